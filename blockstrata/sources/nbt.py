"""Tag trees (NBT, big-endian): reader, writer and canonical order.

A tag is (kind, value). A compound's value is a list of (key, tag) in file order; a list's is (kind, values);
numeric arrays are kept as their bytes, strings and keys as modified UTF-8 bytes; lists of numbers may be numpy arrays
instead. So what is read is written
again without change, and keys are compared by bytes.
"""

from __future__ import annotations

import struct
from typing import Any

import numpy as np

BYTE, SHORT, INT, LONG, FLOAT, DOUBLE, BYTES, STRING, LIST, COMPOUND, INTS, LONGS = range(1, 13)
_FIXED = {BYTE: ">b", SHORT: ">h", INT: ">i", LONG: ">q", FLOAT: ">f", DOUBLE: ">d"}
_SIZE = {kind: struct.calcsize(row) for kind, row in _FIXED.items()}
_ARRAY = {BYTE: ">i1", SHORT: ">i2", INT: ">i4", LONG: ">i8", FLOAT: ">f4", DOUBLE: ">f8"}
_WIDTH = {BYTES: 1, INTS: 4, LONGS: 8}
Tag = tuple[int, Any]


class _Reader:
    def __init__(self, data: bytes, arrays: bool = False):
        self.data, self.at, self.size, self.arrays = data, 0, len(data), arrays

    def take(self, n: int) -> bytes:
        at = self.at
        end = at + n
        if n < 0 or end > self.size:
            raise ValueError("tag tree ends early")
        self.at = end
        return self.data[at:end]

    def number(self, kind: int) -> Any:
        at = self.at
        end = at + _SIZE[kind]
        if end > self.size:
            raise ValueError("tag tree ends early")
        self.at = end
        return struct.unpack_from(_FIXED[kind], self.data, at)[0]

    def string(self) -> bytes:
        return self.take(int.from_bytes(self.take(2)))

    def value(self, kind: int) -> Any:
        if kind == COMPOUND:
            out = []
            while k := self.take(1)[0]:
                key = self.take(int.from_bytes(self.take(2)))
                out.append((key, (k, self.value(k))))
            return out
        if kind == STRING:
            return self.take(int.from_bytes(self.take(2)))
        if kind in _FIXED:
            return self.number(kind)
        if kind in _WIDTH:
            return self.take(self.number(INT) * _WIDTH[kind])
        if kind == LIST:
            of = self.take(1)[0]
            n = self.number(INT)
            if of == 0 and n > 0:
                raise ValueError("a list of nothing has items")
            if of in _FIXED and n > 0:
                if self.arrays:
                    return of, np.frombuffer(self.take(n * _SIZE[of]), _ARRAY[of])
                row = f">{n}{_FIXED[of][1]}"
                return of, list(struct.unpack(row, self.take(struct.calcsize(row))))
            return of, [self.value(of) for _ in range(n)]
        raise ValueError(f"unknown tag {kind}")


def load(data: bytes, *, arrays: bool = False) -> tuple[bytes, list]:
    """(root name, root compound's items), with ``arrays`` lists of numbers as arrays."""
    r = _Reader(data, arrays)
    if not data or r.take(1)[0] != COMPOUND:
        raise ValueError("not a tag tree")
    return r.string(), r.value(COMPOUND)


def _write(kind: int, value: Any, out: list[bytes]) -> None:
    if kind in _FIXED:
        out.append(struct.pack(_FIXED[kind], value))
    elif kind in _WIDTH:
        out += [(len(value) // _WIDTH[kind]).to_bytes(4), value]
    elif kind == STRING:
        out += [len(value).to_bytes(2), value]
    elif kind == LIST:
        of, items = value
        out += [bytes([of]), len(items).to_bytes(4)]
        if isinstance(items, np.ndarray):
            out.append(items.astype(_ARRAY[of]).tobytes())
            return
        if of in _FIXED:
            out.append(struct.pack(f">{len(items)}{_FIXED[of][1]}", *items))
            return
        for x in items:
            _write(of, x, out)
    else:
        for key, (k, v) in value:
            out += [bytes([k]), len(key).to_bytes(2), key]
            _write(k, v, out)
        out.append(b"\0")


def dump(name: bytes, items: list) -> bytes:
    out = [bytes([COMPOUND]), len(name).to_bytes(2), name]
    _write(COMPOUND, items, out)
    return b"".join(out)


def _ordered(kind: int, value: Any) -> Any:
    if kind == COMPOUND:
        return sorted(((key, (k, _ordered(k, v))) for key, (k, v) in value), key=lambda x: x[0])
    if kind == LIST and value[0] in (LIST, COMPOUND):
        return value[0], [_ordered(value[0], x) for x in value[1]]
    return value


def canonical(items: list) -> list:
    """Keys of all compounds in order of their bytes, also in lists; lists keep their order."""
    return _ordered(COMPOUND, items)


def get(items: list, key: str, kind: int) -> Any:
    """Value of a key if it has that kind, else None."""
    wanted = key.encode()
    for name, (k, v) in items:
        if name == wanted:
            return v if k == kind else None
    return None


def text(value: bytes) -> str:
    """From modified UTF-8, which writes U+0000 in two bytes and large characters as two surrogates."""
    if value.isascii():
        return value.decode()
    return value.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def mutf8(value: str) -> bytes:
    if value.isascii() and "\0" not in value:
        return value.encode()
    out = bytearray()
    for c in value:
        if c == "\0":
            out += b"\xc0\x80"
        elif ord(c) > 0xFFFF:
            pair = c.encode("utf-16-be")
            out += pair[:2].decode("utf-16-be", "surrogatepass").encode("utf-8", "surrogatepass") + pair[2:].decode("utf-16-be", "surrogatepass").encode("utf-8", "surrogatepass")
        else:
            out += c.encode("utf-8", "surrogatepass")
    return bytes(out)
