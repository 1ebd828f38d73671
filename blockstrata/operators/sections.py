"""Chunks split into sections of cells and the rest, and put together again.

A container is a palette with packed rows of indices. Cells are arrays of ids: 64 biomes, 4096 block states.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from blockstrata.functions.packing import first_seen, pack_cells, unpack_cells, width_of
from blockstrata.operators.registry import NAMESPACE, Registry
from blockstrata.sources import nbt

BIOMES, BLOCKS, BLOCK_BITS = 64, 4096, 4


class Section(NamedTuple):
    y: int
    biome: np.ndarray
    block_state: np.ndarray


def _cells(container: list, entries: list[int], cells: int, least: int) -> np.ndarray:
    """A palette of one, or none of the rows, fills the section."""
    raw = nbt.get(container, "data", nbt.LONGS)
    bits = width_of(len(entries), least)
    if raw is None or bits == 0:
        return np.full(cells, entries[0], "i8")
    return np.array(entries, "i8")[unpack_cells(np.frombuffer(raw, ">u8"), bits, cells)]


def read_biomes(container: list, registry: Registry) -> np.ndarray:
    of, names = nbt.get(container, "palette", nbt.LIST) or (0, [])
    if of != nbt.STRING or not names:
        raise ValueError("a biome palette is a list of names")
    return _cells(container, [registry.biome_id(nbt.text(n)) for n in names], BIOMES, 0)


def read_blocks(container: list, registry: Registry) -> np.ndarray:
    of, entries = nbt.get(container, "palette", nbt.LIST) or (0, [])
    if of != nbt.COMPOUND or not entries:
        raise ValueError("a block palette is a list of compounds")
    ids = []
    for e in entries:
        name = nbt.get(e, "Name", nbt.STRING)
        if name is None:
            raise ValueError("a palette entry has no Name")
        props = {nbt.text(k): nbt.text(v) for k, (kind, v) in nbt.get(e, "Properties", nbt.COMPOUND) or [] if kind == nbt.STRING}
        ids.append(registry.state_id(nbt.text(name), props))
    return _cells(container, ids, BLOCKS, BLOCK_BITS)


def _rows(index: np.ndarray, bits: int) -> bytes:
    return pack_cells(index, bits).astype(">u8").tobytes()


def write_biomes(cells: np.ndarray, registry: Registry) -> list:
    values, index = first_seen(cells)
    names = (nbt.LIST, (nbt.STRING, [nbt.mutf8(NAMESPACE + registry.biome_name(int(v))) for v in values]))
    if len(values) == 1:
        return [(b"palette", names)]
    return [(b"data", (nbt.LONGS, _rows(index, width_of(len(values))))), (b"palette", names)]


def write_blocks(cells: np.ndarray, registry: Registry) -> list:
    """Rows are always written, also for a palette of one."""
    values, index = first_seen(cells)
    entries = []
    for v in values:
        name, props = registry.state(int(v))
        entry = [(b"Name", (nbt.STRING, nbt.mutf8(NAMESPACE + name)))]
        if props:
            entry.append((b"Properties", (nbt.COMPOUND, [(nbt.mutf8(k), (nbt.STRING, nbt.mutf8(x))) for k, x in props])))
        entries.append(entry)
    return [(b"data", (nbt.LONGS, _rows(index, width_of(len(values), BLOCK_BITS)))), (b"palette", (nbt.LIST, (nbt.COMPOUND, entries)))]


def split_chunk(items: list, registry: Registry) -> tuple[list, list[Section]]:
    """(the rest, sections). Light is reset; sections beyond the world, first or last without cells, are left out."""
    found = nbt.get(items, "sections", nbt.LIST)
    if found is None or (found[0] != nbt.COMPOUND and found[1]):
        raise ValueError("a chunk has no list of sections")
    out, last = [], len(found[1]) - 1
    for i, s in enumerate(found[1]):
        y, biomes, blocks = nbt.get(s, "Y", nbt.BYTE), nbt.get(s, "biomes", nbt.COMPOUND), nbt.get(s, "block_states", nbt.COMPOUND)
        if y is None:
            raise ValueError(f"section {i} has no Y")
        if biomes is None or blocks is None:
            if i in (0, last):
                continue
            raise ValueError(f"section {i} (Y {y}) has no cells")
        out.append(Section(y, read_biomes(biomes, registry), read_blocks(blocks, registry)))
    reset = lambda k, t: (nbt.BYTE, 0) if k == b"isLightOn" and t[0] == nbt.BYTE else t
    return [(k, reset(k, t)) for k, t in items if k != b"sections"], out


def restore_chunk(rest: list, sections: list[Section], registry: Registry) -> list:
    made = []
    for s in sections:
        if len(s.biome) != BIOMES or len(s.block_state) != BLOCKS:
            raise ValueError("a section has 64 biomes and 4096 block states")
        made.append([
            (b"Y", (nbt.BYTE, s.y)), (b"biomes", (nbt.COMPOUND, write_biomes(s.biome, registry))),
            (b"block_states", (nbt.COMPOUND, write_blocks(s.block_state, registry))),
        ])
    return [*rest, (b"sections", (nbt.LIST, (nbt.COMPOUND if made else 0, made)))]


def dump_sections(sections: list[Section]) -> bytes:
    """Cells as a tag tree: y, biome as bytes, block_state as a list of shorts (bits of an unsigned number)."""
    rows = [[
        (b"y", (nbt.BYTE, s.y)), (b"biome", (nbt.BYTES, s.biome.astype("u1").tobytes())),
        (b"block_state", (nbt.LIST, (nbt.SHORT, s.block_state.astype("u2").view("i2")))),
    ] for s in sections]
    return nbt.dump(b"", [(b"sections", (nbt.LIST, (nbt.COMPOUND if rows else 0, rows)))])


def load_sections(data: bytes) -> list[Section]:
    _, items = nbt.load(data, arrays=True)
    out = []
    for s in (nbt.get(items, "sections", nbt.LIST) or (0, []))[1]:
        y, biome, (_, blocks) = nbt.get(s, "y", nbt.BYTE), nbt.get(s, "biome", nbt.BYTES), nbt.get(s, "block_state", nbt.LIST)
        out.append(Section(y, np.frombuffer(biome, "u1").astype("i8"), np.asarray(blocks, "i2").view("u2").astype("i8")))
    return out


def section_bytes(section: Section, what: str) -> bytes:
    """Cells as they are printed: 4096 little-endian 16-bit numbers ('block') or 64 bytes ('biome')."""
    return section.block_state.astype("<u2").tobytes() if what == "block" else section.biome.astype("u1").tobytes()
