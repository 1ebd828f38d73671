"""Keys: safety, glob patterns, routing to codecs and coordinates in names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockstrata.functions.packing import local_of, morton

#: Pattern of a key, codec. No key matches two of them.
ROUTES = (
    ("**/*.png", "raw"), ("**/*.json", "raw"), ("**/*.dat", "gzip"),
    ("**/region/r.*.*.mca", "region"), ("**/entities/r.*.*.mca", "other_region"), ("**/poi/r.*.*.mca", "other_region"),
)
SENTINEL = "/timestamp-header"
UNSAFE = r"(^/)|(^[A-Za-z]:)|((^|[/\\])\.\.([/\\]|$))|(^\\)"


def glob_regex(pattern: str) -> str:
    """One dialect for all stores: ** spans directories, * and ? stay within a name, [...] is a set."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        close = pattern.find("]", i + 2) if c == "[" else -1
        if close > 0:
            body = re.sub(r"([\\\[&])", r"\\\1", pattern[i + 1 : close])  # Java gives these a meaning in sets
            out.append(f"[{'^' + body[1:] if body[0] == '!' else body}]")
            i = close + 1
            continue
        out.append({"*": "[^/]*", "?": "[^/]"}.get(c, re.sub(r"([.^$+(){}\[\]|\\])", r"\\\1", c)))
        i += 1
    return f"^{''.join(out)}$"


def matches(key: Column, pattern: str) -> Column:
    if re.search(UNSAFE, pattern):
        raise ValueError(f"unsafe pattern: {pattern}")
    return key.rlike(glob_regex(pattern))


def is_safe(key: Column) -> Column:
    """Relative, without .. and without a drive."""
    return F.coalesce(~key.rlike(UNSAFE) & (key != ""), F.lit(False))


def safe_key(key: Column) -> Column:
    return F.when(is_safe(key), key).otherwise(F.raise_error(F.concat(F.lit("unsafe key: "), F.coalesce(key, F.lit("null")))))


def route(key: Column) -> Column:
    """Codec of a key; null: no pattern takes it."""
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(ROUTES):
        out = F.when(matches(key, pattern), kind).otherwise(out)
    return out


def basename(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)


def strip_suffix(key: Column, suffix: str) -> Column:
    """Null for keys that don't end so."""
    return F.when(F.endswith(key, F.lit(suffix)), F.substring(key, F.lit(1), F.length(key) - len(suffix)))


def layout(path: Column) -> Column:
    """An order in which similar contents are neighbours: chunks of a region go by kind and then along a Morton curve,
    whatever else by its path."""
    chunk = path.rlike(r"/c\.-?\d+\.-?\d+\.(nbt|dump)$")
    x, z = name_xz(basename(path))
    folder = F.when(chunk, F.regexp_replace(path, "[^/]*$", "")).otherwise(path)
    return F.struct(folder.alias("folder"), F.when(chunk, morton(local_of(x), local_of(z), 5)).alias("place"), path.alias("path"))


def name_xz(name: Column) -> tuple[Column, Column]:
    """Second and third dotted part of a name as numbers: r.-1.0.mca is (-1, 0); null if they aren't."""
    part = lambda i: F.get(F.split(name, r"\."), F.lit(i)).try_cast("int")
    return part(1), part(2)
