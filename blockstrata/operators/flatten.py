"""Saves as many small canonical objects, and back.

flatten: files (key, content) to objects. PNG and JSON files pass; .dat files are decompressed and sorted;
region files fall apart into timestamps, chunks and sections. unflatten is the inverse, up to what flattening
leaves out. Files that no pattern takes are dropped; see unrouted().
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockstrata.functions.paths import SENTINEL, route
from blockstrata.operators.registry import Registry
from blockstrata.operators.sections import dump_sections, load_sections, restore_chunk, split_chunk
from blockstrata.sources import nbt
from blockstrata.sources.batches import PART, in_parts, parts
from blockstrata.sources.region import read_region, region_chunks, timestamps_of, write_region

OBJECT = "key string, content binary"
CHUNK = "region_key string, chunk_x int, chunk_z int, nbt binary"
SECTION = "region_key string, chunk_x int, chunk_z int, ord int, y tinyint, biome array<smallint>, block_state array<int>"
Then = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
FULL = "minecraft:full"
#: Sections in a batch of cells, of some 16 KB each.
SECTIONS = 128


def gunzip(data: bytes) -> bytes:
    """Data without a gzip header passes as it is; a damaged stream is an error."""
    if data[:2] != b"\x1f\x8b":
        return data
    stream = zlib.decompressobj(31)
    out = stream.decompress(data) + stream.flush()
    if not stream.eof:
        raise ValueError("gzip stream ends early")
    return out


def _canonical(data: bytes) -> bytes:
    name, items = nbt.load(data)
    return nbt.dump(name, nbt.canonical(items))


def _coordinates(key: str) -> tuple[int, int]:
    parts = key.rpartition("/")[2].split(".")
    try:
        return int(parts[1]), int(parts[2])
    except (IndexError, ValueError):
        raise ValueError(f"no region coordinates in {key}") from None


def _flat_region(key: str, content: bytes, registry: Registry | None, keep_partial: bool) -> Iterator[tuple[str, bytes]]:
    for i, (x, z, raw) in enumerate(region_chunks(content, *_coordinates(key))):
        if i == 0:
            yield f"{key}{SENTINEL}", timestamps_of(content)
        name, items = nbt.load(raw)
        if registry is None:
            yield f"{key}/c.{x}.{z}.nbt", nbt.dump(name, nbt.canonical(items))
            continue
        status = nbt.get(items, "Status", nbt.STRING)
        if status is None:
            raise ValueError(f"chunk {x},{z} of {key} has no Status")
        if nbt.text(status) != FULL and not keep_partial:
            continue
        rest, sections = split_chunk(items, registry)
        yield f"{key}/other/c.{x}.{z}.nbt", nbt.dump(name, nbt.canonical(rest))
        yield f"{key}/sections/c.{x}.{z}.dump", dump_sections(sections)


def flatten(files: DataFrame, registry: Registry, *, keep_partial: bool = False) -> DataFrame:
    """A scan, a filter on the name and one pass over the content; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            as_is = pc.equal(batch["codec"], "raw")
            if (raw := batch.filter(as_is)).num_rows:  # these stay as they came
                yield raw.select(["key", "content"])
            small = []
            for key, content, codec in zip(*(c.to_pylist() for c in batch.filter(pc.invert(as_is)).columns), strict=True):
                if codec == "gzip":
                    small.append((key, _canonical(gunzip(content))))
                else:
                    yield from _in_parts(_flat_region(key, content, registry if codec == "region" else None, keep_partial))
            yield from _in_parts(small)

    return files.select("key", "content", route(F.col("key")).alias("codec")).where("codec is not null").mapInArrow(run, OBJECT)


def _in_parts(rows: Iterable[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """Objects in batches of some PART bytes, as they are made."""
    return map(_objects, in_parts(rows, PART))


def _objects(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["key", "content"])


def unrouted(files: DataFrame) -> DataFrame:
    """Keys that flatten() drops."""
    return files.select("key").where(route(F.col("key")).isNull())


def damaged_chunks(files: DataFrame) -> DataFrame:
    """key, chunk_x, chunk_z, error of chunks that can't be decompressed and so are missing from flatten()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = []
            for key, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                region = read_region(content, *_coordinates(key))
                rows += [(key, x, z, e) for x, z, e in (region.errors if region else [])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["key", "chunk_x", "chunk_z", "error"])

    routed = files.where(route(F.col("key")).isin("region", "other_region"))
    return routed.select("key", "content").mapInArrow(run, "key string, chunk_x int, chunk_z int, error string")


def chunks(files: DataFrame, then: Then | None = None, schema: str = CHUNK) -> DataFrame:
    """region_key, chunk_x, chunk_z, nbt of every readable chunk. A filter on the region's name prunes files.

    ``then`` makes rows of ``schema`` from these in the same worker, so chunks neither go back to Spark, where they
    are gathered by thousands, nor need another worker a core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for key, content in zip(*batch.columns, strict=True):
                key, content = key.as_py(), content.as_buffer()
                found = ((key, x, z, raw) for x, z, raw in region_chunks(content, *_coordinates(key)))
                for rows in in_parts(found, PART):
                    keys, xs, zs, raw = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(xs, pa.int32()), pa.array(zs, pa.int32()), pa.array(raw, pa.binary())], ["region_key", "chunk_x", "chunk_z", "nbt"])

    routed = files.where(route(F.col("key")).isin("region", "other_region"))
    return routed.select("key", "content").mapInArrow((lambda batches: then(run(batches))) if then else run, schema)


def sections(chunk_rows: DataFrame, registry: Registry) -> DataFrame:
    """region_key, chunk_x, chunk_z, ord, y, biome, block_state of chunks()."""
    return chunk_rows.select("region_key", "chunk_x", "chunk_z", "nbt").mapInArrow(_sections_of(registry), SECTION)


def region_sections(files: DataFrame, registry: Registry) -> DataFrame:
    """sections() of the chunks() of files, by one worker."""
    return chunks(files, _sections_of(registry), SECTION)


def _sections_of(registry: Registry) -> Then:
    def made(rows: list[tuple]) -> pa.RecordBatch:
        keys, xs, zs, ords, found = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([
            pa.array(keys), pa.array(xs, pa.int32()), pa.array(zs, pa.int32()), pa.array(ords, pa.int32()), pa.array([s.y for s in found], pa.int8()),
            _lists([s.biome for s in found], "i2"), _lists([s.block_state for s in found], "i4"),
        ], ["region_key", "chunk_x", "chunk_z", "ord", "y", "biome", "block_state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in parts(batches):
            for key, x, z, raw in zip(*batch.columns, strict=True):
                key, x, z = key.as_py(), x.as_py(), z.as_py()
                rows += [(key, x, z, i, s) for i, s in enumerate(split_chunk(nbt.load(raw.as_py())[1], registry)[1])]
                if len(rows) >= SECTIONS:
                    yield made(rows)
                    rows = []
        if rows:
            yield made(rows)

    return run


def _lists(cells: list[np.ndarray], kind: str) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, cells)]).astype("i4"), np.concatenate(cells).astype(kind))


_PART = r"^(.*/(region|entities|poi)/r\.[^/]*\.mca)/(timestamp-header|(?:(other|sections)/)?c\.(-?\d+)\.(-?\d+)\.(?:nbt|dump))$"


def unflatten(objects: DataFrame, registry: Registry) -> DataFrame:
    """Files again. Objects of a region (1,024 chunks at most) are grouped by its key, an equality, and encoded
    together; a region is there if its timestamps are."""
    key = F.col("key")
    part = lambda i: F.regexp_extract(key, _PART, i)
    plain = objects.where(route(key).isin("raw", "gzip")).select("key", "content", route(key).alias("codec"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield _objects([(k, content if codec == "raw" else gzip.compress(content, mtime=0)) for k, content, codec in rows])

    def build(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        region = rows[0]["region"]
        stamps = [r["content"] for r in rows if r["part"] == "timestamp-header"]
        if not stamps:
            return pa.Table.from_batches([_objects([])], schema=_SCHEMA)
        kept, dumps = {}, {}
        for r in rows:
            if r["part"] != "timestamp-header":
                (dumps if r["folder"] == "sections" else kept)[int(r["x"]), int(r["z"])] = r["content"]
        made = []
        for (x, z), raw in sorted(kept.items(), key=lambda i: (i[0][1], i[0][0])):
            if rows[0]["kind"] == "region":
                if (x, z) not in dumps:
                    raise ValueError(f"chunk {x},{z} of {region} has no sections")
                name, rest = nbt.load(raw)
                raw = nbt.dump(name, restore_chunk(rest, load_sections(dumps[x, z]), registry))
            made.append((x, z, raw))
        return pa.Table.from_batches([_objects([(region, write_region(*_coordinates(region), stamps[0], made))])], schema=_SCHEMA)

    pieces = objects.where(key.rlike(_PART)).select(
        part(1).alias("region"), part(2).alias("kind"), part(3).alias("part"), part(4).alias("folder"), part(5).alias("x"), part(6).alias("z"), "content"
    )
    regions = pieces.groupBy("region").applyInArrow(build, OBJECT)
    return plain.mapInArrow(encode, OBJECT).unionByName(regions)


_SCHEMA = pa.schema([("key", pa.string()), ("content", pa.binary())])


def flatten_folder(spark: SparkSession, save: str, out: str, registry: Registry) -> int:
    from blockstrata.sources.files import put, scan

    return put(flatten(scan(spark, save), registry), out)


def unflatten_folder(spark: SparkSession, flat: str, out: str, registry: Registry) -> int:
    from blockstrata.sources.files import put, scan

    return put(unflatten(scan(spark, flat), registry), out)
