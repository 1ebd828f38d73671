"""Queries of the engine's main paths: a save is made from the driver's tables, taken apart, committed, read, restored.

Every document is a chunk of a region file: id, light, status, text and one section of cells. Stores and folders are
made anew for each call, in the folder that driver and executors share.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockstrata.functions import packing
from blockstrata.functions.paths import layout
from blockstrata.operators.flatten import flatten, region_sections, unflatten
from blockstrata.operators.registry import Block, Registry
from blockstrata.operators.sections import Section, dump_sections, load_sections, section_bytes, write_biomes, write_blocks
from blockstrata.plans import history
from blockstrata.plans.store import Store
from blockstrata.queries import _BLOB, QUERIES, SQL, _by_region, _dealt, _t, query
from blockstrata.sources import files, nbt, profiles
from blockstrata.sources.region import write_region

__all__ = ["QUERIES", "SQL"]
NONE = Registry("none", [], {})
#: Three blocks, the last with states of its own, and three biomes.
WORLD = Registry("test", [Block("b0", 0, 0), Block("b1", 1, 1), Block("b2", 2, 2, [("lit", ["true", "false"]), ("age", ["0", "1", "2"])])], {"plains": 0, "river": 5, "taiga": 9})
_WHEN = datetime(2024, 1, 1, tzinfo=UTC)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, on one machine alone, below a temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(there or tempfile.mkdtemp(prefix='blockstrata-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# -- files and snapshots ------------------------------------------------------------------------------------------

_KEY = "'w/' || source || '/' || doc_id || '.json'"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("w/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".json"))
    return _t(spark, sf_dir, "documents").select("doc_id", key.alias("key"), F.col("text").cast("binary").alias("content"))


def _digests(entries: DataFrame) -> DataFrame:
    return entries.select("key", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest"))


def _store(spark: SparkSession, entries: DataFrame) -> Store:
    store = Store(spark, scratch(spark, "store"))
    store.commit(entries, "first", init=True, ts=_WHEN)
    return store


_WHOLE = f"SELECT {_KEY} AS key, octet_length(encode(text))::bigint AS size, sha256(text) AS digest FROM documents"


@query(_WHOLE)
def folder_put_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written below a folder and read again."""
    root = scratch(spark, "folder")
    files.put(_files(spark, sf_dir), root)
    return _digests(files.scan(spark, root))


@query(f"SELECT {_KEY} AS key FROM documents WHERE source LIKE '%1' AND doc_id >= 10 AND doc_id <= 99")
def folder_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "folder")
    files.put(_files(spark, sf_dir), root)
    return files.glob(spark, root, "w/*1/[0-9][0-9].json")


@query("SELECT (25 - row_number() OVER (ORDER BY n_nationkey))::int AS ordinal, 'n/' || n_nationkey || '.json' AS key, sha256(n_name) AS digest FROM nation")
def folder_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch read from a folder, in the order asked for."""
    root = scratch(spark, "folder")
    files.put(_nations(spark, sf_dir), root)
    return _looked_up(files.scan(spark, root))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation").select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string"), F.lit(".json")).alias("key"), F.col("n_name").cast("binary").alias("content"))


def _looked_up(entries: DataFrame) -> DataFrame:
    got = files.lookup(entries, [f"n/{i}.json" for i in range(24, -1, -1)])
    return got.select("ordinal", "key", F.sha2("content", 256).alias("digest"))


@query("SELECT (25 - row_number() OVER (ORDER BY n_nationkey))::int AS ordinal, 'n/' || n_nationkey || '.json' AS key, sha256(n_name) AS digest FROM nation")
def snapshot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch read at a commit, in the order asked for."""
    return _looked_up(_store(spark, _nations(spark, sf_dir)).entries("main"))


@query(_WHOLE)
def snapshot_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A save flattened, committed and read at the branch."""
    return _digests(_store(spark, flatten(_files(spark, sf_dir), NONE)).entries("main"))


@query(f"SELECT {_KEY} AS path, {_BLOB} AS oid FROM documents WHERE source LIKE '%2'")
def snapshot_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, _files(spark, sf_dir)).listing("main", "w/*2/*.json")


@query(f"""WITH f AS (SELECT source, hex(encode('100644 ' || doc_id || '.json' || chr(0))) || upper({_BLOB}) AS h, doc_id || '.json' AS k FROM documents),
d AS (SELECT source, string_agg(h, '' ORDER BY encode(k)) AS h FROM f GROUP BY source),
s AS (SELECT hex(encode('40000 ' || source || chr(0))) || upper(sha1(encode('tree ' || octet_length(from_hex(h)) || chr(0)) || from_hex(h))) AS h, source FROM d),
w AS (SELECT string_agg(h, '' ORDER BY encode(source || '/')) AS h FROM s),
r AS (SELECT hex(encode('40000 w' || chr(0))) || upper(sha1(encode('tree ' || octet_length(from_hex(h)) || chr(0)) || from_hex(h))) AS h FROM w),
t AS (SELECT sha1(encode('tree ' || octet_length(from_hex(h)) || chr(0)) || from_hex(h)) AS tree_oid FROM r),
b AS (SELECT tree_oid, 'tree ' || tree_oid || chr(10) || 'author nobody <nobody@localhost> 1704067200 +0000' || chr(10) || 'committer nobody <nobody@localhost> 1704067200 +0000' || chr(10) || chr(10) || 'first' || chr(10) AS b FROM t)
SELECT sha1(encode('commit ' || octet_length(encode(b)) || chr(0) || b)) AS commit_id, tree_oid, 0 AS parents, 'first' AS message FROM b""")
def snapshot_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commit's row: its ids are git's."""
    return _store(spark, _files(spark, sf_dir)).table("commits").select("commit_id", "tree_oid", F.size("parents").alias("parents"), "message")


_TWO = f"""o AS (SELECT {_KEY} AS path, text FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT {_KEY} AS path, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)"""


def _two(spark: SparkSession, sf_dir: str) -> tuple[Store, str]:
    """A store of two commits and the first one's id."""
    rows = _files(spark, sf_dir)
    store = Store(spark, scratch(spark, "store"))
    first = store.commit(rows.where("doc_id % 7 <> 0").select("key", "content"), "first", init=True, ts=_WHEN)
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit(b"!"))).otherwise(F.col("content"))
    store.commit(rows.where("doc_id % 11 <> 0").select("key", changed.alias("content")), "second", ts=_WHEN)
    return store, first


@query(f"WITH {_TWO} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'A' WHEN n.path IS NULL THEN 'D' WHEN o.text = n.text THEN '=' ELSE 'M' END AS change FROM o FULL JOIN n ON o.path = n.path")
def store_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, first = _two(spark, sf_dir)
    return history.diff(store.listing(first), store.listing("main"))


@query(f"WITH {_TWO} SELECT path AS key, octet_length(encode(text))::bigint AS size, sha256(text) AS digest FROM o")
def checkout_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two commits, restored to a folder and scanned there."""
    store, first = _two(spark, sf_dir)
    root = scratch(spark, "folder")
    files.put(unflatten(store.entries(first[:12]), NONE), root)
    return _digests(files.scan(spark, root))


@query(f"WITH {_TWO} SELECT path AS key, octet_length(encode(text))::bigint AS size, sha256(text) AS digest FROM n")
def repacked_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branch of a compacted store."""
    store, _ = _two(spark, sf_dir)
    return _digests(store.compact(scratch(spark, "compact")).entries("main"))


@query(f"WITH {_TWO}, b AS (SELECT text FROM o UNION SELECT text FROM n) SELECT count(*)::bigint AS blobs, sum(octet_length(encode(text)))::bigint AS bytes, 2::bigint AS commits FROM b")
def pulled_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What another store has after a pull, and a pull again."""
    store, _ = _two(spark, sf_dir)
    other = Store(spark, scratch(spark, "other"))
    other.pull(store)
    other.pull(store)
    blobs = other.table("blobs").agg(F.count("*").alias("blobs"), F.sum("size").alias("bytes"))
    return blobs.join(other.table("commits").agg(F.count("*").alias("commits")))


@query(f"SELECT {_KEY} AS path, {_BLOB} AS oid FROM documents")
def git_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch exported to a git repository, and what git lists there."""
    from blockstrata.sources import git_objects

    store, bare = _store(spark, _files(spark, sf_dir)), scratch(spark, "git")
    git_objects.export(store, "main", bare.removeprefix("file://"))
    return git_objects.listing(spark, bare.removeprefix("file://"), "main")


@query(f"WITH {_TWO} SELECT path, sha1(encode('blob ' || octet_length(encode(text)) || chr(0) || text)) AS oid FROM o")
def git_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch of two commits exported at once, and what git lists at the first one."""
    from blockstrata.sources import git_objects

    (store, first), bare = _two(spark, sf_dir), scratch(spark, "git").removeprefix("file://")
    git_objects.export(store, "main", bare, history=True)
    return git_objects.listing(spark, bare, first)


@query(f"WITH {_TWO} SELECT 1 AS n, path AS key, sha256(text) AS digest FROM o UNION ALL SELECT 2, path, sha256(text) FROM n")
def repacked_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both snapshots of a compacted store that got the second one, and what it needs, later."""
    store, first = _two(spark, sf_dir)
    early = Store(spark, scratch(spark, "early"))
    early.commit(store.entries(first), "first", init=True, ts=_WHEN)
    out = scratch(spark, "compact")
    early.compact(out)
    packed = store.compact(out)
    at = lambda n, commit: packed.entries(commit).select(F.lit(n).alias("n"), "key", F.sha2("content", 256).alias("digest"))
    return at(1, first).unionByName(at(2, "main"))


@query("SELECT save_dir, branch FROM (SELECT source AS save_dir, max_by(lang, -doc_id) AS branch FROM documents GROUP BY source) WHERE save_dir <> 'src1' UNION ALL SELECT 'new', 'main'")
def profiles_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles written as JSON, read, one added and one deleted."""
    path = scratch(spark, "profiles")
    rows = _t(spark, sf_dir, "documents").orderBy("doc_id").select(F.col("source").alias("save_dir"), F.lit("1").alias("mc_version"), F.col("lang").alias("branch"), F.lit("").alias("remote_url"), F.lit("").alias("updated_at"), F.col("doc_id").alias("_n"))
    profiles.write(profiles.normalize(rows), path)
    more = profiles.upsert(profiles.read(spark, path), {"save_dir": "new", "mc_version": "9", "branch": "main", "remote_url": ""})
    return profiles.delete(more, "src1").select("save_dir", "branch")


# -- chunks -------------------------------------------------------------------------------------------------------


def _world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region files, key and content; a third of the chunks is not full."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 64 - 32).cast("int").alias("x"), F.floor(F.col("doc_id") / 64).cast("int").alias("z"))
    docs = docs.withColumn("rx", packing.region_of(F.col("x"))).withColumn("rz", packing.region_of(F.col("z")))

    def chunk(doc_id: int, text: str) -> bytes:
        blocks = np.arange(4096) * doc_id % (1 + doc_id % 8)
        biomes = np.array([0, 5, 9])[np.arange(64) * doc_id % (1 + doc_id % 3)]
        cells = [(b"Y", (nbt.BYTE, doc_id % 7 - 3)), (b"biomes", (nbt.COMPOUND, write_biomes(biomes, WORLD))), (b"block_states", (nbt.COMPOUND, write_blocks(blocks, WORLD)))]
        status = b"minecraft:noise" if doc_id % 3 == 0 else b"minecraft:full"
        return nbt.dump(b"", [
            (b"id", (nbt.LONG, doc_id)), (b"isLightOn", (nbt.BYTE, 1)), (b"sections", (nbt.LIST, (nbt.COMPOUND, [cells]))), (b"Status", (nbt.STRING, status)), (b"t", (nbt.BYTES, text.encode())),
        ])

    def write(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["z"], r["x"]))
        rx, rz = rows[0]["rx"], rows[0]["rz"]
        made = write_region(rx, rz, bytes(range(256)) * 16, ((r["x"], r["z"], chunk(r["doc_id"], r["text"])) for r in rows))
        return pa.table({"key": [f"w/region/r.{rx}.{rz}.mca"], "content": pa.array([made], pa.binary())})

    return _by_region(docs).applyInArrow(write, "key string, content binary")


_PLACE = "(doc_id % 64 - 32)::int AS chunk_x, (doc_id // 64)::int AS chunk_z"
_REST = """sha256(from_hex('0a0000' || '080006537461747573000e' || hex(encode('minecraft:full')) || '0400026964' || lpad(hex(doc_id), 16, '0') || '01000969734c696768744f6e00' || '07000174' || lpad(hex(octet_length(encode(text))), 8, '0') || hex(encode(text)) || '00'))"""
_OTHER = f"SELECT 'w/region/r.' || ((doc_id % 64 - 32) >> 5) || '.' || (doc_id // 2048) || '.mca/other/c.' || (doc_id % 64 - 32) || '.' || (doc_id // 64) || '.nbt' AS key, {_REST} AS digest FROM documents WHERE doc_id % 3 <> 0"


@query(_OTHER)
def chunk_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of full chunks without their sections, with light reset."""
    flat = flatten(_world(spark, sf_dir), WORLD).where("key like '%/other/%'")
    return flat.select("key", F.sha2("content", 256).alias("digest"))


@query(_OTHER)
def region_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As chunk_other, of regions flattened, committed, read at the commit, restored as files and flattened again."""
    store = _store(spark, flatten(_world(spark, sf_dir), WORLD))
    again = flatten(unflatten(store.entries("main"), WORLD), WORLD).where("key like '%/other/%'")
    return again.select("key", F.sha2("content", 256).alias("digest"))


def _cells(n: int, biomes: str, blocks: str) -> str:
    """Sums in which every cell's place counts."""
    at = lambda values, size: f"list_sum(list_transform(range({size}), lambda i: (i + 1) * ({values})))::bigint"
    return f"SELECT {_PLACE}, (doc_id % 7 - 3)::int AS y, {at(biomes, 64)} AS biome, {at(blocks, 4096)} AS block_state FROM documents WHERE doc_id % {n} <> 0"


_SECTIONS = ("[0, 5, 9][((i * doc_id) % (1 + doc_id % 3) + 1)::int]", "(i * doc_id) % (1 + doc_id % 8)")


def _weighed(rows: DataFrame) -> DataFrame:
    total = lambda c: F.aggregate(F.transform(c, lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("chunk_x", "chunk_z", F.col("y").cast("int").alias("y"), total("biome").alias("biome"), total("block_state").alias("block_state"))


@query(_cells(1, *_SECTIONS).replace("WHERE doc_id % 1 <> 0", ""))
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all chunks, decoded through palettes and registry."""
    return _weighed(region_sections(_world(spark, sf_dir), WORLD))


@query(_cells(3, *_SECTIONS))
def section_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of regions that were flattened and restored, so encoded anew."""
    return _weighed(region_sections(unflatten(flatten(_world(spark, sf_dir), WORLD), WORLD), WORLD))


@query("SELECT 'w/region/r.' || rx || '.' || rz || '.mca' AS region, sha256(from_hex(repeat(h, 16))) AS digest FROM (SELECT DISTINCT (doc_id % 64 - 32) >> 5 AS rx, doc_id // 2048 AS rz FROM documents), (SELECT string_agg(lpad(hex(b), 2, '0'), '' ORDER BY b) AS h FROM range(256) r(b))")
def region_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockstrata.functions.paths import SENTINEL, strip_suffix

    flat = flatten(_world(spark, sf_dir), WORLD)
    return flat.select(strip_suffix(F.col("key"), SENTINEL).alias("region"), F.sha2("content", 256).alias("digest")).where("region is not null")


@query("SELECT doc_id, 'w/region/r.0.0.mca/sections/' AS folder, list_sum(list_transform(range(5), lambda b: (((doc_id % 32) >> b) & 1) * (1 << (2 * b)) + ((((doc_id // 64) % 32) >> b) & 1) * (2 << (2 * b))))::bigint AS place FROM documents")
def chunk_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where chunks come in a compacted store."""
    name = F.concat(F.lit("w/region/r.0.0.mca/sections/c."), (F.col("doc_id") % 64 - 32).cast("string"), F.lit("."), F.floor(F.col("doc_id") / 64).cast("string"), F.lit(".dump"))
    return _t(spark, sf_dir, "documents").select("doc_id", layout(name).alias("at")).select("doc_id", "at.folder", "at.place")


@query(f"SELECT {_PLACE} FROM documents")
def region_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a folder of region files, by the data source."""
    from blockstrata.sources.region_source import register

    root = scratch(spark, "world")
    files.put(_world(spark, sf_dir), root)
    register(spark)
    return spark.read.format("region").load(root).select("chunk_x", "chunk_z")


_LE = "list_reduce(list_transform(range(4096), lambda i: lpad(hex((i * p_size) % (1 + p_size % 3)), 2, '0') || '00'), lambda a, b: a || b)"


@query(f"SELECT p_partkey, sha256(from_hex({_LE})) AS block, sha256(from_hex(repeat('05', 64))) AS biome FROM part")
def section_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as they are printed, of sections that were dumped and loaded."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = load_sections(dump_sections([Section(0, np.full(64, 5), np.arange(4096) * size % (1 + size % 3))]))[0]
                out.append((key, *[hashlib.sha256(section_bytes(s, what)).hexdigest() for what in ("block", "biome")]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], ["p_partkey", "block", "biome"])

    return _dealt(_t(spark, sf_dir, "part").select("p_partkey", "p_size")).mapInArrow(run, "p_partkey bigint, block string, biome string")


@query("SELECT state_id, CASE WHEN state_id < 2 THEN 'b' || state_id ELSE 'b2' END AS name, CASE WHEN state_id < 2 THEN '' ELSE ['true', 'false'][((state_id - 2) // 3 + 1)::int] || ['0', '1', '2'][((state_id - 2) % 3 + 1)::int] END AS props, count(*)::bigint AS parts FROM (SELECT (p_size % 8)::int AS state_id FROM part) GROUP BY 1")
def registry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of parts, named by the registry's dimension."""
    dim = F.broadcast(WORLD.block_states(spark))
    named = _t(spark, sf_dir, "part").select((F.col("p_size") % 8).cast("int").alias("state_id")).join(dim, "state_id")
    props = F.array_join(F.transform(F.reverse("props"), lambda p: p["v"]), "")
    return named.groupBy("state_id", "name", props.alias("props")).agg(F.count("*").alias("parts"))
