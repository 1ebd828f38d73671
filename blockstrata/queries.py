"""The engine's operators on the driver's tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from blockstrata.functions import hashing, packing, paths
from blockstrata.plans import history
from blockstrata.plans.store import last_write
from blockstrata.sources.batches import parts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows with much work each, in tasks for all cores; a scan of a small file makes too few."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _by_region(rows: DataFrame) -> GroupedData:
    """Documents by region, some 1,024 a task, so batches between workers are as large at any size of the table."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // 1024))
    return rows.repartition(tasks, "rx", "rz").groupBy("rx", "rz")


_BLOB = "sha1(encode('blob ' || octet_length(encode(text)) || chr(0) || text))"


@query(f"SELECT doc_id, {_BLOB} AS oid FROM documents")
def blob_oid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", hashing.blob_oid(F.col("text")).alias("oid"))


def _blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", hashing.blob_oid(F.col("text")).alias("oid"), F.octet_length("text").cast("long").alias("size"))


@query(f"SELECT count(*)::bigint AS objects, count(DISTINCT oid)::bigint AS distinct_objects, sum(size)::bigint AS bytes, sum(size) FILTER (n = 1)::bigint AS distinct_bytes FROM (SELECT {_BLOB} AS oid, octet_length(encode(text)) AS size, row_number() OVER (PARTITION BY text) AS n FROM documents)")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.stats(_blobs(spark, sf_dir))


@query(f"SELECT source, count(*)::bigint AS objects, count(DISTINCT oid)::bigint AS distinct_objects, sum(size)::bigint AS bytes, sum(size) FILTER (n = 1)::bigint AS distinct_bytes FROM (SELECT source, {_BLOB} AS oid, octet_length(encode(text)) AS size, row_number() OVER (PARTITION BY source, text) AS n FROM documents) GROUP BY source")
def repo_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.stats(_blobs(spark, sf_dir), "source")


_TREE = "sha1(encode('tree ' || (octet_length(from_hex(h)))::varchar || chr(0)) || from_hex(h))"
_FILES = f"SELECT lang, source, hex(encode('100644 ' || doc_id || '.txt' || chr(0))) || upper({_BLOB}) AS h, doc_id || '.txt' AS k FROM documents"


@query(f"WITH f AS ({_FILES}), d AS (SELECT source, string_agg(h, '' ORDER BY encode(k)) AS h FROM f GROUP BY source) SELECT source, {_TREE} AS tree_oid FROM d")
def tree_oid_by_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "oid", F.lit(False).alias("is_dir"))
    return _blobs(spark, sf_dir).groupBy("source").agg(hashing.tree_oid(F.collect_list(entry)).alias("tree_oid"))


@query(f"""WITH f AS ({_FILES}), d AS (SELECT lang, source, string_agg(h, '' ORDER BY encode(k)) AS h FROM f GROUP BY lang, source),
s AS (SELECT lang, source, hex(encode('40000 ' || source || chr(0))) || upper({_TREE}) AS h FROM d),
l AS (SELECT lang, string_agg(h, '' ORDER BY encode(source || '/')) AS h FROM s GROUP BY lang)
SELECT lang, {_TREE} AS tree_oid FROM l""")
def tree_oid_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return hashing.root_trees(_blobs(spark, sf_dir).select("lang", path.alias("path"), "oid"), ["lang"])


@query("SELECT doc_id, sha1(encode('commit ' || octet_length(encode(b)) || chr(0) || b)) AS commit_id FROM (SELECT doc_id, 'tree ' || sha1(encode(text)) || chr(10) || 'parent ' || sha1(encode(source)) || chr(10) || 'author A <a@b> ' || doc_id || ' +0000' || chr(10) || 'committer A <a@b> ' || doc_id || ' +0000' || chr(10) || chr(10) || lang || chr(10) AS b FROM documents)")
def commit_oid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    oid = hashing.commit_oid(F.sha1(F.col("text").cast("binary")), F.array(F.sha1(F.col("source").cast("binary"))), F.lit("A <a@b>"), F.col("doc_id"), F.col("lang"))
    return docs.select("doc_id", oid.alias("commit_id"))


@query("""WITH o AS (SELECT doc_id::varchar AS path, text FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT doc_id::varchar AS path, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'A' WHEN n.path IS NULL THEN 'D' WHEN o.text = n.text THEN '=' ELSE 'M' END AS change
FROM o FULL JOIN n ON o.path = n.path""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    old = docs.where("doc_id % 7 <> 0").select("path", hashing.blob_oid(F.col("text")).alias("oid"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return history.diff(old, docs.where("doc_id % 11 <> 0").select("path", hashing.blob_oid(changed).alias("oid")))


@query("""WITH f AS (SELECT text, min(doc_id % 13) AS n FROM documents GROUP BY text),
p AS (SELECT n, count(*)::bigint AS new_blobs, sum(octet_length(encode(text)))::bigint AS new_bytes FROM f GROUP BY n)
SELECT n, new_blobs, new_bytes, (sum(new_bytes) OVER (ORDER BY n))::bigint AS total_bytes FROM p""")
def incremental_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.increments(_blobs(spark, sf_dir).withColumn("n", F.col("doc_id") % 13))


@query("SELECT sha1(doc_id::varchar) AS commit_id, substr(sha1(doc_id::varchar), 1, 7) AS short_id, source AS message, lang AS author, strftime(make_timestamp((n_chars * 1000000)::bigint), '%Y-%m-%d %H:%M:%S') AS date FROM documents ORDER BY n_chars DESC, 1 LIMIT 50")
def commit_log_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return history.log(docs.select(F.sha1(F.col("doc_id").cast("string").cast("binary")).alias("commit_id"), F.col("source").alias("message"), F.col("lang").alias("author"), F.timestamp_seconds("n_chars").alias("ts")))


@query("SELECT sha1(event_type) AS commit_id, substr(sha1(event_type), 1, 7) AS short_id, event_type AS message, user_id::varchar AS author, event_id::varchar AS date FROM events WHERE event_id % 3 <> 0")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    oid = F.sha1(F.col("event_type").cast("binary"))
    line = F.concat_ws("\x1f", oid, F.substring(oid, 1, 7), "event_type", F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string")))
    return history.parse_log(_t(spark, sf_dir, "events").select(line.alias("line")))


@query("""SELECT count(*)::double AS "count", sum(n_chars) / 1024.0 AS size, count(DISTINCT source)::double AS in_pack, 0.0::double AS packs, max(n_chars) / 1024.0 AS size_pack, 0.0::double AS prune_packable, count(DISTINCT lang)::double AS garbage, 0.0::double AS size_garbage,
sum(n_chars) / 1024.0 + max(n_chars) / 1024.0 AS total_mib FROM documents""")
def count_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of lines 'key: value' on the documents, with a bad number, an unknown key and a line of neither."""
    told = {"count": F.count("*"), "size": F.sum("n_chars"), "in-pack": F.count_distinct("source"), "size-pack": F.max("n_chars"), "garbage": F.count_distinct("lang"), "unknown": F.min("n_chars")}
    pairs = [F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in told.items()]
    lines = _t(spark, sf_dir, "documents").agg(F.array(*pairs).alias("p")).select(F.explode("p").alias("p")).select(F.concat_ws(": ", "p.k", "p.v").alias("line"))
    return history.parse_report(lines.unionByName(spark.createDataFrame([("packs: none",), ("no value",)], "line string")))


@query("SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE ((p_size % 10 + 3) - p_size % 10) * 100.0 / (p_size % 10) END::double AS growth FROM part")
def growth_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = (F.col("p_size") % 10).cast("double")
    return _t(spark, sf_dir, "part").select("p_partkey", history.growth(before, before + 3).alias("growth"))


@query("SELECT user_id, arg_max(event_id, row(ts, event_id)) AS event_id, arg_max(event_type, row(ts, event_id)) AS event_type FROM events, (SELECT ts AS m FROM events WHERE event_id = (SELECT max(event_id) // 2 FROM events)) WHERE ts <= m GROUP BY user_id")
def as_of_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    middle = events.agg(F.max("event_id").alias("m")).join(events, F.expr("event_id = m div 2")).first()["ts"]
    return history.as_of(events, "user_id", "ts", F.lit(str(middle)).cast(events.schema["ts"].dataType), "event_id").select("user_id", "event_id", "event_type")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (c >> 5)::int AS region, (((c % 32) + 32) % 32)::int AS local FROM (SELECT *, (l_partkey - l_suppkey * 37)::int AS c FROM lineitem)")
def region_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = (F.col("l_partkey") - F.col("l_suppkey") * 37).cast("int")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", packing.region_of(c).alias("region"), packing.local_of(c).alias("local"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_partkey * 256 + l_linenumber AS entry, l_partkey AS sector, l_linenumber::bigint AS sectors FROM lineitem")
def location_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = packing.location_entry(F.col("l_partkey"), F.col("l_linenumber"))
    sector, sectors = packing.location_parts(F.col("entry"))
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return _t(spark, sf_dir, "lineitem").select(*keys, entry.alias("entry")).select(*keys, "entry", sector.alias("sector"), sectors.alias("sectors"))


@query("SELECT p_partkey, p_size, CASE WHEN p_size <= 1 THEN 0 ELSE length(ltrim(bin(p_size - 1), '0')) END::int AS bits, greatest(4, CASE WHEN p_size <= 1 THEN 0 ELSE length(ltrim(bin(p_size - 1), '0')) END)::int AS block_bits FROM part")
def bit_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return _t(spark, sf_dir, "part").select("p_partkey", "p_size", packing.bit_width(n).alias("bits"), packing.bit_width(n, 4).alias("block_bits"))


_ORDERED = "list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey)"
_FIRST = "list_transform(list_sort(list_transform(list_distinct(c), lambda v: lpad(list_position(c, v)::varchar, 9, '0') || v)), lambda v: substr(v, 10))"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order the return flags in line order: cells of a small container."""
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("l"))
    cells = lines.select("l_orderkey", F.transform("l", lambda x: x["l_returnflag"]).alias("cells"))
    return cells.withColumn("entries", packing.palette(F.col("cells")))


@query(f"SELECT l_orderkey, array_to_string(e, '') AS palette, array_to_string(list_transform(c, lambda v: list_position(e, v) - 1), ',') AS indices FROM (SELECT l_orderkey, c, {_FIRST} AS e FROM (SELECT l_orderkey, {_ORDERED} AS c FROM lineitem GROUP BY 1))")
def palette_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = F.transform("cells", lambda c: (F.array_position("entries", c) - 1).cast("string"))
    return _cells(spark, sf_dir).select("l_orderkey", F.array_join("entries", "").alias("palette"), F.array_join(index, ",").alias("indices"))


@query(f"""WITH o AS (SELECT l_orderkey, c, {_FIRST} AS e FROM (SELECT l_orderkey, {_ORDERED} AS c FROM lineitem GROUP BY 1)),
i AS (SELECT l_orderkey, unnest(list_transform(c, lambda v: list_position(e, v) - 1)) AS x, unnest(range(len(c))) AS k FROM o)
SELECT l_orderkey, (k // 6)::int AS row, sum(x::bigint << (10 * (k % 6))::bigint)::bigint AS packed FROM i GROUP BY 1, 2""")
def palette_pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(F.col("cells"), F.col("entries"), 10)
    return _cells(spark, sf_dir).select("l_orderkey", F.posexplode(rows).alias("row", "packed"))


@query(f"SELECT l_orderkey, array_to_string({_ORDERED}, '') AS cells FROM lineitem GROUP BY 1")
def palette_unpack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _cells(spark, sf_dir).withColumn("rows", packing.pack(F.col("cells"), F.col("entries"), 10)).withColumn("n", F.size("cells"))
    return packed.select("l_orderkey", F.array_join(packing.unpack(F.col("rows"), F.col("entries"), 10, F.col("n")), "").alias("cells"))


_STATUS, _PRIORITY = ["F", "O", "P"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda values, c: F.array_position(F.array(*map(F.lit, values)), F.col(c)) - 1
    number = packing.radix_id([place(_STATUS, "o_orderstatus"), place(_PRIORITY, "o_orderpriority")], [3, 5], 100)
    return _t(spark, sf_dir, "orders").select("o_orderkey", number.alias("state_id"))


@query(f"SELECT o_orderkey, 100 + (list_position({_STATUS}, o_orderstatus) - 1) * 5 + list_position({_PRIORITY}, o_orderpriority) - 1 AS state_id FROM orders")
def mixed_radix_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _radix(spark, sf_dir)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F','O','P') THEN o_orderstatus END AS status, o_orderpriority AS priority FROM orders")
def mixed_radix_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = packing.radix_digits(F.col("state_id"), [3, 5], 100)
    name = lambda values, d: F.get(F.array(*map(F.lit, values)), d.cast("int"))
    return _radix(spark, sf_dir).select("o_orderkey", name(_STATUS, a).alias("status"), name(_PRIORITY, b).alias("priority"))


@query("SELECT p_partkey, list_sum(list_transform(range(16), lambda b: (((p_partkey >> b) & 1) << (2 * b)) + (((p_size::bigint >> b) & 1) << (2 * b + 1))))::bigint AS morton FROM part")
def morton_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", packing.morton(F.col("p_partkey"), F.col("p_size")).alias("morton"))


@query("SELECT p_partkey, '{\"a\":\"' || p_brand || '\",\"m\":\"' || p_size || '\",\"z\":\"' || p_type || '\"}' AS canonical FROM part")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.to_json(F.struct(F.col("p_type").alias("z"), F.col("p_brand").alias("a"), F.col("p_size").cast("string").alias("m")))
    ordered = F.map_from_entries(F.array_sort(F.map_entries(F.from_json(raw, "map<string,string>"))))
    return _t(spark, sf_dir, "part").select("p_partkey", F.to_json(ordered).alias("canonical"))


_KEYS = "'w/' || ['region/r.', 'entities/r.', 'poi/r.', 'data/m', 'icons/i', 'x/y'][(page_id % 6 + 1)::int] || page_id || ['.-2.mca', '.3.mca', '.4.mca', '.dat', '.png', '.txt'][(page_id % 6 + 1)::int]"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda *v: F.get(F.array(*map(F.lit, v)), (F.col("page_id") % 6).cast("int"))
    key = F.concat(F.lit("w/"), at("region/r.", "entities/r.", "poi/r.", "data/m", "icons/i", "x/y"), F.col("page_id").cast("string"), at(".-2.mca", ".3.mca", ".4.mca", ".dat", ".png", ".txt"))
    return _t(spark, sf_dir, "pages").select("page_id", key.alias("key"))


@query("SELECT ['region','other_region','other_region','gzip','raw',NULL][(page_id % 6 + 1)::int] AS codec, count(*)::bigint AS files FROM pages GROUP BY 1")
def glob_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).groupBy(paths.route(F.col("key")).alias("codec")).agg(F.count("*").alias("files"))


@query(f"SELECT page_id, string_split({_KEYS}, '/')[-1] AS name, try_cast(string_split(string_split({_KEYS}, '/')[-1], '.')[2] AS int) AS x, try_cast(string_split(string_split({_KEYS}, '/')[-1], '.')[3] AS int) AS z FROM pages")
def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _paths(spark, sf_dir).select("page_id", paths.basename(F.col("key")).alias("name"))
    x, z = paths.name_xz(F.col("name"))
    return named.select("page_id", "name", x.alias("x"), z.alias("z"))


@query("SELECT page_id, 'w/r.' || page_id || '.0.mca' AS region FROM pages WHERE page_id % 2 = 0")
def sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("w/r."), F.col("page_id").cast("string"), F.lit(".0.mca"), F.when(F.col("page_id") % 2 == 0, paths.SENTINEL).otherwise("/c.0.0.nbt"))
    return _t(spark, sf_dir, "pages").select("page_id", paths.strip_suffix(key, paths.SENTINEL).alias("region")).where("region is not null")


@query("SELECT page_id, page_id % 4 = 3 AS safe FROM pages")
def key_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.get(F.array(*map(F.lit, ("/abs", "a/../b", "..", "a..b/c"))), (F.col("page_id") % 4).cast("int"))
    return _t(spark, sf_dir, "pages").select("page_id", paths.is_safe(F.concat(prefix, F.when(F.col("page_id") % 4 == 2, "").otherwise("/x"))).alias("safe"))


@query("SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY lang, source")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.keep_first(_t(spark, sf_dir, "documents").select("lang", "source", "doc_id"), ["lang", "source"], "doc_id")


@query("SELECT user_id, event_type, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select(F.struct("user_id", "event_type").alias("k"), "value", F.struct("ts", "event_id").alias("o"))
    return last_write(events, "k", F.col("o")).select("k.user_id", "k.event_type", "value")


@query("SELECT source, doc_id, running::bigint AS running FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC) AS running FROM documents) WHERE running <= 20000")
def retention_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.retained(_t(spark, sf_dir, "documents"), ["source"], [F.col("doc_id").desc()], "n_chars", 20000).select("source", "doc_id", "running")


@query("SELECT o_orderkey, part, CASE part WHEN 'other' THEN o_orderpriority ELSE o_totalprice::varchar END AS content FROM (SELECT o_orderkey, o_orderpriority, o_custkey::varchar AS o_totalprice, unnest(['other', 'sections']) AS part FROM orders WHERE o_orderstatus = 'F')")
def status_filter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return full.select("o_orderkey", F.expr("stack(2, 'other', o_orderpriority, 'sections', cast(o_custkey as string)) as (part, content)"))


@query("SELECT o_orderkey, o_orderpriority, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey)::varchar AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def layer_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("l"))
    met = _t(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return met.select("o_orderkey", "o_orderpriority", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["l_partkey"].cast("string")), ", "), F.lit("]")).alias("parts"))


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AS homogeneous FROM lineitem GROUP BY 1")
def homogeneous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("l_orderkey", packing.homogeneous(F.col("cells")).alias("homogeneous"))


@query("SELECT c_custkey, c_nationkey FROM customer ANTI JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON c_nationkey = n_nationkey")
def registry_lookup_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _t(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0")
    return _t(spark, sf_dir, "customer").join(F.broadcast(known), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti").select("c_custkey", "c_nationkey")


@query("SELECT event_type, count(*)::bigint AS events FROM events WHERE value >= 50 GROUP BY 1")
def level_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").where("value >= 50").groupBy("event_type").agg(F.count("*").alias("events"))


# -- codecs: what comes back from the formats must be what went in ------------------------------------------------


@query("SELECT doc_id, octet_length(encode(text))::bigint AS size, sha256(text) AS digest FROM documents")
def gzip_tag_tree_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as .dat files, flattened and read again."""
    from blockstrata.operators.flatten import flatten, gunzip
    from blockstrata.operators.registry import Registry
    from blockstrata.sources import nbt

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for b in parts(batches):
            made = [gzip.compress(nbt.dump(b"", [(b"z", (nbt.BYTES, t.encode())), (b"a", (nbt.LONG, i))]), 1) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"d/{i}.dat" for i in b.column(0).to_pylist()]), pa.array(made, pa.binary())], ["key", "content"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            items = [nbt.load(gunzip(c.as_py()))[1] for c in b.column(1)]
            assert all([k for k, _ in x] == [b"a", b"z"] for x in items)
            yield pa.RecordBatch.from_arrays([pa.array([nbt.get(x, "a", nbt.LONG) for x in items]), pa.array([nbt.get(x, "z", nbt.BYTES) for x in items], pa.binary())], ["doc_id", "t"])

    files = _t(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(wrap, "key string, content binary")
    out = flatten(files, Registry("none", [], {})).mapInArrow(read, "doc_id bigint, t binary")
    return out.select("doc_id", F.octet_length("t").cast("long").alias("size"), F.sha2("t", 256).alias("digest"))


@query("SELECT doc_id, (doc_id % 64 - 32)::int AS chunk_x, (doc_id // 64)::int AS chunk_z, sha256(text) AS digest FROM documents")
def region_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as chunks of region files, written by region and read chunk by chunk."""
    from blockstrata.operators.flatten import chunks
    from blockstrata.sources import nbt
    from blockstrata.sources.region import write_region

    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 64 - 32).cast("int").alias("x"), F.floor(F.col("doc_id") / 64).cast("int").alias("z"))
    docs = docs.withColumn("rx", packing.region_of(F.col("x"))).withColumn("rz", packing.region_of(F.col("z")))

    def write(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        rx, rz = rows[0]["rx"], rows[0]["rz"]
        made = ((r["x"], r["z"], nbt.dump(b"", [(b"id", (nbt.LONG, r["doc_id"])), (b"t", (nbt.BYTES, r["text"].encode()))])) for r in rows)
        return pa.table({"key": [f"w/poi/r.{rx}.{rz}.mca"], "content": pa.array([write_region(rx, rz, bytes(4096), made)], pa.binary())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            items = [nbt.load(c.as_py())[1] for c in b["nbt"]]
            yield pa.RecordBatch.from_arrays([pa.array([nbt.get(x, "id", nbt.LONG) for x in items]), b["chunk_x"], b["chunk_z"], pa.array([nbt.get(x, "t", nbt.BYTES) for x in items], pa.binary())], ["doc_id", "chunk_x", "chunk_z", "t"])

    files = _by_region(docs).applyInArrow(write, "key string, content binary")
    out = chunks(files, read, "doc_id bigint, chunk_x int, chunk_z int, t binary")
    return out.select("doc_id", "chunk_x", "chunk_z", F.sha2("t", 256).alias("digest"))


@query("SELECT p_partkey, 1 + p_size % 3 AS palette, list_sum(list_transform(range(4096), lambda i: (i + 1) * ((i * p_size) % (1 + p_size % 3))))::bigint AS blocks, list_sum(list_transform(range(64), lambda i: (i + 1) * ((i * p_partkey) % (1 + p_partkey % 3))))::bigint AS biomes FROM part")
def section_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as containers of 4,096 block states and 64 biomes, encoded and decoded through registry, palette and packed
    rows; in the sums every cell's place counts."""
    import numpy as np

    from blockstrata.operators.registry import Block, Registry
    from blockstrata.operators.sections import Section, dump_sections, load_sections, read_biomes, read_blocks, write_biomes, write_blocks

    registry = Registry("test", [Block(f"b{i}", i, i) for i in range(3)], {"plains": 0, "river": 1, "taiga": 2})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                blocks, biomes = np.arange(4096) * size % (1 + size % 3), np.arange(64) * key % (1 + key % 3)
                section = Section(0, read_biomes(write_biomes(biomes, registry), registry), read_blocks(write_blocks(blocks, registry), registry))
                again = load_sections(dump_sections([section]))[0]
                out.append((key, 1 + size % 3, *[int(c @ np.arange(1, len(c) + 1)) for c in (again.block_state, again.biome)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["p_partkey", "palette", "blocks", "biomes"])

    return _dealt(_t(spark, sf_dir, "part").select("p_partkey", "p_size")).mapInArrow(run, "p_partkey bigint, palette int, blocks bigint, biomes bigint")


@query("SELECT save_dir, branch FROM (SELECT source AS save_dir, lang AS branch, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source <> 'src3') WHERE n = 1")
def profiles_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockstrata.sources.profiles import normalize

    blank = F.when(F.col("source") == "src3", "  ").otherwise(F.col("source"))
    rows = _t(spark, sf_dir, "documents").select(blank.alias("save_dir"), F.lit("1").alias("mc_version"), F.col("lang").alias("branch"), F.lit("").alias("remote_url"), F.lit("").alias("updated_at"), F.col("doc_id").alias("_n"))
    return normalize(rows).select("save_dir", "branch")
