"""What is taken at once, shuffled, or sent to the driver doesn't grow with the input."""

import random
from datetime import UTC, datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockstrata.plans import store as stores
from blockstrata.plans.store import Store
from blockstrata.sources import files, git_objects, region
from blockstrata.sources.region_source import CHUNKS, RegionFile, RegionReader

WHEN = datetime(2024, 1, 1, tzinfo=UTC)


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(700):
        (tmp_path / f"{i}.txt").write_bytes(b"%d" % i)
    got = files.scan(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() <= 16
    assert {(r["key"], bytes(r["content"])) for r in got.collect()} == {(f"{i}.txt", b"%d" % i) for i in range(700)}


def test_files_of_a_commit_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    rows = [(f"{folder}f{i}.txt", b"%d" % i) for folder in ("", "a/", "a/b/", "c d/é/") for i in range(40)]
    store, bare = Store(spark, str(tmp_path / "store")), str(tmp_path / "bare")
    store.commit(spark.createDataFrame(rows, files.SCHEMA), "first", init=True, ts=WHEN)
    git_objects.export(store, "main", bare)
    said, git = [], git_objects.git
    monkeypatch.setattr(git_objects, "git", lambda *a, **k: said.append(git(*a, **k)) or said[-1])
    got = {tuple(r) for r in git_objects.listing(spark, bare, "main").collect()}
    assert got == {tuple(r) for r in store.listing("main").collect()} and len(got) == 160
    assert not any(b".txt" in x for x in said)


def shuffled(spark):
    jvm = spark.sparkContext._jvm
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))


@pytest.mark.parametrize("sent", [8, 0])
def test_contents_stay_where_they_are(spark, tmp_path, monkeypatch, sent):
    """New contents are told by a bit a row; beyond the bound they are shuffled, to the same end."""
    monkeypatch.setattr(stores, "SENT", sent)
    rng = random.Random(3)
    contents = [rng.randbytes(20_000) for _ in range(60)]
    rows = [(f"k{i}", contents[i % 60]) for i in range(90)]
    store = Store(spark, str(tmp_path / "store"))
    frame = spark.createDataFrame(rows, files.SCHEMA).coalesce(2)
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if there were very many ids
    try:
        store.commit(frame, "first", init=True, ts=WHEN)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = shuffled(spark) - before
    assert moved < 300_000 if sent else moved > 1_000_000
    store.commit(spark.createDataFrame([*rows[:10], ("new", b"new")], files.SCHEMA), "second", ts=WHEN)
    blobs = [bytes(r["content"]) for r in store.table("blobs").collect()]
    assert len(blobs) == len(set(blobs)) and set(blobs) == {*contents, b"new"}
    assert {(r["key"], bytes(r["content"])) for r in store.entries(store.table("commits").where("message = 'first'").first()["commit_id"]).collect()} == set(rows)


def test_chunks_leave_in_batches(tmp_path):
    made = region.write_region(0, 0, bytes(4096), [(i % 32, i // 32, b"%d" % i) for i in range(150)])
    (tmp_path / "r.0.0.mca").write_bytes(made)
    got = list(RegionReader({"path": str(tmp_path)}).read(RegionFile(str(tmp_path / "r.0.0.mca"), 0, 0)))
    assert all(isinstance(b, pa.RecordBatch) and b.num_rows <= CHUNKS for b in got)
    assert [(r["chunk_x"], r["chunk_z"], r["nbt"]) for b in got for r in b.to_pylist()] == [(i % 32, i // 32, b"%d" % i) for i in range(150)]


def planned(frame, what):
    return sum(f"{what} " in line.split("#")[0] + " " for line in frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines())


def test_chunks_are_decompressed_one_by_one(monkeypatch):
    made = region.write_region(0, 0, bytes(4096), [(i, 0, bytes([i]) * 3000) for i in range(20)])
    done, real = [], region.zlib.decompress
    monkeypatch.setattr(region.zlib, "decompress", lambda data: done.append(1) or real(data))
    got = region.region_chunks(made, 0, 0)
    assert next(got) == (0, 0, bytes(3000)) and len(done) == 1
    assert [x for x, _, _ in got] == list(range(1, 20))


def test_chunks_leave_their_worker_in_parts_once(spark, sf_dir, monkeypatch):
    """Batches have a bound in bytes, whatever a region has, and what reads chunks gets them in the same worker."""
    from blockstrata.operators import flatten as fl

    monkeypatch.setattr(fl, "PART", 10_000)
    made = region.write_region(0, 0, bytes(4096), [(i, 0, bytes([i]) * 3000) for i in range(20)])
    frame = spark.createDataFrame([("w/poi/r.0.0.mca", made)], files.SCHEMA)

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    out = fl.chunks(frame, count, "n bigint")
    assert [r["n"] for r in out.collect()] == [4] * 5 and planned(out, "MapInArrow") == 1


def test_regions_are_dealt_by_their_number(spark, tmp_path, sf_dir):
    """A task has about a region, so tasks are as large at any size of the table."""
    from blockstrata.save_queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("doc_id", F.col("doc_id") + F.col("n") * 256).drop("n")
    more.write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["region_round_trip"](spark, str(tmp_path))
    assert planned(out, "MapInArrow") == 1 and out.rdd.getNumPartitions() == -(-more.count() // 1024) > 4
    assert out.select("chunk_x", "chunk_z").distinct().count() == more.count()


def test_cells_are_read_where_chunks_are(spark, sf_dir):
    from blockstrata.save_queries import QUERIES

    assert planned(QUERIES["chunk_sections"](spark, sf_dir), "MapInArrow") == 1
    assert planned(QUERIES["section_rebuild"](spark, sf_dir), "MapInArrow") == 4  # flattened for either kind of files, others restored, cells


def test_a_commit_starts_no_workers_of_its_own(spark, tmp_path, monkeypatch):
    """Rows of commits and refs are literals: frames of Python's rows would start workers beside those of the codecs."""
    frame = spark.createDataFrame([("a/b.json", b"{}"), ("c.json", b"[]")], files.SCHEMA)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *_, **__: pytest.fail("rows made by Python"))
    store = Store(spark, str(tmp_path / "store"))
    first = store.commit(frame, "first", init=True, ts=WHEN)
    second = store.commit(frame.where("key = 'c.json'"), "it's \"2\" \\n", ts=WHEN)
    rows = {r["commit_id"]: r for r in store.table("commits").collect()}
    assert rows[first]["parents"] == [] and rows[second]["parents"] == [first] and rows[second]["message"] == "it's \"2\" \\n"
    assert [r["seq"] for r in store.table("refs").orderBy("seq").collect()] == [1, 2] and store.resolve("main") == second
    assert store.table("commits").where(F.col("ts") == F.lit(WHEN)).count() == 2


def test_raw_files_pass_as_they_come(spark, monkeypatch):
    """Beside files that are read, also in one batch; others are dropped."""
    from blockstrata.operators import flatten as fl
    from blockstrata.operators.registry import Registry
    from blockstrata.sources import nbt

    made = []
    real = fl._objects
    monkeypatch.setattr(fl, "_objects", lambda rows: made.extend(k for k, _ in rows) or real(rows))
    monkeypatch.setattr(fl, "route", lambda key: key)
    tree = nbt.dump(b"", [(b"b", (nbt.BYTE, 1)), (b"a", (nbt.BYTE, 2))])
    batch = pa.RecordBatch.from_arrays([pa.array(["x.json", "y.dat", "z.json"]), pa.array([b"{}", tree, b""], pa.binary()), pa.array(["raw", "gzip", "raw"])], ["key", "content", "codec"])

    class Files:
        def select(self, *_):
            return self

        where = select

        def mapInArrow(self, run, _):
            return [(r["key"], r["content"]) for b in run(iter([batch])) for r in b.to_pylist()]

    monkeypatch.setattr(fl.F, "col", lambda _: type("C", (), {"alias": lambda s, _: s})())
    got = fl.flatten(Files(), Registry("none", [], {}))
    canon = nbt.dump(b"", [(b"a", (nbt.BYTE, 2)), (b"b", (nbt.BYTE, 1))])
    assert sorted(got) == [("x.json", b"{}"), ("y.dat", canon), ("z.json", b"")] and made == ["y.dat"]
