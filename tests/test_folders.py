"""Folders come back whole: also files without content, and names that Spark's reader takes for hidden ones."""

import os
import threading
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from blockstrata.save_queries import QUERIES, SQL
from blockstrata.sources import files
from tests.test_queries import rows

SOURCES = ["src1", ".a", "_b", "_k=v", "c._COPYING_", "World [1]", "d e%20é"]


@pytest.fixture(scope="module")
def odd_documents(tmp_path_factory):
    """Documents of odd sources; each source has some without text."""
    at = tmp_path_factory.mktemp("odd")
    n = range(20 * len(SOURCES))
    table = {"doc_id": pa.array(n, pa.int64()), "text": ["" if i % 3 == 0 else f"text {i}" for i in n], "lang": ["en" for _ in n], "source": [SOURCES[i % len(SOURCES)] for i in n]}
    pq.write_table(pa.table(table), at / "documents.parquet")
    return str(at)


def same_as_sql(spark, at, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    want = con.sql(SQL[name]).df()
    assert rows(QUERIES[name](spark, at).toPandas()) == rows(want) and (want["size"] == 0).any()


def test_checkout_restores_all_files(spark, odd_documents):
    same_as_sql(spark, odd_documents, "checkout_earlier")


def test_scan_lists_and_reads_all_files(spark, tmp_path):
    made = {"x": b"", "a/.b/c.txt": b"1", "a/_d/e/f.txt": b"22", "a/g": b"", ".h": b"333", "_SUCCESS": b"", "i j/k.crc": b"4"}
    for key, content in made.items():
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_bytes(content)
    (tmp_path / "none/at/all").mkdir(parents=True)
    for root in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}", os.path.relpath(tmp_path)):
        assert sorted((r["key"], r["size"], bytes(r["content"])) for r in files.scan(spark, root).collect()) == sorted((k, len(c), c) for k, c in made.items())
    assert sorted(tuple(r) for r in files.scan(spark, str(tmp_path), content=False).collect()) == sorted((k, len(c)) for k, c in made.items())
    assert sorted(r["key"] for r in files.scan(spark, str(tmp_path), "a/**").collect()) == ["a/.b/c.txt", "a/_d/e/f.txt", "a/g"]
    assert [r["key"] for r in files.glob(spark, str(tmp_path), "*").collect()] == [".h", "_SUCCESS", "x"]
    assert files.scan(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="nope"):
        files.scan(spark, str(tmp_path / "nope"))


def test_what_only_spark_opens(spark, tmp_path):
    (Path(tmp_path) / "a").mkdir()
    (Path(tmp_path) / "a/b.txt").write_bytes(b"1")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    assert [(r["key"], bytes(r["content"])) for r in files.scan(spark, "viewfs://store/in").collect()] == [("a/b.txt", b"1")]


def test_put_and_scan_have_all_files(spark, odd_documents):
    same_as_sql(spark, odd_documents, "folder_put_scan")


def test_few_files_need_few_tasks(spark, tmp_path):
    files.put(spark.createDataFrame([("a/x", b"1"), ("y", b"")], files.SCHEMA), str(tmp_path))
    assert files.scan(spark, str(tmp_path)).rdd.getNumPartitions() == 2


def test_put_writes_what_it_is_given(spark, tmp_path):
    """Whatever the name's suffix, and whatever was there."""
    names = [f"a{suffix}" for suffix in ("", ".gz", ".bz2", ".zst", ".lz4", ".br")]
    for content in (b"long content", b"short", b""):
        files.put(spark.createDataFrame([(n, content) for n in names], files.SCHEMA), str(tmp_path))
        assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == dict.fromkeys(names, content)


def test_a_repeated_task_does_not_empty_files(spark, tmp_path):
    """What a task writes again, and may not finish, has its content all the time."""
    content, at, seen, over = bytes(range(256)) * 50_000, tmp_path / "x.json", set(), threading.Event()
    frame = spark.createDataFrame([("x.json", content)], files.SCHEMA)
    files.put(frame, str(tmp_path))

    def watch():
        while not over.is_set():
            seen.add(at.stat().st_size)

    watcher = threading.Thread(target=watch)
    watcher.start()
    for _ in range(3):
        files.put(frame, str(tmp_path))
    over.set()
    watcher.join()
    assert seen == {len(content)} and at.read_bytes() == content
