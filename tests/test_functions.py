import hashlib
import subprocess

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockstrata.functions import hashing, packing, paths


@given(st.lists(st.integers(0, 300), min_size=1, max_size=200), st.integers(0, 6))
@settings(max_examples=60, deadline=None)
def test_cells_round_trip(cells, more):
    values, index = packing.first_seen(np.array(cells))
    bits = max(1, packing.width_of(len(values)) + more)
    assert list(values) == list(dict.fromkeys(cells))
    assert values[packing.unpack_cells(packing.pack_cells(index, bits), bits, len(cells))].tolist() == cells


@pytest.mark.parametrize(("n", "bits"), [(0, 0), (1, 0), (2, 1), (3, 2), (16, 4), (17, 5), (256, 8), (257, 9)])
def test_width(spark, n, bits):
    assert packing.width_of(n) == bits
    assert spark.range(1).select(packing.bit_width(F.lit(n))).first()[0] == bits


@pytest.mark.parametrize("n", [2, 16, 17, 40])
def test_columns_agree_with_numpy(spark, n):
    cells = np.random.default_rng(n).permutation(np.arange(4096) % n)
    values, index = packing.first_seen(cells)
    bits = packing.width_of(n, 4)
    df = spark.createDataFrame([(cells.tolist(),)], "cells array<int>").withColumn("entries", packing.palette(F.col("cells")))
    df = df.withColumn("rows", packing.pack(F.col("cells"), F.col("entries"), bits))
    got = df.withColumn("again", packing.unpack(F.col("rows"), F.col("entries"), bits, 4096)).first()
    assert got["entries"] == values.tolist()
    assert got["rows"] == packing.pack_cells(index, bits).view("i8").tolist()
    assert got["again"] == cells.tolist()


def test_index_beyond_palette_is_an_error(spark):
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        spark.range(1).select(packing.unpack(F.array(F.lit(7).cast("long")), F.array(F.lit(1)), 4, 1)).collect()


@given(st.lists(st.integers(2, 5), min_size=1, max_size=4), st.data())
@settings(max_examples=20, deadline=None)
def test_radix_twins(sizes, data):
    digits = [data.draw(st.integers(0, s - 1)) for s in sizes]
    number = 0
    for d, s in zip(digits, sizes, strict=True):
        number = number * s + d
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    row = spark.range(1).select(packing.radix_id([F.lit(d) for d in digits], sizes, 9).alias("n"), *[d.alias(f"d{i}") for i, d in enumerate(packing.radix_digits(F.lit(number + 9), sizes, 9))]).first()
    assert row["n"] == number + 9 and list(row)[1:] == digits


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("a/*.txt", ["a/x.txt"], ["a/b/x.txt", "b/x.txt", "a/x.txt2"]),
        ("**/region/r.*.*.mca", ["region/r.0.0.mca", "w/region/r.-1.2.mca"], ["w/entities/r.0.0.mca", "region/r.0.mca"]),
        ("World [[]1]/*", ["World [1]/a"], ["World 1/a"]),
        ("[!a]?.md", ["bc.md"], ["ac.md", "b.md"]),
    ],
)
def test_glob(spark, pattern, yes, no):
    df = spark.createDataFrame([(k,) for k in yes + no], "k string")
    assert {r[0] for r in df.where(paths.matches(F.col("k"), pattern)).collect()} == set(yes)


def test_unsafe(spark):
    keys = ["ok/a", "/abs", "a/../b", "..", "", "C:/x", "a..b", None]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(paths.is_safe(F.col("k"))).collect()] == [True, False, False, False, False, False, True, False]
    with pytest.raises(Exception, match="unsafe key"):
        df.select(paths.safe_key(F.col("k"))).collect()
    with pytest.raises(ValueError, match="unsafe"):
        paths.matches(F.col("k"), "../*")


def test_git_ids(spark, tmp_path):
    git = lambda *a, **k: subprocess.run(["git", "-C", str(tmp_path), *a], capture_output=True, check=True, **k).stdout.decode().strip()
    git("init", "-q")
    files = {"foo/x": b"1", "foo.a": b"2", "foo-b/y/z": b"3\n", "é/ü": b"4", "a": b""}
    for k, v in files.items():
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_bytes(v)
    git("add", "-A")
    df = spark.createDataFrame(list(files.items()), "path string, content binary").withColumn("oid", hashing.blob_oid(F.col("content")))
    assert {r["path"]: r["oid"] for r in df.collect()}["foo-b/y/z"] == git("hash-object", "foo-b/y/z")
    tree = hashing.root_trees(df.select(F.lit(1).alias("g"), "path", "oid"), ["g"]).first()["tree_oid"]
    assert tree == git("write-tree")
    env = {f"GIT_{w}_{k}": v for w in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "A"), ("EMAIL", "a@b"), ("DATE", "1700000000 +0000"))}
    made = git("commit-tree", tree, "-m", "one", env=env | {"PATH": "/usr/bin:/bin"})
    ours = spark.range(1).select(hashing.commit_oid(F.lit(tree), F.array().cast("array<string>"), F.lit("A <a@b>"), F.lit(1700000000), F.lit("one"))).first()[0]
    assert ours == made


def test_empty_tree(spark):
    empty = spark.range(1).select(hashing.tree_oid(F.from_json(F.lit("[]"), "array<struct<name:string,oid:string,is_dir:boolean>>"))).first()[0]
    assert empty == hashing.EMPTY_TREE == hashlib.sha1(b"tree 0\0").hexdigest()


@pytest.mark.parametrize("bits", [1, 2, 3, 4, 5, 8, 9])
@pytest.mark.parametrize("n", [1, 63, 64, 256, 257, 4096])
def test_cells_as_bytes(bits, n):
    """Few values are told apart as bytes; rows are those of the formula at any width."""
    cells = np.random.default_rng(n).integers(0, 1 << bits, n) + 300
    values, index = packing.first_seen(cells)
    assert list(dict.fromkeys(cells.tolist())) == values.tolist() and values[index].tolist() == cells.tolist()
    assert bits > 8 or index.dtype.itemsize == 1 or len(values) == 1
    width, per = packing.width_of(len(values), bits), 64 // packing.width_of(len(values), bits)
    rows = [sum(int(v) << (k * width) for k, v in enumerate(index[at : at + per])) for at in range(0, n, per)]
    assert packing.pack_cells(index, width).tolist() == rows
    assert packing.unpack_cells(np.array(rows, ">u8"), width, n + 70).tolist() == [*index.tolist(), *[0] * (packed_extra(n, per))] + [0] * (70 - packed_extra(n, per))


def packed_extra(n, per):
    return min(70, -n % per)
