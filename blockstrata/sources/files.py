"""Folders as tables of key and content, and back."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockstrata.functions.paths import matches, safe_key
from blockstrata.sources.batches import in_parts

SCHEMA = "key string, content binary"
#: Files of a listing that leave at once.
LISTED = 10_000


def open_store(root: str):
    """(file system, path in it) of a folder, for tasks that read or write files themselves."""
    from urllib.parse import quote

    from pyarrow import fs

    if "://" in root and not root.startswith("file:"):
        return fs.FileSystem.from_uri(quote(root, safe=":/@"))
    return fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/") if root.startswith(("file:", "/")) else root


def _key(root: str):
    """The path below a root, without reading it as a pattern."""
    tail = root.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "")
    return F.substring(path, F.lit(len(tail) + 1), F.length(path))


def scan(spark: SparkSession, root: str, pattern: str | None = None, *, content: bool = True) -> DataFrame:
    """All files below ``root``: key, size and content. Without content only the listing is read.

    Directories alone come to the driver; tasks list the files of each and, dealt evenly to several tasks a core, read
    them. Spark's own reader leaves out files without content and all that is below a name with _ or . in front, so it
    is for stores that only Spark opens."""
    root, tasks = _qualified(spark, root), max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = lambda rows: rows.where(matches(F.col("key"), pattern)) if pattern else rows
    if not _opens(root):
        base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_literal(root)).coalesce(tasks)
        return kept(base.select(_key(root).alias("key"), F.col("length").alias("size"), *(["content"] if content else [])))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder, infos in _below(root, batches):
            found = [(f"{folder}{i.base_name}", i.size) for i in infos if i.is_file]
            for at in range(0, len(found), LISTED):
                keys, sizes = zip(*found[at : at + LISTED], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int64())], ["key", "size"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        for batch in batches:
            for rows in in_parts(_read(store, base, key) for key in batch.column(0).to_pylist()):
                keys, contents = zip(*rows, strict=True)
                columns = [pa.array(keys, pa.string()), pa.array(map(len, contents), pa.int64()), pa.array(contents, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "size", "content"])

    folders, number = _folders(spark, root, tasks)
    out = kept(_dealt(spark, folders, tasks).mapInArrow(listed, "key string, size bigint"))
    return out.select("key").repartition(max(1, min(tasks, number))).mapInArrow(read, "key string, size bigint, content binary") if content else out


def _qualified(spark: SparkSession, root: str) -> str:
    """As Spark understands it: with its scheme, and not relative."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString()


def _opens(root: str) -> bool:
    """Whether tasks can open this store themselves."""
    try:
        open_store(root)
    except (pa.ArrowException, OSError):
        return False
    return True


def _folders(spark: SparkSession, root: str, tasks: int) -> tuple[list[str], int]:
    """All directories below a root, with the root itself, level by level; and the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder, infos in _below(root, batches):
            below = [f"{folder}{i.base_name}/" for i in infos if i.type.name == "Directory"]
            number = sum(i.is_file for i in infos)
            yield pa.RecordBatch.from_arrays([pa.array([*below, None], pa.string()), pa.array([0] * len(below) + [number], pa.int64())], ["folder", "files"])

    out, level, number = [], [""], 0
    while level:
        out += level
        rows = _dealt(spark, level, tasks).mapInArrow(run, "folder string, files bigint").collect()
        level, number = [r["folder"] for r in rows if r["folder"] is not None], number + sum(r["files"] for r in rows)
    return out, number


def _dealt(spark: SparkSession, folders: list[str], tasks: int) -> DataFrame:
    return spark.createDataFrame(pa.table({"folder": pa.array(folders, pa.string())})).repartition(min(len(folders), tasks))


def _below(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list]]:
    """Each folder, its name with a slash behind, and what is right below it."""
    from pyarrow import fs

    store, base = open_store(root)
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            yield folder, store.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{folder}".rstrip("/") or "/"))


def _read(store, base: str, key: str) -> tuple[str, bytes]:
    with store.open_input_file(f"{base.rstrip('/')}/{key}") as f:
        return key, f.read()


def _literal(root: str) -> str:
    """The reader takes a path for a pattern; a save's folder may be named World [1]."""
    return "".join("\\" + c if c in "[]{}*?\\" else c for c in root)


def glob(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return scan(spark, root, pattern, content=False).select("key").orderBy("key")


def lookup(entries: DataFrame, keys: list[str]) -> DataFrame:
    """ordinal, key, content in the order asked for; a missing or unsafe key is an error."""
    spark = entries.sparkSession
    wanted = spark.createDataFrame(list(enumerate(keys)), "ordinal int, key string").withColumn("key", safe_key(F.col("key")))
    met = F.broadcast(wanted).join(entries.select("key", F.col("content").alias("_c"), F.lit(True).alias("_there")), "key", "left")
    found = F.when(F.col("_there"), F.col("_c")).otherwise(F.raise_error(F.concat(F.lit("no such key: "), F.col("key"))).cast("binary"))
    return met.select("ordinal", "key", found.alias("content")).orderBy("ordinal")


def put(entries: DataFrame, root: str) -> int:
    """Write key and content below ``root``, whatever was there; number of files. Executors write in parallel;
    a file that a repeated task writes again has the same content, also meanwhile, where files are local."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        made: set[str] = set()
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path = f"{base}/{key}"
                if (folder := path.rpartition("/")[0]) not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                _write(store, path, content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    done = entries.select(safe_key(F.col("key")).alias("key"), "content").mapInArrow(write, "n bigint")
    return done.agg(F.sum("n")).first()[0] or 0


def _write(store, path: str, content: pa.Buffer) -> None:
    """A local file that is there is written over and then cut to its length, not emptied first: a task that is repeated
    and ended halfway leaves it as the other one has written it. A name's suffix doesn't compress the content."""
    if store.type_name == "local":
        out, left = os.open(path, os.O_WRONLY | os.O_CREAT, 0o666), memoryview(content)
        try:
            while left:
                left = left[os.write(out, left) :]
            os.ftruncate(out, content.size)
        finally:
            os.close(out)
    else:
        with store.open_output_stream(path, compression=None) as out:
            out.write(content)
