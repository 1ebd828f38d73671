"""Object ids of the git format, computed by built-in functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def object_oid(kind: str, content: Column) -> Column:
    head = F.encode(F.concat(F.lit(f"{kind} "), F.octet_length(content).cast("string"), F.chr(F.lit(0))), "UTF-8")
    return F.sha1(F.concat(head, content))


def blob_oid(content: Column) -> Column:
    return object_oid("blob", content.cast("binary"))


def tree_body(entries: Column) -> Column:
    """A tree's content from an array of struct(name, oid, is_dir). Git sorts by bytes, a directory as if its name ended in a slash."""
    keyed = F.transform(entries, lambda e: F.struct(F.encode(F.concat(e["name"], F.when(e["is_dir"], "/").otherwise("")), "UTF-8").alias("k"), e.alias("e")))
    line = lambda x: F.concat(
        F.encode(F.concat(F.when(x["e"]["is_dir"], "40000 ").otherwise("100644 "), x["e"]["name"], F.chr(F.lit(0))), "UTF-8"), F.unhex(x["e"]["oid"])
    )
    return F.unhex(F.array_join(F.transform(F.sort_array(keyed), lambda x: F.hex(line(x))), ""))


def tree_oid(entries: Column) -> Column:
    return object_oid("tree", tree_body(entries))


def trees_by_level(entries: DataFrame, by: list[str]) -> Iterator[DataFrame]:
    """``by``, dir, oid and body of all directories: an aggregate per level, the deepest first, the root last.

    ``entries`` has ``by``, path and oid. All directories of a level are built at once; the number of rounds is
    the depth of the deepest path.
    """
    parts = F.split("path", "/")
    files = entries.select(*by, F.slice(parts, 1, F.size(parts) - 1).alias("dir"), F.element_at(parts, -1).alias("name"), "oid", F.lit(False).alias("is_dir"))
    depth, up = files.agg(F.max(F.size("dir"))).first()[0] or 0, None
    for d in range(depth, -1, -1):
        level = files.where(F.size("dir") == d)
        level = level if up is None else level.unionByName(up)
        trees = level.groupBy(*by, "dir").agg(tree_body(F.collect_list(F.struct("name", "oid", "is_dir"))).alias("body"))
        trees = trees.withColumn("oid", object_oid("tree", F.col("body")))
        yield trees
        if d:
            up = trees.select(*by, F.slice("dir", 1, d - 1).alias("dir"), F.element_at("dir", -1).alias("name"), "oid", F.lit(True).alias("is_dir"))


def root_trees(entries: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and tree_oid of the root."""
    *_, root = trees_by_level(entries, by)
    return root.select(*by, F.col("oid").alias("tree_oid"))


def commit_body(tree: Column, parents: Column, author: Column, seconds: Column, message: Column) -> Column:
    """``author``: Name <mail>; times are in UTC."""
    stamp = F.concat(author, F.lit(" "), seconds.cast("string"), F.lit(" +0000\n"))
    body = F.concat(
        F.lit("tree "), tree, F.lit("\n"), F.array_join(F.transform(parents, lambda p: F.concat(F.lit("parent "), p, F.lit("\n"))), ""),
        F.lit("author "), stamp, F.lit("committer "), stamp, F.lit("\n"), message, F.lit("\n"),
    )
    return F.encode(body, "UTF-8")


def commit_oid(tree: Column, parents: Column, author: Column, seconds: Column, message: Column) -> Column:
    return object_oid("commit", commit_body(tree, parents, author, seconds, message))
