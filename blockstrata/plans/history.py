"""Questions to the history of a store, or to tables shaped like one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIB = 1024 * 1024
#: Statistics that are kept of a key: value report.
REPORT = ("count", "size", "in-pack", "packs", "size-pack", "prune-packable", "garbage", "size-garbage")


def log(commits: DataFrame, n: int = 50) -> DataFrame:
    """The latest n commits, newest first."""
    out = commits.orderBy(F.col("ts").desc(), "commit_id").limit(n)
    return out.select("commit_id", F.substring("commit_id", 1, 7).alias("short_id"), "message", "author", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"))


def parse_log(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines of five fields separated by U+001F; others are dropped."""
    part = F.split(column, "\x1f", 5)
    fields = ["commit_id", "short_id", "message", "author", "date"]
    return lines.where(F.size(part) == 5).select(*[part[i].alias(f) for i, f in enumerate(fields)])


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and change: A(dded), D(eleted), M(odified) or '='."""
    both = old.select("path", F.col("oid").alias("_old")).join(new.select("path", F.col("oid").alias("_new")), "path", "full_outer")
    change = F.when(F.col("_old").isNull(), "A").when(F.col("_new").isNull(), "D").when(F.col("_old") == F.col("_new"), "=").otherwise("M")
    return both.select("path", change.alias("change"))


def increments(entries: DataFrame) -> DataFrame:
    """``entries``: n (number of the snapshot), oid, size. Per snapshot new_blobs, new_bytes, total_bytes.

    First appearances are summed before anything is ordered: the window sees a row per snapshot."""
    first = entries.groupBy("oid").agg(F.min("n").alias("n"), F.min("size").alias("size"))
    per = first.groupBy("n").agg(F.count("*").alias("new_blobs"), F.sum("size").alias("new_bytes"))
    return per.withColumn("total_bytes", F.sum("new_bytes").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))


def stats(entries: DataFrame, *by: str) -> DataFrame:
    """Objects, distinct objects and bytes with and without repeats."""
    per = entries.groupBy(*by, "oid").agg(F.count("*").alias("_n"), F.sum("size").alias("_all"), F.min("size").alias("_one"))
    return per.groupBy(*by).agg(
        F.sum("_n").alias("objects"), F.count("*").alias("distinct_objects"), F.sum("_all").cast("long").alias("bytes"), F.sum("_one").cast("long").alias("distinct_bytes")
    )


def parse_report(lines: DataFrame, column: str = "line") -> DataFrame:
    """One row from 'key: value' lines: unknown keys are ignored, bad numbers are 0; sizes, in KiB, come as MiB."""
    part = F.split(column, ": ", 2)
    value = F.coalesce(F.get(part, F.lit(1)).try_cast("double"), F.lit(0.0))
    pick = lambda k: F.coalesce(F.max(F.when(F.get(part, F.lit(0)) == k, value)), F.lit(0.0)) / (1024 if k.startswith("size") else 1)
    out = lines.agg(*[pick(k).alias(k.replace("-", "_")) for k in REPORT])
    return out.withColumn("total_mib", F.col("size") + F.col("size_pack") + F.col("size_garbage"))


def growth(before: Column, after: Column) -> Column:
    """Per cent; null without a baseline."""
    return F.try_divide((after - before) * 100.0, before)


def as_of(events: DataFrame, key: str, ts: str, at: Column, *order: str) -> DataFrame:
    """The latest row of each key not after ``at``."""
    newest = F.max_by(F.struct(*events.columns), F.struct(ts, *order))
    return events.where(F.col(ts) <= at).groupBy(key).agg(newest.alias("_r")).select("_r.*")


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("_r")).select("_r.*")


def retained(files: DataFrame, by: list[str], newest: list[Column], size: str, limit: int) -> DataFrame:
    """Files, newest first, as long as their sizes together stay within the limit."""
    run = Window.partitionBy(*by).orderBy(*newest).rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("running", F.sum(size).over(run)).where(F.col("running") <= limit)
