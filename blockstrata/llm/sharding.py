"""Sharding by sampled splitters.

Keys are (text digest, id), so equal texts lie side by side. A size-weighted sample of keys gives quantile
boundaries of many fine ranges; their exact sizes are counted, and ranges that are overfull are subdivided by
new and denser samples from inside them, until none is left that a boundary could divide. Rows are sorted
within a range only. The ranges' prefix sums then place every row on one line of bytes, which is cut into
shards of equal length: sizes differ by less than one document.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockstrata.llm.store import discard, settle

#: Ranges: at least so many a shard, one for so many rows, and at most so many in all, as they travel with the plan.
RANGES, ROWS, MOST = 32, 200_000, 8192
#: Sampled keys per share of a range, and how many shares make a range overfull.
DRAWS, OVERFULL = 8, 2


def _range_of(key: Column, bounds: list) -> Column:
    """How many boundaries are at most the key: binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    at = F.from_json(F.lit(json.dumps([{"k": k, "i": i, "r": r} for k, i, r in bounds])), "array<struct<k:string,i:bigint,r:bigint>>")
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda n, step: F.when(F.coalesce(key >= F.get(at, n + step - 1), F.lit(False)), n + step).otherwise(n),
    )


def _draws(pool: DataFrame, per: float, number: int) -> list:
    """Keys in order, about one for each ``per`` bytes; a row of ``per`` bytes or more is drawn surely. Every round has
    draws of its own."""
    u = F.shiftrightunsigned(F.xxhash64("_k", F.lit(number)), 11).cast("double") / float(2**53)
    return sorted(tuple(r[0]) for r in pool.where(u * per < F.col("size")).select("_k").toLocalIterator())


def overfull(keyed: DataFrame, bounds: list, share: float) -> list[int]:
    """Ranges with more than OVERFULL shares beside their largest row, which no boundary divides."""
    sizes = keyed.groupBy(_range_of(F.col("_k"), bounds).alias("_range")).agg((F.sum("size") - F.max("size")).alias("n"))
    return [r[0] for r in sizes.where(F.col("n") > OVERFULL * share).select("_range").toLocalIterator()]


def boundaries(keyed: DataFrame, total: int, ranges: int) -> list:
    """Keys at which ranges begin, so that none is overfull. ``keyed``: _k (unique) and size.

    What comes to the driver is bounded: about DRAWS keys a range at first, then DRAWS, twice that and so on for each
    share of the few ranges still overfull. Draws end up dense enough to part any two rows, so the loop ends.
    """
    share = total / ranges or 1
    drawn = _draws(keyed, share / DRAWS, 0)
    step = max(1, round(len(drawn) / ranges))
    bounds, number = drawn[step - 1 :: step], 0
    while full := overfull(keyed, bounds, share):
        number += 1
        pool = keyed.where(_range_of(F.col("_k"), bounds).isin(full))
        bounds = sorted({*bounds, *_draws(pool, share / (DRAWS << number), number)[:: max(1, DRAWS >> number)]})
    return bounds


def shard_rows(slim: DataFrame, shards: int) -> DataFrame:
    """``slim`` has _key, _id, _row (unique) and size >= 1; adds shard and slot. ``slim`` must be settled."""
    totals = slim.agg(F.sum("size"), F.count("*")).first()
    total = totals[0] or 0
    key = F.struct(F.col("_key"), F.coalesce(F.col("_id"), F.lit(-(2**63))).alias("_id"), F.col("_row"))
    bounds = boundaries(slim.withColumn("_k", key), total, min(max(shards * RANGES, math.ceil(totals[1] / ROWS)), MOST))
    ranged = slim.withColumn("_range", _range_of(key, bounds).cast("int"))
    line = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    stats = ranged.groupBy("_range").agg(F.sum("size").alias("_n"), F.count("*").alias("_c"))
    # As many rows as ranges, MOST and a few more: fit for one window and for a broadcast.
    stats = stats.select(
        "_range", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_bytes"), F.coalesce(F.sum("_c").over(line), F.lit(0)).alias("_rank")
    )
    inside = Window.partitionBy("_range").orderBy("_key", "_id", "_row")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        ranged.join(F.broadcast(stats), "_range")
        .withColumn("_at", F.col("_bytes") + before)
        .withColumn("_place", F.col("_rank") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"cast((_at * {shards}L) div {max(total, 1)}L as int)"))
        .drop("_range", "_bytes", "_rank", "_at")
    )
    placed = settle(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("_place").alias("_first"))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_place") - F.col("_first")).drop("_place", "_first")


def shard_documents(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, size (UTF-8 bytes + 1), text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Equal texts share a shard unless a shard ends among them. A null text counts as an empty one (size 1,
    CRC 0); a null id sorts first. Repeated rows are rows of their own, told apart by a row number that is
    fixed once written. An empty table gives an empty result; other columns play no part.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"),
        F.crc32(text).alias("text_crc32"), F.md5(text).alias("_key"), F.monotonically_increasing_id().alias("_row"),
    )
    slim = settle(slim, "sizes")
    out = shard_rows(slim, shards)
    discard(slim)
    return out.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
