"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets an exponential key, -ln(u) / w, where u is a hash of its id and text and w a quality
weight. Sorted by key, a source's documents are a weighted random order; a prefix sum of their sizes says how
far a token budget reaches. A budget above the source's size first takes whole epochs and then a prefix.

No source is sorted in one task: sizes are summed by key bucket first, and only the one bucket per source in
which the budget runs out is sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockstrata.llm.store import discard, settle
from blockstrata.llm.text import unit, word_count

#: Key buckets per source. Only rows of one bucket per source are ever sorted.
BUCKETS = 4096
NOISE = "#*$%&|<>{}[]=_~^"


def quality_weight(text: Column) -> Column:
    """Share of characters that aren't noise symbols, to the fourth power; 0.001 at least, also for empty texts."""
    n = F.length(text).cast("double")
    share = F.coalesce(F.when(n > 0, F.length(F.translate(text, NOISE, "")) / n), F.lit(0.0))
    square = share * share
    return F.greatest(square * square, F.lit(0.001))


@dataclass(frozen=True)
class Mix:
    """What a mix needs from the columns of documents."""

    id_col: str = "doc_id"
    text_col: str = "text"
    source_col: str = "source"
    cycle: tuple[int, ...] = (5, 2, 1)
    share_halves: int = 3  # of all sizes, in halves: 3 is 150 %
    cap: int = 2
    seed: int = 11

    def keyed(self, docs: DataFrame) -> DataFrame:
        """``docs`` with _size, _key, _tie and _bucket; _key falls as the document should come earlier."""
        text = F.col(self.text_col)
        u = unit(F.lit(self.seed), F.col(self.id_col), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
        return (
            docs.withColumn("_size", word_count(text))
            .withColumn("_key", -F.log(u) / quality_weight(text))
            .withColumn("_tie", F.md5(F.coalesce(text, F.lit("")).cast("binary")))
            .withColumn("_bucket", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("_key"))) * BUCKETS)).cast("int"))
        )

    def targets(self, slim: DataFrame) -> DataFrame:
        """A row per source: _source, source_size, target. Sources are few beside documents."""
        sizes = slim.groupBy(F.col(self.source_col).alias("_source")).agg(F.sum("_size").alias("source_size"))
        ordered = Window.orderBy(F.col("_source").asc_nulls_last())
        cycle = F.array(*[F.lit(w).cast("long") for w in self.cycle])
        at = (F.row_number().over(ordered) - 1) % len(self.cycle)
        weighed = sizes.withColumn("_w", F.get(cycle, at)).withColumn("_total", F.sum("source_size").over(Window.partitionBy()))
        # Sources that reach their cap come first by size over weight; the level of the others follows from what is left.
        fill = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("_source").asc_nulls_last())
        before = fill.rowsBetween(Window.unboundedPreceding, -1)
        filled = (
            weighed.withColumn("_rank", F.row_number().over(fill))
            .withColumn("_left2", F.col("_total") * self.share_halves - 2 * self.cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
            .withColumn("_w_left", F.sum("_w").over(Window.partitionBy()) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
            .withColumn("_free", 2 * self.cap * F.col("source_size") * F.col("_w_left") >= F.col("_w") * F.col("_left2"))
        )
        level = F.min(F.when(F.col("_free"), F.struct("_rank", "_left2", "_w_left"))).over(Window.partitionBy())
        free = F.col("_w") * F.col("_level._left2") / (2 * F.col("_level._w_left"))
        return filled.withColumn("_level", level).select(
            "_source", "source_size",
            F.when(F.col("_rank") >= F.col("_level._rank"), free).otherwise(F.col("source_size") * self.cap).cast("double").alias("target"),
        )

    def plan(self, slim: DataFrame) -> DataFrame:
        """A row per source: _source, source_size, target, _epochs, _cut_bucket and _cut, the last row of the prefix."""
        targets = self.targets(slim)
        s, t = F.col("source_size"), F.col("target")
        goals = targets.withColumn("_epochs", F.when(s > 0, F.floor(t / s)).otherwise(0).cast("long")).withColumn("_rest", t - F.col("_epochs") * s)
        sums = slim.groupBy(F.col(self.source_col).alias("_s"), F.col("_bucket").alias("_b")).agg(F.sum("_size").alias("_n"))
        before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        cuts = (
            goals.join(sums, F.col("_source").eqNullSafe(F.col("_s")))
            .where(F.col("_before") <= F.col("_rest"))
            .groupBy("_source", "source_size", "target", "_epochs", "_rest")
            .agg(F.max("_b").alias("_cut_bucket"), F.max_by("_before", "_b").alias("_before"))
        )
        rows = slim.join(cuts, F.col(self.source_col).eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_cut_bucket")))
        order = [F.col("_key"), F.col(self.id_col).asc_nulls_first(), F.col("_tie")]
        run = Window.partitionBy("_source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        upto = F.col("_before") + F.coalesce(F.sum("_size").over(run), F.lit(0))
        last = (
            rows.withColumn("_in", 2 * upto + F.col("_size") <= 2 * F.col("_rest"))
            .groupBy(F.col("_source").alias("_s"))
            .agg(F.max(F.when(F.col("_in"), self.place())).alias("_cut"))
        )
        return cuts.drop("_before", "_rest").join(last, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")

    def place(self) -> Column:
        return F.struct(F.col("_key"), F.col(self.id_col).alias("_id"), F.col("_tie"))

    def times(self) -> Column:
        """How often the mix takes a row of keyed documents joined with plan()."""
        earlier = (F.col("_bucket") < F.col("_cut_bucket")) | ((F.col("_bucket") == F.col("_cut_bucket")) & F.coalesce(self.place() <= F.col("_cut"), F.lit(False)))
        return F.col("_epochs") + F.when(earlier, 1).otherwise(0)


def mix_plan(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """(slim keyed rows, plan per source), both settled."""
    slim = settle(mix.keyed(docs).select(mix.id_col, mix.source_col, "_size", "_key", "_tie", "_bucket"), "mix")
    return slim, settle(mix.plan(slim), "mix-plan")


def mix_report(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per document: id, size in words, its source's size and target, and the words that the mix takes.

    A null or empty text has size 0 and nothing to take; null is a source of its own, the last one. Rows with
    the same id and text share a key and are taken or left together. An empty table gives an empty result;
    other columns play no part.
    """
    slim, plan = mix_plan(docs.select(mix.id_col, mix.text_col, mix.source_col), mix)
    joined = slim.join(plan, F.col(mix.source_col).eqNullSafe(F.col("_source")))
    return joined.select(
        mix.id_col, F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * mix.times()).alias("taken")
    )


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them: the plan is found on slim rows and
    applied in place, so texts aren't shuffled."""
    slim, plan = mix_plan(docs.select(mix.id_col, mix.text_col, mix.source_col), mix)
    discard(slim)
    names = docs.columns
    keyed = mix.keyed(docs.select(mix.id_col, mix.text_col, mix.source_col, F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")))
    joined = keyed.join(plan, F.col(mix.source_col).eqNullSafe(F.col("_source")))
    return joined.withColumn("_times", mix.times()).where("_times > 0").select(
        F.explode(F.array_repeat(F.col("_row"), F.col("_times").cast("int"))).alias("_row")
    ).select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
