"""Quality rules with risk-controlled thresholds.

Every rule compares a ratio of counts with a cutoff. Cutoffs aren't set by hand: in each stratum, and for each
rule, the grid of cutoffs is tested from loose to strict on labelled documents. A cutoff is certified if the
exact binomial tail says that it rejects at most RISK / rules of the good documents, at level CONFIDENCE
divided by rules and strata (Bonferroni); along the grid the tests stop at the first failure, which needs no
further correction. So, with the stated confidence, no stratum loses more than RISK of its good documents to
all rules together. A stratum with too few labels gets no cutoff.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockstrata.llm.store import settle
from blockstrata.llm.text import BLANKS, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
#: Share of good documents that all rules together may reject in a stratum, and the chance that this fails.
RISK, DELTA = 0.02, 0.05
#: Cutoffs in thousandths, loose to strict.
GRID = (900, 800, 700, 600, 500, 400, 300, 250, 200, 160, 130, 100, 80, 65, 50, 40, 30, 25, 20, 15, 10)
#: Rule: (counted, of how many). A document fails if 1000 * counted > cutoff * of.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
}


def _repeat_words(hashes: Column, n_words: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more. Sorting is paid for only where a hash repeats."""
    m = F.size(hashes)
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda z, a, b: F.coalesce(F.get(z, a)["h"] == F.get(z, b)["h"], F.lit(False))
    # One-element arrays bind a value to a name inside an expression.
    twice = F.transform(
        F.array(placed),
        lambda z: F.sort_array(F.transform(F.filter(z, lambda x, j: same(z, j, j - 1) | same(z, j, j + 1)), lambda x: x["i"])),
    )
    covered = F.transform(
        twice, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, b: a + b)
    )
    return F.when((m < 2) | (m == F.size(F.array_distinct(hashes))), 0).otherwise(F.get(covered, F.lit(0))).cast("long")


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rid = lambda chars: F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    out = docs.withColumn("_w", F.transform(words(text), lambda w: F.xxhash64(w))).withColumn("_l", lines)
    out = out.withColumn("n_words", F.size("_w").cast("long")).withColumn(
        "_h",
        F.when(F.size("_w") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_w"), i, WINDOW)))).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    out = out.withColumns({
        "word_chars": rid(BLANKS).cast("long"), "n_symbols": (F.length(text) - rid(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"), "n_repeat_words": _repeat_words(F.col("_h"), F.col("n_words")),
        "n_lines": F.size("_l").cast("long"), "n_capitals": (F.length(text) - rid(CAPITALS)).cast("long"),
    }).drop("_w", "_l", "_h")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p). From k downwards terms only shrink while k <= np, so the sum stops when they no longer count."""
    if k >= n * p:
        return 1.0
    total = term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    while k > 0 and term > total * 1e-16:
        term *= k * (1 - p) / ((n - k + 1) * p)
        total += term
        k -= 1
    return total


def cutoffs(counted: DataFrame, labels: DataFrame, id_col: str, stratum_col: str) -> DataFrame:
    """Certified cutoffs: a row per stratum that has any, _stratum and cut_<rule> (null: none).

    What comes to the driver is a row of counts per stratum with enough labels for a certificate; there are
    at most labels / least of these.
    """
    spark = counted.sparkSession
    good = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max("quality").alias("_good")).where("_good = 1")
    over = [F.sum((1000 * F.col(a) > c * F.col(b)).cast("long")).alias(f"{rule}_{c}") for rule, (a, b) in RULES.items() for c in GRID]
    held = counted.where(~F.col("base_failed")).join(good, F.col(id_col) == F.col("_id"))
    per = held.groupBy(F.col(stratum_col).alias("_stratum")).agg(F.count("*").alias("_n"), *over)
    strata = counted.select(stratum_col).distinct().count()
    level, risk = DELTA / (len(RULES) * max(strata, 1)), RISK / len(RULES)
    least = math.ceil(math.log(level) / math.log1p(-risk))
    rows = []
    for r in per.where(F.col("_n") >= least).toLocalIterator():
        row = {"_stratum": r["_stratum"]}
        for rule in RULES:
            for c in GRID:
                if binomial_tail(r[f"{rule}_{c}"], r["_n"], risk) > level:
                    break
                row[f"cut_{rule}"] = c
        rows.append(row)
    kind = "array<struct<_stratum:string," + ",".join(f"cut_{x}:int" for x in RULES) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def _judged(counted: DataFrame, cuts: DataFrame, stratum_col: str) -> DataFrame:
    """Adds kept. Cutoffs have come through the driver, so they are small enough to broadcast."""
    fails = F.lit(False)
    for rule, (a, b) in RULES.items():
        fails = fails | F.coalesce(1000 * F.col(a) > F.col(f"cut_{rule}") * F.col(b), F.lit(False))
    joined = counted.join(F.broadcast(cuts), F.col(stratum_col).cast("string").eqNullSafe(F.col("_stratum")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~fails)


def judge_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Per document: id, counts, base_failed and kept.

    A null text has no words and fails the base rule; a null stratum is a stratum of its own. Of labels that
    contradict each other the best counts; a null label is none. Repeated rows are judged alike, each by
    itself. An empty table gives an empty result; other columns play no part.
    """
    counted = settle(with_counts(docs.select(id_col, text_col, stratum_col), text_col).drop(text_col), "counts")
    out = _judged(counted, cutoffs(counted, labels, id_col, stratum_col), stratum_col)
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that judge_documents() keeps, with their columns. Texts aren't shuffled: counts are
    found twice, once as a slim table for the cutoffs and once in place."""
    slim = settle(with_counts(docs.select(id_col, text_col, stratum_col), text_col).drop(text_col), "counts")
    cuts = cutoffs(slim, labels, id_col, stratum_col)
    packed = docs.select(F.col(text_col).alias("_text"), F.col(stratum_col).alias("_lang"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    # A generated column: a filter on the verdict itself would move down and repeat all the counting in each of its terms.
    judged = _judged(with_counts(packed, "_text"), cuts, "_lang").select("_row", F.explode(F.array("kept")).alias("_stays"))
    return judged.where("_stays").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
