"""Profiles of saves, kept as a JSON array: one per save folder."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "save_dir string, mc_version string, branch string, remote_url string, updated_at string"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]


def normalize(profiles: DataFrame, order: str = "_n") -> DataFrame:
    """Without blank folders, the first of each folder, sorted."""
    first = Window.partitionBy("save_dir").orderBy(order)
    kept = profiles.where(F.trim("save_dir") != "").withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return kept.select(*FIELDS).orderBy("save_dir")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A missing file has no profiles."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{SCHEMA.replace(' string', ':string')}>>")).alias("_n", "p"))
    return normalize(rows.select("_n", "p.*"))


def write(profiles: DataFrame, path: str) -> None:
    """One pretty-printed file; profiles are few."""
    spark = profiles.sparkSession
    text = json.dumps([r.asDict() for r in normalize(profiles.withColumn("_n", F.monotonically_increasing_id())).collect()], indent=2, ensure_ascii=False)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def upsert(profiles: DataFrame, profile: dict[str, str], now: datetime | None = None) -> DataFrame:
    """The profile replaces the one of its folder, or is added, with the time of the change."""
    stamped = profile | {"updated_at": (now or datetime.now(UTC)).isoformat()}
    row = profiles.sparkSession.createDataFrame([tuple(stamped.get(f) for f in FIELDS)], SCHEMA)
    return normalize(row.withColumn("_n", F.lit(0)).unionByName(profiles.withColumn("_n", F.lit(1))))


def delete(profiles: DataFrame, save_dir: str) -> DataFrame:
    return profiles.where(F.col("save_dir") != save_dir)
