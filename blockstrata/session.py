"""A session with the settings that the codecs expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows hold whole files or chunks, so Arrow batches are short. AQE splits skewed joins and merges small partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.parquet.compression.codec": "zstd",
}


def session(app: str = "blockstrata", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=SETTINGS | settings).getOrCreate()
