"""Files that arrive in a folder, as snapshots: every micro-batch is a commit of what is there by then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blockstrata.operators.flatten import flatten
from blockstrata.operators.registry import Registry
from blockstrata.plans.store import Store
from blockstrata.sources.files import _key

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def snapshots(store: Store, folder: str, registry: Registry, checkpoint: str, *, branch: str = "main", available_now: bool = True) -> StreamingQuery:
    """A batch that is repeated after a failure finds its message in the branch's log and is not committed twice."""
    spark = store.spark
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").load(folder)

    def commit(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        message = f"batch {number} of {folder}"
        known = store.exists() and store.table("commits").where(F.col("message") == message).count()
        if not known:
            objects = flatten(batch.select(_key(folder).alias("key"), "content"), registry)
            begun = store.exists() and store.resolve(branch)
            store.commit(objects, message, branch=branch, init=None, inherit=branch if begun else None)

    out = files.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
