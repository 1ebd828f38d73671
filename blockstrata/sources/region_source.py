"""Region files as a data source: spark.read.format("region").load(folder) has a row per chunk.

A file is a partition. Coordinates in a file's name prune files before they are opened, when filters are pushed
(spark.sql.python.filterPushdown.enabled).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from blockstrata.sources.files import open_store
from blockstrata.sources.region import SIDE, read_region

#: Chunks that leave at once, as Arrow batches: rows of Python values would be gathered by thousands.
CHUNKS = 64
_NAME = re.compile(r"(?:^|/)r\.(-?\d+)\.(-?\d+)\.mca$")


class RegionFile(InputPartition):
    def __init__(self, path: str, x: int, z: int):
        super().__init__(path)
        self.path, self.x, self.z = path, x, z


class RegionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.want = options["path"], {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("chunk_x",), ("chunk_z",)):
                self.want[f.attribute[0]] = f.value // SIDE
            yield f  # rows are filtered again: only files are pruned here

    def partitions(self) -> list[RegionFile]:
        from pyarrow import fs

        store, base = open_store(self.root)
        out = []
        for info in store.get_file_info(fs.FileSelector(base, recursive=True)):
            m = _NAME.search(info.path)
            if m and self.want.get("chunk_x", int(m[1])) == int(m[1]) and self.want.get("chunk_z", int(m[2])) == int(m[2]):
                out.append(RegionFile(info.path, int(m[1]), int(m[2])))
        return out

    def read(self, partition: RegionFile) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.root)
        with store.open_input_file(partition.path) as f:
            region = read_region(f.read(), partition.x, partition.z)
        found = region.chunks if region else []
        for at in range(0, len(found), CHUNKS):
            xs, zs, raw = zip(*found[at : at + CHUNKS], strict=True)
            columns = [pa.array([partition.path] * len(raw)), pa.array(xs, pa.int32()), pa.array(zs, pa.int32()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "chunk_x", "chunk_z", "nbt"])


class RegionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "region"

    def schema(self) -> str:
        return "path string, chunk_x int, chunk_z int, nbt binary"

    def reader(self, schema) -> RegionReader:  # noqa: ARG002
        return RegionReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RegionSource)
