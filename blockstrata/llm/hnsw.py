"""Nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one point that carries its least ids: as ties go to the smaller id, more are never asked
for. Points are hashed to shards of bounded size; a task builds each shard's graph and keeps it as flat arrays
of neighbours. Queries come to the graphs in blocks, and the shards' results are merged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockstrata.llm.store import settle

#: Points per shard, queries per block, links per node (twice as many on the ground level), beams of build and search.
SHARD, BLOCK, M, BUILD, SEARCH = 8192, 2048, 12, 64, 192


class Graph:
    """Levels of a node are consecutive rows of ``links``, from ``first[node]`` up; -1 fills a row."""

    def __init__(self, points: np.ndarray, links: np.ndarray, first: np.ndarray, top: np.ndarray, entry: int):
        self.points, self.links, self.first, self.top, self.entry = points, links, first, top, entry

    @classmethod
    def build(cls, points: np.ndarray) -> Graph:
        n = len(points)
        u = np.random.default_rng(7).random(n)
        top = np.minimum(np.floor(-np.log1p(-u) / math.log(M)), 12).astype("i4")
        first = np.concatenate([[0], np.cumsum(top + 1)[:-1]]).astype("i4") if n else np.zeros(0, "i4")
        g = cls(points, np.full((int((top + 1).sum()), 2 * M), -1, "i4"), first, top, 0)
        for node in range(1, n):
            g._insert(node)
        return g

    def _far(self, q: np.ndarray, nodes) -> np.ndarray:
        d = self.points[nodes] - q
        return np.einsum("ij,ij->i", d, d)

    def _insert(self, node: int) -> None:
        q, at, high = self.points[node], self.entry, int(self.top[self.entry])
        seen = np.zeros(node + 1, bool)
        own = int(self.top[node])
        for level in range(high, own, -1):
            at = self._descend(q, at, level)
        start = [(float(self._far(q, [at])[0]), at)]
        for level in range(min(high, own), -1, -1):
            start = self._beam(q, start, level, BUILD, seen)
            near = self._spread([x for _, x in start], np.array([d for d, _ in start]), M)
            room = 2 * M if level == 0 else M
            self.links[self.first[node] + level, : len(near)] = near
            for x in near:
                row = self.links[self.first[x] + level]
                free = int((row >= 0).sum())
                if free < room:
                    row[free] = node
                else:
                    all_ = np.append(row[:room], node)
                    far = self._far(self.points[x], all_)
                    order = np.argsort(far, kind="stable")
                    kept = self._spread(all_[order].tolist(), far[order], room)
                    row[:] = -1
                    row[: len(kept)] = kept
        if own > high:
            self.entry = node

    def _spread(self, nodes: list[int], far: np.ndarray, most: int) -> list[int]:
        """Of nodes sorted by distance those that are nearer to the centre than to any node taken before; then the nearest others."""
        p = self.points[nodes]
        sq = np.einsum("ij,ij->i", p, p)
        between = sq[:, None] + sq[None, :] - 2 * (p @ p.T)
        least, taken = np.full(len(nodes), np.inf), []
        for k in range(len(nodes)):
            if far[k] <= least[k]:
                taken.append(k)
                if len(taken) == most:
                    break
                np.minimum(least, between[k], out=least)
        if len(taken) < most:
            held = set(taken)
            taken += [k for k in range(len(nodes)) if k not in held][: most - len(taken)]
        return [nodes[k] for k in taken]

    def _descend(self, q: np.ndarray, at: int, level: int) -> int:
        best = float(self._far(q, [at])[0])
        while True:
            row = self.links[self.first[at] + level]
            row = row[row >= 0]
            if not len(row):
                return at
            far = self._far(q, row)
            k = int(far.argmin())
            if far[k] >= best:
                return at
            at, best = int(row[k]), float(far[k])

    def _beam(self, q: np.ndarray, start: list[tuple[float, int]], level: int, width: int, seen: np.ndarray) -> list[tuple[float, int]]:
        """The ``width`` nearest found on a level, nearest first."""
        seen[:] = False
        ahead = list(start)
        heapq.heapify(ahead)
        found = [(-d, x) for d, x in start]
        heapq.heapify(found)
        seen[[x for _, x in start]] = True
        while ahead:
            d, x = heapq.heappop(ahead)
            if len(found) >= width and d > -found[0][0]:
                break
            row = self.links[self.first[x] + level]
            row = row[row >= 0]
            row = row[~seen[row]]
            if not len(row):
                continue
            seen[row] = True
            far = self._far(q, row)
            if len(found) >= width:
                ok = far < -found[0][0]
                row, far = row[ok], far[ok]
            for d, x in zip(far.tolist(), row.tolist(), strict=True):
                if len(found) < width:
                    heapq.heappush(found, (-d, x))
                elif d < -found[0][0]:
                    heapq.heapreplace(found, (-d, x))
                else:
                    continue
                heapq.heappush(ahead, (d, x))
        return sorted((-d, x) for d, x in found)

    def search(self, q: np.ndarray, width: int) -> list[int]:
        if not len(self.points):
            return []
        at = self.entry
        for level in range(int(self.top[at]), 0, -1):
            at = self._descend(q, at, level)
        return [x for _, x in self._beam(q, [(float(self._far(q, [at])[0]), at)], 0, width, np.zeros(len(self.points), bool))]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct (_id, _v) without null ids and without vectors that are null, empty, zero or not finite throughout."""
    v = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v")).distinct()


def build_index(vectors: DataFrame, k: int) -> DataFrame:
    """A row per shard: dim, shard, points, ids (k + 1 least per point), links, first, top, entry; settled."""
    least = Window.partitionBy("_v").orderBy("_id")
    few = vectors.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= k + 1)
    points = settle(few.groupBy("_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids")), "points")
    shards = max(1, math.ceil(points.count() / SHARD))
    placed = points.select(F.size("_v").alias("dim"), F.pmod(F.xxhash64("_v"), F.lit(shards)).cast("int").alias("shard"), "_v", "_ids")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_ids", key=lambda c: c.map(lambda x: x[0]), kind="stable")
        p = np.stack(rows["_v"].to_list()).astype("f8")
        ids = np.full((len(p), k + 1), -1, "i8")
        sizes = np.array([len(x) for x in rows["_ids"]], "i4")
        for i, x in enumerate(rows["_ids"]):
            ids[i, : len(x)] = x
        g = Graph.build(p)
        return pd.DataFrame({
            "dim": [int(key[0])], "shard": [int(key[1])], "points": [p.tobytes()], "ids": [ids.tobytes()], "sizes": [sizes.tobytes()],
            "links": [g.links.tobytes()], "first": [g.first.tobytes()], "top": [g.top.tobytes()], "entry": [g.entry],
        })

    kind = "dim int, shard int, points binary, ids binary, sizes binary, links binary, first binary, top binary, entry int"
    return settle(placed.groupBy("dim", "shard").applyInPandas(build, kind), "graphs")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest found: query_id, rank, vec_id, score (Euclidean distance in double precision).

    A query's own id is no candidate. Null, empty, zero and non-finite vectors and null ids take no part;
    repeated rows count once; vectors of other lengths than the query's are no candidates. Ties go to the
    smaller id. No usable vectors or queries: an empty result. Other columns play no part.
    """
    graphs = build_index(usable(vectors, id_col, vector_col), k)
    asked = settle(usable(queries, id_col, vector_col).withColumn("dim", F.size("_v")), "asked")
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    pile = asked.withColumn("block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")).groupBy("dim", "block")
    pile = pile.agg(F.sort_array(F.collect_list(F.struct("_id", "_v"))).alias("q"))
    # A task's rows are graphs, each followed by all blocks: a graph is read once and stays while queries pass.
    places = graphs.select("dim", "shard")  # a row for each SHARD points
    met = graphs.withColumn("block", F.lit(-1)).unionByName(pile.join(F.broadcast(places), "dim"), allowMissingColumns=True)
    met = met.repartition(max(1, places.count()), "dim", "shard").sortWithinPartitions("dim", "shard", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, ids, sizes = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                dim = r["dim"].as_py()
                if r["block"].as_py() < 0:
                    raw = lambda c, kind, r=r: np.frombuffer(r[c].as_buffer(), kind)
                    g = Graph(raw("points", "f8").reshape(-1, dim), raw("links", "i4").reshape(-1, 2 * M), raw("first", "i4"), raw("top", "i4"), r["entry"].as_py())
                    ids, sizes = raw("ids", "i8").reshape(-1, k + 1), raw("sizes", "i4")
                    continue
                out, own = [], r["q"].values
                q_ids, q_v = own.field("_id").to_pylist(), np.asarray(own.field("_v").flatten()).reshape(-1, dim)
                for qid, q in zip(q_ids, q_v, strict=True):
                    near = g.search(q, max(SEARCH, k + 1))
                    score = np.sqrt(g._far(q, near)).tolist()
                    some = [(s, x) for s, node in zip(score, near, strict=True) for x in ids[node, : sizes[node]].tolist() if x != qid]
                    out += [(qid, x, s) for s, x in heapq.nsmallest(k, some)]
                columns = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
