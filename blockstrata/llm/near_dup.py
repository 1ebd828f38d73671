"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in few bits differ in at most two in one of a few parts. In each part the
words of a covering code (a Hamming code, covering radius 1, over the first 2^m - 1 bits; the other bits stand
as they are) are anchors. Some point halfway between two members differs from either in one bit at most, and
the anchor next to it lies within radius + 1 of both: the threshold of two bits is borne by both sides, one
bit each. So every fingerprint is replicated to all anchors within 1 + 1 bits, 15 or 16 a part, and all links
meet at an anchor. Equal fingerprints travel once.

That bound is on bits. For a bound on the similarity of the texts, similar_dups() compares the sets of shingles
themselves: close fingerprints, found at anchors, are candidates; bands of least hashes add those whose fingerprints
are further apart; and exact counts of common shingles decide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockstrata.llm.components import components
from blockstrata.llm.store import settle
from blockstrata.llm.workers import tidy

SEED = 42
#: Rows that a task compares at once, and the size above which one anchor's rows are split further.
CHUNK, LARGE = 200_000, 2048
#: Tasks that share the members of a component, or of a group of candidates.
SALT = 32


# -- fingerprints ------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, k: int) -> int:
    """Majority bits of the XXH64 values of k-word shingles, lower-cased in A to Z; no words: 0."""
    return _majority(_hashes(text, k))


def _hashes(text: str | None, k: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle, in chunks."""
    import xxhash

    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not words:
        return
    joined, count = b" ".join(words), max(1, len(words) - k + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:count]
    ends, digest = ends[min(k, len(words)) - 1 :], xxhash.xxh64_intdigest
    for at in range(0, count, 65536):
        cut = [joined[a:b] for a, b in zip(starts[at : at + 65536].tolist(), ends[at : at + 65536].tolist(), strict=True)]
        yield np.array([digest(s, SEED) for s in cut], "<u8")


def _majority(chunks: Iterable[np.ndarray]) -> int:
    count, ones = 0, np.zeros(64, "i8")
    for h in chunks:
        count += len(h)
        octets = h.view("u1").reshape(-1, 8)
        if len(h) < 256:
            ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype="i8")
        else:
            ones += np.concatenate([np.bincount(b, minlength=256) @ _BITS for b in octets.T])
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


_BITS = np.unpackbits(np.arange(256, dtype="u1")[:, None], axis=1, bitorder="little").astype("i8")


def fingerprints(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """_id, _key (of the text) and _fp (64 bits, as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), k) for t in batch.column(1)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*batch.columns[::2], pa.array(fps)], ["_id", "_key", "_fp"])

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_key"))
    return slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, _key bigint, _fp bigint")


# -- anchors -----------------------------------------------------------------------------------------------------


def parts(bits: int) -> list[tuple[int, int, int]]:
    """(first bit, width, m) of the parts; 2^m - 1 bits of a part are coded. One part differs in two bits at most."""
    n = (bits + 3) // 3
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a, (b - a + 1).bit_length() - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(width: int, m: int) -> list[list[int]]:
    """By syndrome, what to XOR a part with to reach each anchor within two bits."""
    n, out = 2**m - 1, []
    flip = lambda i: 1 << (i - 1)
    for s in range(n + 1):
        home = flip(s) if s else 0
        two = [flip(i) | flip(i ^ s) for i in range(1, n + 1) if i < i ^ s and i != s] if s else []
        out.append([home, *two, *[home | 1 << j for j in range(n, width)]])
    return out


def anchors(fp: Column, bits: int, base: int = 0) -> Column:
    """Keys of all anchors that a fingerprint is replicated to: number of the part in the top bits, anchor below."""
    keys = []
    for p, (first, width, m) in enumerate(parts(bits), base):
        part = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        syndrome = F.lit(0)
        for b in range(m):
            odd = sum(1 << (i - 1) for i in range(1, 2**m) if i >> b & 1)
            syndrome = syndrome + F.bit_count(part.bitwiseAND(F.lit(odd))) % 2 * (1 << b)
        table = F.array(*[F.array(*[F.lit(x - 2**64 if x >= 2**63 else x).cast("long") for x in row]) for row in masks(width, m)])
        top = F.lit(p).cast("long") * (1 << 59) if width < 59 else F.lit(0).cast("long")
        keys.append(_moved(F.get(table, syndrome.cast("int")), part, top))
    return F.concat(*keys)


def _moved(by: Column, part: Column, top: Column) -> Column:
    return F.transform(by, lambda x: part.bitwiseXOR(x) + top)


def _close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def _links(fps: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of close fingerprints among those of one anchor, block by block. A large set is
    split by bits + 1 blocks of the 64 bits, of which one is equal in any close pair."""
    n, step = len(fps), LARGE // 2
    cuts = [64 * i // (bits + 1) for i in range(bits + 2)] if n > LARGE and bits < 16 else [0, 0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        key = (fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] + np.uint64(1)))
        for lo, hi in zip(at, [*at[1:], n], strict=True):
            own = order[lo:hi]
            for x in range(0, len(own), step):
                for y in range(x, len(own), step):
                    i, j = np.nonzero(_close(fps[own[x : x + step], None], fps[None, own[y : y + step]], bits))
                    yield own[x + i], own[y + j]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the links a - b: (member, root)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _compare(key: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by anchor, as stars. Short runs are compared at once by shifting the rows."""
    at = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    size = np.diff(at, append=len(key))
    short = np.repeat(size <= 32, size)
    found_a, found_b = [fps[:0]], [fps[:0]]
    for shift in range(1, min(32, int(size.max()))):
        i = np.flatnonzero((key[shift:] == key[:-shift]) & short[shift:])
        i = i[_close(fps[i], fps[i + shift], bits)]
        found_a.append(fps[i])
        found_b.append(fps[i + shift])
    for lo, n in zip(at[size > 32], size[size > 32], strict=True):
        own = fps[lo : lo + n]
        for i, j in _links(own, bits):
            # Only a forest of each block is kept: links never pile up as all pairs of a group.
            a, b = _forest(own[i], own[j])
            found_a.append(a)
            found_b.append(b)
    return _forest(np.concatenate(found_a), np.concatenate(found_b))


def _per_anchor(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def done(key: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(key) > 1:
                a, b = _compare(key, fps, bits)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view("i8")), pa.array(b.view("i8"))], ["a", "b"])

        for batch in batches:
            key, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            held.append((key, fps.view("u8")))
            rows += batch.num_rows
            if rows < CHUNK:
                continue
            key, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(key, key[-1]))  # the last anchor may go on in the next batch
            if last:
                yield from done(key[:last], fps[:last])
            held, rows = [(key[last:], fps[last:])], 0 if last else rows
        if held:
            yield from done(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        tidy()

    return run


def near_dups(docs: DataFrame, *, shingle: int = 5, bits: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, fingerprint (16 hex digits) and component_id, the least id reachable over links.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. A null id takes part, but is
    never a component's least one unless all are null. Repeated rows give repeated rows. An empty table gives
    an empty result; other columns play no part.
    """
    return _classes(*near_links(docs, shingle=shingle, bits=bits, id_col=id_col, text_col=text_col), id_col)


def near_links(docs: DataFrame, *, shingle: int = 5, bits: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, str]:
    """(rows, links a - b, the column of rows whose values are linked)."""
    rows = settle(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    return rows, _close_links(rows.select("_fp").distinct(), bits), "_fp"


def _close_links(fps: DataFrame, bits: int) -> DataFrame:
    """Links a - b of close ones among distinct fingerprints."""
    spread = fps.select(F.explode(anchors(F.col("_fp"), bits)).alias("key"), "_fp")
    return spread.repartition("key").sortWithinPartitions("key").mapInArrow(_per_anchor(bits), "a bigint, b bigint")


def _rooted(rows: DataFrame, edges: DataFrame, by: str, what: Column) -> DataFrame:
    """``edges`` are links between values of the column ``by``, each of which stands for all rows that have it. Per
    value, the least of ``what`` and the component's root."""
    roots = components(edges)
    groups = rows.groupBy(by).agg(F.min(what).alias("_least"))
    return groups.join(roots, F.col(by) == F.col("node"), "left").select(by, "_least", F.coalesce("root", by).alias("_root"))


def _classes(rows: DataFrame, edges: DataFrame, by: str, id_col: str) -> DataFrame:
    """The least ids go back to their components' members salted: one large component isn't one task's."""
    rooted = settle(_rooted(rows, edges, by, F.col("_id")), "rooted")
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"), F.count("*").alias("_n")).where("_n > 1")
    least = least.select("_root", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"), "component_id", F.lit(True).alias("_met"))
    named = rooted.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")).join(least, ["_root", "_salt"], "left")
    named = settle(named.select(by, F.when(F.col("_met"), F.col("component_id")).otherwise(F.col("_least")).alias("component_id")), "classes")
    return rows.join(named, by).select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- sets of shingles --------------------------------------------------------------------------------------------

#: Linked are sets of which PART of WHOLE shingles are common. One of BANDS bands of DEEP least hashes is equal in
#: all but (1 - 0.8^4)^32 = 5e-8 of pairs at just 0.8, and in more of those above.
PART, WHOLE, BANDS, DEEP = 4, 5, 32, 4
#: Sets and shingles in a block of a group of candidates; larger groups are compared by pairs of blocks.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 21
_BY, _PLUS = np.random.default_rng(SEED).integers(0, 2**32, (2, BANDS * DEEP, 1), "u4") | np.array([[[1]], [[0]]], "u4")


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Distinct values of a text's shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *_hashes(text, k)]))


def bands(own: np.ndarray) -> list[int]:
    """Keys of a set: sets that are alike have one in common."""
    import xxhash

    least, high = np.full(BANDS * DEEP, 2**32 - 1, "u4"), (own >> np.uint64(32)).astype("u4")
    for at in range(0, len(high), 4096):
        np.minimum(least, (high[at : at + 4096] * _BY + _PLUS).min(1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, DEEP))]


def _sets(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """_id, _key (of the text), _fp, _node (digest of the set of shingles), _size, and of a node's first row in a task _bands and _text."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                chunks = list(_hashes(text, k))
                own = np.unique(np.concatenate([np.zeros(0, "<u8"), *chunks]))
                node = xxhash.xxh64_intdigest(own.tobytes(), SEED)
                new = node not in met
                met.add(node)
                out.append((_majority(chunks), node, len(own), np.array(bands(own), "u8").view("i8") if new else None, (text or "") if new else None))
            fp, node, size, keys, text = zip(*out, strict=True) if out else [()] * 5
            longs = [pa.array(np.array(x, "u8").view("i8")) for x in (fp, node)]
            columns = [*batch.columns[::2], *longs, pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_key", "_fp", "_node", "_size", "_bands", "_text"])
        met.clear()
        tidy()

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_key"))
    return slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, _key bigint, _fp bigint, _node bigint, _size int, _bands array<bigint>, _text string")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: each node with the first of its key."""
    last = root = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        new = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first = np.where(at < 0, 0 if root is None else root, node[at])
        last, root = key[-1], first[-1]
        moved = first != node
        yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(first[moved])], ["a", "b"])


def alike(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that connect all sets of which PART of WHOLE shingles are common. Pairs that are connected already
    are not compared, nor those too different in size."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order], "i8")
    ends = np.cumsum(size)
    values, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    mark, label = np.zeros(len(values), bool), np.arange(len(sets))
    for i in range(len(sets) - 1):
        to = int(np.searchsorted(size, size[i] * WHOLE // PART, side="right"))
        if (label[i + 1 : to] == label[i]).all():
            continue
        own = flat[ends[i] - size[i] : ends[i]]
        mark[own] = True
        common = np.add.reduceat(mark[flat[ends[i] : ends[to - 1]]], ends[i : to - 1] - ends[i], dtype="i8")
        mark[own] = False
        for j in i + 1 + np.flatnonzero(common * WHOLE >= (size[i] + size[i + 1 : to] - common) * PART):
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                yield order[i], order[j]


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of alike sets among rows of root, lo, hi, node, set, sorted by these: of each pair of blocks, as stars."""

    def done() -> Iterator[pa.RecordBatch]:
        if len(sets) > 1:
            links, own = np.array(list(alike(sets)), "i8").reshape(-1, 2), np.array(nodes, "i8")
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _forest(own[links[:, 0]], own[links[:, 1]])], ["a", "b"])

    nodes: list[int] = []
    sets: list[np.ndarray] = []
    last = None
    for batch in batches:
        for *group, node, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != last:
                yield from done()
                nodes, sets, last = [], [], group
            if not nodes or nodes[-1] != node:  # else a copy from another task
                nodes.append(node)
                sets.append(np.frombuffer(own, "<u8"))
    yield from done()
    tidy()


def _close_nodes(rows: DataFrame, bits: int) -> DataFrame:
    """Candidates a - b: nodes whose fingerprints are equal or close, the least node of each standing for it."""
    pairs = settle(rows.select("_fp", "_node").distinct(), "pairs")
    least = settle(pairs.groupBy("_fp").agg(F.min("_node").alias("least")), "least")
    at = lambda end: least.select(F.col("_fp").alias(end), F.col("least").alias(f"{end}_least"))
    close = _close_links(least.select("_fp"), bits).join(at("a"), "a").join(at("b"), "b").select("a_least", "b_least")
    return close.union(pairs.join(least, "_fp").where("_node <> least").select("_node", "least")).toDF("a", "b")


def _alike(rows: DataFrame, k: int, bits: int) -> DataFrame:
    """Links a - b of nodes. Candidates that hang together are compared all with all."""
    spread = rows.where("_bands IS NOT NULL").select("_node", "_bands").dropDuplicates(["_node"]).select(F.explode("_bands").alias("key"), "_node")
    banded = spread.repartition("key").sortWithinPartitions("key", "_node").mapInArrow(_stars, "a bigint, b bigint")
    roots = components(_close_nodes(rows, bits).union(banded))
    members = settle(roots.union(roots.select("root", "root").distinct()).toDF("_node", "root"), "members")
    sizes = rows.groupBy("_node").agg(F.max("_size").alias("_size")).join(members, "_node")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("_size") / BLOCK_SHINGLES)).cast("int")
    per = sizes.groupBy("root").agg(blocks.alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, k).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], ["root", "n", "_node", "own"])
        tidy()

    salted = per.select("root", "n", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    wanted = members.withColumn("_salt", F.pmod(F.xxhash64("_node"), F.lit(SALT)).cast("int")).join(salted, ["root", "_salt"])
    wanted = settle(wanted.select("_node", "root", "n"), "wanted")
    texts = rows.where("_text IS NOT NULL").join(wanted, "_node").select("root", "n", "_node", "_text")
    sets = texts.mapInArrow(run, "root bigint, n int, _node bigint, own binary")
    block = F.pmod(F.xxhash64("_node"), F.col("n")).cast("int")
    # Blocks i and j meet in the group (i, j); a group of one block in (0, 0).
    other = F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda j: j != F.col("block")))
    dealt = sets.withColumn("block", block).withColumn("j", F.explode(other))
    dealt = dealt.select("root", F.least("block", "j").alias("lo"), F.greatest("block", "j").alias("hi"), "_node", "own")
    return dealt.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "_node").mapInArrow(_confirmed, "a bigint, b bigint")


def similar_dups(docs: DataFrame, *, shingle: int = 5, bits: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As near_dups(), for texts whose sets of shingles are similar to 0.8 or more: common ones over all of both.

    Every link is an exact count of common shingles (of their XXH64 values). Candidates are fingerprints that differ in
    ``bits`` or fewer, and those that bands of least hashes add, see BANDS. Texts without words, null ones too, have equal sets and are linked. Null ids, repeated rows,
    empty tables and other columns are as in near_dups(). Sets are told apart by 64 bits of XXH64.
    """
    return _classes(*similar_links(docs, shingle=shingle, bits=bits, id_col=id_col, text_col=text_col), id_col)


def similar_links(docs: DataFrame, *, shingle: int = 5, bits: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, str]:
    """As near_links(), of similar_dups()."""
    rows = settle(_sets(docs, shingle, id_col, text_col), "shingles")
    return rows, _alike(rows, shingle, bits), "_node"


def drop_near_dups(docs: DataFrame, find=similar_links, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component stays, that with the least id, null ids last, and of these with the least digest of
    the text; of rows that repeat id and text, one. Ids that several components share are told apart by the text.

    Of all texts without words, null ones too, one row stays. The rows keep all their columns, whatever their names;
    an empty table gives an empty result.
    """
    rows, edges, by = find(docs, id_col=id_col, text_col=text_col, **how)
    rooted = _rooted(rows, edges, by, F.struct(F.col("_id").isNull().alias("last"), "_id", "_key"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("_least"))
    name = max(docs.columns, key=len) + "_"  # no column of docs has it
    keep = least.select(F.col("_least._id").alias(f"{name}id"), F.col("_least._key").alias(f"{name}key"))
    keyed = docs.withColumn(name, F.xxhash64(text_col))
    kept = keyed.join(keep, F.col(id_col).eqNullSafe(F.col(f"{name}id")) & (F.col(name) == F.col(f"{name}key")), "left_semi")
    return kept.dropDuplicates([id_col, name]).drop(name)
