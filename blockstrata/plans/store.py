"""A snapshot store: tables of blobs, tree entries, commits and refs in one folder.

Objects are addressed by their git ids. Rows are only ever appended; a ref's last row is its value, and its
earlier rows are its log. One writer at a time is assumed; a commit checks the ref it builds on.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from blockstrata.functions.hashing import EMPTY_TREE, blob_oid, commit_oid, root_trees
from blockstrata.functions.paths import layout, matches, safe_key

#: Pieces of 4 KB, for 32,768 rows each, that are broadcast at most to tell which contents are new.
SENT = 16_384
TABLES = {
    "blobs": "oid string, size bigint, content binary",
    "tree_entries": "commit_id string, path string, oid string",
    "commits": "commit_id string, tree_oid string, parents array<string>, message string, author string, ts timestamp",
    "refs": "ref string, commit_id string, updated_at timestamp, seq bigint",
}


def last_write(entries: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key."""
    newest = Window.partitionBy(key).orderBy(order.desc())
    return entries.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._path("refs"))
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def init(self) -> Store:
        for table, schema in TABLES.items():
            self._row(schema).limit(0).write.mode("ignore").parquet(self._path(table))
        return self

    def _row(self, schema: str, *values) -> DataFrame:
        """One row of literals, or of nulls. A frame made of Python's rows would start a worker a core of a kind that nothing
        else here uses, and these would stay beside those of the codecs."""
        fields = StructType.fromDDL(schema).fields
        lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
        return self.spark.range(0, 1, 1, 1).select(*[lit(v).cast(f.dataType).alias(f.name) for f, v in zip(fields, values or [None] * len(fields), strict=True)])

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(self._path(name))

    # -- refs ----------------------------------------------------------------------------------------------------

    def refs(self) -> DataFrame:
        return last_write(self.table("refs"), "ref", F.col("seq"))

    def resolve(self, name: str, at: datetime | None = None) -> str | None:
        """Commit of a branch (as of a time), or of an id or its beginning; '' is the empty snapshot."""
        if name == "":
            return ""
        log = self.table("refs").where(F.col("ref") == name)
        if at is not None:
            log = log.where(F.col("updated_at") <= F.lit(at))
        row = log.orderBy(F.col("seq").desc()).select("commit_id").first()
        if row is None and at is None and len(name) >= 4:
            rows = self.table("commits").where(F.startswith(F.col("commit_id"), F.lit(name))).select("commit_id").limit(2).collect()
            row = rows[0] if len(rows) == 1 else None
        return row[0] if row else None

    def parents(self, branch: str, init: bool | None) -> list[str]:
        """The branch must exist, or else be begun by ``init``, not both; None begins it where it isn't there."""
        tip = self.resolve(branch) if self.exists() else None
        if tip and init:
            raise ValueError(f"branch {branch} exists already")
        if not tip and init is False:
            raise ValueError(f"no branch {branch}; begin it with init")
        return [tip] if tip else []

    # -- writing -------------------------------------------------------------------------------------------------

    def commit(self, entries: DataFrame, message: str, *, branch: str | None = "main", author: str = "nobody <nobody@localhost>",
               ts: datetime | None = None, init: bool | None = False, seq: str | None = None, inherit: str | None = None) -> str:
        """A snapshot of ``entries`` (key, content) alone, or, with ``inherit``, beside that commit's other files, whose
        contents aren't read.

        Of rows with one key the one with the largest ``seq`` counts. Content that is stored already is not
        written again. Returns the commit's id; without a branch nothing refers to it.
        """
        if not message.strip():
            raise ValueError("a commit needs a message")
        parents = self.parents(branch, init) if branch else []
        self.init()
        ts = (ts or datetime.now(UTC)).replace(microsecond=0)
        staged = entries.select(safe_key(F.col("key")).alias("path"), "content", *([F.col(seq).alias("_seq")] if seq else []))
        staged = last_write(staged, "path", F.col("_seq")) if seq else staged
        # Contents may come from decoding whole saves: they are made once, and what follows reads them from here.
        stage = self._path(f"_staged-{uuid.uuid4().hex}")
        staged.select("path", blob_oid(F.col("content")).alias("oid"), "content", F.monotonically_increasing_id().alias("row")).write.option("compression", "zstd").parquet(stage)
        try:
            hashed = self.spark.read.schema("path string, oid string, content binary, row bigint").parquet(stage)
            tree = hashed.select("path", "oid").distinct()
            if inherit:
                tree = tree.unionByName(self.listing(inherit).join(tree.select("path"), "path", "left_anti"))
            return self._commit(hashed, tree, message, branch, author, ts, parents)
        finally:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(stage)
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def _commit(self, hashed: DataFrame, listed: DataFrame, message: str, branch: str | None, author: str, ts: datetime, parents: list[str]) -> str:
        # Which contents are new is told by ids alone, and sent to the contents, which stay where they are, as one bit a
        # row. Beyond some 500 million rows both are shuffled.
        new = hashed.groupBy("oid").agg(F.min("row").alias("row")).join(self.table("blobs").select("oid"), "oid", "left_anti")
        piece, place = F.bitmap_bucket_number("row").alias("piece"), F.bitmap_bit_position("row").alias("place")
        if hashed.select(piece).distinct().count() <= SENT:
            bits = new.select(piece, place).groupBy("piece").agg(F.bitmap_construct_agg("place").alias("bits"))
            octet = F.conv(F.hex(F.substring("bits", (F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            fresh = hashed.select("*", piece, place).join(F.broadcast(bits), "piece").where(F.call_function("getbit", octet, (F.col("place") % 8).cast("int")) == 1)
        else:
            fresh = hashed.join(new, ["oid", "row"], "left_semi")
        fresh.select("oid", F.octet_length("content").cast("long").alias("size"), "content").write.mode("append").option("compression", "zstd").parquet(self._path("blobs"))
        tree = root_trees(listed.select(F.lit(0).alias("one"), "path", "oid"), ["one"]).first()
        tree_oid = tree["tree_oid"] if tree else EMPTY_TREE
        row = self._row("tree_oid string, parents array<string>, message string, author string, ts timestamp", tree_oid, parents, message, author, ts)
        row = row.withColumn("commit_id", commit_oid(F.col("tree_oid"), F.col("parents"), F.col("author"), F.unix_timestamp("ts"), F.col("message")))
        commit_id = row.first()["commit_id"]
        listed.select(F.lit(commit_id).alias("commit_id"), "path", "oid").sortWithinPartitions("path").write.mode("append").parquet(self._path("tree_entries"))
        row.select(*self.table("commits").columns).write.mode("append").parquet(self._path("commits"))
        if branch:
            if (self.resolve(branch) or None) != (parents[0] if parents else None):
                raise RuntimeError(f"branch {branch} has moved meanwhile")
            self._set_ref(branch, commit_id, ts)
        return commit_id

    def _set_ref(self, branch: str, commit_id: str, ts: datetime) -> None:
        seq = (self.table("refs").agg(F.max("seq")).first()[0] or 0) + 1
        self._row(TABLES["refs"], branch, commit_id, ts, seq).write.mode("append").parquet(self._path("refs"))

    # -- reading -------------------------------------------------------------------------------------------------

    def listing(self, commit: str, pattern: str | None = None) -> DataFrame:
        """path and oid of a snapshot."""
        commit_id = self.resolve(commit)
        if commit_id is None:
            raise ValueError(f"no commit {commit}")
        out = self.table("tree_entries").where(F.col("commit_id") == commit_id).select("path", "oid").distinct()
        return out.where(matches(F.col("path"), pattern)) if pattern else out

    def entries(self, commit: str, pattern: str | None = None) -> DataFrame:
        """key and content. The listing is filtered before it meets the blobs; a missing blob is an error."""
        met = self.listing(commit, pattern).join(self.table("blobs").withColumn("_there", F.lit(True)), "oid", "left")
        lost = F.raise_error(F.concat(F.lit("no blob "), F.col("oid"))).cast("binary")
        return met.select(F.col("path").alias("key"), F.when(F.col("_there"), F.col("content")).otherwise(lost).alias("content"))

    # -- compaction ----------------------------------------------------------------------------------------------

    def compact(self, out: str, files: int = 8) -> Store:
        """The store's reachable content in few files elsewhere, blobs in an order in which similar ones are neighbours.

        Where ``out`` is such a store already, only what it lacks is read and added, in files of its own; the others
        stay as they are. Commits come after their contents, so a repeat after a failure adds what is still missing.
        """
        target = Store(self.spark, out).init()
        lacking = lambda table, *by: self.table(table).join(target.table(table).select(*by), list(by), "left_anti").select(*self.table(table).columns)
        commits = lacking("commits", "commit_id")
        listed = self.table("tree_entries").join(commits.select("commit_id"), "commit_id", "left_semi")
        place = self.table("tree_entries").groupBy("oid").agg(F.min("path").alias("_p"))
        blobs = lacking("blobs", "oid").dropDuplicates(["oid"]).join(place, "oid").withColumn("_p", layout(F.col("_p")))
        blobs = blobs.repartitionByRange(files, "_p").sortWithinPartitions("_p").select("oid", "size", "content")
        tables = {"blobs": blobs, "tree_entries": listed.select("commit_id", "path", "oid").coalesce(files), "commits": commits.coalesce(1), "refs": lacking("refs", "ref", "commit_id", "seq").coalesce(1)}
        for name, rows in tables.items():
            rows.write.mode("append").option("compression", "zstd").parquet(target._path(name))
        return target

    def pull(self, other: Store) -> None:
        """What another store has and this one lacks; a branch takes the other's value."""
        self.init()
        other.table("blobs").join(self.table("blobs").select("oid"), "oid", "left_anti").write.mode("append").parquet(self._path("blobs"))
        fresh = other.table("commits").join(self.table("commits").select("commit_id"), "commit_id", "left_anti")
        other.table("tree_entries").join(fresh.select("commit_id"), "commit_id", "left_semi").select("commit_id", "path", "oid").write.mode("append").parquet(self._path("tree_entries"))
        fresh.select(*self.table("commits").columns).write.mode("append").parquet(self._path("commits"))
        for r in other.refs().toLocalIterator():
            if self.resolve(r["ref"]) != r["commit_id"]:
                self._set_ref(r["ref"], r["commit_id"], r["updated_at"])


def commit_folder(store: Store, save: str, registry, message: str, **how) -> str:
    from blockstrata.operators.flatten import flatten
    from blockstrata.sources.files import scan

    return store.commit(flatten(scan(store.spark, save), registry), message, **how)


def backup_folder(store: Store, save: str, registry, message: str, packed: str | None = None, **how) -> str:
    """A commit that begins its branch where it isn't there; then the compacted store ``packed`` gets what it lacks."""
    commit_id = commit_folder(store, save, registry, message, **{"init": None, **how})
    if packed:
        store.compact(packed)
    return commit_id


def checkout_folder(store: Store, commit: str, save: str, registry) -> int:
    """Restore a snapshot to a folder that isn't there yet; number of files."""
    from blockstrata.operators.flatten import unflatten
    from blockstrata.sources.files import put

    at = store.spark._jvm.org.apache.hadoop.fs.Path(save)
    if at.getFileSystem(store.spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        raise FileExistsError(save)
    return put(unflatten(store.entries(commit), registry), save)


def bak_of(path: str) -> str:
    """Where a save is set aside: its last suffix, if it has one, becomes .bak."""
    folder, slash, name = path.rstrip("/").rpartition("/")
    stem, dot, _ = name.rpartition(".")
    return f"{folder}{slash}{stem if dot and stem else name}.bak"


def set_aside(spark: SparkSession, path: str) -> bool:
    """Rename a folder that is there to its .bak; an earlier one is never overwritten. Whether there was any."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at, to = jvm.Path(path), jvm.Path(bak_of(path))
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(at):
        return False
    if fs.exists(to):
        raise FileExistsError(bak_of(path))
    return bool(fs.rename(at, to))


def git_dir_of(save_dir: Column) -> Column:
    """Where a save's backups are: ../../backups/{name}.git."""
    clean = F.regexp_replace(save_dir, "[/\\\\]+$", "")
    return F.regexp_replace(clean, r"^(.*)[/\\][^/\\]+[/\\]([^/\\]+)$", "$1/backups/$2.git")
