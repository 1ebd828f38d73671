"""Snapshots from and to git repositories.

Reading, the driver lists a commit (without contents) and tasks fetch blobs through one ``git cat-file --batch``
each. Writing, tasks store loose objects themselves; git reads them at once and packs them when it likes.
"""

from __future__ import annotations

import subprocess
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockstrata.functions.hashing import commit_body, trees_by_level
from blockstrata.plans.store import Store
from blockstrata.sources.batches import parts
from blockstrata.sources.files import SCHEMA, put


def git(git_dir: str, *args: str, **how) -> bytes:
    """Output of git; a failure is an error with what git says."""
    done = subprocess.run(["git", f"--git-dir={git_dir}", *args], capture_output=True, check=False, **how)
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def exists(git_dir: str) -> bool:
    try:
        return bool(git(git_dir, "rev-parse", "--git-dir"))
    except RuntimeError:
        return False


def init(git_dir: str) -> None:
    """An empty bare repository that keeps logs of its refs and isn't packed behind one's back."""
    subprocess.run(["git", "init", "-q", "--bare", git_dir], check=True, capture_output=True)
    git(git_dir, "config", "core.logAllRefUpdates", "true")
    git(git_dir, "config", "gc.auto", "0")


def listing(spark: SparkSession, git_dir: str, commit: str, tasks: int = 8) -> DataFrame:
    """path and oid; names are taken as they are, unquoted. Directories alone come to the driver; tasks list the files
    of each. ``git_dir`` is a folder that all executors see."""
    dirs = []
    for line in git(git_dir, "ls-tree", "-r", "-d", "-z", commit).split(b"\0"):
        head, _, path = line.partition(b"\t")
        if path and head.split()[1] == b"tree":
            dirs.append((f"{path.decode()}/", head.split()[2].decode()))
    dirs.append(("", git(git_dir, "rev-parse", "--verify", f"{commit}^{{tree}}").decode().strip()))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, oid in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _files(git_dir, folder, oid)

    return spark.createDataFrame(dirs, "path string, oid string").repartition(tasks).mapInArrow(files, "path string, oid string")


def _files(git_dir: str, folder: str, oid: str) -> Iterator[pa.RecordBatch]:
    """Files of one tree, without those of its subtrees; git's output is read as it comes."""
    with subprocess.Popen(["git", f"--git-dir={git_dir}", "ls-tree", "-z", oid], stdout=subprocess.PIPE, stderr=subprocess.PIPE) as p:
        left = b""
        while chunk := p.stdout.read(1 << 20):
            *lines, left = (left + chunk).split(b"\0")
            found = [(head.split(), name) for head, _, name in (line.partition(b"\t") for line in lines)]
            found = [(folder + name.decode(), head[2].decode()) for head, name in found if head[1] == b"blob"]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], ["path", "oid"])
        said = p.stderr.read()
    if p.returncode:
        raise RuntimeError(f"git ls-tree: {said.decode(errors='replace').strip()}")


def entries(spark: SparkSession, git_dir: str, commit: str, tasks: int = 8) -> DataFrame:
    """key and content of a commit. ``git_dir`` is a folder that all executors see."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with subprocess.Popen(["git", f"--git-dir={git_dir}", "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
            for batch in batches:
                keys, found = batch.column(0).to_pylist(), []
                for oid in batch.column(1).to_pylist():
                    p.stdin.write(oid.encode() + b"\n")
                    p.stdin.flush()
                    head = p.stdout.readline().split()
                    if len(head) != 3:
                        raise RuntimeError(f"no blob {oid}")
                    found.append(p.stdout.read(int(head[2])))
                    p.stdout.read(1)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found, pa.binary())], ["key", "content"])
            p.stdin.close()

    return listing(spark, git_dir, commit).repartition(tasks).mapInArrow(fetch, SCHEMA)


def _lacking(store: Store, commit_id: str, git_dir: str) -> list[str]:
    """Commits from ``commit_id`` back that a repository lacks. Ids of commits, one per snapshot, come to the driver."""
    parents = {r["commit_id"]: r["parents"] for r in store.table("commits").select("commit_id", "parents").toLocalIterator()}
    there, out, ahead = set(git(git_dir, "rev-list", "--all").decode().split()), [], [commit_id]
    while ahead:
        at = ahead.pop()
        if at not in there:
            there.add(at)
            out.append(at)
            ahead += parents[at]
    return out


def export(store: Store, branch: str, git_dir: str, *, history: bool = False) -> str:
    """A branch's last commit as loose objects of a repository, and the branch set to it; earlier commits must be
    there already, or come along with ``history``: all that the repository lacks, at once. Returns the commit's id."""
    spark = store.spark
    commit_id = store.resolve(branch)
    if not commit_id:
        raise ValueError(f"no branch {branch}")
    if not exists(git_dir):
        init(git_dir)
    row = store.table("commits").where(F.col("commit_id") == commit_id)
    if history:
        wanted = F.broadcast(spark.createDataFrame([(c,) for c in _lacking(store, commit_id, git_dir)], "commit_id string"))
        row = store.table("commits").join(wanted, "commit_id", "left_semi")
        tree = store.table("tree_entries").join(wanted, "commit_id", "left_semi").distinct()
    else:
        for parent in row.first()["parents"]:
            git(git_dir, "cat-file", "-e", f"{parent}^{{commit}}")
        tree = store.listing(commit_id).withColumn("commit_id", F.lit(commit_id))
    blobs = store.table("blobs").join(tree.select("oid").distinct(), "oid", "left_semi").select(F.lit("blob").alias("kind"), "oid", F.col("content").alias("body"))
    levels = [t.select(F.lit("tree").alias("kind"), "oid", "body") for t in trees_by_level(tree.select("commit_id", "path", "oid"), ["commit_id"])]
    body = commit_body(F.col("tree_oid"), F.col("parents"), F.col("author"), F.unix_timestamp("ts"), F.col("message"))
    commits = row.select(F.lit("commit").alias("kind"), F.col("commit_id").alias("oid"), body.alias("body"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            keys = [f"objects/{o[:2]}/{o[2:]}" for o in b.column(1).to_pylist()]
            made = [zlib.compress(f"{k} {len(c)}\0".encode() + c) for k, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(made, pa.binary())], ["key", "content"])

    objects = reduce(DataFrame.unionByName, [*levels, commits], blobs)
    put(objects.dropDuplicates(["oid"]).mapInArrow(pack, SCHEMA), git_dir)
    git(git_dir, "update-ref", f"refs/heads/{branch}", commit_id)
    return commit_id
