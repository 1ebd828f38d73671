"""python -m blockstrata: flatten, unflatten, commit, backup, checkout, log, repack, chunk and section."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from blockstrata.operators import flatten as fl
from blockstrata.operators.registry import Registry
from blockstrata.operators.sections import section_bytes, split_chunk
from blockstrata.plans import history
from blockstrata.plans.store import Store, backup_folder, checkout_folder, commit_folder, set_aside
from blockstrata.session import session
from blockstrata.sources import nbt
from blockstrata.sources.files import scan


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="blockstrata")
    sub = top.add_subparsers(dest="what", required=True)

    def add(name: str, *args: str, registry: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        if registry:
            p.add_argument("--registry", required=True, help="JSON of the game version's blocks and biomes")
        return p

    add("flatten", "save", "out", registry=True)
    add("unflatten", "flat", "out", registry=True)
    p = add("commit", "save", "store", registry=True)
    p.add_argument("-b", "--branch", default="main")
    p.add_argument("-m", "--message", required=True)
    p.add_argument("--init", action="store_true")
    p.add_argument("--author", default="nobody <nobody@localhost>")
    p = add("backup", "save", "store", registry=True)
    p.add_argument("-b", "--branch", default="main")
    p.add_argument("-m", "--message", required=True)
    p.add_argument("--pack", help="compacted store that gets what it lacks")
    add("checkout", "store", "commit", "save", registry=True)
    add("log", "store").add_argument("-n", type=int, default=50)
    add("repack", "store", "out")
    for name in ("chunk", "section"):
        p = add(name, "region", "x", "z", registry=name == "section")
        if name == "section":
            p.add_argument("y")
            p.add_argument("--biome", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    a = _arguments().parse_args(argv)
    spark = session()
    registry = Registry.from_json(open(a.registry, encoding="utf-8").read()) if getattr(a, "registry", None) else None
    if a.what == "flatten":
        print(fl.flatten_folder(spark, a.save, a.out, registry), "objects")
    elif a.what == "unflatten":
        print(fl.unflatten_folder(spark, a.flat, a.out, registry), "files")
    elif a.what == "commit":
        store = Store(spark, a.store)
        before = _mib(store) if store.exists() else 0.0
        print(commit_folder(store, a.save, registry, a.message, branch=a.branch, init=a.init, author=a.author))
        after = _mib(store)
        print(f"{before:.2f} MiB, {after:.2f} MiB" + (f" ({(after - before) / before:+.2%})" if before else ""))
    elif a.what == "backup":
        print(backup_folder(Store(spark, a.store), a.save, registry, a.message, a.pack, branch=a.branch))
    elif a.what == "checkout":
        set_aside(spark, a.save)
        print(checkout_folder(Store(spark, a.store), a.commit, a.save, registry), "files")
    elif a.what == "log":
        for r in history.log(Store(spark, a.store).table("commits"), a.n).toLocalIterator():
            print(r["short_id"], r["date"], r["author"], r["message"], sep="\t")
    elif a.what == "repack":
        Store(spark, a.store).compact(a.out)
    else:
        folder, _, name = a.region.rpartition("/")
        files = scan(spark, folder or ".").where(F.col("key") == name).withColumn("key", F.concat(F.lit("x/poi/"), "key"))
        found = fl.chunks(files).where(f"chunk_x = {int(a.x)} and chunk_z = {int(a.z)}").first()
        if found is None:
            raise SystemExit(f"no chunk {a.x},{a.z}")
        raw = bytes(found["nbt"])
        if a.what == "section":
            _, sections = split_chunk(nbt.load(raw)[1], registry)
            raw = next((section_bytes(s, "biome" if a.biome else "block") for s in sections if s.y == int(a.y)), None)
            if raw is None:
                raise SystemExit(f"no section {a.y}")
        sys.stdout.buffer.write(raw)
    return 0


def _mib(store: Store) -> float:
    return (store.table("blobs").agg(F.sum("size")).first()[0] or 0) / history.MIB


if __name__ == "__main__":
    sys.exit(main())
