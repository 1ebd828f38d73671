from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from blockstrata.operators.registry import Registry
from blockstrata.plans import history
from blockstrata.plans.store import Store, bak_of, checkout_folder, commit_folder, git_dir_of, set_aside
from blockstrata.sources import files, profiles


def _e(spark, d):
    return spark.createDataFrame(list(d.items()), files.SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.mark.parametrize("sent", [200_000, 0])
def test_commits(spark, store, tmp_path, monkeypatch, sent):
    monkeypatch.setattr("blockstrata.plans.store.SENT", sent)
    assert not store.exists()
    with pytest.raises(ValueError, match="begin it with init"):
        store.commit(_e(spark, {"a": b""}), "x")
    t = lambda h: datetime(2024, 1, 1, h, tzinfo=UTC)
    one = store.commit(_e(spark, {"src/hello.txt": b"hello", "a.txt": b"v1", "copy": b"v1"}), "initial", init=True, ts=t(1))
    assert len(one) == 40 and bytes(store.entries("main", "src/*").first()["content"]) == b"hello"
    assert store.table("blobs").count() == 2
    with pytest.raises(ValueError, match="exists already"):
        store.commit(_e(spark, {"a": b""}), "x", init=True)
    with pytest.raises(ValueError, match="message"):
        store.commit(_e(spark, {"a": b""}), " ")
    two = store.commit(_e(spark, {"b.txt": b"v2", "copy": b"v1"}), "second", ts=t(2))
    assert [r["path"] for r in store.listing("main").orderBy("path").collect()] == ["b.txt", "copy"]
    assert store.table("commits").where(F.col("commit_id") == two).first()["parents"] == [one]
    assert store.table("blobs").count() == 3
    assert store.resolve("main", t(1)) == one and store.resolve(two[:8]) == two and store.resolve("nope") is None
    changes = {r["path"]: r["change"] for r in history.diff(store.listing(one), store.listing("main")).collect()}
    assert changes == {"a.txt": "D", "src/hello.txt": "D", "b.txt": "A", "copy": "="}
    assert [r["message"] for r in history.log(store.table("commits")).collect()] == ["second", "initial"]
    three = store.commit(_e(spark, {"c.txt": b"v3", "copy": b"v4"}), "third", branch=None, inherit="main", ts=t(3))
    assert {r["key"]: bytes(r["content"]) for r in store.entries(three).collect()} == {"b.txt": b"v2", "c.txt": b"v3", "copy": b"v4"}
    assert store.table("blobs").count() == 5
    dangling = store.commit(_e(spark, {}), "empty", branch=None, ts=t(3))
    assert store.table("commits").where(F.col("commit_id") == dangling).first()["tree_oid"] == "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
    small = store.compact(str(tmp_path / "small"), 2)
    assert {(r["key"], bytes(r["content"])) for r in small.entries("main").collect()} == {("b.txt", b"v2"), ("copy", b"v1")}
    four = store.commit(_e(spark, {"d.txt": b"v5", "copy": b"v1"}), "fourth", ts=t(4))
    parts = {p for p in (tmp_path / "small").rglob("*.parquet")}
    small = store.compact(str(tmp_path / "small"), 2)
    assert parts < {p for p in (tmp_path / "small").rglob("*.parquet")} and small.resolve("main") == four
    assert {(r["key"], bytes(r["content"])) for r in small.entries("main").collect()} == {("d.txt", b"v5"), ("copy", b"v1")}
    assert small.listing(one).count() == 3 and small.table("blobs").count() == 6 and small.table("refs").count() == 3
    other = Store(spark, str(tmp_path / "other"))
    other.pull(store)
    other.pull(store)
    assert other.resolve("main") == four and other.table("blobs").count() == 6 and other.listing("main").count() == 2


def test_last_write_wins(spark, store):
    twice = spark.createDataFrame([("k", b"same")] * 2, "key string, content binary")
    store.commit(twice, "m", branch="twice", init=True)
    assert store.entries("twice").count() == store.table("blobs").count() == 1
    rows = spark.createDataFrame([("k", b"old", 1), ("k", b"new", 2)], "key string, content binary, seq int")
    store.commit(rows, "m", init=True, seq="seq")
    assert bytes(store.entries("main").first()["content"]) == b"new"


def test_folders(spark, store, tmp_path):
    registry = Registry("none", [], {})
    files.put(_e(spark, {"w/a.json": b"{}", "w/x.txt": b"dropped"}), str(tmp_path / "save"))
    commit_folder(store, str(tmp_path / "save"), registry, "one", init=True)
    assert checkout_folder(store, "main", str(tmp_path / "back"), registry) == 1
    assert (tmp_path / "back/w/a.json").read_bytes() == b"{}"
    with pytest.raises(FileExistsError):
        checkout_folder(store, "main", str(tmp_path / "back"), registry)


def test_streaming(spark, store, tmp_path):
    from blockstrata.streaming.snapshotter import snapshots

    folder = tmp_path / "in"
    for n, name in enumerate(("a.json", "b.json")):
        files.put(_e(spark, {f"w/{name}": str(n).encode()}), str(folder))
        q = snapshots(store, str(folder), Registry("none", [], {}), str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
    assert store.table("commits").count() == 2 and store.listing("main").count() == 2


def test_profiles(spark, tmp_path):
    path = str(tmp_path / "p.json")
    assert profiles.read(spark, path).count() == 0
    rows = [(d, v, "main", "", "") for d, v in (("/b", "1"), ("", "1"), ("   ", "1"), ("/a", "2"), ("/b", "3"))]
    profiles.write(spark.createDataFrame(rows, profiles.SCHEMA), path)
    assert [(r["save_dir"], r["mc_version"]) for r in profiles.read(spark, path).collect()] == [("/a", "2"), ("/b", "1")]
    more = profiles.upsert(profiles.read(spark, path), {"save_dir": "/b", "mc_version": "9", "branch": "x", "remote_url": ""})
    assert [(r["save_dir"], r["mc_version"]) for r in more.collect()] == [("/a", "2"), ("/b", "9")]
    assert profiles.delete(more, "/a").count() == 1 and profiles.delete(more, "/zz").count() == 2


def test_small_answers(spark):
    df = spark.createDataFrame([("/home/x/saves/World", 0.0, 5.0)], "s string, a double, b double")
    row = df.select(git_dir_of(F.col("s")).alias("g"), history.growth(F.col("a"), F.col("b")).alias("p")).first()
    assert row["g"] == "/home/x/backups/World.git" and row["p"] is None


def test_set_aside(spark, tmp_path):
    assert [bak_of(p) for p in ("/s/World", "/s/A.b", "/s/.x/", "w")] == ["/s/World.bak", "/s/A.bak", "/s/.x.bak", "w.bak"]
    assert not set_aside(spark, str(tmp_path / "w"))
    (tmp_path / "w").mkdir()
    assert set_aside(spark, str(tmp_path / "w")) and (tmp_path / "w.bak").is_dir()
    (tmp_path / "w").mkdir()
    with pytest.raises(FileExistsError):
        set_aside(spark, str(tmp_path / "w"))


def test_git(spark, store, tmp_path):
    from blockstrata.sources import git_objects

    bare = str(tmp_path / "r.git")
    assert not git_objects.exists(bare)
    t = datetime(2024, 1, 1, tzinfo=UTC)
    first = {"foo/x": b"1", "foo.a": b"2", "deep/er/é": b"3" * 1000}
    one = store.commit(_e(spark, first), "one", init=True, ts=t)
    assert git_objects.export(store, "main", bare) == one
    two = store.commit(_e(spark, {"b/z.md": b"4"}), "two", ts=t)
    git_objects.export(store, "main", bare)
    git_objects.git(bare, "fsck", "--strict")
    assert git_objects.git(bare, "rev-list", "main").decode().split() == [two, one]
    assert {r["key"]: bytes(r["content"]) for r in git_objects.entries(spark, bare, one).collect()} == first
    assert [r["path"] for r in git_objects.listing(spark, bare, "main").collect()] == ["b/z.md"]
    three = store.commit(_e(spark, {"b/z.md": b"5"}), "three", ts=t)
    again = str(tmp_path / "again.git")
    for repository in (again, bare, bare):
        assert git_objects.export(store, "main", repository, history=True) == three
        git_objects.git(repository, "fsck", "--strict")
        assert git_objects.git(repository, "rev-list", "main").decode().split() == [three, two, one]
    assert {r["key"]: bytes(r["content"]) for r in git_objects.entries(spark, again, one).collect()} == first
    with pytest.raises(RuntimeError, match="ls-tree"):
        git_objects.listing(spark, bare, "nope")


def test_command_line(spark, tmp_path, capsysbinary):
    from blockstrata.__main__ import main
    from tests.test_codecs import REGISTRY, _save

    (tmp_path / "reg.json").write_text(REGISTRY)
    save, reg, at = str(tmp_path / "save"), ["--registry", str(tmp_path / "reg.json")], str(tmp_path / "store2")
    files.put(_e(spark, {k: v for k, v in _save().items() if v}), save)
    main(["commit", save, at, "-m", "first", "--init", *reg])
    main(["checkout", at, "main", save, *reg])
    assert (tmp_path / "save.bak").is_dir() and (tmp_path / "save/w/region/r.-1.0.mca").is_file()
    main(["log", at])
    main(["backup", save, at, "-m", "second", "--pack", str(tmp_path / "packed"), *reg])
    main(["backup", save, str(tmp_path / "new"), "-m", "begun", *reg])
    assert Store(spark, str(tmp_path / "packed")).listing("main").count() == Store(spark, str(tmp_path / "new")).listing("main").count() == 11
    main(["flatten", save, str(tmp_path / "flat"), *reg])
    main(["unflatten", str(tmp_path / "flat"), str(tmp_path / "again"), *reg])
    main(["repack", at, str(tmp_path / "small")])
    said = capsysbinary.readouterr().out
    assert b"first" in said and b"11 objects" in said
    main(["section", f"{save}/w/region/r.-1.0.mca", "-32", "0", "-3", *reg])
    assert len(capsysbinary.readouterr().out) == 8192
    main(["chunk", f"{save}/w/region/r.-1.0.mca", "-32", "0"])
    assert capsysbinary.readouterr().out.startswith(b"\n\0\0")
