"""Synthetic saves: formats, canonical form, and the law flatten(unflatten(flatten(s))) == flatten(s)."""

import gzip
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockstrata.operators import flatten as fl
from blockstrata.operators import sections as sec
from blockstrata.operators.registry import Registry
from blockstrata.sources import files, nbt, region

REGISTRY = """{"version": "t1", "blocks": [
 {"name": "air", "default_state": 0, "min_state_id": 0, "states": []},
 {"name": "lamp", "default_state": 2, "min_state_id": 1, "states": [{"name": "lit", "type": "bool", "num_values": 2}]},
 {"name": "stairs", "default_state": 5, "min_state_id": 3, "states": [{"name": "facing", "type": "enum", "values": ["n", "s", "e"]}, {"name": "half", "type": "enum", "values": ["top", "low"]}]},
 {"name": "wool", "default_state": 9, "min_state_id": 9, "states": [{"name": "hue", "type": "int", "values": %s}]}],
 "biomes": [{"id": 0, "name": "plains"}, {"id": 1, "name": "river"}, {"id": 7, "name": "taiga"}]}""" % str([str(i) for i in range(400)]).replace("'", '"')


@pytest.fixture(scope="module")
def registry():
    return Registry.from_json(REGISTRY)


def test_state_ids(registry):
    assert [registry.state_id("minecraft:lamp", {"lit": v}) for v in ("true", "false")] == [1, 2]
    assert registry.state_id("minecraft:stairs", {"facing": "s", "half": "low", "other": "x"}) == 3 + 1 * 2 + 1
    assert registry.state_id("stairs", {}) == 5
    assert registry.state(6) == ("stairs", [("half", "low"), ("facing", "s")])
    for i in range(409):
        name, props = registry.state(i)
        assert registry.state_id(name, dict(props)) == i
    with pytest.raises(ValueError, match="facing"):
        registry.state_id("stairs", {"half": "top"})
    with pytest.raises(KeyError):
        registry.state_id("other:stairs", {})
    with pytest.raises(KeyError):
        registry.biome_id("sea")
    with pytest.raises(ValueError, match="16 bits"):
        Registry.from_json('{"version": "x", "blocks": [], "biomes": [{"id": 300, "name": "far"}]}')


def test_dims(spark, registry):
    assert registry.block_states(spark).where("name = 'wool'").count() == 400
    assert registry.biome_dim(spark).count() == 3


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 400])
def test_block_containers(registry, n):
    cells = 9 + np.arange(4096)[::-1] % n
    made = sec.write_blocks(cells, registry)
    rows = nbt.get(made, "data", nbt.LONGS)
    assert len(rows) // 8 == -(-4096 // (64 // max(4, (n - 1).bit_length())))
    assert sec.read_blocks(made, registry).tolist() == cells.tolist()


def test_biome_containers(registry):
    for n in (1, 2, 3):
        cells = np.array([0, 1, 7])[np.arange(64) % n]
        made = sec.write_biomes(cells, registry)
        assert (nbt.get(made, "data", nbt.LONGS) is None) == (n == 1)
        assert sec.read_biomes(made, registry).tolist() == cells.tolist()
    one = [(b"data", (nbt.LONGS, bytes(8))), (b"palette", (nbt.LIST, (nbt.STRING, [b"minecraft:taiga"])))]
    assert sec.read_biomes(one, registry).tolist() == [7] * 64


keys = st.binary(max_size=4)
leaf = st.one_of(
    st.integers(-128, 127).map(lambda v: (nbt.BYTE, v)), st.integers(-(2**63), 2**63 - 1).map(lambda v: (nbt.LONG, v)), st.binary(max_size=9).map(lambda v: (nbt.STRING, v)),
    st.binary(max_size=9).map(lambda v: (nbt.BYTES, v)), st.lists(st.integers(-9, 9)).map(lambda v: (nbt.LIST, (nbt.SHORT, v))), st.floats(allow_nan=False).map(lambda v: (nbt.DOUBLE, v)),
)
compound = st.deferred(lambda: st.dictionaries(keys, tag, max_size=4).map(lambda d: list(d.items())))
tag = st.one_of(leaf, compound.map(lambda c: (nbt.COMPOUND, c)), st.lists(compound, max_size=3).map(lambda c: (nbt.LIST, (nbt.COMPOUND, c))))


@given(compound)
@settings(max_examples=80, deadline=None)
def test_tag_trees(items):
    raw = nbt.dump(b"root", items)
    assert nbt.load(raw) == (b"root", items)
    once = nbt.canonical(items)
    assert nbt.canonical(once) == once and len(nbt.dump(b"root", once)) == len(raw)
    assert [k for k, _ in once] == sorted(k for k, _ in items)


def test_tag_tree_errors():
    for bad in (b"", b"\x01\0\0", nbt.dump(b"", [(b"a", (nbt.LONG, 1))])[:-4]):
        with pytest.raises(ValueError):
            nbt.load(bad)


@given(st.text(max_size=20))
def test_modified_utf8(s):
    s = s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    assert nbt.text(nbt.mutf8(s)) == s


def _chunk(status="minecraft:full", cells=True, light=True, seed=0):
    rng = np.random.default_rng(seed)
    container = lambda made: (nbt.COMPOUND, made)
    registry = Registry.from_json(REGISTRY)
    empty = [(b"Y", (nbt.BYTE, -5)), (b"SkyLight", (nbt.BYTES, b"\1" * 8))]
    full = [
        [(b"block_states", container(sec.write_blocks(rng.integers(0, n, 4096), registry))), (b"Y", (nbt.BYTE, y)), (b"biomes", container(sec.write_biomes(np.array([0, 1, 7])[rng.integers(0, 3, 64) % n], registry)))]
        for y, n in ((-4, 1), (-3, 9), (-2, 400))
    ]
    items = [(b"z", (nbt.INT, seed)), (b"sections", (nbt.LIST, (nbt.COMPOUND, [empty, *full, empty] if cells else full)))]
    items += [(b"Status", (nbt.STRING, status.encode()))] if status else []
    items += [(b"isLightOn", (nbt.BYTE, 1))] if light else []
    return nbt.dump(b"", items)


def _save():
    stamps = bytes(range(256)) * 16
    chunks = [(-32, 0, _chunk(seed=1)), (-31, 0, _chunk("minecraft:noise")), (-1, 31, _chunk(seed=2, light=False, cells=False))]
    poi = [(0, 0, nbt.dump(b"", [(b"b", (nbt.INT, 1)), (b"a", (nbt.COMPOUND, [(b"d", (nbt.BYTE, 1)), (b"c", (nbt.BYTE, 2))]))]))]
    dat = nbt.dump(b"", [(b"y", (nbt.INT, 1)), (b"x", (nbt.INT, 2))])
    return {
        "w/region/r.-1.0.mca": region.write_region(-1, 0, stamps, chunks),
        "w/entities/r.0.0.mca": region.write_region(0, 0, stamps, poi),
        "w/poi/r.0.0.mca": b"",
        "w/level.dat": gzip.compress(dat), "w/raw.dat": dat, "w/icon.png": b"png", "w/a b/ü.json": b"{}", "w/session.lock": b"x",
    }


def _frame(spark, save):
    return spark.createDataFrame(list(save.items()), files.SCHEMA)


def test_flatten_and_back(spark, registry):
    save = _frame(spark, _save())
    flat = {r["key"]: bytes(r["content"]) for r in fl.flatten(save, registry).collect()}
    base = "w/region/r.-1.0.mca"
    assert set(flat) == {
        f"{base}/timestamp-header", f"{base}/other/c.-32.0.nbt", f"{base}/sections/c.-32.0.dump", f"{base}/other/c.-1.31.nbt", f"{base}/sections/c.-1.31.dump",
        "w/entities/r.0.0.mca/timestamp-header", "w/entities/r.0.0.mca/c.0.0.nbt", "w/level.dat", "w/raw.dat", "w/icon.png", "w/a b/ü.json",
    }
    assert flat["w/level.dat"] == flat["w/raw.dat"] == nbt.dump(b"", [(b"x", (nbt.INT, 2)), (b"y", (nbt.INT, 1))])
    rest = nbt.load(flat[f"{base}/other/c.-32.0.nbt"])[1]
    assert nbt.get(rest, "isLightOn", nbt.BYTE) == 0 and nbt.get(rest, "sections", nbt.LIST) is None
    assert [s.y for s in sec.load_sections(flat[f"{base}/sections/c.-32.0.dump"])] == [-4, -3, -2]
    again = fl.unflatten(_frame(spark, flat), registry)
    assert {r["key"]: bytes(r["content"]) for r in fl.flatten(again, registry).collect()} == flat
    assert [r[0] for r in fl.unrouted(save).collect()] == ["w/session.lock"]
    assert fl.flatten(save, registry, keep_partial=True).count() == len(flat) + 2


def test_unflatten_needs_sections(spark, registry):
    flat = fl.flatten(_frame(spark, _save()), registry)
    with pytest.raises(Exception, match="has no sections"):
        fl.unflatten(flat.where("not key like '%.dump'"), registry).collect()


def test_chunk_errors(registry):
    no_status = region.write_region(0, 0, bytes(4096), [(0, 0, _chunk(None))])
    with pytest.raises(ValueError, match="no Status"):
        list(fl._flat_region("w/region/r.0.0.mca", no_status, registry, False))
    middle = nbt.dump(b"", [(b"sections", (nbt.LIST, (nbt.COMPOUND, [[(b"Y", (nbt.BYTE, i))] for i in range(3)])))])
    with pytest.raises(ValueError, match="has no cells"):
        sec.split_chunk(nbt.load(middle)[1], registry)
    with pytest.raises(ValueError, match="no region coordinates"):
        fl._coordinates("w/region/rx.mca")


def test_region_edges():
    assert region.read_region(b"x", 0, 0) is None
    with pytest.raises(ValueError, match="8192"):
        region.read_region(bytes(4096), 0, 0)
    assert region.read_region(region.write_region(0, 0, bytes(4096), []), 0, 0) is None
    made = bytearray(region.write_region(-2, -3, bytes(4096), [(-64, -96, b"one"), (-33, -65, b"two"), (-63, -96, b"three")]))
    assert region.read_region(bytes(made), -2, -3).chunks == [(-64, -96, b"one"), (-63, -96, b"three"), (-33, -65, b"two")]
    made[2 * 4096 + 6] ^= 0xFF
    got = region.read_region(bytes(made), -2, -3)
    assert [c[2] for c in got.chunks] == [b"three", b"two"] and got.errors[0][:2] == (-64, -96)
    for kind, body in ((1, gzip.compress(b"q")), (3, b"q")):
        at = 3 * 4096
        made[at : at + 5 + len(body)] = (len(body) + 1).to_bytes(4) + bytes([kind]) + body
        assert b"q" in [c[2] for c in region.read_region(bytes(made), -2, -3).chunks]
    made[3 * 4096 + 4] = 9
    with pytest.raises(ValueError, match="unknown compression"):
        region.read_region(bytes(made), -2, -3)
    cut = region.write_region(0, 0, bytes(4096), [(0, 0, np.random.default_rng(0).bytes(9000))])
    with pytest.raises(ValueError, match="stated length"):
        region.read_region(cut[: 2 * 4096 + 3000], 0, 0)
    with pytest.raises(ValueError, match="outside"):
        region.write_region(0, 0, bytes(4096), [(32, 0, b"")])
    with pytest.raises(ValueError, match="sectors"):
        region.write_region(0, 0, bytes(4096), [(0, 0, np.random.default_rng(0).bytes(1 << 20))])
    assert region.SECTOR == 4096 and zlib.decompress(zlib.compress(b"a")) == b"a"


def test_gunzip():
    assert fl.gunzip(b"plain") == b"plain"
    with pytest.raises(ValueError, match="ends early"):
        fl.gunzip(gzip.compress(b"x" * 999)[:-9])


def test_chunks_sections_and_source(spark, registry, tmp_path):
    save = _frame(spark, _save())
    rows = fl.chunks(save)
    assert {(r["chunk_x"], r["chunk_z"]) for r in rows.collect()} == {(-32, 0), (-31, 0), (-1, 31), (0, 0)}
    cells = fl.sections(rows.where("region_key like '%/region/%' and chunk_x = -32"), registry).where("y = -3").first()
    assert len(cells["block_state"]) == 4096 and len(cells["biome"]) == 64
    section = sec.Section(0, np.array(cells["biome"]), np.array(cells["block_state"]))
    assert np.frombuffer(sec.section_bytes(section, "block"), "<u2").tolist() == cells["block_state"]
    assert len(sec.section_bytes(section, "biome")) == 64
    damaged = bytearray(_save()["w/region/r.-1.0.mca"])
    damaged[2 * 4096 + 6] ^= 0xFF
    assert fl.damaged_chunks(_frame(spark, {"w/region/r.-1.0.mca": bytes(damaged)})).select("chunk_x", "chunk_z").collect() == [(-32, 0)]
    assert files.put(save.where("key <> 'w/poi/r.0.0.mca'"), str(tmp_path / "World [1]")) == 7
    from blockstrata.sources.region_source import register

    register(spark)
    source = spark.read.format("region").load(str(tmp_path / "World [1]"))
    assert source.count() == 4 and source.where("chunk_x = -1 and chunk_z = 31").count() == 1


def test_files(spark, tmp_path):
    root = str(tmp_path / "s")
    files.put(_frame(spark, {"a/x.txt": b"1", "a/y.txt": b"2", "b/z.bin": b"3", "foo/bar.bin": b"hello"}), root)
    assert [r[0] for r in files.glob(spark, root, "a/*.txt").collect()] == ["a/x.txt", "a/y.txt"]
    got = files.lookup(files.scan(spark, root), ["foo/bar.bin", "a/x.txt", "foo/bar.bin"]).collect()
    assert [(r["key"], bytes(r["content"])) for r in got] == [("foo/bar.bin", b"hello"), ("a/x.txt", b"1"), ("foo/bar.bin", b"hello")]
    with pytest.raises(Exception, match="no such key"):
        files.lookup(files.scan(spark, root), ["nope"]).collect()
    with pytest.raises(Exception, match="unsafe key"):
        files.put(_frame(spark, {"../x": b""}), root)


def test_lists_of_numbers_as_arrays():
    """Cells travel as arrays, not number by number; both forms are the same bytes."""
    items = [(b"a", (nbt.LIST, (nbt.SHORT, [1, -2, 300]))), (b"b", (nbt.LIST, (nbt.COMPOUND, [[(b"c", (nbt.LIST, (nbt.DOUBLE, [0.5])))]])))]
    raw = nbt.dump(b"", items)
    read = nbt.load(raw, arrays=True)[1]
    assert isinstance(nbt.get(read, "a", nbt.LIST)[1], np.ndarray) and nbt.get(read, "a", nbt.LIST)[1].tolist() == [1, -2, 300]
    assert nbt.dump(b"", read) == raw and nbt.load(raw)[1] == items
    with pytest.raises(ValueError):
        nbt.load(raw[:13], arrays=True)


def test_cells_in_tasks_for_all_cores(spark, sf_dir):
    """A small file of many rows is not one task's work."""
    from blockstrata.save_queries import QUERIES

    for name in ("section_dump", "section_codec"):
        assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_batches_in_parts(monkeypatch):
    """A batch of large rows is never taken at once, and no row is lost."""
    from blockstrata.sources import batches

    monkeypatch.setattr(batches, "PART", 1000)
    rows = [bytes([i]) * n for i, n in enumerate([10] * 50 + [400] * 20 + [5000, 0, 0])]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["content"])
    got = list(batches.parts(iter([batch, batch.slice(0, 0)])))
    assert [c for b in got for c in b.column(0).to_pylist()] == rows
    assert max(b.num_rows for b in got) <= 10 and list(batches.parts(iter([]))) == []


def test_flatten_yields_parts(spark, registry, monkeypatch):
    """A region's objects, and many small files, leave in batches of bounded size."""
    from blockstrata.operators import flatten as fl

    monkeypatch.setattr(fl, "PART", 1000)
    got = list(fl._in_parts((str(i), bytes(300)) for i in range(10)))
    assert [b.num_rows for b in got] == [4, 4, 2] and [k for b in got for k in b.column(0).to_pylist()] == list(map(str, range(10)))
