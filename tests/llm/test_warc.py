import gzip

import pytest
from pyspark.sql import functions as F

from blockstrata.llm import warc


def test_record_round_trip():
    raw = warc.write_record(7, "http://a/ü b", b"x\r\n\r\ny", None, False, warc.digest(b"x\r\n\r\ny"))
    named, n, payload = warc.read_record(raw)
    assert payload == b"x\r\n\r\ny" and n == 6 and warc.page_of(named["WARC-Record-ID"]) == 7 and "\n" not in named["WARC-Target-URI"]
    named, n, payload = warc.read_record(warc.write_record(8, None, b"abc", 7, True, warc.digest(b"abc")))
    assert payload is None and n == 3 and warc.page_of(named["WARC-Refers-To"]) == 7
    with pytest.raises(ValueError, match="differ"):
        warc.read_record(raw.replace(b"\r\n\r\ny", b"\r\n\r\nz"))
    with pytest.raises(ValueError, match="whole"):
        warc.read_record(raw[:-3])


def test_spans(monkeypatch):
    monkeypatch.setattr(warc, "GAP", 10)
    monkeypatch.setattr(warc, "SPAN", 100)
    rows = [("a", 0, 20), ("a", 25, 20), ("a", 60, 10), ("a", 75, 80), ("b", 155, 5)]
    assert list(warc.spans(rows)) == [("a", 0, 45, [0, 1]), ("a", 60, 155, [2, 3]), ("b", 155, 160, [4])]


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = warc.write_archives(pages)
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    some = warc.read_archives(index.where("page_id % 3 = 0")).collect()
    assert {r["page_id"] for r in some} == {i for i in html if i % 3 == 0}
    assert all(r["payload"].decode() == html[r["page_id"]] for r in some if r["record_type"] == "response")
    file = index.first()["file"].removeprefix("file:")
    with gzip.open("/" + file.lstrip("/")) as f:
        assert f.read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


@pytest.mark.parametrize("sent", [500_000, 0])
def test_messy(spark, monkeypatch, sent):
    monkeypatch.setattr(warc, "SENT", sent)
    rows = [(1, "u", "same", "c"), (2, None, "same", "c"), (5, "u5", "same", None), (3, "v", None, "c"), (4, "w", "", "c"), (None, "n", "same", "c"), (None, "n", "alone", "c"), (9, "x\r\nWARC: 1", "long" * 100_000, "c"), (6, "r", "twice", "c"), (6, "r", "twice", "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, sha string")
    pages = pages.withColumns({c: F.lit("clash") for c in ("payload", "best", "best_sha", "copies", "revisit", "file", "offset", "length", "record_type", "refers_to")})
    got = warc.archive_pages(pages).collect()
    kinds = sorted((-1 if r["page_id"] is None else r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["page_id"] != 6)
    assert kinds == [(-1, "response", None, 5), (-1, "revisit", 5, 4), (1, "revisit", 5, 4), (2, "revisit", 5, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 4), (9, "response", None, 400_000)]
    assert [r["record_type"] for r in got if r["page_id"] == 6] == ["response", "response"]
    assert warc.archive_pages(pages.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.archive_pages(pages, min_revisit=1000).collect()} == {"response"}
