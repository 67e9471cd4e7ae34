"""WARC archives: read back against a plain version, the bytes of the format, and the cases the docstrings name."""
import hashlib
import io
import random
import struct

import pytest
import zstandard

from sheetmetric.llm import warc as W

SCHEMA = "page_id long, url string, html string, payload string, digest int, key string, first long"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)


def some_pages(n=300, seed=1):
    rng = random.Random(seed)
    hot = "<html><body>" + "same é page " * 60 + "</body></html>"
    rows = []
    for k in range(n):
        text = "".join(rng.choices("abc é\n", k=rng.choice([0, 3, 40, 99, 100, 101, 400])))
        rows.append((k * 7 % n, f"http://example.org/{k}", rng.choice([hot, hot, text, f"<html><p class='x'>{text}</p><footer>all the same footer</footer></html>", None, "a" * 99, "b" * 100])))
    rng.shuffle(rows)
    return rows


def plain(rows):
    first = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            first[data] = min(first.get(data, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        again = data in first and first[data] != page_id
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
    return out


def key(row):
    return repr(tuple(row))


def test_equals_plain(spark):
    rows = some_pages()
    rows += [(None, None, rows[0][2]), (None, None, "only null ids here " * 9), (None, "u", "only null ids here " * 9), (5_000, "v\r\nX-Page-ID: 1", "z" * 100), (5_000, "v", "z" * 100), (5_001, "v", "z" * 100), (9_000, "l", "long é " * 300_000)]
    for parts in (1, 7):
        got = W.round_trip(frame_of(spark, rows).repartition(parts)).collect()
        assert sorted(map(key, got)) == sorted(map(key, plain(rows)))


def test_payloads_urls_and_several_archives(spark):
    rows = some_pages(200, 2)
    written = W.archive(frame_of(spark, rows).repartition(2), archive_bytes=2_000)
    assert written.count() > 4
    assert sum(r["n_records"] for r in written.collect()) == len(rows)
    read = {r["page_id"]: r for r in W.read(written, payloads=True).collect()}
    for page_id, url, html in rows:
        assert read[page_id]["url"] == url
        assert read[page_id]["record_type"] == "revisit" or read[page_id]["payload"].decode() == (html or "")


def test_format(spark):
    rows = [(k, f"http://e.org/{k}", f"<html><head><title>Page {k}</title></head><body>{'<p>words of page</p>' * 20}{k * 7919}</body></html>") for k in range(400)]
    row = W.archive(frame_of(spark, rows).coalesce(1)).first()
    data = open(row["path"].removeprefix("file:"), "rb").read()
    assert len(data) == row["bytes"]
    magic, size = struct.unpack("<II", data[:8])
    assert magic == W.SKIPPABLE
    dictionary = zstandard.ZstdDecompressor().decompress(data[8:8 + size])
    assert dictionary[:4] == b"\x37\xa4\x30\xec" and len(dictionary) <= W.DICTIONARY_BYTES
    found = list(W.records(io.BytesIO(data)))
    assert len(found) == 400 and all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") for x in found)
    alone = zstandard.ZstdCompressor(level=W.LEVEL)
    assert len(data) - 8 - size < 0.5 * sum(len(alone.compress(x)) for x in found)
    fields, block = W.parse(found[0])
    assert {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} <= set(fields)
    assert len(block) == int(fields["content-length"])


def test_every_block_size(monkeypatch):
    found = [W.record(k, "http://e.org/a b\r\nX: é", b"payload" * k, 7 * k, "d", None, False) for k in range(30)]
    data = b"".join(map(zstandard.ZstdCompressor().compress, found))
    for block in (1, 7, 64, 1 << 16):
        monkeypatch.setattr(W, "BLOCK", block)
        assert list(W.records(io.BytesIO(data))) == found
    with pytest.raises(ValueError):
        list(W.records(io.BytesIO(data[:-3])))
    assert W.parse(found[1])[0]["warc-target-uri"] == "http://e.org/a%20b%0D%0AX:%20%C3%A9"
    with pytest.raises(ValueError):
        W.parse(found[1][:-1])


def test_commonest_payload_is_looked_up(spark):
    rows = [(k, "u", "hot " * 50) for k in range(3_000)] + [(k, "u", f"{k} " * 60) for k in range(3_000, 4_000)] + [(k, "u", f"pair {k // 2} " * 20) for k in range(5_000, 5_200)]
    got = W.plan(frame_of(spark, rows).repartition(3))
    kinds = {(r["record_type"], r["refers_to"] == 0): r["count"] for r in got.groupBy("record_type", "refers_to").count().collect() if r["refers_to"] == 0 or r["refers_to"] is None}
    assert kinds[("revisit", True)] == 2_999
    assert got.where("record_type = 'revisit'").count() == 2_999 + 100


def test_empty_table(spark):
    none = frame_of(spark, [(1, "u", "x")]).where("page_id > 1")
    assert W.round_trip(none).count() == 0 and W.archive(none).count() == 0
