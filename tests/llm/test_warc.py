import base64
import hashlib
import os
import random

import pytest
import zstandard

from weftgraph.errors import StorageError
from weftgraph.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, first long, sha string"


@pytest.fixture
def round_trip(spark, tmp_path):
    def run(rows, schema=SCHEMA, **options):
        df = spark.createDataFrame([(*r, "p", 1, "s") for r in rows], schema)
        warc.write(df, str(tmp_path / "archives"), **options)
        return warc.read(spark, str(tmp_path / "archives"), df.schema["page_id"].dataType.simpleString()).collect()

    run.path = tmp_path / "archives"
    return run


def plain(rows, min_bytes=0):
    held = {}
    for i, _, html in rows:
        held.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in rows:
        raw, ids = (html or "").encode(), [k for k in held[html or ""] if k is not None]
        first = min(ids) if ids and len(raw) >= min_bytes else None
        again = first is not None and i != first
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(map(str, out))


def fields(found):
    return sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in found)


ROWS = [
    (1, "http://a.net/x", "<p>same</p>"), (2, "http://b.net/", "<p>same</p>"), (3, None, None), (4, "no url\r\nX: 1 é%20", ""), (5, "", "ü\x00\r\n\r\n\U0001f600"),
    (None, "http://c.net", "<p>same</p>"), (None, "http://d.net", "only without id"), (None, "http://d.net", "only without id"), (5, "http://e.net", "ü\x00\r\n\r\n\U0001f600"),
    (7, "http://f.net", "x" * 50), (6, "http://f.net", "x" * 50),
]


@pytest.mark.parametrize("min_bytes", [0, 12, 1000])
def test_odd_rows(round_trip, min_bytes):
    found = round_trip(ROWS, min_bytes=min_bytes)
    assert fields(found) == plain(ROWS, min_bytes)
    whole = {r["page_id"]: r for r in found if r["record_type"] == "response" and r["page_id"] is not None}
    texts = {i: (html or "").encode() for i, _, html in ROWS}
    assert all(bytes(r["payload"]) == texts[i] for i, r in whole.items())
    for r in found:
        if r["record_type"] == "revisit":
            assert r["payload"] is None and r["refers_to_record"] == whole[r["refers_to"]]["record_id"]
    assert {r["url"] for r in found if r["page_id"] == 4} == {"no%20url%0D%0AX:%201%20%C3%A9%20"}


def test_many_pages_and_a_frequent_payload(round_trip, monkeypatch):
    monkeypatch.setattr(warc, "HOT_MOST", 1)
    rng = random.Random(5)
    page = lambda: "<html><body>" + " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(60)) + "</body></html>"
    rows = [(i, f"http://h.net/{i}", page()) for i in range(900)] + [(2000 + i, "http://f.net", "frequent") for i in range(1500)] + [(5000 - i, "http://g.net", "also") for i in range(40)]
    found = round_trip(rows, archive_bytes=100_000)
    assert fields(found) == plain(rows)
    files = [f for f in os.listdir(round_trip.path) if f.startswith("part-")]
    assert len(files) >= 10
    sizes = raw = 0
    for f in files:
        content = (round_trip.path / f).read_bytes()
        records = list(warc.records_of(content))
        raw, sizes = raw + sum(map(len, records)), sizes + len(content)
        if content[:4] == warc.DICTIONARY_FRAME:
            n = int.from_bytes(content[4:8], "little")
            assert content[8:12] == warc.DICTIONARY
            held = zstandard.ZstdCompressionDict(content[8 : 8 + n])
            with zstandard.ZstdDecompressor(dict_data=held).stream_reader(content[8 + n :], read_across_frames=True) as stream:  # as any reader does
                assert stream.read(1 << 30) == b"".join(records)
    assert any((round_trip.path / f).read_bytes()[:4] == warc.DICTIONARY_FRAME for f in files) and sizes < raw / 2


def test_a_dictionary_makes_small_records_smaller():
    rng = random.Random(1)
    records = [f"GET /{rng.random()} HTTP/1.1\r\nHost: example.com\r\nAccept: text/html; charset=utf-8\r\nUser-Agent: none {i}\r\n\r\n".encode() for i in range(3000)]
    packed = warc.archive(records)
    assert list(warc.records_of(packed + warc.SEPARATOR)) == records
    assert len(packed) < 0.7 * sum(len(zstandard.compress(r)) for r in records)


def test_long_and_incompressible_records(round_trip):
    rng = random.Random(2)
    rows = [(1, "u", "y" * 6_000_000), (2, "u", "".join(chr(rng.randrange(32, 50_000)) for _ in range(400_000))), (3, "u", warc.SEPARATOR.decode() * 9), (4, "u", "z")]
    assert fields(round_trip(rows, archive_bytes=1000)) == plain(rows)


def test_text_ids(round_trip):
    rows = [("b é\r\n", "u", "same"), ("a", "u", "same"), ("", "u", "other")]
    assert fields(round_trip(rows, SCHEMA.replace("page_id long", "page_id string"))) == plain(rows)


def test_empty_table(round_trip):
    assert round_trip([]) == []


def test_damage_is_an_error():
    packed = warc.archive([warc.record("1", "u", b"payload", None, "1970-01-01T00:00:00Z")])
    with pytest.raises((StorageError, zstandard.ZstdError)):
        list(warc.records_of(packed + b"\n"))
    (raw,) = warc.records_of(packed)
    with pytest.raises(StorageError):
        warc.parsed(raw.replace(b"payload\r", b"paylaod\r"))
