import base64
import gzip
import hashlib
import io
from collections import defaultdict

import pytest

from groundphrase.llm import warc
from groundphrase.llm.common import new_path

SCHEMA = "page_id long, url string, html string, digest string, name int"
BIG = "<p>é\r\n\r\nlong 🎉 page</p>" * 30_000
ROWS = [(1, "http://a/", "x", "c", 1), (2, "http://b/ c\r\nWARC-Type: x", "x", None, 2), (3, None, None, "d", 3), (4, "u", "", "e", 4), (5, "u", "\r\n\r\nWARC/1.1\r\n\r\n", "f", 5), (6, "u", BIG, "g", 6), (7, "u", BIG, "h", 7), (8, "u", "y" * 70_000 + "z", "h", 8), (None, "u", "x", None, 9), (None, "u", "only", None, 9), (9, "u", "twice", None, 9), (9, "u", "twice", None, 9), (10, "u", "w" * 200_000, None, 9), (10, "u", "w" * 200_000, None, 9)]


def brute(rows):
    top, out = defaultdict(list), []
    for i, _, t, *_ in rows:
        top[t or ""].append(i)
    for i, _, t, *_ in rows:
        raw = (t or "").encode()
        first = max((x for x in top[t or ""] if x is not None), default=None)
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=str)


def test_round_trip(spark):
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(ROWS, SCHEMA).repartition(3), path)
    read = warc.read_warc(spark, path)
    got = warc.digests(read).collect()
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=str) == brute(ROWS)
    assert {r.payload.decode() for r in read.where("record_type = 'response'").collect()} == {t or "" for _, _, t, *_ in ROWS}


def test_archives_are_well_formed(spark):
    rows = [r.value for r in warc.records(spark.createDataFrame(ROWS, SCHEMA)).collect()]
    records = [x for v in rows for x in warc.parse(io.BytesIO(v.encode() + b"\r\n\r\n"))]
    assert len(records) == len(rows) > len(ROWS)  # long ones have continuations
    segments = [h for h, _ in records if "warc-segment-number" in h]
    assert any("warc-segment-total-length" in h for h in segments) and all(("warc-segment-origin-id" in h) == (h["warc-type"] == "continuation") for h in segments)
    assert all(len(b) == int(h["content-length"]) for h, b in records)


def test_damage_is_found(spark, tmp_path):
    rows = [r.value for r in warc.records(spark.createDataFrame([r for r in ROWS if r[0] == 8], SCHEMA)).collect()]
    assert len(rows) > 1
    for lost in range(len(rows)):
        (tmp_path / f"{lost}").mkdir()
        (tmp_path / f"{lost}" / "a.gz").write_bytes(gzip.compress("".join(v + "\r\n\r\n" for i, v in enumerate(rows) if i != lost).encode()))
        with pytest.raises(Exception, match="segments are missing|bytes, not"):
            warc.read_warc(spark, str(tmp_path / f"{lost}")).collect()
    for bad in (b"5\r\nabc", b"", b"3\r\nabcd\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.dechunk(bad)
    assert warc.dechunk(b"3;x=y\r\nabc\r\nA\r\n0123456789\r\n0\r\nTrailer: t\r\n\r\n") == b"abc0123456789"
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"


def test_archives_roll_by_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 40)
    rows = [(i, "u", f"{i} " + "long page " * 20_000, None, 0) for i in range(30)]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    sizes = [len(gzip.open(f).read()) for f in (tmp_path / "w").glob("*.gz")]
    assert len(sizes) == 3 and max(sizes) <= 40 * (warc.SEGMENT + 1000)  # 4 records a page, whatever it is long
    with open(next((tmp_path / "w").glob("*.gz")), "rb") as f:
        stream = warc.parse(gzip.open(f))
        next(stream)
        assert f.tell() < 70_000  # no more has been read than the first record needs
    assert warc.read_warc(spark, path).count() == 30


def test_empty(spark):
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], SCHEMA), path)
    assert warc.digests(warc.read_warc(spark, path)).count() == 0
