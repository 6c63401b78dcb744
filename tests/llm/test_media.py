import hashlib
import zlib
from pathlib import Path

import pytest

from groundphrase.llm import media
from groundphrase.llm.common import new_path

SCHEMA = "doc_id long, text string, media string, n_bytes int"
TEXTS = ["", None, "a", "a" * 64, "é🎉" * 50, "b" * 65, "long text " * 100_000]


def frame(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", None, None), (2, "a", "again", 5)], SCHEMA)


def test_round_trip(spark):
    path = new_path(spark, "media")
    media.write_archives(frame(spark), path, archivebytes="300")
    got = media.with_samples(media.read_archives(spark, path, splitbytes="150"), payload="payload").collect()
    assert len(got) == len(TEXTS) + 2
    by = {}
    for r in got:
        raw = (TEXTS[r.id] if r.id is not None else "null id") or ""
        raw = raw.encode()
        pay = raw + bytes(64 if not raw else -len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, bytes(r.payload)) == (len(raw), len(pay), pay)
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert by.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert len({x.archive for x in got}) > 1


def test_damage_and_uncommitted_files(spark):
    path = new_path(spark, "media")
    media.write_archives(frame(spark).where("doc_id < 5"), path)
    root = Path(path.removeprefix("file:"))
    (root / "lost.members").write_bytes(b"left by a lost task")
    assert media.read_archives(spark, path).count() == 6
    for f in root.glob("*.members"):
        raw = bytearray(f.read_bytes())
        raw[-1] ^= 1
        f.write_bytes(raw)
    with pytest.raises(Exception, match="damaged member"):
        media.read_archives(spark, path, tries="2", waitseconds="0.01").collect()


def test_a_failing_read_is_tried_again_alone(monkeypatch, tmp_path):
    w = media.ArchiveWriter({"path": str(tmp_path)})
    import pyarrow as pa

    rows = [(i, 1, media.to_png(media.pad(b"x" * i))) for i in range(5)]
    w.commit([w.write(iter([pa.table(dict(zip(("id", "n_bytes", "media"), map(list, zip(*rows))))).to_batches()[0]]))])
    reader = media.ArchiveReader({"path": str(tmp_path), "waitseconds": "0"})
    opened, real = [], media._fs(str(tmp_path))
    third = media.HEADER.size * 3 + sum(len(m) for *_, m in rows[:2]) + 20  # inside the third member's media

    class Damaged:
        def __init__(self, f):
            self.f = f

        def __getattr__(self, name):
            return getattr(self.f, name)

        def read(self, n):
            raw = bytearray(self.f.read(n))
            raw[third] ^= 1
            return bytes(raw)

    class Flaky:
        def __getattr__(self, name):
            return getattr(real[0], name)

        def open_input_file(self, path):
            f = real[0].open_input_file(path)
            if path.endswith(".members"):
                opened.append(path)
                if len(opened) == 1:
                    return Damaged(f)
                if len(opened) == 2:
                    raise OSError("lost connection")
            return f

    monkeypatch.setattr(media, "_fs", lambda path: (Flaky(), real[1]))
    got = [x for p in reader.partitions() for b in reader.read(p) for x in zip(b.column("id").to_pylist(), b.column("media").to_pylist())]
    assert got == [(i, m) for i, _, m in rows]
    assert len(opened) == 4  # the stream, two tries for the one member, and the stream taken up after it


def test_empty(spark):
    path = new_path(spark, "media")
    media.write_archives(frame(spark).limit(0), path)
    assert media.with_samples(media.read_archives(spark, path)).count() == 0


@pytest.mark.parametrize("bad", [b"", b"GIF", media.to_png(media.pad(b"x"))[:-20], media.to_png(media.pad(b"x")).replace(b"IDAT", b"IDAX")])
def test_bad_png(bad):
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bad)
