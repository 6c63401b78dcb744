"""Media columns: payloads as lossless 8-bit greyscale PNG members of archives, read through a data source.

The source `member_archive` writes archives of members and reads a directory of them. Reading plans partitions
of byte ranges over the archives (a member belongs to the range in which it starts), streams members in small
Arrow batches, and reads a member again by its offset when a read or its checksum fails, without touching the
others.

An archive is a run of members, each a fixed header (mark, flags, id, unpadded bytes, media bytes, CRC-32 of
header and media) and the media. Beside it lies an index of member offsets. Only archives named by a committed
write's manifest are read, so that files of lost or repeated tasks do no harm.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from groundphrase.llm.common import BATCH_BYTES, BATCH_ROWS, free_name, map_text, new_path, qualified, small_batches, table

#: Samples in a row of an image, and the unit to which payloads are padded.
WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MARK = b"GPM1"
#: Ranges that the driver plans for a directory, about at most.
MOST_RANGES = 50_000
HEADER = struct.Struct("<4sBqqqI")
SCHEMA = "id long, n_bytes long, media binary, archive string, offset long"
ARROW = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("archive", pa.string()), ("offset", pa.int64())])


def pad(raw: bytes) -> bytes:
    """raw with bytes 0 up to a positive multiple of WIDTH."""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """Samples of a padded payload as an 8-bit greyscale PNG, WIDTH wide, rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    body = np.zeros((len(rows), WIDTH + 1), np.uint8)
    body[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(body.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of such a PNG; ValueError if it is not one or is damaged."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, shape = 8, [], None
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body, crc = media[at + 8 : at + 8 + n], media[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(kind + body) != int.from_bytes(crc, "big"):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit greyscale without interlace")
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows")
    return rows[:, 1:].tobytes()


@lru_cache(4)
def _fs(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    scheme, mark, rest = path.partition(":")
    if not mark:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri("s3:" + rest if scheme in ("s3a", "s3n") else path)


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    stop: int

    def __init__(self, archive: str, start: int, stop: int):
        self.archive, self.start, self.stop = archive, start, stop


@dataclass
class Written(WriterCommitMessage):
    archives: list


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes archives of its own under new names; the manifest comes last."""

    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options.get("archivebytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        done, out, name, at, starts = [], None, "", 0, []

        def close() -> None:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.index") as f:
                f.write(np.array(starts, "<i8").tobytes())
            done.append([name, at])

        for b in iterator:
            for i, n, media in zip(*(b.column(k).to_pylist() for k in ("id", "n_bytes", "media")), strict=True):
                if out is None or at >= self.limit:
                    if out is not None:
                        close()
                    name, at, starts = f"{uuid.uuid4().hex}.members", 0, []
                    out = fs.open_output_stream(f"{root}/{name}")
                head = HEADER.pack(MARK, i is None, i or 0, n, len(media), 0)[:-4]
                starts.append(at)
                out.write(head + struct.pack("<I", zlib.crc32(media, zlib.crc32(head))))
                out.write(media)
                at += HEADER.size + len(media)
        if out is not None:
            close()
        return Written(done)

    def commit(self, messages: list) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m for x in m.archives]).encode())

    def abort(self, messages: list) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            for name, _ in m.archives if m else ():
                fs.delete_file(f"{root}/{name}")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class _Window:
    """Reads of a file, `ahead` bytes or more at a time: members that follow each other take one request for many."""

    def __init__(self, f, ahead: int = 4 << 20):
        self.f, self.ahead, self.at, self.held = f, ahead, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.f.seek(at)
            self.at, self.held = at, self.f.read(max(n, self.ahead))
        return self.held[at - self.at : at - self.at + n]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", 16 << 20))
        self.tries, self.wait = int(options.get("tries", 4)), float(options.get("waitseconds", 0.2))

    def partitions(self) -> list[Range]:
        """Ranges of splitbytes, or of more where that would make over MOST_RANGES of them."""
        from pyarrow.fs import FileSelector

        fs, root = _fs(self.path)
        archives = []
        for x in fs.get_file_info(FileSelector(root, allow_not_found=True)):
            if x.base_name.startswith("manifest-"):
                with fs.open_input_stream(x.path) as f:
                    archives += json.loads(f.read())
        split = max(self.split, sum(size for _, size in archives) // MOST_RANGES + 1)
        return [Range(name, s, min(s + split, size)) for name, size in archives for s in range(0, size, split)] or [Range("", 0, 0)]

    @staticmethod
    def _read_one(read: Callable[[int, int], bytes], name: str, start: int) -> tuple:
        """The member at a place, by read(place, bytes)."""
        head = read(start, HEADER.size)
        mark, null, i, n, size, crc = HEADER.unpack(head)
        if mark != MARK or size < 0:
            raise ValueError("damaged member")
        media = read(start + HEADER.size, size)
        if len(media) != size or zlib.crc32(media, zlib.crc32(head[:-4])) != crc:
            raise ValueError("damaged member")
        return None if null else i, n, media, name, start

    def _member(self, name: str, start: int) -> tuple:
        """One member by its offset alone, tried several times."""
        fs, root = _fs(self.path)
        for k in range(self.tries):
            try:
                with fs.open_input_file(f"{root}/{name}") as f:
                    return self._read_one(_Window(f, 0).read, name, start)
            except (OSError, ValueError, struct.error) as e:
                if k + 1 == self.tries:
                    raise OSError(f"{name} at {start}: {e}") from e
                time.sleep(self.wait * 2**k)
        raise OSError(f"{name} at {start}: no try was allowed")

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, root = _fs(self.path)
        with fs.open_input_file(f"{root}/{partition.archive}.index") as f:
            starts = np.frombuffer(f.read(), "<i8")
        starts = starts[np.searchsorted(starts, partition.start) : np.searchsorted(starts, partition.stop)]
        rows, size, f, window = [], 0, None, None
        try:
            for start in starts.tolist():
                # The range is one stream; a member that fails is read again by its offset, and the stream taken up after it.
                try:
                    if window is None:
                        f = fs.open_input_file(f"{root}/{partition.archive}")
                        window = _Window(f)
                    got = self._read_one(window.read, partition.archive, start)
                except (OSError, ValueError, struct.error):
                    window = None
                    got = self._member(partition.archive, start)
                rows.append(got)
                size += len(got[2])
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES // 2:
                    yield _batch(rows)
                    rows, size = [], 0
        finally:
            if f is not None:
                f.close()
        if rows:
            yield _batch(rows)


class ArchiveSource(DataSource):
    """format("member_archive"): options path, archivebytes (writing), splitbytes, tries and waitseconds (reading)."""

    @classmethod
    def name(cls) -> str:
        return "member_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options))


def write_archives(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", **options: str) -> None:
    """Write each text's padded UTF-8 bytes as a member. Null texts count as empty; null ids stay null;
    repeated rows are members of their own; other columns of df are not carried. An empty table gives a
    directory without archives."""
    spark = df.sparkSession
    spark.dataSource.register(ArchiveSource)

    def make():
        return lambda texts: [[len(t or b"") for t in texts], [to_png(pad(t or b"")) for t in texts]]

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    map_text(source, "text", "n_bytes long, media binary", make, ["id"]).write.format("member_archive").options(**options).mode("append").save(qualified(spark, path))


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The members of all archives of a directory: SCHEMA."""
    spark.dataSource.register(ArchiveSource)
    small_batches(spark)
    return spark.read.format("member_archive").options(**options).load(qualified(spark, path))


def features(samples: bytes) -> str:
    """Mean, deviation, entropy in bits, distinct values and most frequent value of the samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, v = len(samples), np.arange(256)
    mean = int(counts @ v) / n
    var = max(0.0, int(counts @ (v * v)) / n - mean * mean)
    p = counts[counts > 0] / n
    return f"mean={mean:.4f};std={var**0.5:.4f};entropy={-(p * np.log2(p)).sum() + 0.0:.4f};distinct={len(p)};mode={counts.argmax()}"


def with_samples(df: DataFrame, media: str = "media", payload: str | None = None, feature: str = "feature") -> DataFrame:
    """Decode a column of PNG media: add sizes, digests, the CRC-32 of the last row, features and, if named,
    the payload itself. Null media counts as damaged and fails."""
    name = free_name(df, "m")

    def make():
        def run(medias: list) -> list:
            got = [from_png(m or b"") for m in medias]
            cols = [[len(p) for p in got], [hashlib.sha256(p).hexdigest() for p in got], [zlib.crc32(p[-WIDTH:]) for p in got], [len(m) for m in medias], [hashlib.sha256(m).hexdigest() for m in medias], [features(p) for p in got]]
            return cols + [got] * bool(payload)

        return run

    fields = f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, `{feature}` string" + (f", `{payload}` binary" if payload else "")
    return map_text(df.withColumn(name, F.col(media)), name, fields, make, [c for c in df.columns if c != media], raw=True)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, through an archive and back. A null text is empty and padded like one; equal texts give equal values, repeated
    rows come back as often as they are there, a null id stays null; an empty table gives an empty result."""
    path = new_path(spark, "media")
    write_archives(table(spark, sf_dir, "documents"), path)
    got = with_samples(read_archives(spark, path))
    return got.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES = {"op9_media": op9_media}
ORACLE_SQL: dict[str, str] = {}
