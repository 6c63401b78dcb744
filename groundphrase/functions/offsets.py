"""Normalization that remembers where everything stood: for each normalized character its span in the raw text.

Spark has no running state over a text's characters, so one Arrow pass makes the map; what is done with it afterwards
are column expressions. Runs of plain letters and digits, nearly all of most texts, map one to one and are
handled as wholes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundphrase.functions import text as tx

_FOLD = str.maketrans(tx.RETRIEVAL_FROM, tx.RETRIEVAL_TO, tx.TATWEEL)
#: What separates words: white space, the joiner, and spaces that count as blanks.
_BLANK = re.compile(r"[\s‌​]+")
_RUN = re.compile(r"[^\s‌​]+")
TOKEN = "struct<text:string,normalized:string,raw_start:int,raw_end:int,start:int,end:int>"
FIELDS = f"normalized string, starts array<int>, ends array<int>, tokens array<{TOKEN}>"


def _mapped_run(run: str, at: int) -> tuple[str, list[int], list[int]]:
    """The normalized characters of a run without blanks, and their spans; a letter and its marks are one span."""
    out, starts, ends, i = [], [], [], 0
    while i < len(run):
        end = i + 1
        while end < len(run) and unicodedata.combining(run[end]):
            end += 1
        for c in unicodedata.normalize("NFC", run[i:end]).translate(_FOLD):
            if c.isalnum() and not unicodedata.combining(c):
                for x in c.lower():
                    if x.isalnum():
                        out.append(x)
                        starts.append(at + i)
                        ends.append(at + end)
        i = end
    return "".join(out), starts, ends


#: Letters and digits; below MARKS there are no combining marks, no letters that fold and, but for one, none that gets longer.
_PIECE = re.compile(r"[^\W_]+")
MARKS, LONGER = "\u0300", "İ"


@dataclass
class Mapped:
    """A normalized text, its characters' raw spans, and its tokens: texts and (raw start, raw end, start, end) as columns."""

    text: str
    starts: np.ndarray
    ends: np.ndarray
    words: list[str]
    places: np.ndarray


def _plain(raw: str) -> Mapped:
    """The map of a text without marks: runs of letters and digits are taken as wholes."""
    low, words, parts, at, size, new, last = raw.lower(), [], [], [], [], [], -1
    for m in _PIECE.finditer(raw):
        a, b = m.span()
        gap = raw[last:a] if last >= 0 else " "
        fresh = gap == " " or last < 0 or _BLANK.search(gap) is not None
        if fresh:
            if parts:
                words.append("".join(parts) if len(parts) > 1 else parts[0])
            parts = []
        parts.append(low[a:b])
        at.append(a)
        size.append(b - a)
        new.append(fresh)
        last = b
    if not parts:
        none = np.zeros(0, np.int32)
        return Mapped("", none, none, [], np.zeros((4, 0), np.int32))
    words.append("".join(parts) if len(parts) > 1 else parts[0])
    at, size, new = np.array(at, np.int64), np.array(size, np.int64), np.array(new)
    begin = np.cumsum(size + new) - size - 1  # normalized places of the pieces: one blank before each new token but the first
    n = int(begin[-1] + size[-1])
    starts = np.empty(n, np.int32)
    inside = np.ones(n, bool)
    first = np.flatnonzero(new)
    blanks = begin[first[1:]] - 1
    inside[blanks] = False
    starts[inside] = np.repeat(at - begin, size) + np.flatnonzero(inside)
    ends = starts + 1
    after = at + size
    starts[blanks], ends[blanks] = after[first[1:] - 1], at[first[1:]]
    final = np.r_[first[1:] - 1, len(at) - 1]
    return Mapped(" ".join(words), starts, ends.astype(np.int32), words, np.stack([at[first], after[final], begin[first], (begin + size)[final]]).astype(np.int32))


def mapped(raw: str) -> Mapped:
    """The map of a raw text. The span of a blank between two words is that of all that stands between them; ends
    are exclusive."""
    if not raw or max(raw) < MARKS and LONGER not in raw:
        return _plain(raw)
    parts, starts, ends, places = [], [], [], []
    for m in _RUN.finditer(raw):
        text, a, b = _mapped_run(m[0], m.start())
        if not text:
            continue
        if parts:
            starts.append(ends[-1])
            ends.append(a[0])
        places.append((a[0], b[-1], len(starts), len(starts) + len(text)))
        parts.append(text)
        starts += a
        ends += b
    return Mapped(" ".join(parts), np.array(starts, np.int32), np.array(ends, np.int32), parts, np.array(places, np.int32).reshape(-1, 4).T)


def _lists(parts: list[np.ndarray], values: pa.Array) -> pa.ListArray:
    """A list column of so many values in each row."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), values)


def intake(df: DataFrame, text: str = "text") -> DataFrame:
    """Add FIELDS, display and compact to df: all that matching needs of a raw text, which stays as it is.

    normalized is that of the text composed (NFC). Null texts count as empty: no characters, no tokens. Columns
    of these names give way; rows are kept as they are, repeated ones too.
    """
    out = T.StructType.fromDDL(FIELDS)
    new = {f.name for f in out} | {"display", "compact"}
    keep = [c for c in df.columns if c.lower() not in new or c == text]
    names = [f"c{i}" for i in range(len(keep))]
    source = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    schema = T.StructType([*(T.StructField(n, df.schema[c].dataType) for c, n in zip(keep, names, strict=True)), *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):  # maps are larger than texts: a few at a time
                part = b.slice(at, 256)
                raws = part.column(part.num_columns - 1).to_pylist()
                got = [mapped(r) for r in raws]
                joined = [np.concatenate(x) for x in ([g.starts for g in got], [g.ends for g in got])]
                places = np.concatenate([g.places for g in got], axis=1)
                texts = [r[x:y] for r, g in zip(raws, got, strict=True) for x, y in zip(g.places[0].tolist(), g.places[1].tolist(), strict=True)]
                fields = [pa.array(texts, pa.string()), pa.array([w for g in got for w in g.words], pa.string()), *(pa.array(p, pa.int32()) for p in places)]
                tokens = _lists([g.words for g in got], pa.StructArray.from_arrays(fields, names=["text", "normalized", "raw_start", "raw_end", "start", "end"]))
                spans = [_lists([g.starts for g in got], pa.array(x, pa.int32())) for x in joined]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([g.text for g in got], pa.string()), *spans, tokens], names=[*names, *out.names])

    got = source.mapInArrow(run, schema).select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), *out.names)
    return got.withColumn("display", tx.display(tx.composed(F.coalesce(F.col(f"`{text}`"), F.lit(""))))).withColumn("compact", tx.compact(F.col("normalized")))


def raw_span(starts: Column, ends: Column, start: Column, end: Column) -> Column:
    """The raw span of normalized places [start, end); of an empty interval, the place where it stands."""
    n = F.size(starts)
    here = F.when(n == 0, 0).when(start >= n, F.get(ends, n - 1)).otherwise(F.get(starts, start.cast("int")))
    return F.when(start == end, F.struct(here.alias("start"), here.alias("end"))).otherwise(F.struct(F.get(starts, start.cast("int")).alias("start"), F.get(ends, end.cast("int") - 1).alias("end")))
