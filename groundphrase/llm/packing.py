"""Best-fit packing with several permitted sequence lengths.

Documents are cut into pieces no longer than the largest length; pieces go, longest first, into the open bin
that they fill best. Where none fits, a bin of the least-cost length is opened: for each length that holds the
piece, the histogram of the sizes that are still to come tells how full such a bin can get (the largest that fit,
one after the other), and the length whose cost for each token is least wins. A sequence costs its length, a fixed
overhead and attention, which grows with the square; so long bins pay only where short ones would stay emptier.
At the end each bin shrinks to the smallest length that holds its contents. Packing runs in shards of bounded
size, dealt by a hash of the piece and, for repeated rows, of their number, so that no key can be hot, no task
sees much more than a shard whatever the data, and the result does not depend on how the table is laid out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundphrase.llm.common import map_text, stored, table

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: What a bin costs besides its length, in tokens (masks, rows), and the length at which attention costs as
#: much as everything else (six times the width of a model that is 4,096 wide).
OVERHEAD, ATTENTION = 16, 24_576
#: Pieces in a shard, about.
SHARD = 20_000
#: Characters that are encoded at once when tokens are counted.
STRIDE = 1 << 20


def bin_cost(length: int, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    """The cost of a sequence of that length, in tokens."""
    return overhead + length + length * length / attention


class _Left:
    """The sizes still to come: how much of a room their largest ones can fill."""

    def __init__(self, sizes: Sequence[int]):
        n = Counter(sizes)
        self.values = sorted(n)
        self.counts = [n[v] for v in self.values]
        self.at = {v: i for i, v in enumerate(self.values)}
        self.below = [*range(-1, len(self.values))]  # i + 1: the next place at or under i that has any, plus 1

    def take(self, size: int) -> None:
        i = self.at[size]
        self.counts[i] -= 1
        if not self.counts[i]:
            self.below[i + 1] = i - 1

    def _find(self, i: int) -> int:
        path = []
        while i >= 0 and self.below[i + 1] != i:
            path.append(i)
            i = self.below[i + 1]
        for j in path:
            self.below[j + 1] = i
        return i

    def fill(self, room: int) -> int:
        total, i = 0, bisect_right(self.values, room) - 1
        while (i := self._find(i)) >= 0:
            v = self.values[i]
            k = min(self.counts[i], room // v)
            total, room = total + k * v, room - k * v
            i = min(i - 1, bisect_right(self.values, room) - 1)
        return total


def opened(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, overhead: float = OVERHEAD, attention: float = ATTENTION) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """(bin, place in it) of each piece, and of each bin the length it was opened with and what it holds."""
    lengths = sorted(set(lengths))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left, small = _Left(sizes), sizes[order[-1]] if order else 0
    price = {c: bin_cost(c, overhead, attention) for c in lengths}
    free: list[tuple[int, int]] = []  # (room, bin), sorted
    caps: list[int] = []
    fill: list[int] = []
    count: list[int] = []
    place = [(0, 0)] * len(sizes)
    for i in order:
        size = sizes[i]
        left.take(size)
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room = min((c for c in lengths if c >= size), key=lambda c: (price[c] / (size + left.fill(c - size)), c))
            b = len(caps)
            caps.append(room)
            fill.append(0)
            count.append(0)
        place[i] = (b, count[b])
        count[b] += 1
        fill[b] += size
        if room - size >= small:
            insort(free, (room - size, b))
    return place, caps, fill


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, overhead: float = OVERHEAD, attention: float = ATTENTION) -> list[tuple[int, int, int]]:
    """(bin, its length, place in it) of each piece; sizes are 1 to max(lengths), others raise ValueError. Bins are
    numbered from 0 as they are opened; pieces of one size go in their given order. No sizes give no bins."""
    place, _, fill = opened(sizes, lengths, overhead, attention)
    final = [next(c for c in sorted(lengths) if c >= n) for n in fill]
    return [(b, final[b], k) for b, k in place]


class _Counts(dict):
    """Token counts of what stands between single spaces; NaN for what has white space, or the mark that means a space
    to the model, at an end."""

    #: Entries that are kept, and the longest text among them.
    MEMORY, LONGEST = 500_000, 64

    def __init__(self, encode: Callable[[str], list]):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> float:
        n = float("nan") if not part or part.strip() != part or "▁" in (part[0], part[-1]) else len(self.encode(part))
        if len(part) < self.LONGEST:
            if len(self) >= self.MEMORY:
                self.clear()
            self[part] = n
        return n


@lru_cache(2)
def counter(model: str) -> Callable[[str], int]:
    """The number of tokens of a text, an end id included, by the sentencepiece library. No piece of a vocabulary holds
    a space between other characters, so what stands between single spaces is encoded alone and remembered; other
    texts are encoded whole, or in parts that end before a single space."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    whole = any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))
    counts = _Counts(sp.encode)

    def stride(text: str) -> int:
        if not whole and (n := sum(map(counts.__getitem__, text.split(" ")))) == n:
            return n
        return len(sp.encode(text))

    def count(text: str) -> int:
        at, n = 0, 1
        while not whole and len(text) - at > STRIDE:
            cut = text.find(" ", at + STRIDE)
            while cut >= 0 and (text[cut - 1].isspace() or text[cut - 1] == "▁" or text[cut + 1 : cut + 2].strip().strip("▁") == ""):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            n += stride(text[at:cut])
            at = cut + 1
        return n + stride(text[at:])

    return count


def with_tokens(df: DataFrame, model: str, text: str = "text", out: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """Add the number of tokens of whole texts, an end id included. Null counts as empty."""

    def make():
        count = counter(model)
        return lambda texts: [[count((t or b"").decode(errors="replace")) for t in texts]]

    return map_text(df, text, f"`{out}` long", make, keep)


def pieces(df: DataFrame, doc_id: str, size: Column, longest: int) -> DataFrame:
    """(doc_id, piece, start, n): each document in pieces of at most `longest`; sizes under 1 give no piece."""
    d = df.select(F.col(doc_id).alias("doc_id"), size.cast("long").alias("size")).where("size > 0")
    d = d.select("doc_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / longest).cast("long"))).alias("piece"))
    start = F.col("piece") * longest
    return d.select("doc_id", "piece", start.alias("start"), F.least(F.col("size") - start, F.lit(longest)).alias("n"))


OUT = "shard long, bin long, capacity int, place int, doc_id long, piece long, start long, n long"


def pack_documents(df: DataFrame, doc_id: str = "doc_id", size: Column | None = None, lengths: Sequence[int] = LENGTHS, overhead: float = OVERHEAD, attention: float = ATTENTION, shard: int = SHARD, text: str = "text", model: str | None = None) -> DataFrame:
    """A row for each piece: shard and bin (both name the sequence), capacity, place, doc_id, piece, start and n.

    size: tokens of a document (by default those of `text` under the sentencepiece model, and an end mark). Every
    document is there whole; null and empty texts are an end mark alone, null sizes and sizes under 1 give
    nothing. Repeated rows and null ids are packed like any other; rows that are alike in all of this may change
    places, nothing else depends on the table's layout. Other columns aren't carried. An empty table gives an
    empty result.
    """
    if size is None:
        if model is None:
            import public_tokenizers

            model = str(public_tokenizers.path("piece_bpe_32k.model"))
        df, size = with_tokens(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")), model, "t", keep=["doc_id"]), F.col("n_tokens")
        doc_id = "doc_id"
    p = pieces(df, doc_id, size, max(lengths)).groupBy("doc_id", "piece", "start", "n").agg(F.count(F.lit(1)).alias("copies"))
    p, _ = stored(p, "pieces")
    shards = max(1, -(-(p.agg(F.sum("copies")).first()[0] or 0) // shard))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "n", "copy"], kind="stable", na_position="first")
        b, c, k = zip(*pack(pdf["n"].tolist(), lengths, overhead, attention), strict=True)
        return pdf.assign(bin=b, capacity=c, place=k)[["shard", "bin", "capacity", "place", "doc_id", "piece", "start", "n"]]

    each = p.select("doc_id", "piece", "start", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return each.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n", "copy"), F.lit(shards))).groupBy("shard").applyInPandas(run, OUT)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed, by the tokens of the same model as op1's; see pack_documents for nulls, ties and repeats."""
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
ORACLE_SQL: dict[str, str] = {}
