"""Exact BPE encoding and decoding with a SentencePiece model, by backtracking.

A sequence of pieces is the encoding of a text exactly if every piece encodes to itself and every two
neighbours, merged anew from characters, give just these two pieces again. So the encoder walks left to right:
it takes the longest piece that starts here (all matches come from one Aho-Corasick pass), checks it against
the piece before, tries the next shorter one where that fails, and steps back where none is left. Positions that
failed once are marked in a bit field and never tried again, which bounds the work.

Texts are encoded in units between which no piece can reach (found from the vocabulary, not assumed); units
that come again are taken from a bounded memory.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from groundphrase.llm.common import map_text, table

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
#: Stands for control ids, which end a run of bytes: no text decodes from it.
NOT_UTF8 = b"\xff"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        value |= (c & 127) << shift
        i, shift = i + 1, shift + 7
        if c < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class Codec:
    """One model. encode(text) gives ids as an array of ints, decode(ids) the text."""

    #: Units and neighbour checks that are remembered, in each of two generations.
    MEMORY = 300_000

    def __init__(self, path: str):
        self.pieces, self.kinds, scores, self.end = [], [], [], None
        normal, trainer = {}, {}
        with open(path, "rb") as f:
            for field, value in _fields(f.read()):
                if field == 1:
                    m = dict(_fields(value))
                    self.pieces.append(m[1].decode())
                    scores.append(struct.unpack("<f", m[2])[0] if 2 in m else 0.0)
                    self.kinds.append(m.get(3, NORMAL))
                elif field == 2:
                    trainer = dict(_fields(value))
                elif field == 3:
                    normal = dict(_fields(value))
        if trainer.get(3) != 2 or normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1) or trainer.get(35, 0) == 0:
            raise ValueError("only BPE models with byte fallback, a leading space and no other normalization are supported")
        if USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.end = self.pieces.index("</s>")
        self.unknown_text = trainer.get(44, " ⁇ ".encode())
        self.score = {p: s for p, s, k in zip(self.pieces, scores, self.kinds, strict=True) if k == NORMAL}
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        inside = set("".join(pairs))
        # Where no piece holds a pair of neighbours, texts can be cut between them: before a space, around
        # a character that is in no longer piece, and between a word and punctuation.
        alone = "".join(c for c in "\n\t" if c not in inside)
        after = "".join(re.escape(c) for c in ".,;:|!?%&#*" if not any(x[1] == c and x[0].isalnum() for x in pairs))
        rest = f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+"
        if any(x[1] == SPACE != x[0] for x in pairs):
            rest = ".+"
        self._unit = re.compile((f"[{alone}]|" if alone and rest != ".+" else "") + (f"{SPACE}*[^\\W_]+(?=[{after}])|" if after and rest != ".+" else "") + rest, re.S)
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if len(p) > 1 and self.merge(p) == [p]:
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self._units: list[dict] = [{}, {}]
        self._fit: list[dict] = [{}, {}]
        as_bytes = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in self.byte_id.items():
            as_bytes[i] = bytes([b])
        for i, k in enumerate(self.kinds):
            if k in (CONTROL, UNKNOWN):
                as_bytes[i] = self.unknown_text if k == UNKNOWN else NOT_UTF8
        self.as_bytes = as_bytes

    def merge(self, text: str) -> list[str]:
        """The merge rule itself, on a short text: the best pair first, then the leftmost."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, key: tuple[str, str]) -> bool:
        """Whether two neighbours, merged anew, stay as they are (where the memory's first part has no answer)."""
        new, old = self._fit
        ok = old.get(key)
        if ok is None:
            ok = self.merge(key[0] + key[1]) == [*key]
        if len(new) >= self.MEMORY:
            self._fit[:] = [{}, new]
            new = self._fit[0]
        new[key] = ok
        return ok

    def backtrack(self, unit: str) -> list[str]:
        """The pieces of a unit; single characters may be outside the vocabulary."""
        n = len(unit)
        lengths: list = [None] * n
        for last, k in self.automaton.iter(unit):
            at = last - k + 1
            if lengths[at] is None:
                lengths[at] = [1, k]  # a single character can always be tried
            else:
                lengths[at].append(k)  # in order of their ends, so rising
        known, fits, failed, out, pos, prev, most = self._fit[0].get, self._fits, bytearray((n >> 3) + 1), [], 0, None, n
        while pos < n:
            for k in reversed(lengths[pos] or (1,)):
                if k > most:
                    continue
                end = pos + k
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                piece = unit[pos:end]
                if prev is not None:
                    key = (prev, piece)
                    ok = known(key)
                    if not (fits(key) if ok is None else ok):
                        continue
                out.append(piece)
                prev, pos, most = piece, end, n
                break
            else:  # nothing is left here: step back, and never come here again
                failed[pos >> 3] |= 1 << (pos & 7)
                most = len(out.pop()) - 1
                pos -= most + 1
                prev = out[-1] if out else None
        return out

    def _ids(self, unit: str) -> bytes:
        ids = array("i")
        for p in self.backtrack(unit):
            i = self.id.get(p)
            if i is None:
                ids.extend(self.byte_id[b] for b in p.encode())
            else:
                ids.append(i)
        return ids.tobytes()

    def units(self, text: str) -> list[str]:
        """text in parts that no piece crosses."""
        return self._unit.findall(SPACE + text.replace(" ", SPACE))

    def encode(self, text: str, end: bool = True) -> np.ndarray:
        """Ids of a whole text, with the end id if asked for."""
        parts, (new, old) = [], self._units
        if text:
            for u in self.units(text):
                got = new.get(u)
                if got is None:
                    got = old.get(u)
                    if got is None:
                        got = self._ids(u)
                    if len(new) >= self.MEMORY:
                        old, new = new, {}
                        self._units[:] = [new, old]
                    if len(u) < 64:
                        new[u] = got
                parts.append(got)
        if end:
            parts.append(array("i", [self.end]).tobytes())
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids) -> str:
        """The text of ids. Control ids give nothing; broken bytes give U+FFFD one by one."""
        ids, table_ = ids.tolist() if isinstance(ids, np.ndarray) else list(ids), self.as_bytes
        while ids and self.kinds[ids[-1]] == CONTROL:
            ids.pop()
        raw = b"".join([table_[i] for i in ids])
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_broken(ids)
        return text[1:] if text.startswith(" ") and self._first_is_space(ids) else text

    def _first_is_space(self, ids) -> bool:
        """Only a space that the first piece brings is the leading one."""
        for i in ids:
            if self.kinds[i] != CONTROL:
                return self.kinds[i] == NORMAL
        return False

    def _decode_broken(self, ids) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if self.kinds[i] == BYTE:
                run += self.as_bytes[i]
            else:
                flush()
                out.append("" if self.kinds[i] == CONTROL else self.as_bytes[i].decode())
        flush()
        return "".join(out)


@lru_cache(2)
def codec(path: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(path)


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids", end: bool = True, decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add the column `ids` (array of ints) of whole texts and, if named, their decoded text.

    Null counts as empty, which gives the end id alone. Columns that clash with the new ones give way. Any other
    column, repeated rows and empty tables pass through.
    """

    def make():
        c = codec(model)

        def run(texts: list) -> list:
            got = [c.encode((t or b"").decode(errors="replace"), end) for t in texts]
            ends = np.cumsum([0, *map(len, got)], dtype=np.int32)
            flat = np.concatenate(got) if got else np.empty(0, np.int32)
            arrays = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))]
            return arrays if decoded is None else [*arrays, [c.decode(x) for x in got]]

        return run

    return map_text(df, text, f"`{ids}` array<int>" + (f", `{decoded}` string" if decoded else ""), make, keep)


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the text of a column of ids; null gives null."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def f(s):
        c = codec(model)
        return s.map(lambda x: None if x is None else c.decode(x))

    return df.withColumn(text, f(F.col(ids)))


def digests(df: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """What the encoding and its decoding give, as counts and SHA-256, without the ids leaving the worker."""

    def make():
        c = codec(model)
        decimal = [str(i) for i in range(len(c.pieces))]

        def run(texts: list) -> list:
            n, a, b = [], [], []
            for t in texts:
                ids = c.encode((t or b"").decode(errors="replace")).tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                b.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            return [n, a, b]

        return run

    return map_text(df, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", make, keep)


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return digests(table(spark, sf_dir, "documents"), model, keep=["doc_id"])


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
