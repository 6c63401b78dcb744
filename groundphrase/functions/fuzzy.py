"""Approximate matching: bit-parallel kernels and the evidence built on them.

Only candidate pairs reach these functions; everything before them runs as DataFrame operations.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundphrase.functions.text import RETRIEVAL_FROM, RETRIEVAL_TO, TATWEEL

#: Thresholds (fixed values).
TOKEN_SIMILARITY, LENGTH_DELTA, LEAST_COMPACT, LEAST_ROUGH = 0.72, 2, 8, 0.45
LEAST_EVIDENCE, SKIP_BASE, CLEAR_SCORE, CLEAR_GAP, WEIGHT = 0.55, 0.95, 0.90, 0.05, 0.40

_FOLD = str.maketrans(RETRIEVAL_FROM, RETRIEVAL_TO, TATWEEL)


def infix_distance(pattern: str, text: str) -> int:
    """Edits that turn pattern into the nearest substring of text: one machine word of bits for each letter
    of the pattern, one step for each letter of the text."""
    m = len(pattern)
    if not m:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for c in text:
        same = at.get(c, 0)
        cross = ((same & up) + up ^ up) | same
        rise, fall = down | ~(cross | up) & full, up & cross
        score += bool(rise & last) - bool(fall & last)
        best = min(best, score)
        rise, fall, same = rise << 1 & full, fall << 1 & full, same | down
        up, down = fall | ~(same | rise) & full, rise & same
    return best


def places(b: list | str) -> dict:
    """For each item the bits of its places."""
    at: dict = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << i
    return at


def lcs(a: list | str, b: list | str, at: dict | None = None) -> int:
    """The length of the longest common subsequence, by bits; at: places(b), if they are known."""
    at = places(b) if at is None else at
    full = state = (1 << len(b)) - 1
    for x in a:
        hit = state & at.get(x, 0)
        state = (state + hit | state - hit) & full
    return len(b) - state.bit_count()


def ratio(a: str, b: str, autojunk: bool = False) -> float:
    return SequenceMatcher(None, a, b, autojunk=autojunk).ratio()


def allowed_edits(n: int) -> int:
    return 1 + sum(n >= x for x in (12, 24, 36))


def repairs(query: list[str], doc: list[str]) -> tuple[float, int, bool]:
    """Token evidence, repaired tokens, and whether a query token of three letters or more stays unmatched.

    Equal tokens pair off first, in order; then the most similar pairs, later ones first on ties.
    """
    open_doc: dict[int, str] = dict(enumerate(doc))
    rest: dict[int, str] = {}
    exact = 0
    for i, q in enumerate(query):
        j = next((j for j, d in open_doc.items() if d == q), None)
        if j is None:
            rest[i] = q
        else:
            del open_doc[j]
            exact += 1
    pairs = [(s, i, j) for i, q in rest.items() if len(q) > 1 for j, d in open_doc.items() if len(d) > 1 and abs(len(q) - len(d)) <= LENGTH_DELTA and (s := ratio(q, d)) >= TOKEN_SIMILARITY]
    sims = []
    for s, i, j in sorted(pairs, reverse=True):
        if i in rest and j in open_doc:
            del rest[i], open_doc[j]
            sims.append(s)
    unmatched = any(len(q) >= 3 for q in rest.values())
    if not sims:
        return 0.0, 0, unmatched
    return (exact + sum(sims)) / len(query) * (0.8 + 0.2 * sum(sims) / len(sims)), len(sims), unmatched


def bigrams(s: str) -> set[str]:
    return {s[i : i + 2] for i in range(max(1, len(s) - 1))} if s else set()


def evidence(query: str, doc: str) -> float:
    """How well a normalized query is a misspelt form of a normalized document, from 0 to 1."""
    q, d = query.replace(" ", ""), doc.replace(" ", "")
    if len(q) < LEAST_COMPACT:
        return 0.0
    tokens, n, unmatched = repairs(query.split(), doc.split())
    if n and not unmatched:
        return tokens
    grams = bigrams(q)
    if len(grams & bigrams(d)) < LEAST_ROUGH * len(grams):
        return 0.0
    edits = infix_distance(q, d)
    compact = 1 - edits / len(q) if 0 < edits <= allowed_edits(len(q)) else 0.0
    return max(compact, tokens if n and (compact > 0 or not unmatched) else 0.0)


@F.pandas_udf(T.DoubleType())
def fuzzy_evidence(query: pd.Series, doc: pd.Series) -> pd.Series:
    """evidence() of two normalized columns; null counts as empty."""
    out = pd.Series(0.0, query.index, dtype="float64")
    some = query.notna() & doc.notna()
    out[some] = [evidence(q, d) for q, d in zip(query[some], doc[some], strict=True)]
    return out


def token_spans(text: str) -> list[tuple[str, int, int]]:
    """Normalized tokens with their places in the raw text; what is dropped inside a token belongs to it."""
    out, token, start, end = [], "", 0, 0
    for i, c in enumerate(text + " "):
        if c.isspace() or c == "‌":
            if token:
                out.append((token, start, end))
            token = ""
            continue
        kept = "".join(x for x in unicodedata.normalize("NFC", c).translate(_FOLD) if x.isalnum()).lower()
        if kept:
            start = start if token else i
            token, end = token + kept, i + 1
    return out


class Candidate:
    """A normalized candidate, and what all windows are compared with."""

    def __init__(self, text: str):
        self.compact, self.tokens = text.replace(" ", ""), text.split()
        self.words, self.bigrams = set(self.tokens), bigrams(self.compact)
        self.blocks, self.places = SequenceMatcher(None, "", self.compact, autojunk=False), places(self.compact)

    def score(self, q: str, qt: list[str], n_grams: int, common: int, same: int, blocks: int) -> float:
        n, d = len(q), len(self.compact)
        score = 0.30 * same / max(1, len(qt)) + 0.15 * same / max(1, len(self.tokens)) + 0.25 * common / max(1, n_grams) + 0.15 * blocks / n + 0.10 * common / max(1, len(self.bigrams)) + 0.05 * min(1.0, n / 8)
        if n >= 6 and q in self.compact:
            score = max(score, 0.92 + 0.05 * n / d)
        return min(1.0, score)

    def matched(self, q: str) -> int:
        self.blocks.set_seq1(q)
        return sum(b.size for b in self.blocks.get_matching_blocks())


def alignment(window: str, candidate: str) -> float:
    """A quick score of a window of a request against a candidate, both normalized."""
    q, qt, c = window.replace(" ", ""), window.split(), Candidate(candidate)
    if not q:
        return 0.0
    qg = bigrams(q)
    return c.score(q, qt, len(qg), len(qg & c.bigrams), lcs(qt, c.tokens), c.matched(q))


class Request:
    """A request's tokens, and counts over all its windows that don't depend on a candidate."""

    def __init__(self, text: str):
        self.spans = token_spans(text)
        self.tokens = [x[0] for x in self.spans]
        self.compact = "".join(self.tokens)
        self.at = np.cumsum([0, *map(len, self.tokens)])
        self.grams = [self.compact[i : i + 2] for i in range(len(self.compact) - 1)]
        last: dict[str, int] = {}
        before = np.full(len(self.grams), -1)
        for i, g in enumerate(self.grams):
            before[i] = last.get(g, -1)
            last[g] = i
        #: Places of bigrams (columns) that a window from each token (rows) meets for the first time.
        self.new = (before < self.at[:-1, None]) & (np.arange(len(self.grams)) >= self.at[:-1, None])
        self.first = self.summed(self.new)
        self.letters = sorted(set(self.compact))
        shown = np.zeros((len(self.letters), len(self.compact) + 1), np.int32)
        for i, c in enumerate(self.letters):
            shown[i, 1:] = np.cumsum([x == c for x in self.compact])
        self.shown = shown[:, self.at]

    @staticmethod
    def summed(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((*x.shape[:-1], 1), np.int64), np.cumsum(x, axis=-1)], axis=-1)


_request = lru_cache(256)(Request)
_candidate = lru_cache(4096)(Candidate)
#: What rounding may add to a bound.
SLACK = 1e-9


def windows(text: str, candidate: str, most: int = 3, extra: int = 2) -> list[tuple[int, int, str, float]]:
    """(start, end, raw text, score) of the best windows of a request for a normalized candidate.

    Windows are looked at by falling bounds of their scores (exact counts of bigrams, tokens and letters in common
    whatever their order), until no other can be among the best; so the result is that of all windows.
    """
    r, c = _request(text), _candidate(candidate)
    n = len(r.tokens)
    longest = min(n, max(3, len(c.tokens) + extra))
    sizes = np.arange(min(2, n) or 1, longest + 1)
    if not n or not len(sizes):
        return []
    start = np.concatenate([np.arange(n - k + 1) for k in sizes])
    end = start + np.repeat(sizes, n - sizes + 1)
    length = r.at[end] - r.at[start]
    held = np.fromiter((g in c.bigrams for g in r.grams), bool, len(r.grams))
    upto = np.maximum(r.at[end] - 1, 0)
    n_grams, common = r.first[start, upto], r.summed(r.new & held)[start, upto]
    if (one := length == 1).any():  # a single letter is its own bigram
        n_grams[one] = 1
        common[one] = [r.compact[r.at[i]] in c.bigrams for i in start[one]]
    words = r.summed(np.fromiter((t in c.words for t in r.tokens), bool, n))
    same = np.minimum(words[end] - words[start], len(c.tokens))
    letters = np.minimum(r.shown[:, end] - r.shown[:, start], np.array([[c.compact.count(x)] for x in r.letters])).sum(0)
    w_same = 0.30 / (end - start) + 0.15 / max(1, len(c.tokens))
    fixed = 0.25 * common / np.maximum(1, n_grams) + 0.10 * common / max(1, len(c.bigrams)) + 0.05 * np.minimum(1.0, length / 8)
    bound = fixed + w_same * same + 0.15 * letters / length
    inside = (common == n_grams) & (length >= 6)  # perhaps a whole piece of the candidate
    bound[inside] = np.maximum(bound[inside], 0.97)
    best: list[tuple[float, int, int]] = []
    for k in np.argsort(-bound, kind="stable"):
        least = best[-1][0] - SLACK if len(best) == most else -1.0
        if bound[k] < least:
            break
        i, j = int(start[k]), int(end[k])
        qt, q = r.tokens[i:j], r.compact[r.at[i] : r.at[j]]
        exact = lcs(qt, c.tokens) if same[k] else 0
        # Blocks in common are a common subsequence, too.
        if not inside[k] and len(best) == most and fixed[k] + w_same[k] * exact + 0.15 * lcs(q, c.compact, c.places) / len(q) < least:
            continue
        score = c.score(q, qt, int(n_grams[k]), int(common[k]), exact, c.matched(q))
        best = sorted([*best, (score, r.spans[j - 1][2] - r.spans[i][1], -r.spans[i][1])], reverse=True)[:most]
    return [(-s, -s + n, text[-s : -s + n], score) for score, n, s in best]
