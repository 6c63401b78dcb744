"""Toxicity by weak supervision.

Word beginnings that go with toxic labels are mined from a bounded sample of labelled rows and dealt into
lexicons. Many voters, one for each lexicon and pattern, vote toxic or clean or abstain; labels don't vote. A
generative model, in which every voter's vote depends on the class and on the vote of the one voter that it
goes with most (a tree, found from the votes), estimates accuracies and correlations together by
expectation-maximisation and gives each sampled text a posterior label; a linear classifier is trained on these and scores all
texts from their words alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundphrase.llm.common import map_text, stored, table

WORD = re.compile(r"[^\W\d_]+")
#: Words and their first so many letters are features.
BEGINNINGS = (5, 6, 7)
#: Rows of the training sample, mined features, and lexicons that they are dealt into, at most.
SAMPLE, FEATURES, LEXICONS = 12_000, 1_500, 16
#: A mined feature is in so many toxic texts of the sample, in that share of them, and its mean value is so many
#: times that in clean ones.
LEAST_TEXTS, LEAST_SHARE, LEAST_RATIO = 4, 0.02, 3.0
#: A mined lexicon votes toxic on texts that have more of it than this share of the clean ones.
QUIET = 0.97
#: Pseudo-counts of a voter's votes on a toxic text (abstain, clean, toxic), what its own rates weigh against those
#: given its parent's vote, and the information (nats) below which voters count as independent.
PRIOR, PARENT_WEIGHT, LEAST_INFORMATION = np.array([2.0, 1.0, 4.0]), 5.0, 0.005
#: A lexicon of the author's own (fixed values): insults that are plain in any text.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown imbecile fool jerk bastard bitch asshole shit fuck fucking crap vermin filth retard retarded whore slut cunt"
    " idiotin dummkopf arschloch scheisse scheiße abschaum trottel vollidiot connard connasse salope ordure merde débile crétin abruti idiota imbécil estúpido estúpida basura mierda puta cabrón gilipollas tonto payaso".split()
)


def words(text: bytes | None) -> list[str]:
    return WORD.findall((text or b"").decode(errors="replace").lower())


def beginnings(word: str) -> list[str]:
    """The features of a word."""
    n = len(word)
    return [word, *(word[:k] + "*" for k in BEGINNINGS if n > k)] if n > 3 else []


def rate(count: float, n_words: int) -> float:
    """The value of a feature: how often it comes, against the length, on a log scale."""
    return math.log1p(200.0 * count / (n_words + 30))


def is_held_out(doc_id):
    """Column: crc32 of the id as text, modulo 5, is 0 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _patterns(text: str, n: int) -> list[int]:
    """Votes (1, 0 or -1 for abstention) of patterns that need no lexicon."""
    upper, marks = sum(c.isupper() for c in text), text.count("!")
    return [-1 if n < 10 else 1 if marks * 8 > n else 0 if marks == 0 else -1, -1 if n < 10 else 1 if upper * 2 > len(text) else 0 if upper * 10 < len(text) else -1, 1 if re.search(r"\byou (are|re) (an?|so|such)\b|\bshut up\b", text.lower()) else -1]


def _shares(per: dict[int, int], n: int) -> dict[int, int]:
    """How many of n each class gets: all it has if that fits, else its share, and one at least."""
    total, one = sum(per.values()), per.get(1, 0)
    if total <= n:
        return {y: per.get(y, 0) for y in (0, 1)}
    toxic = min(one, max(1, round(n * one / total)))
    if toxic == n and per.get(0, 0) and n > 1:
        toxic -= 1
    return {0: n - toxic, 1: toxic}


def _taken(df: DataFrame, n: int, *key: str) -> DataFrame:
    """n rows (y, key...) in order of a hash of the key, by class as _shares says."""
    per = {r.y: r.n for r in df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = lambda y, k: df.where(F.col("y") == y).orderBy(F.xxhash64(*key), *key).limit(k)
    zero, one = (of(y, k) for y, k in _shares(per, n).items())
    return zero.unionByName(one)


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", n: int = SAMPLE) -> DataFrame:
    """(id, y, hash, n_words, feats, insults, patterns) of labelled texts that aren't held out, at most n different ones.

    An id's label is the largest of its labels. Up to n ids are looked at in order of a hash, and of their different
    texts up to n are taken in order of a hash, both classes in proportion and neither without any (from an n of 2
    on). Copies of a text that is taken come with it, as rows; fit() makes them its weight. Only bounded lists
    of ids and hashes are sent to the documents, never texts to a shuffle. Null ids and labels other than 0 and 1
    teach nothing; null texts count as empty.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~is_held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    ids = _taken(ids.join(docs.select(F.col(doc_id).alias("id")).distinct(), "id", "left_semi"), n, "id")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")).join(F.broadcast(ids), "id")
    each, _ = stored(_taken(rows.select("id", "h", "y").distinct(), n, "id", "h"), "sample")
    rows = rows.drop("y").join(F.broadcast(each), ["id", "h"])

    def make():
        def run(texts: list) -> list:
            out = [[], [], [], [], []]
            for t in texts:
                w, s = words(t), (t or b"").decode(errors="replace")
                c = Counter(f for x in w for f in beginnings(x))
                out[0].append(int.from_bytes(hashlib.blake2b(t or b"", digest_size=8).digest(), "big", signed=True))
                out[1].append(len(w))
                out[2].append([{"f": f, "c": k} for f, k in c.items()])
                out[3].append(sum(x in INSULTS for x in w))
                out[4].append(_patterns(s, len(w)))
            return out

        return run

    # Rows that are alike teach alike, so (id, text) names them and a count stands for the rest.
    return map_text(rows, "text", "hash long, n_words int, feats array<struct<f:string,c:int>>, insults int, patterns array<int>", make, ["id", "y"])


def _mutual(votes: np.ndarray, p: np.ndarray, weight: np.ndarray, a: int, b: int) -> float:
    """Information that two voters' votes hold on each other, given the class."""
    out = 0.0
    for w in (p * weight, (1 - p) * weight):
        joint = np.bincount(votes[:, a] * 3 + votes[:, b], weights=w, minlength=9).reshape(3, 3) + 0.1
        share, joint = w.sum() / weight.sum(), joint / joint.sum()
        out += share * float((joint * np.log(joint / np.outer(joint.sum(1), joint.sum(0)))).sum())
    return out


def _tree(votes: np.ndarray, p: np.ndarray, weight: np.ndarray) -> list[int]:
    """For each voter the one that it depends on (-1: none): the spanning tree with the most information."""
    k = votes.shape[1]
    parent, best = [-1] * k, {j: (_mutual(votes, p, weight, 0, j), 0) for j in range(1, k)}
    while best:
        j = max(best, key=lambda x: (best[x][0], -x))
        gain, at = best.pop(j)
        parent[j] = at if gain > LEAST_INFORMATION else -1
        for i in best:
            g = _mutual(votes, p, weight, j, i)
            if g > best[i][0]:
                best[i] = (g, j)
    return parent


@dataclass
class Voters:
    """What the label model has estimated: each voter's parent and, by class and the parent's vote, the
    probabilities of its votes (abstain, clean, toxic), and the share of the toxic class."""

    parent: list[int]
    tables: list[np.ndarray]
    share: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.full(len(votes), math.log(self.share / (1 - self.share)))
        for j, (at, t) in enumerate(zip(self.parent, self.tables, strict=True)):
            given = votes[:, at] if at >= 0 else 0
            odds += np.log(t[1, given, votes[:, j]] / t[0, given, votes[:, j]])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def accuracy(self, votes: np.ndarray, p: np.ndarray) -> list[tuple[float, float]]:
        """Of each voter: how often it votes toxic on toxic texts and clean on clean ones, where it votes."""
        hits = [[(w @ (votes[:, j] == v)) / max(1e-9, w @ (votes[:, j] > 0)) for v, w in ((2, p), (1, 1 - p))] for j in range(votes.shape[1])]
        return [(float(a), float(b)) for a, b in hits]


def label_model(votes: np.ndarray, balance: float | None = None, rounds: int = 60, weight: np.ndarray | None = None) -> tuple[np.ndarray, Voters]:
    """Posteriors of the toxic class, and the voters' accuracies and correlations, by expectation-maximisation.

    votes: rows by voters, 1 (toxic), 0 (clean) or -1 (abstain); balance: the toxic class's share, if it is known; weight: how often each row counts. The
    first posteriors are the shares of toxic votes. A class keeps its name because each voter's prior is to vote right where it votes.
    """
    v = np.where(votes < 0, 0, votes + 1).astype(np.int64)
    k = v.shape[1]
    weight = np.ones(len(v)) if weight is None else weight
    toxic, clean = (v == 2).sum(1), (v == 1).sum(1)
    p = np.clip((toxic + 0.1) / (toxic + clean + 0.4), 0.02, 0.98)
    model = Voters([-1] * k, [], 0.5)
    for step in range(rounds):
        if step in (1, 5, 15):
            model.parent = _tree(v, p, weight)
        tables = []
        for j in range(k):
            at = model.parent[j]
            t = np.zeros((2, 3, 3))
            for c, w in enumerate(((1 - p) * weight, p * weight)):
                alone = np.bincount(v[:, j], weights=w, minlength=3) + (PRIOR if c else PRIOR[[0, 2, 1]])
                t[c] = alone / alone.sum()
                if at >= 0:  # towards the voter's own rates where a parent's vote is rare
                    joint = np.bincount(v[:, at] * 3 + v[:, j], weights=w, minlength=9).reshape(3, 3) + PARENT_WEIGHT * t[c]
                    t[c] = joint / joint.sum(1, keepdims=True)
            tables.append(t)
        model = Voters(model.parent, tables, float((p @ weight + 1) / (weight.sum() + 2)) if balance is None else balance)
        new = model.posterior(v)
        done = np.abs(new - p).max() < 1e-5 and step > 16
        p = new
        if done:
            break
    return p, model


@dataclass
class Model:
    bias: float = math.log(1 / 19)
    weights: dict[str, float] = field(default_factory=dict)
    insults: float = 2.0

    def score(self, text: bytes | None) -> float:
        w = words(text)
        counts: dict[str, int] = {}
        heads, weights, insults = self._heads, self.weights, 0
        for x in w:
            if x[:4] in heads:
                insults += x in INSULTS
                for f in beginnings(x):
                    if f in weights:
                        counts[f] = counts.get(f, 0) + 1
        z = self.bias + self.insults * rate(insults, len(w)) + sum(weights[f] * rate(c, len(w)) for f, c in counts.items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def ready(self) -> Model:
        self._heads = frozenset(f[:4] for f in self.weights) | frozenset(x[:4] for x in INSULTS)
        return self


def fit(rows: DataFrame) -> Model:
    """A model from sample()'s rows. Without rows of both classes, insults alone count."""
    rows = rows.persist()
    try:
        size = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        n0, n1 = size.get(0, 0), size.get(1, 0)
        if not n0 or not n1:
            return Model().ready()
        # How often a feature comes in either class, and in how many texts of either.
        per = rows.select("y", "n_words", F.explode("feats").alias("x")).select("y", F.col("x.f").alias("f"), F.log1p(200.0 * F.col("x.c") / (F.col("n_words") + 30)).alias("v"))
        one, zero = F.when(F.col("y") == 1, F.col("v")), F.when(F.col("y") == 0, F.col("v"))
        stats = per.groupBy("f").agg(F.coalesce(F.sum(one), F.lit(0.0)).alias("a"), F.coalesce(F.sum(zero), F.lit(0.0)).alias("b"), F.count(one).alias("na"))
        gain = (F.col("a") / n1 - F.col("b") / n0) / F.sqrt((F.col("a") + F.col("b") + 1) / (n0 + n1))
        least, ratio = max(LEAST_TEXTS, LEAST_SHARE * n1), F.col("a") / n1 >= LEAST_RATIO * F.col("b") / n0
        best = stats.where((F.col("na") >= least) & ratio).withColumn("gain", F.round(gain, 9)).where("gain > 0").orderBy(F.desc("gain"), "f").limit(FEATURES).collect()
        names = rows.sparkSession.createDataFrame([(r.f, i) for i, r in enumerate(best)], "f string, i int")
        key = ["id", "hash"]
        each = rows.groupBy(*key).agg(*(F.first(c).alias(c) for c in ("y", "n_words", "insults", "patterns")), F.count(F.lit(1)).alias("copies"))
        hits = rows.select(*key, F.explode("feats").alias("x")).select(*key, F.col("x.f").alias("f"), F.col("x.c").alias("c")).join(F.broadcast(names), "f")
        hits = hits.distinct().groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("hits"))
        docs = each.join(hits, key, "left").orderBy(*key).collect()  # SAMPLE at most
    finally:
        rows.unpersist()
    return _train(docs, [r.f for r in best])


def _votes(docs: list, names: list[str], row: np.ndarray, col: np.ndarray, val: np.ndarray, insult: np.ndarray) -> np.ndarray:
    """Votes of the author's lexicon, of the mined ones and of the patterns. Lexicons take features in turn, so that
    each has strong ones; a lexicon votes toxic above what QUIET of the texts labelled clean reach, copies counted."""
    copies = np.array([r.copies for r in docs], float)
    n, size, clean = len(docs), np.array([r.n_words for r in docs], float), np.array([r.y == 0 for r in docs])
    votes = [np.where(insult > 0, 1, np.where(size >= 30, 0, -1))]
    m = max(1, min(LEXICONS, len(names)))
    for j in range(m if names else 0):
        total = np.bincount(row[col % m == j], weights=val[col % m == j], minlength=n)
        order = np.argsort(total[clean], kind="stable")
        upto = np.cumsum(copies[clean][order])
        high = float(total[clean][order][np.searchsorted(upto, int(QUIET * upto[-1]), "right")]) if clean.any() else 0.0
        votes.append(np.where(total > high, 1, np.where((total <= high / 2) & (size >= 30), 0, -1)))
    return np.stack(votes + [np.array([r.patterns[j] for r in docs]) for j in range(3)], 1)


def _train(docs: list, names: list[str]) -> Model:
    n, k, copies = len(docs), len(names), np.array([r.copies for r in docs], float)
    total = copies.sum()
    size = np.array([r.n_words for r in docs], float)
    row = np.array([i for i, r in enumerate(docs) for _ in r.hits or ()], np.int64)
    col = np.array([h.i for r in docs for h in r.hits or ()], np.int64)
    val = np.log1p(200.0 * np.array([h.c for r in docs for h in r.hits or ()], float) / (size[row] + 30)) if len(row) else np.zeros(0)
    insult = np.log1p(200.0 * np.array([r.insults for r in docs], float) / (size + 30))
    # Labels vote on no text: they chose the lexicons, and give the classes' balance.
    p, _ = label_model(_votes(docs, names, row, col, val, insult), (sum(r.y * r.copies for r in docs) + 1) / (total + 2), weight=copies)
    # The linear classifier, on posterior labels: logistic regression with a quadratic penalty, by Adam.
    w, insults, bias = np.zeros(k), 0.0, math.log((p @ copies + 0.5) / (total - p @ copies + 0.5))
    mom, sec, lr, penalty = np.zeros(k + 2), np.zeros(k + 2), 0.05, 0.1 / total
    for t in range(1, 601):
        z = bias + insults * insult + np.bincount(row, weights=val * w[col], minlength=n)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - p) * copies / total
        g = np.r_[np.bincount(col, weights=val * e[row], minlength=k) + penalty * w, e @ insult + penalty * insults, e.sum()]
        mom, sec = 0.9 * mom + 0.1 * g, 0.99 * sec + 0.01 * g * g
        d = lr * (mom / (1 - 0.9**t)) / (np.sqrt(sec / (1 - 0.99**t)) + 1e-8)
        w, insults, bias = w - d[:k], insults - d[k], bias - d[k + 1]
    return Model(float(bias), {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-4}, float(insults)).ready()


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the score of whole texts; null and empty texts get the model's score of no words. A clashing
    column gives way; other columns and repeated rows pass."""
    return map_text(df, text, f"`{out}` double", lambda: lambda texts: [[*map(model.score, texts)]], keep)


def learned(spark: SparkSession, sf_dir: str) -> Model:
    return fit(sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score; sample() and score() say what becomes of nulls, ties and repeats."""
    got = score(table(spark, sf_dir, "documents"), learned(spark, sf_dir), keep=["doc_id"])
    return got.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE_SQL: dict[str, str] = {}
