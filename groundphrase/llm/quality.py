"""Quality rules as weak supervision.

Rules vote good or bad or abstain. Expectation-maximisation over the counts of all vote patterns estimates how
often each rule votes right in either class; the posterior probability of the good class replaces the demand
that all rules pass. Patterns are counted over the whole table; there are at most 3 ** rules of them, so the
driver's share is bounded whatever the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundphrase.llm.common import map_text, stored, table

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Frequent function words of the corpus languages (fixed values).
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other"
    " de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux d l"
    " der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei"
    " el los del las por con una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había".split()
)
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct long, n_upper long, n_alpha long, n_function long, n_ended long, n_stutter long"


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words inside windows (a power of two wide) that occur twice or more, the first included."""
    ids: dict = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    n = len(words) - window + 1
    if n < 2 or len(words) - len(ids) < window:  # each word of a second occurrence has come before
        return 0
    width, top = 1, len(ids)
    while width < window:  # ranks of runs twice as wide, exactly
        _, a = np.unique(a[:-width] * top + a[width:], return_inverse=True)
        top, width = int(a.max()) + 1, 2 * width
    twice = np.bincount(a)[a] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge) > 0).sum())


def features(text: bytes | None) -> tuple:
    """FEATURES of a text; null counts as empty."""
    raw = text or b""
    words, chars = raw.split(), raw.decode(errors="replace")  # bytes.split: ASCII white space
    blanks = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)] if b"\n" in raw else [raw] * bool(words)
    tokens = [w.strip(".,;:!?\"'()[]") for w in chars.split()]
    return (
        len(words), len(chars) - blanks, sum(raw.count(bytes([c])) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), len(set(words)), sum(map(str.isupper, tokens)), sum(map(str.isalpha, tokens)), sum(map(FUNCTION_WORDS.__contains__, map(str.lower, tokens))),
        sum(x.rstrip()[-1:] in b".!?\"'" for x in lines), sum(map(bytes.__eq__, words, words[1:])),
    )


def with_features(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    return map_text(df, text, FEATURES, lambda: lambda texts: [*map(list, zip(*map(features, texts), strict=True))] or [[]] * 12, keep)


def rules() -> dict[str, tuple[Column, Column]]:
    """(good, bad) of each rule; a rule abstains where neither holds. Every word count is at least 1 here."""
    c, n = F.col, F.col("n_words")
    return {
        "length": (n >= 30, n < 12),
        "word_length": (c("word_chars").between(3 * n, 9 * n), ~c("word_chars").between(2 * n, 14 * n)),
        "symbols": (c("n_symbols") * 50 <= n, c("n_symbols") * 8 > n),
        "dup_lines": (c("n_dup_lines") == 0, c("n_dup_lines") * 4 > c("n_lines")),
        "repeats": (c("n_repeat_words") * 20 <= n, c("n_repeat_words") * 10 > 3 * n),
        "upper": (c("n_upper") * 10 <= n, c("n_upper") * 4 > n),
        "alpha": (c("n_alpha") * 10 >= 9 * n, c("n_alpha") * 4 < 3 * n),
        "variety": (c("n_distinct") * 3 >= n, c("n_distinct") * 6 < n),
        "function": (c("n_function") * 8 >= n, (c("n_function") * 25 < n) & (n >= 30)),
        "stutter": (c("n_stutter") * 50 <= n, c("n_stutter") * 10 > n),
        "endings": (c("n_ended") * 2 >= c("n_lines"), (c("n_ended") * 5 < c("n_lines")) & (c("n_lines") >= 3)),
    }


def with_votes(df: DataFrame) -> DataFrame:
    """Add `votes`: for each rule + (good), - (bad) or 0, as one string. Texts without words get all 0."""
    each = [F.when(F.col("n_words") == 0, "0").when(good, "+").when(bad, "-").otherwise("0") for good, bad in rules().values()]
    return df.withColumn("votes", F.concat(*each))


#: The pseudo-counts of a right and a wrong vote, so many times the mean count: rules are better than chance.
PRIOR_RIGHT, PRIOR_WRONG, PRIOR_WEIGHT, ROUNDS = 0.8, 0.2, 0.02, 200


def label_model(patterns: list[tuple[str, int]]) -> tuple[float, list[tuple[float, float]]]:
    """The log odds of the good class, and for each rule what a good and a bad vote add to them.

    Abstentions carry nothing. The first responsibilities are the shares of good votes; a class keeps its name
    because each rule's prior favours right votes. No pattern at all gives a prior of one half and weights of
    the rules' priors.
    """
    k = len(patterns[0][0]) if patterns else len(rules())
    votes = np.array([[{"+": 1, "-": -1, "0": 0}[v] for v in p] for p, _ in patterns], float).reshape(-1, k)
    n = np.array([m for _, m in patterns], float)
    good, bad = (votes > 0).astype(float), (votes < 0).astype(float)
    p = (good.sum(1) + 0.5) / (good.sum(1) + bad.sum(1) + 1)
    p = np.where(bad.sum(1) >= 2, np.minimum(p, 0.3), np.where(bad.sum(1) == 0, np.maximum(p, 0.9), p))
    weight = 1 + PRIOR_WEIGHT * n.sum()
    share, w = 0.5, np.zeros((k, 2))
    for _ in range(ROUNDS):
        a, b = n * p, n * (1 - p)
        share = (a.sum() + 1) / (n.sum() + 2)
        ga, ba, gb, bb = a @ good, a @ bad, b @ good, b @ bad
        right = (ga + PRIOR_RIGHT * weight) / (ga + ba + weight)  # a good vote on a good text
        wrong = (gb + PRIOR_WRONG * weight) / (gb + bb + weight)  # a good vote on a bad text
        new = np.stack([np.log(right / wrong), np.log((1 - right) / (1 - wrong))], 1)
        p = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + good @ new[:, 0] + bad @ new[:, 1], -50, 50)))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return float(np.log(share / (1 - share))), [(float(x), float(y)) for x, y in new]


def judge(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add FEATURES, votes, quality (posterior), base_failed and kept; columns of these names give way.

    base_failed: fewer than 20 words, or more than 30 of 100 in repeated windows. Such rows aren't kept, and
    the model is learned without them. Null texts have no words. An empty table gives an empty result.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows, _ = stored(with_votes(with_features(df, text, keep)).withColumn("base_failed", base), "quality")
    seen = rows.where(~F.col("base_failed")).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    start, weights = label_model([(r.votes, r.n) for r in sorted(seen, key=lambda r: r.votes)])
    odds = F.lit(start)
    for i, (g, b) in enumerate(weights):
        v = F.substring("votes", i + 1, 1)
        odds += F.when(v == "+", g).when(v == "-", b).otherwise(0.0)
    quality = 1 / (1 + F.exp(-odds))
    return rows.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and verdict. A null text has no words and fails the base rules; a posterior of exactly one half
    is kept; repeated rows count as rows in the model and come back as often as they are there; an empty table gives an empty result."""
    got = judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


QUERIES = {"op5_quality": op5_quality}
ORACLE_SQL: dict[str, str] = {}
