"""Where phrases of a corpus stand in texts: all of them at once, in both directions, and what is done about it."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundphrase.functions import offsets
from groundphrase.functions import text as tx
from groundphrase.operators.lexical import DICTIONARY

#: Stored surfaces of fewer letters are not hidden or looked for (a fixed value).
LEAST_SURFACE = 4
MARK = "[FFE_USER_MENTION]"


def surfaces(variants: DataFrame, least: int = LEAST_SURFACE) -> DataFrame:
    """(surface): the different stored texts, trimmed, of so many characters or more."""
    return variants.select(F.trim("text").alias("surface")).where(F.length("surface") >= least).distinct()


def _fits(phrases: DataFrame, column: str, dictionary: int) -> bool:
    return (phrases.agg(F.sum(F.length(column))).first()[0] or 0) <= dictionary


def occurrences(texts: DataFrame, phrases: DataFrame, key: str, text: str = "text", phrase: str = "surface", least: int = LEAST_SURFACE, dictionary: int = DICTIONARY) -> DataFrame:
    """(key, phrase, start): every place (from 0) where a phrase stands in a text, overlapping ones too.

    While the phrases' checked size allows it, one pass of an automaton finds them; beyond that, phrases and texts
    meet by a join on a phrase's first letters (so phrases have `least` of them). Null texts hold nothing.
    """
    p = phrases.select(F.col(phrase).alias("phrase")).where(F.length("phrase") >= least).distinct()
    t = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    if not _fits(p, "phrase", dictionary):
        heads = t.select("key", "text", F.posexplode(tx.char_ngrams(F.col("text"), least)).alias("start", "head"))
        found = heads.join(p.withColumn("head", F.substring("phrase", 1, least)), "head").where(F.expr("substring(text, start + 1, length(phrase)) = phrase"))
        return found.select(F.col("key").alias(key), F.col("phrase").alias(phrase), F.col("start").cast("int").alias("start"))
    words = sorted(r.phrase for r in p.collect())  # checked: DICTIONARY letters at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in words:
            machine.add_word(w, w)
        if words:
            machine.make_automaton()
        for b in batches:
            at, found, starts = [], [], []
            for i, x in enumerate(b.column(1).to_pylist() if words else ()):
                for last, w in machine.iter(x):
                    at.append(i)
                    found.append(w)
                    starts.append(last - len(w) + 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(found, pa.string()), pa.array(starts, pa.int32())], names=["key", "phrase", "start"])

    schema = T.StructType([T.StructField("key", t.schema["key"].dataType), T.StructField("phrase", T.StringType()), T.StructField("start", T.IntegerType())])
    return t.mapInArrow(run, schema).select(F.col("key").alias(key), F.col("phrase").alias(phrase), "start")


def chosen(spans: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """Spans (start, end) without overlaps of places (start, phrase) in a text: longer phrases first, then smaller ones,
    then from the left, as if one phrase after the other was replaced."""
    taken: list[tuple[int, int]] = []
    for _, _, start, end in sorted((-len(w), w, s, s + len(w)) for s, w in spans):
        i = bisect_left(taken, (start, start))
        if (i == len(taken) or taken[i][0] >= end) and (i == 0 or taken[i - 1][1] <= start):
            insort(taken, (start, end))
    return taken


def redact(texts: DataFrame, phrases: DataFrame, key: str, text: str = "text", mark: str = MARK, dictionary: int = DICTIONARY) -> DataFrame:
    """texts with every stored surface replaced by a mark, overlaps as chosen() says. key: one value a row.

    Null texts stay null; texts without a surface pass as they are.
    """
    places = occurrences(texts, phrases, key, text, dictionary=dictionary).groupBy(key).agg(F.collect_list(F.struct("start", "surface")).alias("_spans"))
    both = texts.join(places, key, "left")
    hidden = _replaced(F.struct(F.col(f"`{text}`").alias("text"), F.col("_spans").alias("spans")), mark)
    return both.withColumn(text, F.when(F.col("_spans").isNull(), F.col(f"`{text}`")).otherwise(hidden)).drop("_spans").select(*(f"`{c}`" for c in texts.columns))


def _replaced(pair, mark: str):
    @F.pandas_udf(T.StringType())
    def run(df: pd.DataFrame) -> pd.Series:
        out = []
        for t, spans in zip(df["text"], df["spans"], strict=True):
            if t is None or spans is None:
                out.append(t)
                continue
            at, parts = 0, []
            for s, e in chosen([(x["start"], x["surface"]) for x in spans]):
                parts += [t[at:s], mark]
                at = e
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    return run(pair)


def leaks(texts: DataFrame, phrases: DataFrame, key: str, text: str = "text", dictionary: int = DICTIONARY) -> DataFrame:
    """(key, surface, n): stored surfaces that a text holds, and how often."""
    return occurrences(texts, phrases, key, text, dictionary=dictionary).groupBy(key, "surface").agg(F.count(F.lit(1)).alias("n"))


def mentions(texts: DataFrame, variants: DataFrame, key: str, text: str = "text", least: int = LEAST_SURFACE, dictionary: int = DICTIONARY) -> DataFrame:
    """(key, doc_id, family_id, start, end, raw_start, raw_end, raw): whole-word places of variants in texts, in
    normalized places and, by the text's map, in raw ones, with the raw words themselves."""
    v = variants.select("doc_id", "family_id", tx.retrieval(tx.composed(F.col("text"))).alias("surface")).where(F.length("surface") >= least)
    t = texts.select(F.col(key).alias("_key"), F.col(text).alias("text")).where("text is not null")
    words = v.select("surface").distinct()
    found = _mentioned(t, words) if _fits(words, "surface", dictionary) else _mentioned_by_join(t, v, least)
    return found.join(v, "surface").select(F.col("_key").alias(key), "doc_id", "family_id", "start", "end", "raw_start", "raw_end", "raw")


def _mentioned(t: DataFrame, words: DataFrame) -> DataFrame:
    """Whole-word places of phrases by one pass of an automaton over each text's normalized form; nothing is shuffled."""
    phrases = sorted(r.surface for r in words.collect())  # checked: DICTIONARY letters at most
    out = f"_key {t.schema['_key'].dataType.simpleString()}, surface string, start int, end int, raw_start int, raw_end int, raw string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in phrases:
            machine.add_word(f" {w} ", w)
        if phrases:
            machine.make_automaton()
        for b in batches:
            at, rows = [], []
            for i, raw in enumerate(b.column(1).to_pylist() if phrases else ()):
                m = offsets.mapped(raw)
                for last, w in machine.iter(f" {m.text} "):
                    end = last - 1
                    start = end - len(w)
                    a, z = int(m.starts[start]), int(m.ends[end - 1])
                    at.append(i)
                    rows.append((w, start, end, a, z, raw[a:z]))
            cols = [pa.array([r[k] for r in rows], pa.string() if k in (0, 5) else pa.int32()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *cols], names=["_key", "surface", "start", "end", "raw_start", "raw_end", "raw"])

    return t.mapInArrow(run, out)


def _mentioned_by_join(t: DataFrame, v: DataFrame, least: int) -> DataFrame:
    """The same where the phrases are too many for an automaton: places by a join, then maps of the texts that have any."""
    plain = t.select("_key", tx.retrieval(tx.composed(F.col("text"))).alias("normalized"))
    places = occurrences(plain, v, "_key", "normalized", least=least, dictionary=0)
    maps = offsets.intake(t.join(places.select("_key").distinct(), "_key", "left_semi")).drop("tokens", "display", "compact")
    first, last = F.col("start"), F.col("start") + F.length("surface")
    whole = places.join(maps, "_key")
    edge = lambda at: F.substring(F.concat(F.lit(" "), F.col("normalized"), F.lit(" ")), at, F.lit(1)) == " "
    whole = whole.where(edge(first + 1) & edge(last + 2)).withColumn("_raw", offsets.raw_span(F.col("starts"), F.col("ends"), first, last))
    return whole.select("_key", "surface", "start", last.alias("end"), F.col("_raw.start").alias("raw_start"), F.col("_raw.end").alias("raw_end"), F.substring("text", F.col("_raw.start") + 1, F.col("_raw.end") - F.col("_raw.start")).alias("raw"))


def _inside(small: DataFrame, large: DataFrame) -> DataFrame:
    """(s, l) of strings (s, x) inside strings (l, y): whatever holds a string holds its rarest gram, so an equi-join on
    that finds all. Grams have three letters, or as many as a shorter string has."""
    widths = sorted(r[0] for r in small.select(F.least(F.length("x"), F.lit(3)).alias("w")).distinct().collect())  # 1, 2, 3
    out = None
    for w in widths:
        of = lambda df, k, c, w=w: df.select(k, c, F.explode(F.array_distinct(tx.char_ngrams(F.col(c), w))).alias("gram"))
        q = small.where(F.least(F.length("x"), F.lit(3)) == w)
        grams = of(large.where(F.length("y") >= w), "l", "y")
        df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
        each = of(q, "s", "x").join(df, "gram", "left")
        rare = each.groupBy("s", "x").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r")).where("r.df > 0")
        hits = rare.select("s", "x", "r.gram").join(grams, "gram").where(F.expr("instr(y, x) > 0")).select("s", "l")
        out = hits if out is None else out.unionByName(hits)
    return small.select("s").crossJoin(large.select("l").limit(0)).where("false") if out is None else out


def either_inside(a: DataFrame, b: DataFrame, key_a: str, key_b: str, text: str = "text") -> DataFrame:
    """(key_a, key_b, a_in_b, b_in_a): pairs of texts of which one stands inside the other; equal ones in both.

    Texts are compared as they are; equal texts are compared once and their keys joined back. Null and empty
    texts overlap nothing.
    """
    of = lambda df, k: df.select(F.col(k).alias("k"), F.col(text).alias("t")).where("t is not null and t <> ''")
    a, b = of(a, key_a), of(b, key_b)
    x, y = a.select("t").distinct(), b.select("t").distinct()
    one = _inside(x.select(F.col("t").alias("s"), F.col("t").alias("x")), y.select(F.col("t").alias("l"), F.col("t").alias("y"))).select(F.col("s").alias("ta"), F.col("l").alias("tb"), F.lit(True).alias("in"), F.lit(False).alias("out"))
    two = _inside(y.select(F.col("t").alias("s"), F.col("t").alias("x")), x.select(F.col("t").alias("l"), F.col("t").alias("y"))).select(F.col("l").alias("ta"), F.col("s").alias("tb"), F.lit(False).alias("in"), F.lit(True).alias("out"))
    pairs = one.unionByName(two).groupBy("ta", "tb").agg(F.max("in").alias("a_in_b"), F.max("out").alias("b_in_a"))
    return a.select(F.col("k").alias(key_a), F.col("t").alias("ta")).join(pairs, "ta").join(b.select(F.col("k").alias(key_b), F.col("t").alias("tb")), "tb").select(key_a, key_b, "a_in_b", "b_in_a")


def grounded_target(targets: DataFrame, bindings: DataFrame, key: str) -> DataFrame:
    """(key, target): the planned target span against a request's grounded spans (key, raw, raw_start).

    If exactly one grounded span stands in the target or holds it, that is the target; else the target stays as it
    was written; without one, the first grounded span is taken.
    """
    b = bindings.select(F.col(key).alias("_k"), "raw", "raw_start").distinct()
    both = targets.select(key, "target").join(b, F.col(key) == F.col("_k"), "left")
    over = F.coalesce(F.col("raw").isNotNull() & F.col("target").isNotNull() & (F.contains("target", "raw") | F.contains("raw", "target")), F.lit(False))
    g = both.groupBy(key).agg(F.first("target").alias("target"), F.count_if(over).alias("n"), F.max(F.when(over, F.col("raw"))).alias("only"), F.min_by("raw", F.struct("raw_start", "raw")).alias("first"))
    return g.select(key, F.when(F.col("target").isNull(), F.col("first")).when(F.col("n") == 1, F.col("only")).otherwise(F.col("target")).alias("target"))


def dedupe(bindings: DataFrame, key: str) -> DataFrame:
    """One row for each request, family and raw place: the variant with the smallest id."""
    w = Window.partitionBy(key, "family_id", "raw_start", "raw_end").orderBy("doc_id")
    return bindings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
