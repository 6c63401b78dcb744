"""The engine's entry: policies as values, rankings, decisions with all their branches, and automatic dispatch."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundphrase.functions import cues
from groundphrase.functions import fuzzy as fz
from groundphrase.functions import text as tx
from groundphrase.operators import decide, index, lexical, local, plan, semantic, store, verify
from groundphrase.operators.attest import attest


@dataclass(frozen=True)
class Policy:
    """Thresholds (fixed values as defaults) of the decisions, and words that a remembered phrase may have too many."""

    fillers: tuple[str, ...] = ("فلان", "دیگه", "دیگر")
    candidates: int = 10
    local: float = 0.72
    local_margin: float = 0.04
    window_tokens: int = 3
    short_candidate: int = 4
    strong: float = 0.85
    strong_overlap: float = 0.20
    alternatives: int = 3

    def __post_init__(self):
        if self.candidates < 1 or self.alternatives < 1 or not all(0 <= x <= 1 for x in (self.local, self.local_margin, self.strong, self.strong_overlap)):
            raise ValueError("a policy's counts are at least 1, its scores from 0 to 1")


class Retriever(Protocol):
    """requests (query_id, text) and a corpus in, (query_id, doc_id, score, rank, ...) out."""

    def __call__(self, requests: DataFrame, docs: DataFrame) -> DataFrame: ...


class Verifier(Protocol):
    """pairs (query_id, family_id, text, gloss) in, (query_id, family_id, content) with a JSON answer each out."""

    def __call__(self, pairs: DataFrame) -> DataFrame: ...


class Planner(Protocol):
    """requests in, (query_id, route, actions, target) out; a missing row is an invalid plan."""

    def __call__(self, requests: DataFrame) -> DataFrame: ...


def factory(spec: str) -> Callable:
    """The callable that "module:function" names."""
    module, mark, name = spec.partition(":")
    if not mark or not module or not name:
        raise ValueError("a factory is named as module:function")
    got = getattr(importlib.import_module(module), name)
    if not callable(got):
        raise TypeError(f"{spec} can't be called")
    return got


#: Letters that a quoted phrase has at least to be taken for what is asked (a fixed value).
LEAST_QUOTED = 6


def unwrapped(requests: DataFrame) -> DataFrame:
    """Requests with the only phrase that is quoted in a wrapper in place of the whole text."""
    text = F.coalesce(tx.single_quoted(F.col("text"), f"(?U){cues.WRAPPER}", LEAST_QUOTED), F.col("text"))
    return requests.withColumn("text", text)


def surface_ranking(requests: DataFrame, variants: DataFrame, indexes: lexical.Indexes | None = None) -> DataFrame:
    """(query_id, doc_id, family_id, tfidf, coverage, bm25, fuzzy, score, rank), one row for each family: exact matches,
    else partial ones, else fused evidence with fuzzy reranking. Only open requests reach the costly steps."""
    sure = lexical.surface(requests, variants)
    sure = store.stored(sure, "exact")
    rest = requests.join(sure.select("query_id").distinct(), "query_id", "left_anti")
    near = local.fuzzy_rerank(index.ranked(lexical.fused(rest, variants, indexes=indexes)), rest, variants)
    zero = [F.lit(0.0).alias(c) for c in ("tfidf", "coverage", "bm25", "fuzzy")]
    both = near.select("query_id", "doc_id", "tfidf", "coverage", "bm25", "fuzzy", "score").unionByName(sure.select("query_id", "doc_id", *zero, "score"))
    return lexical.best_of_family(index.ranked(both), variants)


def surface_evidence(pairs: DataFrame, requests: DataFrame, variants: DataFrame, indexes: lexical.Indexes | None = None) -> DataFrame:
    """Add tfidf, coverage, bm25 and fuzzy to pairs (query_id, doc_id), without pruning: 0 where there is none."""
    wanted = pairs.select("query_id", "doc_id").distinct()
    e = lexical.evidence(requests.join(wanted.select("query_id").distinct(), "query_id", "left_semi"), variants, None, wanted, indexes)
    texts = requests.select("query_id", tx.retrieval(F.col("text")).alias("_q"))
    docs = variants.select("doc_id", tx.retrieval(F.col("text")).alias("_d"))
    out = pairs.join(e, ["query_id", "doc_id"], "left").join(texts, "query_id").join(docs, "doc_id").withColumn("fuzzy", fz.fuzzy_evidence("_q", "_d")).drop("_q", "_d")
    return out.fillna(0.0, ["tfidf", "coverage", "bm25", "fuzzy"])


def _local(requests: DataFrame, variants: DataFrame, ranked: DataFrame, p: Policy, indexes: lexical.Indexes | None = None) -> DataFrame:
    """(query_id, strong_spans, local_ok, local_doc, local_score): what windows of the open requests say."""
    a = local.align(ranked, requests, variants, p.candidates, indexes).join(variants.select("doc_id", "family_id", F.col("text").alias("found")), "doc_id")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("end") - F.col("start"), "doc_id")
    a = a.withColumn("nth", F.row_number().over(w)).where("nth <= 2")
    two = a.groupBy("query_id").agg(*(F.max_by(F.struct("doc_id", "start", "end", "text", "found", "score"), F.col("nth") == k).alias(n) for k, n in ((1, "x"), (2, "y"))), F.count(F.lit(1)).alias("k"))
    two = two.join(requests.select("query_id", F.col("text").alias("request")), "query_id")
    second = F.when(F.col("k") > 1, F.col("y.score")).otherwise(0.0)
    toks = lambda c: tx.tokens(tx.retrieval(c))
    nw, nc, nq = F.size(toks(F.col("x.text"))), F.size(toks(F.col("x.found"))), F.size(toks(F.col("request")))
    after = F.size(toks(F.expr("substring(request, x.end + 1)")))
    wt, ct = toks(F.col("x.text")), toks(F.col("x.found"))
    held = F.array_position(ct, F.get(wt, F.lit(0)))
    in_order = (held > 0) & (F.array_position(ct, F.get(wt, F.lit(1))) > held)
    specific = (nw >= p.window_tokens) | ((nw == 2) & (nc <= p.short_candidate) & in_order)
    wrapped = semantic.wrapped(F.col("x.start"), F.col("x.end"), F.col("request"), nq, nc, nw, after)
    strong = (F.col("k") > 1) & (F.col("x.score") >= p.strong) & (second >= p.strong) & (plan.spans_overlap(F.col("x.start"), F.col("x.end"), F.col("y.start"), F.col("y.end")) <= p.strong_overlap)
    ok = wrapped & specific & (F.col("x.score") >= p.local) & (F.col("x.score") - second >= p.local_margin)
    return two.select("query_id", strong.alias("strong_spans"), ok.alias("local_ok"), F.col("x.doc_id").alias("local_doc"), F.col("x.score").alias("local_score"))


def decide_surface(requests: DataFrame, variants: DataFrame, ranked: DataFrame, policy: Policy | None = None, use_local: bool = True, indexes: lexical.Indexes | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(query_id, reason, decision, doc_id, score, margin) of each request over a ranking with evidence. asked: the same
    requests with what was ranked in place of the whole text, where that differs."""
    p = policy or Policy()
    ranked = store.stored(ranked, "ranking")
    top = lexical.top_two(ranked).join(variants.select("doc_id", F.col("text").alias("found")), "doc_id")
    top = surface_evidence(top, requests if asked is None else asked, variants, indexes)
    fams = lexical.contained(requests, variants).groupBy("query_id").agg(F.count_distinct("family_id").alias("families"))
    d = requests.select("query_id", "text").join(top, "query_id", "left").join(fams, "query_id", "left")
    d = d.withColumn("r", tx.retrieval(F.col("text"))) if asked is None else d.join(asked.select("query_id", tx.retrieval(F.col("text")).alias("r")), "query_id")
    toks = tx.tokens(F.col("r"))
    open_words = F.array_except(F.array_except(toks, tx.tokens(tx.retrieval(F.col("found")))), F.array(*map(F.lit, p.fillers)))
    agree = decide.surface_agreement(F.col("top"), F.col("margin"), F.length(tx.compact(F.col("r"))), F.size(toks), F.col("tfidf"), F.col("coverage"), F.col("bm25"), F.col("fuzzy"), F.size(open_words) == 0)
    d = d.select("query_id", "text", "doc_id", "top", "margin", F.coalesce("families", F.lit(0)).alias("families"), F.coalesce(agree, F.lit(False)).alias("agree"))
    blank, no = F.trim(F.coalesce("text", F.lit(""))) == "", F.lit(False)
    if not use_local:
        reason = decide.surface_reason(blank, F.col("top"), F.col("margin"), F.col("families"), F.col("agree"), no, no)
        return d.select("query_id", reason.alias("reason"), "doc_id", F.col("top").alias("score"), "margin").withColumn("decision", decide.decision(F.col("reason")))
    d = store.stored(d.withColumn("early", decide.surface_reason(blank, F.col("top"), F.col("margin"), F.col("families"), F.col("agree"), no, no)), "decisions")
    open_ = d.where(F.col("early").isin("small-ranking-margin", "insufficient-surface-evidence")).select("query_id", "text")
    l = _local(open_, variants, ranked.join(open_.select("query_id"), "query_id", "left_semi"), p, indexes)  # noqa: E741
    d = d.join(l, "query_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    reason = decide.surface_reason(blank, F.col("top"), F.col("margin"), F.col("families"), F.col("agree"), yes("strong_spans"), yes("local_ok"))
    d = d.withColumn("reason", reason)
    by_window = F.col("reason") == "local-surface-evidence-agreement"
    return d.select("query_id", "reason", F.when(by_window, F.col("local_doc")).otherwise(F.col("doc_id")).alias("doc_id"), F.when(by_window, F.col("local_score")).otherwise(F.col("top")).alias("score"), "margin", decide.decision(F.col("reason")).alias("decision"))


#: What BM25 of words adds to a gloss that trigrams have found (a fixed value).
GLOSS_BONUS = 0.05


def meaning_ranking(requests: DataFrame, glosses: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, tfidf, bm25, score, rank): glosses that trigrams find, by their cosine, a little lifted where
    words agree too. Words alone bring no gloss in. k: the best of each request."""

    def best(s: DataFrame) -> DataFrame:
        s = s.where("tfidf is not null").fillna(0.0, ["bm25"]).withColumn("score", lexical.rescore(F.col("tfidf"), F.col("bm25"), GLOSS_BONUS))
        return index.ranked(s.where("score > 0"), k=k)

    s = lexical.scores(requests, glosses, "tb", None if k is None else best)
    return (best(s) if k is None else s).select("query_id", "doc_id", "tfidf", "bm25", "score", "rank")


def decide_meaning(requests: DataFrame, glosses: DataFrame, ranked: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """(query_id, reason, decision, doc_id, score, margin): a result needs a content word that request and gloss share."""
    d = requests.select("query_id", "text").join(lexical.top_two(ranked), "query_id", "left").join(glosses.select("doc_id", F.col("text").alias("gloss")), "doc_id", "left")
    anchored = tx.meaning_evidence(F.col("text"), F.coalesce("gloss", F.lit("")), stop).anchored
    reason = decide.meaning_reason(F.trim(F.coalesce("text", F.lit(""))) == "", F.col("top"), F.col("margin"), anchored)
    return d.select("query_id", reason.alias("reason"), "doc_id", F.col("top").alias("score"), "margin").withColumn("decision", decide.decision(F.col("reason")))


def auto(requests: DataFrame, surface: DataFrame, meaning: DataFrame, attested: DataFrame, explicit: Column | None = None, scaffold: Column | None = None) -> DataFrame:
    """(query_id, task, reason, decision): one task for each request. Explicit wording decides; else the surface and
    meaning decisions are probes. Attestation is never inferred from similarity.

    surface and meaning: (query_id, decision, score, margin); attested: (query_id, status); explicit: a route
    over `text`, null where it says nothing; scaffold: that a meaning is described. By default the cues of both.
    """
    if explicit is None:
        x = cues.explicit(F.col("text"))
        explicit = decide.explicit_route(F.trim(F.coalesce("text", F.lit(""))) == "", x["attestation"], x["surface"], x["meaning"], x["technical"])
    of = lambda df, k: df.select("query_id", *(F.col(c).alias(f"{k}_{c}") for c in ("decision", "score", "margin") if c in df.columns))
    n = F.size(tx.tokens(tx.retrieval(F.col("text"))))
    d = requests.select("query_id", "text", explicit.alias("explicit"), n.alias("n"), (cues.scaffold(F.col("text")) if scaffold is None else scaffold).alias("scaffold"))
    d = d.join(of(surface, "s"), "query_id", "left").join(of(meaning, "m"), "query_id", "left").join(attested.select("query_id", "status"), "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    probe = decide.probe_route(F.col("n"), zero("s_score"), F.coalesce("s_decision", F.lit("ABSTAIN")), zero("s_margin"), zero("m_score"), F.coalesce("m_decision", F.lit("ABSTAIN")), F.col("scaffold"))
    route = F.split(F.coalesce("explicit", probe), ":")
    d = d.withColumn("task", F.get(route, F.lit(0))).withColumn("reason", F.get(route, F.lit(1)))
    result = F.when(F.col("task") == "ATTESTATION", plan.runtime_state(F.lit("attest"), F.col("status"))).when(F.col("task") == "SURFACE", F.col("s_decision")).when(F.col("task") == "MEANING", F.col("m_decision")).otherwise("CLARIFY")
    return d.select("query_id", "task", "reason", result.alias("decision"))


class Engine:
    """A corpus (variants: doc_id, family_id, text; glosses: doc_id, family_id, text) that requests are put to."""

    def __init__(self, variants: DataFrame, glosses: DataFrame, policy: Policy | None = None, surface: Retriever = surface_ranking, meaning: Retriever = meaning_ranking):
        self.variants, self.glosses, self.policy = variants, glosses, policy or Policy()
        self.retrievers = {"surface": surface, "meaning": meaning}
        self.indexes = lexical.Indexes(variants)

    def attest(self, requests: DataFrame) -> DataFrame:
        return attest(requests, self.variants)

    def surface(self, requests: DataFrame, use_local: bool = True) -> DataFrame:
        """What stands quoted in a wrapper is looked for alone; else the whole request is."""
        own, asked = self.retrievers["surface"], unwrapped(requests)
        ranked = own(asked, self.variants, self.indexes) if own is surface_ranking else own(asked, self.variants)
        return decide_surface(requests, self.variants, ranked, self.policy, use_local, self.indexes, asked)

    def alternatives(self, requests: DataFrame) -> DataFrame:
        """(query_id, n_families, alternatives) of requests in which several phrases stand."""
        return verify.alternatives(lexical.contained(requests, self.variants), k=self.policy.alternatives)

    def verify(self, pairs: DataFrame, verifier: Verifier, verifier_id: str = "semantic-verifier") -> DataFrame:
        return verify.verify(pairs, verifier, verifier_id)

    def meaning(self, requests: DataFrame) -> DataFrame:
        return decide_meaning(requests, self.glosses, self.retrievers["meaning"](requests, self.glosses))

    def auto(self, requests: DataFrame, explicit: Column | None = None) -> DataFrame:
        """Probes don't use windows: these verify, they don't detect a task."""
        return auto(requests, self.surface(requests, use_local=False), self.meaning(requests), self.attest(requests), explicit)
