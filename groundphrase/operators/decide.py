"""Decisions over rankings and evidence, and routes, as ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds (fixed values).
SURFACE, SURFACE_MARGIN, MEANING, MEANING_MARGIN = 0.86, 0.03, 0.30, 0.05
LOCAL, LOCAL_MARGIN = 0.72, 0.04


def first(*cases: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The value of the first condition that holds; unknown conditions don't."""
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(F.lit(otherwise))


def surface_agreement(top: Column, margin: Column, n_compact: Column, n_tokens: Column, tfidf: Column, cov: Column, bm25: Column, fuzzy: Column, supported: Column) -> Column:
    """Independent evidence that accepts a middling score: by edits, or by words the candidate supports."""
    edit = (n_compact >= 10) & (tfidf >= 0.18) & (cov >= 0.58) & (fuzzy >= 0.85)
    words = supported & (n_tokens >= 3) & (tfidf >= 0.35) & (cov >= 0.60) & (bm25 >= 0.60)
    return (top >= 0.60) & (margin >= 0.10) & (n_compact >= 8) & (edit | words)


def surface_reason(blank: Column, top: Column, margin: Column, families: Column, agree: Column, strong_spans: Column, local: Column) -> Column:
    """The rule that decides a surface request. top is null without candidates."""
    return first(
        (blank, "empty-query"), (top.isNull(), "no-overlap"), (families >= 2, "multiple-attested-expressions"), ((top >= SURFACE) & (margin >= SURFACE_MARGIN), "score-and-margin-passed"),
        (agree, "surface-evidence-agreement"), (strong_spans, "multiple-local-surface-expressions"), (local, "local-surface-evidence-agreement"), (top >= SURFACE, "small-ranking-margin"), otherwise="insufficient-surface-evidence",
    )


def meaning_reason(blank: Column, top: Column, margin: Column, anchored: Column) -> Column:
    return first(
        (blank, "empty-query"), (top.isNull(), "no-overlap"), ((top >= MEANING) & ~anchored, "insufficient-meaning-content-anchor"), ((top >= MEANING) & (margin >= MEANING_MARGIN), "score-and-margin-passed"),
        (top >= MEANING, "small-ranking-margin"), otherwise="low-score",
    )


def decision(reason: Column) -> Column:
    return first(
        (reason.isin("score-and-margin-passed", "surface-evidence-agreement", "local-surface-evidence-agreement"), "ACCEPT"),
        (reason.isin("multiple-attested-expressions", "multiple-local-surface-expressions", "small-ranking-margin"), "CLARIFY"), otherwise="ABSTAIN",
    )


def explicit_route(blank: Column, attestation: Column, surface: Column, meaning: Column, technical: Column) -> Column:
    """Task and reason as "TASK:reason"; null asks for probes."""
    return first(
        (blank, "CLARIFY:empty-query"), (attestation, "ATTESTATION:explicit-cue"), (surface & ~meaning, "SURFACE:explicit-cue"), (meaning & ~surface, "MEANING:explicit-cue"),
        (surface & meaning, "CLARIFY:conflicting-explicit-task-cues"), (technical, "CLARIFY:technical-out-of-domain-guard"),
    )


def probe_route(n: Column, s: Column, s_dec: Column, s_margin: Column, m: Column, m_dec: Column, scaffold: Column) -> Column:
    """The eleven probe rules: n tokens, surface and meaning scores and decisions."""
    a, c, x = (lambda d: d == "ACCEPT"), (lambda d: d == "CLARIFY"), (lambda d: d == "ABSTAIN")
    weak = c(m_dec) & x(s_dec)
    return first(
        ((n <= 10) & (s >= 0.75) & (s >= m + 0.15), "SURFACE:surface-strong-probe"), (a(s_dec) & ~a(m_dec), "SURFACE:surface-only-accept"), (a(m_dec) & ~a(s_dec), "MEANING:meaning-only-accept"),
        (a(s_dec) & a(m_dec) & (n <= 10) & (s >= 0.60), "SURFACE:surface-phrase-both-accept"), (a(s_dec) & a(m_dec), "CLARIFY:both-tasks-accept"), (c(s_dec) & x(m_dec), "SURFACE:surface-only-clarify"),
        (weak & (((n >= 6) & scaffold) | ((m >= 0.50) & (m >= s + 0.15))), "MEANING:meaning-clarify-probe"), (weak & (n <= 6) & (s >= 0.60) & (s >= m + 0.20), "SURFACE:surface-fragment-over-weak-meaning"),
        (weak, "CLARIFY:weak-meaning-clarify"), ((n <= 6) & (s >= 0.55) & (s >= m + 0.15) & ((s_margin >= 0.08) | (s >= 0.70)), "SURFACE:surface-fragment-probe"), otherwise="CLARIFY:insufficient-task-evidence",
    )


def gate(primary: Column, veto: Column) -> Column:
    """Two-stage verdict: only SUPPORTED consults the veto; anything but its support is UNCERTAIN. Null is an error."""
    return F.when(primary.isNull(), "UNCERTAIN").when(primary != "SUPPORTED", primary).when(veto == "SUPPORTED", "SUPPORTED").otherwise("UNCERTAIN")


def resolve(n_supported: Column) -> Column:
    return first((n_supported == 1, "ACCEPT"), (n_supported > 1, "CLARIFY"), otherwise="ABSTAIN")


def search_violation(dec: Column, has_match: Column, n_alternatives: Column) -> Column:
    """What a result breaks, or null: ACCEPT has a match, CLARIFY alternatives and no match, ABSTAIN neither."""
    return first(
        ((dec == "ACCEPT") & ~has_match, "accept-without-match"), ((dec == "CLARIFY") & (n_alternatives == 0), "clarify-without-alternatives"), ((dec == "CLARIFY") & has_match, "clarify-with-match"),
        ((dec == "ABSTAIN") & (has_match | (n_alternatives > 0)), "abstain-with-content"),
    )


def plan_violation(route: Column, actions: Column, target: Column, semantic: Column, n: Column) -> Column:
    """What a plan breaks, or null. actions is an array of strings."""
    has = lambda *names: F.arrays_overlap(actions, F.array(*map(F.lit, names)))
    span = has("ATTEST", "RESTORE_SURFACE", "EXPLAIN")
    return first(
        ((route != "FFE_REQUIRED") & (F.size(actions) > 0), "actions-without-route"), ((route == "FFE_REQUIRED") & (F.size(actions) == 0), "route-without-actions"), (span & target.isNull(), "span-action-without-target"),
        (has("SEARCH_BY_MEANING") & semantic.isNull(), "search-without-description"), (has("RETRIEVE_EXAMPLES") & (F.coalesce(n, F.lit(0)) < 1), "examples-without-count"),
    )
