"""Intents, plans and dispatch over given evidence: ordered conditions, no model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundphrase.functions import text as tx
from groundphrase.operators.decide import first

SPAN_ACTIONS = ("ATTEST", "RESTORE_SURFACE", "EXPLAIN")


def intent(blank: Column, fictional: Column, forbids: Column, examples: Column, meta: Column, mentions: Column, exact: Column, restore: Column, attest: Column, explain: Column, noun: Column, search: Column, context: Column, indirect: Column) -> Column:
    """The signal of a request's cues, with `mentions` phrases of the corpus in it; null if there is none."""
    here = mentions > 0
    return first(
        (blank | fictional, "NONE"), (forbids, "FORCE_GENERAL"), (examples, "RETRIEVE_EXAMPLES"), (~here & meta, "FORCE_GENERAL"), (here & exact, "ATTEST"), (here & restore, "RESTORE_SURFACE"), (here & attest, "ATTEST"),
        (here & explain, "EXPLAIN"), ((noun & search & context) | indirect, "SEARCH_BY_MEANING"), otherwise="NONE",
    )


def finalize(route: Column, actions: Column, signal: Column, exact: Column, families: Column, both: Column, one_unknown: Column, target: Column) -> Column:
    """The plan that stands after the overrides, as ROUTE or FFE_REQUIRED:ACTION+ACTION.

    route and actions are the draft's; families are those that mentions bind; target is a span (or null).
    """
    strong = signal.isin(*SPAN_ACTIONS)
    required = lambda a: F.concat(F.lit("FFE_REQUIRED:"), a)
    joined = F.array_join(actions, "+")
    single = F.when(F.size(actions) == 1, F.get(actions, F.lit(0)))
    has_target = target.isNotNull() | (families > 0)
    span = F.exists(actions, lambda a: a.isin(*SPAN_ACTIONS))
    return (
        F.when(signal == "FORCE_GENERAL", "GENERAL")
        .when(exact & (route != "GENERAL"), required(F.lit("ATTEST")))
        .when((signal == "RESTORE_SURFACE") & (families > 0) & ~exact, required(F.lit("RESTORE_SURFACE")))
        .when((route == "CLARIFY") & (families >= 2) & strong & both & ~one_unknown, required(signal))
        .when((route == "GENERAL") & (signal != "NONE"), required(signal))
        .when((route == "FFE_REQUIRED") & single.isNotNull() & (single != "RETRIEVE_EXAMPLES") & (signal != "NONE") & (single != signal) & (~strong | has_target), required(signal))
        .when(route.isin("GENERAL", "CLARIFY"), route)
        .when(span & ~has_target, "CLARIFY")
        .otherwise(required(joined))
    )


def dispatch(route: Column, actions: Column, blank: Column, valid: Column) -> Column:
    """Which operator answers: one of the search, attest and surface paths, or a final state."""
    n, one = F.size(actions), F.get(actions, F.lit(0))
    pair = (n == 2) & F.array_contains(actions, "ATTEST") & F.array_contains(actions, "EXPLAIN")
    return first(
        (blank | ~valid, "ABSTAIN"), (route == "GENERAL", "PASS_THROUGH"), (route == "CLARIFY", "CLARIFY"), (n == 0, "ABSTAIN"), (pair, "attest"), (n > 1, "ABSTAIN"), (one == "SEARCH_BY_MEANING", "meaning-search"),
        (one == "RETRIEVE_EXAMPLES", "exactly-n"), (one == "RESTORE_SURFACE", "restore"), (one == "ATTEST", "attest"), (one == "EXPLAIN", "explain"), otherwise="ABSTAIN",
    )


def multi_surface(families: Column, both: Column, one_unknown: Column, scope: Column) -> Column:
    """What several mentions give: not applicable, ask, or accept all or the selected ones. scope may be null."""
    return first((families < 2, "NOT_APPLICABLE"), (one_unknown, "CLARIFY"), (both, "ACCEPT_ALL"), (scope.isNull() | (scope == "CLARIFY"), "CLARIFY"), (scope == "SELECTED", "ACCEPT_SELECTED"), otherwise="CLARIFY")


def runtime_state(kind: Column, status: Column) -> Column:
    """The final state of a search or attestation result; clarifying shows no alternatives."""
    return first(
        ((kind == "search") & (status == "ACCEPT"), "ACCEPT"), ((kind == "search") & (status == "CLARIFY"), "CLARIFY"), ((kind == "attest") & (status == "ATTESTED"), "ACCEPT"), ((kind == "attest") & (status == "NEEDS_CLARIFICATION"), "CLARIFY"),
        (kind == "attest", "NOT_ATTESTED_IN_CURRENT_CORPUS"), otherwise="ABSTAIN",
    )


def spans_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The shared part of two spans over the shorter one."""
    shared = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return shared / F.greatest(F.lit(1), F.least(a_end - a_start, b_end - b_start))


def views(families: DataFrame, labels: tuple[str, str, str] = ("", "situation: ", "phrase: ")) -> DataFrame:
    """(family_id, view, n, text): a family's gloss, its gloss as a situation, phrase and gloss, and each reviewed
    keyword list, scenario, paraphrase and usage note; equal texts once, in this order.

    families has family_id, gloss, canonical and, if reviewed, the arrays keywords, scenarios, paraphrases, usage_notes.
    """
    one = lambda name, text: F.array(F.struct(F.lit(name).alias("view"), text.alias("text")))
    many = lambda name, col: F.transform(F.coalesce(col, F.array().cast("array<string>")), lambda t, i: F.struct(F.concat(F.lit(f"{name}-"), (i + 1).cast("string")).alias("view"), t.alias("text")))
    parts = [one("gloss", F.concat(F.lit(labels[0]), "gloss")), one("scenario-from-gloss", F.concat(F.lit(labels[1]), "gloss")), one("canonical-plus-gloss", F.concat(F.lit(labels[2]), "canonical", F.lit("\n"), "gloss"))]
    if "keywords" in families.columns:
        parts.append(F.when(F.size("keywords") > 0, one("reviewed-keywords", F.array_join("keywords", ", "))).otherwise(F.array().cast("array<struct<view:string,text:string>>")))
        parts += [many(f"reviewed-{n}", F.col(c)) for n, c in (("scenario", "scenarios"), ("paraphrase", "paraphrases"), ("usage", "usage_notes"))]
    rows = families.select("family_id", F.posexplode(F.concat(*parts)).alias("n", "v")).select("family_id", "n", "v.view", F.trim("v.text").alias("text")).where("text <> ''")
    kept = rows.groupBy("family_id", "text").agg(F.min(F.struct("n", "view")).alias("m"))
    return kept.select("family_id", "m.view", F.col("m.n").cast("long").alias("n"), "text")


def render(template: Column, texts: Column) -> Column:
    """A template with [[1]], [[2]] … replaced by corpus texts; a slot that stays or isn't there once is an error."""
    slots = F.transform(texts, lambda t, i: F.struct(F.concat(F.lit("[["), (i + 1).cast("string"), F.lit("]]")).alias("slot"), t.alias("text")))
    done = F.aggregate(slots, template, lambda a, s: F.replace(a, s.slot, s.text))
    used = F.array_sort(F.regexp_extract_all(template, F.lit(r"\[\[(\d+)\]\]"), F.lit(0)))
    return F.when(used == F.array_sort(F.transform(slots, lambda s: s.slot)), done).otherwise(F.raise_error(F.concat(F.lit("slots don't match: "), template)))


def leaked(text: Column, surfaces: Column, allowed: Column) -> Column:
    """Corpus phrases that stand in a text without being among the allowed ones (normalized, whole words)."""
    plain = F.concat(F.lit(" "), tx.retrieval(text), F.lit(" "))
    return F.filter(F.array_except(surfaces, allowed), lambda s: F.contains(plain, F.concat(F.lit(" "), s, F.lit(" "))))


def scored(runs: DataFrame) -> DataFrame:
    """Add decision, runtime, route, action and family matches and their conjunction to runs joined with gold.

    Without expected actions any action is right; without target families that match is null and doesn't count.
    """
    action = (F.size("expected_actions_any") == 0) | F.arrays_overlap("actions", "expected_actions_any")
    family = F.when(F.size("target_family_ids") > 0, F.arrays_overlap("families", "target_family_ids"))
    out = runs.withColumns({
        "decision_match": F.col("decision") == F.col("expected_response_decision"), "runtime_match": F.col("runtime_decision") == F.col("expected_runtime_decision"),
        "route_match": F.col("route").eqNullSafe(F.col("expected_route")), "action_match": F.coalesce(action, F.lit(False)), "family_match": family,
    })
    return out.withColumn("automatic_e2e", F.col("decision_match") & F.col("runtime_match") & F.col("route_match") & F.col("action_match") & F.coalesce("family_match", F.lit(True)))
