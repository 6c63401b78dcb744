"""Verification of candidate pairs by an injected verifier: suitability first, strict answers, errors as uncertain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundphrase.functions import cues

VERDICTS = ("SUPPORTED", "NOT_SUPPORTED", "UNCERTAIN")
#: Alternatives that a request for clarification names (a fixed value).
ALTERNATIVES = 3


def payload(content: Column, verdicts: tuple[str, ...] = VERDICTS) -> Column:
    """A verifier's JSON answer as a struct (verdict, reason, problem). It is an object with a known verdict and perhaps a
    reason, and nothing else; whatever differs has a problem and no verdict. Null is no answer."""
    v, keys = F.try_parse_json(content), F.json_object_keys(content)
    extra = F.array_sort(F.array_except(keys, F.array(F.lit("verdict"), F.lit("reason"))))
    verdict = F.try_variant_get(v, "$.verdict", "string")
    problem = (
        F.when(content.isNull(), "no answer").when(v.isNull(), "invalid JSON").when(keys.isNull(), "not an object").when(F.size(extra) > 0, F.concat(F.lit("forbidden "), F.array_join(extra, ",")))
        .when(~F.array_contains(keys, "verdict"), "no verdict").when(verdict.isNull() | ~verdict.isin(*verdicts), "unknown verdict")
    )
    return F.struct(F.when(problem.isNull(), verdict).alias("verdict"), F.when(problem.isNull(), F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit(""))).alias("reason"), problem.alias("problem"))


def verify(pairs: DataFrame, verifier, verifier_id: str = "semantic-verifier") -> DataFrame:
    """(query_id, family_id, verdict, verifier_id, reason) of each pair (query_id, family_id, text, phrase, gloss).

    A phrase that doesn't suit its request is NOT_SUPPORTED by policy, and no verifier sees it. The verifier gets
    the other pairs without their phrases (query_id, family_id, text, gloss) and returns (query_id, family_id,
    content); a missing answer and one with a problem are UNCERTAIN, and the problem is the reason.
    Pairs are unique by query_id and family_id; of several answers to one the smallest counts.
    """
    p = pairs.withColumn("_no", F.coalesce(cues.unsuitable(F.col("phrase"), F.col("text")), F.lit(False)))
    asked = p.where(~F.col("_no")).select("query_id", "family_id", "text", "gloss")
    answers = verifier(asked).groupBy("query_id", "family_id").agg(F.min("content").alias("content"))
    both = p.join(answers, ["query_id", "family_id"], "left").withColumn("_a", payload(F.col("content")))
    verdict = F.when(F.col("_no"), "NOT_SUPPORTED").otherwise(F.coalesce("_a.verdict", F.lit("UNCERTAIN")))
    who = F.when(F.col("_no"), f"{verifier_id}+recommendation-policy").otherwise(verifier_id)
    reason = F.when(F.col("_no"), "unsuitable-register").when(F.col("_a.problem").isNotNull(), F.concat(F.lit("verifier-error:"), "_a.problem")).otherwise(F.col("_a.reason"))
    return both.select("query_id", "family_id", verdict.alias("verdict"), who.alias("verifier_id"), reason.alias("reason"))


def alternatives(contained: DataFrame, key: str = "query_id", k: int = ALTERNATIVES) -> DataFrame:
    """(key, n_families, alternatives): the first k families that stand in a request with two or more, by their place,
    then by name. A limit is the feature here."""
    w = Window.partitionBy(key).orderBy("first_pos", "family_id")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    c = contained.withColumn("_nth", F.row_number().over(w)).withColumn("n_families", n).where(F.col("n_families") >= 2)
    some = F.transform(F.array_sort(F.collect_list(F.when(F.col("_nth") <= k, F.struct("_nth", "family_id")))), lambda x: x.family_id)
    return c.groupBy(key).agg(F.first("n_families").alias("n_families"), some.alias("alternatives"))


#: Slots of a drafted answer, and quotation marks that it may not have (fixed values).
SLOT, QUOTES = r"<FFE_\d+>", "«»“”„‟\"`"


def template_problem(template: Column, slots: Column) -> Column:
    """What a drafted template breaks, or null: it has all the slots that it was given and no others, each once, and quotes
    nothing. Null templates are empty ones."""
    t = F.coalesce(template, F.lit(""))
    used = F.regexp_extract_all(t, F.lit(SLOT), F.lit(0))
    differ = (F.size(F.array_except(used, slots)) > 0) | (F.size(F.array_except(slots, used)) > 0)
    return F.when(differ, "missing or unknown slots").when(F.size(used) != F.size(F.array_distinct(used)), "a slot twice").when(F.translate(t, QUOTES, "") != t, "quotes")


def template_violations(templates: DataFrame, surfaces: DataFrame, key: str) -> DataFrame:
    """(key, problem) of templates (key, template, slots) that break a rule, or else hold a stored surface outside a slot."""
    from groundphrase.operators.mentions import leaks

    own = templates.select(key, template_problem(F.col("template"), F.col("slots")).alias("problem"))
    held = leaks(templates.select(key, F.col("template").alias("text")), surfaces, key).select(F.col(key).alias("_k")).distinct()
    both = own.join(held, F.col(key) == F.col("_k"), "left")
    return both.select(key, F.coalesce("problem", F.when(F.col("_k").isNotNull(), "stored text outside a slot")).alias("problem")).where("problem is not null")


def target_problem(target: Column, request: Column) -> Column:
    """A planned target is copied from its request letter by letter, or there is none."""
    return F.when(target.isNotNull() & ~F.coalesce(F.contains(request, target), F.lit(False)), "target is not in the request")
