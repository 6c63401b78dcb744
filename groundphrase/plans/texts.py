"""Queries over text normalization, the corpus and its data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundphrase.functions import cues
from groundphrase.functions import text as tx
from groundphrase.operators import quality as dq
from groundphrase.plans import bindings as b
from groundphrase.plans.bindings import VIEWS, compact, grams, norm

DOCS = ("documents", "doc_id")
STOP = ["the", "of", "and"]

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, sf):
    return b.table(spark, sf, "documents")


@query(r"SELECT doc_id, trim(regexp_replace(text, '[ \t]+', ' ', 'g')) AS shown FROM documents")
def norm_display(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.display(F.col("text")).alias("shown"))


@query(f"SELECT doc_id, {norm('text')} AS r FROM documents")
def norm_retrieval(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.retrieval(F.col("text")).alias("r"))


@query(f"SELECT doc_id, {compact('text')} AS c, length({compact('text')})::BIGINT AS n FROM documents")
def norm_compact(spark, sf):
    c = tx.compact(tx.retrieval(F.col("text")))
    return _docs(spark, sf).select("doc_id", c.alias("c"), F.length(c).cast("long").alias("n"))


@query(f"SELECT doc_id, len(list_filter(string_split({norm('text')}, ' '), lambda x: x <> ''))::BIGINT AS n_tokens, list_filter(string_split({norm('text')}, ' '), lambda x: x <> '')[1] AS head FROM documents")
def tokens(spark, sf):
    t = _docs(spark, sf).select("doc_id", tx.tokens(tx.retrieval(F.col("text"))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.get("t", F.lit(0)).alias("head"))


@query(f"SELECT g AS gram, count(*)::BIGINT AS n FROM (SELECT unnest({grams(norm('text'), 3)}) AS g FROM benchmark) GROUP BY g")
def char_trigrams(spark, sf):
    return b.table(spark, sf, "benchmark").select(F.explode(tx.char_ngrams(tx.retrieval(F.col("text")))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT item_id, len(list_distinct({grams(compact('text'), 2)}))::BIGINT AS n_bigrams FROM benchmark")
def bigram_sets(spark, sf):
    return b.table(spark, sf, "benchmark").select("item_id", F.size(tx.bigram_set(tx.compact(tx.retrieval(F.col("text"))))).cast("long").alias("n_bigrams"))


@query(f"SELECT doc_id, len(list_distinct(list_filter(string_split({norm('text')}, ' '), lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[A-Za-z0-9_+./:-]+') AND NOT list_contains(['the', 'of', 'and'], x))))::BIGINT AS n FROM documents")
def content_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(tx.content_tokens(tx.tokens(tx.retrieval(F.col("text"))), STOP)).cast("long").alias("n"))


@query(r"""SELECT conv_id, turn, regexp_matches(text, '(?i)\b(what|which)\b') AS asks, regexp_matches(text, '\d') AS has_digit, len(regexp_extract_all(text, '"([^"]+)"', 1))::BIGINT AS n_quoted FROM conversations""")
def cue_flags(spark, sf):
    c = b.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.col("text").rlike(r"(?i)\b(what|which)\b").alias("asks"), F.col("text").rlike(r"\d").alias("has_digit"), F.size(F.regexp_extract_all("text", F.lit('"([^"]+)"'), F.lit(1))).cast("long").alias("n_quoted"))


@query(f"WITH {VIEWS} SELECT query_id, CASE WHEN len(q) = 1 AND regexp_matches(text, 'say') AND length({compact('q[1]')}) >= 6 THEN q[1] END AS span FROM (SELECT query_id, 'they say \"' || text || '\"' AS text, regexp_extract_all('they say \"' || text || '\"', '\"([^\"]+)\"', 1) AS q FROM requests)")
def quoted_span(spark, sf):
    r = b.requests(spark, sf).withColumn("text", F.concat(F.lit('they say "'), "text", F.lit('"')))
    return r.select("query_id", tx.single_quoted(F.col("text"), "say", 6).alias("span"))


@query(r"SELECT doc_id, replace(replace(replace(text, 'tion', '[x]'), 'the', '[x]'), 'er', '[x]') AS redacted FROM documents")
def redact_surfaces(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.redact(F.col("text"), F.array(F.lit("er"), F.lit("tion"), F.lit("the")), "[x]").alias("redacted"))


@query("SELECT conv_id, turn, FALSE AS attestation, FALSE AS meaning, FALSE AS surface, regexp_matches(' ' || trim(regexp_replace(lower(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[^\\p{L}\\p{N} ]', '', 'g')), ' +', ' ', 'g')) || ' ', ' [a-z0-9]+ ') AS technical FROM conversations")
def explicit_cues(spark, sf):
    return b.table(spark, sf, "conversations").select("conv_id", "turn", *(e.alias(k) for k, e in cues.explicit(F.col("text")).items()))


@query(f"WITH {VIEWS} SELECT * FROM variants")
def variants_flat(spark, sf):
    return b.variants(spark, sf)


@query(f"WITH {VIEWS} SELECT v.doc_id, v.variant_id, v.text, s.source_name, coalesce(nullif(v.source_ref, ''), s.ref) AS source_ref FROM variants v JOIN sources s USING (source_id)")
def resolve_pointers(spark, sf):
    from groundphrase.operators.attest import resolve

    v = b.variants(spark, sf)
    return resolve(v.select("doc_id"), v, b.sources(spark, sf)).select("doc_id", "variant_id", "text", "source_name", "source_ref")


@query(f"WITH {VIEWS} SELECT family_id, expression_id, text AS canonical FROM variants WHERE variant_id LIKE '%-v1'")
def canonical_families(spark, sf):
    return b.variants(spark, sf).where("variant_id like '%-v1'").select("family_id", "expression_id", F.col("text").alias("canonical"))


@query(f"SELECT {norm('text')} AS surface, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_normalized_surfaces(spark, sf):
    return dq.duplicate_surfaces(_docs(spark, sf), "doc_id", "text").select("surface", "n", "first_id")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def fk_violations(spark, sf):
    return dq.missing_keys(_docs(spark, sf), b.table(spark, sf, "labels"), "doc_id").select("doc_id")


@query(f"WITH {VIEWS} SELECT variant_id, row_number() OVER (PARTITION BY expression_id ORDER BY variant_id) AS nth, (variant_id <> expression_id || '-v' || (row_number() OVER (PARTITION BY expression_id ORDER BY variant_id))::VARCHAR) AS wrong FROM variants")
def sequential_id_check(spark, sf):
    return dq.sequential(b.variants(spark, sf), "expression_id", "variant_id").select("variant_id", "nth", "wrong")


@query("SELECT count(*)::BIGINT AS n_rows, count(DISTINCT sha256(text))::BIGINT AS n_texts, min(sha256(text))[1:16] AS first_hash FROM documents")
def content_hash(spark, sf):
    h = _docs(spark, sf).select(F.sha2("text", 256).alias("h"))
    return h.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("h").alias("n_texts"), F.substring(F.min("h"), 1, 16).alias("first_hash"))


@query(f"WITH {VIEWS} SELECT count(DISTINCT expression_id)::BIGINT AS expressions, count(*)::BIGINT AS variants, count(DISTINCT g.family_id)::BIGINT AS glossed FROM variants v LEFT JOIN (SELECT family_id FROM glosses WHERE text <> '') g USING (family_id)")
def corpus_counts(spark, sf):
    return dq.corpus_counts(b.variants(spark, sf), b.glosses(spark, sf))


@query(f"WITH {VIEWS}, v AS (SELECT *, CASE WHEN regexp_matches(text, '[()\\[\\]{{}}<>]|//|\\n') THEN 'editorial-marker' WHEN NOT regexp_full_match(expression_id, 'p\\d{{4,}}') THEN 'expression-id' WHEN {norm('text')} = '' THEN 'empty-surface' END AS violation FROM variants) SELECT variant_id, violation FROM v WHERE violation IS NOT NULL")
def variant_violations(spark, sf):
    return dq.variant_violations(b.variants(spark, sf))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, array_to_string(json_keys(props), ',') AS keys FROM events")
def json_keys_check(spark, sf):
    e = b.table(spark, sf, "events").withColumn("k", F.json_object_keys("props"))
    return e.select("event_id", F.expr("map_values(from_json(props, 'map<string,string>'))[0]").alias("first_value"), F.array_join("k", ",").alias("keys"))
