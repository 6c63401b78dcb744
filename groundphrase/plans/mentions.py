"""Queries over raw places of words and phrases: request intake, hiding of stored surfaces, span bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundphrase.functions import offsets
from groundphrase.functions import text as tx
from groundphrase.operators import engine, lexical
from groundphrase.operators import mentions as mn
from groundphrase.operators import verify as vf
from groundphrase.plans import bindings as b
from groundphrase.plans.bindings import VIEWS, compact, norm

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def tokens_sql(source: str) -> str:
    """Tokens (id, nth, token, raw_start, raw_end, start0, end0) of a table (id, text), by running sums over runs of letters and blanks."""
    return rf"""runs AS (SELECT id, unnest(r) AS run, unnest(range(len(r))) AS nth FROM (SELECT id, regexp_extract_all(text, '\s+|[^\s]+') AS r FROM {source})),
placed AS (SELECT id, run, nth, coalesce(sum(length(run)) OVER (PARTITION BY id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM runs),
words AS (SELECT id, nth, {norm('run')} AS token, pos + length(regexp_extract(run, '^[^\p{{L}}\p{{N}}]*')) AS raw_start, pos + length(run) - length(regexp_extract(run, '[^\p{{L}}\p{{N}}]*$')) AS raw_end FROM placed),
toks AS MATERIALIZED (SELECT *, (sum(length(token) + 1) OVER w)::BIGINT - length(token) - 1 AS start0, (sum(length(token) + 1) OVER w)::BIGINT - 1 AS end0 FROM words WHERE token <> '' WINDOW w AS (PARTITION BY id ORDER BY nth))"""


def _intake_sql(table: str, key: str) -> str:
    return rf"""WITH src AS (SELECT {key} AS id, text FROM {table}), {tokens_sql('src')},
good AS (SELECT id, count(*) AS n, sha256(string_agg(raw_start || ':' || raw_end || ':' || start0 || ':' || end0 || ':' || token, ',' ORDER BY nth)) AS spans FROM toks GROUP BY 1),
slices AS (SELECT id, bool_and({norm('substr(text, raw_start + 1, raw_end - raw_start)')} = token) AS same FROM toks JOIN src USING (id) GROUP BY 1)
SELECT src.id, {norm('text')} AS normalized, coalesce(n, 0)::BIGINT AS n_tokens, coalesce(same, true) AS slices_agree, coalesce(spans, sha256('')) AS spans FROM src LEFT JOIN good USING (id) LEFT JOIN slices USING (id)"""


def _intake(df, key):
    t = offsets.intake(df.select(F.col(key).alias("id"), "text"))
    spelled = F.transform("tokens", lambda x: F.concat_ws(":", x.raw_start.cast("string"), x.raw_end.cast("string"), x.start.cast("string"), x["end"].cast("string"), x.normalized))
    whole = F.array_join(F.transform("tokens", lambda x: x.normalized), " ") == F.col("normalized")
    agree = whole & (tx.retrieval(F.array_join(F.transform("tokens", lambda x: x.text), " ")) == F.col("normalized"))
    return t.select("id", "normalized", F.size("tokens").cast("long").alias("n_tokens"), agree.alias("slices_agree"), F.sha2(F.array_join(spelled, ","), 256).alias("spans"))


@query(_intake_sql("documents", "doc_id"))
def token_offsets(spark, sf):
    """Every document's tokens with their places in the raw and the normalized text."""
    return _intake(b.table(spark, sf, "documents"), "doc_id")


TURNS = "(SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS key, text FROM conversations)"


@query(_intake_sql(TURNS, "key"))
def request_intake(spark, sf):
    """Every turn of every conversation, taken in."""
    turns = b.table(spark, sf, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), "text")
    return _intake(turns, "key")


SURFACES = "sf AS (SELECT DISTINCT trim(text) AS s FROM variants WHERE length(trim(text)) >= 4), surfs AS (SELECT list(s ORDER BY length(s) DESC, s) AS l FROM sf)"


@query(f"WITH {VIEWS}, {SURFACES} SELECT doc_id, list_reduce(list_prepend(text, l), lambda a, s: replace(a, s, '[FFE_USER_MENTION]')) AS text FROM documents, surfs")
def redacted_by_corpus(spark, sf):
    """Every document without any stored surface."""
    return mn.redact(b.table(spark, sf, "documents").select("doc_id", "text"), mn.surfaces(b.variants(spark, sf)), "doc_id")


@query(f"WITH {VIEWS}, {SURFACES} SELECT doc_id, s AS surface, len(list_filter(range(1, length(text) - length(s) + 2), lambda i: substr(text, i, length(s)) = s))::BIGINT AS n FROM documents JOIN sf ON contains(text, s)")
def surface_leaks(spark, sf):
    return mn.leaks(b.table(spark, sf, "documents"), mn.surfaces(b.variants(spark, sf)), "doc_id")


SEQUENCES = """runs_of AS MATERIALIZED (SELECT id, nth, start0, raw_start, list(token) OVER w AS ts, list(raw_end) OVER w AS es FROM toks WINDOW w AS (PARTITION BY id ORDER BY nth ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
sizes AS (SELECT DISTINCT len(string_split(v, ' ')) AS k FROM nv), pieces AS (SELECT id, start0 AS s, raw_start, es[k] AS raw_end, array_to_string(ts[1:k], ' ') AS v FROM runs_of, sizes WHERE len(ts) >= k),
spans AS MATERIALIZED (SELECT pieces.*, nv.* EXCLUDE (v) FROM pieces JOIN nv USING (v))"""


@query(
    rf"""WITH {VIEWS}, src AS (SELECT doc_id AS id, text FROM documents), {tokens_sql('src')}, nv AS (SELECT doc_id, family_id, {norm('text')} AS v FROM variants WHERE length({norm('text')}) >= 4), {SEQUENCES}
SELECT id, doc_id, family_id, s::INTEGER AS "start", (s + length(v))::INTEGER AS "end", raw_start::INTEGER AS raw_start, raw_end::INTEGER AS raw_end, substr(text, raw_start + 1, raw_end - raw_start) AS raw FROM spans JOIN src USING (id)"""
)
def grounded_mentions(spark, sf):
    """Whole-word places of variants in every document, in raw places too."""
    return mn.mentions(b.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), b.variants(spark, sf), "id")


@query(f"WITH {VIEWS}, q AS (SELECT query_id, {norm('text')} AS x FROM requests), v AS (SELECT doc_id, {norm('text')} AS y FROM variants) SELECT query_id, doc_id, contains(y, x) AS a_in_b, contains(x, y) AS b_in_a FROM q JOIN v ON x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x))")
def either_inside(spark, sf):
    q, v = (df.withColumn("text", tx.retrieval(F.col("text"))) for df in (b.requests(spark, sf), b.variants(spark, sf)))
    return mn.either_inside(q, v, "query_id", "doc_id")


PLANNED = "t AS (SELECT query_id, CASE length(text) % 4 WHEN 0 THEN NULL WHEN 1 THEN text WHEN 2 THEN left(text, 20) ELSE 'elsewhere' END AS target FROM requests)"


@query(
    rf"""WITH {VIEWS}, {PLANNED}, src AS (SELECT query_id AS id, text FROM requests), {tokens_sql('src')}, nv AS (SELECT DISTINCT {norm('text')} AS v FROM variants WHERE length({norm('text')}) >= 4), {SEQUENCES},
bound AS (SELECT DISTINCT id, raw_start, substr(text, raw_start + 1, raw_end - raw_start) AS raw FROM spans JOIN src USING (id)),
o AS (SELECT query_id, any_value(target) AS target, count(*) FILTER (contains(target, raw) OR contains(raw, target)) AS n, max(raw) FILTER (contains(target, raw) OR contains(raw, target)) AS only_, arg_min(raw, (raw_start, raw)) AS first_ FROM t LEFT JOIN bound ON id = query_id GROUP BY 1)
SELECT query_id, CASE WHEN target IS NULL THEN first_ WHEN n = 1 THEN only_ ELSE target END AS target FROM o"""
)
def grounded_targets(spark, sf):
    """Planned targets against the requests' grounded spans."""
    q = b.requests(spark, sf)
    kind = F.length("text") % 4
    planned = q.select("query_id", F.when(kind == 1, F.col("text")).when(kind == 2, F.left("text", F.lit(20))).when(kind == 3, "elsewhere").alias("target"))
    return mn.grounded_target(planned, mn.mentions(q, b.variants(spark, sf), "query_id"), "query_id")


PAIRS = "pairs AS (SELECT query_id, family_id, text, length(text) % 7 AS k FROM requests, (SELECT family_id, doc_id AS f, count(*) OVER () AS n FROM glosses) WHERE (length(text) + length(query_id)) % n = f)"


@query(
    f"WITH {VIEWS}, {PAIRS} SELECT query_id, family_id, CASE k WHEN 1 THEN 'SUPPORTED' WHEN 2 THEN 'NOT_SUPPORTED' WHEN 0 THEN 'NOT_SUPPORTED' ELSE 'UNCERTAIN' END AS verdict, CASE k WHEN 0 THEN 'v+recommendation-policy' ELSE 'v' END AS verifier_id,"
    " CASE k WHEN 0 THEN 'unsuitable-register' WHEN 1 THEN 'r' WHEN 2 THEN '' WHEN 3 THEN 'verifier-error:forbidden rank,score' WHEN 4 THEN 'verifier-error:invalid JSON' WHEN 5 THEN 'verifier-error:unknown verdict' ELSE 'verifier-error:no answer' END AS reason FROM pairs"
)
def verified_pairs(spark, sf):
    """Each request with a family, through suitability and a verifier whose answers are broken in several ways."""
    q, g = b.requests(spark, sf), b.glosses(spark, sf)
    n = g.count()
    fams = g.select("family_id", F.col("text").alias("gloss"), F.col("doc_id").alias("f"))
    k = F.length("text") % 7
    pairs = q.withColumn("f", (F.length("text") + F.length("query_id")) % n).join(fams, "f").withColumn("phrase", F.when(k == 0, "حرف گه زدن").otherwise("حرف زدن"))
    answers = {1: '{"verdict": "SUPPORTED", "reason": "r"}', 2: '{"verdict": "NOT_SUPPORTED"}', 3: '{"verdict": "SUPPORTED", "score": 1, "rank": 2}', 4: "{verdict", 5: '{"verdict": "YES"}'}

    def verifier(asked):
        content = F.lit(None).cast("string")
        for i, x in answers.items():
            content = F.when(k == i, x).otherwise(content)
        return asked.where(k != 6).select("query_id", "family_id", content.alias("content"))

    return vf.verify(pairs, verifier, "v")


SEVERAL = "one AS (SELECT item_id, text FROM variants WHERE variant_id LIKE '%-v1'), several AS (SELECT a.item_id, concat_ws(' or ', d.text, a.text, c.text, b.text) AS text FROM one a LEFT JOIN one b ON b.item_id = a.item_id + 1 LEFT JOIN one c ON c.item_id = a.item_id + 2 AND c.item_id % 3 = 0 LEFT JOIN one d ON d.item_id = a.item_id + 3)"


@query(
    f"WITH {VIEWS}, {SEVERAL}, d AS (SELECT item_id, {compact('text')} AS c FROM several), v AS (SELECT DISTINCT family_id, {compact('text')} AS v FROM variants WHERE length({compact('text')}) >= 8), f AS (SELECT item_id, family_id, min(instr(c, v)) AS pos FROM d JOIN v ON contains(c, v) GROUP BY 1, 2)"
    " SELECT item_id, count(*)::BIGINT AS n_families, array_to_string(list(family_id ORDER BY pos, family_id)[1:3], ',') AS alternatives FROM f GROUP BY 1 HAVING count(*) >= 2"
)
def clarify_alternatives(spark, sf):
    """Requests in which several phrases stand, with the first three."""
    one = b.variants(spark, sf).where("variant_id like '%-v1'").select("item_id", "text")
    at = lambda k, name: one.select((F.col("item_id") - k).alias("item_id"), F.col("text").alias(name))
    third = at(2, "c").where((F.col("item_id") + 2) % 3 == 0)
    q = one.withColumnRenamed("text", "a").join(at(1, "b"), "item_id", "left").join(third, "item_id", "left").join(at(3, "d"), "item_id", "left")
    c = lexical.contained(q.select("item_id", F.concat_ws(" or ", "d", "a", "c", "b").alias("text")), b.variants(spark, sf), "item_id")
    return vf.alternatives(c, "item_id").select("item_id", "n_families", F.array_join("alternatives", ",").alias("alternatives"))


@query(
    f"WITH {VIEWS} SELECT query_id, CASE length(text) % 3 WHEN 0 THEN text WHEN 1 THEN 'یادم رفته «' || text || '» چی بود' ELSE '«' || text || '» و «' || text || '»' END AS whole, CASE WHEN length(text) % 3 = 1 AND length({compact('text')}) >= 6 THEN trim(text) ELSE whole END AS asked FROM requests"
)
def unwrapped_requests(spark, sf):
    """Requests in wrappers, and what of them is looked for."""
    k, t = F.length("text") % 3, F.col("text")
    said = F.when(k == 0, t).when(k == 1, F.concat(F.lit("یادم رفته «"), t, F.lit("» چی بود"))).otherwise(F.concat(F.lit("«"), t, F.lit("» و «"), t, F.lit("»")))
    q = b.requests(spark, sf).select("query_id", said.alias("text"))
    return engine.unwrapped(q.withColumn("whole", F.col("text"))).select("query_id", "whole", F.col("text").alias("asked"))


DRAFTS = "t AS (SELECT doc_id, doc_id % 6 AS k, CASE doc_id % 6 WHEN 0 THEN text || ' <FFE_1>' WHEN 1 THEN '<FFE_2> ' || text || ' <FFE_1>' WHEN 2 THEN '<FFE_1> ' || text || ' <FFE_1>' WHEN 3 THEN text WHEN 4 THEN '«' || text || '» <FFE_1>' ELSE '<FFE_1> <FFE_2> ' || text END AS t FROM documents)"


@query(
    f"WITH {VIEWS}, {SURFACES}, {DRAFTS}, h AS (SELECT DISTINCT doc_id FROM t JOIN sf ON contains(t, s)), p AS (SELECT doc_id, CASE k WHEN 2 THEN 'a slot twice' WHEN 3 THEN 'missing or unknown slots' WHEN 4 THEN 'quotes' ELSE CASE WHEN length(translate(t, '«»“”„‟\"`', '')) < length(t) THEN 'quotes' WHEN h.doc_id IS NOT NULL THEN 'stored text outside a slot' END END AS problem FROM t LEFT JOIN h USING (doc_id)) SELECT * FROM p WHERE problem IS NOT NULL"
)
def template_checks(spark, sf):
    """Drafts made of every document, with slots right and wrong, against rules and the whole corpus."""
    k, t = F.col("doc_id") % 6, F.col("text")
    s = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    draft = F.when(k == 0, s(t, " <FFE_1>")).when(k == 1, s("<FFE_2> ", t, " <FFE_1>")).when(k == 2, s("<FFE_1> ", t, " <FFE_1>")).when(k == 3, t).when(k == 4, s("«", t, "» <FFE_1>")).otherwise(s("<FFE_1> <FFE_2> ", t))
    slots = F.when(k.isin(1, 5), F.array(F.lit("<FFE_1>"), F.lit("<FFE_2>"))).otherwise(F.array(F.lit("<FFE_1>")))
    d = b.table(spark, sf, "documents").select("doc_id", draft.alias("template"), slots.alias("slots"))
    return vf.template_violations(d, mn.surfaces(b.variants(spark, sf)), "doc_id")


@query(f"WITH {VIEWS}, t AS (SELECT query_id, text, CASE length(text) % 4 WHEN 0 THEN NULL WHEN 1 THEN left(text, 7) WHEN 2 THEN upper(text) ELSE text || '!' END AS target FROM requests) SELECT query_id, CASE WHEN target IS NOT NULL AND NOT contains(text, target) THEN 'target is not in the request' END AS problem FROM t")
def target_checks(spark, sf):
    k, t = F.length("text") % 4, F.col("text")
    target = F.when(k == 1, F.left(t, F.lit(7))).when(k == 2, F.upper(t)).when(k == 3, F.concat(t, F.lit("!")))
    return b.requests(spark, sf).select("query_id", vf.target_problem(target, t).alias("problem"))
