"""Queries over cues, targets and stems of requests in their own language, given as a literal table.

The driver's tables hold no text in that language, so the requests stand here; every cue has requests in which
it fires and others in which it doesn't.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from groundphrase.functions import cues, intents, stems
from groundphrase.functions import text as tx
from groundphrase.operators import decide
from groundphrase.operators.restore import fuzzy_restore, long_tokens
from groundphrase.plans import bindings as b
from groundphrase.plans.bindings import VIEWS, norm

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: (number, mentions of corpus phrases, wording), and what it must give: cues, signal, scope, writing with a phrase or a
#: saying, explicit cues, route, and whether a meaning's scaffold stands in it.
REQUESTS = (
    (1, 0, "یه ضرب المثل برای وقتی که کسی زیاد حرف می‌زنه بگو", "noun search context", "SEARCH_BY_MEANING", "", "", "meaning", "MEANING:explicit-cue", True),
    (2, 1, "آب از آب تکان نخورد یعنی چی", "explain", "EXPLAIN", "after_target", "", "", "", False),
    (3, 0, "آب از آب تکان نخورد یعنی چی", "explain", "NONE", "after_target", "", "", "", False),
    (4, 1, "آیا «آب از آب تکان نخورد» دقیقا همین صورت ثبت شده هست؟", "exact restore attest", "ATTEST", "exact_question", "", "", "", False),
    (5, 1, "این مثل که میگه نوش دارو واقعی است یا نه", "attest noun context", "ATTEST", "", "", "", "", False),
    (6, 1, "اصلش چی بود، آب که از سر گذشت", "restore context", "RESTORE_SURFACE", "", "", "surface", "SURFACE:explicit-cue", False),
    (7, 0, "سه تا ضرب المثل درباره صبر بگو", "examples noun search", "RETRIEVE_EXAMPLES", "", "", "", "", False),
    (8, 0, "نقش ضرب المثل ها در فرهنگ و ادبیات چیست", "meta noun", "FORCE_GENERAL", "", "", "", "", False),
    (9, 0, "یک مثل جدید و ساختگی درست کن", "fictional noun", "NONE", "", "", "", "", False),
    (10, 0, "یک متن بنویس و هیچ ضرب المثل داخلش نیاور", "forbids noun", "FORCE_GENERAL", "", "phrase saying", "", "", False),
    (11, 0, "به کسی که دیر می‌رسد چی می‌گن", "context indirect", "SEARCH_BY_MEANING", "", "", "meaning", "MEANING:explicit-cue", True),
    (12, 0, "هوا امروز خوب است", "", "NONE", "", "", "", "", False),
    (13, 0, "", "", "NONE", "", "", "", "CLARIFY:empty-query", False),
    (14, 0, "   ", "", "NONE", "", "", "", "CLARIFY:empty-query", False),
    (15, 2, "معنی هر دو رو توضیح بده", "explain context", "EXPLAIN", "all_mentions", "", "", "", True),
    (16, 2, "فقط یکی از این دوتا رو میخوام ولی نمی‌گم کدوم", "search", "NONE", "one_unknown", "", "", "", False),
    (17, 1, "یک پیام دوستانه بنویس و یه ضرب المثل هم داخلش بذار", "noun search", "NONE", "", "phrase saying", "meaning", "MEANING:explicit-cue", False),
    (18, 0, "یک نامه آماده کن و آخرش یک گفته بیار", "search", "NONE", "", "saying", "", "", False),
    (19, 0, "كدام مثل برای این حالت مناسب است؟", "noun search context", "SEARCH_BY_MEANING", "", "", "meaning", "MEANING:explicit-cue", False),
    (20, 1, "گربه دستش به گوشت نمی‌رسه ضرب المثل هست؟", "attest noun", "ATTEST", "", "", "", "", False),
    (21, 1, "شکل درست این رو بگو", "restore search", "RESTORE_SURFACE", "", "", "", "", False),
    (22, 0, "برای این موقعیت یه اصطلاح پیشنهاد بده که کنایه باشد", "noun search context", "SEARCH_BY_MEANING", "", "", "meaning", "MEANING:explicit-cue", False),
    (23, 0, "چه مثلی داریم برای این معنی", "noun search context", "SEARCH_BY_MEANING", "", "", "meaning", "MEANING:explicit-cue", True),
    (24, 0, "یادم رفته ادامه‌اش چی بود", "restore", "NONE", "", "", "surface", "SURFACE:explicit-cue", False),
    (25, 0, "این ضرب المثل واقعیه", "attest noun", "NONE", "", "", "attestation", "ATTESTATION:explicit-cue", False),
    (26, 0, "یادم رفته، چه اصطلاحی برای این معنا داریم", "restore noun search context", "SEARCH_BY_MEANING", "", "", "meaning surface", "CLARIFY:conflicting-explicit-task-cues", True),
    (27, 0, "python code بنویس", "", "NONE", "", "", "technical", "CLARIFY:technical-out-of-domain-guard", False),
    (28, 0, "«نوش دارو پس از مرگ سهراب» واقعی است؟", "attest", "NONE", "", "", "attestation", "ATTESTATION:explicit-cue", False),
    (29, 1, "کی به کار می‌ره این عبارت", "explain", "EXPLAIN", "after_target", "", "", "", False),
    (30, 0, "با دو تا کنایه مثال بزن و نمونه بده", "examples noun", "RETRIEVE_EXAMPLES", "", "", "", "", False),
    (31, 0, "یه جمله جا افتاده درباره صبر بگو", "search indirect", "SEARCH_BY_MEANING", "", "", "", "", False),
    (32, 0, "در ترجمه مثل ها چه چیزی مهم است", "meta noun", "FORCE_GENERAL", "", "", "", "", False),
    (33, 0, "نباشه توی متن هیچ اصطلاح خاصی", "forbids noun", "FORCE_GENERAL", "", "", "", "", False),
    (34, 1, "منظورش چیه این که گفت", "explain context", "EXPLAIN", "after_target", "", "", "", False),
    (35, 0, "یه مثل جدید بساز", "fictional noun", "NONE", "", "", "meaning", "MEANING:explicit-cue", False),
    (36, 1, "همین ثبت شده است", "exact", "ATTEST", "exact_question", "", "", "", False),
    (37, 0, "دوتاشون رو معنی کن", "context", "NONE", "all_mentions", "", "", "", True),
)
#: (number, wording with a place for the item's words, its target with the same or nothing).
WISHES = (
    (1, "{} آب که از سر گذشت چه یه وجب رو عامیانه نوشتم، درستش رو بگو", "{} آب که از سر گذشت چه یه وجب"), (2, "{} گربه دستش به گوشت نمیرسه رو شنیدم اصلش چیه", "{} گربه دستش به گوشت نمیرسه"), (3, "چطور میشه {} رو اشتباه نوشتم شکل درستش رو بگو", None),
    (4, "درستش رو بگو {}", None), (5, "{} این را غلط گفتم صورت درست بگو", "{} این"), (6, "، {} نوش دارو بعد مرگ سهراب را اشتباه نوشتم؛ صورت ثبت شده‌اش را بده", "{} نوش دارو بعد مرگ سهراب"), (7, "هوا خوب است {}", None), (8, "", None),
    (9, "مرغ همسایه غاز است {} شکل معیارش چیست", None), (10, "{} کوه به کوه نمی‌رسه رو ناقص یادم مونده . کاملش رو بگو", "{} کوه به کوه نمی‌رسه"),
)
#: (number, phrase, its stems); the item's words follow, which have no endings.
PHRASES = (
    (1, "زبونش دراز است", "زبان دراز است"), (2, "کتابو خوندم", "کتاب خوند"), (3, "نمیشه که نشه", "شه"), (4, "آب از آب تکان نخورد", "آب آب تکان خورد"), (5, "گیره، گیرها", "گیر گیرها"),
    (6, "دهنشون بسته‌اند", "دهان بست اند"), (7, "میگن شونه خالی کرد", "شان خال"), (8, "عمو جان", "عمو جان"), (9, "زندگیشان را دادند", "زندگ"), (10, "و از به", ""), (11, "جادو و کادو", "جادو کادو"), (12, "", ""),
)


def _text(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''").replace("‌", "' || chr(8204) || '") + "'" if isinstance(v, str) else f"{v}::BIGINT"


def values(rows, names: str) -> str:
    """Rows as a table of SQL."""
    return f"(VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in rows)}) t({names})"


def _asked(spark, sf, rows, name: str, *columns: str):
    """(item_id, phrase, name, columns...): each item with the wording that its number gives it; phrase: its first words."""
    t = spark.createDataFrame([r[: 2 + len(columns)] for r in rows], ", ".join(["k long", *(f"{c} {'long' if c == 'mentions' else 'string'}" for c in (*columns, name))]))
    w = b.words(spark, sf).select("item_id", F.array_join(F.slice("w", 1, 2), " ").alias("phrase"), (F.col("item_id") % len(rows) + 1).alias("k"))
    return w.join(F.broadcast(t), "k")


def _requests(spark, sf):
    text = F.when(F.trim("wording") == "", F.col("wording")).otherwise(F.concat("phrase", F.lit(" "), "wording"))
    return _asked(spark, sf, REQUESTS, "wording", "mentions").select("item_id", "mentions", text.alias("text"))


def _filled(spark, sf, rows):
    return _asked(spark, sf, rows, "wording").select("item_id", F.replace("wording", F.lit("{}"), F.col("phrase")).alias("text"))


NAMES = "k, mentions, wording, cues, signal, scope, writes, explicit, route, scaffold"
ASKED = f"WITH {b.WORDS}, asked AS (SELECT item_id, t.* FROM words JOIN {values(REQUESTS, NAMES)} ON k = item_id % {len(REQUESTS)} + 1)"


def said(column: str, names) -> str:
    """For each name whether it stands in a column of names."""
    return ", ".join(f"list_contains(string_split({column}, ' '), '{x}') AS {x}" for x in names)


@query(f"{ASKED} SELECT item_id, {said('cues', intents.CUES)} FROM asked")
def intent_cues(spark, sf):
    return _requests(spark, sf).select("item_id", *(c.alias(k) for k, c in intents.cues(F.col("text")).items()))


@query(f"{ASKED} SELECT item_id, signal FROM asked")
def request_signal(spark, sf):
    return _requests(spark, sf).select("item_id", intents.signal(F.col("text"), F.col("mentions")).alias("signal"))


@query(f"{ASKED} SELECT item_id, {said('scope', intents.SCOPE)} FROM asked")
def scope_cues(spark, sf):
    return _requests(spark, sf).select("item_id", *(c.alias(k) for k, c in intents.scope(F.col("text")).items()))


@query(f"{ASKED} SELECT item_id, {said('writes', ('phrase', 'saying'))} FROM asked")
def composition_task(spark, sf):
    return _requests(spark, sf).select("item_id", intents.needs_composition(F.col("text")).alias("phrase"), intents.needs_composition(F.col("text"), intents.PHRASE_OR_SAYING).alias("saying"))


@query(f"{ASKED} SELECT item_id, {said('explicit', ('attestation', 'surface', 'meaning', 'technical'))}, nullif(route, '') AS route, scaffold FROM asked")
def explicit_route_of_requests(spark, sf):
    x = cues.explicit(F.col("text"))
    r = _requests(spark, sf).select("item_id", "text", *(c.alias(k) for k, c in x.items()))
    route = decide.explicit_route(F.trim("text") == "", *(F.col(k) for k in ("attestation", "surface", "meaning", "technical")))
    return r.select("item_id", "attestation", "surface", "meaning", "technical", route.alias("route"), cues.scaffold(F.col("text")).alias("scaffold"))


@query(f"WITH {b.WORDS} SELECT item_id, replace(target, '{{}}', array_to_string(w[1:2], ' ')) AS target FROM words JOIN {values(WISHES, 'k, wording, target')} ON k = item_id % {len(WISHES)} + 1")
def restore_targets(spark, sf):
    return _filled(spark, sf, WISHES).select("item_id", intents.restore_target(F.col("text")).alias("target"))


@query(f"WITH {b.WORDS} SELECT item_id, trim(stems || ' ' || array_to_string(w[1:2], ' ')) AS stems FROM words JOIN {values(PHRASES, 'k, wording, stems')} ON k = item_id % {len(PHRASES)} + 1")
def wide_stems(spark, sf):
    p = _asked(spark, sf, PHRASES, "wording").select("item_id", F.concat("wording", F.lit(" "), "phrase").alias("text"))
    return p.select("item_id", F.array_join(stems.wide_signature(F.col("text")), " ").alias("stems"))


@query(
    f"WITH {VIEWS}, vs AS (SELECT doc_id, family_id, list_distinct(list_filter(string_split({norm('text')}, ' '), lambda x: length(x) > 1)) AS t FROM variants), qs AS (SELECT query_id, list_distinct(list_filter(string_split({norm('text')}, ' '), lambda x: length(x) > 1)) AS t FROM requests),"
    " vk AS (SELECT doc_id, family_id, unnest(t) AS k FROM vs), held AS (SELECT k, count(DISTINCT family_id) AS families FROM vk GROUP BY 1),"
    " h AS (SELECT query_id, doc_id, count(*) AS n, min(families) AS families, count(*) FILTER (families <= 2) AS dis FROM (SELECT query_id, unnest(t) AS k FROM qs) JOIN vk USING (k) JOIN held USING (k) GROUP BY 1, 2),"
    " p AS (SELECT query_id, doc_id, vs.family_id, n / len(qs.t) AS qc, n / len(vs.t) AS vc, len(qs.t) AS nq, len(vs.t) AS nv, n, dis, h.families FROM h JOIN qs USING (query_id) JOIN vs USING (doc_id)),"
    " b AS (SELECT *, n >= 3 AND qc >= 0.75 AND vc >= 0.75 AS alike, CASE WHEN nq = 1 AND families = 1 THEN greatest(0.94, 0.55 * qc + 0.45 * vc) ELSE 0.55 * qc + 0.45 * vc END AS base FROM p),"
    " s AS (SELECT query_id, family_id, doc_id, alike, CASE WHEN alike AND least(nq, nv) >= 4 AND dis >= 2 THEN greatest(base, 0.9) ELSE base END AS score FROM b),"
    " f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, family_id ORDER BY round(score, 9) DESC, doc_id) AS nth FROM s) WHERE nth = 1),"
    " r AS (SELECT *, row_number() OVER w AS rank, score - coalesce(lead(score) OVER w, 0) AS margin FROM f WINDOW w AS (PARTITION BY query_id ORDER BY round(score, 9) DESC, family_id))"
    " SELECT query_id, CASE WHEN score >= 0.88 AND margin >= 0.12 THEN family_id END AS family_id, round(coalesce(score, 0), 6) AS score, round(coalesce(margin, 0), 6) AS margin, CASE WHEN len(t) = 0 THEN 'empty-normalized-surface' WHEN score IS NULL THEN 'no-lexical-rescue-candidate' WHEN NOT (score >= 0.88 AND margin >= 0.12) THEN 'restore-rescue-threshold-not-met'"
    " WHEN score >= 0.9 AND alike THEN 'morphology-distinctive-near-match-rescue' ELSE 'morphology-and-distinctive-token-rescue' END AS reason FROM qs LEFT JOIN (SELECT * FROM r WHERE rank = 1) USING (query_id)"
)
def restore_fuzzy(spark, sf):
    got = fuzzy_restore(b.requests(spark, sf), b.variants(spark, sf), items=long_tokens)
    return got.withColumn("score", F.round("score", 6)).withColumn("margin", F.round("margin", 6))


STOPPED = "[" + ", ".join(_text(w) for w in tx.NON_CONTENT) + "]"
#: (number, request, gloss); the item's first two words follow the request, its second and third the gloss.
GLOSSES = ((1, "برای وقتی که کسی زیاد حرف بی فایده می زند", "حرف بی فایده زدن و پرگویی."), (2, "وقتی کار از کار گذشته باشد", "انجام دادن کاری پس از گذشتن فرصت."), (3, "python 3", "حرف بی فایده."), (4, "این چیست", "حرف."), (5, "حرف حرف فایده", "فایده حرف زدن حرف"))
CONTENT = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(translate({}, 'آ', 'ا'), '[^\\p{{L}}\\p{{N}} ]', '', 'g'), ' +', ' ', 'g')), ' '), lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[A-Za-z0-9_+./:-]+') AND NOT list_contains(" + STOPPED.replace("{", "{{").replace("}", "}}") + ", x)))"


@query(f"WITH {b.WORDS}, a AS (SELECT item_id, request || ' ' || array_to_string(w[1:2], ' ') AS request, gloss || ' ' || array_to_string(w[2:3], ' ') AS gloss FROM words JOIN {values(GLOSSES, 'k, request, gloss')} ON k = item_id % 5 + 1), t AS (SELECT item_id, {CONTENT.format('request')} AS q, {CONTENT.format('gloss')} AS g FROM a) SELECT item_id, array_to_string(list_sort(list_intersect(q, g)), ' ') AS shared, len(list_intersect(q, g)) > 0 AS anchored, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, g)) / len(q) ELSE 0 END, 6)::DOUBLE AS query_support, round(CASE WHEN len(g) > 0 THEN len(list_intersect(q, g)) / len(g) ELSE 0 END, 6)::DOUBLE AS gloss_support FROM t")
def meaning_support(spark, sf):
    g = spark.createDataFrame(GLOSSES, "k long, request string, gloss string")
    w = b.words(spark, sf).withColumn("k", F.col("item_id") % len(GLOSSES) + 1).join(F.broadcast(g), "k")
    said_ = lambda c, i: F.concat(c, F.lit(" "), F.array_join(F.slice("w", i, 2), " "))
    e = w.select("item_id", tx.meaning_evidence(said_("request", 1), said_("gloss", 2)).alias("e"))
    return e.select("item_id", F.array_join("e.shared", " ").alias("shared"), "e.anchored", F.round("e.query_support", 6).alias("query_support"), F.round("e.gloss_support", 6).alias("gloss_support"))


@query("SELECT doc_id, replace(replace(replace(replace(replace('<p title=\"x''y\">' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM documents")
def html_escaped(spark, sf):
    d = b.table(spark, sf, "documents")
    return d.select("doc_id", tx.html_escape(F.concat(F.lit("<p title=\"x'y\">"), "text")).alias("escaped"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z' AS stamp FROM events")
def utc_stamps(spark, sf):
    return b.table(spark, sf, "events").select("event_id", tx.utc_stamp(F.col("ts")).alias("stamp"))
