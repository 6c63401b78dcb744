"""The pipeline's stages by brute force over the small tables, one stage's input at a time."""

import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from groundphrase.llm import secret_scan

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash")).withColumn("n_words", F.lit(1))
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None, "x", 2), (None, "word " * 90, "en", "s", 450, "x", 2), (None, "word " * 90, "en", "s", 450, "x", 2), (-3, "of the " * 3, "en", "s", 20, "x", 2)], docs.schema))
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    cols = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "toxicity", "near duplicates", "secrets", "packing"]
    seen = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        before = docs.collect()
        docs = pipeline.stored(stage(spark, docs, SF), "test")[0]
        after = docs.collect()
        seen.append((before, after))
        if k < 4:
            assert docs.columns == cols
    (q0, q1), (t0, t1), (n0, n1), (s0, s1), (p0, p1) = seen
    ids = lambda rows: {r.doc_id for r in rows}
    good = [i for i, x in labels.items() if x.quality == 1]
    assert len(ids(q1) & set(good)) > 0.9 * len(good) and None not in {r.text for r in q1}
    gone = ids(t0) - ids(t1)
    assert all(labels[i].toxic for i in gone if i in labels) and gone
    # Texts are linked by the Jaccard similarity of their five-word shingles.
    plain = [tuple(re.sub("[A-Z]+", lambda m: m[0].lower(), r.text or "").encode().split()) for r in n0]
    keys = [*dict.fromkeys(plain)]
    sets = {w: {w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set() for w in keys}
    group = {w: {w} for w in keys}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                group[a] |= group[b]
                for w in group[a]:
                    group[w] = group[a]
    by = {}
    for r, w in zip(n0, plain, strict=True):
        by.setdefault(id(group[w]), []).append(r.doc_id)
    assert ids(n1) == {min((x for x in v if x is not None), default=None) for v in by.values()} and len(n1) == len(by) < len(keys)
    texts = {r.doc_id: r.text for r in s0}
    for r in s1:
        spans = secret_scan.scanner().scan(texts[r.doc_id] or "")
        assert (r.text == texts[r.doc_id]) == (not spans) and r.n_chars == len(r.text)
        assert not any(texts[r.doc_id][a:b] in r.text for a, b, *_ in spans)
    n = {}
    for r in p1:
        n[r.doc_id] = n.get(r.doc_id, 0) + r.n
    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    assert n == {r.doc_id: len(sp.encode(r.text)) + 1 for r in p0}


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, 'a token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e" here', "en", "s", 5, 7), (2, "plain words of a text", "en", "s", 5, 8)], "doc_id long, text string, lang string, source string, n_chars long, `a.b` int")
    got = {r.doc_id: r for r in pipeline.secrets(spark, docs, SF).collect()}
    assert got[1]["a.b"] == 7 and got[1].text == "a [secret]\" here" and got[1].n_chars == len(got[1].text) and got[2].text == "plain words of a text"
    kept = pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == 2
    assert pipeline.quality_rules(spark, docs, SF).columns == docs.columns == pipeline.toxic(spark, docs, SF).columns


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
