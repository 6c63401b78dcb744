import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundphrase.functions import cues
from groundphrase.functions import fuzzy as fz
from groundphrase.functions import text as tx

#: Texts in the script that the engine is made for (invented), with letters, digits and spaces that fold.
TEXTS = ["كتاب علي", "می‌روم  به   خانه", "آب ۱۲۳ و ٤٥", "ـــکشیده", "a b​c", "é É Straße", "", " \n\t ", "مُدَرِّس", "٪؟!،", "x y z", "é"]


def brute(text):
    """The rule of the retrieval form, restated character by character."""
    fold = dict(zip(tx.RETRIEVAL_FROM, tx.RETRIEVAL_TO, strict=True))
    out = ""
    for c in unicodedata.normalize("NFC", text):
        c = fold.get(c, c)
        if c == tx.TATWEEL:
            continue
        out += " " if c.isspace() or c == "‌" else c.lower() if c.isalnum() else ""
    return " ".join(out.split())


def column(spark, texts, f):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_retrieval(spark):
    assert column(spark, TEXTS, lambda c: tx.retrieval(c, True)) == [brute(t) for t in TEXTS]


def test_display(spark):
    assert column(spark, ["كتاب  علي", "a \tb\nc‌d "], tx.display) == ["کتاب علی", "a b\nc‌d"]


def test_grams_tokens_and_quotes(spark):
    assert column(spark, ["abcd", "ab", ""], lambda c: tx.char_ngrams(c, 3)) == [["abc", "bcd"], ["ab"], []]
    assert column(spark, ["aab ab", ""], lambda c: tx.bigram_set(tx.compact(c))) == [["aa", "ab", "ba"], []]
    assert column(spark, ["یک کتاب خوب و کتاب a1", ""], lambda c: tx.content_tokens(tx.tokens(tx.retrieval(c)), ["خوب"])) == [["یک", "کتاب"], []]
    assert column(spark, ['«یک دو سه» یادم', '«a» "b" یادم', "یادم"], lambda c: tx.single_quoted(c, cues.WRAPPER, 6)) == ["یک دو سه", None, None]
    assert column(spark, ["a cat and a catalog"], lambda c: tx.redact(c, F.array(F.lit("cat"), F.lit("catalog")), "#")) == ["a # and a #"]


def test_cues(spark):
    texts = ["یادم رفته، چی بود؟", "چه مثلی برای این معنی", "«نان و نمک» واقعی است؟", "file.txt را باز کن", "سلام"]
    got = column(spark, texts, lambda c: F.struct(*(e.alias(k) for k, e in cues.explicit(c).items())))
    assert [tuple(r) for r in got] == [(False, False, True, False), (False, True, False, False), (True, False, False, False), (False, False, False, True), (False, False, False, False)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ‌ي۱é.,", max_size=30))
def test_spans_agree_with_the_retrieval_form(text):
    spans = fz.token_spans(text)
    assert " ".join(t for t, *_ in spans) == brute(text)
    assert all(brute(text[a:b]) == t for t, a, b in spans)


def slow_infix(q, d):
    row = [0] * (len(d) + 1)
    for i, a in enumerate(q, 1):
        new = [i]
        for j, b in enumerate(d, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=14), st.text(alphabet="abc", max_size=30))
def test_kernels(q, d):
    assert fz.infix_distance(q, d) == slow_infix(q, d)
    best = [[0] * (len(d) + 1) for _ in range(len(q) + 1)]
    for i, a in enumerate(q):
        for j, b in enumerate(d):
            best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
    assert fz.lcs(list(q), list(d)) == best[-1][-1]


def test_evidence():
    assert fz.evidence("the quick brown fox", "the quick brown fox") == 0.0  # nothing to repair
    assert fz.evidence("the quick brwn fox", "the quick brown fox") > 0.9
    assert fz.evidence("the quick green fox", "the quick brown fox") == 0.0  # another word, not a misspelt one
    assert fz.evidence("short", "shirt") == 0.0
    assert fz.allowed_edits(11) == 1 and fz.allowed_edits(12) == 2 and fz.allowed_edits(40) == 4
    assert "the quick brwn fox" in {w[2] for w in fz.windows("tell me the quick brwn fox please", "the quick brown fox jumps", 60)}
