"""Text normalization as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that count as one (fixed values), and spaces that count as a blank.
DISPLAY_FROM, DISPLAY_TO = "يك", "یک"
RETRIEVAL_FROM = DISPLAY_FROM + "ىأإآٱةۀؤئ" + "٠١٢٣٤٥٦٧٨٩" + "۰۱۲۳۴۵۶۷۸۹"
RETRIEVAL_TO = DISPLAY_TO + "یااااههوی" + "0123456789" * 2
TATWEEL = "ـ"
EXOTIC_SPACES = r"[   　 -​]"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition, which Spark has no function for."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def composed(c: Column) -> Column:
    """NFC; plain ASCII and Latin-1 text never leaves the JVM."""
    return F.when(c.rlike(r"[^\x00-\xff]"), nfc(c)).otherwise(c)


def display(c: Column, compose: bool = False) -> Column:
    """For showing: letters folded, exotic spaces as blanks, runs of blanks and tabs as one, trimmed."""
    c = F.translate(composed(c) if compose else c, DISPLAY_FROM, DISPLAY_TO)
    return F.trim(F.regexp_replace(F.regexp_replace(c, EXOTIC_SPACES, " "), r"[ \t]+", " "))


def retrieval(c: Column, compose: bool = False) -> Column:
    """For matching: letters and digits folded, small, all else dropped but single blanks between words."""
    c = F.translate(composed(c) if compose else c, RETRIEVAL_FROM + TATWEEL, RETRIEVAL_TO)
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)[\s‌]+", " "), r"[^\p{L}\p{N} ]", "")
    return F.trim(F.regexp_replace(F.lower(c), " +", " "))


def compact(normalized: Column) -> Column:
    return F.replace(normalized, F.lit(" "))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def char_ngrams(c: Column, n: int = 3) -> Column:
    """All n-grams, with repeats; a shorter text is its own only one, an empty one has none.

    Shifted copies of the characters are zipped: substring() would walk from the text's start for each gram.
    """
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    shifted = F.arrays_zip(*(F.slice(chars, i + 1, F.greatest(F.size(chars), F.lit(1))) for i in range(n)))
    grams = F.filter(F.transform(shifted, lambda t: F.concat(*(t[str(i)] for i in range(n)))), lambda g: g.isNotNull())
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.length(c) < n, F.array(c)).otherwise(grams)


def bigram_set(compacted: Column) -> Column:
    return F.array_distinct(char_ngrams(compacted, 2))


def content_tokens(toks: Column, stop: list[str]) -> Column:
    """Distinct tokens in order, without single characters, stop words and ASCII ones."""
    kept = F.filter(toks, lambda t: (F.length(t) > 1) & ~t.rlike("^[A-Za-z0-9_+./:-]+$"))
    return F.array_distinct(F.array_except(kept, F.array(*map(F.lit, stop)))) if stop else F.array_distinct(kept)


def redact(c: Column, surfaces: Column, mark: str = "[phrase]") -> Column:
    """Put a mark for each of an array of surfaces, longest first."""
    ordered = F.array_sort(F.transform(surfaces, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s"))))
    return F.aggregate(ordered, c, lambda a, s: F.replace(a, s.s, F.lit(mark)))


def quoted_spans(c: Column) -> Column:
    """What stands in «», “” or straight double quotes, in that order of kinds."""
    return F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in ("«([^»]+)»", "“([^”]+)”", '"([^"]+)"')))


def single_quoted(c: Column, cue: str, least: int) -> Column:
    """The only quoted span with enough letters, if a cue stands in the text; else null. Shorter spans don't count."""
    spans = F.filter(F.transform(quoted_spans(c), F.trim), lambda x: F.length(compact(retrieval(x))) >= least)
    return F.when(c.rlike(cue) & (F.size(spans) == 1), F.get(spans, F.lit(0)))


def html_escape(c: Column) -> Column:
    """Text that may stand in HTML, quotes included."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def utc_stamp(ts: Column) -> Column:
    """An instant as ISO 8601 in UTC."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


#: Words of requests that describe no meaning (fixed values); some can't match normalized tokens and stay for parity.
NON_CONTENT = (
    "آیا اگر اما از است استفاده اصطلاح اصطلاحی الان امروز این آن با باشد برای به بود تا تقریبا تقریباً چرا چطور چقدر چیست چه چیزی حالتی حالا در دیروز را رو روی شد شدن"
    " ضرب ضربالمثل ضرب‌المثل فردا کرد کرده کردن کدام که کسی گفته مناسب مناسبی معنا معنای معنی مورد می میشه میشود میگن میگوید می‌شود می‌گوید هیچ هست هستند و وقتی یک یا شود کند کار هم"
).split()


def meaning_evidence(query: Column, gloss: Column, stop: list[str] | None = None) -> Column:
    """Content tokens that a request and a gloss share, and the share of either that they are; 0 without any."""
    stop = NON_CONTENT if stop is None else stop
    q, g = (content_tokens(tokens(retrieval(c)), stop) for c in (query, gloss))
    shared = F.array_sort(F.array_intersect(q, g))
    part = lambda x: F.when(F.size(x) > 0, F.size(shared) / F.size(x)).otherwise(0.0)
    return F.struct(shared.alias("shared"), (F.size(shared) > 0).alias("anchored"), part(q).alias("query_support"), part(g).alias("gloss_support"))
