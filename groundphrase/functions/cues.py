"""Lexical cues of requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundphrase.functions import text as tx

#: Patterns (fixed values) that ask for a phrase by its meaning, for a phrase's wording, and whether it is real.
MEANING = (
    r"(?:چه|کدام|یه)\s+(?:ضرب\s*[‌ ]?المثل|مثل|مثلی|اصطلاح|اصطلاحی)",
    r"(?:ضرب\s*[‌ ]?المثل|مثل|اصطلاح)\s+(?:برای|مناسب)",
    r"برای\s+(?:این\s+)?(?:معنی|معنا|مفهوم|حالتی)",
    r"(?:معنی|معنا|مفهوم)\s+(?:می[‌ ]?خوام|مناسب|این)",
    r"چه\s+(?:مثلی|اصطلاحی)\s+(?:داریم|میگن|می‌گن|به\s+کار)",
    r"چی\s+می[‌ ]?گن",
    r"مثل\s+معروف\s+می[‌ ]?خوام",
    r"می[‌ ]?خوام\s+که\s+بگه",
)
SURFACE = (
    r"چی\s*بود",
    r"یادم\s+(?:رفته|نمیاد|نمی‌آد|نمیادش)",
    r"کاملش\s+کن",
    r"ادامه(?:ش|اش)",
    r"درستش\s+(?:چیه|چیست)",
    r"صورت\s+درست",
    r"چطور\s+بود",
    r"می[‌ ]?گفت\s*[«“\"]",
    r"اون\s+(?:ضرب\s*[‌ ]?المثل|مثله)",
)
ATTESTATION = (
    r"(?s)[«“\"][^»”\"]+[»”\"].{0,64}(?:واقعی|اصیل|معتبر|ساختگی|جعلی|درسته|درست\s+است)",
    r"(?s)[«“\"][^»”\"]+[»”\"].{0,48}(?:ضرب\s*[‌ ]?المثل|مثل|اصطلاح|عبارت).{0,12}(?:است|هست|محسوب\s+می[‌ ]?شود)",
    r"(?:این\s+)?(?:ضرب\s*[‌ ]?المثل|مثل|مثلی|اصطلاح(?:ی)?|عبارت)\s+(?:واقعیه|واقعی\s+است|اصیله|اصیل\s+است|معتبره|معتبر\s+است|ساختگیه|ساختگی\s+است|جعلیه|جعلی\s+است|درسته|درست\s+است|وجود\s+داره|وجود\s+دارد)",
)
#: What surrounds a quoted phrase that is asked for, and one whose being real is asked for (fixed values).
WRAPPER = r"(?:ضرب\s*[‌ ]?المثل|(?:^|\s)مثل(?:\s|$)|چی\s*بود|چیست|می[‌ ]?گفت|میگه|یادم|جمله|عبارت|گفته)"
REAL = r"(?:ضرب\s*[‌ ]?المثل|(?:^|\s)مثل(?:\s|$)|واقعی|اصیل|معتبر|وجود\s+دارد|درسته|درست\s+است|هست|است)"
#: Words that a described meaning leans on (fixed values).
SCAFFOLD = ("وقتی", "حالتی", "کسی", "معنی", "معنا")
#: Coarse words, and requests that allow them (fixed values).
COARSE = ("گه", "گوه", "کون", "پیزی", "ماتحت", "نریده", "رید", "ریده")
ALLOWS_COARSE = r"(?:رکیک|زشت|فحش|خیلی\s+عامیانه|کوچه\s*بازاری|تند\s+و\s+زننده|بی\s*ادبانه)"


def any_of(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(f"(?U){p}")
    return out


def technical(c: Column) -> Column:
    """A token of ASCII letters and digits stands in the normalized text."""
    return F.exists(tx.tokens(tx.retrieval(c)), lambda t: t.rlike("^[A-Za-z0-9_+./:-]+$"))


def explicit(c: Column) -> dict[str, Column]:
    return {"attestation": any_of(c, ATTESTATION), "meaning": any_of(c, MEANING), "surface": any_of(c, SURFACE), "technical": technical(c)}


def scaffold(c: Column) -> Column:
    """A word that a described meaning leans on stands in the raw text; null counts as none."""
    return F.coalesce(F.lit(False) | F.exists(F.array(*map(F.lit, SCAFFOLD)), lambda w: F.contains(c, w)), F.lit(False))


def unsuitable(phrase: Column, request: Column) -> Column:
    """A coarse word stands in the phrase and the request does not ask for such."""
    words = F.regexp_extract_all(phrase, F.lit("[؀-ۿ]+"), F.lit(0))
    return F.arrays_overlap(words, F.array(*map(F.lit, COARSE))) & ~request.rlike(f"(?U){ALLOWS_COARSE}")
