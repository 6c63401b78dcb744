"""What a request asks for, from cues in its wording, and the phrase that it wants restored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundphrase.functions.cues import any_of
from groundphrase.operators.plan import intent

#: Patterns (fixed values) over text with light normalization (`plain`).
CUES = {
    "fictional": (r"(?:ساختگی|خیالی|اختراع\s+کن|از\s+خودت\s+بساز|جعلی\s+بساز|یه\s+مثل\s+جدید\s+بساز)",),
    "forbids": (
        r"(?:هیچ\s+)?(?:ضرب\s*المثل|مثل|اصطلاح|کنایه|تعبیر).{0,28}(?:نیاور|نیار|استفاده\s+نکن|به\s*کار\s+نبر|نذار|نباشه|قرار\s+نده)",
        r"(?:نیاور|نیار|استفاده\s+نکن|به\s*کار\s+نبر|نذار|نباشه).{0,28}(?:ضرب\s*المثل|مثل|اصطلاح|کنایه|تعبیر)",
    ),
    "examples": (
        r"(?:(?:یک|دو|سه|چهار|پنج|شش|هفت|هشت|نه|ده|چند|\d+)\s*(?:تا\s*)?(?:ضرب\s*المثل|مثل|اصطلاح|کنایه|تعبیر).{0,35}(?:می\s*خوام|میخوام|بگو|بده|مثال|نمونه)|(?:ضرب\s*المثل|اصطلاح|تعبیر).{0,30}(?:مثال\s*بزن|نمونه\s*بده))",
    ),
    "meta": (
        r"(?:ضرب\s*المثل\s*ها|مثل\s*ها|اصطلاح\s*ها|کنایه\s*ها|تعبیر\s*ها).{0,45}(?:ترجمه|فرهنگ|زبان|ادبیات|چرا|نقش|مفهوم|تحلیل|ویژگی)",
        r"(?:ترجمه|فرهنگ|زبان|ادبیات).{0,45}(?:ضرب\s*المثل\s*ها|مثل\s*ها|اصطلاح\s*ها|کنایه\s*ها|تعبیر\s*ها)",
    ),
    "exact": (r"(?:دقیقاً|دقیقا|همین|به\s+همین\s+صورت).{0,45}(?:ثبت\s*(?:شده|شدن|شده\s*اند)|تایید|تأیید|وجود\s+داره).{0,20}(?:\?|هست|است|؟)",),
    "restore": (
        r"(?:اصلش\s+چی|درستش\s+(?:چی|رو\s+(?:بگو|بده))|شکل\s+(?:درست|معیار|ثبت\s*شده)|صورت\s+(?:درست|معیار|ثبت\s*شده)|صورتش\s+رو\s+(?:بگو|بده)|کاملش\s+چی|ادامه\s*(?:اش|ش)\s+چی|یادم\s+(?:رفته|نیست)|فکر\s+کنم\s+می\s*گن|فکر\s+کنم\s+میگن|اشتباه\s+نوشتم|غلط\s+گفتم|تصحیح\s+کن|اصلاح\s+کن)",
    ),
    "attest": (
        r"(?:واقع(?:ی|اً)|اصیل|معتبر|درست|ثبت\s*(?:شده|شدن|شده\s*اند)|وجود\s+داره|ضرب\s*المثل\s+هست|اصطلاح\s+هست).{0,35}(?:\?|هست|نیست|یا|؟)",
        r"(?:در|توی)\s+پیکره.{0,35}ثبت\s*(?:شده|شدن|هست|است)",
        r"(?:این|اون).{0,40}(?:واقعیه|اصله|معتبره|درسته)",
    ),
    "explain": (
        r"(?:یعنی\s+چی|معن(?:ی|یش)\s*(?:چیه|چیست)|منظورش\s+چیه|معن(?:ی|یش)\s*(?:رو|شو)?\s*(?:بگو|بگید|بده|بدین)|چه\s+معنی(?:\s*ای)?\s+می\s*ده|توضیح(?:ش)?\s+بده|ک[ِی]?\s+به\s+کار\s+می\s*ره)",
    ),
    "noun": (r"(?:ضرب\s*المثل|مثل(?:\s+واقعی|\s+فارسی)?|اصطلاح(?:\s+فارسی|\s+رایج)?|کنایه|تعبیر(?:\s+رایج|\s+فارسی)?|عبارت\s+رایج|جمله\s+رایج)",),
    "search": (
        r"(?:می\s*خوام|میخوام|می\s*خواهم|میخواهم|بگو|بگید|پیشنهاد|پیدا\s*کن|بیار|بذار|بگذار|اضافه\s*کن|استفاده\s*کن|جا\s*بده|قرار\s*بده|مناسب|معادل|جای\s+این|برای\s+این|برای\s+این\s+موقعیت)",
    ),
    "context": (r"(?:برای\s+(?:وقتی|کسی|آدم|این|وضع|وضعیت|حالت|موقعیت)|درباره\s+(?:اینکه|این|موضوع)|مناسب\s+(?:این|برای)|مفهوم|معنی|منظور|که\s+.{4,}|وقتی\s+.{4,})",),
    "indirect": (
        r"(?:چی\s*می\s*گن|چی\s*میگن|چه\s*می\s*گن|چه\s*میگن|وقتی.+چی\s*می\s*گن|برای\s+این\s+(?:وضع|وضعیت|حالت|موقعیت).+چی|یه\s+چیزی\s+(?:هست|نیست)\s+که\s+می\s*گن|چطور\s+(?:عامیانه|رایج|اصطلاحی)\s+بگم|یه\s+جمله\s+جا\s*افتاده.+(?:بگو|میخوام|می\s*خوام))",
    ),
}
#: A writing task, and a phrase to be put into it; the second set of nouns is the composer's (fixed values).
WRITING = (
    r"(?:پیام|متن|کپشن|نامه|ایمیل|جواب|پست|استوری|یادداشت).{0,35}(?:بنویس|بساز|آماده\s+کن|درست\s+کن)",
    r"(?:بنویس|بساز|آماده\s+کن|درست\s+کن).{0,35}(?:پیام|متن|کپشن|نامه|ایمیل|جواب|پست|استوری|یادداشت)",
)
PHRASE, PHRASE_OR_SAYING = r"(?:ضرب\s*المثل|مثل|اصطلاح|کنایه|تعبیر)", r"(?:ضرب\s*المثل|مثل|اصطلاح|کنایه|تعبیر|گفته|عبارت|جمله)"
INSERT = (r"{}.{{0,45}}(?:داخل|توی|تو\s+ی|آخر|بذار|بگذار|بیار|استفاده\s+کن|جا\s+بده|قرار\s+بده)", r"(?:داخلش|توش|توی\s+متن|آخرش).{{0,45}}{}")
#: Scope of several mentions (fixed values).
SCOPE = {
    "all_mentions": (r"(?:هر\s*دو|هردو|هر\s*کدوم|هر\s*کدام|هر\s+کدام|دوتاشون|دو\s*تاشون)",),
    "one_unknown": (r"(?:فقط\s+یکی|یکی\s+از\s+این\s+(?:دو|دوتا)).{0,60}(?:نمی\s*گم|نمیگم|مشخص\s+نمی\s*کنم|معلوم\s+نمی\s*کنم)",),
    "after_target": (r"(?:یعنی\s+چی|منظورش\s+چیه|معن(?:ی|یش)\s*(?:رو|شو)?\s*(?:بگو|بده|چیه)|ک[ِی]?\s+به\s+کار\s+می\s*ره)",),
    "exact_question": (
        r"(?:دقیقاً|دقیقا|همین|به\s+همین\s+صورت).{0,45}(?:ثبت\s*(?:شده|شدن|شده\s*اند)|تایید|تأیید|وجود\s+داره|عبارت\s+فارسی).{0,20}(?:\?|هست|است|؟)",
        r"(?:ثبت\s*شده|تایید|تأیید).{0,30}(?:دقیقاً|دقیقا|همین\s+صورت)",
    ),
}
#: What asks for the right wording of what stands before it, that something stands before it, and what goes from
#: that (fixed values).
RESTORE_CUE = r"(?:اصلش|درستش|کاملش|صورت(?:ش)?\s+(?:ثبت\s*شده|درست|معیار|اصلی)|شکل(?:ش)?\s+(?:ثبت\s*شده|درست|معیار|اصلی)|نسخه(?:ش)?\s+(?:درست|اصلی)).{0,30}(?:بگو|بده|چی(?:ه|ست)?)"
SUPPLIED = r"(?:رو|را).{0,35}(?:عامیانه|محاوره(?:‌|\s)?ای|غلط|اشتباه|ناقص|نوشتم|گفتم|شنیدم|اصلش|درستش|صورت|شکل|نسخه)"
NOISE_TAIL = r"\s+(?:رو|را)\s+(?:(?:عامیانه|محاوره(?:‌|\s)?ای|غلط|اشتباه|ناقص|تقریبی)\s*)?(?:(?:نوشتم|گفتم|شنیدم|یادم\s+مونده|یادم\s+هست))?\s*$"
META_START = r"^(?:چطور|چگونه|روش|برای\s+اینکه|آیا\s+می\s*شه)"
EDGES, LETTERS = r" ،,:؛;\-.\n\t", "[ءآأإؤئابتثجچحخدذرزژسشصضطظعغفقکگلمنوهی]+"


def plain(c: Column) -> Column:
    """Joiners as blanks, letters that count as one folded, small."""
    return F.lower(F.translate(c, "‌يكۀ", " یکه"))


def cues(c: Column) -> dict[str, Column]:
    """Every cue of CUES over a request."""
    return {k: any_of(plain(c), p) for k, p in CUES.items()}


def signal(c: Column, mentions: Column) -> Column:
    """The intent of a request in which `mentions` phrases of the corpus stand; null counts as blank."""
    x = cues(c)
    names = ("fictional", "forbids", "examples", "meta"), ("exact", "restore", "attest", "explain", "noun", "search", "context", "indirect")
    return intent(F.trim(F.coalesce(c, F.lit(""))) == "", *(x[k] for k in names[0]), mentions, *(x[k] for k in names[1]))


def needs_composition(c: Column, noun: str = PHRASE) -> Column:
    """The request is to write something with a phrase in it."""
    p = plain(c)
    return any_of(p, WRITING) & any_of(p, tuple(x.format(noun) for x in INSERT))


def scope(c: Column) -> dict[str, Column]:
    """Cues of which of several mentions is meant."""
    spaced = F.replace(c, F.lit("‌"), F.lit(" "))
    return {k: any_of(spaced, p) for k, p in SCOPE.items()}


def restore_target(c: Column) -> Column:
    """What stands before an explicit wish for the right wording, without remarks at its end; null unless it has three
    words and isn't a question about restoring."""
    before = F.regexp_extract(c, f"(?Us)^(.*?)(?:{RESTORE_CUE})", 1)
    cue = F.regexp_extract(c, f"(?U){RESTORE_CUE}", 0)
    trim = lambda x: F.regexp_replace(x, f"^[{EDGES}]+|[{EDGES}]+$", "")
    prefix = trim(before)
    cleaned = trim(F.regexp_replace(prefix, f"(?U){NOISE_TAIL}", ""))
    ok = (cue != "") & (prefix != "") & F.concat(prefix, F.lit(" "), cue).rlike(f"(?U){SUPPLIED}")
    ok = ok & (F.size(F.regexp_extract_all(cleaned, F.lit(LETTERS), F.lit(0))) >= 3) & ~cleaned.rlike(f"(?U){META_START}")
    return F.when(ok, cleaned)
