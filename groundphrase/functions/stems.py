"""A light stemmer for colloquial phrases, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colloquial forms, light verb roots, and what carries no meaning of its own (fixed values).
COLLOQUIAL = {
    "زبون": "زبان", "دهن": "دهان", "ناخون": "ناخن", "شونه": "شانه", "خودشو": "خود", "خودش": "خود",
    "نمیشه": "نشدن", "نمیبره": "نبردن", "میکنه": "کردن", "میکنند": "کردن", "میگه": "گفتن", "میگن": "گفتن",
}
ROOTS = {"زد": "زدن", "شد": "شدن", "کرد": "کردن", "گفت": "گفتن", "برد": "بردن", "داد": "دادن", "گرفت": "گرفتن"}
STOP = ("را", "رو", "به", "از", "در", "تو", "توی", "برای", "یک", "یه", "و", "که", "کسی", "خود")
LIGHT = ("کردن", "شدن", "زدن", "گفتن", "بودن", "داشتن", "دادن", "گرفتن", "بردن", "آوردن")
#: Endings, the first that fits goes (fixed values).
POSSESSIVE = ("شان", "شون", "مون", "تون", "اش", "ش")
VERBAL = ("یدن", "اند", "ید", "یم", "ین", "ند", "م", "ی", "ه")


def _mapped(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c), c)


def _without(c: Column, endings: tuple[str, ...]) -> Column:
    """c without its longest such ending, if three letters stay."""
    return F.regexp_replace(c, f"^(.{{3,}}?)(?:{'|'.join(endings)})$", "$1")


def stem(token: Column) -> Column:
    t = _mapped(_without(_mapped(token, COLLOQUIAL), POSSESSIVE), COLLOQUIAL)
    return _mapped(_without(F.regexp_replace(t, "^(?:نمی|می|ن)", ""), VERBAL), ROOTS)


def signature(text: Column) -> Column:
    """The stems of a text's words in order, without stop words, light verbs and single letters."""
    plain = F.lower(F.translate(F.replace(text, F.lit("‌"), F.lit(" ")), "يك", "یک"))
    stems = F.transform(F.regexp_extract_all(plain, F.lit("[؀-ۿ]+"), F.lit(0)), stem)
    return F.filter(stems, lambda s: (F.length(s) > 1) & ~s.isin(*STOP, *LIGHT))


#: The extended stemmer's letters, forms and stop words (fixed values).
WIDE_LETTERS = "[ءآأإؤئابپتثجچحخدذرزژسشصضطظعغفقکكگلمنوهةۀهیيى]+"
WIDE_COLLOQUIAL = {
    "زبون": "زبان", "دهن": "دهان", "ناخون": "ناخن", "شونه": "شانه", "خودشو": "خود", "خودش": "خود", "نمیشه": "شدن", "میشه": "شدن", "شه": "شدن", "بشه": "شدن", "بشود": "شدن",
    "میکنه": "کردن", "میکنند": "کردن", "میگه": "گفتن", "میگن": "گفتن",
}
WIDE_STOP = ("را", "رو", "به", "از", "در", "تو", "توی", "برا", "برای", "یک", "یه", "و", "که", "کسی", "خود", "این", "اون", "آن")


def _wide_stems(tokens: Column) -> Column:
    """The stems of an array of words, step by step, so that no step's expression is repeated in the next."""
    out = F.transform(tokens, lambda t: _mapped(t, WIDE_COLLOQUIAL))
    out = F.transform(out, lambda t: _without(t, POSSESSIVE))
    out = F.transform(out, lambda t: _mapped(t, WIDE_COLLOQUIAL))
    out = F.transform(out, lambda t: _without(F.regexp_replace(t, "^(?:نمی|می|ن)", ""), VERBAL))
    return F.transform(out, lambda t: _mapped(t, ROOTS))


def wide_signature(text: Column) -> Column:
    """The stems of a text's words in order, for restoring: a final object marker counts as none where that leaves a
    stem; no stop words, light verbs and single letters."""
    folded = F.lower(F.translate(F.coalesce(text, F.lit("")), "‌يىكۀة", " ییکهه"))
    words = F.regexp_extract_all(folded, F.lit(WIDE_LETTERS), F.lit(0))
    bare = F.transform(words, lambda t: F.regexp_replace(t, "^(.{3,}[^ای])و$", "$1"))
    keep = lambda s: F.when((F.length(s) >= 2) & ~s.isin(*WIDE_STOP, *LIGHT), s)
    return F.filter(F.zip_with(_wide_stems(bare), _wide_stems(words), lambda x, y: F.coalesce(keep(x), keep(y))), lambda s: s.isNotNull())
