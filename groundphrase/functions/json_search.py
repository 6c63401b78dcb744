"""Search for a key in JSON of any shape."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels and places of an array that are looked at (fixed values).
DEPTH, PLACES = 8, 64
HIT = "path string, value string"


def first_hit(text: str | None, aliases: frozenset[str], backwards: bool = False) -> tuple[str | None, str | None]:
    """(path, value as JSON) of the first key among aliases (small letters) in a JSON text; (None, None) without any or
    if it isn't JSON. An object's own keys come before those inside its values, the first value's before the next one's;
    backwards: the last value's before the one before it, as a stack that is filled in order gives them.
    """
    try:
        todo = [("$", json.loads(text), 0)] if text is not None else []
    except ValueError:
        return None, None
    while todo:
        path, x, depth = todo.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                if k.lower() in aliases:
                    return f"{path}.{k}", json.dumps(v, ensure_ascii=False, separators=(",", ":"))
            inside = [(f"{path}.{k}", v, depth + 1) for k, v in x.items()]
        else:
            inside = [(f"{path}[{i}]", v, depth + 1) for i, v in enumerate(x[:PLACES])] if isinstance(x, list) else []
        if depth < DEPTH:
            todo += inside if backwards else inside[::-1]
    return None, None


def find_key(c: Column, aliases: list[str], backwards: bool = False) -> Column:
    """A struct (path, value) of the first hit in each JSON text; texts that name none of the keys never leave the JVM."""
    wanted = frozenset(a.lower() for a in aliases)

    @F.pandas_udf(HIT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([first_hit(t, wanted, backwards) for t in texts], columns=["path", "value"])

    low, named = F.lower(c), F.lit(False)
    for a in sorted(wanted):
        named = named | low.contains(a) if a.isascii() and a.isalnum() else F.lit(True)
    return F.when(named | F.contains(c, F.lit("\\u")), run(c))
