"""Where models plug in: callables that get batches of texts. Offline stand-ins are deterministic."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefixes of queries and passages that encoders expect (fixed values).
PREFIXES = {"plain": ("", ""), "e5": ("query: ", "passage: ")}


def hashed_vectors(texts: list[str], size: int = 64) -> np.ndarray:
    """Signed hashes of character trigrams, L2-normalized; a text without letters gets the first axis."""
    out = np.zeros((len(texts), size))
    for row, t in zip(out, texts, strict=True):
        for i in range(max(1, len(t) - 2)):
            h = int.from_bytes(hashlib.blake2b(t[i : i + 3].encode(), digest_size=8).digest(), "little")
            row[h % size] += 1 if h >> 63 else -1
        if not row.any():
            row[0] = 1
        row /= np.linalg.norm(row)
    return out


def with_vectors(df: DataFrame, text: str, out: str = "v", encode: Callable[[list[str]], np.ndarray] = hashed_vectors, family: str = "plain", query: bool = True) -> DataFrame:
    """Add vectors of a column from an encoder that each worker calls in batches."""
    prefix = PREFIXES[family][0 if query else 1]

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([v.astype("float32").tolist() for v in encode([prefix + (t or "") for t in s])])

    return df.withColumn(out, run(F.col(text)))


def with_model(df: DataFrame, prompt: Column, complete: Callable[[str], str], out: str = "answer") -> DataFrame:
    """Add a model's answer and, where it failed, the error instead of an exception."""

    @F.pandas_udf(T.StructType([T.StructField(out, T.StringType()), T.StructField("error", T.StringType())]))
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for p in s:
            try:
                rows.append((complete(p), None))
            except Exception as e:  # a failed call is data: the caller decides what it means
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=[out, "error"])

    return df.withColumn("_m", run(prompt)).select("*", f"_m.{out}", F.col("_m.error").alias(f"{out}_error")).drop("_m")


def clean_json(answer: Column) -> Column:
    """A model's answer without its thoughts and code fences."""
    c = F.regexp_replace(answer, r"(?s)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def strict_json(answer: Column, schema: str, fields: list[str]) -> Column:
    """The answer as a struct; null unless it is one object with exactly these fields."""
    c = clean_json(answer)
    keys = F.json_object_keys(c)
    exact = keys.isNotNull() & (F.array_sort(keys) == F.array(*map(F.lit, sorted(fields))))
    return F.when(exact, F.from_json(c, schema))


def messages(system: str, user: Column) -> Column:
    """A chat request as JSON, letters as they are."""
    return F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))))


def snapshot_metadata(path: str, model_id: str, family_ids: list[str], dimension: int, digest: str) -> None:
    """Write what a table of vectors was made from, to be checked when it is read."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"model_id": model_id, "family_ids": family_ids, "dimension": dimension, "normalized": True, "embeddings_sha256": digest}, f, ensure_ascii=False, indent=2)


def check_snapshot(path: str, model_id: str, family_ids: list[str], vectors: DataFrame) -> None:
    """ValueError unless the vectors (family_id, v) are those that the metadata describes."""
    with open(path, encoding="utf-8") as f:
        m = json.load(f)
    n, wrong = vectors.agg(F.count(F.lit(1)), F.count_if(F.size("v") != m["dimension"])).first()
    if m["model_id"] != model_id or m["family_ids"] != family_ids or n != len(family_ids) or wrong:
        raise ValueError("the vectors don't belong to this corpus or model")
