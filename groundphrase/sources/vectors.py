"""Frozen vectors: matrices in NumPy files, and the metadata that says what they were made from."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("model_id", "corpus_hash", "dimension", "family_ids", "embeddings_sha256")


def corpus_hash(spark: SparkSession, expressions: str, sources: str, between: bytes = b"\0sources\0") -> str:
    """Sixteen hex digits that two files give together."""
    one = lambda p: spark.read.format("binaryFile").load(p).select(F.col("content").alias("c"))
    a, b = one(expressions).select(F.col("c").alias("a")), one(sources).select(F.col("c").alias("b"))
    got = a.crossJoin(b).select(F.left(F.sha2(F.concat("a", F.lit(between), "b"), 256), F.lit(16)).alias("h")).collect()  # two files, one row each
    if len(got) != 1:
        raise ValueError("one file of expressions and one of sources")
    return got[0].h


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, v) of two-dimensional NumPy files without objects; anything else fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                m = np.load(io.BytesIO(raw.as_py()), allow_pickle=False)
                if m.ndim != 2:
                    raise ValueError(f"{name}: a matrix has two dimensions, not {m.ndim}")
                for at in range(0, len(m), 1024):
                    part = np.ascontiguousarray(m[at : at + 1024], np.float32)
                    v = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * m.shape[1]), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), v], names=["path", "row", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row long, v array<float>")


def write_matrix(path: str, rows: np.ndarray, model_id: str, corpus: str, family_ids: list[str], view_names: list[str] | None = None) -> None:
    """A matrix and, beside it as .json, what it was made from. view_names: for several rows a family."""
    raw = io.BytesIO()
    np.save(raw, np.asarray(rows, np.float32), allow_pickle=False)
    with open(path, "wb") as f:
        f.write(raw.getvalue())
    about = {"model_id": model_id, "corpus_hash": corpus, "dimension": int(rows.shape[1]), "family_ids": family_ids, "embeddings_sha256": hashlib.sha256(raw.getvalue()).hexdigest()}
    with open(f"{path}.json", "w", encoding="utf-8") as f:
        json.dump(about | ({"view_names": view_names} if view_names else {}), f, ensure_ascii=False, indent=2)


def read_frozen(spark: SparkSession, path: str, model_id: str, corpus: str, family_ids: list[str], view_names: list[str] | None = None) -> DataFrame:
    """(row, family_id, view, v) of a frozen matrix; ValueError if the model, the corpus, the order of families or
    views, the file or its shape isn't what the metadata says."""
    with open(f"{path}.json", encoding="utf-8") as f:
        about = json.load(f)
    if missing := [k for k in KEYS if k not in about]:
        raise ValueError(f"metadata lacks {', '.join(missing)}")
    for key, want in (("model_id", model_id), ("corpus_hash", corpus), ("family_ids", family_ids), ("view_names", view_names)):
        if about.get(key) != want:
            raise ValueError(f"{key} is not that of the frozen vectors")
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first().h
    if digest != about["embeddings_sha256"]:
        raise ValueError("the frozen vectors have changed")
    rows = read_matrix(spark, path)
    n, wrong = rows.agg(F.count(F.lit(1)), F.count_if(F.size("v") != about["dimension"])).first()
    if n != len(family_ids) or wrong:
        raise ValueError("the shape of the frozen vectors is not that of the metadata")
    names = spark.createDataFrame([(i, f, (view_names or [None] * n)[i]) for i, f in enumerate(family_ids)], "row long, family_id string, view string")
    return rows.drop("path").join(names, "row").select("row", "family_id", "view", "v")
