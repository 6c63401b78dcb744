"""SimHash near-duplicate groups by ball hashing.

Every distinct fingerprint emits all values within half the radius of it. Two fingerprints within the radius
share one of them, so a shuffle on these values brings each linked pair together. A value is shared by at most
as many fingerprints as lie in its ball (65 for a radius of 2), whatever the data; within a ball all are linked
with each other, so links to its smallest node keep the components whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundphrase.llm.common import components, join_counted, map_text, stored, table

#: Shingles whose bits are summed at once.
BLOCK = 1 << 16


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text as a signed number. Null and wordless texts: 0."""
    w = (text or b"").lower().split()  # of bytes: A-Z only, and ASCII white space
    if not w:
        return 0
    digest, counts, n = xxhash.xxh64_digest, np.zeros(64, np.int64), max(1, len(w) - words + 1)
    for at in range(0, n, BLOCK):
        part = w[at : at + BLOCK + words - 1]
        runs = zip(*(part[i:] for i in range(words)), strict=False) if len(w) >= words else [part]
        got = np.frombuffer(b"".join([digest(b" ".join(x), seed) for x in runs]), np.uint8)
        counts += np.unpackbits(got.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def of_hashes(hashes: np.ndarray) -> int:
    """The SimHash of a set of 64-bit hashes as a signed number; none: 0."""
    counts, n = np.zeros(64, np.int64), len(hashes)
    raw = hashes.astype(">i8").view(np.uint8).reshape(-1, 8)
    for at in range(0, n, BLOCK):
        counts += np.unpackbits(raw[at : at + BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True) if n else 0


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", words: int = 3, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """Add the SimHash of whole texts as a long."""
    return map_text(df, text, f"`{out}` long", lambda: lambda texts: [[fingerprint(t, words, seed) for t in texts]], keep)


def ball(half: int) -> list[int]:
    """All 64-bit masks of at most half set bits, as signed numbers."""
    sums = [sum(1 << i for i in c) for k in range(half + 1) for c in combinations(range(64), k)]
    return [x - (1 << 64) if x >> 63 else x for x in sums]


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between the rows of nodes (fp, node; both distinct) that keep all components at the radius."""
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("the radius must be 0, 2 or 4")
    near = nodes.where("node is not null").select("fp", "node", F.explode(F.array(*map(F.lit, ball(radius // 2)))).alias("mask"))
    near = near.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp", "node")
    w = Window.partitionBy("variant").orderBy("node")
    pairs = near.select("fp", "node", F.first("fp").over(w).alias("fp0"), F.first("node").over(w).alias("node0"))
    return pairs.where((F.col("node") != F.col("node0")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp0"))) <= radius)).select(F.col("node").alias("a"), F.col("node0").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """(id, fp, component_id) for every row of df: component_id is the smallest id that links reach.

    Copies have one fingerprint and become one node before anything is compared. Null texts count as empty; all
    wordless texts have fingerprint 0 and are linked like any other. Rows with a null id get their group's
    smallest id (null if it has none) and don't name groups. Repeated rows come back as often as they are
    there; other columns of df are not carried. An empty table gives an empty result.
    """
    fps, _ = stored(with_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), keep=["id"]), "fingerprints")
    nodes, _ = stored(fps.groupBy("fp").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")), "nodes")
    groups = components(links(nodes, radius))
    named = nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"), "n")
    return join_counted(fps, named, "fp", "n").select(F.col("id").alias(id_col), "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component; near_duplicates() says what becomes of nulls, wordless texts, repeats and
    null ids. A bit that is set in exactly half of the hashes is 0."""
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
ORACLE_SQL: dict[str, str] = {}
