"""Near copies by the Jaccard similarity of word shingles: ball hashing and hash blocks propose, the shingles decide.

SimHash fingerprints of the same shingles propose by ball hashing, as everywhere in `simhash`. That alone can't give
right results here: at a similarity of 0.8 two fingerprints differ in 9.7 of 64 bits on average, so a
radius with 0.99 of such pairs is 17, and half of it has billions of variants. So blocks of minima propose too:
minima of permuted shingle hashes, ROWS in a block, bring two texts of similarity s together with probability
1 - (1 - s ** ROWS) ** BLOCKS: 0.99994 at 0.8. A block's texts are first compared with one of them, another one in each
block; what that links is one part, and only texts of different parts that share a block are compared after it,
inside tasks, in tiles of bounded size. So every pair of a block is compared or connected already, and only
links become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundphrase.llm import simhash
from groundphrase.llm.common import components, join_counted, map_text, release, stored
from groundphrase.llm.simhash import BLOCK

WORDS, SIMILARITY_10 = 5, 8  # shingles of five words; tenths
ROWS, BLOCKS = 6, 32
_rng = np.random.default_rng(42)
_FLIP, _TIMES = _rng.integers(0, 1 << 32, (2, ROWS * BLOCKS, 1), np.uint32)
_TIMES |= 1
#: Shingles of a tile, about.
TILE = 1 << 18
#: Shingles permuted at once.
STRIDE = 256


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def node(w: list[bytes]) -> int:
    """One number for all texts of the same words."""
    return int.from_bytes(xxhash.xxh64_digest(b" ".join(w), 7), "big", signed=True)


def shingles(w: list[bytes], n: int = WORDS) -> np.ndarray:
    """The sorted hashes of all runs of n words, each once; a shorter text is one run, a wordless one has none."""
    if not w:
        return np.zeros(0, np.int64)
    digest, out = xxhash.xxh64_digest, []
    for at in range(0, max(1, len(w) - n + 1), BLOCK):
        part = w[at : at + BLOCK + n - 1]
        runs = zip(*(part[i:] for i in range(n)), strict=False) if len(w) >= n else [part]
        out.append(np.frombuffer(b"".join([digest(b" ".join(x), 42) for x in runs]), np.int64))
    return np.unique(np.concatenate(out))


def blocks(s: np.ndarray) -> list[int]:
    """A number for each block of minima; its place is part of it."""
    if not len(s):
        return []
    h, low = (s.view(np.uint64) >> np.uint64(32)).astype(np.uint32), np.full(ROWS * BLOCKS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), STRIDE):
        np.minimum(low, ((h[at : at + STRIDE] ^ _FLIP) * _TIMES).min(axis=1), out=low)
    return [int.from_bytes(xxhash.xxh64_digest(x.tobytes(), i), "big", signed=True) for i, x in enumerate(low.reshape(BLOCKS, ROWS))]


def with_node(df: DataFrame, text: str = "text", out: str = "node") -> DataFrame:
    return map_text(df, text, f"`{out}` long", lambda: lambda texts: [[node(words(t)) for t in texts]])


def _sketched(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def sketch(texts):
        out = [[], [], [], []]
        for t in texts:  # the words of one text at a time
            w = words(t)
            s = shingles(w)
            for x, v in zip(out, (node(w), len(s), simhash.of_hashes(s), blocks(s)), strict=True):
                x.append(v)
        return out

    return map_text(df, text, "node long, n int, fp long, blocks array<long>", lambda: sketch, keep)


def _balls(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that ball hashing proposes: each node with the first of its fingerprint, and linked fingerprints."""
    some = nodes.where("n > 0")
    firsts, _ = stored(some.groupBy("fp").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("rows")), "fingerprints")
    same = join_counted(some.select("fp", F.col("node").alias("b")), firsts.withColumnRenamed("node", "a"), "fp", "rows").where("a != b").select("a", "b")
    return same.unionByName(simhash.links(firsts.select("fp", "node")))


def _shingled(df: DataFrame) -> DataFrame:
    def sets(texts):
        got = [shingles(words(t)) for t in texts]
        return [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, got)]), pa.int32()), pa.array(np.concatenate(got) if got else [], pa.int64()))]

    return map_text(df, "text", "s array<long>", lambda: sets, ["node"])


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("s").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(both * 10 >= (F.size("s_a") + F.size("s_b") - both) * SIMILARITY_10).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _lengths_allow(n, m):
    return F.least(n, m) * 10 >= F.greatest(n, m) * SIMILARITY_10


class _Tile:
    """Nodes, their parts and their shingles: one row of a list column of structs."""

    def __init__(self, col: pa.ListArray, i: int):
        from_, to = col.offsets[i].as_py(), col.offsets[i + 1].as_py()
        rows = col.values.slice(from_, to - from_)
        self.node, self.part = (rows.field(k).to_numpy() for k in (0, 1))
        sets = rows.field(2)
        ends = sets.offsets.to_numpy()
        self.starts, self.sizes = ends[:-1] - ends[0], np.diff(ends)
        self.values = sets.values.slice(ends[0], ends[-1] - ends[0]).to_numpy()


def joined(a: _Tile, b: _Tile, same: bool) -> list[tuple[int, int]]:
    """Links between nodes of different parts, as many as connect what is alike: every pair is compared, unless
    parts have come together before it."""
    _, ids = np.unique(np.concatenate([a.values, b.values]), return_inverse=True)
    ids_a, ids_b = ids[: len(a.values)], ids[len(a.values) :]
    has, out = np.zeros(len(ids), np.int64), []
    part_a, part_b = a.part.copy(), b.part.copy()
    for i in range(len(a.node)):
        n = a.sizes[i]
        open_ = (part_b != part_a[i]) & (np.minimum(b.sizes, n) * 10 >= np.maximum(b.sizes, n) * SIMILARITY_10)
        if same:
            open_[: i + 1] = False
        if not open_.any():
            continue
        mine = ids_a[a.starts[i] : a.starts[i] + n]
        has[mine] = 1
        both = np.add.reduceat(has[ids_b], b.starts)
        has[mine] = 0
        for j in np.flatnonzero(open_ & (both * 10 >= (n + b.sizes - both) * SIMILARITY_10)):
            x, y = part_a[i], part_b[j]
            if x != y:
                out.append((int(a.node[i]), int(b.node[j])))
                part_a[part_a == y] = x
                part_b[part_b == y] = x
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = batch.columns
        got = []
        for i in range(batch.num_rows):
            t = _Tile(one, i)
            got += joined(t, _Tile(two, i), False) if two[i].is_valid else joined(t, t, True)
        a, b = zip(*got, strict=True) if got else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _across(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the parts of blocks: (block, node, part, tiles). A block's nodes are dealt into tiles of
    about TILE shingles, and tiles are compared two by two inside a task: what is no link never becomes a row."""
    rows = open_.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles")).join(sets, "node")
    tile, _ = stored(rows.groupBy("block", "tile", "tiles").agg(F.collect_list(F.struct("node", "part", "s")).alias("one")), "tiles")
    none = F.lit(None).cast(tile.schema["one"].dataType).alias("two")
    # The pairs of a block's tiles are dealt first, each by its own key; then either tile is fetched by its key.
    here = tile.where("tiles > 1").select("block", F.col("tile").alias("i"), "tiles")
    dealt = here.where("i < tiles - 1").withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("tiles") - 1).cast("array<long>"))).select("block", "i", "j")
    one = tile.select("block", F.col("tile").alias("i"), "one")
    two = tile.select("block", F.col("tile").alias("j"), F.col("one").alias("two"))
    pairs = dealt.join(one, ["block", "i"]).join(two, ["block", "j"]).select("one", "two").unionByName(tile.select("one", none))
    return pairs.mapInArrow(_compared, "a long, b long")


def groups(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, node, component) for every row of df: texts of one component are linked by five-word similarities
    of 0.8 or more. Ids play no part; null texts count as empty, and all wordless texts are alike."""
    rows, _ = stored(_sketched(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", ["id"]), "sketches")
    nodes, _ = stored(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("blocks").alias("blocks"), F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "nodes")
    each = nodes.select("node", "n", F.explode("blocks").alias("block"))
    heads = each.groupBy("block").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node", "block")).alias("head"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("size"))
    heads, _ = stored(heads.where("members > 1"), "heads")
    shared, path_0 = stored(join_counted(each, heads.drop("size"), "block", "members").where("head is not null"), "blocks")
    balls, path_1 = stored(_ordered(_balls(nodes)), "balls")
    release(df.sparkSession)
    wanted = shared.select("node").unionByName(balls.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    # One row of a node is enough: that with its smallest id, so the copies of a text don't meet by their node.
    wanted = wanted.join(nodes.select("node", "id"), "node")
    texts = with_node(df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))).alias("t").join(wanted.alias("w"), F.expr("t.node = w.node and t.id <=> w.id"), "left_semi")
    texts = texts.select("text", "node").dropDuplicates(["node"])
    sets, path_2 = stored(_shingled(texts), "shingles")
    release(df.sparkSession)
    near = shared.where((F.col("node") != F.col("head.node")) & _lengths_allow(F.col("n"), F.col("head.n"))).select(F.col("head.node").alias("a"), F.col("node").alias("b"))
    links, _ = stored(_alike(_ordered(near).unionByName(balls).distinct(), sets), "links")
    part, _ = stored(shared.join(components(links), "node", "left").select("block", "node", F.coalesce("component", "node").alias("part")), "parts")
    release(df.sparkSession, path_0, path_1)
    # What is connected needs no more comparing, and blocks of one part are done.
    mixed = part.groupBy("block").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x != y").select("block")
    tiles = F.ceil(F.col("size") / TILE).cast("int").alias("tiles")
    mixed, _ = stored(heads.join(mixed, "block").select("block", "members", tiles), "mixed")
    more, _ = stored(_across(join_counted(part, mixed, "block", "members").where("tiles is not null"), sets), "links")
    release(df.sparkSession, path_2)
    found = components(links.unionByName(more))
    named = nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "copies")
    return join_counted(rows.select("id", "node"), named, "node", "copies").select(F.col("id").alias(id_col), "node", "component")
