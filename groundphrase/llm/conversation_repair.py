"""Conversation structure repair by composing weighted automata.

A conversation is an acceptor of its rows in order; an edit transducer keeps, re-roles, deletes or inserts rows at
a cost; a grammar acceptor allows only certain sequences of role initials. Their composition is walked lazily: arcs are
made for the grammar states and row kinds that occur, and remembered. It is a lattice in the order of rows, so one
pass finds the shortest path under the weight (cost, labels), smaller labels winning among equal costs.

Labels of paths that have read the same rows end alike or not at all: each row gives one letter that is not an
insertion and ends its part, so none of two different ones begins the other. Thus it is enough to know how the few live
states' labels compare; the next step compares those ranks and the letters that are added. Each state carries the
running hash of what its best path writes, and a byte a row says which arc it came by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundphrase.llm.common import small_batches, stored, table

#: (s?(ua)+)? as a deterministic acceptor: state -> role initial -> state.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = frozenset((0, 3))
ROLES = {"u": "user", "a": "assistant"}
RIGHT = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def insertions(q: int) -> Iterator[tuple[int, str, int, str]]:
    """(state, labels, cost, initials written) of what may be inserted at a state; no state is met twice."""
    paths, seen = [(q, "", 0, "")], {q}
    while paths:
        p, labels, cost, out = paths.pop()
        yield p, labels, cost, out
        for x in ROLES:
            if (to := GRAMMAR[p].get(x)) is not None and to not in seen:
                seen.add(to)
                paths.append((to, labels + "I", cost + INSERT, out + x))


@lru_cache(maxsize=256)
def arcs(q: int, initial: str, gone: bool, cut: bool) -> tuple[tuple[int, str, int, str, str], ...]:
    """Composed arcs that read one row at a grammar state: (next state, labels, cost, initials inserted, role).

    role: '' for a deleted row, '=' for its own, else the initial of the new one. Only the best arc to each state.
    """
    best: dict[int, tuple] = {}
    for p, labels, cost, out in insertions(q):
        edits = [(p, "D", DELETE, "")]
        if not gone:
            extra = CUT if cut else 0
            edits += [(GRAMMAR[p].get(initial), "K", KEEP + extra, "=")] + [(GRAMMAR[p].get(x), "R", REROLE + extra, x) for x in ROLES]
        for to, label, more, role in edits:
            if to is not None and ((arc := (cost + more, labels + label, out, role)) < best.get(to, (1 << 60,))):
                best[to] = arc
    return tuple((to, labels, cost, out, role) for to, (cost, labels, out, role) in sorted(best.items()))


#: All that one row can add to the labels; a byte of a path's record names one and the state before.
PARTS = [i * "I" + x for i in range(4) for x in "DKR"]


@dataclass
class _Path:
    cost: int
    rank: int
    text: object  # the running hash
    any: bool = False

    def wrote(self, lines: list[tuple[bytes, bytes]]) -> _Path:
        p = _Path(self.cost, 0, self.text.copy() if lines else self.text, self.any or bool(lines))
        for i, (role, text) in enumerate(lines):
            p.text.update((b"\n" if self.any or i else b"") + role + b":")
            p.text.update(text)
        return p


@dataclass
class Repair:
    """One conversation; add() takes its rows in order, result() gives FIELDS."""

    live: dict[int, _Path] = field(default_factory=lambda: {0: _Path(0, 0, hashlib.sha256())})
    back: bytearray = field(default_factory=bytearray)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: list = field(default_factory=lambda: [0, 0, 0])  # distinct ones, the first, the last
    before: str | None = None

    def add(self, turn: int | None, role: str, text: bytes, fault: str, n: int = 1) -> None:
        """n equal rows in a row; fault: blank, duplicate, truncated or ''. All but the first repeat it."""
        if turn is not None and (not self.turns[0] or turn != self.turns[2]):
            self.turns = [self.turns[0] + 1, self.turns[1] if self.turns[0] else turn, turn]
        initial = role[:1]
        for k in range(n):
            what = "duplicate" if k and fault != "blank" else fault
            if what:
                setattr(self, what, getattr(self, what) + 1)
            self.illegal += self.before is not None and self.before + initial not in RIGHT
            self.before = initial
            self._step(initial if initial in ("s", "u", "a") else "", role, text, what)

    def _step(self, initial: str, role: str, text: bytes, fault: str) -> None:
        best: dict[int, tuple] = {}
        for q, path in self.live.items():
            for to, labels, cost, out, new in arcs(q, initial, fault in ("blank", "duplicate"), fault == "truncated"):
                key = (path.cost + cost, path.rank, labels)
                if to not in best or key < best[to][0]:
                    best[to] = (key, q, out, new)
        record, live = bytearray(4), {}
        for rank, to in enumerate(sorted(best, key=lambda x: best[x][0][1:])):
            (cost, _, labels), q, out, new = best[to]
            lines = [(ROLES[x].encode(), b"") for x in out] + ([((role if new == "=" else ROLES[new]).encode(), text)] if new else [])
            live[to] = self.live[q].wrote(lines)
            live[to].cost, live[to].rank = cost, rank
            record[to] = 4 * PARTS.index(labels) + q
        self.live = live
        self.back += record

    def result(self) -> tuple:
        ends = [(path.cost + cost, path.rank, labels, q, out) for q, path in self.live.items() for p, labels, cost, out in insertions(q) if p in FINAL]
        cost, _, last, q, out = min(ends)
        done = self.live[q].wrote([(ROLES[x].encode(), b"") for x in out])
        parts, at = [last], q
        for i in range(len(self.back) - 4, -1, -4):
            part, at = divmod(self.back[i + at], 4)
            parts.append(PARTS[part])
        n, low, high = self.turns
        return (high - low + 1 - n if n else 0, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(reversed(parts)), done.text.hexdigest())


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows after the damage that crc32(`conv_id:turn`) % 20 chooses, nulls as one
    space; n is 2 for repeated rows, and 0 for dropped ones, which keep nothing but their conversation."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    kept = kind != 0
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.when(kept, F.col("turn").cast("long")).alias("turn"), F.when(kept, F.when(kind == 4, "user").otherwise(space("role"))).otherwise("").alias("role"),
        F.when(kept, text).otherwise("").alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def last_mark(text: Column) -> Column:
    """The last character that is no white space; empty if there is none."""
    return F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, fault): each row's first fault; that it repeats one of its own turn is left to
    repaired(), where such rows are neighbours.

    A row is a duplicate if its role and text stand at an earlier turn. Which do is found on hashes of texts alone,
    added up before they are shuffled, and written; texts move for it only where that table is too large to send.
    """
    rows = rows.withColumn("h", F.unhex(F.sha2("text", 256)))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = rows.where("n > 0").groupBy("conv_id", "role", "h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last")
    again, _ = stored(again, "repeats")
    on = F.expr("l.conv_id <=> a.conv_id and l.role = a.role and l.h = a.h")
    both = rows.alias("l").join(again.alias("a"), on, "left").select("l.conv_id", "l.turn", "l.role", "l.text", "l.n", (F.col("a.first") < F.struct(F.col("l.turn").isNotNull().alias("known"), "l.turn")).alias("later"))
    mark = last_mark(F.col("text"))
    fault = F.when(mark == "", "blank").when(F.col("later"), "duplicate").when(~mark.isin(".", "!", "?"), "truncated").otherwise("")
    return both.withColumn("fault", fault).drop("later")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, FIELDS) of rows with their faults, one for each conversation that has any row, dropped ones included."""
    small_batches(rows.sparkSession)
    ordered = rows.select("conv_id", "turn", "role", F.col("text").cast("binary").alias("text"), "n", "fault").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = ["conv_id", *(f.split()[0] for f in FIELDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, done, last = None, None, [], None

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)
            done.clear()
            return out

        for b in batches:
            for c, turn, role, text, n, fault in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if now is None or c != conv:
                    if now is not None:
                        done.append((conv, *now.result()))
                    conv, now, last = c, Repair(), None
                if n:
                    now.add(turn, role, text, "duplicate" if fault != "blank" and last == (turn, role, text) else fault, n)
                    last = turn, role, text
            if done:
                yield flush()
        if now is not None:
            done.append((conv, *now.result()))
            yield flush()

    return ordered.mapInArrow(run, f"conv_id long, {FIELDS}")


def repair(df: DataFrame) -> DataFrame:
    """(conv_id, FIELDS) of whole conversations (conv_id, turn, role, text) as they are, each at least cost.

    Rows are taken by turn (null first), then role, then text. Null roles and texts count as one space, which
    is no role and blank. A null conv_id is a conversation of its own. Repeated rows are duplicates of each other.
    A conversation's rows are spread over tasks up to the last step; there they are read in order, in small batches, since the
    hash of its text is one chain. What is held of it then is four bytes a row and its audit. An empty table
    gives an empty result; other columns are not read.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.lit(1).cast("long").alias("n"))
    return repaired(with_faults(rows))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of `conversations` after the damage, counted and repaired; see repair() for nulls, ties, repeats."""
    return repaired(with_faults(damaged(table(spark, sf_dir, "conversations"))))


_SPACE = "coalesce({}::VARCHAR, ' ')"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"
_MARK = r"right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)"
_SQL = f"""WITH RECURSIVE raw AS (SELECT conv_id, turn, {_SPACE.format("role")} AS role, {_SPACE.format("text")} AS text, {_SPACE.format("conv_id")} || ':' || {_SPACE.format("turn")} AS k FROM conversations),
hit AS (SELECT *, {_CRC} % 20 AS f FROM raw),
hurt AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE f WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, {_MARK} AS m FROM hurt),
faulty AS (SELECT *, CASE WHEN m = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN m NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS two FROM numbered),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b')::BIGINT AS blank, count(*) FILTER (fault = 'd')::BIGINT AS duplicate, count(*) FILTER (fault = 't')::BIGINT AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(i) AS n FROM faulty GROUP BY 1),
convs AS (SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(n, 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id),
g(q, o, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(q, q2, l, c, o) AS (SELECT q, q, '', 0, []::VARCHAR[] FROM (SELECT unnest(range(4)) AS q) UNION ALL SELECT ins.q, g.q2, l || 'I', c + 5, list_append(ins.o, CASE g.o WHEN 'u' THEN 'user:' ELSE 'assistant:' END) FROM ins JOIN g ON g.q = ins.q2 WHERE g.o <> 's' AND length(l) < 3),
ed(a, q, o, q2, c) AS (SELECT 'D', q, '', q, 2 FROM (SELECT unnest(range(4)) AS q) UNION ALL SELECT 'K', q, o, q2, 0 FROM g UNION ALL SELECT 'R', q, o, q2, 1 FROM g WHERE o <> 's'),
paths AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS q, {{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}} AS b FROM convs UNION ALL
  SELECT p.conv_id, r.i, ed.q2::BIGINT, min({{'c': (p.b.c + ins.c + ed.c + CASE WHEN ed.a <> 'D' AND fault = 't' THEN 5 ELSE 0 END)::BIGINT, 'a': p.b.a || ins.l || ed.a,
    'o': list_concat(list_concat(p.b.o, ins.o), CASE ed.a WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text] ELSE [CASE ed.o WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] END)}})
  FROM paths p JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 JOIN ins ON ins.q = p.q JOIN ed ON ed.q = ins.q2 AND (ed.a = 'D' OR fault NOT IN ('b', 'd')) AND (ed.a <> 'K' OR ed.o = left(role, 1)) GROUP BY 1, 2, 3),
done AS (SELECT p.conv_id, min({{'c': p.b.c + ins.c, 'a': p.b.a || ins.l, 'o': list_concat(p.b.o, ins.o)}}) AS b FROM paths p JOIN convs ON convs.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = n JOIN ins ON ins.q = p.q AND ins.q2 IN (0, 3) GROUP BY 1)
SELECT convs.conv_id, gaps, blank, duplicate, truncated, illegal, b.c::BIGINT AS cost, b.a AS audit, sha256(array_to_string(b.o, chr(10))) AS repaired_sha256 FROM convs JOIN done ON done.conv_id IS NOT DISTINCT FROM convs.conv_id"""

QUERIES = {"op13_conversations": op13_conversations}
ORACLE_SQL: dict[str, str] = {"op13_conversations": _SQL}
