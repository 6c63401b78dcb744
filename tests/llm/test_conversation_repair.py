import hashlib
import heapq
import re
from zlib import crc32

import duckdb
import numpy as np
import pytest

from groundphrase.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, h int, fault string, n string"


def brute(rows, damage=True):
    """FIELDS of each conversation by best-first search over whole label strings, without any lattice."""
    convs = {}
    for c, t, r, x in rows:
        kind = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damage else 9
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        mine = convs.setdefault(c, [])
        mine += [(t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for c, mine in convs.items():
        mine.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), m[2].encode()))
        faults, seen = [], set()
        for _, r, x in mine:
            body = x.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((r, x))
        turns = [m[0] for m in mine if m[0] is not None]
        two = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:], strict=False)]
        heap, best = [(0, "", 0, ())], None
        while best is None:
            cost, audit, i, lines = heapq.heappop(heap)
            initials = "".join(x[0][:1] or "-" for x in lines)
            if i == len(mine) and re.fullmatch("(s?(ua)+)?", initials):
                best = cost, audit, lines
                break
            if not re.fullmatch("(s?(ua)*u?)?", initials) or audit.endswith("IIII"):
                continue
            for new in ("user", "assistant"):
                heapq.heappush(heap, (cost + 5, audit + "I", i, (*lines, (new, ""))))
            if i < len(mine):
                _, r, x = mine[i]
                extra = 5 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, lines))
                if faults[i] not in ("blank", "duplicate"):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, (*lines, (r, x))))
                    for new in ("user", "assistant"):
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, (*lines, (new, x))))
        text = "\n".join(f"{r}:{x}" for r, x in best[2])
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in two), best[0], best[1], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(0, 8))):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "usher", "", "System"])
            text = rng.choice(["Hi.", "Hi.", "How are you?", "no end", " \t\n", "", "x!  ", "Ünï…", "a\x0b", "b. "])
            rows.append((c, t if rng.random() < 0.8 else int(rng.integers(0, 9)), str(role), str(text)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def test_against_best_first_search(spark):
    rows = random_rows(1, 70)
    rows += [(None, 0, "user", "Q?"), (None, None, "assistant", "A."), (None, None, None, None), (500, None, None, None), (501, 2, "user", None), (501, 9, None, "Hm.")]
    rows += rows[:9] + rows[:4] + [(502, 0, "user", "same?")] * 4 + [(502, 0, "assistant", "same?")] * 2
    got = cr.repair(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, damage=False)
    got = cr.repaired(cr.with_faults(cr.damaged(frame(spark, rows))))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_dropped_and_empty(spark):
    gone = [(c, t, "user", "Hi.") for c in range(60) for t in range(1) if crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = cr.repaired(cr.with_faults(cr.damaged(frame(spark, gone)))).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(got) == len(gone) > 0
    assert cr.repair(frame(spark, [])).count() == 0


def test_long_conversation_and_long_text(spark):
    rows = [(7, t, "assistant" if t % 2 else "user", "word " * (200_000 if t == 5 else 2) + f"{t}.") for t in range(3000)] + [(7, 3000, "user", "left open")]
    r = cr.repair(frame(spark, rows)).first()
    assert (r.cost, r.audit) == (2, "K" * 3000 + "D")
    assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{x[2]}:{x[3]}" for x in rows[:-1]).encode()).hexdigest()


@pytest.mark.parametrize("seed", [2, 3])
def test_sql_agrees_on_damaged_rows(spark, tmp_path, seed):
    rows = [r for r in random_rows(seed, 60)] + [(None, None, None, "x."), (90, None, None, None)]
    path = str(tmp_path / "c.parquet")
    frame(spark, rows).select("conv_id", "turn", "role", "text").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(map(tuple, con.execute(cr.ORACLE_SQL["op13_conversations"]).fetchall()), key=str) == brute(rows)
