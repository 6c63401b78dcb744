import numpy as np
import pytest
import xxhash

from groundphrase.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def brute(rows):
    def fp(text):
        words, cur = [], ""
        for c in text or "":
            c = c.lower() if "A" <= c <= "Z" else c
            if c == " " or "\t" <= c <= "\r":
                words, cur = words + [cur] * bool(cur), ""
            else:
                cur += c
        words += [cur] * bool(cur)
        if not words:
            return 0
        sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        out.setdefault(find(i), []).append(d)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in out.items()}
    return sorted(((d, f"{fps[i]:016x}", low[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = " ".join(rng.choice(["oak", "elm", "ash", "fir", "yew"], 400))
    rows = [(i, " ".join(rng.choice(["a", "B", "c"], rng.integers(0, 4)))) for i in range(60)]
    for i in range(60, 140):  # chains of small changes
        w = base.split()
        for at in rng.integers(0, 400, i % 7):
            w[at] = "pine"
        rows.append((i, " ".join(w)))
    rows += [(None, "a b c"), (200, None), (201, ""), (202, " \t"), (61, base), (61, base), (203, "É é\x85x y z")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    got = [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_long_chain_and_empty(spark):
    # fingerprints 2 bits apart in a row of 40, nodes in shuffled order
    fps = [(1 << (i // 2 * 2 % 64)) for i in range(2)]
    x, fps = 0, []
    for i in range(31):
        x |= 3 << (2 * i)
        fps.append(x)
    nodes = spark.createDataFrame([(f, int(n)) for f, n in zip(fps, np.random.default_rng(0).permutation(31))], "fp long, node long")
    from groundphrase.llm.common import components

    assert {r.component for r in components(simhash.links(nodes)).collect()} == {0}
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(nodes, 3)
