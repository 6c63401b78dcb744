import hashlib
import itertools
import re

import numpy as np
import pytest

from groundphrase.llm import personal_data as pd

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    """The contract's patterns as they are written."""
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            n = re.sub("[^0-9]", "", m[0])
            odd = sum(int(x) for x in n[-1::-2]) + sum(sum(map(int, str(2 * int(x)))) for x in n[-2::-2])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(n) <= 19 and odd % 10 == 0, "phone": 9 <= len(n) <= 15}[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], list(PLAIN).index(x[2])))


def test_base_patterns():
    rng = np.random.default_rng(1)
    pieces = ["a", "b.c", "@", "@", "x@y.z", ".", "..", "+", "-", " ", "1", "12", "255", "256", "0007", "1.2.3.4", "4111111111111111", "4111 1111 1111 1111", "+1 (509) 555-6973", "(", ")", "é", "٣", "%", "\n", "_"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces, rng.integers(1, 14)))
        assert pd.base(t) == plain_base(t), t


def test_base_is_linear_in_long_texts():
    for t in ("a" * 2_000_000, "1" * 1_000_000, "1." * 500_000, "a@" * 500_000, "@" * 500_000, "+1" * 500_000, "1 " * 500_000, "a@b." * 300_000):
        pd.base(t)


def small():
    t = pd.Tagger(hidden=3, seed=1)
    t.w = {k: v.astype(float) for k, v in t.w.items()}
    return t


def test_gradient_against_differences():
    t, rng = small(), np.random.default_rng(0)
    x, tags, real = (a[:, :24] for a in pd.encode(pd.labelled_texts(5, 3), 96))
    real[0, 15:] = False
    tags[0, 15:] = 0
    x[0, 15:] = pd.PAD
    grad = t.gradient(x, tags, real)[1]
    for k, w in t.w.items():
        for _ in range(4):
            at = (int(rng.integers(2)), int(x[1, rng.integers(20)]), int(rng.integers(12))) if k == "x" else tuple(int(rng.integers(n)) for n in w.shape)
            keep = w[at]
            w[at] = keep + 1e-4
            up = t.gradient(x, tags, real)[0]
            w[at] = keep - 1e-4
            down = t.gradient(x, tags, real)[0]
            w[at] = keep
            assert abs((up - down) / 2e-4 - grad[k][at]) < 1e-4 * max(1, abs(grad[k][at])), (k, at)


def test_decoding_against_all_sequences():
    t = small()
    x, _, real = pd.encode([("a@1 ", []), ("b2", [])], 4)
    e, move = t.emissions(x), t.w["move"] + t.ban
    score = lambda row, s: t.w["first"][s[0]] + t.ban_first[s[0]] + sum(e[row, i, k] for i, k in enumerate(s)) + sum(move[a, b] for a, b in itertools.pairwise(s))
    tags = t.decode(x, real)[0]
    for row, n in ((0, 4), (1, 2)):
        assert tuple(tags[row, :n]) == max(itertools.product(range(len(pd.TAGS)), repeat=n), key=lambda s, r=row: score(r, s))


def test_reconciled_against_all_subsets():
    rng = np.random.default_rng(2)
    for _ in range(200):
        spans = {}
        for _ in range(7):
            s = int(rng.integers(0, 20))
            spans[s, s + int(rng.integers(1, 8)), str(rng.choice(pd.KINDS))] = float(rng.integers(1, 100)) + float(rng.random())
        taken = [(s, s + 3, "ip") for s in sorted(rng.choice(24, 2, replace=False).tolist())]
        ok = [x for x in spans if not any(x[0] < b and a < x[1] for a, b, _ in taken)]
        best = max((sum(spans[x] for x in c) for n in range(len(ok) + 1) for c in itertools.combinations(ok, n) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(c, 2))), default=0)
        got = pd.reconciled(spans, taken)
        assert abs(sum(x[3] for x in got) - best) < 1e-9
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(got))


@pytest.fixture(scope="module")
def finder():
    return pd.Finder(pd.tagger())


def test_held_out_spans(finder):
    held = pd.labelled_texts(1000, seed=1234)
    right = wrong = all_ = 0
    for (_, want), (known, added) in zip(held, finder.scan([t for t, _ in held]), strict=True):
        base_, got = set(known), {x[:3] for x in added}
        all_ += len(set(want) - base_)
        right += len(got & set(want))
        wrong += len(got - set(want))
    assert right >= 0.85 * all_ and wrong <= 0.02 * right, (right, wrong, all_)


def test_forms_that_no_rule_makes(finder):
    yes = ["write me at joe.smith {at} mail {dot} example {dot} com now", "ana_b (AT) host-x.org, thanks", "blocked 10[.]0[.]0[.]7 today", "visa 4539.1488.0343.6467 ok", "call 1 (800) 555-0199", "0044 20 7946 0958 uk"]
    no = ["on 2024-01-15 at 10:30", "price 1.234.567 EUR", "ISBN 978-3-16-148410-0 x", "see https://a.b/12345678", "order 123456789012", "he was at home. dot product of 3", "lat 48.8566 2.3522", "id=550e8400-e29b-41d4-a716-446655440000", "12:34:56:78:9a:bc", "scores 3-2, 4-1, 10-9", "visa 4539.1488.0343.6468 ok"]
    assert [bool(a) for _, a in finder.scan(yes)] == [True] * len(yes)
    assert [a for _, a in finder.scan(no)] == [[]] * len(no)


def test_windows_cover_marks(finder):
    t = "x" * 500 + " 0044 20 7946 0958 " + "y" * 300 + "7 " * 400
    w = finder.windows(t, [])
    assert all(any(a <= m.start() < b for a, b in w) for m in pd.MARK.finditer(t))
    assert all(b - a <= finder.WIDTH for a, b in w) and len(set(w)) == len(w)
    assert finder.windows("no marks here " * 1000, []) == [] == finder.windows("", [])
    assert finder.windows("to 1.2.3.4.", pd.base("to 1.2.3.4.")) == []


def test_frames(spark):
    long = "Lorem ipsum. " * 100_000 + "Tel. 0171/1234567, or joe (at) mail (dot) org."
    rows = [(1, "mail a.b@c.de now", "x"), (1, "mail a.b@c.de now", "x"), (2, None, None), (None, "", "y"), (3, "4111 1111 1111 1111 and 10[.]0[.]0[.]7 é 1.1.1.1", "z"), (4, long, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, personal string")
    got = pd.find(df).collect()
    assert len(got) == len(rows)
    spans = sorted((r.doc_id, [(x.kind, x.start, x.end, x.score is None) for x in r.personal]) for r in got if r.doc_id in (1, 3))
    assert spans[0] == spans[1] == (1, [("email", 5, 13, True)])
    assert spans[2] == (3, [("card", 0, 19, True), ("ip", 24, 38, False), ("ip", 41, 48, True)])
    assert [r.personal for r in got if r.doc_id in (2, None)] == [[], []]
    assert [long[x.start : x.end] for r in got if r.doc_id == 4 for x in r.personal] == ["0171/1234567", "joe (at) mail (dot) org"]
    assert pd.find(spark.createDataFrame([], df.schema)).count() == 0


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pd.op12_personal_data(spark, sf).collect():
        b = plain_base(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in b) for k in pd.KINDS]
        spelled = [f"{k}:{s}:{e}" for s, e, k in b]
        assert r.base_sha256 == hashlib.sha256(",".join(spelled).encode()).hexdigest()
        assert set(spelled) <= set(r.spans.split(",")) | {""} or not spelled


def test_every_valid_span_has_a_mark():
    finder = pd.Finder(None)
    spans = [(s, "email") for s in ("ana at host.com", "ana AT host . com", "ana arroba host(.)com", "ana at host[.]co", "ana  at  host.com")] + [(s, "ip") for s in ("dead:beef::cafe", "::a:b:c", "a:b:c:d:e:f:a:b", "fe::%x")]
    for span, kind in spans:
        text = "word " * 40 + span + " word" * 40
        at = text.index(span)
        if pd.valid(kind, span, " ", " "):
            assert any(a <= at and at + len(span) <= b for a, b in finder.windows(text, [])), span
    assert sum(pd.valid(k, s, " ", " ") for s, k in spans) >= 7
