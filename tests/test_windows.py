"""The best windows of a request come from bounds, and are those of all windows."""

import random

from groundphrase.functions import fuzzy as fz


def brute(text, candidate, most=3, extra=2):
    t = fz.token_spans(text)
    longest = min(len(t), max(3, len(candidate.split()) + extra))
    parts = [t[i : i + n] for n in range(min(2, len(t)) or 1, longest + 1) for i in range(len(t) - n + 1)]
    found = sorted(((fz.alignment(" ".join(x[0] for x in p), candidate), p[-1][2] - p[0][1], -p[0][1]) for p in parts), reverse=True)
    return [(-s, -s + n, text[-s : -s + n], score) for score, n, s in found[:most]], len(parts)


def test_equal_to_all_windows_with_few_compared(monkeypatch):
    rng, compared, every = random.Random(2), [], 0
    words = "a i stitch in time saves nine the bird hand worth two bushes it ab aba".split()
    cases = [("", "x y"), ("a", "a b"), ("...", "abc"), ("a a a", ""), ("a a a a a", "a a"), ("é à x", "é à x")]
    cases += [(" ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", "!"]), " ".join(rng.choices(words, k=rng.randint(1, 8)))) for _ in range(150)]
    expected = [brute(*c) for c in cases]
    own = fz.Candidate.matched
    monkeypatch.setattr(fz.Candidate, "matched", lambda self, q: compared.append(q) or own(self, q))
    for case, (best, n) in zip(cases, expected, strict=True):
        assert fz.windows(*case) == best
        every += n
    assert len(compared) < every / 4, (len(compared), every)
