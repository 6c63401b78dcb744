import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundphrase.llm import packing


def check(sizes, lengths, overhead=16, attention=packing.ATTENTION):
    got = packing.pack(sizes, lengths, overhead, attention)
    bins = {}
    for s, (b, cap, k) in zip(sizes, got, strict=True):
        bins.setdefault((b, cap), []).append((k, s))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, cap), xs in bins.items():
        n = sum(s for _, s in xs)
        assert sorted(k for k, _ in xs) == [*range(len(xs))]
        assert n <= cap == min(c for c in lengths if c >= n)  # downsized
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_bins_hold_their_pieces(sizes):
    bins = check(sizes, (8, 16, 64))
    assert sum(c for _, c in bins) >= sum(sizes)


def brute(sizes, lengths, price):
    """The least cost of any packing, by trying all."""
    best = [float("inf")]

    def go(i, bins):
        if i == len(sizes):
            best[0] = min(best[0], sum(price(min(c for c in lengths if c >= b)) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= max(lengths):
                go(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("attention", [48, 1e12])
def test_near_the_best_packing(attention):
    rng, lengths = np.random.default_rng(2), (4, 8, 16)
    price = lambda c: packing.bin_cost(c, 1, attention)
    ours = best = 0
    for _ in range(40):
        sizes = rng.integers(1, 17, 7).tolist()
        cost, least = sum(price(c) for _, c in check(sizes, lengths, 1, attention)), brute(sizes, lengths, price)
        assert cost <= 1.45 * least
        ours, best = ours + cost, best + least
    assert ours <= 1.12 * best


def mixed():
    return np.minimum(np.random.default_rng(5).lognormal(6, 1.2, 6000).astype(int) + 1, 8192).tolist()


def test_lengths_are_chosen_jointly():
    sizes = mixed()
    _, caps, _ = packing.opened(sizes)
    assert len({*caps[: len(caps) // 2]}) > 1 and len({*caps}) >= 3  # long before the pieces run out
    cost = lambda lengths: sum(packing.bin_cost(c) for _, c in {(b, c) for b, c, _ in packing.pack(sizes, lengths)})
    one = sum(packing.bin_cost(8192) for _ in {b for b, *_ in packing.pack(sizes, (8192,))})
    downsized = packing.opened(sizes, (8192,))[2]
    assert cost(packing.LENGTHS) < 0.9 * one
    assert cost(packing.LENGTHS) < sum(packing.bin_cost(next(c for c in packing.LENGTHS if c >= n)) for n in downsized)


def test_what_is_left_fills_a_room():
    rng = np.random.default_rng(6)
    for _ in range(200):
        sizes = rng.integers(1, 30, 12).tolist()
        left = packing._Left(sizes)
        gone = rng.integers(0, 12)
        for s in sizes[:gone]:
            left.take(s)
        room = want = int(rng.integers(0, 60))
        for s in sorted(sizes[gone:], reverse=True):
            want -= s * (s <= want)
        assert left.fill(room) == room - want


def test_little_padding():
    sizes = np.random.default_rng(3).integers(1, 3000, 5000).tolist()
    assert sum(c for _, c in check(sizes, packing.LENGTHS, attention=1e12)) < 1.02 * sum(sizes)
    assert sum(c for _, c in check(sizes, packing.LENGTHS)) < 1.12 * sum(sizes)


def tokens(text):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    return len(sp.encode(text or "", add_eos=True))


def test_documents_stay_whole(spark):
    rows = [(i, "word " * (i % 50), 1) for i in range(300)] + [(300, None, 2), (None, "a b", 3), (7, "word " * 7, 1), (7, "word " * 7, 1), (301, "w " * 40_000, 1), (302, "w " * 8191, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bin int")
    got = packing.pack_documents(df, shard=100).collect()
    by, bins = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.start, r.n))
        bins.setdefault((r.shard, r.bin, r.capacity), []).append((r.place, r.n))
    want = {}
    for i, t, _ in rows:
        want[i] = want.get(i, 0) + tokens(t)
    assert {i: sum(n for _, n in v) for i, v in by.items()} == want and len({r.shard for r in got}) > 2
    assert [s for s, _ in sorted(by[301])] == [8192 * k for k in range(-(-want[301] // 8192))]
    assert len(by[7]) == 3
    assert all(sum(n for _, n in v) <= c and sorted(k for k, _ in v) == [*range(len(v))] for (*_, c), v in bins.items())
    assert packing.pack_documents(df.limit(0)).count() == 0
    # Neither the order nor the layout of the rows plays a part.
    other = packing.pack_documents(df.orderBy("text").repartition(7), shard=100).collect()
    assert sorted(map(str, other)) == sorted(map(str, got))


def test_tokens_of_long_texts():
    import public_tokenizers

    count = packing.counter(str(public_tokenizers.path("piece_bpe_32k.model")))
    text = "Ein  paar Wörter, some words\n and 中文 too. " * 60_000 + "x" * 300_000
    assert len(text) > 2 * packing.STRIDE and count(text) == tokens(text)
    assert count("") == 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\u00a0\u3000éß中▁.,", max_size=40))
def test_tokens_against_the_library(text):
    import public_tokenizers

    assert packing.counter(str(public_tokenizers.path("piece_bpe_32k.model")))(text) == tokens(text)


def test_too_long_a_piece():
    with pytest.raises(ValueError):
        packing.pack([9], (4, 8))
