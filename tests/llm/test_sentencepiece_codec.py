import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from groundphrase.llm import sentencepiece_codec as codec

MODEL = public_tokenizers.path("piece_bpe_32k.model")
OWN, LIB = codec.Codec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def same(text):
    ids = OWN.encode(text).tolist()
    assert ids == LIB.encode(text) + [2], text
    assert OWN.decode(ids) == LIB.decode(ids), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


def test_dense_alphabets():
    rng = random.Random(4)
    for alphabet in ("ab ", "the in", "▁ a\t\n\r", "ingtio.,n ", "0123 $#", "é日🎉 à\0", "<0x41>s/"):
        for _ in range(400):
            same("".join(rng.choice(alphabet) for _ in range(rng.randrange(50))))


def test_edges():
    for t in ("", " ", "   x", "x" * 5000, " " * 100, "\n" * 50, "<s></s><unk>", "a" * 2000 + " " + "b" * 2000, "ab" * 30_000):
        same(t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=20))
def test_decode_of_any_ids(ids):
    assert OWN.decode(ids) == LIB.decode(ids)


def test_columns(spark):
    rows = [(1, "a b", "x", 1), (None, None, None, 2), (3, "", "y", 3), (1, "a b", "x", 1), (4, "long text " * 50_000, "z", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string, n_tokens int")
    got = codec.encode(df, MODEL, decoded="back").collect()
    assert len(got) == 5 and {tuple(r.ids) == tuple(LIB.encode(r.text or "") + [2]) and r.back == (r.text or "") for r in got} == {True}
    assert [r.t2 for r in codec.decode(codec.encode(df, MODEL), MODEL, text="t2").orderBy("n_tokens").collect()][-1] == "long text " * 50_000
    for r in codec.digests(df, MODEL, keep=["doc_id", "text"]).collect():
        ids = LIB.encode(r.text or "") + [2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()
    assert codec.encode(df.limit(0), MODEL).count() == 0


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"")
    with pytest.raises(ValueError):
        codec.Codec(str(tmp_path / "m"))
