"""Chunked BPE against the tokenizer library, text by text."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from shelfrank.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(6)
    bits = ["the ", "Straße ", "don't ", "I'LL", "x1234", "\n\n", "\t", " ", "é", "́", "日本語", "😀", "<|endoftext|>",
            "<|startoftext|>", "<|start", "oftext|>", "ΟΔΟΣ ", "İ", "--", "$$$", " ", " ", "ﬁ", "ᾳ", "'s", "\x00", "\x1c", "\x85"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 600))) for _ in range(120)]
    passage = "".join(rng.choice(bits) + rng.choice("abc ") for _ in range(2000))
    out += [passage, "prefix " + passage, passage + "suffix", "x" * 5000, "ab" * 4000 + " " + "é" * 3000, " " * 5000, "", "a", " a", "a ", "日" * 3000]
    return out + [t.upper() for t in out[:20]]


def library():
    return Tokenizer.from_file(PATH)


def test_equals_library_over_any_cut(spark):
    t = library()
    want = [t.encode(x, add_special_tokens=False).ids for x in texts()]
    for mean, least in ((1024, 256), (16, 4), (4, 1)):
        codec = bpe.Codec(PATH)
        old = bpe.cuts
        bpe.cuts = lambda u, f=old, a=mean, b=least: f(u, a, b)
        try:
            got = codec.encode_all([x.encode() for x in texts()])
        finally:
            bpe.cuts = old
        for x, w, (ids, text) in zip(texts(), want, got):
            assert np.frombuffer(ids, "<u4").tolist() == w, x[:80]
            assert text.decode() == t.decode(w, skip_special_tokens=False), x[:80]


def test_small_memo_changes_nothing():
    t = library()
    codec = bpe.Codec(PATH, memo_bytes=4000)
    codec.words.limit = 2000
    for x in texts()[::3]:
        (ids, _), = codec.encode_all([x.encode()])
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_cuts_follow_content():
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(30000)).encode()

    def chunks(u):
        ends = bpe.cuts(u)
        return [u[a:b] for a, b in zip([0, *ends], ends)]

    assert b"".join(chunks(passage)) == passage
    a, b = chunks(passage), chunks("ein anderer Anfang: ".encode() * 7 + passage)
    assert len(set(a) & set(b)) > 0.8 * len(a)
    for c in a:
        c.decode()


def test_operator_round_trip(spark):
    from pyspark.sql import functions as F
    t = library()
    rows = [(i, x) for i, x in enumerate(texts()) if "\x00" not in x] + [(None, "a b"), (900, None), (3, "dup"), (3, "dup")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("decoded", F.lit(0))
    enc = bpe.encode(df, PATH, carry=True)
    got = enc.collect()
    assert len(got) == len(rows)
    for r in got:
        want = t.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == t.decode(want, skip_special_tokens=False)
        assert r.id == r.doc["doc_id"]
    key = lambda x: str(x)
    back = bpe.decode(bpe.encode(df, PATH), PATH)
    assert sorted(((r.id, r.decoded) for r in back.collect()), key=key) == sorted(((r.id, r.decoded) for r in got), key=key)
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_refuses_other_tokenizers():
    import pytest
    with pytest.raises(ValueError):
        bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
