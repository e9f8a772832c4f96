"""Native SimHash against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shelfrank.llm import fingerprints as P
from shelfrank.llm.queries import QUERIES  # noqa: F401  (the module must import)


def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["é", "日本", "😀x"]
    out = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    return out + [(500, None), (501, ""), (502, "😀😀😀"), (None, "first of all"), (504, out[0][1]), (505, "a  A\tb"), (506, "A a B "), (507, "x " * 20000)]


def pairs(spark, r):
    df = spark.createDataFrame(r, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("key", F.lit(1)).withColumn("hi", F.lit(2))
    return P.fingerprint_pairs(df)


def test_edited_texts_and_likeness(spark):
    r = rows()
    got = {x.id: x for x in pairs(spark, r).collect()}
    assert len(got) == len(r)
    ring = sorted(r, key=lambda x: (x[0] is not None, x[0] or 0))
    alone = {x.id: (x.hi, x.lo) for x in P.fingerprints(spark.createDataFrame(r, "doc_id long, text string")).collect()}
    edited = []
    for (i, t), (j, u) in zip(ring, ring[1:] + ring[:1]):
        t, u = t or "", u or ""
        half = len(t) // 2
        e = t[:len(t) - half] + u[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert (got[i].hi, got[i].lo) == alone[i] and (got[i].next_hi, got[i].next_lo) == alone[j]
        edited.append((i, e))
    of_edited = {x.id: (x.hi, x.lo) for x in P.fingerprints(spark.createDataFrame(edited, "doc_id long, text string")).collect()}
    assert all((got[i].edited_hi, got[i].edited_lo) == of_edited[i] for i, _ in edited)
    assert alone[0] == alone[504] and alone[505] == alone[506] != alone[504] and alone[500] == alone[501] == (0, 0)


def test_votes_are_weighted_majorities(spark):
    text = "the quick brown the quick fox jumps"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    words = text.split()
    terms = [(a, b, len(a) + len(b)) for a, b in zip([""] + words, words)]
    hashed = spark.createDataFrame(terms, "a string, b string, w int").select("w", F.xxhash64("a", "b").alias("h0"), F.xxhash64("b", "a", F.lit(1)).alias("h1")).collect()
    want = []
    for k in ("h0", "h1"):
        v = 0
        for bit in range(64):
            if 2 * sum(h.w for h in hashed if h[k] >> bit & 1) > sum(h.w for h in hashed):
                v |= 1 << bit
        want.append(v)
    r = P.fingerprints(df).first()
    assert [r.hi % 2**64, r.lo % 2**64] == want
    assert df.select(P.hex_of(F.lit(-1).cast("bigint"), F.lit(255).cast("bigint")).alias("x")).first().x == "f" * 16 + "0" * 14 + "ff"


def test_one_row_repeated_ids_and_empty(spark):
    one = pairs(spark, [(9, "alone in here")]).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(("alone in here"[:7] + "alone in here"[:6]).encode()).hexdigest()
    same = pairs(spark, [(1, "a b c d"), (1, "a b c d"), (1, "other text"), (2, "zz"), (2, "yy yy"), (3, "end")]).collect()
    assert len(same) == 6 and len({(x.id, x.hi, x.lo, x.edited_sha256) for x in same}) == 5
    assert pairs(spark, [(1, "x")]).limit(0).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.fingerprint_pairs(empty).count() == 0 and P.fingerprints(empty).count() == 0


def test_ring(spark):
    ids = random.Random(1).sample(range(-1000, 1000), 300)
    got = {r.key: r.next for r in P.ring(spark.createDataFrame([(i,) for i in ids], "key long").repartition(5)).collect()}
    s = sorted(ids)
    assert got == dict(zip(s, s[1:] + s[:1]))


@pytest.mark.parametrize("radius,blocks", [(0, None), (2, None), (3, 6), (4, 5)])
def test_block_tables_find_all(spark, radius, blocks):
    rng = random.Random(radius)
    fps = {rng.getrandbits(128) for _ in range(60)}
    for f in list(fps):
        for _ in range(3):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(128), rng.randint(1, radius + 2))))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    data = [(signed(f >> 64), signed(f % 2**64)) for f in fps]
    df = spark.createDataFrame(data * 2 + [(None, None)], "hi long, lo long")
    found = P.within_radius(df, radius, blocks=blocks).collect()
    got = {frozenset((((r.hi % 2**64) << 64) + r.lo % 2**64, ((r.other_hi % 2**64) << 64) + r.other_lo % 2**64)): r.apart for r in found}
    fl = list(fps)
    want = {frozenset((a, b)): (a ^ b).bit_count() for i, a in enumerate(fl) for b in fl[:i] if (a ^ b).bit_count() <= radius}
    assert got == want and len(found) == len(want)
