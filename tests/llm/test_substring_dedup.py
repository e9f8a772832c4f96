"""Super-k-mer dedup against a brute-force list of windows."""

import random
import re

import numpy as np
import pytest

from shelfrank.llm.substring_dedup import _ranked, _Words, substring_dedup

LATE = 2**62


def brute(rows, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - window + 1):
            x = tuple(w[p:p + window])
            first[x] = min(first.get(x, LATE), LATE if i is None else i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < (LATE if i is None else i):
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def rows():
    rng = random.Random(4)
    vocab = ["a", "b", "c", "ü", "日本", "x y"]
    passage = [rng.choice(vocab) for _ in range(40)]
    out = []
    for i in range(120):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 50))]
        if i % 3 == 0:
            at = rng.randint(0, 20)
            t[5:5] = passage[at:at + rng.randint(10, 20)]
        out.append((i * 7 % 120, rng.choice([" ", "\n", " \t ", "\x0b\x0c\r"]).join(t)))
    out += [(200, None), (201, ""), (202, " \n "), (None, " ".join(passage)), (None, " ".join(passage)),
            (5, out[5][1]), (out[9][0], out[9][1]), (203, " ".join(passage) + " "), (204, "z " * 3000), (205, "z " * 40)]
    return out


def collect(df):
    return sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [8 << 20, 1500])
def test_equals_brute_force(spark, block_bytes):
    r = rows()
    df = spark.createDataFrame(r, "doc_id long, text string")
    assert collect(substring_dedup(df, block_bytes=block_bytes)) == brute(r)


@pytest.mark.parametrize("window,m", [(5, 2), (8, 3), (4, 4), (1, 1), (16, 5)])
def test_other_windows(spark, window, m):
    r = rows()
    df = spark.createDataFrame(r, "doc_id long, text string")
    assert collect(substring_dedup(df, window=window, m=m, block_bytes=4000)) == brute(r, window)


def test_ranks_tell_windows_apart():
    ids = np.random.default_rng(1).integers(0, 3, 500)
    for w in (1, 2, 3, 7, 8, 13):
        rank = _ranked(ids, w)
        runs = [tuple(ids[i:i + w]) for i in range(len(ids) - w + 1)]
        assert len(rank) == len(runs)
        assert len(set(zip(rank.tolist(), runs))) == len(set(runs)) == len(set(rank.tolist()))


def test_super_kmers_hold_each_window_once():
    rng = np.random.default_rng(2)
    lines = [" ".join(map(str, rng.integers(0, 9, n))).encode() for n in (300, 0, 12, 13, 40, 1)]
    w = _Words(lines, 13, 3)
    got = [(d, p) for a, n, d in zip(w.first, w.count, w.doc[w.first]) for p in range(a, a + n - 12)]
    edge = np.searchsorted(w.doc, np.arange(7))
    assert got == [(d, p) for d in range(6) for p in range(edge[d], edge[d + 1] - 12)]
    texts = w.texts()
    assert all(len(t.split(b" ")) == n and b"\n" not in t for t, n in zip(texts, w.count))
    assert len(set(zip(texts, w.digest))) == len(set(texts)) == len(set(w.digest))


def test_layout_and_carried_columns(spark):
    from pyspark.sql import functions as F
    p = " ".join(f"p{i}" for i in range(20))
    r = [(1, f"one\n\n{p}  two"), (2, f"three\tfour {p}\nfive  six"), (3, "as  it\nwas ")]
    df = spark.createDataFrame(r, "doc_id long, text string").withColumn("kept", F.lit("k")).withColumn("id", F.col("doc_id") * 10)
    got = {r.id: (r.kept, r.doc["kept"], r.doc["id"]) for r in substring_dedup(df, layout=True, carry=True).collect()}
    assert got == {1: (r[0][1], "k", 10), 2: ("three\tfour\nfive  six", "k", 20), 3: (r[2][1], "k", 30)}
    assert substring_dedup(df.limit(0), carry=True).count() == 0
