"""Anchor covering against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from shelfrank.llm import simhash_anchors as S
from shelfrank.llm.components import components


def brute_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, near):
    """nodes: value -> smallest id."""
    root = {v: v for v in nodes}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for a, b in itertools.combinations(nodes, 2):
        if near(a, b):
            root[find(a)] = find(b)
    out = {}
    for v in nodes:
        out.setdefault(find(v), set()).add(v)
    return [frozenset(x) for x in out.values()]


def test_anchor_code_is_perfect():
    """Every 23-bit word has exactly one home, at most 3 bits away."""
    flips, upto = S._patterns(2)
    assert len(flips) == 1 + 23 + 253 + 1771 + 8855 + 33649
    assert (upto[:, 1] - upto[:, 0] == 1).all()
    assert all(bin(f).count("1") <= 3 for f in flips[upto[:, 0]])


def test_near_fingerprints_share_a_home():
    rng = np.random.default_rng(3)
    fp = rng.integers(-2**63, 2**63 - 1, 300)
    for d in (1, 2):
        other = fp.copy()
        for i in range(len(other)):
            for b in rng.choice(64, d, replace=False):
                other[i] ^= np.int64(1 << int(b)) if b < 63 else np.int64(-2**63)
        oa, aa, ha = S.anchors_of(fp, 2)
        ob, ab, _ = S.anchors_of(other, 2)
        homes = dict(zip(oa[ha], aa[ha]))
        assert len(homes) == len(fp)
        reach = {}
        for o, a in zip(ob, ab):
            reach.setdefault(o, set()).add(a)
        assert all(homes[i] in reach[i] for i in range(len(fp)))


def docs(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))) for i in range(150)]
    base = [rng.choice(words) for _ in range(60)]
    for i in range(150, 260):  # a crowd of near copies
        t = list(base)
        t[rng.randrange(60)] = rng.choice(words)
        rows.append((i, "\t".join(t)))
    rows += [(300, None), (301, ""), (302, " \n"), (None, "A b C d"), (303, "a B c D"), (304, "é É x"), (5, rows[5][1])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def expected(rows, distance):
    fps, least = [brute_fingerprint(t) for _, t in rows], {}
    for (i, _), f in zip(rows, fps):
        least[f] = min((x for x in (least.get(f), i) if x is not None), default=None)
    comp = {}
    for group in brute_components(least, lambda a, b: (a ^ b).bit_count() <= distance):
        m = min((least[f] for f in group if least[f] is not None), default=None)
        comp |= {f: m for f in group}
    return sorted(((i, f, comp[f]) for (i, _), f in zip(rows, fps)), key=str)


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_equals_brute_force(spark, distance):
    rows, df = docs(spark)
    got = S.near_dedup(df, distance=distance).collect()
    assert sorted(((r.id, r.fp % 2**64, r.component_id) for r in got), key=str) == expected(rows, distance)


def random_cluster(n, seed):
    rng = np.random.default_rng(seed)
    centre = int(rng.integers(0, 2**62))
    out = {centre}
    while len(out) < n:
        f = rng.choice(list(out)) if rng.random() < 0.7 else centre
        f = int(f)
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            f ^= 1 << int(b)
        out.add(f)
    return sorted(out)


def test_crowded_anchors(spark, monkeypatch):
    """Clusters beyond the pairwise limit and beyond what one task holds."""
    fps = random_cluster(400, 1)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {frozenset(x) for x in brute_components({f: f for f in fps}, lambda a, b: (a ^ b).bit_count() <= 2)}
    for crowd in (20_000, 60):
        monkeypatch.setattr(S, "CROWD", crowd)
        roots = {r.node % 2**64: r.root % 2**64 for r in components(S.links(distinct, 2)).collect()}
        got = {}
        for f in fps:
            got.setdefault(roots.get(f, f), set()).add(f)
        assert {frozenset(x) for x in got.values()} == want


def test_components_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 200)], "a long, b long")
    assert {r.node: r.root for r in components(chain).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(chain.limit(0)).count() == 0


def test_empty_table_and_clashing_columns(spark):
    from pyspark.sql import functions as F
    rows, df = docs(spark)
    assert S.near_dedup(df.limit(0)).count() == 0
    wide = df.withColumn("fp", F.lit("x")).withColumn("id", F.lit(1)).withColumn("component_id", F.lit(2))
    assert sorted(((r.id, r.fp % 2**64, r.component_id) for r in S.near_dedup(wide).collect()), key=str) == expected(rows, 2)
