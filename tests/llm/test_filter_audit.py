"""Filter audit against running the filters in every order."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from shelfrank.llm import filter_audit as A

DOCS = "doc_id bigint, text string, source string, part string, failed int, digest string"
LABELS = "doc_id bigint, quality int, toxic int, part string"


def fails(rows, i, f):
    text = rows[i][1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": re.search(r"[#$%&*|]", text) is not None,
            "E": rows[i][0] is not None and any(j[0] is not None and j[0] < rows[i][0] and (j[1] or "") == text for j in rows)}[f]


def brute(rows, labels):
    table = [{f: fails(rows, i, f) for f in "ABCDE"} for i in range(len(rows))]
    good, bad = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    out = []
    for part in {r[2] or "" for r in rows}:
        own = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        shapley, lines = Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [i for i in left if table[i][f]]
                before, left = left, [i for i in left if not table[i][f]]
                shapley[f] += len(gone)
                lines.append((f, ["".join(order), step, len(left), len(gone), sum(table[i][f] for i in own) - len(gone),
                                  sum(sum(table[i].values()) == 1 and table[i][f] for i in own),
                                  sum(rows[i][0] in good for i in gone), sum(rows[i][0] in bad for i in gone)]))
        out += [(part, *x, shapley[f]) for f, x in lines]
    return Counter(out)


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 5, "y") for r in rows], DOCS)
    said = spark.createDataFrame([(*r, "x") for r in labels], LABELS)
    got = A.filter_audit(docs, said)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return Counter(tuple(r) for r in got.collect())


def some_rows(n, seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", "A", "hash # tag", "B " * 250]
    for _ in range(40):
        k = rng.choice([5, 150, 199, 200, 201, 300])
        words = [rng.choice(["w%d" % rng.randrange(rng.choice([3, 400])), "É", "Word"]) for _ in range(k)]
        texts.append(rng.choice([" ", "\t", "\n"]).join(words) + rng.choice(["", " $", " |", " UPPER CASE TEXT" * rng.randrange(3)]))
    return [(rng.choice([None, *range(n)]) if i % 9 == 0 else i, rng.choice(texts), rng.choice(["hot", "hot", "hot", "s1", "s2", None, ""])) for i in range(n)]


def test_equals_running_every_order(spark):
    rows = some_rows(150, 1)
    labels = [(i, i % 3 % 2, i % 4 // 3) for i in range(0, 150, 2)] + [(None, 1, 1), (4, 1, None), (4, None, 1), (6, 2, -1), (999, 1, 1)]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_a_hot_group_of_copies_and_repeated_rows(spark):
    rows = [(i, "same text", f"s{i % 4}") for i in range(300)] + [(0, "same text", "s1")] * 3 + [(7, "x " * 200, "s0")] * 2
    assert run(spark, rows, [(0, 1, 1), (5, 1, 0)]) == brute(rows, [(0, 1, 1), (5, 1, 0)])


def test_empty_tables(spark):
    assert run(spark, [], []) == Counter()
    rows = some_rows(30, 2)
    assert run(spark, rows, []) == brute(rows, [])


def test_positional_popcount_equals_plain_sums():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 8, 9, 10, 100, 4097):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        plain = (words[:, None] >> np.arange(32, dtype=np.uint32) & 1).sum(axis=0) if n else np.zeros(32)
        assert (A.positional_popcount(words) == plain).all()
    assert (A.positional_popcount(np.full(100_000, 0xFFFFFFFF, np.uint32)) == 100_000).all()


def test_truth_table():
    for failed in range(32):
        for s in range(32):
            assert bool(A.TRUTH[failed] >> np.uint32(s) & 1) == (s & failed == 0)


def test_tasks_give_sums_away_in_between(spark, monkeypatch):
    monkeypatch.setattr(A, "PARTS", 1)
    import pyarrow as pa

    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([False] * len(rows)), pa.array([True] * len(rows))], names=list("abcd"))
    out = [r for b in A._counts([batch([("a", 0), ("b", 31)]), batch([("a", 1)])]) for r in b.to_pylist()]
    total = Counter()
    for r in out:
        total[r["part"], r["kind"]] += r["n1"]
    assert total == {("a", 0): 1, ("a", 2): 1, ("b", 0): 0, ("b", 2): 0} | {}


@pytest.mark.parametrize("text, bits", [(b"", 1), (b"A", 5), (b"#", 9), ("é".encode() * 10, 1), (b"a " * 200, 2), (b" ".join(b"%d" % i for i in range(200)), 0)])
def test_text_filters(text, bits):
    assert A.failures(text) == bits
