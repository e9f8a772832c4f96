"""Curriculum mix against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from shelfrank.llm import curriculum as C

DOCS = "doc_id bigint, text string, source string, size string, key string, copies int"


def brute_targets(sizes):
    """source -> target, by sharing the excess out again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        rest = Fraction(total - sum(held.values()))
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return share | held
        held |= {s: 3 * sizes[s] for s in over}


def brute(rows):
    """Taken words of each row, in the order of the rows' marks."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = Counter()
    for (_, _, s), n in zip(rows, size):
        sizes[s] += n
    goals = {s: float(t) for s, t in brute_targets(sizes).items()}
    taken = [0] * len(rows)
    for s, goal in goals.items():
        own = sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: (
            hashlib.md5(str("" if rows[i][0] is None else rows[i][0]).encode()).hexdigest()[:16], rows[i][0] is not None, rows[i][0] or 0, size[i]))
        left = int(goal + 0.5)
        for _ in range(3):
            for i in own:
                k = min(size[i], left)
                taken[i] += k
                left -= k
        assert left == 0
    return Counter((r[0], n, sizes[r[2]], round(goals[r[2]], 6), k) for r, n, k in zip(rows, size, taken))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", 7) for i, t, s in rows], DOCS)


def cases():
    rng = random.Random(5)
    text = lambda n: rng.choice(["", " ", "\t"]) + rng.choice([" ", "\n", " \r\v "]).join(rng.choice("a bb ccc é  x".split(" ")) for _ in range(n)) + rng.choice(["", " "])
    hot = [(i, text(rng.randrange(40)), "hot" if i % 3 else f"s{i % 7}") for i in range(400)]
    yield hot
    yield [(1, "a b c", "tiny"), (2, "x " * 500, "big"), (3, "y " * 300, None), (4, None, "none"), (5, "", "none"), (6, " \n ", "none")]
    yield [(1, "a b", "s"), (1, "a b", "s"), (1, "a b", "s"), (None, "q r s t", "s"), (None, None, None), (2, "long " * 5000, "z"), (3, "w", "é"), (4, "w w", "\U0001F600"), (5, "w", "￮")]
    yield [(1, "", "a"), (2, None, None)]


@pytest.mark.parametrize("n", range(4))
def test_equals_brute_force(spark, n):
    rows = list(cases())[n]
    got = C.mix(frame(spark, rows)).collect()
    assert Counter((r.id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == brute(rows)
    assert all(r.taken <= 3 * r.size and r.taken == sum(c.words for c in r.copies) for r in got)


def test_reruns_agree_whatever_the_partitions(spark):
    rows = list(cases())[0]
    one = C.mix(frame(spark, rows)).collect()
    other = C.mix(frame(spark, rows[::-1]).repartition(7)).collect()
    assert Counter(map(str, one)) == Counter(map(str, other))


def test_positions_follow_the_schedule(spark):
    """At any time a source has given the integral of its schedule up to then."""
    rows = [(i, "w " * 10, f"s{i % 3}") for i in range(3000)]
    copies = C.training_order(C.mix(frame(spark, rows))).collect()
    assert [c.position for c in copies] == sorted(c.position for c in copies)
    given, goal = defaultdict(list), {f"s{k}": 30_000 * (k + 1) / 6 for k in range(3)}
    for c in copies:
        given[c.source].append((c.position, c.words))
    for k, source in enumerate(sorted(given)):
        knots = C.SCHEDULES[k + 1]
        for time in (0.1, 0.4, 0.5, 0.77, 0.95):
            steps = 20_000
            area = sum(rate(knots, (j + 0.5) / steps) for j in range(int(time * steps))) / sum(rate(knots, (j + 0.5) / steps) for j in range(steps))
            asked = sum(w for p, w in given[source] if p < time)
            assert abs(asked / goal[source] - area) < 0.005, (source, time)


def rate(knots, t):
    for (a, r), (b, s) in zip(knots, knots[1:]):
        if t <= b:
            return r + (s - r) * (t - a) / (b - a)


def test_a_document_of_a_third_of_its_source_is_cut_at_the_target(spark):
    got = {r.id: r for r in C.mix(frame(spark, [(1, "a " * 900, "a"), (2, "b " * 1000, "b"), (3, "c " * 10, "b")])).collect()}
    assert got[1].target == 1910 / 3 and got[1].taken == 637
    assert got[2].taken + got[3].taken == 1273


def test_empty_table_and_bad_schedules(spark):
    empty = frame(spark, []).limit(0)
    assert C.mix(empty).collect() == []
    assert C.training_order(C.mix(empty)).collect() == []
    with pytest.raises(ValueError):
        C.mix(empty, weights=(1, 9))
    for knots in (((0.0, 1.0), (0.9, 1.0)), ((0.0, 0.0), (1.0, 1.0)), ((0.0, 1.0), (0.0, 2.0), (1.0, 1.0))):
        with pytest.raises(ValueError):
            C.integral(knots)


def test_words_are_counted_as_listed(spark):
    texts = ["", " ", "a", " a", "a ", "\x0b\x0ca\x1cb c", "a b", "\x00 x", "é ü", "a\n\nb\r\nc", "x" * 100_000, "x " * 100_000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.n_words(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", r.t)) for r in got]
