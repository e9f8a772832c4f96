"""Quality and toxicity: held-out accuracy on the given tables, restoration,
and tables with odd rows."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfrank.llm import quality as Q
from shelfrank.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out_rows(found, labels, label):
    return found.where("held_out").join(labels, F.col("id") == F.col("doc_id")).select("score", F.col(label).alias("y")).collect()


def test_quality_on_held_out_rows(spark):
    docs, labels = tables(spark)
    rows = held_out_rows(Q.quality(docs, labels), labels, "quality")
    assert sum((r.score >= 0.3) == (r.y == 1) for r in rows) / len(rows) > 0.9
    good = [r.score for r in rows if r.y]
    assert sum(s >= 0.3 for s in good) / len(good) > 0.95


def test_toxicity_on_held_out_rows(spark):
    docs, labels = tables(spark)
    rows = held_out_rows(T.toxicity(docs, labels), labels, "toxic")
    assert sum((r.score >= 0.5) == (r.y == 1) for r in rows) / len(rows) > 0.9


def test_features_cover_words_and_grams():
    f = Q.features(b"Ab  cde\n")
    assert len(f) == 2 + (2 + 3) + (1 + 2)
    assert (Q.features(b" \tAb cde") == f).all() and len(Q.features(b" \n")) == len(Q.features(b"")) == 0
    assert sorted(Q.features(b"Ab x cde Ab x"))[:1] == [0]  # the repeated pair
    long = b"x" * 70 + b"y" * 10
    assert Q.features(long)[0] != Q.features(long + b"z")[0]


def test_model_reads_the_mean_of_vectors():
    m = Q.train([b"good words here", b"bad !!! words !!!"] * 40, [1, 0] * 40, 0.5, buckets=1 << 12)
    assert m.score(b"good words") > 0.7 > 0.3 > m.score(b"bad !!!")
    assert m.score(b"") == m.score(b"  ")


@pytest.mark.parametrize("make", [Q.quality, lambda d, l, **k: T.toxicity(d, l, **k)])
def test_odd_rows(spark, make):
    rows = [(1, "a nice text of words"), (2, None), (3, ""), (None, "x"), (4, "nice " * 30000), (1, "a nice text of words"), (5, "idiot " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("score", F.lit(-1))
    label = "quality" if make is Q.quality else "toxic"
    for given in ([(1, 1), (5, 0), (7, None), (None, 1), (1, 0)], [], [(1, 1)]):
        labels = spark.createDataFrame(given, f"doc_id long, {label} int")
        got = make(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        by = {}
        for r in got:
            by.setdefault(r.id, set()).add(r.score)
        assert len(by[1]) == 1 and by[2] == by[3]
        if not given:
            assert {r.score for r in got} == {0.5}
    assert make(docs.limit(0), spark.createDataFrame([(1, 1)], f"doc_id long, {label} int")).count() == 0


def test_held_out_rows_are_never_learned_from(spark):
    import zlib
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    texts, _, _ = Q.sample(docs, labels, "quality", rows=1000, most_bytes=100)
    assert {int(t.split()[1]) for t in texts} == set(range(400)) - set(ids)
    assert {r.id for r in Q.quality(docs, labels).where("held_out").collect()} == set(ids)


# ------------------------------------------------------------ restoration

def corpus():
    words = "the idiot was a moron and worthless stupid clown with pathetic trash for disgusting scum loser this house is on top of it".split()
    return b" ".join(w.encode() for w in words * 30)


def test_trigrams(spark):
    n = T.trigram_counts(b"Ab, ab \xc3\xa9")
    at = lambda *s: n[(s[0] * T.SYMBOLS + s[1]) * T.SYMBOLS + s[2]]
    assert at(0, 0, 1) == 2 and at(0, 1, 2) == 2 and at(1, 2, 0) == 2 and at(0, 0, 27) == 1
    docs = spark.createDataFrame([("Ab, ab é",), (None,), ("",)], "text string")
    total = np.zeros(T.SYMBOLS ** 3, np.int64)
    for r in T.corpus_trigrams(docs).collect():
        total[r.trigram] = r.n
    some = np.arange(T.SYMBOLS ** 3) % T.SYMBOLS > 0
    assert (total == n)[some].all()


def test_restores_obfuscated_words():
    r = T.Restorer(T.costs(T.trigram_counts(corpus())))
    for written, clean in (("1d10t", "idiot"), ("m0r0n", "moron"), ("st*pid", "stupid"), ("p@thet1c", "pathetic"), ("idiooooot!!", "idiot"),
                           ("$cum", "scum"), ("cl0wnnnn", "clown"), ("wor-th-less", "worthless"), ("d1$gust1ng", "disgusting")):
        assert clean.encode() in r.words(written.encode()), written
    for written, clean in (("you i d i o t !", "idiot"), ("s.t.u.p.i.d", "stupid"), ("l 0 s e r", "loser"), ("m o r o n", "moron")):
        assert clean.encode() in r.spaced(written.encode()), written
    assert r.words(b"house") == (b"house",) and r.words(b"(house),") == (b"house",) and r.words(b"###") == ()


def test_letters_may_stand_any_way_apart():
    r = T.Restorer(T.costs(T.trigram_counts(corpus())))
    for gap in (" ", "   ", "     ", "\n", " \r\n\t ", "\u00a0", "\u2003\u200b", "\ufeff", "-----", " .\n. ", "\u2060"):
        for word in ("idiot", "stupid", "worthless", "l0ser"):
            assert word.replace("0", "o").encode() in r.spaced(f"you: {gap.join(word)} .".encode()), (gap, word)
    assert r.spaced(b"a\nlist of one\nb\n") == [] and r.spaced("a\u00e9 b\u00e9 c\u00e9".encode()) == []
    start = time.time()
    for odd in (b"* " * 20000, b"a " * 50000 + b"bc", b"a\n\n\n" * 20000 + b"x\xc3", b" " * 200000 + b"a", b"a*" * 20000 + b"bc"):
        list(T._SPACED.finditer(odd))
    assert time.time() - start < 5


def test_viterbi_finds_the_cheapest_path():
    cost = T.costs(T.trigram_counts(corpus()))

    def price(token, path):
        total, text = 0.0, b""
        for emitted, extra in path:
            total, text = total + extra, text + emitted
        p = q = 0
        for x in text + b" ":
            s = T._SYMBOL[x]
            if s or q:
                total += cost[p, q, s]
            p, q = (q, s) if q and s else (0, s)
        return total, text

    for token in (b"1d10t", b"st*p", b"a!b", b"cl0wnnn", b"$c"):
        paths = itertools.product(*T.lattice(token))
        best = min(price(token, p) for p in paths)
        got = T.restore(token, cost)
        assert math.isclose(min(price(token, p)[0] for p in itertools.product(*T.lattice(token)) if price(token, p)[1].strip() == got.strip()), best[0])


def test_learned_words_are_found_when_obfuscated():
    import random
    rng = random.Random(2)
    sounds = "ba ke li mo nu ra si to ve za".split()
    text = lambda: " ".join("".join(rng.choices(sounds, k=rng.randint(1, 3))) for _ in range(30))
    texts, labels = [], []
    for i in range(300):
        words = text().split()
        if i % 3 == 0:
            words[rng.randrange(30)] = rng.choice(["glorp", "snarfle"])
        texts.append(" ".join(words).encode())
        labels.append(int(i % 3 == 0))
    m = T.train(texts, labels, 1 / 3, T.trigram_counts(b" ".join(texts)))
    assert m.score((text() + " glorp").encode()) > 0.9 and m.score(text().encode()) < 0.1
    for bad in ("gl0rp", "GLORP!!", "s n a r f l e", "snarrrrfle", "sn@rfle", "g-l-o-r-p"):
        assert m.score((text() + " " + bad + " " + text()).encode()) > 0.9, bad
    assert m.score(b"") < 0.1


def test_fully_replaced_words_are_restored():
    words = "the idiot was a loser and worthless trash with shit for this house is on top of it".split()
    r = T.Restorer(T.costs(T.trigram_counts(b" ".join(w.encode() for w in words * 30))))
    for written, clean in (("l053r", "loser"), ("7r45h", "trash"), ("1d107", "idiot"), ("5h17", "shit"), ("+r@$#", "trash")):
        assert clean.encode() in r.words(written.encode()), written
    assert r.words(b"2015") == () and r.words(b"***") == () and r.words(b"$20") == ()


def learned_from(bad_words):
    import random
    rng = random.Random(2)
    sounds = "ba ke li mo nu ra si to ve za".split()
    text = lambda: " ".join("".join(rng.choices(sounds, k=rng.randint(1, 3))) for _ in range(30))
    labels = [int(i % 3 == 0) for i in range(300)]
    texts = [" ".join([text(), *([rng.choice(bad_words)] if y else []), text()]).encode() for y in labels]
    return T.train(texts, labels, 1 / 3, T.trigram_counts(b" ".join(texts))), text


def test_learned_words_are_found_when_fully_replaced():
    m, text = learned_from(["loser", "idiot", "asshole", "trash"])
    assert m.score(text().encode()) < 0.1
    for bad in ("l053r", "1d107", "1053r", "7r45h", "4$$h0l3", "4$$#013"):
        assert m.score((text() + " " + bad + " " + text()).encode()) > 0.9, bad


def test_signs_at_the_end_doubled_letters_and_short_spacing():
    m, text = learned_from(["loser", "idiot", "ass", "trash", "stupid", "cunt", "moron"])
    for bad in ("idio+", "(idio+)", "a$$", "a$$!!", "tra$#", "*tra$#*", "stuupid", "iddiioott", "mmoorroonn", "a s s", "a $ $", "a-s-s", "i d i o +",
                "( u n t", "tr*sh", "t r a s #"):
        assert m.score((text() + " " + bad + " " + text()).encode()) > 0.9, bad
    for clean in ("too good, really (well) 1 2 3", "c++ a+ 50% #1 * * * hello! (f. b. i.)", "butter: 100 - 20 = 80!"):
        assert m.score((text() + " " + clean + " " + text()).encode()) < 0.1, clean


def test_restoring_long_odd_text_takes_no_long_time():
    import time
    r = T.Restorer(T.costs(T.trigram_counts(corpus())), {b"idiot ": 1.0})
    start = time.process_time()
    for odd in (b"* " * 3000 + b"x1", b"a*" * 3000 + b"bb", b"*" * 9000 + b"ab", b"1, " * 3000 + b"ab", b"ab" * 3000 + b"aa", b"a* *" * 2000 + b"bb"):
        r.spaced(odd)
        for token in odd.split():
            r.words(token) if len(token) > 5 else None
    assert time.process_time() - start < 30


def test_only_tokens_that_may_hold_an_indicator_are_searched(monkeypatch):
    import random
    rng = random.Random(4)
    known = {b"idiot ": 1.0, b"loser": 1.0, b"asshole ": 1.0, b"trash ": 1.0, "pé".encode() + b"ss ": 1.0}
    cost = T.costs(T.trigram_counts(corpus()))
    pieces = [b"idiot", b"l053r", b"4$$h0l3", b"tr", b"a$h", b"1d", b"107", b"ss", b"sss", "pé".encode(), b"0", b"**", b"-", b".", b"xy", b" ", b"##", b"\xc2"]
    m = T.Model(cost, known, 0.0, 1.0)
    r = T.Restorer(cost, known)
    held = 0
    for _ in range(3000):
        token = b"".join(rng.choices(pieces, k=rng.randint(1, 6)))
        words = [w for t in token.split() for w in r.words(t)] + r.joined(token)
        hits = {h for w in words for h in T._heads(w) if h in known}
        held += bool(hits)
        assert not hits or r.possible(token), token
        assert {h for t in token.split() for w in r.words(t) for h in T._heads(w) if h in known} <= m.found(token), token
    assert held > 300
    searched = []
    monkeypatch.setattr(T, "restorations", lambda part, *more, whole=T.restorations: searched.append(part) or whole(part, *more))
    assert m.found(b" ".join(b"b%dq.u%d@mail-%d" % (i, i, i) for i in range(500)) + b" you id1ot") == {b"idiot "}
    assert len(searched) < 20


def test_long_words_are_hashed_whole():
    at = lambda t: Q.features(t)[0]
    words = {b"x" * 70 + bytes([97 + i]) + b"y" * (20 + j) + bytes([97 + k]) for i in range(5) for j in range(3) for k in range(5)}
    assert len({at(w) for w in words}) > len(words) * 0.9
    for w in words:  # wherever the word stands
        assert at(w) in Q.features(b"a bc " + w + b" d")[:4] and (Q.features(w + b" " + w) == 0).any()
