"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from shelfrank.llm import spelling as S

DOCS = "doc_id bigint, text string, word string, n string, gram int"


def brute_words(rows, one_in, min_chars=6, min_count=5):
    out = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if one_in:
                h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
                if h % one_in == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= min_chars and n >= min_count}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    near = {w: [x for x in counts if one_apart(w, x)] for w in counts}
    best = {w: min(near[w], key=lambda x: (-counts[x], x)) for w in counts if near[w]}
    form = {w: x for w, x in best.items() if counts[x] >= 5 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS)


def edits(word, rng, letters):
    i = rng.randrange(len(word) + 1)
    return rng.choice([word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1:], word[:i] + word[i + 1:]])


def corpus(seed, letters, n=400):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababababab"]
    known = stems + [edits(rng.choice(stems), rng, letters) for _ in range(200)]
    known += [edits(w, rng, letters) for w in known[-100:]]
    weight = [rng.choice([1, 5, 30, 200]) for _ in known]
    rows = []
    for i in range(n):
        words = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w in rng.choices(known, weight, k=rng.randrange(60))]
        rows.append((i if i % 50 else None, rng.choice([" ", "-", "1", "€"]).join(words)))
    return rows + [(7, None), (8, ""), (9, "12 €€ ÿÀÀÿ×÷× " * 9), (10, "x" * 70_000 + " " + ("é" * 50 + " ") * 5)] + rows[:30]


@pytest.mark.parametrize("seed, letters", [(1, "ab"), (2, "abcdeé"), (3, "abcdefghijklmnopqrstuvwxyzÿ")])
def test_equals_brute_force(spark, seed, letters):
    rows = corpus(seed, letters)
    counts = brute_words(rows, 19)
    assert len(counts) > 50
    got = S.spelling_variants(frame(spark, rows), one_in=19)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(counts)


def test_forms_are_followed_to_the_last(spark):
    """A chain of words, each five times as frequent as the one before."""
    chain = ["abcdefghijklmn"[:6 + k] for k in range(5)]
    rows = [(i, (w + " ") * 5 ** (k + 1)) for i, (k, w) in enumerate(enumerate(chain))] + [(99, "xbcdef " * 5)]
    got = {r.word: r for r in S.spelling_variants(frame(spark, rows)).collect()}
    assert {w: got[w].root for w in got} == dict.fromkeys([*chain], chain[-1]) | {"xbcdef": "xbcdef"}
    assert [got[w].form for w in chain] == [*chain[1:], None] and got["xbcdef"].n_near == 1


def test_words_without_errors_in_long_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE_BYTES", 50)
    monkeypatch.setattr(S, "RUNS", 30)
    rows = corpus(4, "abcé")
    import pyarrow as pa

    utf8 = pa.RecordBatch.from_arrays([pa.array([str(i) for i, _ in rows]), pa.array([None if t is None else t.encode() for _, t in rows], pa.binary())], names=["id", "utf8"])
    for one_in in (None, 7):
        out = Counter()
        for b in S._counted(1, one_in)([utf8]):
            for r in b.to_pylist():
                out[r["word"]] += r["n"]
        assert {w: n for w, n in out.items() if w} == brute_words([(str(i), t) for i, t in rows], one_in, 1, 1)


def test_one_edit_leaves_a_gram_in_both_signatures():
    """For many words and a dictionary of any frequent grams."""
    rng = random.Random(9)
    for _ in range(4000):
        letters = rng.choice(["ab", "abcd", "abcdefgh"])
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 12)))
        b = edits(a, rng, letters + "z")
        if len(b) < 6 or a == b:
            continue
        text = (a + S.END) + (b + S.END)
        frequent = {}
        for q in range(2, 6):
            for p in range(len(text) - q + 1):
                g = text[p:p + q]
                if rng.random() < 0.6 and (q == 2 or g[:-1] in frequent):
                    frequent[g] = rng.randrange(9, 99)
        keys = [{(g, "start", p) for g, p in S.signature(w, frequent)} | {(g, "end", len(w) - p) for g, p in S.signature(w, frequent)} for w in (a, b)]
        assert keys[0] & keys[1], (a, b, frequent)


def test_decomposition_and_bound():
    frequent = {"ab": 50, "abc": 40, "bc": 30}
    assert S.decompose("abcdef", frequent) == ["abcd", "bcd", "cd", "de", "ef", "f" + S.END]
    assert S.affected(["abcd", "bcd", "cd", "de", "ef", "f" + S.END]) == 4
    assert S.affected([]) == 0


def test_empty_table_and_options(spark):
    assert S.spelling_variants(frame(spark, []).limit(0)).collect() == []
    assert S.spelling_variants(frame(spark, [(1, "short words only")])).collect() == []
    with pytest.raises(ValueError):
        S.spelling_variants(frame(spark, []), min_chars=5)
    with pytest.raises(ValueError):
        S.spelling_variants(frame(spark, []), outnumbers=1)


def test_query_equals_brute_force_on_the_smallest_table(spark):
    from shelfrank.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in QUERIES["op12_vgram_spelling"](spark, sf).collect()}
    assert got == brute(brute_words(rows, 199))
