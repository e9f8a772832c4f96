"""Winnowing against a brute-force scan of every window."""

import random
import re

from shelfrank.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=10):
    out = []
    tests = [(i, WORD.findall(lower(t))) for i, t in items]
    for d, text in docs:
        words, hit, names = WORD.findall(lower(text)), set(), set()
        for i, w in tests:
            n = min(window, len(w))
            for p in range(len(w) - n + 1 if n else 0):
                for q in range(len(words) - n + 1):
                    if words[q:q + n] == w[p:p + n]:
                        hit.update(range(q, q + n))
                        if i is not None:
                            names.add(i)
        out.append((d, len(words), tuple(sorted(hit)), tuple(sorted(names, key=str))))
    return sorted(out, key=str)


def collect(df):
    return sorted(((r.id, r.n_words, tuple(p for s in r.spans for p in range(s.start, s.end)), tuple(r["items"]))
                   for r in df.collect()), key=str)


def tables(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)] + ["über", "día", "Ψυχή", "naïve9"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 25]) if i % 4 == 0 else rng.randint(10, 30))) for i in range(12)]
    items = [x for x in items if len(WORD.findall(x[1])) > 1]
    items += [(None, text(12)), (99, None), (98, ""), (97, items[1][1].upper()), (96, items[1][1])]
    docs = []
    for d in range(40):
        t = text(rng.randint(0, 60))
        if d % 3 == 0:
            w = rng.choice([x for x in items if x[1]])[1].split(" ")
            at = rng.randint(0, max(0, len(w) - 8))
            t += " " + " ".join(w[at:at + rng.randint(8, 14)]) + "! " + text(5)
        docs.append((d, t))
    docs += [(100, None), (101, ""), (None, items[2][1]), (7, docs[7][1]), (102, "  \t-- "), (103, text(3000) + items[3][1] + text(3000))]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(spark):
    docs, items, d, b = tables(spark)
    assert collect(decontaminate(d, b)) == brute(docs, items)


def test_blocks_give_the_same_rows(spark):
    docs, items, d, b = tables(spark)
    assert collect(decontaminate(d, b, block_bytes=300)) == brute(docs, items)


def test_other_window_and_k(spark):
    docs, items, d, b = tables(spark)
    assert collect(decontaminate(d, b, k=3, window=4)) == brute(docs, items, 4)
    assert collect(decontaminate(d, b, k=6, window=6)) == brute(docs, items, 6)


def test_empty_tables_and_carried_columns(spark):
    docs, items, d, b = tables(spark)
    assert decontaminate(d.limit(0), b).count() == 0
    assert {(n, s) for _, n, s, _ in collect(decontaminate(d, b.limit(0)))} == {(n, ()) for _, n, _, _ in brute(docs, items)}
    from pyspark.sql import functions as F
    wide = d.withColumn("items", F.lit("x")).withColumn("id", F.col("doc_id")).withColumn("utf8", F.lit(1))
    rows = decontaminate(wide, b, carry=True).collect()
    assert len(rows) == len(docs) and all(r.doc["items"] == "x" and r.doc["doc_id"] == r.id for r in rows)
    assert sorted(str((r.id, r.text)) for r in rows) == sorted(map(str, docs))
    more = decontaminate(wide, b, carry=True, block_bytes=300).collect()
    assert sorted(str((r.id, r.text, r.n_words)) for r in more) == sorted(str((r.id, r.text, r.n_words)) for r in rows)
