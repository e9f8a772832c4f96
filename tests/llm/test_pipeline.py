"""The pipeline against the brute-force versions of its stages."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_bpe import library
from test_decontaminate import brute as brute_hits
from test_simhash_anchors import expected as brute_groups
from test_substring_dedup import brute as brute_cut

import corpus_pipeline as P
from shelfrank.llm.queries import QUALITY
from shelfrank.llm.quality import quality

SF = "/root/testdata/sf0.001"


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(P.STAGES) == 5
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == P.COLUMNS, name


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    good = {r.id for r in quality(docs, labels).where(F.col("score") >= QUALITY).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    assert 0 < len(rows) <= docs.count()
    first = {i for i, _, c in brute_groups(rows, 2) if i == c}
    rows = [r for r in rows if r[0] in first]
    cut = {i: (n, kept) for i, _, n, kept in brute_cut(rows)}
    rows = [(i, cut[i][1]) for i, _ in rows]
    hit = {i for i, _, spans, _ in brute_hits(rows, items) if spans}
    t = library()
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in rows if i not in hit}
    got = P.run(spark, SF).collect()
    assert {r.doc_id: np.frombuffer(r.token_ids, "<u4").tolist() for r in got} == want
    assert all(r.n_tokens == len(want[r.doc_id]) and r.decoded == t.decode(want[r.doc_id], skip_special_tokens=False) for r in got)


def odd(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = text(60), text(4000)
    rows = [(1, text(30) + " " + passage), (2, text(40) + "\n" + passage + " " + text(9)), (3, None), (4, ""), (None, text(20)), (None, None),
            (5, long), (6, long), (7, "same row"), (7, "same row"), (8, text(50)), (9, passage)]
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long") \
        .withColumn("id", F.lit("clash")).withColumn("doc", F.lit("clash")), rows, passage


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, empty):
    docs, rows, passage = odd(spark)
    if empty:
        docs = docs.limit(0)
    for _, stage in P.STAGES[1:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns == P.COLUMNS
    got = collections.defaultdict(list)
    for r in docs.collect():
        got[r.doc_id].append(r)
    if empty:
        assert not got
    else:
        assert set(got) == {1, 2, 3, 5, 7, 8, 9, None} and len(got[None]) == 2 and len(got[7]) == 1
        assert got[1][0].text == rows[0][1] and got[9][0].text == "" and got[9][0].n_chars == 0
        assert passage not in got[2][0].text and got[2][0].n_chars == len(got[2][0].text)
    for _, stage in P.STAGES[3:]:
        docs = stage(spark, docs, SF)
    assert docs.count() == sum(map(len, got.values()))
    assert P.quality_stage(spark, docs.limit(0).selectExpr("doc_id", "decoded as text", "lang", "source", "n_tokens as n_chars"), SF).count() == 0
