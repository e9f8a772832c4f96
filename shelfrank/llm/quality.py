"""Quality classifier: supervised subword embeddings.

A text's features are its words and the character n-grams of each word (with
``<`` and ``>`` at its ends), hashed into buckets. Each bucket has a learned
vector; a text is the average of its features' vectors, and a softmax over two
classes reads it. Both are trained together by stochastic gradient descent in
numpy, on a bounded sample of the labelled rows (``train_rows``).

The softmax reads an average, so it is the average of what it reads from each
vector: a trained model is one number per bucket, and scoring a text of any
length is a sum over its features. That table (fixed size) goes to the tasks;
documents are scored where they lie, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import id_type, out_batch, schema_of, slices, text_of, texts_of, utf8_input

#: Buckets, vector length, character n-grams, training.
BUCKETS = 1 << 17
DIM = 10
GRAMS = (3, 4)
EPOCHS = 8
#: Few rows are gone through more often, until there are this many steps.
STEPS = 8_000
RATE = 0.5
#: Words back within which a repeated pair of words is noticed.
REPEAT = 12
#: Labelled rows of each class that are learned from, and the longest text
#: among them (bytes). Scoring has no limit of either kind.
TRAIN_ROWS = 2_000
TRAIN_BYTES = 100_000

_P = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_UNBASE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def held_out(id_col: str) -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 5, is 0.
    (A null id counts as the empty text.)"""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _mix(h: np.ndarray, buckets: int) -> np.ndarray:
    h = h ^ h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, np.uint64))


def features(utf8: bytes, buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS) -> np.ndarray:
    """Buckets of the text's words and character n-grams (of bytes), repeats
    included, and bucket 0 for each word that repeats what stands shortly before.
    Words are separated by ASCII white space and keep their case."""
    data = np.frombuffer(utf8, np.uint8)
    if not len(data):
        return np.empty(0, np.int64)
    space = np.concatenate(([True], _SPACE[data], [True]))
    first = np.flatnonzero(space[:-1] & ~space[1:])
    last = np.flatnonzero(~space[:-1] & space[1:])
    if not len(first):
        return np.empty(0, np.int64)
    # every byte is a symbol of its own; white space next to a word is its end mark
    symbol = np.concatenate(([0], np.where(space[1:-1], 0, data.astype(np.int64) + 1), [0])).astype(np.uint64)
    code = (symbol + np.uint64(1)) * np.uint64(_P)
    out = []
    longest = int((last - first).max())
    done = np.zeros(len(first), np.uint64)
    alive, place = np.arange(len(first)), first + 1
    for step in range(min(longest, 64)):
        done[alive] = done[alive] * np.uint64(0x100000001B3) + code[place + step]
        on = (last[alive] - first[alive]) > step + 1
        alive, place = alive[on], place[on]
        if not len(alive):
            break
    if longest > 64:
        # longer words are hashed whole, by prefix sums: the base is odd, so its powers can be divided by
        far = np.flatnonzero(last - first > 64)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(code * _powers(_BASE, len(code)))))
        whole = sums[last[far] + 1] - sums[first[far] + 1]
        done[far] = whole * _powers(_UNBASE, len(code))[first[far]]
    done ^= (last - first).astype(np.uint64) << np.uint64(40)
    out.append(_mix(done, buckets))
    again = np.zeros(len(done), bool)
    for back in range(1, min(REPEAT, len(done) - 1) + 1):
        same = done[back:] == done[:-back]
        again[back:] |= same if back == 1 else same & np.concatenate(([False], same[:-1]))
    # a word that repeats the word before, or with it a pair of words shortly before
    out.append(np.zeros(int(again.sum()), np.int64))
    for n in grams:
        m = len(symbol) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        inside = np.ones(m, bool)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + code[j:j + m]
            if 0 < j < n - 1:
                inside &= symbol[j:j + m] > 0
        out.append(_mix(h[inside] * np.uint64(_P), buckets))
    return np.concatenate(out)


@dataclass
class Model:
    """``weight`` of each bucket and ``bias``: log-odds of class 1."""

    weight: np.ndarray
    bias: float
    grams: tuple[int, ...]

    def score(self, utf8: bytes) -> float:
        f = features(utf8, len(self.weight), self.grams)
        x = self.bias + (float(self.weight[f].mean()) if len(f) else 0.0)
        return 1.0 / (1.0 + float(np.exp(-min(max(x, -500.0), 500.0))))


def train(texts: list[bytes], labels: list[int], share: float, *, buckets: int = BUCKETS, dim: int = DIM,
          grams: tuple[int, ...] = GRAMS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Fits the vectors and the softmax. ``share``: of class 1 among all labelled
    rows; the sample's other share is corrected for in the bias, so that the
    score is a probability for rows as they come."""
    rng = np.random.default_rng(seed)
    if not texts:
        return Model(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))), grams)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    read = np.zeros((dim, 2), np.float32)
    base = np.zeros(2, np.float32)
    rows = []
    for t in texts:
        u, n = np.unique(features(t, buckets, grams), return_counts=True)
        rows.append((u, (n / max(1, n.sum())).astype(np.float32)))
    epochs = max(epochs, -(-STEPS // len(rows)))
    order, step, steps = np.arange(len(rows)), 0, epochs * len(rows)
    for _ in range(epochs):
        rng.shuffle(order)
        for r in order:
            lr = rate * (1 - step / steps)
            step += 1
            u, w = rows[r]
            mean = w @ vectors[u] if len(u) else np.zeros(dim, np.float32)
            z = mean @ read + base
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[r]] -= 1
            back = read @ p
            read -= lr * np.outer(mean, p)
            base -= lr * p
            if len(u):
                vectors[u] -= (lr * len(u) ** 0.5) * np.outer(w, back)
    ones = sum(labels)
    shift = np.log(share / (1 - share)) - np.log((ones + 1) / (len(labels) - ones + 1))
    return Model((vectors @ (read[:, 1] - read[:, 0])).astype(np.float32), float(base[1] - base[0] + shift), grams)


def sample(docs: DataFrame, labels: DataFrame, label: str, *, rows: int, most_bytes: int, id_col: str = "doc_id",
           text_col: str = "text") -> tuple[list[bytes], list[int], float]:
    """Texts and labels of at most ``rows`` labelled rows of each class, chosen
    by hash among those that are not held out, and the share of class 1 among
    all labels that are not held out. Only the chosen ids and texts, a bounded
    number, come to the driver."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)) \
        .groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (n.get(1, 0) + 0.5) / (n.get(0, 0) + n.get(1, 0) + 1)
    chosen = []
    for y in (0, 1):
        chosen += known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows).collect()
    if not chosen:
        return [], [], share
    picked = spark.createDataFrame([(r.id, r.y) for r in chosen], "id bigint, y int")
    found = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).cast("binary").alias("utf8")) \
        .where(F.length("utf8") <= most_bytes).join(F.broadcast(picked), "id").dropDuplicates(["id"]) \
        .orderBy("id").collect()
    return [bytes(r.utf8) for r in found], [r.y for r in found], share


def scored(docs: DataFrame, model, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``id`` and ``score`` of every row, by ``model.score(utf8)``; ``carry``
    adds ``text`` and ``doc``, the other columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = [shared.value.score(t) for t in texts_of(part)]
                yield out_batch(part, carry, score=pa.array(found, pa.float64()))

    source = utf8_input(docs, id_col, text_col, carry)
    return source.mapInArrow(run, schema_of(f"id {id_type(docs, id_col)}, score double", source))


def quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", train_rows: int = TRAIN_ROWS,
            train_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", carry: bool = False,
            **fit) -> DataFrame:
    """Per document: ``id``, ``held_out``, ``score`` (probability of label 1);
    ``carry`` adds ``text`` and ``doc``, the other columns.

    Trains on at most ``train_rows`` labelled documents of each class that are
    not held out and have at most ``train_bytes`` of text; ids are integers
    there. Only texts are features. Null and empty texts get the score of a text
    without features. Labels other than 0 and 1 are not used; a document
    labelled twice counts with the larger label. Without labels every score is
    one half. One row per input row.
    """
    texts, known, share = sample(docs, labels, label, rows=train_rows, most_bytes=train_bytes, id_col=id_col, text_col=text_col)
    found = scored(docs, train(texts, known, share, **fit), id_col=id_col, text_col=text_col, carry=carry)
    return found.select("id", held_out("id").alias("held_out"), "score", *(["text", "doc"] if carry else []))
