"""How text filters interact: what every order of them removes, part by part.

Five filters make 32 subsets, and a document survives a subset when it fails
none of its filters. Its truth table, one bit per subset, is a 32-bit word. The
survivors of each subset in a part (a source) are counted by positional
popcounts of these words, with carry-save adders: three words of one weight
become a word of sums and a word of carries, which weighs twice as much, and
only the last two words of a weight have their bits taken apart.

From the 32 counts of a part everything else is arithmetic: after some filters
as many documents are kept as survive that subset, so all 120 orders cost one
pass over the documents, and none of them is run.

The filters (a failing document is removed):

* A: under ``min_words`` words ``[^\\x20\\x09-\\x0D]+``;
* B: fewer distinct words than half of all words (case counts);
* C: over 2 capital letters A-Z in 100 code points;
* D: one of the signs ``#$%&*|``;
* E: the same text as a document with a smaller id, in the whole table.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import slices, small_batches, texts_of
from shelfrank.session import persist_table

FILTERS = "ABCDE"
MIN_WORDS = 200
SIGNS = b"#$%&*|"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_TAILS = bytes(range(0x80, 0xC0))
_E = 1 << FILTERS.index("E")
#: Sets of documents that are counted.
KINDS = ("all", "good", "toxic")
#: A task adds the words of so many parts before it gives their sums away.
PARTS = 4096

#: By the set of filters that a document fails: its truth table. Bit s of the word
#: is 1 when the document survives the subset s.
TRUTH = np.array([sum(1 << s for s in range(32) if not s & failed) for failed in range(32)], np.uint32)


def failures(utf8: bytes, min_words: int = MIN_WORDS) -> int:
    """The filters A to D that a text fails, as bits 0 to 3."""
    words = utf8.split()
    n_chars = len(utf8.translate(None, _TAILS))
    capitals = len(utf8) - len(utf8.translate(None, _CAPITALS))
    return ((len(words) < min_words) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * n_chars) << 2
            | (len(utf8.translate(None, SIGNS)) < len(utf8)) << 3)


def _features(min_words: int):
    def run(batches):
        for batch in batches:
            for rows in slices(batch):
                texts = texts_of(rows)
                failed = pa.array([failures(t, min_words) for t in texts], pa.int32())
                digest = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), failed, digest],
                                                 names=["id", "part", "failed", "digest"])
    return run


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set (carry-save adders)."""
    counts, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while (k := len(words) // 3):
            a, b, c = words[:k], words[k:2 * k], words[2 * k:3 * k]
            half = a ^ b
            carries.append(a & b | half & c)
            words = np.concatenate((half ^ c, words[3 * k:]))
        for word in words:  # two at most
            counts += weight * (word >> np.arange(32, dtype=np.uint32) & 1).astype(np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return counts


def _counts(batches):
    """(part, failed, good, toxic) -> sums of the task: part, kind, 32 counts."""
    held: dict[str, np.ndarray] = {}

    def out():
        rows = [(part, kind, n) for part, sums in held.items() for kind, n in enumerate(sums) if n.any()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
             *(pa.array([r[2][i] for r in rows], pa.int64()) for i in range(32))], names=["part", "kind", *_COUNTS])

    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        at = parts.indices.to_numpy(zero_copy_only=False)
        words = TRUTH[batch.column(1).to_numpy(zero_copy_only=False)]
        sets = [np.ones(len(at), bool), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))]
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(parts.dictionary) + 1))
        for i, part in enumerate(parts.dictionary.to_pylist()):
            own = order[ends[i]:ends[i + 1]]
            sums = held.setdefault(part, np.zeros((len(KINDS), 32), np.int64))
            for kind, members in enumerate(sets):
                sums[kind] += positional_popcount(words[own[members[own]]])
        if len(held) > PARTS:
            yield out()
            held = {}
    if held:
        yield out()


_COUNTS = [f"n{s}" for s in range(32)]


def survivors(docs: DataFrame, labels: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
              part_col: str = "source") -> DataFrame:
    """``part``, ``kind`` (0 all documents, 1 of good quality, 2 toxic), ``n0`` to
    ``n31``: how many of them survive each subset of the filters (bit 0: A).

    One row per part and kind that has documents. A null text is an empty one, a
    null part the empty string. ``labels`` (doc_id, quality, toxic) may lack
    documents; if a document has several rows, one with a 1 is enough, and a value
    other than 1 says no. For E, a null id is neither smaller than another nor has
    it smaller ones; rows with the same id and text do not remove each other. An
    empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary").alias("utf8"),
                         F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    found = persist_table(source.mapInArrow(_features(min_words), "id bigint, part string, failed int, digest binary"), spark, "audit-documents")
    # a written table, so that Spark can split the join where one text is a large part of all
    first = persist_table(found.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"),
                          spark, "audit-copies")
    marked = found.join(first, "digest", "left").select(
        "id", "part", F.col("failed").bitwiseOR(F.when(F.col("id") > F.col("first"), F.lit(_E)).otherwise(F.lit(0))).alias("failed"))
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = marked.join(told, "id", "left").select("part", "failed", F.coalesce("good", F.lit(False)).alias("good"),
                                                  F.coalesce("toxic", F.lit(False)).alias("toxic"))
    sums = rows.mapInArrow(_counts, ", ".join(["part string, kind int", *(f"{n} bigint" for n in _COUNTS)]))
    return sums.groupBy("part", "kind").agg(*[F.sum(n).alias(n) for n in _COUNTS])


# ------------------------------------------------------------- the orders

#: For every order and step: its letters, the step, and the subsets before and after.
_STEPS = [("".join(order), step + 1, sum(1 << FILTERS.index(f) for f in order[:step]), sum(1 << FILTERS.index(f) for f in order[:step + 1]))
          for order in permutations(FILTERS) for step in range(len(FILTERS))]


def _orders(batches):
    before, after = (np.array([s[i] for s in _STEPS]) for i in (2, 3))
    which = before ^ after
    for batch in batches:
        names = batch.schema.names
        n = {kind: np.stack([batch.column(names.index(f"{kind}_{c}")).to_numpy(zero_copy_only=False) for c in _COUNTS], axis=1) for kind in KINDS}
        every, part = n["all"], batch.column(0)
        rows = len(part)
        for start in range(0, rows, 100):
            x = every[start:start + 100]
            here = x[:, before] - x[:, after]
            alone = x[:, 31 ^ which] - x[:, [31]]
            shapley = np.zeros((len(x), 32), np.int64)
            for bit in (1 << i for i in range(len(FILTERS))):
                shapley[:, bit] = here[:, which == bit].sum(axis=1)
            k = len(x)
            flat = lambda a: pa.array(a.ravel(), pa.int64())
            yield pa.RecordBatch.from_arrays([
                part.slice(start, k).take(pa.array(np.repeat(np.arange(k), len(_STEPS)))),
                pa.array([s[0] for s in _STEPS] * k), pa.array([s[1] for s in _STEPS] * k, pa.int32()),
                flat(x[:, after]), flat(here), flat(x[:, [0]] - x[:, which] - here), flat(alone),
                *(flat(n[kind][start:start + 100][:, before] - n[kind][start:start + 100][:, after]) for kind in KINDS[1:]),
                flat(shapley[:, which])],
                names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


def filter_audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per part, order of the filters and step; ``options`` and the rules
    for odd rows are those of ``survivors``.

    ``part``, ``filter_order`` (all 120), ``step`` (1 to 5; its filter is that
    letter), and counts within the part: ``kept`` after the step, ``removed``
    here, ``redundant`` (failing this filter, but removed before), ``unique_fails``
    (failing this filter only), ``good_lost``, ``toxic_lost`` (of ``removed``),
    ``shapley`` (removed by this filter, summed over all orders).
    """
    counts = survivors(docs, labels, **options)
    wide = counts.groupBy("part").agg(*[
        F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(c))), F.lit(0)).alias(f"{kind}_{c}") for k, kind in enumerate(KINDS) for c in _COUNTS])
    return wide.mapInArrow(_orders, "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
                                    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")
