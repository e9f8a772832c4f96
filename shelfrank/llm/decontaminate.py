"""Benchmark decontamination by winnowing.

A document word is *hit* when it lies inside an occurrence of a window of
``window`` consecutive words of a benchmark item (an item with fewer words is
one window itself). Winnowing finds the occurrences: of the k-gram hashes in
each run of ``window - k + 1`` k-grams the minimum is kept, on both sides, so
every shared span of ``window`` words shares a kept fingerprint. Fingerprints
that meet are extended word by word, which also removes hash collisions.

The benchmark side is a table of a few thousand items, much smaller than the
corpus. It goes to the tasks as read-only blocks of at most ``block_bytes`` of
text each (checked before anything is collected); a larger benchmark is worked
off block by block, with the same result. Documents are never shuffled while
one block is enough.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from shelfrank.llm.common import id_type, out_batch, schema_of, slices, text_of, texts_of, utf8_input
from shelfrank.session import persist_table

#: Text bytes of the benchmark in one block (about ten times that in a task).
BLOCK_BYTES = 4 << 20

#: Bytes outside words become spaces, A-Z become a-z; bytes from 0x80 on are
#: parts of non-ASCII characters, which are word characters.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
              else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

SPANS = "array<struct<start:int,end:int>>"


def words_of(utf8: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Every other
    byte has become a space, so ``split`` cuts at those alone."""
    return utf8.translate(_FOLD).split()


class _Ids(dict):
    """Benchmark words by number; every other word is 0."""

    def __missing__(self, word):
        return 0


def _mixed(n: int) -> np.ndarray:
    """A fixed pseudo-random 64-bit value for each word number."""
    x = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _gram_hashes(ids: np.ndarray, n: int, mix: np.ndarray) -> np.ndarray:
    """Hash of the n-gram that starts at each word; the largest value marks
    n-grams that hold a word which the benchmark does not have."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h, known = np.zeros(m, np.uint64), np.ones(m, bool)
    for j in range(n):
        part = ids[j:j + m]
        h = h * np.uint64(0x100000001B3) + mix[part]
        known &= part > 0
    h >>= np.uint64(1)
    h[~known] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return h


def _winnowed(h: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the minimum of some run of ``width`` hashes."""
    runs = len(h) - width + 1
    if runs <= 0:
        return np.empty(0, np.int64)
    low = h[:runs].copy()
    for j in range(1, width):
        np.minimum(low, h[j:j + runs], out=low)
    kept = np.zeros(len(h), bool)
    for j in range(width):
        kept[j:j + runs] |= h[j:j + runs] == low
    kept &= h != np.uint64(0xFFFFFFFFFFFFFFFF)
    return np.flatnonzero(kept)


@dataclass
class Block:
    """Fingerprints of some benchmark items. ``ids`` are their words one after
    the other, with ``pad`` zeros between items."""

    words: dict
    mix: np.ndarray
    ids: np.ndarray
    item: np.ndarray  # at each word: the number of its item
    names: list  # item_ids by item number
    grams: dict  # n-gram length -> (sorted hashes, their places in ids)
    k: int
    window: int

    @classmethod
    def of(cls, items: list[tuple[object, bytes]], k: int, window: int) -> Block:
        texts: dict[tuple, set] = {}
        for item_id, utf8 in items:
            if words := tuple(words_of(utf8)):
                texts.setdefault(words, set()).add(item_id)
        vocab = _Ids()
        for words in texts:
            for w in words:
                if w not in vocab:
                    vocab[w] = len(vocab) + 1
        mix = _mixed(len(vocab) + 1)
        gap = [0] * window
        ids, item = list(gap), [0] * window
        short: dict[int, list[int]] = {}
        long: list[tuple[int, int]] = []
        for n, words in enumerate(texts):
            if len(words) < window:
                short.setdefault(len(words), []).append(len(ids))
            else:
                long.append((len(ids), len(words)))
            ids += [vocab[w] for w in words] + gap
            item += [n] * (len(words) + window)
        ids = np.array(ids, np.int64)
        grams = {}
        for n, starts in short.items():
            at = np.array(starts, np.int64)
            h = _gram_hashes(ids, n, mix)[at]
            order = np.argsort(h, kind="stable")
            grams[n] = (h[order], at[order])
        places = [np.empty(0, np.int64)]
        for start, n in long:
            places.append(start + _winnowed(_gram_hashes(ids[start:start + n], k, mix), window - k + 1))
        at = np.concatenate(places)
        if len(at):
            h = _gram_hashes(ids, k, mix)[at]
            order = np.argsort(h, kind="stable")
            grams[0] = (h[order], at[order])
        names = [sorted((i for i in s if i is not None), key=str) for s in texts.values()]
        return cls(vocab, mix, ids, np.array(item, np.int64), names, grams, k, window)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of windows in ``ids`` (document words one after the
        other, ``window`` zeros before, between and after documents): start,
        end and item number of each."""
        found = [(np.empty(0, np.int64),) * 3]
        for n, (hashes, places) in self.grams.items():
            if n:
                h = _gram_hashes(ids, n, self.mix)
                mine, theirs = _meet(h, np.flatnonzero(np.isin(h, hashes)), hashes, places)
                same = np.ones(len(mine), bool)
                for j in range(n):
                    same &= ids[mine + j] == self.ids[theirs + j]
                found.append((mine[same], mine[same] + n, self.item[theirs[same]]))
                continue
            h = _gram_hashes(ids, self.k, self.mix)
            kept = _winnowed(h, self.window - self.k + 1)
            mine, theirs = _meet(h, kept[np.isin(h[kept], hashes)], hashes, places)
            # each window around a kept k-gram lies within `reach` words of it
            reach = self.window - self.k
            same = np.empty((2 * reach + self.k, len(mine)), bool)
            for j in range(len(same)):
                ours = ids[mine + j - reach]
                same[j] = (ours == self.ids[theirs + j - reach]) & (ours > 0)
            for first in range(reach + 1):
                whole = same[first:first + self.window].all(axis=0)
                start = mine[whole] + first - reach
                found.append((start, start + self.window, self.item[theirs[whole]]))
        return tuple(np.concatenate(x) for x in zip(*found))


def _meet(h, mine, hashes, places):
    """All pairs of a document place and a benchmark place with equal hashes."""
    lo, hi = np.searchsorted(hashes, h[mine], "left"), np.searchsorted(hashes, h[mine], "right")
    n = hi - lo
    first = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else lo, n)
    return np.repeat(mine, n), places[first + np.arange(n.sum())]


def _spans(start: np.ndarray, end: np.ndarray) -> list[dict]:
    """Sorted union of the ranges."""
    out: list[dict] = []
    for s, e in sorted(set(zip(start.tolist(), end.tolist()))):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


def _mark(block, carry: bool, item_type: pa.DataType):
    def run(batches):
        b: Block = block.value
        gap = [0] * b.window
        for batch in batches:
            for part in slices(batch):
                ids, starts, counts = list(gap), [], []
                for utf8 in texts_of(part):
                    words = words_of(utf8)
                    starts.append(len(ids))
                    counts.append(len(words))
                    ids += map(b.words.__getitem__, words)
                    ids += gap
                begin = np.array(starts, np.int64)
                s, e, item = b.hits(np.array(ids, np.int64))
                row = np.searchsorted(begin, s, "right") - 1
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(len(starts) + 1))
                spans, items = [], []
                for r in range(len(starts)):
                    mine = order[cut[r]:cut[r + 1]]
                    spans.append(_spans(s[mine] - begin[r], e[mine] - begin[r]) if len(mine) else [])
                    items.append(sorted({x for n in set(item[mine].tolist()) for x in b.names[n]}, key=str))
                yield out_batch(
                    part, carry, n_words=pa.array(counts, pa.int64()),
                    spans=pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    items=pa.array(items, pa.list_(item_type)))
    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, k: int = 5, window: int = 10,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  carry: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: ``id``, ``n_words``, ``spans`` (sorted, disjoint word ranges
    that are hit) and ``items`` (ids of the items with an occurring window, sorted
    as strings); with ``carry`` also ``text`` and ``doc``, the other columns.

    Null or empty texts have no words and no hits; empty items are no windows;
    a null item_id hits words but is not listed; equal items are all listed. An
    empty benchmark hits nothing. Repeated documents give one row each.
    """
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and the window")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("id"), text_of(text_col).cast("binary").alias("utf8"))
    total = items.agg(F.sum(F.length("utf8"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)

    def marked(source: DataFrame, part: DataFrame, id_ddl: str) -> DataFrame:
        block = spark.sparkContext.broadcast(
            Block.of([(r.id, bytes(r.utf8)) for r in part.toLocalIterator()], k, window))
        return source.mapInArrow(
            _mark(block, "doc" in source.columns, item_type),
            schema_of(f"id {id_ddl}, n_words bigint, spans {SPANS}, items array<{id_type(benchmark, item_col)}>", source))

    source = utf8_input(docs, id_col, text_col, carry)
    if n_blocks == 1:
        return marked(source, items, id_type(docs, id_col))
    # stable row numbers, then one pass over the documents for each block
    rows = persist_table(source.withColumn("row", F.monotonically_increasing_id()), spark, "decontaminate")
    found = None
    for b in range(n_blocks):
        part = marked(rows.select(F.col("row").alias("id"), "utf8"),
                      items.where(F.pmod(F.xxhash64("utf8"), F.lit(n_blocks)) == b), "bigint")
        found = part if found is None else found.union(part)
    merged = found.groupBy(F.col("id").alias("row")).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.flatten(F.collect_list("items")).alias("items"))
    joined = F.aggregate(
        "spans", F.array().cast(SPANS),
        lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, -1)["end"] >= x["start"]), F.concat(
            F.slice(out, 1, F.size(out) - 1), F.array(F.struct(
                F.element_at(out, -1)["start"].alias("start"),
                F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end"))))).otherwise(
            F.concat(out, F.array(x))))
    by_text = lambda x, y: F.when(x.cast("string") < y.cast("string"), -1).when(
        x.cast("string") > y.cast("string"), 1).otherwise(0)
    return rows.join(merged, "row").select(
        "id", "n_words", joined.alias("spans"),
        F.array_sort(F.array_distinct("items"), by_text).alias("items"),
        *([F.col("utf8").cast("string").alias("text"), "doc"] if carry else []))
