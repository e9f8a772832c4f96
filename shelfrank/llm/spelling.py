"""Spelling variants: words one edit apart, found with variable-length grams.

Words are counted over all texts. A dictionary holds the grams of 2 to 5
characters that stand in more than ``T`` words' places: the frequent ones. The
gram at a place of a word is the shortest one there that is not frequent, 5
characters long at most (the end of a word is a character, too). So it depends
on its own characters only, and an edit touches just the grams that cover its
place; the most of them over all places is the word's bound of affected grams,
``b``.

Two words one edit apart therefore share, untouched, all but ``b`` grams of
either. With the grams of each word in one order, rarest first, the first
shared one is among the first ``b + 1`` of both. Only these lists are merged.
An untouched gram stands at the same distance from the start of both words,
before the edit, or from their end, behind it; and the lengths differ by one at
most. So a list's key is the gram, its distance from the start or the end, and
the word's length. Each pair that meets in a list is verified.

Size of the dictionary: with ``T`` at least the places of all words divided by
``GRAMS``, at most ``GRAMS`` grams of each of the four lengths are frequent,
whatever the number of words, so it goes to every task.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import SLICE_BYTES, slices, small_batches, texts_of
from shelfrank.session import drop_table, persist_table

#: Words of at least so many code points, and occurrences.
MIN_CHARS = 6
MIN_COUNT = 5
#: A near word is the form of a word that it outnumbers so many times.
OUTNUMBERS = 5
#: Lengths of grams; a word has more places than an edit can touch (MIN_CHARS > LONGEST).
SHORTEST, LONGEST = 2, 5
#: A gram in more places than this is frequent, or in more than one in GRAMS of all.
LEAST_T = 16
GRAMS = 50_000
#: The character behind a word's last, which no word holds.
END = "\0"

#: Distinct runs, and bytes of them, that a task counts before it gives them away;
#: a task of the gram count holds as many grams.
RUNS, RUN_BYTES = 200_000, 16 << 20
#: Runs of up to so many bytes have their hashes put together from tables.
SHORT = 40

#: Latin-1 bytes: A-Z lower-cased, a-z and U+00C0 to U+00FF as they are, the rest white space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_ZEROS = [bytes(k) for k in range(SHORT + 1)]
_ZERO_CRC = np.array([zlib.crc32(z) for z in _ZEROS], np.uint32)


# ---------------------------------------------------------------- words

def _pieces(line: bytes) -> Iterator[bytes]:
    """A long text in pieces that end at white space."""
    start = 0
    while len(line) - start > SLICE_BYTES and (end := line.find(b" ", start + SLICE_BYTES)) > 0:
        yield line[start:end]
        start = end
    yield line[start:] if start else line


def _utf8(run: bytes) -> bytes:
    return run if run.isascii() else run.decode("latin-1").encode()


class _Runs:
    """The runs of a task as Latin-1 bytes, numbered, with hashes and counts."""

    def __init__(self, one_in: int | None):
        self.one_in = one_in
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.crc, self.n_bytes, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.changed: dict[bytes, int] = defaultdict(int)
        self.size = 0

    def add(self, names: list[bytes], sizes: list[int], runs: list[bytes]) -> None:
        """The runs of some documents, ``sizes`` of them each."""
        at = np.fromiter(map(self.number.__getitem__, runs), np.int64, len(runs))
        if fresh := list(islice(reversed(self.number), len(self.number) - len(self.n)))[::-1]:
            utf8 = [_utf8(r) for r in fresh]
            self.crc = np.concatenate((self.crc, np.array([zlib.crc32(r) for r in utf8], np.uint32)))
            self.n_bytes = np.concatenate((self.n_bytes, np.array([len(r) for r in utf8], np.int64)))
            self.n = np.concatenate((self.n, np.zeros(len(fresh), np.int64)))
            self.size += sum(map(len, fresh))
        self.n += np.bincount(at, minlength=len(self.n))
        if self.one_in is None:
            return
        # the CRC-32 of name + run is the exclusive or of the run's, of the name's
        # carried on over as many zeros, and of the zeros'
        starts = [zlib.crc32(name) for name in names]
        carried = np.array([[zlib.crc32(z, s) for z in _ZEROS] for s in starts], np.uint32).reshape(-1, SHORT + 1) ^ _ZERO_CRC
        owner = np.repeat(np.arange(len(names)), sizes)
        n_bytes = self.n_bytes[at]
        h = self.crc[at] ^ carried[owner, np.minimum(n_bytes, SHORT)]
        for i in np.flatnonzero((h % self.one_in == 0) | (n_bytes > SHORT)).tolist():
            run = runs[i]
            whole = zlib.crc32(_utf8(run), starts[owner[i]])
            if whole % self.one_in == 0:
                k = whole % len(run)
                self.n[at[i]] -= 1
                self.changed[run[:k] + run[k + 1:]] += 1

    def full(self) -> bool:
        return len(self.number) > RUNS or self.size > RUN_BYTES

    def give(self, min_chars: int) -> pa.RecordBatch:
        kept = [(r.decode("latin-1"), n) for r, n in zip(self.number, self.n.tolist()) if n and len(r) >= min_chars]
        kept += [(r.decode("latin-1"), n) for r, n in self.changed.items() if len(r) >= min_chars]
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])


def _counted(min_chars: int, one_in: int | None):
    def run(batches):
        held = _Runs(one_in)
        for batch in batches:
            for rows in slices(batch):
                names, sizes, runs = [], [], []
                for name, text in zip(rows.column(0).to_pylist(), texts_of(rows)):
                    for piece in _pieces(text.decode().encode("latin-1", "replace").translate(_LETTERS)):
                        found = piece.split()
                        names.append(name.encode() + b":")
                        sizes.append(len(found))
                        runs += found
                        if len(runs) > RUNS:
                            held.add(names, sizes, runs)
                            names, sizes, runs = [], [], []
                            if held.full():
                                yield held.give(min_chars)
                held.add(names, sizes, runs)
                if held.full():
                    yield held.give(min_chars)
        yield held.give(min_chars)
    return run


def words(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, one_in: int | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``n``: the distinct runs ``[A-Za-z\u00C0-\u00FF]+`` of all texts, only
    A-Z lower-cased, of at least ``min_chars`` code points and ``min_count``
    occurrences.

    With ``one_in``, the runs get typing errors by rule: where it divides h, the
    CRC-32 of ``<id>:<run>`` in UTF-8 (a null id is ``null``), a run loses its
    code point h modulo its length before it is counted.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).cast("string").cast("binary").alias("utf8"))
    return source.mapInArrow(_counted(min_chars, one_in), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= min_count)


# ---------------------------------------------------------------- grams

def _gram_counts(batches):
    held: Counter[str] = Counter()

    def give():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])

    for batch in batches:
        for word in batch.column(0).to_pylist():
            text = word + END
            for q in range(SHORTEST, LONGEST + 1):
                held.update([text[p:p + q] for p in range(len(text) - q + 1)])
            if len(held) > RUNS:
                yield give()
                held.clear()
    yield give()


def frequent_grams(table: DataFrame) -> dict[str, int]:
    """The dictionary of a table of words: frequent grams and the places they
    stand in, at most GRAMS of each length."""
    places = table.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    t = max(LEAST_T, places // GRAMS)
    grams = table.select("word").mapInArrow(_gram_counts, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in grams.where(F.col("n") > t).toLocalIterator()}


def decompose(word: str, frequent: dict[str, int]) -> list[str]:
    """The gram at each place of a word."""
    text, out = word + END, []
    for p in range(len(word)):
        q = SHORTEST
        while q < LONGEST and p + q < len(text) and text[p:p + q] in frequent:
            q += 1
        out.append(text[p:p + q])
    return out


def affected(grams: list[str]) -> int:
    """The most grams of a word that one edit can touch."""
    edge = [0] * (len(grams) + LONGEST + 1)
    for p, g in enumerate(grams):
        edge[p] += 1
        edge[p + len(g)] -= 1
    return max(islice(accumulate(edge), len(grams)), default=0)


def signature(word: str, frequent: dict[str, int]) -> list[tuple[str, int]]:
    """The grams, with their places, whose lists a word is looked up in."""
    grams = decompose(word, frequent)
    order = sorted((frequent.get(g, 0), g, p) for p, g in enumerate(grams))
    return [(g, p) for _, g, p in order[:affected(grams) + 1]]


def _signatures(frequent):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 10_000):
                rows = batch.slice(start, 10_000)
                found = [[{"gram": g, "place": p} for g, p in signature(w, frequent.value)] for w in rows.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(found, pa.list_(pa.struct([("gram", pa.string()), ("place", pa.int32())])))],
                    names=["word", "n", "grams"])
    return run


def _key(side: str, length: Column) -> Column:
    offset = F.col("g.place") if side == "start" else F.length("word") - F.col("g.place")
    return F.xxhash64(F.lit(side), "g.gram", offset, length)


def near_pairs(table: DataFrame) -> DataFrame:
    """``table`` (``word`` without repeats, ``n``) -> ``a``, ``a_n``, ``b``, ``b_n``:
    every pair of words one inserted, deleted or replaced code point apart, once.
    Words have more than LONGEST code points."""
    spark = table.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_grams(table))
    signed = persist_table(table.select("word", "n").mapInArrow(
        _signatures(frequent), "word string, n bigint, grams array<struct<gram: string, place: int>>"), spark, "spelling-grams")
    places = signed.select("word", "n", F.explode("grams").alias("g"))
    length = F.length("word")
    lists = places.select(F.col("word").alias("b"), F.col("n").alias("b_n"),
                          F.explode(F.array(_key("start", length), _key("end", length))).alias("key"))
    # words of the same length meet once, at the start; longer ones at either side
    sought = places.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(F.array(
        _key("start", length), _key("start", length + 1), _key("end", length + 1))).alias("key"))
    ordered = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    met = sought.join(lists, "key").where(ordered & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


# ---------------------------------------------------------------- groups

def _roots(forms: DataFrame) -> DataFrame:
    """``word``, ``form`` -> ``word``, ``root``: the last of its forms. Each round
    doubles the steps; a form outnumbers its word, so there are few."""
    spark = forms.sparkSession
    forms = persist_table(forms, spark, "spelling-forms")
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if roots.join(step, "root", "left_semi").isEmpty():
            return roots
        moved = persist_table(roots.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")), spark, "spelling-roots")
        if hasattr(roots, "_scratch_path"):
            drop_table(roots)
        roots = moved


def spelling_variants(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, outnumbers: int = OUTNUMBERS,
                      one_in: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word of ``words``: ``word``, ``form`` (its near word with the
    largest n, ties: the smallest by code point, if that is ``outnumbers`` times
    the word's n or more; else null), ``root`` (following the forms to the last; the
    word itself if it has none), ``n``, ``n_near`` (words one edit apart), ``form_n``.

    A null or empty text has no word; repeated rows count as often as they stand;
    a run of any length is one word. An empty table, or one without such words,
    gives an empty result. Other columns are not read.
    """
    if min_chars <= LONGEST:
        raise ValueError(f"words of {LONGEST} code points or fewer may share no gram with a near word")
    if outnumbers < 2:
        raise ValueError("a form outnumbers its word")
    spark = docs.sparkSession
    table = persist_table(words(docs, min_chars=min_chars, min_count=min_count, one_in=one_in, id_col=id_col, text_col=text_col), spark, "spelling-words")
    sides = near_pairs(table).select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    has = -F.col("best.minus") >= F.col("n") * outnumbers
    found = persist_table(table.join(best, "word", "left").select(
        "word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(has, -F.col("best.minus")).alias("form_n")), spark, "spelling-near")
    roots = _roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
