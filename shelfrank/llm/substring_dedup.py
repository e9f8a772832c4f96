"""Substring dedup over super-k-mers.

A window is ``window`` consecutive words. Every word that lies in a window
which also starts in a document with a smaller id is removed; windows are
judged on the input, so a passage stays whole in its first document.

1. Documents are dealt into blocks of about ``BLOCK_BYTES`` of text by a hash.
   In a block, consecutive windows that share their minimiser (the smallest
   hash of ``m`` words) are one super-k-mer, a packed string of words. Equal
   super-k-mers of a block are merged before anything is shuffled, so a passage
   in a third of all documents leaves each block once.
2. The strings go to the bucket of their minimiser, zstd-packed per block and
   bucket. Equal windows have equal minimisers, so they meet there. A bucket
   ranks its windows by sorting (word numbers, then pairs of ranks: 2, 4, 8,
   ``window`` words), which is exact, and finds the smallest id of each.
3. Only super-k-mers with a window that some document of the block must lose
   go back to their block, which cuts its documents. Blocks are read from the
   same exchange as in step 1.

Memory follows a block, a bucket and the longest document. A bucket grows with the
distinct super-k-mers of each block: a passage longer than a window costs one
string per block, however many documents hold it, but a phrase of ``m`` words or
more that stands in ever other surroundings costs one for each of them, all on
its minimiser, which is not split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import schema_of, small_batches, text_of

WINDOW = 13
#: Words in a minimiser. Fewer give longer super-k-mers, more keep phrases that
#: are merely common from filling a bucket.
MINIMISER = 4
#: Text bytes in a block, and in the share of a bucket.
BLOCK_BYTES = 8 << 20
#: Text bytes that are hashed at once.
GROUP_BYTES = 512 << 10

_LAST = np.iinfo(np.int64).max  # stands for a null id: after every other id
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACED = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


_PRIME, _UNPRIME = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0x5851F42D4C957F2D)


@cache
def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64)


def _line(utf8: bytes) -> bytes:
    """The words joined by one space."""
    line = utf8.translate(_SPACED)
    return b" ".join(line.split()) if b"  " in line or line[:1] == b" " or line[-1:] == b" " else line


class _Words:
    """The words of some documents' lines, and their super-k-mers.

    ``text``: all lines, with a line break between; ``begin``, ``end``: bytes of
    each word; ``doc``: the number of its line; ``first``, ``count``, ``mini``:
    first word, number of words and minimiser of each super-k-mer; ``digest``:
    a 64-bit hash of its text (equal texts have equal ones).
    """

    def __init__(self, lines: list[bytes], window: int, m: int):
        self.text = b"\n".join(lines)
        data = np.frombuffer(self.text, np.uint8)
        gap = np.concatenate(([True], (data == 32) | (data == 10), [True]))
        self.begin = np.flatnonzero(gap[:-1] & ~gap[1:])
        self.end = np.flatnonzero(~gap[:-1] & gap[1:])
        starts = np.cumsum([0, *(len(x) + 1 for x in lines)])
        self.doc = np.searchsorted(starts, self.begin, "right") - 1
        size = 1 << max(16, int(len(data)).bit_length())
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_PRIME, size)[:len(data)], dtype=np.uint64)))
        self._hash = lambda a, b: (total[b] - total[a]) * _powers(_UNPRIME, size)[a]
        h = self._hash(self.begin, self.end)
        windows, grams = len(h) - window + 1, len(h) - m + 1
        if windows <= 0:
            self.first = self.count = np.empty(0, np.int64)
            self.mini = self.digest = np.empty(0, np.uint64)
            return
        g = np.zeros(grams, np.uint64)
        for j in range(m):
            g = g * np.uint64(0x100000001B3) + h[j:j + grams]
        g ^= g >> np.uint64(31)
        g *= np.uint64(_PRIME)
        g ^= g >> np.uint64(32)
        low = g[:windows].copy()
        for j in range(1, window - m + 1):
            np.minimum(low, g[j:j + windows], out=low)
        whole = self.doc[:windows] == self.doc[window - 1:]
        new = np.concatenate(([True], (low[1:] != low[:-1]) | (self.doc[1:windows] != self.doc[:windows - 1]) | (whole[1:] != whole[:-1])))
        first = np.flatnonzero(new)
        stop = np.append(first[1:], windows)
        kept = whole[first]
        self.first, self.count = first[kept], (stop - first)[kept] + window - 1
        self.mini = low[self.first]
        self.digest = self._hash(self.begin[self.first], self.end[self.first + self.count - 1])

    def texts(self, which: np.ndarray | slice = slice(None)) -> list[bytes]:
        first, count = self.first[which], self.count[which]
        return [self.text[a:b] for a, b in zip(self.begin[first].tolist(), self.end[first + count - 1].tolist())]


def _groups(utf8s) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about GROUP_BYTES, with the number of the first."""
    at, some, size = 0, [], 0
    for x in utf8s:
        some.append(x.as_py())
        size += len(some[-1])
        if size >= GROUP_BYTES:
            yield at, some
            at, some, size = at + len(some), [], 0
    if some:
        yield at, some


def _ids(column) -> list[int]:
    return [_LAST if x is None else x for x in column.to_pylist()]


# `minimiser`: the upper 32 bits of each; two that differ below them are only looked at together.
# `ids`: differences of the smallest ids, then what the largest are above them.
_CHUNKS = "bucket int, block int, minimiser binary, ids binary, packed binary"
_REPLIES = "block int, minimiser binary, digest binary, windows binary, smallest binary"


def _split(window: int, m: int, buckets: int):
    """Block of documents -> one row per bucket with its super-k-mers."""
    def run(table: pa.Table) -> pa.Table:
        ids = np.array(_ids(table["id"]), np.int64)
        texts: list[bytes] = []
        parts = []
        for at, some in _groups(table["utf8"]):
            w = _Words([_line(t) for t in some], window, m)
            texts += w.texts()
            parts.append((w.mini, w.digest, ids[at + w.doc[w.first]]))
        rows = []
        if texts:
            block = table["block"][0].as_py()
            mini, digest, lo = (np.concatenate(x) for x in zip(*parts))
            hi = lo.copy()
            # merge equal texts of the block; only those with equal hashes are compared
            order = np.argsort(digest, kind="stable")
            same = digest[order][1:] == digest[order][:-1]
            again = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
            seen: dict[bytes, int] = {}
            gone = np.zeros(len(texts), bool)
            for i in again.tolist():
                k = seen.setdefault(texts[i], i)
                if k != i:
                    gone[i] = True
                    lo[k] = min(lo[k], lo[i])
                    hi[k] = max(hi[k], hi[i])
            stay = np.flatnonzero(~gone)
            mini, lo, hi, texts = mini[stay], lo[stay], hi[stay], [texts[i] for i in stay.tolist()]
            bucket = (mini % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            pack = zstandard.ZstdCompressor(level=5)
            for mine in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                ids = np.concatenate((np.diff(lo[mine], prepend=0), hi[mine] - lo[mine]))
                rows.append((int(bucket[mine[0]]), block, (mini[mine] >> np.uint64(32)).astype(np.uint32).tobytes(),
                             pack.compress(ids.tobytes()), pack.compress(b"\n".join([texts[i] for i in mine.tolist()]))))
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 3
        names = ["bucket", "block", "minimiser", "ids", "packed"]
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds))})
    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs, by sorting."""
    return np.unique(a * (b.max() + 1) + b, return_inverse=True)[1] if len(a) else a


def _ranked(ids: np.ndarray, window: int) -> np.ndarray:
    """At each place, a number that equal runs of ``window`` words share. Places
    beyond ``len(ids) - window`` are left out."""
    rank, width = ids, 1
    while 2 * width <= window:
        rank, width = _pairs(rank[:-width], rank[width:]), 2 * width
    if width < window:
        step = window - width
        rank = _pairs(rank[:-step], rank[step:])
    return rank


def _count(window: int):
    """Bucket -> replies to the blocks that must remove something."""
    def run(table: pa.Table) -> pa.Table:
        blocks = table["block"].to_pylist()
        unpack, base = zstandard.ZstdDecompressor(), 0
        minis = [np.frombuffer(x, np.uint32) for x in table["minimiser"].to_pylist()]
        ids = [np.frombuffer(unpack.decompress(x), np.int64).reshape(2, -1) for x in table["ids"].to_pylist()]
        row = np.repeat(np.arange(len(blocks)), [len(x) for x in minis])
        mini, low = np.concatenate(minis), np.concatenate([np.cumsum(x[0]) for x in ids])
        high = low + np.concatenate([x[1] for x in ids])
        values, back, times = np.unique(mini, return_inverse=True, return_counts=True)
        wide = np.zeros(len(values), bool)
        wide[back[low < high]] = True
        active = np.flatnonzero((times > 1)[back] | wide[back])
        texts: list[bytes] = []
        for r, x in enumerate(table["packed"]):
            mine = active[(active >= base) & (active < base + len(minis[r]))] - base
            base += len(minis[r])
            if len(mine):
                own = unpack.decompress(x.as_py()).split(b"\n")
                texts += [own[i] for i in mine.tolist()]
        out: dict[int, list] = {}
        if texts:
            words = [t.split(b" ") for t in texts]
            numbers: dict[bytes, int] = {}
            ids = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in words for w in ws), np.int64)
            n_words = np.array([len(ws) for ws in words], np.int64)
            n_windows = n_words - window + 1
            begin = np.cumsum(n_words) - n_words
            first = np.cumsum(n_windows) - n_windows
            owner = np.repeat(np.arange(len(texts)), n_windows)
            place = begin[owner] + np.arange(len(owner)) - first[owner]
            rank = _ranked(ids, window)[place]
            order = np.argsort(rank, kind="stable")
            groups = np.concatenate(([0], np.flatnonzero(np.diff(rank[order])) + 1))
            least = np.minimum.reduceat(low[active][owner][order], groups)
            smallest = np.empty(len(owner), np.int64)
            smallest[order] = np.repeat(least, np.diff(np.append(groups, len(order))))
            cut = np.logical_or.reduceat(smallest < high[active][owner], first)
            for t in np.flatnonzero(cut).tolist():
                k = active[t]
                a = out.setdefault(blocks[row[k]], [[], [], [], []])
                a[0].append(mini[k])
                a[1].append(xxhash.xxh3_128_digest(texts[t]))
                a[2].append(n_windows[t])
                a[3].append(smallest[first[t]:first[t] + n_windows[t]])
        return pa.table({
            "block": pa.array(list(out), pa.int32()),
            "minimiser": pa.array([np.array(a[0], np.uint32).tobytes() for a in out.values()], pa.binary()),
            "digest": pa.array([b"".join(a[1]) for a in out.values()], pa.binary()),
            "windows": pa.array([np.array(a[2], np.int64).tobytes() for a in out.values()], pa.binary()),
            "smallest": pa.array([np.concatenate(a[3]).tobytes() for a in out.values()], pa.binary())})
    return run


def _kept_layout(utf8: bytes, keep: np.ndarray) -> bytes:
    """The kept words with the white space between neighbours; a line break
    stands for each removed run."""
    spans = [m.span() for m in _WORD.finditer(utf8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], keep.astype(np.int8), [0]))))
    return b"\n".join(utf8[spans[a][0]:spans[b - 1][1]] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()))


def _cut(window: int, m: int, layout: bool, carry: bool):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        known: dict[bytes, np.ndarray] = {}
        minis = [np.empty(0, np.uint32)]
        for r in replies.to_pylist():
            minis.append(np.frombuffer(r["minimiser"], np.uint32))
            n = np.frombuffer(r["windows"], np.int64)
            for i, part in enumerate(np.split(np.frombuffer(r["smallest"], np.int64), np.cumsum(n)[:-1])):
                known[r["digest"][16 * i:16 * i + 16]] = part
        asked = np.unique(np.concatenate(minis))
        ids = np.array(_ids(docs["id"]), np.int64)
        n_words, n_removed, texts = [], [], []
        for at, some in _groups(docs["utf8"]):
            lines = [_line(t) for t in some]
            w = _Words(lines, window, m)
            gone = np.zeros(len(w.doc) + window + 1, np.int64)
            if len(asked):
                upper = (w.mini >> np.uint64(32)).astype(np.uint32)
                mine = np.flatnonzero(asked[np.minimum(np.searchsorted(asked, upper), len(asked) - 1)] == upper)
                for p, text in zip(w.first[mine].tolist(), w.texts(mine)):
                    smallest = known.get(xxhash.xxh3_128_digest(text))
                    if smallest is not None:
                        place = p + np.flatnonzero(smallest < ids[at + w.doc[p]])
                        gone[place] += 1
                        gone[place + window] -= 1
            keep = np.cumsum(gone)[:len(w.doc)] == 0
            edge = np.searchsorted(w.doc, np.arange(len(some) + 1))
            lost = np.concatenate(([0], np.cumsum(~keep)))[edge]
            n_words += np.diff(edge).tolist()
            n_removed += np.diff(lost).tolist()
            for i, removed in enumerate(np.diff(lost).tolist()):
                if not removed:
                    texts.append(some[i] if layout else lines[i])
                elif layout:
                    texts.append(_kept_layout(some[i], keep[edge[i]:edge[i + 1]]))
                else:
                    texts.append(b" ".join([x for x, k in zip(lines[i].split(), keep[edge[i]:edge[i + 1]].tolist()) if k]))
        out = {"id": docs["id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
               "kept": pa.array(texts, pa.binary()).cast(pa.string())}
        return pa.table(out | ({"doc": docs["doc"]} if carry else {}))
    return run


def substring_dedup(docs: DataFrame, *, window: int = WINDOW, m: int = MINIMISER, id_col: str = "doc_id",
                    text_col: str = "text", layout: bool = False, carry: bool = False,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: ``id``, ``n_words``, ``n_removed`` and ``kept``, the words
    ``[^\\x20\\x09-\\x0D]+`` that stay, joined by one space; with ``layout`` the
    text as it was where nothing is removed, else the kept words with their own
    white space and a line break for each cut. ``carry`` adds ``doc``, a struct
    of the other columns.

    Ids are integers. Null or empty texts have no words; a null id counts as
    larger than every id; documents with the same id (repeated rows, two null
    ids) take nothing from each other. Fewer than ``window`` words: nothing is
    removed. One row per input row.
    """
    if not 1 <= m <= window:
        raise ValueError("m must lie between 1 and the window")
    small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    cols = [F.col(id_col).cast("bigint").alias("id"), text_of(text_col).cast("binary").alias("utf8")]
    others = [c for c in docs.columns if c != text_col]
    carry = carry and bool(others)
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in others]).alias("doc"))
    source = docs.select(*cols)
    source = source.withColumn("block", F.pmod(F.xxhash64("id", F.length("utf8")), F.lit(blocks)).cast("int"))
    chunks = source.groupBy("block").applyInArrow(_split(window, m, blocks), _CHUNKS)
    replies = chunks.groupBy("bucket").applyInArrow(_count(window), _REPLIES)
    return source.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        _cut(window, m, layout, carry), schema_of("id bigint, n_words bigint, n_removed bigint, kept string", source, text=False))
