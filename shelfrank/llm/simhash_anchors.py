"""SimHash near-dedup with anchor points.

Fingerprints are compared only where they share an anchor. The anchors are the
words of a covering code on the low 46 bits: two binary Golay codes of 23 bits,
each perfect with covering radius 3. So every fingerprint has one home anchor,
at most 3 bits away in either half. A fingerprint within ``distance`` bits of
it lies within 3 + x and 3 + y bits of that anchor, with x + y at most
``distance``; each fingerprint is therefore replicated to every anchor within
that radius (about 61 of 2**24 for 2 bits), and no link is missed.

Equal fingerprints are merged first, so a group of copies of any size is one
fingerprint. An anchor with many members (a cluster of near copies) is not
compared pair by pair: its members meet at the fingerprints one bit away, where
two that differ in 1 or 2 bits always share one, and are linked to the smallest
there. An anchor beyond ``CROWD`` members does this as a Spark aggregate.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import slices, texts_of, utf8_input
from shelfrank.llm.components import components
from shelfrank.session import persist_table

SHINGLE = 3
DISTANCE = 2
SEED = 42

#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b110001110101
HALF = 23
RADIUS = 3
#: Members of an anchor that are compared pair by pair; members one task holds.
FEW = 24
CROWD = 20_000


# ------------------------------------------------------------ fingerprints

def fingerprint(utf8: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is 1 when it is 1 in over half the XXH64 hashes of the text's word
    shingles (ASCII-lower-cased words; fewer words than a shingle are one
    shingle; no word gives 0)."""
    words = utf8.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    at = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    h = np.array([xxhash.xxh64_intdigest(line[a:b - 1], SEED) for a, b in zip(at, at[shingle:])], np.uint64)
    votes = np.zeros(64, np.int64)
    for part in np.split(h, range(1 << 16, len(h), 1 << 16)):
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp`` (the 64 bits as a signed long) of every row."""
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(t, shingle) for t in texts_of(part)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    source = utf8_input(docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")), "i", "t", False)
    return source.mapInArrow(run, "id bigint, fp bigint")


# ----------------------------------------------------------------- anchors

@cache
def _patterns(extra: int) -> tuple[np.ndarray, np.ndarray]:
    """Error patterns of up to RADIUS + extra bits by syndrome and weight:
    ``flips`` in one array, and ``upto[s, w]``, where those of syndrome ``s``
    with weight at most RADIUS + w - 1 end (``upto[s, 0]``: where ``s`` begins)."""
    bit = []
    for i in range(HALF):
        r = 1 << i
        for top in range(i, 10, -1):
            if r >> top & 1:
                r ^= GOLAY << (top - 11)
        bit.append(r)
    rows = []
    for weight in range(RADIUS + extra + 1):
        for places in itertools.combinations(range(HALF), weight):
            s = 0
            for p in places:
                s ^= bit[p]
            rows.append((s, max(0, weight - RADIUS), sum(1 << p for p in places)))
    rows.sort()
    s, w, flips = (np.array(x, np.int64) for x in zip(*rows))
    key = s * (extra + 1) + w
    upto = np.searchsorted(key, np.arange(2048 * (extra + 1)), "right").reshape(2048, extra + 1)
    begin = np.searchsorted(s, np.arange(2048))
    return flips, np.concatenate((begin[:, None], upto), axis=1)


@cache
def _syndromes() -> np.ndarray:
    """Syndrome of every 23-bit word, as the sum of those of its bits."""
    out = np.zeros(1, np.int16)
    for i in range(HALF):
        r = 1 << i
        for top in range(i, 10, -1):
            if r >> top & 1:
                r ^= GOLAY << (top - 11)
        out = np.concatenate((out, out ^ np.int16(r)))
    return out


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, with the number of the range of each."""
    n = end - begin
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - (np.cumsum(n) - n)[owner] + begin[owner]


def anchors_of(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every anchor near enough to each fingerprint: its number in ``fp``, the
    anchor (46 bits), and whether it is the home anchor."""
    mask = (1 << HALF) - 1
    low, high = (fp & mask).astype(np.int64), (fp >> HALF & mask).astype(np.int64)
    flips, upto = _patterns(distance)
    syndromes = _syndromes()
    s = syndromes[low]
    owner, at = _spread(upto[s, 0], upto[s, distance + 1])
    first = low[owner] ^ flips[at]
    spent = np.zeros(len(at), np.int64)
    for x in range(1, distance + 1):
        spent += at >= upto[s[owner], x]
    t = syndromes[high[owner]]
    second, at2 = _spread(upto[t, 0], upto[t, distance - spent + 1])
    anchor = first[second] | (high[owner[second]] ^ flips[at2]) << HALF
    return owner[second], anchor, (spent[second] == 0) & (at2 < upto[t[second], 1])


def _replicas(distance: int):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                fp = batch.column(0).slice(start, 2000).to_numpy(zero_copy_only=False)
                owner, anchor, home = anchors_of(fp, distance)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[owner]), pa.array(home)],
                                                 names=["anchor", "fp", "home"])
    return run


# ------------------------------------------------------------------- links

def _near(fp: np.ndarray) -> np.ndarray:
    """Each fingerprint and those one bit away, a row for each fingerprint."""
    flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64))).view(np.int64)
    return fp[:, None] ^ flips[None, :]


def _star(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all fingerprints within 2 bits of one another."""
    meet = _near(fp).ravel()
    owner = np.repeat(fp, 65)
    order = np.lexsort((owner, meet))
    meet, owner = meet[order], owner[order]
    first = np.concatenate(([True], meet[1:] != meet[:-1]))
    head = owner[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
    pairs = np.unique(np.stack((owner[~first], head[~first])), axis=1)
    return pairs[0], pairs[1]


def _links(distance: int):
    """Rows sorted by anchor -> links (a, b), and members of crowded anchors (a, null)."""
    def emit(a, b=None):
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())], names=["a", "b"])

    def groups(anchor, fp, home) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
        size = np.repeat(np.diff(edge), np.diff(edge))
        few = np.flatnonzero((size > 1) & ((size <= FEW) | (distance > 2)))
        k, f, h = anchor[few], fp[few], home[few]
        for step in range(1, int(size[few].max()) if len(few) else 0):
            a, b = f[:-step], f[step:]
            near = (k[:-step] == k[step:]) & (h[:-step] | h[step:]) & (a != b)
            near[near] = np.bitwise_count((a ^ b)[near].view(np.uint64)) <= distance
            if near.any():
                yield emit(a[near], b[near])
        if distance <= 2:
            for start, end in zip(edge[:-1], edge[1:]):
                if end - start > FEW and home[start:end].any():
                    members = np.unique(fp[start:end])
                    a, b = _star(members) if distance == 2 else _one_bit(members)
                    yield emit(a, b)

    def run(batches):
        rest = None
        crowded = None
        for batch in batches:
            anchor, fp, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if crowded is not None:
                own = anchor == crowded
                if own.any():
                    yield emit(fp[own])
                    anchor, fp, home = anchor[~own], fp[~own], home[~own]
                if not len(anchor):
                    continue
                crowded = None
            if rest is not None:
                anchor, fp, home = (np.concatenate(x) for x in zip(rest, (anchor, fp, home)))
            cut = np.searchsorted(anchor, anchor[-1]) if len(anchor) else 0
            yield from groups(anchor[:cut], fp[:cut], home[:cut])
            rest = (anchor[cut:], fp[cut:], home[cut:])
            if distance == 2 and len(rest[0]) > CROWD:
                crowded, fps = rest[0][0], rest[1]
                yield emit(fps)
                rest = None
        if rest is not None and len(rest[0]):
            yield from groups(*rest)
    return run


def _one_bit(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = _near(fp)[:, 1:]
    row, _ = np.nonzero(np.isin(near, fp))
    other = near[np.isin(near, fp)]
    return fp[row], other


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``distinct`` (one column ``fp`` without repeats) -> links ``a``, ``b``
    whose components are those of all pairs at most ``distance`` bits apart."""
    if distance == 0:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    spread = distinct.select("fp").mapInArrow(_replicas(distance), "anchor bigint, fp bigint, home boolean")
    met = spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_links(distance), "a bigint, b bigint")
    met = met.distinct().checkpoint()
    direct = met.where("b IS NOT NULL")
    if distance != 2 or met.where("b IS NULL").isEmpty():
        return direct
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)])
    meet = met.where("b IS NULL").select("a", F.explode(flips).alias("flip")).select("a", F.expr("a ^ flip").alias("z"))
    least = meet.groupBy("z").agg(F.min("a").alias("b"))
    return direct.union(meet.join(least, "z").where("a <> b").select("a", "b")).distinct()


def near_dedup(docs: DataFrame, *, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``id``, ``fp`` (signed long), ``component_id``: the smallest id reachable
    over links of at most ``distance`` differing bits, the row's own included.

    One row per input row. Ids are integers; a null id is never a component_id
    unless all ids of the component are null. Null, empty and wordless texts
    have fingerprint 0 and are linked like any other.
    """
    spark = docs.sparkSession
    fps = persist_table(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), spark, "simhash")
    distinct = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(distinct, distance)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("id", "fp", "component_id")
