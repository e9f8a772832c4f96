"""Mixing sources to target weights along a curriculum, in DataFrame functions only.

Each source gets a share of all words by its weight, at most ``most`` times its
own words. A curriculum gives every weight a schedule, its rate of demand over
the training time 0 to 1 (piecewise linear). The integral of the schedule, up to
a time, is the share of a source's target that training has asked for until
then; a document's copy starts where the demand reaches the words that stand
before it in its source, so its training position is the inverse of that
integral. Documents come out sorted by position in ranges.

Within a source the documents stand in the order of the MD5 of their id. The
source is passed up to ``most`` times in that order until its target is
reached; the copy in which that happens is cut there, so that a source gives
its target to the word, however long its documents are.

Words before a document are counted by range slices (``operators/prefix.py``),
so that a source with a third of all documents is many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import text_of
from shelfrank.operators.prefix import running_totals
from shelfrank.session import persist_table

#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: A source's words are taken so many times at most.
MOST = 3
#: Rate of demand by weight: (time, rate) knots from time 0 to 1, rates above 0.
#: Light sources are asked for early, heavy ones late.
SCHEDULES: dict[int, Sequence[tuple[float, float]]] = {
    1: ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    2: ((0.0, 1.0), (1.0, 1.0)),
    3: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
}

_SPACE = "\\x20\\x09-\\x0D"


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``, without a list of them: each
    word and the white space behind it become one letter."""
    bare = F.regexp_replace(text, f"^[{_SPACE}]++", "")
    return F.length(F.regexp_replace(bare, f"[^{_SPACE}]++[{_SPACE}]*+", "x")).cast("bigint")


def integral(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """Segments (share before, share behind, time, length, slope) with the rates
    scaled to an integral of 1; the rate at a segment's start follows from both."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    if knots[0][0] != 0 or knots[-1][0] != 1 or min(b[0] - a[0] for a, b in zip(knots, knots[1:])) <= 0 or min(r for _, r in knots) <= 0:
        raise ValueError("a schedule has rising times from 0 to 1 and rates above 0")
    whole, out, before = sum(areas), [], 0.0
    for (t, r), (u, s), area in zip(knots, knots[1:], areas):
        out.append((before, before + area / whole, t, u - t, r / whole, s / whole))
        before += area / whole
    return out


def position(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a schedule has asked for ``share`` of its target.

    In a segment of length d with rates r to s the demand after x of it is
    d * (r * x + (s - r) * x * x / 2); its inverse is written without the
    difference of two large terms."""
    out = None
    for before, behind, time, length, r, s in reversed(integral(knots)):
        asked = (share - before) / length
        x = asked * 2.0 / (F.lit(r) + F.sqrt(F.greatest(asked * (2.0 * (s - r)) + r * r, F.lit(0.0))))
        here = F.lit(time) + F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * length
        out = here if out is None else F.when(share < behind, here).otherwise(out)
    return out


def targets(sizes: DataFrame, *, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source`` (distinct, null allowed) and ``source_size`` -> both, ``weight``
    and ``target``, written to the shared folder.

    Sources by code point, null last, weigh ``weights``, repeating. A target is
    the source's share of all words by weight, but ``most`` times its own words
    at most; what is above that is shared out again by weight among the others.
    Every round is one aggregate of the sources' table, until no other source is
    above its limit; sums are exact decimals.
    """
    spark = sizes.sparkSession
    one = sizes.select("source", "source_size", F.lit(0).alias("all"), F.lit(1).alias("one"), F.isnull("source").alias("last"))
    ranked = running_totals(one, ["all"], [F.col("last").asc(), F.col("source").asc()], "one", cum_col="no", rank_col="r", total_col="n")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("no") - 1) % len(weights) + 1).cast("int"))
    weighed = persist_table(ranked.select("source", "source_size", weight.alias("weight")), spark, "mix-sources")
    limit = F.col("source_size").cast("decimal(38,0)") * most
    whole = weighed.agg(F.sum(F.col("source_size").cast("decimal(38,0)"))).first()[0] or 0

    def free(level: tuple[int, int]) -> Column:
        """Whether a source is not held at its limit at a level of words per weight."""
        return limit * F.lit(level[1]).cast("decimal(38,0)") > F.col("weight") * F.lit(level[0]).cast("decimal(38,0)")

    def left(rest: DataFrame) -> tuple[int, int]:
        """Words that the sources of ``rest`` share, and their weights' sum."""
        row = rest.agg(F.sum(limit), F.sum("weight")).first()
        return int(whole - (held - (row[0] or 0))), int(row[1] or 0)

    held = int(weighed.agg(F.sum(limit)).first()[0] or 0)
    level = left(weighed)
    while level[1] and (now := left(weighed.where(free(level)))) != level:
        level = now
    share = F.col("weight").cast("double") * F.lit(float(level[0])) / F.lit(float(level[1] or 1))
    return weighed.withColumn("target", F.when(free(level), share).otherwise(limit.cast("double")))


def mix(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, most: int = MOST,
        schedules: Mapping[int, Sequence[tuple[float, float]]] = SCHEDULES, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """One row per input row: ``id``, ``source``, ``size`` (words), ``source_size``,
    ``target`` (words that its source gives), ``taken`` (words that the mix takes
    of the document, repeats counted, at most ``most`` times its size), and
    ``copies``, an array of (``position``, ``words``) in the order of training;
    sorted in ranges by the first position, rows without a copy last.

    A null text is an empty one; a document without words has size 0 and no
    copy. A null source is a source of its own, the last one. Rows that agree in
    id and size are interchangeable, so the result is the same in every run. A
    null id sorts as an empty one. An empty table gives an empty result. Other
    columns are not read.
    """
    if missing := set(weights) - set(schedules):
        raise ValueError(f"no schedule for the weights {sorted(missing)}")
    spark = docs.sparkSession
    mark = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 16)
    rows = persist_table(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                                     n_words(text_of(text_col)).alias("size"), mark.alias("mark")), spark, "mix-documents")
    found = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, most=most)
    # a key that is never null
    named = lambda: F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key")
    order = [F.col("mark").asc(), F.col("id").asc(), F.col("size").asc()]
    placed = running_totals(rows.select("*", named()), ["key"], order, "size", cum_col="upto", rank_col="r", total_col="t")
    joined = placed.select("key", "id", "size", (F.col("upto") - F.col("size")).alias("before")).join(
        found.select(named(), "source", "source_size", "weight", "target"), "key")
    goal = F.floor(F.col("target") + 0.5)
    copies = []
    for e in range(most):
        start = F.col("before") + F.col("source_size") * e
        share = F.try_divide(start.cast("double"), F.col("target"))
        at = F.coalesce(*[F.when(F.col("weight") == w, position(share, schedules[w])) for w in sorted(set(weights))])
        copies.append(F.struct(at.alias("position"), F.greatest(F.least(goal - start, "size"), F.lit(0)).cast("bigint").alias("words")))
    out = joined.select("id", "source", "size", "source_size", "target", F.filter(F.array(*copies), lambda c: c["words"] > 0).alias("copies"))
    taken = F.aggregate("copies", F.lit(0).cast("bigint"), lambda n, c: n + c["words"])
    return out.select("id", "source", "size", "source_size", "target", taken.alias("taken"), "copies").orderBy(
        F.try_element_at("copies", F.lit(1))["position"].asc_nulls_last(), "id")


def training_order(mixed: DataFrame) -> DataFrame:
    """Rows of ``mix`` -> one row per copy: ``position``, ``id``, ``source``,
    ``copy`` (from 0), ``words`` (the first so many are taken), sorted in ranges
    by position."""
    copies = mixed.select("id", "source", F.posexplode("copies").alias("copy", "c"))
    return copies.select("c.position", "id", "source", "copy", "c.words").orderBy("position", "id", "copy")
