"""Annotation result cache (J2, J3, U2, U3, A18, F12; S6/K6 in JSON form).

The cache is a flat table ``(store_id, product, abc_class, analysis)``; a
class change or an empty text is a miss. Hits, misses and the upsert are
joins on the three keys, so they shuffle on the keys like any equi-join.
Written caches are folders by the hash of the store, of which an update
rewrites those it touches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfrank.config import DEFAULT, Params
from shelfrank.operators import annotate as A
from shelfrank.operators.ranking import flat
from shelfrank.session import persist_table

KEYS = ["store_id", "product", "abc_class"]
CACHE_SCHEMA = "store_id string, product string, abc_class string, analysis string"


def unique(cache: DataFrame) -> DataFrame:
    """One entry for each key. Of several texts the greatest counts (so a text
    wins over an empty or missing one), whatever order they were read in."""
    return cache.groupBy(*KEYS).agg(F.max("analysis").alias("analysis"))


def _usable(cache: DataFrame) -> DataFrame:
    return unique(cache.filter(F.col("analysis").isNotNull() & (F.col("analysis") != "")))


def hits(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items whose (store, product, class) has a non-empty cached text."""
    return items.join(_usable(cache).select(*KEYS, "analysis"), KEYS, "inner")


def misses(items: DataFrame, cache: DataFrame) -> DataFrame:
    """The other items (anti-join)."""
    return items.join(_usable(cache).select(*KEYS), KEYS, "left_anti")


def looked_up(items: DataFrame, cache: DataFrame) -> DataFrame:
    """J2 and J3 in one left join: items with ``analysis``, null for a miss."""
    return items.join(_usable(cache).select(*KEYS, "analysis"), KEYS, "left")


def annotate_abc(items: DataFrame, cache: DataFrame, annotator, params: Params = DEFAULT, journal: str | None = None):
    """Cached items keep their text; the rest are batched, sent to the
    annotator and attached (default ``Análise indisponível``, also where a call
    failed). ``journal``: see :func:`shelfrank.operators.annotate.call_annotator`.

    Returns ``(items_out, new_entries)``: items with ``analysis`` and
    ``from_cache`` (U3), and the fresh cache entries (the "unavailable" text
    is not cached).
    """
    # written once: the hits and the batches both read it
    found = persist_table(looked_up(items, cache), items.sparkSession, "cache-lookup")
    hit = found.where("analysis IS NOT NULL").withColumn("from_cache", F.lit(True))
    miss = found.where("analysis IS NULL")
    if annotator is None:
        # without a model ABC items carry no comment
        fresh = miss
    else:
        rows = A.batch_rows(A.abc_batches(miss.drop("analysis"), params)).withColumn("prompt", A.abc_prompt("history" in items.columns))
        done = A.attach(A.answered(rows, annotator, ["store_id", "batch"], journal), A.UNAVAILABLE, analysis=("analise", A.UNAVAILABLE))
        fresh = flat(done, ["store_id"]).drop("i")
    out = hit.unionByName(fresh.withColumn("from_cache", F.lit(False)))
    new = fresh.filter(F.col("analysis").isNotNull() & (F.col("analysis") != A.UNAVAILABLE)).select(*KEYS, "analysis")
    return out, new


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """New entries overwrite entries with the same key; others are kept.
    Repeated keys become one entry (``unique``)."""
    new = unique(new)
    return unique(cache).join(new.select(*KEYS), KEYS, "left_anti").unionByName(new)


def stats(cache: DataFrame) -> DataFrame:
    """Entries and stores in a cache."""
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("store_id").alias("stores"))


def hit_miss_by_store(items_out: DataFrame) -> DataFrame:
    """Per-store hits and misses of one run."""
    return items_out.groupBy("store_id").agg(F.count_if(F.col("from_cache")).alias("hits"),
                                             F.count_if(~F.col("from_cache")).alias("misses"))


def run_stats(items_out: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """A18 of one run: per store of the run its hits and misses, beside the
    entries before and after and the stores after. The totals are windows over
    the per-store counts (a dimension), not joins on a constant."""
    zero = F.lit(0).cast("bigint")
    runs = hit_miss_by_store(items_out).select("store_id", "hits", "misses", zero.alias("b"), zero.alias("a"))
    olds = before.groupBy("store_id").agg(F.count(F.lit(1)).alias("b")).select(
        "store_id", zero.alias("hits"), zero.alias("misses"), "b", zero.alias("a"))
    news = after.groupBy("store_id").agg(F.count(F.lit(1)).alias("a")).select(
        "store_id", zero.alias("hits"), zero.alias("misses"), zero.alias("b"), "a")
    per_store = runs.unionByName(olds).unionByName(news).groupBy("store_id").agg(
        *[F.sum(c).alias(c) for c in ("hits", "misses", "b", "a")])
    every = Window.partitionBy()
    return per_store.select(
        "store_id", "hits", "misses", F.sum("b").over(every).alias("entries_before"),
        F.sum("a").over(every).alias("entries_after"),
        F.count(F.when(F.col("a") > 0, 1)).over(every).alias("stores_after"),
    ).where("hits + misses > 0")


# ----------------------------------------------------------------------------- JSON form

#: Parts of a cache folder, by the hash of the store.
BUCKETS = 64


def _json_line() -> Column:
    key = F.concat_ws("|", "product", "abc_class")
    return F.to_json(F.create_map(F.col("store_id"), F.create_map(key, F.col("analysis")))).alias("value")


def to_json_lines(cache: DataFrame) -> DataFrame:
    """F12 + K6: ``{"store": {"product|class": text}}`` objects, one line per
    entry, so no line or task holds a store; readers merge the objects."""
    return cache.select(_json_line())


def _bucket() -> Column:
    return F.pmod(F.xxhash64("store_id"), F.lit(BUCKETS)).cast("int")


class _Folder:
    """A cache folder: data folders with one folder per bucket in them, and
    manifests ``manifest-<number>.json`` that say which data folder holds each
    bucket. The manifest with the largest number is the cache. It is written under
    another name and renamed when all of its data is complete, so at any moment
    the folder holds a whole cache, the old one or the new one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._p().getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _named(self, pattern: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.globStatus(self._p(pattern)) or [])

    def current(self) -> tuple[int, dict[int, str]] | None:
        """Number and buckets of the newest manifest."""
        names = self._named("manifest-*.json")
        if not names:
            return None
        text = self.spark.read.text(f"{self.path}/{names[-1]}", wholetext=True).first()[0]
        return int(names[-1][9:-5]), {int(b): d for b, d in json.loads(text).items()}

    def data(self, buckets: dict[int, str]) -> list[str]:
        return [f"{self.path}/{d}/bucket={b}" for b, d in sorted(buckets.items())]

    def write_data(self, cache: DataFrame) -> dict[int, str]:
        """Writes the entries to a new data folder; its buckets."""
        name = f"data-{uuid.uuid4().hex[:12]}"
        lines = cache.select(_bucket().alias("bucket"), _json_line())
        lines.hint("rebalance", "bucket").write.partitionBy("bucket").text(f"{self.path}/{name}")
        return {int(x.getPath().getName()[7:]): name for x in self.fs.globStatus(self._p(name, "bucket=*")) or []}

    def publish(self, number: int, buckets: dict[int, str]) -> None:
        """Makes ``buckets`` the cache."""
        draft, final = self._p(f"draft-{uuid.uuid4().hex[:12]}"), self._p(f"manifest-{number:012d}.json")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(buckets).encode()))
        out.close()
        if not self.fs.rename(draft, final):
            raise OSError(f"{final} is there already: another run has written to {self.path}")

    def tidy(self) -> None:
        """Deletes what the newest manifest does not need."""
        number, buckets = self.current()
        keep = {f"manifest-{number:012d}.json", *buckets.values()}
        for name in self._named("*"):
            if name not in keep:
                self.fs.delete(self._p(name), True)


def write_json(cache: DataFrame, path: str) -> None:
    """K6: write the cache to the folder ``path``, also when the cache reads from
    there. Whatever step a run fails at, :func:`read_json` finds the old cache or
    the new one. Frames that read the old files must not be used afterwards.
    """
    folder = _Folder(cache.sparkSession, path)
    before = folder.current()
    buckets = folder.write_data(cache)
    folder.publish(before[0] + 1 if before else 1, buckets)
    folder.tidy()


def update_json(new: DataFrame, path: str) -> None:
    """U2 + K6: the new entries go into the cache in the folder ``path``, over those
    with the same key. Only the buckets of their stores are read and written."""
    spark = new.sparkSession
    folder = _Folder(spark, path)
    before = folder.current()
    if before is None:
        return write_json(upsert(read_json(spark, path), new), path)
    number, buckets = before
    touched = {r.b for r in new.select(_bucket().alias("b")).distinct().collect()}
    if not touched:
        return None
    old = _entries(spark, folder.data({b: d for b, d in buckets.items() if b in touched}), False)
    folder.publish(number + 1, buckets | folder.write_data(upsert(old, new)))
    return folder.tidy()


def read_json(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Read a cache folder, or plain cache objects (JSON lines, or one object
    per file with ``whole_file``) with one entry per key; an absent path or corrupt
    text gives no rows. Any other failure to read is raised."""
    try:
        found = _Folder(spark, path).current()
        return _entries(spark, _Folder(spark, path).data(found[1]) if found else [path], whole_file and not found)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def _entries(spark: SparkSession, paths: list[str], whole_file: bool) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], CACHE_SCHEMA)
    schema = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))
    m = spark.read.text(paths, wholetext=whole_file).select(F.from_json("value", schema).alias("m"))
    s = m.select(F.explode("m").alias("store_id", "entries"))
    e = s.select("store_id", F.explode("entries").alias("k", "analysis"))
    return unique(e.select(
        "store_id",
        F.regexp_extract("k", r"(?s)^(.*)\|([^|]*)$", 1).alias("product"),
        F.regexp_extract("k", r"(?s)^(.*)\|([^|]*)$", 2).alias("abc_class"),
        "analysis"))
