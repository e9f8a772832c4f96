"""Document fingerprints (SimHash), in DataFrame functions only.

Terms are a text's words with the word before each (lower-cased, ASCII white
space; the first has an empty one before it). A term's weight is its length in
characters, once per occurrence, since long terms are rare ones. Its hash, two
XXH64 values of 64 bits, votes with that weight for or against each of the 128
bits; a bit of the fingerprint is 1 where the votes for it are over half.

Counting votes: one long holds two counters of 32 bits (bits j and j + 32 of a
hash), so 32 plain sums in one hash aggregate count the votes of a hash.

``within_radius`` finds all pairs at most ``radius`` bits apart with permuted
block tables: the bits are cut into ``blocks`` blocks; two fingerprints that
near agree in ``blocks - radius`` of them at least, so each choice of that many
blocks is a table, keyed by the bits of its blocks, where such a pair meets.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import text_of
from shelfrank.session import checkpoint_dir, persist_table

BITS = 128
_LANES = (1 << 32) + 1
_FIRST = -(1 << 63)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[\\x09-\\x0D\\x20]+", " ")), " ")


def _votes(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``text`` -> ``keys``, ``half`` (0 or 1), ``bits`` (64 bits of the
    fingerprint), two rows per combination of keys. Keys must tell rows apart.

    Each half has rows of its own, so that the code that Spark generates for the
    aggregate has 32 sums, not 64; compiling one twice as long can take the JVM
    more memory than all of its data."""
    words = texts.select(*keys, _words(F.col("text")).alias("w"))
    terms = words.select(*keys, F.explode(F.arrays_zip(
        F.concat(F.array(F.lit("")), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))).alias("a"),
        F.col("w").alias("b"))).alias("t")).select(*keys, F.col("t.a").alias("a"), F.col("t.b").alias("b"))
    hashes = F.array(*[F.struct(F.lit(half).alias("half"), h.alias("h")) for half, h in enumerate((F.xxhash64("a", "b"), F.xxhash64("b", "a", F.lit(1))))])
    hashed = terms.select(*keys, F.explode(hashes).alias("x"), (F.length("a") + F.length("b")).cast("bigint").alias("weight")).select(
        *keys, "x.half", "x.h", "weight")
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_LANES)) * F.col("weight")).alias(f"v{j}") for j in range(32)]
    counted = hashed.groupBy(*keys, "half").agg(F.sum("weight").alias("total"), *sums)
    low = [F.when(F.col(f"v{j}").bitwiseAND(F.lit((1 << 32) - 1)) * 2 > F.col("total"), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(32)]
    high = [F.when(F.shiftrightunsigned(f"v{j}", 32) * 2 > F.col("total"), F.lit(_signed(1 << j + 32))).otherwise(F.lit(0)) for j in range(32)]
    bits = reduce(lambda x, y: x.bitwiseOR(y), low + high).cast("bigint")
    return counted.select(*keys, "half", bits.alias("bits"))


def _half(half: int, also: Column | None = None) -> Column:
    cond = F.col("half") == half
    return F.max(F.when(cond if also is None else cond & also, F.col("bits")))


def hex_of(hi: str, lo: str) -> Column:
    """32 lowercase hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Share of equal bits, 0 to 1."""
    apart = F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))
    return F.lit(1.0) - apart.cast("double") / BITS


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``hi``, ``lo`` per row. Null, empty and wordless texts have no
    votes and fingerprint 0; texts with the same words in order have the same."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return _votes(rows, ["row", "id"]).groupBy("row", "id").agg(_half(0).alias("hi"), _half(1).alias("lo")).select("id", "hi", "lo")


def ring(ids: DataFrame) -> DataFrame:
    """``key`` (distinct longs) -> ``key``, ``next``: the next larger key; after
    the largest the smallest. Keys are dealt out by range; only the first key
    of each range, as many rows as there are partitions, meets in one task."""
    spark = ids.sparkSession
    checkpoint_dir(spark)
    dealt = ids.select("key").repartitionByRange("key").withColumn("part", F.spark_partition_id()).checkpoint()
    heads = dealt.groupBy("part").agg(F.min("key").alias("head"))
    heads = heads.selectExpr("part", "lead(head) OVER (ORDER BY head) AS after", "min(head) OVER () AS least")
    inside = dealt.selectExpr("key", "part", "lead(key) OVER (PARTITION BY part ORDER BY key) AS inside")
    return inside.join(F.broadcast(heads), "part").select("key", F.coalesce("inside", "after", "least").alias("next"))


def fingerprint_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document.

    The edited text is the text with its last floor(n/2) code points replaced by
    the first as many (or all) of the next document's, by ascending id; the last
    document's next is the first. Columns: ``id``, ``n_chars``,
    ``edited_sha256``, ``hi``, ``lo``, ``edited_hi``, ``edited_lo``, ``next_hi``,
    ``next_lo``.

    Ids are integers; a null id comes before all others. Rows with the same id
    have the same next document, the one after that id; where the next id has
    several texts, the one whose XXH64 is smallest counts. One row per input row.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_FIRST)).alias("key"), text_of(text_col).alias("text"))
    facts = persist_table(
        base.groupBy("key").agg(F.max(F.floor(F.length("text") / 2)).cast("int").alias("need"),
                                F.min(F.xxhash64("text")).alias("mark")), spark, "fingerprint-ids")
    # what each key takes from its next document; the texts are dealt out by key
    # once, for this join and the next
    wanted = ring(facts).join(facts.select("key", "need"), "key").join(
        facts.select(F.col("key").alias("next"), "mark"), "next").select("next", "mark", F.col("key").alias("owner"), "need")
    heads = base.join(wanted, (F.col("key") == F.col("next")) & (F.xxhash64("text").bitwiseXOR(F.col("mark")) == 0)).select(
        F.col("owner").alias("key"), "next", F.col("mark").alias("next_mark"), F.expr("substring(text, 1, need)").alias("head"))
    half = "cast(floor(length(text) / 2) AS int)"
    both = base.join(heads.dropDuplicates(["key"]), "key").select(
        "key", "next", "next_mark", "text",
        F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(head, 1, {half}))").alias("edited"))
    keys = ["key", "row", "mark", "next", "next_mark", "n_chars", "sha"]
    # rows are numbered before each becomes two
    numbered = both.select(
        "key", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("mark"), "next", "next_mark",
        F.length("text").cast("bigint").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"), "text", "edited")
    rows = numbered.select(
        *keys, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")),
                          F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x"))
    voted = _votes(rows.select(*keys, "x.kind", "x.text"), [*keys, "kind"])
    names = {0: ("hi", "lo"), 1: ("edited_hi", "edited_lo")}
    found = persist_table(voted.groupBy(*keys).agg(*[
        _half(half, F.col("kind") == kind).alias(name) for kind, pair in names.items() for half, name in enumerate(pair)]), spark, "fingerprints")
    after = found.select(F.col("key").alias("next"), F.col("mark").alias("next_mark"), F.col("hi").alias("next_hi"),
                         F.col("lo").alias("next_lo")).dropDuplicates(["next", "next_mark"])
    return found.join(after, ["next", "next_mark"]).select(
        F.nullif("key", F.lit(_FIRST)).alias("id"), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        "hi", "lo", "edited_hi", "edited_lo", "next_hi", "next_lo")


def within_radius(prints: DataFrame, radius: int, *, blocks: int | None = None) -> DataFrame:
    """All pairs of different fingerprints at most ``radius`` bits apart.

    ``prints`` (``hi``, ``lo``, repeats allowed) -> ``hi``, ``lo``, ``other_hi``,
    ``other_lo``, ``apart``; each pair once, the smaller (hi, lo) first. Repeats
    are merged first, so a group of copies is one fingerprint; a null one is
    left out. With ``blocks`` - ``radius`` blocks in a key, more blocks make
    longer keys and more tables.
    """
    if not 0 <= radius < BITS:
        raise ValueError("the radius must lie between 0 and 127")
    blocks = min(BITS, blocks or radius + 2)
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        m = sum((1 << edge[i + 1]) - (1 << edge[i]) for i in chosen)
        masks.append((_signed(m >> 64), _signed(m & (1 << 64) - 1)))
    distinct = prints.select("hi", "lo").where("hi IS NOT NULL AND lo IS NOT NULL").distinct()
    tables = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(h).cast("bigint").alias("h"), F.lit(m).cast("bigint").alias("l"))
                       for i, (h, m) in enumerate(masks)])
    dealt = distinct.select("hi", "lo", F.explode(tables).alias("t")).select(
        "hi", "lo", F.col("t.no").alias("no"), F.col("hi").bitwiseAND(F.col("t.h")).alias("kh"),
        F.col("lo").bitwiseAND(F.col("t.l")).alias("kl"))
    other = dealt.select(F.col("hi").alias("other_hi"), F.col("lo").alias("other_lo"), "no", "kh", "kl")
    apart = F.bit_count(F.col("hi").bitwiseXOR(F.col("other_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("other_lo")))
    first = (F.col("hi") < F.col("other_hi")) | ((F.col("hi") == F.col("other_hi")) & (F.col("lo") < F.col("other_lo")))
    return dealt.join(other, ["no", "kh", "kl"]).where(first).withColumn("apart", apart).where(F.col("apart") <= radius) \
        .select("hi", "lo", "other_hi", "other_lo", "apart").distinct()
