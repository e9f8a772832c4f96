"""Annotation of ranked items through a user-given function.

The unit is one row per prompt, which carries its items as an array:

  a store-period's lists, or a store's batch of 15    -> prompt text  F8 F13–F15 W10
        -> ``mapInArrow`` runs ``annotator(prompt) -> reply`` per row  X3/X4
        -> JSON repair and parse as column expressions              F9 F10 F11
        -> every item looks up its last entry in the reply          J4
        -> status texts where nothing was asked                     F16

The items never leave their row: nothing is exploded, and replies are not joined
back. ``annotator`` is any picklable ``str -> str`` callable (a model client in
production). Rows are bounded (at most top_n + bottom_n items, or one batch).
With a ``journal`` folder every reply is kept as it arrives
(:mod:`shelfrank.operators.journal`), so that no call is made twice.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfrank.config import DEFAULT, Params
from shelfrank.functions.clean import brl_text
from shelfrank.operators.journal import Journal
from shelfrank.operators.prefix import running_totals
from shelfrank.operators.ranking import flat, recent_periods
from shelfrank.session import persist_table, qualified

# Status texts and defaults of the reference's annotated items.
NO_MODEL = "IA não disponível"
HISTORICAL = "Período histórico"
CALL_ERROR = "Erro na análise"
UNAVAILABLE = "Análise indisponível"
NO_ACTION = "-"

REPLY_FIELDS = T.StructType([
    T.StructField("produto", T.StringType()),
    T.StructField("diagnostico", T.StringType()),
    T.StructField("acao", T.StringType()),
    T.StructField("analise", T.StringType()),
])


# ----------------------------------------------------------------------------- prompts

def items_json(fields: dict[str, str], items: str = "items") -> Column:
    """F8: a row's items as compact JSON text (non-ASCII kept), in list order.
    ``fields``: name in the JSON -> field of an item; decimals become numbers."""
    def value(x: Column, name: str) -> Column:
        return x[name].cast("double") if name == "value" else x[name]
    return F.to_json(F.transform(items, lambda x: F.struct(*[value(x, f).alias(n) for n, f in fields.items()])))


def period_prompt() -> Column:
    """the prompt of a store-period (multi-granularity job), from a row with
    granularity, period, store_id, total and items. Our own template: store,
    period and revenue in one sentence, then the items as JSON in list order."""
    return F.concat(
        F.lit("Sales review of one "), F.col("granularity"), F.lit(" ("), F.col("period"),
        F.lit(") in store "), F.col("store_id"), F.lit("; revenue of all its products: "),
        brl_text(F.col("total")), F.lit(".\nITEMS_JSON: "),
        items_json({"produto": "product", "tipo": "kind", "valor": "value"}),
        F.lit("\nAnswer with a JSON array, one short object for each item, with the keys "
              "produto, diagnostico, acao."))


def month_prompt() -> Column:
    """the prompt of a store-month with season (J5), month total (A7), TOP and
    BOTTOM sums (A9), item count and the items, from a row with store_id, label,
    season, events, period_total, top_sum, bottom_sum, n_items and items."""
    return F.concat(
        F.lit("Monthly menu review for store "), F.col("store_id"), F.lit(", "), F.col("label"),
        F.lit(".\nSeason: "), F.col("season"), F.lit(". Context: "), F.col("events"),
        F.lit(".\nMonth revenue, all products: "), brl_text(F.col("period_total")),
        F.lit("\nTop items: "), brl_text(F.col("top_sum")),
        F.lit("; bottom items: "), brl_text(F.col("bottom_sum")),
        F.lit("; items listed: "), F.col("n_items").cast("string"),
        F.lit("\nITEMS_JSON: "), items_json({"produto": "product", "tipo": "kind", "venda_este_mes": "value"}),
        F.lit("\nJudge each item on its own. Answer with a JSON array of objects with the keys "
              "produto, diagnostico, acao."))


def abc_batches(items: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Number items of each store in rank order and cut batches of
    ``batch_size``. The position is an exact running count (range slices), so
    a store with a huge catalogue is not one task."""
    one = items.withColumn("_one", F.lit(1))
    pos = running_totals(one, ["store_id"], [F.col("rank").asc(), F.col("product").asc()], "_one",
                         cum_col="_pos", rank_col="_r", total_col="_n")
    return pos.withColumn("batch", F.floor((F.col("_pos") - 1) / params.batch_size).cast("int")) \
              .withColumn("i", (F.col("_pos") - F.col("batch") * params.batch_size).cast("int")) \
              .drop("_one", "_pos", "_r", "_n")


def batch_rows(batched: DataFrame) -> DataFrame:
    """One row per (store_id, batch) with its items as an array in the order of ``i``."""
    own = [c for c in batched.columns if c not in ("store_id", "batch", "i")]
    rec = F.struct("i", *own)
    by_pos = F.array_sort(F.collect_list(rec), lambda a, b: a["i"] - b["i"])
    return batched.groupBy("store_id", "batch").agg(by_pos.alias("items"))


def abc_prompt(history: bool = False) -> Column:
    """the prompt of a store's batch with product, class and history, from a
    row of ``batch_rows``."""
    fields = {"produto": "product", "classe": "abc_class"} | ({"historico": "history"} if history else {})
    return F.concat(
        F.lit("ABC review for store "), F.col("store_id"),
        F.lit(". One line of advice per product, no comparisons, no trends.\nITEMS_JSON: "), items_json(fields),
        F.lit("\nAnswer with a JSON array of objects with the keys produto, analise."))


# ----------------------------------------------------------------------------- the call

#: Prompts are dealt over this many tasks for each core of the cluster.
TASKS_PER_CORE = 4


def call_annotator(prompts: DataFrame, annotator: Callable[[str], str], keys: list[str],
                   tasks: int | None = None, carry: tuple[str, ...] = (), journal: str | None = None) -> DataFrame:
    """Apply ``annotator`` to every ``prompt`` on the executors. Output:
    keys, the columns ``carry`` as they are, ``reply``, ``error``; a failing call
    gives a null reply (status ``Erro na análise``) and the exception's class and
    text.

    A prompt is small but its call is slow, so the prompts are dealt out by
    number, not by size (which would let AQE put all of them in one task):
    ``tasks`` tasks, each calling one prompt after the other. The calls that
    run at once are at most the cluster's cores, or ``tasks`` where a service
    allows fewer; default ``TASKS_PER_CORE`` tasks a core.

    Replies of a real model are not repeatable: write the result (see
    :func:`shelfrank.session.persist_table`) before using it twice. A task that
    is tried again repeats its calls, unless a ``journal`` folder on shared
    storage keeps them.
    """
    spark, cols = prompts.sparkSession, [*keys, *carry]
    schema = T.StructType([*prompts.select(*cols).schema.fields, T.StructField("reply", T.StringType()),
                           T.StructField("error", T.StringType())])
    n = tasks or TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    book = qualified(spark, journal) if journal else None

    def run(batches):
        known = Journal(book) if book else None
        for batch in batches:
            replies, errors = [], []
            for p in batch.column("prompt").to_pylist():
                try:
                    reply = known.get(p) if known else None
                    if reply is None:
                        reply = annotator(p)
                        if known and reply is not None:
                            known.put(p, reply)
                    replies.append(reply)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 — the items are marked, the class is reported
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in cols], pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=[*cols, "reply", "error"])

    return prompts.select(*cols, "prompt").repartition(n, *keys).mapInArrow(run, schema)


def call_errors(replies: DataFrame) -> DataFrame:
    """Calls, failed calls and the error classes met, for the job's report."""
    kind = F.substring_index("error", ":", 1)
    return replies.agg(F.count(F.lit(1)).alias("calls"), F.count("error").alias("failed"),
                       F.array_sort(F.collect_set(kind)).alias("errors"))


# ----------------------------------------------------------------------------- replies

def repair_json(c) -> Column:
    """the JSON list in a model's reply, made parsable.

    What stands before the first ``[`` or after the last ``]`` (fences, chat)
    is cut off. Then one pass over the rest takes string literals as they are
    and removes each comma that only white space parts from a closing bracket.
    A reply without a list is returned trimmed.
    """
    s = F.col(c) if isinstance(c, str) else c
    first, last = F.instr(s, "["), F.length(s) - F.instr(F.reverse(s), "]") + 1
    listed = F.when((first > 0) & (first < last) & (last <= F.length(s)), F.substring(s, first, last - first + 1))
    literal_or_comma = r'("(?:[^"\\]|\\.)*+")|,(?=\s*[\]}])'
    return F.regexp_replace(F.trim(F.coalesce(listed, s)), literal_or_comma, "$1")


def entries(reply: str = "reply") -> Column:
    """the object elements of the reply's JSON list, with their place ``pos``.

    A reply that is not a list (bare object, junk) has none; elements that are
    not objects (numbers, strings) are skipped, as the reference does."""
    listed = F.from_json(repair_json(reply), T.ArrayType(T.StringType()))
    objects = F.filter(F.transform(listed, lambda e, i: F.struct(i.alias("pos"), e.alias("e"))), lambda x: F.ltrim(x["e"]).startswith("{"))
    parsed = F.transform(objects, lambda x: F.struct(x["pos"].alias("pos"), F.from_json(x["e"], REPLY_FIELDS).alias("r")))
    return F.coalesce(parsed, F.array().cast(f"array<struct<pos:int,r:{REPLY_FIELDS.simpleString()}>>"))


def parse_replies(replies: DataFrame, keys: list[str]) -> DataFrame:
    """F10 + F11, flat: one row per object element of a reply. Output: keys, pos,
    produto, diagnostico, acao, analise."""
    return replies.select(*keys, F.explode(entries()).alias("x")).select(*keys, "x.pos", "x.r.*")


def answered(asked: DataFrame, annotator, keys: list[str], journal: str | None = None) -> DataFrame:
    """Calls the annotator once per row of ``asked`` and writes all of its columns
    but ``prompt``, with ``_entries`` (parsed) and ``_failed``, to the shared folder."""
    carry = tuple(c for c in asked.columns if c not in (*keys, "prompt"))
    replies = call_annotator(asked, annotator, keys, carry=carry, journal=journal)
    return persist_table(replies.select(*keys, *carry, entries().alias("_entries"), F.isnull("reply").alias("_failed")),
                         asked.sparkSession, "replies")


def attach(rows: DataFrame, failed: str = CALL_ERROR, **fields: tuple[str, str]) -> DataFrame:
    """J4 + F11 + F16: each item of a row of ``answered`` gets ``fields``: name ->
    (field of the reply, default). The last entry of its product wins; without one
    the defaults hold, and ``failed`` in place of a text where the call failed."""
    def item(x: Column) -> Column:
        own = F.try_element_at(F.filter("_entries", lambda y: y["r"]["produto"] == x["product"]), F.lit(-1))["r"]
        found = [F.when(F.col("_failed"), F.lit(failed if default == UNAVAILABLE else default))
                 .otherwise(F.coalesce(own[source], F.lit(default))).alias(name) for name, (source, default) in fields.items()]
        return F.struct(*[x[c].alias(c) for c in names], *found)

    names = [c for c in rows.schema["items"].dataType.elementType.fieldNames() if c not in fields]
    return rows.select(*[c for c in rows.columns if c not in ("items", "_entries", "_failed")], F.transform("items", item).alias("items"))


_INSIGHT = {"diagnosis": ("diagnostico", UNAVAILABLE), "action": ("acao", NO_ACTION)}


def with_status(rows: DataFrame, text: str | None) -> DataFrame:
    """F16: one ``status`` text for all items of a row that nobody was asked about
    (null: they have their own)."""
    return rows.withColumn("status", F.lit(text).cast("string"))


def said(x: Column, status: str = "status") -> tuple[Column, Column]:
    """Diagnosis and action of an item of an annotated row."""
    return F.coalesce(x["diagnosis"], F.col(status)), F.coalesce(x["action"], F.lit(NO_ACTION))


def flat_items(annotated: DataFrame, keys: list[str]) -> DataFrame:
    """One row per item of annotated rows, with its diagnosis and action."""
    return flat(annotated, keys, "status").withColumns({
        "diagnosis": F.coalesce("diagnosis", "status"), "action": F.coalesce("action", F.lit(NO_ACTION))}).drop("status")


def annotate_periods(lists: DataFrame, annotator, keys: list[str], params: Params = DEFAULT, journal: str | None = None) -> DataFrame:
    """X4 on ``ranking.overlap_lists``: prompts for the newest periods of each store
    (W6), a ``status`` text for the rest. Fills in diagnosis and action of the items.

    The rows (one per store-period) are written once: the prompts and the older
    periods both read them, so the fact is read by one job."""
    if annotator is None:
        return with_status(lists, NO_MODEL)
    store = [k for k in keys if k != "period"]
    rows = persist_table(recent_periods(lists, store, params=params).drop("recency"), lists.sparkSession, "period-lists")
    asked = rows.where(F.col("annotated") & (F.size("items") > 0)).drop("annotated").withColumn("prompt", period_prompt())
    done = with_status(attach(answered(asked, annotator, keys, journal), **_INSIGHT), None)
    rest = rows.where(~F.col("annotated") | (F.size("items") == 0)).drop("annotated")
    return done.unionByName(with_status(rest, HISTORICAL))


def annotate_months(lists: DataFrame, annotator, keys: list[str], journal: str | None = None) -> DataFrame:
    """X4 on ``ranking.monthly_lists`` with sums and season (every month is asked)."""
    if annotator is None:
        return with_status(lists, NO_MODEL)
    done = answered(lists.withColumn("prompt", month_prompt()), annotator, keys, journal)
    return with_status(attach(done, **_INSIGHT), None)
