"""The reference's three batch jobs, each one Spark plan per output.

* :func:`abc_job` — ABC classes per store with month history, optional
  annotation through the cache, ABC documents and the updated cache (3.1).
* :func:`monthly_job` — monthly TOP/BOTTOM per store (optionally one store),
  annotation, monthly documents and run statistics (3.2).
* :func:`multi_job` — day/week/month rankings from one day mart, last-7
  annotation, period documents per granularity and the index (3.3).

Inputs are a sales fact (``store_id, product, value, d``) or raw files read
with :func:`shelfrank.sources.files.read_sales` and cleaned here. Marts that
several outputs read are written once to the shared checkpoint folder.
``journal``: a folder on shared storage that keeps the annotator's replies as
they arrive, so that a job that is run again does not repeat a call.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfrank.config import DEFAULT, Params
from shelfrank.functions.clean import DEFAULT_DATE_FORMATS
from shelfrank.functions.periods import GRANULARITIES, month_label
from shelfrank.operators import abc, annotate, cache, documents, marts, quality, ranking
from shelfrank.operators.clean import clean_sales, rename_raw
from shelfrank.session import drop_table, persist_table
from shelfrank.sources.dims import with_season
from shelfrank.sources.files import read_sales


@dataclass
class JobResult:
    """What a job wrote, and frames over it. ``close`` deletes the job's scratch
    tables; frames that read them must not be used afterwards."""

    outputs: dict[str, str] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    scratch: list[DataFrame] = field(default_factory=list)

    def keep(self, df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
        """``persist_table`` for the length of the job."""
        self.scratch.append(persist_table(df, spark, name))
        return self.scratch[-1]

    def close(self) -> None:
        while self.scratch:
            drop_table(self.scratch.pop())

    def __enter__(self) -> JobResult:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def load_fact(spark: SparkSession, path: str, invalid_dates: str = "bucket", money: str = "br",
              currency: bool = False, collapse_ws: bool = True, drop_invalid_products: bool = True,
              date_formats=DEFAULT_DATE_FORMATS, counts: Observation | None = None, **read_options) -> DataFrame:
    """Read raw files (S1–S5) and clean them (P1–P12) into the sales fact.

    ``money``/``currency`` (P2/P3, D3), ``collapse_ws`` (P10 or P11),
    ``drop_invalid_products`` and ``date_formats`` go to the cleaning; native
    dates of workbooks are always read. ``counts`` gets the data-quality counts
    (A13) from the job's own pass. ``read_options`` go to ``read_sales``.
    """
    read_options.setdefault("decimal", "." if money == "plain" else ",")
    raw = rename_raw(read_sales(spark, path, **read_options))
    formats = [*date_formats, *(f for f in DEFAULT_DATE_FORMATS if f not in date_formats)]
    return clean_sales(raw, money=money, currency=currency, invalid_dates=invalid_dates, collapse_ws=collapse_ws,
                       drop_invalid_products=drop_invalid_products, counts=counts,
                       date_formats=formats if "source_file" in raw.columns else date_formats)


def abc_job(spark: SparkSession, sales: DataFrame, out_dir: str, annotator=None,
            cache_in: DataFrame | None = None, params: Params = DEFAULT, journal: str | None = None) -> JobResult:
    """3.1: A1 -> A6 -> W1–W3 -> (X3 with J2/J3/U2) -> K1 (+ K6).

    ``cache_in`` defaults to the cache of the last run in ``out_dir`` (none:
    empty). It is fixed before anything is written, the documents are written
    next, and the new entries go into the cache last (only the parts of their
    stores are rewritten), so the job can be run every day on one folder and a
    failure loses nothing.
    """
    res = JobResult()
    month = res.keep(marts.product_month_sales(sales), spark, "abc-month-mart")
    classified = abc.classify(marts.product_history(month), params=params)
    path = f"{out_dir}/cache"
    items = classified
    if annotator is not None:
        old = res.keep(cache_in if cache_in is not None else cache.read_json(spark, path), spark, "abc-cache")
        items, new = cache.annotate_abc(classified, old, annotator, params, journal)
    res.outputs["abc"] = documents.write_documents(documents.abc_documents(items), f"{out_dir}/abc")
    if annotator is not None:
        res.outputs["cache"] = path
        if cache_in is None:
            cache.update_json(new, path)
        else:
            cache.write_json(cache.upsert(old, new), path)
        res.frames["cache"] = cache.read_json(spark, path)
    res.frames["classified"] = classified
    return res


def monthly_job(spark: SparkSession, sales: DataFrame, out_dir: str, annotator=None,
                store: str | None = None, months: tuple[str, str] | None = None,
                params: Params = DEFAULT, journal: str | None = None) -> JobResult:
    """3.2 (and the single-store variant, P13 + K3; ``months=(lo, hi)`` keeps
    a month range, P15, as a date filter the scan can use)."""
    if store is not None:
        sales = sales.filter(F.col("store_id") == store)  # pushed below the aggregate
    if months is not None:
        sales = marts.in_month_range(sales, *months)
    res = JobResult()
    month = res.keep(marts.product_month_sales(sales), spark, "monthly-mart")
    keys = ["store_id", "month"]
    lists = with_season(ranking.with_sums(ranking.monthly_lists(month, keys, params)).withColumn("label", month_label("month")), spark)
    annotated = annotate.annotate_months(lists, annotator, keys, journal)
    res.outputs["monthly"] = documents.write_documents(
        documents.monthly_documents(annotated), f"{out_dir}/monthly", partition_by="store_id")
    res.frames["statistics"] = quality.run_statistics(ranking.monthly_top_bottom(month, keys, params), keys)
    return res


def multi_job(spark: SparkSession, sales: DataFrame, out_dir: str, annotator=None,
              granularities=GRANULARITIES, params: Params = DEFAULT, journal: str | None = None) -> JobResult:
    """3.3: day mart once (persisted), week/month from it, overlap rankings,
    last-7 annotation, one document folder per granularity, index."""
    sales = sales.filter(F.col("d").isNotNull())  # P6b: this job drops undated rows
    res = JobResult()
    # the index needs the first and last day, so the day rows are always kept
    mart = res.keep(marts.multi_granularity_mart(sales, tuple(dict.fromkeys(("day", *granularities)))), spark, "multi-mart")
    days, mart = mart, mart.where(F.col("granularity").isin(*granularities))
    keys = ["granularity", "store_id", "period"]
    annotated = annotate.annotate_periods(ranking.overlap_lists(mart, keys, params), annotator, keys, params, journal)
    res.outputs["periods"] = documents.write_documents(
        documents.period_documents(annotated), f"{out_dir}/periods", partition_by="granularidade")
    res.outputs["index"] = f"{out_dir}/index"
    written = documents.written_files(spark, out_dir, res.outputs["periods"])
    documents.index_document(days, written).write.mode("overwrite").json(res.outputs["index"])
    res.frames["annotated"] = annotated
    return res
