"""Result documents (A19, A20, P19), sinks (K1–K5), output check (K7) and reload
of written documents (S7, U4).

Documents are JSON lines whose shape does not depend on any size: one line per
ABC item, per store-month (<= 20 items), and per store of a granularity (its
periods, bounded by the calendar, <= 20 items each). The readers give the flat
rows back, and from those the reference's one object per store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.functions.clean import store_number
from shelfrank.operators.annotate import said
from shelfrank.operators.prefix import running_totals


def _sorted_items(order_col: str, item) -> F.Column:
    rec = F.struct(F.col(order_col).alias("_o"), item.alias("r"))
    return F.transform(
        F.array_sort(F.collect_list(rec), lambda a, b: F.when(a["_o"] < b["_o"], -1)
                     .when(a["_o"] > b["_o"], 1).otherwise(0)),
        lambda s: s["r"])


def abc_documents(classified: DataFrame) -> DataFrame:
    """A19 + P19: one line per item, ``{id_loja, store_id, pos, item: {produto,
    valor_total, classe, historico, analise_ia}}``; ``pos`` counts the store's
    items from 0: those from the cache first, then the others (U3), by rank.

    ``classified`` has store_id, product, value, rank, abc_class and
    optionally history (map), analysis and from_cache. The position is an exact
    running count over range slices, so a store's catalogue is not one task.
    """
    cols = classified.columns
    fresh = F.when(F.col("from_cache"), 0).otherwise(1) if "from_cache" in cols else F.lit(0)
    narrow = classified.select("store_id", "product", "rank", fresh.alias("_fresh"), F.lit(1).alias("_one"))
    placed = running_totals(narrow, ["store_id"], [F.col("_fresh").asc(), F.col("rank").asc(), F.col("product").asc()],
                            "_one", cum_col="_pos", rank_col="_r", total_col="_n")
    placed = placed.select("store_id", "product", (F.col("_pos") - 1).cast("int").alias("pos"))
    item = F.struct(
        F.col("product").alias("produto"),
        F.col("value").cast("double").alias("valor_total"),
        F.col("abc_class").alias("classe"),
        (F.col("history") if "history" in cols else F.lit(None).cast("map<string,decimal(28,2)>"))
        .cast("map<string,double>").alias("historico"),
        (F.col("analysis") if "analysis" in cols else F.lit(None).cast("string")).alias("analise_ia"),
    )
    return classified.join(placed, ["store_id", "product"]).select(
        store_number("store_id").alias("id_loja"), "store_id", "pos", item.alias("item"))


ABC_LINE = ("id_loja int, store_id string, pos int, item struct<produto:string,valor_total:double,classe:string,"
            "historico:map<string,double>,analise_ia:string>")


def read_abc_documents(spark: SparkSession, path: str) -> DataFrame:
    """Written ABC lines, as ``abc_documents`` gives them."""
    return spark.read.schema(ABC_LINE).json(path)


def abc_summary(lines: DataFrame) -> DataFrame:
    """Per store of the ABC lines: number of items, first and last product, last
    analysis. Every task sends one row per store, whatever the catalogue's size."""
    return lines.groupBy("id_loja", "store_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_items"),
        F.min_by("item.produto", "pos").alias("first_product"), F.max_by("item.produto", "pos").alias("last_product"),
        F.max_by("item.analise_ia", "pos").alias("last_analysis"))


def nest_abc(lines: DataFrame) -> DataFrame:
    """K1's form: one object per store with its items in order. A store's
    catalogue becomes one value, so this is for consumers of single stores."""
    return lines.groupBy("id_loja", "store_id").agg(_sorted_items("pos", F.col("item")).alias("itens"))


def _annotated_items(*fields: tuple[str, str]) -> F.Column:
    """The items of an annotated row as the documents have them: (name, field)."""
    def item(x: F.Column) -> F.Column:
        diagnosis, action = said(x)
        own = [(x[f].cast("double") if f == "value" else x[f]).alias(n) for n, f in fields]
        return F.struct(*own, F.struct(diagnosis.alias("diagnostico"), action.alias("acao")).alias("analise_ia"))
    return F.transform("items", item)


def monthly_documents(annotated: DataFrame) -> DataFrame:
    """A20 + P19: one line per store-month: ``{id_loja, store_id, mes,
    total_mensal, itens: [{produto, tipo, venda_este_mes, analise_ia{diagnostico, acao}}]}``.

    ``annotated``: the annotated rows of ``ranking.monthly_lists``.
    """
    return annotated.select(store_number("store_id").alias("id_loja"), "store_id", F.col("month").alias("mes"),
                            F.col("period_total").cast("double").alias("total_mensal"), _annotated_items(("produto", "product"), ("tipo", "kind"), ("venda_este_mes", "value")).alias("itens"))


MONTH_LINE = ("id_loja int, store_id string, mes string, total_mensal double, itens array<struct<produto:string,"
              "tipo:string,venda_este_mes:double,analise_ia:struct<diagnostico:string,acao:string>>>")


def read_month_documents(spark: SparkSession, path: str) -> DataFrame:
    """Written monthly lines; ``store_id`` comes from the folder (K3) where it
    is not in the line."""
    return spark.read.schema(MONTH_LINE).json(path)


PERIOD_ITEM = "struct<produto:string,valor:double,tipo:string,analise_ia:struct<diagnostico:string,acao:string>>"
PERIOD_LINE = ("granularidade string, gerado_em string, dados_lojas array<struct<id_loja:int,store_id:string,"
               f"analises:map<string,struct<total:double,itens:array<{PERIOD_ITEM}>>>>>")


def period_documents(annotated: DataFrame) -> DataFrame:
    """A20 for the multi-granularity job, in the form of the result file:
    ``{granularidade, gerado_em, dados_lojas: [{id_loja, store_id, analises:
    {periodo: {total, itens}}}]}``, one line per store of a granularity. The
    periods of a store are bounded by the calendar, the items by the ranking.

    ``annotated``: the annotated rows of ``ranking.overlap_lists``."""
    entry = F.struct("period", F.struct(F.col("total").cast("double").alias("total"), _annotated_items(("produto", "product"), ("valor", "value"), ("tipo", "kind")).alias("itens")))
    stores = annotated.groupBy("granularity", "store_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["period"] < b["period"], -1)
                                        .when(a["period"] > b["period"], 1).otherwise(0))).alias("analises"))
    return stores.select(
        F.col("granularity").alias("granularidade"), F.current_timestamp().cast("string").alias("gerado_em"),
        F.array(F.struct(store_number("store_id").alias("id_loja"), "store_id", "analises")).alias("dados_lojas"))


def index_document(mart: DataFrame, written: DataFrame) -> DataFrame:
    """K5 + T3: folders written, stores in string order, first/last day, time.

    ``mart``: the multi-granularity mart with its day rows; ``written``: one
    ``path`` per file written, below the output folder. Stores and folders are
    dimensions: one entry each, not per row."""
    none = F.lit(None).cast("string")
    rows = mart.where("granularity = 'day'").select("store_id", "period", none.alias("folder")).unionByName(
        written.select(none.alias("store_id"), none.alias("period"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")))
    return rows.agg(
        F.sort_array(F.collect_set("folder")).alias("arquivos"), F.sort_array(F.collect_set("store_id")).alias("lojas"),
        F.struct(F.min("period").alias("inicio"), F.max("period").alias("fim")).alias("periodo_dados"),
    ).select(F.current_timestamp().cast("string").alias("gerado_em"), "*")


# ----------------------------------------------------------------------------- sinks

def write_documents(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """K1–K4: JSON lines; ``partition_by='store_id'`` gives one folder per store
    (K3), ``'granularidade'`` one per granularity (K4). Rows are first
    rebalanced by folder: a small folder is one file, a large one is split."""
    w = df.write
    if partition_by:
        w = df.hint("rebalance", partition_by).write.partitionBy(partition_by)
    w.mode("overwrite").json(path)
    return path


def written_files(spark: SparkSession, out_dir: str, path: str) -> DataFrame:
    """``path`` of each file written below ``path``, relative to ``out_dir``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True) \
        .option("pathGlobFilter", "part-*").load(path).select("path")
    return files.select(F.substring_index("path", out_dir.rstrip("/").split("://")[-1] + "/", -1).alias("path"))


def read_period_documents(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """S7 + U4: read period documents back (all granularity folders are
    unioned by the reader; ``whole_file`` for a file that is one object) and
    flatten to one row per item: granularidade, store_id, periodo, total, pos,
    produto, valor, tipo, analise_ia."""
    docs = spark.read.schema(PERIOD_LINE).option("multiLine", whole_file).json(path)
    stores = docs.select("granularidade", "gerado_em", F.explode("dados_lojas").alias("loja"))
    periods = stores.select("granularidade", "gerado_em", "loja.id_loja",
                            F.coalesce("loja.store_id", F.col("loja.id_loja").cast("string")).alias("store_id"),
                            F.explode("loja.analises").alias("periodo", "doc"))
    return periods.select("granularidade", "gerado_em", "id_loja", "store_id", "periodo", "doc.total",
                          F.posexplode("doc.itens").alias("pos", "item")) \
                  .select("granularidade", "gerado_em", "id_loja", "store_id", "periodo", "total", "pos", "item.*")


def output_check(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """K7: per written output, files, bytes, JSON records and corrupt records."""
    out = None
    for name, p in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True) \
            .option("pathGlobFilter", "part-*").load(p) \
            .select(F.lit(1).alias("files"), F.col("length").alias("bytes"), F.lit(0).alias("records"), F.lit(0).alias("corrupt"))
        # each line must be one JSON object; json_object_keys is null otherwise
        lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").text(p).select(
            F.lit(0).alias("files"), F.lit(0).cast("bigint").alias("bytes"), F.lit(1).alias("records"),
            F.json_object_keys("value").isNull().cast("int").alias("corrupt"))
        one = files.unionByName(lines).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
                                             for c in ("files", "bytes", "records", "corrupt")]) \
            .select(F.lit(name).alias("output"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# ----------------------------------------------------------------------------- documents of any shape

def read_mixed_documents(spark: SparkSession, path: str) -> DataFrame:
    """S7 for period files of any age, by ``VARIANT``: each line is parsed without a
    schema, and only what is asked for is looked up, so that fields of another
    type, missing or new ones do no harm. Result: the rows of
    ``read_period_documents`` without ``gerado_em`` and ``analise_ia``, with
    ``diagnostico`` and ``acao``.

    A line is a file's object, or a bare list of its stores (then the granularity
    is null). ``id_loja`` may be a number or text; ``analises`` an object by
    period, or a list of objects that hold their ``periodo``; ``analise_ia`` an
    object, or a text, which is the diagnosis. A line that is no JSON, and items
    that are no objects, give no rows.
    """
    doc = spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    get = lambda v, at, kind: F.try_variant_get(v, at, kind)
    stores = doc.select(get("v", "$.granularidade", "string").alias("granularidade"), F.explode(F.coalesce(
        get("v", "$.dados_lojas", "array<variant>"), get("v", "$", "array<variant>"))).alias("loja"))
    # an object by period, else a list whose entries name their period
    by_name = get("loja", "$.analises", "map<string,variant>")
    listed = get("loja", "$.analises", "array<variant>")
    entries = F.coalesce(F.transform(F.map_entries(by_name), lambda e: F.struct(e["key"].alias("periodo"), e["value"].alias("doc"))),
                         F.transform(listed, lambda e: F.struct(get(e, "$.periodo", "string").alias("periodo"), e.alias("doc"))))
    number = F.coalesce(get("loja", "$.id_loja", "int"), store_number(get("loja", "$.id_loja", "string")))
    periods = stores.select(
        "granularidade", number.alias("id_loja"),
        F.coalesce(get("loja", "$.store_id", "string"), get("loja", "$.id_loja", "string")).alias("store_id"), F.explode(entries).alias("e"))
    items = periods.select("granularidade", "id_loja", "store_id", "e.periodo", get("e.doc", "$.total", "double").alias("total"),
                           F.posexplode(get("e.doc", "$.itens", "array<variant>")).alias("pos", "i"))
    found = items.where(F.schema_of_variant("i").startswith("OBJECT"))
    return found.select(
        "granularidade", "id_loja", "store_id", "periodo", "total", "pos", get("i", "$.produto", "string").alias("produto"),
        get("i", "$.valor", "double").alias("valor"), get("i", "$.tipo", "string").alias("tipo"),
        F.coalesce(get("i", "$.analise_ia.diagnostico", "string"), _text(get("i", "$.analise_ia", "variant"))).alias("diagnostico"),
        get("i", "$.analise_ia.acao", "string").alias("acao"))


def _text(v: F.Column) -> F.Column:
    """A variant that is a text."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
