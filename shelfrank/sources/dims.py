"""Small fixed dimensions (S8, S9, S10) and their joins.

They have a fixed number of rows (12 months, a handful of stores), so
broadcasting them is safe at any data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Seasonal context per month number (Brazil), as the reference states it:
# month, season, events, trend.
SEASONS = [
    ("01", "Verão", "Férias escolares, calor intenso", "bebidas geladas, saladas"),
    ("02", "Verão", "Carnaval, calor", "bebidas, pratos leves"),
    ("03", "Outono", "Volta às aulas, fim do verão", "transição cardápio"),
    ("04", "Outono", "Páscoa, temperaturas amenas", "chocolates, pratos equilibrados"),
    ("05", "Outono", "Dia das Mães, friagem", "aumento consumo, pratos reconfortantes"),
    ("06", "Inverno", "Festa Junina, início frio", "comidas típicas, bebidas quentes"),
    ("07", "Inverno", "Férias escolares, frio intenso", "sopas, caldos, churrasco"),
    ("08", "Inverno", "Dia dos Pais, frio", "carnes, pratos quentes"),
    ("09", "Primavera", "Início primavera, clima variável", "transição cardápio"),
    ("10", "Primavera", "Dia das Crianças, esquenta", "combos família, porções"),
    ("11", "Primavera", "Black Friday, calor chegando", "promoções, bebidas"),
    ("12", "Verão", "Natal, Ano Novo, férias", "celebrações, alto movimento"),
]
# Defaults for an unknown month number, and for a malformed key.
SEASON_UNKNOWN = ("N/A", "Período padrão", "análise geral")
SEASON_MALFORMED = ("N/A", "N/A", "N/A")

# Store display names. Synthetic names of our own; any id not listed is shown
# as "Loja <id>" (J6).
STORE_NAMES = [
    ("1", "CENTRO"), ("2", "NORTE"), ("3", "SUL"), ("4", "LESTE"), ("5", "OESTE"),
    ("6", "PRAÇA"), ("7", "SHOPPING"), ("8", "ESTAÇÃO"), ("9", "PARQUE"),
    ("12", "AEROPORTO"), ("14", "PORTO"), ("15", "MERCADO"), ("20", "RODOVIA"),
]


def seasons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEASONS, "mm string, season string, events string, trend string")


def store_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STORE_NAMES, "store_id string, store_name string")


def with_season(df: DataFrame, spark: SparkSession, month_col: str = "month") -> DataFrame:
    """Season, events and trend of a ``yyyy-MM`` key; defaults for an
    unknown month number and for a key without exactly one ``-``."""
    parts = F.split(F.col(month_col), "-")
    ok = F.size(parts) == 2
    mm = F.when(ok, F.element_at(parts, 2))
    s = F.broadcast(seasons(spark))
    j = df.withColumn("_mm", mm).join(s, F.col("_mm") == s.mm, "left")
    unknown, bad = SEASON_UNKNOWN, SEASON_MALFORMED
    out = j
    for i, c in enumerate(("season", "events", "trend")):
        out = out.withColumn(
            f"_{c}", F.when(~ok, F.lit(bad[i])).otherwise(F.coalesce(F.col(c), F.lit(unknown[i]))))
    out = out.drop("mm", "_mm", "season", "events", "trend")
    for c in ("season", "events", "trend"):
        out = out.withColumnRenamed(f"_{c}", c)
    return out


def with_store_name(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Display name, fallback ``Loja <id>``."""
    names = F.broadcast(store_names(spark))
    return df.join(names, "store_id", "left").withColumn(
        "store_name", F.coalesce(F.col("store_name"), F.concat(F.lit("Loja "), F.col("store_id"))))
