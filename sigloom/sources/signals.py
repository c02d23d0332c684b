"""Signals read from tables: blocks of pixels, colours, series, symbols and blobs, with a total order in each.

Only the columns that a signal needs are read, so that Parquet prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, vec): 8 x 8 blocks of bytes-like integers, row by row, from unit vectors."""
    vec = F.transform("embedding", lambda e: F.round(e.cast("double") * 127 + 128).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", vec.alias("vec"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, p, y, x, v): the blocks, a row per pixel."""
    out = blocks(spark, sf_dir).select("vec_id", "label", F.posexplode("vec").alias("p", "v"))
    return out.select("vec_id", "label", "p", F.shiftright("p", 3).alias("y"), F.col("p").bitwiseAND(F.lit(7)).alias("x"), "v")


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, l_partkey, l_suppkey, r, g, b)."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.col("l_quantity").cast("int").alias("r"), F.round(F.col("l_discount") * 1000).cast("int").alias("g"), F.round(F.col("l_tax") * 1000).cast("int").alias("b"),
    )


#: Columns that order the rows of one l_orderkey without ties.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ts, event_id, event_type, sym, sample): one series per user, ordered by (ts, event_id)."""
    kinds = ("view", "signup", "purchase", "error", "click")
    sym = F.coalesce(*(F.when(F.col("event_type") == k, i) for i, k in enumerate(kinds)), F.lit(len(kinds)))
    return table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", sym.alias("sym"), F.round(F.col("value") * 100).cast("int").alias("sample"))


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, sym): the code points of texts."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.split("text", "")).alias("sym")).where("sym != ''")
