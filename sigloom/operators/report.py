"""Ranked reports over results of methods: winners, budgets, roll-ups, leaderboards, and their text and HTML forms."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.scalar import ratio, size_text

RESULT = (
    "name string, tier int, output_path string, original_size long, compressed_size long, compression_ratio double, ssim double, psnr double, "
    "elapsed_seconds double, format string, quality_param string, notes string, decompressor string"
)
BUDGET = 1024


def winners(results: DataFrame) -> DataFrame:
    """(tier, name, compressed_size): the smallest of each tier, ties to the first name."""
    best = F.min_by(F.struct("name", "compressed_size"), F.struct("compressed_size", "name"))
    return results.groupBy("tier").agg(best.alias("w")).select("tier", "w.name", "w.compressed_size")


def within_budget(results: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Artifacts of at most `budget` bytes (P01), best quality first in rnk, unknown quality as 0."""
    order = Window.partitionBy("tier").orderBy(F.coalesce("ssim", F.lit(0.0)).desc(), "compressed_size", "name")
    return results.where(F.col("compressed_size") <= budget).withColumn("rnk", F.row_number().over(order))


def rollup(results: DataFrame) -> DataFrame:
    """(tier, methods, best_size, total_size) with a row, tier null, over all."""
    return results.rollup("tier").agg(F.count("*").alias("methods"), F.min("compressed_size").alias("best_size"), F.sum("compressed_size").alias("total_size"))


def leaderboard(results: DataFrame) -> DataFrame:
    """results by size within their tier, with ratio, rank and readable size."""
    rank = F.rank().over(Window.partitionBy("tier").orderBy("compressed_size"))
    return results.withColumn("rnk", rank).withColumn("ratio", F.round(ratio(F.col("original_size"), F.col("compressed_size")), 4)).withColumn("size", size_text(F.col("compressed_size")))


def against(results: DataFrame, baseline: int) -> DataFrame:
    """results with delta_pct, the percentage above the baseline's size."""
    return results.withColumn("delta_pct", F.round((F.col("compressed_size") - baseline) / F.lit(float(baseline)) * 100, 4))


def text_lines(results: DataFrame) -> DataFrame:
    """(tier, line_no, line): the fixed-width table (S08), for write.text."""
    board = leaderboard(results)
    number = lambda c: F.when(F.col(c).isNull(), "N/A").when(F.col(c) == float("inf"), "inf").otherwise(F.format_string("%.4f", F.round(c, 4)))
    line = F.format_string("%-35s %10s %7.1fx %8s %8s %s", "name", "size", F.round("ratio", 1), number("ssim"), number("psnr"), F.coalesce("quality_param", F.lit("")))
    order = Window.partitionBy("tier").orderBy("compressed_size", "name")
    return board.select("tier", F.row_number().over(order).alias("line_no"), line.alias("line"))


def html_page(rows: Sequence, title: str = "Results") -> str:
    """A table of collected result rows (S09); reports are small, a row per method."""
    if not rows:
        return f"<!DOCTYPE html><title>{html.escape(title)}</title><p>No results.</p>"
    names = list(rows[0].asDict())
    cells = lambda r: "".join(f"<td>{html.escape('' if r[n] is None else str(r[n]))}</td>" for n in names)
    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    return f"<!DOCTYPE html><title>{html.escape(title)}</title><table><tr>{head}</tr>{''.join(f'<tr>{cells(r)}</tr>' for r in rows)}</table>"
