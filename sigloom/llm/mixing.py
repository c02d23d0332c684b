"""Mixing sources to target weights.

Shares p of the sources' tokens become weights p^a / sum p^a. The exponent a is found by bisection: flat enough for the target
entropy, but not so flat that a source would repeat more than the limit. Weights times the budget are the sources' quotas; a quota
is spent on whole passes over the source's blocks, a block being the documents of one hash value, and then on blocks in a
pseudo-random order, the last one up to the document with which the quota is reached.

Any number of sources: the bisection needs how many sources have how many tokens, and of t tokens in all there are at most sqrt(2 t)
different counts, 16 bytes each on the driver (some 70 MB of 10^13 tokens); sources themselves stay in tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.common import BROADCAST_ROWS, cut

#: Blocks of a source: so many at least, and so many that the block at which a quota ends has some BLOCK_ROWS documents at most.
BLOCKS, BLOCK_ROWS = 256, 8192


def tokens(text: str = "text") -> Column:
    """Words of a text: runs of other than ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _norm(sizes: dict[int, int], a: float) -> float:
    """The sum of c^a over the sources, sizes[c] of them with c tokens."""
    return math.fsum(n * float(c) ** a for c, n in sizes.items() if c)


def entropy(sizes: dict[int, int], a: float) -> float:
    """Of the weights under exponent a."""
    z = _norm(sizes, a)
    return math.log(z) - math.fsum(n * float(c) ** a * a * math.log(c) for c, n in sizes.items() if c) / z


def solve_exponent(sizes: dict[int, int], budget: int, target: float, limit: float, steps: int = 60) -> float:
    """The largest a in [0, 1] whose weights reach `target` of the largest possible entropy, or, where these would repeat a source
    more than `limit` times, the smallest a at which none is (1 if even the plain shares do). sizes: tokens -> sources."""
    live = sum(n for c, n in sizes.items() if c)
    if live < 2:
        return 1.0
    goal = target * math.log(live)

    def bisect(low_ok) -> float:
        """The border between small a, where low_ok holds, and large a."""
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if low_ok(mid) else (lo, mid)
        return lo

    least = min(c for c in sizes if c)
    repeats = lambda a: float(least) ** (a - 1) * budget / _norm(sizes, a)  # noqa: E731  a <= 1: the smallest source repeats most
    flat = 1.0 if entropy(sizes, 1.0) >= goal else bisect(lambda a: entropy(sizes, a) >= goal)
    if repeats(flat) <= limit:
        return flat
    if repeats(1.0) > limit:
        return 1.0
    return max(flat, bisect(lambda a: repeats(a) > limit) + 1e-12)


def plan(docs: DataFrame, budget: int | None = None, target: float = 0.9, limit: float = 4.0) -> tuple[DataFrame, int]:
    """Per source with tokens: source, tokens, weight, quota; and how many sources there are. docs: source, tokens."""
    rows = docs.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    sizes = {r.tokens: r.n for r in rows.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    budget = sum(c * n for c, n in sizes.items()) if budget is None else budget
    a = solve_exponent(sizes, budget, target, limit)
    weight = F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.lit(_norm(sizes, a) or 1.0)
    quota = F.least(F.floor(F.col("weight") * budget), F.floor(F.col("tokens") * F.lit(float(limit))))
    return rows.withColumn("weight", weight).withColumn("quota", quota.cast("long")), sum(sizes.values())


def mix_sources(docs: DataFrame, budget: int | None = None, target: float = 0.9, limit: float = 4.0, blocks: int = BLOCKS, seed: int = 17) -> DataFrame:
    """One row per document drawn and pass: doc_id, source, n_tokens, pass (from 0), block, position (the block's place in the
    source's pass), weight and quota of the source.

    budget: tokens to draw, by default as many as there are. A null source is one source, named ''. Documents without tokens cost
    nothing and are drawn where their block is; those of a source without any are not drawn. Repeated rows are drawn as separate
    documents. An empty table gives an empty draw. Whole passes draw every document; of the last, only the block at which the quota ends
    is ordered by document: blocks grow in number with the table, so that such a block stays small however hot its source is.
    """
    digest = cut(_numbered(docs, seed), "mix")
    blocks = max(blocks, -(-digest.count() // BLOCK_ROWS))
    digest = digest.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int")).drop("h")
    few = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df
    sources, n = plan(digest, budget, target, limit)
    per_block = digest.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens")).join(few(sources, n), "source")
    per_block = per_block.withColumn("whole", F.expr("quota div tokens")).withColumn("rest", F.expr("quota % tokens"))
    order = F.xxhash64(F.lit(seed), "source", "block", "whole")
    line = Window.partitionBy("source").orderBy(order, "block")
    placed = per_block.withColumn("before", F.sum("block_tokens").over(line) - F.col("block_tokens")).withColumn("position", F.row_number().over(line))
    placed = placed.withColumn("left", F.col("rest") - F.col("before")).select("source", "block", "weight", "quota", "whole", "position", "block_tokens", F.when(F.col("left") <= 0, 0).when(F.col("left") >= F.col("block_tokens"), 2).otherwise(1).alias("share"), "left")
    rows = digest.join(few(placed, n * blocks), ["source", "block"])
    whole = rows.where("share != 1").withColumn("passes", F.col("whole") + F.when(F.col("share") == 2, 1).otherwise(0))
    cut_line = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "tokens"), "doc_id")
    part = rows.where("share = 1").withColumn("before", F.sum("tokens").over(cut_line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    part = part.withColumn("passes", F.col("whole") + F.when(F.col("before") < F.col("left"), 1).otherwise(0)).drop("before")
    drawn = whole.unionByName(part).where("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
    return drawn.select("doc_id", "source", F.col("tokens").alias("n_tokens"), "pass", "block", F.col("position").cast("long").alias("position"), "weight", "quota")


def _numbered(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), tokens().alias("tokens"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")).alias("h"))
