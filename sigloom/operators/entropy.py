"""Frequencies, entropies and code costs: two-level aggregations that combine before the shuffle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequencies(df: DataFrame, keys: Sequence[str], sym: str = "sym") -> DataFrame:
    """(keys, sym, cnt)."""
    return df.groupBy(*keys, sym).agg(F.count("*").alias("cnt"))


def character_counts(texts: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """(key, sym, cnt) of the code points of texts: counted batch by batch inside each task, so that a row goes out per distinct symbol and
    not per character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, Counter] = {}
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(k, Counter()).update(t or "")
        rows = [(k, c, n) for k, counts in held.items() for c, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["key", "sym", "n"])

    each = texts.select((F.col(key) if key else F.lit(None).cast("string")).alias("key"), text).mapInArrow(run, "key string, sym string, n long")
    keys = [F.col("key").alias(key)] if key else []
    return each.groupBy(*keys, "sym").agg(F.sum("n").alias("cnt"))


def entropy_of(cnt: str = "cnt") -> tuple[Column, Column]:
    """(bits in all, bits per symbol) over rows of counts: n log2 n - sum c log2 c, the same for any order of the rows up to rounding."""
    n = F.sum(cnt).cast("double")
    bits = n * F.log2(n) - F.sum(F.col(cnt) * F.log2(F.col(cnt).cast("double")))
    return bits, bits / n


def entropy(df: DataFrame, keys: Sequence[str] = (), sym: str = "sym", digits: int = 6) -> DataFrame:
    """(keys, n, bps): Shannon entropy of sym, bits per symbol."""
    return entropy_from(frequencies(df, keys, sym), keys, digits)


def entropy_from(counts: DataFrame, keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """The same from (keys, sym, cnt)."""
    _, bps = entropy_of()
    return counts.groupBy(*keys).agg(F.sum("cnt").alias("n"), (F.round(bps, digits) + 0.0).alias("bps"))


def total_bits(df: DataFrame, keys: Sequence[str] = (), sym: str = "sym", digits: int = 4) -> DataFrame:
    """(keys, n, bits): what an ideal order-0 code spends."""
    return total_bits_from(frequencies(df, keys, sym), keys, digits)


def total_bits_from(counts: DataFrame, keys: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """The same from (keys, sym, cnt)."""
    bits, _ = entropy_of()
    return counts.groupBy(*keys).agg(F.sum("cnt").alias("n"), (F.round(bits, digits) + 0.0).alias("bits"))


def _log2_factorial(numbers: pa.Array) -> pa.Array:
    from math import lgamma, log

    return pa.array(np.array([lgamma(n + 1.0) for n in numbers.to_pylist()]) / log(2))


def adaptive_bits(df: DataFrame, keys: Sequence[str], symbols: int, sym: str = "sym", digits: int = 4) -> DataFrame:
    """(keys, n, bits): ideal length under counts that start at one and grow by one (O03, O04, O07 before any rescaling).

    Sample i of a key costs log2(i - 1 + symbols), the j-th of a symbol gains log2(j): the sums are those of factorials of the counts,
    whatever the order of the samples, so that no series is sorted and no key is hot.
    """
    log2f = F.arrow_udf(_log2_factorial, "double")
    counts = frequencies(df, keys, sym).select(*keys, "cnt", log2f("cnt").alias("gain"))
    sums = counts.groupBy(*keys).agg(F.sum("cnt").alias("n"), F.sum("gain").alias("gain"))
    bits = log2f(F.col("n") + symbols - 1) - log2f(F.lit(symbols - 1).cast("long") + F.col("n") * 0) - F.col("gain")
    return sums.select(*keys, "n", (F.round(bits, digits) + 0.0).alias("bits"))
