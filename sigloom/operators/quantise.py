"""Vector quantisation, nearest neighbours, hash buckets and set membership, over arrays of integers.

Integer centroids, planes and distances make every result exact. Codebooks, planes and kernels are literals of a size that the caller
fixes; sets of queries travel in blocks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that go to the tasks at once.
QUERY_BLOCK = 10_000


def _numpy(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)


def _near(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, squared distance) of each vector: the first of the nearest."""
    d2 = (v * v).sum(1)[:, None] - 2 * v @ book.T + (book * book).sum(1)
    code = d2.argmin(1)
    return code, d2[np.arange(len(v)), code]


def assign(vectors: DataFrame, codebook: np.ndarray, key: str = "vec_id") -> DataFrame:
    """(key, code, d2): the nearest code by squared distance, the first of equals (K03). No exchange."""
    book = codebook.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, d2 = _near(_numpy(batch, 1), book)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code.astype(np.int32)), pa.array(d2)], [key, "code", "d2"])

    return vectors.select(key, "vec").mapInArrow(run, f"{key} long, code int, d2 long")


def first_vectors(vectors: DataFrame, k: int, key: str = "vec_id", skip: int = 0) -> np.ndarray:
    """The vectors of the k smallest keys after `skip` others, as the seeds of a codebook."""
    return np.array([r.vec for r in vectors.orderBy(key).limit(k + skip).select("vec").collect()[skip:]], np.int64)


def lloyd(vectors: DataFrame, codebook: np.ndarray, steps: int) -> np.ndarray:
    """Centroids after so many Lloyd steps, rounded half to even each; an empty cell keeps its centroid (K01, K02). Ends when none moves.

    A step is one pass: tasks give out sums and counts of their cells, k rows for each place of the vectors, which are added up.
    """
    book = codebook.astype(np.int64)
    for _ in range(steps):
        k, dim = book.shape

        def run(batches: Iterator[pa.RecordBatch], book: np.ndarray = book) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
            for batch in batches:
                if batch.num_rows:
                    v = _numpy(batch, 0)
                    code, _ = _near(v, book)
                    np.add.at(sums, code, v)
                    counts += np.bincount(code, minlength=len(book))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, book.shape[1])), pa.array(np.tile(np.arange(book.shape[1]), len(some))), pa.array(sums[some].ravel()), pa.array(np.repeat(counts[some], book.shape[1]))], ["code", "place", "s", "n"])

        parts = vectors.select("vec").mapInArrow(run, "code long, place long, s long, n long")
        new = book.copy()
        for r in parts.groupBy("code", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
            q, rest = divmod(r.s, r.n)
            new[r.code, r.place] = q + (2 * rest > r.n or (2 * rest == r.n and q % 2))
        if (new == book).all():
            break
        book = new
    return book


def spread_vectors(vectors: DataFrame, k: int, key: str = "vec_id") -> np.ndarray:
    """Seeds by squared distance (K01): first the vector of the smallest key, then each next one drawn with a chance in proportion to its
    squared distance to the nearest seed so far. The draw is the least of -ln(u) / d2 over all vectors, u a fixed share of the key and the
    turn, so that it is one pass a seed, the same however the table is split."""
    seeds = first_vectors(vectors, 1, key)
    for turn in range(1, k):
        u = ((F.pmod(F.col(key) * 7919 + turn * 104729, F.lit(65537)) + 1) / 65538.0).alias("u")
        near = assign(vectors, seeds, key).select(key, "d2", u).where("d2 > 0")
        first = near.orderBy((-F.ln("u") / F.col("d2")), key).limit(1).collect()
        if not first:
            break
        seeds = np.vstack([seeds, vectors.where(F.col(key) == first[0][0]).select("vec").first().vec])
    return seeds


def residuals(vectors: DataFrame, codebook: np.ndarray, key: str = "vec_id") -> DataFrame:
    """(key, code, vec): each vector less its code's."""
    book = codebook.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _numpy(batch, 1)
                code, _ = _near(v, book)
                left = v - book[code]
                lists = pa.ListArray.from_arrays(np.arange(0, left.size + 1, left.shape[1], dtype=np.int32), pa.array(left.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code.astype(np.int32)), lists], [key, "code", "vec"])

    return vectors.select(key, "vec").mapInArrow(run, f"{key} long, code int, vec array<int>")


def _squares(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (q * q).sum(1)[:, None] - 2 * q @ v.T + (v * v).sum(1)


def _absolutes(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return sum(np.abs(q[:, i, None] - v[:, i]) for i in range(q.shape[1]))


def _greatest(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return functools.reduce(np.maximum, (np.abs(q[:, i, None] - v[:, i]) for i in range(q.shape[1])))


#: Distances of all queries from all vectors: squared Euclidean, sum and greatest of absolute differences.
METRICS = {"squares": _squares, "absolutes": _absolutes, "greatest": _greatest}


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", metric: str = "squares") -> DataFrame:
    """(q, rnk, id, d2): exact nearest neighbours, ties to the smaller id (K09, K10, R09); a row is none of its own. d2: the distance by `metric`.

    Queries go out in blocks; every task returns k rows a query, and one window picks among the tasks'.
    """
    kind = "q long, id long, d2 long"
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        held = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).orderBy(key).select(key, "vec").collect()
        ids, q = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64)

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            who, near, far = (np.empty(0, np.int64) for _ in range(3))
            least = np.full(len(ids), np.iinfo(np.int64).max)  # distance of the k-th so far
            for batch in batches:
                for a in range(0, batch.num_rows if len(ids) else 0, 4096):
                    part = batch.slice(a, 4096)
                    v, own = _numpy(part, 1), part.column(0).to_numpy(zero_copy_only=False)
                    d = METRICS[metric](q, v)
                    d[ids[:, None] == own] = np.iinfo(np.int64).max
                    border = np.minimum(least, np.partition(d, k - 1, 1)[:, k - 1]) if d.shape[1] > k else least
                    rows, cols = np.nonzero((d <= border[:, None]) & (d < np.iinfo(np.int64).max))
                    who, near, far = np.append(who, rows), np.append(near, own[cols]), np.append(far, d[rows, cols])
                    order = np.lexsort((near, far, who))
                    who, near, far = who[order], near[order], far[order]
                    rank = np.arange(len(who)) - np.searchsorted(who, who)
                    least[who[rank == k - 1]] = far[rank == k - 1]
                    who, near, far = who[rank < k], near[rank < k], far[rank < k]
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(near), pa.array(far)], ["q", "id", "d2"])

        found = vectors.select(key, "vec").mapInArrow(run, kind)
        out = found if out is None else out.union(found)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d2", "id"))
    return out.withColumn("rnk", rank).where(F.col("rnk") <= k).select("q", "rnk", "id", "d2")


def plane_signs(table: int, bits: int, dim: int) -> list[list[int]]:
    """+1 and -1 planes by a rule, so that SQL can state them too: -1 where (i * 7 + b * 13 + t * 29 + i * b) mod 11 is odd."""
    return [[-1 if (i * 7 + b * 13 + table * 29 + i * b) % 11 % 2 else 1 for i in range(dim)] for b in range(bits)]


def lsh_buckets(vectors: DataFrame, tables: int = 4, bits: int = 8, centre: int = 128, key: str = "vec_id") -> DataFrame:
    """(key, tbl, bucket): signs of the projections on fixed planes (K11), as one column expression."""
    dim = len(plane_signs(0, 1, 64)[0])

    def bucket(t: int) -> Column:
        out = F.lit(0)
        for b, plane in enumerate(plane_signs(t, bits, dim)):
            weights = F.array(*map(F.lit, plane))
            dot = F.aggregate(F.zip_with("vec", weights, lambda v, w: (v - centre) * w), F.lit(0), lambda a, x: a + x)
            out = out + F.when(dot > 0, 1 << b).otherwise(0)
        return out

    return vectors.select(key, F.posexplode(F.array(*(bucket(t) for t in range(tables)))).alias("tbl", "bucket"))


def bloom_size(items: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) of a filter for so many items."""
    m = int(-items * math.log(rate) / math.log(2) ** 2)
    return m, max(1, int(m / items * math.log(2)))


def _double_hash(words: pa.Array, m: int, k: int) -> np.ndarray:
    """(words, k) places in a filter of m bits: xor-multiply and times-31 hashes of the UTF-8 bytes, byte by byte over all words at once."""
    data = words.cast(pa.binary()).fill_null(b"")
    sizes = np.array([len(w) for w in data.to_pylist()], np.int64)
    flat = np.frombuffer(b"".join(data.to_pylist()), np.uint8).astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    h1, h2, low = np.full(len(sizes), 2166136261, np.uint64), np.full(len(sizes), 16777619, np.uint64), np.uint64(0xFFFFFFFF)
    on = np.flatnonzero(sizes > 0)
    j = 0
    while len(on):
        byte = flat[first[on] + j]
        h1[on] = (h1[on] ^ byte) * np.uint64(16777619) & low
        h2[on] = h2[on] * np.uint64(31) + byte & low
        j += 1
        on = on[sizes[on] > j]
    return ((h1[:, None] + np.arange(k, dtype=np.uint64) * h2[:, None]) % np.uint64(m)).astype(np.int64)


def bloom_bits(items: DataFrame, text: str, m: int, k: int) -> DataFrame:
    """items with bits: the k places of each in a filter of m bits, by double hashing (C14)."""

    def places(words: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(len(words) + 1, dtype=np.int32) * k, pa.array(_double_hash(words, m, k).ravel()))

    return items.withColumn("bits", F.arrow_udf(places, "array<bigint>")(F.col(text)))


def bloom_build(items: DataFrame, text: str, m: int, k: int) -> DataFrame:
    """(bit): the places that are set."""
    return bloom_bits(items, text, m, k).select(F.explode("bits").alias("bit")).distinct()


def bloom_words(built: DataFrame, m: int) -> list[int]:
    """The filter as words of 64 bits on the driver: m / 8 bytes, which bloom_size bounds by the number of items."""
    words = built.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("v")).collect()
    out = [0] * (m // 64 + 1)
    for r in words:
        out[r.word] = r.v
    return out


def bloom_probe(items: DataFrame, text: str, words: list[int], m: int, k: int) -> DataFrame:
    """items with maybe: whether all places of each are set in a filter of bloom_words. No exchange: the filter goes with the tasks."""
    held = np.array([w & 0xFFFFFFFFFFFFFFFF for w in words], np.uint64)

    def probe(asked: pa.Array) -> pa.Array:
        at = _double_hash(asked, m, k)
        return pa.array(((held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(1))

    return items.withColumn("maybe", F.arrow_udf(probe, "boolean")(F.col(text)))


def lsh_search(vectors: DataFrame, queries: DataFrame, k: int, tables: int = 8, bits: int = 8, key: str = "vec_id") -> DataFrame:
    """(q, rnk, id, d2): of the vectors that share a bucket with a query in some table the k nearest, exactly ranked, ties to the smaller id.

    An equi-join on (table, bucket), pairs once each; both vectors join the pairs afterwards, as buckets carry keys only.
    """
    buckets = lambda df: lsh_buckets(df, tables, bits, key=key)
    asked = buckets(queries).withColumnRenamed(key, "q")
    pairs = asked.join(buckets(vectors).withColumnRenamed(key, "id"), ["tbl", "bucket"]).where("q != id").select("q", "id").distinct()
    both = pairs.join(queries.select(F.col(key).alias("q"), F.col("vec").alias("qv")), "q").join(vectors.select(F.col(key).alias("id"), "vec"), "id")
    d2 = F.aggregate(F.zip_with("vec", "qv", lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda a, x: a + x)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d2", "id"))
    return both.select("q", "id", d2.alias("d2")).withColumn("rnk", rank).where(F.col("rnk") <= k).select("q", "rnk", "id", "d2")
