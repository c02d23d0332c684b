"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors centred on a sample's mean and turned by learned rotations (alternating sign codes and orthogonal Procrustes steps, from
TURNS random starts); the signs are the bits, those of one rotation a substring. Codes are longer than the vectors, as bits of several
rotations tell near from far where those of one don't. A table maps the values of each substring to the rows that have it. If two codes
differ in at most r bits, some substring differs in at most r // TURNS: probing all values that near retrieves every code within r.
These are compared by their vectors. The radius covers the wanted share of the true neighbours, over all rows, of a few sampled ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.common import bounded_sample, cut, shared_path

#: Rows that rotations are learned from, those of the smallest hashes of vec_id; and how many of them the radius is learned from.
SAMPLE, TRIED = 4096, 128
#: Rotations: substrings of a code.
TURNS = 4
#: Queries that are sent to the tasks at once, in expectation.
BLOCK = 16_384
#: Rows of a task that are indexed at once.
CHUNK = 32_768


@dataclass(frozen=True)
class Coder:
    mean: np.ndarray
    turns: np.ndarray

    @property
    def bits(self) -> int:
        return self.turns.shape[0] * self.turns.shape[2]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, substrings, words of 64 bits): a bit per dimension of each rotated space."""
        pad = -self.turns.shape[2] % 64
        out = np.empty((len(x), len(self.turns), (self.turns.shape[2] + pad) // 64), np.uint64)
        for j, turn in enumerate(self.turns):
            bits = np.packbits((x - self.mean) @ turn > 0, axis=1)
            out[:, j] = np.pad(bits, ((0, 0), (0, out.shape[2] * 8 - bits.shape[1]))).view(np.uint64)
        return out


def fit_coder(x: np.ndarray, turns: int = TURNS, steps: int = 30, seed: int = 5) -> Coder:
    """Learn from a sample."""
    d = x.shape[1] if x.ndim == 2 else 0
    if len(x) < 2:
        return Coder(np.zeros(d), np.repeat(np.eye(d)[None], turns, 0))
    mean = x.mean(0)
    c = x - mean
    axes = np.linalg.eigh(np.cov(c.T).reshape(d, d))[1][:, ::-1]
    v, found, rng = c @ axes, [], np.random.default_rng(seed)
    for _ in range(turns):
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(steps):
            u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        found.append(axes @ turn)
    return Coder(mean, np.stack(found))


class Index:
    """Substring tables over codes: of each substring the rows by its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for j in range(codes.shape[1]):
            words = np.ascontiguousarray(codes[:, j])
            order = np.lexsort(words.T)
            at = words[order]
            first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]).any(1))) if len(at) else np.empty(0, int)
            self.tables.append((order, at[first], np.append(first, len(order))))

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows that the probes meet: some substring is as near as a code within radius must have one."""
        m = len(self.tables)
        hit = np.zeros(len(self.codes), bool)
        for j, (order, values, first) in enumerate(self.tables):
            allowed = radius // m if j <= radius % m else radius // m - 1
            if allowed < 0:
                continue
            near = np.flatnonzero(np.bitwise_count(values ^ code[j]).sum(1, dtype=np.int64) <= allowed)
            if len(values) == len(order):
                hit[order[near]] = True
            else:
                for b in near:
                    hit[order[first[b] : first[b + 1]]] = True
        return np.flatnonzero(hit)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from code in at most radius bits: pigeonhole probes, then the distance itself."""
        rows = self.probed(code, radius)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum((1, 2), dtype=np.int64) <= radius]


def _usable(df: DataFrame) -> DataFrame:
    """vec_id and the vector in doubles; without null, zero and non-finite ones and those of another length than most."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    zero = F.forall(e, lambda v: v == 0)
    return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", e.alias("v")).where(~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(True)))


def _coded(coder: Coder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = coder.codes(_matrix(batch.column(1), batch.num_rows)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "v", "code"])

    return run


def _matrix(vectors: pa.Array, rows: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _best(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, k: int, candidates: Callable[[Index, int], np.ndarray] | None):
    """Of a task's coded rows the k nearest to each query, with the distance of the codes; candidates: the rows of an index to compare
    with a query's vector, all if it is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        best = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)

        def merge() -> None:
            own_ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
            x = np.concatenate([_matrix(b.column(1), b.num_rows) for b in held])
            own = np.frombuffer(b"".join(c for b in held for c in b.column(2).to_pylist()), np.uint64).reshape(len(x), *codes.shape[1:])
            index = Index(own) if candidates else None
            norms = (x * x).sum(1) if not candidates else None
            for q in range(len(ids)):
                near = candidates(index, q) if candidates else _lowest(norms - 2 * (x @ vectors[q]), k + int((own_ids == ids[q]).sum()))
                near = near[own_ids[near] != ids[q]]
                if not len(near):
                    continue
                dist = np.sqrt(((x[near] - vectors[q]) ** 2).sum(1))
                dist, who = np.concatenate([best[q][0], dist]), np.concatenate([best[q][1], own_ids[near]])
                far = np.concatenate([best[q][2], np.bitwise_count(own[near] ^ codes[q]).sum((1, 2), dtype=np.int64)])
                order = _first(dist, who, k)
                best[q] = (dist[order], who[order], far[order])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= CHUNK:
                merge()
                held, rows = [], 0
        if rows:
            merge()
        for a in range(0, len(ids), 1000):
            part = best[a : a + 1000]
            cols = [np.repeat(ids[a : a + 1000], [len(b[0]) for b in part]), *(np.concatenate([b[i] for b in part]) for i in (1, 0, 2))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score", "far"])

    return run


def _lowest(near: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k smallest values and those that rounding might have put behind them."""
    if len(near) <= k:
        return np.arange(len(near))
    border = np.partition(near, k - 1)[k - 1]
    return np.flatnonzero(near <= border + 1e-9 * max(1.0, float(np.abs(near).max())))


def _first(dist: np.ndarray, who: np.ndarray, k: int) -> np.ndarray:
    if len(dist) <= 4 * k:
        return np.lexsort((who, dist))[:k]
    border = np.partition(dist, k - 1)[k - 1]
    rows = np.flatnonzero(dist <= border)
    return rows[np.lexsort((who[rows], dist[rows]))[:k]]


def _top(coded: DataFrame, held: list, coder: Coder, k: int, radius: int | None) -> DataFrame:
    """(query_id, vec_id, score, far, rank) of the k nearest to each of the rows held, among codes within radius; among all if it is None."""
    ids, vectors = np.array([r.vec_id for r in held], np.int64), np.array([r.v for r in held])
    codes = coder.codes(vectors)
    found = coded.mapInArrow(_best(ids, vectors, codes, k, None if radius is None else lambda index, q: index.within(codes[q], radius)), "query_id long, vec_id long, score double, far long")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10, sample: int = SAMPLE, recall: float = 0.97) -> DataFrame:
    """Per query (vec_id divisible by `every`) its k nearest by Euclidean distance: query_id, rank, vec_id, score.

    Ties go to the smaller vec_id. Rows of the query's own vec_id are never candidates; rows that repeat another vec_id are all
    candidates; of a repeated query the smallest vector counts. Neighbours beyond the radius of the codes are missed, 1 - recall of them
    in expectation; a query that has fewer than k rows within the radius is compared with all rows, so that k (or all) are always
    found. Null, zero and non-finite vectors, and those whose length isn't the most common, take no part. Rows are coded once, in the
    shared folder; queries go to the tasks in blocks of bounded size, one after the other, and a task returns k rows per query.
    """
    spark = embeddings.sparkSession
    rows = _usable(embeddings)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == sizes[0].d)
    some = bounded_sample(rows, "vec_id", sample, "v").collect()
    coder = fit_coder(np.array([r.v for r in some]))
    coded = cut(rows.mapInArrow(_coded(coder), "vec_id long, v array<double>, code binary"), "coded")
    tried = list({r.vec_id: r for r in some[:TRIED]}.values())
    far = [r.far for r in _top(coded, tried, coder, k, None).select("far").collect()]
    radius = int(np.quantile(far, recall, method="higher")) if far else 0
    queries = cut(coded.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = -(-queries.count() // BLOCK)
    path = shared_path(spark, "nearest")
    kind, again = "query_id long, rank int, vec_id long, score double", False
    for b in range(blocks):
        held = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        if not held:
            continue
        found = _top(coded, held, coder, k, radius)
        found.select("query_id", "rank", "vec_id", "score").write.parquet(f"{path}/near/block={b}")
        whole = spark.read.schema(kind).parquet(f"{path}/near/block={b}").where(F.col("rank") == k).select("query_id")
        lacking = {r.vec_id for r in held} - {r.query_id for r in whole.collect()}
        if lacking:
            again = True
            _top(coded, [r for r in held if r.vec_id in lacking], coder, k, None).select("query_id", "rank", "vec_id", "score").write.parquet(f"{path}/all/block={b}")
    if not blocks:
        return spark.createDataFrame([], kind)
    near = spark.read.schema(kind).parquet(f"{path}/near").select("query_id", "rank", "vec_id", "score")
    if not again:
        return near
    exact = spark.read.schema(kind).parquet(f"{path}/all").select("query_id", "rank", "vec_id", "score")
    return near.join(exact.select("query_id").distinct(), "query_id", "left_anti").union(exact)
