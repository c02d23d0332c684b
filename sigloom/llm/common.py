"""Shared pieces of the training-data operators: durable cuts of the lineage, size-checked joins, words and hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

#: Most rows of ids that are ever broadcast: 16 bytes each, some 30 MB as a hash relation.
BROADCAST_ROWS = 500_000
#: Most rows of an Arrow batch of texts, and bytes of texts, about, that a task takes apart at once.
BATCH_ROWS, SLICE = 2000, 3_000_000

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


_LOCAL: dict[str, str] = {}
#: Folders of cuts by application, oldest first; of each thread its own, so that no one removes what another still reads.
_MADE = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where that is unset, one of our own if all run on this machine; else none will do."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="sigloom-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return _LOCAL[app]


def folders(spark: SparkSession) -> list[str]:
    """Folders of cuts that this thread made in this session, oldest first."""
    return _MADE.__dict__.setdefault(spark.sparkContext.applicationId, [])


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in a folder of its own, which `release` removes."""
    folder = f"{shared_dir(spark)}/sigloom-{uuid.uuid4().hex}"
    folders(spark).append(folder)
    return f"{folder}/{name}"


def release(spark: SparkSession, since: int = 0, but: str = "") -> None:
    """Remove the folders of cuts that this thread made in this session, from the `since`th on, except one: for a caller who has written what needs them."""
    held = folders(spark)
    for folder in held[since:]:
        if folder != but:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    held[since:] = [but] if but in held[since:] else []


def made(spark: SparkSession) -> int:
    """How many folders of cuts this thread has in this session."""
    return len(folders(spark))


def keep_last(spark: SparkSession, since: int) -> None:
    """Remove the folders of cuts from the `since`th on, except the last one."""
    release(spark, since, folders(spark)[-1])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a function like `cut`, whose last result stays; all other cuts made inside go at the end."""
    since, kept = made(spark), [""]

    def last(df: DataFrame, name: str) -> DataFrame:
        out = cut(df, name)
        kept[0] = folders(spark)[-1]
        return out

    yield last
    release(spark, since, kept[0])


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let no Arrow batch of this session hold more than `rows` rows: a batch of texts is then some megabytes, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: later steps start from files that outlive any executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Row]:
    """df, cut, and its number of rows n and other aggregates, which are taken while it is written: no job of their own."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in measures.items())), name)
    return out, Row(**seen.get)


def by_ids(rows: DataFrame, ids: DataFrame, key: str, how: str, few: bool | None = None) -> DataFrame:
    """rows joined with distinct ids, which are cut before: broadcast if they are at most BROADCAST_ROWS, else shuffled. few: whether they are, if that is known."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS if few is None else few
    return rows.join(F.broadcast(ids) if few else ids.hint("merge"), key, how)


def sized(small: DataFrame, name: str) -> DataFrame:
    """small, cut, with a hint to broadcast it if it has at most BROADCAST_ROWS rows."""
    small, seen = measured(small, name)
    return F.broadcast(small) if seen.n <= BROADCAST_ROWS else small


def bounded_sample(rows: DataFrame, id_col: str, n: int, *ties: str) -> DataFrame:
    """The n rows of the smallest hashes of id_col (ties by the columns named), all if they are fewer.

    A cut of the hash that some 2 n rows pass goes first, so that no task sends more than its share of those.
    """
    share = min(1.0, 2 * n / max(1, rows.count()))
    h = F.pmod(F.xxhash64(id_col), F.lit(1 << 40))
    few = rows.where(h < int(share * (1 << 40)) + 1) if share < 1 else rows
    return few.orderBy(h, id_col, *ties).limit(n)


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs (start, end) of rows whose sizes add up to some `most`, one row at least, that cover all rows."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the well-known 64-bit finaliser)."""
    x = (x ^ (x >> _S33)) * _C1
    x = (x ^ (x >> _S33)) * _C2
    return x ^ (x >> _S33)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes, in order; of all of them, if they are fewer; none of none."""
    if not len(h):
        return h
    k_now = min(k, len(h))
    n = len(h) - k_now + 1
    out = np.full(n, k_now, np.uint64)
    for i in range(k_now):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): every node of edges (a, b: long) with the smallest node that it reaches.

    Each round maps a node to the smallest of its neighbours and itself and redraws the edges between the images;
    an edge survives unless both ends meet, so that nothing is lost, and the graph shrinks until no edge is left.
    The driver sees only edge counts. Hot nodes: partial minima before the shuffle, and joins that are broadcast while nodes are few, or that AQE can split.
    """
    edges, seen = measured(edges.select("a", "b").where("a != b").distinct(), "edges")
    labels = None
    while seen.n:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        to = sized(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m")), "parents")
        new = labels.join(to, labels.comp == to.n, "left").select("node", F.coalesce("m", "comp").alias("comp")) if labels is not None else to.select(F.col("n").alias("node"), F.col("m").alias("comp"))
        labels = cut(new, "labels")
        redrawn = edges.join(to.withColumnsRenamed({"n": "a", "m": "a2"}), "a").join(to.withColumnsRenamed({"n": "b", "m": "b2"}), "b")
        edges, seen = measured(redrawn.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a != b").distinct(), "edges")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return labels
