"""Shared pieces: components, bounded samples, size-checked joins, hashes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import common


def find_components(edges):
    up = {}

    def find(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {i: find(i) for i in up}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "loops", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(3)
    ids = rng.permutation(400).tolist()
    edges = {
        "chain": list(zip(ids, ids[1:], strict=False)), "star": [(ids[0], i) for i in ids[1:]], "random": [tuple(map(int, rng.integers(0, 400, 2))) for _ in range(220)],
        "loops": [(5, 5), (5, 6), (6, 5), (5, 6)], "none": [],
    }[shape]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = find_components([(a, b) for a, b in edges if a != b])
    assert got == want


def test_bounded_sample(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    a = [tuple(r) for r in common.bounded_sample(rows, "id", 100).collect()]
    b = [tuple(r) for r in common.bounded_sample(rows.repartition(7), "id", 100).collect()]
    assert a == b and len(set(a)) == 100
    assert common.bounded_sample(rows.limit(3), "id", 100).count() == 3 and common.bounded_sample(rows.limit(0), "id", 5).count() == 0


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    ids = spark.range(40).select((F.col("id") * 2).alias("doc_id"))
    few = common.by_ids(docs, ids, "doc_id", "left_anti")
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    many = common.by_ids(docs, ids, "doc_id", "left_anti")
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan(few) and "SortMergeJoin" in plan(many)
    assert sorted(r.doc_id for r in few.collect()) == sorted(r.doc_id for r in many.collect()) and few.count() == 60


def test_gram_hashes():
    h = common.word_hashes([b"a", b"b", b"a", b"b", b"c"])
    g = common.gram_hashes(h, 2)
    assert len(g) == 4 and g[0] == g[2] and len(set(g.tolist())) == 3
    assert len(common.gram_hashes(h[:2], 4)) == 1 and len(common.gram_hashes(h[:0], 4)) == 0


def test_cuts_are_removed(spark):
    import os

    from pyspark.sql import functions as F

    since = common.made(spark)
    folders = lambda: common.folders(spark)
    common.cut(spark.range(5), "a")
    with common.scratch(spark) as last:
        common.cut(spark.range(5), "b")
        kept = last(spark.range(7).select(F.col("id") * 2), "c")
        common.cut(spark.range(5), "d")
    assert kept.count() == 7 and common.made(spark) == since + 2 and all(os.path.isdir(f) for f in folders()[since:])
    before = folders()[since:]
    common.cut(spark.range(3), "e")
    common.keep_last(spark, since)
    assert common.made(spark) == since + 1 and not any(os.path.exists(f) for f in before)
    common.release(spark, since)
    assert common.made(spark) == since


def test_shared_folder_is_demanded_of_clusters(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "x"

    with pytest.raises(ValueError):
        common.shared_dir(Elsewhere)


def test_slices():
    assert list(common.slices(np.array([5, 1, 1, 9, 2]), 6)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(common.slices(np.array([], int), 6)) == [] and list(common.slices(np.array([0, 0]), 6)) == [(0, 2)]
