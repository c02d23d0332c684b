"""Scalar functions, fields and models on their edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import scalar as s
from sigloom.operators import fields
from sigloom.operators.neighbours import map_blocks
from sigloom.operators.ordered import ContextMixer, DecayedModes, LogitMixer, RunningLine
from sigloom.operators.quantise import bloom_build, bloom_probe, bloom_size, bloom_words, knn


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_colours_turn_back(spark):
    values = [0, 1, 2, 127, 128, 254, 255]
    df = spark.createDataFrame([(r, g, b) for r in values for g in values for b in values], "r int, g int, b int")
    back = s.from_ycocg(*s.to_ycocg(F.col("r"), F.col("g"), F.col("b")))
    assert df.where((back[0] != F.col("r")) | (back[1] != F.col("g")) | (back[2] != F.col("b"))).count() == 0
    for theta in (0.0, 0.3, -2.0, math.pi / 2):
        a, b = s.unrotate(*s.rotate(F.col("r"), F.col("g"), theta), theta)
        assert df.where((a != F.col("r")) | (b != F.col("g"))).count() == 0


def test_integers(spark):
    edge = [0, 1, -1, 2, -2, 2**30, -(2**30)] + [d * (2**k + e) for k in range(2, 30) for e in (-1, 0, 1) for d in (1, -1)]
    df = spark.createDataFrame([(v,) for v in edge], "v long")
    z = s.zigzag(F.col("v"))
    k, bits, extra = s.bucket(z)
    assert df.where((s.unzigzag(z) != F.col("v")) | (s.unbucket(k, extra) != z) | (bits != F.greatest(k - 1, F.lit(0)))).count() == 0
    assert [r[0] for r in spark.createDataFrame([(v,) for v in (0, 127, 128, 16383, 16384)], "v long").select(s.varint_bytes(F.col("v"))).collect()] == [1, 1, 2, 2, 3]
    assert [r[0] for r in spark.createDataFrame([(32767 + 1,), (-32769,), (5,)], "v int").select(s.wrap16(F.col("v"))).collect()] == [-32768, 32767, 5]


def test_hashes_and_bytes(spark):
    h = 2166136261
    for v in (104, 195, 169):
        h = (h ^ v) * 16777619 & 0xFFFFFFFF
    r = one(spark, h=s.fnv1a(s.utf8_bytes(F.lit("hé"))), b=s.utf8_bytes(F.lit("hé")))
    assert r.b == [104, 195, 169] and r.h == h


def test_hilbert_is_a_walk(spark):
    x, y = s.hilbert_xy(F.col("id").cast("int"), 16)
    at = [tuple(r) for r in spark.range(256).orderBy("id").select(x, y).collect()]
    assert len(set(at)) == 256 and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(at, at[1:], strict=False))


def test_numbers(spark):
    r = one(spark, soft=s.softmax(F.array(F.lit(1000.0), F.lit(1000.0))), p=s.sigmoid(s.logit(F.lit(0.3))), inf=s.ratio(F.lit(5), F.lit(0)), angle=s.givens_angle(F.lit(1.0), F.lit(0.0), F.lit(0.0)), near=s.nearest_prime(F.lit(9)), crt=s.from_residues(s.residues(F.lit(1154))))
    assert r.soft == [0.5, 0.5] and r.p == pytest.approx(0.3) and r.inf == math.inf and r.angle == 0 and r.near == 7 and r.crt == 1154
    sizes = spark.createDataFrame([(5,), (19712,), (2**21,)], "n long").select(s.size_text(F.col("n"))).collect()
    assert [v[0] for v in sizes] == ["5 B", "19.2 KB", "2.00 MB"]
    poly = one(spark, **{f"c{i}": c for i, c in enumerate(s.polynomial(F.lit(2.0), F.lit(3.0), 2))})
    assert sorted(poly) == [1, 2, 3, 4, 6, 9]


def test_filters_and_wavelets():
    rng = np.random.default_rng(0)
    v, k = rng.integers(0, 9, (7, 8)), rng.integers(0, 5, (3, 2))
    out = fields.correlate_valid(v, k)
    assert out.shape == (5, 7) and out[2, 3] == (v[2:5, 3:5] * k).sum()
    w = rng.integers(0, 9, out.shape)
    assert (out * w).sum() == (v * fields.convolve_full(w, k)).sum()  # adjoint
    x = rng.normal(size=(8, 8))
    assert np.allclose((fields.db2(x) ** 2).sum(), (x**2).sum())
    assert np.allclose(fields.fourier_top(x, 64)[0], x)
    assert fields.box_down(np.array([[1, 2], [2, 1]]), 2)[0, 0] == 2 and fields.pad_to(np.ones((3, 5)), 4).shape == (4, 8)
    ramp = np.add.outer(3 * np.arange(8), 5 * np.arange(8))
    assert (fields.local_fit(ramp)[4:, 4:] == ramp[4:, 4:]).all()
    assert fields.edge_direction(np.tile(np.arange(8) * 9, (8, 1))) == (1, 0)
    mask = np.zeros((16, 16))
    mask[4:12, 4:12] = 1
    mixed = fields.composite(np.full((16, 16), 200), np.zeros((16, 16)), mask)
    assert mixed[8, 8] == 200 and mixed[0, 0] == 0
    noise = fields.gradient_noise(16, 16, 4, 1)
    assert np.allclose(noise[::4, ::4], 0) and fields.cell_distance(3, 3, np.array([[0.0, 0.0]]))[0, 0] == 0


def test_online_models():
    m = DecayedModes(3)
    m.learn(10, [10, 0, 9])
    assert m.best() == 0 and m.blend([10, 0, 9]) >= 9
    line = RunningLine()
    for i in range(150):
        line.learn(i, 2 * i + 3)
    assert line.predict(200) == 403 and RunningLine().predict(7) == 7
    logit = LogitMixer(2)
    for _ in range(200):
        logit.mix([0.9, 0.2])
        logit.learn(1)
    assert logit.mix([0.9, 0.2]) > 0.8
    c = ContextMixer(2, 2)
    for _ in range(100):
        c.learn(1, [5, 50], 5)
    assert c.predict(1, [5, 50]) < 10 and c.predict(0, [5, 51]) == 28


def test_neighbours_search(spark):
    rows = [(0, [0, 0]), (20, [0, 1]), (1, [0, 0]), (2, [3, 4]), (3, [0, 0])]
    df = spark.createDataFrame(rows, "vec_id long, vec array<int>")
    got = sorted(map(tuple, knn(df, df.where("vec_id % 20 = 0"), 2).collect()))
    assert got == [(0, 1, 1, 0), (0, 2, 3, 0), (20, 1, 0, 1), (20, 2, 1, 1)]
    flat = spark.createDataFrame([(1, [7] * 64)], "vec_id long, vec array<int>")
    assert map_blocks(flat, lambda ids, v: {"vec_id": ids, "s": v.sum((1, 2))}, "vec_id long, s long").first().s == 448
    assert map_blocks(flat.limit(0), lambda ids, v: {"vec_id": ids}, "vec_id long").count() == 0


def test_membership(spark):
    m, k = bloom_size(50, 0.01)
    items = spark.createDataFrame([(f"item {i}",) for i in range(50)], "t string")
    others = spark.createDataFrame([(f"other {i * 7}",) for i in range(500)], "t string")
    built = bloom_build(items, "t", m, k)
    words = bloom_words(built, m)
    assert sum(bin(w & (1 << 64) - 1).count("1") for w in words) == built.count()
    assert bloom_probe(items, "t", words, m, k).where("not maybe").count() == 0
    assert bloom_probe(others, "t", words, m, k).where("maybe").count() < 25
