"""Queries over 8 x 8 blocks (embeddings as pixels), each with the SQL that gives the same rows."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions.predictors import block_modes, context_features, frame_modes, lookup_context, magnitude_level, median_edge, mixer_context
from sigloom.functions.scalar import fnv1a, hilbert_xy, uniform_codes, zigzag
from sigloom.operators import linalg
from sigloom.operators.codecs import decode_buckets, decode_in_contexts, decode_residuals, decode_shifted, encode_buckets, encode_in_contexts, encode_residuals, encode_shifted, huffman_decode, huffman_encode, zigzag as zigzag_int, unzigzag
from sigloom.operators.containers import pack_palette, pack_planes, pack_svd, unpack_palette, unpack_planes
from sigloom.operators.entropy import entropy, entropy_of, frequencies, total_bits
from sigloom.operators.neighbours import block_predictions, haar, map_blocks, shifted, with_neighbours
from sigloom.operators.quantise import assign, first_vectors, knn, lloyd, lsh_buckets, lsh_search, plane_signs, residuals, spread_vectors
from sigloom.sources.signals import blocks, pixels

NAMES = ("left", "above", "ul", "ur", "left2", "above2")


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(pixels(spark, sf_dir))


def _modes(df: DataFrame) -> list:
    return list(block_modes(*(F.col(n) for n in NAMES)).values())


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, best: struct<sad, mode_idx>): one exchange, for the window; the aggregation shares its key."""
    near = _near(spark, sf_dir)
    sads = near.groupBy("vec_id").agg(*(F.sum(F.abs(F.col("v") - p)).alias(f"s{i}") for i, p in enumerate(_modes(near))))
    least = F.array_min(F.array(*(F.struct(F.col(f"s{i}").alias("sad"), F.lit(i).alias("mode_idx")) for i in range(9))))
    return sads.select("vec_id", least.alias("best"))


def block_mode_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).groupBy(F.col("best.mode_idx").alias("mode_idx")).agg(F.count("*").alias("blocks"), F.sum("best.sad").alias("sad"))


def block_mode_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("vec_id", "best.mode_idx", "best.sad")


def block_mode_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same choice as block_mode_grid by the NumPy kernel: no exchange."""

    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        sads = np.stack([np.abs(v - p).sum((1, 2)) for p in block_predictions(v.astype(np.int64))])
        return {"vec_id": ids, "mode_idx": sads.argmin(0).astype(np.int32), "sad": sads.min(0)}

    return map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, mode_idx int, sad long")


def _long(df: DataFrame) -> DataFrame:
    """A row per pixel and mode."""
    return df.select("vec_id", "p", F.posexplode(F.array(*(F.col("v") - m for m in _modes(df)))).alias("mode_idx", "r"))


def pixel_oracle_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _near(spark, sf_dir)
    least = F.array_min(F.array(*(F.struct(F.abs(F.col("v") - m).alias("e"), F.lit(i).alias("mode_idx")) for i, m in enumerate(_modes(near)))))
    return near.select(least.alias("b")).groupBy(F.col("b.mode_idx").alias("mode_idx")).agg(F.count("*").alias("pixels"), F.sum("b.e").alias("abs_err"))


def implicit_mode_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes chosen by the squared errors of the left and the upper neighbour (W09): no side information."""
    zero = with_neighbours(pixels(spark, sf_dir), border=0)
    modes = frame_modes(F.col("left"), F.col("above"), F.col("ul"), F.col("y") == 0, F.col("x") == 0)
    errors = zero.select("vec_id", "p", "x", "y", "v", *(m.alias(f"m{i}") for i, m in enumerate(modes.values())))
    w = Window.partitionBy("vec_id").orderBy("p")
    square = lambda i: (F.col("v") - F.col(f"m{i}")) * (F.col("v") - F.col(f"m{i}"))
    cost = lambda i: F.when(F.col("x") > 0, F.lag(square(i), 1).over(w)).otherwise(0) + F.when(F.col("y") > 0, F.lag(square(i), 8).over(w)).otherwise(0)
    costs = errors.select("v", *(F.col(f"m{i}") for i in range(6)), *(cost(i).alias(f"c{i}") for i in range(6)))
    best = F.array_min(F.array(*(F.struct(F.col(f"c{i}").alias("c"), F.lit(i).alias("mode_idx"), F.col(f"m{i}").alias("m")) for i in range(6))))
    return costs.select("v", best.alias("b")).groupBy(F.col("b.mode_idx").alias("mode_idx")).agg(F.count("*").alias("pixels"), F.sum(F.abs(F.col("v") - F.col("b.m"))).alias("abs_err"))


def med_residual_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _near(spark, sf_dir)
    med = F.when((F.col("x") == 0) & (F.col("y") == 0), F.lit(128)).when(F.col("y") == 0, F.col("left")).when(F.col("x") == 0, F.col("above")).otherwise(median_edge(F.col("left"), F.col("above"), F.col("ul")))
    return near.groupBy((F.col("v") - med).alias("residual")).agg(F.count("*").alias("cnt"))


def residual_entropy_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _long(_near(spark, sf_dir)).select("mode_idx", zigzag(F.col("r")).alias("sym"))
    return entropy(r, ["mode_idx"]).select("mode_idx", "bps")


def predictor_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.orderBy("bps", "mode_idx"))
    return residual_entropy_by_mode(spark, sf_dir).withColumn("rnk", rank)


def context_features_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _near(spark, sf_dir)
    f = context_features(*(F.col(n) for n in ("left", "above", "ul", "left2", "above2")))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), v.cast("int").alias("value")) for k, v in f.items())))
    return near.select(pairs.alias("f")).groupBy("f.feature").agg(F.min("f.value").alias("min_v"), F.max("f.value").alias("max_v"), F.sum("f.value").alias("sum_v"))


def _gradient_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _near(spark, sf_dir).select("vec_id", "p", "x", "y", (F.col("v") - (F.col("left") + F.col("above") - F.col("ul"))).alias("r"))
    w = Window.partitionBy("vec_id").orderBy("p")
    at = lambda n, c: F.when(F.col(c) > 0, F.abs(F.lag("r", n).over(w))).otherwise(0)
    return near.select("r", (magnitude_level(at(1, "x")) * 8 + magnitude_level(at(8, "y"))).alias("ctx"))


def residual_context_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return total_bits(_gradient_residuals(spark, sf_dir), ["ctx"], "r")


def mixer_context_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).groupBy(mixer_context(F.col("left"), F.col("above"), F.col("ul")).alias("ctx")).agg(F.count("*").alias("n"))


def lookup_table_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = lookup_context(F.col("left"), F.col("above"), F.col("ul"), 6)
    return _near(spark, sf_dir).groupBy(ctx.alias("ctx")).agg(F.count("*").alias("n"), F.bround(F.avg("v")).cast("int").alias("pred"))


def block_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, variance, grad2, coherence) of blocks (W15), rounded."""
    return _coherence(spark, sf_dir).select("vec_id", F.round("variance", 4).alias("variance"), F.round("grad2", 4).alias("grad2"), F.round("coherence", 4).alias("coherence"))


def _coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _near(spark, sf_dir)
    dx, dy = F.when(F.col("x") > 0, F.col("v") - F.col("left")), F.when(F.col("y") > 0, F.col("v") - F.col("above"))
    agg = near.groupBy("vec_id").agg(
        F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("s2"), F.sum(dx).alias("gx"), F.sum(dx * dx).alias("gx2"), F.sum(dy).alias("gy"), F.sum(dy * dy).alias("gy2")
    )
    grad2 = (F.col("gx2") + F.col("gy2")) / 56.0
    mean2 = (F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) / 3136.0
    return agg.select("vec_id", ((F.col("s2") * 64 - F.col("s") * F.col("s")) / 4096.0).alias("variance"), grad2.alias("grad2"), F.when(grad2 > 1, F.sqrt(mean2 / grad2)).otherwise(0.0).alias("coherence"))


def block_region_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by variance and coherence (M05); the thresholds suit the spread of these blocks."""
    region = F.when(F.col("variance") < 150, "smooth").when(F.col("coherence") > 0.25, "edge").when(F.col("variance") < 250, "textured").otherwise("complex")
    return _coherence(spark, sf_dir).groupBy(region.alias("region")).agg(F.count("*").alias("blocks"))


def smooth_block_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of 1, x, y, xy per block in closed form (M06): the centred terms are orthogonal."""
    x, y = F.col("x") - 3.5, F.col("y") - 3.5
    sums = pixels(spark, sf_dir).groupBy("vec_id").agg(F.sum("v").alias("s"), F.sum(x * F.col("v")).alias("sx"), F.sum(y * F.col("v")).alias("sy"), F.sum(x * y * F.col("v")).alias("sxy"))
    c3 = F.col("sxy") / 1764.0
    c1, c2 = F.col("sx") / 336.0 - c3 * 3.5, F.col("sy") / 336.0 - c3 * 3.5
    c0 = F.col("s") / 64.0 - c1 * 3.5 - c2 * 3.5 - c3 * 12.25
    return sums.select("vec_id", *((F.round(c, 4) + 0.0).alias(f"c{i}") for i, c in enumerate((c0, c1, c2, c3))))


def quadtree_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, level, cost): 8 bytes and the entropy of what the mean leaves, over the squares of side 8, 4 and 2."""
    px = pixels(spark, sf_dir).select("vec_id", "v", F.explode(F.array(F.struct(F.lit(8).alias("level"), F.lit(0).alias("sub")), *(F.struct(F.lit(s).alias("level"), (F.floor(F.col("y") / s) * 8 + F.floor(F.col("x") / s)).cast("int").alias("sub")) for s in (4, 2)))).alias("l"))
    px = px.select("vec_id", "l.level", "l.sub", "v")
    mean = F.bround(F.avg("v").over(Window.partitionBy("vec_id", "level", "sub"))).cast("int")
    counts = frequencies(px.withColumn("r", F.col("v") - mean), ["vec_id", "level", "sub"], "r")
    bits, _ = entropy_of()
    each = counts.groupBy("vec_id", "level", "sub").agg((F.ceil(F.round(bits, 6) / 8) + 8).alias("cost"))
    return each.groupBy("vec_id", "level").agg(F.sum("cost").alias("cost"))


def quadtree_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks are split once: where the four squares and a flag cost under nine tenths of the whole."""
    wide = quadtree_costs(spark, sf_dir).groupBy("vec_id").pivot("level", [8, 4]).agg(F.first("cost"))
    split = (F.col("4") + 1) * 10 < F.col("8") * 9
    return wide.groupBy(split.alias("split")).agg(F.count("*").alias("blocks"))


def mdl_block_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model of least description per block: constant, plane, mode of least entropy, or sixteen 2 x 2 means."""

    def cost(r: np.ndarray) -> float:
        c = np.unique(r, return_counts=True)[1]
        return float((c * np.log2(r.size / c)).sum() / 8)

    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        y, x = np.mgrid[:8, :8] - 3.5  # the centred terms are orthogonal
        part = lambda t, n: (v * t).sum((1, 2), keepdims=True) / n * t
        fit = np.rint(part(np.ones((8, 8)), 64.0) + part(x, 336.0) + part(y, 336.0) + part(x * y, 1764.0))
        tiles = np.repeat(np.repeat(np.rint(v.reshape(-1, 4, 2, 4, 2).mean((2, 4))), 2, 1), 2, 2)
        modes = block_predictions(v.astype(np.int64))
        models = [
            [2 + cost(b - round(b.mean())) for b in v], [8 + cost(b - f) for b, f in zip(v, fit, strict=True)],
            [1 + min(cost(b - m[i]) for m in modes) for i, b in enumerate(v)], [16 + cost(b - t) for b, t in zip(v, tiles, strict=True)],
        ]
        return {"vec_id": ids, "model": np.array(["constant", "plane", "mode", "tiles"])[np.argmin(np.round(models, 9), 0)], "bytes": np.round(np.min(models, 0), 4)}

    return map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, model string, bytes double")


def edge_complex_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, edge_bits, complex_bits): bits of what prediction along the mean gradient leaves, with two bytes for its angle, and of what the
    median edge predictor leaves (M08)."""

    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        v = v.astype(np.int64)
        angle = np.arctan2(np.diff(v, axis=1).sum((1, 2)) / 64, np.diff(v, axis=2).sum((1, 2)) / 64)
        dy, dx = np.rint(np.sin(angle)).astype(int), np.rint(np.cos(angle)).astype(int)
        y, x = np.mgrid[:8, :8]
        sy, sx = y - dy[:, None, None], x - dx[:, None, None]
        inside = (sy >= 0) & (sy < 8) & (sx >= 0) & (sx < 8)
        left, above, ul = (shifted(v, a, b, 0) for a, b in ((0, 1), (1, 0), (1, 1)))
        near = np.where(x > 0, left, np.where(y > 0, above, 0))
        edge = np.where(inside, v[np.arange(len(v))[:, None, None], np.clip(sy, 0, 7), np.clip(sx, 0, 7)], near)
        med = np.where(ul >= np.maximum(left, above), np.minimum(left, above), np.where(ul <= np.minimum(left, above), np.maximum(left, above), left + above - ul))
        med = np.where((x == 0) & (y == 0), 128, np.where(y == 0, left, np.where(x == 0, above, med)))
        bits = lambda r: np.array([64 * 6 - (c * np.log2(c)).sum() for b in r for c in [np.unique(b, return_counts=True)[1]]])
        return {"vec_id": ids, "edge_bits": np.round(bits(v - edge) + 16, 4), "complex_bits": np.round(bits(v - med), 4)}

    return map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, edge_bits double, complex_bits double")


def _kernel(name: str, schema: str, make) -> object:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return map_blocks(blocks(spark, sf_dir), make, schema)

    query.__name__ = name
    return query


def _round_trip(encode, decode):
    """Whether decode(encode(block)) is the block."""

    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        return {"vec_id": ids, "ok": np.array([bool((np.asarray(decode(encode(b), b)) == b).all()) for b in v])}

    return kernel


_gradient = lambda b: (b - block_predictions(b[None].astype(np.int64))[2][0]).ravel().tolist()


def _ungradient(r: list[int]) -> np.ndarray:
    out = np.zeros((8, 8), np.int64)
    at = lambda y, x: out[y, x] if y >= 0 and x >= 0 else 128
    for i, d in enumerate(r):
        y, x = divmod(i, 8)
        out[y, x] = d + at(y, x - 1) + at(y - 1, x) - at(y - 1, x - 1)
    return out


_OK = "vec_id long, ok boolean"
_ctx = lambda b: [i % 3 for i in range(b.size)]
huffman_roundtrip = _kernel("huffman_roundtrip", _OK, _round_trip(lambda b: huffman_encode(b.ravel().tolist()), lambda d, b: np.array(huffman_decode(d)).reshape(8, 8)))
shifted_roundtrip = _kernel("shifted_roundtrip", _OK, _round_trip(lambda b: encode_shifted(_gradient(b), 512, 1023), lambda d, b: _ungradient(decode_shifted(d, 512))))
bucket_roundtrip = _kernel("bucket_roundtrip", _OK, _round_trip(lambda b: encode_buckets(_gradient(b)), lambda d, b: _ungradient(decode_buckets(d))))
arith_roundtrip = _kernel("arith_roundtrip", _OK, _round_trip(lambda b: encode_residuals(_gradient(b)), lambda d, b: _ungradient(decode_residuals(d, 64))))
context_roundtrip = _kernel(
    "context_roundtrip", _OK, _round_trip(lambda b: encode_in_contexts([min(511, zigzag_int(r)) for r in (b - 128).ravel().tolist()], _ctx(b), 512), lambda d, b: np.array([unzigzag(z) for z in decode_in_contexts(d, _ctx(b), 512)]).reshape(8, 8) + 128)
)
planes_roundtrip = _kernel("planes_roundtrip", _OK, _round_trip(lambda b: pack_planes([b]), lambda d, b: unpack_planes(d)[0]))
#: 256 greys hold every block as it is.
palette_roundtrip = _kernel("palette_roundtrip", _OK, _round_trip(lambda b: pack_palette(b, [(g, g, g) for g in range(256)]), lambda d, b: unpack_palette(d)[:, :, 0]))


def svd_rank_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        e = linalg.rank_energy(v - 128)
        return {"vec_id": np.repeat(ids, 8), "rank": np.tile(np.arange(1, 9, dtype=np.int32), len(ids)), "share": np.round(e.ravel(), 6)}

    return map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, rank int, share double").groupBy("rank").agg(F.round(F.avg("share"), 4).alias("share"))


def svd_container_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        rows = [(i, r, len(pack_svd([b], r)), int(np.abs(linalg.integer_rank(b, r)[1]).sum())) for i, b in zip(ids, v, strict=True) for r in (1, 2, 4)]
        return dict(zip(("vec_id", "rank", "bytes", "abs_rest"), (np.array(c) for c in zip(*rows, strict=True)), strict=True))

    return map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, rank long, bytes long, abs_rest long").groupBy("rank").agg(F.sum("bytes").alias("bytes"), F.sum("abs_rest").alias("abs_rest"))


def tensor_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute rest of Tucker and tensor-train forms of blocks as 4 x 4 x 4 tensors."""

    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        rest = lambda x, y: int(np.abs(x - np.rint(y)).sum())
        t = v.reshape(-1, 4, 4, 4)
        return {"vec_id": ids, "tucker": np.array([rest(x, linalg.untucker(*linalg.tucker(x, (2, 2, 2)))) for x in t]), "train": np.array([rest(x, linalg.untrain(linalg.tensor_train(x, 2))) for x in t]), "full": np.array([rest(x, linalg.untrain(linalg.tensor_train(x, 16))) for x in t])}

    return map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, tucker long, train long, full long")


def omp_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        atoms = linalg.dct_atoms()
        rest = [[np.linalg.norm(linalg.pursuit(atoms, b.ravel() - 128.0, k)[2]) for k in (1, 4, 16)] for b in v]
        return {"vec_id": ids, **{f"rest{k}": np.round([r[i] for r in rest], 4) for i, k in enumerate((1, 4, 16))}}

    return map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, rest1 double, rest4 double, rest16 double")


def ksvd_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared rest per pixel of four-atom codes, by cosine atoms and by atoms learnt from the blocks of the 64 smallest ids."""
    vectors = blocks(spark, sf_dir)
    start = linalg.dct_atoms()
    learnt = linalg.learn_dictionary(first_vectors(vectors, 64) - 128.0, start, 4, 2)

    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        rest = lambda atoms: np.array([float((linalg.pursuit(atoms, b.ravel() - 128.0, 4)[2] ** 2).mean()) for b in v])
        return {"vec_id": ids, "cosine": rest(start), "learnt": rest(learnt)}

    return map_blocks(vectors, kernel, "vec_id long, cosine double, learnt double").agg(F.round(F.avg("cosine"), 4).alias("cosine"), F.round(F.avg("learnt"), 4).alias("learnt"))


def dictionary_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared rest per pixel of four-atom codes by 64 cosine atoms, and by these and 64 drawn blocks, those of the smallest ids."""
    vectors = blocks(spark, sf_dir)
    drawn = linalg.drawn_atoms(first_vectors(vectors, 64) - 128.0, 128)

    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        rest = lambda atoms: np.array([float((linalg.pursuit(atoms, b.ravel() - 128.0, 4)[2] ** 2).mean()) for b in v])
        return {"vec_id": ids, "cosine": rest(drawn[:, :64]), "drawn": rest(drawn)}

    return map_blocks(vectors, kernel, "vec_id long, cosine double, drawn double").agg(F.round(F.avg("cosine"), 4).alias("cosine"), F.round(F.avg("drawn"), 4).alias("drawn"))


def siren_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        ends = [linalg.siren_fit(b, steps=60) for b in v]
        return {"vec_id": ids, "mse_before": np.array([a for a, _ in ends]), "mse_after": np.array([b for _, b in ends])}

    return map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, mse_before double, mse_after double")


def polynomial_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        return {"vec_id": ids, **{f"rest{d}": np.array([int(np.abs(b - linalg.surface_fit(b, d)[1]).sum()) for b in v]) for d in (1, 3, 5)}}

    return map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, rest1 long, rest3 long, rest5 long")


def haar_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        c = np.rint(haar(v.astype(float)) * 2) / 2  # coefficients are halves of integers
        cuts = [np.percentile(np.abs(c), p, axis=(1, 2), keepdims=True) for p in (50, 90)]
        return {"vec_id": ids, **{f"kept{p}": (np.abs(c) >= t).sum((1, 2)) for p, t in zip((50, 90), cuts, strict=True)}, "energy": (c**2).sum((1, 2)).astype(np.int64)}

    return map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, kept50 long, kept90 long, energy long")


def dtree_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a decision tree guesses each pixel's best mode from its context (L11, A17), by Spark's own trees."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    near = _near(spark, sf_dir)
    f = context_features(*(F.col(n) for n in ("left", "above", "ul", "left2", "above2")))
    label = F.array_min(F.array(*(F.struct(F.abs(F.col("v") - m).alias("e"), F.lit(float(i)).alias("i")) for i, m in enumerate(_modes(near)))))["i"]
    rows = VectorAssembler(inputCols=list(f), outputCol="features").transform(near.select(label.alias("label"), *(v.cast("double").alias(k) for k, v in f.items())))
    rows = rows.select("label", "features")
    model = DecisionTreeClassifier(maxDepth=6, impurity="gini", seed=1).fit(rows)
    out = model.transform(rows).agg(F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 4).alias("accuracy"))
    return out.withColumn("nodes", F.lit(model.numNodes))


def decision_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, threshold, gain) of the best single split for whether left beats above (A14): thresholds are fixed."""
    near = _near(spark, sf_dir)
    f = context_features(*(F.col(n) for n in ("left", "above", "ul", "left2", "above2")))
    up = (F.abs(F.col("v") - F.col("left")) <= F.abs(F.col("v") - F.col("above"))).cast("int")
    tests = F.array(*(F.struct(F.lit(k).alias("feature"), F.lit(t).alias("threshold"), (v > t).cast("int").alias("side")) for k, v in f.items() for t in (8, 16, 32, 64, 128, 160)))
    each = near.select(up.alias("up"), F.explode(tests).alias("t")).groupBy("t.feature", "t.threshold").agg(F.count("*").alias("n"), F.sum("up").alias("u"), F.sum("t.side").alias("m"), F.sum(F.col("t.side") * F.col("up")).alias("um"))
    gini = lambda n, u: F.when(n == 0, 0.0).otherwise(2.0 * u * (n - u) / n)
    n, u, m, um = (F.col(c) for c in ("n", "u", "m", "um"))
    gain = F.round((gini(n, u) - gini(m, um) - gini(n - m, u - um)) / n, 6)
    return each.select("feature", "threshold", gain.alias("gain"))


def patch_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the 4 x 4 patches of blocks."""
    px = pixels(spark, sf_dir)
    return px.groupBy("vec_id", F.shiftright("y", 2).alias("by"), F.shiftright("x", 2).alias("bx")).agg(F.sum("v").alias("s"))


def top_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent 2 x 2 patches of 16 levels (A12), ties by key."""
    px = pixels(spark, sf_dir).withColumn("q", F.shiftright("v", 4))
    key = F.sum(F.col("q") * F.pow(F.lit(16.0), (F.col("y") % 2) * 2 + F.col("x") % 2)).cast("long")
    patches = px.groupBy("vec_id", F.shiftright("y", 1).alias("by"), F.shiftright("x", 1).alias("bx")).agg(key.alias("patch"))
    return patches.groupBy("patch").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "patch").limit(10)


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = blocks(spark, sf_dir)
    return knn(vectors, vectors.where("vec_id % 20 = 0"), 5)


#: Lloyd steps of every trained codebook, and the sizes of codebooks.
STEPS, CODES = 2, 16


def knn_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, q, rnk, id, d2): the two nearest by the sum and by the greatest of absolute differences."""
    vectors, out = blocks(spark, sf_dir), None
    for metric in ("absolutes", "greatest"):
        found = knn(vectors, vectors.where("vec_id % 20 = 0"), 2, metric=metric).select(F.lit(metric).alias("metric"), "q", "rnk", "id", "d2")
        out = found if out is None else out.union(found)
    return out


def vq_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = blocks(spark, sf_dir)
    return assign(vectors, first_vectors(vectors, CODES)).groupBy("code").agg(F.count("*").alias("n"), F.sum("d2").alias("d2"))


def vq_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component, bits): a trained codebook, indices and what is left, each at its entropy."""
    vectors = blocks(spark, sf_dir)
    book = lloyd(vectors, first_vectors(vectors, CODES), STEPS)
    rest = residuals(vectors, book)
    parts = rest.select(F.lit("indices").alias("component"), F.col("code").alias("sym")).union(rest.select(F.lit("residual"), F.explode("vec")))
    codes = spark.createDataFrame([("codebook", int(v)) for v in book.ravel()], "component string, sym int")
    return total_bits(parts.union(codes), ["component"], digits=3).select("component", "bits")


def kmeans_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the cells after two Lloyd steps from the 8 smallest ids."""
    vectors = blocks(spark, sf_dir)
    return assign(vectors, lloyd(vectors, first_vectors(vectors, 8), STEPS)).groupBy("code").agg(F.count("*").alias("n"))


def kmeans_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the cells after two Lloyd steps from four seeds drawn by squared distance."""
    vectors = blocks(spark, sf_dir)
    return assign(vectors, lloyd(vectors, spread_vectors(vectors, 4), STEPS)).groupBy("code").agg(F.count("*").alias("n"), F.sum("d2").alias("d2"))


def residual_vq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stage, bits): entropy of the pixels left after each of three stages, of codebooks of 256, 128 and 64 trained on what the last one left."""
    left, out = blocks(spark, sf_dir).select("vec_id", "vec"), None
    for stage in range(3):
        left = residuals(left, lloyd(left, first_vectors(left, max(32, 256 >> stage)), STEPS)).select("vec_id", "vec")
        bits = total_bits(left.select(F.lit(stage).alias("stage"), F.explode("vec").alias("sym")), ["stage"], digits=3)
        out = bits if out is None else out.union(bits)
    return out.select("stage", "bits")


def product_vq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sub, codes, d2): quarters of vectors, each with a codebook of 256 trained on it (K07): codes in use, and squared distances."""
    vectors, out = blocks(spark, sf_dir), None
    for sub in range(4):
        part = vectors.select("vec_id", F.slice("vec", 16 * sub + 1, 16).alias("vec"))
        near = assign(part, lloyd(part, first_vectors(part, 256), STEPS)).select(F.lit(sub).alias("sub"), "code", "d2")
        out = near if out is None else out.union(near)
    return out.groupBy("sub").agg(F.countDistinct("code").alias("codes"), F.sum("d2").alias("d2"))


def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = lsh_buckets(blocks(spark, sf_dir)).groupBy("tbl", "bucket").agg(F.count("*").alias("n"))
    return each.groupBy("tbl").agg(F.count("*").alias("buckets"), F.max("n").alias("max_bucket"))


def lsh_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, rnk, id, d2): the five nearest of those that share one of eight buckets with a query, exactly ranked."""
    vectors = blocks(spark, sf_dir).select("vec_id", "vec")
    return lsh_search(vectors, vectors.where("vec_id % 20 = 0"), 5)


def region_gradient_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane a + b x + c y per label, by sums."""
    x, y, v = F.col("x") - 3.5, F.col("y") - 3.5, F.col("v")
    s = pixels(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(x * v).alias("sx"), F.sum(y * v).alias("sy"))
    b, c = F.col("sx") / (F.col("n") * 5.25), F.col("sy") / (F.col("n") * 5.25)
    return s.select("label", F.round(F.col("s") / F.col("n") - b * 3.5 - c * 3.5, 4).alias("a"), F.round(b, 6).alias("b"), F.round(c, 6).alias("c"))


def top_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, energy_pct): share of energy in the k largest pixels of centred blocks."""
    w = Window.partitionBy("vec_id").orderBy(F.desc("e"), "p")
    ranked = pixels(spark, sf_dir).select("vec_id", "p", ((F.col("v") - 128) * (F.col("v") - 128)).alias("e")).withColumn("r", F.row_number().over(w))
    sums = ranked.agg(F.sum("e").alias("all"), *(F.sum(F.when(F.col("r") <= k, F.col("e"))).alias(f"k{k}") for k in (1, 4, 16, 64)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.round(F.col(f"k{k}") * 100.0 / F.col("all"), 4).alias("energy_pct")) for k in (1, 4, 16, 64)))).alias("r")).select("r.*")


def dct_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of DCT energy by u + v of the coefficient (C33), energy kept to rounding."""

    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        c = linalg.dct2(v - 128.0)
        return {"vec_id": np.repeat(ids, 64), "band": np.tile(np.add.outer(np.arange(8), np.arange(8)).ravel().astype(np.int32), len(v)), "e": (c * c).ravel()}

    return map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, band int, e double").groupBy("band").agg(F.round(F.sum("e"), 1).alias("energy"))


def threshold_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pct, thr, kept): values at or above a percentile of the distances from 128."""
    d = pixels(spark, sf_dir).select(F.abs(F.col("v") - 128).alias("d"))
    cuts = d.agg(F.percentile("d", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("t")).select(F.posexplode("t").alias("i", "thr"))
    counts = d.groupBy("d").count().join(F.broadcast(cuts), F.col("d") >= F.col("thr"))
    pct = F.element_at(F.array(F.lit(50), F.lit(90), F.lit(99)), F.col("i") + 1)
    return counts.groupBy(pct.alias("pct"), F.round("thr", 4).alias("thr")).agg(F.sum("count").alias("kept"))


def psnr_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bits, max_diff, psnr) of pixels cut to so many bits (A06, A08); equal planes have an infinite one."""
    px = pixels(spark, sf_dir).select("v", F.explode(F.array(*map(F.lit, (8, 6, 4, 2)))).alias("bits"))
    step = F.pow(F.lit(2.0), 8 - F.col("bits")).cast("int")
    d = F.col("v") - (F.floor(F.col("v") / step) * step + F.floor(step / 2)).cast("int")
    out = px.select("bits", d.alias("d")).groupBy("bits").agg(F.max(F.abs("d")).alias("max_diff"), F.avg(F.col("d") * F.col("d")).alias("mse"))
    return out.select("bits", "max_diff", F.when(F.col("mse") == 0, float("inf")).otherwise(F.round(F.log10(F.lit(65025.0) / F.col("mse")) * 10, 4)).alias("psnr"))


def abs_diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between blocks and their 4-bit uniform codes brought back."""
    w = Window.partitionBy("vec_id")
    px = pixels(spark, sf_dir).select("vec_id", "v", F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"))
    code = uniform_codes(F.col("v"), F.col("lo"), F.col("hi"), 15)
    back = (F.floor(code * (F.col("hi") - F.col("lo")) / 15.0) + F.col("lo")).cast("int")
    return px.select("vec_id", F.abs(F.col("v") - back).alias("d")).agg(F.max("d").alias("max_d"), F.round(F.avg("d"), 6).alias("mean_d"), F.sum((F.col("d") > 0).cast("int")).alias("differ"))


def ssim_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural similarity of blocks to their copies in 32 levels: 7 x 7 box windows, sample moments (A07), the mean of the four whole windows."""
    px = pixels(spark, sf_dir).select("vec_id", "x", "y", F.col("v").alias("a"), (F.shiftleft(F.shiftright("v", 3), 3) + 4).alias("b"))
    sums = {"sa": F.col("a"), "sb": F.col("b"), "saa": F.col("a") * F.col("a"), "sbb": F.col("b") * F.col("b"), "sab": F.col("a") * F.col("b")}
    across = Window.partitionBy("vec_id", "y").orderBy("x").rowsBetween(-3, 3)
    down = Window.partitionBy("vec_id", "x").orderBy("y").rowsBetween(-3, 3)
    px = px.select("vec_id", "x", "y", *(F.sum(c).over(across).alias(k) for k, c in sums.items()))
    px = px.select("vec_id", "x", "y", *(F.sum(k).over(down).alias(k) for k in sums)).where("x between 3 and 4 and y between 3 and 4")
    n = 49.0
    var = lambda ss, s, t: (F.col(ss) - F.col(s) * F.col(t) / n) / (n - 1)
    ma, mb = F.col("sa") / n, F.col("sb") / n
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    s = (2 * ma * mb + c1) * (2 * var("sab", "sa", "sb") + c2) / ((ma * ma + mb * mb + c1) * (var("saa", "sa", "sa") + var("sbb", "sb", "sb") + c2))
    return px.groupBy("vec_id").agg(F.round(F.avg(s), 4).alias("ssim"))


def downsample_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level, bits): entropy of the box means of side 1, 2, 4 and 8, rounded half to even."""
    px = pixels(spark, sf_dir).select("vec_id", "v", "x", "y", F.explode(F.array(*map(F.lit, (1, 2, 4, 8)))).alias("level"))
    means = px.groupBy("vec_id", "level", F.floor(F.col("y") / F.col("level")).alias("by"), F.floor(F.col("x") / F.col("level")).alias("bx")).agg(F.bround(F.avg("v")).cast("int").alias("sym"))
    return total_bits(means, ["level"], digits=3).select("level", "bits")


def hilbert_scan_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan, bps): entropy of the differences along rows and along the Hilbert curve."""
    px = pixels(spark, sf_dir)
    x, y = hilbert_xy(F.col("d"), 8)
    curve = spark.range(64).select(F.col("id").cast("int").alias("d")).select("d", x.alias("x"), y.alias("y"))
    both = px.select("vec_id", F.lit("raster").alias("scan"), F.col("p").alias("d"), "v").union(px.join(F.broadcast(curve), ["x", "y"]).select("vec_id", F.lit("hilbert"), "d", "v"))
    step = F.col("v") - F.lag("v", 1, 128).over(Window.partitionBy("vec_id", "scan").orderBy("d"))
    return entropy(both.select("scan", step.alias("sym")), ["scan"]).select("scan", "bps")


def omp_first_atom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, atom): of 16 sign patterns of the plane the one of greatest correlation, the first of equals (L13's first step)."""
    atoms = [(u, w) for u in range(4) for w in range(4)]
    sign = lambda c, u: F.when((F.floor(c * u / 8) % 2) == 0, 1).otherwise(-1)
    px = pixels(spark, sf_dir)
    sums = px.groupBy("vec_id").agg(*(F.sum((F.col("v") - 128) * sign(F.col("y"), u * 2) * sign(F.col("x"), w * 2)).alias(f"a{i}") for i, (u, w) in enumerate(atoms)))
    best = F.array_max(F.array(*(F.struct(F.abs(f"a{i}").alias("c"), F.lit(-i).alias("k")) for i in range(16))))
    return sums.select("vec_id", (-best["k"]).alias("atom"), best["c"].alias("score"))


def lossless_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that the prefix sum of row differences doesn't bring back (V01, L07): none."""
    near = _near(spark, sf_dir).select("vec_id", "p", "y", "x", "v", (F.col("v") - F.col("left")).alias("r"))
    back = near.select("vec_id", "p", (F.sum("r").over(Window.partitionBy("vec_id", "y").orderBy("x")) + 128).cast("int").alias("v"))
    return near.join(back, ["vec_id", "p", "v"], "left_anti").agg(F.count("*").alias("mismatches"))


def block_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bucket, n): the xor-multiply hash of blocks (C13), modulo 8."""
    return blocks(spark, sf_dir).groupBy((fnv1a(F.col("vec")) % 8).alias("bucket")).agg(F.count("*").alias("n"))


def crop_and_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, pixels, total): centre crop and every second pixel."""
    px = pixels(spark, sf_dir)
    crop = px.where("y between 2 and 5 and x between 2 and 5").select(F.lit("crop").alias("part"), "v")
    stride = px.where("y % 2 = 0 and x % 2 = 0").select(F.lit("stride").alias("part"), "v")
    return crop.union(stride).groupBy("part").agg(F.count("*").alias("pixels"), F.sum("v").alias("total"))


def region_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, mean, cells): means by class."""
    return pixels(spark, sf_dir).groupBy("label").agg(F.bround(F.avg("v"), 0).cast("int").alias("mean"), F.countDistinct("vec_id").alias("cells"))


_PX = """
px as (
  select vec_id, label, cast(p as int) as p, cast(p // 8 as int) as y, cast(p % 8 as int) as x, cast(round(cast(e as double) * 127 + 128) as int) as v
  from (select vec_id, label, unnest(embedding) as e, unnest(range(64)) as p from embeddings))"""


def _nb(border: int) -> str:
    lag = lambda n, there, name: f"case when {there} then lag(v, {n}) over w else {border} end as {name}"
    parts = [lag(1, "x > 0", "l"), lag(8, "y > 0", "a"), lag(9, "x > 0 and y > 0", "ul"), lag(7, "y > 0 and x < 7", "ur"), lag(2, "x > 1", "l2"), lag(16, "y > 1", "a2")]
    return f"{_PX}, nb as (select *, {', '.join(parts)} from px window w as (partition by vec_id order by p))"


_PAETH = "case when abs(a - ul) <= abs(l - ul) and abs(a - ul) <= abs(l + a - 2 * ul) then l when abs(l - ul) <= abs(l + a - 2 * ul) then a else ul end"
_MODES = [
    "l", "a", "l + a - ul", _PAETH, "(l + a + 1) >> 1",
    "case when abs(a - ul) > abs(l - ul) + 4 then a when abs(l - ul) > abs(a - ul) + 4 then l else l + a - ul end",
    "l + a + (l + a - ul) - greatest(l, a, l + a - ul) - least(l, a, l + a - ul)",
    "case when abs(l - l2) < abs(a - a2) then 2 * l - l2 else 2 * a - a2 end",
    "cast(round_even((l * (1.0::double / (abs(l - ul) + 1)) + a * (1.0::double / (abs(a - ul) + 1))) / ((1.0::double / (abs(l - ul) + 1)) + (1.0::double / (abs(a - ul) + 1))), 0) as int)",
]
_LONG = "(" + " union all ".join(f"select vec_id, p, {i} as mode_idx, v - ({m}) as r from nb" for i, m in enumerate(_MODES)) + ")"
_BITS = "round(sum(cnt) * log2(sum(cnt)::double) - sum(cnt * log2(cnt::double)), {d}) + 0.0"
_BPS = "round((sum(cnt) * log2(sum(cnt)::double) - sum(cnt * log2(cnt::double))) / sum(cnt), 6) + 0.0"
_GRID = f"with {_nb(128)}, long as {_LONG}, sads as (select vec_id, mode_idx, sum(abs(r)) as sad from long group by all), best as (select vec_id, cast(arg_min(mode_idx, sad * 16 + mode_idx) as int) as mode_idx, cast(min(sad) as bigint) as sad from sads group by 1)"
_FEATURES = {
    "left": "l", "above": "a", "ul": "ul", "gradient": "l + a - ul", "across": "abs(a - ul)", "down": "abs(l - ul)", "both": "abs(a - ul) + abs(l - ul)", "bend_left": "abs(l - l2)", "bend_above": "abs(a - a2)",
    "curvature": "abs(l + a - 2 * ul)", "average": "(l + a + 1) >> 1", "clamped": "least(abs(a - ul) + abs(l - ul), 255)",
}
_LEVEL = "case when {0} = 0 then 0 when {0} <= 1 then 1 when {0} <= 3 then 2 when {0} <= 7 then 3 when {0} <= 15 then 4 when {0} <= 31 then 5 when {0} <= 63 then 6 else 7 end"
_ENTROPY = f"with {_nb(128)}, long as {_LONG}, c as (select mode_idx, case when r >= 0 then 2 * r else -2 * r - 1 end as z, count(*) as cnt from long group by all), e as (select mode_idx, {_BPS} as bps from c group by 1)"
_COHERE = f"""with {_nb(128)}, g as (
  select vec_id, sum(v) as s, sum(v * v) as s2, sum(case when x > 0 then v - l end) as gx, sum(case when x > 0 then (v - l) * (v - l) end) as gx2, sum(case when y > 0 then v - a end) as gy, sum(case when y > 0 then (v - a) * (v - a) end) as gy2
  from nb group by 1), h as (select vec_id, (s2 * 64 - s * s)::double / 4096.0::double as variance, (gx2 + gy2)::double / 56.0::double as grad2, (gx * gx + gy * gy)::double / 3136.0::double as mean2 from g),
  k as (select vec_id, variance, grad2, case when grad2 > 1 then sqrt(mean2 / grad2) else 0.0::double end as coherence from h)"""
_IMPLICIT = [
    "case when x = 0 then 128 else l end", "case when y = 0 then 128 else a end", "case when x > 0 and y > 0 then ul else 128 end", _PAETH,
    "case when abs({h}) > abs({u}) then greatest(0, least(255, a + {h})) else greatest(0, least(255, l + {u})) end".format(h="(case when x = 0 then 0 when y = 0 then l else l - ul end)", u="(case when y = 0 then 0 when x = 0 then a else a - ul end)"),
    "(l + a + 1) >> 1",
]
_VEC = "vecs as (select vec_id, list_transform(embedding, lambda e: cast(round(cast(e as double) * 127 + 128) as int)) as vec from embeddings)"
_D2 = "list_sum(list_transform(range(1, 65), lambda i: (x.vec[i] - {c}[i]) * (x.vec[i] - {c}[i])))"


def _near_code(k: int, source: str = "vecs", skip: int = 0) -> str:
    return f"book as (select row_number() over (order by vec_id) - 1 as code, vec as c from (select * from {source} order by vec_id limit {k} offset {skip})), d as (select x.vec_id, x.vec, b.code, b.c, {_D2.format(c='b.c')} as d2 from {source} x cross join book b), near as (select vec_id, any_value(vec) as vec, arg_min(code, d2 * 64 + code) as code, min(d2) as d2, arg_min(c, d2 * 64 + code) as c from d group by vec_id)"


_VD = "vecs as (select vec_id, list_transform(embedding, lambda e: round(cast(e as double) * 127 + 128)) as vec from embeddings)"
_DOT = "(list_inner_product({x}, {x}) - 2 * list_inner_product({x}, {c}) + list_inner_product({c}, {c}))"


def _lsh_buckets_sql(tables: int, bits: int = 8) -> str:
    def bucket(t: int) -> str:
        return " + ".join(f"(case when list_inner_product(c, {[float(x) for x in plane]}::double[]) > 0 then {1 << b} else 0 end)" for b, plane in enumerate(plane_signs(t, bits, 64)))

    rows = " union all ".join(f"select vec_id, {t} as tbl, {bucket(t)} as bucket from centred" for t in range(tables))
    return f"{_VD}, centred as (select vec_id, list_transform(vec, lambda v: v - 128) as c from vecs), b as ({rows})"


_LSH_NEAREST = f"""with {_lsh_buckets_sql(8)}, p as (select distinct x.vec_id as q, y.vec_id as id from b x join b y using (tbl, bucket) where x.vec_id % 20 = 0 and x.vec_id <> y.vec_id),
 d as (select q, id, cast({_DOT.format(x='x.vec', c='y.vec')} as bigint) as d2 from p join vecs x on x.vec_id = q join vecs y on y.vec_id = id),
 r as (select q, cast(row_number() over (partition by q order by d2, id) as int) as rnk, id, d2 from d) select * from r where rnk <= 5"""


def trained_sql(name: str, source: str, k: int, steps: int = STEPS, seeds: str = "") -> str:
    """CTEs of a codebook from the k smallest ids (or of seeds: code, c) and Lloyd steps over source (vec_id, vec of doubles): near_{name} (vec_id, vec, code, d2, c), book_{name}."""
    first = seeds or f"select row_number() over (order by vec_id) - 1 as code, vec as c from (select * from {source} order by vec_id limit {k})"
    out = f"b_{name}0 as ({first})"
    for s in range(steps + 1):
        d2 = _DOT.format(x="x.vec", c="b.c")
        out += f", d_{name}{s} as (select x.vec_id, x.vec, b.code, b.c, {d2} as d2 from {source} x cross join b_{name}{s} b), n_{name}{s} as (select vec_id, any_value(vec) as vec, arg_min(code, d2 * 1024 + code) as code, min(d2) as d2, arg_min(c, d2 * 1024 + code) as c from d_{name}{s} group by 1)"
        if s < steps:
            out += f", e_{name}{s} as (select code, i, round_even(avg(vec[i]), 0) as m from n_{name}{s}, unnest(range(1, len(vec) + 1)) t(i) group by all), m_{name}{s} as (select code, list(m order by i) as c from e_{name}{s} group by 1), b_{name}{s + 1} as (select b.code, coalesce(m.c, b.c) as c from b_{name}{s} b left join m_{name}{s} m using (code))"
    return f"{out}, near_{name} as (select * from n_{name}{steps}), book_{name} as (select * from b_{name}{steps})"


LEFT = "list_transform(range(1, len(vec) + 1), lambda i: vec[i] - c[i])"
#: The next seed: the least of -ln(u) / d2 to the seeds before.
_SEED = "s{t} as (select vec_id, vec from (select x.vec_id, any_value(x.vec) as vec, min({d}) as d2 from vecs x cross join ({before}) b group by 1) where d2 > 0 order by -ln(((vec_id * 7919 + {t} * 104729) % 65537 + 1) / 65538.0::double) / d2, vec_id limit 1)"


def _spread_sql() -> str:
    before, out = "select 0 as code, vec as c from s0", f"with {_VD}, s0 as (select vec_id, vec from vecs order by vec_id limit 1)"
    for t in range(1, 4):
        out += ", " + _SEED.format(t=t, d=_DOT.format(x="x.vec", c="b.c"), before=before)
        before += f" union all select {t}, vec from s{t}"
    return f"{out}, {trained_sql('k', 'vecs', 4, STEPS, before)} select cast(code as int) as code, count(*) as n, cast(sum(d2) as bigint) as d2 from near_k group by 1"


def _hilbert_rows() -> str:
    """The curve over 8 x 8 by its own recursive definition: quadrants, the first and the last turned."""

    def curve(n: int) -> list[tuple[int, int]]:
        if n == 1:
            return [(0, 0)]
        h = n // 2
        sub = curve(h)
        return [(y, x) for x, y in sub] + [(x, y + h) for x, y in sub] + [(x + h, y + h) for x, y in sub] + [(n - 1 - y, h - 1 - x) for x, y in sub]

    return ", ".join(f"({d}, {x}, {y})" for d, (x, y) in enumerate(curve(8)))


def _residual_vq_sql() -> str:
    out = f"with {_VD}, s0 as (select * from vecs)"
    for s in range(3):
        out += f", {trained_sql(f'v{s}', f's{s}', max(32, 256 >> s))}, s{s + 1} as (select vec_id, {LEFT} as vec from near_v{s})"
    parts = " union all ".join(f"select {s} as stage, unnest(vec) as sym from s{s + 1}" for s in range(3))
    return out + f", parts as ({parts}), k as (select stage, sym, count(*) as cnt from parts group by all) select cast(stage as int) as stage, {_BITS.format(d=3)} as bits from k group by 1"


def _product_vq_sql() -> str:
    subs = ", ".join(f"q{s} as (select vec_id, vec[{16 * s + 1}:{16 * s + 16}] as vec from vecs), {trained_sql(f'q{s}', f'q{s}', 256)}" for s in range(4))
    rows = " union all ".join(f"select {s} as sub, count(distinct code) as codes, cast(sum(d2) as bigint) as d2 from near_q{s}" for s in range(4))
    return f"with {_VD}, {subs} select cast(sub as int) as sub, codes, d2 from ({rows})"


_SSIM = """with {px}, q as (select vec_id, x, y, v as a, ((v >> 3) << 3) + 4 as b from px),
 w as (select cx as x0, cy as y0 from range(0, 2) s(cx) cross join range(0, 2) t(cy)),
 m as (select vec_id, x0, y0, sum(a)::double as sa, sum(b)::double as sb, sum(a * a)::double as saa, sum(b * b)::double as sbb, sum(a * b)::double as sab from q join w on x between x0 and x0 + 6 and y between y0 and y0 + 6 group by all),
 s as (select vec_id, (2 * (sa / 49) * (sb / 49) + 6.5025::double) * (2 * ((sab - sa * sb / 49) / 48) + 58.5225::double) / (((sa / 49) * (sa / 49) + (sb / 49) * (sb / 49) + 6.5025::double) * ((saa - sa * sa / 49) / 48 + (sbb - sb * sb / 49) / 48 + 58.5225::double)) as s from m)
select vec_id, round(avg(s), 4) as ssim from s group by 1"""

SQL = {
    "block_mode_select": f"{_GRID} select mode_idx, count(*) as blocks, cast(sum(sad) as bigint) as sad from best group by 1",
    "block_mode_grid": f"{_GRID} select vec_id, mode_idx, sad from best",
    "block_mode_kernel": f"{_GRID} select vec_id, mode_idx, sad from best",
    "pixel_oracle_modes": f"with {_nb(128)}, long as {_LONG}, b as (select vec_id, p, arg_min(mode_idx, abs(r) * 16 + mode_idx) as mode_idx, min(abs(r)) as e from long group by all) select cast(mode_idx as int) as mode_idx, count(*) as pixels, cast(sum(e) as bigint) as abs_err from b group by 1",
    "implicit_mode_select": f"with {_nb(0)}, pr as (select vec_id, p, x, y, v, {', '.join(f'{m} as m{i}' for i, m in enumerate(_IMPLICIT))} from nb), co as (select v, {', '.join(f'm{i}' for i in range(6))}, {', '.join(f'(case when x > 0 then lag((v - m{i}) * (v - m{i}), 1) over w else 0 end) + (case when y > 0 then lag((v - m{i}) * (v - m{i}), 8) over w else 0 end) as c{i}' for i in range(6))} from pr window w as (partition by vec_id order by p)), be as (select v, least({', '.join(f'c{i} * 8 + {i}' for i in range(6))}) % 8 as k, [{', '.join(f'm{i}' for i in range(6))}] as ms from co) select cast(k as int) as mode_idx, count(*) as pixels, cast(sum(abs(v - ms[k + 1])) as bigint) as abs_err from be group by 1",
    "med_residual_hist": f"with {_nb(128)}, m as (select v - case when x = 0 and y = 0 then 128 when y = 0 then l when x = 0 then a when ul >= greatest(l, a) then least(l, a) when ul <= least(l, a) then greatest(l, a) else l + a - ul end as residual from nb) select residual, count(*) as cnt from m group by 1",
    "residual_entropy_by_mode": f"{_ENTROPY} select cast(mode_idx as int) as mode_idx, bps from e",
    "predictor_ranking": f"{_ENTROPY} select cast(mode_idx as int) as mode_idx, bps, cast(row_number() over (order by bps, mode_idx) as int) as rnk from e",
    "context_features_summary": f"with {_nb(128)}, f as ({' union all '.join(f'''select '{k}' as feature, {v} as value from nb''' for k, v in _FEATURES.items())}) select feature, min(value) as min_v, max(value) as max_v, cast(sum(value) as bigint) as sum_v from f group by 1",
    "residual_context_entropy": f"with {_nb(128)}, r as (select vec_id, p, x, y, v - (l + a - ul) as r from nb), q as (select r, abs(case when x > 0 then lag(r, 1) over w else 0 end) as rl, abs(case when y > 0 then lag(r, 8) over w else 0 end) as ra from r window w as (partition by vec_id order by p)), c as (select {_LEVEL.format('rl')} * 8 + {_LEVEL.format('ra')} as ctx, r, count(*) as cnt from q group by all) select cast(ctx as int) as ctx, cast(sum(cnt) as bigint) as n, {_BITS.format(d=4)} as bits from c group by 1",
    "mixer_context_hist": f"with {_nb(128)}, c as (select abs(l - ul) as dx, abs(l - ul) + abs(a - ul) as m from nb) select cast(least(m // 8, 7) * 8 + case when m > 2 then least(cast(floor(dx::double / (m + 1) * 8) as int), 7) else 0 end as int) as ctx, count(*) as n from c group by 1",
    "lookup_table_predict": f"with {_nb(128)} select cast((((l + 256) >> 7) * 16 | ((a + 256) >> 7) * 4 | ((ul + 256) >> 7)) % 64 as int) as ctx, count(*) as n, cast(round_even(avg(v), 0) as int) as pred from nb group by 1",
    "block_gradients": f"{_COHERE} select vec_id, round(variance, 4) as variance, round(grad2, 4) as grad2, round(coherence, 4) as coherence from k",
    "block_region_class": f"{_COHERE} select case when variance < 150 then 'smooth' when coherence > 0.25::double then 'edge' when variance < 250 then 'textured' else 'complex' end as region, count(*) as blocks from k group by 1",
    "smooth_block_fit": f"with {_PX}, s as (select vec_id, sum(v)::double as s, sum((x - 3.5::double) * v) as sx, sum((y - 3.5::double) * v) as sy, sum((x - 3.5::double) * (y - 3.5::double) * v) as sxy from px group by 1), c as (select vec_id, s, sxy / 1764.0::double as c3, sx / 336.0::double - sxy / 1764.0::double * 3.5::double as c1, sy / 336.0::double - sxy / 1764.0::double * 3.5::double as c2 from s) select vec_id, round(s / 64.0::double - c1 * 3.5::double - c2 * 3.5::double - c3 * 12.25::double, 4) + 0.0 as c0, round(c1, 4) + 0.0 as c1, round(c2, 4) + 0.0 as c2, round(c3, 4) + 0.0 as c3 from c",
    "quadtree_costs": f"with {_PX}, l as (select vec_id, v, cast(s as int) as level, (y // s) * 8 + x // s as sub from px cross join (values (8), (4), (2)) t(s)), m as (select vec_id, level, sub, v - cast(round_even(avg(v) over (partition by vec_id, level, sub), 0) as int) as r from l), c as (select vec_id, level, sub, r, count(*) as cnt from m group by all), e as (select vec_id, level, sub, cast(ceil(round(sum(cnt) * log2(sum(cnt)::double) - sum(cnt * log2(cnt::double)), 6) / 8) as bigint) + 8 as cost from c group by all) select vec_id, level, cast(sum(cost) as bigint) as cost from e group by all",
    "decision_split": f"with {_nb(128)}, t as ({' union all '.join(f'''select '{k}' as feature, thr as threshold, case when abs(v - l) <= abs(v - a) then 1 else 0 end as up, case when ({v}) > thr then 1 else 0 end as side from nb cross join (values (8), (16), (32), (64), (128), (160)) q(thr)''' for k, v in _FEATURES.items())}), g as (select feature, threshold, count(*)::double as n, sum(up)::double as u, sum(side)::double as m, sum(side * up)::double as um from t group by all) select feature, cast(threshold as int) as threshold, round((2.0::double * u * (n - u) / n - case when m = 0 then 0 else 2.0::double * um * (m - um) / m end - case when n = m then 0 else 2.0::double * (u - um) * (n - m - (u - um)) / (n - m) end) / n, 6) as gain from g",
    "patch_extract": f"with {_PX} select vec_id, cast(y >> 2 as int) as by, cast(x >> 2 as int) as bx, cast(sum(v) as bigint) as s from px group by all",
    "top_patches": f"with {_PX}, k as (select vec_id, y >> 1 as by, x >> 1 as bx, cast(sum((v >> 4) * pow(16, (y % 2) * 2 + x % 2)) as bigint) as patch from px group by all) select patch, count(*) as cnt from k group by 1 order by cnt desc, patch limit 10",
    "knn_exact": f"with {_VEC}, d as (select q.vec_id as q, x.vec_id as id, cast({_D2.format(c='q.vec')} as bigint) as d2 from vecs x cross join vecs q where q.vec_id % 20 = 0 and x.vec_id <> q.vec_id), r as (select *, cast(row_number() over (partition by q order by d2, id) as int) as rnk from d) select q, rnk, id, d2 from r where rnk <= 5",
    "vq_assign": f"with {_VEC}, {_near_code(16)} select cast(code as int) as code, count(*) as n, cast(sum(d2) as bigint) as d2 from near group by 1",
    "vq_cost": f"with {_VD}, {trained_sql('v', 'vecs', CODES)}, parts as (select 'indices' as component, code::double as sym from near_v union all select 'residual', unnest({LEFT}) from near_v union all select 'codebook', unnest(c) from book_v), k as (select component, sym, count(*) as cnt from parts group by all) select component, {_BITS.format(d=3)} as bits from k group by 1",
    "kmeans_steps": f"with {_VD}, {trained_sql('v', 'vecs', 8)} select cast(code as int) as code, count(*) as n from near_v group by 1",
    "residual_vq": _residual_vq_sql(),
    "product_vq": _product_vq_sql(),
    "lsh_candidates": f"with {_lsh_buckets_sql(4)}, n as (select tbl, bucket, count(*) as n from b group by all) select cast(tbl as int) as tbl, count(*) as buckets, max(n) as max_bucket from n group by 1",
    "region_gradient_fit": f"with {_PX}, s as (select label, count(*)::double as n, sum(v)::double as s, sum((x - 3.5::double) * v) as sx, sum((y - 3.5::double) * v) as sy from px group by 1), c as (select label, n, s, sx / (n * 5.25::double) as b, sy / (n * 5.25::double) as c from s) select label, round(s / n - b * 3.5::double - c * 3.5::double, 4) as a, round(b, 6) as b, round(c, 6) as c from c",
    "top_coefficients": f"with {_PX}, r as (select (v - 128) * (v - 128) as e, row_number() over (partition by vec_id order by (v - 128) * (v - 128) desc, p) as r from px) select cast(k as int) as k, round(sum(case when r <= k then e end) * 100.0::double / sum(e), 4) as energy_pct from r cross join (values (1), (4), (16), (64)) t(k) group by 1",
    "threshold_percentile": f"with {_PX}, d as (select abs(v - 128) as d from px), t as (select cast(pct as int) as pct, (select quantile_cont(d::double, 0.5) from d) as q50, (select quantile_cont(d::double, 0.9) from d) as q90, (select quantile_cont(d::double, 0.99) from d) as q99 from (values (50), (90), (99)) p(pct)), u as (select pct, case pct when 50 then q50 when 90 then q90 else q99 end as thr from t) select pct, round(thr, 4) as thr, count(*) as kept from u join d on d >= thr group by pct, thr",
    "psnr_by_level": f"with {_PX}, d as (select cast(bits as int) as bits, v - ((v // cast(pow(2, 8 - bits) as int)) * cast(pow(2, 8 - bits) as int) + cast(pow(2, 8 - bits) as int) // 2) as d from px cross join (values (8), (6), (4), (2)) t(bits)), m as (select bits, max(abs(d)) as max_diff, avg(d * d) as mse from d group by 1) select bits, max_diff, case when mse = 0 then 'Infinity'::double else round(log10(65025.0::double / mse) * 10, 4) end as psnr from m",
    "abs_diff_stats": f"with {_PX}, m as (select v, min(v) over (partition by vec_id) as lo, max(v) over (partition by vec_id) as hi from px), b as (select abs(v - (cast(floor(cast(floor((v - lo)::double / (case when hi = lo then 1 else hi - lo end)::double * 15) as int) * (hi - lo) / 15.0::double) as int) + lo)) as d from m) select max(d) as max_d, round(avg(d), 6) as mean_d, cast(sum(case when d > 0 then 1 else 0 end) as bigint) as differ from b",
    "ssim_tiles": _SSIM.format(px=_PX),
    "downsample_pyramid": f"with {_PX}, m as (select vec_id, cast(s as int) as level, y // s as by, x // s as bx, cast(round_even(avg(v), 0) as int) as sym from px cross join (values (1), (2), (4), (8)) t(s) group by all), k as (select level, sym, count(*) as cnt from m group by all) select level, {_BITS.format(d=3)} as bits from k group by 1",
    "hilbert_scan_entropy": f"with {_PX}, h(d, x, y) as (values {_hilbert_rows()}), b as (select vec_id, 'raster' as scan, p as d, v from px union all select vec_id, 'hilbert', h.d, v from px join h on px.x = h.x and px.y = h.y), s as (select scan, v - coalesce(lag(v) over (partition by vec_id, scan order by d), 128) as sym from b), k as (select scan, sym, count(*) as cnt from s group by all) select scan, {_BPS} as bps from k group by 1",
    "omp_first_atom": f"with {_PX}, s as (select vec_id, k, sum((v - 128) * (case when ((y * ((k // 4) * 2)) // 8) % 2 = 0 then 1 else -1 end) * (case when ((x * ((k % 4) * 2)) // 8) % 2 = 0 then 1 else -1 end)) as c from px cross join range(0, 16) t(k) group by all) select vec_id, cast(arg_max(k, abs(c) * 16 - k) as int) as atom, cast(max(abs(c)) as bigint) as score from s group by 1",
    "lossless_antijoin": f"with {_nb(128)}, r as (select vec_id, p, y, x, v, v - l as r from nb), k as (select v, 128 + sum(r) over (partition by vec_id, y order by x) as back from r) select count(*) as mismatches from k where v <> back",
    "crop_and_stride": f"with {_PX} select 'crop' as part, count(*) as pixels, cast(sum(v) as bigint) as total from px where y between 2 and 5 and x between 2 and 5 union all select 'stride', count(*), cast(sum(v) as bigint) from px where y % 2 = 0 and x % 2 = 0",
    "region_mask": f"with {_PX} select label, cast(round_even(avg(v), 0) as int) as mean, count(distinct vec_id) as cells from px group by 1",
    "block_hash": f"with {_VEC} select list_reduce(list_transform(vec, lambda v: v::hugeint), lambda h, v: (xor(h, v) * 16777619) % 4294967296, 2166136261::hugeint)::bigint % 8 as bucket, count(*) as n from vecs group by 1",
    "quadtree_splits": None,
    "lsh_nearest": _LSH_NEAREST,
    "mdl_block_choice": f"""with {_nb(128)}, q as (select *, x - 3.5::double as cx, y - 3.5::double as cy from nb),
      f as (select vec_id, sum(v) / 64.0::double as s, sum(v * cx) / 336.0::double as sx, sum(v * cy) / 336.0::double as sy, sum(v * (cx * cy)) / 1764.0::double as sxy from q group by 1),
      r as (select vec_id, 'constant' as model, 0 as k, 2 as extra, v - cast(round_even(s, 0) as int) as r from q join f using (vec_id)
        union all select vec_id, 'plane', 1, 8, v - cast(round_even(s + sx * cx + sy * cy + sxy * (cx * cy), 0) as int) from q join f using (vec_id)
        {''.join(f" union all select vec_id, 'mode', {i + 2}, 1, v - ({m}) from nb" for i, m in enumerate(_MODES))}
        union all select vec_id, 'tiles', 11, 16, v - cast(round_even(avg(v) over (partition by vec_id, y // 2, x // 2), 0) as int) from nb),
      c as (select vec_id, model, k, extra, r, count(*) as cnt from r group by all), b as (select vec_id, model, k, extra + sum(cnt * log2(64.0::double / cnt)) / 8 as bytes from c group by vec_id, model, k, extra),
      w as (select *, row_number() over (partition by vec_id order by round(bytes, 9), k) as n from b) select vec_id, model, round(bytes, 4) as bytes from w where n = 1""",
    "edge_complex_costs": f"""with {_nb(0)}, g as (select vec_id, atan2(sum(case when y > 0 then v - a else 0 end) / 64.0::double, sum(case when x > 0 then v - l else 0 end) / 64.0::double) as t from nb group by 1),
      d as (select vec_id, cast(round_even(sin(t), 0) as int) as dy, cast(round_even(cos(t), 0) as int) as dx from g),
      e as (select n.vec_id, n.v - coalesce(s.v, case when n.x > 0 then n.l when n.y > 0 then n.a else 0 end) as r,
        n.v - case when n.x = 0 and n.y = 0 then 128 when n.y = 0 then n.l when n.x = 0 then n.a when n.ul >= greatest(n.l, n.a) then least(n.l, n.a) when n.ul <= least(n.l, n.a) then greatest(n.l, n.a) else n.l + n.a - n.ul end as q
        from nb n join d using (vec_id) left join px s on s.vec_id = n.vec_id and s.y = n.y - d.dy and s.x = n.x - d.dx),
      a as (select vec_id, r, count(*) as cnt from e group by all), b as (select vec_id, q, count(*) as cnt from e group by all),
      m as (select vec_id, 384 - sum(cnt * log2(cnt::double)) as bits from a group by 1), w as (select vec_id, 384 - sum(cnt * log2(cnt::double)) as bits from b group by 1)
      select vec_id, round(m.bits + 16, 4) as edge_bits, round(w.bits, 4) as complex_bits from m join w using (vec_id)""",
    "knn_metrics": f"with {_VEC}, p as (select q.vec_id as q, x.vec_id as id, list_transform(range(1, 65), lambda i: abs(x.vec[i] - q.vec[i])) as a from vecs x cross join vecs q where q.vec_id % 20 = 0 and x.vec_id <> q.vec_id), d as (select 'absolutes' as metric, q, id, cast(list_sum(a) as bigint) as d2 from p union all select 'greatest', q, id, cast(list_max(a) as bigint) from p), r as (select metric, q, cast(row_number() over (partition by metric, q order by d2, id) as int) as rnk, id, d2 from d) select * from r where rnk <= 2",
    "kmeans_spread": _spread_sql(),
    "haar_threshold": f"with {_PX}, t as (select vec_id, y >> 1 as by, x >> 1 as bx, max(case when y % 2 = 0 and x % 2 = 0 then v end) as a, max(case when y % 2 = 0 and x % 2 = 1 then v end) as b, max(case when y % 2 = 1 and x % 2 = 0 then v end) as c, max(case when y % 2 = 1 and x % 2 = 1 then v end) as d from px group by all), h as (select vec_id, unnest([a + b + c + d, a - b + c - d, a + b - c - d, a - b - c + d]) / 2.0::double as h from t), q as (select vec_id, quantile_cont(abs(h), 0.5) as t50, quantile_cont(abs(h), 0.9) as t90 from h group by 1) select vec_id, count(*) filter (abs(h) >= t50) as kept50, count(*) filter (abs(h) >= t90) as kept90, cast(sum(h * h) as bigint) as energy from h join q using (vec_id) group by 1",
    "dct_energy": f"with {_PX}, c as (select u, i, cos(pi() * (2 * i + 1) * u / 16.0::double) * case when u = 0 then sqrt(1 / 8.0::double) else 0.5::double end as b from range(8) a(u), range(8) z(i)), r as (select vec_id, y, u, sum((v - 128) * b) as s from px join c on i = x group by all), f as (select vec_id, w.u + r.u as band, sum(s * w.b) as c from r join c w on w.i = r.y group by vec_id, w.u, r.u) select cast(band as int) as band, round(sum(c * c), 1) as energy from f group by 1",
    **{k: "select vec_id, true as ok from embeddings" for k in ("huffman_roundtrip", "shifted_roundtrip", "bucket_roundtrip", "arith_roundtrip", "context_roundtrip", "planes_roundtrip", "palette_roundtrip")},
}
SQL["quadtree_splits"] = SQL["quadtree_costs"].replace("select vec_id, level, cast(sum(cost) as bigint) as cost from e group by all", "select split, count(*) as blocks from (select vec_id, (sum(case when level = 4 then cost end) + 1) * 10 < sum(case when level = 8 then cost end) * 9 as split from e group by 1) group by 1")

QUERIES = [
    block_mode_select, block_mode_grid, block_mode_kernel, pixel_oracle_modes, implicit_mode_select, med_residual_hist, residual_entropy_by_mode, predictor_ranking, context_features_summary,
    residual_context_entropy, mixer_context_hist, lookup_table_predict, block_gradients, block_region_class, smooth_block_fit, quadtree_costs, quadtree_splits, mdl_block_choice, edge_complex_costs, huffman_roundtrip, shifted_roundtrip, bucket_roundtrip, arith_roundtrip, context_roundtrip, palette_roundtrip,
    planes_roundtrip, svd_rank_energy, svd_container_size, tensor_errors, omp_sparsity, ksvd_cost, dictionary_rest, siren_fit, polynomial_surface, haar_threshold, dtree_accuracy, decision_split, patch_extract, top_patches, knn_exact, knn_metrics,
    vq_assign, vq_cost, kmeans_steps, kmeans_spread, residual_vq, product_vq, lsh_candidates, lsh_nearest, region_gradient_fit, top_coefficients, dct_energy, threshold_percentile, psnr_by_level, abs_diff_stats, ssim_tiles, downsample_pyramid,
    hilbert_scan_entropy, omp_first_atom, lossless_antijoin, block_hash, crop_and_stride, region_mask,
]
