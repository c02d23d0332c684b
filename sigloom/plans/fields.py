"""Queries of local fits, wavelets, Fourier, noise, similarity, attention, online mixing, layers and fitted models over blocks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions.predictors import scalar_modes
from sigloom.functions.scalar import clip, from_ycocg, harmonics, rotate, softmax, to_ycocg, unrotate, zigzag
from sigloom.operators import fields, linalg
from sigloom.operators.entropy import entropy, total_bits
from sigloom.operators.neighbours import block_predictions, map_blocks, with_neighbours
from sigloom.operators.ordered import ContextMixer, LogitMixer, RunningLine, fold
from sigloom.operators.quantise import first_vectors, lloyd, residuals
from sigloom.plans.blocks import _BITS, _VD, LEFT, STEPS, trained_sql
from sigloom.sources.signals import blocks, colours, pixels, series


def _rows(make, **kinds: str):
    """A query of one row per block: make(block) gives the values in the order of kinds."""

    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        cols = list(zip(*(make(b) for b in v.astype(np.int64)), strict=True))
        casts = {"long": np.int64, "double": np.float64, "int": np.int32}
        return {"vec_id": ids, **{k: np.array(c, casts[t]) for (k, t), c in zip(kinds.items(), cols, strict=True)}}

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, " + ", ".join(f"{k} {t}" for k, t in kinds.items()))

    return query


def _named(name: str, query):
    query.__name__ = name
    return query


_abs = lambda r: int(np.abs(r).sum())
_r = lambda x: round(float(x), 4) + 0.0
_KERNEL = np.array([[1, 2, 1], [2, 4, 2], [1, 2, 1]])
#: Blocks whose halved forms are the domains of self-similarity.
POOL = 32

local_fit_residual = _named("local_fit_residual", _rows(lambda b: (_abs(b - fields.local_fit(b)),), abs_err="long"))
edge_directions = _named("edge_directions", _rows(lambda b: (*fields.edge_direction(b), _abs(b - np.roll(b, fields.edge_direction(b), (0, 1)))), dy="int", dx="int", abs_err="long"))


def self_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, matched, mse): quarters of blocks by the best of the halved forms of POOL blocks, those of the smallest ids, in four turns."""
    vectors = blocks(spark, sf_dir)
    pool = fields.domains(first_vectors(vectors, POOL).reshape(-1, 8, 8))

    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        errors = fields.domain_errors(v.astype(float), pool)
        return {"vec_id": ids, "matched": (errors < 400).sum(1).astype(np.int64), "mse": np.round(errors.mean(1), 4) + 0.0}

    return map_blocks(vectors, kernel, "vec_id long, matched long, mse double")


patch_kmeans = _named("patch_kmeans", _rows(lambda b: (_abs(b - fields.patch_means(b)),), abs_err="long"))
wavelet_db2 = _named("wavelet_db2", _rows(lambda b: (_r((fields.db2(b.astype(float)) ** 2).sum() - (b.astype(float) ** 2).sum()), int((np.abs(fields.db2(b.astype(float))) > 20).sum())), energy_change="double", large="long"))
fourier_top = _named("fourier_top", _rows(lambda b: tuple(_r(fields.fourier_top(b - 128, k)[1]) for k in (1, 8, 64)), top1="double", top8="double", top64="double"))
scale_search = _named("scale_search", _rows(lambda b: tuple(map(_r, fields.best_scale(linalg.dct2(b - 128.0)))), scale="double", bits="double"))
layered_model = _named("layered_model", _rows(lambda b: tuple(_r(fields.entropy_bits(r)) for r in fields.layered(b)), mean_bits="double", rank_bits="double", tile_bits="double"))
svd_then_predict = _named("svd_then_predict", _rows(lambda b: (lambda r: (_r(fields.entropy_bits(r)), _r(min(fields.entropy_bits(r - p[0]) for p in block_predictions(r[None], border=0)))))(linalg.integer_rank(b, 1)[1]), svd_bits="double", predicted_bits="double"))
attention_residual = _named("attention_residual", _rows(lambda b: (_abs(fields.attention_residuals(b)),), abs_err="long"))
attention_heads = _named("attention_heads", _rows(lambda b: (_abs(fields.attention_residuals(b, heads=2)), _abs(fields.attention_residuals(b, heads=2, other=b // 16 * 16))), two="long", across="long"))
two_scale_codes = _named("two_scale_codes", _rows(lambda b: tuple(map(_abs, linalg.two_scales(b - 128, 2, 2))), coarse="long", fine="long"))
program_search = _named("program_search", _rows(lambda b: (_r(fields.evolve_program(b)[1]),), mse="double"))
plane_memoriser = _named("plane_memoriser", _rows(lambda b: tuple(map(_r, fields.memorise(b))), mse_before="double", mse_after="double"))
block_resize = _named("block_resize", _rows(lambda b: (_abs(fields.resize(fields.box_down(b, 2), 8, 8) - b), _abs(fields.pad_to(b[:7, :5], 8)[:7, :5] - b[:7, :5])), down_up="long", padding="long"))
mask_composite = _named("mask_composite", _rows(lambda b: (lambda c: (int(c.min()), int(c.max()), int(c.sum())))(fields.composite(b, np.full_like(b, 128), b > 128)), low="long", high="long", total="long"))
noise_fit = _named("noise_fit", _rows(lambda b: (_r(np.corrcoef(fields.gradient_noise(8, 8, 2, 1).ravel(), b.ravel())[0, 1] if b.std() else 0.0), _r((fields.cell_distance(8, 8, np.array([[0.2, 0.3], [0.7, 0.8]])) * b).sum())), noise_corr="double", cell_sum="double"))


def _batch(name: str, doc: str, make, **kinds: str):
    """A query of one row per block: make(blocks as n x 64 doubles) gives columns of doubles, rounded to four places."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
            cols = make(v.reshape(len(v), -1).astype(float))
            return {"vec_id": ids, **{k: np.round(c, 4) + 0.0 for k, c in zip(kinds, cols, strict=True)}}

        return map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, " + ", ".join(f"{k} {t}" for k, t in kinds.items()))

    query.__name__, query.__doc__ = name, doc
    return query


def _onto(a: np.ndarray) -> np.ndarray:
    """The projection on the columns of a: a least-squares fit of every block is one product with it."""
    return a @ np.linalg.pinv(a)


def _fit_error(a: np.ndarray):
    m = _onto(a)
    return lambda v: (((v @ m.T - v) ** 2).mean(1),)


def _projections() -> list[np.ndarray]:
    return [_onto(np.random.default_rng(9).normal(size=(int(64 * share), 64)).T) for share in (0.1, 0.3, 0.5)]


def _features() -> np.ndarray:
    y, x = linalg.plane_features(8, 8)
    return linalg.random_features(np.c_[x.ravel(), y.ravel()], 12, 1)


def _waves() -> np.ndarray:
    y, x = linalg.plane_features(8, 8)
    return np.stack([np.ones(64)] + [f(math.pi * k * c.ravel()) for k in (0.5, 1, 1.5) for c in (x, y, x + y) for f in (np.sin, np.cos)], 1)


random_projection = _batch(
    "random_projection", "Rest after projecting on Gaussian directions of 10, 30 and 50 per cent and back by least squares (L25).",
    lambda v: [np.linalg.norm((v - 128) - (v - 128) @ m.T, axis=1) for m in _projections()], rest10="double", rest30="double", rest50="double",
)
random_feature_fit = _batch("random_feature_fit", "Least squares on random features of the coordinates (L10).", lambda v: _fit_error(_features())(v), mse="double")
fourier_codec = _batch("fourier_codec", "Least squares on harmonics of the coordinates (L18).", lambda v: _fit_error(_waves())(v), mse="double")


def _procedural(b: np.ndarray) -> tuple[float]:
    """Evolution of a rendered plane of 30 parameters: a gradient, three waves and three soft spots."""
    y, x = linalg.plane_features(8, 8)

    def render(p: np.ndarray) -> np.ndarray:
        out = p[0] + p[1] * x + p[2] * y
        for a, fx, fy, at in p[3:15].reshape(3, 4):
            out = out + a * np.sin(3 * fx * x + 3 * fy * y + at)
        for a, cx, cy, sx, sy in p[15:].reshape(3, 5):
            out = out + a * np.exp(-(((x - cx) * (1 + sx * sx)) ** 2) - ((y - cy) * (1 + sy * sy)) ** 2)
        return 128 + 60 * out

    return (_r(linalg.evolve(lambda p: float(((render(p) - b) ** 2).mean()), 30, rounds=25, spread=0.2)[1]),)


procedural_fit = _named("procedural_fit", _rows(_procedural, mse="double"))


def _conv_codes(b: np.ndarray) -> tuple[int, float]:
    """A step of convolutional sparse coding with four filters: the strongest twentieth of the responses kept."""
    filters = [np.outer(a, c) / 3.0 for a in ((1, 1, 1), (1, 0, -1)) for c in ((1, 1, 1), (1, 0, -1))]
    x = b - 128.0
    codes = np.stack([fields.correlate_valid(x, f) for f in filters])
    cut = np.sort(np.abs(codes).ravel())[-max(1, codes.size // 20)]
    codes = np.where(np.abs(codes) >= cut, codes, 0)
    back = sum(fields.convolve_full(c, f) for c, f in zip(codes, filters, strict=True))
    scale = float((back * x).sum() / max(1e-9, (back * back).sum()))
    return int((codes != 0).sum()), _r(((x - scale * back) ** 2).mean())


conv_sparse_codes = _named("conv_sparse_codes", _rows(_conv_codes, kept="long", mse="double"))


def _symbolic(b: np.ndarray) -> tuple[float]:
    """The best of 60 random quadratic surfaces, then refined by finite differences."""
    rng = np.random.default_rng(8)
    y, x = linalg.plane_features(8, 8)
    form = lambda c: c[0] * x * x + c[1] * y * y + c[2] * x * y + c[3] * x + c[4] * y + c[5]
    error = lambda c: float(((form(c) * 60 + 128 - b) ** 2).mean())
    c = min(rng.normal(0, 0.5, (60, 6)), key=error)
    for _ in range(30):
        g = np.array([(error(c + 1e-3 * e) - error(c - 1e-3 * e)) / 2e-3 for e in np.eye(6)])
        new = c - 2e-4 * g
        if error(new) >= error(c):
            break
        c = new
    return (_r(error(c)),)


symbolic_surface = _named("symbolic_surface", _rows(_symbolic, mse="double"))


def smooth_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the valid 3 x 3 correlations of blocks."""
    return _rows(lambda b: (int(fields.correlate_valid(b, _KERNEL).sum()), int(fields.correlate_valid(b, _KERNEL).max())), total="long", top="long")(spark, sf_dir)


def scalar_mode_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mode_idx, bps) of the seven clamped modes."""
    near = with_neighbours(pixels(spark, sf_dir))
    modes = scalar_modes(*(F.col(n) for n in ("left", "above", "ul", "left2", "above2")))
    r = near.select(F.posexplode(F.array(*(zigzag(F.col("v") - m) for m in modes.values()))).alias("mode_idx", "sym"))
    return entropy(r, ["mode_idx"]).select("mode_idx", "bps")


def pixel_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, mean, zero_pct): row means and the share of exact zeros of the left residual."""
    near = with_neighbours(pixels(spark, sf_dir))
    return near.groupBy("y").agg(F.bround(F.avg("v")).cast("int").alias("mean"), F.round(F.avg((F.col("v") == F.col("left")).cast("double")) * 100, 4).alias("zero_pct"))


def coefficient_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, cnt): centred pixels in six bits by each block's largest (C20)."""
    top = F.max(F.abs(F.col("v") - 128)).over(Window.partitionBy("vec_id"))
    code = F.bround((F.col("v") - 128) * 31.0 / F.greatest(top, F.lit(1))).cast("int")
    return pixels(spark, sf_dir).select(code.alias("code")).groupBy("code").agg(F.count("*").alias("cnt"))


def finite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(finite, rows): ratios of blocks' first pixels, some of them infinite or undefined."""
    v = F.transform("vec", lambda x: (x - 128).cast("double"))
    ratio = blocks(spark, sf_dir).select(F.when(v[1] == 0, F.when(v[0] == 0, float("nan")).otherwise(float("inf"))).otherwise(v[0] / v[1]).alias("q"))
    ok = ~F.isnan("q") & (F.abs("q") < float("inf"))
    return ratio.groupBy(ok.alias("finite")).agg(F.count("*").alias("rows"))


def hierarchical_vq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stage, bits): whole blocks by codes, then their quarters, then their sixteenths, each by a codebook trained on what is left."""
    left, out = blocks(spark, sf_dir).select("vec_id", "vec"), None
    for stage, k in enumerate(HIERARCHY):
        left = residuals(left, lloyd(left, first_vectors(left, k), STEPS)).select("vec_id", "vec")
        bits = total_bits(left.select(F.lit(stage).alias("stage"), F.explode("vec").alias("sym")), ["stage"], digits=3)
        out = bits if out is None else out.unionByName(bits)
        quarters = [F.array(*(F.col("vec")[i] for i in places)) for places in _quarters(8 >> stage)]
        parts = left.select("vec_id", F.posexplode(F.array(*quarters)).alias("part", "vec"))
        left = parts.select((F.col("vec_id") * 4 + F.col("part")).alias("vec_id"), "vec")
    return out.select("stage", "bits")


#: Codes of whole blocks, quarters and sixteenths.
HIERARCHY = (8, 16, 32)


def _quarters(width: int) -> list[list[int]]:
    """Places, row by row, of the four quarters of a square."""
    half = width // 2
    return [[(by * half + y) * width + bx * half + x for y in range(half) for x in range(half)] for by in (0, 1) for bx in (0, 1)]


def _hierarchical_sql() -> str:
    out = f"with {_VD}, h0 as (select * from vecs)"
    for s, k in enumerate(HIERARCHY):
        out += f", {trained_sql(f'h{s}', f'h{s}', k)}, l{s} as (select vec_id, {LEFT} as vec from near_h{s})"
        if s < len(HIERARCHY) - 1:
            parts = " union all ".join(f"select vec_id * 4 + {j} as vec_id, list_transform({[i + 1 for i in places]}, lambda i: vec[i]) as vec from l{s}" for j, places in enumerate(_quarters(8 >> s)))
            out += f", h{s + 1} as ({parts})"
    rows = " union all ".join(f"select {s} as stage, unnest(vec) as sym from l{s}" for s in range(len(HIERARCHY)))
    return f"{out}, k as (select stage, sym, count(*) as cnt from ({rows}) group by all) select cast(stage as int) as stage, {_BITS.format(d=3)} as bits from k group by 1"


def cross_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(predictor, bps): green from the co-located red, raw and by least squares over all rows."""
    c = colours(spark, sf_dir).select("r", "g")
    line = c.agg(F.regr_slope("g", "r").alias("a"), F.regr_intercept("g", "r").alias("b")).first()
    both = c.select("g", "r", F.bround(F.lit(line.a) * F.col("r") + F.lit(line.b)).cast("int").alias("p"))
    r = both.select(F.explode(F.array(F.struct(F.lit("raw").alias("predictor"), (F.col("g") - F.col("r")).alias("sym")), F.struct(F.lit("line").alias("predictor"), (F.col("g") - F.col("p")).alias("sym")))).alias("x")).select("x.*")
    return entropy(r, ["predictor"]).select("predictor", "bps")


def pca_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, mismatches): colours less their means, turned by three lifting rotations of the axes of their covariance, and back."""
    c = colours(spark, sf_dir).select("r", "g", "b")
    m = c.agg(*(F.avg(x).alias(x) for x in "rgb"), *(F.covar_pop(x, y).alias(x + y) for i, x in enumerate("rgb") for y in "rgb"[i:])).first()
    cov = np.array([[m["r" * 2], m["rg"], m["rb"]], [m["rg"], m["gg"], m["gb"]], [m["rb"], m["gb"], m["bb"]]])
    e = np.linalg.eigh(cov)[1][:, ::-1]
    turns = [(0, 1, math.atan2(e[2, 1], e[2, 2])), (0, 2, math.atan2(-e[1, 0], e[0, 0])), (1, 2, math.atan2(e[2, 0], e[2, 2]))]
    ch = [F.col(x) - round(m[x]) for x in "rgb"]
    df = c.select("r", "g", "b", *(x.alias(f"c{i}") for i, x in enumerate(ch)))
    for i, j, t in turns:
        a, b = rotate(F.col(f"c{i}"), F.col(f"c{j}"), t)
        df = df.withColumns({f"c{i}": a, f"c{j}": b})
    for i, j, t in reversed(turns):
        a, b = unrotate(F.col(f"c{i}"), F.col(f"c{j}"), t)
        df = df.withColumns({f"c{i}": a, f"c{j}": b})
    off = (F.col("c0") + round(m.r) != F.col("r")) | (F.col("c1") + round(m.g) != F.col("g")) | (F.col("c2") + round(m.b) != F.col("b"))
    return df.agg(F.count("*").alias("n"), F.sum(off.cast("int")).alias("mismatches"))


def grey_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grey, cnt): truncated mean of the three colours."""
    return colours(spark, sf_dir).groupBy(F.floor((F.col("r") + F.col("g") + F.col("b")) / 3).cast("int").alias("grey")).agg(F.count("*").alias("cnt"))


def clipped_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lost): colours that three more units of luma clip or change by more than that."""
    y, co, cg = to_ycocg(F.col("r"), F.col("g"), F.col("b"))
    r, g, b = from_ycocg(y + 3, co, cg)
    return colours(spark, sf_dir).agg(F.sum(((r != clip(F.col("r") + 3, 0, 255)) | (g != clip(F.col("g") + 3, 0, 255)) | (b != clip(F.col("b") + 3, 0, 255))).cast("int")).alias("lost"))


def harmonic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, mean) of the harmonics of the rows' coordinate (C12, C21, C22), and of their softmax."""
    x = -1 + 2 * F.col("y") / 7.0
    px = pixels(spark, sf_dir).select(harmonics(x, 2).alias("h"))
    return px.select(F.posexplode("h").alias("k", "v"), softmax(F.col("h")).alias("s")).groupBy("k").agg((F.round(F.avg("v"), 6) + 0.0).alias("mean"), F.round(F.avg(F.col("s")[F.col("k")]), 6).alias("weight"))


def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, y0, y1, x0, x1): the box of bright pixels with a margin of one."""
    px = pixels(spark, sf_dir).where("v > 140").groupBy("vec_id")
    return px.agg(F.greatest(F.min("y") - 1, F.lit(0)).alias("y0"), F.least(F.max("y") + 1, F.lit(7)).alias("y1"), F.greatest(F.min("x") - 1, F.lit(0)).alias("x0"), F.least(F.max("x") + 1, F.lit(7)).alias("x1"))


def _inverses() -> dict[str, object]:
    """Transforms and back of blocks (n, 8, 8) of doubles."""
    many = lambda f: lambda v: np.stack([f(b) for b in v])
    waves = {w: fields.wavelet_matrix(w, 8) for w in ("haar", "db2")}
    atoms, draws = linalg.dct_atoms(), np.random.default_rng(9).normal(size=(64, 64))
    projection = np.linalg.pinv(draws) @ draws

    def low_rank(b: np.ndarray) -> np.ndarray:
        return linalg.integer_rank(b, 8)[0]

    def cube(f) -> object:
        return many(lambda b: f(b.reshape(4, 4, 4)).reshape(8, 8))

    def coded(b: np.ndarray) -> np.ndarray:
        chosen, coef, _ = linalg.pursuit(atoms, b.ravel(), 64)
        return (atoms[:, chosen] @ coef).reshape(8, 8)

    return {
        "cosine": lambda v: linalg.idct2(linalg.dct2(v)), "fourier": many(lambda b: fields.fourier_top(b, 64)[0]), **{w: lambda v, m=m: m.T @ (m @ v @ m.T) @ m for w, m in waves.items()},
        "singular": many(low_rank), "tucker": cube(lambda t: linalg.untucker(*linalg.tucker(t, (4, 4, 4)))), "train": cube(lambda t: linalg.untrain(linalg.tensor_train(t, 16))),
        "pursuit": many(coded), "projection": lambda v: (v.reshape(len(v), 64) @ projection.T).reshape(v.shape),
    }


def inverse_roundtrips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(transform, blocks, exact): blocks that a transform of full size and its inverse give back to the unit (L07 over C33, C34, L01, L04, L05, L13, L22, L25)."""

    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        found = {k: (np.rint(f(v - 128.0)) + 128 == v).all((1, 2)) for k, f in _inverses().items()}
        return {"transform": np.array([k for k in found for _ in ids]), "ok": np.concatenate(list(found.values())).astype(np.int64)}

    return map_blocks(blocks(spark, sf_dir), kernel, "transform string, ok long").groupBy("transform").agg(F.count("*").alias("blocks"), F.sum("ok").alias("exact"))


def attention_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, ok): blocks from their residuals by the same attention over what is back already."""

    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        return {"vec_id": ids, "ok": np.array([bool((fields.attention_residuals(fields.attention_residuals(b, heads=2), heads=2, back=True) == b).all()) for b in v.astype(np.int64)])}

    return map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, ok boolean")


class _MixedBack:
    """(n, ok): residuals of the context mixer's and the running line's predictions, decoded by twins that see what is decoded only."""

    def __init__(self):
        self.pairs = [(ContextMixer(8, 3), RunningLine()) for _ in range(2)]
        self.past, self.n, self.ok = [(0, 0), (0, 0)], 0, True

    def _predict(self, side: int) -> tuple[int, int, list[int], int]:
        (mixer, line), (last, before) = self.pairs[side], self.past[side]
        preds = [last, 2 * last - before, (last + before) // 2]
        ctx = min(7, abs(last - before).bit_length() // 2)
        return mixer.predict(ctx, preds), line.predict(last), preds, ctx

    def _learn(self, side: int, v: int, preds: list[int], ctx: int) -> None:
        mixer, line = self.pairs[side]
        mixer.learn(ctx, preds, v)
        line.learn(self.past[side][0], v)
        self.past[side] = (v, self.past[side][0])

    def learn_all(self, values: list[int]) -> None:
        for v in values:
            p, q, preds, ctx = self._predict(0)
            sent = (v - p, v - q)
            self._learn(0, v, preds, ctx)
            p, q, preds, ctx = self._predict(1)
            back = sent[0] + p
            self.ok &= back == v == sent[1] + q
            self._learn(1, back, preds, ctx)
            self.n += 1

    def row(self) -> tuple[int, int]:
        return self.n, int(self.ok)


def mixing_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, n, ok): series decoded from the residuals of the online mixers."""
    return fold(series(spark, sf_dir), "user_id", ["ts", "event_id"], "sample", _MixedBack, "n long, ok long")


class _Mixed:
    """Online mixing over a series: predictions by context, a line on the value before, and a logit mix of the sign's chance."""

    def __init__(self):
        self.mixer, self.line, self.logit = ContextMixer(8, 3), RunningLine(), LogitMixer(2)
        self.last = self.before = self.total = self.line_total = 0
        self.bits, self.up = 0.0, [1, 1]

    def learn_all(self, values: list[int]) -> None:
        for v in values:
            last, before, up = self.last, self.before, self.up
            preds = [last, 2 * last - before, (last + before) // 2]
            ctx = min(7, abs(last - before).bit_length() // 2)
            self.total += abs(v - self.mixer.predict(ctx, preds))
            self.mixer.learn(ctx, preds, v)
            self.line_total += abs(v - self.line.predict(last))
            self.line.learn(last, v)
            bit = int(v > last)
            p = self.logit.mix([up[1] / sum(up), 0.75 if last < before else 0.25])
            self.bits -= math.log2(p if bit else 1 - p)
            self.logit.learn(bit)
            up[bit] += 1
            self.before, self.last = last, v

    def row(self) -> tuple[int, int, float]:
        return self.total, self.line_total, round(self.bits, 4)


def online_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, mixed, line, sign_bits): the online mixers over each series."""
    return fold(series(spark, sf_dir), "user_id", ["ts", "event_id"], "sample", _Mixed, "mixed long, line long, sign_bits double")


_PX = "px as (select vec_id, cast(p as int) as p, cast(p // 8 as int) as y, cast(p % 8 as int) as x, cast(round(cast(e as double) * 127 + 128) as int) as v from (select vec_id, unnest(embedding) as e, unnest(range(64)) as p from embeddings))"
_NB = f"{_PX}, nb as (select *, case when x > 0 then lag(v, 1) over w else 128 end as l, case when y > 0 then lag(v, 8) over w else 128 end as a, case when x > 0 and y > 0 then lag(v, 9) over w else 128 end as ul, case when x > 1 then lag(v, 2) over w else 128 end as l2, case when y > 1 then lag(v, 16) over w else 128 end as a2 from px window w as (partition by vec_id order by p))"
_C = "c as (select cast(l_quantity as int) as r, cast(round(l_discount * 1000) as int) as g, cast(round(l_tax * 1000) as int) as b from lineitem)"
_SEVEN = [
    "l", "a", "l + a - ul", "case when abs(a - ul) <= abs(l - ul) and abs(a - ul) <= abs(l + a - 2 * ul) then l when abs(l - ul) <= abs(l + a - 2 * ul) then a else ul end", "(l + a) // 2",
    "case when abs(a - ul) > abs(l - ul) then a when abs(l - ul) > abs(a - ul) then l else l + a - ul end", "case when abs(l - l2) < abs(a - a2) then 2 * l - l2 else 2 * a - a2 end",
]
_BPS = "round((sum(cnt) * log2(sum(cnt)::double) - sum(cnt * log2(cnt::double))) / sum(cnt), 6) + 0.0"

_OFFSETS = "o as (select dy - 2 as dy, dx - 2 as dx from range(5) a(dy), range(5) b(dx))"


def _window(name: str, source: str, pick: str) -> str:
    """A 5 x 5 window over m, edges repeated."""
    return f"{name} as (select c.vec_id, c.y, c.x, {pick}(d.m) as m from {source} c cross join o join {source} d on d.vec_id = c.vec_id and d.y = greatest(0, least(7, c.y + o.dy)) and d.x = greatest(0, least(7, c.x + o.dx)) group by all)"


_HARMONICS = ["sin(1 * pi() * u)", "cos(1 * pi() * u)", "sin(2 * pi() * u)", "cos(2 * pi() * u)"]
_EDGE = """g as (select vec_id, sum(case when y = 7 then v when y = 0 then -v else 0 end) / 56.0::double as gy, sum(case when x = 7 then v when x = 0 then -v else 0 end) / 56.0::double as gx from px group by 1),
  d as (select vec_id, cast(round_even(sin(atan2(gy, gx) + pi() / 2), 0) as int) as dy, cast(round_even(cos(atan2(gy, gx) + pi() / 2), 0) as int) as dx from g)"""
_TAPS = "taps as (select j, (case j when 0 then 1 + s when 1 then 3 + s when 2 then 3 - s else 1 - s end) / (4 * sqrt(2::double)) as low, (case j when 0 then 1 - s when 1 then -(3 - s) when 2 then 3 + s else -(1 + s) end) / (4 * sqrt(2::double)) as high from range(4) t(j), (select sqrt(3::double) as s))"
_TRANSFORMS = "cosine fourier haar db2 singular tucker train pursuit projection".split()
#: Places of a 4 x 4 square after k quarter turns, by (i, j).
_TURNS = " union all ".join(f"select d, {k} as k, i, j, h from halves, range(4) a(i), range(4) b(j) where hy = {y} and hx = {x}" for k, (y, x) in enumerate((("i", "j"), ("j", "3 - i"), ("3 - i", "3 - j"), ("3 - j", "i"))))
_SELF = f"""with {_PX}, first as (select vec_id as d from embeddings order by vec_id limit {POOL}), halves as (select d, y // 2 as hy, x // 2 as hx, avg(v) as h from px join first on d = vec_id group by all),
  turned as ({_TURNS}), pool as (select d, k, i, j, h - avg(h) over (partition by d, k) as h from turned), spread as (select d, k, sum(h * h) / 16 as f from pool group by all),
  parts as (select vec_id, y // 4 as qy, x // 4 as qx, y % 4 as i, x % 4 as j, v - avg(v) over (partition by vec_id, y // 4, x // 4) as w from px), owned as (select vec_id, qy, qx, sum(w * w) / 16 as q from parts group by all),
  cov as (select vec_id, qy, qx, d, k, sum(w * h) / 16 as c from parts join pool using (i, j) group by all),
  e as (select vec_id, qy, qx, min(s * s * f - 2 * s * c + q) as e from (select *, least(1.0::double, case when f > 0 then sqrt(q / f) else 0 end) as s from cov join spread using (d, k) join owned using (vec_id, qy, qx)) group by all)
  select vec_id, cast(sum((greatest(0, e) < 400)::int) as bigint) as matched, round(sum(greatest(0, e)) / 4, 4) + 0.0 as mse from e group by 1"""
SQL = {
    "self_similarity": _SELF,
    "inverse_roundtrips": f"select unnest({_TRANSFORMS}) as transform, n as blocks, n as exact from (select count(*) as n from embeddings)",
    "attention_roundtrip": "select vec_id, true as ok from embeddings",
    "mixing_roundtrip": "select user_id, count(*) as n, 1::bigint as ok from events group by 1",
    "edge_directions": f"with {_PX}, {_EDGE} select p.vec_id, any_value(dy) as dy, any_value(dx) as dx, cast(sum(abs(p.v - q.v)) as bigint) as abs_err from px p join d using (vec_id) join px q on q.vec_id = p.vec_id and q.y = (p.y - dy + 8) % 8 and q.x = (p.x - dx + 8) % 8 group by 1",
    "wavelet_db2": f"""with {_PX}, {_TAPS}, c as (select vec_id, i, x, sum(v * low) as a, sum(v * high) as d from px, range(4) t(i), taps where y = (2 * i + j) % 8 group by all),
      q as (select vec_id, i, k, sum(a * low) as w1, sum(a * high) as w2, sum(d * low) as w3, sum(d * high) as w4 from c, range(4) t(k), taps where x = (2 * k + j) % 8 group by all), r as (select vec_id, unnest([w1, w2, w3, w4]) as w from q),
      e as (select vec_id, sum(w * w) as e, count(*) filter (abs(w) > 20) as large from r group by 1), o as (select vec_id, sum(v * v)::double as o from px group by 1) select vec_id, round(e - o, 4) + 0.0 as energy_change, large from e join o using (vec_id)""",
    "fourier_top": f"""with {_PX}, f as (select vec_id, u, w, sum((v - 128) * cos(pi() * (u * y + w * x) / 4.0::double)) as a, sum((v - 128) * sin(pi() * (u * y + w * x) / 4.0::double)) as b from px, range(8) s(u), range(8) t(w) group by all),
      r as (select vec_id, a * a + b * b as e, row_number() over (partition by vec_id order by a * a + b * b desc) as k from f)
      select vec_id, round(sum(e) filter (k <= 1) / sum(e), 4) as top1, round(sum(e) filter (k <= 8) / sum(e), 4) as top8, round(sum(e) / sum(e), 4) as top64 from r group by 1""",
    "hierarchical_vq": _hierarchical_sql(),
    "block_resize": f"with {_PX}, m as (select vec_id, v - cast(round_even(avg(v) over (partition by vec_id, y // 2, x // 2), 0) as int) as r from px) select vec_id, cast(sum(abs(r)) as bigint) as down_up, 0::bigint as padding from m group by 1",
    "mask_composite": f"with {_PX}, {_OFFSETS}, m0 as (select vec_id, y, x, (v > 128)::int::double as m from px), {_window('m1', 'm0', 'min')}, {_window('m2', 'm1', 'max')}, {_window('m3', 'm2', 'avg')}, c as (select vec_id, cast(round_even(m * v + (1 - m) * 128, 0) as bigint) as c from m3 join px using (vec_id, y, x)) select vec_id, min(c) as low, max(c) as high, cast(sum(c) as bigint) as total from c group by 1",
    "pca_roundtrip": "select count(*) as n, 0::bigint as mismatches from lineitem",
    "harmonic_features": f"with {_PX}, h as (select unnest([0, 1, 2, 3]) as k, [{', '.join(_HARMONICS)}] as h from (select -1 + 2 * y / 7.0::double as u from px)), e as (select k, h[k + 1] as v, exp(h[k + 1] - list_max(h)) / list_sum(list_transform(h, lambda a: exp(a - list_max(h)))) as s from h) select k, round(avg(v), 6) + 0.0 as mean, round(avg(s), 6) as weight from e group by 1",
    "smooth_filter": f"with {_PX}, k as (select vec_id, oy, ox, sum(v * case when y - oy = 1 then 2 else 1 end * case when x - ox = 1 then 2 else 1 end) as s from px cross join range(0, 6) a(oy) cross join range(0, 6) b(ox) where y between oy and oy + 2 and x between ox and ox + 2 group by all) select vec_id, cast(sum(s) as bigint) as total, cast(max(s) as bigint) as top from k group by 1",
    "scalar_mode_entropy": f"with {_NB}, r as ({' union all '.join(f'select {i} as mode_idx, v - least(511, greatest(0, {m})) as r from nb' for i, m in enumerate(_SEVEN))}), k as (select mode_idx, r, count(*) as cnt from r group by all) select cast(mode_idx as int) as mode_idx, {_BPS} as bps from k group by 1",
    "pixel_means": f"with {_NB} select y, cast(round_even(avg(v), 0) as int) as mean, round(avg((v = l)::int::double) * 100, 4) as zero_pct from nb group by 1",
    "coefficient_codes": f"with {_PX}, t as (select v - 128 as c, greatest(1, max(abs(v - 128)) over (partition by vec_id)) as top from px) select cast(round_even(c * 31.0::double / top, 0) as int) as code, count(*) as cnt from t group by 1",
    "finite_rows": "with v as (select cast(round(cast(embedding[1] as double) * 127) as int) as a, cast(round(cast(embedding[2] as double) * 127) as int) as b from embeddings) select b <> 0 as finite, count(*) as rows from v group by 1",
    "cross_channel": f"with {_C}, l as (select regr_slope(g::double, r::double) as s, regr_intercept(g::double, r::double) as i from c), x as (select 'raw' as predictor, g - r as sym from c union all select 'line', g - cast(round_even(s * r + i, 0) as int) from c cross join l), k as (select predictor, sym, count(*) as cnt from x group by all) select predictor, {_BPS} as bps from k group by 1",
    "grey_levels": f"with {_C} select cast((r + g + b) // 3 as int) as grey, count(*) as cnt from c group by 1",
    "clipped_inverse": f"with {_C}, t as (select r, g, b, r - b as co, b + ((r - b) >> 1) as t from c), u as (select *, g - t as cg, t + ((g - t) >> 1) + 3 as y from t), w as (select *, y - (cg >> 1) as t2 from u) select cast(sum((t2 - (co >> 1) + co <> r + 3 or cg + t2 <> g + 3 or t2 - (co >> 1) <> b + 3)::int) as bigint) as lost from w",
    "bounding_boxes": f"with {_PX} select vec_id, greatest(min(y) - 1, 0) as y0, least(max(y) + 1, 7) as y1, greatest(min(x) - 1, 0) as x0, least(max(x) + 1, 7) as x1 from px where v > 140 group by 1",
}

QUERIES = [
    local_fit_residual, edge_directions, self_similarity, patch_kmeans, wavelet_db2, fourier_top, scale_search, layered_model, svd_then_predict, attention_residual, attention_heads, two_scale_codes, program_search, plane_memoriser, block_resize, mask_composite,
    noise_fit, random_projection, random_feature_fit, fourier_codec, procedural_fit, conv_sparse_codes, symbolic_surface, smooth_filter, scalar_mode_entropy, pixel_means, coefficient_codes, finite_rows, hierarchical_vq,
    cross_channel, pca_roundtrip, grey_levels, clipped_inverse, harmonic_features, bounding_boxes, online_mixing, inverse_roundtrips, attention_roundtrip, mixing_roundtrip,
]
