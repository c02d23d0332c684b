"""Queries of containers, headers, videos, batteries of methods, and codecs of several scales."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.operators import containers, fields, linalg, report
from sigloom.operators.codecs import CODERS
from sigloom.functions.scalar import zigzag
from sigloom.operators.entropy import entropy_of, total_bits
from sigloom.operators.neighbours import block_predictions, map_blocks
from sigloom.sources.images import png_bytes
from sigloom.sources.signals import blocks, pixels, table

GOP = 30


def video_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gop, frames, ok): blocks as frames in order of id, coded and decoded by groups of 30 (F02, O14-O16), with their row means as sound.

    A group starts with an intra frame, so that groups are decoded in parallel.
    """

    def code(rows: pd.DataFrame) -> pd.DataFrame:
        frames = [np.array(v, np.int64).reshape(8, 8) for v in rows.sort_values("vec_id").vec]
        sound = [int(m) * 257 - 32768 for f in frames for m in f.mean(1)]
        back, heard = containers.unpack_video(containers.pack_video(frames, audio=sound, gop=GOP))
        return pd.DataFrame({"gop": [rows.gop.iloc[0]], "frames": [len(frames)], "ok": [heard == sound and all((a == b).all() for a, b in zip(frames, back, strict=True))]})

    return blocks(spark, sf_dir).select(F.floor(F.col("vec_id") / GOP).alias("gop"), "vec_id", "vec").groupBy("gop").applyInPandas(code, "gop long, frames long, ok boolean")


def svd_container_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rank, bytes, psnr): singular containers decoded again."""

    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        rows = [(i, r, len(blob), float(((containers.unpack_svd(blob)[0] - b) ** 2).sum())) for i, b in zip(ids, v, strict=True) for r in (1, 3, 8) for blob in [containers.pack_svd([b], r)]]
        return dict(zip(("vec_id", "rank", "bytes", "sse"), map(np.array, zip(*rows, strict=True)), strict=True))

    out = map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, rank long, bytes long, sse double")
    mse = F.sum("sse") / (F.count("*") * 64)
    return out.groupBy("rank").agg(F.sum("bytes").alias("bytes"), F.when(mse == 0, float("inf")).otherwise(F.round(F.log10(65025 / mse) * 10, 2)).alias("psnr"))


def decode_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, blocks, exact): blocks packed in five kinds of artifacts by their id, decoded by what their first bytes say."""
    kinds = {
        "planes": lambda b: containers.pack_planes([b]), "video": lambda b: containers.pack_video([b]), "palette": lambda b: containers.pack_palette(b, [(g,) * 3 for g in range(256)]),
        "standard": lambda b: png_bytes(np.stack([b] * 3, -1)), "small": lambda b: containers.pack_small(containers.pack_planes([b]), None),
    }

    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        names = list(kinds)
        blobs = [kinds[names[i % len(names)]](b) for i, b in zip(ids, v.astype(np.int64), strict=True)]
        return {"kind": np.array([containers.kind_of(x) for x in blobs]), "ok": np.array([int((containers.decode(x, (8, 8)) == b).all()) for x, b in zip(blobs, v, strict=True)])}

    return map_blocks(blocks(spark, sf_dir), kernel, "kind string, ok long").groupBy("kind").agg(F.count("*").alias("blocks"), F.sum("ok").alias("exact"))


def _le(v: Column, n: int) -> Column:
    """An integer as n bytes, low byte first, in hexadecimal."""
    return F.concat(*(F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(n)))


def _from_le(h: Column, at: int, n: int) -> Column:
    """The integer of n bytes from byte `at` of a hexadecimal blob, low byte first."""
    return F.conv(F.concat(*(F.substring(h, 2 * (at + i) + 1, 2) for i in range(n - 1, -1, -1))), 16, 10).cast("int")


#: Kind -> (magic in hexadecimal, bytes between magic and width, bytes of width and height).
HEADERS = {"planes": ("5052534D", 1, 4), "video": ("4E585631", 0, 4), "svd": ("53564431", 0, 2), "palette": ("4350414C", 0, 2), "hybrid": ("43485942", 3, 2), "parametric": ("43504152", 1, 1), "semantic": ("53454D00", 4, 2)}


def container_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, n, widths, heights): headers of all kinds written and read by columns alone (F01-F08, P08). Dimensions come from lineitem."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % len(HEADERS)).cast("int").alias("k"), (F.col("l_quantity") % 50 + 1).cast("int").alias("w"), (F.col("l_linenumber") * 9).cast("int").alias("h"))
    blob = F.lit(None).cast("string")
    for i, (magic, gap, n) in enumerate(HEADERS.values()):
        blob = F.when(F.col("k") == i, F.concat(F.lit(magic + "01" * gap), _le(F.col("w"), n), _le(F.col("h"), n))).otherwise(blob)
    x = F.hex("blob")
    kind, w, h = F.lit("standard"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, (magic, gap, n) in HEADERS.items():
        is_kind = F.substring(x, 1, 8) == magic
        kind, w, h = F.when(is_kind, name).otherwise(kind), F.when(is_kind, _from_le(x, 4 + gap, n)).otherwise(w), F.when(is_kind, _from_le(x, 4 + gap + n, n)).otherwise(h)
    return rows.select(F.unhex(blob).alias("blob")).select(kind.alias("kind"), w.alias("w"), h.alias("h")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("w").alias("widths"), F.sum("h").alias("heights"))


def json_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(algo, n, total): compact headers written as JSON and parsed again."""
    docs = table(spark, sf_dir, "documents")
    head = F.to_json(F.struct(F.element_at(F.array(*map(F.lit, ("raw", "zlib", "bz2", "lzma"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int")).alias("algo"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size")))
    return docs.select(F.from_json(head, "algo string, sha256 string, size int").alias("h")).groupBy("h.algo").agg(F.count("*").alias("n"), F.sum("h.size").alias("total"), F.countDistinct("h.sha256").alias("hashes"))


def giant_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, bits): a text's bytes as one number: eight bits a byte less its leading zeros."""
    first = F.conv(F.substring(F.hex(F.encode("text", "UTF-8")), 1, 2), 16, 10).cast("int")
    bits = F.when(F.length("text") == 0, 0).otherwise(F.octet_length("text") * 8 - 8 + F.length(F.bin(first)))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(bits).alias("bits"))


def entropy_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, kb): size of all blocks estimated from the first rows' bits per pixel, and counted."""
    px = pixels(spark, sf_dir)
    first = total_bits(px.where("y < 2").select(F.lit(0).alias("g"), F.col("v").alias("sym")), ["g"], digits=6).select(F.lit("estimate").alias("part"), F.round(F.col("bits") * 4 / 8192, 4).alias("kb"))
    whole = total_bits(px.select(F.lit(0).alias("g"), F.col("v").alias("sym")), ["g"], digits=6).select(F.lit("counted").alias("part"), F.round(F.col("bits") / 8192, 4).alias("kb"))
    return first.union(whole)


#: Parameters of the battery's sweeps.
RANKS, GREYS, FACTORS, PERCENTILES = (5, 10, 20, 50, 100), (8, 16, 32, 64, 128, 256), (2, 4, 8), (90, 95, 99)
#: A plane of the battery: so many blocks in order of id, side by side.
ACROSS = 4


def _greys(plane: np.ndarray, k: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(indices, levels) of a plane in k greys: Lloyd steps over its histogram from levels of even shares (T06, K02); ends when no index moves."""
    values, counts = np.unique(plane, return_counts=True)
    share = (np.cumsum(counts) - counts / 2) / counts.sum()
    levels = np.unique(values[np.minimum(np.searchsorted(share, (np.arange(k) + 0.5) / k), len(values) - 1)].astype(float))
    near = None
    for _ in range(rounds):
        new = np.abs(values[:, None] - levels).argmin(1)
        if near is not None and (new == near).all():
            break
        near = new
        mass = np.bincount(near, counts, len(levels))
        levels = np.where(mass > 0, np.bincount(near, counts * values, len(levels)) / np.maximum(mass, 1), levels)
    return near[np.searchsorted(values, plane)], np.rint(levels).astype(int)


def _ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Structural similarity by 7 x 7 box windows and sample moments."""
    win = lambda x: np.lib.stride_tricks.sliding_window_view(x.astype(float), (7, 7)).reshape(-1, 49)
    x, y = win(a), win(b)
    mx, my = x.mean(1), y.mean(1)
    vx, vy, c = x.var(1, ddof=1), y.var(1, ddof=1), ((x - mx[:, None]) * (y - my[:, None])).sum(1) / 48
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float(((2 * mx * my + c1) * (2 * c + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())


def battery(b: np.ndarray) -> list[tuple[str, int, bytes, np.ndarray]]:
    """(method, tier, blob, plane again) of a square plane by a registry of methods."""
    raw = b.astype(np.uint8).tobytes()
    small = lambda q: zlib.compress(q.astype("<i2").tobytes(), 9)
    out = [(f"lossless_{k}", 1, e(raw), b) for k, (e, _) in CODERS.items()]
    out.append(("lossless_modes", 1, containers.pack_planes([b]), b))
    out += [(f"svd_rank{r}", 4, blob, containers.unpack_svd(blob)[0]) for r in RANKS for blob in [containers.pack_svd([b], r)]]
    for k in GREYS:
        at, levels = _greys(b, k)
        blob = containers.pack_palette(at, [(int(g),) * 3 for g in levels])
        out.append((f"palette_k{k}", 3, blob, containers.unpack_palette(blob)[:, :, 0].astype(int)))
    for f in FACTORS:
        part = fields.box_down(b, f)
        out.append((f"downscale_{f}x", 4, zlib.compress(part.astype(np.uint8).tobytes(), 9), fields.resize(part, *b.shape)))
    spectra = {"dct": (linalg.dct2(b - 128.0), linalg.idct2), **{f"wavelet_{w}": (m @ (b - 128.0) @ m.T, lambda c, m=m: m.T @ c @ m) for w in ("haar", "db2") for m in [fields.wavelet_matrix(w, len(b))]}}
    for name, (c, back) in spectra.items():
        for pct in PERCENTILES:
            kept = np.rint(np.where(np.abs(c) >= np.percentile(np.abs(c), pct), c, 0))
            out.append((f"{name}_pct{pct}", 4, small(kept), np.clip(np.rint(back(kept) + 128), 0, 255).astype(int)))
    for name, tier, blob, plane in [m for m in out if m[1] > 1]:  # a second pass over the artifacts (T10)
        out.append((f"{name}+again", 5, min((e(blob) for e, _ in CODERS.values()), key=len), plane))
    return out


def method_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tier, rnk, name, compressed_size, ratio, psnr, ssim): every method over planes of blocks, ranked in its tier."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tiles = np.zeros((ACROSS * ACROSS, 8, 8), np.int64) + 128
        for i, v in zip(rows.vec_id % (ACROSS * ACROSS), rows.vec, strict=True):
            tiles[i] = np.array(v).reshape(8, 8)
        b = tiles.reshape(ACROSS, ACROSS, 8, 8).swapaxes(1, 2).reshape(8 * ACROSS, 8 * ACROSS)
        return pd.DataFrame([(n, t, len(blob), float(((p - b) ** 2).sum()), _ssim(b, p)) for n, t, blob, p in battery(b)], columns=["name", "tier", "bytes", "sse", "s"])

    planes = blocks(spark, sf_dir).select(F.floor(F.col("vec_id") / (ACROSS * ACROSS)).alias("plane"), "vec_id", "vec")
    each = planes.groupBy("plane").applyInPandas(run, "name string, tier long, bytes long, sse double, s double")
    pixels_of = F.count("*") * 64 * ACROSS * ACROSS
    mse = F.sum("sse") / pixels_of
    sums = each.groupBy("tier", "name").agg(
        pixels_of.alias("original_size"), F.sum("bytes").alias("compressed_size"), F.when(mse == 0, float("inf")).otherwise(F.round(F.log10(65025 / mse) * 10, 2)).alias("psnr"), F.round(F.avg("s"), 4).alias("ssim")
    )
    return report.leaderboard(sums).select("tier", "rnk", "name", "compressed_size", "ratio", "psnr", "ssim")


def sparse_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component, bytes): dictionary, atom indices, counts, coefficients and rest of four-atom codes."""
    atoms = linalg.dct_atoms()

    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        rows = []
        for i, b in zip(ids, v, strict=True):
            chosen, coef, _ = linalg.pursuit(atoms, b.ravel() - 128.0, 4)
            q = np.rint(coef / 4).astype(int)
            rest = b.ravel() - 128 - np.rint(atoms[:, chosen] @ (q * 4.0)).astype(int)
            rows += [(i, "coefficient", int(x)) for x in q] + [(i, "index", int(x)) for x in chosen] + [(i, "residual", int(x)) for x in rest]
        return dict(zip(("vec_id", "component", "sym"), map(np.array, zip(*rows, strict=True)), strict=True))

    parts = map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, component string, sym long")
    costs = total_bits(parts, ["component"], digits=3)
    return costs.select("component", F.when(F.col("component") == "index", F.col("n") * 6.0).otherwise(F.col("bits")).alias("bits")).select("component", F.ceil(F.col("bits") / 8).alias("bytes"))


def _scales(b: np.ndarray) -> tuple[float, ...]:
    """Bits of what a surface over the halved block, then the tiles' means, then the median-edge predictor leave."""
    half = fields.box_down(b, 2)
    coarse = fields.resize(linalg.surface_fit(half, 2)[1], 8, 8)
    rest = b - coarse
    tiles = rest - np.repeat(np.repeat(fields.box_down(rest, 4), 4, 0), 4, 1)
    left, above, gradient = block_predictions(tiles[None], border=0)[:3]
    med = np.median(np.stack([left[0], above[0], gradient[0]]), 0).astype(int)
    return tuple(round(fields.entropy_bits(x), 4) for x in (rest, tiles, tiles - med))


def multi_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        return {"vec_id": ids, **dict(zip(("surface_bits", "tile_bits", "edge_bits"), map(np.array, zip(*map(_scales, v.astype(np.int64)), strict=True)), strict=True))}

    return map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, surface_bits double, tile_bits double, edge_bits double")


def blend(plane: np.ndarray, back: bool) -> np.ndarray:
    """Residuals of a plane by a softmax blend of left, above and their gradient, weights by past errors; or the plane of residuals."""
    h, w = plane.shape
    frame, out, errors = (np.zeros_like(plane) if back else plane), np.zeros_like(plane), [0.0] * 3
    for y in range(h):
        for x in range(w):
            left, above = int(frame[y, x - 1]) if x else 128, int(frame[y - 1, x]) if y else 128
            preds = (left, above, left + above - (int(frame[y - 1, x - 1]) if x and y else 128))
            weights = [math.exp(-(e - min(errors)) / 8) for e in errors]
            p = math.floor(sum(a * b for a, b in zip(weights, preds, strict=True)) / sum(weights) + 0.5)
            if back:
                frame[y, x] = plane[y, x] + p
            else:
                out[y, x] = plane[y, x] - p
            errors = [0.9 * e + 0.1 * abs(int(frame[y, x]) - q) for e, q in zip(errors, preds, strict=True)]
    return frame if back else out


def blend_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        return {"vec_id": ids, "ok": np.array([bool((blend(blend(b, False), True) == b).all()) for b in v.astype(np.int64)])}

    return map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, ok boolean")


#: Fixed values: (tier, format, name of the parameter, its values) of the sweeps by coders that are not on the box.
SWEEPS = [
    (2, "jpeg", "quality", [95, 97, 99, 100]), (2, "webp", "quality", [95, 97, 99, 100]), (2, "jxl", "distance", [0.1, 0.2, 0.3, 0.5]), (2, "avif", "quality", [90, 95, 97, 100]),
    (3, "jxl", "distance", [1.0, 2.0, 3.0, 5.0, 8.0, 10.0, 15.0]),
]
#: Qualities that the lossy sweeps of jpeg, webp and avif take.
QUALITIES = [90, 80, 70, 60, 50, 40, 30, 20, 10]


def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tier, format, parameter, runs, low, high): the sweeps of coders that are not on the box, as data."""
    rows = [(t, f, p, float(v)) for t, f, p, vs in SWEEPS + [(3, f, "quality", QUALITIES) for f in ("jpeg", "webp", "avif")] for v in vs]
    grid = spark.createDataFrame(rows, "tier int, format string, parameter string, value double")
    return grid.groupBy("tier", "format", "parameter").agg(F.count("*").alias("runs"), F.min("value").alias("low"), F.max("value").alias("high"))


def clamp_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_returnflag, clipped, bits): prices in cents, clipped to 16 bits, at the entropy of their zig-zag."""
    cents = F.round(F.col("l_extendedprice") * 2).cast("int") - 50_000
    v = F.greatest(F.lit(-32768), F.least(F.lit(32767), cents))
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (v != cents).cast("int").alias("cut"), zigzag(v).alias("sym"))
    counts = rows.groupBy("l_returnflag", "sym").agg(F.count("*").alias("cnt"), F.sum("cut").alias("cut"))
    bits, _ = entropy_of()
    return counts.groupBy("l_returnflag").agg(F.sum("cut").alias("clipped"), (F.round(bits, 2) + 0.0).alias("bits"))


def adaptive_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, abs_err): each row of a block from the row of its 4-bit form by a line, that of the whole block at first, then moved by a
    twentieth to each row's own (W06)."""

    def kernel(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        t = v.astype(np.int64)
        r = t // 16

        def line(t: np.ndarray, r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
            axes = tuple(range(1, t.ndim))
            sr, st = r.sum(axes), t.sum(axes)
            a = ((n * (r * t).sum(axes) - sr * st) / (n * n)) / ((n * (r * r).sum(axes) - sr * sr) / (n * n) + 1e-10)
            return a, st / n - a * (sr / n)

        a, b = line(t, r, 64)
        total = np.zeros(len(t), np.int64)
        for y in range(8):
            total += np.abs(t[:, y] - np.rint(a[:, None] * r[:, y] + b[:, None]).astype(np.int64)).sum(1)
            ra, rb = line(t[:, y], r[:, y], 8)
            a, b = 0.95 * a + (1 - 0.95) * ra, 0.95 * b + (1 - 0.95) * rb
        return {"vec_id": ids, "abs_err": total}

    return map_blocks(blocks(spark, sf_dir), kernel, "vec_id long, abs_err long")


def duplicate_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level_bits, patches, distinct, top): distinct 2 x 2 patches when pixels are cut to so many bits."""
    px = pixels(spark, sf_dir).select("vec_id", "y", "x", "v", F.explode(F.array(*map(F.lit, (7, 6, 5, 4)))).alias("level_bits"))
    q = F.floor(F.col("v") / F.pow(F.lit(2.0), 8 - F.col("level_bits"))).cast("long")
    key = F.sum(q * F.pow(F.lit(256.0), (F.col("y") % 2) * 2 + F.col("x") % 2).cast("long"))
    patches = px.groupBy("level_bits", "vec_id", F.shiftright("y", 1).alias("by"), F.shiftright("x", 1).alias("bx")).agg(key.alias("patch"))
    counts = patches.groupBy("level_bits", "patch").agg(F.count("*").alias("n"))
    return counts.groupBy("level_bits").agg(F.sum("n").alias("patches"), F.count("*").alias("distinct"), F.max("n").alias("top"))


def lag_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lag, corr): correlation of pixels with those so many before them in their row."""
    w = Window.partitionBy("vec_id", "y").orderBy("x")
    px = pixels(spark, sf_dir).select("v", *(F.lag("v", i).over(w).alias(f"b{i}") for i in (1, 2, 4)))
    sums = px.agg(*(F.corr("v", f"b{i}").alias(f"c{i}") for i in (1, 2, 4)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(i).alias("lag"), F.round(f"c{i}", 6).alias("corr")) for i in (1, 2, 4)))).alias("r")).select("r.*")


_PX = "px as (select vec_id, cast(p as int) as p, cast(p // 8 as int) as y, cast(p % 8 as int) as x, cast(round(cast(e as double) * 127 + 128) as int) as v from (select vec_id, unnest(embedding) as e, unnest(range(64)) as p from embeddings))"
_B = "sum(cnt) * log2(sum(cnt)::double) - sum(cnt * log2(cnt::double))"

_LINE = "(({n} * sum(r * t) - sum(r) * sum(t)) / ({n} * {n})::double) / (({n} * sum(r * r) - sum(r) * sum(r)) / ({n} * {n})::double + 1e-10::double)"
_SWEEP = ", ".join(f"({t}, '{f}', '{p}', {float(v)}::double)" for t, f, p, vs in SWEEPS + [(3, f, "quality", QUALITIES) for f in ("jpeg", "webp", "avif")] for v in vs)

SQL = {
    "video_roundtrip": f"select vec_id // {GOP} as gop, count(*) as frames, true as ok from embeddings group by 1",
    "decode_dispatch": "select (['planes', 'video', 'palette', 'standard', 'small'])[vec_id % 5 + 1] as kind, count(*) as blocks, count(*) as exact from embeddings group by 1",
    "blend_roundtrip": "select vec_id, true as ok from embeddings",
    "sweep_grid": f"select cast(t as int) as tier, f as format, p as parameter, count(*) as runs, min(v) as low, max(v) as high from (values {_SWEEP}) g(t, f, p, v) group by all",
    "clamp_cost": f"with c as (select l_returnflag, cast(round(l_extendedprice * 2) as int) - 50000 as c from lineitem), v as (select l_returnflag, c, greatest(-32768, least(32767, c)) as v from c), k as (select l_returnflag, case when v >= 0 then 2 * v else -2 * v - 1 end as sym, count(*) as cnt, sum((v <> c)::int) as cut from v group by all) select l_returnflag, cast(sum(cut) as bigint) as clipped, round({_B}, 2) + 0.0 as bits from k group by 1",
    "adaptive_line": f"""with recursive {_PX}, tr as (select vec_id, y, x, v as t, v // 16 as r from px),
      g as (select vec_id, a, st / 64.0::double - a * (sr / 64.0::double) as b from (select vec_id, {_LINE.format(n=64)} as a, sum(t) as st, sum(r) as sr from tr group by 1)),
      l as (select vec_id, y, a, st / 8.0::double - a * (sr / 8.0::double) as b from (select vec_id, y, {_LINE.format(n=8)} as a, sum(t) as st, sum(r) as sr from tr group by all)),
      w as (select vec_id, 0 as y, a, b from g union all select w.vec_id, w.y + 1, 0.95::double * w.a + (1 - 0.95::double) * l.a, 0.95::double * w.b + (1 - 0.95::double) * l.b from w join l on l.vec_id = w.vec_id and l.y = w.y where w.y < 7)
      select vec_id, cast(sum(abs(t - cast(round_even(a * r + b, 0) as bigint))) as bigint) as abs_err from w join tr using (vec_id, y) group by 1""",
    "container_headers": f"select ([{', '.join(repr(k) for k in HEADERS)}])[l_partkey % {len(HEADERS)} + 1] as kind, count(*) as n, cast(sum(cast(l_quantity as int) % 50 + 1) as bigint) as widths, cast(sum(l_linenumber * 9) as bigint) as heights from lineitem group by 1",
    "json_header": "select (['raw', 'zlib', 'bz2', 'lzma'])[doc_id % 4 + 1] as algo, count(*) as n, cast(sum(octet_length(encode(text))) as bigint) as total, count(distinct sha256(text)) as hashes from documents group by 1",
    "giant_integers": "select source, cast(sum(case when length(text) = 0 then 0 else octet_length(encode(text)) * 8 - 8 + length(ltrim(bin(('0x' || substring(hex(encode(text)), 1, 2))::int), '0')) end) as bigint) as bits from documents group by 1",
    "entropy_estimate": f"with {_PX}, a as (select v, count(*) as cnt from px where y < 2 group by 1), b as (select v, count(*) as cnt from px group by 1) select 'estimate' as part, round(round({_B}, 6) * 4 / 8192, 4) as kb from a union all select 'counted', round(round({_B}, 6) / 8192, 4) from b",
    "duplicate_share": f"with {_PX}, k as (select b as level_bits, vec_id, y >> 1 as by, x >> 1 as bx, sum((v // cast(pow(2, 8 - b) as int))::bigint * cast(pow(256, (y % 2) * 2 + x % 2) as bigint)) as patch from px cross join (values (7), (6), (5), (4)) t(b) group by all), c as (select level_bits, patch, count(*) as n from k group by all) select cast(level_bits as int) as level_bits, cast(sum(n) as bigint) as patches, count(*) as distinct, max(n) as top from c group by 1".replace("as distinct", 'as "distinct"'),
    "lag_autocorrelation": f"with {_PX}, b as (select v, lag(v, 1) over w as b1, lag(v, 2) over w as b2, lag(v, 4) over w as b4 from px window w as (partition by vec_id, y order by x)) select 1 as lag, round(corr(v::double, b1::double), 6) as corr from b union all select 2, round(corr(v::double, b2::double), 6) from b union all select 4, round(corr(v::double, b4::double), 6) from b",
}

QUERIES = [
    video_roundtrip, decode_dispatch, svd_container_psnr, container_headers, json_header, giant_integers, entropy_estimate, method_battery, sparse_cost, multi_scale, blend_roundtrip, sweep_grid, clamp_cost, adaptive_line, duplicate_share, lag_autocorrelation,
]
