"""Planes made or changed as wholes: filters, wavelets, Fourier, noise, masks, self-similarity, local fits. NumPy kernels for one plane."""

from __future__ import annotations

import math

import numpy as np


def correlate_valid(v: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sliding dot products without padding, the kernel not turned."""
    kh, kw = kernel.shape
    return np.einsum("yxij,ij->yx", np.lib.stride_tricks.sliding_window_view(v, (kh, kw)), kernel)


def convolve_full(v: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The adjoint: padded all round, the kernel turned."""
    kh, kw = kernel.shape
    return correlate_valid(np.pad(v, ((kh - 1, kh - 1), (kw - 1, kw - 1))), kernel[::-1, ::-1])


_S3 = math.sqrt(3)
DB2 = np.array([1 + _S3, 3 + _S3, 3 - _S3, 1 - _S3]) / (4 * math.sqrt(2))


def db2(v: np.ndarray) -> np.ndarray:
    """One level of the four-tap orthogonal wavelet along both axes, periodic, averages first."""
    high = DB2[::-1] * np.array([1, -1, 1, -1])
    for axis in (0, 1):
        rolled = [np.roll(v, -i, axis) for i in range(4)]
        even = (slice(None),) * axis + (slice(0, None, 2),)
        v = np.concatenate([sum(f[i] * rolled[i][even] for i in range(4)) for f in (DB2, high)], axis)
    return v


def wavelet_matrix(name: str, n: int) -> np.ndarray:
    """One level of an orthogonal wavelet over n periodic samples, averages in the upper half (C33): two equal taps, or the four of DB2."""
    low = np.full(2, math.sqrt(0.5)) if name == "haar" else DB2
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    m = np.zeros((n, n))
    for i in range(n // 2):
        for j in range(len(low)):
            m[i, (2 * i + j) % n] += low[j]
            m[n // 2 + i, (2 * i + j) % n] += high[j]
    return m


def fourier_top(v: np.ndarray, keep: int) -> tuple[np.ndarray, float]:
    """(the plane of its `keep` strongest Fourier coefficients, their share of the energy) (C34, L22, A11); ties to the first."""
    f = np.fft.fft2(v)
    size = np.abs(f).ravel()
    top = np.argsort(-np.round(size, 9), kind="stable")[:keep]
    g = np.zeros(f.size, complex)
    g[top] = f.ravel()[top]
    total = float((size**2).sum())
    return np.fft.ifft2(g.reshape(f.shape)).real, float((size[top] ** 2).sum() / total) if total else 1.0


def gradient_noise(h: int, w: int, cells: int, seed: int) -> np.ndarray:
    """Noise of random gradients on a grid, with the quintic fade."""
    angle = np.random.default_rng(seed).uniform(0, 2 * math.pi, (cells + 1, cells + 1))
    y, x = np.meshgrid(np.linspace(0, cells, h, endpoint=False), np.linspace(0, cells, w, endpoint=False), indexing="ij")
    iy, ix = y.astype(int), x.astype(int)
    fy, fx = y - iy, x - ix
    fade = lambda t: t * t * t * (t * (6 * t - 15) + 10)
    dot = lambda dy, dx: np.cos(angle[iy + dy, ix + dx]) * (fx - dx) + np.sin(angle[iy + dy, ix + dx]) * (fy - dy)
    top = dot(0, 0) + fade(fx) * (dot(0, 1) - dot(0, 0))
    return top + fade(fy) * (dot(1, 0) + fade(fx) * (dot(1, 1) - dot(1, 0)) - top)


def cell_distance(h: int, w: int, points: np.ndarray) -> np.ndarray:
    """Distance to the nearest of points (y, x in 0..1)."""
    y, x = np.meshgrid(np.linspace(0, 1, h), np.linspace(0, 1, w), indexing="ij")
    return np.sqrt(((y[..., None] - points[:, 0]) ** 2 + (x[..., None] - points[:, 1]) ** 2).min(-1))


def _spread(mask: np.ndarray, pick, pad: int = 2) -> np.ndarray:
    edge = np.pad(mask, pad, mode="edge")
    return pick(np.lib.stride_tricks.sliding_window_view(edge, (2 * pad + 1, 2 * pad + 1)), (2, 3))


def composite(front: np.ndarray, back: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """front over back where mask is set, its edge eroded, dilated and blurred by 5 x 5 windows."""
    soft = _spread(_spread(_spread(mask.astype(float), np.min), np.max), np.mean)
    return np.rint(soft * front + (1 - soft) * back).astype(np.int64)


def resize(v: np.ndarray, h: int, w: int) -> np.ndarray:
    """Nearest samples."""
    return v[np.arange(h)[:, None] * v.shape[0] // h, np.arange(w) * v.shape[1] // w]


def box_down(v: np.ndarray, f: int) -> np.ndarray:
    """Means of f x f boxes, rounded half to even."""
    h, w = v.shape[0] // f, v.shape[1] // f
    return np.rint(v[: h * f, : w * f].reshape(h, f, w, f).mean((1, 3))).astype(np.int64)


def pad_to(v: np.ndarray, step: int) -> np.ndarray:
    """Edges repeated up to multiples of step."""
    return np.pad(v, ((0, -v.shape[0] % step), (0, -v.shape[1] % step)), mode="edge")


def local_fit(v: np.ndarray, block: int = 4, border: int = 128) -> np.ndarray:
    """Each block extrapolated from a polynomial in the two rows above (two columns wider each way) and the two columns to its left (W04):
    degree 2 from six samples, 1 from three, else their mean, or the border."""
    h, w = v.shape
    out = np.zeros_like(v)
    terms = lambda y, x, d: np.stack([y**i * x**j for i in range(d + 1) for j in range(d + 1 - i)], -1)
    for by in range(0, h, block):
        for bx in range(0, w, block):
            ctx = [(y, x) for y in range(max(0, by - 2), by) for x in range(max(0, bx - 2), min(w, bx + block + 2))] + [(y, x) for y in range(by, min(h, by + block)) for x in range(max(0, bx - 2), bx)]
            yy, xx = np.mgrid[by : min(h, by + block), bx : min(w, bx + block)]
            if len(ctx) < 3:
                out[yy, xx] = round(float(np.mean([v[c] for c in ctx]))) if ctx else border
                continue
            a = np.array(ctx, float) - (by, bx)
            d = 2 if len(ctx) >= 6 else 1
            c = np.linalg.lstsq(terms(a[:, 0], a[:, 1], d), np.array([v[p] for p in ctx], float), rcond=None)[0]
            out[yy, xx] = np.clip(np.rint(terms(yy - float(by), xx - float(bx), d) @ c), 0, 255)
    return out


def edge_direction(v: np.ndarray) -> tuple[int, int]:
    """The step (dy, dx) along the mean gradient's normal, rounded to a neighbour."""
    gy, gx = float(np.diff(v, axis=0).mean()), float(np.diff(v, axis=1).mean())
    along = math.atan2(gy, gx) + math.pi / 2
    return round(math.sin(along)), round(math.cos(along))


def domains(planes: np.ndarray) -> np.ndarray:
    """Planes halved by box means, in four turns each, as rows of 16 less their means."""
    half = planes.astype(float).reshape(len(planes), 4, 2, 4, 2).mean((2, 4))
    turned = np.concatenate([np.rot90(half, k, (1, 2)) for k in range(4)]).reshape(-1, 16)
    return turned - turned.mean(1, keepdims=True)


def domain_errors(planes: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Mean squared errors (planes, 4) of 4 x 4 quarters by the best domain of a pool, brightness from means, contrast from deviations, at most one."""
    parts = planes.reshape(-1, 2, 4, 2, 4).swapaxes(2, 3).reshape(-1, 16)
    parts = parts - parts.mean(1, keepdims=True)
    own, of = (parts**2).mean(1), (pool**2).mean(1)
    scale = np.minimum(1.0, np.sqrt(own[:, None] / np.where(of > 0, of, np.inf)))
    errors = scale**2 * of - 2 * scale * (parts @ pool.T / 16) + own[:, None]
    return np.maximum(0, errors.min(1)).reshape(-1, 4)


def patch_means(v: np.ndarray, k: int = 4, rounds: int = 10) -> np.ndarray:
    """The plane from k means of its 4 x 4 patches (M07), seeds first patches."""
    p = v.reshape(2, 4, 2, 4).swapaxes(1, 2).reshape(4, 16).astype(float)
    centres = np.unique(p, axis=0)[:k]
    near = np.zeros(len(p), int)
    for _ in range(rounds):
        near = ((p[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([p[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        if np.allclose(new, centres):
            break
        centres = new
    return np.rint(centres[near]).astype(np.int64).reshape(2, 2, 4, 4).swapaxes(1, 2).reshape(8, 8)


def best_scale(c: np.ndarray, low: float = 0.05, high: float = 4.0) -> tuple[float, float]:
    """(scale, cost in bits) of rounded c * scale with its error's log, by a coarse geometric and a fine search around it."""

    def cost(s: float) -> float:
        q = np.rint(c * s)
        n = np.unique(q, return_counts=True)[1]
        left = np.rint(c - q / s)
        m = np.unique(left, return_counts=True)[1]
        return float((n * np.log2(c.size / n)).sum() + (m * np.log2(c.size / m)).sum())

    coarse = min(np.geomspace(low, high, 12), key=lambda s: (cost(s), s))
    fine = min(np.linspace(coarse * 0.8, coarse * 1.2, 9), key=lambda s: (cost(s), s))
    return float(fine), cost(fine)


def layered(v: np.ndarray) -> list[np.ndarray]:
    """What is left of a plane after its mean, then its first singular triple, then block means of side 4."""
    out, rest = [], v.astype(np.int64)
    for model in (lambda r: np.full_like(r, round(float(r.mean()))), _rank1, lambda r: np.repeat(np.repeat(box_down(r, 4), 4, 0), 4, 1)):
        rest = rest - model(rest)
        out.append(rest)
    return out


def _rank1(r: np.ndarray) -> np.ndarray:
    u, s, vt = np.linalg.svd(r.astype(float))
    return np.rint(s[0] * np.outer(u[:, 0], vt[0])).astype(np.int64)


def entropy_bits(r: np.ndarray) -> float:
    n = np.unique(r, return_counts=True)[1]
    return float((n * np.log2(r.size / n)).sum())


def attention_residuals(v: np.ndarray, window: int = 12, width: int = 4, rate: float = 0.01, seed: int = 2, heads: int = 1, other: np.ndarray | None = None, back: bool = False) -> np.ndarray:
    """Online prediction by attention over the nearest earlier samples: two small projections a head, learned as it goes, the heads'
    predictions averaged (W17, O13). other: a plane known already, whose co-located samples are a feature more, so that attention crosses channels.
    back: v are residuals, and the samples come back."""
    rng = np.random.default_rng(seed)
    h, w = v.shape
    x = np.zeros(v.shape) if back else v / 255.0
    side = None if other is None else other / 255.0
    n = 4 + (side is not None)
    wq, wk = rng.normal(0, 0.3, (heads, n, width)), rng.normal(0, 0.3, (heads, n, width))
    out = np.zeros_like(v)
    feat = lambda y, k: np.array([x[y, k - 1] if k else 0.5, x[y - 1, k] if y else 0.5, y / h, k / w, *(() if side is None else (side[y, k],))])
    spots = sorted(((dy, dx) for dy in range(3) for dx in range(-2, 3) if dy or dx > 0), key=lambda s: (s[0] ** 2 + s[1] ** 2, s))
    for y in range(h):
        for k in range(w):
            seen = [(y - dy, k - dx) for dy, dx in spots if y >= dy and 0 <= k - dx < w][:window]
            if not seen:
                out[y, k] = v[y, k] + (128 if back else -128)
                x[y, k] = (out if back else v)[y, k] / 255.0
                continue
            f, fs, vs = feat(y, k), np.array([feat(*s) for s in seen]), np.array([x[s] for s in seen])
            q, ks = f @ wq, fs @ wk  # heads x width, heads x seen x width
            a = np.exp((ks @ q[:, :, None])[:, :, 0] / math.sqrt(width))
            a /= a.sum(1, keepdims=True)
            each = a @ vs
            p = float(each.mean())
            out[y, k] = v[y, k] + (round(p * 255) if back else -round(p * 255))
            x[y, k] = (out if back else v)[y, k] / 255.0
            g = 2 * (p - x[y, k]) / heads * a * (vs - each[:, None]) / math.sqrt(width)
            wq -= rate * f[:, None] * (g[:, None] @ ks)
            wk -= rate * np.einsum("sn,hs,hw->hnw", fs, g, q)
    return out


def evolve_program(v: np.ndarray, people: int = 12, rounds: int = 6, seed: int = 0) -> tuple[tuple, float]:
    """(program, mean squared error) of a small stack-program search: tournaments of three, crossover, mutation, the best kept."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[: v.shape[0], : v.shape[1]] / max(1, v.shape[0] - 1)
    goal = v / 255.0
    ops = [lambda a, b: a + b, lambda a, b: a * b, lambda a, b: np.sin(3 * a + b), lambda a, b: np.cos(3 * a - b), lambda a, b: np.sqrt(np.abs(a)), lambda a, b: np.clip(a, 0, 1), lambda a, b: 0.5 * (a + b)]

    def run(program: tuple) -> np.ndarray:
        steps = [x, y, np.full_like(x, 0.5)]
        for op, i, j in program:
            steps.append(ops[op](steps[i % len(steps)], steps[j % len(steps)]))
        return steps[-1]

    error = lambda p: float(((np.clip(run(p), 0, 1) - goal) ** 2).mean())
    gene = lambda: tuple(int(rng.integers(n)) for n in (len(ops), 99, 99))
    crowd = [tuple(gene() for _ in range(4)) for _ in range(people)]
    for _ in range(rounds):
        crowd.sort(key=lambda p: (error(p), p))
        pick = lambda: min((crowd[int(rng.integers(people))] for _ in range(3)), key=lambda p: (error(p), p))  # noqa: B023, E731
        new = [crowd[0]]
        while len(new) < people:
            a, b, cut = pick(), pick(), int(rng.integers(1, 4))
            child = list(a[:cut] + b[cut:])
            if rng.random() < 0.5:
                child[int(rng.integers(4))] = gene()
            new.append(tuple(child))
        crowd = new
    best = min(crowd, key=lambda p: (error(p), p))
    return best, error(best)


def memorise(v: np.ndarray, hidden: int = 12, rounds: int = 200, seed: int = 4, rate: float = 0.05) -> tuple[float, float]:
    """Error before and after of a two-layer sine network on the plane's coordinates, plain gradient steps."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[: v.shape[0], : v.shape[1]] / max(1, v.shape[0] - 1)
    a = np.c_[x.ravel(), y.ravel(), np.ones(v.size)]
    goal = v.ravel()[:, None] / 255.0
    w1, w2 = rng.normal(0, 2, (3, hidden)), rng.normal(0, 0.3, (hidden, 1))
    first = last = 0.0
    for t in range(rounds):
        h = np.sin(a @ w1)
        e = h @ w2 - goal
        last = float((e * e).mean())
        first = last if t == 0 else first
        w1, w2 = w1 - rate * a.T @ ((e @ w2.T) * np.cos(a @ w1)) / v.size, w2 - rate * h.T @ e / v.size
    return first, last
