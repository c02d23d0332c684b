"""Linear algebra on blocks: transforms, low rank, sparse codes, fits. NumPy kernels over Arrow batches, one exchange-free pass each."""

from __future__ import annotations

import math

import numpy as np


def dct_basis(n: int = 8) -> np.ndarray:
    """Orthonormal DCT-II rows."""
    k, i = np.mgrid[:n, :n]
    b = np.cos(math.pi * (2 * i + 1) * k / (2 * n)) * math.sqrt(2 / n)
    b[0] /= math.sqrt(2)
    return b


def dct2(v: np.ndarray) -> np.ndarray:
    b = dct_basis(v.shape[-1])
    return b @ v @ b.T


def idct2(c: np.ndarray) -> np.ndarray:
    b = dct_basis(c.shape[-1])
    return b.T @ c @ b


def dct_atoms(n: int = 8) -> np.ndarray:
    """Unit-norm cosine atoms, columns in order of (u, v)."""
    k, i = np.mgrid[:n, :n]
    rows = np.cos(math.pi * (2 * i + 1) * k / (2 * n))
    atoms = np.einsum("ui,vj->uvij", rows, rows).reshape(n * n, n * n).T
    return atoms / np.linalg.norm(atoms, axis=0)


def pursuit(atoms: np.ndarray, signal: np.ndarray, sparsity: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Orthogonal matching pursuit: (atoms, coefficients, rest)."""
    rest, chosen, coef = signal.astype(float), [], np.empty(0)
    for _ in range(min(sparsity, atoms.shape[1])):
        score = np.abs(atoms.T @ rest)
        score[chosen] = -1
        chosen.append(int(score.argmax()))
        coef = np.linalg.lstsq(atoms[:, chosen], signal, rcond=None)[0]
        rest = signal - atoms[:, chosen] @ coef
        if np.linalg.norm(rest) < 1e-10:
            break
    return chosen, coef, rest


def learn_dictionary(signals: np.ndarray, atoms: np.ndarray, sparsity: int, rounds: int) -> np.ndarray:
    """K-SVD: each round codes the signals and renews every atom, with its coefficients, from the error without it.

    Signs: an atom keeps the sign that its singular vector has, and its coefficients theirs, so that the two agree.
    """
    atoms = atoms.copy()
    for _ in range(rounds):
        codes = np.zeros((atoms.shape[1], len(signals)))
        for i, s in enumerate(signals):
            chosen, coef, _ = pursuit(atoms, s, sparsity)
            codes[chosen, i] = coef
        for k in range(atoms.shape[1]):
            on = np.flatnonzero(codes[k])
            if len(on):
                error = signals[on].T - atoms @ codes[:, on] + np.outer(atoms[:, k], codes[k, on])
                u, s, vt = np.linalg.svd(error, full_matrices=False)
                atoms[:, k], codes[k, on] = u[:, 0], s[0] * vt[0]
    return atoms


def rank_energy(v: np.ndarray) -> np.ndarray:
    """Shares of a block's energy that rank 1, 2, ... keep."""
    s = np.linalg.svd(v.astype(float), compute_uv=False) ** 2
    total = s.sum(-1, keepdims=True)
    return np.cumsum(s, -1) / np.where(total == 0, 1, total)


def integer_rank(v: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(rounded approximation of a rank, what it leaves)."""
    u, s, vt = np.linalg.svd(v.astype(float), full_matrices=False)
    near = np.rint((u[..., :rank] * s[..., None, :rank]) @ vt[..., :rank, :]).astype(np.int64)
    return near, v - near


def tucker(x: np.ndarray, ranks: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Higher-order SVD: core and factors."""
    factors = [np.linalg.svd(np.moveaxis(x, i, 0).reshape(x.shape[i], -1), full_matrices=False)[0][:, :r] for i, r in enumerate(ranks)]
    core = x.astype(float)
    for i, f in enumerate(factors):
        core = np.moveaxis(np.tensordot(f.T, core, (1, i)), 0, i)
    return core, factors


def untucker(core: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    for i, f in enumerate(factors):
        core = np.moveaxis(np.tensordot(f, core, (1, i)), 0, i)
    return core


def tensor_train(x: np.ndarray, rank: int) -> list[np.ndarray]:
    """Cores of a tensor train."""
    cores, left, rest = [], 1, x.astype(float)
    for n in x.shape[:-1]:
        u, s, vt = np.linalg.svd(rest.reshape(left * n, -1), full_matrices=False)
        r = min(rank, len(s))
        cores.append(u[:, :r].reshape(left, n, r))
        left, rest = r, s[:r, None] * vt[:r]
    return [*cores, rest.reshape(left, x.shape[-1], 1)]


def untrain(cores: list[np.ndarray]) -> np.ndarray:
    out = cores[0]
    for c in cores[1:]:
        out = np.tensordot(out, c, (-1, 0))
    return out[0, ..., 0]


def plane_features(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column coordinates in [-1, 1]."""
    return tuple(np.meshgrid(np.linspace(-1, 1, h), np.linspace(-1, 1, w), indexing="ij"))


def surface_fit(v: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, rounded surface) of a polynomial in the coordinates."""
    y, x = plane_features(*v.shape)
    a = np.stack([x**i * y**j for i in range(degree + 1) for j in range(degree + 1 - i)], -1).reshape(v.size, -1)
    c = np.linalg.lstsq(a, v.ravel().astype(float), rcond=None)[0]
    return c, np.rint(a @ c).reshape(v.shape).astype(np.int64)


def random_features(x: np.ndarray, hidden: int, seed: int) -> np.ndarray:
    """Fixed random tanh features and a one."""
    rng = np.random.default_rng(seed)
    return np.c_[np.tanh(x @ rng.normal(size=(x.shape[1], hidden)) + rng.normal(size=hidden)), np.ones(len(x))]


def siren_fit(v: np.ndarray, hidden: int = 16, steps: int = 150, seed: int = 0, rate: float = 5e-3) -> tuple[float, float]:
    """Mean squared error before and after training a sine network on a plane in [0, 1] (L17), Adam with clipped gradients."""
    rng = np.random.default_rng(seed)
    y, x = plane_features(*v.shape)
    a = np.c_[x.ravel(), y.ravel()]
    goal = v.ravel()[:, None] / 255.0
    w = [rng.uniform(-0.5, 0.5, (2, hidden)), np.zeros(hidden), rng.uniform(-1, 1, (hidden, hidden)) * math.sqrt(6 / hidden) / 30, np.zeros(hidden), rng.uniform(-1, 1, (hidden, 1)) * math.sqrt(6 / hidden) / 30, np.zeros(1)]
    m, s = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    first = last = 0.0
    for t in range(1, steps + 1):
        z1 = 30 * (a @ w[0] + w[1])
        h1 = np.sin(z1)
        z2 = 30 * (h1 @ w[2] + w[3])
        h2 = np.sin(z2)
        e = h2 @ w[4] + w[5] - goal
        last = float((e * e).mean())
        first = first if t > 1 else last
        g = 2 * e / e.size
        d2 = g @ w[4].T * np.cos(z2) * 30
        d1 = d2 @ w[2].T * np.cos(z1) * 30
        grads = [a.T @ d1, d1.sum(0), h1.T @ d2, d2.sum(0), h2.T @ g, g.sum(0)]
        size = max(1.0, math.sqrt(sum(float((q * q).sum()) for q in grads)))
        for i, q in enumerate(grads):
            q = q / size
            m[i] += 0.1 * (q - m[i])
            s[i] += 0.001 * (q * q - s[i])
            w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return first, last


def evolve(fitness, dim: int, rounds: int = 30, people: int = 16, seed: int = 0, spread: float = 0.5) -> tuple[np.ndarray, float]:
    """Covariance-matrix evolution (L19): a weighted mean of the better half, a path that sets the step's size, and one that, with the better
    half's steps, moves the covariance; the constants are the method's usual ones."""
    rng = np.random.default_rng(seed)
    half = people // 2
    w = math.log(half + 0.5) - np.log(np.arange(1, half + 1))
    w /= w.sum()
    mass = 1 / (w * w).sum()
    c_step, c_path = (mass + 2) / (dim + mass + 5), (4 + mass / dim) / (dim + 4 + 2 * mass / dim)
    damp = 1 + c_step + 2 * max(0.0, math.sqrt((mass - 1) / (dim + 1)) - 1)
    c_one = 2 / ((dim + 1.3) ** 2 + mass)
    c_many = min(1 - c_one, 2 * (mass - 2 + 1 / mass) / ((dim + 2) ** 2 + mass))
    usual = math.sqrt(dim) * (1 - 1 / (4 * dim) + 1 / (21 * dim * dim))
    mean, cov, step, best = np.zeros(dim), np.eye(dim), spread, (np.zeros(dim), math.inf)
    turn, path = np.zeros(dim), np.zeros(dim)
    for t in range(1, rounds + 1):
        size, axes = np.linalg.eigh(cov)
        size = np.sqrt(np.maximum(size, 1e-12))
        steps = rng.normal(size=(people, dim)) * size @ axes.T
        scores = np.array([fitness(mean + step * y) for y in steps])
        order = np.argsort(scores, kind="stable")
        if scores[order[0]] < best[1]:
            best = (mean + step * steps[order[0]], float(scores[order[0]]))
        top = steps[order[:half]]
        move = w @ top
        mean = mean + step * move
        turn = (1 - c_step) * turn + math.sqrt(c_step * (2 - c_step) * mass) * (axes @ ((axes.T @ move) / size))
        calm = np.linalg.norm(turn) / math.sqrt(1 - (1 - c_step) ** (2 * t)) < (1.4 + 2 / (dim + 1)) * usual
        path = (1 - c_path) * path + calm * math.sqrt(c_path * (2 - c_path) * mass) * move
        cov = (1 - c_one - c_many) * cov + c_one * np.outer(path, path) + c_many * (top.T * w) @ top
        step *= math.exp(min(1.0, c_step / damp * (np.linalg.norm(turn) / usual - 1)))
    return best


def drawn_atoms(signals: np.ndarray, size: int) -> np.ndarray:
    """A dictionary of cosine atoms and, for the rest of its size, the signals themselves, brought to unit norm."""
    base = dct_atoms(int(math.isqrt(signals.shape[1])))
    own = signals[: max(0, size - base.shape[1])].astype(float).T
    norms = np.linalg.norm(own, axis=0)
    return np.hstack([base[:, :size], own / np.where(norms < 1e-12, 1.0, norms)])


def two_scales(v: np.ndarray, coarse: int, fine: int) -> tuple[np.ndarray, np.ndarray]:
    """What sparse codes of a block leave, and what codes of its quarters leave of that, rounded."""
    big, small = dct_atoms(v.shape[0]), dct_atoms(v.shape[0] // 2)
    flat = v.ravel().astype(float)
    first = np.rint(pursuit(big, flat, coarse)[2]).astype(np.int64).reshape(v.shape)
    h = v.shape[0] // 2
    out = np.empty_like(first)
    for y in (0, h):
        for x in (0, h):
            out[y : y + h, x : x + h] = np.rint(pursuit(small, first[y : y + h, x : x + h].ravel().astype(float), fine)[2]).reshape(h, h)
    return first, out
