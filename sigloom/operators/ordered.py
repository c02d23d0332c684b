"""Deterministic left folds over an ordered series: adaptive predictors and models. A series streams through one task, batch by batch."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame


class Fold(Protocol):
    """A state that learns from values in order and has a row of results at the end."""

    def learn_all(self, values: list) -> None: ...

    def row(self) -> tuple: ...


def fold(df: DataFrame, key: str, order: list[str], value: str, make: Callable[[], Fold], results: str) -> DataFrame:
    """(key, results): what make() has after each key's values in order. Keys are dealt to tasks and sorted there, spilling where they must;
    a task holds one batch and one state at a time, however long a series is."""
    kinds = [x.split()[1] for x in results.split(", ")]
    arrow = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}

    def rows(done: list[tuple[Any, ...]]) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [()] * (len(kinds) + 1)
        names = [key, *(x.split()[0] for x in results.split(", "))]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, arrow[k]) for c, k in zip(cols[1:], kinds, strict=True))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, values, done, a = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], 0
            while a < len(keys):
                b = a + 1
                while b < len(keys) and keys[b] == keys[a]:
                    b += 1
                if state is None or keys[a] != now:
                    if state is not None:
                        done.append((now, *state.row()))
                    now, state = keys[a], make()
                state.learn_all(values[a:b])
                a = b
            if done:
                yield rows(done)
        if state is not None:
            yield rows([(now, *state.row())])

    return df.repartition(key).sortWithinPartitions(key, *order).select(key, value).mapInArrow(run, f"{key} long, {results}")


class DecayedModes:
    """Errors per mode, decayed, the least first; the mode is chosen before its error is learnt."""

    def __init__(self, modes: int, decay: float = 0.998):
        self.errors, self.decay = [1.0] * modes, decay

    def best(self) -> int:
        return min(range(len(self.errors)), key=lambda m: (self.errors[m], m))

    def blend(self, predictions: list[int]) -> int:
        """By inverse errors, rounded half to even."""
        w = [1 / (e + 1) for e in self.errors]
        return round(sum(a * p for a, p in zip(w, predictions, strict=True)) / sum(w))

    def learn(self, actual: int, predictions: list[int]) -> None:
        self.errors = [e * self.decay + (actual - p) ** 2 for e, p in zip(self.errors, predictions, strict=True)]


class LogitMixer:
    """Weighted sum of logits, learning by gradient."""

    def __init__(self, inputs: int, rate: float = 0.02):
        self.w, self.rate = [1 / inputs] * inputs, rate

    def mix(self, ps: list[float]) -> float:
        self.x = [math.log((q := min(1 - 1e-6, max(1e-6, p))) / (1 - q)) for p in ps]
        z = max(-20.0, min(20.0, sum(a * b for a, b in zip(self.w, self.x, strict=True))))
        self.p = 1 / (1 + math.exp(-z))
        return self.p

    def learn(self, bit: int) -> None:
        self.w = [w + self.rate * (bit - self.p) * x for w, x in zip(self.w, self.x, strict=True)]


class ContextMixer:
    """Softmax weights per context over predictions, nudged to the better ones."""

    def __init__(self, contexts: int = 64, modes: int = 7, rate: float = 0.05):
        self.w, self.rate = [[0.0] * modes for _ in range(contexts)], rate

    def weights(self, context: int) -> list[float]:
        top = max(self.w[context])
        e = [math.exp(v - top) for v in self.w[context]]
        return [v / sum(e) for v in e]

    def predict(self, context: int, predictions: list[int]) -> int:
        return round(sum(w * p for w, p in zip(self.weights(context), predictions, strict=True)))

    def learn(self, context: int, predictions: list[int], actual: int) -> None:
        errors = [abs(actual - p) for p in predictions]
        mean = sum(errors) / len(errors)
        self.w[context] = [max(-8.0, min(8.0, w - self.rate * (e - mean) / (mean + 1))) for w, e in zip(self.w[context], errors, strict=True)]


class RunningLine:
    """Least squares of one channel on another, decayed after 100 samples; no slope before four."""

    def __init__(self, decay: float = 0.99):
        self.n = self.sx = self.sy = self.sxx = self.sxy = 0.0
        self.decay = decay

    def predict(self, x: float) -> int:
        if self.n < 4:
            return round(x)
        d = self.n * self.sxx - self.sx * self.sx
        slope = (self.n * self.sxy - self.sx * self.sy) / d if abs(d) > 1e-10 else 0.0
        return round(slope * x + (self.sy - slope * self.sx) / self.n)

    def learn(self, x: float, y: float) -> None:
        if self.n >= 100:
            self.n, self.sx, self.sy, self.sxx, self.sxy = (v * self.decay for v in (self.n, self.sx, self.sy, self.sxx, self.sxy))
        self.n, self.sx, self.sy, self.sxx, self.sxy = self.n + 1, self.sx + x, self.sy + y, self.sxx + x * x, self.sxy + x * y


class SeriesModes:
    """(best_mode, residual_sum) of a series by the online choice among last value, line through the last two, and mean of both."""

    def __init__(self):
        self.model, self.last, self.before, self.total = DecayedModes(3), 0, 0, 0

    def learn_all(self, values: list[int]) -> None:
        for v in values:
            modes = [self.last, 2 * self.last - self.before, (3 * self.last - self.before) // 2]
            self.total += abs(v - modes[self.model.best()])
            self.model.learn(v, modes)
            self.before, self.last = self.last, v

    def row(self) -> tuple[int, int]:
        return self.model.best(), self.total


class SeriesBlend:
    """(residual_sum): the same modes blended by their errors instead of chosen."""

    def __init__(self):
        self.model, self.last, self.before, self.total = DecayedModes(3), 0, 0, 0

    def learn_all(self, values: list[int]) -> None:
        for v in values:
            modes = [self.last, 2 * self.last - self.before, (3 * self.last - self.before) // 2]
            self.total += abs(v - self.model.blend(modes))
            self.model.learn(v, modes)
            self.before, self.last = self.last, v

    def row(self) -> tuple[int]:
        return (self.total,)


class RescaledBits:
    """(n, bits, rescales) of an adaptive code whose counts are halved, one at least, when they reach `limit` in all."""

    def __init__(self, symbols: int, limit: int):
        self.counts, self.limit, self.n, self.bits, self.halved = [1] * symbols, limit, 0, 0.0, 0

    def learn_all(self, values: list[int]) -> None:
        for v in values:
            self.bits += math.log2(sum(self.counts)) - math.log2(self.counts[v])
            self.counts[v] += 1
            self.n += 1
            if sum(self.counts) >= self.limit:
                self.counts = [max(1, c >> 1) for c in self.counts]
                self.halved += 1

    def row(self) -> tuple[int, float, int]:
        return self.n, round(self.bits, 4) + 0.0, self.halved


class FourContexts:
    """(n, bits) of bits of symbols under four adaptive models, of contexts of the last 4, 8, 12 and 16 bits, the average of their chances."""

    def __init__(self, width: int = 3):
        self.width, self.past, self.n, self.bits, self.seen = width, 0, 0, 0.0, {}

    def learn_all(self, values: list[int]) -> None:
        for v in values:
            for i in range(self.width - 1, -1, -1):
                bit = v >> i & 1
                at = [self.seen.setdefault((k, self.past & (1 << k) - 1), [1, 1]) for k in (4, 8, 12, 16)]
                self.bits -= math.log2(sum(c[bit] / (c[0] + c[1]) for c in at) / 4)
                for c in at:
                    c[bit] += 1
                self.past = self.past << 1 & 0xFFFF | bit
                self.n += 1

    def row(self) -> tuple[int, float]:
        return self.n, round(self.bits, 4) + 0.0


class PrefixModel:
    """Counts of symbols after every prefix of the last `depth` symbols, oldest first, and a blend with the even distribution."""

    def __init__(self, depth: int = 8):
        self.depth, self.counts = depth, {}

    def learn(self, context: list[int], symbol: int) -> None:
        recent = tuple(context[-self.depth :])
        for k in range(len(recent) + 1):
            at = self.counts.setdefault(recent[:k], {})
            at[symbol] = at.get(symbol, 0) + 1

    def predict(self, context: list[int], symbols: int, escape: float = 0.1) -> list[float]:
        recent, k = tuple(context[-self.depth :]), 0
        while k < len(recent) and recent[: k + 1] in self.counts:
            k += 1
        seen = self.counts.get(recent[:k], {})
        n = sum(seen.values())
        share = (1 - escape**k) if n else 0.0
        return [(1 - share) / symbols + (share * seen.get(s, 0) / n if n else 0.0) for s in range(symbols)]
