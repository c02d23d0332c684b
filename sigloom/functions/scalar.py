"""Exact scalar functions, Column to Column: colour lifting, zig-zag, buckets, variable-length integers, hashes, scan orders.

All of them stay inside the JVM. Shifts floor on negative values, and halves round to even (bround) where an average is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def to_ycocg(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Reversible luma and two chroma differences of integer colours."""
    co = r - b
    t = b + F.shiftright(co, 1)
    cg = g - t
    return t + F.shiftright(cg, 1), co, cg


def from_ycocg(y: Column, co: Column, cg: Column) -> tuple[Column, Column, Column]:
    """The inverse of to_ycocg, clipped to bytes."""
    t = y - F.shiftright(cg, 1)
    g = cg + t
    b = t - F.shiftright(co, 1)
    return clip(b + co, 0, 255), clip(g, 0, 255), clip(b, 0, 255)


def rotate(a: Column, b: Column, theta: float) -> tuple[Column, Column]:
    """Rotation by theta in three integer lifting steps (C03); undone exactly by unrotate."""
    if abs(theta) < 1e-10:
        return a, b
    alpha, beta = (math.cos(theta) - 1) / math.sin(theta), math.sin(theta)
    a = a + F.floor(F.lit(alpha) * b).cast("int")
    b = b + F.floor(F.lit(beta) * a).cast("int")
    return a + F.floor(F.lit(alpha) * b).cast("int"), b


def unrotate(a: Column, b: Column, theta: float) -> tuple[Column, Column]:
    if abs(theta) < 1e-10:
        return a, b
    alpha, beta = (math.cos(theta) - 1) / math.sin(theta), math.sin(theta)
    a = a - F.floor(F.lit(alpha) * b).cast("int")
    b = b - F.floor(F.lit(beta) * a).cast("int")
    return a - F.floor(F.lit(alpha) * b).cast("int"), b


def givens_angle(a: Column, b: Column, c: Column) -> Column:
    """Angle that diagonalises [[a, c], [c, b]]; 0 if c is all but 0."""
    return F.when(F.abs(c) < 1e-10, 0.0).otherwise(F.atan2(2 * c, a - b) * 0.5)


def zigzag(x: Column) -> Column:
    """0, -1, 1, -2, ... to 0, 1, 2, 3, ...."""
    return F.when(x >= 0, x * 2).otherwise(x * -2 - 1)


def unzigzag(z: Column) -> Column:
    return F.shiftright(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1))))


def bit_length(v: Column) -> Column:
    """Bits of a non-negative integer; 0 of 0."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


def bucket(v: Column) -> tuple[Column, Column, Column]:
    """(bucket, number of extra bits, their value) of a non-negative integer: bucket 0 holds 0, bucket k its k-bit values."""
    k = bit_length(v)
    bits = F.greatest(k - 1, F.lit(0))
    return k, bits, F.when(k == 0, 0).otherwise(v - F.expr("1L") * F.pow(F.lit(2.0), bits).cast("long"))


def unbucket(k: Column, extra: Column) -> Column:
    return F.when(k == 0, 0).otherwise(F.pow(F.lit(2.0), k - 1).cast("long") + extra)


def varint_bytes(v: Column) -> Column:
    """Bytes of the 7-bits-a-byte code of a non-negative integer."""
    return F.greatest(F.lit(1), F.ceil(bit_length(v) / 7)).cast("int")


def signed_varint_bytes(v: Column) -> Column:
    return varint_bytes(zigzag(v))


def fnv1a(values: Column) -> Column:
    """32-bit xor-multiply hash of an array of integers, in order."""
    return F.aggregate(values, F.lit(2166136261).cast("long"), lambda h, v: (h.bitwiseXOR(v.cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def utf8_bytes(text: Column) -> Column:
    """Bytes of a string's UTF-8 form as an array of integers."""
    digits = F.hex(F.encode(text, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))


def hilbert_xy(d: Column, side: int) -> tuple[Column, Column]:
    """(x, y) of the d-th cell of the Hilbert curve over a square of `side` cells, a power of two (C11)."""
    x, y, t, s = F.lit(0), F.lit(0), d, 1
    while s < side:
        rx = F.shiftright(t, 1).bitwiseAND(F.lit(1))
        ry = t.bitwiseXOR(rx).bitwiseAND(F.lit(1))
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - x).otherwise(x), F.when(flip, s - 1 - y).otherwise(y)
        turned = ry == 0
        nx, ny = F.when(turned, fy).otherwise(fx), F.when(turned, fx).otherwise(fy)
        x, y = nx + rx * s, ny + ry * s
        t, s = F.shiftright(t, 2), s * 2
    return x, y


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    """With its argument clamped to 20 either way."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x))))


def softmax(xs: Column) -> Column:
    """Of an array of doubles, shifted by its maximum."""
    e = F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def size_text(n: Column) -> Column:
    """Bytes as a readable size."""
    kb, mb = F.bround(n / F.lit(1024.0), 1), F.bround(n / F.lit(1048576.0), 2)
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1048576, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.2f MB", mb))


def ratio(original: Column, compressed: Column) -> Column:
    """original / compressed; infinite if nothing is left."""
    return F.when(compressed == 0, F.lit(float("inf"))).otherwise(original / compressed)


def wrap16(x: Column) -> Column:
    """As a 16-bit integer wraps."""
    return (x + 32768).bitwiseAND(F.lit(65535)) - 32768


PRIMES = [p for p in range(2, 256) if all(p % q for q in range(2, math.isqrt(p) + 1))]


def nearest_prime(v: Column) -> Column:
    """Of the primes below 256 the nearest, the smaller of two."""
    return F.array_min(F.array(*(F.struct(F.abs(v - p).alias("d"), F.lit(p).alias("p")) for p in PRIMES)))["p"]


def residues(v: Column, moduli: tuple[int, ...] = (3, 5, 7, 11)) -> list[Column]:
    return [F.pmod(v, F.lit(m)) for m in moduli]


def from_residues(rs: list[Column], moduli: tuple[int, ...] = (3, 5, 7, 11)) -> Column:
    """The integer below the moduli's product that leaves these residues."""
    n = math.prod(moduli)
    total = F.lit(0)
    for r, m in zip(rs, moduli, strict=True):
        total = total + r * (n // m * pow(n // m, -1, m))
    return F.pmod(total, F.lit(n))


def uniform_codes(v: Column, low: Column, high: Column, levels: int = 255) -> Column:
    """(v - low) / range in `levels` steps, truncated; a flat range counts as 1."""
    span = F.when(high == low, F.lit(1.0)).otherwise((high - low).cast("double"))
    return F.floor((v - low) / span * levels).cast("int")


def harmonics(x: Column, n: int) -> Column:
    """sin and cos of pi * k * x for k = 1..n."""
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.array(F.sin(k * math.pi * x), F.cos(k * math.pi * x))))


def polynomial(x: Column, y: Column, degree: int) -> list[Column]:
    """x^i y^j for i + j <= degree."""
    return [F.pow(x, F.lit(float(i))) * F.pow(y, F.lit(float(j))) for i in range(degree + 1) for j in range(degree + 1 - i)]


def equation(form: str, x: Column, y: Column, c: list[float]) -> Column:
    """The symbolic forms of the regression search."""
    k = [F.lit(float(v)) for v in c]
    r = F.sqrt(x * x + y * y)
    forms = {
        "linear": lambda: k[0] * x + k[1] * y + k[2],
        "quadratic": lambda: k[0] * x * x + k[1] * y * y + k[2] * x * y + k[3] * x + k[4] * y + k[5],
        "sinusoidal": lambda: k[0] * F.sin(k[1] * x + k[2]) * F.cos(k[3] * y + k[4]) + k[5],
        "radial": lambda: k[0] * F.sin(k[1] * r + k[2]) + k[3],
        "wave_mix": lambda: k[0] * F.sin(k[1] * x) + k[2] * F.cos(k[3] * y) + k[4] * F.sin(k[5] * (x + y)),
        "multi_freq": lambda: sum((k[i] * F.sin((i + 1) * math.pi * x) * F.cos((i + 1) * math.pi * y) for i in range(len(k))), F.lit(0.0)),
    }
    return forms[form]()


def gene(program: list[tuple], x: Column, y: Column) -> Column:
    """A stack program of (operation, *operands) as one expression (C24); operands are numbers, or 'x', 'y', or earlier steps by index."""
    steps: list[Column] = []

    def of(v) -> Column:
        return {"x": x, "y": y}[v] if isinstance(v, str) else steps[v] if isinstance(v, int) else F.lit(float(v))

    for name, *args in program:
        a = [of(v) for v in args]
        steps.append(
            {
                "add": lambda: a[0] + a[1], "mul": lambda: a[0] * a[1], "sin": lambda: F.sin(a[0]), "cos": lambda: F.cos(a[0]), "sqrt": lambda: F.sqrt(F.abs(a[0])),
                "clamp": lambda: F.greatest(F.lit(0.0), F.least(F.lit(1.0), a[0])), "blend": lambda: a[0] * (1 - a[2]) + a[1] * a[2], "grad_v": lambda: y, "grad_h": lambda: x,
                "noise": lambda: F.sin(a[0] * 12.9898 + a[1] * 78.233) * 43758.5453 - F.floor(F.sin(a[0] * 12.9898 + a[1] * 78.233) * 43758.5453),
            }[name]()
        )
    return steps[-1]
