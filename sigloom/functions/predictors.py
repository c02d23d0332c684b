"""Predictors of a sample from the samples already seen: left, above, and around. Column expressions over integers.

Every family lists its members in the order in which ties are decided: the first of least cost wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloom.functions.scalar import clip


def paeth(left: Column, above: Column, diag: Column) -> Column:
    """Of the three the closest to left + above - diag, in this order (P3 of W02)."""
    to_left, to_above, to_diag = F.abs(above - diag), F.abs(left - diag), F.abs(left + above - 2 * diag)
    return F.when((to_left <= to_above) & (to_left <= to_diag), left).when(to_above <= to_diag, above).otherwise(diag)


def median_edge(left: Column, above: Column, diag: Column) -> Column:
    """The LOCO-I predictor."""
    low, high = F.least(left, above), F.greatest(left, above)
    return F.when(diag >= high, low).when(diag <= low, high).otherwise(left + above - diag)


def block_modes(left: Column, above: Column, ul: Column, ur: Column, left2: Column, above2: Column) -> dict[str, Column]:
    """The nine modes that blocks choose from."""
    across, down = F.abs(above - ul), F.abs(left - ul)
    gradient = left + above - ul
    w_left, w_above = F.lit(1.0) / (down + 1), F.lit(1.0) / (across + 1)
    return {
        "left": left,
        "above": above,
        "gradient": gradient,
        "paeth": paeth(left, above, ul),
        "average": F.shiftright(left + above + 1, 1),
        "edge_adaptive": F.when(across > down + 4, above).when(down > across + 4, left).otherwise(gradient),
        "median3": left + above + gradient - F.greatest(left, above, gradient) - F.least(left, above, gradient),
        "extrapolate": F.when(F.abs(left - left2) < F.abs(above - above2), 2 * left - left2).otherwise(2 * above - above2),
        "weighted_grad": F.bround((left * w_left + above * w_above) / (w_left + w_above)).cast("int"),
    }


def scalar_modes(left: Column, above: Column, ul: Column, left2: Column, above2: Column) -> dict[str, Column]:
    """The seven modes of the online mixer, clamped to 0..511."""
    across, down = F.abs(above - ul), F.abs(left - ul)
    gradient = left + above - ul
    modes = {
        "left": left,
        "above": above,
        "gradient": gradient,
        "paeth": paeth(left, above, ul),
        "average": F.floor((left + above) / 2).cast("int"),
        "edge": F.when(across > down, above).when(down > across, left).otherwise(gradient),
        "extrapolate": F.when(F.abs(left - left2) < F.abs(above - above2), 2 * left - left2).otherwise(2 * above - above2),
    }
    return {k: clip(v, 0, 511) for k, v in modes.items()}


def frame_modes(left: Column, above: Column, diag: Column, first_row: Column, first_column: Column) -> dict[str, Column]:
    """The six modes of frames, over planes whose missing neighbours are 0 (W08, in their vectorised form W09)."""
    zero = F.lit(0)
    inner = ~first_row & ~first_column
    gh = F.when(first_column, zero).when(first_row, left).otherwise(left - diag)
    gv = F.when(first_row, zero).when(first_column, above).otherwise(above - diag)
    return {
        "left": F.when(first_column, 128).otherwise(left),
        "above": F.when(first_row, 128).otherwise(above),
        "diagonal": F.when(inner, diag).otherwise(128),
        "paeth": paeth(left, above, diag),
        "gradient": F.when(F.abs(gh) > F.abs(gv), clip(above + gh, 0, 255)).otherwise(clip(left + gv, 0, 255)),
        "average": F.shiftright(left + above + 1, 1),
    }


def context_features(left: Column, above: Column, ul: Column, left2: Column, above2: Column) -> dict[str, Column]:
    """The twelve causal features of a sample."""
    across, down = F.abs(above - ul), F.abs(left - ul)
    return {
        "left": left, "above": above, "ul": ul, "gradient": left + above - ul, "across": across, "down": down, "both": across + down,
        "bend_left": F.abs(left - left2), "bend_above": F.abs(above - above2), "curvature": F.abs(left + above - 2 * ul),
        "average": F.shiftright(left + above + 1, 1), "clamped": F.least(across + down, F.lit(255)),
    }


def magnitude_level(v: Column) -> Column:
    """Eight levels of a size: 0, 1, to 3, to 7, ... to 63, above."""
    level = F.when(v == 0, 0)
    for k, top in enumerate((1, 3, 7, 15, 31, 63), 1):
        level = level.when(v <= top, k)
    return level.otherwise(7)


def mixer_context(left: Column, above: Column, ul: Column) -> Column:
    """64 contexts of local gradient size and direction."""
    dx, dy = F.abs(left - ul), F.abs(above - ul)
    size = dx + dy
    turn = F.when(size > 2, F.least(F.floor(dx / (size + 1) * 8).cast("int"), F.lit(7))).otherwise(0)
    return F.least(F.shiftright(size, 3), F.lit(7)) * 8 + turn


def lookup_context(left: Column, above: Column, ul: Column, bits: int) -> Column:
    """A key of `bits` bits, a multiple of three, from the three neighbours (C17)."""
    each = bits // 3
    q = [F.shiftright(x + 256, 9 - each) for x in (left, above, ul)]
    return F.pmod(F.shiftleft(q[0], 2 * each).bitwiseOR(F.shiftleft(q[1], each)).bitwiseOR(q[2]), F.lit(1 << bits))
