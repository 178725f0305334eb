"""Neighbourhood operators on pixel grids.

Kernels are applied line by line with range frames. A task holds a few grid lines, whose length is
bounded by the raster, and no pixel is copied per kernel cell.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame


def _along(keys: Sequence[str], line: str, axis: str, low: int, high: int, func: str, value: str) -> str:
    by = ", ".join([*keys, line])

    def edge(k: int) -> str:
        return f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}" if k else "CURRENT ROW"

    return f"{func}({value}) OVER (PARTITION BY {by} ORDER BY {axis} RANGE BETWEEN {edge(low)} AND {edge(high)})"


def focal(
    pixels: DataFrame, keys: Sequence[str], value: str, radius: float, func: str, shape: str = "circle", out: str | None = None
) -> DataFrame:
    """Minimum or maximum over a circle or square of the given radius; missing pixels are ignored.

    Each pixel is listed on every row its kernel reaches (2 * radius + 1 copies), tagged with the
    kernel's half width there. One pass along the rows then sees all neighbours, also where the pixel
    above or below is missing.
    """
    if func not in ("min", "max"):
        raise ValueError("func must be min or max")
    r = math.floor(radius)
    widths = {dy: r if shape == "square" else math.floor(math.sqrt(radius * radius - dy * dy)) for dy in range(-r, r + 1)}
    reach = ", ".join(f"struct({dy} AS dy, {w} AS w)" for dy, w in widths.items())
    others = [c for c in pixels.columns if c not in (value, "prow")]
    listed = pixels.selectExpr(*others, "prow", value, f"explode(array({reach})) AS _k").selectExpr(
        *others, "prow + _k.dy AS prow", "_k.dy AS _dy", "_k.w AS _w", value
    )
    parts = [
        _along(keys, "prow", "pcol", -w, w, func, f"CASE WHEN _w = {w} THEN {value} END") for w in sorted(set(widths.values()))
    ]
    pick = "least" if func == "min" else "greatest"
    combined = f"{pick}({', '.join(parts)})" if len(parts) > 1 else parts[0]
    kept = [c for c in pixels.columns if c != value]
    return listed.selectExpr(*kept, "_dy", f"{combined} AS _f").where("_dy = 0").selectExpr(*kept, f"_f AS {out or value}")


def opening(mask: DataFrame, keys: Sequence[str], value: str = "m", size: int = 8) -> DataFrame:
    """Morphological opening of a dense 0/1 grid with a size x size kernel.

    Erosion looks from -size/2 to size-1-size/2, dilation the other way round, so the result never
    exceeds the mask. Both are separable; the two column steps share one shuffle.
    """
    back, ahead = size // 2, size - 1 - size // 2
    width = f"count({value})"

    def step(df: DataFrame, line: str, axis: str, func: str) -> DataFrame:
        low, high = (-back, ahead) if func == "min" else (-ahead, back)
        expr = _along(keys, line, axis, low, high, func, value)
        if func == "min":  # beyond the border counts as empty
            full = _along(keys, line, axis, low, high, "count", value)
            expr = f"CASE WHEN {full} = {size} THEN {expr} ELSE 0 END"
        return df.selectExpr(*[c for c in df.columns if c != value], f"{expr} AS {value}")

    out = step(mask, "prow", "pcol", "min")
    out = step(out, "pcol", "prow", "min")
    out = step(out, "pcol", "prow", "max")
    return step(out, "prow", "pcol", "max")


def sparse_opening(mask: DataFrame, keys: Sequence[str], size: int = 8) -> DataFrame:
    """Opening of a mask given by its set pixels only: rows (keys, prow, pcol).

    A pixel survives erosion when the kernel around it is full; dilation marks every pixel whose
    mirrored kernel holds a survivor. Work follows the set pixels, not the raster area.
    """
    back, ahead = size // 2, size - 1 - size // 2
    row_full = _along(keys, "prow", "pcol", -back, ahead, "count", "1")
    col_full = _along(keys, "pcol", "prow", -back, ahead, "count", "1")
    kept = mask.select(*keys, "prow", "pcol").selectExpr("*", f"{row_full} AS _f").where(f"_f = {size}")
    kept = kept.selectExpr(*keys, "prow", "pcol", f"{col_full} AS _f").where(f"_f = {size}")
    # survivors next to each other cover overlapping pixels: fill gaps along columns, then along rows
    down = kept.selectExpr(*keys, "pcol", f"explode(sequence(prow - {back}, prow + {ahead})) AS prow").distinct()
    return down.selectExpr(*keys, "prow", f"explode(sequence(pcol - {back}, pcol + {ahead})) AS pcol").distinct()


def project_mask(
    mask: DataFrame, keys: Sequence[str], angle_degrees: str, steps: int
) -> DataFrame:
    """Pixels met when every mask pixel is moved 1..steps pixels along its image's direction, itself included.

    The angle is mathematical (0 = east, counter-clockwise) with rows counted downwards.
    """
    moved = mask.selectExpr(*keys, "prow", "pcol", f"radians({angle_degrees}) AS _a", f"explode(sequence(0, {steps})) AS _s")
    return moved.selectExpr(
        *keys, "CAST(prow - round(_s * sin(_a)) AS BIGINT) AS prow", "CAST(pcol + round(_s * cos(_a)) AS BIGINT) AS pcol"
    ).distinct()
