"""Vector to pixel conversion and pixel grid reductions."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.functions import geometry as g


def _cell(value: str, resolution: float) -> str:
    return f"CAST(floor({value} / {resolution}) AS BIGINT)"


#: Columns of a stripe in which runs of one grid row are united.
STRIPE_BITS = 12


def _spans(resolution: float, all_touched: bool) -> str:
    """Runs of grid cells of ``geom``: centre inside, or any contact (these may overlap)."""
    res = float(resolution)
    inside = g.cell_spans(
        "geom", lambda y: f"({y} / {res} - 0.5D)", lambda x: f"({x} / {res} - 0.5D)",
        lambda r: f"(({r} + 0.5D) * {res})", lambda c: f"(({c} + 0.5D) * {res})",
    )
    if not all_touched:
        return inside
    return g.touched_spans(
        "geom", lambda y: f"({y} / {res})", lambda x: f"({x} / {res})", lambda r: f"({r} * {res})", lambda c: f"({c} * {res})",
        (_cell("bbox.ymin", res), _cell("bbox.ymax", res)), (_cell("bbox.xmin", res), _cell("bbox.xmax", res)), inside,
    )


def covered_cells(df: DataFrame, resolution: float, keep: Sequence[str], all_touched: bool = False) -> DataFrame:
    """Grid cells (cx, cy = floor(coordinate / resolution)) of each feature: centre inside, or any contact.

    Cells are found along the outline and filled row by row; no row carries an outline per cell. With contact, a
    feature's cells are united in its row.
    """
    spans = _spans(resolution, all_touched)
    if not all_touched:
        return df.selectExpr(*keep, f"explode({spans}) AS _s").selectExpr(
            *keep, "explode(sequence(_s.c0, _s.c1)) AS cx", "_s.row AS cy"
        )
    # a cell as one number, as arrays of numbers are united by hash
    whole = f"array_distinct(flatten(transform({spans}, s -> transform(sequence(s.c0, s.c1), c -> shiftleft(s.row, 32) + c + 2147483648L))))"
    return df.selectExpr(*keep, f"explode({whole}) AS _c").selectExpr(*keep, "(_c & 4294967295L) - 2147483648L AS cx", "shiftright(_c, 32) AS cy")


def dissolve_runs(df: DataFrame, resolution: float, group: Sequence[str] = (), all_touched: bool = False) -> DataFrame:
    """Union of areas as disjoint runs of grid cells: (group, cy, c0, c1); no row per cell.

    Runs are cut at stripes of columns. Of the runs that begin in one cell the longest is kept before the shuffle, so
    a stripe's row has a bounded number of them, however many areas lie on each other; the largest end so far tells where a new run begins.
    """
    group = list(group)
    runs = df.selectExpr(*group, f"explode({_spans(resolution, all_touched)}) AS _s").selectExpr(
        *group, "_s.row AS cy", "_s.c0 AS c0", "_s.c1 AS c1", f"explode(sequence(shiftright(_s.c0, {STRIPE_BITS}), shiftright(_s.c1, {STRIPE_BITS}))) AS _stripe"
    ).selectExpr(
        *group, "cy", "_stripe", f"greatest(c0, shiftleft(_stripe, {STRIPE_BITS})) AS c0", f"least(c1, shiftleft(_stripe + 1L, {STRIPE_BITS}) - 1L) AS c1"
    )
    at = [*group, "cy", "_stripe"]
    longest = runs.groupBy(*at, "c0").agg(F.max("c1").alias("c1"))
    over = f"OVER (PARTITION BY {', '.join(at)} ORDER BY c0 ROWS BETWEEN UNBOUNDED PRECEDING AND"
    marked = longest.selectExpr("*", f"CAST(coalesce(c0 > max(c1) {over} 1 PRECEDING) + 1L, true) AS INT) AS _new")
    numbered = marked.selectExpr("*", f"sum(_new) {over} CURRENT ROW) AS _run")
    return numbered.groupBy(*at, "_run").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).select(*group, "cy", "c0", "c1")


def dissolve_cells(df: DataFrame, resolution: float, group: Sequence[str] = ()) -> DataFrame:
    """Union of areas as the distinct cells they cover, listed from their runs."""
    return dissolve_runs(df, resolution, group).selectExpr(*group, "explode(sequence(c0, c1)) AS cx", "cy")


def dissolved_area(df: DataFrame, resolution: float, group: Sequence[str] = ()) -> DataFrame:
    """(group, area) of the union of areas, from run lengths."""
    return dissolve_runs(df, resolution, group).groupBy(*group).agg(F.expr(f"sum(c1 - c0 + 1) * {float(resolution) ** 2}D AS area"))


def overlay_runs(
    left: DataFrame, right: DataFrame, resolution: float, left_keys: Sequence[str], right_keys: Sequence[str], equal: Sequence[str] = (),
) -> DataFrame:
    """Overlay of areas of any outline as disjoint runs of common grid cells: (equal, left keys, right keys, cy, c0, c1).

    The areas of each set of keys are united first. Runs never cross a stripe, so both sides meet in a row of one stripe, and
    only runs that overlap make a row. Exact at the resolution, by the centres of cells; no vector is cut.
    """
    equal = list(equal)
    stripe = f"shiftright(c0, {STRIPE_BITS}) AS _stripe"
    a = dissolve_runs(left, resolution, [*equal, *left_keys]).selectExpr(*equal, *left_keys, stripe, "cy", "c0 AS _a0", "c1 AS _a1")
    b = dissolve_runs(right, resolution, [*equal, *right_keys]).selectExpr(*equal, *right_keys, stripe, "cy", "c0 AS _b0", "c1 AS _b1")
    met = a.join(b, [*equal, "_stripe", "cy"]).where("_a0 <= _b1 AND _b0 <= _a1")
    return met.selectExpr(*equal, *left_keys, *right_keys, "cy", "greatest(_a0, _b0) AS c0", "least(_a1, _b1) AS c1")


def overlay_area(
    left: DataFrame, right: DataFrame, resolution: float, left_keys: Sequence[str], right_keys: Sequence[str], equal: Sequence[str] = (),
) -> DataFrame:
    """(equal, left keys, right keys, area) of the areas that overlap; see ``overlay_runs``."""
    runs = overlay_runs(left, right, resolution, left_keys, right_keys, equal)
    return runs.groupBy(*equal, *left_keys, *right_keys).agg(F.expr(f"sum(c1 - c0 + 1) * {float(resolution) ** 2}D AS area"))


def rasterize(
    features: DataFrame, scenes: DataFrame, scene: str, order: str, all_touched: bool = False,
    window: tuple[int, int, int, int] | None = None, classes: Mapping[int, float] | None = None,
) -> DataFrame:
    """Class id per covered pixel of each scene: (scene, prow, pcol, class_id); the last feature wins.

    ``scenes`` holds scene, xmin, ymax, res, height and width. ``features`` carry the scene they belong
    to. Uncovered pixels have no row; ``fill_grid`` adds the background. One pixel is reduced by a
    mergeable aggregate, so stacked features never meet in one list. ``window`` (row0, col0, height, width) lists
    only its pixels. ``classes`` gives the value burned for each class id; features of other classes burn 0.
    """
    row0, col0, high, wide = window or (0, 0, None, None)
    last_row = "height - 1L" if high is None else f"least(height - 1L, {row0 + high - 1}L)"
    last_col = "width - 1L" if wide is None else f"least(width - 1L, {col0 + wide - 1}L)"
    inside = (
        "bbox.xmin < xmin + width * res AND bbox.xmax >= xmin AND bbox.ymax > ymax - height * res AND bbox.ymin <= ymax"
    )
    value = "class_id"
    if classes is not None:
        cases = " ".join(f"WHEN class_id = {k} THEN {float(v)}D" for k, v in classes.items())
        value = f"CASE {cases} ELSE 0D END AS class_id"
    met = features.selectExpr(scene, "geom", "bbox", value, order).join(scenes, scene).where(inside)
    spans = g.cell_spans(
        "geom", lambda v: f"((ymax - {v}) / res - 0.5D)", lambda v: f"(({v} - xmin) / res - 0.5D)",
        lambda r: g.pixel_to_map(r, "0", "xmin", "ymax", "res")[1], lambda c: g.pixel_to_map("0", c, "xmin", "ymax", "res")[0],
        (f"{row0}L", last_row), (f"{col0}L", last_col),
    )
    if all_touched:
        top, left = g.map_to_pixel("bbox.xmin", "bbox.ymax", "xmin", "ymax", "res")
        bottom, right = g.map_to_pixel("bbox.xmax", "bbox.ymin", "xmin", "ymax", "res")
        spans = g.touched_spans(
            "geom", lambda v: f"((ymax - {v}) / res)", lambda v: f"(({v} - xmin) / res)", lambda r: f"(ymax - {r} * res)", lambda c: f"(xmin + {c} * res)",
            (f"greatest({row0}L, {top})", f"least({last_row}, {bottom})"), (f"greatest({col0}L, {left})", f"least({last_col}, {right})"), spans,
        )
    spread = met.selectExpr(scene, "class_id", order, f"explode({spans}) AS _s").selectExpr(
        scene, "class_id", order, "_s.row AS prow", "explode(sequence(_s.c0, _s.c1)) AS pcol"
    )
    return spread.groupBy(scene, "prow", "pcol").agg(F.max_by("class_id", order).alias("class_id"))


def scene_grid(scenes: DataFrame, scene: str) -> DataFrame:
    """All pixels of every scene."""
    return scenes.selectExpr(scene, "width", "explode(sequence(0L, height - 1L)) AS prow").selectExpr(
        scene, "prow", "explode(sequence(0L, width - 1L)) AS pcol"
    )


def fill_grid(grid: DataFrame, pixels: DataFrame, keys: Sequence[str], column: str, background: int = 0) -> DataFrame:
    """Every grid pixel with its value, or the null class where there is none."""
    joined = grid.join(pixels, list(keys), "left")
    return joined.selectExpr(*[c for c in joined.columns if c != column], f"coalesce({column}, {background}) AS {column}")


def window_pixels(pixels: DataFrame, row0: int, col0: int, height: int, width: int) -> DataFrame:
    """Pixels of one window; a range filter the scan can prune with."""
    return pixels.where(
        f"prow >= {row0} AND prow < {row0 + height} AND pcol >= {col0} AND pcol < {col0 + width}"
    )


def resize_nearest(pixels: DataFrame, height: int, width: int, out_height: int, out_width: int) -> DataFrame:
    """Nearest neighbour resize of a window: output pixel i takes input pixel floor(i * size / out)."""
    def outputs(position: str, size: int, out: int) -> str:
        first = f"CAST(ceil({position} * {out} / {size}) AS BIGINT)"
        last = f"CAST(ceil(({position} + 1) * {out} / {size}) AS BIGINT) - 1"
        return f"explode(CASE WHEN {first} <= {last} THEN sequence({first}, {last}) END)"

    return pixels.selectExpr("*", f"{outputs('prow', height, out_height)} AS orow").selectExpr(
        "*", f"{outputs('pcol', width, out_width)} AS ocol"
    )


def resample(pixels: DataFrame, factor: int, keys: Sequence[str], value: str, how: str = "sum") -> DataFrame:
    """Coarser grid by integer division of row and column."""
    return pixels.groupBy(
        *keys, F.expr(f"prow DIV {factor} AS prow"), F.expr(f"pcol DIV {factor} AS pcol")
    ).agg(F.expr(f"{how}({value}) AS {value}"))


def mosaic(images: DataFrame, keys: Sequence[str], value: str, order: str, last_on_top: bool = True) -> DataFrame:
    """One value per pixel from stacked images: the last (or first) one that is not NULL."""
    pick = F.max_by if last_on_top else F.min_by
    return images.where(f"{value} IS NOT NULL").groupBy(*keys).agg(pick(value, order).alias(value))


def land_use_mask(images: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First non-NULL land use per pixel, roads (> 50) as class 6, and the mask of used land."""
    first = {v: F.expr(f"min_by({v}, {order}) FILTER (WHERE {v} IS NOT NULL)").alias(v) for v in ("lulc", "road")}
    return (
        images.groupBy(*keys)
        .agg(first["lulc"], first["road"])
        .selectExpr(*keys, "CASE WHEN road > 50 THEN 6 ELSE lulc END AS lulc")
        .selectExpr("*", "CAST(lulc <> 0 AS INT) AS mask")
    )


def flip(pixels: DataFrame, height: str | int, width: str | int, vertical: bool = True, horizontal: bool = True) -> DataFrame:
    """Mirror pixel positions."""
    row = f"{height} - 1 - prow" if vertical else "prow"
    col = f"{width} - 1 - pcol" if horizontal else "pcol"
    others = [c for c in pixels.columns if c not in ("prow", "pcol")]
    return pixels.selectExpr(*others, f"{row} AS prow", f"{col} AS pcol")


def median_raster(images: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per-pixel median of a collection.

    A pixel has one value per image, so its list is as long as the collection, whatever the area.
    """
    return images.groupBy(*keys).agg(F.median(value).alias(value))
