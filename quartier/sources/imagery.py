"""Raster sources: image collections, scenes and population grids as tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.functions.scalars import stem
from quartier.operators.raster import median_raster, mosaic

# Stored band order, working band order, period and cloud limit of the collection.
STORED_BANDS = ["b2", "b3", "b4", "b8"]
CHANNEL_ORDER = [3, 2, 1, 0]
START_DATE, END_DATE = "2023-01-01", "2024-05-24"
CLOUD_FILTER = 15


def ordered_bands(order: Sequence[int] = CHANNEL_ORDER, stored: Sequence[str] = STORED_BANDS) -> list[str]:
    return [stored[i] for i in order]


def read_bands(pixels: DataFrame, keys: Sequence[str], order: Sequence[int] = CHANNEL_ORDER, window: tuple | None = None) -> DataFrame:
    """Bands in working order; ``window`` = (row0, col0, row1, col1) prunes by range."""
    if window is not None:
        r0, c0, r1, c1 = window
        pixels = pixels.where(f"prow >= {r0} AND prow < {r1} AND pcol >= {c0} AND pcol < {c1}")
    return pixels.select(*keys, *ordered_bands(order))


def select_bands(df: DataFrame, keys: Sequence[str], pattern: str = "b[0-9]+") -> DataFrame:
    """Key columns and the bands whose name matches."""
    return df.select(*keys, df.colRegex(f"`{pattern}`"))


def scene_metadata(pixels: DataFrame, scene: str) -> DataFrame:
    """Extent and pixel count of each scene."""
    return pixels.groupBy(scene).agg(
        F.expr("min(prow) AS row_min"), F.expr("max(prow) AS row_max"),
        F.expr("min(pcol) AS col_min"), F.expr("max(pcol) AS col_max"),
        F.expr("count(1) AS pixels"),
    )


def filter_images(
    images: DataFrame, start: str = START_DATE, end: str = END_DATE, cloud: float | None = CLOUD_FILTER,
    area: tuple | None = None,
) -> DataFrame:
    """Images of a period (end excluded) under a cloud limit and, given (xmin, ymin, xmax, ymax), over an area."""
    out = images.where(f"day >= '{start}' AND day < '{end}'")
    if cloud is not None:
        out = out.where(f"cloud_pct <= {cloud}")
    if area is not None:
        x0, y0, x1, y1 = area
        out = out.where(f"bbox.xmin <= {x1} AND bbox.xmax >= {x0} AND bbox.ymin <= {y1} AND bbox.ymax >= {y0}")
    return out


def save_first(primary: DataFrame, secondary: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Attach the first matching secondary image; primaries without one are dropped."""
    picked = ", ".join(columns)
    first = secondary.groupBy(key).agg(F.expr(f"min_by(struct({picked}), {order}) AS saved"))
    return primary.join(first, key).select("*", *[F.col(f"saved.{c}").alias(c) for c in columns]).drop("saved")


def population_grid(hrsl: DataFrame, ghs: DataFrame, use_hrsl: bool = True) -> DataFrame:
    """Population pixels of one of two datasets, named in ``dataset_used``; the collection is mosaicked."""
    keys = ["prow", "pcol", "px", "py"]
    if use_hrsl:
        return mosaic(hrsl, keys, "b1", "image_order").selectExpr("*", "'HRSL' AS dataset_used")
    return ghs.selectExpr(*keys, "b1", "'GHS' AS dataset_used")


def population_window(images: DataFrame, box: tuple) -> DataFrame:
    """Median population grid inside (xmin, ymin, xmax, ymax), with row and column counted from its corner."""
    x0, y0, x1, y1 = box
    inside = images.where(f"px >= {x0} AND px < {x1} AND py >= {y0} AND py < {y1}")
    return median_raster(inside, ["prow", "pcol", "px", "py"], "b1")


def match_images(cities: DataFrame, images: DataFrame) -> DataFrame:
    """First image (by name) called ``country_city*`` per city; ``image_path`` is NULL when none matches.

    The prefix test becomes an equi-join: every image name is listed under its prefixes that end
    before an underscore or at the end of the name part, instead of comparing all pairs.
    """
    name = stem("image_path")
    # prefixes of the name, one per length: names are short strings
    listed = images.selectExpr("image_path", f"{name} AS _name").selectExpr(
        "image_path", "explode(transform(sequence(1, length(_name)), i -> left(_name, i))) AS _prefix"
    )
    wanted = cities.selectExpr("*", "concat(country, '_', city) AS _prefix")
    first = (
        listed.join(wanted.select("_prefix").distinct(), "_prefix", "left_semi")
        .groupBy("_prefix")
        .agg(F.expr("min(image_path) AS image_path"))
    )
    return wanted.join(first, "_prefix", "left").drop("_prefix")


def skipped_cities(matched: DataFrame) -> DataFrame:
    """Cities without an image."""
    return matched.where("image_path IS NULL").drop("image_path")
