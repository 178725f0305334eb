"""Cloud-masked median composite of dated images."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.functions.scalars import math_azimuth
from quartier.operators.focal import focal, project_mask
from quartier.operators.raster import resample

# Cloud probability and dark near-infrared limits, projection distance and buffer.
CLOUD_PROBABILITY = 50
DARK_NIR = 0.15
REFLECTANCE_SCALE = 1e4
PROJECTION_STEPS = 1 * 10
WATER_CLASS = 6
MIN_RADIUS = 2
MAX_RADIUS = 10 * 2 / 20
KEYS = ["image_id"]


def add_clouds(obs: DataFrame, threshold: float = CLOUD_PROBABILITY) -> DataFrame:
    """``clouds`` = 1 where the cloud probability exceeds the threshold."""
    return obs.selectExpr("*", f"CAST(probability > {threshold} AS INT) AS clouds")


def add_shadows(
    obs: DataFrame, images: DataFrame, factor: int = 10, steps: int = PROJECTION_STEPS, exclude_water: bool = False
) -> DataFrame:
    """``dark_pixels``, ``cloud_transform`` and ``shadows``: dark pixels on the sun-ray trace of a cloud.

    Clouds are traced on a coarser grid (``factor`` pixels per cell, any cloud marks the cell), so the
    number of traced cells falls with its square.
    """
    dark = f"b8 < {DARK_NIR * REFLECTANCE_SCALE}" + (f" AND scl <> {WATER_CLASS}" if exclude_water else "")
    coarse = resample(obs.where("clouds = 1"), factor, KEYS, "clouds", "max")
    traced = project_mask(
        coarse.join(images.select("image_id", "azimuth"), "image_id"), [*KEYS, "azimuth"], math_azimuth("azimuth"), steps
    ).selectExpr(*KEYS, "prow AS _cr", "pcol AS _cc", "1 AS cloud_transform")
    keyed = obs.selectExpr("*", f"prow DIV {factor} AS _cr", f"pcol DIV {factor} AS _cc")
    return (
        keyed.join(traced, [*KEYS, "_cr", "_cc"], "left")
        .selectExpr(
            *obs.columns, f"CAST({dark} AS INT) AS dark_pixels", "coalesce(cloud_transform, 0) AS cloud_transform"
        )
        .selectExpr("*", "cloud_transform * dark_pixels AS shadows")
    )


def add_mask(
    obs: DataFrame, factor: int = 2, min_radius: float = MIN_RADIUS, max_radius: float = MAX_RADIUS, shape: str = "circle"
) -> DataFrame:
    """``cloudmask``: cloud or shadow, small patches removed, the rest grown, on a coarser grid."""
    flagged = obs.selectExpr("*", "CAST(clouds + shadows > 0 AS INT) AS _flag")
    coarse = resample(flagged, factor, KEYS, "_flag", "max")
    shrunk = focal(coarse, KEYS, "_flag", min_radius, "min", shape)
    grown = focal(shrunk, KEYS, "_flag", max_radius, "max", shape).selectExpr(
        *KEYS, "prow AS _cr", "pcol AS _cc", "_flag AS cloudmask"
    )
    keyed = obs.selectExpr("*", f"prow DIV {factor} AS _cr", f"pcol DIV {factor} AS _cc")
    return keyed.join(grown, [*KEYS, "_cr", "_cc"]).drop("_cr", "_cc")


def apply_mask(obs: DataFrame, keys: Sequence[str], pattern: str = "b[0-9]+") -> DataFrame:
    """Reflectance bands, NULL where masked."""
    bands = obs.select(obs.colRegex(f"`{pattern}`")).columns
    return obs.selectExpr(*keys, *[f"CASE WHEN cloudmask = 0 THEN {b} END AS {b}" for b in bands])


def composite(
    images: DataFrame, obs: DataFrame, bands: Sequence[str] = ("b2", "b3", "b4", "b8"), scene: Sequence[str] = (),
    shadow_factor: int = 10, shadow_steps: int = PROJECTION_STEPS, mask_factor: int = 2,
) -> DataFrame:
    """Median of the unmasked observations per pixel; ``images`` are already filtered.

    A pixel has at most one observation per image, so the exact median of one group stays as short as
    the collection.
    """
    picked = obs.join(images.select("image_id", *scene), "image_id")
    shadows = add_shadows(add_clouds(picked), images, shadow_factor, shadow_steps)
    masked = apply_mask(add_mask(shadows, mask_factor), [*scene, "image_id", "prow", "pcol"])
    return masked.groupBy(*scene, "prow", "pcol").agg(*[F.median(b).alias(b) for b in bands])
