"""Normalising, scoring and stitching tiles."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartier.functions.geometry import let
from quartier.functions.scalars import over_threshold

# Band means and deviations in working order (near infrared, red, green, blue).
BAND_MEANS = {"b8": 2581.270, "b4": 1298.905, "b3": 1144.928, "b2": 934.346}
BAND_STDS = {"b8": 586.279, "b4": 458.048, "b3": 302.029, "b2": 244.423}


def normalise_bands(
    pixels: DataFrame, tile: Sequence[str], bands: Sequence[str],
    means: dict = BAND_MEANS, stds: dict = BAND_STDS, is_byte: bool = False,
) -> DataFrame:
    """(value - mean) / std, divided by the tile's own deviation of that band, 0 where the raw value is 0.

    The tile deviation includes its no-data pixels. Byte data is returned as it is. No values are
    clipped. The deviations are one row per tile, joined back on the tile key.
    """
    if is_byte:
        return pixels
    scaled = {b: f"({b} - {means[b]}D) / {stds[b]}D" for b in bands}
    spread = pixels.groupBy(*tile).agg(*[F.expr(f"stddev_pop({scaled[b]}) AS _s_{b}") for b in bands])
    others = [c for c in pixels.columns if c not in bands]
    final = [
        f"CASE WHEN {b} = 0 THEN 0D WHEN _s_{b} <> 0 THEN {scaled[b]} / _s_{b} END AS {b}" for b in bands
    ]
    return pixels.join(spread, list(tile)).selectExpr(*others, *final)


def chip_statistics(pixels: DataFrame, tile: Sequence[str], band: str) -> DataFrame:
    """Population deviation, minimum and maximum of a band per tile."""
    return pixels.groupBy(*tile).agg(
        F.expr(f"stddev_pop({band}) AS std"), F.expr(f"min({band}) AS low"), F.expr(f"max({band}) AS high")
    )


def stretch(values: str) -> str:
    """Scale an array to [0, 1]; a constant array gives zeros."""
    limits = f"named_struct('low', array_min({values}), 'high', array_max({values}))"
    return let(
        limits,
        lambda b: f"transform({values}, v -> CASE WHEN {b}.high > {b}.low THEN (v - {b}.low) / ({b}.high - {b}.low) ELSE v - v END)",
    )


def clean_tiles(tiles: DataFrame, images: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """NaN image values become 0; tiles with a NaN label are dropped."""
    bad = " OR ".join(f"exists({c}, v -> v IS NULL OR isnan(v))" for c in labels)
    fixed = [
        f"transform({c}, v -> nanvl(coalesce(v, CAST(0 AS FLOAT)), CAST(0 AS FLOAT))) AS {c}" if c in images else c
        for c in tiles.columns
    ]
    return tiles.where(f"NOT ({bad})").selectExpr(*fixed)


def stack_channels(tiles: DataFrame, bands: Sequence[str], out: str = "channels") -> DataFrame:
    """Band arrays side by side, as float, in the given order."""
    arrays = ", ".join(f"transform({b}, v -> CAST(v AS FLOAT))" for b in bands)
    return tiles.selectExpr(*[c for c in tiles.columns if c not in bands], f"array({arrays}) AS {out}")


def score_tiles(
    tiles: DataFrame, open_model: Callable, inputs: Sequence[str], keys: Sequence[str], model: str = "model",
    logits: bool = True,
) -> DataFrame:
    """Probability array per tile: rows (keys, model, scores).

    ``open_model()`` runs once per task and returns a function from a batch of tiles to a matrix with
    one row per tile. Tiles move in Arrow batches; logits are turned into probabilities here.
    """
    slim = tiles.select(*keys, *[c for c in inputs if c not in keys])
    schema = T.StructType(slim.select(*keys).schema.fields).add("model", "string").add("scores", T.ArrayType(T.DoubleType()))

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = open_model()
        for pdf in parts:
            if len(pdf):
                out = np.asarray(run(pdf), dtype=np.float64)
                if logits:
                    out = 1.0 / (1.0 + np.exp(-out))
                yield pdf[list(keys)].assign(model=model, scores=list(out))

    return slim.mapInPandas(batches, schema)


def ensemble_mean(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the models' score arrays, pixel by pixel.

    A tile has one short list of arrays (one per model). They are added inside the group with one
    aggregate per tile; no pixel is exploded.
    """
    return scores.groupBy(*keys).agg(F.expr("collect_list(scores) AS _all")).selectExpr(
        *keys,
        "transform(_all[0], (v, i) -> aggregate(_all, 0D, (acc, a) -> acc + a[i]) / size(_all)) AS scores",
    )


def explode_scores(tiles: DataFrame, keys: Sequence[str], width: int, row0: str = "row0", col0: str = "col0", scores: str = "scores") -> DataFrame:
    """Absolute pixel position of every score of a tile."""
    return tiles.selectExpr(*keys, row0, col0, f"posexplode({scores}) AS (_i, score)").selectExpr(
        *keys, f"{row0} + _i DIV {width} AS prow", f"{col0} + _i % {width} AS pcol", "CAST(score AS DOUBLE) AS score"
    )


def smooth(pixel_scores: DataFrame, scene: Sequence[str]) -> DataFrame:
    """Average of all windows covering a pixel; sums are combined before the shuffle."""
    return pixel_scores.groupBy(*scene, "prow", "pcol").agg(F.expr("avg(score) AS score"))


def discretise(scores: DataFrame, threshold: float = 0.5, inclusive: bool = False) -> DataFrame:
    """Class map from scores."""
    return scores.selectExpr(
        *[c for c in scores.columns if c != "score"], f"{over_threshold('score', threshold, inclusive)} AS m"
    )
