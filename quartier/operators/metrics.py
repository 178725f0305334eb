"""Segmentation metrics."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Smoothing constants of the per-image metrics and the positive class weight.
IOU_SMOOTH = 1e-6
RATIO_SMOOTH = 1e-10
POSITIVE_WEIGHT = 2.0


def image_metrics(pixels: DataFrame, image: Sequence[str], pred: str = "pred", truth: str = "truth") -> DataFrame:
    """IoU, precision, recall and F1 of every image from its 0/1 pixels."""
    counts = pixels.groupBy(*image).agg(
        F.expr(f"CAST(count_if({pred} = 1 AND {truth} = 1) AS DOUBLE) AS tp"),
        F.expr(f"CAST(count_if({pred} = 1) AS DOUBLE) AS pp"),
        F.expr(f"CAST(count_if({truth} = 1) AS DOUBLE) AS ap"),
    )
    s, e = f"{IOU_SMOOTH!r}D", f"{RATIO_SMOOTH!r}D"
    return counts.selectExpr(
        *image, f"(tp + {s}) / (pp + ap - tp + {s}) AS iou",
        f"tp / (pp + {e}) AS precision", f"tp / (ap + {e}) AS recall",
    ).selectExpr("*", f"2 * precision * recall / (precision + recall + {e}) AS f1")


def mean_metrics(per_image: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over images."""
    return per_image.groupBy(*by).agg(*[F.expr(f"avg({m}) AS {m}") for m in ("iou", "precision", "recall", "f1")])


def class_metrics(pixels: DataFrame, by: Sequence[str], class_id: int = 1, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Global F1, precision and recall of one class per group; NULL where a denominator is zero."""
    counts = pixels.groupBy(*by).agg(
        F.expr(f"count_if({pred} = {class_id} AND {truth} = {class_id}) AS tp"),
        F.expr(f"count_if({pred} = {class_id} AND {truth} <> {class_id}) AS fp"),
        F.expr(f"count_if({pred} <> {class_id} AND {truth} = {class_id}) AS fn"),
    )
    rates = counts.selectExpr(
        "*", "try_divide(tp, tp + fp) AS precision", "try_divide(tp, tp + fn) AS recall"
    )
    return rates.selectExpr(
        *by, "tp", "fp", "fn", "precision", "recall",
        "try_divide(2 * precision * recall, precision + recall) AS f1",
    )


def weighted_mean(city_metrics: DataFrame, compat: bool = False) -> DataFrame:
    """Tile-weighted means over cities with defined metrics.

    ``compat`` divides by the tiles of all cities, including those left out for undefined metrics.
    """
    valid = "f1 IS NOT NULL AND precision IS NOT NULL AND recall IS NOT NULL"
    total = "sum(num_tiles)" if compat else f"sum(num_tiles) FILTER (WHERE {valid})"
    return city_metrics.agg(
        *[F.expr(f"sum({m} * num_tiles) FILTER (WHERE {valid}) / {total} AS {m}") for m in ("f1", "precision", "recall")]
    )


def unweighted_mean(city_metrics: DataFrame) -> DataFrame:
    """Plain means over cities with defined metrics."""
    valid = city_metrics.where("f1 IS NOT NULL AND precision IS NOT NULL AND recall IS NOT NULL")
    return valid.agg(*[F.expr(f"avg({m}) AS {m}") for m in ("f1", "precision", "recall")])


def cross_entropy(logit: str, truth: str, weight: float = POSITIVE_WEIGHT) -> str:
    """Weighted binary cross-entropy of one pixel from its logit, in the overflow-safe form."""
    softplus = f"(log1p(exp(-abs({logit}))) + greatest(-({logit}), 0D))"
    return f"(1 - {truth}) * ({logit}) + (1 + ({weight}D - 1) * {truth}) * {softplus}"


def mean_loss(pixels: DataFrame, by: Sequence[str], weight: float = POSITIVE_WEIGHT, logit: str = "logit", truth: str = "truth") -> DataFrame:
    return pixels.groupBy(*by).agg(F.expr(f"avg({cross_entropy(logit, truth, weight)}) AS loss"))
