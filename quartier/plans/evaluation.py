"""Evaluation of predictions per city and split."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.operators.metrics import class_metrics


def evaluate(pred: DataFrame, truth: DataFrame, tiles: DataFrame, city: str, class_id: int = 1) -> DataFrame:
    """Per city: F1, precision and recall of one class over all pixels, with the number of tiles.

    Cities without tiles are left out.
    """
    joined = pred.join(truth, [city, "prow", "pcol"])
    counts = tiles.groupBy(city).agg(F.expr("count(1) AS num_tiles"))
    return class_metrics(joined, [city], class_id).join(counts, city).where("num_tiles > 0")


def evaluate_unseen(
    pred: DataFrame, truth: DataFrame, folds: DataFrame, keys: Sequence[str], class_id: int = 1
) -> DataFrame:
    """Per city and split: metrics of split i's predictions on the tiles that validate split i.

    ``pred`` and ``truth`` hold one row per tile pixel (keys, i) and ``pred`` also its split.
    """
    city = keys[0]
    unseen = pred.join(folds.where("fold IS NOT NULL").selectExpr(*keys, "fold AS split"), [*keys, "split"])
    joined = unseen.join(truth, [*keys, "i"])
    counts = folds.where("fold IS NOT NULL").groupBy(city, F.expr("fold AS split")).agg(F.expr("count(1) AS num_tiles"))
    return class_metrics(joined, [city, "split"], class_id).join(counts, [city, "split"])
