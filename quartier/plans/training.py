"""A pixel scorer fitted on Spark, for use where no network file is given."""
from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from quartier.operators.metrics import POSITIVE_WEIGHT


def fit_pixel_scorer(
    pixels: DataFrame, features: Sequence[str], label: str = "truth", weight: float = POSITIVE_WEIGHT, max_iter: int = 200,
):
    """Weighted logistic regression on pixel features; returns the fitted model.

    Training is Spark's own distributed optimiser: every iteration aggregates gradients over all rows. A fit that
    ``max_iter`` ends before it converges warns.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    weighted = pixels.selectExpr(
        *features, f"CAST({label} AS DOUBLE) AS label", f"CASE WHEN {label} = 1 THEN {weight}D ELSE 1D END AS w"
    ).dropna()
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(weighted)
    model = LogisticRegression(weightCol="w", maxIter=max_iter, regParam=1e-6).fit(rows)
    if model.summary.totalIterations >= max_iter:
        warnings.warn(f"the fit has not converged in {max_iter} iterations", stacklevel=2)
    return model


def cross_score(pixels: DataFrame, features: Sequence[str], n_splits: int, fold: str = "fold", **options) -> DataFrame:
    """Pixels of each fold (0 to ``n_splits`` - 1), scored by a model fitted on all other folds.

    Rows without a fold are test rows: no model sees them and they are left out.
    """
    known = pixels.where(f"{fold} IS NOT NULL")
    parts = []
    for k in range(n_splits):
        model = fit_pixel_scorer(known.where(f"{fold} <> {k}"), features, **options)
        parts.append(score_pixels(model, known.where(f"{fold} = {k}"), features))
    return reduce(lambda a, b: a.unionByName(b), parts)


def score_pixels(model, pixels: DataFrame, features: Sequence[str]) -> DataFrame:
    """Probability of the positive class as a plain column expression of the fitted coefficients."""
    terms = " + ".join(f"{float(w)!r}D * {f}" for w, f in zip(model.coefficients, features))
    return pixels.selectExpr("*", f"1 / (1 + exp(-({float(model.intercept)!r}D + {terms}))) AS score")
