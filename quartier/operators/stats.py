"""Grouped statistics of metric columns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.functions.scalars import min_max
from quartier.operators.skew import exact_percentiles, lookup_join
from quartier.session import materialise


def describe(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of a column per group."""
    base = df.groupBy(*group).agg(
        F.expr(f"count({value}) AS count"), F.expr(f"avg({value}) AS mean"),
        F.expr(f"stddev_samp({value}) AS std"), F.expr(f"min({value}) AS min"), F.expr(f"max({value}) AS max"),
    )
    quartiles = exact_percentiles(df, group, value, [0.25, 0.5, 0.75]).groupBy(*group).agg(
        *[F.expr(f"max(q) FILTER (WHERE p = {p}D) AS {n}") for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    return base.join(quartiles, list(group))


def mean_and_std(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).agg(
        *[F.expr(f"avg({c}) AS {c}_mean") for c in columns], *[F.expr(f"stddev_samp({c}) AS {c}_std") for c in columns]
    )


def box_statistics(df: DataFrame, group: Sequence[str], value: str, whiskers: tuple = (0.1, 0.9)) -> DataFrame:
    """Whiskers and quartiles per group."""
    points = [whiskers[0], 0.25, 0.5, 0.75, whiskers[1]]
    names = ["low", "q1", "median", "q3", "high"]
    q = exact_percentiles(df, group, value, points)
    return q.groupBy(*group).agg(*[F.expr(f"max(q) FILTER (WHERE p = {p}D) AS {n}") for p, n in zip(points, names)])


def drop_outliers(df: DataFrame, group: Sequence[str], columns: Sequence[str], sigmas: float = 3.0) -> DataFrame:
    """Keep rows within mean +- sigmas * std, column after column.

    Limits of a column come from the rows that passed the earlier ones. Each limit table has one row
    per group and is written out, so every pass is one scan with broadcast filters and no shuffle of
    the rows. NULL values, and groups without a deviation, do not pass.
    """
    kept = df
    for c in columns:
        limits = materialise(kept.groupBy(*group).agg(F.expr(f"avg({c}) AS _m"), F.expr(f"stddev_samp({c}) AS _s")))
        kept = lookup_join(kept, limits, group).where(
            f"{c} >= _m - {sigmas} * _s AND {c} <= _m + {sigmas} * _s"
        ).select(*df.columns)
    return kept


def scale_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min-max scaling over the whole table; the limits are a scalar subquery."""
    parts = ", ".join(f"'{c}_{f}', {f}({c})" for c in columns for f in ("min", "max"))
    limits = df.selectExpr(f"named_struct({parts}) AS lim")
    others = [c for c in df.columns if c not in columns]
    return df.withColumn("_lim", limits.scalar()).selectExpr(
        *others, *[f"{min_max(c, f'_lim.{c}_min', f'_lim.{c}_max')} AS {c}" for c in columns]
    )


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def map_names(df: DataFrame, column: str, names: dict[str, str], keep_unknown: bool = False) -> DataFrame:
    """Replace codes by display names; unknown codes become NULL or stay. The mapping is a literal."""
    pairs = ", ".join(f"{k!r}, {v!r}" for k, v in names.items())
    found = f"map({pairs})[{column}]"
    expr = f"coalesce({found}, {column})" if keep_unknown else found
    return df.selectExpr(*[c for c in df.columns if c != column], f"{expr} AS {column}")
