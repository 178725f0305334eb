"""Joins and rankings that stay parallel when one key holds a large share of the rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.session import materialise

ROWS_PER_TASK = 4_000_000
#: Rows that a task unfolds at most from the rows given to it, as far as single rows allow.
UNFOLDED_PER_TASK = 200_000


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """All keys with more than ``rows_per_task`` rows and the number of pieces each should be cut into.

    There are at most rows / rows_per_task of them: a few million short rows for 1e13 input rows.
    """
    return (
        df.groupBy(*keys)
        .agg(F.expr("count(1) AS _n"))
        .where(f"_n > {rows_per_task}")
        .selectExpr(*keys, f"CAST(ceil(_n / {rows_per_task}) AS INT) AS _pieces")
    )


def salted_join(
    big: DataFrame,
    other: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    condition: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Equi-join in which hot keys of ``big`` are cut into pieces and ``other`` repeated per piece.

    ``how`` may be inner, left or left_semi (seen from ``big``). Columns besides ``keys`` must differ. Pieces are
    dealt by row number, so equal rows spread too and columns may be of any type; ``big`` should come from files or
    a checkpoint, whose order holds when a task runs again.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(big, keys, rows_per_task))
    left = big.selectExpr("*", "monotonically_increasing_id() AS _row").join(hot, keys, "left").selectExpr(
        *big.columns, "CAST(CASE WHEN _pieces > 1 THEN pmod(_row, _pieces) ELSE 0 END AS INT) AS _piece",
    )
    right = other.join(hot, keys, "left").selectExpr(
        *[f"{c} AS _k_{c}" if c in keys else c for c in other.columns],
        "explode(sequence(0, coalesce(_pieces, 1) - 1)) AS _k__piece",
    )
    match = " AND ".join(f"{c} = _k_{c}" for c in [*keys, "_piece"])
    if condition is not None:
        match = f"{match} AND {condition}"
    return left.join(right, F.expr(match), how).drop("_piece", *[f"_k_{c}" for c in [*keys, "_piece"]])


def lookup_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a table expected to be small; adaptive execution broadcasts it by its measured bytes.

    Beyond that size it is a shuffled join. One more key, derived from the others, makes Spark exchange both sides
    anew even after an aggregate by ``keys``: only such exchanges can be split at a hot key.
    """
    tag = F.xxhash64(*keys)
    joined = big.withColumn("_tag", tag).join(small.withColumn("_tag", tag), [*keys, "_tag"], how)
    return joined.drop("_tag")


def spread_rows(df: DataFrame, unfolded: str, rows_per_task: int = UNFOLDED_PER_TASK) -> DataFrame:
    """``df`` dealt to tasks so that one unfolds about ``rows_per_task`` rows, where a row gives ``unfolded`` rows.

    A file of a few MB is read by one task, which would unfold, group and sort all that its rows become. Rows are dealt by
    their own values, so a task that runs again gets its rows again; equal rows stay together.
    """
    total = df.selectExpr(f"sum({unfolded}) AS n").first()[0] or 0
    tasks = -(-int(total) // rows_per_task)
    return df.repartition(tasks, F.xxhash64(*df.columns)) if tasks > 1 else df


def shuffled_rank(
    df: DataFrame, group: Sequence[str], keys: Sequence[str], seed: int, hex_digits: int = 3, whole: int = ROWS_PER_TASK // 100
) -> DataFrame:
    """Add ``pos`` (0-based place in a seeded shuffle of the group) and ``n`` (group size).

    The order is by md5 of seed, group and keys. The leading hex digits cut every group of over ``whole`` rows into
    16**hex_digits even buckets; places are counted inside buckets and shifted by the sizes of the
    earlier ones, so no task ever sorts a large group. Smaller groups are one bucket, as their buckets would be as many as their rows.
    """
    by = ", ".join(group)
    text = ", ".join(f"CAST({c} AS STRING)" for c in [*group, *keys])
    large = df.groupBy(*group).agg(F.expr("count(1) AS _n")).where(f"_n > {whole}")
    tagged = lookup_join(df, large, group, "left").selectExpr(
        *df.columns, f"md5(concat_ws('|', '{seed}', {text})) AS _h", "_n IS NOT NULL AS _large"
    ).selectExpr(*df.columns, "_h", f"CASE WHEN _large THEN substring(_h, 1, {hex_digits}) ELSE '' END AS _b")
    sizes = tagged.groupBy(*group, "_b").agg(F.expr("count(1) AS _c"))
    offsets = sizes.selectExpr(
        *group, "_b",
        f"sum(_c) OVER (PARTITION BY {by} ORDER BY _b ROWS UNBOUNDED PRECEDING) - _c AS _off",
        f"sum(_c) OVER (PARTITION BY {by}) AS n",
    )
    order = ", ".join(["_h", *keys])
    placed = tagged.selectExpr("*", f"row_number() OVER (PARTITION BY {by}, _b ORDER BY {order}) - 1 AS _p")
    # rows unfolded from a small file are taken for few: where a plan wants no other column of theirs, Spark would broadcast all of them
    return placed.hint("merge").join(offsets, [*group, "_b"]).selectExpr(*df.columns, "CAST(_p + _off AS BIGINT) AS pos", "n")


def _range_bucket(df: DataFrame, group: list[str], order: str, buckets: int) -> DataFrame:
    """Add ``_b``, a value range number: equal rows per range as far as ties allow.

    There are ``buckets`` ranges, or more where the largest group would put over ROWS_PER_TASK rows into one.
    The cut points come from one mergeable sketch per group and are written out once, so every use of
    the bucket sees the same ranges.
    """
    most = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    buckets = max(buckets, -(-most // ROWS_PER_TASK))
    points = ", ".join(f"{i / buckets}D" for i in range(1, buckets))
    sketch = f"percentile_approx({order}, array({points}), {20 * buckets}) AS _cuts"
    cuts = materialise(df.groupBy(*group).agg(F.expr(sketch)))
    return lookup_join(df, cuts, group).selectExpr(*df.columns, f"size(filter(_cuts, c -> c < {order})) AS _b")


def ordered_rank(
    df: DataFrame, group: Sequence[str], order: str, ties: Sequence[str] = (), buckets: int = 64
) -> DataFrame:
    """Add ``pos``, the 0-based place by (order, ties) within the group, without sorting a group in one task.

    ``order`` is a numeric column without NULLs; rows equal in it share a bucket.
    """
    group = list(group)
    by = ", ".join(group)
    tagged = _range_bucket(df, group, order, buckets)
    offsets = tagged.groupBy(*group, "_b").agg(F.expr("count(1) AS _c")).selectExpr(
        *group, "_b", f"sum(_c) OVER (PARTITION BY {by} ORDER BY _b ROWS UNBOUNDED PRECEDING) - _c AS _off"
    )
    inner = ", ".join([order, *ties])
    placed = tagged.selectExpr("*", f"row_number() OVER (PARTITION BY {by}, _b ORDER BY {inner}) - 1 AS _p")
    return placed.join(offsets, [*group, "_b"]).selectExpr(*df.columns, "CAST(_p + _off AS BIGINT) AS pos")


def exact_percentiles(
    df: DataFrame, group: Sequence[str], value: str, probabilities: Sequence[float], buckets: int = 64
) -> DataFrame:
    """Interpolated percentiles: rows (group, p, q). NULL values are ignored.

    Equal values are counted first, then ranked range by range; only the rows next to a wanted rank
    reach the final aggregate. The built-in exact percentile keeps all distinct values of a group in
    one task instead.
    """
    group = list(group)
    by = ", ".join(group)
    # written once: the cut points and the ranking both read it
    counts = materialise(df.where(f"{value} IS NOT NULL").groupBy(*group, value).agg(F.expr("count(1) AS _c")))
    tagged = _range_bucket(counts, group, value, buckets)
    offsets = tagged.groupBy(*group, "_b").agg(F.expr("sum(_c) AS _s")).selectExpr(
        *group, "_b",
        f"sum(_s) OVER (PARTITION BY {by} ORDER BY _b ROWS UNBOUNDED PRECEDING) - _s AS _off",
        f"sum(_s) OVER (PARTITION BY {by}) AS _n",
    )
    running = f"sum(_c) OVER (PARTITION BY {by}, _b ORDER BY {value} ROWS UNBOUNDED PRECEDING) AS _run"
    ranked = tagged.selectExpr("*", running).join(offsets, [*group, "_b"]).selectExpr(
        *group, value, "_n", "_run + _off AS _end", "_run + _off - _c AS _start"
    )
    low, high = "floor(p * (_n - 1))", "ceil(p * (_n - 1))"
    wanted = ", ".join(f"{float(p)}D" for p in probabilities)
    near = (
        f"filter(array({wanted}), p -> ({low} >= _start AND {low} < _end) OR ({high} >= _start AND {high} < _end))"
    )
    hits = ranked.selectExpr(*group, value, "_n", "_start", "_end", f"explode({near}) AS p")
    return (
        hits.groupBy(*group, "p")
        .agg(
            F.expr(f"max(CASE WHEN {low} >= _start AND {low} < _end THEN {value} END) AS _lo"),
            F.expr(f"max(CASE WHEN {high} >= _start AND {high} < _end THEN {value} END) AS _hi"),
            F.expr("max(_n) AS _n"),
        )
        .selectExpr(*group, "p", f"_lo + (_hi - _lo) * (p * (_n - 1) - {low}) AS q")
    )
