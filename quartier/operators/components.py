"""Connected components by alternating star contraction (large star, small star)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.operators.skew import lookup_join
from quartier.session import materialise, small_tasks


def _shrink(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One large-star and one small-star step on edges (keys, u, v) with u > v.

    Every group is reduced to its minimum by a mergeable aggregate and joined back, so a hub is never
    collected; ``lookup_join`` lets adaptive execution split its join partition.
    """
    both = edges.unionByName(edges.selectExpr(*keys, "v AS u", "u AS v"))
    smallest = both.groupBy(*keys, "u").agg(F.expr("least(u, min(v)) AS m"))
    # written once, as a plan would make it for both uses
    large = materialise(lookup_join(both, smallest, [*keys, "u"]).where("v > u").selectExpr(*keys, "v AS u", "m AS v").distinct())
    parents = large.groupBy(*keys, "u").agg(F.expr("min(v) AS m"))
    joined = lookup_join(large, parents, [*keys, "u"])
    return (
        joined.where("v <> m").selectExpr(*keys, "v AS u", "m AS v")
        .unionByName(parents.selectExpr(*keys, "u", "m AS v"))
        .distinct()
    )


def connected_components(edges: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, component) for all nodes of the edge list; the component is its smallest node.

    Each round is written to the checkpoint folder; the number of rounds grows with the logarithm of
    the longest path. A task reads a bounded part of a round, however many edges there are (``small_tasks``).
    """
    keys, spark = list(keys), edges.sparkSession
    with small_tasks(spark):
        current = materialise(
            edges.where(f"{a} <> {b}").selectExpr(*keys, f"greatest({a}, {b}) AS u", f"least({a}, {b}) AS v").distinct()
        )
    hashed = ", ".join([*keys, "u", "v"])

    def state(df: DataFrame):
        return df.selectExpr("count(1)", f"sum(CAST(xxhash64({hashed}) AS DECIMAL(38, 0)))").first()

    before = state(current)
    while before[0]:
        with small_tasks(spark, 2 * before[0]):  # every edge in both directions
            current = materialise(_shrink(current, keys))
        after = state(current)
        if after == before:
            break
        before = after
    nodes = current.selectExpr(*keys, "u AS node", "v AS component").unionByName(
        current.selectExpr(*keys, "v AS node", "v AS component").distinct()
    )
    return nodes


def chain_order(links: DataFrame, keys: Sequence[str], node: str = "node", following: str = "following") -> DataFrame:
    """Distance to the end of each node's chain, by pointer doubling: rows (keys, node, to_end).

    ``following`` is NULL at the end of a chain. Rounds grow with the logarithm of the longest chain. Nodes whose
    pointer has reached an end leave the loop and only serve as targets; the other pointers of a chain all differ.
    """
    keys = list(keys)
    start = materialise(
        links.selectExpr(
            *keys, f"{node} AS node", f"{following} AS ptr", f"CAST({following} IS NOT NULL AS BIGINT) AS to_end"
        )
    )
    settled, moving = start.where("ptr IS NULL"), start.where("ptr IS NOT NULL")
    while not moving.isEmpty():
        ahead = settled.unionByName(moving).selectExpr(*keys, "node AS ptr", "ptr AS _ptr", "to_end AS _d")
        stepped = materialise(
            moving.join(ahead, [*keys, "ptr"], "left").selectExpr(
                *keys, "node", "_ptr AS ptr", "to_end + coalesce(_d, 0) AS to_end"
            )
        )
        settled, moving = settled.unionByName(stepped.where("ptr IS NULL")), stepped.where("ptr IS NOT NULL")
    return settled.drop("ptr")
