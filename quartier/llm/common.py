"""Shared pieces of the text operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartier.session import materialise

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def id_text() -> Column:
    """doc_id as text; a null id counts as the empty text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def id_remainder(n: int) -> Column:
    return F.crc32(id_text().cast("binary")) % n


def without_white(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which a key may hold any share of the rows.

    One more key, derived from the others, makes Spark exchange both sides anew even where one was just
    aggregated by ``keys``; only such exchanges can adaptive execution cut at a hot key.
    """
    tag = F.xxhash64(*keys)
    return left.withColumn("_llm_tag", tag).join(right.withColumn("_llm_tag", tag), [*keys, "_llm_tag"], how).drop("_llm_tag")


def hash_sample(rows: DataFrame, by: list[Column], bound: int) -> DataFrame:
    """At most ``bound`` rows, those of least hash of ``by``.

    Rows are first cut by hash to little more than ``bound`` of all, so that the tasks together send no more than that.
    """
    share = 1.2 * bound / max(rows.count(), 1)
    place = F.xxhash64(*by)
    cut = rows if share >= 1 else rows.where(F.pmod(place, F.lit(2**40)) < int(share * 2**40))
    return cut.orderBy(place, *by).limit(bound)


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    Alternates large-star and small-star steps. Minima are pre-aggregated and joined back with ``spread_join``,
    so a hub is neither collected nor bound to one task. Each round is checkpointed; the rounds grow with the
    logarithm of the longest path.
    """
    current = materialise(
        edges.where(f"{a} <> {b}").selectExpr(f"greatest({a}, {b}) AS u", f"least({a}, {b}) AS v").distinct()
    )

    def state(df: DataFrame):
        return df.selectExpr("count(1)", "sum(CAST(xxhash64(u, v) AS DECIMAL(38, 0)))").first()

    before = state(current)
    while before[0]:
        both = current.unionByName(current.selectExpr("v AS u", "u AS v"))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = materialise(spread_join(both, smallest, ["u"]).where("v > u").selectExpr("v AS u", "m AS v").distinct())
        parents = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, parents, ["u"]).where("v <> m").selectExpr("v AS u", "m AS v")
        current = materialise(small.unionByName(parents.selectExpr("u", "m AS v")).distinct())
        after = state(current)
        if after == before:
            break
        before = after
    roots = current.select("v").distinct()
    return current.selectExpr("u AS node", "v AS component").unionByName(roots.selectExpr("v AS node", "v AS component"))
