"""Mixing sources to target weights by hash-threshold histograms."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartier.llm.common import WORD, id_text, text_or_empty
from quartier.session import materialise

#: Bits of a document's hash, and bits told apart by one level of histograms.
HASH_BITS, STEP = 60, 10


def targets(sizes: dict[str | None, int], weights=(5, 2, 1), factor: float = 1.5, repeats: float = 2.0) -> dict[str | None, float]:
    """Words to take from each source: ``factor`` times all words, shared by weight, none above ``repeats`` times its own.

    Weights repeat over the sources in code-point order, null last.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, open_, result = factor * sum(sizes.values()), list(order), {}
    while open_:
        share = budget / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * share > repeats * sizes[s]]
        if not full:
            return result | {s: weight[s] * share for s in open_}
        for s in full:
            result[s] = repeats * sizes[s]
            budget -= result[s]
        open_ = [s for s in open_ if s not in result]
    return result


def _hash():
    return F.conv(F.substring(F.md5(id_text().cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _size():
    return F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")


def plan_mix(docs: DataFrame, weights=(5, 2, 1), factor: float = 1.5, repeats: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(facts, cuts): facts has doc_id, source, size, h of every row; cuts has one row per source.

    A source's target is met by ``whole`` copies of each document and one more of those with h < ``below``. The
    threshold is found level by level: sizes are summed by source and bucket of h (pre-aggregated), a running
    sum over at most 1,024 buckets finds the one in which the budget ends, and only that bucket is told apart
    further. The driver and ``cuts`` hold one row per source, nothing per document.
    """
    spark = docs.sparkSession
    facts = materialise(docs.select("doc_id", "source", _size().alias("size"), _hash().alias("h")))
    sizes = {r["source"]: r["n"] or 0 for r in facts.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    target = targets(sizes, weights, factor, repeats)
    state = {}
    for s, n in sizes.items():
        whole = math.floor(target[s] / n) if n else 0
        state[s] = {"whole": whole, "rest": target[s] - whole * n, "below": 0, "open": n > 0 and target[s] > whole * n}
    for level in range(1, HASH_BITS // STEP + 1):
        wide = HASH_BITS - STEP * level
        rows = [(s, x["below"] >> (wide + STEP), x["rest"]) for s, x in state.items() if x["open"]]
        if not rows:
            break
        looked = spark.createDataFrame(rows, "_s string, _lo long, _rest double")
        hist = (
            facts.join(F.broadcast(looked), F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("h", wide + STEP) == F.col("_lo")))
            .where("size > 0").groupBy("source", "_rest", F.shiftright("h", wide).alias("bucket"))
            .agg(F.sum("size").alias("n"), F.count("*").alias("docs"))
        )
        before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ends = hist.withColumn("before", before).where("before <= _rest AND before + n > _rest").collect()
        met = {r["source"]: r for r in ends}
        for s, x in state.items():
            if not x["open"]:
                continue
            if (r := met.get(s)) is None:  # the budget ends with the last bucket
                x |= {"below": ((x["below"] >> (wide + STEP)) + 1) << (wide + STEP), "open": False}
                continue
            x |= {"below": r["bucket"] << wide, "rest": x["rest"] - r["before"]}
            if r["docs"] == 1 or not wide:  # one document or one hash: in if that comes nearer
                x |= {"below": (r["bucket"] + (2 * x["rest"] >= r["n"])) << wide, "open": False}
    cuts = spark.createDataFrame(
        [(s, sizes[s], float(target[s]), x["whole"], x["below"]) for s, x in state.items()],
        "_s string, source_size long, target double, whole long, below long",
    )
    return facts, cuts


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row of ``docs``.

    Size is the number of words (null text: 0); null is a source of its own. Rows that share a doc_id share their
    hash and so their fate. Documents without words are taken as often as their hash says. Reruns agree.
    """
    facts, cuts = plan_mix(docs, **options)
    return facts.join(F.broadcast(cuts), F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") + (F.col("h") < F.col("below")).cast("long")).alias("copies"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as taken, with their columns. No row is shuffled."""
    _, cuts = plan_mix(docs, **options)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    cuts = cuts.select([F.col(c).alias(f"_llm_{c}") for c in cuts.columns])
    copies = F.col("_llm_whole") + (_hash() < F.col("_llm_below")).cast("long")
    return (
        docs.join(F.broadcast(cuts), F.col("source").eqNullSafe(F.col("_llm__s")))
        .withColumn("_llm_copies", copies).where("_llm_copies > 0")
        .withColumn("_llm_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_llm_copies"))))
        .select(*columns)
    )
