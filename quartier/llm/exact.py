"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.llm.common import spread_join, text_or_empty, without_white
from quartier.session import materialise

#: Code points of the normalised text that the second level hashes.
PREFIX = 256


def _facts(docs: DataFrame) -> DataFrame:
    norm = without_white(text_or_empty())
    return docs.select(
        F.col("doc_id"),
        F.length(text_or_empty()).cast("long").alias("n_chars"),
        F.length(norm).cast("long").alias("n_norm"),
        F.xxhash64(F.substring(norm, 1, PREFIX)).alias("prefix_hash"),
        F.sha2(norm, 256).alias("sha"),
    )


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose ``keys`` another row has too."""
    groups = rows.groupBy(*keys).count().where("count > 1").select(*keys)
    return spread_join(rows, groups, keys, "left_semi")


def exact_groups(docs: DataFrame, digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, n_norm, prefix_hash, sha, keep_id, group_size, kept.

    Texts are equal when identical after deleting white space; a null text is empty. Of equal texts the row with
    the most code points stays, then the smallest doc_id (null last); of rows that repeat text and doc_id, one.
    ``sha`` (of the normalised text) is null for rows that no other row resembles, unless ``digest`` asks
    for it. Without ``digest`` the first read takes lengths and prefixes only, and the full hash is taken
    in a second read of the surviving groups alone; with it one read serves both, and the hash still decides
    only among survivors. Extra columns of ``docs`` are not used. An empty table gives an empty result.

    Groups are found by pre-aggregated counts; only ids, lengths and hashes are shuffled, and joins back to
    the rows let adaptive execution split a hot group.
    """
    read = _facts(docs)
    first = materialise(
        (read if digest else read.withColumn("sha", F.lit(None).cast("string")))
        .withColumn("uid", F.monotonically_increasing_id())
    )
    alike = _shared(_shared(first, ["n_norm"]), ["n_norm", "prefix_hash"])
    if not digest:
        level3 = read.alias("d").join(
            alike.select(F.col("doc_id").alias("_i"), F.col("n_norm").alias("_n"), F.col("prefix_hash").alias("_p")).distinct(),
            F.col("d.doc_id").eqNullSafe(F.col("_i")) & (F.col("n_norm") == F.col("_n")) & (F.col("prefix_hash") == F.col("_p")),
            "left_semi",
        )
        alike = level3.withColumn("uid", F.monotonically_increasing_id())
    alike = materialise(alike)
    singles = spread_join(
        first, alike.select("n_norm", "prefix_hash").distinct(), ["n_norm", "prefix_hash"], "left_anti"
    )
    groups = alike.groupBy("sha").agg(
        F.count("*").alias("group_size"),
        F.min("n_norm").alias("n_norm"),
        F.max("n_chars").alias("most"),
    )
    longest = spread_join(alike, groups, ["sha", "n_norm"]).where("n_chars = most")
    keepers = longest.groupBy("sha", "n_norm").agg(
        F.min("doc_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
        F.expr("min(named_struct('later', doc_id IS NULL, 'id', doc_id, 'uid', uid)).uid").alias("keep_uid"),
    )
    grouped = spread_join(alike, keepers, ["sha", "n_norm"])
    columns = ["doc_id", "n_chars", "n_norm", "prefix_hash", "sha"]
    return grouped.select(*columns, "keep_id", "group_size", F.expr("uid = keep_uid").alias("kept")).unionByName(
        singles.select(*columns, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with their columns; extra columns are kept.

    Full content is read again only where a row's length and prefix survive the first two levels. Rows that
    repeat both doc_id and text become one (any of them).
    """
    kept = materialise(exact_groups(docs).where("kept").selectExpr(
        "doc_id AS _llm_i", "n_chars AS _llm_c", "n_norm AS _llm_n", "prefix_hash AS _llm_p", "sha AS _llm_s"))
    norm = without_white(text_or_empty())
    found = docs.join(
        kept,
        F.col("doc_id").eqNullSafe(F.col("_llm_i"))
        & (F.length(text_or_empty()).cast("long") == F.col("_llm_c"))
        & (F.length(norm).cast("long") == F.col("_llm_n"))
        & (F.xxhash64(F.substring(norm, 1, PREFIX)) == F.col("_llm_p"))
        # not an equality, so that the hash is taken only of rows whose other keys meet
        & (F.col("_llm_s").isNull() | F.sha2(norm, 256).startswith(F.col("_llm_s"))),
    )
    repeats = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeats:
        found = found.dropDuplicates(["_llm_i", "_llm_c", "_llm_n", "_llm_p", "_llm_s"])
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
