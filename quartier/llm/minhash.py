"""Document fingerprints by Order MinHash."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quartier.llm.common import text_or_empty

#: Code points of a k-mer, sketches of a fingerprint (a power of two), k-mers of a sketch.
KMER, SKETCHES, TUPLE = 8, 128, 2

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def order_minhash(text: str) -> np.ndarray:
    """SKETCHES values of 16 bits; 0 marks a sketch without k-mers.

    Each k-mer is numbered among its equals and hashed with its number; the hash deals it to a sketch and ranks
    it there. A sketch takes its TUPLE least, puts them in text order and hashes the tuple. A text shorter than a
    k-mer is one k-mer; an empty text has none. A numbered k-mer has one hash in texts of any length. Memory is a few words per code point of one text.
    """
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    result = np.zeros(SKETCHES, dtype=np.uint16)
    if not len(points):
        return result
    if len(points) < KMER:
        value = len(points)
        for x in points.tolist():
            value = (value * int(_A) + x) % (1 << 64)
        kmers = np.array([value], dtype=np.uint64)
    else:
        kmers, width = points, 1
        while width < KMER:  # hashes of twice the width from two neighbours
            factor = np.uint64(pow(int(_A), width, 1 << 64))
            kmers = kmers[:-width] * factor + kmers[width:]
            width *= 2
    kmers = _mixed(kmers)
    n = len(kmers)
    # equal k-mers side by side in text order, to number them: nothing here may depend on the text's length
    at = np.argsort(kmers)
    ordered = kmers[at]
    starts = np.ones(n, dtype=bool)
    starts[1:] = ordered[1:] != ordered[:-1]
    if not starts.all():
        at = np.sort((np.cumsum(starts) << 32) | at) & 0xFFFFFFFF
    rank = np.arange(n)
    number = rank - np.maximum.accumulate(np.where(starts, rank, 0))
    hashes = np.empty(n, dtype=np.uint64)
    hashes[at] = _mixed(ordered + _A * (number + 1).astype(np.uint64))
    # sketch by sketch (the top bits), least hash first; of equal hashes the first in the text
    shift = np.uint64(64 - SKETCHES.bit_length() + 1)
    least = np.sort(hashes)
    begin = np.searchsorted((least >> shift).astype(np.int64), np.arange(SKETCHES))
    end = np.append(begin[1:], n)
    filled = begin < end
    last = np.zeros(SKETCHES, dtype=np.uint64)
    last[filled] = least[np.minimum(begin + TUPLE, end)[filled] - 1]
    few = np.flatnonzero(hashes <= last[(hashes >> shift).astype(np.int64)])
    few = few[np.argsort(hashes[few], kind="stable")]
    begin = np.searchsorted((hashes[few] >> shift).astype(np.int64), np.arange(SKETCHES))
    end = np.append(begin[1:], len(few))
    value = np.zeros(SKETCHES, dtype=np.uint64)
    chosen = np.full((SKETCHES, TUPLE), n, dtype=np.int64)
    for i in range(TUPLE):
        has = begin + i < end
        chosen[has, i] = few[begin[has] + i]
    chosen.sort(axis=1)
    for i in range(TUPLE):
        has = chosen[:, i] < n
        value[has] = _mixed(value[has] * _A + kmers[chosen[has, i]])
    result[filled] = (value[filled] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    return result


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal sketches among those that either text fills; 1 for two empty texts."""
    filled = (a != 0) | (b != 0)
    return float((a == b)[filled].mean()) if filled.any() else 1.0


def as_text(sketches: np.ndarray) -> str:
    return sketches.astype(">u2").tobytes().hex()


@F.pandas_udf(StringType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprint of each whole text; null counts as empty."""
    for batch in texts:
        yield pd.Series([as_text(order_minhash(t or "")) for t in batch])


def _bucket(bounds: list[int]) -> Column:
    """Number of bounds below doc_id, by binary search."""
    steps = 1 << max(len(bounds), 1).bit_length() >> 1
    padded = F.array(*[F.lit(b).cast("long") for b in bounds + [2**63 - 1] * (2 * steps - 1 - len(bounds))])
    halves = F.array(*[F.lit(1 << i) for i in range(steps.bit_length() - 1, -1, -1)])
    return F.aggregate(halves, F.lit(0), lambda lo, s: F.when(F.get(padded, lo + s - 1) < F.col("_id"), lo + s).otherwise(lo))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, one row per row of ``docs``:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, by ascending doc_id (null first, rows of one doc_id by the hash of their text); the last is followed
    by the first. A null text is empty. Extra columns are not used; an empty table gives an empty result.

    Rows are dealt once into ranges of doc_id, with as many bounds as shuffle partitions (quantiles, the
    only thing the driver gets besides each range's least id); the first row of each range also goes to the range
    before, so every row meets its follower in one task.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"),
        text_or_empty().alias("text"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("_id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts).alias("b")).first()["b"]
    bounds = sorted(set(cuts or []))
    rows = rows.withColumn("_range", _bucket(bounds))
    firsts = dict(rows.groupBy("_range").agg(F.min("_id")).collect())
    full = sorted(firsts)
    before = {r: full[i - 1] for i, r in enumerate(full)}
    size = len(bounds) + 1
    first_of = F.array(*[F.lit(firsts.get(r)).cast("long") for r in range(size)])
    range_before = F.array(*[F.lit(before.get(r)).cast("int") for r in range(size)])
    own = F.struct(F.col("_range").cast("int").alias("r"), F.lit(False).alias("follows"))
    ahead = F.struct(F.get(range_before, F.col("_range")).alias("r"), F.lit(True).alias("follows"))
    dealt = rows.withColumn(
        "_to", F.explode(F.when(F.col("_id") == F.get(first_of, F.col("_range")), F.array(own, ahead)).otherwise(F.array(own)))
    ).select("_to.r", "_to.follows", "_id", "doc_id", "text")
    ordered = dealt.repartitionById(size, "r").sortWithinPartitions("r", "follows", "_id", F.xxhash64("text"), "text")
    return ordered.select("r", "follows", "doc_id", "text").mapInPandas(
        _compare,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one range in order, then its followers: each row meets the next one."""
    held = None
    for batch in batches:
        out = []
        for r, follows, doc_id, text in zip(batch["r"], batch["follows"], batch["doc_id"], batch["text"], strict=True):
            if held is not None and held[0] == r:
                own = order_minhash(text)
                out.append(_row(*held[1:], text, own))
            elif follows:
                continue  # only the first of the followers is needed
            else:
                own = order_minhash(text)
            held = None if follows else (r, doc_id, text, own)
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"doc_id": "Int64"})


def _row(doc_id, text: str, own: np.ndarray, following: str, nxt: np.ndarray) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    sketches = order_minhash(edited)
    return (
        doc_id, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), as_text(own), as_text(sketches),
        likeness(own, sketches), likeness(own, nxt),
    )
