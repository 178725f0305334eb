"""SimHash near-duplicates with BK-trees."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quartier.llm.common import connected, spread_join, text_or_empty
from quartier.session import materialise

#: Fingerprints in one shard, and in a tree's leaf.
SHARD, LEAF = 16_384, 256
SHINGLE = 3


def fingerprint(text: str) -> int:
    """64 bits: a bit is 1 if set in over half of the shingles' hashes. Whole text, repeats included."""
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z are lower-cased, only ASCII white space splits
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    digest, total, bits = xxhash.xxh64_intdigest, 0, np.zeros(64, dtype=np.int64)
    hashes = np.fromiter((digest(s, 42) for s in shingles), dtype=np.uint64)
    for i in range(0, len(hashes), 65_536):
        block = hashes[i : i + 65_536]
        total += len(block)
        bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > total, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], dtype=np.uint64).view(np.int64))


class Tree:
    """BK-tree over distinct fingerprints: children are keyed by their distance to the parent; small ones are leaves."""

    def __init__(self, prints: np.ndarray, at: np.ndarray | None = None):
        self.at = np.arange(len(prints)) if at is None else at
        self.prints, self.pivot, self.children = prints, None, {}
        if len(prints) > LEAF:
            self.pivot = prints[0]
            far = np.bitwise_count(prints[1:] ^ self.pivot)
            for d in np.unique(far):
                own = np.flatnonzero(far == d) + 1
                self.children[int(d)] = Tree(prints[own], self.at[own])

    def near(self, queries: np.ndarray, at: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, members, whether they link) of every block of queries that the edges within the radius lead to."""
        if self.pivot is None:
            for i in range(0, len(queries), 4096):
                yield at[i : i + 4096], self.at, np.bitwise_count(queries[i : i + 4096, None] ^ self.prints[None, :]) <= radius
            return
        far = np.bitwise_count(queries ^ self.pivot).astype(np.int16)
        yield at, self.at[:1], (far <= radius)[:, None]
        for d, child in self.children.items():
            led = np.abs(far - d) <= radius
            if led.any():
                yield from child.near(queries[led], at[led], radius)


def shard_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (print, smallest print it reaches) among distinct prints; as many rows as prints at most."""
    prints = np.sort(prints)
    root = np.arange(len(prints))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for q, m, links in Tree(prints).near(prints, np.arange(len(prints)), radius):
        new = links & (root[q][:, None] != root[m][None, :])
        for i, j in zip(*np.nonzero(new), strict=True):
            a, b = find(q[i]), find(m[j])
            if a != b:
                root[max(a, b)] = min(a, b)
        while new.any() and (root[root] != root).any():
            root = root[root]
    linked = np.flatnonzero(root != np.arange(len(prints)))
    return prints[linked], prints[root[linked]]


def _links_of_shards(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by shard; a shard may span batches."""
        held: list[np.ndarray] = []
        last = None

        def flush():
            prints = np.unique(np.concatenate(held))
            return shard_links(prints, radius) if len(prints) > 1 else (prints[:0], prints[:0])

        for batch in batches:
            keys, prints = batch["shard"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
            if not len(keys):
                continue
            ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            found = []
            for i, j in zip([0, *ends], [*ends, len(keys)], strict=True):
                if keys[i] != last:
                    if held and (len(held) > 1 or len(held[0]) > 1):
                        found.append(flush())
                    held, last = [], keys[i]
                held.append(prints[i:j])
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
        if held:
            a, b = flush()
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def near_links(prints: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` of ``prints`` that join all those within ``radius`` bits.

    Two fingerprints within the radius agree in one of radius + 1 blocks of their bits, so each goes to one shard
    per block, named by place and value. Shards above ``shard`` rows are told apart by blocks of their other bits,
    twice; what is still above is cut into pieces by hash, and every pair of pieces meets in a shard of its own.
    A shard's tree stays where its rows were shuffled to, so no tree passes through the driver.
    """
    parts = radius + 1
    rows = prints.select("fp", F.col("fp").alias("rest"), F.lit("").alias("path"))
    width_left, ready = 64, None
    for level in range(3):
        width = width_left // parts
        cut = [
            F.struct(
                F.concat("path", F.lit(f"{b}."), F.hex(F.expr(f"shiftrightunsigned(rest, {b * width}) & {(1 << width) - 1}L")), F.lit("/")).alias("path"),
                F.expr(
                    f"(shiftleft(shiftrightunsigned(shiftrightunsigned(rest, {(b + 1) * width - 1}), 1), {b * width})) | (rest & {(1 << (b * width)) - 1}L)"
                ).alias("rest"),
            )
            for b in range(parts)
        ]
        rows = rows.select("fp", F.explode(F.array(*cut)).alias("c")).select("fp", "c.path", "c.rest")
        large = materialise(rows.groupBy("path").count().where(F.col("count") > shard))
        if not large.limit(1).count():
            ready = rows.select("path", "fp") if ready is None else ready.unionByName(rows.select("path", "fp"))
            rows = None
            break
        small = spread_join(rows, large.select("path"), ["path"], "left_anti").select("path", "fp")
        ready = small if ready is None else ready.unionByName(small)
        rows = materialise(spread_join(rows, large.select("path"), ["path"], "left_semi"))
        width_left -= width
    if rows is not None:
        pieces = F.ceil(F.col("count") / (shard // 2)).cast("int")
        met = spread_join(rows, large, ["path"]).withColumn("n", pieces).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        met = met.withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
        ready = ready.unionByName(
            met.select(F.concat("path", F.least("own", "other").cast("string"), F.lit("-"), F.greatest("own", "other").cast("string")).alias("path"), "fp")
        )
    ready = ready.withColumnRenamed("path", "shard").repartition("shard").sortWithinPartitions("shard")
    return ready.mapInPandas(_links_of_shards(radius), "a long, b long").distinct()


def near_components(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs``: the smallest doc_id reachable over links of ``radius`` bits.

    Null and empty texts have fingerprint zero and link like any other. Ties and repeated rows share their
    fingerprint and component. A null doc_id is smallest only where all are null. Only distinct fingerprints
    are searched; extra columns are not used; an empty table gives an empty result.
    """
    own = materialise(docs.select("doc_id", fingerprints(text_or_empty()).alias("fp")))
    distinct = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    member = materialise(connected(near_links(distinct, radius), "a", "b"))
    linked = spread_join(distinct, member.withColumnRenamed("node", "fp"), ["fp"])
    least = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = spread_join(linked, least, ["component"]).select("fp", "component_id")
    single = spread_join(distinct, member.select(F.col("node").alias("fp")), ["fp"], "left_anti")
    table = named.unionByName(single.select("fp", F.col("least_id").alias("component_id")))
    return spread_join(own, materialise(table), ["fp"]).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component. Rows that share a doc_id count as one document."""
    stay = near_components(docs, radius).where("doc_id <=> component_id").select(F.col("doc_id").alias("_llm_id")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_llm_id")), "left_semi")
