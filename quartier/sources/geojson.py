"""GeoJSON of any layout, split between tasks.

Files are read by Spark's text source with ``}`` as line separator, so a file of any size and layout (pretty-printed, one
line, one feature a line) is cut by bytes, and each record ends where an object may end. Whether it does depends on what
came before: whether the record begins inside a string, and how deep. Each split tells what it does to either state; their
running sums give each split's own start, and then every split finds its features. Paths are opened by Spark only.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartier.operators.skew import lookup_join
from quartier.schemas import FEATURE
from quartier.session import materialise

#: Kinds of text that a split gives: a whole object, the end of one, its beginning, its middle.
WHOLE, END, BEGIN, MIDDLE = range(4)
_ESCAPE = re.compile(r"\\.", re.S)
_FEATURES = re.compile(r'"features"\s*:\s*\[')


def opened(record: str, inside: int) -> tuple[int, int]:
    """Braces that a record opens outside strings, and whether it ends inside a string, if it begins ``inside`` one."""
    text = _ESCAPE.sub("", record) if "\\" in record else record
    parts = text.split('"')
    return sum(p.count("{") for p in parts[inside::2]), (len(parts) - 1 + inside) % 2


def braces(record: str, inside: int) -> Iterator[int]:
    """Positions of the braces that a record opens outside strings."""
    at = 0
    for i, part in enumerate(_ESCAPE.sub("\0\0", record).split('"')):
        if i % 2 == inside:
            yield from (at + m.start() for m in re.finditer("{", part))
        at += len(part) + 1


def _by_split(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, list[str]]]:
    """(file, block, records) in order; a split may come in several pieces."""
    for batch in batches:
        for (file, block), own in batch.groupby(["file", "block"], sort=False):
            yield file, block, own["value"].tolist()


class _Effect:
    """What a split does if it begins outside a string (0) or inside one (1): where it ends, how much deeper, and the least
    depth, from its start, at which an array of features begins."""

    def __init__(self):
        self.inside, self.deeper, self.least = [0, 1], [0, 0], [None, None]

    def take(self, record: str) -> None:
        keys = list(_FEATURES.finditer(record)) if '"features"' in record else ()
        for i in (0, 1):
            for m in keys:
                n, within = opened(record[: m.start()], self.inside[i])
                if not within and (self.least[i] is None or self.deeper[i] + n < self.least[i]):
                    self.least[i] = self.deeper[i] + n
            n, self.inside[i] = opened(record, self.inside[i])
            self.deeper[i] += n - (not self.inside[i])


def _effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The effect of each split; whether it turns inside and outside round is where it ends from outside."""
    at, own, out = None, None, []
    for file, block, records in _by_split(batches):
        if at != (file, block):
            if own:
                out.append((*at, own.inside[0], *own.deeper, *own.least))
            at, own = (file, block), _Effect()
        for record in records:
            own.take(record)
    if own:
        out.append((*at, own.inside[0], *own.deeper, *own.least))
    columns = ["file", "block", "turns", "deeper_0", "deeper_1", "least_0", "least_1"]
    yield pd.DataFrame(out, columns=columns).astype({"least_0": "Int64", "least_1": "Int64"})


def _objects(starts):
    """Objects of each split, given where each split starts: {(file, block): (inside, depth, level)}."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, kind, out = None, [], WHOLE, []
        inside = depth = level = 0

        def close(last: int) -> None:
            if held:
                out.append((*at, last, "".join(held)))
                held.clear()

        for file, block, records in _by_split(batches):
            if at != (file, block):
                close(BEGIN if kind == WHOLE else MIDDLE)
                at = (file, block)
                inside, depth, level = starts.value[at]
                kind = END if depth >= level else WHOLE
            for record in records:
                if depth < level:  # between objects: cut what stands before the next one
                    now = depth
                    begin = next((i for i in braces(record, inside) if (now := now + 1) == level), None)
                    n, inside = opened(record, inside)
                    depth += n - (not inside)
                    if begin is not None:
                        held.append(record[begin:] + "}")
                else:
                    held.append(record + "}")
                    n, inside = opened(record, inside)
                    depth += n - (not inside)
                if held and depth < level:
                    close(kind)
                    kind = WHOLE
            if out:
                yield pd.DataFrame(out, columns=["file", "block", "kind", "value"])
                out.clear()
        close(BEGIN if kind == WHOLE else MIDDLE)
        if out:
            yield pd.DataFrame(out, columns=["file", "block", "kind", "value"])

    return run


def read_features(spark: SparkSession, paths: str | list[str], recursive: bool = False, files: str = "true") -> DataFrame:
    """(path, f) of every feature of the files: f has its properties and its geometry's type and coordinate text.

    A file holds collections, one or several, or plain features, in any layout and with any line breaks; it is split
    as any text file. ``files`` is a condition on ``path``. Members of a collection that are no features are left out; empty files and
    missing folders give no rows. A split's start (a few numbers for each) is broadcast; a feature across splits is
    put together from their pieces.
    """
    try:
        text = spark.read.option("lineSep", "}").option("recursiveFileLookup", recursive).option("ignoreMissingFiles", True).text(paths)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND" or not recursive:
            raise
        return spark.range(0).selectExpr("CAST(NULL AS STRING) AS path", f"from_json(CAST(NULL AS STRING), '{FEATURE}') AS f")
    named = text.selectExpr("value", "_metadata.file_path AS path", "_metadata.file_block_start AS block").where(files)
    records = named.selectExpr("xxhash64(path) AS file", "block", "value")
    effects = materialise(records.mapInPandas(_effects, "file long, block long, turns int, deeper_0 long, deeper_1 long, least_0 long, least_1 long"))
    before = "OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    begins = effects.selectExpr("*", f"CAST(coalesce(sum(turns) {before}, 0) % 2 AS INT) AS inside").selectExpr(
        "file", "block", "inside", f"coalesce(sum(IF(inside = 0, deeper_0, deeper_1)) {before}, 0) AS depth", "IF(inside = 0, least_0, least_1) AS least",
    # the outermost object of a collection holds the array, so features are one deeper
    ).selectExpr("file", "block", "inside", "depth", "IF(min(depth + least) OVER (PARTITION BY file) = 1, 2, 1) AS level").collect()
    starts = spark.sparkContext.broadcast({(r["file"], r["block"]): (r["inside"], r["depth"], r["level"]) for r in begins})
    objects = records.mapInPandas(_objects(starts), "file long, block long, kind int, value string")
    found = objects.where(f"kind = {WHOLE}").select("file", "value")
    if any(r["depth"] >= r["level"] for r in begins):
        pieces = materialise(objects.where(f"kind <> {WHOLE}"))
        parts = pieces.selectExpr("*", f"count_if(kind = {BEGIN}) OVER (PARTITION BY file ORDER BY block, kind) AS n")
        joined = parts.groupBy("file", "n").agg(F.expr("array_join(transform(array_sort(collect_list(struct(block, kind, value))), p -> p.value), '') AS value"))
        found = found.unionByName(joined.select("file", "value"))
    names = named.select("path").distinct().selectExpr("xxhash64(path) AS file", "path")
    parsed = found.where("value LIKE '%\"Feature\"%'").selectExpr("file", f"from_json(value, '{FEATURE}') AS f").where("f.type = 'Feature'")
    return lookup_join(parsed, names, ["file"]).select("path", "f")
