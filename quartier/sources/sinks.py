"""Distributed writers."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from quartier.functions import geometry as g
from quartier.functions.scalars import class_file
from quartier.sources.wkb import encode_wkb


def feature_lines(df: DataFrame, keep: Sequence[str] = (), geom: str = "geom") -> DataFrame:
    """One GeoJSON feature per row, in column ``value``; all other columns become properties.

    ``keep`` columns stay beside the text, for partitioned writing.
    """
    names = [c for c in df.columns if c not in (geom, "bbox")]
    fields = ", ".join(f"'{c}', {c}" for c in names)
    text = (
        f"""concat('{{"type":"Feature","properties":', to_json(named_struct({fields})), ',"geometry":', """
        f"""{g.to_geojson(geom)}, '}}')"""
    )
    return df.selectExpr(*keep, f"{text} AS value")


def write_geojson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Newline-delimited GeoJSON; nothing passes through the driver."""
    feature_lines(df).write.mode(mode).text(path)


def write_geoparquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet with WKB geometry and the bounding box struct scans prune with."""
    encode_wkb(df).write.mode(mode).parquet(path)


def write_clustered(df: DataFrame, path: str, cell: float, partitions: int | None = None) -> None:
    """Features sorted by grid cell, so row-group statistics on ``bbox`` prune box queries.

    Range partitioning samples the keys and spreads a crowded cell's neighbours over several files.
    """
    keyed = df.selectExpr(
        "*", f"CAST(floor(bbox.xmin / {cell}) AS BIGINT) AS _cx", f"CAST(floor(bbox.ymin / {cell}) AS BIGINT) AS _cy"
    )
    keys = ["_cx", "_cy", "bbox.xmin", "bbox.ymin"]
    ranged = keyed.repartitionByRange(partitions, *keys) if partitions else keyed.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).drop("_cx", "_cy").write.parquet(path)


def write_csv(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """CSV with header, one folder per value of ``by`` or a single table."""
    writer = df.write.mode(mode).option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_prediction_store(
    regions: DataFrame, pixels: DataFrame, path: str, class_id: int, class_name: str, mode: str = "errorifexists"
) -> None:
    """Per country and city: class polygons as GeoJSON lines and the discrete pixels as Parquet."""
    keys = ["country", "city"]
    named = regions.selectExpr("*", f"{class_file(str(class_id), repr(class_name))} AS class_file")
    lines = feature_lines(named, [*keys, "class_file"])
    lines.write.mode(mode).partitionBy(*keys, "class_file").text(f"{path}/vector_output")
    pixels.write.mode(mode).partitionBy(*keys).parquet(f"{path}/labels")


def write_composite(composite: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Composite pixels partitioned by country and city, sorted so row ranges prune."""
    composite.repartitionByRange("country", "city", "prow", "pcol").sortWithinPartitions(
        "country", "city", "prow", "pcol"
    ).write.mode(mode).partitionBy("country", "city").parquet(path)
