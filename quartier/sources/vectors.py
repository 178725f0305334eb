"""Vector feature sources."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from quartier.functions import geometry as g
from quartier.functions import projection as proj
from quartier.operators.spatial import inside_box
from quartier.sources.geojson import read_features
from quartier.sources.wkb import decode_wkb

# Class ids of the three feature kinds.
BUILDING, ROAD, POI = 1, 2, 3


def _published(df: DataFrame, columns: Sequence[str], class_id: int, mercator: bool) -> DataFrame:
    geom = proj.to_mercator("geom") if mercator else "geom"
    return df.selectExpr(*columns, f"{geom} AS geom", f"{class_id} AS class_id")


def buildings_in_box(buildings: DataFrame, box: tuple, mercator: bool = True) -> DataFrame:
    """Buildings whose bounds lie strictly inside (xmin, ymin, xmax, ymax); empty when there are none."""
    return _published(inside_box(buildings, *box), ["id"], BUILDING, mercator)


def roads_in_box(segments: DataFrame, box: tuple, mercator: bool = True) -> DataFrame:
    """Road segments (other transport kinds are skipped) strictly inside a box."""
    return _published(inside_box(segments, *box).where("subtype = 'road'"), ["id", "subtype"], ROAD, mercator)


def pois_in_box(places: DataFrame, box: tuple, mercator: bool = True) -> DataFrame:
    """Places strictly inside a box with flattened name and category and rounded confidence."""
    columns = [
        "id", "names.primary AS name", "categories.main AS category", "round(confidence, 2) AS confidence"
    ]
    return _published(inside_box(places, *box), columns, POI, mercator)


def read_geoparquet(spark: SparkSession, path: str, geometry: str = "geometry", box: tuple | None = None) -> DataFrame:
    """Parquet table with a WKB column, decoded.

    ``box`` (xmin, ymin, xmax, ymax) keeps features whose bounds meet it. Where the table stores a ``bbox``, the test
    reaches the scan as four pushed filters, and only what it leaves is decoded.
    """
    table = spark.read.parquet(path)
    if box is None:
        return decode_wkb(table, geometry)
    xmin, ymin, xmax, ymax = box
    meets = f"bbox.xmin <= {xmax} AND bbox.xmax >= {xmin} AND bbox.ymin <= {ymax} AND bbox.ymax >= {ymin}"
    return decode_wkb(table.where(meets) if "bbox" in table.columns else table, geometry).where(meets)


def read_geojson(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """GeoJSON features: (path, properties map, kind, geom, bbox).

    Any layout and line breaks; a file is split between tasks whatever its layout.
    """
    return read_features(spark, paths).selectExpr(
        "path", "f.properties AS properties", "f.geometry.type AS kind",
        f"{g.from_geojson('f.geometry.type', 'f.geometry.coordinates')} AS geom",
    ).selectExpr("*", f"{g.bounds('geom')} AS bbox")


def features(
    spark: SparkSession, frame: DataFrame | None = None, uris: Sequence[str] | None = None,
    default_class: int | None = None, from_mercator: bool = False,
) -> DataFrame:
    """One feature table from a frame (which wins) or from files, in longitude/latitude."""
    if frame is None and not uris:
        raise ValueError("give a frame or at least one path")
    if frame is None:
        parts = [read_geojson(spark, u).selectExpr(
            "properties['id'] AS id", "CAST(properties['class_id'] AS INT) AS class_id", "properties", "geom"
        ) for u in uris]
        frame = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if from_mercator:
        others = [c for c in frame.columns if c not in ("geom", "bbox")]
        frame = frame.selectExpr(*others, f"{proj.to_lonlat('geom')} AS geom").selectExpr(
            "*", f"{g.bounds('geom')} AS bbox"
        )
    if default_class is not None:
        frame = infer_class(frame, default_class)
    return frame


def infer_class(df: DataFrame, default: int) -> DataFrame:
    """Fill the class id of features that have none."""
    if "class_id" not in df.columns:
        return df.selectExpr("*", f"{default} AS class_id")
    others = [c for c in df.columns if c != "class_id"]
    return df.selectExpr(*others, f"coalesce(class_id, {default}) AS class_id")


def city_predictions(spark: SparkSession, folder: str, by_country: bool = False) -> DataFrame:
    """All class files below a folder with city and country from the path.

    Reads ``country/city/vector_output/*`` trees and partitioned prediction stores. Missing folders and
    empty files give no rows. ``by_country`` reads the merged ``country/averaged_predictions.geojson`` files instead, whose
    features name their city.
    """
    plain, stored = "/([^/=]+)/([^/=]+)/vector_output/", "/country=([^/]+)/city=([^/]+)/"

    def part(i: int) -> str:
        found = f"coalesce(nullif(regexp_extract(path, '{stored}', {i}), ''), regexp_extract(path, '{plain}', {i}))"
        return f"url_decode(replace({found}, '+', '%2B'))"

    country, city = part(1), part(2)
    if by_country:
        merged = "regexp_extract(path, '/(?:country=)?([^/]+)/averaged_predictions.geojson', 1)"
        country, city = f"url_decode(replace({merged}, '+', '%2B'))", "f.properties['city']"
    wanted = f"path LIKE '{'%/averaged_predictions.geojson%' if by_country else '%vector_output%'}'"
    return read_features(spark, folder, recursive=True, files=wanted).selectExpr(
        f"{country} AS country", f"{city} AS city", "f.properties AS properties",
        f"{g.from_geojson('f.geometry.type', 'f.geometry.coordinates')} AS geom",
    )


def check_features(df: DataFrame) -> DataFrame:
    """Rows that cannot be burned into a raster, with the reason: wrong geometry kind or no class id."""
    reason = (
        f"CASE WHEN geom IS NULL THEN 'no geometry' WHEN NOT {g.is_areal('geom')} THEN 'not a polygon' "
        "WHEN class_id IS NULL THEN 'no class id' END"
    )
    return df.selectExpr("*", f"{reason} AS reason").where("reason IS NOT NULL")


def require_features(df: DataFrame) -> DataFrame:
    """Same rows; the job fails at the first row that cannot be burned."""
    test = f"{g.is_areal('geom')} AND class_id IS NOT NULL"
    return df.where(f"assert_true({test}, 'features must be polygons with a class id') IS NULL")


def valid_features(df: DataFrame) -> DataFrame:
    return df.where(f"geom IS NOT NULL AND {g.is_valid('geom')}")


def rejected_features(df: DataFrame) -> DataFrame:
    """Complement of ``valid_features``, for the quality report."""
    return df.where(f"geom IS NULL OR NOT {g.is_valid('geom')}")
