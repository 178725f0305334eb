"""City registry and small text sources."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from quartier.schemas import MORPHOMETRIC


def select_cities(registry: DataFrame, cities: str | Sequence[str] | None = None) -> DataFrame:
    """One city, a list of cities, or all."""
    if cities is None:
        return registry
    if isinstance(cities, str):
        return registry.where(registry.city == cities)
    if isinstance(cities, (list, tuple)):
        return registry.where(registry.city.isin(list(cities)))
    raise TypeError("cities must be a name, a list of names or None")


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files below a folder; only directory metadata is read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "length")
    )


def missing_files(registry: DataFrame, files: DataFrame, column: str = "labels_path") -> DataFrame:
    """Registry rows whose file is not listed."""
    return registry.join(files.selectExpr(f"path AS {column}"), column, "left_anti")


def read_morphometrics(spark: SparkSession, path: str, schema: str = MORPHOMETRIC) -> DataFrame:
    """Metric files with a declared schema; NaN text becomes NULL."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "NaN").csv(path)
