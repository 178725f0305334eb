"""City bounding boxes."""
from __future__ import annotations

from pyspark.sql import DataFrame

from quartier.functions import geometry as g
from quartier.functions import projection as proj
from quartier.functions.scalars import file_safe
from quartier.plans.preparation import label_bounds


def city_boxes(labels: DataFrame, city: str, buffer: float = 1000.0, zone: int = 16) -> DataFrame:
    """Envelope of each city's areas (longitude/latitude), grown by metres in UTM: (city, file_name, bbox).

    The grown shape is only used through its bounds, so the corners are projected, expanded and
    projected back; no buffer polygon is built.
    """
    corners = ("xmin", "ymin", "xmax", "ymax")
    metric = proj.to_utm(g.rectangle(*corners), zone)
    boxes = label_bounds(labels, city).selectExpr(city, f"{g.let(metric, g.bounds)} AS _m")
    grown = g.let(g.expand("_m", f"{buffer}D"), g.envelope)
    back = boxes.selectExpr(city, f"{g.let(grown, lambda e: proj.utm_to_lonlat(e, zone))} AS _g")
    return back.selectExpr(city, f"{file_safe(city)} AS file_name", f"{g.bounds('_g')} AS bbox")


def part_boxes(features: DataFrame, index: str = "id") -> DataFrame:
    """Bounds of every polygon; parts of a multipolygon are numbered ``index_part``."""
    tagged = features.selectExpr("*", "geom.type AS _kind")
    parts = g.explode_parts(tagged)
    name = f"CASE WHEN _kind = 'MultiPolygon' THEN concat_ws('_', {index}, part) ELSE CAST({index} AS STRING) END"
    return parts.selectExpr(
        *[c for c in features.columns if c not in (index, "geom", "bbox")], f"{name} AS geometry_index",
        f"{g.bounds('geom')} AS bbox",
    )
