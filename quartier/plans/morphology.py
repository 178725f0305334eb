"""Building measures inside settlement areas and their comparison between cities."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.functions import geometry as g
from quartier.operators.raster import dissolve_cells
from quartier.operators.spatial import FINER, met_groups
from quartier.operators.stats import box_statistics, drop_outliers, map_names, melt, scale_columns
from quartier.operators.tessellation import (
    adjacency, cell_areas, contiguity, nearest_owner, neighbour_distance, touching_groups, within_steps,
)
from quartier.session import materialise

MEASURES = ["tessellation_car", "buildings_wall", "buildings_adjacency", "buildings_neighbour_distance"]
# Display names of the measures.
MEASURE_NAMES = {
    "tessellation_car": "Tesselation CAR",
    "buildings_wall": "Buildings Perimeter Length",
    "buildings_adjacency": "Buildings Adjecency",
    "buildings_neighbour_distance": "Distance to Nearest Building",
}


def buildings_in_areas(buildings: DataFrame, areas: DataFrame, city: str, cell: float) -> DataFrame:
    """Valid buildings touching any area of a city, once per city: (city, bid, geom, bbox)."""
    # valid areas only; no pairs are made, as a building may meet many areas
    met = met_groups(buildings, areas.where(g.is_valid("geom")), cell / FINER, ["id"], [city])
    return met.where(f"{g.is_box('geom', 'bbox')} OR {g.is_valid('geom')}").selectExpr(city, "id AS bid", "geom", "bbox")


def tessellate(areas: DataFrame, built: DataFrame, city: str, resolution: float) -> DataFrame:
    """Owner of every area pixel: (city, cx, cy, owner, dist)."""
    cells = dissolve_cells(areas, resolution, [city]).selectExpr(
        "*", f"(cx + 0.5D) * {resolution} AS px", f"(cy + 0.5D) * {resolution} AS py"
    )
    return nearest_owner(cells, built, [city], resolution)


def morphometrics(
    buildings: DataFrame, areas: DataFrame, city: str, resolution: float = 2.0, cell: float = 500.0, steps: int = 3,
) -> DataFrame:
    """Per building inside the areas: covered area ratio, perimeter, adjacency and neighbour distance.

    Buildings that own no pixel (smaller than the grid) have no cell and no neighbours: NULL there.
    """
    keys = [city]
    built = materialise(buildings_in_areas(buildings, areas, city, cell))
    owned = materialise(tessellate(areas, built, city, resolution))
    edges = materialise(contiguity(owned, keys))
    near = within_steps(edges, keys, steps)
    owners = built.selectExpr(city, "bid AS owner")
    groups = touching_groups(built, keys, cell)
    return (
        built.selectExpr(city, "bid AS owner", f"{g.area('geom')} AS _area", f"{g.perimeter('geom')} AS buildings_wall")
        .join(cell_areas(owned, keys, resolution), [city, "owner"], "left")
        .join(adjacency(near, groups, owners, keys), [city, "owner"], "left")
        .join(neighbour_distance(edges, built, keys), [city, "owner"], "left")
        .selectExpr(
            city, "owner AS uid", "_area / cell_area AS tessellation_car", "buildings_wall",
            "adjacency AS buildings_adjacency", "neighbour_distance AS buildings_neighbour_distance",
        )
    )


def comparable(metrics: DataFrame, cities: Sequence[str], names: dict[str, str]) -> DataFrame:
    """Selected cities under display names, without outliers, scaled and in long form."""
    kept = metrics.where(metrics.city.isin(list(cities))).select("city", *MEASURES)
    named = map_names(kept, "city", names)
    inliers = drop_outliers(named, ["city"], MEASURES)
    long = melt(scale_columns(inliers, MEASURES), ["city"], MEASURES)
    return map_names(long, "variable", MEASURE_NAMES)


def compare_morphometrics(metrics: DataFrame, cities: Sequence[str], names: dict[str, str]) -> DataFrame:
    """Box statistics per measure and city with whiskers at 10 and 90 per cent."""
    return box_statistics(comparable(metrics, cities, names), ["variable", "city"], "value")
