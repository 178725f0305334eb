"""Share of the population living in settlement areas."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.functions import geometry as g
from quartier.functions.scalars import guarded_ratio
from quartier.operators.raster import dissolve_cells, median_raster
from quartier.operators.spatial import spatial_join
from quartier.operators.zonal import zonal_sum


def settlement_population(settlements: DataFrame, pop: DataFrame, block: float = 1000.0) -> DataFrame:
    """Each settlement polygon with its ``estimated_population``; other geometry kinds are skipped."""
    areal = settlements.where(g.is_areal("geom"))
    sums = zonal_sum(pop, areal, ["sid"], block=block).withColumnRenamed("total", "estimated_population")
    return areal.join(sums, "sid")


def population_share(
    cities: DataFrame, settlements: DataFrame, pop: DataFrame, dataset: str = "HRSL",
    cell: float = 2000.0, block: float = 1000.0,
) -> DataFrame:
    """Per city: total population, population of the settlements touching it, and their ratio.

    A settlement touching two cities of its country counts, whole, in both. Cities and settlements go
    through one zonal sum, so the population grid is read once.
    """
    cities = cities.where(g.is_areal("geom")).select("country", "city", "geom", "bbox")
    settlements = settlements.where(g.is_areal("geom")).select("country", "sid", "geom", "bbox")
    zones = cities.selectExpr("'city' AS kind", "country", "city AS zone", "geom", "bbox").unionByName(
        settlements.selectExpr("'settlement' AS kind", "country", "CAST(sid AS STRING) AS zone", "geom", "bbox")
    )
    sums = zonal_sum(pop, zones, ["kind", "country", "zone"], block=block)
    pairs = spatial_join(settlements, cities, cell, equal=["country"]).selectExpr(
        "'settlement' AS kind", "country", "CAST(l_sid AS STRING) AS zone", "r_city AS city"
    )
    # a settlement row repeats per city it touches; a city row stands for itself
    return (
        sums.join(pairs, ["kind", "country", "zone"], "left")
        .where("kind = 'city' OR city IS NOT NULL")
        .groupBy("country", F.expr("coalesce(city, zone) AS city"))
        .agg(
            F.expr("sum(total) FILTER (WHERE kind = 'city') AS total_population"),
            F.expr("coalesce(sum(total) FILTER (WHERE kind = 'settlement'), 0D) AS informal_population"),
        )
        .selectExpr(
            "*",
            f"{guarded_ratio('informal_population', 'total_population')} AS proportion_informal",
            f"'{dataset}' AS dataset_used",
        )
    )


def label_population_share(
    labels: DataFrame, pop: DataFrame, city: str, resolution: float, dataset: str = "HRSL", block: float = 1000.0
) -> DataFrame:
    """Per label set ``city``: population of its bounding box against that of its merged areas.

    Areas are merged as the set of grid cells with their centre in any area, so overlaps count once.
    ``country`` repeats the city and ``formal_population`` the total, as in the published table.
    """
    boxes = labels.groupBy(city).agg(
        F.expr("min(bbox.xmin) AS xmin"), F.expr("min(bbox.ymin) AS ymin"),
        F.expr("max(bbox.xmax) AS xmax"), F.expr("max(bbox.ymax) AS ymax"),
    )
    corners = ("xmin", "ymin", "xmax", "ymax")
    zones = boxes.selectExpr(city, f"{g.rectangle(*corners)} AS geom", f"{g.box(*corners)} AS bbox")
    totals = zonal_sum(pop, zones, [city], block=block).withColumnRenamed("total", "total_population")
    keyed = pop.selectExpr(
        f"CAST(floor(px / {resolution}) AS BIGINT) AS cx", f"CAST(floor(py / {resolution}) AS BIGINT) AS cy", "b1"
    )
    informal = (
        dissolve_cells(labels, resolution, [city])
        .join(keyed, ["cx", "cy"])
        .groupBy(city)
        .agg(F.expr("sum(b1) AS informal"))
    )
    return totals.join(informal, city, "left").selectExpr(
        f"{city} AS city",
        f"CAST({city} AS STRING) AS country",
        "total_population",
        "total_population AS formal_population",
        "coalesce(informal, 0D) AS informal_population",
        f"{guarded_ratio('coalesce(informal, 0D)', 'total_population')} AS proportion_informal",
        f"'{dataset}' AS dataset_used",
    )


def median_population_share(
    cities: DataFrame, settlements: DataFrame, images: DataFrame, cell: float = 2000.0, block: float = 1000.0
) -> DataFrame:
    """Variant on a collection of grids: the per-pixel median stands for the population."""
    pop = median_raster(images, ["px", "py"], "b1")
    return population_share(cities, settlements, pop, "median", cell, block)


def ranked_cities(shares: DataFrame) -> DataFrame:
    """Cities with any informal population, highest proportion first."""
    return shares.where("informal_population > 0").orderBy(F.desc("proportion_informal"), "city")


def top_cities(shares: DataFrame, n: int) -> DataFrame:
    """First ``n`` cities of the ranking."""
    return ranked_cities(shares).limit(n)


def bottom_cities(shares: DataFrame, n: int) -> DataFrame:
    """Last ``n`` cities of the ranking."""
    return shares.where("informal_population > 0").orderBy("proportion_informal", F.desc("city")).limit(n)


def report_rows(shares: DataFrame) -> DataFrame:
    """Columns shown in the published chart: readable city name, formal share, labels."""
    from quartier.functions.scalars import millions_label, percent_label, spaced_name

    return shares.selectExpr(
        "*",
        "total_population - informal_population AS formal_population",
        f"{spaced_name('city')} AS clean_city",
        f"{percent_label('proportion_informal')} AS share_label",
        f"{millions_label('total_population')} AS total_label",
    )
