"""Queries that write files and read them back."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import query
from catalogue.scratch import folder
from catalogue.sql import ctes
from quartier.fixtures import fixture, vector_fixture
from quartier.functions import geometry as g
from quartier.operators import spatial
from quartier.plans import prediction
from quartier.sources import registry, sinks, vectors

BOUNDS = "SELECT sid, country, CAST(xmin AS DOUBLE) AS x0, CAST(ymin AS DOUBLE) AS y0, CAST(xmax AS DOUBLE) AS x1, CAST(ymax AS DOUBLE) AS y1 FROM f_settlements"


def bounds_of(df, *keep):
    return df.selectExpr(*keep, f"{g.bounds('geom')} AS b").selectExpr(*[k.split(" AS ")[-1] for k in keep], "b.xmin AS x0", "b.ymin AS y0", "b.xmax AS x1", "b.ymax AS y1")


@query("s5_s12_geoparquet", ctes("f_settlements") + BOUNDS)
def geoparquet(spark, sf):
    path = folder(spark, "geoparquet")
    sinks.write_geoparquet(vector_fixture(spark, sf, "f_settlements"), path)
    return bounds_of(vectors.read_geoparquet(spark, path), "sid", "country")


@query("s1_s5_geoparquet_box", ctes("f_settlements") + "SELECT sid FROM f_settlements WHERE xmin>3000 AND xmax<9000 AND ymin>3000 AND ymax<9000")
def geoparquet_box(spark, sf):
    path = folder(spark, "geoparquet")
    sinks.write_geoparquet(vector_fixture(spark, sf, "f_settlements"), path)
    box = (3000, 3000, 9000, 9000)
    return spatial.inside_box(vectors.read_geoparquet(spark, path, box=box), *box).select("sid")


@query("s4_k1_geojson", ctes("f_settlements") + BOUNDS)
def geojson(spark, sf):
    path = folder(spark, "geojson")
    sinks.write_geojson(vector_fixture(spark, sf, "f_settlements"), path)
    df = vectors.read_geojson(spark, path)
    return bounds_of(df, "CAST(properties['sid'] AS BIGINT) AS sid", "properties['country'] AS country")


def pretty(spark, df, name, by=("country",)):
    """Collections with free line breaks, of at most a few dozen features each, so none grows with the table; one folder per value of ``by``."""
    path = folder(spark, name)
    lines = sinks.feature_lines(df.selectExpr("*", "CAST(floor(sid / 40) AS BIGINT) AS piece"), ["piece", *by])
    spread = "regexp_replace(replace(value, ',\"', ',\\n      \"'), '([\\\\[{])', '$1\\n  ')"
    body = lines.selectExpr("piece", *by, f"{spread} AS value").groupBy("piece", *by).agg(F.expr("concat_ws(',\n', collect_list(value)) AS value"))
    text = "concat('{\\n  \"type\": \"FeatureCollection\",\\n  \"crs\": {\"type\": \"name\", \"properties\": {\"name\": \"a } in a string {\"}},\\n  \"features\": [\\n', value, '\\n]\\n}') AS value"
    body.selectExpr(*by, text).write.partitionBy(*by).text(path)
    return path


@query("s4_whole_file_geojson", ctes("f_settlements") + BOUNDS)
def whole_geojson(spark, sf):
    """Pretty-printed collections."""
    path = pretty(spark, vector_fixture(spark, sf, "f_settlements").withColumn("folder", F.col("country")), "collections", ("folder",))
    df = vectors.read_geojson(spark, f"{path}/*/*.txt")
    return bounds_of(df, "CAST(properties['sid'] AS BIGINT) AS sid", "properties['country'] AS country")


@query(
    "s6_pretty_feature_source",
    ctes("f_settlements") + "SELECT sid, 2 AS class_id, round(degrees(xmin/6378137.0e0),9) AS x0, round(degrees(2*atan(exp(ymax/6378137.0e0))-pi()/2),9) AS y1 FROM f_settlements",
)
def pretty_feature_source(spark, sf):
    path = pretty(spark, vector_fixture(spark, sf, "f_settlements").withColumn("folder", F.col("country")), "sources", ("folder",))
    df = vectors.features(spark, uris=[f"{path}/*/*.txt"], default_class=2, from_mercator=True)
    return df.selectExpr("CAST(properties['sid'] AS BIGINT) AS sid", "class_id", "round(bbox.xmin,9) AS x0", "round(bbox.ymax,9) AS y1")


@query("s11_pretty_predictions", ctes("f_settlements") + "SELECT country, kind AS city, count(*) AS n FROM f_settlements GROUP BY 1,2")
def pretty_predictions(spark, sf):
    areas = vector_fixture(spark, sf, "f_settlements").selectExpr("country", "kind AS city", "'vector_output' AS part", "sid", "geom")
    path = pretty(spark, areas, "tree", ("country", "city", "part"))
    return vectors.city_predictions(spark, path).groupBy("country", "city").agg(F.expr("count(1) AS n"))


@query(
    "s6_feature_source",
    ctes("f_settlements") + "SELECT sid, 2 AS class_id, round(degrees(xmin/6378137.0e0),9) AS x0, round(degrees(2*atan(exp(ymax/6378137.0e0))-pi()/2),9) AS y1 FROM f_settlements",
)
def feature_source(spark, sf):
    parts = []
    for kind in ("tri", "rect"):
        path = folder(spark, kind)
        sinks.write_geojson(vector_fixture(spark, sf, "f_settlements").where(f"kind = '{kind}'").withColumnRenamed("sid", "id"), path)
        parts.append(path)
    df = vectors.features(spark, uris=parts, default_class=2, from_mercator=True)
    return df.selectExpr("CAST(id AS BIGINT) AS sid", "class_id", "round(bbox.xmin,9) AS x0", "round(bbox.ymax,9) AS y1")


@query("s11_x5_merged_predictions", ctes("f_settlements") + "SELECT country, kind AS city, count(*) AS n, round(sum((xmax-xmin)*(ymax-ymin)*CASE WHEN kind='rect' THEN 1.0e0 ELSE 0.5e0 END),3) AS area FROM f_settlements GROUP BY 1,2")
def merged(spark, sf):
    path = folder(spark, "predictions")
    areas = vector_fixture(spark, sf, "f_settlements").selectExpr("country", "kind AS city", "sid", "geom")
    pixels = fixture(spark, sf, "f_obs").selectExpr("'x' AS country", "'y' AS city", "prow", "pcol", "CAST(b8 > 1500 AS INT) AS m")
    sinks.write_prediction_store(areas, pixels, path, 1, "slums")
    df = prediction.merge_predictions(spark, path)
    return df.groupBy("country", "city").agg(F.expr("count(1) AS n"), F.expr(f"round(sum({g.area('geom')}),3) AS area"))


@query("x5_merged_splits", ctes("f_settlements") + "SELECT country, sid%2 AS split, count(*) AS n, count(*) FILTER (WHERE sid%2=1 AND kind='tri') AS with_kind FROM f_settlements GROUP BY 1,2")
def merged_splits(spark, sf):
    df = vector_fixture(spark, sf, "f_settlements")
    parts = {0: df.where("sid % 2 = 0").drop("kind"), 1: df.where("sid % 2 = 1")}
    return prediction.merge_splits(parts).groupBy("country", F.expr("CAST(split AS BIGINT) AS split")).agg(
        F.expr("count(1) AS n"), F.expr("count_if(kind = 'tri') AS with_kind")
    )


@query(
    "s14_k2_csv",
    ctes("f_morpho") + "SELECT city, count(*) AS n, count(buildings_neighbour_distance) AS with_distance, round(sum(tessellation_car),2) AS total FROM f_morpho GROUP BY 1",
)
def csv(spark, sf):
    path = folder(spark, "csv")
    columns = ["tessellation_car", "buildings_wall", "buildings_adjacency", "buildings_neighbour_distance", "city"]
    sinks.write_csv(fixture(spark, sf, "f_morpho").select(*columns), path, ["city"])
    df = registry.read_morphometrics(spark, path)
    return df.groupBy("city").agg(
        F.expr("count(1) AS n"), F.expr("count(buildings_neighbour_distance) AS with_distance"), F.expr("round(sum(tessellation_car),2) AS total")
    )


@query("s16_missing_files", ctes("f_cities") + "SELECT city FROM f_cities WHERE xmin%8000=200")
def missing(spark, sf):
    path = folder(spark, "labels")
    cities = fixture(spark, sf, "f_cities")
    cities.where("xmin % 8000 <> 200").selectExpr("city", "'x' AS value").write.partitionBy("city").text(path)
    files = registry.listing(spark, path, "*.txt").selectExpr("regexp_extract(path, 'city=([^/]*)', 1) AS path")
    return registry.missing_files(cities.selectExpr("city", "city AS labels_path"), files).select("city")


@query(
    "k3_prediction_store",
    ctes("f_settlements", "f_obs", a="SELECT 'class-1-slums.json' AS item, country, count(*) AS n FROM f_settlements GROUP BY 2",
         b="SELECT 'labels' AS item, CASE WHEN image_id%2=0 THEN 'AFRICA' ELSE 'ASIA' END AS country, count(*) AS n FROM f_obs GROUP BY 2")
    + "SELECT * FROM a UNION ALL SELECT * FROM b",
)
def store(spark, sf):
    path = folder(spark, "store")
    areas = vector_fixture(spark, sf, "f_settlements").selectExpr("country", "kind AS city", "sid", "geom")
    pixels = fixture(spark, sf, "f_obs").selectExpr(
        "CASE WHEN image_id % 2 = 0 THEN 'AFRICA' ELSE 'ASIA' END AS country", "CAST(image_id AS STRING) AS city", "prow", "pcol", "CAST(b8 > 1500 AS INT) AS m"
    )
    sinks.write_prediction_store(areas, pixels, path, 1, "slums")
    lines = spark.read.text(f"{path}/vector_output").groupBy(F.expr("class_file AS item"), "country").agg(F.expr("count(1) AS n"))
    labels = spark.read.parquet(f"{path}/labels").groupBy(F.expr("'labels' AS item"), "country").agg(F.expr("count(1) AS n"))
    return lines.unionByName(labels)


@query("k4_composite_store", ctes("f_obs") + "SELECT prow%5 AS city, count(*) AS n, round(sum(b8),1) AS total FROM (SELECT prow, pcol, median(b8) AS b8 FROM f_obs GROUP BY 1,2) GROUP BY 1")
def composite_store(spark, sf):
    path = folder(spark, "composite")
    df = fixture(spark, sf, "f_obs").groupBy("prow", "pcol").agg(F.median("b8").alias("b8")).selectExpr(
        "'x' AS country", "prow % 5 AS city", "prow", "pcol", "b8"
    )
    sinks.write_composite(df, path)
    return spark.read.parquet(path).groupBy(F.expr("CAST(city AS BIGINT) AS city")).agg(F.expr("count(1) AS n"), F.expr("round(sum(b8),1) AS total"))


@query("f2_clustered_scan", ctes("f_buildings") + "SELECT id FROM f_buildings WHERE xmin>3000 AND xmax<6000 AND ymin>3000 AND ymax<6000")
def clustered(spark, sf):
    path = folder(spark, "clustered")
    sinks.write_clustered(vector_fixture(spark, sf, "f_buildings"), path, 1000.0)
    return spatial.inside_box(spark.read.parquet(path), 3000, 3000, 6000, 6000).select("id")
