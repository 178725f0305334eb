"""Stand-in tables derived from the given star-schema tables by integer arithmetic.

Each text runs unchanged on Spark (table names become Parquet paths) and as a common table
expression of the checking SQL.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quartier.functions import geometry as g

SQL = {
    "f_buildings": """
SELECT o_orderkey AS id, (o_orderkey*7919)%20000 AS xmin, (o_orderkey*104729)%20000 AS ymin,
       (o_orderkey*7919)%20000+5+o_orderkey%11 AS xmax, (o_orderkey*104729)%20000+5+o_orderkey%7 AS ymax,
       1 AS class_id
FROM {orders}""",
    "f_roads": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey%3=0 THEN 'rail' ELSE 'road' END AS subtype,
       (o_orderkey*7919)%20000 AS xmin, (o_orderkey*104729)%20000 AS ymin,
       (o_orderkey*7919)%20000+40+o_orderkey%90 AS xmax, (o_orderkey*104729)%20000+4+o_orderkey%3 AS ymax
FROM {orders}""",
    "f_cities": """
SELECT n_name AS city, r_name AS country, 4000*(n_nationkey%5)+200 AS xmin,
       4000*CAST(floor(n_nationkey/5) AS BIGINT)+200 AS ymin,
       4000*(n_nationkey%5)+3800 AS xmax, 4000*CAST(floor(n_nationkey/5) AS BIGINT)+3800 AS ymax
FROM {nation} JOIN {region} ON n_regionkey=r_regionkey""",
    "f_settlements": """
SELECT s_suppkey AS sid, r_name AS country, CASE WHEN s_suppkey%4=0 THEN 'tri' ELSE 'rect' END AS kind,
       4000*(n_nationkey%5)+(s_suppkey*1543)%3700 AS xmin,
       4000*CAST(floor(n_nationkey/5) AS BIGINT)+(s_suppkey*2741)%3700 AS ymin,
       4000*(n_nationkey%5)+(s_suppkey*1543)%3700+200+(s_suppkey%5)*100 AS xmax,
       4000*CAST(floor(n_nationkey/5) AS BIGINT)+(s_suppkey*2741)%3700+200+(s_suppkey%3)*400 AS ymax
FROM {supplier} JOIN {nation} ON s_nationkey=n_nationkey JOIN {region} ON n_regionkey=r_regionkey""",
    "f_pop": """
SELECT (l_orderkey*13+l_linenumber*29)%200 AS prow, (l_orderkey*7+l_partkey*3)%200 AS pcol,
       50+100*((l_orderkey*7+l_partkey*3)%200) AS px, 19950-100*((l_orderkey*13+l_linenumber*29)%200) AS py,
       sum(l_quantity) AS b1
FROM {lineitem} GROUP BY 1,2,3,4""",
    "f_pop_images": """
SELECT l_linenumber AS image_order, (l_orderkey*13+l_suppkey*29)%200 AS prow, (l_orderkey*7+l_partkey*3)%200 AS pcol,
       50+100*((l_orderkey*7+l_partkey*3)%200) AS px, 19950-100*((l_orderkey*13+l_suppkey*29)%200) AS py,
       sum(l_quantity) AS b1
FROM {lineitem} GROUP BY 1,2,3,4,5""",
    "f_pois": """
SELECT event_id AS id, props AS name_json, event_type AS category,
       (2*CAST(floor(value) AS BIGINT)+1)/2000 AS confidence,
       (event_id*7919+user_id*31)%20000 AS x, (event_id*104729+user_id*17)%20000 AS y, 3 AS class_id
FROM {events}""",
    "f_images": """
SELECT DISTINCT l_linenumber AS image_id, concat('2024-01-0', CAST(l_linenumber AS VARCHAR(2))) AS day,
       3*l_linenumber AS cloud_pct, 20*l_linenumber AS azimuth FROM {lineitem}""",
    "f_obs": """
SELECT l_linenumber AS image_id, l_orderkey%64 AS prow, CAST(floor(l_orderkey/64) AS BIGINT)%64 AS pcol,
       max(CAST(l_quantity AS BIGINT))*40 AS b2, min(CAST(l_quantity AS BIGINT))*40 AS b3,
       max(l_suppkey)*7%3000 AS b4, max(l_partkey)*13%4000 AS b8,
       max(CAST(round(l_discount*1000) AS BIGINT)) AS probability, max(CAST(round(l_tax*100) AS BIGINT)) AS scl
FROM {lineitem} GROUP BY 1,2,3""",
    "f_tiles": """
SELECT vec_id AS tile_id, CAST(floor(vec_id/100) AS BIGINT) AS city_id, vec_id%100 AS tile_idx,
       4*CAST(floor((vec_id%100)/10) AS BIGINT) AS row0, 4*(vec_id%10) AS col0, embedding AS logits
FROM {embeddings}""",
    "f_morpho": """
SELECT o_orderkey AS uid, concat('city_', CAST(o_custkey%6 AS VARCHAR(8))) AS city,
       o_totalprice AS tessellation_car, o_totalprice*(1+o_orderkey%3) AS buildings_wall,
       CAST(o_orderkey%101 AS DOUBLE)+CASE WHEN o_orderkey%997=0 THEN 5000 ELSE 0 END AS buildings_adjacency,
       CASE WHEN o_orderkey%50=0 THEN NULL ELSE CAST((o_orderkey*37)%501 AS DOUBLE) END AS buildings_neighbour_distance
FROM {orders}""",
    "f_scenes": """
SELECT s_suppkey AS scene, 40+s_suppkey%17 AS height, 44+s_suppkey%23 AS width FROM {supplier}""",
    "f_image_files": """
SELECT concat(CASE WHEN n_nationkey%7=3 THEN 'img/old_' ELSE 'img/' END, r_name, '_', n_name, '_', CAST(s_suppkey AS VARCHAR(12)), '.tif') AS image_path
FROM {supplier} JOIN {nation} ON s_nationkey=n_nationkey JOIN {region} ON n_regionkey=r_regionkey""",
    "f_registry": """
SELECT c_custkey AS rid, c_name AS city, concat('img/', c_mktsegment, '/', CAST(c_custkey AS VARCHAR(12)), '_x.tif') AS image_path,
       concat('lab/', CAST(c_custkey AS VARCHAR(12)), '.geojson') AS labels_path,
       CASE WHEN c_custkey%9<7 THEN c_custkey%2=0 END AS use_augmentation
FROM {customer}""",
}

TABLE = re.compile(r"\{(\w+)\}")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The stand-in table as a lazy DataFrame over the Parquet files."""
    return spark.sql(TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", SQL[name]))


def with_fixtures(*names: str) -> str:
    """``WITH`` clause defining the stand-in tables for the checking SQL."""
    return "WITH " + ", ".join(f"{n} AS ({TABLE.sub(lambda m: m.group(1), SQL[n])})" for n in names)


def with_box(df: DataFrame) -> DataFrame:
    """Replace the four bound columns by ``bbox`` and a rectangle (or right triangle) ``geom``."""
    geom = g.rectangle("xmin", "ymin", "xmax", "ymax")
    if "kind" in df.columns:
        triangle = g.polygon(g.point("xmin", "ymin"), g.point("xmax", "ymin"), g.point("xmin", "ymax"))
        geom = f"CASE WHEN kind = 'tri' THEN {triangle} ELSE {geom} END"
    others = [c for c in df.columns if c not in ("xmin", "ymin", "xmax", "ymax")]
    return df.selectExpr(*others, f"{geom} AS geom", f"{g.box('xmin', 'ymin', 'xmax', 'ymax')} AS bbox")


def vector_fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_box(fixture(spark, sf_dir, name))
