"""Sources, filters, lookups, counts and set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import query
from catalogue.population import inputs, share
from catalogue.sql import MEDIAN_SHARE_CTES, SHARE_CTES, ctes
from quartier.fixtures import fixture, vector_fixture
from quartier.functions import geometry as g
from quartier.functions import projection as proj
from quartier.functions import scalars as sc
from quartier.operators import spatial
from quartier.operators.raster import land_use_mask, mosaic
from quartier.operators.skew import lookup_join, ordered_rank
from quartier.operators.stats import map_names
from quartier.plans.boxes import part_boxes
from quartier.plans.population import bottom_cities, median_population_share, ranked_cities, report_rows, top_cities
from quartier.plans.preparation import label_bounds
from quartier.sources import imagery, registry, vectors

BOX = (-90.47, 14.65, -90.37, 14.75)
LONLAT = "SELECT {cols} xmin/1e5-90.52e0 AS xmin, ymin/1e5+14.6e0 AS ymin, xmax/1e5-90.52e0 AS xmax, ymax/1e5+14.6e0 AS ymax FROM {table}"
INSIDE = "xmin>-90.47e0 AND xmax<-90.37e0 AND ymin>14.65e0 AND ymax<14.75e0"


def mx(lon):
    return f"round(6378137.0e0*radians({lon}),3)"


def my(lat):
    return f"round(6378137.0e0*ln(tan(pi()/4+radians({lat})/2)),3)"


def lonlat(df, *keep):
    """Fixture bounds in longitude/latitude with geometry and box."""
    moved = df.selectExpr(
        *keep, "xmin/1e5D-90.52D AS xmin", "ymin/1e5D+14.6D AS ymin", "xmax/1e5D-90.52D AS xmax", "ymax/1e5D+14.6D AS ymax"
    )
    corners = ("xmin", "ymin", "xmax", "ymax")
    return moved.selectExpr(*keep, f"{g.rectangle(*corners)} AS geom", f"{g.box(*corners)} AS bbox")


def out_bounds(df, *keep):
    return df.selectExpr(*keep, f"{g.bounds('geom')} AS b").selectExpr(
        *keep, "round(b.xmin,3) AS x0", "round(b.ymin,3) AS y0", "round(b.xmax,3) AS x1", "round(b.ymax,3) AS y1"
    )


@query(
    "s1_buildings_in_box",
    ctes("f_buildings", ll=LONLAT.format(cols="id,", table="f_buildings"))
    + f"SELECT id, 1 AS class_id, {mx('xmin')} AS x0, {my('ymin')} AS y0, {mx('xmax')} AS x1, {my('ymax')} AS y1 FROM ll WHERE {INSIDE}",
)
def s1(spark, sf):
    table = lonlat(fixture(spark, sf, "f_buildings"), "id")
    return out_bounds(vectors.buildings_in_box(table, BOX), "id", "class_id")


@query(
    "s2_roads_in_box",
    ctes("f_roads", ll=LONLAT.format(cols="id, subtype,", table="f_roads"))
    + f"SELECT id, subtype, 2 AS class_id, {mx('xmin')} AS x0, {my('ymin')} AS y0, {mx('xmax')} AS x1, {my('ymax')} AS y1 FROM ll WHERE {INSIDE} AND subtype='road'",
)
def s2(spark, sf):
    table = lonlat(fixture(spark, sf, "f_roads"), "id", "subtype")
    return out_bounds(vectors.roads_in_box(table, BOX), "id", "subtype", "class_id")


@query(
    "s3_pois_in_box",
    ctes("f_pois", ll="SELECT *, x/1e5-90.52e0 AS lon, y/1e5+14.6e0 AS lat FROM f_pois")
    + f"""SELECT id, name_json AS name, category, round(confidence,2) AS confidence, 3 AS class_id, {mx('lon')} AS x0, {my('lat')} AS y0
 FROM ll WHERE lon>-90.47e0 AND lon<-90.37e0 AND lat>14.65e0 AND lat<14.75e0""",
)
def s3(spark, sf):
    places = fixture(spark, sf, "f_pois").selectExpr(
        "id", "named_struct('primary', name_json) AS names", "named_struct('main', category) AS categories",
        "confidence", "x/1e5D-90.52D AS lon", "y/1e5D+14.6D AS lat",
    ).selectExpr(
        "id", "names", "categories", "CAST(confidence AS DOUBLE) AS confidence",
        f"named_struct('type', 'Point', 'polys', array(array(array({g.point('lon', 'lat')})))) AS geom",
        f"{g.box('lon', 'lat', 'lon', 'lat')} AS bbox",
    )
    found = vectors.pois_in_box(places, BOX)
    return found.selectExpr(
        "id", "name", "category", "confidence", "class_id",
        "round(geom.polys[0][0][0].x,3) AS x0", "round(geom.polys[0][0][0].y,3) AS y0",
    )


@query("s7_read_bands", ctes("f_obs") + "SELECT image_id, prow, pcol, b8, b4, b3, b2 FROM f_obs WHERE prow>=8 AND prow<48 AND pcol>=4 AND pcol<60")
def s7(spark, sf):
    return imagery.read_bands(fixture(spark, sf, "f_obs"), ["image_id", "prow", "pcol"], window=(8, 4, 48, 60))


@query(
    "s8_scene_metadata",
    ctes("f_obs") + """SELECT image_id, min(prow) AS row_min, max(prow) AS row_max, min(pcol) AS col_min, max(pcol) AS col_max,
 count(*) AS pixels FROM f_obs GROUP BY image_id""",
)
def s8(spark, sf):
    return imagery.scene_metadata(fixture(spark, sf, "f_obs"), "image_id")


@query("s9_filter_images", ctes("f_images") + "SELECT * FROM f_images WHERE day>='2024-01-02' AND day<'2024-01-07' AND cloud_pct<=15")
def s9(spark, sf):
    return imagery.filter_images(fixture(spark, sf, "f_images"), "2024-01-02", "2024-01-07")


@query(
    "s10_population_mosaic",
    ctes("f_pop_images") + """SELECT prow, pcol, px, py, b1, 'HRSL' AS dataset_used FROM (SELECT *, row_number() OVER
 (PARTITION BY prow, pcol ORDER BY image_order DESC) AS k FROM f_pop_images) WHERE k=1""",
)
def s10(spark, sf):
    return imagery.population_grid(fixture(spark, sf, "f_pop_images"), fixture(spark, sf, "f_pop"))


@query("s10_population_single", ctes("f_pop") + "SELECT prow, pcol, px, py, b1, 'GHS' AS dataset_used FROM f_pop")
def s10_single(spark, sf):
    return imagery.population_grid(fixture(spark, sf, "f_pop_images"), fixture(spark, sf, "f_pop"), use_hrsl=False)


@query(
    "s13_match_images",
    ctes("f_cities", "f_image_files") + """SELECT c.country, c.city, min(i.image_path) AS image_path FROM f_cities c LEFT JOIN f_image_files i
 ON starts_with(i.image_path, concat('img/', c.country, '_', c.city)) GROUP BY 1,2""",
)
def s13(spark, sf):
    cities = fixture(spark, sf, "f_cities").select("country", "city")
    return imagery.match_images(cities, fixture(spark, sf, "f_image_files"))


@query(
    "k6_skipped_cities",
    ctes("f_cities", "f_image_files") + """SELECT c.country, c.city FROM f_cities c WHERE NOT EXISTS (SELECT 1 FROM f_image_files i
 WHERE starts_with(i.image_path, concat('img/', c.country, '_', c.city)))""",
)
def k6(spark, sf):
    cities = fixture(spark, sf, "f_cities").select("country", "city")
    return imagery.skipped_cities(imagery.match_images(cities, fixture(spark, sf, "f_image_files")))


@query(
    "s15_select_cities",
    ctes("f_registry") + """SELECT city, image_path, labels_path, use_augmentation FROM f_registry
 WHERE city IN ('Customer#000000001','Customer#000000007','Customer#000000008')""",
)
def s15(spark, sf):
    names = [f"Customer#{i:09d}" for i in (1, 7, 8)]
    return registry.select_cities(fixture(spark, sf, "f_registry").drop("rid"), names)


@query(
    "s17_population_window",
    ctes("f_pop_images") + "SELECT prow, pcol, px, py, median(b1) AS b1 FROM f_pop_images WHERE px>=2000 AND px<15000 AND py>=1000 AND py<18000 GROUP BY 1,2,3,4",
)
def s17(spark, sf):
    return imagery.population_window(fixture(spark, sf, "f_pop_images"), (2000, 1000, 15000, 18000))


@query("f1_band_selection", ctes("f_obs") + "SELECT image_id, prow, pcol, b2, b3, b4, b8 FROM f_obs")
def f1(spark, sf):
    return imagery.select_bands(fixture(spark, sf, "f_obs"), ["image_id", "prow", "pcol"])


@query("f2_strict_box", ctes("f_buildings") + "SELECT id, class_id FROM f_buildings WHERE xmin>1000 AND xmax<9000 AND ymin>500 AND ymax<12000")
def f2(spark, sf):
    return spatial.inside_box(vector_fixture(spark, sf, "f_buildings"), 1000, 500, 9000, 12000).select("id", "class_id")


@query(
    "f4_city_list",
    ctes("f_morpho") + "SELECT city, count(*) AS n FROM f_morpho WHERE city IN ('city_1','city_4') GROUP BY 1",
)
def f4(spark, sf):
    df = fixture(spark, sf, "f_morpho")
    return df.where(df.city.isin("city_1", "city_4")).groupBy("city").agg(F.expr("count(1) AS n"))


@query("f5_with_informal", SHARE_CTES + "SELECT * FROM share WHERE informal_population>0")
def f5(spark, sf):
    return ranked_cities(share(spark, sf))


@query(
    "f7_drop_null_geometry",
    ctes("f_settlements") + "SELECT sid, country FROM f_settlements WHERE sid%7<>0",
)
def f7(spark, sf):
    df = vector_fixture(spark, sf, "f_settlements").selectExpr("sid", "country", "CASE WHEN sid%7<>0 THEN geom END AS geom")
    return df.dropna(subset=["geom"]).select("sid", "country")


@query(
    "f9_check_features",
    ctes("f_settlements") + """SELECT sid, CASE WHEN sid%7=0 THEN 'no geometry' WHEN sid%5=0 THEN 'not a polygon' ELSE 'no class id' END AS reason
 FROM f_settlements WHERE sid%7=0 OR sid%5=0 OR sid%3=0""",
)
def f9(spark, sf):
    df = vector_fixture(spark, sf, "f_settlements").selectExpr(
        "sid", "CASE WHEN sid%3<>0 THEN 1 END AS class_id",
        """CASE WHEN sid%7=0 THEN NULL WHEN sid%5=0 THEN named_struct('type', 'LineString', 'polys', geom.polys) ELSE geom END AS geom""",
    )
    return vectors.check_features(df).select("sid", "reason")


@query(
    "d6_default_class",
    ctes("f_settlements") + "SELECT sid, CASE WHEN sid%3=0 THEN 2 ELSE 1 END AS class_id FROM f_settlements",
)
def d6(spark, sf):
    df = fixture(spark, sf, "f_settlements").selectExpr("sid", "CASE WHEN sid%3=0 THEN 2 END AS class_id")
    return vectors.infer_class(df, 1)


@query(
    "f14_row_status",
    ctes("f_registry") + """SELECT CASE WHEN TRY_CAST(substring(city, 18, 1) AS BIGINT)>4 THEN 'ok' ELSE 'rejected' END AS status, count(*) AS n
 FROM f_registry GROUP BY 1""",
)
def f14(spark, sf):
    df = fixture(spark, sf, "f_registry").selectExpr("*", "try_cast(substring(city, 18, 1) AS BIGINT) AS number")
    return df.selectExpr("*", "CASE WHEN number > 4 THEN 'ok' ELSE 'rejected' END AS status").groupBy("status").agg(
        F.expr("count(1) AS n")
    )


J1_SQL = ctes("f_buildings", "f_settlements") + """SELECT b.id, s.sid FROM f_buildings b JOIN f_settlements s ON
 b.xmin<=s.xmax AND s.xmin<=b.xmax AND b.ymin<=s.ymax AND s.ymin<=b.ymax AND (s.kind='rect' OR
 (greatest(b.xmin,s.xmin)-s.xmin)*(s.ymax-s.ymin)+(greatest(b.ymin,s.ymin)-s.ymin)*(s.xmax-s.xmin)<=(s.xmax-s.xmin)*(s.ymax-s.ymin))"""


@query("j1_buildings_in_settlements", J1_SQL)
def j1(spark, sf):
    pairs = spatial.meeting_ids(
        vector_fixture(spark, sf, "f_buildings"), vector_fixture(spark, sf, "f_settlements"), 500.0, "id", "sid"
    )
    return pairs.selectExpr("l_id AS id", "r_sid AS sid")


@query("j2_buildings_meeting_areas", f"SELECT DISTINCT id FROM ({J1_SQL})")
def j2(spark, sf):
    return spatial.spatial_semi(
        vector_fixture(spark, sf, "f_buildings"), vector_fixture(spark, sf, "f_settlements"), 500.0, ["id"]
    ).select("id")


@query(
    "j2_meets_rectangle",
    ctes("f_settlements") + """SELECT sid FROM f_settlements s WHERE s.xmin<=12000 AND s.xmax>=3100 AND s.ymin<=9000 AND s.ymax>=2500 AND (s.kind='rect' OR
 (greatest(3100,s.xmin)-s.xmin)*(s.ymax-s.ymin)+(greatest(2500,s.ymin)-s.ymin)*(s.xmax-s.xmin)<=(s.xmax-s.xmin)*(s.ymax-s.ymin))""",
)
def j2_box(spark, sf):
    return spatial.meets_box(vector_fixture(spark, sf, "f_settlements"), 3100, 2500, 12000, 9000).select("sid")


def clipped_area(x0, y0, x1, y1):
    """Area of settlement s inside a box; corner sums of the triangle beyond (a, b)."""
    w, h = "(s.xmax-s.xmin)", "(s.ymax-s.ymin)"

    def corner(a, b):
        return f"({w}*{h}/2.0e0)*pow(greatest(0, 1-greatest({a}-s.xmin,0)/CAST({w} AS DOUBLE)-greatest({b}-s.ymin,0)/CAST({h} AS DOUBLE)),2)"

    tri = f"{corner(x0, y0)}-{corner(x1, y0)}-{corner(x0, y1)}+{corner(x1, y1)}"
    rect = f"greatest(0,least({x1},s.xmax)-greatest({x0},s.xmin))*greatest(0,least({y1},s.ymax)-greatest({y0},s.ymin))"
    return f"round(CASE WHEN s.kind='rect' THEN CAST({rect} AS DOUBLE) ELSE {tri} END,3)"


@query(
    "j4_overlay_cities",
    ctes("f_cities", "f_settlements", o=f"""SELECT s.sid, c.city, {clipped_area('c.xmin', 'c.ymin', 'c.xmax', 'c.ymax')} AS area
 FROM f_settlements s JOIN f_cities c ON s.xmin<=c.xmax AND c.xmin<=s.xmax AND s.ymin<=c.ymax AND c.ymin<=s.ymax""")
    + "SELECT * FROM o WHERE area>0",
)
def j4(spark, sf):
    cities, settlements, _ = inputs(spark, sf)
    cut = spatial.overlay_box(settlements, cities, 2000.0)
    return cut.selectExpr("l_sid AS sid", "r_city AS city", f"round({g.area('geom')},3) AS area").where("area > 0")


@query(
    "j5_clip_rectangle",
    ctes("f_settlements", o=f"SELECT s.sid, {clipped_area(3100, 2500, 12000, 9000)} AS area FROM f_settlements s WHERE s.xmin<=12000 AND s.xmax>=3100 AND s.ymin<=9000 AND s.ymax>=2500")
    + "SELECT * FROM o WHERE area>0",
)
def j5(spark, sf):
    cut = spatial.clip_box(vector_fixture(spark, sf, "f_settlements"), 3100, 2500, 12000, 9000)
    return cut.selectExpr("sid", f"round({g.area('geom')},3) AS area").where("area > 0")


@query(
    "j6_save_first",
    ctes("f_images", s="SELECT l_linenumber AS image_id, l_returnflag AS flag, max(l_tax) AS tax FROM lineitem GROUP BY 1,2")
    + """SELECT image_id, day, cloud_pct, azimuth, flag, tax FROM (SELECT i.*, s.flag, s.tax, row_number() OVER (PARTITION BY i.image_id ORDER BY s.flag) AS k
 FROM f_images i JOIN s ON s.image_id=i.image_id) WHERE k=1""",
)
def j6(spark, sf):
    other = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(
        F.expr("l_linenumber AS image_id"), F.expr("l_returnflag AS flag")
    ).agg(F.expr("max(l_tax) AS tax"))
    return imagery.save_first(fixture(spark, sf, "f_images"), other, "image_id", "flag", ["flag", "tax"])


@query(
    "j9_country_lookup",
    ctes("f_cities", "f_settlements") + """SELECT c.city, count(s.sid) AS settlements FROM f_cities c LEFT JOIN f_settlements s
 ON s.country=c.country AND s.country<>'ASIA' GROUP BY 1""",
)
def j9(spark, sf):
    # all settlements are read; those of one country count for none, so the lookup misses it
    counted = fixture(spark, sf, "f_settlements").groupBy(F.expr("nullif(country, 'ASIA') AS country"))
    counts = counted.agg(F.expr("count(1) AS n"))
    return lookup_join(fixture(spark, sf, "f_cities"), counts, ["country"], "left").selectExpr(
        "city", "coalesce(n, 0) AS settlements"
    )


NAMES = {"city_0": "Zero", "city_1": "One", "city_2": "Two"}


@query(
    "j10_display_names",
    ctes("f_morpho") + """SELECT CASE city WHEN 'city_0' THEN 'Zero' WHEN 'city_1' THEN 'One' WHEN 'city_2' THEN 'Two' ELSE city END AS city,
 count(*) AS n FROM f_morpho GROUP BY 1""",
)
def j10(spark, sf):
    return map_names(fixture(spark, sf, "f_morpho"), "city", NAMES, keep_unknown=True).groupBy("city").agg(F.expr("count(1) AS n"))


@query(
    "j10_display_names_strict",
    ctes("f_morpho") + """SELECT CASE city WHEN 'city_0' THEN 'Zero' WHEN 'city_1' THEN 'One' WHEN 'city_2' THEN 'Two' END AS city,
 count(*) AS n FROM f_morpho GROUP BY 1""",
)
def j10_strict(spark, sf):
    return map_names(fixture(spark, sf, "f_morpho"), "city", NAMES).groupBy("city").agg(F.expr("count(1) AS n"))


@query(
    "a4_total_bounds",
    ctes("f_settlements") + """SELECT country, CAST(min(xmin) AS DOUBLE) AS xmin, CAST(min(ymin) AS DOUBLE) AS ymin,
 CAST(max(xmax) AS DOUBLE) AS xmax, CAST(max(ymax) AS DOUBLE) AS ymax FROM f_settlements GROUP BY 1""",
)
def a4(spark, sf):
    return label_bounds(vector_fixture(spark, sf, "f_settlements"), "country")


@query("a6_value_counts", ctes("f_pois") + "SELECT concat(category, ', ', CAST(class_id AS VARCHAR)) AS label, count(*) AS n FROM f_pois GROUP BY 1")
def a6(spark, sf):
    df = fixture(spark, sf, "f_pois").selectExpr(f"{sc.city_country('category', 'CAST(class_id AS STRING)')} AS label")
    return df.groupBy("label").agg(F.expr("count(1) AS n")).orderBy(F.desc("n"), "label")


@query(
    "a9_mosaic",
    ctes("f_pop_images") + """SELECT prow, pcol, b1 FROM (SELECT *, row_number() OVER (PARTITION BY prow, pcol ORDER BY image_order) AS k
 FROM f_pop_images WHERE b1<>20) WHERE k=1""",
)
def a9(spark, sf):
    images = fixture(spark, sf, "f_pop_images").selectExpr("image_order", "prow", "pcol", "CASE WHEN b1 <> 20 THEN b1 END AS b1")
    return mosaic(images, ["prow", "pcol"], "b1", "image_order", last_on_top=False)


@query(
    "a10_land_use_mask",
    ctes("f_obs", x="SELECT prow, pcol, image_id, CASE WHEN scl>0 THEN scl END AS lulc, CASE WHEN probability>20 THEN probability END AS road FROM f_obs",
         y="""SELECT prow, pcol, arg_min(lulc, image_id) FILTER (WHERE lulc IS NOT NULL) AS lulc,
 arg_min(road, image_id) FILTER (WHERE road IS NOT NULL) AS road FROM x GROUP BY 1,2""",
         z="SELECT prow, pcol, CASE WHEN road>50 THEN 6 ELSE lulc END AS lulc FROM y")
    + "SELECT prow, pcol, lulc, CAST(lulc<>0 AS INT) AS mask FROM z",
)
def a10(spark, sf):
    images = fixture(spark, sf, "f_obs").selectExpr(
        "prow", "pcol", "image_id", "CASE WHEN scl > 0 THEN scl END AS lulc", "CASE WHEN probability > 20 THEN probability END AS road"
    )
    return land_use_mask(images, ["prow", "pcol"], "image_id")


@query("a26_distinct_countries", ctes("f_settlements") + "SELECT count(DISTINCT country) AS countries FROM f_settlements")
def a26(spark, sf):
    return fixture(spark, sf, "f_settlements").select(F.count_distinct("country").alias("countries"))


def twisted(spark, sf):
    """Settlement outlines, every fifth one as a bow tie."""
    bow = g.polygon(g.point("xmin", "ymin"), g.point("xmax", "ymax"), g.point("xmax", "ymin"), g.point("xmin", "ymax + 7"))
    box = g.rectangle("xmin", "ymin", "xmax", "ymax")
    return fixture(spark, sf, "f_settlements").selectExpr(
        "sid", "country", f"CASE WHEN sid % 5 = 0 THEN {bow} WHEN sid % 7 <> 0 THEN {box} END AS geom"
    )


@query(
    "g17_validity_report",
    ctes("f_settlements") + """SELECT country, count(*) FILTER (WHERE sid%5=0 OR sid%7=0) AS rejected, count(*) FILTER (WHERE sid%5<>0 AND sid%7<>0) AS valid
 FROM f_settlements GROUP BY 1""",
)
def g17(spark, sf):
    return twisted(spark, sf).groupBy("country").agg(
        F.expr(f"count_if(geom IS NULL OR NOT {g.is_valid('geom')}) AS rejected"),
        F.expr(f"count_if(geom IS NOT NULL AND {g.is_valid('geom')}) AS valid"),
    )


@query("a27_rejected_features", ctes("f_settlements") + "SELECT sid, country FROM f_settlements WHERE sid%5=0 OR sid%7=0")
def a27(spark, sf):
    return vectors.rejected_features(twisted(spark, sf)).select("sid", "country")


@query(
    "a32_part_boxes",
    ctes("f_settlements") + """SELECT country, concat(CAST(sid AS VARCHAR), '_', CAST(k AS VARCHAR)) AS geometry_index, CAST(xmin+900*k AS DOUBLE) AS x0, CAST(ymax+10*k AS DOUBLE) AS y1
 FROM f_settlements, (VALUES (0),(1)) t(k) WHERE kind='rect' UNION ALL SELECT country, CAST(sid AS VARCHAR), CAST(xmin AS DOUBLE), CAST(ymax AS DOUBLE) FROM f_settlements WHERE kind='tri'""",
)
def a32(spark, sf):
    multi = f"named_struct('type', 'MultiPolygon', 'polys', concat(geom.polys, ({g.translate('geom', '900', '10')}).polys))"
    df = vector_fixture(spark, sf, "f_settlements").selectExpr(
        "sid AS id", "country", f"CASE WHEN kind = 'rect' THEN {multi} ELSE geom END AS geom", "bbox"
    )
    return part_boxes(df).selectExpr("country", "geometry_index", "bbox.xmin AS x0", "bbox.ymax AS y1")


@query("o1_ranking_top", SHARE_CTES + "SELECT * FROM share WHERE informal_population>0 ORDER BY proportion_informal DESC, city LIMIT 5")
def o1(spark, sf):
    return top_cities(share(spark, sf), 5)


@query("o2_ranking_tail", SHARE_CTES + "SELECT * FROM share WHERE informal_population>0 ORDER BY proportion_informal, city DESC LIMIT 8")
def o2(spark, sf):
    return bottom_cities(share(spark, sf), 8)


@query(
    "o3_first_per_city",
    ctes("f_morpho") + "SELECT city, arg_min(uid, struct_pack(a:=-tessellation_car, b:=uid)) AS uid, max(tessellation_car) AS tessellation_car FROM f_morpho GROUP BY 1",
)
def o3(spark, sf):
    best = F.expr("min_by(struct(uid, tessellation_car), struct(-tessellation_car, uid)) AS best")
    return fixture(spark, sf, "f_morpho").groupBy("city").agg(best).selectExpr("city", "best.uid", "best.tessellation_car")


@query(
    "m6_report_rows",
    SHARE_CTES + r"""SELECT city, total_population-informal_population AS formal_population, regexp_replace(city, '(\w)([A-Z])', '\1 \2', 'g') AS clean_city,
 printf('%.1f%%', proportion_informal*100) AS share_label, printf('%.1fM', total_population/1e6) AS total_label FROM share""",
)
def m6(spark, sf):
    return report_rows(share(spark, sf)).select("city", "formal_population", "clean_city", "share_label", "total_label")


@query(
    "w1_sequential_ids",
    ctes("f_morpho") + "SELECT city, uid, row_number() OVER (PARTITION BY city ORDER BY tessellation_car, uid)-1 AS pos FROM f_morpho",
)
def w1(spark, sf):
    return ordered_rank(fixture(spark, sf, "f_morpho"), ["city"], "tessellation_car", ["uid"]).select("city", "uid", "pos")


@query(
    "u1_union_with_missing_columns",
    ctes("f_buildings", "f_roads") + """SELECT kind, count(*) AS n, count(subtype) AS with_subtype, count(class_id) AS with_class FROM
 (SELECT 'b' AS kind, id, NULL AS subtype, class_id FROM f_buildings UNION ALL SELECT 'r', id, subtype, NULL FROM f_roads) GROUP BY 1""",
)
def u1(spark, sf):
    b = fixture(spark, sf, "f_buildings").selectExpr("'b' AS kind", "id", "class_id")
    r = fixture(spark, sf, "f_roads").selectExpr("'r' AS kind", "id", "subtype")
    return b.unionByName(r, allowMissingColumns=True).groupBy("kind").agg(
        F.expr("count(1) AS n"), F.expr("count(subtype) AS with_subtype"), F.expr("count(class_id) AS with_class")
    )


@query(
    "m1_file_safe_names",
    """SELECT p_partkey AS id, replace(replace(replace(replace(replace(replace(replace(replace(concat(p_name, ' (', p_type, '/[', p_brand, ']) & ''x'''),
 ' ', '_'), '/', '_'), '[', ''), ']', ''), '(', ''), ')', ''), '&', 'and'), '''', '') AS name FROM part""",
)
def m1(spark, sf):
    text = """concat(p_name, ' (', p_type, '/[', p_brand, "]) & 'x'")"""
    return spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS id", f"{sc.file_safe(text)} AS name")


@query(
    "m2_spaced_names",
    r"SELECT p_partkey AS id, regexp_replace(replace(p_type, ' ', 'X'), '(\w)([A-Z])', '\1 \2', 'g') AS name FROM part",
)
def m2(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "p_partkey AS id", sc.spaced_name("replace(p_type, ' ', 'X')") + " AS name"
    )


@query(
    "m3_image_names",
    ctes("f_cities") + "SELECT city, concat(country, '_', city, '_2024') AS file_name, concat(city, ', ', country) AS city_country FROM f_cities",
)
def m3(spark, sf):
    return fixture(spark, sf, "f_cities").selectExpr(
        "city", sc.image_name("country", "city", "'2024-05-24'") + " AS file_name", sc.city_country("city", "country") + " AS city_country"
    )


@query(
    "m4_path_parts",
    ctes("f_registry") + """SELECT rid, concat(CAST(rid AS VARCHAR), '_x') AS stem, split_part(image_path, '/', 2) AS folder,
 concat('class-', CAST(rid AS VARCHAR), '-slums.json') AS class_file FROM f_registry""",
)
def m4(spark, sf):
    return fixture(spark, sf, "f_registry").selectExpr(
        "rid", sc.stem("image_path") + " AS stem", sc.path_part("image_path", 2) + " AS folder", sc.class_file("rid", "'slums'") + " AS class_file"
    )


@query(
    "m7_clamped_coordinates",
    ctes("f_pois") + "SELECT id, least(greatest(x/50.0e0-200,-180),180) AS lon, least(greatest(y/50.0e0-200,-90),90) AS lat FROM f_pois",
)
def m7(spark, sf):
    lon, lat = sc.clamp_lonlat("x/50D-200", "y/50D-200")
    return fixture(spark, sf, "f_pois").selectExpr("id", f"{lon} AS lon", f"{lat} AS lat")


@query(
    "m11_class_weights",
    ctes("f_obs") + "SELECT image_id, sum(CASE WHEN scl=1 THEN 1.0e0 WHEN scl=2 THEN 0.5e0 ELSE 0.0e0 END) AS weight FROM f_obs GROUP BY 1",
)
def m11(spark, sf):
    return fixture(spark, sf, "f_obs").groupBy("image_id").agg(F.expr(f"sum({sc.class_weight('scl')}) AS weight"))


@query(
    "m10_nan_to_zero",
    "SELECT c_custkey AS id, CASE WHEN c_acctbal<0 OR c_custkey%11=0 THEN 0.0e0 ELSE c_acctbal END AS value FROM customer",
)
def m10(spark, sf):
    raw = "CASE WHEN c_acctbal < 0 THEN double('NaN') WHEN c_custkey % 11 <> 0 THEN c_acctbal END"
    return spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS id", sc.nan_to_zero(raw) + " AS value")


@query(
    "x7_median_population_share",
    MEDIAN_SHARE_CTES + "SELECT * FROM share",
)
def x7_median(spark, sf):
    cities, settlements, _ = inputs(spark, sf)
    df = median_population_share(cities, settlements, fixture(spark, sf, "f_pop_images"))
    return df.selectExpr("country", "city", "total_population", "informal_population", "round(proportion_informal, 6) AS proportion_informal", "dataset_used")
