"""Geometry and projection queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import query
from catalogue.sql import ctes
from catalogue.tables import lonlat
from quartier.fixtures import fixture, vector_fixture
from quartier.functions import geometry as g
from quartier.functions import projection as proj
from quartier.operators.raster import covered_cells, dissolved_area, overlay_area
from quartier.operators.spatial import spatial_join
from quartier.plans.boxes import city_boxes
from quartier.plans.prediction import common_pixel_boxes


@query(
    "g1_mercator_round_trip",
    ctes("f_pois") + """SELECT id, round(x/1e5-90.52e0,9) AS lon, round(y/1e5+14.6e0,9) AS lat,
 round(6378137.0e0*radians(x/1e5-90.52e0),3) AS mx, round(6378137.0e0*ln(tan(pi()/4+radians(y/1e5+14.6e0)/2)),3) AS my FROM f_pois""",
)
def g1(spark, sf):
    df = fixture(spark, sf, "f_pois").selectExpr(
        "id", f"{proj.mercator_x('x/1e5D-90.52D')} AS mx", f"{proj.mercator_y('y/1e5D+14.6D')} AS my"
    )
    return df.selectExpr(
        "id", f"round({proj.mercator_lon('mx')},9) AS lon", f"round({proj.mercator_lat('my')},9) AS lat",
        "round(mx,3) AS mx", "round(my,3) AS my",
    )


# Krueger's series written out for SQL (third flattening n, conformal latitude, then the harmonics)
_N = "0.0016792203863837205e0"
KRUEGER = ctes(
    "f_pois",
    p=f"""SELECT id, radians(y/1e5+14.6e0) AS phi, radians(x/1e5-90.52e0+87) AS dl, 2*sqrt({_N})/(1+{_N}) AS e FROM f_pois""",
    q="SELECT id, dl, sinh(atanh(sin(phi))-e*atanh(e*sin(phi))) AS t FROM p",
    r="SELECT id, atan2(t, cos(dl)) AS xi, atanh(sin(dl)/sqrt(1+t*t)) AS eta FROM q",
    k=f"""SELECT 6378137.0e0/(1+{_N})*(1+pow({_N},2)/4+pow({_N},4)/64) AS a, {_N}/2-2*pow({_N},2)/3+5*pow({_N},3)/16 AS a1,
 13*pow({_N},2)/48-3*pow({_N},3)/5 AS a2, 61*pow({_N},3)/240 AS a3""",
)


@query(
    "g2_utm",
    KRUEGER + """SELECT id, round(500000+0.9996e0*a*(eta+a1*cos(2*xi)*sinh(2*eta)+a2*cos(4*xi)*sinh(4*eta)+a3*cos(6*xi)*sinh(6*eta)),3) AS east,
 round(0.9996e0*a*(xi+a1*sin(2*xi)*cosh(2*eta)+a2*sin(4*xi)*cosh(4*eta)+a3*sin(6*xi)*cosh(6*eta)),3) AS north FROM r, k""",
)
def g2(spark, sf):
    return fixture(spark, sf, "f_pois").selectExpr("id", f"{proj.utm('(x/1e5D-90.52D)', '(y/1e5D+14.6D)')} AS p").selectExpr(
        "id", "round(p.x,3) AS east", "round(p.y,3) AS north"
    )


@query("g2_utm_round_trip", ctes("f_pois") + "SELECT id, round(x/1e5-90.52e0,8) AS lon, round(y/1e5+14.6e0,8) AS lat FROM f_pois")
def g2_back(spark, sf):
    df = fixture(spark, sf, "f_pois").selectExpr("id", f"{proj.utm('(x/1e5D-90.52D)', '(y/1e5D+14.6D)')} AS p")
    return df.selectExpr("id", f"{proj.utm_inverse('p.x', 'p.y')} AS q").selectExpr(
        "id", "round(q.x,8) AS lon", "round(q.y,8) AS lat"
    )


@query(
    "g3_g4_g5_measures",
    ctes("f_settlements", v="SELECT *, CAST(xmax-xmin AS DOUBLE) AS w, CAST(ymax-ymin AS DOUBLE) AS h FROM f_settlements")
    + """SELECT sid, CAST(xmin AS DOUBLE) AS x0, CAST(ymax AS DOUBLE) AS y1, CASE WHEN kind='rect' THEN w*h ELSE w*h/2 END AS area,
 round(CASE WHEN kind='rect' THEN 2*(w+h) ELSE w+h+sqrt(w*w+h*h) END,6) AS perimeter FROM v""",
)
def measures(spark, sf):
    return vector_fixture(spark, sf, "f_settlements").selectExpr(
        "sid", f"({g.bounds('geom')}).xmin AS x0", f"({g.bounds('geom')}).ymax AS y1",
        f"{g.area('geom')} AS area", f"round({g.perimeter('geom')},6) AS perimeter",
    )


def holed(spark, sf):
    """Two-part settlements: an outline with a square hole, and a shifted copy without."""
    hole = "array(" + ", ".join(
        g.point(x, y) for x, y in (
            ("bbox.xmin+10", "bbox.ymin+10"), ("bbox.xmin+30", "bbox.ymin+10"), ("bbox.xmin+30", "bbox.ymin+30"),
            ("bbox.xmin+10", "bbox.ymin+30"), ("bbox.xmin+10", "bbox.ymin+10"),
        )
    ) + ")"
    shifted = f"({g.translate('geom', '5000', '-3')}).polys[0]"
    return vector_fixture(spark, sf, "f_settlements").selectExpr(
        "sid", "kind", f"named_struct('type', 'MultiPolygon', 'polys', array(array(geom.polys[0][0], {hole}), {shifted})) AS geom"
    )


@query(
    "g4_area_with_holes",
    ctes("f_settlements", v="SELECT *, (xmax-xmin)*(ymax-ymin)*CASE WHEN kind='rect' THEN 1.0e0 ELSE 0.5e0 END AS a FROM f_settlements")
    + "SELECT sid, 2*a-400 AS area, 2*a AS filled_area FROM v",
)
def area_with_holes(spark, sf):
    return holed(spark, sf).selectExpr("sid", f"{g.area('geom')} AS area", f"{g.fill_holes('geom')} AS filled").selectExpr(
        "sid", "area", f"{g.area('filled')} AS filled_area"
    )


@query(
    "g10_split_multipolygons",
    ctes("f_settlements") + """SELECT sid, k AS part, (xmax-xmin)*(ymax-ymin)*CASE WHEN kind='rect' THEN 1.0e0 ELSE 0.5e0 END-CASE WHEN k=0 THEN 400 ELSE 0 END AS area,
 CAST(xmin+5000*k AS DOUBLE) AS x0 FROM f_settlements, (VALUES (0),(1)) t(k)""",
)
def split_multipolygons(spark, sf):
    return g.explode_parts(holed(spark, sf)).selectExpr(
        "sid", "part", f"{g.area('geom')} AS area", f"({g.bounds('geom')}).xmin AS x0"
    )


@query("g11_promoted_types", ctes("f_settlements") + "SELECT 'MultiPolygon' AS type, count(*) AS n FROM f_settlements")
def promoted(spark, sf):
    return vector_fixture(spark, sf, "f_settlements").selectExpr(f"({g.promote('geom')}).type AS type").groupBy("type").agg(
        F.expr("count(1) AS n")
    )


@query(
    "g12_polygon_distance",
    ctes("f_cities", "f_settlements") + """SELECT s.sid, c.city, round(sqrt(pow(greatest(c.xmin-s.xmax, s.xmin-c.xmax, 0),2)+pow(greatest(c.ymin-s.ymax, s.ymin-c.ymax, 0),2)),6) AS distance
 FROM f_settlements s JOIN f_cities c ON c.country=s.country WHERE greatest(c.xmin-s.xmax, s.xmin-c.xmax, c.ymin-s.ymax, s.ymin-c.ymax)<=1000""",
)
def polygon_distance(spark, sf):
    """Distances between settlements and the cities of their country whose bounds come within 1,000 m per axis."""
    s = vector_fixture(spark, sf, "f_settlements").selectExpr("sid", "country", f"{g.envelope('bbox')} AS geom", f"{g.expand('bbox', '1000D')} AS bbox")
    c = vector_fixture(spark, sf, "f_cities").select("city", "country", "geom", "bbox")
    near = spatial_join(s, c, 2000.0, None, ["country"])
    return near.selectExpr("l_sid AS sid", "r_city AS city", f"round({g.distance('l_geom', 'r_geom')},6) AS distance")


@query(
    "g7_point_distance",
    ctes("f_settlements", "f_cities") + """SELECT s.sid, round(sqrt(pow(greatest(s.xmin-c.px, c.px-s.xmax, 0),2)+pow(greatest(s.ymin-c.py, c.py-s.ymax, 0),2)),6) AS distance,
 c.px>=s.xmin AND c.px<s.xmax AND c.py>=s.ymin AND c.py<s.ymax AS inside FROM f_settlements s JOIN
 (SELECT country, min(xmin)+1500 AS px, min(ymin)+1300 AS py FROM f_cities GROUP BY 1) c ON c.country=s.country""",
)
def point_in_polygon(spark, sf):
    s = vector_fixture(spark, sf, "f_settlements").selectExpr("sid", "country", f"{g.envelope('bbox')} AS geom")
    c = fixture(spark, sf, "f_cities").groupBy("country").agg(
        F.expr("min(xmin) + 1500 AS px"), F.expr("min(ymin) + 1300 AS py")
    )
    return s.join(c, "country").selectExpr(
        "sid", f"round({g.point_distance('geom', 'px', 'py')},6) AS distance", f"{g.contains_point('geom', 'px', 'py')} AS inside"
    )


@query(
    "g13_window_frame",
    ctes("f_settlements") + "SELECT sid, CAST(xmin-xmin//256*256 AS DOUBLE) AS x0, CAST(ymax-ymin//256*256 AS DOUBLE) AS y1 FROM f_settlements",
)
def window_frame(spark, sf):
    df = vector_fixture(spark, sf, "f_settlements").selectExpr(
        "sid", f"{g.translate('geom', '-floor(bbox.xmin/256)*256', '-floor(bbox.ymin/256)*256')} AS geom"
    )
    return df.selectExpr("sid", f"({g.bounds('geom')}).xmin AS x0", f"({g.bounds('geom')}).ymax AS y1")


PIXEL_BOX = """SELECT sid, CAST(floor((20000-ymax)/50.0e0) AS BIGINT) AS t, CAST(floor(xmin/50.0e0) AS BIGINT) AS l,
 CAST(floor((20000-ymin)/50.0e0) AS BIGINT) AS b, CAST(floor(xmax/50.0e0) AS BIGINT) AS r FROM f_settlements"""


@query(
    "g14_g15_pixel_boxes",
    ctes("f_settlements", p=PIXEL_BOX) + """SELECT sid, greatest(0, least(t, b, 299)) AS iymin, greatest(0, least(l, r, 349)) AS ixmin,
 least(300, greatest(t, b, 1)) AS iymax, least(350, greatest(l, r, 1)) AS ixmax, t AS bymin, greatest(b, t+1) AS bymax FROM p""",
)
def pixel_boxes(spark, sf):
    scenes = fixture(spark, sf, "f_settlements").selectExpr(
        "sid", "xmin AS x0", "ymin AS y0", "xmax AS x1", "ymax AS y1", "0D AS xmin", "20000D AS ymax", "50D AS res",
        "300L AS height", "350L AS width",
    )
    return common_pixel_boxes(scenes).selectExpr(
        "sid", "image_box.ymin AS iymin", "image_box.xmin AS ixmin", "image_box.ymax AS iymax", "image_box.xmax AS ixmax",
        "building_box.ymin AS bymin", "building_box.ymax AS bymax",
    )


@query(
    "g16_square_boxes",
    ctes("f_pois", m="SELECT id, 6378137.0e0*radians(x/1e5-90.52e0) AS mx, 6378137.0e0*ln(tan(pi()/4+radians(y/1e5+14.6e0)/2)) AS my FROM f_pois")
    + """SELECT id, round(degrees((mx-250)/6378137.0e0),8) AS x0, round(degrees(2*atan(exp((my-250)/6378137.0e0))-pi()/2),8) AS y0,
 round(degrees((mx+250)/6378137.0e0),8) AS x1, round(degrees(2*atan(exp((my+250)/6378137.0e0))-pi()/2),8) AS y1 FROM m""",
)
def square_boxes(spark, sf):
    df = fixture(spark, sf, "f_pois").selectExpr("id", f"{proj.square_around('(x/1e5D-90.52D)', '(y/1e5D+14.6D)', '500D')} AS b")
    return df.selectExpr(
        "id", "round(b.xmin,8) AS x0", "round(b.ymin,8) AS y0", "round(b.xmax,8) AS x1", "round(b.ymax,8) AS y1"
    )


@query("x11_city_boxes")
def boxes(spark, sf):
    labels = lonlat(fixture(spark, sf, "f_settlements"), "country", "sid")
    return city_boxes(labels, "country").selectExpr(
        "country", "file_name", "round(bbox.xmin,6) AS x0", "round(bbox.ymin,6) AS y0", "round(bbox.xmax,6) AS x1", "round(bbox.ymax,6) AS y1"
    )


CELL_IN = """(c.cx*100+50>=s.xmin AND c.cx*100+50<s.xmax AND c.cy*100+50>=s.ymin AND c.cy*100+50<s.ymax AND (s.kind='rect' OR
 (c.cx*100+50-s.xmin)*(s.ymax-s.ymin)+(c.cy*100+50-s.ymin)*(s.xmax-s.xmin)<(s.xmax-s.xmin)*(s.ymax-s.ymin)))"""
GRID = "SELECT a.i AS cx, b.i AS cy FROM range(0,260) a(i), range(0,260) b(i)"
COVERED = f"SELECT s.sid, s.country, c.cx, c.cy FROM f_settlements s JOIN grid c ON {CELL_IN}"


@query("r1_covered_cells", ctes("f_settlements", grid=GRID) + COVERED)
def cells(spark, sf):
    return covered_cells(vector_fixture(spark, sf, "f_settlements"), 100.0, ["sid", "country"])


@query(
    "r1_touched_cells",
    ctes("f_settlements", grid=GRID) + """SELECT s.sid, c.cx, c.cy FROM f_settlements s JOIN grid c ON
 s.xmin<=(c.cx+1)*100 AND c.cx*100<=s.xmax AND s.ymin<=(c.cy+1)*100 AND c.cy*100<=s.ymax AND c.cx=floor(greatest(c.cx*100,s.xmin)/100.0) AND c.cy=floor(greatest(c.cy*100,s.ymin)/100.0)
 AND (s.kind='rect' OR (greatest(c.cx*100,s.xmin)-s.xmin)*(s.ymax-s.ymin)+(greatest(c.cy*100,s.ymin)-s.ymin)*(s.xmax-s.xmin)<=(s.xmax-s.xmin)*(s.ymax-s.ymin))""",
)
def touched_cells(spark, sf):
    return covered_cells(vector_fixture(spark, sf, "f_settlements"), 100.0, ["sid"], all_touched=True)


@query(
    "a7_dissolved_area",
    ctes("f_settlements", grid=GRID, cov=COVERED) + "SELECT country, count(DISTINCT (cx, cy))*10000.0e0 AS area FROM cov GROUP BY 1",
)
def dissolved(spark, sf):
    return dissolved_area(vector_fixture(spark, sf, "f_settlements"), 100.0, ["country"])


@query(
    "j4_overlay_outlines",
    ctes("f_cities", "f_settlements", grid=GRID, cov=COVERED)
    + """SELECT v.sid, c.city, count(*)*10000.0e0 AS area FROM cov v JOIN f_cities c ON v.cx*100+50>=c.xmin AND v.cx*100+50<c.xmax AND v.cy*100+50>=c.ymin AND v.cy*100+50<c.ymax
 AND NOT (v.cx*100+50>=c.xmin+1730 AND v.cx*100+50<c.xmin+2530 AND v.cy*100+50>=c.ymin+1260) GROUP BY 1,2""",
)
def overlay_outlines(spark, sf):
    """Settlements cut by city outlines with a deep notch."""
    corners = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin + 2530", "ymax"), ("xmin + 2530", "ymin + 1260"), ("xmin + 1730", "ymin + 1260"), ("xmin + 1730", "ymax"), ("xmin", "ymax")]
    cities = fixture(spark, sf, "f_cities").selectExpr("city", f"{g.polygon(*[g.point(*c) for c in corners])} AS geom")
    return overlay_area(vector_fixture(spark, sf, "f_settlements"), cities, 100.0, ["sid"], ["city"])


@query(
    "x7_label_population_share",
    ctes("f_settlements", "f_pop", grid=GRID, cov=COVERED,
         b="SELECT country, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM f_settlements GROUP BY 1",
         t="SELECT b.country, sum(p.b1) AS v FROM b JOIN f_pop p ON p.px>=b.xmin AND p.px<b.xmax AND p.py>=b.ymin AND p.py<b.ymax GROUP BY 1",
         u="SELECT DISTINCT country, cx, cy FROM cov",
         i="SELECT u.country, sum(p.b1) AS v FROM u JOIN f_pop p ON p.px=u.cx*100+50 AND p.py=u.cy*100+50 GROUP BY 1")
    + """SELECT b.country AS city, b.country, coalesce(t.v,0) AS total_population, coalesce(t.v,0) AS formal_population, coalesce(i.v,0) AS informal_population,
 round(CASE WHEN coalesce(t.v,0)>0 THEN coalesce(i.v,0)/t.v ELSE 0 END,6) AS proportion_informal, 'HRSL' AS dataset_used
 FROM b LEFT JOIN t USING (country) LEFT JOIN i USING (country)""",
)
def label_share(spark, sf):
    from quartier.plans.population import label_population_share

    df = label_population_share(vector_fixture(spark, sf, "f_settlements"), fixture(spark, sf, "f_pop"), "country", 100.0)
    return df.selectExpr(
        "city", "country", "total_population", "formal_population", "informal_population",
        "round(proportion_informal,6) AS proportion_informal", "dataset_used",
    )


@query(
    "j1_settlement_overlaps",
    ctes("f_settlements", e="SELECT sid, xmin, ymin, xmax, ymax FROM f_settlements")
    + "SELECT a.sid AS a, b.sid AS b FROM e a JOIN e b ON a.sid<b.sid AND a.xmin<=b.xmax AND b.xmin<=a.xmax AND a.ymin<=b.ymax AND b.ymin<=a.ymax",
)
def overlaps(spark, sf):
    boxes_only = vector_fixture(spark, sf, "f_settlements").selectExpr("sid", f"{g.envelope('bbox')} AS geom", "bbox")
    return spatial_join(boxes_only, boxes_only, 300.0).where("l_sid < r_sid").selectExpr("l_sid AS a", "r_sid AS b")
