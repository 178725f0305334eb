"""Morphometrics, comparison, regions."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import query
from catalogue.grids import MODELS, score_tiles, settlement_mask
from catalogue.scratch import folder
from catalogue.shapes import COVERED, GRID
from catalogue.sql import ctes
from quartier.fixtures import fixture, vector_fixture
from quartier.functions import geometry as g
from quartier.operators import components, regions, skew, stats, tessellation
from quartier.plans import morphology, prediction
from quartier.session import materialise

MEASURES = morphology.MEASURES

# -- morphometrics: cells of 40 m, countries stand for cities ------------------------------------
RES = 40
FINE_IN = """(c.cx*40+20>=s.xmin AND c.cx*40+20<s.xmax AND c.cy*40+20>=s.ymin AND c.cy*40+20<s.ymax AND (s.kind='rect' OR
 (c.cx*40+20-s.xmin)*(s.ymax-s.ymin)+(c.cy*40+20-s.ymin)*(s.xmax-s.xmin)<(s.xmax-s.xmin)*(s.ymax-s.ymin)))"""
MEETS = """b.xmin<=s.xmax AND s.xmin<=b.xmax AND b.ymin<=s.ymax AND s.ymin<=b.ymax AND (s.kind='rect' OR
 (greatest(b.xmin,s.xmin)-s.xmin)*(s.ymax-s.ymin)+(greatest(b.ymin,s.ymin)-s.ymin)*(s.xmax-s.xmin)<=(s.xmax-s.xmin)*(s.ymax-s.ymin))"""
RECT_GAP = "sqrt(pow(greatest(p.xmin-q.xmax, q.xmin-p.xmax, 0),2)+pow(greatest(p.ymin-q.ymax, q.ymin-p.ymax, 0),2))"
TESS = {
    "built": f"SELECT DISTINCT s.country, b.id AS owner, b.xmin, b.ymin, b.xmax, b.ymax FROM f_buildings b JOIN f_settlements s ON {MEETS}",
    "fine": f"SELECT DISTINCT s.country, c.cx, c.cy FROM f_settlements s JOIN (SELECT a.i AS cx, b.i AS cy FROM range(0,640) a(i), range(0,640) b(i)) c ON {FINE_IN}",
    "cand": """SELECT f.country, f.cx, f.cy, b.owner, sqrt(pow(greatest(b.xmin-(f.cx*40+20), f.cx*40+20-b.xmax, 0),2)+pow(greatest(b.ymin-(f.cy*40+20), f.cy*40+20-b.ymax, 0),2)) AS d
 FROM fine f JOIN built b ON b.country=f.country""",
    "own": "SELECT country, cx, cy, owner FROM (SELECT *, row_number() OVER (PARTITION BY country, cx, cy ORDER BY d, owner) AS k FROM cand) WHERE k=1",
    "side": """SELECT a.country, a.owner AS a, b.owner AS b FROM own a JOIN own b ON b.country=a.country AND ((b.cx=a.cx+1 AND b.cy BETWEEN a.cy-1 AND a.cy+1) OR (b.cx=a.cx AND b.cy=a.cy+1)) WHERE a.owner<>b.owner""",
    "edge": "SELECT country, a, b FROM side UNION SELECT country, b, a FROM side",
    "two": "SELECT DISTINCT x.country, x.a, y.b FROM edge x JOIN edge y ON y.country=x.country AND y.a=x.b WHERE x.a<>y.b",
    "three": "SELECT DISTINCT x.country, x.a, y.b FROM two x JOIN edge y ON y.country=x.country AND y.a=x.b WHERE x.a<>y.b",
    "near": "SELECT * FROM edge UNION SELECT * FROM two UNION SELECT * FROM three",
    "touch": """SELECT p.country, p.owner AS a, q.owner AS b FROM built p JOIN built q ON q.country=p.country AND p.owner<>q.owner AND p.xmin<=q.xmax AND q.xmin<=p.xmax AND p.ymin<=q.ymax AND q.ymin<=p.ymax""",
}
COMP = """reach AS (SELECT country, owner AS a, owner AS b FROM built UNION SELECT r.country, r.a, t.b FROM reach r JOIN touch t ON t.country=r.country AND t.a=r.b),
 comp AS (SELECT country, a AS owner, min(b) AS component FROM reach GROUP BY 1,2)"""


def tess_ctes(*names, recursive=False):
    text = ctes("f_buildings", "f_settlements", **{k: v for k, v in TESS.items() if not names or k in names})
    if not recursive:
        return text
    return text.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + COMP + " "


def built(spark, sf):
    return morphology.buildings_in_areas(
        vector_fixture(spark, sf, "f_buildings"), vector_fixture(spark, sf, "f_settlements"), "country", 500.0
    )


def owned(spark, sf, buildings=None):
    areas = vector_fixture(spark, sf, "f_settlements")
    return morphology.tessellate(areas, buildings if buildings is not None else built(spark, sf), "country", float(RES))


@query("j13_nearest_owner", tess_ctes() + "SELECT country, cx, cy, owner FROM own")
def j13(spark, sf):
    return owned(spark, sf).select("country", "cx", "cy", "owner")


@query("a28_cell_areas", tess_ctes() + "SELECT country, owner, count(*)*1600.0e0 AS cell_area FROM own GROUP BY 1,2")
def a28(spark, sf):
    return tessellation.cell_areas(owned(spark, sf), ["country"], float(RES))


@query("j14_three_step_neighbours", tess_ctes() + "SELECT country, a, b FROM near")
def j14(spark, sf):
    return tessellation.within_steps(tessellation.contiguity(owned(spark, sf), ["country"]), ["country"], 3)


@query(
    "a30_neighbour_distance",
    tess_ctes() + f"""SELECT e.country, e.a AS owner, round(avg({RECT_GAP}),6) AS neighbour_distance FROM edge e JOIN built p ON p.country=e.country AND p.owner=e.a
 JOIN built q ON q.country=e.country AND q.owner=e.b GROUP BY 1,2""",
)
def a30(spark, sf):
    buildings = materialise(built(spark, sf))
    edges = tessellation.contiguity(owned(spark, sf, buildings), ["country"])
    return tessellation.neighbour_distance(edges, buildings, ["country"]).selectExpr(
        "country", "owner", "round(neighbour_distance,6) AS neighbour_distance"
    )


@query(
    "c1_touching_groups",
    ctes("f_settlements", t="""SELECT p.country, p.sid AS a, q.sid AS b FROM f_settlements p JOIN f_settlements q ON q.country=p.country AND p.sid<>q.sid
 AND p.xmin<=q.xmax AND q.xmin<=p.xmax AND p.ymin<=q.ymax AND q.ymin<=p.ymax""").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + """, r AS (SELECT country, a, a AS b FROM t UNION SELECT r.country, r.a, t.b FROM r JOIN t ON t.country=r.country AND t.a=r.b)
 SELECT country, a AS owner, min(b) AS component FROM r GROUP BY 1,2""",
)
def touching(spark, sf):
    outlines = vector_fixture(spark, sf, "f_settlements").selectExpr("country", "sid AS bid", f"{g.envelope('bbox')} AS geom", "bbox")
    return tessellation.touching_groups(outlines, ["country"], 500.0)


@query(
    "x8_morphometrics",
    tess_ctes(recursive=True) + f""", ca AS (SELECT country, owner, count(*)*1600.0e0 AS cell_area FROM own GROUP BY 1,2),
 mem AS (SELECT country, a, b FROM near UNION SELECT country, owner, owner FROM built),
 adj AS (SELECT m.country, m.a AS owner, count(DISTINCT c.component)/CAST(count(*) AS DOUBLE) AS adjacency FROM mem m JOIN comp c ON c.country=m.country AND c.owner=m.b GROUP BY 1,2),
 nd AS (SELECT e.country, e.a AS owner, avg({RECT_GAP}) AS nd FROM edge e JOIN built p ON p.country=e.country AND p.owner=e.a JOIN built q ON q.country=e.country AND q.owner=e.b GROUP BY 1,2)
 SELECT b.country, b.owner AS uid, round((b.xmax-b.xmin)*(b.ymax-b.ymin)/ca.cell_area,8) AS tessellation_car, CAST(2*(b.xmax-b.xmin+b.ymax-b.ymin) AS DOUBLE) AS buildings_wall,
 round(adj.adjacency,8) AS buildings_adjacency, round(nd.nd,6) AS buildings_neighbour_distance FROM built b LEFT JOIN ca USING (country, owner) LEFT JOIN adj USING (country, owner) LEFT JOIN nd USING (country, owner)""",
)
def x8(spark, sf):
    df = morphology.morphometrics(
        vector_fixture(spark, sf, "f_buildings"), vector_fixture(spark, sf, "f_settlements"), "country", float(RES)
    )
    return df.selectExpr(
        "country", "uid", "round(tessellation_car,8) AS tessellation_car", "buildings_wall",
        "round(buildings_adjacency,8) AS buildings_adjacency", "round(buildings_neighbour_distance,6) AS buildings_neighbour_distance",
    )


# -- comparison ----------------------------------------------------------------------------------
NAMES = {f"city_{i}": f"City {i}" for i in range(5)}
CHOSEN = ["city_0", "city_1", "city_2", "city_4"]


def clean_ctes():
    chosen = ", ".join(f"'{c}'" for c in CHOSEN)
    parts = {"k0": f"SELECT uid, replace(city, 'city_', 'City ') AS city, {', '.join(MEASURES)} FROM f_morpho WHERE city IN ({chosen})"}
    for i, m in enumerate(MEASURES):
        parts[f"k{i + 1}"] = (
            f"SELECT k.* FROM k{i} k JOIN (SELECT city, avg({m}) AS a, stddev_samp({m}) AS s FROM k{i} GROUP BY 1) l ON l.city=k.city"
            f" WHERE {m}>=a-3*s AND {m}<=a+3*s"
        )
    return parts


@query("x9_outliers_removed", ctes("f_morpho", **clean_ctes()) + f"SELECT city, count(*) AS n, {', '.join(f'round(max({m}),6) AS {m}' for m in MEASURES)} FROM k4 GROUP BY 1")
def outliers(spark, sf):
    df = fixture(spark, sf, "f_morpho")
    kept = stats.map_names(df.where(df.city.isin(CHOSEN)), "city", NAMES)
    kept = stats.drop_outliers(kept, ["city"], MEASURES)
    return kept.groupBy("city").agg(F.expr("count(1) AS n"), *[F.expr(f"round(max({m}),6) AS {m}") for m in MEASURES])


SCALED = "SELECT city, " + ", ".join(f"({m}-min({m}) OVER ())/(max({m}) OVER ()-min({m}) OVER ()) AS {m}" for m in MEASURES) + " FROM k4"
LONG = " UNION ALL ".join(f"SELECT city, '{morphology.MEASURE_NAMES[m]}' AS variable, {m} AS value FROM sc" for m in MEASURES)


@query("m18_scaled_measures", ctes("f_morpho", **clean_ctes(), sc=SCALED, lo=LONG) + "SELECT city, variable, count(*) AS n, round(sum(value),5) AS total, round(min(value),8) AS low, round(max(value),8) AS high FROM lo GROUP BY 1,2")
def scaled(spark, sf):
    long = morphology.comparable(fixture(spark, sf, "f_morpho"), CHOSEN, NAMES)
    return long.groupBy("city", "variable").agg(
        F.expr("count(1) AS n"), F.expr("round(sum(value),5) AS total"), F.expr("round(min(value),8) AS low"), F.expr("round(max(value),8) AS high")
    )


@query(
    "x9_a22_compared_morphometrics",
    ctes("f_morpho", **clean_ctes(), sc=SCALED, lo=LONG) + """SELECT city, variable, round(quantile_cont(value,0.1),8) AS low, round(quantile_cont(value,0.25),8) AS q1,
 round(quantile_cont(value,0.5),8) AS median, round(quantile_cont(value,0.75),8) AS q3, round(quantile_cont(value,0.9),8) AS high FROM lo GROUP BY 1,2""",
)
def compared(spark, sf):
    df = morphology.compare_morphometrics(fixture(spark, sf, "f_morpho"), CHOSEN, NAMES)
    return df.selectExpr("city", "variable", *[f"round({c},8) AS {c}" for c in ("low", "q1", "median", "q3", "high")])


@query(
    "a19_describe",
    ctes("f_morpho") + """SELECT city, count(buildings_neighbour_distance) AS count, round(avg(buildings_neighbour_distance),6) AS mean, round(stddev_samp(buildings_neighbour_distance),6) AS std,
 min(buildings_neighbour_distance) AS min, quantile_cont(buildings_neighbour_distance,0.25) AS q25, quantile_cont(buildings_neighbour_distance,0.5) AS q50,
 quantile_cont(buildings_neighbour_distance,0.75) AS q75, max(buildings_neighbour_distance) AS max FROM f_morpho GROUP BY 1""",
)
def describe(spark, sf):
    df = stats.describe(fixture(spark, sf, "f_morpho"), ["city"], "buildings_neighbour_distance")
    return df.selectExpr("city", "count", "round(mean,6) AS mean", "round(std,6) AS std", "min", "q25", "q50", "q75", "max")


@query(
    "a20_mean_and_std",
    ctes("f_morpho") + "SELECT city, round(avg(tessellation_car),4) AS tessellation_car_mean, round(stddev_samp(tessellation_car),4) AS tessellation_car_std FROM f_morpho GROUP BY 1",
)
def mean_std(spark, sf):
    df = stats.mean_and_std(fixture(spark, sf, "f_morpho"), ["city"], ["tessellation_car"])
    return df.selectExpr("city", "round(tessellation_car_mean,4) AS tessellation_car_mean", "round(tessellation_car_std,4) AS tessellation_car_std")


@query("a21_min_max", ctes("f_morpho") + "SELECT uid, round((tessellation_car-min(tessellation_car) OVER ())/(max(tessellation_car) OVER ()-min(tessellation_car) OVER ()),8) AS tessellation_car FROM f_morpho")
def min_max(spark, sf):
    df = stats.scale_columns(fixture(spark, sf, "f_morpho").select("uid", "tessellation_car"), ["tessellation_car"])
    return df.selectExpr("uid", "round(tessellation_car,8) AS tessellation_car")


# -- regions -------------------------------------------------------------------------------------
NEXT = "n.r BETWEEN s.r-1 AND s.r+1 AND n.c BETWEEN s.c-1 AND s.c+1"
REGION_CTES = ctes("f_settlements", grid=GRID, cov=COVERED, m="SELECT DISTINCT cx AS c, cy AS r FROM cov").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
 s(seed, r, c) AS (SELECT r*2147483648+c, r, c FROM m UNION SELECT s.seed, n.r, n.c FROM s JOIN m n ON {NEXT}),
 lab AS (SELECT r, c, min(seed) AS region FROM s GROUP BY 1,2) """


@query("c1_region_labels", REGION_CTES + "SELECT r AS prow, c AS pcol, region FROM lab")
def region_labels(spark, sf):
    return regions.label_regions(settlement_mask(spark, sf), ["scene"], 16).select("prow", "pcol", "region")


@query(
    "c1_region_table",
    REGION_CTES + "SELECT region, count(*) AS pixels, min(r) AS row_min, min(c) AS col_min, max(r) AS row_max, max(c) AS col_max FROM lab GROUP BY 1",
)
def region_table(spark, sf):
    return regions.region_table(regions.label_regions(settlement_mask(spark, sf), ["scene"], 16), ["scene"]).drop("scene")


@query("c1_region_outlines")
def outlines(spark, sf):
    polygons = regions.vectorize(settlement_mask(spark, sf), ["scene"], 16)
    return polygons.selectExpr("region", "size(geom.polys[0][0]) - 1 AS corners", f"{g.area('geom')} AS area", f"{g.perimeter('geom')} AS perimeter")


@query("x4_predicted_regions")
def predicted(spark, sf):
    _, labelled = prediction.predict(score_tiles(spark, sf), MODELS, ["logits"], ["city_id"], 8, kernel=2, block=16)
    scenes = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id DIV 100 AS city_id").distinct().selectExpr(
        "city_id", "1000D * city_id AS xmin", "5000D AS ymax", "10D AS res"
    )
    features = prediction.region_features(labelled, scenes, ["city_id"])
    return features.selectExpr("city_id", "region", f"{g.area('geom')} AS area", f"({g.bounds('geom')}).xmin AS x0")


def open_bright():
    import numpy as np

    return lambda batch: (np.stack(batch["b8"].to_numpy()).astype("float64") - 3600.5) / 1000


@query(
    "x4_city_chain",
    ctes("f_cities", "f_image_files", "f_obs", m="SELECT image_id, prow, pcol FROM f_obs WHERE b8>3600",
         z="""SELECT c.country, c.city, min(i.image_path) AS image_path FROM f_cities c LEFT JOIN f_image_files i
 ON starts_with(i.image_path, concat('img/', c.country, '_', c.city)) GROUP BY 1,2""").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
 s(img, seed, r, c) AS (SELECT image_id, prow*64+pcol, prow, pcol FROM m UNION SELECT s.img, s.seed, n.prow, n.pcol FROM s JOIN m n
  ON n.image_id=s.img AND n.prow BETWEEN s.r-1 AND s.r+1 AND n.pcol BETWEEN s.c-1 AND s.c+1),
 lab AS (SELECT img, r, c, min(seed) AS region FROM s GROUP BY 1,2,3),
 n AS (SELECT img, count(*) AS pixels, count(DISTINCT region) AS regions FROM lab GROUP BY 1)
 SELECT z.country, z.city, coalesce(n.pixels,0) AS pixels, coalesce(n.regions,0) AS regions, z.image_path IS NULL AS skipped
 FROM z LEFT JOIN n ON n.img=1+CAST(regexp_extract(z.image_path, '_([0-9]+)[.]tif', 1) AS BIGINT)%7""",
)
def city_chain(spark, sf):
    """Names to images, tiles, scores, smoothed masks, regions and the store, which is read back."""
    path = folder(spark, "chain")
    number = "CAST(regexp_extract(image_path, '_([0-9]+)[.]tif', 1) AS BIGINT)"
    cities = fixture(spark, sf, "f_cities").select("country", "city")
    images = fixture(spark, sf, "f_image_files")
    scenes = images.selectExpr(
        "image_path", f"1000D * ({number} % 20) AS xmin", "12000D AS ymax", "10D AS res", "64L AS height", "64L AS width"
    )
    pixels = images.selectExpr("image_path", f"1 + {number} % 7 AS image_id").join(
        fixture(spark, sf, "f_obs").select("image_id", "prow", "pcol", "b2", "b3", "b4", "b8"), "image_id"
    ).drop("image_id")
    buildings = vector_fixture(spark, sf, "f_buildings").withColumnRenamed("id", "order_id")
    skipped = prediction.predict_cities(
        cities, images, scenes, pixels, buildings, {"bright": open_bright}, ["b8", "buildings"], path, 1, "slums",
        16, 8, kernel=0, block=16, cell=1000.0, transform=lambda tiles, keys, bands: tiles,
    )
    keys = ["country", "city"]
    regions_ = prediction.merge_predictions(spark, path).groupBy(*keys).agg(F.expr("count(1) AS regions"))
    marked = spark.read.parquet(f"{path}/labels").where("m = 1").groupBy(*keys).agg(F.expr("count(1) AS pixels"))
    return cities.join(marked, keys, "left").join(regions_, keys, "left").join(
        skipped.selectExpr(*keys, "true AS _skipped"), keys, "left"
    ).selectExpr(*keys, "coalesce(pixels, 0) AS pixels", "coalesce(regions, 0) AS regions", "_skipped IS NOT NULL AS skipped")


@query(
    "w1_percentiles",
    ctes("f_pois") + "SELECT category, round(quantile_cont(x,0.1),6) AS p10, round(quantile_cont(x,0.5),6) AS p50, round(quantile_cont(x,0.9),6) AS p90 FROM f_pois GROUP BY 1",
)
def percentiles(spark, sf):
    q = skew.exact_percentiles(fixture(spark, sf, "f_pois"), ["category"], "x", [0.1, 0.5, 0.9])
    return q.groupBy("category").agg(*[F.expr(f"round(max(q) FILTER (WHERE p = {p}D),6) AS p{int(p * 100)}") for p in (0.1, 0.5, 0.9)])


@query(
    "c1_graph_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS a, -o_custkey AS b FROM orders),
 u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a, a AS b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a=r.b)
 SELECT a AS node, min(b) AS component FROM r GROUP BY 1""",
)
def graph_components(spark, sf):
    e = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS a", "-o_custkey AS b")
    return components.connected_components(e, "a", "b")
