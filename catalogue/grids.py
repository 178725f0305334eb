"""Tiles, splits, focal operators, composites, scoring and evaluation."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import query
from catalogue.sql import ctes
from quartier.fixtures import fixture, vector_fixture, with_box
from quartier.operators import focal, metrics, raster, scoring, tiles
from quartier.plans import composite as comp
from quartier.plans import evaluation, prediction, preparation, training

SC = ["scene"]


def starts(extent, size, stride, pad, first):
    return f"unnest(range({first}, {extent}+{pad}-{size}+1, {stride}))"


WINDOWS = """SELECT scene, (row_number() OVER (PARTITION BY scene ORDER BY ymin, xmin)-1) AS tile_idx, ymin, xmin, ymin+8 AS ymax, xmin+8 AS xmax FROM
 (SELECT scene, ymin, unnest(range({x0}, width+{pad}-7, 4)) AS xmin FROM (SELECT *, unnest(range({x0}, height+{pad}-7, 4)) AS ymin FROM f_scenes))"""


@query("r4_sliding_windows", ctes("f_scenes") + WINDOWS.format(x0=0, pad=0))
def r4(spark, sf):
    return tiles.sliding_windows(fixture(spark, sf, "f_scenes"), SC, 8, 4)


@query("r4_padded_windows", ctes("f_scenes") + WINDOWS.format(x0=-2, pad=2))
def r4_padded(spark, sf):
    return tiles.sliding_windows(fixture(spark, sf, "f_scenes"), SC, 8, 4, 2, "both")


AREAS = """SELECT scene, xmin, ymin, xmax, ymax FROM (SELECT scene, 5 AS xmin, 3 AS ymin, width-9 AS xmax, height-6 AS ymax FROM f_scenes
 UNION ALL SELECT scene, 0, 0, 12, 12 FROM f_scenes WHERE scene%2=0)"""


def in_areas(spark, sf, within):
    scenes = fixture(spark, sf, "f_scenes")
    boxes = scenes.selectExpr("scene", "5 AS xmin", "3 AS ymin", "width - 9 AS xmax", "height - 6 AS ymax").unionByName(
        scenes.where("scene % 2 = 0").selectExpr("scene", "0 AS xmin", "0 AS ymin", "12 AS xmax", "12 AS ymax")
    )
    windows = tiles.sliding_windows(scenes, SC, 8, 4)
    return tiles.windows_in_areas(windows, with_box(boxes), SC, within, 16.0)


@query(
    "r4_windows_in_areas",
    ctes("f_scenes", w=WINDOWS.format(x0=0, pad=0), a=AREAS)
    + "SELECT w.* FROM w WHERE EXISTS (SELECT 1 FROM a WHERE a.scene=w.scene AND w.xmin>=a.xmin AND w.xmax<=a.xmax AND w.ymin>=a.ymin AND w.ymax<=a.ymax)",
)
def r4_within(spark, sf):
    return in_areas(spark, sf, True)


@query(
    "r4_windows_meeting_areas",
    ctes("f_scenes", w=WINDOWS.format(x0=0, pad=0), a=AREAS)
    + "SELECT w.* FROM w WHERE EXISTS (SELECT 1 FROM a WHERE a.scene=w.scene AND w.xmin<=a.xmax AND w.xmax>=a.xmin AND w.ymin<=a.ymax AND w.ymax>=a.ymin)",
)
def r4_meeting(spark, sf):
    return in_areas(spark, sf, False)


GRIDS = """SELECT scene, (row_number() OVER (PARTITION BY scene ORDER BY ymin, xmin)-1) AS tile_idx, ymin, xmin, ymin+16 AS ymax, xmin+16 AS xmax FROM
 (SELECT scene, ymin, unnest(range(0, width, 16)) AS xmin FROM (SELECT *, unnest(range(0, height, 16)) AS ymin FROM f_scenes))"""
LABELS = "SELECT 1+o_orderkey%(SELECT count(*) FROM supplier) AS scene, o_custkey%56 AS prow, (o_orderkey*7)%66 AS pcol, max(CASE WHEN o_totalprice>300000 THEN 1 ELSE 0 END) AS class_id FROM orders GROUP BY 1,2,3"


def labels(spark, sf):
    n = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("count(1) AS n")
    return spark.read.parquet(f"{sf}/orders.parquet").withColumn("_n", n.scalar()).groupBy(
        F.expr("1 + o_orderkey % _n AS scene"), F.expr("o_custkey % 56 AS prow"), F.expr("(o_orderkey * 7) % 66 AS pcol")
    ).agg(F.expr("max(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END) AS class_id"))


@query(
    "r5_labelled_windows",
    ctes("f_scenes", w=GRIDS, l=LABELS)
    + "SELECT w.* FROM w WHERE EXISTS (SELECT 1 FROM l WHERE l.scene=w.scene AND l.class_id<>0 AND l.prow>=w.ymin AND l.prow<w.ymax AND l.pcol>=w.xmin AND l.pcol<w.xmax)",
)
def r5(spark, sf):
    windows = tiles.grid_windows(fixture(spark, sf, "f_scenes"), SC, 16)
    return tiles.labelled_windows(windows, labels(spark, sf), SC, 16)


@query(
    "a11_tiles_with_label",
    ctes(l=LABELS) + "SELECT scene, prow//16*16 AS ymin, pcol//16*16 AS xmin, bool_or(class_id<>0) AS has_label FROM l GROUP BY 1,2,3",
)
def a11(spark, sf):
    return tiles.tile_has_label(labels(spark, sf), SC, 16)


@query(
    "r7_aligned_tiles",
    ctes("f_scenes", a=WINDOWS.format(x0=0, pad=0)) + """SELECT scene, tile_idx, ymin, xmin, 2*ymin AS b_ymin, 2*xmin AS b_xmin FROM a""",
)
def r7(spark, sf):
    scenes = fixture(spark, sf, "f_scenes")
    fine = scenes.selectExpr("scene", "2 * height AS height", "2 * width AS width")
    pairs = tiles.align_tiles(tiles.sliding_windows(scenes, SC, 8, 4), tiles.sliding_windows(fine, SC, 16, 8), SC)
    return pairs.select("scene", "tile_idx", "ymin", "xmin", "b_ymin", "b_xmin")


@query(
    "f10_equal_tile_counts",
    ctes("f_scenes") + """SELECT scene, ((height-8)//4+1)*((width-8)//4+1) AS n_image, ((height-16)//8+1)*((width-16)//8+1) AS n_buildings FROM f_scenes
 WHERE ((height-8)//4+1)*((width-8)//4+1)=((height-16)//8+1)*((width-16)//8+1)
 UNION ALL SELECT -scene-1, ((height-8)//4+1)*((width-8)//4+1), ((2*height-16)//8+1)*((2*width-16)//8+1) FROM f_scenes""",
)
def f10(spark, sf):
    scenes = fixture(spark, sf, "f_scenes")
    coarse = tiles.sliding_windows(scenes, SC, 8, 4)
    same = tiles.sliding_windows(scenes, SC, 16, 8)
    fine = tiles.sliding_windows(scenes.selectExpr("-scene-1 AS scene", "2 * height AS height", "2 * width AS width"), SC, 16, 8)
    image = coarse.unionByName(coarse.selectExpr("-scene-1 AS scene", *[c for c in coarse.columns if c != "scene"]))
    return tiles.equal_tile_counts(image, same.unionByName(fine), SC)


RANK = """SELECT *, row_number() OVER (PARTITION BY scene ORDER BY md5(concat_ws('|','42',CAST(scene AS VARCHAR),CAST(tile_idx AS VARCHAR))), tile_idx)-1 AS pos,
 count(*) OVER (PARTITION BY scene) AS n FROM w"""
FOLDS = """SELECT scene, tile_idx, CASE WHEN pos<nt THEN NULL ELSE CAST((pos-nt)*1 AS BIGINT) END AS p, n-nt AS m, nt FROM (SELECT *, CAST(ceil(0.1e0*n) AS BIGINT) AS nt FROM r)"""
FOLD = "SELECT scene, tile_idx, CAST(CASE WHEN p IS NULL THEN NULL WHEN p<(m%3)*(m//3+1) THEN p//(m//3+1) ELSE m%3+(p-(m%3)*(m//3+1))//(m//3) END AS INT) AS fold FROM f"
FOLD_CTES = ctes("f_scenes", w=WINDOWS.format(x0=0, pad=0), r=RANK, f=FOLDS, d=FOLD)


def folds(spark, sf):
    windows = tiles.sliding_windows(fixture(spark, sf, "f_scenes"), SC, 8, 4).select("scene", "tile_idx")
    return tiles.fold_split(windows, SC, 3, 0.1)


@query("w3_w4_fold_split", FOLD_CTES + "SELECT scene, tile_idx, fold FROM d")
def w3(spark, sf):
    return folds(spark, sf)


LABELLED = "SELECT scene, tile_idx, CASE WHEN fold IS NULL THEN 'test' WHEN fold=1 THEN 'val' ELSE 'train' END AS split FROM d"


@query("j12_split_labels", FOLD_CTES + LABELLED)
def j12(spark, sf):
    return tiles.split_label(folds(spark, sf), 1)


@query(
    "j12_membership_labels",
    ctes("f_tiles", a="SELECT city_id, tile_idx, CASE WHEN label=1 THEN 'train' ELSE 'val' END AS split FROM f_tiles JOIN embeddings ON vec_id=tile_id WHERE label<3")
    + "SELECT t.city_id, t.tile_idx, coalesce(a.split,'test') AS split FROM f_tiles t LEFT JOIN a USING (city_id, tile_idx)",
)
def j12_membership(spark, sf):
    all_tiles = fixture(spark, sf, "f_tiles").select("tile_id", "city_id", "tile_idx")
    assigned = all_tiles.join(spark.read.parquet(f"{sf}/embeddings.parquet").where("label < 3"), F.expr("tile_id = vec_id")).selectExpr(
        "city_id", "tile_idx", "CASE WHEN label = 1 THEN 'train' ELSE 'val' END AS split"
    )
    return tiles.label_by_membership(all_tiles.drop("tile_id"), assigned, ["city_id", "tile_idx"])


@query("w2_split_blocks", FOLD_CTES.rstrip() + f", s AS ({LABELLED}) " + "SELECT scene, CAST(sum(count(*)) OVER (ORDER BY scene)-count(*) AS BIGINT) AS start, count(*) AS length FROM s WHERE split='val' GROUP BY scene")
def w2(spark, sf):
    return tiles.split_blocks(tiles.split_label(folds(spark, sf), 1), "scene")


@query("u4_f11_split_sizes", FOLD_CTES.rstrip() + f", s AS ({LABELLED}) " + "SELECT scene, split, count(*) AS num_samples FROM s GROUP BY 1,2")
def u4(spark, sf):
    return tiles.non_empty_splits(tiles.split_label(folds(spark, sf), 1), "scene")


@query(
    "w5_ratio_split",
    ctes("f_scenes", w=WINDOWS.format(x0=0, pad=0), r=RANK)
    + "SELECT scene, tile_idx, CASE WHEN pos<floor(0.2e0*n) THEN 'val' WHEN pos<floor(0.2e0*n)+floor(0.3e0*n) THEN 'test' ELSE 'train' END AS split FROM r",
)
def w5(spark, sf):
    windows = tiles.sliding_windows(fixture(spark, sf, "f_scenes"), SC, 8, 4).select("scene", "tile_idx")
    return tiles.ratio_split(windows, SC, 0.2, 0.3)


@query("r6_tile_subset", FOLD_CTES + "SELECT w.* FROM w JOIN d USING (scene, tile_idx) WHERE fold=0")
def r6(spark, sf):
    windows = tiles.sliding_windows(fixture(spark, sf, "f_scenes"), SC, 8, 4)
    return tiles.subset(windows, folds(spark, sf).where("fold = 0"), ["scene", "tile_idx"])


# scenes of 64 x 64 pixels of 10 m, one per image number
SCENE7 = "SELECT DISTINCT l_linenumber AS city, 2000.0e0*l_linenumber AS xmin, 12000.0e0 AS ymax, 10.0e0 AS res, 64 AS height, 64 AS width FROM lineitem"


def scenes7(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_linenumber AS city", "2000D * l_linenumber AS xmin", "12000D AS ymax", "10D AS res", "64L AS height", "64L AS width"
    ).distinct()


BURN = """SELECT z.city, p.i AS prow, q.i AS pcol, arg_max(1+s.sid%2, s.sid) AS class_id FROM z JOIN f_settlements s
 ON s.xmin<=z.xmin+640 AND s.xmax>=z.xmin AND s.ymin<=12000 AND s.ymax>=12000-640 JOIN range(0,64) p(i) ON true JOIN range(0,64) q(i)
 ON z.xmin+(q.i+0.5e0)*10>=s.xmin AND z.xmin+(q.i+0.5e0)*10<s.xmax AND 12000-(p.i+0.5e0)*10>=s.ymin AND 12000-(p.i+0.5e0)*10<s.ymax AND (s.kind='rect' OR
 (z.xmin+(q.i+0.5e0)*10-s.xmin)*(s.ymax-s.ymin)+(12000-(p.i+0.5e0)*10-s.ymin)*(s.xmax-s.xmin)<(s.xmax-s.xmin)*(s.ymax-s.ymin)) GROUP BY 1,2,3"""
BURN_CTES = ctes("f_settlements", z=SCENE7, burn=BURN)


def burned(spark, sf, **options):
    areas = vector_fixture(spark, sf, "f_settlements").selectExpr("sid AS order_id", "geom", "bbox", "1 + sid % 2 AS class_id")
    scenes = scenes7(spark, sf)
    return raster.rasterize(preparation.scene_features(areas, scenes, "city", 1000.0), scenes, "city", "order_id", **options)


@query("r1_rasterize", BURN_CTES + "SELECT * FROM burn")
def r1(spark, sf):
    return burned(spark, sf)


FULL = """SELECT z.city, p.i AS prow, q.i AS pcol, coalesce(b.class_id, 0) AS class_id FROM z CROSS JOIN range(0,64) p(i) CROSS JOIN range(0,64) q(i)
 LEFT JOIN burn b ON b.city=z.city AND b.prow=p.i AND b.pcol=q.i"""


@query("r3_r17_label_image", BURN_CTES + FULL)
def r3(spark, sf):
    grid = raster.scene_grid(scenes7(spark, sf), "city")
    return raster.fill_grid(grid, burned(spark, sf), ["city", "prow", "pcol"], "class_id")


@query("r2_r8_window_chip", BURN_CTES.rstrip() + f", full_image AS ({FULL}) " + "SELECT * FROM full_image WHERE prow>=10 AND prow<42 AND pcol>=20 AND pcol<52")
def r2(spark, sf):
    grid = raster.window_pixels(raster.scene_grid(scenes7(spark, sf), "city"), 10, 20, 32, 32)
    return raster.fill_grid(grid, burned(spark, sf, window=(10, 20, 32, 32)), ["city", "prow", "pcol"], "class_id")


@query(
    "r9_resized_chip",
    ctes("f_obs") + """SELECT o.image_id, r.i AS orow, c.i AS ocol, o.b8 FROM range(0,96) r(i), range(0,40) c(i), f_obs o WHERE o.prow=r.i*64//96 AND o.pcol=c.i*64//40""",
)
def r9(spark, sf):
    return raster.resize_nearest(fixture(spark, sf, "f_obs").select("image_id", "prow", "pcol", "b8"), 64, 64, 96, 40).select(
        "image_id", "orow", "ocol", "b8"
    )


@query("r10_flipped", ctes("f_obs") + "SELECT image_id, 63-prow AS prow, 63-pcol AS pcol, b8 FROM f_obs")
def r10(spark, sf):
    return raster.flip(fixture(spark, sf, "f_obs").select("image_id", "prow", "pcol", "b8"), 64, 64)


@query("r12_resampled", ctes("f_obs") + "SELECT image_id, prow//4 AS prow, pcol//4 AS pcol, avg(b8) AS b8 FROM f_obs GROUP BY 1,2,3")
def r12(spark, sf):
    return raster.resample(fixture(spark, sf, "f_obs"), 4, ["image_id"], "b8", "avg")


# cloud and shadow chain
CLOUDS = "SELECT *, CAST(probability>50 AS INT) AS clouds FROM f_obs"
COARSE = "SELECT image_id, prow//4 AS r, pcol//4 AS c, max(clouds) AS v FROM k GROUP BY 1,2,3"
TRACE = """SELECT DISTINCT q.image_id, CAST(q.r-round(s.i*sin(radians(90-m.azimuth))) AS BIGINT) AS r, CAST(q.c+round(s.i*cos(radians(90-m.azimuth))) AS BIGINT) AS c
 FROM coarse q JOIN f_images m USING (image_id), range(0,4) s(i) WHERE q.v=1"""
SHADOW = """SELECT k.*, CAST(b8<1500 AS INT) AS dark_pixels, CASE WHEN t.r IS NULL THEN 0 ELSE 1 END AS cloud_transform,
 CASE WHEN t.r IS NULL THEN 0 ELSE CAST(b8<1500 AS INT) END AS shadows FROM k LEFT JOIN trace t ON t.image_id=k.image_id AND t.r=k.prow//4 AND t.c=k.pcol//4"""
FLAG = "SELECT image_id, prow//2 AS r, pcol//2 AS c, max(CAST(clouds+shadows>0 AS INT)) AS v FROM sh GROUP BY 1,2,3"


def near(table, func, r2):
    return f"""SELECT a.image_id, a.r, a.c, {func}(b.v) AS v FROM {table} a JOIN {table} b ON b.image_id=a.image_id AND b.r BETWEEN a.r-2 AND a.r+2 AND b.c BETWEEN a.c-2 AND a.c+2
 AND (a.r-b.r)*(a.r-b.r)+(a.c-b.c)*(a.c-b.c)<={r2} GROUP BY 1,2,3"""


MASKED = """SELECT sh.*, grown.v AS cloudmask FROM sh JOIN grown ON grown.image_id=sh.image_id AND grown.r=sh.prow//2 AND grown.c=sh.pcol//2"""
CLOUD_CTES = ctes("f_obs", "f_images", k=CLOUDS, coarse=COARSE, trace=TRACE, sh=SHADOW, flag=FLAG, shrunk=near("flag", "min", 4), grown=near("shrunk", "max", 1), masked=MASKED)


def shadowed(spark, sf):
    obs, images = fixture(spark, sf, "f_obs"), fixture(spark, sf, "f_images")
    return comp.add_shadows(comp.add_clouds(obs), images, 4, 3)


@query("r13_cloud_band", CLOUD_CTES + "SELECT image_id, prow, pcol, probability, clouds FROM k")
def r13(spark, sf):
    return comp.add_clouds(fixture(spark, sf, "f_obs")).select("image_id", "prow", "pcol", "probability", "clouds")


@query("w8_cloud_projection", CLOUD_CTES + "SELECT image_id, r AS prow, c AS pcol FROM trace")
def w8(spark, sf):
    clouds = comp.add_clouds(fixture(spark, sf, "f_obs")).where("clouds = 1")
    coarse = raster.resample(clouds, 4, ["image_id"], "clouds", "max").join(fixture(spark, sf, "f_images"), "image_id")
    return focal.project_mask(coarse, ["image_id", "azimuth"], "90 - azimuth", 3).drop("azimuth")


@query("r14_shadow_bands", CLOUD_CTES + "SELECT image_id, prow, pcol, dark_pixels, cloud_transform, shadows FROM sh")
def r14(spark, sf):
    return shadowed(spark, sf).select("image_id", "prow", "pcol", "dark_pixels", "cloud_transform", "shadows")


@query("w6_focal_min", CLOUD_CTES + "SELECT image_id, r AS prow, c AS pcol, v FROM shrunk")
def w6(spark, sf):
    flag = shadowed(spark, sf).selectExpr("image_id", "prow", "pcol", "CAST(clouds + shadows > 0 AS INT) AS v")
    return focal.focal(raster.resample(flag, 2, ["image_id"], "v", "max"), ["image_id"], "v", 2, "min")


@query("r15_cloud_shadow_mask", CLOUD_CTES + "SELECT image_id, prow, pcol, cloudmask FROM masked")
def r15(spark, sf):
    return comp.add_mask(shadowed(spark, sf)).select("image_id", "prow", "pcol", "cloudmask")


@query(
    "r16_masked_bands",
    CLOUD_CTES + """SELECT image_id, prow, pcol, CASE WHEN cloudmask=0 THEN b2 END AS b2, CASE WHEN cloudmask=0 THEN b3 END AS b3,
 CASE WHEN cloudmask=0 THEN b4 END AS b4, CASE WHEN cloudmask=0 THEN b8 END AS b8 FROM masked""",
)
def r16(spark, sf):
    return comp.apply_mask(comp.add_mask(shadowed(spark, sf)), ["image_id", "prow", "pcol"])


@query("a8_median_composite", ctes("f_obs") + "SELECT prow, pcol, median(b2) AS b2, median(b8) AS b8 FROM f_obs GROUP BY 1,2")
def a8(spark, sf):
    return fixture(spark, sf, "f_obs").groupBy("prow", "pcol").agg(F.median("b2").alias("b2"), F.median("b8").alias("b8"))


@query(
    "x1_composite",
    CLOUD_CTES + """SELECT prow, pcol, median(CASE WHEN cloudmask=0 THEN b2 END) AS b2, median(CASE WHEN cloudmask=0 THEN b3 END) AS b3,
 median(CASE WHEN cloudmask=0 THEN b4 END) AS b4, median(CASE WHEN cloudmask=0 THEN b8 END) AS b8 FROM masked
 JOIN f_images i ON i.image_id=masked.image_id AND i.cloud_pct<=15 GROUP BY 1,2""",
)
def x1(spark, sf):
    from quartier.sources.imagery import filter_images

    images = filter_images(fixture(spark, sf, "f_images"))
    return comp.composite(images, fixture(spark, sf, "f_obs"), shadow_factor=4, shadow_steps=3)


# opening of the settlement mask on the 100 m grid
from catalogue.shapes import COVERED, GRID  # noqa: E402

CELLS = "SELECT DISTINCT cx AS c, cy AS r FROM cov"
OPEN_CTES = ctes(
    "f_settlements", grid=GRID, cov=COVERED, m=CELLS,
    e="""SELECT a.r, a.c FROM m a JOIN m b ON b.r BETWEEN a.r-1 AND a.r+1 AND b.c BETWEEN a.c-1 AND a.c+1 GROUP BY 1,2 HAVING count(*)=9""",
    o="SELECT DISTINCT e.r+i.i AS r, e.c+j.i AS c FROM e, range(-1,2) i(i), range(-1,2) j(i)",
)


def settlement_mask(spark, sf):
    cells = raster.dissolve_cells(vector_fixture(spark, sf, "f_settlements"), 100.0)
    return cells.selectExpr("0 AS scene", "cy AS prow", "cx AS pcol")


@query("w7_sparse_opening", OPEN_CTES + "SELECT r AS prow, c AS pcol FROM o")
def w7(spark, sf):
    return focal.sparse_opening(settlement_mask(spark, sf), SC, 3).select("prow", "pcol")


TILE_PIXELS = """SELECT t.city_id, t.tile_idx, t.row0+u.i//8 AS prow, t.col0+u.i%8 AS pcol, CAST(t.logits[u.i+1] AS DOUBLE) AS z FROM f_tiles t, range(0,64) u(i)"""
TRUTH = "CASE WHEN (prow*31+pcol*17)%10<4 THEN 1 ELSE 0 END"
SMOOTH = "SELECT city_id, prow, pcol, avg((1/(1+exp(-z))+1/(1+exp(-(-0.5e0*z+0.1e0))))/2) AS score FROM px GROUP BY 1,2,3"
TILE_CTES = ctes("f_tiles", px=TILE_PIXELS, sm=SMOOTH, mask="SELECT city_id, prow, pcol, CAST(score>0.5 AS INT) AS m FROM sm")


@query("w7_dense_opening", TILE_CTES.rstrip() + """, e AS (SELECT a.city_id, a.prow, a.pcol FROM mask a JOIN mask b ON b.city_id=a.city_id AND b.m=1 AND b.prow BETWEEN a.prow-1 AND a.prow
 AND b.pcol BETWEEN a.pcol-1 AND a.pcol GROUP BY 1,2,3 HAVING count(*)=4), o AS (SELECT DISTINCT city_id, prow-i.i AS prow, pcol-j.i AS pcol FROM e, range(0,2) i(i), range(0,2) j(i))
 SELECT mask.city_id, mask.prow, mask.pcol, CASE WHEN o.prow IS NULL THEN 0 ELSE 1 END AS m FROM mask LEFT JOIN o USING (city_id, prow, pcol)""")
def w7_dense(spark, sf):
    return focal.opening(stitched(spark, sf), ["city_id"], "m", 2)


def open_identity():
    import numpy as np

    return lambda batch: np.stack(batch["logits"].to_numpy()).astype("float64")


def open_second():
    import numpy as np

    return lambda batch: -0.5 * np.stack(batch["logits"].to_numpy()).astype("float64") + 0.1


MODELS = {"first": open_identity, "second": open_second}
TK = ["city_id", "tile_idx"]


def score_tiles(spark, sf):
    return fixture(spark, sf, "f_tiles")


def stitched(spark, sf):
    t = score_tiles(spark, sf)
    return prediction.stitched_mask(t, prediction.ensemble_scores(t, MODELS, ["logits"], TK), ["city_id"], 8)


@query(
    "x3_scored_tiles",
    ctes("f_tiles", px=TILE_PIXELS.replace("SELECT t.city_id", "SELECT u.i, t.city_id")) + "SELECT city_id, tile_idx, i, round(1/(1+exp(-z)),9) AS score FROM px",
)
def x3(spark, sf):
    scored = scoring.score_tiles(score_tiles(spark, sf), open_identity, ["logits"], TK)
    return scored.selectExpr(*TK, "posexplode(scores) AS (i, score)").selectExpr(*TK, "CAST(i AS BIGINT) AS i", "round(score,9) AS score")


@query(
    "a13_ensemble_mean",
    ctes("f_tiles", px=TILE_PIXELS.replace("SELECT t.city_id", "SELECT u.i, t.city_id"))
    + "SELECT city_id, tile_idx, i, round((1/(1+exp(-z))+1/(1+exp(-(-0.5e0*z+0.1e0))))/2,9) AS score FROM px",
)
def a13(spark, sf):
    mean = prediction.ensemble_scores(score_tiles(spark, sf), MODELS, ["logits"], TK)
    return mean.selectExpr(*TK, "posexplode(scores) AS (i, score)").selectExpr(*TK, "CAST(i AS BIGINT) AS i", "round(score,9) AS score")


@query("a12_smoothed_scores", TILE_CTES + "SELECT city_id, prow, pcol, round(score,9) AS score FROM sm")
def a12(spark, sf):
    t = score_tiles(spark, sf)
    scores = prediction.ensemble_scores(t, MODELS, ["logits"], TK)
    placed = t.select(*TK, "row0", "col0").join(scores, TK)
    return scoring.smooth(scoring.explode_scores(placed, ["city_id"], 8), ["city_id"]).selectExpr(
        "city_id", "prow", "pcol", "round(score,9) AS score"
    )


@query("m9_r18_discrete_mask", TILE_CTES + "SELECT * FROM mask")
def m9(spark, sf):
    return stitched(spark, sf)


def truth_pixels(df):
    return df.selectExpr("*", "CASE WHEN (prow * 31 + pcol * 17) % 10 < 4 THEN 1 ELSE 0 END AS truth")


def logit_pixels(spark, sf):
    t = score_tiles(spark, sf)
    return truth_pixels(scoring.explode_scores(t, TK, 8, scores="logits").withColumnRenamed("score", "logit"))


IMAGE_METRICS = f"""SELECT city_id, tile_idx, (tp+1e-6)/(pp+ap-tp+1e-6) AS iou, tp/(pp+1e-10) AS precision, tp/(ap+1e-10) AS recall FROM (SELECT city_id, tile_idx,
 CAST(count(*) FILTER (WHERE z>0 AND {TRUTH}=1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE z>0) AS DOUBLE) AS pp, CAST(count(*) FILTER (WHERE {TRUTH}=1) AS DOUBLE) AS ap FROM px GROUP BY 1,2)"""


@query(
    "a14_a15_image_metrics",
    ctes("f_tiles", px=TILE_PIXELS, im=IMAGE_METRICS) + """SELECT city_id, tile_idx, round(iou,9) AS iou, round(precision,9) AS precision, round(recall,9) AS recall,
 round(2*precision*recall/(precision+recall+1e-10),9) AS f1 FROM im""",
)
def a14(spark, sf):
    px = logit_pixels(spark, sf).selectExpr("*", "CAST(logit > 0 AS INT) AS pred")
    return metrics.image_metrics(px, TK).selectExpr(*TK, *[f"round({m},9) AS {m}" for m in ("iou", "precision", "recall", "f1")])


@query(
    "a15_macro_metrics",
    ctes("f_tiles", px=TILE_PIXELS, im=IMAGE_METRICS) + """SELECT city_id, round(avg(iou),8) AS iou, round(avg(precision),8) AS precision, round(avg(recall),8) AS recall,
 round(avg(2*precision*recall/(precision+recall+1e-10)),8) AS f1 FROM im GROUP BY 1""",
)
def a15(spark, sf):
    px = logit_pixels(spark, sf).selectExpr("*", "CAST(logit > 0 AS INT) AS pred")
    means = metrics.mean_metrics(metrics.image_metrics(px, TK), ["city_id"])
    return means.selectExpr("city_id", *[f"round({m},8) AS {m}" for m in ("iou", "precision", "recall", "f1")])


CLASS = f"""SELECT city_id, count(*) FILTER (WHERE m=1 AND {TRUTH}=1) AS tp, count(*) FILTER (WHERE m=1 AND {TRUTH}=0) AS fp, count(*) FILTER (WHERE m=0 AND {TRUTH}=1) AS fn FROM mask GROUP BY 1"""
RATES = "SELECT *, tp/nullif(tp+fp,0) AS precision, tp/nullif(tp+fn,0) AS recall FROM cl"
CITY = """SELECT r.*, 2*precision*recall/nullif(precision+recall,0) AS f1, n.num_tiles FROM ra r JOIN (SELECT city_id, count(*) AS num_tiles FROM f_tiles GROUP BY 1) n USING (city_id)"""
EVAL_CTES = TILE_CTES.rstrip() + f", cl AS ({CLASS}), ra AS ({RATES}), ev AS ({CITY}) "


def evaluated(spark, sf):
    pred = stitched(spark, sf).withColumnRenamed("m", "pred")
    truth = truth_pixels(pred.select("city_id", "prow", "pcol"))
    return evaluation.evaluate(pred, truth, score_tiles(spark, sf), "city_id")


@query("a16_x6_city_metrics", EVAL_CTES + "SELECT city_id, tp, fp, fn, round(precision,9) AS precision, round(recall,9) AS recall, round(f1,9) AS f1, num_tiles FROM ev")
def a16(spark, sf):
    return evaluated(spark, sf).selectExpr(
        "city_id", "tp", "fp", "fn", "round(precision,9) AS precision", "round(recall,9) AS recall", "round(f1,9) AS f1", "num_tiles"
    )


UNDEFINED = "SELECT city_id, num_tiles, CASE WHEN city_id%4<>1 THEN f1 END AS f1, precision, recall FROM ev"
VALID = "f1 IS NOT NULL AND precision IS NOT NULL AND recall IS NOT NULL"


def with_undefined(spark, sf):
    return evaluated(spark, sf).selectExpr("city_id", "num_tiles", "CASE WHEN city_id % 4 <> 1 THEN f1 END AS f1", "precision", "recall")


def weighted(total):
    parts = ", ".join(f"round(sum({m}*num_tiles) FILTER (WHERE {VALID})/{total},9) AS {m}" for m in ("f1", "precision", "recall"))
    return EVAL_CTES.rstrip() + f", un AS ({UNDEFINED}) SELECT {parts} FROM un"


@query("a17_weighted_mean", weighted(f"sum(num_tiles) FILTER (WHERE {VALID})"))
def a17(spark, sf):
    return metrics.weighted_mean(with_undefined(spark, sf)).selectExpr(*[f"round({m},9) AS {m}" for m in ("f1", "precision", "recall")])


@query("a17_weighted_mean_all_tiles", weighted("sum(num_tiles)"))
def a17_compat(spark, sf):
    means = metrics.weighted_mean(with_undefined(spark, sf), compat=True)
    return means.selectExpr(*[f"round({m},9) AS {m}" for m in ("f1", "precision", "recall")])


@query("a18_unweighted_mean", EVAL_CTES.rstrip() + f", un AS ({UNDEFINED}) SELECT round(avg(f1),9) AS f1, round(avg(precision),9) AS precision, round(avg(recall),9) AS recall FROM un WHERE {VALID}")
def a18(spark, sf):
    return metrics.unweighted_mean(with_undefined(spark, sf)).selectExpr(*[f"round({m},9) AS {m}" for m in ("f1", "precision", "recall")])


@query(
    "a25_weighted_loss",
    ctes("f_tiles", px=TILE_PIXELS) + f"SELECT city_id, round(avg(-(2.0e0*{TRUTH}*ln(1/(1+exp(-z)))+(1-{TRUTH})*ln(1-1/(1+exp(-z))))),8) AS loss FROM px GROUP BY 1",
)
def a25(spark, sf):
    return metrics.mean_loss(logit_pixels(spark, sf), ["city_id"]).selectExpr("city_id", "round(loss,8) AS loss")


UNSEEN = f"""SELECT f.city_id, f.fold AS split, count(*) FILTER (WHERE p.z>CASE f.fold WHEN 0 THEN 0 ELSE 0.05e0 END AND {TRUTH}=1) AS tp,
 count(*) FILTER (WHERE p.z>CASE f.fold WHEN 0 THEN 0 ELSE 0.05e0 END AND {TRUTH}=0) AS fp, count(*) FILTER (WHERE p.z<=CASE f.fold WHEN 0 THEN 0 ELSE 0.05e0 END AND {TRUTH}=1) AS fn,
 count(DISTINCT p.tile_idx) AS num_tiles FROM fo f JOIN px p ON p.city_id=f.city_id AND p.tile_idx=f.tile_idx WHERE f.fold IS NOT NULL GROUP BY 1,2"""


def city_folds(sql_of_tiles):
    rank = RANK.replace("scene", "city_id").replace("FROM w", f"FROM ({sql_of_tiles})")
    fold = FOLD.replace("scene", "city_id").replace("%3", "%2").replace("//3", "//2")
    return {"r": rank, "f": FOLDS.replace("scene", "city_id"), "fo": fold}


@query(
    "x6_unseen_folds",
    ctes("f_tiles", px=TILE_PIXELS, **city_folds("SELECT city_id, tile_idx FROM f_tiles"), un=UNSEEN) + "SELECT city_id, split, tp, fp, fn, num_tiles FROM un",
)
def x6_unseen(spark, sf):
    base = logit_pixels(spark, sf).selectExpr("*", "row_number() OVER (PARTITION BY city_id, tile_idx ORDER BY prow, pcol) AS i")
    pred = base.selectExpr(*TK, "i", "0 AS split", "CAST(logit > 0 AS INT) AS pred").unionByName(
        base.selectExpr(*TK, "i", "1 AS split", "CAST(logit > 0.05D AS INT) AS pred")
    )
    fold = tiles.fold_split(score_tiles(spark, sf).select(*TK), ["city_id"], 2, 0.1)
    done = evaluation.evaluate_unseen(pred, base.select(*TK, "i", "truth"), fold, TK)
    return done.select("city_id", "split", "tp", "fp", "fn", "num_tiles")


NORM = """SELECT image_id, prow, pcol, prow//16 AS tr, pcol//16 AS tc, {b}, ({b}-{m})/{s} AS z FROM f_obs"""


@query(
    "m14_normalised_bands",
    ctes("f_obs", z="SELECT *, prow//16 AS tr, pcol//16 AS tc, (b8-2581.270e0)/586.279e0 AS z8, (b2-934.346e0)/244.423e0 AS z2 FROM f_obs",
         d="SELECT image_id, tr, tc, stddev_pop(z8) AS s8, stddev_pop(z2) AS s2 FROM z GROUP BY 1,2,3")
    + """SELECT image_id, prow, pcol, round(CASE WHEN b8=0 THEN 0 WHEN s8<>0 THEN z8/s8 END,6) AS b8, round(CASE WHEN b2=0 THEN 0 WHEN s2<>0 THEN z2/s2 END,6) AS b2
 FROM z JOIN d USING (image_id, tr, tc)""",
)
def m14(spark, sf):
    px = fixture(spark, sf, "f_obs").selectExpr("image_id", "prow DIV 16 AS tr", "pcol DIV 16 AS tc", "prow", "pcol", "b8", "b2")
    done = scoring.normalise_bands(px, ["image_id", "tr", "tc"], ["b8", "b2"])
    return done.selectExpr("image_id", "prow", "pcol", "round(b8,6) AS b8", "round(b2,6) AS b2")


@query(
    "a23_a24_chip_statistics",
    ctes("f_obs") + "SELECT image_id, prow//16 AS tr, pcol//16 AS tc, round(stddev_pop(b8),6) AS std, min(b8) AS low, max(b8) AS high FROM f_obs GROUP BY 1,2,3",
)
def a23(spark, sf):
    px = fixture(spark, sf, "f_obs").selectExpr("*", "prow DIV 16 AS tr", "pcol DIV 16 AS tc")
    return scoring.chip_statistics(px, ["image_id", "tr", "tc"], "b8").selectExpr("image_id", "tr", "tc", "round(std,6) AS std", "low", "high")


@query(
    "a24_stretched_chips",
    ctes("f_tiles") + """SELECT tile_id, u.i AS i, round((CAST(logits[u.i+1] AS DOUBLE)-list_min(logits))/(CAST(list_max(logits) AS DOUBLE)-list_min(logits)),6) AS v FROM f_tiles, range(0,64) u(i)""",
)
def a24(spark, sf):
    df = fixture(spark, sf, "f_tiles").selectExpr("tile_id", "transform(logits, v -> CAST(v AS DOUBLE)) AS logits")
    return df.selectExpr("tile_id", f"posexplode({scoring.stretch('logits')}) AS (i, v)").selectExpr(
        "tile_id", "CAST(i AS BIGINT) AS i", "round(v,6) AS v"
    )


@query(
    "f12_clean_tiles",
    ctes("f_tiles") + """SELECT tile_id, round(sum(CASE WHEN u.i%9=3 THEN 0 ELSE CAST(logits[u.i+1] AS DOUBLE) END),6) AS total FROM f_tiles, range(0,64) u(i)
 WHERE tile_id%6<>2 GROUP BY 1""",
)
def f12(spark, sf):
    dirty = fixture(spark, sf, "f_tiles").selectExpr(
        "tile_id", "transform(logits, (v, i) -> CASE WHEN i % 9 = 3 THEN CAST('NaN' AS FLOAT) ELSE v END) AS image",
        "transform(logits, (v, i) -> CASE WHEN tile_id % 6 = 2 AND i = 5 THEN CAST('NaN' AS FLOAT) ELSE v END) AS label",
    )
    cleaned = scoring.clean_tiles(dirty, ["image"], ["label"])
    return cleaned.selectExpr("tile_id", "round(aggregate(image, 0D, (a, v) -> a + v),6) AS total")


@query(
    "r11_stacked_channels",
    ctes("f_tiles") + "SELECT tile_id, 2 AS channels, round(CAST(logits[3] AS DOUBLE),6) AS first, round(-CAST(logits[3] AS DOUBLE),6) AS second FROM f_tiles",
)
def r11(spark, sf):
    df = fixture(spark, sf, "f_tiles").selectExpr("tile_id", "logits AS a", "transform(logits, v -> -v) AS b")
    return scoring.stack_channels(df, ["a", "b"]).selectExpr(
        "tile_id", "size(channels) AS channels", "round(CAST(channels[0][2] AS DOUBLE),6) AS first", "round(CAST(channels[1][2] AS DOUBLE),6) AS second"
    )


def prepared(spark, sf, labelled_only):
    pixels = fixture(spark, sf, "f_obs").withColumnRenamed("image_id", "city")
    built = vector_fixture(spark, sf, "f_buildings").withColumnRenamed("id", "order_id")
    areas = vector_fixture(spark, sf, "f_settlements").selectExpr("sid AS order_id", "geom", "bbox", "1 AS class_id")
    return preparation.prepare_tiles(
        scenes7(spark, sf), pixels, built, areas, "city", 16, 8, labelled_only, cell=1000.0, classes={1: 0.5}
    )


def by_place(values):
    """Sum of values times their place in reading order: differs if a tile is turned or shifted."""
    return f"aggregate(transform({values}, (v, i) -> CAST(v AS DOUBLE) * (i + 1)), 0D, (a, v) -> a + v)"


PREP_CTES = ctes(
    "f_settlements", "f_buildings", "f_obs", z=SCENE7, burn=BURN,
    w="""SELECT city, (row_number() OVER (PARTITION BY city ORDER BY ymin, xmin)-1) AS tile_idx, ymin, xmin FROM
 (SELECT city, ymin, unnest(range(0, 64-15, 8)) AS xmin FROM (SELECT *, unnest(range(0, 64-15, 8)) AS ymin FROM z))""",
    fine="""SELECT DISTINCT z.city, p.i AS prow, q.i AS pcol FROM z JOIN f_buildings s ON s.xmin<=z.xmin+640 AND s.xmax>=z.xmin AND s.ymin<=12000 AND s.ymax>=12000-640
 JOIN range(0,128) p(i) ON 12000-(p.i+0.5e0)*5>=s.ymin AND 12000-(p.i+0.5e0)*5<s.ymax JOIN range(0,128) q(i) ON z.xmin+(q.i+0.5e0)*5>=s.xmin AND z.xmin+(q.i+0.5e0)*5<s.xmax""",
    b="SELECT w.city, w.tile_idx, 0.5e0*sum((f.prow-2*w.ymin)*32+f.pcol-2*w.xmin+1) AS built FROM w JOIN fine f ON f.city=w.city AND f.prow>=2*w.ymin AND f.prow<2*w.ymin+32 AND f.pcol>=2*w.xmin AND f.pcol<2*w.xmin+32 GROUP BY 1,2",
    lab="""SELECT w.city, w.tile_idx, list((f.prow-w.ymin)*16+f.pcol-w.xmin ORDER BY f.prow, f.pcol) AS places FROM w JOIN burn f
 ON f.city=w.city AND f.prow>=w.ymin AND f.prow<w.ymin+16 AND f.pcol>=w.xmin AND f.pcol<w.xmin+16 GROUP BY 1,2""",
    r=RANK.replace("scene", "city"), f=FOLDS.replace("scene", "city"), d=FOLD.replace("scene", "city").replace("m%3", "m%2").replace("m//3", "m//2"),
    t="""SELECT w.city, w.tile_idx, (o.prow-w.ymin)*16+o.pcol-w.xmin+1 AS i, o.b8, (o.b8-2581.270e0)/586.279e0 AS v FROM w JOIN f_obs o ON o.image_id=w.city AND o.prow>=w.ymin AND o.prow<w.ymin+16 AND o.pcol>=w.xmin AND o.pcol<w.xmin+16""",
    g="SELECT city, tile_idx, stddev_pop(v) AS s FROM t GROUP BY 1,2",
    n="SELECT t.city, t.tile_idx, sum(CAST(CAST(CASE WHEN b8=0 OR s=0 THEN 0 ELSE v/s END AS FLOAT) AS DOUBLE)*i) AS nir FROM t JOIN g USING (city, tile_idx) GROUP BY 1,2",
)


@query(
    "x2_prepared_tiles",
    PREP_CTES + """SELECT w.city, w.tile_idx, w.ymin, w.xmin, d.fold, coalesce(CAST(b.built AS DOUBLE),0) AS built, round(coalesce(n.nir,0),3) AS nir,
 coalesce(array_to_string(lab.places, ','), '') AS labels FROM w JOIN d USING (city, tile_idx) LEFT JOIN n USING (city, tile_idx) LEFT JOIN b USING (city, tile_idx) LEFT JOIN lab USING (city, tile_idx)""",
)
def x2(spark, sf):
    return prepared(spark, sf, False).selectExpr(
        "city", "tile_idx", "ymin", "xmin", "fold", f"{by_place('buildings')} AS built", f"round({by_place('b8')},3) AS nir",
        "array_join(filter(transform(labels, (v, i) -> CASE WHEN v > 0 THEN CAST(i AS STRING) END), x -> x IS NOT NULL), ',') AS labels",
    )


@query(
    "x2_labelled_tiles",
    BURN_CTES + """SELECT city, 4*(prow//16)+pcol//16 AS tile_idx, prow//16*16 AS ymin, pcol//16*16 AS xmin FROM burn GROUP BY ALL""",
)
def x2_labelled(spark, sf):
    return prepared(spark, sf, True).select("city", "tile_idx", "ymin", "xmin")


@query("x10_pixel_scorer")
def x10(spark, sf):
    px = fixture(spark, sf, "f_obs").selectExpr(
        "image_id", "prow", "pcol", "b2/2000D AS b2", "b3/2000D AS b3", "b4/3000D AS b4", "b8/4000D AS b8",
        "CASE WHEN b8 > 2 * b3 THEN 1 ELSE 0 END AS truth",
    )
    bands = ["b2", "b3", "b4", "b8"]
    scored = training.cross_score(px.selectExpr("*", "image_id % 2 AS fold"), bands, 2)
    return scored.groupBy("image_id", "truth").agg(F.expr("count(1) AS n"), F.expr("round(avg(score), 4) AS mean_score"))
