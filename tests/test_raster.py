from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartier.functions import geometry as g
from quartier.operators import focal, raster, regions, scoring, tessellation, tiles, zonal
from quartier.plans import training
from quartier.plans.prediction import matched_pixels
from quartier.plans.preparation import assemble_tiles, tile_pixels
from quartier.session import materialise
from tests.shapes import frame, geom, ring, square


def mask_frame(spark, grid, scene=0):
    rows = [(scene, int(r), int(c), int(v)) for (r, c), v in np.ndenumerate(grid)]
    return spark.createDataFrame(rows, "scene long, prow long, pcol long, m int")


def dense(df, shape, column="m"):
    out = np.zeros(shape, dtype=int)
    for r in df.collect():
        out[r["prow"], r["pcol"]] = r[column]
    return out


def brute_opening(grid, k):
    back, ahead = k // 2, k - 1 - k // 2
    out = np.zeros_like(grid)
    h, w = grid.shape
    for r in range(back, h - ahead):
        for c in range(back, w - ahead):
            if grid[r - back:r + ahead + 1, c - back:c + ahead + 1].all():
                out[r - back:r + ahead + 1, c - back:c + ahead + 1] = 1
    return out


@pytest.mark.parametrize("k", [2, 3, 8])
def test_opening(spark, k):
    rng = np.random.default_rng(1)
    grid = (rng.random((20, 20)) < 0.85).astype(int)
    grid[2:14, 3:15] = 1
    df = mask_frame(spark, grid)
    opened = focal.opening(df, ["scene"], "m", k)
    got = dense(opened, grid.shape)
    assert (got == brute_opening(grid, k)).all()
    assert (got <= grid).all()
    assert (dense(focal.opening(opened, ["scene"], "m", k), grid.shape) == got).all()  # idempotent
    sparse = focal.sparse_opening(df.where("m = 1"), ["scene"], k).selectExpr("*", "1 AS m")
    assert (dense(sparse, grid.shape) == got).all()


def test_opening_of_blocks(spark):
    grid = np.zeros((20, 20), dtype=int)
    grid[4:16, 4:16] = 1
    assert (dense(focal.opening(mask_frame(spark, grid), ["scene"]), grid.shape) == grid).all()
    grid[:] = 0
    grid[4:11, 4:11] = 1
    assert dense(focal.opening(mask_frame(spark, grid), ["scene"]), grid.shape).sum() == 0


@pytest.mark.parametrize("shape", ["circle", "square"])
def test_focal(spark, shape):
    rng = np.random.default_rng(2)
    grid = rng.integers(0, 90, (9, 11))
    there = rng.random((9, 11)) < 0.6  # gaps in the grid
    df = mask_frame(spark, np.where(there, grid, -1)).where("m >= 0")
    for func, pick in (("min", min), ("max", max)):
        got = {(r["prow"], r["pcol"]): r["m"] for r in focal.focal(df, ["scene"], "m", 2, func, shape).collect()}
        for (r, c), v in got.items():
            near = [
                grid[y, x] for y, x in np.argwhere(there)
                if ((r - y) ** 2 + (c - x) ** 2 <= 4 if shape == "circle" else max(abs(r - y), abs(c - x)) <= 2)
            ]
            assert v == pick(near)
        assert len(got) == there.sum()


def brute_regions(grid):
    label, todo = {}, {tuple(p) for p in np.argwhere(grid)}
    while todo:
        start = min(todo)
        stack, todo = [start], todo - {start}
        while stack:
            r, c = stack.pop()
            label[(r, c)] = start[0] * 2**31 + start[1]
            for q in [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if q in todo:
                    todo.discard(q)
                    stack.append(q)
    return label


def spiral():
    grid = np.zeros((24, 24), dtype=int)
    grid[1, 1:23] = grid[1:23, 22] = grid[22, 3:23] = grid[4:23, 3] = grid[4, 3:19] = grid[4:19, 18] = 1
    grid[10:13, 8:11] = 1
    grid[11, 9] = 0  # a hole
    grid[15, 6] = grid[16, 7] = grid[17, 6] = 1  # joined by corners
    return grid


@pytest.mark.parametrize("block", [4, 7, 64])
def test_region_labels(spark, block):
    rng = np.random.default_rng(4)
    for scene, grid in enumerate([(rng.random((25, 30)) < 0.42).astype(int), spiral()]):
        df = mask_frame(spark, grid, scene).where("m = 1")
        got = {(r["prow"], r["pcol"]): r["region"] for r in regions.label_regions(df, ["scene"], block).collect()}
        assert got == brute_regions(grid)


def filled_sizes(grid, label):
    """Pixels of each region plus its holes: whatever the outside cannot reach over sides."""
    sizes = {}
    for region in set(label.values()):
        own = np.zeros((grid.shape[0] + 2, grid.shape[1] + 2), dtype=bool)
        for (r, c), v in label.items():
            own[r + 1, c + 1] = v == region
        out, stack = np.zeros_like(own), [(0, 0)]
        out[0, 0] = True
        while stack:
            r, c = stack.pop()
            for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= q[0] < own.shape[0] and 0 <= q[1] < own.shape[1] and not out[q] and not own[q]:
                    out[q] = True
                    stack.append(q)
        sizes[region] = int((~out).sum())
    return sizes


def test_region_outlines(spark):
    rng = np.random.default_rng(6)
    for scene, grid in enumerate([spiral(), (rng.random((18, 18)) < 0.45).astype(int)]):
        df = mask_frame(spark, grid, scene).where("m = 1")
        polygons = regions.vectorize(df, ["scene"], 7)
        rows = polygons.selectExpr("region", f"{g.area('geom')} AS area", "geom").collect()
        assert {r["region"]: r["area"] for r in rows} == filled_sizes(grid, brute_regions(grid))
        for r in rows:
            corners = r["geom"]["polys"][0][0]
            assert corners[0] == corners[-1]
            for a, b in zip(corners, corners[1:]):  # axis-parallel steps, every corner turns
                assert (a["x"] == b["x"]) != (a["y"] == b["y"])


def test_zonal_sum(spark):
    rnd = random.Random(8)
    pixels = [(x + 0.5, y + 0.5, float(rnd.randrange(9))) for x in range(30) for y in range(30)]
    pop = spark.createDataFrame(pixels, "px double, py double, b1 double")
    shapes = [
        square(2, 2, 20), square(3.2, 3.2, 0.9), square(7.1, 7.1, 1.5), geom([ring((0, 0), (28, 3), (5, 27))]),
        geom([ring((1, 1), (29, 1), (29, 29), (1, 29)), ring((12, 12), (13, 12), (13, 13), (12, 13))]),
        square(100, 100, 4),
    ]
    zones = frame(spark, list(enumerate(shapes)))

    def inside(shape, x, y, holes):
        hit = False
        for rings in shape["polys"]:
            for rg in rings if holes else rings[:1]:
                for a, b in zip(rg, rg[1:]):
                    if (a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]:
                        hit = not hit
        return hit

    for block in (3.0, 10.0, 64.0):
        for holes in (False, True):
            got = {r["id"]: r["total"] for r in zonal.zonal_sum(pop, zones, ["id"], block=block, exterior_only=not holes).collect()}
            want = {i: sum(v for x, y, v in pixels if inside(s, x, y, holes)) for i, s in enumerate(shapes)}
            assert got == want


def test_nearest_owner(spark):
    rnd = random.Random(11)
    built = [("a", i, square(rnd.uniform(0, 200), rnd.uniform(0, 200), 3)) for i in range(30)]
    built += [("a", 100 + i, built[4][2]) for i in range(10)]  # stacked copies
    df = frame(spark, [(k, i, s) for k, i, s in built], "city string, bid long")
    cells = [("a", x, y) for x in range(0, 40, 3) for y in range(0, 40, 3)] + [("empty", 1, 1)]
    px = spark.createDataFrame(cells, "city string, cx long, cy long").selectExpr("*", "cx * 5 + 2.5D AS px", "cy * 5 + 2.5D AS py")

    def gap(s, x, y):
        p = s["polys"][0][0]
        return np.hypot(max(p[0]["x"] - x, 0, x - p[2]["x"]), max(p[0]["y"] - y, 0, y - p[2]["y"]))

    want = {(x, y): min((round(gap(s, x * 5 + 2.5, y * 5 + 2.5), 9), i) for _, i, s in built)[1] for k, x, y in cells if k == "a"}
    for enough in (1, 5, 24):
        got = {(r["cx"], r["cy"]): r["owner"] for r in tessellation.nearest_owner(px, df, ["city"], 5.0, enough=enough).collect()}
        assert got == want


def test_nearest_owner_nested(spark):
    """Boxes of many sizes at one corner: those inside one of a smaller id are never compared, whatever else is stacked there."""
    rnd = random.Random(3)
    sizes = [(5 + i % 11, 5 + i % 7) for i in range(77)]
    built = []
    for n, (x, y) in enumerate([(3, 4), (3, 44), (61, 18), (95, 95)]):
        rnd.shuffle(sizes)
        built += [("a", 100 * n + i, geom([ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))])) for i, (w, h) in enumerate(sizes)]
    # a triangle leads nobody, and one in a box of a greater id stays
    built += [("a", 0 - 1, geom([ring((3, 4), (33, 4), (3, 34))])), ("a", 900, square(40, 70, 20)), ("a", 800, geom([ring((41, 71), (45, 71), (41, 75))]))]
    df = frame(spark, built, "city string, bid long")
    cells = [("a", x, y) for x in range(24) for y in range(24)]
    px = spark.createDataFrame(cells, "city string, cx long, cy long").selectExpr("*", "cx * 5 + 2.5D AS px", "cy * 5 + 2.5D AS py")

    def gap(s, x, y):
        p = s["polys"][0][0]
        a, b, c, d = min(v["x"] for v in p), min(v["y"] for v in p), max(v["x"] for v in p), max(v["y"] for v in p)
        box = np.hypot(max(a - x, 0, x - c), max(b - y, 0, y - d))
        if len(p) == 5:
            return box
        # beyond the long edge, whose slope is -1, its nearest point decides
        past = x + y - (c + b)
        t = min(max((x - a - (y - b) + (c - a)) / 2, 0), c - a)
        return box if past <= 0 else np.hypot(a + t - x, d - t - y)

    want = {(x, y): min((round(gap(s, x * 5 + 2.5, y * 5 + 2.5), 9), i) for _, i, s in built)[1] for _, x, y in cells}
    got = {(r["cx"], r["cy"]): r["owner"] for r in tessellation.nearest_owner(px, df, ["city"], 5.0).collect()}
    assert got == want
    leading = tessellation.leading_outlines(df.selectExpr("city", "bid AS owner", "geom", "bbox AS box"), ["city"], 5.0)
    kept = {r["owner"] for r in leading.collect()}
    inside = lambda p, q: all(u <= v for u, v in zip(q[:2], p[:2])) and all(u >= v for u, v in zip(q[2:], p[2:]))
    box = {i: (s["polys"][0][0][0]["x"], s["polys"][0][0][0]["y"], s["polys"][0][0][2]["x"], s["polys"][0][0][2]["y"]) for _, i, s in built}
    corner = [i for i in box if 0 <= i < 800]
    assert kept == {i for i in corner if not any(j < i and j // 100 == i // 100 and inside(box[i], box[j]) for j in corner)} | {-1, 800, 900}
    assert len(kept) < 80


def test_nearest_owner_dense_and_empty(spark):
    """A dense quarter, a very dense cell and a lone hut in wide empty land: few candidates for every pixel, at every distance."""
    rnd = random.Random(5)
    built = [("a", 100 * i + j, square(3000 + 8 * i, 3000 + 8 * j, 5)) for i in range(40) for j in range(40)]
    built += [("a", 10_000 + i, square(-2000 + rnd.uniform(0, 3), -2000 + rnd.uniform(0, 3), 0.5)) for i in range(300)] + [("a", 20_000, square(-4000, 5000, 4))]
    df = frame(spark, built, "city string, bid long")
    cells = sorted({(rnd.randrange(-420, 520), rnd.randrange(-420, 520)) for _ in range(900)} | {(x, y) for x in range(296, 330, 2) for y in range(296, 330, 2)} | {(x, y) for x in range(-204, -196) for y in range(-204, -196)})
    px = spark.createDataFrame([("a", *c) for c in cells], "city string, cx long, cy long").selectExpr("*", "cx * 10 + 5D AS px", "cy * 10 + 5D AS py")
    corners = np.array([[s["polys"][0][0][0]["x"], s["polys"][0][0][0]["y"], s["polys"][0][0][2]["x"], s["polys"][0][0][2]["y"]] for _, _, s in built])
    ids = np.array([i for _, i, _ in built])
    got = {(r["cx"], r["cy"]): (r["owner"], r["dist"]) for r in tessellation.nearest_owner(px, df, ["city"], 10.0).collect()}
    assert sorted(got) == cells
    for (x, y), (owner, dist) in got.items():
        cx, cy = 10 * x + 5, 10 * y + 5
        gaps = np.hypot(np.maximum(np.maximum(corners[:, 0] - cx, cx - corners[:, 2]), 0), np.maximum(np.maximum(corners[:, 1] - cy, cy - corners[:, 3]), 0))
        assert dist == pytest.approx(gaps.min(), rel=1e-9, abs=1e-9) and gaps[ids == owner][0] == pytest.approx(gaps.min(), rel=1e-9, abs=1e-9)
    blocks = tessellation.candidate_blocks(px, df.selectExpr("city", "bid AS owner", "bbox AS box"), ["city"], 10.0)
    sizes = blocks.groupBy("level", "x", "y").agg(F.sum(F.size("owners")).alias("n"), F.min(F.array_min("owners")).alias("least"))
    most = {r["quarter"]: r["n"] for r in sizes.groupBy((F.col("least") < 10_000).alias("quarter")).agg(F.max("n").alias("n")).collect()}
    # of 1,901 outlines, wherever the pixel lies; the heap's boxes lie within fractions of a pixel, so more of them may be nearest
    assert most[True] <= tessellation.ENOUGH and most[False] <= 300


def test_tessellation_measures(spark):
    owners = {(0, 0): 1, (1, 0): 1, (2, 0): 2, (0, 1): 3, (1, 1): 3, (2, 1): 2, (3, 0): 4, (4, 0): 5}
    df = spark.createDataFrame([("a", x, y, o) for (x, y), o in owners.items()], "city string, cx long, cy long, owner long")
    assert {(r["owner"], r["cell_area"]) for r in tessellation.cell_areas(df, ["city"], 2.0).collect()} == {(1, 8), (2, 8), (3, 8), (4, 4), (5, 4)}
    edges = tessellation.contiguity(df, ["city"])
    pairs = {(r["a"], r["b"]) for r in edges.collect()}
    half = {(1, 2), (1, 3), (2, 3), (2, 4), (4, 5)}
    assert pairs == half | {(b, a) for a, b in half}
    near = {(r["a"], r["b"]) for r in tessellation.within_steps(edges, ["city"], 2).collect()}
    assert (1, 4) in near and (2, 5) in near and (1, 5) not in near and not any(a == b for a, b in near)
    built = frame(spark, [("a", i, square(2 * i, 0, 2 if i == 1 else 1)) for i in range(1, 6)], "city string, bid long")
    groups = tessellation.touching_groups(built, ["city"], 3.0)
    assert {(r["owner"], r["component"]) for r in groups.collect()} == {(1, 1), (2, 1)}
    three = tessellation.within_steps(edges, ["city"], 3)
    adj = tessellation.adjacency(three, groups, built.selectExpr("city", "bid AS owner"), ["city"])
    assert {r["owner"]: r["adjacency"] for r in adj.collect()} == {i: 4 / 5 for i in range(1, 6)}
    dist = tessellation.neighbour_distance(edges, built, ["city"]).collect()
    assert {r["owner"]: r["neighbour_distance"] for r in dist}[5] == 1.0


def test_rasterize_last_wins_and_all_touched(spark):
    scenes = spark.createDataFrame([("s", 0.0, 10.0, 1.0, 10, 10)], "scene string, xmin double, ymax double, res double, height int, width int")
    feats = frame(spark, [("s", 1, 1, square(1, 1, 4)), ("s", 2, 2, square(3.2, 3.2, 3)), ("s", 3, 1, square(50, 50))], "scene string, o long, class_id int")
    burned = raster.rasterize(feats, scenes, "scene", "o")
    full = raster.fill_grid(raster.scene_grid(scenes, "scene"), burned, ["scene", "prow", "pcol"], "class_id")
    grid = dense(full, (10, 10), "class_id")
    want = np.zeros((10, 10), dtype=int)
    want[5:9, 1:5] = 1
    want[4:7, 3:6] = 2
    assert (grid == want).all()
    touched = dense(raster.rasterize(feats, scenes, "scene", "o", all_touched=True), (10, 10), "class_id")
    assert touched.sum() > want.sum() and touched[3, 6] == 2


def outlines():
    """Round outlines with holes, slivers, and corners that lie on cell corners."""
    from tests.test_geometry import wavy

    rows = [(1, geom([*wavy(800, 9, 3.3, -2.1, 0.2, 31)["polys"][0], wavy(300, 5, 3.1, -2.0, 0.3, 17)["polys"][0][0]]))]
    rows += [(2, geom([ring((0, 0), (6, 0), (0, 3))])), (3, square(1, 1, 2)), (4, geom([ring((-5, -5), (7, 7), (7, 7.5))])), (5, geom([ring((0.2, 0.3), (0.4, 0.3), (0.3, 0.35))]))]
    rows += [(6, geom([ring((0, 0), (4, 4), (8, 0), (4, -4))])), (7, geom([ring((0.5, 0.5), (9.5, 0.5), close=False)], kind="LineString")), (8, geom([ring((-3, -3), (-1, -3), (-1, -1))], [ring((2, 2), (3, 2), (3, 3))]))]
    return rows


def test_touched_cells_against_every_cell(spark):
    """Cells along edges and inside are those whose closed square the outline meets, cell by cell of its box."""
    df = frame(spark, outlines())
    got = raster.covered_cells(df, 1.0, ["id"], all_touched=True).collect()
    spread = df.selectExpr("*", "explode(sequence(CAST(floor(bbox.ymin) AS BIGINT), CAST(floor(bbox.ymax) AS BIGINT))) AS cy").selectExpr(
        "*", "explode(sequence(CAST(floor(bbox.xmin) AS BIGINT), CAST(floor(bbox.xmax) AS BIGINT))) AS cx")
    want = spread.where(g.intersects("geom", f"({g.rectangle('cx', 'cy', 'cx + 1', 'cy + 1')})")).select("id", "cx", "cy").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    scenes = spark.createDataFrame([("s", -12.0, 12.0, 1.0, 24, 24)], "scene string, xmin double, ymax double, res double, height int, width int")
    burned = raster.rasterize(df.selectExpr("'s' AS scene", "id AS o", "CAST(id AS INT) AS class_id", "geom", "bbox"), scenes, "scene", "o", all_touched=True).collect()
    last = {}
    for i, x, y in sorted(map(tuple, want)):
        last[(11 - y, x + 12)] = i
    # rows count downwards, so contact with a lower border is seen from the other cell
    assert len(burned) > 100 and sum(last.get((r["prow"], r["pcol"])) == r["class_id"] for r in burned) > 0.9 * len(burned)


def test_touched_cells_of_a_long_outline(spark):
    import time

    from tests.test_geometry import wavy

    shape = geom([*wavy(10_000, 100)["polys"][0], wavy(10_000, 60)["polys"][0][0]])
    start = time.time()
    cells = {(r["cx"], r["cy"]) for r in raster.covered_cells(frame(spark, [(1, shape)]), 1.0, ["id"], all_touched=True).collect()}
    assert time.time() - start < 60
    corners = {(int(np.floor(v["x"])), int(np.floor(v["y"]))) for r in shape["polys"][0] for v in r}
    centres = {(r["cx"], r["cy"]) for r in raster.covered_cells(frame(spark, [(1, shape)]), 1.0, ["id"]).collect()}
    assert corners <= cells and centres <= cells
    assert len(cells - centres) < 2.5 * len(corners)


def test_dissolved_runs(spark):
    """Runs of the union are disjoint, hold each covered cell once and are as many as the outline is long, however many areas overlap."""
    rnd = random.Random(3)
    rows = [(i, square(rnd.uniform(-5000, 5000) if i % 3 else 10.2, rnd.uniform(-30, 30) if i % 3 else 3.3, rnd.uniform(1, 40))) for i in range(300)]
    df = frame(spark, rows).withColumn("kind", F.col("id") % 2)
    runs = raster.dissolve_runs(df, 1.0, ["kind"]).collect()
    cells = [(r["kind"], c, r["cy"]) for r in runs for c in range(r["c0"], r["c1"] + 1)]
    want = {tuple(r) for r in raster.covered_cells(df, 1.0, ["kind"]).distinct().collect()}
    assert len(cells) == len(set(cells)) and set(cells) == want
    assert len(runs) < len(want) / 4
    area = {r["kind"]: r["area"] for r in raster.dissolved_area(df, 1.0, ["kind"]).collect()}
    assert area == {k: float(sum(1 for x in want if x[0] == k)) for k in (0, 1)}
    assert {tuple(r) for r in raster.dissolve_cells(df, 1.0, ["kind"]).collect()} == want


def test_overlay_of_outlines(spark):
    """Common cells of a star-shaped city with a hole and of overlapping districts, cell by cell."""
    from tests.test_geometry import wavy

    city = geom([*wavy(400, 40, 5.2, -3.7, 0.5, 7)["polys"][0], wavy(90, 12, 5.0, -3.5, 0.3, 5)["polys"][0][0]])
    left = frame(spark, [(1, city), (2, square(5000, 0, 3))]).selectExpr("id AS city", "geom", "bbox")
    parts = [(i % 3, square(-40 + 9.3 * i, -30 + 4.1 * i, 14)) for i in range(9)]
    right = frame(spark, parts).selectExpr("id AS part", "geom", "bbox")
    cells = lambda df, k: {tuple(r) for r in raster.covered_cells(df, 1.0, [k]).collect()}
    a, b = cells(left, "city"), cells(right, "part")
    want = {(c, p, x, y) for c, x, y in a for p in range(3) if (p, x, y) in b}
    runs = raster.overlay_runs(left, right, 1.0, ["city"], ["part"]).collect()
    got = [(r["city"], r["part"], x, r["cy"]) for r in runs for x in range(r["c0"], r["c1"] + 1)]
    assert len(got) == len(set(got)) and set(got) == want
    area = {(r["city"], r["part"]): r["area"] for r in raster.overlay_area(left, right, 1.0, ["city"], ["part"]).collect()}
    assert area == {k: float(sum(w[:2] == k for w in want)) for k in {w[:2] for w in want}}


def test_windows_and_folds(spark):
    scenes = spark.createDataFrame([("a", 7, 9), ("b", 3, 3)], "scene string, height int, width int")
    got = tiles.sliding_windows(scenes, ["scene"], 4, 3).collect()
    assert [(r["scene"], r["tile_idx"], r["ymin"], r["xmin"]) for r in sorted(got)] == [
        ("a", 0, 0, 0), ("a", 1, 0, 3), ("a", 2, 3, 0), ("a", 3, 3, 3)]
    assert tiles.grid_windows(scenes, ["scene"], 4).count() == 2 * 3 + 1
    df = spark.range(7).selectExpr("'x' AS scene", "id AS tile_idx")
    folds = tiles.fold_split(df, ["scene"], 2, 0.0).groupBy("fold").count().collect()
    assert sorted((r["fold"], r["count"]) for r in folds) == [(0, 4), (1, 3)]
    many = spark.range(103).selectExpr("'x' AS scene", "id AS tile_idx")
    sizes = {r["fold"]: r["count"] for r in tiles.fold_split(many, ["scene"], 4, 0.1).groupBy("fold").count().collect()}
    assert sizes == {None: 11, 0: 23, 1: 23, 2: 23, 3: 23}
    split = {r["split"]: r["count"] for r in tiles.ratio_split(many, ["scene"], 0.2, 0.1).groupBy("split").count().collect()}
    assert split == {"val": 20, "test": 10, "train": 73}
    with pytest.raises(ValueError):
        tiles.ratio_split(many, ["scene"], 0.6, 0.5)


def test_tile_pixels_cover_every_window(spark):
    grid = np.arange(9 * 10).reshape(9, 10)
    px = mask_frame(spark, grid).withColumnRenamed("m", "v")
    scenes = spark.createDataFrame([(0, 9, 10)], "scene long, height int, width int")
    windows = tiles.sliding_windows(scenes, ["scene"], 4, 3)
    arrays = assemble_tiles(tile_pixels(px, windows, ["scene"], 4, 3), ["scene", "tile_idx"], ["v"], 4)
    rows = arrays.join(windows, ["scene", "tile_idx"]).collect()
    assert len(rows) == 6
    for r in rows:
        assert r["v"] == grid[r["ymin"]:r["ymin"] + 4, r["xmin"]:r["xmin"] + 4].ravel().tolist()


def test_scoring_opens_model_per_task(spark):
    df = spark.range(20).selectExpr("id AS tile_idx", "'c' AS city", "array(CAST(id AS FLOAT), CAST(0 AS FLOAT)) AS x")

    def open_model():
        return lambda batch: np.stack(batch["x"].to_numpy())

    rows = scoring.score_tiles(df, open_model, ["x"], ["city", "tile_idx"], "m").collect()
    assert len(rows) == 20
    for r in rows:
        assert r["scores"] == pytest.approx([1 / (1 + np.exp(-r["tile_idx"])), 0.5])
    both = scoring.score_tiles(df, open_model, ["x"], ["city", "tile_idx"], "n", logits=False)
    mean = scoring.ensemble_mean(scoring.score_tiles(df, open_model, ["x"], ["city", "tile_idx"]).unionByName(both), ["city", "tile_idx"])
    got = {r["tile_idx"]: r["scores"] for r in mean.collect()}
    assert got[3] == pytest.approx([(1 / (1 + np.exp(-3)) + 3) / 2, 0.25])


def test_pixel_scorer_learns(spark):
    df = spark.range(2000).selectExpr("id", "(id % 100) / 100D AS a", "(id % 7) / 7D AS b", "CAST(id % 100 >= 50 AS INT) AS truth")
    model = training.fit_pixel_scorer(df, ["a", "b"])
    scored = training.score_pixels(model, df, ["a", "b"])
    wrong = scored.where("(score > 0.5) <> (truth = 1)").count()
    assert wrong < 100


def outline(n, seed):
    """Star-shaped ring of n corners around (500, 500) with a hole, and whether points lie inside."""
    rng = np.random.default_rng(seed)
    turn = np.linspace(0, 2 * np.pi, n, endpoint=False)
    far = 250 + 150 * rng.random(n)
    outer = ring(*zip(500 + far * np.cos(turn), 500 + far * np.sin(turn)))
    hole = ring((450, 450), (450, 560), (555, 560), (555, 450))

    def inside(x, y):
        hit = np.zeros(np.broadcast(x, y).shape, dtype=bool)
        for rg in (outer, hole):
            for a, b in zip(rg, rg[1:]):
                row = (a["y"] > y) != (b["y"] > y)
                if row.any():
                    with np.errstate(divide="ignore", invalid="ignore"):
                        hit ^= row & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
        return hit

    return geom([outer, hole]), inside


def test_long_outline_equals_brute_force(spark):
    shape, inside = outline(10_000, 4)
    x, y = np.meshgrid(np.arange(100) * 10 + 5.0, np.arange(100) * 10 + 5.0)
    hit = inside(x, y)
    want = {(int(px // 10), int(py // 10)) for px, py in zip(x[hit], y[hit])}
    df = frame(spark, [(1, shape)])
    cells = raster.covered_cells(df, 10.0, ["id"])
    assert {(r["cx"], r["cy"]) for r in cells.collect()} == want and cells.count() == len(want)
    scenes = spark.createDataFrame([(1, 0.0, 1000.0, 10.0, 100, 100)], "id long, xmin double, ymax double, res double, height int, width int")
    burned = raster.rasterize(df.selectExpr("*", "7 AS class_id", "1 AS o"), scenes, "id", "o")
    assert {(r["pcol"], 99 - r["prow"]) for r in burned.collect()} == want
    part = raster.rasterize(df.selectExpr("*", "7 AS class_id", "1 AS o"), scenes, "id", "o", window=(20, 30, 40, 25), classes={7: 0.5})
    got = part.collect()
    assert {(r["pcol"], 99 - r["prow"]) for r in got} == {(c, y) for c, y in want if 30 <= c < 55 and 20 <= 99 - y < 60}
    assert {r["class_id"] for r in got} == {0.5}
    pixels = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in zip(x.ravel(), y.ravel())], "px double, py double, b1 double")
    for block in (37.0, 200.0):
        total = zonal.zonal_sum(pixels, df, ["id"], block=block, exterior_only=False).first()["total"]
        assert total == len(want)


def test_cells_of_odd_geometries(spark):
    rows = [
        (1, geom([ring((0, 0), (4, 0), (4, 4), (0, 4))], [ring((2, 2), (6, 2), (6, 6), (2, 6))])),  # parts that overlap
        (2, geom([ring((0, 0), (9, 9), close=False)], kind="LineString")), (3, geom([ring((1, 1), close=False)], kind="Point")),
        (4, None), (5, square(0.6, 0.6, 0.2)),
    ]
    got = raster.covered_cells(frame(spark, rows), 1.0, ["id"]).collect()
    assert {r["id"] for r in got} == {1} and len(got) == len(set(got)) == 16 + 16 - 4
    pixels = spark.createDataFrame([(x + 0.5, y + 0.5, 1.0) for x in range(10) for y in range(10)], "px double, py double, b1 double")
    sums = {r["id"]: r["total"] for r in zonal.zonal_sum(pixels, frame(spark, rows), ["id"], block=3.0).collect()}
    assert sums == {1: 28.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_cells_meeting_at_a_corner_are_contiguous(spark):
    df = spark.createDataFrame([("a", 0, 0, 1), ("a", 1, 1, 2), ("a", 3, 3, 3)], "city string, cx long, cy long, owner long")
    assert {(r["a"], r["b"]) for r in tessellation.contiguity(df, ["city"]).collect()} == {(1, 2), (2, 1)}


def test_box_within(spark):
    areas = {
        "all": square(0, 0, 10), "same": square(2, 2, 3), "smaller": square(3, 3, 5), "line": geom([ring((0, 0), (9, 9), close=False)], kind="LineString"),
        "hole": geom([ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((3, 3), (4, 3), (4, 4), (3, 4))]),
        "notch": geom([ring((0, 0), (10, 0), (10, 10), (3, 10), (3, 4), (2.5, 10), (0, 10))]),
    }
    df = frame(spark, list(areas.items()), "name string").selectExpr("name", "geom", f"{g.box('2', '2', '5', '5')} AS w")
    got = {r["name"] for r in df.where(g.box_within("w", "geom")).collect()}
    assert got == {"all", "same"}


def test_cross_scores_leave_the_fold_out(spark):
    # fold 0 says the opposite of fold 1: models of the other fold rank its pixels the wrong way
    df = spark.range(400).selectExpr("CAST(id % 20 AS DOUBLE) AS b", "CAST(id % 2 AS INT) AS fold", "id").selectExpr(
        "*", "CAST(CASE WHEN fold = 0 THEN b < 10 ELSE b >= 10 END AS INT) AS truth"
    ).unionByName(spark.range(5).selectExpr("1D AS b", "CAST(NULL AS INT) AS fold", "id", "1 AS truth"))
    got = training.cross_score(df, ["b"], 2).groupBy("truth").avg("score").collect()
    means = {r["truth"]: r[1] for r in got}
    assert training.cross_score(df, ["b"], 2).count() == 400 and means[1] < means[0]


def test_only_matched_images_list_their_pixels(spark, tmp_path):
    """Pixels made by a join of images and observations: the images without a city go before that join."""
    spark.range(200).selectExpr("concat('img/', id) AS image_path", "id % 7 AS image_id").write.parquet(f"{tmp_path}/images")
    spark.range(7 * 64).selectExpr("id % 7 AS image_id", "id DIV 7 AS prow").write.parquet(f"{tmp_path}/obs")
    images, obs = spark.read.parquet(f"{tmp_path}/images"), spark.read.parquet(f"{tmp_path}/obs")
    found = materialise(images.where("image_path IN ('img/3', 'img/10')").selectExpr("image_path", "upper(image_path) AS scene"))
    own = matched_pixels(images.join(obs, "image_id").drop("image_id"), found)
    joins = re.findall("Join (Inner|LeftSemi)", own._jdf.queryExecution().optimizedPlan().toString())
    assert joins == ["Inner", "Inner", "LeftSemi"]  # outermost first
    want = images.join(obs, "image_id").join(found, "image_path").select("image_path", "prow", "scene").collect()
    assert sorted(own.select("image_path", "prow", "scene").collect()) == sorted(want) and len(want) == 128
