from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quartier import session
from quartier.fixtures import with_box
from quartier.functions import geometry as g
from quartier.operators import components, skew, spatial, tiles
from quartier.operators.components import chain_order, connected_components
from tests.shapes import frame, geom, ring, square


def test_salted_join_equals_join(spark):
    # one key holds a third of the rows
    big = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 50 END AS k")
    other = spark.range(60).selectExpr("id AS k", "id * 2 AS v")
    for how in ("inner", "left", "left_semi"):
        want = big.join(other, "k", how).select("id", "k").collect()
        got = skew.salted_join(big, other, ["k"], how, rows_per_task=100).select("id", "k").collect()
        assert sorted(want) == sorted(got)
    hot = {r["k"]: r["_pieces"] for r in skew.hot_keys(big, ["k"], 100).collect()}
    assert hot == {7: 11}


def test_lookup_join_falls_back(spark):
    big = spark.range(500).selectExpr("id", "id % 9 AS k")
    small = spark.range(9).selectExpr("id AS k", "id + 1 AS v")
    want = sorted(big.join(small, "k").select("id", "v").collect())
    assert sorted(skew.lookup_join(big, small, ["k"]).select("id", "v").collect()) == want


def test_ranks_and_percentiles(spark):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else f"c{i % 4}", i, float(rnd.choice([1, 2, 2, 5, rnd.random() * 1e6]))) for i in range(900)]
    df = spark.createDataFrame(rows, "c string, i long, v double")
    got = {(r["c"], r["i"]): r["pos"] for r in skew.ordered_rank(df, ["c"], "v", ["i"], buckets=8).collect()}
    for c in {r[0] for r in rows}:
        order = sorted((v, i) for cc, i, v in rows if cc == c)
        assert [got[(c, i)] for _, i in order] == list(range(len(order)))
    q = {(r["c"], r["p"]): r["q"] for r in skew.exact_percentiles(df, ["c"], "v", [0, 0.1, 0.5, 0.77, 1], buckets=8).collect()}
    for (c, p), value in q.items():
        assert np.isclose(value, np.quantile([v for cc, _, v in rows if cc == c], p))


def test_shuffled_rank_is_a_permutation(spark):
    df = spark.range(1000).selectExpr("id % 2 AS c", "id AS k")
    rows = skew.shuffled_rank(df, ["c"], ["k"], 42).collect()
    for c in (0, 1):
        mine = [r for r in rows if r["c"] == c]
        assert sorted(r["pos"] for r in mine) == list(range(500)) and {r["n"] for r in mine} == {500}
    again = skew.shuffled_rank(df.repartition(5), ["c"], ["k"], 42).collect()
    assert {(r["k"], r["pos"]) for r in rows} == {(r["k"], r["pos"]) for r in again}


def test_spatial_join_matches_theta_join(spark):
    rnd = random.Random(5)
    # a third of the left side sits in one place; the right side mixes small and huge squares
    left = [(i, square(50, 50, 1) if i % 3 == 0 else square(rnd.uniform(-100, 100), rnd.uniform(-100, 100), 2)) for i in range(300)]
    right = [(i, square(rnd.uniform(-120, 100), rnd.uniform(-120, 100), rnd.choice([1, 5, 150]))) for i in range(60)]
    a, b = frame(spark, left), frame(spark, right)

    def meets(p, q):
        p, q = p["polys"][0][0], q["polys"][0][0]
        return p[0]["x"] <= q[2]["x"] and q[0]["x"] <= p[2]["x"] and p[0]["y"] <= q[2]["y"] and q[0]["y"] <= p[2]["y"]

    want = sorted((i, j) for i, p in left for j, q in right if meets(p, q))
    for cell, limit in ((7.0, 4), (40.0, 64)):
        # the sides' order and partitions make no difference
        for left_side, right_side in ((a, b), (a.repartition(5), b.repartition(3)), (a.orderBy(F.desc("id")).coalesce(1), b)):
            pairs = spatial.spatial_join(left_side, right_side, cell, max_cells=limit)
            assert sorted((r["l_id"], r["r_id"]) for r in pairs.select("l_id", "r_id").collect()) == want
    semi = spatial.spatial_semi(a, b, 20.0, ["id"]).select("id").collect()
    assert sorted(r["id"] for r in semi) == sorted({i for i, _ in want})
    assert spatial.spatial_join(a, b.where("id < 0"), 7.0).count() == 0


def test_ranked_rows_are_never_broadcast(spark, tmp_path):
    """Windows of a file of a few rows: Spark takes all that is unfolded from it for few."""
    spark.range(20).selectExpr("id AS scene", "40 AS height", "44 AS width").write.parquet(str(tmp_path / "scenes"))
    windows = tiles.sliding_windows(spark.read.parquet(str(tmp_path / "scenes")), ["scene"], 8, 4).select("scene", "tile_idx")
    sizes = skew.shuffled_rank(windows, ["scene"], ["tile_idx"], 1).groupBy("scene").agg(F.expr("max(pos) + 1 AS n"))
    plan = sizes._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Inner, Build" not in plan
    want = {r["scene"]: r["count"] for r in windows.groupBy("scene").count().collect()}
    assert {r["scene"]: r["n"] for r in sizes.collect()} == want and len(want) == 20


def test_meeting_ids_are_those_of_the_join(spark):
    rnd = random.Random(9)
    corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
    dented = [(0, 0), (1, 0), (1, 1), (0.4, 0.3), (0, 1)]
    cut = [(0, 0), (1, 0), (1, 0.3), (0.6, 1), (0, 1)]
    forms = [corners[:i] + corners[i + 1:] for i in range(4)] + [dented, cut, [(0, 0), (0.3, 1), (1, 0.8)], corners, corners]

    def placed(form, side):
        x, y = rnd.randint(-60, 60), rnd.randint(-60, 60)
        points = [(x + side * p, y + side * q) for p, q in form]
        return ring(*(points if rnd.random() < 0.5 else points[::-1]))

    right = [(i, geom([placed(forms[i % 9], rnd.choice([4, 20, 90]))])) for i in range(180)]
    right += [(200, geom([square(-40, -40, 80)["polys"][0][0], square(-30, -30, 60)["polys"][0][0]])), (201, geom([placed(corners, 3)], [placed(dented, 30)]))]
    left = [(i, square(rnd.randint(-70, 70), rnd.randint(-70, 70), rnd.choice([1, 3, 40]))) for i in range(300)]
    left += [(300 + i, geom([placed(forms[i % 9], 8)])) for i in range(40)]
    a, b = frame(spark, left), frame(spark, right, "sid long")
    boxes = a.where(g.is_box("geom", "bbox"))
    plain = b.where("sid % 9 NOT IN (4, 6) AND sid < 200")
    for x, y, cell in ((a, b, 8.0), (boxes, plain, 2.0), (a, b.where("sid < 0"), 8.0), (boxes, b, 400.0)):
        want = sorted((r["l_id"], r["r_sid"]) for r in spatial.spatial_join(x, y, cell * 3).collect())
        got = spatial.meeting_ids(x, y, cell, "id", "sid")
        assert sorted((r["l_id"], r["r_sid"]) for r in got.collect()) == want
    # neither side's outlines reach the join of boxes with boxes cut by an edge
    plan = spatial.meeting_ids(boxes, plain, 8.0, "id", "sid")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "geom" not in "".join(line for line in plan.splitlines() if "Project" in line)


def test_box_filter_is_pushed_down(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = str(tmp_path / "t")
    frame(spark, [(i, square(i, i)) for i in range(50)]).write.parquet(path)
    df = spatial.inside_box(spark.read.parquet(path), 3, 3, 20, 20).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(bbox.xmin,3.0)" in plan and "LessThan(bbox.ymax,20.0)" in plan
    assert "polys" not in plan.split("ReadSchema")[-1]
    assert sorted(r["id"] for r in df.collect()) == list(range(4, 19))


def test_components(spark):
    rnd = random.Random(9)
    edges = [(1, rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(2, 5, i) for i in range(40)] + [(3, i, i + 1) for i in range(30)]
    parent = {}

    def root(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for k, a, b in edges:
        if a != b:
            ra, rb = root((k, a)), root((k, b))
            parent[max(ra, rb)] = min(ra, rb)
    want = {n: root(n)[1] for n in parent}
    got = connected_components(spark.createDataFrame(edges, "k long, a long, b long"), "a", "b", ["k"]).collect()
    assert {(r["k"], r["node"]): r["component"] for r in got} == want
    assert len(got) == len(want)


def test_rounds_have_tasks_of_bounded_size(spark, monkeypatch):
    """Settings hold inside only, smaller ones of the session stay, and a contraction round runs under them."""
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")
    settings = lambda: [spark.conf.get(k) for k in names]
    before, seen = settings(), []
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    with session.small_tasks(spark, 10_000):
        assert settings() == [str(session.TASK_BYTES)] * 2 + ["1000"]
        with session.small_tasks(spark, 50):
            assert settings()[2] == "1000"
    assert settings() == before
    write = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df: (seen.append(settings()), write(df))[1])
    chain = spark.range(100).selectExpr("id AS a", "id + 1 AS b")
    got = connected_components(chain, "a", "b").collect()
    assert settings() == before and len(got) == 101 and {r["component"] for r in got} == {0}
    assert all(s[:2] == [str(session.TASK_BYTES)] * 2 for s in seen) and max(int(s[2]) for s in seen) >= 20


def test_chain_order(spark):
    rows = [(1, i, i + 1 if i < 20 else None) for i in range(21)] + [(2, 5, None)]
    got = chain_order(spark.createDataFrame(rows, "k long, node long, following long"), ["k"]).collect()
    assert {(r["k"], r["node"]): r["to_end"] for r in got} == {**{(1, i): 20 - i for i in range(21)}, (2, 5): 0}


def test_geometry_prefix_of_plan(spark):
    """A joined predicate stays one JVM expression: no Python node in the plan."""
    a = frame(spark, [(1, square(0, 0))])
    plan = spatial.spatial_join(a, a, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert g.intersects("a", "b")


def test_large_features_take_few_cells(spark):
    # one left feature covers a million cells of the base grid, a thin one a thousand
    left = frame(spark, [(1, square(-500, -500, 1000)), (2, square(0, 0)), (3, g_strip())])
    right = frame(spark, [(i, square(i * 20, 0.2, 0.5)) for i in range(-30, 31)] + [(99, square(-400, -400, 900))])
    listed = spatial.spatial_join(left, right, 1.0).select("l_id", "r_id").collect()
    near = [i for i in range(-30, 31) if -25 <= i <= 25]
    want = {(1, i) for i in near} | {(1, 99), (2, 0), (2, 99), (3, 99)} | {(3, i) for i in near}
    assert {tuple(r) for r in listed} == want and len(listed) == len(want)
    level = spatial._level("bbox", 1.0, 64)
    spread = spatial._spread(left.selectExpr("*", f"{level} AS _level"), "bbox", 1.0, "a").groupBy("id").count().collect()
    assert max(r["count"] for r in spread) <= 81


def g_strip():
    return {"type": "Polygon", "polys": [[[{"x": float(x), "y": float(y)} for x, y in ((-500, 0.3), (500, 0.3), (500, 0.4), (-500, 0.4), (-500, 0.3))]]]}


def test_unfolded_windows_are_dealt_and_never_broadcast(spark):
    """A few scenes of many windows: Spark's estimate of the windows is that of the scenes."""
    scenes = spark.range(40).coalesce(1).selectExpr("id AS scene", "2000L AS height", "400L AS width")
    windows = tiles.sliding_windows(scenes, ["scene"], 8, 4)
    assert windows.rdd.getNumPartitions() > 4
    per_task = [r["n"] for r in windows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(per_task) == 40 * 499 * 99 and max(per_task) < sum(per_task) / 2
    plan = tiles.align_tiles(windows, windows, ["scene"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    one = spark.createDataFrame([(0, 5, 3, 300, 200)], "scene long, xmin int, ymin int, xmax int, ymax int")
    for within in (True, False):
        few = tiles.sliding_windows(scenes.where("scene = 0"), ["scene"], 8, 4)
        got = {(r["ymin"], r["xmin"]) for r in tiles.windows_in_areas(few, with_box(one), ["scene"], within, 16.0).collect()}
        starts = [(y, x) for y in range(0, 1993, 4) for x in range(0, 393, 4)]
        if within:
            assert got == {(y, x) for y, x in starts if x >= 5 and x + 8 <= 300 and y >= 3 and y + 8 <= 200}
        else:
            assert got == {(y, x) for y, x in starts if x <= 300 and x + 8 >= 5 and y <= 200 and y + 8 >= 3}


def test_listed_windows_are_never_broadcast(spark, tmp_path):
    """A list of most windows of a small file comes without broadcasts, which would hold all of them in one place."""
    spark.range(40).selectExpr("id AS scene", "200L AS height", "44L AS width").write.parquet(f"{tmp_path}/scenes")
    windows = tiles.sliding_windows(spark.read.parquet(f"{tmp_path}/scenes"), ["scene"], 8, 4)
    listed = windows.where("tile_idx % 3 > 0").select("scene", "tile_idx")
    got = tiles.subset(windows, listed, ["scene", "tile_idx"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert sorted(got.collect()) == sorted(windows.where("tile_idx % 3 > 0").collect())


def test_small_groups_are_one_bucket(spark):
    """Whole groups and groups cut into buckets are ranked alike; small groups make no table of their buckets."""
    df = spark.range(3000).selectExpr("id % 30 AS c", "id AS k")
    whole, cut = (sorted(skew.shuffled_rank(df, ["c"], ["k"], 42, whole=n).collect()) for n in (1000, 10))
    assert whole == cut and [r["n"] for r in whole] == [100] * 3000


def test_groups_met_by_lists_of_cells(spark):
    """Boxes, triangles and areas stacked deep on both sides and of all sizes: the groups met are those of all pairs."""
    rnd = random.Random(9)

    def shape(i, side):
        x, y = rnd.uniform(-60, 60), rnd.uniform(-60, 60)
        return square(x, y, side) if i % 3 else geom([ring((x, y), (x + side, y), (x, y + side))])

    left = frame(spark, [(i, shape(i, rnd.choice([0.5, 2, 70]))) for i in range(400)])
    deep = [("c", square(-20, -20, 9 + i / 1000)) for i in range(300)] + [("d", shape(0, 1)) for i in range(300)]
    right = frame(spark, [(f"k{i % 3}", shape(i, rnd.choice([1, 9, 40]))) for i in range(60)] + deep, "k string")
    pairs = left.selectExpr("id", "geom AS a").crossJoin(right.selectExpr("k", "geom AS b")).where(g.intersects("a", "b"))
    want = sorted(pairs.select("k", "id").distinct().collect())
    for cell in (1.0, 30.0):
        got = spatial.met_groups(left, right, cell, ["id"], ["k"])
        assert sorted(got.select("k", "id").collect()) == want
    assert got.selectExpr("id", "geom AS shape").join(left, "id").where("shape <> geom").count() == 0
    lists = spatial._cell_lists(right.where("k = 'c'"), ["k"], 1.0, spark.sql("SELECT array(0) AS used"), 64)
    assert lists.selectExpr("max(size(own))").first()[0] <= 2 * spatial.CHUNK
    assert lists.where("_cx BETWEEN -9 AND -7 AND _cy BETWEEN -9 AND -7 AND size(own) > 1").count() == 0
    assert {r["id"] for r in spatial.spatial_semi(left, right, 8.0, ["id"]).collect()} == {r["id"] for r in want}
