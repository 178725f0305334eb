from __future__ import annotations

import math

import pytest

from quartier.functions import geometry as g
from quartier.functions import projection as proj
from quartier.functions import scalars as sc
from tests.shapes import frame, geom, one, ring, square

UNIT = square(0, 0)
HOLED = geom([ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (2, 1), (2, 2), (1, 2))])
BOW = geom([ring((0, 0), (2, 2), (2, 0), (0, 3))])


def test_measures(spark):
    assert one(spark, g.area("a"), a=UNIT) == 1
    assert one(spark, g.perimeter("a"), a=UNIT) == 4
    assert one(spark, g.area("a"), a=HOLED) == 15
    assert one(spark, g.perimeter("a"), a=HOLED) == 16  # exterior only
    assert one(spark, g.area(f"({g.fill_holes('a')})"), a=HOLED) == 16
    line = geom([ring((0, 0), (3, 4), close=False)], kind="LineString")
    assert one(spark, g.perimeter("a"), a=line) == 0


def test_point_rules(spark):
    inside = lambda x, y, a: one(spark, g.contains_point("a", str(x), str(y)), a=a)
    assert inside(0.5, 0.5, UNIT) and not inside(1.5, 0.5, UNIT)
    assert inside(0, 0, UNIT) and not inside(1, 1, UNIT)  # lower left border only
    assert not inside(1.5, 1.5, HOLED) and inside(3, 3, HOLED)


def test_intersects(spark):
    def meet(a, b):
        return one(spark, g.intersects("a", "b"), a=a, b=b)

    assert meet(UNIT, square(1, 1))  # a common corner
    assert meet(UNIT, square(1, 0)) and meet(UNIT, square(-5, -5, 20))
    assert not meet(UNIT, square(1.001, 0))
    assert not meet(square(1.2, 1.2, 0.5), HOLED)  # wholly in the hole
    assert meet(square(-1, 1.5, 10), geom([ring((0, 0), (3, 0), (0, 3))]))


def test_distance(spark):
    assert one(spark, g.distance("a", "b"), a=UNIT, b=square(4, 5)) == pytest.approx(5)
    assert one(spark, g.distance("a", "b"), a=UNIT, b=square(0.5, 0.5)) == 0
    tri = geom([ring((3, 0), (5, 2), (5, -2))])
    assert one(spark, g.distance("a", "b"), a=square(0, -0.5), b=tri) == pytest.approx(2)
    assert one(spark, g.point_distance("a", "4", "5"), a=UNIT) == pytest.approx(5)


def test_validity(spark):
    valid = lambda a: one(spark, g.is_valid("a"), a=a)
    assert valid(UNIT) and valid(HOLED)
    assert not valid(BOW)
    assert not valid(geom([ring((0, 0), (1, 0), (1, 1), close=False)]))  # open
    assert not valid(geom([ring((0, 0), (1, 0), (2, 0))]))  # no area
    assert not valid(None)


def test_clip_never_grows(spark):
    shapes = [UNIT, HOLED, square(2, 2, 5), geom([ring((0, 0), (6, 1), (3, 7))])]
    df = frame(spark, [(i, s) for i, s in enumerate(shapes)])
    window = df.selectExpr("*", f"{g.box('1', '1', '3', '3')} AS w")
    cut = window.selectExpr("id", f"{g.area('geom')} AS a", f"{g.clip('geom', 'w')} AS c")
    rows = {r["id"]: r for r in cut.selectExpr("id", "a", f"CASE WHEN c IS NULL THEN 0 ELSE {g.area('c')} END AS b").collect()}
    assert all(r["b"] <= r["a"] + 1e-9 for r in rows.values())
    assert rows[0]["b"] == 0 and rows[1]["b"] == pytest.approx(3) and rows[2]["b"] == pytest.approx(1)


def test_parts_and_geojson(spark):
    three = geom(*[[ring((i, 0), (i + 1, 0), (i, 1))] for i in range(3)])
    assert g.explode_parts(frame(spark, [(1, three)]).drop("bbox")).count() == 3
    for shape in (UNIT, HOLED, three):
        text = one(spark, g.to_geojson("a"), a=shape)
        back = spark.createDataFrame([(text,)], "t string").selectExpr(
            "from_json(t, 'type string, coordinates string') AS j"
        ).selectExpr(f"{g.from_geojson('j.type', 'j.coordinates')} AS geom").first()["geom"]
        assert back.asDict(recursive=True) == shape


def test_pixel_boxes(spark):
    df = spark.sql("SELECT named_struct('ymin', 9, 'xmin', -4, 'ymax', 2, 'xmax', -4) AS b")
    row = df.selectExpr(f"{g.clamp_pixel_box('b', '8', '8')} AS c", f"{g.positive_pixel_box('b')} AS p").first()
    assert tuple(row["c"]) == (2, 0, 8, 1)
    assert tuple(row["p"]) == (2, -4, 9, -3)


def test_projections(spark):
    row = spark.range(1).selectExpr(f"{proj.mercator_x('-90.52D')} AS x", f"{proj.mercator_y('14.64D')} AS y").first()
    assert row["x"] == pytest.approx(-10076640.306607, abs=1e-5)
    assert row["y"] == pytest.approx(1647746.042506, abs=1e-5)
    there = spark.range(1).selectExpr(f"{proj.utm('-90.52D', '14.64D')} AS p")
    back = there.selectExpr(f"{proj.utm_inverse('p.x', 'p.y')} AS q", "p").first()
    assert back["q"]["x"] == pytest.approx(-90.52, abs=1e-9) and back["q"]["y"] == pytest.approx(14.64, abs=1e-9)
    # the central meridian keeps its scale
    up = spark.range(1).selectExpr(f"{proj.utm('-87D', '0D')} AS p").first()["p"]
    assert up["x"] == pytest.approx(500000) and up["y"] == pytest.approx(0, abs=1e-6)


def test_strings(spark):
    row = spark.range(1).selectExpr(
        sc.file_safe('''"St. John's (A/B) & [C]"''') + " AS a", sc.spaced_name("'SanPedroDeMacoris'") + " AS b",
        sc.millions_label("12345678D") + " AS c", sc.percent_label("0.1234D") + " AS d", sc.class_file("1", "'slums'") + " AS e",
        sc.stem("'a/b/Panama_PS.shp'") + " AS f",
    ).first()
    assert list(row) == ["St._Johns_A_B_and_C", "San Pedro De Macoris", "12.3M", "12.3%", "class-1-slums.json", "Panama_PS"]
    assert sc.as_pair(3) == (3, 3) and sc.as_pair((1, 2)) == (1, 2)
    with pytest.raises(ValueError):
        sc.as_pair((1, 2, 3))
    assert math.isclose(spark.range(1).selectExpr(sc.sigmoid("0D") + " AS s").first()["s"], 0.5)


def wavy(n, radius, cx=0.0, cy=0.0, depth=0.1, waves=400, turn=0.0):
    """An outline of n vertices round a centre, its border going in and out."""
    steps = [2 * math.pi * i / n + turn for i in range(n)]
    return geom([ring(*[(cx + radius * (1 + depth * math.sin(waves * t)) * math.cos(t), cy + radius * (1 + depth * math.sin(waves * t)) * math.sin(t)) for t in steps])])


def comb(n, left=0.0, teeth=10.0, along="x"):
    """A comb of about n vertices: long teeth side by side, so that along one axis every edge spans the whole extent."""
    points = [(left + i * 0.5, 0.0 if i % 2 else teeth) for i in range(n)] + [(left + n * 0.5, -1.0), (left - 1, -1.0)]
    return geom([ring(*([(x, y) for x, y in points] if along == "x" else [(y, x) for x, y in points]))])


def edges_of(shape):
    return [(a["x"], a["y"], b["x"], b["y"]) for poly in shape["polys"] for r in poly for a, b in zip(r, r[1:])]


def brute_distance(a, b):
    """Least distance between the borders, edge by edge."""
    import numpy as np

    s, t = np.array(edges_of(a)), np.array(edges_of(b))
    best = np.inf
    for p, q in ((s, t), (t, s)):
        d = q[:, 2:] - q[:, :2]
        length = (d**2).sum(axis=1)
        for x in np.array_split(p[:, :2], max(1, len(p) // 200)):
            away = x[:, None, :] - q[None, :, :2]
            share = np.clip((away * d).sum(axis=2) / length, 0, 1)
            best = min(best, np.sqrt(((away - share[..., None] * d) ** 2).sum(axis=2)).min())
    return best


def shapes_of(n):
    ring_land = geom([*wavy(n, 100)["polys"][0], wavy(n, 85, turn=0.1)["polys"][0][0]])
    return {
        "beside": (wavy(n, 100), wavy(n, 100, 223.0)), "diagonal": (wavy(n, 100), wavy(n, 100, 160.0, 160.0)), "around": (ring_land, wavy(n, 60, 0.3)),
        "combs": (comb(n), comb(n, left=n / 2 + 5.0)), "upright": (comb(n, along="y"), wavy(n, 30, 60.0, n / 4)), "square": (wavy(n, 100), square(150, -3, 6)),
    }


@pytest.mark.parametrize("name", list(shapes_of(9)))
def test_outlines_against_brute_force(spark, name):
    a, b = shapes_of(1_200)[name]
    assert one(spark, g.distance("a", "b"), a=a, b=b) == pytest.approx(brute_distance(a, b), rel=1e-9)
    assert not one(spark, g.intersects("a", "b"), a=a, b=b)
    for dx in (-45.0, 45.0):  # moved until the borders meet
        moved = geom([[{"x": v["x"] + dx, "y": v["y"] + dx / 3} for v in r] for r in b["polys"][0]])
        meets = one(spark, g.borders_touch("a", "b"), a=a, b=moved)
        assert meets == (brute_distance(a, moved) < 0.5 and crosses(a, moved))


def crosses(a, b):
    """Any two edges share a point: signs of the corners' sides, edge by edge."""
    import numpy as np

    s, t = np.array(edges_of(a)), np.array(edges_of(b))
    side = lambda p, q, x, y: (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0])
    for e in s:
        p, q = e[:2], e[2:]
        one_side = side(p, q, t[:, 0], t[:, 1]) * side(p, q, t[:, 2], t[:, 3]) <= 0
        d = t[:, 2:] - t[:, :2]
        other = (d[:, 0] * (p[1] - t[:, 1]) - d[:, 1] * (p[0] - t[:, 0])) * (d[:, 0] * (q[1] - t[:, 1]) - d[:, 1] * (q[0] - t[:, 0])) <= 0
        boxes = (np.minimum(t[:, 0], t[:, 2]) <= max(p[0], q[0])) & (np.maximum(t[:, 0], t[:, 2]) >= min(p[0], q[0])) & (np.minimum(t[:, 1], t[:, 3]) <= max(p[1], q[1])) & (np.maximum(t[:, 1], t[:, 3]) >= min(p[1], q[1]))
        if (one_side & other & boxes).any():
            return True
    return False


@pytest.mark.parametrize("name", list(shapes_of(9)))
def test_long_outlines(spark, name):
    """10,000 vertices on each side: seconds, not the product of the numbers."""
    import time

    a, b = shapes_of(10_000)[name]
    start = time.time()
    assert not one(spark, g.borders_touch("a", "b"), a=a, b=b)
    found = one(spark, g.distance("a", "b"), a=a, b=b)
    assert time.time() - start < 60
    # found edge by edge, in half a minute each
    assert found == pytest.approx({"beside": 3.152059045248355, "diagonal": 6.369407640329062}.get(name, found), rel=1e-9) and found > 0


def test_long_outline_validity(spark):
    shape = wavy(10_000, 100)
    assert one(spark, g.is_valid("a"), a=shape) and one(spark, g.is_valid("a"), a=comb(10_000))
    crossed = geom([[*shape["polys"][0][0]]])
    crossed["polys"][0][0][4000], crossed["polys"][0][0][4001] = crossed["polys"][0][0][4001], crossed["polys"][0][0][4000]
    crossed["polys"][0][0][7000] = {"x": 0.0, "y": 130.0}
    assert not one(spark, g.is_valid("a"), a=crossed)


def metric(lon, lat, zone):
    """UTM position by the power series in the longitude difference."""
    a, f, k = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    p2, phi, lam = e2 / (1 - e2), math.radians(lat), math.radians(lon - (6 * zone - 183))
    n, t, c, x = a / math.sqrt(1 - e2 * math.sin(phi) ** 2), math.tan(phi) ** 2, p2 * math.cos(phi) ** 2, math.cos(phi) * lam
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi) - 35 * e2**3 / 3072 * math.sin(6 * phi)
    )
    east = k * n * (x + (1 - t + c) * x**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * p2) * x**5 / 120) + 500000
    north = k * (m + n * math.tan(phi) * (x * x / 2 + (5 - t + 9 * c + 4 * c * c) * x**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * p2) * x**6 / 720))
    return east, north


def test_city_boxes(spark):
    """Each city's box, back in metres, is the envelope of its areas grown by the buffer."""
    from quartier.plans.boxes import city_boxes

    areas = [("San Pedro", square(-88.05, 15.45, 0.03)), ("San Pedro", square(-88.0, 15.5, 0.02)), ("Guatemala", square(-90.55, 14.6, 0.04))]
    df = frame(spark, areas, "city string")
    for buffer in (1000.0, 250.0):
        got = {r["city"]: r for r in city_boxes(df, "city", buffer).collect()}
        assert got["San Pedro"]["file_name"] == "San_Pedro" and len(got) == 2
        for city, (x0, y0, x1, y1) in {"San Pedro": (-88.05, 15.45, -87.98, 15.52), "Guatemala": (-90.55, 14.6, -90.51, 14.64)}.items():
            points = [metric(x, y, 16) for x in (x0, x1) for y in (y0, y1)]
            west, east = min(p[0] for p in points) - buffer, max(p[0] for p in points) + buffer
            south, north = min(p[1] for p in points) - buffer, max(p[1] for p in points) + buffer
            b = got[city]["bbox"]
            # each side of the box is set by a corner of the grown envelope
            sides = [abs(metric(b["xmin"], y, 16)[0] - west) for y in (b["ymin"], b["ymax"])] + [abs(metric(b["xmax"], y, 16)[0] - east) for y in (b["ymin"], b["ymax"])]
            assert min(sides[:2]) < 2 and min(sides[2:]) < 2
            assert min(abs(metric(x, b["ymin"], 16)[1] - south) for x in (b["xmin"], b["xmax"])) < 2
            assert min(abs(metric(x, b["ymax"], 16)[1] - north) for x in (b["xmin"], b["xmax"])) < 2
            assert b["xmin"] < x0 and b["xmax"] > x1 and b["ymin"] < y0 and b["ymax"] > y1
