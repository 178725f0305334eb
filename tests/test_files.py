from __future__ import annotations

import json
import os
import struct

import pytest

from quartier.plans import prediction
from quartier.session import ensure_checkpoint_dir
from quartier.sources import registry, sinks, vectors
from quartier.sources.wkb import decode_wkb
from tests.shapes import frame, geom, ring, square


def test_wkb_kinds_and_byte_orders(spark):
    point = struct.pack(">BIdd", 0, 1, 3.0, 4.0)
    line = struct.pack("<BII4d", 1, 2, 2, 0.0, 0.0, 1.0, 2.0)
    poly = struct.pack("<BIII8d", 1, 3, 1, 4, 0, 0, 1, 0, 1, 1, 0, 0)
    multi = struct.pack("<BII", 1, 6, 2) + poly + poly
    rows = [(1, point), (2, line), (3, poly), (4, multi), (5, b"\x01\x03"), (6, None)]
    df = decode_wkb(spark.createDataFrame(rows, "id long, geometry binary"))
    got = {r["id"]: r for r in df.collect()}
    assert [got[i]["geom"]["type"] for i in (1, 2, 3, 4)] == ["Point", "LineString", "Polygon", "MultiPolygon"]
    assert len(got[4]["geom"]["polys"]) == 2 and got[1]["bbox"]["xmin"] == 3
    assert got[5]["geom"] is None and got[6]["geom"] is None


def test_prediction_tree(spark, tmp_path):
    """country/city/vector_output/*.json with one feature per line inside a collection, one file empty."""
    def feature(x):
        return json.dumps({"type": "Feature", "properties": {"n": x}, "geometry": {"type": "Polygon", "coordinates": [[[x, 0], [x + 1, 0], [x, 1], [x, 0]]]}})

    for country, city, n in (("Panama", "Colon", 2), ("Panama", "David+City", 1), ("El Salvador", "Sonsonate", 0)):
        folder = tmp_path / country / city / "vector_output"
        os.makedirs(folder)
        body = "" if n == 0 else '{"type": "FeatureCollection", "features": [\n' + ",\n".join(feature(i) for i in range(n)) + "\n]}"
        (folder / "class-1-slums.json").write_text(body)
    df = prediction.merge_predictions(spark, str(tmp_path))
    rows = sorted((r["country"], r["city"], r["properties"]["n"]) for r in df.collect())
    assert rows == [("Panama", "Colon", "0"), ("Panama", "Colon", "1"), ("Panama", "David+City", "0")]
    assert {r["geom"]["type"] for r in df.collect()} == {"Polygon"}


def test_geojson_round_trip(spark, tmp_path):
    path = str(tmp_path / "g")
    shapes = [square(0, 0), geom([ring((0, 0), (4, 0), (4, 4))], [ring((9, 9), (10, 9), (9, 10))])]
    sinks.write_geojson(frame(spark, list(enumerate(shapes))), path)
    got = {int(r["properties"]["id"]): r["geom"].asDict(recursive=True) for r in vectors.read_geojson(spark, path).collect()}
    assert got == dict(enumerate(shapes))


def test_feature_source_needs_input(spark):
    with pytest.raises(ValueError):
        vectors.features(spark)


def test_failing_gate(spark):
    good = frame(spark, [(1, square(0, 0))]).selectExpr("*", "1 AS class_id")
    assert vectors.require_features(good).count() == 1
    bad = good.selectExpr("id", "named_struct('type', 'Point', 'polys', geom.polys) AS geom", "bbox", "class_id")
    with pytest.raises(Exception, match="polygons with a class id"):
        vectors.require_features(bad).collect()
    assert [r["reason"] for r in vectors.check_features(bad).collect()] == ["not a polygon"]


def test_registry(spark, tmp_path):
    cities = spark.createDataFrame([("a", "x"), ("b", "y")], "city string, labels_path string")
    assert registry.select_cities(cities, "a").count() == 1 and registry.select_cities(cities).count() == 2
    with pytest.raises(TypeError):
        registry.select_cities(cities, 3)
    (tmp_path / "f.txt").write_text("1")
    assert registry.listing(spark, str(tmp_path)).count() == 1


def test_checkpoint_dir_is_read_from_the_session(spark):
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()


def test_points_lines_heights_and_srid(spark):
    import struct

    from quartier.sources.wkb import _read, _write

    line = {"type": "LineString", "polys": [[[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 2.0}]]]}
    spot = {"type": "Point", "polys": [[[{"x": 3.0, "y": 4.0}]]]}
    for geom in (line, spot):
        kind, polys, _ = _read(_write(geom), 0)
        assert {"type": kind, "polys": polys} == geom
    ring = [(0, 0, 9), (1, 0, 9), (1, 1, 9), (0, 0, 9)]
    body = struct.pack("<I", 1) + struct.pack("<I", 4) + b"".join(struct.pack("<ddd", *v) for v in ring)
    want = [[[{"x": x, "y": y} for x, y, _ in ring]]]
    assert _read(struct.pack("<BI", 1, 1003) + body, 0)[:2] == ("Polygon", want)
    assert _read(struct.pack("<BII", 1, 0xA0000003, 4326) + body, 0)[:2] == ("Polygon", want)


def test_geojson_of_one_line_and_kinds(spark, tmp_path):
    from quartier.functions import geometry as g
    from quartier.sources.vectors import city_predictions, features, read_geojson

    parts = [
        '{"type":"Feature","properties":{"id":"a","class_id":"2"},"geometry":{"type":"Point","coordinates":[1,2]}}',
        '{"type":"Feature","properties":{"id":"b"},"geometry":{"type":"LineString","coordinates":[[0,0],[3,4]]}}',
    ]
    (tmp_path / "one.geojson").write_text('{"type":"FeatureCollection","features":[' + ",".join(parts) + "]}\n")
    got = read_geojson(spark, str(tmp_path / "one.geojson")).selectExpr("kind", f"{g.to_geojson('geom')} AS text").collect()
    assert {r["kind"]: r["text"] for r in got} == {
        "Point": '{"type":"Point","coordinates":[1.0,2.0]}', "LineString": '{"type":"LineString","coordinates":[[0.0,0.0],[3.0,4.0]]}',
    }
    rows = features(spark, uris=[str(tmp_path / "one.geojson")], default_class=1).collect()
    assert {r["id"]: (r["class_id"], r["properties"].get("class_id")) for r in rows} == {"a": (2, "2"), "b": (1, None)}
    assert city_predictions(spark, str(tmp_path / "missing")).count() == 0


def test_line_beside_a_square(spark):
    from quartier.functions import geometry as g

    df = spark.sql(
        "SELECT from_json('{\"type\":\"LineString\",\"polys\":[[[{\"x\":-5,\"y\":-5},{\"x\":10,\"y\":-5},{\"x\":10,\"y\":10}]]]}', "
        "'type string, polys array<array<array<struct<x:double,y:double>>>>') AS a, "
        f"{g.rectangle('0D', '0D', '1D', '1D')} AS b, {g.rectangle('9D', '0D', '11D', '1D')} AS c"
    )
    assert df.selectExpr(g.intersects("a", "b"), g.intersects("a", "c")).first()[:] == (False, True)


def test_country_files(spark, tmp_path):
    def feature(x, city):
        return {"type": "Feature", "properties": {"city": city}, "geometry": {"type": "Polygon", "coordinates": [[[x, 0], [x + 1, 0], [x, 1], [x, 0]]]}}

    for country, cities, gap in (("Panama", ["Colon", "David"], None), ("El Salvador", ["Sonsonate"], 0)):
        (tmp_path / country).mkdir()
        lines = ",\n".join(json.dumps(feature(i, c)) for i, c in enumerate(cities))
        body = '{"type": "FeatureCollection", "features": [' + ("\n" if gap is None else "") + lines + ("\n" if gap is None else "") + "]}"
        (tmp_path / country / "averaged_predictions.geojson").write_text(body)
    folder = tmp_path / "Panama" / "Colon" / "vector_output"
    os.makedirs(folder)
    (folder / "class-1-slums.json").write_text(json.dumps(feature(5, "x")))
    got = prediction.merge_predictions(spark, str(tmp_path), by_country=True).collect()
    assert sorted((r["country"], r["city"]) for r in got) == [("El Salvador", "Sonsonate"), ("Panama", "Colon"), ("Panama", "David")]
    assert all(r["geom"]["type"] == "Polygon" for r in got)
    assert prediction.merge_predictions(spark, str(tmp_path)).count() == 1


def test_geoparquet_box_reaches_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = str(tmp_path / "g")
    sinks.write_geoparquet(frame(spark, [(i, square(i, i)) for i in range(50)]), path)
    df = vectors.read_geoparquet(spark, path, box=(3, 3, 8, 8))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert all(f in plan for f in ("LessThanOrEqual(bbox.xmin,8.0)", "GreaterThanOrEqual(bbox.ymax,3.0)"))
    assert sorted(r["id"] for r in df.collect()) == list(range(2, 9))


def layouts(features, crs):
    """The same features in every layout a file may have."""
    head = {"type": "FeatureCollection", "name": 'a "{[ name }\\', "crs": crs}
    return {
        "pretty": json.dumps(head | {"features": features}, indent=2),
        "tabs": json.dumps({"features": features} | head, indent="\t", ensure_ascii=False),
        "one": json.dumps(head | {"features": features}),
        "close": json.dumps({"type": "FeatureCollection", "features": features}, separators=(",", ":")) + "\n",
        "lines": '{"type": "FeatureCollection", "features": [\n' + ",\n".join(map(json.dumps, features)) + "\n]}",
        "plain": "\n".join(map(json.dumps, features)) + "\n",
        "windows": json.dumps(head | {"features": features}, indent=1).replace("\n", "\r\n"),
        "several": "\n".join(json.dumps(head | {"features": features[i : i + 7]}, indent=1) for i in range(0, len(features), 7)),
        "stretched": "\n\n".join(json.dumps(f, indent=1) for f in features),
    }


@pytest.mark.parametrize("size", ["200", "1500", "128m"])
def test_geojson_layouts_and_splits(spark, tmp_path, size):
    """Equal rows from every layout, whether a file is read by one task or by dozens whose borders fall anywhere."""
    names = ["plain", "with } brace", '"{"', "\\", "\\\"}", "line\nbreak }{", "Straße 😀 }", "", '"features":[{', "x" * 900]
    features = [
        {"type": "Feature", "properties": {"id": i, "name": names[i % len(names)], "deep": {"a": [{"b": "}"}]} if i % 3 else None}, "geometry":
         {"type": "Polygon", "coordinates": [[[i, 0], [i + 1, 0], [i, 1.5], [i, 0]]]} if i % 4 else {"type": "MultiPolygon", "coordinates": [[[[i, 0], [i + 1, 0], [i, 2], [i, 0]]]] * (1 + 40 * (i == 8))}}
        for i in range(41)
    ]
    files = layouts(features, {"type": "name", "properties": {"name": "urn:}:{"}})
    for name, text in files.items():
        (tmp_path / f"{name}.geojson").write_bytes(text.encode())
    before = {k: spark.conf.get(f"spark.sql.files.{k}") for k in ("maxPartitionBytes", "openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = vectors.read_geojson(spark, str(tmp_path))
        rows = df.selectExpr("path", "CAST(properties['id'] AS INT) AS id", "properties['name'] AS name", "kind", "geom", "bbox.ymax").collect()
        tasks = spark.read.text(str(tmp_path / "pretty.geojson")).rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.files.{k}", v)
    assert tasks > 50 or size != "200"
    want = sorted((i, names[i % len(names)], "Polygon" if i % 4 else "MultiPolygon", 1.5 if i % 4 else 2.0, 1 + 40 * (i == 8)) for i in range(41))
    for name in files:
        got = sorted((r["id"], r["name"], r["kind"], r["ymax"], len(r["geom"]["polys"])) for r in rows if r["path"].endswith(f"/{name}.geojson"))
        assert got == want, name


def test_geojson_of_nothing(spark, tmp_path):
    for name, text in {"a": "", "b": "\n", "c": '{"type": "FeatureCollection", "features": []}', "d": "{}", "e": '{"type": "FeatureCollection",\n"features": [\n]\n}\n'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert vectors.read_geojson(spark, str(tmp_path)).count() == 0


def test_features_without_geometry(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type":"Feature","properties":null,"geometry":null}\n{"type":"Feature","properties":{"id":1},"geometry":{"type":"Point","coordinates":[1,2]}}')
    got = vectors.read_geojson(spark, str(tmp_path)).collect()
    assert sorted((r["kind"] or "", r["geom"] is None) for r in got) == [("", True), ("Point", False)]
