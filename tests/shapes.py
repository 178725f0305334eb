"""Geometry literals and brute-force helpers for the tests."""
from __future__ import annotations

from quartier.functions import geometry as g


def ring(*points, close=True):
    pts = list(points) + ([points[0]] if close else [])
    return [{"x": float(x), "y": float(y)} for x, y in pts]


def geom(*polys, kind=None):
    """Each poly is a list of rings."""
    return {"type": kind or ("Polygon" if len(polys) == 1 else "MultiPolygon"), "polys": [list(p) for p in polys]}


def square(x, y, side=1.0):
    return geom([ring((x, y), (x + side, y), (x + side, y + side), (x, y + side))])


def frame(spark, rows, columns="id long"):
    """DataFrame of (columns..., geom) with bbox."""
    from quartier.schemas import GEOM

    df = spark.createDataFrame(rows, f"{columns}, geom {GEOM}")
    return df.selectExpr("*", f"{g.bounds('geom')} AS bbox")


def one(spark, expr, **geoms):
    """Evaluate an expression over named geometry literals."""
    from quartier.schemas import GEOM

    schema = ", ".join(f"{k} {GEOM}" for k in geoms)
    return spark.createDataFrame([tuple(geoms.values())], schema).selectExpr(f"{expr} AS v").first()["v"]
