"""Zonal sums of a pixel grid."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.functions import geometry as g
from quartier.operators.skew import salted_join
from quartier.session import materialise

# Place of a block's reference point: shares that round coordinates do not meet.
SHARE_X, SHARE_Y = 0.6180339887498949, 0.4142135623730951
EDGE = "struct<ax: double, ay: double, bx: double, by: double>"


def _block(value: str, block: float) -> str:
    return f"CAST(floor({value} / {block}) AS BIGINT)"


def zonal_sum(
    pixels: DataFrame,
    zones: DataFrame,
    zone_id: Sequence[str],
    value: str = "b1",
    block: float = 1000.0,
    exterior_only: bool = True,
) -> DataFrame:
    """Sum of the pixels whose centre (px, py) lies in each zone: rows (zone_id, total), 0 if none.

    Zones are cut into grid blocks. Blocks wholly inside a zone use one pre-summed row; only blocks that an edge
    meets are joined with their pixels. A border block carries just the edges that meet it and whether its own
    reference point lies inside: a pixel is inside if the way to that point, along its row and then up or down the
    point's column, crosses edges an even number of times (odd, if the point lies outside). Work grows with the
    length of the zones' borders and their number of blocks, never with vertices times blocks or pixels.
    """
    zone_id = list(zone_id)
    geom = g.fill_holes("geom") if exterior_only else "geom"
    slim = materialise(
        zones.where(g.is_areal("geom")).selectExpr(*zone_id, f"{geom} AS geom", "monotonically_increasing_id() AS _z")
        .selectExpr(*zone_id, "_z", "posexplode(geom.polys) AS (_part, _rings)")
        .selectExpr(*zone_id, "_z", "_part", "named_struct('type', 'Polygon', 'polys', array(_rings)) AS geom")
    )
    at = [*zone_id, "_z", "_part"]

    def centre(i: str, share: float) -> str:
        return f"(({i} + {share}D) * {block}D)"

    # blocks whose reference point lies inside
    spans = g.cell_spans(
        "geom", lambda y: f"({y} / {block}D - {SHARE_Y}D)", lambda x: f"({x} / {block}D - {SHARE_X}D)",
        lambda r: centre(r, SHARE_Y), lambda c: centre(c, SHARE_X),
    )
    inside = slim.selectExpr(*at, f"explode({spans}) AS _s").selectExpr(
        *at, "explode(sequence(_s.c0, _s.c1)) AS bx", "_s.row AS by", f"CAST(NULL AS {EDGE}) AS _e"
    )
    # blocks that an edge meets: along the edge, one row of blocks after the other
    edges = slim.selectExpr(*at, f"explode({g.segments('geom')}) AS _e").selectExpr(
        *at, "_e", f"explode(sequence({_block('least(_e.ay, _e.by)', block)}, {_block('greatest(_e.ay, _e.by)', block)})) AS by"
    )
    reach = [
        f"CASE WHEN _e.ay = _e.by THEN _e.{end}x ELSE _e.ax + ({y} - _e.ay) / (_e.by - _e.ay) * (_e.bx - _e.ax) END"
        for end, y in (
            ("a", f"greatest(least(_e.ay, _e.by), by * {block}D)"), ("b", f"least(greatest(_e.ay, _e.by), (by + 1) * {block}D)"),
        )
    ]
    slack = block * 1e-6
    met = edges.selectExpr(*at, "_e", "by", f"{reach[0]} AS _x0", f"{reach[1]} AS _x1").selectExpr(
        *at, f"explode(sequence({_block(f'(least(_x0, _x1) - {slack})', block)}, {_block(f'(greatest(_x0, _x1) + {slack})', block)})) AS bx",
        "by", "_e",
    )
    parts = inside.unionByName(met).groupBy(*at, "bx", "by").agg(
        F.expr("collect_list(_e) AS edges"), F.expr("count_if(_e IS NULL) AS ref")
    )
    blocks = materialise(
        parts.groupBy(*zone_id, "_z", "bx", "by").agg(
            F.expr("bool_or(size(edges) = 0) AS _whole"), F.expr("collect_list(struct(ref, edges)) AS _parts")
        )
    )
    grid = pixels.selectExpr(
        f"{_block('px', block)} AS bx", f"{_block('py', block)} AS by", "px", "py", f"{value} AS _v"
    )
    block_sums = grid.groupBy("bx", "by").agg(F.expr("sum(_v) AS _v"))
    whole = blocks.where("_whole").select(*zone_id, "bx", "by").join(block_sums, ["bx", "by"])
    x, y = centre("bx", SHARE_X), centre("by", SHARE_Y)

    def above(y_at: str) -> str:
        return (
            f"CASE WHEN e.bx > e.ax THEN ({x} - e.ax) * (e.by - e.ay) > ({y_at} - e.ay) * (e.bx - e.ax) "
            f"ELSE ({x} - e.ax) * (e.by - e.ay) < ({y_at} - e.ay) * (e.bx - e.ax) END"
        )

    in_row = f"({g.straddles('e', 'py')} AND (({g.left_of('e', 'px', 'py')}) <> ({g.left_of('e', x, 'py')})))"
    in_column = f"(((e.ax > {x}) <> (e.bx > {x})) AND (({above('py')}) <> ({above(y)})))"
    crossed = f"size(filter(p.edges, e -> {in_row} <> {in_column}))"
    partial = salted_join(
        blocks.where("NOT _whole").select(*zone_id, "_parts", "bx", "by"), grid, ["bx", "by"], "inner",
        f"exists(_parts, p -> (p.ref + {crossed}) % 2 = 1)",
    )
    sums = whole.select(*zone_id, "_v").unionByName(partial.select(*zone_id, "_v")).groupBy(*zone_id).agg(F.expr("sum(_v) AS total"))
    return zones.select(*zone_id).join(sums, zone_id, "left").selectExpr(*zone_id, "coalesce(total, 0D) AS total")
