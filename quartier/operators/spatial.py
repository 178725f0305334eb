"""Spatial joins rewritten as equi-joins on grid cells.

A feature is listed in every cell its bounding box meets; a pair is reported only in the first cell
both share, so no distinct is needed. A feature that would cover many cells moves to a coarser grid level
of its own; a pair meets at the coarser level of the two. The join's partitions are cut at run time where a cell is hot
(adaptive execution), whichever side it is hot on; nothing is dealt by row number, so a task that runs again gives its rows again.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.functions import geometry as g
from quartier.operators.skew import lookup_join, spread_rows
from quartier.session import materialise

MAX_CELLS = 64
#: Features of one cell in one list; how much finer the cells of lists are than those of pairs, so that features contain some.
CHUNK, FINER = 128, 4
#: How much finer the cells of ``meeting_ids`` are, and features of one cell in one of its lists.
FINEST, IDS = 8, 1024


def _cell(value: str, size: str) -> str:
    return f"CAST(floor({value} / {size}) AS BIGINT)"


def _level(bbox: str, cell: float, max_cells: int) -> str:
    """Smallest grid level at which the box covers about ``max_cells`` cells or fewer, whatever its shape."""
    side = f"greatest({bbox}.xmax - {bbox}.xmin, {bbox}.ymax - {bbox}.ymin) / {cell * math.sqrt(max_cells)}"
    return f"CAST(ceil(log2(greatest({side}, 1D))) AS INT)"


def _spread(df: DataFrame, bbox: str, cell: float, prefix: str) -> DataFrame:
    """One row per cell of the row's grid level ``_level``; keeps the first cell for de-duplication."""
    size = f"({float(cell)}D * pow(2D, _level))"
    x0, x1 = _cell(f"{bbox}.xmin", size), _cell(f"{bbox}.xmax", size)
    y0, y1 = _cell(f"{bbox}.ymin", size), _cell(f"{bbox}.ymax", size)
    return (
        df.selectExpr(
            "*", f"{x0} AS _{prefix}x", f"{y0} AS _{prefix}y", f"sequence({x0}, {x1}) AS _cols", f"sequence({y0}, {y1}) AS _rows"
        )
        .selectExpr("*", "explode(_cols) AS _cx")
        .selectExpr("*", "explode(_rows) AS _cy")
        .drop("_cols", "_rows")
    )


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    cell: float,
    predicate: Callable[[str, str], str] | None = g.intersects,
    equal: Sequence[str] = (),
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """Pairs of features whose boxes meet and for which ``predicate(left geom, right geom)`` holds.

    Both sides carry ``geom`` and ``bbox``; ``predicate=None`` compares boxes only. Output columns are
    prefixed ``l_`` and ``r_`` except those in ``equal``, which must match. Each side is listed once; the
    levels in use are read from the boxes before.
    """
    equal = list(equal)

    def prefixed(df: DataFrame, prefix: str) -> list[str]:
        return [c if c in equal else f"{c} AS {prefix}{c}" for c in df.columns]

    def listed(df: DataFrame, other: DataFrame, prefix: str, own: str) -> DataFrame:
        """The feature's level and the coarser ones that the other side uses (one row of a few numbers)."""
        used = other.selectExpr(f"collect_set({_level('bbox', cell, max_cells)}) AS used").scalar()
        tagged = df.selectExpr(*prefixed(df, prefix), f"{_level('bbox', cell, max_cells)} AS {own}").withColumn("_used", used)
        levels = f"array_union(array({own}), filter(_used, u -> u > {own}))"
        return tagged.selectExpr(*[c for c in tagged.columns if c != "_used"], f"explode({levels}) AS _level")

    a, b = listed(left, right, "l_", "_al"), listed(right, left, "r_", "_bl")
    if predicate is g.intersects:
        # where both are boxes, boxes that meet are all
        a, b = (d.withColumn(f"_{p}", F.expr(g.is_box(f"{p}_geom", f"{p}_bbox"))) for d, p in ((a, "l"), (b, "r")))
        predicate = lambda x, y: f"(_l AND _r OR {g.intersects(x, y)})"
    a = _spread(a, "l_bbox", cell, "a")
    b = _spread(b, "r_bbox", cell, "b")
    condition = f"_level = greatest(_al, _bl) AND _cx = greatest(_ax, _bx) AND _cy = greatest(_ay, _by) AND {g.boxes_meet('l_bbox', 'r_bbox')}"
    if predicate is not None:
        condition = f"{condition} AND {predicate('l_geom', 'r_geom')}"
    keys = [*equal, "_level", "_cx", "_cy"]
    right = b.selectExpr(*[f"{c} AS _k_{c}" if c in keys else c for c in b.columns])
    # unfolded over cells: Spark's estimate of a side is that of its file, by which it would broadcast all cells of a large one
    joined = a.hint("merge").join(right, F.expr(" AND ".join([*[f"{c} = _k_{c}" for c in keys], condition])))
    return joined.drop(*[f"_k_{c}" for c in keys], "_level", "_cx", "_cy", "_al", "_ax", "_ay", "_bl", "_bx", "_by", "_l", "_r")


def _slim(df: DataFrame) -> DataFrame:
    """``df`` with ``whole``, whether its geometry is its box; such rows carry no outline (``geom`` is NULL there)."""
    tagged = df.withColumn("whole", F.expr(f"coalesce({g.is_box('geom', 'bbox')}, false)"))
    return tagged.withColumn("geom", F.expr("CASE WHEN NOT whole THEN geom END"))


def _shape(row: str = "") -> str:
    """The outline of a row of ``_slim``."""
    at = f"{row}." if row else ""
    return f"CASE WHEN {at}whole THEN {g.envelope(f'{at}bbox')} ELSE {at}geom END"


def _cell_lists(right: DataFrame, by: list[str], cell: float, levels: DataFrame, max_cells: int) -> DataFrame:
    """Features by cell of their grid level and of the coarser ``levels``: (by, _level, _cx, _cy, own), lists of CHUNK or so.

    A cell that lies in a feature lists that one only: whatever meets another feature there meets this one too.
    """
    at = [*by, "_level", "_cx", "_cy"]
    # copies say nothing new
    shapes = _slim(right.select(*by, "geom", "bbox").distinct()).withColumn("_own", F.expr(_level("bbox", cell, max_cells)))
    listed = shapes.withColumn("_used", levels.scalar()).selectExpr("*", "explode(array_union(array(_own), filter(_used, u -> u > _own))) AS _level")
    size = f"({cell}D * pow(2D, _level))"
    cells = " * ".join(f"({_cell(f'bbox.{c}max', size)} - {_cell(f'bbox.{c}min', size)} + 1)" for c in "xy")
    dealt = spread_rows(listed.drop("_used"), cells)
    frame = g.box(f"_cx * {size}", f"_cy * {size}", f"(_cx + 1) * {size}", f"(_cy + 1) * {size}")
    inside = g.let(frame, lambda f: f"{g.box_contains('bbox', f)} AND (whole OR {g.box_within(f, 'geom')})")
    spread = materialise(_spread(dealt, "bbox", cell, "b").selectExpr(*at, "struct(whole, bbox, geom) AS f", f"coalesce({inside}, false) AS _full"))
    full = spread.where("_full").groupBy(*at).agg(F.expr("array(any_value(f)) AS own"))
    rest = lookup_join(spread.where("NOT _full"), full.select(*at), at, "left_anti")
    many = rest.groupBy(*at).agg(F.expr("count(1) AS _n")).where(f"_n > {CHUNK}")
    piece = f"CASE WHEN _n IS NULL THEN 0 ELSE CAST(pmod(xxhash64(f), CAST(ceil(_n / {CHUNK}) AS INT)) AS INT) END AS _chunk"
    lists = lookup_join(rest, many, at, "left").selectExpr(*at, "f", piece).groupBy(*at, "_chunk").agg(F.collect_list("f").alias("own"))
    return full.unionByName(lists.drop("_chunk"))


def met_groups(
    left: DataFrame, right: DataFrame, cell: float, key: Sequence[str], by: Sequence[str] = (), max_cells: int = MAX_CELLS
) -> DataFrame:
    """Rows of ``left`` (unique by ``key``) once for every group ``by`` of ``right`` with a feature that they meet: (by, key, geom, bbox).

    No pairs are made: a row meets lists of features by grid cell and stops at the first hit, and cells that lie in one feature list that one
    only. So where features lie many deep a row is compared about once. Grid levels are those of ``spatial_join``.
    """
    by, key, cell = list(by), list(key), float(cell)
    own = _level("bbox", cell, max_cells)
    levels = lambda df: df.selectExpr(f"collect_set({own}) AS used")
    lists = materialise(_cell_lists(right, by, cell, levels(left), max_cells))
    rows = _slim(left.select(*key, "geom", "bbox")).withColumn("_used", levels(right).scalar()).selectExpr("*", f"{own} AS _own").selectExpr(
        *key, "geom", "bbox", "whole", "explode(array_union(array(_own), filter(_used, u -> u > _own))) AS _level"
    )
    at = ["_level", "_cx", "_cy"]
    spread = _spread(rows, "bbox", cell, "a").select(*key, "geom", "bbox", "whole", *at)
    both, near = "whole AND f.whole", g.boxes_meet("bbox", "f.bbox")
    exact = g.let(_shape(), lambda a: g.let(_shape("f"), lambda b: g.intersects(a, b)))
    hit = f"exists(own, f -> {both} AND {near}) OR exists(own, f -> NOT ({both}) AND {near} AND {exact})"
    met = spread.hint("merge").join(lists, at).where(hit)
    once = met.groupBy(*by, *key).agg(F.expr("any_value(struct(whole, bbox, geom)) AS _s"))
    return once.selectExpr(*by, *key, f"{_shape('_s')} AS geom", "_s.bbox AS bbox")


def _with_cut(df: DataFrame) -> DataFrame:
    """Add ``edge``, the sloped edge (x, y, dx, dy), area to its left, of a convex outline whose other edges are sides of its box; NULL for any other.

    A box listed another way than ``is_box`` wants has no such edge: zeros, to whose left all lies.
    """
    ring = "geom.polys[0][0]"
    plain = f"geom.type = 'Polygon' AND size(geom.polys) = 1 AND size(geom.polys[0]) = 1 AND size({ring}) BETWEEN 4 AND 6 AND {ring}[0] = element_at({ring}, -1)"
    turn = "(p.bx - p.ax) * (q.by - q.ay) - (p.by - p.ay) * (q.bx - q.ax)"
    edges = df.selectExpr("*", f"CASE WHEN NOT whole AND {plain} AND bbox = {g.bounds('geom')} THEN {g.ring_segments(ring)} END AS _e")
    # outlines of at most five edges wind once if they turn one way
    turns = edges.selectExpr(
        "*", f"zip_with(_e, concat(slice(_e, 2, size(_e) - 1), slice(_e, 1, 1)), (p, q) -> {turn}) AS _t", "filter(_e, s -> s.ax <> s.bx AND s.ay <> s.by) AS _c"
    ).selectExpr("*", "CASE WHEN size(_c) <= 1 THEN CASE WHEN array_min(_t) > 0 THEN 1D WHEN array_max(_t) < 0 THEN -1D END END AS _w", "get(_c, 0) AS _s")
    part = {"x": "_s.ax", "y": "_s.ay", "dx": "_w * (_s.bx - _s.ax)", "dy": "_w * (_s.by - _s.ay)"}
    edge = f"named_struct({', '.join(f"'{k}', coalesce({v}, 0D)" for k, v in part.items())})"
    return turns.selectExpr(*df.columns, f"CASE WHEN _w IS NOT NULL THEN {edge} END AS edge")


def _beside(edge: str, box: str, whole: bool = False) -> str:
    """Some corner of a box (``whole``: every corner) lies on the edge or to its left."""
    near, far = ("min", "max") if whole else ("max", "min")
    y, x = (f"IF({edge}.d{a} > 0, {box}.{c}{p}, {box}.{c}{q})" for a, c, p, q in (("x", "y", near, far), ("y", "x", far, near)))
    return f"{edge}.dx * ({y} - {edge}.y) >= {edge}.dy * ({x} - {edge}.x)"


def _id_lists(rows: DataFrame, at: list[str], item: str) -> DataFrame:
    """Items of a cell in lists of IDS or so: (at, own)."""
    many = rows.groupBy(*at).agg(F.expr("count(1) AS _n")).where(f"_n > {IDS}")
    piece = f"CASE WHEN _n IS NULL THEN 0 ELSE CAST(pmod(xxhash64(id), CAST(ceil(_n / {IDS}) AS INT)) AS INT) END AS _chunk"
    return lookup_join(rows, many, at, "left").selectExpr(*at, f"{item} AS own", piece).groupBy(*at, "_chunk").agg(F.collect_list("own").alias("own")).drop("_chunk")


def meeting_ids(left: DataFrame, right: DataFrame, cell: float, left_key: str, right_key: str) -> DataFrame:
    """Ids (l_<left_key>, r_<right_key>) of all pairs of features that meet: what ``spatial_join`` finds, where nothing but ids is wanted.

    Fine cells that lie in a feature of ``right`` list its id: what is listed there on the left meets it without a test. In the
    cells of its border boxes are compared with boxes, or with boxes cut by one edge; neither reads an outline. So a pair
    costs little more than its row. Boxes and any other outline are compared in its border cells only; a
    left feature that is no box goes through ``spatial_join``. Grid levels and the cell that reports a pair are those of ``spatial_join``.
    """
    cell, most = float(cell) / FINEST, MAX_CELLS * FINEST
    own = _level("bbox", cell, most)
    # written once: outlines are read here only
    lefts = materialise(_slim(left.selectExpr(f"{left_key} AS id", "geom", "bbox")).selectExpr("*", f"{own} AS _own"))
    shapes = materialise(_with_cut(_slim(right.selectExpr(f"{right_key} AS id", "geom", "bbox"))).selectExpr("*", f"{own} AS _own"))
    boxes = lefts.where("whole").select("id", "bbox", "_own")

    def at_levels(df: DataFrame, other: DataFrame) -> DataFrame:
        """Rows at their own grid level and at the coarser ones that the other side uses (a few numbers)."""
        coarser = ", ".join(str(u) for u in sorted(other.selectExpr("collect_set(_own)").first()[0]) if u > 0)
        return df.selectExpr("*", f"explode(array_union(array(_own), filter(array({coarser}), u -> u > _own))) AS _level" if coarser else "_own AS _level")

    size = f"({cell}D * pow(2D, _level))"
    cells = " * ".join(f"({_cell(f'bbox.{c}max', size)} - {_cell(f'bbox.{c}min', size)} + 1)" for c in "xy")
    listed = materialise(spread_rows(at_levels(shapes, boxes), cells))
    # whether the cell is of the feature's own level, and in its first column and row
    first = ["_own = _level AS _lo", "_bx = _cx AS _fx", "_by = _cy AS _fy"]
    at = ["_level", "_cx", "_cy", "_lo", "_fx", "_fy"]
    frame = f"{g.box(f'_cx * {size}', f'_cy * {size}', f'(_cx + 1) * {size}', f'(_cy + 1) * {size}')} AS f"

    def in_cells(features: DataFrame, inside: str) -> DataFrame:
        """The features by cell, and whether the cell ``f`` lies in them."""
        return _spread(features, "bbox", cell, "b").selectExpr("*", *first, frame).selectExpr(
            *at, "id", "bbox", "edge", "geom", f"coalesce({g.box_contains('bbox', 'f')} AND {inside}, false) AS _full"
        )

    plain = in_cells(listed.where("whole OR edge IS NOT NULL"), f"(whole OR {_beside('edge', 'f', True)})")
    outlines = in_cells(listed.where("NOT whole AND edge IS NULL"), g.box_within("f", "geom"))
    any_outline = not listed.where("NOT whole AND edge IS NULL").isEmpty()
    inner = plain.where("_full").select(*at, "id")
    if any_outline:
        inner = inner.unionByName(outlines.where("_full").select(*at, "id"))
    full = materialise(_id_lists(inner, at, "id"))
    lists = materialise(_id_lists(plain.where("NOT _full").select(*at, "id", "bbox", "edge"), at, "struct(id AS other, bbox AS b, edge AS e)"))

    rows = _spread(at_levels(boxes, shapes), "bbox", cell, "a").selectExpr(
        "id AS l", "bbox AS a", "_level AS _l", "_cx AS _x", "_cy AS _y", "_own = _level AS _la", "_ax = _cx AS _xa", "_ay = _cy AS _ya"
    )
    same = "_l = _level AND _x = _cx AND _y = _cy AND (_la OR _lo) AND (_xa OR _fx) AND (_ya OR _fy)"
    near = g.boxes_meet("a", "b")
    by_full = rows.drop("a").hint("merge").join(full, F.expr(same)).selectExpr("l", "explode(own) AS r")
    by_border = rows.hint("merge").join(lists, F.expr(same)).selectExpr("l", "a", "inline(own)").where(
        f"{near} AND (e IS NULL OR {_beside('e', 'a')})"
    ).selectExpr("l", "other AS r")
    pairs = by_full.unionByName(by_border)
    if any_outline:
        others = outlines.where("NOT _full").selectExpr(*at, "id AS r", "bbox AS b", "geom")
        exact = f"{same} AND {near} AND {g.intersects(g.envelope('a'), 'geom')}"
        pairs = pairs.unionByName(rows.hint("merge").join(others, F.expr(exact)).select("l", "r"))
    if not lefts.where("NOT whole").isEmpty():
        rest = spatial_join(lefts.where("NOT whole").select("id", "geom", "bbox"), right.selectExpr(f"{right_key} AS id", "geom", "bbox"), cell * FINEST)
        pairs = pairs.unionByName(rest.selectExpr("l_id AS l", "r_id AS r"))
    return pairs.selectExpr(f"l AS l_{left_key}", f"r AS r_{right_key}")


def spatial_semi(
    left: DataFrame, right: DataFrame, cell: float, key: Sequence[str],
    predicate: Callable[[str, str], str] | None = g.intersects,
) -> DataFrame:
    """Rows of ``left`` (unique by ``key``) that meet any feature of ``right``."""
    if predicate is g.intersects:
        hits = met_groups(left, right, cell / FINER, key).select(*key)
    else:
        slim = spatial_join(left.select(*key, "geom", "bbox"), right.select("geom", "bbox"), cell, predicate)
        hits = slim.selectExpr(*[f"l_{c} AS {c}" for c in key]).distinct()
    return left.join(hits, list(key), "left_semi")


def inside_box(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, bbox: str = "bbox") -> DataFrame:
    """Rows whose box lies strictly inside a rectangle; reaches the Parquet scan as four pushed filters."""
    return df.where(
        f"{bbox}.xmin > {xmin} AND {bbox}.xmax < {xmax} AND {bbox}.ymin > {ymin} AND {bbox}.ymax < {ymax}"
    )


def _literal_box(xmin: float, ymin: float, xmax: float, ymax: float) -> str:
    return g.box(str(xmin), str(ymin), str(xmax), str(ymax))


def meets_box(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Rows touching one rectangle: box test for the scan, exact test for the rest."""
    return df.where(
        f"bbox.xmin <= {xmax} AND bbox.xmax >= {xmin} AND bbox.ymin <= {ymax} AND bbox.ymax >= {ymin}"
    ).where(g.intersects_box("geom", _literal_box(xmin, ymin, xmax, ymax)))


def overlay_box(left: DataFrame, boxes: DataFrame, cell: float, equal: Sequence[str] = ()) -> DataFrame:
    """Left geometries cut by each rectangle they meet (``geom`` of ``boxes`` is its ``bbox``)."""
    pairs = spatial_join(left, boxes, cell, None, equal)
    others = [c for c in pairs.columns if c not in ("l_geom", "r_geom")]
    cut = pairs.selectExpr(*others, f"{g.clip('l_geom', 'r_bbox')} AS geom")
    return cut.where(f"geom IS NOT NULL AND {g.area('geom')} > 0")


def clip_box(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Geometries cut by one rectangle; those outside are dropped."""
    near = df.where(
        f"bbox.xmin <= {xmax} AND bbox.xmax >= {xmin} AND bbox.ymin <= {ymax} AND bbox.ymax >= {ymin}"
    )
    others = [c for c in df.columns if c != "geom"]
    cut = near.selectExpr(*others, f"{g.clip('geom', _literal_box(xmin, ymin, xmax, ymax))} AS geom")
    return cut.where(f"geom IS NOT NULL AND {g.area('geom')} > 0")
