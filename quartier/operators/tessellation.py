"""Nearest-building cells on a pixel grid and the neighbour measures derived from them."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.functions import geometry as g
from quartier.operators.components import connected_components
from quartier.operators.skew import lookup_join
from quartier.operators.spatial import spatial_join
from quartier.session import materialise


#: Levels of the pyramids are a factor 2**FAN apart. Blocks of at most 2**(FAN * WIDEST) pixels a side are settled at once.
FAN, WIDEST = 2, 2
#: Outlines that a block of pixels may have to choose from before it is divided, and outlines of one cell in one list.
ENOUGH, CHUNK = 96, 128
_BOX = "named_struct('xmin', min({0}.xmin), 'ymin', min({0}.ymin), 'xmax', max({0}.xmax), 'ymax', max({0}.ymax))"


def _children(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, kids): the nodes (keys, x, y, n, box) below each node of the next level, 4**FAN at most."""
    return nodes.selectExpr(*keys, f"shiftright(x, {FAN}) AS _x", f"shiftright(y, {FAN}) AS _y", "struct(x, y, n, box) AS kid").groupBy(
        *keys, F.col("_x").alias("x"), F.col("_y").alias("y")
    ).agg(F.collect_list("kid").alias("kids"))


def _pyramid(nodes: DataFrame, keys: list[str], steps: int) -> dict[int, DataFrame]:
    """Children by level 1 to ``steps`` of the nodes of level 0, and the nodes of the top under 0."""
    lowest = materialise(_children(nodes, keys))
    own = lowest.selectExpr(*keys, "x", "y", "aggregate(kids, 0L, (s, k) -> s + k.n) AS n", f"{g.box('array_min(kids.box.xmin)', 'array_min(kids.box.ymin)', 'array_max(kids.box.xmax)', 'array_max(kids.box.ymax)')} AS box")
    levels = own.selectExpr(*keys, f"explode(sequence(0, {steps - 1})) AS l", "x", "y", "n", "box").selectExpr(
        *keys, "l + 1 AS level", f"shiftright(x, {FAN} * l) AS x", f"shiftright(y, {FAN} * l) AS y", "n", "box"
    )
    upper = materialise(levels.groupBy(*keys, "level", "x", "y").agg(F.sum("n").alias("n"), F.expr(f"{_BOX.format('box')} AS box")))
    return {1: lowest, 0: upper.where(f"level = {steps}")} | {i + 1: _children(upper.where(f"level = {i}"), keys) for i in range(1, steps)}


def _gap2(a: str, b: str) -> str:
    """Square of the distance between two boxes. Squares are compared, as roots would cost more than all else."""
    x, y = (f"greatest({a}.{c}min - {b}.{c}max, {b}.{c}min - {a}.{c}max, 0D)" for c in "xy")
    return f"({x} * {x} + {y} * {y})"


def _far2(a: str, b: str) -> str:
    """Square of the largest distance between points of two boxes."""
    x, y = (f"greatest({a}.{c}max - {b}.{c}min, {b}.{c}max - {a}.{c}min)" for c in "xy")
    return f"({x} * {x} + {y} * {y})"


def _possible(box: str, found: str) -> str:
    """Of the boxes ``found`` (array of structs with ``box``) those that may hold what is nearest to some point of ``box``."""
    def near(limit: str) -> str:
        # the factor covers rounding, so no tie is lost
        return f"filter({found}, f -> {_gap2(box, 'f.box')} <= {limit} * 1.000000000001D)"

    return g.let(f"array_min(transform({found}, f -> {_far2(box, 'f.box')}))", near)


def candidate_blocks(pixels: DataFrame, outlines: DataFrame, keys: Sequence[str], resolution: float, enough: int = ENOUGH) -> DataFrame:
    """Blocks of pixels and the outlines that may be nearest to one of their centres: (keys, level, x, y, chunk, owners).

    ``pixels`` are (keys, cx, cy, px, py), ``outlines`` (keys, owner, box). Both are nodes of a pyramid; level by level every
    block meets the children of the cells it met before and keeps those no farther off than the nearest one's far corner. So each block searches
    as far as its own surroundings ask for, and a cell is passed on only while it may matter. A block of ``enough`` outlines or
    fewer is settled; others are divided, down to one pixel.
    """
    keys = list(keys)
    dots = pixels.selectExpr(*keys, "CAST(cx AS BIGINT) AS x", "CAST(cy AS BIGINT) AS y", "1L AS n", f"{g.box('px', 'py', 'px', 'py')} AS box")
    place = lambda c: f"CAST(floor((box.{c}min + box.{c}max) / {2 * resolution}) AS BIGINT)"
    placed = outlines.selectExpr(*keys, "owner", "box", f"{place('x')} AS x", f"{place('y')} AS y")
    cells = placed.groupBy(*keys, "x", "y").agg(F.expr("count(1) AS n"), F.expr(f"{_BOX.format('box')} AS box"))
    spans = [d.selectExpr("greatest(max(x) - min(x), max(y) - min(y)) AS d").first()[0] or 0 for d in (dots, cells)]
    steps = max(1, math.ceil(math.log2(max(spans) + 1) / FAN))
    blocks, nodes = _pyramid(dots, keys, steps), _pyramid(cells, keys, steps)
    tops = nodes[0].groupBy(*keys).agg(F.collect_list(F.expr("struct(x, y, n, box)")).alias("cands"))
    # at the top a key has a few blocks and cells
    state = blocks[0].select(*keys, "x", "y", "box").join(tops, keys)
    ready = []
    for level in range(steps, -1, -1):
        if level <= WIDEST:
            state = materialise(state.selectExpr("*", "aggregate(cands, 0L, (s, c) -> s + c.n) AS n"))
            settled = state if level == 0 else state.where(f"n <= {enough}")
            ready.append(settled.selectExpr(*keys, f"{level} AS level", "x", "y", "box", "cands"))
            state = state.where(f"n > {enough}")
        if level == 0:
            break
        met = state.selectExpr(*keys, "x AS bx", "y AS by", "explode(cands) AS c").selectExpr(*keys, "bx", "by", "c.x AS x", "c.y AS y")
        below = lookup_join(met, nodes[level], [*keys, "x", "y"]).groupBy(*keys, F.col("bx").alias("x"), F.col("by").alias("y")).agg(
            F.flatten(F.collect_list("kids")).alias("found")
        )
        # first for the whole block, then for each of its parts
        near = state.select(*keys, "x", "y", "box").join(below, [*keys, "x", "y"]).selectExpr(*keys, "x", "y", f"{_possible('box', 'found')} AS found")
        parts = near.join(blocks[level], [*keys, "x", "y"]).selectExpr(*keys, "explode(kids) AS b", "found")
        state = parts.selectExpr(*keys, "b.x AS x", "b.y AS y", "b.box AS box", f"{_possible('b.box', 'found')} AS cands")
    settled = ready[0]
    for r in ready[1:]:
        settled = settled.unionByName(r)
    # outlines by cell of every level that blocks are settled at, in lists of about CHUNK where a cell has more
    listed = placed.selectExpr(*keys, "owner", "box", f"explode(sequence(0, {WIDEST})) AS level", "x", "y").selectExpr(
        *keys, "owner", "box", "level", f"shiftright(x, {FAN} * level) AS x", f"shiftright(y, {FAN} * level) AS y"
    )
    at = [*keys, "level", "x", "y"]
    full = listed.groupBy(*at).agg(F.expr("count(1) AS _n")).where(f"_n > {CHUNK}")
    piece = f"CASE WHEN _n IS NULL THEN 0 ELSE CAST(pmod(xxhash64(owner), CAST(ceil(_n / {CHUNK}) AS INT)) AS INT) END AS chunk"
    lists = lookup_join(listed, full, at, "left").selectExpr(*at, piece, "struct(owner, box) AS o").groupBy(*at, "chunk").agg(F.collect_list("o").alias("own"))
    met = settled.selectExpr(*keys, "level", "x AS bx", "y AS by", "box", "explode(cands) AS c").selectExpr(*keys, "level", "bx", "by", "box", "c.x AS x", "c.y AS y")
    group = [*keys, "level", "bx", "by"]
    found = lookup_join(met, lists, at).groupBy(*group, "chunk").agg(F.flatten(F.collect_list("own")).alias("own"), F.any_value("box").alias("box"))
    # the least limit of a block's lists holds for all of them
    bounded = found.selectExpr("*", f"min(array_min(transform(own, f -> {_far2('box', 'f.box')}))) OVER (PARTITION BY {', '.join(group)}) AS _limit")
    return bounded.selectExpr(
        *keys, "level", "bx AS x", "by AS y", "chunk", f"filter(own, f -> {_gap2('box', 'f.box')} <= _limit * 1.000000000001D).owner AS owners"
    ).where("size(owners) > 0")


def leading_outlines(outlines: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """``outlines`` (keys, owner, geom, box) without those that lie in a box of a smaller owner: it is as near to any point, and wins ties.

    Outlines are compared within the cell of their lower left corner, in lists of about CHUNK by turns of owners: what has led so far is all a
    list is held against. An outline that other cells or lists would show to be idle stays, which costs time only. Nested copies in one place,
    which differ in size, so leave a few.
    """
    keys = list(keys)
    placed = outlines.selectExpr(
        *keys, *[f"CAST(floor(box.{c}min / {float(cell)}) AS BIGINT) AS _{c}" for c in "xy"],
        f"struct(owner, box, geom, coalesce({g.is_box('geom', 'box')}, false) AS whole) AS o",
    )
    at = [*keys, "_x", "_y"]
    many = placed.groupBy(*at).agg(F.expr("count(1) AS _n")).where(f"_n > {CHUNK}")
    piece = f"CASE WHEN _n IS NULL THEN 0 ELSE CAST(pmod(xxhash64(o.owner), CAST(ceil(_n / {CHUNK}) AS INT)) AS INT) END AS _chunk"
    lists = lookup_join(placed, many, at, "left").selectExpr(*at, "o", piece).groupBy(*at, "_chunk").agg(F.expr("array_sort(collect_list(o)) AS own"))
    idle = f"exists(led, k -> k.whole AND {g.box_contains('k.box', 'o.box')})"
    led = f"aggregate(own, slice(own, 1, 0), (led, o) -> IF({idle}, led, concat(led, array(o))))"
    return lists.selectExpr(*keys, f"inline({led})").select(*keys, "owner", "geom", "box")


def nearest_owner(
    pixels: DataFrame, buildings: DataFrame, keys: Sequence[str], resolution: float, building: str = "bid", enough: int = ENOUGH,
) -> DataFrame:
    """Building owning each pixel centre (px, py): the nearest one, smallest id on ties; (keys, cx, cy, owner, dist).

    ``pixels`` are (keys, cx, cy, px, py), unique by (keys, cx, cy), ``buildings`` (keys, bid, geom, bbox). ``candidate_blocks`` leaves each
    block a short list whatever the density around; a pixel compares box bounds, then the exact distances of the few left.
    Outlines reach a block once, not each of its pixels. Stacked copies of one outline are reduced to their smallest id first, nested ones to those
    that may own a pixel. A pixel without a building under its keys has no row.
    """
    keys = list(keys)
    distinct = materialise(
        buildings.groupBy(*keys, "geom").agg(F.expr(f"min({building}) AS owner")).selectExpr("*", f"{g.bounds('geom')} AS box")
    )
    outlines = materialise(leading_outlines(distinct, keys, resolution))
    pixels = materialise(pixels.selectExpr(*keys, "cx", "cy", "px", "py"))
    at = [*keys, "level", "x", "y"]
    blocks = materialise(candidate_blocks(pixels, outlines.drop("geom"), keys, resolution, enough))
    named = lookup_join(blocks.selectExpr(*at, "chunk", "explode(owners) AS owner"), outlines, [*keys, "owner"])
    lists = named.groupBy(*at, "chunk").agg(F.collect_list(F.struct("owner", "box", "geom")).alias("own"))
    placed = pixels.selectExpr(*keys, f"explode(sequence(0, {WIDEST})) AS level", "struct(cx, cy, px, py) AS p").selectExpr(
        *keys, "level", f"shiftright(CAST(p.cx AS BIGINT), {FAN} * level) AS x", f"shiftright(CAST(p.cy AS BIGINT), {FAN} * level) AS y", "p"
    )
    members = placed.join(blocks.select(*at).distinct(), at, "left_semi").groupBy(*at).agg(F.collect_list("p").alias("pixels"))

    def best(p: str) -> str:
        dot = {"x": f"{p}.px", "y": f"{p}.py"}
        gap = [f"greatest(o.box.{c}min - {v}, {v} - o.box.{c}max, 0D)" for c, v in dot.items()]
        far = [f"greatest({v} - o.box.{c}min, o.box.{c}max - {v})" for c, v in dot.items()]
        square = lambda d: f"({d[0]} * {d[0]} + {d[1]} * {d[1]})"

        def nearest(limit: str) -> str:
            near = f"filter(own, o -> {square(gap)} <= {limit} * 1.000000000001D)"
            return f"array_min(transform({near}, o -> named_struct('dist', {g.point_distance('o.geom', f'{p}.px', f'{p}.py')}, 'owner', o.owner)))"

        return g.let(f"array_min(transform(own, o -> {square(far)}))", nearest)

    each = members.join(lists, at).selectExpr(*keys, "level", "x", "y", "chunk", f"inline(transform(pixels, p -> named_struct('cx', p.cx, 'cy', p.cy, 'best', {best('p')})))")
    many = blocks.where("chunk > 0").select(*at).distinct()
    # pixels whose candidates filled several lists take the best of all
    whole = lookup_join(each, many, at, "left_semi").groupBy(*keys, "cx", "cy").agg(F.min("best").alias("best"))
    single = lookup_join(each, many, at, "left_anti").select(*keys, "cx", "cy", "best")
    return single.unionByName(whole.select(*keys, "cx", "cy", "best")).selectExpr(*keys, "cx", "cy", "best.owner AS owner", "best.dist AS dist")


def cell_areas(owned: DataFrame, keys: Sequence[str], resolution: float) -> DataFrame:
    """Area of each building's cell."""
    return owned.groupBy(*keys, "owner").agg(F.expr(f"count(1) * {resolution * resolution}D AS cell_area"))


def contiguity(owned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs (keys, a, b), a <> b in both directions, of buildings whose cells share a pixel side or corner.

    Every pixel lists its four corners; a corner has at most four pixels and so four owners, whose pairs one
    aggregate finds without a self-join. Pixels with a common side have common corners.
    """
    keys = list(keys)
    corners = ", ".join(f"struct(cx + {i} AS x, cy + {j} AS y)" for i in (0, 1) for j in (0, 1))
    return (
        owned.selectExpr(*keys, "owner", f"explode(array({corners})) AS s")
        .groupBy(*keys, "s.x", "s.y")
        .agg(F.expr("collect_set(owner) AS _owners"))
        .where("size(_owners) > 1")
        .selectExpr(*keys, "_owners", "explode(_owners) AS a")
        .selectExpr(*keys, "a", "explode(_owners) AS b")
        .where("a <> b")
        .distinct()
    )


def within_steps(edges: DataFrame, keys: Sequence[str], steps: int = 3) -> DataFrame:
    """Pairs at most ``steps`` contiguity steps apart, without a building itself.

    Cells of a plane map have few neighbours on average, so each expansion stays near linear; it is
    de-duplicated before the next one.
    """
    keys = list(keys)
    step = edges.selectExpr(*keys, "a AS mid", "b AS c")
    reached = edges.select(*keys, "a", "b")
    frontier = reached
    for _ in range(steps - 1):
        frontier = (
            frontier.withColumnRenamed("b", "mid").join(step, [*keys, "mid"])
            .where("a <> c").selectExpr(*keys, "a", "c AS b").distinct()
        )
        reached = reached.unionByName(frontier)
    return reached.distinct()


def neighbour_distance(edges: DataFrame, buildings: DataFrame, keys: Sequence[str], building: str = "bid") -> DataFrame:
    """Mean distance to the contiguous neighbours."""
    keys = list(keys)
    a = buildings.selectExpr(*keys, f"{building} AS a", "geom AS geom_a")
    b = buildings.selectExpr(*keys, f"{building} AS b", "geom AS geom_b")
    return (
        edges.join(a, [*keys, "a"]).join(b, [*keys, "b"])
        .groupBy(*keys, "a")
        .agg(F.expr(f"avg({g.distance('geom_a', 'geom_b')}) AS neighbour_distance"))
        .withColumnRenamed("a", "owner")
    )


def touching_groups(
    buildings: DataFrame, keys: Sequence[str], cell: float, building: str = "bid"
) -> DataFrame:
    """Component of touching buildings for every building that touches another: (keys, owner, component).

    Copies of one outline are linked to their smallest id; only distinct outlines are compared.
    """
    keys = list(keys)
    outlines = materialise(
        buildings.groupBy(*keys, "geom").agg(F.expr(f"min({building}) AS owner")).selectExpr("*", f"{g.bounds('geom')} AS bbox")
    )
    copies = buildings.join(outlines.select(*keys, "geom", "owner"), [*keys, "geom"]).where(
        f"{building} <> owner"
    ).selectExpr(*keys, f"{building} AS a", "owner AS b")
    pairs = spatial_join(outlines, outlines, cell, equal=keys).where("l_owner < r_owner").selectExpr(
        *keys, "l_owner AS a", "r_owner AS b"
    )
    return connected_components(copies.unionByName(pairs), "a", "b", keys).withColumnRenamed("node", "owner")


def adjacency(near: DataFrame, groups: DataFrame, owners: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Touching groups among a building and its neighbours, divided by their number.

    ``near`` are the pairs of ``within_steps``; a building without contact is a group of its own.
    """
    keys = list(keys)
    members = near.select(*keys, "a", "b").unionByName(owners.selectExpr(*keys, "owner AS a", "owner AS b"))
    grouped = members.join(groups.selectExpr(*keys, "owner AS b", "component"), [*keys, "b"], "left").selectExpr(
        *keys, "a", "coalesce(component, b) AS component"
    )
    # two steps: members per group first, then groups per building
    per_group = grouped.groupBy(*keys, "a", "component").agg(F.expr("count(1) AS n"))
    return per_group.groupBy(*keys, "a").agg(F.expr("count(1) / sum(n) AS adjacency")).withColumnRenamed("a", "owner")
