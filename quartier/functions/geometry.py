"""Geometry as SQL expressions over ``struct<type, polys>`` (polygon -> ring -> vertex, rings closed).

Every function takes and returns expression text, so a composed predicate reaches the JVM as one
parsed expression: ``df.where(g.intersects("l_geom", "r_geom"))``. Nothing runs in Python per row.
"""
from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame

from quartier.schemas import POINT

_names = itertools.count()


def _fn(array: str, body: Callable[[str], str], kind: str = "transform") -> str:
    """Higher-order function with a fresh variable name."""
    v = f"v{next(_names) % 1000}"
    return f"{kind}({array}, {v} -> {body(v)})"


def let(value: str, body: Callable[[str], str]) -> str:
    """Bind ``value`` once, so nested expressions do not repeat it."""
    return f"{_fn(f'array({value})', body)}[0]"


def _sum(array: str, term: Callable[[str, str], str] = lambda acc, v: f"{acc} + {v}") -> str:
    i = next(_names) % 1000
    return f"aggregate({array}, 0D, (a{i}, v{i}) -> {term(f'a{i}', f'v{i}')})"


def point(x: str, y: str) -> str:
    return f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))"


def polygon(*vertices: str) -> str:
    """Polygon without holes from vertex structs; the ring is closed here."""
    ring = ", ".join([*vertices, vertices[0]])
    return f"named_struct('type', 'Polygon', 'polys', array(array(array({ring}))))"


def rectangle(xmin: str, ymin: str, xmax: str, ymax: str) -> str:
    return polygon(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax))


def box(xmin: str, ymin: str, xmax: str, ymax: str) -> str:
    """Bounding box struct."""
    names = ("xmin", "ymin", "xmax", "ymax")
    fields = ", ".join(f"'{n}', CAST({v} AS DOUBLE)" for n, v in zip(names, (xmin, ymin, xmax, ymax)))
    return f"named_struct({fields})"


def bounds(geom: str) -> str:
    """Envelope of one geometry."""
    return let(
        f"flatten(flatten({geom}.polys))",
        lambda p: box(f"array_min({p}.x)", f"array_min({p}.y)", f"array_max({p}.x)", f"array_max({p}.y)"),
    )


def envelope(bbox: str) -> str:
    return rectangle(f"{bbox}.xmin", f"{bbox}.ymin", f"{bbox}.xmax", f"{bbox}.ymax")


def expand(bbox: str, distance: str | float) -> str:
    """Bounds of a rectangle buffered by ``distance``."""
    return box(
        f"{bbox}.xmin - {distance}", f"{bbox}.ymin - {distance}",
        f"{bbox}.xmax + {distance}", f"{bbox}.ymax + {distance}",
    )


def boxes_meet(a: str, b: str) -> str:
    return (
        f"({a}.xmin <= {b}.xmax AND {b}.xmin <= {a}.xmax AND {a}.ymin <= {b}.ymax AND {b}.ymin <= {a}.ymax)"
    )


def exteriors(geom: str) -> str:
    """Exterior ring of each part, holes ignored."""
    return _fn(f"{geom}.polys", lambda rings: f"{rings}[0]")


def fill_holes(geom: str) -> str:
    return f"named_struct('type', {geom}.type, 'polys', {_fn(f'{geom}.polys', lambda rings: f'array({rings}[0])')})"


def ring_segments(ring: str) -> str:
    """Consecutive vertex pairs as (ax, ay, bx, by)."""
    def pairs(r: str) -> str:
        n = f"greatest(size({r}) - 1, 0)"
        i = next(_names) % 1000
        made = f"named_struct('ax', p{i}.x, 'ay', p{i}.y, 'bx', q{i}.x, 'by', q{i}.y)"
        return f"zip_with(slice({r}, 1, {n}), slice({r}, 2, {n}), (p{i}, q{i}) -> {made})"

    return let(ring, pairs)


def segments(geom: str) -> str:
    return f"flatten({_fn(f'flatten({geom}.polys)', ring_segments)})"


def signed_ring_area(ring: str) -> str:
    return _sum(ring_segments(ring), lambda a, s: f"{a} + {s}.ax * {s}.by - {s}.bx * {s}.ay") + " / 2"


def ring_area(ring: str) -> str:
    return f"abs({signed_ring_area(ring)})"


def area(geom: str) -> str:
    """Outer rings minus holes."""
    def part(rings: str) -> str:
        return f"2 * {ring_area(f'{rings}[0]')} - {_sum(_fn(rings, ring_area))}"

    return _sum(_fn(f"{geom}.polys", part))


def perimeter(geom: str) -> str:
    """Length of the exterior rings; other geometry kinds have none."""
    def length(ring: str) -> str:
        return _sum(ring_segments(ring), lambda a, s: f"{a} + hypot({s}.bx - {s}.ax, {s}.by - {s}.ay)")

    return f"CASE WHEN {is_areal(geom)} THEN {_sum(_fn(exteriors(geom), length))} ELSE 0D END"


def straddles(s: str, y: str) -> str:
    """One end of the segment lies above ``y``, the other does not."""
    return f"(({s}.ay > ({y})) <> ({s}.by > ({y})))"


def left_of(s: str, x: str, y: str) -> str:
    """A point lies strictly left of a segment that straddles its height."""
    lhs = f"(({x}) - {s}.ax) * ({s}.by - {s}.ay)"
    rhs = f"({s}.bx - {s}.ax) * (({y}) - {s}.ay)"
    return f"CASE WHEN {s}.by > {s}.ay THEN {lhs} < {rhs} ELSE {lhs} > {rhs} END"


def contains_point(geom: str, x: str, y: str) -> str:
    """Even-odd rule, half open: the lower and left borders belong to the polygon."""
    def odd(rings: str) -> str:
        edges = f"flatten({_fn(rings, ring_segments)})"
        hit = _fn(edges, lambda s: f"{straddles(s, y)} AND {left_of(s, x, y)}", "filter")
        return f"size({hit}) % 2 = 1"

    return _fn(f"{geom}.polys", odd, "exists")


SPANS = "array<struct<row: bigint, c0: bigint, c1: bigint>>"


def cell_spans(
    geom: str, row_at: Callable[[str], str], col_at: Callable[[str], str], y_of: Callable[[str], str],
    x_of: Callable[[str], str], rows: tuple[str, str] | None = None, cols: tuple[str, str] | None = None,
) -> str:
    """Grid cells whose centre lies in an area (as ``contains_point`` says), as runs (row, c0, c1) of columns.

    ``y_of`` and ``x_of`` give the centre of a row and column, ``row_at`` and ``col_at`` are their inverses (not
    rounded). Each edge lists the rows it crosses and the first column right of it; a row's crossings, sorted, begin
    and end its runs. The array grows with the outline's length in cells, not with its area or its vertices times
    rows. ``rows`` and ``cols`` are the limits (inclusive) of the grid. Other kinds of geometry have no cells.
    """
    def crossing(s: str, r: str) -> str:
        def column(y: str) -> str:
            def fit(k: str) -> str:
                # the quotient may be rounded: the exact test decides between its neighbours
                found = (
                    f"CASE WHEN NOT ({left_of(s, x_of(k), y)}) THEN {k} "
                    f"WHEN NOT ({left_of(s, x_of(f'({k} + 1L)'), y)}) THEN {k} + 1L ELSE {k} + 2L END"
                )
                return f"greatest({cols[0]}, least({cols[1]} + 1L, {found}))" if cols else found

            x = f"({s}.ax + ({y} - {s}.ay) * ({s}.bx - {s}.ax) / ({s}.by - {s}.ay))"
            return let(f"CAST(ceil({col_at(x)}) AS BIGINT) - 1L", fit)

        return f"named_struct('row', {r}, 'col', {let(y_of(r), column)})"

    def crossings(s: str) -> str:
        a, b = row_at(f"{s}.ay"), row_at(f"{s}.by")
        low, high = f"CAST(floor(least({a}, {b})) AS BIGINT)", f"CAST(ceil(greatest({a}, {b})) AS BIGINT)"
        if rows:
            low, high = f"greatest({rows[0]}, {low})", f"least({rows[1]}, {high})"

        def listed(span: str) -> str:
            crossed = _fn(f"sequence({span}.low, {span}.high)", lambda r: straddles(s, y_of(r)), "filter")
            none = "CAST(array() AS array<struct<row: bigint, col: bigint>>)"
            return f"CASE WHEN {span}.low <= {span}.high THEN {_fn(crossed, lambda r: crossing(s, r))} ELSE {none} END"

        return let(f"named_struct('low', {low}, 'high', {high})", listed)

    def runs(rings: str) -> str:
        sloped = _fn(f"flatten({_fn(rings, ring_segments)})", lambda s: f"{s}.ay <> {s}.by", "filter")

        def paired(e: str) -> str:
            run = lambda i: f"named_struct('row', {e}[2 * {i}].row, 'c0', {e}[2 * {i}].col, 'c1', {e}[2 * {i} + 1].col - 1L)"
            full = _fn(_fn(f"sequence(0, CAST(size({e}) DIV 2 AS INT) - 1)", run), lambda r: f"{r}.c0 <= {r}.c1", "filter")
            return f"CASE WHEN size({e}) > 1 THEN {full} ELSE CAST(array() AS {SPANS}) END"

        return let(f"array_sort(flatten({_fn(sloped, crossings)}))", paired)

    def united(e: str) -> str:
        # parts of a valid geometry never overlap; those of others give each cell once
        i = next(_names) % 1000
        twice = (
            f"exists(zip_with(slice({e}, 1, size({e}) - 1), slice({e}, 2, size({e}) - 1), "
            f"(p{i}, q{i}) -> p{i}.row = q{i}.row AND q{i}.c0 <= p{i}.c1), t{i} -> t{i})"
        )
        single = _fn(e, lambda r: _fn(f"sequence({r}.c0, {r}.c1)", lambda c: f"named_struct('row', {r}.row, 'c0', {c}, 'c1', {c})"))
        return f"CASE WHEN size({e}) > 1 AND {twice} THEN array_distinct(flatten({single})) ELSE {e} END"

    return f"CASE WHEN {is_areal(geom)} THEN {let(f'array_sort(flatten({_fn(f"{geom}.polys", runs)}))', united)} END"


def touched_spans(
    geom: str, row_at: Callable[[str], str], col_at: Callable[[str], str], y_of: Callable[[str], str],
    x_of: Callable[[str], str], rows: tuple[str, str], cols: tuple[str, str], inside: str,
) -> str:
    """Grid cells that an outline meets, as runs (row, c0, c1) along its edges, and the runs ``inside`` (``cell_spans``); runs may overlap.

    ``y_of`` and ``x_of`` give the upper left corner of a cell, ``row_at`` and ``col_at`` are their inverses (not
    rounded); ``rows`` and ``cols`` are the limits (inclusive) of the cells. The cells that an edge meets in one row are neighbours:
    their ends are estimated and told by the exact test, so the work grows with the outline's length in cells.
    """
    def meets(s: str, r: str, c: str) -> str:
        x, y = (x_of(c), x_of(f"({c} + 1L)")), (y_of(r), y_of(f"({r} + 1L)"))
        overlap = " AND ".join(
            f"least({s}.a{k}, {s}.b{k}) <= greatest({v[0]}, {v[1]}) AND greatest({s}.a{k}, {s}.b{k}) >= least({v[0]}, {v[1]})" for k, v in (("x", x), ("y", y))
        )
        sides = ", ".join(f"({s}.bx - {s}.ax) * ({v} - {s}.ay) - ({s}.by - {s}.ay) * ({u} - {s}.ax)" for u in x for v in y)
        return f"({overlap} AND least({sides}) <= 0 AND greatest({sides}) >= 0)"

    def strip(s: str, r: str) -> tuple[str, str]:
        low, high = (f"{f}({y_of(r)}, {y_of(f'({r} + 1L)')})" for f in ("least", "greatest"))
        return f"greatest(least({s}.ay, {s}.by), {low})", f"least(greatest({s}.ay, {s}.by), {high})"

    def run(s: str, r: str) -> str:
        x = [f"IF({s}.ay = {s}.by, {s}.{e}x, {s}.ax + ({y} - {s}.ay) * ({s}.bx - {s}.ax) / ({s}.by - {s}.ay))" for e, y in zip("ab", strip(s, r), strict=True)]
        ends = f"named_struct('p', {col_at(x[0])}, 'q', {col_at(x[1])})"

        def told(e: str) -> str:
            guess = f"named_struct('l', CAST(floor(least({e}.p, {e}.q)) AS BIGINT) - 1L, 'h', CAST(floor(greatest({e}.p, {e}.q)) AS BIGINT) + 1L)"

            def exact(k: str) -> str:
                first = f"CASE WHEN {meets(s, r, f'{k}.l')} THEN {k}.l WHEN {meets(s, r, f'({k}.l + 1L)')} THEN {k}.l + 1L ELSE {k}.l + 2L END"
                last = f"CASE WHEN {meets(s, r, f'{k}.h')} THEN {k}.h WHEN {meets(s, r, f'({k}.h - 1L)')} THEN {k}.h - 1L ELSE {k}.h - 2L END"
                return f"named_struct('row', {r}, 'c0', greatest({first}, {cols[0]}), 'c1', least({last}, {cols[1]}))"

            return let(guess, exact)

        return let(ends, told)

    def along(s: str) -> str:
        a, b = row_at(f"{s}.ay"), row_at(f"{s}.by")
        low, high = f"greatest({rows[0]}, CAST(floor(least({a}, {b})) AS BIGINT) - 1L)", f"least({rows[1]}, CAST(floor(greatest({a}, {b})) AS BIGINT) + 1L)"

        def listed(span: str) -> str:
            met = _fn(f"sequence({span}.low, {span}.high)", lambda r: f"{strip(s, r)[0]} <= {strip(s, r)[1]}", "filter")
            full = _fn(_fn(met, lambda r: run(s, r)), lambda t: f"{t}.c0 <= {t}.c1", "filter")
            return f"CASE WHEN {span}.low <= {span}.high THEN {full} ELSE CAST(array() AS {SPANS}) END"

        return let(f"named_struct('low', {low}, 'high', {high})", listed)

    return f"concat(flatten({_fn(segments(geom), along)}), coalesce({inside}, CAST(array() AS {SPANS})))"


def _side(p: tuple[str, str], q: tuple[str, str], r: tuple[str, str]) -> str:
    return f"(({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"


def _sides(s: str, t: str) -> tuple[str, str, str, str]:
    s1, s2 = (f"{s}.ax", f"{s}.ay"), (f"{s}.bx", f"{s}.by")
    t1, t2 = (f"{t}.ax", f"{t}.ay"), (f"{t}.bx", f"{t}.by")
    return _side(t1, t2, s1), _side(t1, t2, s2), _side(s1, s2, t1), _side(s1, s2, t2)


def segments_touch(s: str, t: str) -> str:
    p, q, r, u = _sides(s, t)
    overlap = " AND ".join(
        f"least({m}.a{c}, {m}.b{c}) <= greatest({o}.a{c}, {o}.b{c})" for c in "xy" for m, o in ((s, t), (t, s))
    )
    return f"({overlap} AND {p} * {q} <= 0 AND {r} * {u} <= 0)"


def segments_cross(s: str, t: str) -> str:
    p, q, r, u = _sides(s, t)
    return f"({p} * {q} < 0 AND {r} * {u} < 0)"


#: Pairs of segments up to which all are compared; beyond, only those that share a strip.
FEW = 1024


def _met(s: str, bbox: str, reach: str = "0D") -> str:
    """A segment's bounds come within ``reach`` of a box."""
    return " AND ".join(
        f"least({s}.a{c}, {s}.b{c}) <= {bbox}.{c}max + {reach} AND greatest({s}.a{c}, {s}.b{c}) >= {bbox}.{c}min - {reach}" for c in "xy"
    )


def _in_strips(a: str, b: str, test: Callable[[str, str], str]) -> str:
    """Whether any segment of ``a`` and one of ``b`` that run through a common strip pass ``test``.

    Strips run along the axis along which segments are shorter for the extent. They are as high as a segment on average, so
    the list of segments by strip is at most about twice as long as the segments, however long some of them are. The list is
    sorted; the part of it that a segment's strips take is found by halving.
    """
    i = next(_names) % 1000
    low, high = (lambda s: f"least({s}.ay, {s}.by)"), (lambda s: f"greatest({s}.ay, {s}.by)")
    extent = lambda c: f"greatest(array_max(m{i}.a{c}), array_max(m{i}.b{c})) - least(array_min(m{i}.a{c}), array_min(m{i}.b{c}))"
    spread = lambda c: _sum(f"m{i}", lambda t, s: f"{t} + abs({s}.b{c} - {s}.a{c})")
    turned = lambda segs: _fn(segs, lambda s: f"IF(w{i}.turn, named_struct('ax', {s}.ay, 'ay', {s}.ax, 'bx', {s}.by, 'by', {s}.bx), {s})")
    sums = f"named_struct('tx', {spread('x')}, 'ty', {spread('y')}, 'ex', {extent('x')}, 'ey', {extent('y')}, 'n', size(m{i}))"
    shorter = f"t{i}.tx * t{i}.ey < t{i}.ty * t{i}.ex"
    # w: whether x and y change places, the height of a strip
    choose = (
        f"transform(array({sums}), t{i} -> named_struct('turn', {shorter}, 'high', "
        f"greatest(IF({shorter}, t{i}.tx, t{i}.ty) / t{i}.n, 1e-9D * (t{i}.ex + t{i}.ey), 1e-300D)))[0]"
    )
    strip = lambda v: f"CAST(floor({v} / w{i}.high) AS BIGINT)"
    listed = f"transform(sequence({strip(low(f's{i}'))}, {strip(high(f's{i}'))}), k{i} -> named_struct('k', k{i}, 's', s{i}))"
    entries = f"array_sort(flatten(transform(b{i}, s{i} -> {listed})))"
    top = f"CAST(floor(log2(size(e{i}))) AS INT)"
    halves = f"transform(sequence(0, {top}), j{i} -> shiftleft(1, {top} - j{i}))"

    def first(k: str) -> str:
        """Number of entries below strip k."""
        j = next(_names) % 1000
        step = f"IF(c{j} + d{j} <= size(e{i}) AND e{i}[c{j} + d{j} - 1].k < {k}, c{j} + d{j}, c{j})"
        return f"aggregate(h{i}, 0, (c{j}, d{j}) -> {step})"

    span = f"named_struct('f', {first(strip(low(f'q{i}')))}, 'l', {first(f'{strip(high(f"q{i}"))} + 1L')})"
    found = f"slice(e{i}, r{i}.f + 1, r{i}.l - r{i}.f)"
    each = f"exists(a{i}, q{i} -> transform(array({span}), r{i} -> {_fn(found, lambda t: test(f'q{i}', f'{t}.s'), 'exists')})[0])"
    inner = f"transform(array({entries}), e{i} -> transform(array({halves}), h{i} -> {each})[0])[0]"
    placed = f"transform(array({turned(a)}), a{i} -> transform(array({turned(b)}), b{i} -> {inner})[0])[0]"
    return f"transform(array(concat({a}, {b})), m{i} -> transform(array({choose}), w{i} -> {placed})[0])[0]"


def _any_pair(a: str, b: str, test: Callable[[str, str], str]) -> str:
    """Whether any segment of ``a`` and one of ``b`` (names of bound arrays) pass ``test``."""
    every = _fn(a, lambda s: _fn(b, lambda t: test(s, t), "exists"), "exists")
    strips = _in_strips(a, b, test)
    return f"CASE WHEN size({a}) = 0 OR size({b}) = 0 THEN false WHEN CAST(size({a}) AS BIGINT) * size({b}) <= {FEW} THEN {every} ELSE {strips} END"


def _bounds_of(segs: str) -> str:
    edge = lambda outer, f, c: f"{outer}({f}({segs}.a{c}), {f}({segs}.b{c}))"
    return box(*[edge("least", "array_min", c) for c in "xy"], *[edge("greatest", "array_max", c) for c in "xy"])


def borders_touch(a: str, b: str) -> str:
    """Any two segments have a common point; only those near the other's bounds are compared."""
    def pruned(own: str, other: str) -> str:
        return let(
            let(_bounds_of(other), lambda box_b: _fn(own, lambda s: _met(s, box_b), "filter")),
            lambda left: let(
                let(_bounds_of(own), lambda box_a: _fn(other, lambda s: _met(s, box_a), "filter")),
                lambda right: _any_pair(left, right, segments_touch),
            ),
        )

    return f"coalesce({let(segments(a), lambda own: let(segments(b), lambda other: pruned(own, other)))}, false)"


def intersects(a: str, b: str) -> str:
    """Share at least one point: one part lies inside the other geometry (tested first, being cheap), or borders meet."""
    def starts_inside(geom: str, other: str) -> str:
        # only areas have an inside
        return f"{is_areal(other)} AND " + _fn(exteriors(geom), lambda r: contains_point(other, f"{r}[0].x", f"{r}[0].y"), "exists")

    return f"(({starts_inside(a, b)}) OR ({starts_inside(b, a)}) OR {borders_touch(a, b)})"


def intersects_box(geom: str, bbox: str) -> str:
    """``intersects`` with the rectangle of a bounding box."""
    return let(envelope(bbox), lambda frame: intersects(geom, frame))


def is_box(geom: str, bbox: str) -> str:
    """The geometry is the rectangle of its bounding box, with an inside: tests against it need its bounds only."""
    return f"({bbox}.xmin < {bbox}.xmax AND {bbox}.ymin < {bbox}.ymax AND {geom} = {envelope(bbox)})"


def box_contains(a: str, b: str) -> str:
    """Box ``b`` lies in box ``a``."""
    return f"({a}.xmin <= {b}.xmin AND {b}.xmax <= {a}.xmax AND {a}.ymin <= {b}.ymin AND {b}.ymax <= {a}.ymax)"


def box_within(bbox: str, geom: str) -> str:
    """The rectangle of a bounding box lies in the area: its centre does, and no edge enters its interior."""
    def enters(s: str) -> str:
        def part(c: str) -> tuple[str, str]:
            d, low, high = f"({s}.b{c} - {s}.a{c})", f"({bbox}.{c}min - {s}.a{c})", f"({bbox}.{c}max - {s}.a{c})"
            first = f"CASE WHEN {d} <> 0 THEN least({low} / {d}, {high} / {d}) WHEN {low} < 0 AND {high} > 0 THEN 0D ELSE 2D END"
            return first, f"CASE WHEN {d} <> 0 THEN greatest({low} / {d}, {high} / {d}) ELSE 1D END"

        (x0, x1), (y0, y1) = part("x"), part("y")
        return f"greatest(0D, {x0}, {y0}) < least(1D, {x1}, {y1})"

    centre = contains_point(geom, f"({bbox}.xmin + {bbox}.xmax) / 2", f"({bbox}.ymin + {bbox}.ymax) / 2")
    return f"({is_areal(geom)} AND {centre} AND NOT {_fn(segments(geom), enters, 'exists')})"


def _point_segment(x: str, y: str, s: str) -> str:
    """Distance to the nearer end, or to the line between the ends."""
    dx, dy = f"({s}.bx - {s}.ax)", f"({s}.by - {s}.ay)"
    dot = f"(({x} - {s}.ax) * {dx} + ({y} - {s}.ay) * {dy})"
    length2 = f"({dx} * {dx} + {dy} * {dy})"
    return (
        f"CASE WHEN {dot} <= 0 THEN hypot({x} - {s}.ax, {y} - {s}.ay) "
        f"WHEN {dot} >= {length2} THEN hypot({x} - {s}.bx, {y} - {s}.by) "
        f"ELSE abs({dx} * ({y} - {s}.ay) - {dy} * ({x} - {s}.ax)) / sqrt({length2}) END"
    )


def box_gap(bbox: str, x: str, y: str) -> str:
    """Distance from a point to a bounding box, 0 inside: a lower bound of the distance to its geometry."""
    gap_x = f"greatest({bbox}.xmin - {x}, {x} - {bbox}.xmax, 0D)"
    gap_y = f"greatest({bbox}.ymin - {y}, {y} - {bbox}.ymax, 0D)"
    return f"hypot({gap_x}, {gap_y})"


def box_far(bbox: str, x: str, y: str) -> str:
    """Distance from a point to the farthest corner of a bounding box: an upper bound for its geometry."""
    far_x = f"greatest(abs({x} - {bbox}.xmin), abs({x} - {bbox}.xmax))"
    far_y = f"greatest(abs({y} - {bbox}.ymin), abs({y} - {bbox}.ymax))"
    return f"hypot({far_x}, {far_y})"


def boxes_gap(a: str, b: str) -> str:
    """Distance between two bounding boxes: a lower bound of the distance from any point of one to what the other holds."""
    return f"hypot(greatest({a}.xmin - {b}.xmax, {b}.xmin - {a}.xmax, 0D), greatest({a}.ymin - {b}.ymax, {b}.ymin - {a}.ymax, 0D))"


def boxes_far(a: str, b: str) -> str:
    """Largest distance between points of two bounding boxes."""
    return f"hypot(greatest({a}.xmax - {b}.xmin, {b}.xmax - {a}.xmin), greatest({a}.ymax - {b}.ymin, {b}.ymax - {a}.ymin))"


def point_distance(geom: str, x: str, y: str) -> str:
    """Distance from a point, 0 inside."""
    nearest = f"array_min({_fn(segments(geom), lambda s: _point_segment(x, y, s))})"
    return f"CASE WHEN {contains_point(geom, x, y)} THEN 0D ELSE {nearest} END"


def distance(a: str, b: str) -> str:
    """Polygon to polygon distance, 0 when they intersect.

    Of long outlines only segments within the least distance of a corner from the other's bounds count. They are taken in
    runs of neighbours, and only runs whose bounds lie as near as the nearest two corners of runs are compared.
    """
    def ends(s: str, t: str) -> str:
        parts = [_point_segment(f"{m}.{e}x", f"{m}.{e}y", o) for m, o in ((s, t), (t, s)) for e in "ab"]
        return f"least({', '.join(parts)})"

    def least(own: str, other: str) -> str:
        return f"array_min({_fn(own, lambda s: f'array_min({_fn(other, lambda t: ends(s, t))})')})"

    def runs(segs: str, n: str) -> str:
        one = lambda k: let(f"slice({segs}, {k} * {n} + 1, {n})", lambda r: f"named_struct('segs', {r}, 'box', {_bounds_of(r)}, 'x', {r}[0].ax, 'y', {r}[0].ay)")
        return f"CASE WHEN size({segs}) > 0 THEN {_fn(f'sequence(0, (size({segs}) - 1) DIV {n})', one)} END"

    def compared(a: str, b: str, limit: str) -> str:
        corners = f"array_min({_fn(a, lambda p: f'array_min({_fn(b, lambda q: f"hypot({p}.x - {q}.x, {p}.y - {q}.y)")})')})"
        near = lambda p, u: _fn(b, lambda q: f"{boxes_gap(f'{p}.box', f'{q}.box')} <= {u}", "filter")
        found = lambda u: f"array_min({_fn(a, lambda p: f'array_min({_fn(near(p, u), lambda q: least(f"{p}.segs", f"{q}.segs"))})')})"
        return let(f"least({corners}, {limit}) * 1.000000001D", found)

    def searched(own: str, other: str, box_a: str, box_b: str) -> str:
        corner = f"array_min({_fn(own, lambda s: f"named_struct('d', {box_gap(box_b, f'{s}.ax', f'{s}.ay')}, 'x', {s}.ax, 'y', {s}.ay)")})"
        limit = let(corner, lambda c: f"array_min({_fn(other, lambda t: _point_segment(f'{c}.x', f'{c}.y', t))})")

        def within(reach: str) -> str:
            wide = f"({reach} * 1.000000001D)"
            left, right = _fn(own, lambda s: _met(s, box_b, wide), "filter"), _fn(other, lambda t: _met(t, box_a, wide), "filter")
            n = lambda m: f"CAST(ceil(pow(size({m}), 0.34D)) AS INT)"
            parts = lambda m: let(n(m), lambda k: runs(m, k))
            return let(let(left, parts), lambda p: let(let(right, parts), lambda q: compared(p, q, reach)))

        return let(limit, within)

    def sized(own: str, other: str) -> str:
        bounded = let(_bounds_of(own), lambda box_a: let(_bounds_of(other), lambda box_b: searched(own, other, box_a, box_b)))
        return f"CASE WHEN CAST(size({own}) AS BIGINT) * size({other}) <= 64 THEN {least(own, other)} ELSE {bounded} END"

    nearest = let(segments(a), lambda own: let(segments(b), lambda other: sized(own, other)))
    return f"CASE WHEN {intersects(a, b)} THEN 0D ELSE {nearest} END"


def map_vertices(geom: str, f: Callable[[str], str]) -> str:
    polys = _fn(f"{geom}.polys", lambda rings: _fn(rings, lambda ring: _fn(ring, f)))
    return f"named_struct('type', {geom}.type, 'polys', {polys})"


def translate(geom: str, dx: str, dy: str) -> str:
    return map_vertices(geom, lambda v: point(f"{v}.x + ({dx})", f"{v}.y + ({dy})"))


def _keep_half(ring: str, axis: str, test: str, limit: str) -> str:
    """Clip one ring by one axis-parallel line; ``test`` is the comparison that keeps a vertex."""
    def cut(s: str) -> str:
        t = f"(({limit}) - {s}.a{axis}) / ({s}.b{axis} - {s}.a{axis})"
        return let(t, lambda k: point(
            f"{s}.ax + {k} * ({s}.bx - {s}.ax)", f"{s}.ay + {k} * ({s}.by - {s}.ay)"
        ))

    def step(s: str) -> str:
        a_in, b_in = f"{s}.a{axis} {test} ({limit})", f"{s}.b{axis} {test} ({limit})"
        end = point(f"{s}.bx", f"{s}.by")
        return (
            f"CASE WHEN {a_in} AND {b_in} THEN array({end}) WHEN {b_in} THEN array({cut(s)}, {end}) "
            f"WHEN {a_in} THEN array({cut(s)}) ELSE CAST(array() AS array<{POINT}>) END"
        )

    return let(f"flatten({_fn(ring_segments(ring), step)})", lambda p: f"concat({p}, slice({p}, 1, 1))")


def clip(geom: str, bbox: str) -> str:
    """Part of the geometry inside a rectangle; NULL when nothing is left."""
    def ring_clip(ring: str) -> str:
        ring = _keep_half(ring, "x", ">=", f"{bbox}.xmin")
        ring = _keep_half(ring, "x", "<=", f"{bbox}.xmax")
        ring = _keep_half(ring, "y", ">=", f"{bbox}.ymin")
        return _keep_half(ring, "y", "<=", f"{bbox}.ymax")

    def part(rings: str) -> str:
        return _fn(_fn(rings, ring_clip), lambda r: f"size({r}) >= 4", "filter")

    clipped = _fn(_fn(f"{geom}.polys", part), lambda rings: f"size({rings}) > 0", "filter")
    return let(
        clipped,
        lambda polys: f"CASE WHEN size({polys}) > 0 THEN named_struct('type', {geom}.type, 'polys', {polys}) END",
    )


def _self_crosses(ring: str) -> str:
    """Any two segments cross properly; neighbours and a segment itself never do."""
    return let(ring_segments(ring), lambda segs: _any_pair(segs, segs, segments_cross))


def is_valid(geom: str) -> str:
    """Rings closed, at least four vertices, non-zero area, no proper self crossing."""
    def ring_ok(ring: str) -> str:
        return (
            f"size({ring}) >= 4 AND {ring}[0] = element_at({ring}, -1) "
            f"AND {ring_area(ring)} > 0 AND NOT {_self_crosses(ring)}"
        )

    rings = f"flatten({geom}.polys)"
    return f"coalesce(size({rings}) > 0 AND {_fn(rings, ring_ok, 'forall')}, false)"


def is_areal(geom: str) -> str:
    return f"coalesce({geom}.type IN ('Polygon', 'MultiPolygon'), false)"


def promote(geom: str) -> str:
    """Polygon -> MultiPolygon; the storage is the same, only the tag changes."""
    kind = f"CASE WHEN {geom}.type = 'Polygon' THEN 'MultiPolygon' ELSE {geom}.type END"
    return f"named_struct('type', {kind}, 'polys', {geom}.polys)"


def explode_parts(df: DataFrame, geom: str = "geom", part: str = "part") -> DataFrame:
    """One row per polygon of a MultiPolygon, with its part number."""
    others = [c for c in df.columns if c != geom]
    single = f"named_struct('type', 'Polygon', 'polys', array(_rings)) AS {geom}"
    return df.selectExpr(*others, f"posexplode({geom}.polys) AS ({part}, _rings)").selectExpr(*others, part, single)


def map_to_pixel(x: str, y: str, xmin: str, ymax: str, res: str | float) -> tuple[str, str]:
    """(row, col) of a map position under a north-up transform."""
    return (
        f"CAST(floor((({ymax}) - ({y})) / {res}) AS BIGINT)",
        f"CAST(floor((({x}) - ({xmin})) / {res}) AS BIGINT)",
    )


def pixel_to_map(row: str, col: str, xmin: str, ymax: str, res: str | float) -> tuple[str, str]:
    """Centre of a pixel."""
    return f"(({xmin}) + ({col} + 0.5D) * {res})", f"(({ymax}) - ({row} + 0.5D) * {res})"


def clamp_pixel_box(b: str, height: str, width: str) -> str:
    """Order the corners of a pixel box and keep it inside an image of the given size."""
    return (
        f"named_struct('ymin', greatest(0, least({b}.ymin, {b}.ymax, {height} - 1)), "
        f"'xmin', greatest(0, least({b}.xmin, {b}.xmax, {width} - 1)), "
        f"'ymax', least({height}, greatest({b}.ymin, {b}.ymax, 1)), "
        f"'xmax', least({width}, greatest({b}.xmin, {b}.xmax, 1)))"
    )


def positive_pixel_box(b: str) -> str:
    """Order the corners and force at least one row and one column."""
    return (
        f"named_struct('ymin', least({b}.ymin, {b}.ymax), 'xmin', least({b}.xmin, {b}.xmax), "
        f"'ymax', greatest({b}.ymin, {b}.ymax, least({b}.ymin, {b}.ymax) + 1), "
        f"'xmax', greatest({b}.xmin, {b}.xmax, least({b}.xmin, {b}.xmax) + 1))"
    )


def to_geojson(geom: str) -> str:
    """GeoJSON geometry text."""
    coords = _fn(
        f"{geom}.polys", lambda rings: _fn(rings, lambda ring: _fn(ring, lambda v: f"array({v}.x, {v}.y)"))
    )
    return let(
        coords,
        lambda c: f"CASE WHEN {geom}.type = 'Point' "
        f"THEN to_json(named_struct('type', 'Point', 'coordinates', {c}[0][0][0])) "
        f"WHEN {geom}.type = 'LineString' "
        f"THEN to_json(named_struct('type', 'LineString', 'coordinates', {c}[0][0])) "
        f"WHEN {geom}.type = 'Polygon' "
        f"THEN to_json(named_struct('type', 'Polygon', 'coordinates', {c}[0])) "
        f"ELSE to_json(named_struct('type', 'MultiPolygon', 'coordinates', {c})) END",
    )


def from_geojson(kind: str, coordinates: str) -> str:
    """Geometry from the type and coordinate text of a GeoJSON geometry; NULL for other kinds than points, lines and areas."""
    def vertices(rings: str) -> str:
        return _fn(rings, lambda ring: _fn(ring, lambda v: point(f"{v}[0]", f"{v}[1]")))

    single = f"array({vertices(f'''from_json({coordinates}, 'array<array<array<double>>>')''')})"
    multi = _fn(f"from_json({coordinates}, 'array<array<array<array<double>>>>')", vertices)
    as_line = f"array(from_json({coordinates}, 'array<array<double>>'))"
    as_spot = f"array(array(from_json({coordinates}, 'array<double>')))"
    line = f"array({vertices(as_line)})"
    spot = f"array({vertices(as_spot)})"
    return (
        f"CASE {kind} WHEN 'Point' THEN named_struct('type', {kind}, 'polys', {spot}) "
        f"WHEN 'LineString' THEN named_struct('type', {kind}, 'polys', {line}) "
        f"WHEN 'Polygon' THEN named_struct('type', {kind}, 'polys', {single}) "
        f"WHEN 'MultiPolygon' THEN named_struct('type', {kind}, 'polys', {multi}) END"
    )
