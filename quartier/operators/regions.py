"""Regions of a pixel mask: 8-connected labels, region table and outer boundary polygons."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartier.operators.components import chain_order, connected_components

BLOCK = 256


def _label_block(rows: np.ndarray, cols: np.ndarray, block: int) -> np.ndarray:
    """Index of the first pixel of each pixel's 8-connected piece inside one block."""
    r, c = rows % block + 1, cols % block + 1
    index = np.full((block + 2, block + 2), -1, dtype=np.int64)
    index[r, c] = np.arange(len(r))
    label = np.arange(len(r))
    around = [index[r + dr, c + dc] for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
    while True:
        best = label.copy()
        for near in around:
            has = near >= 0
            best[has] = np.minimum(best[has], label[near[has]])
        best = np.minimum(best, best[best])
        if np.array_equal(best, label):
            return label
        label = best


def label_regions(mask: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Add ``region`` to set pixels (keys, prow, pcol): id of the first pixel of the region in reading order.

    Pixels are labelled inside fixed blocks (a task holds block x block pixels at most), then pieces
    are merged over block borders by connected components on the far smaller piece graph.
    """
    keys = list(keys)
    pixels = mask.select(*keys, "prow", "pcol").selectExpr("*", f"prow DIV {block} AS _br", f"pcol DIV {block} AS _bc")
    schema = T.StructType(
        [*pixels.select(*keys, "prow", "pcol").schema.fields, T.StructField("piece", T.LongType())]
    )

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["prow", "pcol"], ignore_index=True)
        rows, cols = pdf["prow"].to_numpy(), pdf["pcol"].to_numpy()
        first = _label_block(rows, cols, block)
        return pdf[[*keys, "prow", "pcol"]].assign(piece=rows[first] * 2**31 + cols[first])

    labelled = pixels.groupBy(*keys, "_br", "_bc").applyInPandas(label, schema)
    last = block - 1
    edge = labelled.where(f"prow % {block} IN (0, {last}) OR pcol % {block} IN (0, {last})")
    steps = "array(struct(0 AS dr, 1 AS dc), struct(1 AS dr, -1 AS dc), struct(1 AS dr, 0 AS dc), struct(1 AS dr, 1 AS dc))"
    reach = (
        edge.selectExpr(*keys, "prow AS _r", "pcol AS _c", "piece AS piece_a", f"explode({steps}) AS s")
        .selectExpr(*keys, "_r", "_c", "piece_a", "_r + s.dr AS prow", "_c + s.dc AS pcol")
        .where(f"_r DIV {block} <> prow DIV {block} OR _c DIV {block} <> pcol DIV {block}")
    )
    pairs = reach.join(edge.withColumnRenamed("piece", "piece_b"), [*keys, "prow", "pcol"]).select(
        *keys, "piece_a", "piece_b"
    ).distinct()
    merged = connected_components(pairs, "piece_a", "piece_b", keys).withColumnRenamed("node", "piece")
    return labelled.join(merged, [*keys, "piece"], "left").selectExpr(
        *keys, "prow", "pcol", "coalesce(component, piece) AS region"
    )


def region_table(regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixel count and pixel bounds of every region."""
    return regions.groupBy(*keys, "region").agg(
        F.expr("count(1) AS pixels"),
        F.expr("min(prow) AS row_min"), F.expr("min(pcol) AS col_min"),
        F.expr("max(prow) AS row_max"), F.expr("max(pcol) AS col_max"),
    )


# directions 0 east, 1 south, 2 west, 3 north; the region lies on the right hand of every side
_SIDES = (
    "array(struct('h' AS o, prow AS y, pcol AS x, 0 AS d), struct('v' AS o, prow AS y, pcol + 1 AS x, 1 AS d), "
    "struct('h' AS o, prow + 1 AS y, pcol AS x, 2 AS d), struct('v' AS o, prow AS y, pcol AS x, 3 AS d))"
)


def boundary_edges(regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Straight boundary pieces from corner to corner: (keys, region, d, sx, sy, ex, ey).

    Every pixel lists its four sides; a side listed once is on the boundary. Runs along one grid line
    are merged, the line length being bounded by the raster.
    """
    keys = list(keys)
    by = ", ".join([*keys, "region", "d", "line"])
    sides = (
        regions.selectExpr(*keys, "region", f"explode({_SIDES}) AS s")
        .groupBy(*keys, "s.o", "s.y", "s.x")
        .agg(F.expr("count(1) AS n"), F.expr("max(region) AS region"), F.expr("max(s.d) AS d"))
        .where("n = 1")
        .selectExpr(*keys, "region", "d", "CASE WHEN o = 'h' THEN y ELSE x END AS line", "CASE WHEN o = 'h' THEN x ELSE y END AS at")
    )
    runs = sides.selectExpr("*", f"at - row_number() OVER (PARTITION BY {by} ORDER BY at) AS run")
    merged = runs.groupBy(*keys, "region", "d", "line", "run").agg(
        F.expr("min(at) AS low"), F.expr("max(at) + 1 AS high")
    )
    return merged.selectExpr(
        *keys, "region", "d",
        "CASE d WHEN 0 THEN low WHEN 2 THEN high ELSE line END AS sx",
        "CASE d WHEN 1 THEN low WHEN 3 THEN high ELSE line END AS sy",
        "CASE d WHEN 0 THEN high WHEN 2 THEN low ELSE line END AS ex",
        "CASE d WHEN 1 THEN high WHEN 3 THEN low ELSE line END AS ey",
    )


def outer_rings(regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Corners of each region's outer ring: (keys, region, ring, pos, x, y), holes dropped.

    Where two pixels meet only at a corner the walk turns left, which keeps 8-connected pixels in one
    ring. Rings are components of the next-edge graph, hole rings are those of negative area, and the
    order along a ring comes from pointer doubling.
    """
    keys = list(keys)
    edges = boundary_edges(regions, keys).selectExpr("*", "sy * 2147483648 + sx * 4 + d AS edge")
    starts = edges.selectExpr(*keys, "region", "sx AS ex", "sy AS ey", "d AS _d").groupBy(
        *keys, "region", "ex", "ey"
    ).agg(F.expr("bit_or(shiftleft(1, _d)) AS dirs"))
    turn = "CASE WHEN dirs & shiftleft(1, (d + 3) % 4) <> 0 THEN (d + 3) % 4 ELSE (d + 1) % 4 END"
    linked = edges.join(starts, [*keys, "region", "ex", "ey"]).selectExpr(
        *keys, "region", "edge", "sx", "sy", "ex", "ey", f"ey * 2147483648 + ex * 4 + {turn} AS next_edge"
    )
    rings = connected_components(linked, "edge", "next_edge", keys).selectExpr(*keys, "node AS edge", "component AS ring")
    placed = linked.join(rings, [*keys, "edge"])
    outer = placed.groupBy(*keys, "ring").agg(F.expr("sum(sx * ey - ex * sy) AS twice_area")).where("twice_area > 0")
    kept = placed.join(outer.select(*keys, "ring"), [*keys, "ring"], "left_semi")
    order = chain_order(
        kept.selectExpr(*keys, "edge AS node", "CASE WHEN next_edge <> ring THEN next_edge END AS following"), keys
    )
    return kept.join(order.withColumnRenamed("node", "edge"), [*keys, "edge"]).selectExpr(
        *keys, "region", "ring", "-to_end AS pos", "sx AS x", "sy AS y"
    )


def ring_polygons(corners: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", min_points: int = 3) -> DataFrame:
    """One polygon per ring with its corners in order; rings with fewer than ``min_points`` are dropped.

    A row is one output feature, so it necessarily holds that feature's corners, and nothing more.
    """
    vertex = f"named_struct('pos', pos, 'x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))"
    ring = "transform(_c, v -> named_struct('x', v.x, 'y', v.y))"
    return (
        corners.groupBy(*keys, "region", "ring")
        .agg(F.expr(f"array_sort(collect_list({vertex})) AS _c"))
        .where(f"size(_c) >= {min_points}")
        .selectExpr(
            *keys, "region",
            f"named_struct('type', 'Polygon', 'polys', array(array(concat({ring}, slice({ring}, 1, 1))))) AS geom",
        )
    )


def vectorize(mask: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Outer polygons of the 8-connected regions of a mask, in pixel coordinates."""
    return ring_polygons(outer_rings(label_regions(mask, keys, block), keys), keys)
