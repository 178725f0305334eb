"""Tile windows, two-resolution alignment and reproducible splits."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.functions import geometry as g
from quartier.functions.scalars import as_pair
from quartier.operators.skew import shuffled_rank, spread_rows
from quartier.operators.spatial import spatial_join

# Tile and stride in pixels of the image and of the building raster, and the split seed.
IMAGE_TILE, IMAGE_STRIDE = 256, 128
BUILDING_TILE, BUILDING_STRIDE = 512, 256
SEED = 42


def _windows(scenes: DataFrame, scene: Sequence[str], rows: str, cols: str, size: tuple, stride: tuple) -> DataFrame:
    """Explode window starts; the index follows reading order (rows outer, columns inner) by arithmetic.

    A scene's row becomes many windows, so scenes are spread over tasks by their number of windows first.
    """
    (h, w), (sy, sx) = size, stride
    counted = scenes.selectExpr(*scene, f"{rows} AS _r", f"{cols} AS _c")
    return (
        spread_rows(counted, "CAST(size(_r) AS BIGINT) * size(_c)")
        .selectExpr(*scene, "_c", "posexplode(_r) AS (_i, ymin)")
        .selectExpr(*scene, "_i", "size(_c) AS _n", "ymin", "posexplode(_c) AS (_j, xmin)")
        .selectExpr(
            *scene, "CAST(_i AS BIGINT) * _n + _j AS tile_idx",
            "ymin", "xmin", f"ymin + {h} AS ymax", f"xmin + {w} AS xmax",
        )
    )


def sliding_windows(
    scenes: DataFrame, scene: Sequence[str], size, stride, padding=0, pad_direction: str = "end"
) -> DataFrame:
    """Windows of every scene (extent 0..height, 0..width): those that fit the extent plus padding.

    ``pad_direction`` puts the padding before, after or on both sides of the extent.
    """
    size, stride, padding = as_pair(size), as_pair(stride), as_pair(padding)
    if pad_direction not in ("start", "end", "both"):
        raise ValueError(f"unknown pad direction {pad_direction!r}")

    def starts(extent: str, n: int, step: int, pad: int) -> str:
        first = -pad if pad_direction in ("start", "both") else 0
        last = f"{extent} + {pad if pad_direction in ('end', 'both') else 0} - {n}"
        return (
            f"CASE WHEN {last} >= {first} THEN sequence(CAST({first} AS BIGINT), CAST({last} AS BIGINT), {step}L) "
            "ELSE CAST(array() AS array<bigint>) END"
        )

    rows = starts("height", size[0], stride[0], padding[0])
    cols = starts("width", size[1], stride[1], padding[1])
    return _windows(scenes, scene, rows, cols, size, stride)


def grid_windows(scenes: DataFrame, scene: Sequence[str], size) -> DataFrame:
    """Non-overlapping windows from the origin; the last ones may overhang the extent."""
    h, w = as_pair(size)
    rows = f"sequence(0L, greatest(CAST(height AS BIGINT) - 1, 0L), {h}L)"
    cols = f"sequence(0L, greatest(CAST(width AS BIGINT) - 1, 0L), {w}L)"
    return _windows(scenes, scene, rows, cols, (h, w), (h, w))


def windows_in_areas(
    windows: DataFrame, areas: DataFrame, scene: Sequence[str], within: bool = True, cell: float = 1024.0
) -> DataFrame:
    """Windows lying in (``within``) or meeting one of the scene's areas of interest; they keep their grid index.

    ``areas`` hold scene, geom and bbox in pixels (x: column, y: row). A scene without areas keeps no window. Windows
    and areas meet on grid cells of side ``cell``.
    """
    framed = windows.selectExpr(*scene, "tile_idx", f"{g.box('xmin', 'ymin', 'xmax', 'ymax')} AS bbox")
    shapes = areas.selectExpr(*scene, "geom", "bbox", f"{g.is_box('geom', 'bbox')} AS whole")

    def test(_: str, area: str) -> str:
        """A window is its box, so none carries an outline; an area that is its box is compared by bounds."""
        if within:
            return f"CASE WHEN r_whole THEN {g.box_contains('r_bbox', 'l_bbox')} ELSE {g.box_within('l_bbox', area)} END"
        return f"(r_whole OR {g.intersects_box(area, 'l_bbox')})"

    hits = spatial_join(framed, shapes, cell, test, scene)
    return windows.join(hits.selectExpr(*scene, "l_tile_idx AS tile_idx").distinct(), [*scene, "tile_idx"], "left_semi")


def labelled_windows(windows: DataFrame, labels: DataFrame, scene: Sequence[str], size) -> DataFrame:
    """Grid windows holding at least one non-zero label pixel; they keep their grid index.

    Labels are reduced to the distinct windows they fall in before the join.
    """
    h, w = as_pair(size)
    hit = labels.where("class_id <> 0").selectExpr(
        *scene, f"prow - prow % {h} AS ymin", f"pcol - pcol % {w} AS xmin"
    ).distinct()
    return windows.join(hit, [*scene, "ymin", "xmin"], "left_semi")


def tile_has_label(labels: DataFrame, scene: Sequence[str], size) -> DataFrame:
    """Per grid window with any pixel: whether a label is non-zero."""
    h, w = as_pair(size)
    return labels.groupBy(
        *scene, F.expr(f"prow - prow % {h} AS ymin"), F.expr(f"pcol - pcol % {w} AS xmin")
    ).agg(F.expr("bool_or(class_id <> 0) AS has_label"))


def align_tiles(image: DataFrame, buildings: DataFrame, scene: Sequence[str]) -> DataFrame:
    """Pair the i-th image tile with the i-th building tile of a scene; surplus tiles of either side drop out."""
    keys = [*scene, "tile_idx"]
    other = buildings.selectExpr(*keys, *[f"{c} AS b_{c}" for c in buildings.columns if c not in keys])
    # windows are unfolded from few scenes: Spark's estimate is that of the scenes, and it would broadcast all windows
    return image.hint("merge").join(other, keys)


def equal_tile_counts(image: DataFrame, buildings: DataFrame, scene: Sequence[str]) -> DataFrame:
    """Scenes for which both tile sets have the same size: (scene, n_image, n_buildings)."""
    a = image.groupBy(*scene).agg(F.expr("count(1) AS n_image"))
    b = buildings.groupBy(*scene).agg(F.expr("count(1) AS n_buildings"))
    return a.join(b, list(scene)).where("n_image = n_buildings")


def subset(tiles: DataFrame, indices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tiles listed in another table."""
    # tiles are unfolded from few scenes: by Spark's estimate, that of the scenes, it would broadcast a list of most tiles
    return tiles.hint("merge").join(indices, list(keys), "left_semi")


def fold_split(
    tiles: DataFrame, scene: Sequence[str], n_splits: int = 2, test_ratio: float = 0.1, seed: int = SEED
) -> DataFrame:
    """Add ``fold``: the fold a tile validates (0..n_splits-1), or NULL for the held-out test tiles.

    Test tiles are the first ceil(ratio * n) of a seeded shuffle per scene; the rest is cut into folds
    whose sizes differ by at most one, larger ones first.
    """
    ranked = shuffled_rank(tiles, scene, ["tile_idx"], seed)
    k = n_splits
    place = "(pos - n_test)"
    rest = "(n - n_test)"
    big = f"({rest} % {k})"
    small_size = f"({rest} DIV {k})"
    limit = f"({big} * ({small_size} + 1))"
    fold = (
        f"CASE WHEN pos < n_test THEN NULL WHEN {place} < {limit} THEN {place} DIV ({small_size} + 1) "
        f"ELSE {big} + ({place} - {limit}) DIV greatest({small_size}, 1) END"
    )
    return ranked.selectExpr("*", f"CAST(ceil({test_ratio}D * n) AS BIGINT) AS n_test").selectExpr(
        *tiles.columns, f"CAST({fold} AS INT) AS fold"
    )


def split_label(folds: DataFrame, split: int) -> DataFrame:
    """train / val / test label of every tile for one split."""
    label = f"CASE WHEN fold IS NULL THEN 'test' WHEN fold = {split} THEN 'val' ELSE 'train' END"
    return folds.selectExpr(*[c for c in folds.columns if c != "fold"], f"{label} AS split")


def label_by_membership(tiles: DataFrame, assigned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Split of each tile from a table of assigned tiles; anything unlisted is test."""
    joined = tiles.join(assigned.select(*keys, "split"), list(keys), "left")
    return joined.selectExpr(*tiles.columns, "coalesce(split, 'test') AS split")


def ratio_split(
    tiles: DataFrame, scene: Sequence[str], val_ratio: float = 0.2, test_ratio: float = 0.2, seed: int = SEED
) -> DataFrame:
    """Add ``split``: validation and test get floor(ratio * n) tiles of a seeded shuffle, training the rest."""
    if not 0 < val_ratio < 1 or not 0 < test_ratio < 1 or val_ratio + test_ratio >= 1:
        raise ValueError("ratios must lie between 0 and 1 and leave room for training tiles")
    ranked = shuffled_rank(tiles, scene, ["tile_idx"], seed)
    val, test = f"floor({val_ratio}D * n)", f"floor({test_ratio}D * n)"
    label = f"CASE WHEN pos < {val} THEN 'val' WHEN pos < {val} + {test} THEN 'test' ELSE 'train' END"
    return ranked.selectExpr(*tiles.columns, f"{label} AS split")


def split_blocks(labelled: DataFrame, scene: str, split: str = "val") -> DataFrame:
    """Start and length of each scene's block when the tiles of one split are laid end to end.

    The running sum is over one row per scene.
    """
    counts = labelled.where(f"split = '{split}'").groupBy(scene).agg(F.expr("count(1) AS length"))
    return counts.selectExpr(
        scene, f"sum(length) OVER (ORDER BY {scene} ROWS UNBOUNDED PRECEDING) - length AS start", "length"
    )


def non_empty_splits(labelled: DataFrame, scene: str) -> DataFrame:
    """(scene, split, num_samples) with at least one tile."""
    return labelled.groupBy(scene, "split").agg(F.expr("count(1) AS num_samples")).where("num_samples > 0")
