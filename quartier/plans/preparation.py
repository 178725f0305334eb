"""Aligned, normalised and labelled tiles of two resolutions."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.functions import geometry as g
from quartier.operators.raster import rasterize
from quartier.operators.scoring import normalise_bands
from quartier.operators.spatial import spatial_join
from quartier.operators.tiles import (
    align_tiles, fold_split, grid_windows, labelled_windows, sliding_windows, windows_in_areas,
)

BANDS = ["b8", "b4", "b3", "b2"]


def label_bounds(labels: DataFrame, scene: str) -> DataFrame:
    """Total bounds of each scene's features."""
    return labels.groupBy(scene).agg(
        F.expr("min(bbox.xmin) AS xmin"), F.expr("min(bbox.ymin) AS ymin"),
        F.expr("max(bbox.xmax) AS xmax"), F.expr("max(bbox.ymax) AS ymax"),
    )


def scene_features(features: DataFrame, scenes: DataFrame, scene: str, cell: float) -> DataFrame:
    """Features meeting each scene's rectangle (xmin, ymax, res, height, width), tagged with the scene."""
    frame = ("xmin", "ymax - height * res", "xmin + width * res", "ymax")
    boxes = scenes.selectExpr(scene, f"{g.rectangle(*frame)} AS geom", f"{g.box(*frame)} AS bbox")
    pairs = spatial_join(features, boxes, cell)
    return pairs.selectExpr(f"r_{scene} AS {scene}", *[f"l_{c} AS {c}" for c in features.columns])


def tile_pixels(pixels: DataFrame, windows: DataFrame, scene: Sequence[str], size: int, stride: int) -> DataFrame:
    """Pixels of every window, with their place in it: (scene, tile_idx, i, pixel columns).

    Each pixel names the windows it falls in by arithmetic (overlap is size / stride per direction),
    then one equi-join on the window corner picks the existing ones.
    """
    def starts(axis: str) -> str:
        return (
            f"filter(transform(sequence(0, {(size - 1) // stride}), k -> ({axis} DIV {stride} - k) * {stride}), "
            f"s -> s >= 0 AND s + {size} > {axis})"
        )

    values = [c for c in pixels.columns if c not in scene]
    listed = pixels.selectExpr(*scene, *values, f"explode({starts('prow')}) AS ymin").selectExpr(
        *scene, *values, "ymin", f"explode({starts('pcol')}) AS xmin"
    )
    return listed.join(windows.select(*scene, "tile_idx", "ymin", "xmin"), [*scene, "ymin", "xmin"]).selectExpr(
        *scene, "tile_idx", f"(prow - ymin) * {size} + pcol - xmin AS i", *values
    )


def assemble_tiles(pixels: DataFrame, keys: Sequence[str], bands: Sequence[str], size: int) -> DataFrame:
    """One row per tile with a dense array per band, 0 where there is no pixel.

    A group holds at most size * size pixels. Missing places are added as zeros and the pixels sorted
    by place, which stays near linear in the tile size.
    """
    values = ", ".join(f"CAST(coalesce({b}, 0) AS FLOAT) AS {b}" for b in bands)
    zeros = ", ".join(f"'{b}', CAST(0 AS FLOAT)" for b in bands)
    missing = f"array_except(sequence(0L, {size * size - 1}L), transform(_l, e -> e.i))"
    filled = f"sort_array(concat(_l, transform({missing}, k -> named_struct('i', k, {zeros}))))"
    return (
        pixels.groupBy(*keys)
        .agg(F.expr(f"collect_list(struct(CAST(i AS BIGINT) AS i, {values})) AS _l"))
        .selectExpr(*keys, f"{filled} AS _f")
        .selectExpr(*keys, *[f"_f.{b} AS {b}" for b in bands])
    )


def prepare_tiles(
    scenes: DataFrame, pixels: DataFrame, buildings: DataFrame, labels: DataFrame | None, scene: str = "city",
    size: int = 256, stride: int = 128, labelled_only: bool = True, n_splits: int = 2, test_ratio: float = 0.1,
    cell: float = 2000.0, building_factor: int = 2, areas: DataFrame | None = None, within: bool = True,
    transform: Callable[[DataFrame, Sequence[str], Sequence[str]], DataFrame] = normalise_bands,
    classes: Mapping[int, float] | None = None,
) -> DataFrame:
    """Tiles of image bands, building raster (``buildings``) and burned labels (``labels``) of every scene with their fold.

    ``scenes`` give extent and pixel size of the image; the building raster is ``building_factor`` times
    finer with windows grown alike, so equal indices cover equal ground. ``labelled_only`` uses the
    non-overlapping windows with any label, else all sliding windows, of these those in or meeting ``areas`` if given.
    ``transform`` maps raw tile pixels (keys, i, bands) to the ones stored; ``classes`` gives the value burned into
    the building raster for each class. Arrays are in reading order. Folds are dealt on the tiles' keys alone.
    Without ``labels`` (for prediction) there is no label array and all sliding windows are used.
    """
    labelled_only = labelled_only and labels is not None
    keys = [scene]
    tile = [scene, "tile_idx"]
    fine = scenes.selectExpr(
        scene, "xmin", "ymax", f"res / {building_factor} AS res", f"height * {building_factor} AS height",
        f"width * {building_factor} AS width",
    )
    burned = None if labels is None else rasterize(scene_features(labels, scenes, scene, cell), scenes, scene, "order_id")
    if labelled_only:
        stride = size
        windows = labelled_windows(grid_windows(scenes, keys, size), burned, keys, size)
        fine_windows = grid_windows(fine, keys, size * building_factor)
    else:
        windows = sliding_windows(scenes, keys, size, stride)
        if areas is not None:
            windows = windows_in_areas(windows, areas, keys, within, 4.0 * size)
        fine_windows = sliding_windows(fine, keys, size * building_factor, stride * building_factor)
    footprint = rasterize(scene_features(buildings, fine, scene, cell), fine, scene, "order_id", classes=classes)

    def gathered(found: DataFrame, of: DataFrame, bands: Sequence[str], names: Sequence[str], n: int) -> DataFrame:
        # a window without any pixel reads as no data: zeros in every band
        empty = f"array_repeat(CAST(0 AS FLOAT), {n * n})"
        return of.join(assemble_tiles(found, tile, bands, n), tile, "left").selectExpr(
            *of.columns, *[f"coalesce({b}, {empty}) AS {name}" for b, name in zip(bands, names)]
        )

    image = tile_pixels(pixels.select(scene, "prow", "pcol", *BANDS), windows, keys, size, stride)
    image_tiles = gathered(transform(image, tile, BANDS), windows, BANDS, BANDS, size)
    if burned is not None:
        in_windows = tile_pixels(burned, windows, keys, size, stride)
        image_tiles = image_tiles.join(gathered(in_windows, windows.select(*tile), ["class_id"], ["labels"], size), tile)
    b_size, b_stride = size * building_factor, stride * building_factor
    covered = tile_pixels(footprint, fine_windows, keys, b_size, b_stride)
    building_tiles = gathered(covered, fine_windows.select(*tile), ["class_id"], ["buildings"], b_size)
    paired = align_tiles(image_tiles, building_tiles, keys).withColumnRenamed("b_buildings", "buildings")
    return paired.join(fold_split(windows.select(*tile), keys, n_splits, test_ratio), tile)
