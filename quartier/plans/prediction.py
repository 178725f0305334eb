"""Score tiles with several models, stitch, discretise, vectorise and merge."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from quartier.functions import geometry as g
from quartier.operators.focal import opening
from quartier.operators.regions import label_regions, outer_rings, ring_polygons
from quartier.operators.scoring import discretise, ensemble_mean, explode_scores, normalise_bands, score_tiles, smooth
from quartier.operators.skew import lookup_join
from quartier.operators.tiles import IMAGE_STRIDE, IMAGE_TILE
from quartier.plans.preparation import prepare_tiles
from quartier.session import materialise
from quartier.sources.imagery import match_images, skipped_cities
from quartier.sources.sinks import write_prediction_store
from quartier.sources.vectors import city_predictions

THRESHOLD = 0.5
KERNEL = 8


def ensemble_scores(
    tiles: DataFrame, models: dict[str, Callable], inputs: Sequence[str], keys: Sequence[str], logits: bool = True
) -> DataFrame:
    """Mean probability array per tile over all models."""
    parts = [score_tiles(tiles, m, inputs, keys, name, logits) for name, m in models.items()]
    scored = reduce(lambda a, b: a.unionByName(b), parts)
    return ensemble_mean(scored, keys)


def stitched_mask(
    tiles: DataFrame, scores: DataFrame, scene: Sequence[str], width: int, threshold: float = THRESHOLD
) -> DataFrame:
    """Discrete pixels (scene, prow, pcol, m): overlapping tile scores averaged, then cut strictly."""
    keys = [*scene, "tile_idx"]
    placed = tiles.select(*keys, "row0", "col0").join(scores, keys)
    return discretise(smooth(explode_scores(placed, list(scene), width), scene), threshold)


def predict(
    tiles: DataFrame, models: dict[str, Callable], inputs: Sequence[str], scene: Sequence[str], width: int,
    kernel: int = KERNEL, block: int = 256,
) -> tuple[DataFrame, DataFrame]:
    """Discrete pixels and labelled region pixels of every scene in one plan."""
    scores = ensemble_scores(tiles, models, inputs, [*scene, "tile_idx"])
    mask = materialise(stitched_mask(tiles, scores, scene, width))
    opened = opening(mask, scene, "m", kernel) if kernel > 0 else mask
    return mask, label_regions(opened.where("m = 1"), scene, block)


def region_features(regions: DataFrame, scenes: DataFrame, scene: Sequence[str]) -> DataFrame:
    """Region outlines in map coordinates; ``scenes`` hold xmin, ymax and res."""
    polygons = ring_polygons(outer_rings(regions, scene), scene)
    moved = g.map_vertices("geom", lambda v: g.point(f"xmin + {v}.x * res", f"ymax - {v}.y * res"))
    return polygons.join(scenes.select(*scene, "xmin", "ymax", "res"), list(scene)).selectExpr(
        *scene, "region", f"{moved} AS geom"
    )


def matched_pixels(pixels: DataFrame, found: DataFrame) -> DataFrame:
    """Pixels of the images of ``found`` (image_path, scene) with their scene.

    The semi-join goes below joins that ``pixels`` are made by, so pixels of the other images are never listed.
    """
    wanted = found.select("image_path", "scene")
    return lookup_join(pixels.join(wanted, "image_path", "left_semi"), wanted, ["image_path"])


def predict_cities(
    cities: DataFrame, images: DataFrame, scenes: DataFrame, pixels: DataFrame, buildings: DataFrame,
    models: dict[str, Callable], inputs: Sequence[str], path: str, class_id: int, class_name: str,
    size: int = IMAGE_TILE, stride: int = IMAGE_STRIDE, kernel: int = KERNEL, block: int = 256, cell: float = 2000.0,
    transform: Callable = normalise_bands,
) -> DataFrame:
    """From city names to the prediction store below ``path``; returns the cities skipped for want of an image.

    ``cities`` are (country, city), ``images`` (image_path); ``scenes`` and ``pixels`` carry the image_path they
    belong to, ``buildings`` order_id, class_id, geom and bbox. The building raster is burned on each image's own
    extent, so both cover the same ground. All cities run in one plan.
    """
    matched = materialise(match_images(cities, images))
    found = matched.where("image_path IS NOT NULL").selectExpr("*", "to_json(struct(country, city)) AS scene")
    placed = materialise(lookup_join(scenes, found.select("image_path", "scene"), ["image_path"]))
    own = matched_pixels(pixels, found)
    tiles = prepare_tiles(placed, own, buildings, None, "scene", size, stride, cell=cell, transform=transform)
    mask, regions = predict(tiles.selectExpr("*", "ymin AS row0", "xmin AS col0"), models, inputs, ["scene"], size, kernel, block)
    names = found.select("scene", "country", "city")
    areas = lookup_join(region_features(regions, placed, ["scene"]), names, ["scene"]).drop("scene")
    write_prediction_store(areas, lookup_join(mask, names, ["scene"]).drop("scene"), path, class_id, class_name)
    return skipped_cities(matched)


def merge_predictions(spark: SparkSession, folder: str, by_country: bool = False) -> DataFrame:
    """All city (or merged country) prediction files below a folder as one table with country and city."""
    return city_predictions(spark, folder, by_country)


def merge_splits(parts: dict[int, DataFrame]) -> DataFrame:
    """Predictions of several splits side by side, named by split; missing columns become NULL."""
    named = [df.selectExpr("*", f"{split} AS split") for split, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def common_pixel_boxes(scenes: DataFrame) -> DataFrame:
    """Pixel boxes of the common map extent in the image (clamped) and in the building raster (made positive).

    ``scenes`` hold the wanted bounds (x0, y0, x1, y1) and the image's xmin, ymax, res, height, width.
    """
    top, left = g.map_to_pixel("x0", "y1", "xmin", "ymax", "res")
    bottom, right = g.map_to_pixel("x1", "y0", "xmin", "ymax", "res")
    raw = f"named_struct('ymin', {top}, 'xmin', {left}, 'ymax', {bottom}, 'xmax', {right})"
    boxed = scenes.selectExpr("*", f"{raw} AS raw_box")
    return boxed.selectExpr(
        "*", f"{g.clamp_pixel_box('raw_box', 'height', 'width')} AS image_box",
        f"{g.positive_pixel_box('raw_box')} AS building_box",
    )
