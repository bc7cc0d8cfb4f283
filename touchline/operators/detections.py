"""Detections of a frame: class and confidence filters, numbering, key points, boxes of crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYPOINT_CONFIDENCE = 0.65


def remap_class(cls: Column) -> Column:
    """Goalkeepers count as players."""
    return F.when(F.lower(cls).contains("goalkeeper"), "player").otherwise(F.lower(cls))


def tracked_only(detections: DataFrame) -> DataFrame:
    """Players and goalkeepers, both as players; referees and the ball are not tracked."""
    return detections.withColumn("cls", remap_class(F.col("cls"))).where(F.col("cls") == "player")


def numbered_players(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Players numbered from 1 by confidence among all detections of the frame, so that numbers may have gaps."""
    order = Window.partitionBy(*keys).orderBy(F.desc("conf"), "idx")
    return tracked_only(detections.withColumn("id", F.row_number().over(order)))


def post_filter(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Players and goalkeepers of each frame; where there is none, all but referees and the ball. Numbered afterwards."""
    wanted = F.col("cls").isin("player", "goalkeeper")
    some = F.max(wanted.cast("int")).over(Window.partitionBy(*keys))
    kept = detections.withColumn("__some", some).where(wanted | ((F.col("__some") == 0) & ~F.col("cls").isin("referee", "ball")))
    order = Window.partitionBy(*keys).orderBy(F.desc("conf"), "idx")
    return kept.withColumn("id", F.row_number().over(order)).drop("__some")


def key_points(points: DataFrame) -> DataFrame:
    """Points seen with confidence, other than (0, 0)."""
    return points.where((F.col("conf") > KEYPOINT_CONFIDENCE) & ~((F.col("x") == 0) & (F.col("y") == 0)))


def on_pitch(points: DataFrame, pitch_points: DataFrame, key: str) -> DataFrame:
    """Key points with their place on the pitch; names the pitch does not know are dropped. pitch_points is a fixed small table."""
    return points.join(F.broadcast(pitch_points), key)


def crop_filter(masks: DataFrame, least_iou: float, least_stability: float, border: int) -> DataFrame:
    """Masks of enough predicted overlap and stability that do not touch their crop's edge, unless it is the image's (crop_*, image_w, image_h)."""
    near = [
        (F.abs(F.col("x1") - F.col("crop_x1")) <= border) & (F.col("x1") > border),
        (F.abs(F.col("y1") - F.col("crop_y1")) <= border) & (F.col("y1") > border),
        (F.abs(F.col("x2") - F.col("crop_x2")) <= border) & (F.col("image_w") - F.col("x2") > border),
        (F.abs(F.col("y2") - F.col("crop_y2")) <= border) & (F.col("image_h") - F.col("y2") > border),
    ]
    touches = near[0] | near[1] | near[2] | near[3]
    return masks.where((F.col("pred_iou") > least_iou) & (F.col("stability") >= least_stability) & ~touches)


def uncrop(boxes: DataFrame) -> DataFrame:
    """Boxes of a crop moved to where the crop lies in the image."""
    return boxes.withColumns({c: F.col(c) + F.col("crop_x1" if c[0] == "x" else "crop_y1") for c in ("x1", "y1", "x2", "y2")})


def stability(pixels: DataFrame, keys: list[str], threshold: float, offset: float) -> DataFrame:
    """Pixels above the higher threshold by pixels above the lower one, from one value a pixel."""
    count = [F.sum((F.col("value") > threshold + sign * offset).cast("int")) for sign in (1, -1)]
    found = pixels.groupBy(*keys).agg(count[0].alias("inner_pixels"), count[1].alias("outer_pixels"))
    return found.withColumn("stability", F.when(F.col("outer_pixels") > 0, F.col("inner_pixels") / F.col("outer_pixels")).otherwise(0.0))


def crop_boxes(images: DataFrame, layers: int, overlap: float) -> DataFrame:
    """layer, x1, y1, x2, y2 of the overlapping crops of each image (w, h): 4^i of layer i, and the whole image."""
    layer = images.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers))))
    side = F.pow(F.lit(2), F.col("layer")).cast("int")
    shared = F.floor(F.lit(overlap) * F.least("w", "h") * (2 / side))
    layer = layer.withColumns({"side": side, "shared": F.when(F.col("layer") == 0, 0).otherwise(shared)})
    length = {c: F.ceil((F.col("shared") * (F.col("side") - 1) + F.col(c)) / F.col("side")) for c in ("w", "h")}
    layer = layer.withColumns({"cw": length["w"], "ch": length["h"]})
    cells = layer.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("side") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    x, y = (F.col("cw") - F.col("shared")) * F.col("i"), (F.col("ch") - F.col("shared")) * F.col("j")
    cells = cells.withColumns({"x1": x.cast("int"), "y1": y.cast("int")})
    return cells.withColumns({"x2": F.least(F.col("x1") + F.col("cw"), "w").cast("int"), "y2": F.least(F.col("y1") + F.col("ch"), "h").cast("int")}).drop(
        "side", "shared", "cw", "ch", "i", "j"
    )
