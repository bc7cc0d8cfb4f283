"""Boxes, points and pitch coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.schemas import PITCH_LENGTH, PITCH_WIDTH


def box_centre(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Centre, truncated to whole pixels."""
    return F.struct(((x1 + x2) / 2).cast("int").alias("x"), ((y1 + y2) / 2).cast("int").alias("y"))


def box_foot(x1: Column, x2: Column, y2: Column) -> Column:
    """Middle of the lower edge, truncated to whole pixels."""
    return F.struct(((x1 + x2) / 2).cast("int").alias("x"), y2.cast("int").alias("y"))


def valid_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 > x1) & (y2 > y1)


def position(obj: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The ball stands at its centre, everyone else at the foot."""
    return F.when(obj == "ball", box_centre(x1, y1, x2, y2)).otherwise(box_foot(x1, x2, y2))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def clamp(value: Column, high: float, low: float = 0.0) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def to_pitch(x: Column, y: Column, h: list[Column]) -> Column:
    """Pixels to pitch metres by the nine entries of a homography in centimetres, clamped to the pitch."""
    depth = h[6] * x + h[7] * y + h[8]
    across = (h[0] * x + h[1] * y + h[2]) / depth * 0.01
    along = (h[3] * x + h[4] * y + h[5]) / depth * 0.01
    return F.struct(clamp(across, PITCH_LENGTH).alias("x"), clamp(along, PITCH_WIDTH).alias("y"))


def corners_to_size(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))


def size_to_corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two corner boxes; 0 where either is empty."""
    width = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = width * height
    whole = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))


def kalman_measure(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Centre, aspect ratio and height; a height of 0 counts as 1."""
    height = F.when(y2 - y1 == 0, 1).otherwise(y2 - y1)
    return F.struct(((x1 + x2) / 2).alias("cx"), ((y1 + y2) / 2).alias("cy"), ((x2 - x1) / height).alias("aspect"), height.alias("h"))


def between(a: Column, b: Column, share: Column) -> Column:
    """Linear interpolation, at a for share 0 and b for share 1."""
    return a + (b - a) * share


def frame_at(seconds: Column, fps: float) -> Column:
    """The frame shown at a time, rounded down."""
    return F.floor(seconds * fps).cast("long")


def large_enough(w: Column, h: Column, least: float = 8.0) -> Column:
    """Whether a box has the least width and height in pixels."""
    return (w >= least) & (h >= least)


def pitch_pixel(value: Column, length: float, pixels: int, margin: int) -> Column:
    """A pitch coordinate on a drawing of so many pixels within a margin, truncated."""
    return F.lit(margin) + (value / F.lit(length) * pixels).cast("int")


def overlay_size(w: Column, h: Column, most: int = 720) -> tuple[Column, Column]:
    """Width and height, scaled to the largest height."""
    return F.when(h > most, (w * most / h).cast("int")).otherwise(w), F.least(h, F.lit(most))
