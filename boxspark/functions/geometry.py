"""Box geometry as Column expressions. A box is its corners x1, y1, x2, y2 unless a name says cxcywh."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.width * self.height


def box(prefix: str = "", of: Column | None = None) -> Box:
    """The box in columns ``<prefix>x1`` ..., or in the fields of a struct."""
    return Box(*(of[c] if of is not None else F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")))


def from_cxcywh(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def scaled(b: Box, width: Column, height: Column) -> Box:
    """Normalised corners in pixels."""
    return Box(b.x1 * width, b.y1 * height, b.x2 * width, b.y2 * height)


def to_cxcywh(b: Box, width: Column, height: Column, int_pixels: bool = False) -> list[Column]:
    """Centre and size as parts of the image; ``int_pixels`` cuts corners to whole pixels first."""
    if int_pixels:
        b = Box(*(c.cast("int") for c in b))
    return [(b.x1 + b.x2) / 2.0 / width, (b.y1 + b.y2) / 2.0 / height, b.width / width, b.height / height]


def from_xywh(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Corner and size in pixels as normalised centre and size."""
    return [(x + w / 2.0) / width, (y + h / 2.0) / height, w / width, h / height]


def intersection(a: Box, b: Box) -> Column:
    wide = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0))
    high = F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0))
    return wide * high


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty, so touching boxes have 0."""
    inter = intersection(a, b)
    union = a.area + b.area - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def iou_distance(a: Box, b: Box) -> Column:
    return F.lit(1.0) - iou(a, b)


def overlap_of_smaller(a: Box, b: Box) -> Column:
    """Intersection over the smaller area; 0 where boxes are apart or empty."""
    inter, least = intersection(a, b), F.least(a.area, b.area)
    return F.when((inter > 0) & (least > 0), inter / least).otherwise(F.lit(0.0))


def may_reach_iou(a: Box, b: Box, threshold: float) -> Column:
    """Necessary for an IoU of ``threshold``: either size differs by no more than that ratio. Cheap, before the IoU."""
    return (
        (F.least(a.width, b.width) >= F.greatest(a.width, b.width) * F.lit(threshold))
        & (F.least(a.height, b.height) >= F.greatest(a.height, b.height) * F.lit(threshold))
    )


def area_ratio(b: Box, width: Column, height: Column) -> Column:
    return b.area / (width * height)


def size_class(ratio: Column, small: float = 0.01) -> Column:
    return F.when(ratio < small, F.lit("small")).otherwise(F.lit("normal"))


def confident(conf: Column, least: float) -> Column:
    """A missing confidence counts as 1."""
    return F.coalesce(conf, F.lit(1.0)) >= least


def unproject(b: Box, scale: Column, flipped: Column, width: Column) -> Box:
    """A box found on a scaled, perhaps mirrored view, on the image itself."""
    mirror = (width * scale).cast("int")
    return Box(
        F.when(flipped, (mirror - b.x2) / scale).otherwise(b.x1 / scale), b.y1 / scale,
        F.when(flipped, (mirror - b.x1) / scale).otherwise(b.x2 / scale), b.y2 / scale,
    )


def clipped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def hardness(error_type: Column, conf: Column, iou_value: Column) -> Column:
    """How hard an error is: confident false alarms and nearly found misses less so, small ones 0.8, others 0.5."""
    return (
        F.when(error_type == "FP", F.lit(1.0) - conf)
        .when(error_type == "FN", F.when(iou_value < 1, F.lit(1.0) - iou_value).otherwise(F.lit(0.0)))
        .when(error_type == "small", F.lit(0.8))
        .otherwise(F.lit(0.5))
    )


def oversample_ratio(score: Column, most: int = 5) -> Column:
    return F.when(score <= 0.5, 1).when(score < 0.7, 2).when(score < 0.9, 3).otherwise(min(5, most))


def variant_count(score: Column, most: int = 4) -> Column:
    return F.when(score < 0.5, 0).when(score < 0.7, 2).when(score < 0.9, 3).otherwise(min(4, most))
