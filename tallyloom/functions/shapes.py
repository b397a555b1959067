"""Boxes and colours of chart images.  Boxes are given by four columns or an array [x, y, w, h]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_region(region: Column, width: Column, height: Column) -> Column:
    """The region if it lies inside the image (one pixel of tolerance), else null."""
    x, y, w, h = (region[i] for i in range(4))
    return F.when((F.size(region) == 4) & (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= width + 1) & (y + h <= height + 1), region)


def oriented(width: Column, height: Column, orientation: Column) -> Column:
    """struct(width, height) as shown: orientations from 5 lie on their side."""
    return F.struct(F.when(orientation >= 5, height).otherwise(width).alias("width"), F.when(orientation >= 5, width).otherwise(height).alias("height"))


def overlap_area(a: str, b: str) -> Column:
    """Common area of the boxes whose columns have these prefixes (``l.`` and ``r.``)."""
    c = F.col
    wide = F.least(c(f"{a}x") + c(f"{a}w"), c(f"{b}x") + c(f"{b}w")) - F.greatest(c(f"{a}x"), c(f"{b}x"))
    high = F.least(c(f"{a}y") + c(f"{a}h"), c(f"{b}y") + c(f"{b}h")) - F.greatest(c(f"{a}y"), c(f"{b}y"))
    return F.greatest(F.lit(0), wide) * F.greatest(F.lit(0), high)


def overlaps(a: str, b: str, tenths: int = 8) -> Column:
    """Whether the boxes share more than so many tenths of the smaller one."""
    smaller = F.least(F.col(f"{a}w") * F.col(f"{a}h"), F.col(f"{b}w") * F.col(f"{b}h"))
    return overlap_area(a, b) * 10 > smaller * tenths


def union_box(x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> list[Column]:
    """Aggregates of the box around a group of boxes."""
    c = F.col
    return [F.min(x).alias("x"), F.min(y).alias("y"), (F.max(c(x) + c(w)) - F.min(x)).alias("w"), (F.max(c(y) + c(h)) - F.min(y)).alias("h")]


def layout_kind(w: Column, h: Column, step: Column) -> Column:
    """Where a legend's numbers stand, from the swatch and the pitch."""
    return F.when((w * 10 > h * 8) & (w * 10 < h * 12) & (step > w * 4), "beside").when((w * 100 > h * 65) & (w * 10 < h * 12), "below").when(w > h * 3, "inline").otherwise("right")


def touches_edge(a: str, b: str) -> Column:
    """Whether box ``a`` isn't strictly inside box ``b``."""
    c = F.col
    return (c(f"{a}x") <= c(f"{b}x")) | (c(f"{a}y") <= c(f"{b}y")) | (c(f"{a}x") + c(f"{a}w") >= c(f"{b}x") + c(f"{b}w")) | (c(f"{a}y") + c(f"{a}h") >= c(f"{b}y") + c(f"{b}h"))


def off_centre(at: Column, centre: Column, pitch: Column) -> Column:
    """More than a fifth of the pitch from the centre of a cell."""
    return F.abs(at - centre) * 5 > pitch


def channel_distance(a: str, b: str) -> Column:
    """Largest difference in a colour channel."""
    return F.greatest(*[F.abs(F.col(f"{a}{k}") - F.col(f"{b}{k}")) for k in "rgb"])


def square_distance(a: str, b: str) -> Column:
    """Squared Euclidean distance of colours: whole numbers, so ties are exact."""
    return sum(((F.col(f"{a}{k}") - F.col(f"{b}{k}")) * (F.col(f"{a}{k}") - F.col(f"{b}{k}")) for k in "rgb"), F.lit(0))


def flat(low: list[Column], high: list[Column], spread: int = 5) -> Column:
    """Whether a cell's pixels hardly vary in any channel."""
    return F.greatest(*[b - a for a, b in zip(low, high)]) < spread
