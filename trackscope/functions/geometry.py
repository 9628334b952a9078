"""Column functions over boxes (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(source: Column | None = None, prefix: str = "") -> Box:
    """The four corners as fields of ``source``, or as columns whose names begin with ``prefix``."""
    return tuple(source[n] if source is not None else F.col(prefix + n) for n in ("x1", "y1", "x2", "y2"))  # type: ignore[return-value]


def overlap(a: Box, b: Box, union: bool = True) -> Column:
    """Intersection over union, or over the area of ``b``; 0 where the intersection or the divisor is not positive."""
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    shared = F.when((width > 0) & (height > 0), width * height).otherwise(F.lit(0.0))
    area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
    whole = area(a) + area(b) - shared if union else area(b)
    return F.when(whole > 0, shared / whole).otherwise(F.lit(0.0))


def is_valid(b: Box) -> Column:
    """Positive width and height, and not all corners zero."""
    return (b[2] > b[0]) & (b[3] > b[1]) & ~((b[0] == 0) & (b[1] == 0) & (b[2] == 0) & (b[3] == 0))


def least_edge(b: Box) -> Column:
    return F.least(b[2] - b[0], b[3] - b[1])


def xywh_to_corners(x: Column, y: Column, w: Column, h: Column) -> Box:
    return x, y, x + w, y + h


def even_up(c: Column) -> Column:
    """The next even whole number."""
    return (F.floor((c + 1) / 2) * 2).cast("long")


def crop_padding(size: Column, most: int = 50, small: float = 150.0, large: float = 500.0) -> Column:
    """Whole pixels of padding: ``most`` up to ``small``, none from ``large`` on, falling in a line between."""
    ramp = (most * (1 - (size - small) / (large - small))).cast("int")
    return F.when(size <= small, F.lit(most)).when(size >= large, F.lit(0)).otherwise(ramp)


def centered_crop(center_x: Column, center_y: Column, side: Column, width: int, height: int) -> dict[str, Column]:
    """Corners of a square of ``side`` around a center, cut towards zero and moved into the picture; smaller only where the picture is."""
    first = lambda center, most: F.greatest(F.lit(0), F.least(F.greatest((center - side / 2).cast("int"), F.lit(0)), F.lit(most) - side))
    x1, y1 = first(center_x, width), first(center_y, height)
    return {"x1": x1.cast("long"), "y1": y1.cast("long"), "x2": F.least(F.lit(width), x1 + side).cast("long"), "y2": F.least(F.lit(height), y1 + side).cast("long")}


def free_crop_side(width: Column, height: Column, padding: int) -> tuple[Column, Column]:
    """Width and height of a crop that follows its own box: cut to whole pixels, padded on both sides, four paddings at least, even."""
    side = lambda c: even_up(F.greatest(c.cast("int") + 2 * padding, F.lit(4 * padding)))
    return side(width), side(height)
