"""Box arithmetic as column expressions. A box is four DOUBLE columns x1, y1, x2, y2, top-left origin, y down."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Four columns. Box.of("a") reads a.x1 ..., Box.of() plain x1 ..."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(alias: str = "") -> Box:
        return Box(*[F.col(f"{alias}.{c}" if alias else c) for c in ("x1", "y1", "x2", "y2")])

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2

    @property
    def area(self) -> Column:
        return F.greatest(F.lit(0.0), self.width) * F.greatest(F.lit(0.0), self.height)

    def holds(self, x: Column, y: Column) -> Column:
        """The point lies inside, edges included."""
        return (x >= self.x1) & (x <= self.x2) & (y >= self.y1) & (y <= self.y2)

    def holds_center(self, other: Box, pad: float = 0.0) -> Column:
        return Box(self.x1 - pad, self.y1 - pad, self.x2 + pad, self.y2 + pad).holds(other.cx, other.cy)

    def union(self, other: Box) -> Box:
        return Box(F.least(self.x1, other.x1), F.least(self.y1, other.y1), F.greatest(self.x2, other.x2), F.greatest(self.y2, other.y2))

    def meet(self, other: Box) -> Box:
        """The intersection; its area is 0 where there is none."""
        return Box(F.greatest(self.x1, other.x1), F.greatest(self.y1, other.y1), F.least(self.x2, other.x2), F.least(self.y2, other.y2))

    def overlap_of_smaller(self, other: Box) -> Column:
        """Intersection over the smaller area; 0 where either is empty."""
        small = F.least(self.area, other.area)
        return F.when(small > 0, self.meet(other).area / small).otherwise(F.lit(0.0))

    def columns(self) -> list[Column]:
        return [self.x1.alias("x1"), self.y1.alias("y1"), self.x2.alias("x2"), self.y2.alias("y2")]


def from_points(left: Column, bottom: Column, right: Column, top: Column, page_height: Column, dpi: Column) -> Box:
    """PDF points (y up) to raster pixels (y down), corners in order."""
    s = dpi / F.lit(72.0)
    xa, xb, ya, yb = left * s, right * s, (page_height - top) * s, (page_height - bottom) * s
    return Box(F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb))


def to_grid(value: Column, extent: Column, grid: int = 1000) -> Column:
    """Onto 0..grid, rounded half to even and clamped."""
    return F.least(F.greatest(F.bround(value * grid / extent), F.lit(0)), F.lit(grid)).cast("int")
