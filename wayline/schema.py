"""Boxes, grids and the column layout of the tables."""

from __future__ import annotations

from dataclasses import asdict, dataclass

POINT = "struct<t:bigint,x:double,y:double>"
POINTS = f"array<{POINT}>"

# What the upper bounds of a data set are padded with, so that no point lies on them; fixed values.
PAD_DEGREES, PAD_MILLIS = 1e-7, 1000


@dataclass(frozen=True)
class Box:
    """A closed range of longitude, latitude and time (epoch ms)."""

    x0: float
    y0: float
    t0: int
    x1: float
    y1: float
    t1: int


@dataclass(frozen=True)
class Grid:
    """2**bits equal parts of each axis of a bounding box; ``dims`` 2 leaves time uncut."""

    bits: int
    dims: int
    x0: float
    y0: float
    t0: int
    x1: float
    y1: float
    t1: int

    @property
    def parts(self) -> int:
        return 1 << self.bits

    def axes(self) -> list[tuple[str, float, float]]:
        """(point field, lower bound, upper bound) of the axes that are cut."""
        return [("x", self.x0, self.x1), ("y", self.y0, self.y1), ("t", float(self.t0), float(self.t1))][: self.dims]

    def ordinate(self, axis: int, value: float) -> int:
        """The part a value lies in; values outside go to the first or last."""
        _, low, high = self.axes()[axis]
        return min(max(int((value - low) / (high - low) * self.parts // 1), 0), self.parts - 1)

    def edge(self, axis: int, ordinate: int) -> float:
        _, low, high = self.axes()[axis]
        return low + ordinate * (high - low) / self.parts

    def as_dict(self) -> dict:
        return asdict(self)
