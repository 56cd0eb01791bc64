"""Boxes as four integer columns (x1, y1, x2, y2), compared by JVM-side expressions only."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """The columns of a box."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{name}") for name in cls._fields))

    @classmethod
    def of_array(cls, array: Column) -> Box:
        return cls(*(F.get(array, F.lit(i)) for i in range(4)))

    def width(self) -> Column:
        return F.greatest(F.lit(0), self.x2 - self.x1)

    def height(self) -> Column:
        return F.greatest(F.lit(0), self.y2 - self.y1)

    def area(self) -> Column:
        return self.width() * self.height()

    def clamped(self, width: Column, height: Column) -> Box:
        def within(value: Column, most: Column) -> Column:
            return F.greatest(F.lit(0), F.least(value, most))

        return Box(within(self.x1, width), within(self.y1, height), within(self.x2, width), within(self.y2, height))

    def padded(self, by: int, width: Column, height: Column) -> Box:
        return Box(self.x1 - by, self.y1 - by, self.x2 + by, self.y2 + by).clamped(width, height)

    def intersection(self, other: Box) -> Column:
        shared = Box(F.greatest(self.x1, other.x1), F.greatest(self.y1, other.y1), F.least(self.x2, other.x2), F.least(self.y2, other.y2))
        return shared.area()

    def coverage_by(self, other: Box) -> Column:
        """Share of this box that the other covers."""
        return self.intersection(other) / F.greatest(F.lit(1), self.area())

    def share_of_smaller(self, other: Box) -> Column:
        """Intersection over the smaller of the two boxes."""
        mine, theirs = (F.greatest(F.lit(1), (b.x2 - b.x1) * (b.y2 - b.y1)) for b in (self, other))
        return self.intersection(other) / F.least(mine, theirs)

    def aspect(self) -> Column:
        return F.greatest(F.lit(1), self.x2 - self.x1) / F.greatest(F.lit(1), self.y2 - self.y1)

    def array(self) -> Column:
        return F.array(*self)


def hull(prefix: str = "") -> list[Column]:
    """Aggregates for the smallest box around a group's boxes."""
    return [F.min(f"{prefix}x1").alias("x1"), F.min(f"{prefix}y1").alias("y1"), F.max(f"{prefix}x2").alias("x2"), F.max(f"{prefix}y2").alias("y2")]


def rounded_box(value: Column) -> Column:
    """array<int> from a variant list of four numbers or numeric strings, rounded half to even; null otherwise."""
    numbers = F.try_variant_get(value, "$", "array<double>")
    whole = F.transform(numbers, lambda x: F.when(F.abs(x) < 2**31, F.bround(x).cast("int")))
    return F.when((F.size(numbers) == 4) & ~F.exists(whole, lambda x: x.isNull()), whole)


def cut_box(values: Column) -> Column:
    """array<int> from array<double>, cut towards zero; null unless there are four."""
    return F.when(F.size(values) == 4, F.transform(values, lambda x: x.cast("int")))


def numbered(prefix: str, number: Column) -> Column:
    """Ids such as view_001."""
    return F.format_string(f"{prefix}%03d", number.cast("int"))


def copy_name(sample_id: Column) -> Column:
    """Whether a sample's name says that it's a copy."""
    return F.lower(sample_id).rlike("([-_]copy$)| copy")


def sizes(values: Sequence[Column]) -> Column:
    """The first of the values that isn't null or zero."""
    return F.coalesce(*[F.when(v != 0, v) for v in values])
