"""Complex numbers as pairs of double columns: Catalyst sees every term."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def divided(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE has it: by 0 infinite, 0 / 0 NaN; no error."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(a * F.pow(b, F.lit(-1.0)))


def atan2(y: Column, x: Column) -> Column:
    """Angle as IEEE has it: Spark's own takes a negative zero for a positive one, which turns the angle by up to a half turn."""
    below = lambda c: (c < 0) | ((c == 0) & (F.pow(c, F.lit(-1.0)) < 0))
    flat = F.when(below(x), math.pi).otherwise(0.0)
    return F.when((y == 0) & ~F.isnan(x), F.when(below(y), -flat).otherwise(flat)).otherwise(F.atan2(y, x))


@dataclass(frozen=True)
class Cx:
    re: Column
    im: Column

    @classmethod
    def of(cls, i: str, q: str) -> Cx:
        return cls(F.col(i), F.col(q))

    @classmethod
    def turn(cls, phase: Column) -> Cx:
        """exp(j phase)."""
        return cls(F.cos(phase), F.sin(phase))

    def __add__(self, o: Cx) -> Cx:
        return Cx(self.re + o.re, self.im + o.im)

    def __sub__(self, o: Cx) -> Cx:
        return Cx(self.re - o.re, self.im - o.im)

    def __mul__(self, o: Cx | Column | float) -> Cx:
        if not isinstance(o, Cx):
            return Cx(self.re * o, self.im * o)
        return Cx(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def conj(self) -> Cx:
        return Cx(self.re, -self.im)

    def power(self) -> Column:
        return self.re * self.re + self.im * self.im

    def abs(self) -> Column:
        return F.sqrt(self.power())

    def arg(self) -> Column:
        return atan2(self.im, self.re)
