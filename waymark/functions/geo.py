"""Positions on a sphere, as points in space: chords compare like great-circle distances and need no case at the poles or the date line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the sphere's radius in metres.
RADIUS = 6378168.0


def point(lat: Column, lng: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lng)
    return F.lit(RADIUS) * F.cos(a) * F.cos(b), F.lit(RADIUS) * F.cos(a) * F.sin(b), F.lit(RADIUS) * F.sin(a)


def chord(p: tuple, q: tuple) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(p, q, strict=True)), F.lit(0.0)))


def arc(chord: Column) -> Column:
    """Great-circle metres of a chord."""
    return F.lit(2 * RADIUS) * F.asin(F.least(F.lit(1.0), chord / (2 * RADIUS)))


def distance(lat: Column, lng: Column, lat2: Column, lng2: Column) -> Column:
    return arc(chord(point(lat, lng), point(lat2, lng2)))


def chord_of(metres: float) -> float:
    """The chord of a great-circle distance."""
    import math

    return 2 * RADIUS * math.sin(min(math.pi / 2, metres / (2 * RADIUS)))


def km(metres: Column) -> Column:
    """Kilometres with one decimal, halves up."""
    return F.floor(metres / 100 + 0.5) / 10
