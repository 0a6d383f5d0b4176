"""Column functions that turn measurements into scores between 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def safe(value: Column, default: float | None = None) -> Column:
    """A number, or default for null, NaN and infinities."""
    number = value.try_cast("double")
    good = ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(good, number).otherwise(F.lit(default).cast("double"))


def trapezoid(value: Column, low: float, ideal_low: float, ideal_high: float, high: float) -> Column:
    """Rises to 1 at ideal_low, falls from ideal_high to 0 at high."""
    up, down = clamp((value - low) / (ideal_low - low)), 1.0 - clamp((value - ideal_high) / (high - ideal_high))
    return F.when(value < ideal_low, up).when(value > ideal_high, down).otherwise(1.0)


def bounded(value: Column, low: float, high: float, ideal_low: float, ideal_high: float, invert: bool = False, missing: float = 0.5) -> Column:
    """Null: missing. 1 between the ideals; below, the ratio from low; above, the ratio from ideal_high to high, which
    rises with the value. invert takes both tails from 1.
    """
    inside = clamp(value, low, high)
    below, above = clamp((inside - low) / (ideal_low - low)), clamp((inside - ideal_high) / (high - ideal_high))
    tail = (lambda r: 1.0 - r) if invert else (lambda r: r)
    return F.when(value.isNull(), missing).when(inside < ideal_low, tail(below)).when(inside > ideal_high, tail(above)).otherwise(1.0)


def distance_score(value: Column, low: float, high: float, missing: float = 0.5) -> Column:
    """Null: missing; 0 up to low, 1 from high, linear between: farther is better."""
    return F.when(value.isNull(), missing).when((value <= 0) | (value < low), 0.0).when(value >= high, 1.0).otherwise((value - low) / (high - low))


def slope_score(slope_degrees: Column) -> Column:
    """The bounds 0, 2, 12 and 35 hold for the grade in percent."""
    return trapezoid(F.greatest(F.lit(0.0), F.tan(F.radians(slope_degrees)) * 100.0), 0.0, 2.0, 12.0, 35.0)


def catchment_score(area_m2: Column) -> Column:
    return F.when(area_m2 <= 0, 0.0).otherwise(trapezoid(area_m2, 10_000.0, 15_000.0, 1_500_000.0, 3_000_000.0))


def rainfall_score(mm: Column) -> Column:
    return F.when(F.coalesce(mm, F.lit(0.0)) <= 0, 0.0).otherwise(trapezoid(mm, 200.0, 600.0, 1800.0, 2500.0))


def water_distance_score(metres: Column, most: float = 300.0) -> Column:
    return F.when(metres.isNull(), 0.5).when(metres <= 0, 1.0).otherwise(clamp(1.0 - metres / most))


def clearance_score(metres: Column, least: float = 25.0, most: float = 250.0) -> Column:
    return distance_score(metres, least, most)


def land_use_score(n_water: Column, n_roads: Column, n_buildings: Column) -> Column:
    """Null counts: no context, 0.75. Fixed penalties for water, and per road and building up to three."""
    loss = F.when(n_water > 0, 0.25).otherwise(0.0) + 0.15 * F.least(n_roads, F.lit(3)) / 3.0 + 0.20 * F.least(n_buildings, F.lit(3)) / 3.0
    return F.when(n_water.isNull() & n_roads.isNull() & n_buildings.isNull(), 0.75).otherwise(clamp(1.0 - loss))
