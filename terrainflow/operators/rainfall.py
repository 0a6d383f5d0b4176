"""Seasonal rainfall and runoff."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RainfallConfig:
    runoff_coefficient: float = 0.3
    seasonal_months: tuple[int, ...] = (6, 7, 8, 9)
    rainfall_years: int = 5
    min_rainfall_mm: float = 1.0
    min_catchment_area_m2: float = 100.0

    def __post_init__(self):
        if not 0 < self.runoff_coefficient <= 1:
            raise ValueError("runoff_coefficient must be over 0 and at most 1")
        if not self.seasonal_months or any(m not in range(1, 13) for m in self.seasonal_months):
            raise ValueError("seasonal_months must be months")
        if self.rainfall_years < 1:
            raise ValueError("rainfall_years must be at least 1")


def period(as_of: Column, years: int) -> tuple[Column, Column]:
    """First and last day of the last full calendar years before as_of."""
    year = F.year(as_of)
    return F.make_date(year - years, F.lit(1), F.lit(1)), F.make_date(year - 1, F.lit(12), F.lit(31))


def location_key(latitude: Column, longitude: Column) -> Column:
    return F.struct(F.round(latitude, 6).alias("lat6"), F.round(longitude, 6).alias("lon6"))


def seasonal_rainfall(daily: DataFrame, config: RainfallConfig = RainfallConfig(), by: str = "site_id", start: str | None = None, end: str | None = None) -> DataFrame:  # noqa: B008
    """daily (by, date, mm) -> by, seasonal_total_mm, daily_values_used, date_start, date_end, mean_annual_mm.

    Null mm is 0, dates that cannot be read are skipped, groups without a day of the season have no row. The mean is
    over the configured years. A plain grouped aggregate: daily may be a stream.
    """
    day = F.try_to_date(F.col("date").cast("string"))
    used = daily.select(by, day.alias("day"), F.coalesce(F.col("mm").cast("double"), F.lit(0.0)).alias("mm")).where(F.month("day").isin(*config.seasonal_months))
    if start:
        used = used.where(F.col("day") >= F.lit(start).cast("date"))
    if end:
        used = used.where(F.col("day") <= F.lit(end).cast("date"))
    out = used.groupBy(by).agg(F.sum("mm").alias("seasonal_total_mm"), F.count("*").alias("daily_values_used"), F.min("day").alias("date_start"), F.max("day").alias("date_end"))
    return out.withColumn("mean_annual_mm", F.col("seasonal_total_mm") / config.rainfall_years)


def runoff(df: DataFrame, config: RainfallConfig = RainfallConfig(), rainfall: str = "mean_annual_mm", area: str = "catchment_area_m2", support: str = "terrain_support") -> DataFrame:  # noqa: B008
    """Adds runoff_m3, storage_m3, water_availability_status, calculation_notes."""
    p, a = F.col(rainfall), F.col(area)
    short, small = p.isNull() | (p < config.min_rainfall_mm), a.isNull() | (a < config.min_catchment_area_m2)
    volume = F.when(~short & ~small, p / 1000.0 * a * config.runoff_coefficient)
    status = F.when(short, "insufficient_rainfall_data").when(small, "catchment_too_small").when(F.col("runoff_m3") < 10, "very_low").when(F.col("runoff_m3") < 1000, "low").when(F.col("runoff_m3") < 10000, "moderate").when(F.col("runoff_m3") < 100000, "good").otherwise("high")
    note = F.when(short, "rainfall unknown or below the minimum").when(small, F.format_string("catchment of %.1f m2 below the minimum", a)).otherwise(F.format_string(f"%.4f m x %.1f m2 x {config.runoff_coefficient:.2f}", p / 1000.0, a))
    return df.withColumn("runoff_m3", volume).withColumns({"storage_m3": F.when(F.coalesce(F.col(support), F.lit(False)) & (F.col("runoff_m3") > 0), F.col("runoff_m3") * 0.5), "water_availability_status": status, "calculation_notes": note})


def candidate_runoff(candidates: DataFrame, daily: DataFrame, config: RainfallConfig = RainfallConfig(), as_of: str = "2025-01-01") -> DataFrame:  # noqa: B008
    """candidates (latitude, longitude, catchment_area_m2, terrain_support), daily (lat6, lon6, date, mm) -> candidates with rain and runoff.

    Each location has one series, joined by rounded coordinates. rainfall_mm is the total over the years, the runoff
    uses the yearly mean. status: ok, provider_unavailable or missing_coordinates.
    """
    first, last = f"{int(as_of[:4]) - config.rainfall_years}-01-01", f"{int(as_of[:4]) - 1}-12-31"
    series = seasonal_rainfall(daily.withColumn("place", F.struct(F.round("lat6", 6).alias("lat6"), F.round("lon6", 6).alias("lon6"))), config, "place", first, last)
    placed = candidates.withColumn("place", location_key(F.col("latitude"), F.col("longitude")))
    out = runoff(placed.join(series, "place", "left"), config)
    status = F.when(F.col("latitude").isNull() | F.col("longitude").isNull(), "missing_coordinates").when(F.col("seasonal_total_mm").isNull(), "provider_unavailable").otherwise("ok")
    quality = F.struct(F.col("daily_values_used"), F.col("date_start"), F.col("date_end"), F.lit(config.rainfall_years).alias("years"))
    return out.withColumns({"rainfall_mm": F.col("seasonal_total_mm"), "rainfall_status": status, "rainfall_quality": quality}).drop("place", "daily_values_used", "date_start", "date_end")
