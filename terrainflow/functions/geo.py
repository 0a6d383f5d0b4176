"""Geographic column functions: UTM zones, forward and inverse transverse Mercator, bounds and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
METRES_PER_DEGREE = 111_320.0

# WGS84, UTM scale and false origin.
SEMI_MAJOR, FLATTENING, SCALE, EASTING, NORTHING_SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0

_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# Krueger series in the third flattening, forward and inverse, to the sixth order.
_ALPHA = (
    _N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4 - 127 / 288 * _N**5 + 7891 / 37800 * _N**6,
    13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4 + 281 / 630 * _N**5 - 1983433 / 1935360 * _N**6,
    61 / 240 * _N**3 - 103 / 140 * _N**4 + 15061 / 26880 * _N**5 + 167603 / 181440 * _N**6,
    49561 / 161280 * _N**4 - 179 / 168 * _N**5 + 6601661 / 7257600 * _N**6,
    34729 / 80640 * _N**5 - 3418889 / 1995840 * _N**6,
    212378941 / 319334400 * _N**6,
)
_BETA = (
    _N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - 1 / 360 * _N**4 - 81 / 512 * _N**5 + 96199 / 604800 * _N**6,
    1 / 48 * _N**2 + 1 / 15 * _N**3 - 437 / 1440 * _N**4 + 46 / 105 * _N**5 - 1118711 / 3870720 * _N**6,
    17 / 480 * _N**3 - 37 / 840 * _N**4 - 209 / 4480 * _N**5 + 5569 / 90720 * _N**6,
    4397 / 161280 * _N**4 - 11 / 504 * _N**5 - 830251 / 7257600 * _N**6,
    4583 / 161280 * _N**5 - 108847 / 3991680 * _N**6,
    20648693 / 638668800 * _N**6,
)
_ECC = (FLATTENING * (2 - FLATTENING)) ** 0.5


def utm_zone(longitude: Column) -> Column:
    """1 to 60; longitudes outside are clamped."""
    zone = F.floor((longitude + 180) / 6) + 1
    return F.greatest(F.lit(1), F.least(F.lit(60), zone)).cast("int")


def utm_epsg(longitude: Column, latitude: Column) -> Column:
    return F.when(latitude >= 0, 32600 + utm_zone(longitude)).otherwise(32700 + utm_zone(longitude)).cast("int")


def to_utm(longitude: Column, latitude: Column, zone: Column, south: Column) -> Column:
    """struct(x, y): easting and northing in the zone."""
    lam = F.radians(longitude - (zone * 6 - 183))
    phi = F.radians(latitude)
    t = F.sinh(F.atanh(F.sin(phi)) - _ECC * F.atanh(_ECC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((EASTING + SCALE * _RECTIFYING * x).alias("x"), (SCALE * _RECTIFYING * y + F.when(south, NORTHING_SOUTH).otherwise(0.0)).alias("y"))


def from_utm(x: Column, y: Column, zone: Column, south: Column) -> Column:
    """struct(longitude, latitude) in degrees."""
    xi = (y - F.when(south, NORTHING_SOUTH).otherwise(0.0)) / (SCALE * _RECTIFYING)
    eta = (x - EASTING) / (SCALE * _RECTIFYING)
    a, b = xi, eta
    for j, k in enumerate(_BETA, 1):
        a = a - k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    conformal = F.asin(F.sin(a) / F.cosh(b))
    # latitude from the conformal latitude: fixed-point steps, each about two more orders of the eccentricity
    phi = conformal
    for _ in range(6):
        phi = F.asin(F.tanh(F.atanh(F.sin(conformal)) + _ECC * F.atanh(_ECC * F.sin(phi))))
    return F.struct((F.degrees(F.atan2(F.sinh(b), F.cos(a))) + zone * 6 - 183).alias("longitude"), F.degrees(phi).alias("latitude"))


def metric_crs(df: DataFrame, crs: str = "crs", x: str = "x", y: str = "y", site: str = "site_id") -> DataFrame:
    """Adds metric_crs: a projected CRS is kept, a geographic one becomes the UTM zone of the site's mean, others are unchanged."""
    mean = df.groupBy(site).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    geographic = F.col(crs).isin("EPSG:4326", "WGS84", "OGC:CRS84")
    return df.join(mean, site).withColumn("metric_crs", F.when(geographic, F.concat(F.lit("EPSG:"), utm_epsg(F.col("_x"), F.col("_y")))).otherwise(F.col(crs))).drop("_x", "_y")


def analysis_bounds(requests: DataFrame) -> DataFrame:
    """requests (latitude, longitude, radius_km and others) -> with south, north, west, east, and error for rows out of range."""
    lat, lon, km = F.col("latitude"), F.col("longitude"), F.col("radius_km")
    bad = lambda c: c.isNull() | F.isnan(c)
    error = (
        F.when(bad(lat) | ~lat.between(-90, 90), "latitude")
        .when(bad(lon) | ~lon.between(-180, 180), "longitude")
        .when(bad(km) | (km <= 0) | (km > 100), "radius_km")
    )
    d_lat = F.degrees(km / EARTH_KM)
    cos = F.cos(F.radians(lat))
    d_lon = F.when(F.abs(cos) < 1e-12, 180.0).otherwise(d_lat / cos)
    ok = F.col("error").isNull()
    return requests.withColumn("error", error).withColumns(
        {
            "south": F.when(ok, F.greatest(F.lit(-90.0), lat - d_lat)),
            "north": F.when(ok, F.least(F.lit(90.0), lat + d_lat)),
            "west": F.when(ok, F.greatest(F.lit(-180.0), lon - d_lon)),
            "east": F.when(ok, F.least(F.lit(180.0), lon + d_lon)),
        }
    )


def padded_bbox(df: DataFrame, metres: float, by: str = "site_id", latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """Box of each group, widened by metres, rounded to four places."""
    agg = df.groupBy(by).agg(F.min(latitude).alias("s"), F.max(latitude).alias("n"), F.min(longitude).alias("w"), F.max(longitude).alias("e"), F.avg(latitude).alias("m"))
    pad = F.lit(metres / METRES_PER_DEGREE)
    wide = pad / F.greatest(F.abs(F.cos(F.radians("m"))), F.lit(1e-6))
    return agg.select(by, F.round(F.col("s") - pad, 4).alias("south"), F.round(F.col("w") - wide, 4).alias("west"), F.round(F.col("n") + pad, 4).alias("north"), F.round(F.col("e") + wide, 4).alias("east"))


def bbox_relation(query: dict[str, Column], coverage: dict[str, Column]) -> Column:
    """full, partial or none: how the coverage holds the query box (keys south, north, west, east)."""
    inside = (coverage["south"] <= query["south"]) & (query["north"] <= coverage["north"]) & (coverage["west"] <= query["west"]) & (query["east"] <= coverage["east"])
    apart = (query["north"] < coverage["south"]) | (query["south"] > coverage["north"]) | (query["east"] < coverage["west"]) | (query["west"] > coverage["east"])
    return F.when(inside, "full").when(apart, "none").otherwise("partial")


def extent_center(df: DataFrame, by: str = "site_id", latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """Centre of each group's extent; null where the extent is all zero."""
    box = df.groupBy(by).agg(F.min(latitude).alias("a"), F.max(latitude).alias("b"), F.min(longitude).alias("c"), F.max(longitude).alias("d"))
    some = (F.col("a") != 0) | (F.col("b") != 0) | (F.col("c") != 0) | (F.col("d") != 0)
    return box.select(by, F.when(some, (F.col("a") + F.col("b")) / 2).alias("latitude"), F.when(some, (F.col("c") + F.col("d")) / 2).alias("longitude"))
