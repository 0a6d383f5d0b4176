"""Terrain tables derived from the star-schema tables: grids from orders, features from customers and suppliers, rain from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITE_CELLS = 1024
SITE_COLS = 32
WIDE_COLS = 120
RESOLUTION = 5.0
X0, Y0 = 500_000.0, 2_350_000.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _elevation(row, col):
    noise = F.round(F.col("o_totalprice") / 250000.0, 3)
    return F.when(F.col("o_orderkey") % 97 != 13, 100.0 + 0.5 * row + 0.25 * col + noise)


def dem_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, row, col, elevation (null: no data); 32 x 32 cells a site, the last site is ragged."""
    key = F.col("o_orderkey")
    site = F.floor(key / SITE_CELLS).cast("bigint")
    row, col = F.floor((key % SITE_CELLS) / SITE_COLS).cast("int"), (key % SITE_COLS).cast("int")
    return read(spark, sf_dir, "orders").select(site.alias("site_id"), row.alias("row"), col.alias("col"), _elevation(row, col).alias("elevation"))


def dem_meta(cells: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """site_id, rows, cols, resolution_m of a cell table."""
    return cells.groupBy("site_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.lit(resolution).alias("resolution_m"))


def dem_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site of 120 columns."""
    row, col = F.floor(F.col("o_orderkey") / WIDE_COLS).cast("int"), (F.col("o_orderkey") % WIDE_COLS).cast("int")
    return read(spark, sf_dir, "orders").select(F.lit(0).cast("bigint").alias("site_id"), row.alias("row"), col.alias("col"), _elevation(row, col).alias("elevation"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, feature_id, x, y."""
    key = F.col("c_custkey")
    site = F.floor(key / 100).cast("bigint")
    x, y = X0 + 1000 * site + (key * 37) % 311 - 75, Y0 + (key * 53) % 317 - 75
    return read(spark, sf_dir, "customer").select(site.alias("site_id"), key.cast("bigint").alias("feature_id"), x.cast("double").alias("x"), y.cast("double").alias("y"))


def water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, feature_id, cx, cy, half, hole (half size of the hole; null: none): squares."""
    key = F.col("s_suppkey")
    site = F.floor(key / 7).cast("bigint")
    half = (5 + key % 20).cast("double")
    return (
        read(spark, sf_dir, "supplier")
        .where(key % 2 == 0)
        .select(
            site.alias("site_id"),
            key.cast("bigint").alias("feature_id"),
            (X0 + 1000 * site + (key * 29) % 160).cast("double").alias("cx"),
            (Y0 + (key * 41) % 160).cast("double").alias("cy"),
            half.alias("half"),
            F.when(key % 4 == 0, half / 2).alias("hole"),
        )
    )


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, feature_id, x1, y1, x2, y2."""
    key = F.col("s_suppkey")
    site = F.floor(key / 7).cast("bigint")
    x, y = (X0 + 1000 * site + (key * 29) % 160).cast("double"), (Y0 + (key * 41) % 160).cast("double")
    return (
        read(spark, sf_dir, "supplier")
        .where(key % 2 == 1)
        .select(site.alias("site_id"), key.cast("bigint").alias("feature_id"), x.alias("x1"), y.alias("y1"), (x + 60).alias("x2"), (y + key % 50).alias("y2"))
    )


def rainfall_daily(spark: SparkSession, sf_dir: str, sites: int) -> DataFrame:
    """site_id, date, mm."""
    day = F.add_months(F.to_date("ts"), (F.col("user_id") % 12).cast("int"))
    return read(spark, sf_dir, "events").groupBy((F.col("user_id") % sites).cast("bigint").alias("site_id"), day.alias("date")).agg(F.round(F.sum("value"), 2).alias("mm"))


def tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """osm_id, other_tags."""
    named = F.concat(F.lit('"building"=>"yes","name"=>"'), F.col("c_name"), F.lit('"'))
    text = F.when(F.col("c_custkey") % 2 == 0, named).otherwise(F.lit('"highway"=>"residential"'))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("osm_id"), text.alias("other_tags"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, latitude, longitude, radius_km."""
    key = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(key.cast("bigint").alias("request_id"), (-60.0 + 5 * key).alias("latitude"), (-170.0 + 14 * key).alias("longitude"), (1.0 + key % 10).alias("radius_km"))


def site_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with all measurements, from customers: site_id, candidate_id and the columns that scores need; some are null."""
    k = F.col("c_custkey")
    some = lambda value, gap: F.when(k % gap != 0, value.cast("double"))
    return read(spark, sf_dir, "customer").select(
        F.floor(k / 100).cast("bigint").alias("site_id"),
        k.cast("bigint").alias("candidate_id"),
        ((k * 7) % 400 / 10.0).cast("double").alias("slope_degrees"),
        ((k * 7919) % 4_000_000).cast("double").alias("catchment_area_m2"),
        some((k * 37) % 3100, 11).alias("rainfall_mm"),
        some((k * 13) % 700, 7).alias("water_distance_m"),
        some((k * 17) % 600, 9).alias("road_distance_m"),
        some((k * 23) % 650, 8).alias("building_distance_m"),
        some((k * 331) % 600_000, 6).alias("runoff_m3"),
        some((k * 151) % 300_000, 5).alias("storage_m3"),
        some((k * 977) % 150_000, 4).alias("flow_accumulation_cells"),
        some((k % 101) / 100.0, 10).alias("dem_score"),
        some((k % 97) / 96.0, 12).alias("hydrology_score"),
        F.when(k % 3 == 0, "feasible").when(k % 3 == 1, "unknown").otherwise(F.when(k % 2 == 0, "feasible").otherwise("rejected")).alias("feasibility"),
        F.when(k % 50 != 0, 21.0 + (k % 300) / 1000.0).alias("latitude"),
        F.when(k % 70 == 0, 200.0).otherwise(81.0 + (k % 500) / 1000.0).alias("longitude"),
        (k % 3).cast("int").alias("n_water"),
        (k % 5).cast("int").alias("n_roads"),
        (k % 7).cast("int").alias("n_buildings"),
    )


def probe_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid cells as points: site_id, id, x, y."""
    cells = dem_cells(spark, sf_dir).where("elevation is not null")
    return cells.select("site_id", (F.col("row") * 32 + F.col("col")).cast("bigint").alias("id"), (X0 + 1000 * F.col("site_id") + 5.0 * F.col("col")).alias("x"), (Y0 + 5.0 * F.col("row")).alias("y"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of buildings, roads and water squares."""
    from terrainflow.operators.spatial import line_features, point_features, ring_features, square_rings

    w = water(spark, sf_dir).withColumn("rings", square_rings(F.col("half"), F.col("cx"), F.col("cy"), F.col("hole")))
    return point_features(buildings(spark, sf_dir), "building").unionByName(line_features(roads(spark, sf_dir), "road")).unionByName(ring_features(w, "water"))


def contour_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, kml: one placemark for each row of a site, with the places of its valid cells as longitude and latitude."""
    cells = dem_cells(spark, sf_dir).where("elevation is not null")
    point = F.format_string("%.6f,%.6f,0", 81.0 + 0.01 * F.col("site_id") + 0.00005 * F.col("col"), 21.0 + 0.00005 * F.col("row"))
    lines = cells.groupBy("site_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", point.alias("p")))), lambda s: s.p), " ").alias("c"))
    mark = F.format_string("<Placemark><name>Contour %d m</name><LineString><coordinates>%s</coordinates></LineString></Placemark>", 100 + F.col("row"), F.col("c"))
    docs = lines.groupBy("site_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", mark.alias("m")))), lambda s: s.m), "\n").alias("body"))
    return docs.select("site_id", F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), "body", F.lit("</Document></kml>")).alias("kml"))
