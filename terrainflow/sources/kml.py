"""Contours from KML and KMZ, rasters, rainfall and features from files."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"
# Tags that hold an elevation, and parts of names of data fields that do.
ELEVATION_TAGS = ("elevation", "elevation_m", "height", "altitude", "contour", "contourelevation")
ELEVATION_WORDS = ("elev", "height", "altitude", "contour")


def first_number(text: Column) -> Column:
    """The first number in a text; null where there is none."""
    return F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit("")).try_cast("double")


def coords_col(text: Column) -> Column:
    """Coordinate text -> array of (x, y): points are split at white space, parts at commas; unreadable points are left out."""
    parts = F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda t: F.split(t, ","))
    points = F.transform(F.filter(parts, lambda p: F.size(p) >= 2), lambda p: F.struct(_number(F.get(p, F.lit(0))).alias("x"), _number(F.get(p, F.lit(1))).alias("y")))
    return F.filter(points, lambda p: p.x.isNotNull() & p.y.isNotNull())


def _number(text: Column) -> Column:
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def _inner(block: Column, tag: str) -> Column:
    """Text of the first element of that name, with any prefix."""
    found = F.regexp_extract(block, rf"(?is)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}\s*>", 1)
    plain = F.regexp_replace(F.regexp_replace(found, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"<[^>]+>", " ")
    return F.nullif(F.trim(plain), F.lit(""))


def elevation_col(block: Column) -> Column:
    """Elevation of a placemark: its elevation tags, then data fields whose name speaks of one, then name, then description."""
    tags = "|".join(ELEVATION_TAGS)
    own = F.regexp_extract_all(block, F.lit(rf"(?is)<(?:\w+:)?(?:{tags})(?:\s[^>]*)?>([^<]*)<"), F.lit(1))
    words = "|".join(ELEVATION_WORDS)
    data = F.regexp_extract_all(block, F.lit(rf"""(?is)<(?:\w+:)?SimpleData\s[^>]*name\s*=\s*["'][^"']*(?:{words})[^"']*["'][^>]*>([^<]*)<"""), F.lit(1))
    numbers = F.filter(F.transform(F.concat(own, data), first_number), lambda n: n.isNotNull())
    return F.coalesce(F.get(numbers, F.lit(0)), first_number(_inner(block, "name")), first_number(_inner(block, "description")))


def parse_contours(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (site_id, kml) -> (contours: site_id, contour_id, elevation_m, name, coords; errors: site_id, error).

    Placemarks without an elevation or with fewer than two points are left out; a document that has none left is an error.
    """
    blocks = docs.select("site_id", F.posexplode(F.regexp_extract_all("kml", F.lit(r"(?is)<(?:\w+:)?Placemark(?:\s[^>]*)?>(.*?)</(?:\w+:)?Placemark\s*>"), F.lit(1))).alias("contour_id", "block"))
    parsed = blocks.select("site_id", "contour_id", elevation_col(F.col("block")).alias("elevation_m"), _inner(F.col("block"), "name").alias("name"), coords_col(_inner(F.col("block"), "coordinates")).alias("coords"))
    contours = parsed.where(F.col("elevation_m").isNotNull() & (F.size("coords") >= 2))
    errors = docs.select("site_id").distinct().join(contours.select("site_id").distinct(), "site_id", "left_anti").withColumn("error", F.lit("no contour with an elevation and two points"))
    return contours, errors


def _members(batches):
    """KML text of files: KMZ archives give doc.kml or else their first .kml."""
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            data, error = bytes(content), None
            try:
                if data[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(data)) as archive:
                        names = archive.namelist()
                        name = "doc.kml" if "doc.kml" in names else next((n for n in names if n.lower().endswith(".kml")), None)
                        if name is None:
                            raise ValueError("the archive holds no KML")
                        data = archive.read(name)
                text = data.decode("utf-8-sig")
                if "<" not in text:
                    raise ValueError("the file is not XML")
            except (ValueError, zipfile.BadZipFile) as e:
                text, error = None, str(e)[:200]
            rows.append((path, text, error))
        yield pd.DataFrame(rows, columns=["path", "kml", "error"])


def read_contours(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files (KML or KMZ) -> (contours, errors); the path is the site. A bad file is a row of errors, the job goes on."""
    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_members, "path string, kml string, error string")
    contours, empty = parse_contours(files.where("error is null").select(F.col("path").alias("site_id"), "kml"))
    return contours, files.where("error is not null").select(F.col("path").alias("site_id"), "error").unionByName(empty)


#: What is read of a placemark. Elements of other names are passed over; attributes have a leading underscore.
_LINES = "array<struct<coordinates: string>>"
_AREAS = "array<struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>>"
PLACEMARK = (
    ", ".join(f"{t} string" for t in (*ELEVATION_TAGS, "name", "description"))
    + ", ExtendedData struct<SchemaData: array<struct<SimpleData: array<struct<_VALUE: string, _name: string>>>>>"
    + f", LineString {_LINES}, LinearRing {_LINES}, Polygon {_AREAS}, MultiGeometry array<struct<LineString: {_LINES}, LinearRing: {_LINES}, Polygon: {_AREAS}>>, _broken string"
)


def read_placemarks(spark: SparkSession, path: str, site: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """KML files by Spark's XML reader -> (contours, errors) as `parse_contours` gives them; the site is the path, or a column of `site`.

    One row for each Placemark at any depth of folders, with any prefix; CDATA and entities are text. A document that is not
    well-formed is a row of errors and gives no contours, also if some of its placemarks could be read; one without a placemark
    gives no row at all. Elevation: the elements of ELEVATION_TAGS, then SimpleData whose name speaks of one, then name, then
    description. Coordinates: the first line, then ring, then outer boundary. A file is read by one task; files are many.
    """
    reader = spark.read.format("xml").option("rowTag", "Placemark").option("ignoreNamespace", "true").option("columnNameOfCorruptRecord", "_broken")
    marks = reader.schema(PLACEMARK).load(path)
    site = F.col("_metadata.file_path") if site is None else site
    marks = marks.select("*", site.alias("_site"), F.monotonically_increasing_id().alias("_at"))
    words = "|".join(ELEVATION_WORDS)
    fields = F.flatten(F.transform(F.coalesce("ExtendedData.SchemaData", F.array()), lambda d: F.coalesce(d.SimpleData, F.array())))
    data = F.transform(F.filter(fields, lambda d: F.lower(d._name).rlike(words)), lambda d: d._VALUE)
    numbers = F.filter(F.transform(F.concat(F.array(*ELEVATION_TAGS), data), first_number), lambda n: n.isNotNull())
    elevation = F.coalesce(F.get(numbers, F.lit(0)), first_number(F.col("name")), first_number(F.col("description")))
    first = lambda lines: F.get(lines, F.lit(0)).coordinates
    outer = lambda areas: F.get(areas, F.lit(0)).outerBoundaryIs.LinearRing.coordinates
    texts = [first(F.col("LineString")), first(F.col("LinearRing")), outer(F.col("Polygon"))]
    inner = [F.transform("MultiGeometry", lambda m: first(m.LineString)), F.transform("MultiGeometry", lambda m: first(m.LinearRing)), F.transform("MultiGeometry", lambda m: outer(m.Polygon))]
    texts += [F.get(F.array_compact(parts), F.lit(0)) for parts in inner]
    of_file = Window.partitionBy("site_id")
    each = marks.select(F.col("_site").alias("site_id"), "_at", elevation.alias("elevation_m"), F.nullif(F.trim("name"), F.lit("")).alias("name"), coords_col(F.coalesce(*texts)).alias("coords"), F.col("_broken").isNotNull().alias("_bad"))
    each = each.withColumns({"_bad": F.max("_bad").over(of_file), "contour_id": (F.col("_at") - F.min("_at").over(of_file)).cast("int")})
    good = F.col("elevation_m").isNotNull() & (F.size("coords") >= 2)
    contours = each.where(~F.col("_bad") & good).select("site_id", "contour_id", "elevation_m", "name", "coords")
    failed = each.groupBy("site_id").agg(F.max("_bad").alias("bad"), F.max(F.coalesce(good, F.lit(False))).alias("any"))
    error = F.when(F.col("bad"), "the document is not well-formed").when(~F.col("any"), "no contour with an elevation and two points")
    return contours, failed.select("site_id", error.alias("error")).where("error is not null")


def raster_cells(rows: DataFrame, a: float, c: float, e: float, f: float, nodata: float | None = None) -> tuple[DataFrame, DataFrame]:
    """rows (site_id, row, elevations array) -> (cells with x = a * col + c and y = e * row + f, summary with error for all-invalid rasters)."""
    from terrainflow.operators.stencil import clean_elevation

    cells = rows.select("site_id", "row", F.posexplode("elevations").alias("col", "elevation"))
    cells = clean_elevation(cells, nodata=nodata).withColumns({"x": a * F.col("col") + c, "y": e * F.col("row") + f})
    summary = cells.groupBy("site_id").agg(F.min("elevation").alias("min_m"), F.max("elevation").alias("max_m"), F.avg("elevation").alias("mean_m"), (F.count("elevation") / F.count("*")).alias("valid_fraction"))
    return cells, summary.withColumn("error", F.when(F.col("valid_fraction") == 0, "every cell is without data"))


def read_rainfall(payloads: DataFrame) -> DataFrame:
    """payloads (location_id, daily struct<time array<string>, precipitation_sum array<double>>) -> location_id, date, mm; null days are 0, unequal lengths give nothing."""
    both = payloads.where(F.size("daily.time") == F.size("daily.precipitation_sum"))
    each = both.select("location_id", F.explode(F.arrays_zip(F.col("daily.time").alias("date"), F.col("daily.precipitation_sum").alias("mm"))).alias("d"))
    return each.select("location_id", "d.date", F.coalesce("d.mm", F.lit(0.0)).alias("mm"))
