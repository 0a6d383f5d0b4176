"""Results as KML, GeoJSON and JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Head and tail of a KML document.
KML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
KML_TAIL = "</Document></kml>"


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def usable(points: Column) -> Column:
    """Points (longitude, latitude) that are finite and in range."""
    ok = lambda v, most: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= most)
    return F.filter(points, lambda p: ok(p.longitude, 180) & ok(p.latitude, 90))


def closed(points: Column) -> Column:
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    return F.when((F.size(points) > 0) & (first != last), F.concat(points, F.array(first))).otherwise(points)


def significant(v: Column, digits: int = 12) -> Column:
    """Text of a number with so many significant digits, as C's %g writes it: no zeros at the end, an exponent below 1e-4."""
    powers = F.format_string(f"%.{digits - 1}e", v)
    exponent = F.substring_index(powers, "e", -1).cast("int")
    plain = F.printf(F.concat(F.lit("%."), F.greatest(digits - 1 - exponent, F.lit(0)).cast("string"), F.lit("f")), v)
    bare = lambda t: F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    short = F.concat(bare(F.substring_index(powers, "e", 1)), F.lit("e"), F.substring_index(powers, "e", -1))
    return F.when(exponent.between(-4, digits - 1), bare(plain)).otherwise(short)


def coordinate_text(points: Column) -> Column:
    number = significant
    return F.array_join(F.transform(points, lambda p: F.concat(number(p.longitude), F.lit(","), number(p.latitude), F.lit(",0"))), " ")


def point_placemark(name: Column, longitude: Column, latitude: Column) -> Column:
    points = usable(F.array(F.struct(longitude.alias("longitude"), latitude.alias("latitude"))))
    return F.when(F.size(points) == 1, F.concat(F.lit("<Placemark><name>"), xml_escape(name), F.lit("</name><Point><coordinates>"), coordinate_text(points), F.lit("</coordinates></Point></Placemark>")))


def line_placemark(name: Column, points: Column) -> Column:
    p = usable(points)
    return F.when(F.size(p) >= 2, F.concat(F.lit("<Placemark><name>"), xml_escape(name), F.lit("</name><LineString><tessellate>1</tessellate><coordinates>"), coordinate_text(p), F.lit("</coordinates></LineString></Placemark>")))


def polygon_placemark(name: Column, ring: Column) -> Column:
    """Null for rings of fewer than four points once closed."""
    p = closed(usable(ring))
    return F.when(F.size(p) >= 4, F.concat(F.lit("<Placemark><name>"), xml_escape(name), F.lit("</name><Polygon><outerBoundaryIs><LinearRing><coordinates>"), coordinate_text(p), F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>")))


def multipolygon_placemarks(name: Column, polygons: Column) -> Column:
    """Outer rings of polygons as placemarks, one text: numbered from 1 where there are several; null without a usable one."""
    many = F.size(polygons) > 1
    each = F.transform(polygons, lambda p, k: polygon_placemark(F.when(many, F.concat(name, F.lit(" "), (k + 1).cast("string"))).otherwise(name), F.element_at(p, 1)))
    text = F.array_join(F.filter(each, lambda t: t.isNotNull()), "")
    return F.when(F.length(text) > 0, text)


def kml_documents(placemarks: DataFrame) -> DataFrame:
    """placemarks (site_id, ord, placemark; null ones are left out) -> site_id, kml. A document has the rows of one site."""
    parts = placemarks.where("placemark is not null").groupBy("site_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "placemark"))), lambda p: p.placemark), "").alias("body"))
    return parts.select("site_id", F.concat(F.lit(KML_HEAD), "body", F.lit(KML_TAIL)).alias("kml"))


def geojson_col(rings: Column) -> Column:
    """rings array<array<struct<longitude, latitude>>> (outer first) -> GeoJSON Polygon."""
    coordinates = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p.longitude, p.latitude)))
    return F.when(rings.isNotNull(), F.to_json(F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))))


def geojson_polygons(polygons: Column) -> Column:
    """polygons (array of parts, each an array of rings, outer first) -> GeoJSON Polygon of one part, MultiPolygon of several; null without any."""
    points = lambda r: F.transform(r, lambda p: F.array(p.longitude, p.latitude))
    parts = F.transform(polygons, lambda rings: F.transform(rings, points))
    several = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates")))
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.try_element_at(parts, F.lit(1)).alias("coordinates")))
    return F.when(F.size(polygons) > 1, several).when(F.size(polygons) == 1, single)


def site_placemarks(sites: DataFrame, ranked: DataFrame, contours: DataFrame | None = None, catchments: DataFrame | None = None) -> DataFrame:
    """Placemarks of centre, bounds, catchment, recommended and alternative sites, and contours, in that order.

    sites: site_id, latitude, longitude, south, west, north, east. ranked: site_id, rank, latitude, longitude.
    catchments: site_id, polygons.
    """
    corner = lambda a, b: F.struct(F.col(a).cast("double").alias("longitude"), F.col(b).cast("double").alias("latitude"))
    centre = sites.select("site_id", F.lit(0).cast("bigint").alias("ord"), point_placemark(F.lit("Centre"), F.col("longitude"), F.col("latitude")).alias("placemark"))
    box = sites.select("site_id", F.lit(1).cast("bigint").alias("ord"), polygon_placemark(F.lit("Analysis Boundary"), F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"))).alias("placemark"))
    name = F.when(F.col("rank") == 1, "Recommended Site").otherwise(F.concat(F.lit("Alternative Candidate "), (F.col("rank") - 1).cast("string")))
    best = ranked.select("site_id", (F.col("rank") + 10).cast("bigint").alias("ord"), point_placemark(name, F.col("longitude"), F.col("latitude")).alias("placemark"))
    out = centre.unionByName(box).unionByName(best)
    if catchments is not None:
        out = out.unionByName(catchments.select("site_id", F.lit(2).cast("bigint").alias("ord"), multipolygon_placemarks(F.lit("Catchment Boundary"), F.col("polygons")).alias("placemark")))
    if contours is not None:
        order = F.row_number().over(Window.partitionBy("site_id").orderBy("contour_id")) + 1_000_000
        points = F.transform("coords", lambda p: F.struct(p.x.alias("longitude"), p.y.alias("latitude")))
        out = out.unionByName(contours.select("site_id", order.cast("bigint").alias("ord"), line_placemark(F.coalesce("name", F.lit("Contour")), points).alias("placemark")))
    return out


def report_json(df: DataFrame, by: str = "site_id") -> DataFrame:
    """One JSON text a row, of all other columns; NaN and infinities become null."""
    safe = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes if c != by]
    return df.select(by, F.to_json(F.struct(*safe)).alias("report"))
