"""Map features from tagged rows: tags, layers, kinds, geometry, clips, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrainflow.sources.quadtree import features_in_boxes

# Columns that override other tags, and land uses that are water.
TAG_COLUMNS = ("highway", "waterway", "water", "natural", "landuse", "building")
WATER_LANDUSE = ("reservoir", "basin")


def tags_col(text: Column) -> Column:
    """`"k"=>"v","k2"=>"v2"` -> map; the last of equal keys counts, text that is not of that form gives an empty map."""
    pairs = F.regexp_extract_all(text, F.lit(r'"([^"]*)"=>"([^"]*)"'), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r'"([^"]*)"=>"([^"]*)"'), F.lit(2))
    entries = F.coalesce(F.arrays_zip(pairs.alias("k"), values.alias("v")), F.array().cast("array<struct<k:string,v:string>>"))
    numbered = F.transform(entries, lambda e, i: F.struct(e.k.alias("key"), e.v.alias("value"), i.alias("i")))
    last = F.filter(numbered, lambda e: ~F.exists(numbered, lambda o: (o.key == e.key) & (o.i > e.i)))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e.key, e.value)))


def merged_tags(df: DataFrame, text: str = "other_tags") -> DataFrame:
    """Adds tags: those of the text, overridden by the columns of TAG_COLUMNS that are there and not null."""
    own = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))) for c in TAG_COLUMNS if c in df.columns]
    if not own:
        return df.withColumn("tags", tags_col(F.col(text)))
    columns = F.array_compact(F.array(*own))
    base = F.map_filter(tags_col(F.col(text)), lambda k, v: ~F.exists(columns, lambda e: e.key == k))
    return df.withColumn("tags", F.map_concat(base, F.map_from_entries(columns)))


def feature_layers(df: DataFrame) -> DataFrame:
    """One row per layer that a row belongs to: water_areas, waterways, roads, buildings; a row may be in several."""
    tag = lambda k: F.try_element_at(F.col("tags"), F.lit(k))
    water = (F.coalesce(tag("natural"), F.lit("")) == "water") | F.coalesce(tag("landuse"), F.lit("")).isin(*WATER_LANDUSE) | tag("water").isNotNull()
    layers = F.array_compact(F.array(F.when(water, "water_areas"), F.when(tag("waterway").isNotNull(), "waterways"), F.when(tag("highway").isNotNull(), "roads"), F.when(tag("building").isNotNull(), "buildings")))
    return df.withColumn("layer", F.explode(layers))


def feature_kind(tags: Column) -> Column:
    """water, road or building, the first that fits; null for none."""
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    water = (F.coalesce(tag("natural"), F.lit("")) == "water") | tag("water").isNotNull() | tag("waterway").isNotNull() | F.coalesce(tag("landuse"), F.lit("")).isin(*WATER_LANDUSE)
    return F.when(water, "water").when(tag("highway").isNotNull(), "road").when(tag("building").isNotNull(), "building")


def layer_kind(layer: Column) -> Column:
    return F.when(layer.isin("water_areas", "waterways"), "water").when(layer == "roads", "road").when(layer == "buildings", "building")


def features_in_bbox(features: DataFrame, boxes: DataFrame) -> DataFrame:
    """features (with west, south, east, north) that touch a box (request_id, west, south, east, north), through quadtree cells."""
    return features_in_boxes(features, boxes)


def clip_relations(nodes: DataFrame, way_nodes: DataFrame, members: DataFrame, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node ids, way ids, relation ids) of a clip: nodes (node_id, lon, lat) in the box (south, west, north, east), ways
    (way_id, node_id) with one of them, multipolygon relations (relation_id, relation_type, member_type, member_id) that
    touch those, then all their members, then all nodes of kept ways.
    """
    south, west, north, east = box
    inside = nodes.where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).select("node_id")
    ways = way_nodes.join(inside, "node_id", "left_semi").select("way_id").distinct()
    areas = members.where("relation_type = 'multipolygon'")
    touched = areas.where("member_type = 'way'").join(ways.withColumnRenamed("way_id", "member_id"), "member_id", "left_semi").select("relation_id")
    touched = touched.unionByName(areas.where("member_type = 'node'").join(inside.withColumnRenamed("node_id", "member_id"), "member_id", "left_semi").select("relation_id")).distinct()
    kept = areas.join(touched, "relation_id", "left_semi")
    ways = ways.unionByName(kept.where("member_type = 'way'").select(F.col("member_id").alias("way_id"))).distinct()
    all_nodes = inside.unionByName(way_nodes.join(ways, "way_id", "left_semi").select("node_id")).unionByName(kept.where("member_type = 'node'").select(F.col("member_id").alias("node_id"))).distinct()
    return all_nodes, ways, touched


def normalise(df: DataFrame) -> DataFrame:
    """rows (feature_id, geom_type, parts array<struct<outer array<point>, holes array<array<point>>>>) -> parts that can be used, one row each.

    Polygons need an outer ring of four points (holes likewise), lines two points; others are dropped.
    """
    each = df.select("*", F.posexplode("parts").alias("part", "g")).drop("parts")
    least = F.when(F.col("geom_type").isin("polygon", "multipolygon"), 4).when(F.col("geom_type").isin("line", "multiline"), 2)
    holes = F.filter(F.col("g.holes"), lambda h: F.size(h) >= 4)
    return each.where(F.size("g.outer") >= least).withColumns({"outer": F.col("g.outer"), "holes": F.coalesce(holes, F.array().cast("array<array<struct<x:double,y:double>>>"))}).drop("g")


def hole_count(column: str = "holes") -> Column:
    return F.coalesce(F.size(column), F.lit(0))


def layer_stats(df: DataFrame) -> DataFrame:
    """rows (layer, outer, holes, geometry_key, in_area) -> layer, candidates, skipped by reason, duplicates, kept, interior_rings."""
    from pyspark.sql import Window

    order = Window.partitionBy("layer", "geometry_key").orderBy("feature_id")
    empty, outside = F.coalesce(F.size("outer"), F.lit(0)) < 2, ~F.col("in_area")
    marked = df.withColumn("skip", F.when(empty, "empty").when(outside, "outside_study_area")).withColumn("copy", F.when(F.col("skip").isNull(), F.row_number().over(order) > 1))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    kept = F.col("skip").isNull() & ~F.coalesce(F.col("copy"), F.lit(False))
    return marked.groupBy("layer").agg(F.count("*").alias("candidates"), n(F.col("skip") == "empty").alias("skipped_empty"), n(F.col("skip") == "outside_study_area").alias("skipped_outside"), n(F.col("copy")).alias("duplicates"), n(kept).alias("features"), F.sum(F.when(kept, hole_count()).otherwise(0)).alias("interior_rings"))


def manifest(stats: DataFrame, area: tuple[float, float, float, float]) -> DataFrame:
    """One row of JSON: study area, counts by layer, totals."""
    south, west, north, east = area
    layers = F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", F.struct("candidates", "features", "duplicates", "interior_rings")))))
    box = F.struct(F.lit(south).alias("south"), F.lit(west).alias("west"), F.lit(north).alias("north"), F.lit(east).alias("east"))
    return stats.agg(layers.alias("layers"), F.sum("features").alias("total_features")).select(F.to_json(F.struct(box.alias("study_area"), "layers", "total_features")).alias("manifest"))


def explode_parts(df: DataFrame) -> DataFrame:
    """Multipart rows -> one row a part with id, id#1, ...; tags that are not JSON become an empty map."""
    each = df.select("*", F.posexplode("parts").alias("part", "g")).drop("parts")
    name = F.when(F.col("part") == 0, F.col("feature_id").cast("string")).otherwise(F.concat_ws("#", F.col("feature_id").cast("string"), F.col("part").cast("string")))
    tags = F.coalesce(F.from_json("tags_json", "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return each.withColumns({"element_id": name, "tags": tags})


def geometry_cols(df: DataFrame) -> DataFrame:
    """Elements (kind, points array<point>, x, y) -> geom_type: closed rings of four points are polygons unless they are roads, two points a line, else a point."""
    n = F.size("points")
    closed = F.element_at("points", 1) == F.element_at("points", -1)
    kind = F.when((n >= 4) & closed & (F.col("kind") != "road"), "polygon").when(n >= 2, "line").when(F.col("x").isNotNull() & F.col("y").isNotNull(), "point")
    return df.withColumn("geom_type", kind)


def dataset_gate(requests: DataFrame, manifests: DataFrame, max_age_days: int, as_of: str) -> DataFrame:
    """requests (box) with dataset_status: missing, unreadable, stale, out_of_coverage or ok; only ok may give an empty success.

    manifests: at most one row (readable, built date, south, west, north, east).
    """
    from terrainflow.functions.geo import bbox_relation

    one = manifests.select(F.lit(1).alias("_k"), "readable", "built", *[F.col(c).alias(f"c_{c}") for c in ("south", "west", "north", "east")])
    joined = requests.withColumn("_k", F.lit(1)).join(F.broadcast(one.limit(1)), "_k", "left")
    side = lambda p: {c: F.col(p + c) for c in ("south", "west", "north", "east")}
    relation = bbox_relation(side(""), side("c_"))
    status = F.when(F.col("readable").isNull(), "missing").when(~F.col("readable"), "unreadable").when(F.datediff(F.lit(as_of).cast("date"), "built") > max_age_days, "stale").when(relation == "none", "out_of_coverage").otherwise("ok")
    return joined.withColumns({"dataset_status": status, "coverage": relation}).drop("_k", "readable", "built", "c_south", "c_west", "c_north", "c_east")
