"""Candidate sites from flow tables: peaks, plateaus, features, constraints, thinning, scores, ranks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrainflow.functions.scores import catchment_score, clamp, slope_score
from terrainflow.operators.independent import thin
from terrainflow.operators.iterate import cut_lineage
from terrainflow.operators.numbering import numbered

# Weights of the candidate score.
CANDIDATE_WEIGHTS = {"catchment_area": 0.35, "flow_accumulation": 0.25, "slope": 0.20, "hydrological_confidence": 0.10, "elevation": 0.10}


@dataclass(frozen=True)
class CandidateConfig:
    min_separation_m: float = 50.0
    min_drainage_area_cells: float = 2.0
    max_candidates: int = 25
    peak_neighbourhood: int = 3
    weights: dict = field(default_factory=lambda: dict(CANDIDATE_WEIGHTS))


def local_maxima(flow: DataFrame, n: int = 3, column: str = "accumulation") -> DataFrame:
    """Cells (site_id, row, col, accumulation) that equal the maximum of their n x n neighbourhood (n at least 3).

    An even n spans -n/2 to n/2 - 1. The maximum is separable: along the rows, then along the columns.
    """
    n = max(3, int(n))
    low, high = -(n // 2), n - 1 - n // 2
    along = Window.partitionBy("site_id", "row").orderBy("col").rangeBetween(low, high)
    across = Window.partitionBy("site_id", "col").orderBy("row").rangeBetween(low, high)
    top = flow.withColumn("_m", F.max(column).over(along)).withColumn("_m", F.max("_m").over(across))
    return top.where(F.col(column) >= F.col("_m")).drop("_m")


def plateau_peaks(peaks: DataFrame) -> DataFrame:
    """One cell of each 4-connected group of peaks: the highest accumulation, then the first in row-major order.

    Smallest labels spread along shared edges and labels jump to the label of their label, so a long plateau settles in
    few rounds. Only peak cells take part.
    """
    order = F.struct("row", "col")
    own = cut_lineage(peaks.select("site_id", "row", "col", "accumulation", order.alias("label")))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    while True:
        sent = own.withColumn("s", F.explode(steps)).select("site_id", (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"), "label")
        least = sent.groupBy("site_id", "row", "col").agg(F.min("label").alias("near"))
        spread = own.join(least.hint("merge"), ["site_id", "row", "col"], "left").withColumn("new", F.least("label", "near"))
        root = spread.select("site_id", F.struct("row", "col").alias("new"), F.col("new").alias("jump"))
        moved = cut_lineage(spread.join(root.hint("merge"), ["site_id", "new"]).select("site_id", "row", "col", "accumulation", F.col("jump").alias("label"), (F.col("jump") != F.col("label")).alias("moved")))
        own = moved.drop("moved")
        if moved.where("moved").limit(1).count() == 0:
            break
    best = own.groupBy("site_id", "label").agg(F.min_by(F.struct("row", "col", "accumulation"), F.struct((-F.col("accumulation")).alias("a"), F.col("row"), F.col("col"))).alias("c"))
    return best.select("site_id", "c.row", "c.col", "c.accumulation")


def candidate_seeds(flow: DataFrame, outlets: DataFrame, config: CandidateConfig = CandidateConfig()) -> DataFrame:  # noqa: B008
    """flow (site_id, row, col, accumulation) and outlets (site_id, row, col) -> site_id, row, col of plateau cells and outlets."""
    valid = flow.where(F.col("accumulation").isNotNull()).select("site_id", "row", "col", "accumulation")
    peaks = plateau_peaks(local_maxima(flow.select("site_id", "row", "col", "accumulation"), config.peak_neighbourhood).where("accumulation is not null"))
    ends = outlets.select("site_id", "row", "col").join(valid.select("site_id", "row", "col").hint("merge"), ["site_id", "row", "col"], "left_semi")
    return peaks.select("site_id", "row", "col").unionByName(ends).distinct()


def build_candidates(seeds: DataFrame, cells: DataFrame, outlets: DataFrame, meta: DataFrame) -> DataFrame:
    """Seeds with features of their cell.

    cells: site_id, row, col, cell, x, y, elevation, slope, accumulation, outlet (terminal cell). outlets (site_id,
    cell, kind): those detected; a terminal that is not among them counts as internal.
    """
    area = F.col("accumulation") * F.col("resolution_m") * F.col("resolution_m")
    kinds = outlets.select("site_id", F.col("cell").alias("outlet"), "kind")
    out = seeds.join(cells.hint("merge"), ["site_id", "row", "col"], "left").join(meta, "site_id").join(kinds.hint("merge"), ["site_id", "outlet"], "left")
    return out.select(
        "site_id",
        F.format_string("cand-%05d-%05d", "row", "col").alias("candidate_id"),
        "row",
        "col",
        "x",
        "y",
        F.col("elevation").alias("elevation_m"),
        F.col("slope").alias("slope_degrees"),
        F.col("accumulation").alias("flow_accumulation_cells"),
        area.alias("drainage_area_m2"),
        F.col("outlet").alias("outlet_id"),
        F.when(F.col("outlet").isNotNull(), F.coalesce("kind", F.lit("internal"))).alias("outlet_kind"),
        F.col("elevation").isNotNull().alias("valid"),
    )


def hard_constraints(candidates: DataFrame, bounds: DataFrame, config: CandidateConfig = CandidateConfig()) -> DataFrame:  # noqa: B008
    """Adds rejection_reason, the first rule broken (null: none). bounds: site_id, x_min, x_max, y_min, y_max, resolution_m, valid_cells."""
    c = candidates.join(bounds, "site_id")
    acc = F.col("flow_accumulation_cells")
    finite = lambda name: F.col(name).isNotNull() & ~F.isnan(name)
    reason = (
        F.when(~F.col("valid"), "nodata_cell")
        .when(F.col("elevation_m").isNull(), "invalid_elevation")
        .when(F.col("slope_degrees").isNull(), "invalid_slope")
        .when(acc.isNull() | (acc < 1), "invalid_accumulation")
        .when(F.col("outlet_id").isNull(), "unresolved_hydrology")
        .when(~(finite("x") & finite("y")), "invalid_coordinate")
        .when(~(F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max"))), "outside_analysis_region")
        .when(F.coalesce("drainage_area_m2", F.lit(0.0)) < config.min_drainage_area_cells * F.col("resolution_m") * F.col("resolution_m"), "insufficient_drainage_area")
        .when(acc > F.col("valid_cells") + 1e-9, "invalid_catchment")
    )
    return c.withColumn("rejection_reason", reason).drop("x_min", "x_max", "y_min", "y_max", "resolution_m", "valid_cells")


def separate(candidates: DataFrame, distance: float) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with rejection_reason and duplicate_of): strongest first by accumulation, then row, column."""
    if distance <= 0:
        return candidates, candidates.limit(0).withColumns({"rejection_reason": F.lit("candidate_too_close"), "duplicate_of": F.lit(None).cast("string")})
    points = candidates.select("site_id", F.col("candidate_id").alias("id"), F.struct((-F.coalesce("flow_accumulation_cells", F.lit(0.0))).alias("a"), F.col("row").alias("r"), F.col("col").alias("c")).alias("priority"), "x", "y")
    kept, dropped = thin(points, distance, strict=True)
    kept = candidates.join(kept.withColumnRenamed("id", "candidate_id").hint("merge"), ["site_id", "candidate_id"], "left_semi")
    dropped = dropped.select("site_id", F.col("id").alias("candidate_id"), F.col("because").alias("duplicate_of"))
    return kept, candidates.drop("rejection_reason").join(dropped.hint("merge"), ["site_id", "candidate_id"]).withColumn("rejection_reason", F.lit("candidate_too_close"))


def score_and_rank(candidates: DataFrame, stats: DataFrame, config: CandidateConfig = CandidateConfig()) -> DataFrame:  # noqa: B008
    """Adds components, candidate_score, explanation, candidate_rank. stats: site_id, max_accumulation, min_elevation, max_elevation."""
    c = candidates.join(stats, "site_id")
    acc, span = F.coalesce("flow_accumulation_cells", F.lit(0.0)), F.col("max_elevation") - F.col("min_elevation")
    parts = {
        "catchment_area": clamp(catchment_score(F.coalesce("drainage_area_m2", F.lit(0.0)))),
        "flow_accumulation": clamp(acc / F.greatest(F.col("max_accumulation"), F.lit(1.0))),
        "slope": clamp(slope_score(F.coalesce("slope_degrees", F.lit(0.0)))),
        "elevation": F.when(span > 0, clamp(1.0 - (F.coalesce("elevation_m", F.lit(0.0)) - F.col("min_elevation")) / span)).otherwise(1.0),
        "hydrological_confidence": F.when(F.col("outlet_kind") == "boundary", 1.0).otherwise(0.6),
    }
    total = sum(config.weights.values()) or 1.0
    score = F.lit(0.0)
    for name, part in parts.items():
        score = score + config.weights.get(name, 0.0) * part
    c = c.withColumns({f"score_{n}": F.round(p, 6) for n, p in parts.items()} | {"candidate_score": F.round(clamp(score / total), 6)})
    phrases = F.array(
        F.format_string("drains %s m2 over %s cells", F.format_number("drainage_area_m2", 0), F.format_number("flow_accumulation_cells", 0)),
        F.format_string("slope %.1f degrees (score %.2f)", "slope_degrees", "score_slope"),
        F.format_string("elevation %.1f m (score %.2f)", "elevation_m", "score_elevation"),
        F.concat(F.lit("drains to a "), F.coalesce("outlet_kind", F.lit("unknown")), F.lit(" outlet")),
    )
    ranked = numbered(c, "candidate_rank", [F.desc("candidate_score"), F.desc("flow_accumulation_cells"), "row", "col"])
    return ranked.withColumns({"explanation": phrases, "candidate_rank": F.col("candidate_rank").cast("int")}).drop("max_accumulation", "min_elevation", "max_elevation")


def generate_candidates(cells: DataFrame, outlets: DataFrame, meta: DataFrame, config: CandidateConfig = CandidateConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B008
    """(accepted, rejected, counts): cells as build_candidates needs them, all of a site."""
    seeds = candidate_seeds(cells, outlets, config)
    built = cut_lineage(build_candidates(seeds, cells, outlets, meta.select("site_id", "resolution_m")))
    valid = F.col("elevation").isNotNull()
    bounds = cells.groupBy("site_id").agg(
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.sum(valid.cast("int")).alias("valid_cells"),
        F.max(F.when(valid, F.col("accumulation"))).alias("max_accumulation"), F.min("elevation").alias("min_elevation"), F.max("elevation").alias("max_elevation"),
    )
    bounds = cut_lineage(bounds.join(meta.select("site_id", "resolution_m"), "site_id"))
    checked = hard_constraints(built, bounds.select("site_id", "x_min", "x_max", "y_min", "y_max", "resolution_m", "valid_cells"), config)
    kept, close = separate(checked.where("rejection_reason is null"), config.min_separation_m)
    ranked = score_and_rank(kept.drop("rejection_reason"), bounds.select("site_id", "max_accumulation", "min_elevation", "max_elevation"), config)
    accepted = ranked.where(F.col("candidate_rank") <= config.max_candidates)
    over = ranked.where(F.col("candidate_rank") > config.max_candidates).withColumn("rejection_reason", F.lit("candidate_limit_exceeded"))
    columns = [*built.columns, "rejection_reason"]
    rejected = checked.where("rejection_reason is not null").select(*columns).unionByName(close.select(*columns)).unionByName(over.select(*columns))
    return accepted, rejected, rejected.groupBy("site_id", "rejection_reason").agg(F.count("*").alias("n"))
