"""Scoring, eligibility, confidence, explanation and ranking of sites."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrainflow.functions import scores as s
from terrainflow.operators.numbering import numbered

# Weights of the legacy score.
LEGACY_WEIGHTS = {"slope": 0.25, "catchment_area": 0.20, "rainfall": 0.20, "water_distance": 0.15, "road_distance": 0.10, "land_use": 0.10}


@dataclass(frozen=True)
class Limits:
    """Hard limits of the legacy filter; the engine uses those on slope, area and rain."""

    max_slope_degrees: float = 35.0
    min_catchment_area_m2: float = 0.0
    min_rainfall_mm: float = 0.0
    min_water_distance_m: float = 25.0
    min_road_distance_m: float = 25.0
    min_building_distance_m: float = 25.0


# Bounds (low, high, ideal low, ideal high), distance bounds and weights of the engine.
BOUNDS = {
    "slope": (0.0, 45.0, 2.0, 12.0),
    "catchment": (1_000.0, 10_000_000.0, 50_000.0, 2_000_000.0),
    "rainfall": (0.0, 3_000.0, 500.0, 2_000.0),
    "runoff": (0.0, 500_000.0, 5_000.0, 100_000.0),
    "storage": (0.0, 250_000.0, 2_500.0, 50_000.0),
}
DISTANCES = {"water": (0.0, 500.0), "road": (25.0, 500.0), "building": (25.0, 500.0)}
WEIGHTS = {"hydrology": 0.25, "terrain": 0.20, "geography": 0.15, "rainfall": 0.15, "runoff": 0.15, "storage": 0.10}
CONFIDENCE_WEIGHTS = {"dem_quality": 0.30, "hydrology_quality": 0.25, "geographic_availability": 0.20, "rainfall_availability": 0.15, "runoff_storage_availability": 0.10}
FULL_FLOW_CELLS = 100_000


@dataclass(frozen=True)
class EngineConfig:
    limits: Limits = Limits()
    bounds: dict = field(default_factory=lambda: dict(BOUNDS))
    distances: dict = field(default_factory=lambda: dict(DISTANCES))
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    confidence_weights: dict = field(default_factory=lambda: dict(CONFIDENCE_WEIGHTS))

    def __post_init__(self):
        for name, weights in (("weights", self.weights), ("confidence_weights", self.confidence_weights)):
            if any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
                raise ValueError(f"{name} must not be negative and must sum to more than 0")
        for name, (low, high, *_) in (self.bounds | self.distances).items():
            if low >= high:
                raise ValueError(f"{name}: the lower bound must be below the upper one")


# --- legacy ---------------------------------------------------------------------------------------


def legacy_scores(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds score_<component> and overall_score.

    Needs slope_degrees, catchment_area_m2, rainfall_mm, water_distance_m, road_distance_m, building_distance_m, n_water,
    n_roads, n_buildings. The weight of road_distance goes to the smaller of the road and building scores; weights of
    unknown names count as 0 in the sum.
    """
    active = LEGACY_WEIGHTS | (weights or {})
    total = sum(active.values())
    if total <= 0:
        raise ValueError("weights must sum to more than 0")
    df = df.withColumns(
        {
            "score_slope": s.slope_score(F.col("slope_degrees")),
            "score_catchment_area": s.catchment_score(F.col("catchment_area_m2")),
            "score_rainfall": s.rainfall_score(F.col("rainfall_mm")),
            "score_water_distance": s.water_distance_score(F.col("water_distance_m")),
            "score_road_distance": s.clearance_score(F.col("road_distance_m")),
            "score_building_distance": s.clearance_score(F.col("building_distance_m")),
            "score_land_use": s.land_use_score(F.col("n_water"), F.col("n_roads"), F.col("n_buildings")),
        }
    )
    df = df.withColumn("score_road_building_distance", F.least("score_road_distance", "score_building_distance"))
    overall = F.lit(0.0)
    for name, weight in active.items():
        column = "score_road_building_distance" if name == "road_distance" else f"score_{name}"
        if column in df.columns:
            overall = overall + weight / total * F.col(column)
    return df.withColumn("overall_score", s.clamp(overall))


def reject_unsuitable(df: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Rows within all limits; unknown rain and distances pass, unknown slope and area count as 0."""
    known = lambda name, least: F.col(name).isNull() | (F.col(name) >= least)
    return df.where(
        (F.coalesce("slope_degrees", F.lit(0.0)) <= limits.max_slope_degrees)
        & (F.coalesce("catchment_area_m2", F.lit(0.0)) >= limits.min_catchment_area_m2)
        & known("rainfall_mm", limits.min_rainfall_mm)
        & known("water_distance_m", limits.min_water_distance_m)
        & known("road_distance_m", limits.min_road_distance_m)
        & known("building_distance_m", limits.min_building_distance_m)
    )


def suitability_class(score: Column) -> Column:
    return F.when(score >= 0.7, "highly_suitable").when(score >= 0.4, "moderately_suitable").otherwise("marginal")


def rank_legacy(df: DataFrame, limits: Limits = Limits(), weights: dict[str, float] | None = None, site: str = "site_id", sequence: str = "candidate_id") -> DataFrame:  # noqa: B008
    """Filter, score and rank: overall score falling, input order on ties. Adds confidence, recommendation, rank."""
    scored = legacy_scores(reject_unsuitable(df, limits), weights)
    scored = scored.withColumns({"confidence": s.clamp(0.55 + 0.45 * F.col("overall_score")), "recommendation": suitability_class(F.col("overall_score"))})
    return numbered(scored, "rank", [F.desc("overall_score"), sequence], site).withColumn("rank", F.col("rank").cast("int"))


# --- engine ---------------------------------------------------------------------------------------


def features(df: DataFrame) -> DataFrame:
    """Numbers made safe: slope and area default to 0, the others to null; feasibility to unknown."""
    optional = ["rainfall_mm", "runoff_m3", "storage_m3", "water_distance_m", "road_distance_m", "building_distance_m", "dem_score", "hydrology_score", "flow_accumulation_cells", "latitude", "longitude"]
    out = {c: s.safe(F.col(c)) for c in optional if c in df.columns} | {c: F.lit(None).cast("double") for c in optional if c not in df.columns}
    out |= {c: s.safe(F.col(c), 0.0) for c in ("slope_degrees", "catchment_area_m2")}
    out |= {"feasibility": F.coalesce("feasibility", F.lit("unknown"))} if "feasibility" in df.columns else {"feasibility": F.lit("unknown")}
    for c in ("feasibility_reason", "dem_status", "hydrology_status"):
        if c not in df.columns:
            out[c] = F.lit(None).cast("string")
    return df.withColumns(out)


def eligibility(df: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008
    """Adds ineligible_reason (null: eligible): the first rule broken. Unknown external data never rejects."""
    lat, lon, limits = F.col("latitude"), F.col("longitude"), config.limits
    reason = (
        F.when(lat.isNull() | lon.isNull(), "missing_coordinates")
        .when(~lat.between(-90, 90) | ~lon.between(-180, 180), "invalid_coordinates")
        .when(F.col("slope_degrees") > limits.max_slope_degrees, "slope_exceeds_limit")
        .when(F.col("catchment_area_m2") < limits.min_catchment_area_m2, "catchment_too_small")
        .when(F.col("rainfall_mm") < limits.min_rainfall_mm, "insufficient_rainfall")
        .when(F.col("feasibility") == "rejected", F.coalesce("feasibility_reason", F.lit("geographic_rejection")))
        .when(F.col("dem_status") == "invalid", "dem_invalid")
        .when(F.col("hydrology_status") == "invalid", "hydrology_invalid")
    )
    return df.withColumn("ineligible_reason", reason)


def component_scores(df: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008
    """Adds hydrology, terrain, geography, rainfall, runoff and storage, with the penalty for runoff and storage both over 0.7."""
    flow, b, d = F.col("flow_accumulation_cells"), config.bounds, config.distances
    own = lambda column, name, **k: s.bounded(F.col(column), *b[name], **k)
    runoff, storage = own("runoff_m3", "runoff"), own("storage_m3", "storage")
    both = (runoff > 0.7) & (storage > 0.7)
    lower = lambda x: F.when(both, x * 0.9).otherwise(x)
    near = [s.distance_score(F.col(f"{k}_distance_m"), *d[k]) for k in ("water", "road", "building")]
    return df.withColumns(
        {
            "hydrology": F.when(F.floor(flow) > 0, F.least(F.lit(1.0), F.floor(flow) / FULL_FLOW_CELLS)).otherwise(own("catchment_area_m2", "catchment")),
            "terrain": own("slope_degrees", "slope", invert=True),
            "geography": (near[0] + near[1] + near[2]) / 3,
            "rainfall": own("rainfall_mm", "rainfall"),
            "runoff": lower(runoff),
            "storage": lower(storage),
        }
    )


def overall_score(config: EngineConfig = EngineConfig()) -> Column:  # noqa: B008
    total = sum(config.weights.values())
    out = F.lit(0.0)
    for name, weight in config.weights.items():
        out = out + weight / total * F.col(name)
    return s.clamp(out)


def confidence(config: EngineConfig = EngineConfig()) -> Column:  # noqa: B008
    parts = {
        # least and greatest skip nulls, so a missing quality must be told from a bad one before it is clamped
        "dem_quality": F.when(F.col("dem_score").isNull(), 0.5).otherwise(s.clamp(F.col("dem_score"))),
        "hydrology_quality": F.when(F.col("hydrology_score").isNull(), 0.5).otherwise(s.clamp(F.col("hydrology_score"))),
        "geographic_availability": F.when(F.col("feasibility") == "feasible", 1.0).when(F.col("feasibility") == "rejected", 0.0).otherwise(0.5),
        "rainfall_availability": F.when(F.col("rainfall_mm").isNull(), 0.3).otherwise(1.0),
        "runoff_storage_availability": F.when(F.col("runoff_m3").isNull(), 0.3).otherwise(1.0),
    }
    total = sum(config.confidence_weights.values())
    out = F.lit(0.0)
    for name, weight in config.confidence_weights.items():
        out = out + weight / total * parts[name]
    return s.clamp(out)


def explanations(df: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:  # noqa: B008
    """Adds strengths, concerns, missing_evidence (arrays of phrases), summary and recommendation."""
    say = lambda pattern, *columns: F.format_string(pattern, *[F.col(c) for c in columns])
    slope, road, building = F.col("slope_degrees"), F.col("road_distance_m"), F.col("building_distance_m")
    rain, runoff, storage = F.col("rainfall_mm"), F.col("runoff_m3"), F.col("storage_m3")
    ideal = config.bounds
    amount = lambda label, column, unit: F.concat(F.lit(label), F.format_number(column, 0), F.lit(unit))
    strengths = [
        F.when(F.col("hydrology") >= 0.7, "strong upstream drainage").when(F.col("hydrology") >= 0.4, "adequate upstream drainage"),
        F.when(slope <= ideal["slope"][3], say("favourable slope (%.1f degrees)", "slope_degrees")),
        F.when(F.col("feasibility") == "feasible", "clear of roads, buildings and water"),
        F.when(road >= config.distances["road"][1], say("well away from roads (%.0f m)", "road_distance_m")),
        F.when(building >= config.distances["building"][1], say("well away from buildings (%.0f m)", "building_distance_m")),
        F.when(rain >= ideal["rainfall"][2], say("good seasonal rain (%.0f mm a year)", "rainfall_mm")),
        F.when(runoff >= ideal["runoff"][2], amount("estimated annual runoff ", runoff, " m3")),
        F.when(storage >= ideal["storage"][2], amount("indicative storage ", storage, " m3")),
    ]
    concerns = [
        F.when(F.col("hydrology") < 0.4, "little upstream drainage"),
        F.when(slope > config.limits.max_slope_degrees, say("steep slope (%.1f degrees)", "slope_degrees")).when(slope > ideal["slope"][3], say("moderate slope (%.1f degrees)", "slope_degrees")),
        F.when(F.col("feasibility") == "rejected", "rejected by its surroundings"),
        F.when(road < config.distances["road"][0], say("close to a road (%.0f m)", "road_distance_m")),
        F.when(building < config.distances["building"][0], say("close to buildings (%.0f m)", "building_distance_m")),
        F.when(rain < ideal["rainfall"][2], say("moderate or low rain (%.0f mm a year)", "rainfall_mm")),
        F.when(runoff < ideal["runoff"][2], amount("low runoff ", runoff, " m3 a year")),
        F.when(storage < ideal["storage"][2], amount("limited storage ", storage, " m3")),
        F.when(F.col("dem_score") < 0.6, "elevation quality below the preferred level"),
        F.when(F.col("hydrology_score") < 0.6, "hydrology quality below the preferred level"),
    ]
    missing = [F.when(F.col("feasibility") == "unknown", "surroundings unknown"), F.when(rain.isNull(), "rainfall unknown"), F.when(runoff.isNull(), "runoff unknown"), F.when(storage.isNull(), "storage unknown")]
    some = lambda parts, default: F.when(F.size(F.array_compact(F.array(*parts))) > 0, F.array_compact(F.array(*parts))).otherwise(F.array(F.lit(default)))
    names = ["overall_score", "confidence", *config.weights]
    summary = F.concat_ws("; ", *[F.format_string(f"{n}=%.3f" if n in names[:2] else f"{n}=%.2f", F.col(n)) for n in names])
    return df.withColumns(
        {
            "strengths": some(strengths, "basic terrain conditions were found"),
            "concerns": some(concerns, "no major constraint was found"),
            "missing_evidence": F.array_compact(F.array(*missing)),
            "summary": summary,
            "recommendation": suitability_class(F.col("overall_score")),
        }
    )


def run_engine(df: DataFrame, config: EngineConfig = EngineConfig(), site: str = "site_id", key: str = "candidate_id") -> DataFrame:  # noqa: B008
    """Eligible candidates with scores, confidence, explanation and rank within their site."""
    ready = eligibility(features(df), config).where("ineligible_reason is null")
    scored = component_scores(ready, config)
    scored = scored.withColumn("overall_score", F.round(overall_score(config), 4)).withColumn("confidence", confidence(config))
    ranked = numbered(scored, "rank", [F.desc("overall_score"), F.desc("confidence"), "latitude", "longitude", key], site)
    return explanations(ranked.withColumn("rank", F.col("rank").cast("int")), config)


def explainability(df: DataFrame) -> DataFrame:
    """Adds phrases for the components slope, catchment, flow_accumulation, rainfall, land, road, building, water that are columns."""
    levels = {"slope": (0.6, 0.3), "catchment": (0.6, 0.3), "flow_accumulation": (0.6, 0.3), "rainfall": (0.6, 0.3), "land": (0.7, 0.4), "road": (0.7, 0.4), "building": (0.7, 0.4), "water": (0.7, 0.4)}
    present = [n for n in levels if n in df.columns]
    phrase = lambda n: F.when(F.col(n) >= levels[n][0], f"{n}: good").when(F.col(n) >= levels[n][1], f"{n}: moderate").when(F.col(n).isNotNull(), f"{n}: poor")
    return df.withColumn("phrases", F.array_compact(F.array(*[phrase(n) for n in present])))
