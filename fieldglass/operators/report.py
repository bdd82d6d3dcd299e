"""Summaries of stored frame scores, reports with their sample size, and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import geometry as g
from fieldglass.operators.references import uuid_key

MIN_FRAMES, MIN_COVERAGE = 500, 0.6


def once(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key; of rows repeated with differing values the largest value counts. NaN counts as null."""
    clean = {v: F.when(~F.isnan(v), F.col(v)) for v, kind in df.select(*values).dtypes if kind in ("double", "float")}
    return df.withColumns(clean).groupBy(*keys).agg(*[F.max(v).alias(v) for v in values])


def player_summary(scores: DataFrame) -> DataFrame:
    """Per job and track of player_frame_score: frames, medians, rates and means. Null measures are passed over in their column only."""
    rows = once(scores, ["job_id", "track_id", "frame_index"], ["space_owned", "position_value", "offside_margin", "nearest_opponent", "lines_broken", "marking_pressure", "lane_open"])
    available = g.is_available(F.coalesce("lane_open", F.lit(False)), F.col("offside_margin"), F.col("marking_pressure"))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return rows.groupBy("job_id", "track_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.median("space_owned").alias("median_space_owned"),
        F.median("position_value").alias("median_position_value"),
        share(available).alias("availability_rate"),
        share(g.is_offside(F.col("offside_margin"))).alias("offside_rate"),
        F.median("offside_margin").alias("median_offside_margin"),
        F.avg("lines_broken").alias("mean_lines_broken"),
        F.median("nearest_opponent").alias("median_separation"),
        F.avg("marking_pressure").alias("mean_pressure"),
    )


def team_summary(frames: DataFrame) -> DataFrame:
    """Per job and attacking side of frame_score: frames, medians of space and hulls, mean passing options."""
    rows = once(frames.where(F.col("attacking_side").isNotNull()), ["job_id", "attacking_side", "frame_index"], ["team_space", "team_dangerous_space", "attacking_hull", "defending_hull", "available_options"])
    return rows.groupBy("job_id", "attacking_side").agg(
        F.count(F.lit(1)).alias("frames"),
        F.median("team_space").alias("median_controlled_space"),
        F.median("team_dangerous_space").alias("median_dangerous_space"),
        F.median("attacking_hull").alias("median_attacking_hull"),
        F.median("defending_hull").alias("median_defending_hull"),
        F.avg("available_options").alias("mean_passing_options"),
    )


def coverage(scored: Column, total: Column) -> Column:
    """Share of frames scored; 0 where there are none."""
    return F.when(total > 0, scored / total).otherwise(F.lit(0.0))


def player_report(summaries: DataFrame, jobs: DataFrame, identities: DataFrame, players: DataFrame) -> DataFrame:
    """Summaries with their run's coverage, the track's side and the player's name.

    Summaries without a job or an identity drop out; those whose player is null or unknown keep a null name. Keys of
    players are compared as uuids. is_reliable needs enough frames and coverage.
    """
    sides = identities.groupBy("job_id", "track_id").agg(F.min("team").alias("side"))
    runs = jobs.groupBy("job_id").agg(F.max("coverage").alias("coverage"), F.max("pipeline_version").alias("pipeline_version"))
    names = players.groupBy(uuid_key(F.col("player_id")).alias("_player")).agg(F.max("known_as").alias("player_name"))
    joined = summaries.join(runs, "job_id").join(sides, ["job_id", "track_id"]).withColumn("_player", uuid_key(F.col("player_id"))).join(names, "_player", "left")
    return joined.withColumn("is_reliable", (F.col("frames") >= MIN_FRAMES) & (F.col("coverage") >= MIN_COVERAGE)).drop("_player")


def reliable(players: DataFrame, min_frames: int = MIN_FRAMES) -> DataFrame:
    return players.where(F.col("frames") >= min_frames)


def rank_by(players: DataFrame, metric: str, *, ascending: bool = False, min_frames: int = MIN_FRAMES, limit: int | None = None) -> DataFrame:
    """Reliable players by a metric, ties in order of job and track; nulls last."""
    order = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    ranked = reliable(players, min_frames).orderBy(order, "job_id", "track_id")
    return ranked if limit is None else ranked.limit(limit)


def shoulder_runners(players: DataFrame, band: float = 2.0, min_frames: int = MIN_FRAMES) -> DataFrame:
    """Reliable players whose median margin is onside by at most band metres."""
    return reliable(players, min_frames).where(F.col("median_offside_margin").between(-band, 0)).orderBy(F.col("median_offside_margin").desc(), "job_id", "track_id")


def unreachable_players(players: DataFrame, max_availability: float = 0.3, min_frames: int = MIN_FRAMES) -> DataFrame:
    """Reliable players with at least the median space of such players, yet seldom available."""
    pool = reliable(players, min_frames)
    middle = pool.agg(F.median("median_space_owned")).first()[0]
    return pool.where((F.col("median_space_owned") >= F.lit(middle)) & (F.col("availability_rate") <= max_availability))


def run_quality(jobs: DataFrame, players: DataFrame, min_frames: int = MIN_FRAMES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Per job its confidence ('high' or 'low') and the reasons against it."""
    thin = players.groupBy("job_id").agg(F.count(F.lit(1)).alias("_players"), F.count_if(F.col("frames") < min_frames).alias("_thin"))
    joined = jobs.select("job_id", "frames_total", "coverage").join(thin, "job_id", "left").na.fill(0, ["_players", "_thin"])
    none = F.coalesce(F.col("frames_total"), F.lit(0)) == 0
    warnings = F.array_compact(F.array(
        F.when(none, "No frames were analysed.").when(F.col("coverage") < min_coverage, F.format_string("Only %d%% of frames could be scored.", F.round(F.col("coverage") * 100).cast("int"))),
        F.when(F.col("_thin") > 0, F.format_string("%d of %d players have fewer than %d scored frames.", "_thin", "_players", F.lit(min_frames))),
        F.when(F.col("_players") == 0, "No players were scored."),
    ))
    return joined.select("job_id", warnings.alias("warnings")).withColumn("confidence", F.when(F.size("warnings") == 0, "high").otherwise("low"))


def threat_efficiency(dangerous: Column, controlled: Column) -> Column:
    """Share of controlled space that is dangerous; 0 without any."""
    return F.when(controlled > 0, dangerous / controlled).otherwise(F.lit(0.0))
