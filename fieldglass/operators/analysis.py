"""The whole analysis of matches: from detections and keypoints to scores and summaries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import geometry as g
from fieldglass.operators.ball import BallConfig, best_path, repair
from fieldglass.operators.calibration import CalibrationConfig, calibrate, gate_calibrations
from fieldglass.operators.control import Grid, with_space
from fieldglass.operators.scenes import KEY, assemble, gated, supporting_players, with_carrier, with_offside_line, with_possession, with_velocity
from fieldglass.operators.stitching import StitchConfig, best_first_matching, candidate_links, chain_heads, relabel, track_extents
from fieldglass.operators.teams import running_votes
from fieldglass.operators.tracking import TrackerConfig, track_detections
from fieldglass.schemas import validate_run
from fieldglass.session import materialise

MATCH = "match_no"


@dataclass(frozen=True)
class AnalysisConfig:
    fps: float = 25.0
    grid: Grid = field(default_factory=Grid)
    tracker: TrackerConfig = field(default_factory=TrackerConfig)
    calibration: CalibrationConfig = field(default_factory=CalibrationConfig)
    stitch: StitchConfig = field(default_factory=StitchConfig)
    ball: BallConfig = field(default_factory=BallConfig)


@dataclass(frozen=True)
class Analysis:
    """Results by stage; counters has a row per match."""

    observations: DataFrame
    frames: DataFrame
    frame_scores: DataFrame
    player_scores: DataFrame
    counters: DataFrame


def place(boxes: DataFrame, cameras: DataFrame, grid: Grid) -> DataFrame:
    """x, y on the pitch of where each box stands, clamped to it; null in frames without a camera or on the horizon."""
    h = [F.get("h", F.lit(i)) for i in range(9)]
    x, y = g.project(h, *g.ground_point(F.col("x1"), F.col("x2"), F.col("y2")))
    inside = lambda v, high: F.when(v.isNotNull(), g.clamp(v, 0, high))
    return boxes.join(cameras, list(KEY), "left").withColumns({"x": inside(x, grid.length), "y": inside(y, grid.width)}).drop("h", "status")


def analyse(detections: DataFrame, keypoints: DataFrame, frames: DataFrame, votes: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> Analysis:
    """Tracks, cameras, places, sides, stitched ids, ball, possession and scores of all matches.

    detections: match_no, frame_index, ord, label ('ball' or else a player), confidence, box; keypoints: img and pitch
    places; frames: every match_no, frame_index; votes: match_no, frame_index, x1, y1, vote - the side that a box's kit
    was taken for. Velocities are of tracks before stitching, so a joined fragment starts at rest.
    """
    validate_run(fps=config.fps, length=config.grid.length, width=config.grid.width)
    spine = frames.select(*KEY).distinct()
    fits = spine.join(calibrate(keypoints, config=config.calibration), list(KEY), "left")
    cameras = materialise(gate_calibrations(fits, config=config.calibration), "cameras")
    tracked = place(track_detections(detections, spine, config.tracker), cameras, config.grid)
    ballots = votes.groupBy(*KEY, "x1", "y1").agg(F.max("vote").alias("vote"))
    sided = running_votes(tracked.join(ballots, [*KEY, "x1", "y1"], "left")).withColumn("ord", F.col("track_id"))
    moving = materialise(with_velocity(sided.select(*KEY, "ord", "track_id", "team", "x", "y"), fps=config.fps), "observations")

    spans = track_extents(moving)
    rates = spine.select(MATCH).distinct().withColumn("fps", F.lit(config.fps))
    heads = chain_heads(best_first_matching(candidate_links(spans, rates, config.stitch, MATCH), MATCH), MATCH)
    observations = relabel(moving, heads, MATCH)

    balls = place(detections.where(F.col("label") == "ball"), cameras, config.grid).where(F.col("x").isNotNull())
    path = best_path(balls.select(*KEY, "ord", "x", "y", F.coalesce("confidence", F.lit(0.0)).alias("confidence")), spine, fps=config.fps, config=config.ball)
    ball = repair(path, fps=config.fps, config=config.ball).withColumnsRenamed({"x": "ball_x", "y": "ball_y"})

    held = materialise(with_possession(assemble(observations, ball)), "frames")
    scored = materialise(with_space(with_carrier(with_offside_line(gated(held, length=config.grid.length, width=config.grid.width))), config.grid), "scores")
    players = supporting_players(scored)
    options = players.groupBy(*KEY).agg(F.count_if("is_available").alias("available_options"))
    plain = [c for c in scored.columns if c not in ("attackers", "defenders", "ownership")]
    seen = spine.join(cameras.select(*KEY, "status"), list(KEY), "left").join(held.select(*KEY, F.col("ball_x").isNotNull().alias("_ball"), F.col("attacking_team").isNotNull().alias("_held")), list(KEY), "left")
    seen = seen.join(scored.select(*KEY, F.lit(True).alias("_scored")), list(KEY), "left")
    ids = observations.groupBy(MATCH).agg(F.countDistinct("track_id").alias("tracks")).join(moving.groupBy(MATCH).agg(F.countDistinct("track_id").alias("fragments")), MATCH)
    counters = seen.groupBy(MATCH).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("status") == "fitted").alias("calibrated"), F.count_if(F.col("status") == "coasted").alias("coasted"), F.count_if("_ball").alias("with_ball"),
        F.count_if("_held").alias("with_possession"), F.count_if("_scored").alias("scored"),
    ).join(ids, MATCH, "left").withColumn("coverage", F.col("scored") / F.col("frames"))
    return Analysis(observations, held, scored.select(*plain).join(options, list(KEY), "left").na.fill(0, ["available_options"]), players, counters)
