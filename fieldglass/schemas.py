"""Schemas of tracking tables and the rules their rows must meet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
VELOCITY = T.StructType([T.StructField("vx", T.DoubleType()), T.StructField("vy", T.DoubleType())])
BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")])

DETECTIONS = T.StructType(
    [T.StructField("match_id", T.StringType()), T.StructField("frame_index", T.IntegerType()), T.StructField("ord", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())]
    + list(BBOX.fields)
)
KEYPOINTS = T.StructType(
    [T.StructField("match_id", T.StringType()), T.StructField("frame_index", T.IntegerType()), T.StructField("ord", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("img_x", "img_y", "pitch_x", "pitch_y")]
)
OBSERVATIONS = T.StructType(
    [T.StructField("match_id", T.StringType()), T.StructField("frame_index", T.IntegerType()), T.StructField("ord", T.IntegerType()), T.StructField("track_id", T.IntegerType()), T.StructField("team", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("x", "y", "vx", "vy")]
)
FRAMES = T.StructType(
    [T.StructField("match_id", T.StringType()), T.StructField("frame_index", T.IntegerType()), T.StructField("timestamp", T.DoubleType()), T.StructField("ball_x", T.DoubleType()), T.StructField("ball_y", T.DoubleType()), T.StructField("attacking_team", T.StringType())]
)


@dataclass(frozen=True)
class Rule:
    """A condition each row must meet; a null outcome meets it, as in a SQL check constraint."""

    name: str
    holds: Column


def player_summary_rules() -> list[Rule]:
    """Ranges of player_match_summary."""
    share = lambda c: F.col(c).between(0, 1)
    return [
        Rule("frames_positive", F.col("frames") > 0),
        Rule("duration_not_negative", F.col("duration_seconds") >= 0),
        Rule("space_not_negative", F.col("median_space_owned") >= 0),
        Rule("value_is_share", share("median_position_value")),
        Rule("availability_is_share", share("availability_rate")),
        Rule("offside_rate_is_share", share("offside_rate")),
        Rule("lines_not_negative", F.col("mean_lines_broken") >= 0),
        Rule("separation_not_negative", F.col("median_separation") >= 0),
        Rule("pressure_is_share", share("mean_pressure")),
    ]


def table_rules() -> dict[str, list[Rule]]:
    """Ranges that the rows of the stored tables keep, by table name."""
    not_negative = lambda *names: [Rule(f"{c}_not_negative", F.col(c) >= 0) for c in names]
    share = lambda *names: [Rule(f"{c}_is_share", F.col(c).between(0, 1)) for c in names]
    filled = lambda c: Rule(f"{c}_not_blank", F.length(F.trim(c)) > 0)
    failed = F.lower(F.trim("status")) == "failed"
    return {
        "analysis_job": [Rule("fps_positive", F.col("fps") > 0), Rule("stride_positive", F.col("stride") >= 1), *share("progress", "coverage"), *not_negative("frames_total", "frames_scored"),
                         Rule("scored_within_total", F.col("frames_scored") <= F.col("frames_total")), Rule("failure_explained", ~failed | F.col("error").isNotNull())],
        "match_info": [Rule("length_permitted", F.col("pitch_length").between(90, 120)), Rule("width_permitted", F.col("pitch_width").between(45, 90)), Rule("clubs_differ", ~F.col("home_club_id").eqNullSafe(F.col("away_club_id")))],
        "player": [filled("full_name"), Rule("foot_known", F.col("primary_foot").isin("left", "right", "both"))],
        "frame_score": [*not_negative("frame_index", "team_space", "team_dangerous_space", "attacking_hull", "defending_hull", "available_options"), Rule("side_known", F.col("attacking_side").isin("home", "away"))],
        "player_frame_score": [*not_negative("space_owned", "lines_broken", "nearest_opponent"), *share("marking_pressure", "position_value")],
        "player_match_summary": player_summary_rules(),
    }


def violations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows (rule, n_rows, n_violations), one per rule, in a single pass over df."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(~r.holds).alias(r.name) for r in rules])
    return counts.select("_n", F.expr("stack({}, {}) as (rule, n_violations)".format(len(rules), ", ".join(f"'{r.name}', {r.name}" for r in rules)))).select(
        "rule", F.col("_n").alias("n_rows"), "n_violations"
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that more than one row has, with their number of rows."""
    return df.groupBy(*keys).count().where(F.col("count") > 1).withColumnRenamed("count", "n_rows")


def validate_run(*, fps: float, stride: int = 1, length: float = 105.0, width: float = 68.0) -> None:
    """Raise where the parameters of a run are out of range."""
    for name, value, low, high in (("fps", fps, 0.0, 120.0), ("stride", stride, 1, 25), ("length", length, 90.0, 120.0), ("width", width, 45.0, 90.0)):
        if not low <= value <= high or (name == "fps" and value <= 0):
            raise ValueError(f"{name} {value} is not within {low} to {high}")
