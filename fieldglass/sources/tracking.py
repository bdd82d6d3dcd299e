"""Tracking tables derived from the events table, so that every engine can derive the same.

Event e of match floor(e / 2400) is object e mod 24 of frame floor((e mod 2400) / 24): 0 is the ball, 1-11 the home
side, 12-22 the away side, 23 the referee. Places follow a fixed formula with a little jitter from the user id. The
expressions are SQL text that Spark and the checking engine both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.sources.tables import table


def _number(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


_O = "CAST(event_id % 24 AS INTEGER)"
_F = "CAST(floor((event_id % 2400) / 24) AS INTEGER)"
_JX = f"(CAST((user_id * 7919 + event_id * 31) % 201 - 100 AS DOUBLE) / {_number(500)})"
_JY = f"(CAST((user_id * 104729 + event_id * 17) % 201 - 100 AS DOUBLE) / {_number(500)})"

OBJECTS = {
    "match_no": "CAST(floor(event_id / 2400) AS BIGINT)",
    "frame_index": _F,
    "ord": _O,
    "x": f"""CASE WHEN {_O} = 0 THEN {_number(51.3)} + {_number(0.1)} * {_F} + {_number(2.4)} * abs({_F} % 40 - 20) / {_number(20)}
 WHEN {_O} <= 11 THEN {_number(30)} + (7 * {_O}) % 35 + {_number(0.1)} * {_F} WHEN {_O} = 17 THEN {_number(54)} + {_number(0.1)} * {_F}
 WHEN {_O} <= 22 THEN {_number(60)} + (5 * {_O}) % 38 - {_number(0.08)} * {_F} ELSE {_number(50)} END + {_JX}""",
    "y": f"""CASE WHEN {_O} = 0 THEN {_number(37)} + CASE WHEN {_F} >= 90 THEN {_number(6)} ELSE {_number(0)} END WHEN {_O} = 17 THEN {_number(37)}
 WHEN {_O} <= 22 THEN {_number(4)} + (11 * {_O}) % 60 ELSE {_number(10)} END + {_JY}""",
    "seen": f"NOT ({_O} = 0 AND event_type = 'error')",
    "confidence": f"least(value / {_number(500)}, {_number(1)})",
}

OBJECTS_SQL = "objects AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in OBJECTS.items()) + " FROM events)"


def objects_from_events(spark: SparkSession, base: str) -> DataFrame:
    """match_no, frame_index, ord, x, y, seen, confidence of ball, players and referee."""
    return table(spark, base, "events").select(*[F.expr(v).alias(k) for k, v in OBJECTS.items()])


def tracking_from_events(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(observations, frames): players with team and track id; one row per frame with the ball, null where it is not seen."""
    objects = objects_from_events(spark, base)
    players = objects.where(F.col("ord").between(1, 22)).select(
        "match_no", "frame_index", "ord", (F.when(F.col("ord") <= 11, 100).otherwise(200) + F.col("ord")).alias("track_id"), F.when(F.col("ord") <= 11, "home").otherwise("away").alias("team"), "x", "y"
    )
    ball = (F.col("ord") == 0) & F.col("seen")
    frames = objects.groupBy("match_no", "frame_index").agg(F.max(F.when(ball, F.col("x"))).alias("ball_x"), F.max(F.when(ball, F.col("y"))).alias("ball_y"))
    return players, frames


def pitch_landmarks(length: float = 105.0, width: float = 68.0) -> list[tuple[str, float, float]]:
    """Named places on a pitch of that size: corners, halfway line, boxes, spots and goal posts, all from the laws' distances."""
    mid, far = width / 2, length
    out = [("centre", far / 2, mid), ("halfway_near", far / 2, 0.0), ("halfway_far", far / 2, width)]
    for side, at in (("left", lambda d: d), ("right", lambda d: far - d)):
        for name, y in (("near", 0.0), ("far", width)):
            out.append((f"{side}_corner_{name}", at(0.0), y))
        for box, depth, half in (("penalty", 16.5, 20.16), ("goal", 5.5, 9.16)):
            out += [(f"{side}_{box}_{n}", at(depth), mid + s * half) for n, s in (("near", -1), ("far", 1))]
            out += [(f"{side}_{box}_base_{n}", at(0.0), mid + s * half) for n, s in (("near", -1), ("far", 1))]
        out.append((f"{side}_spot", at(11.0), mid))
    return out


def marking_polylines(spark: SparkSession, length: float = 105.0, width: float = 68.0, samples: int = 64) -> DataFrame:
    """Rows (marking, i, x, y): painted lines and circles of a pitch as sampled polylines."""
    mid = width / 2
    segments = [("near_touch", 0.0, 0.0, length, 0.0), ("far_touch", 0.0, width, length, width), ("left_goal", 0.0, 0.0, 0.0, width), ("right_goal", length, 0.0, length, width), ("halfway", length / 2, 0.0, length / 2, width)]
    for side, at in (("left", lambda d: d), ("right", lambda d: length - d)):
        for box, depth, half in (("penalty", 16.5, 20.16), ("goal", 5.5, 9.16)):
            lo, hi = mid - half, mid + half
            segments += [(f"{side}_{box}_near", at(0.0), lo, at(depth), lo), (f"{side}_{box}_far", at(0.0), hi, at(depth), hi), (f"{side}_{box}_front", at(depth), lo, at(depth), hi)]
    lines = spark.createDataFrame(segments, "marking string, ax double, ay double, bx double, by double")
    i = F.explode(F.sequence(F.lit(0), F.lit(samples))).alias("i")
    w = F.col("i") / samples
    straight = lines.select("*", i).select("marking", "i", (F.col("ax") + w * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + w * (F.col("by") - F.col("ay"))).alias("y"))
    arcs = spark.createDataFrame([("circle", length / 2, None), ("left_arc", 11.0, 16.5), ("right_arc", length - 11.0, length - 16.5)], "marking string, cx double, front double")
    turn = 2 * F.pi() * w
    round_ = arcs.select("*", i).select("marking", "i", (F.col("cx") + 9.15 * F.cos(turn)).alias("x"), (F.lit(mid) + 9.15 * F.sin(turn)).alias("y"), "front", "cx")
    beyond = F.col("front").isNull() | (F.signum(F.col("x") - F.col("front")) == F.signum(F.col("front") - F.col("cx")))
    return straight.unionByName(round_.where(beyond).select("marking", "i", "x", "y"))
