"""Queries on sequences and on what comes before scoring: ball, boxes, tracks, calibration, teams; and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from fieldglass.functions import geometry as g
from fieldglass.operators import ball as bl
from fieldglass.operators import calibration as cal
from fieldglass.operators import lines as ln
from fieldglass.operators import teams as tm
from fieldglass.operators.analysis import Analysis, analyse
from fieldglass.operators.scenes import with_velocity
from fieldglass.operators.stitching import track_extents
from fieldglass.operators.tracking import track_detections
from fieldglass.plans.scoring import SCENES, rounded, scenes
from fieldglass.sources.tables import table
from fieldglass.sources.tracking import OBJECTS_SQL, objects_from_events, tracking_from_events

SHORT = bl.BallConfig(max_gap=3, max_extrapolate=2)
#: Pitch to image of the camera that the derived keypoints are seen through.
CAMERA = [9.5, 2.1, 180.0, -0.4, 6.2, 90.0, -0.0012, 0.0041, 1.0]


def _ball(spark: SparkSession, base: str) -> DataFrame:
    _, frames = tracking_from_events(spark, base)
    return frames.withColumnsRenamed({"ball_x": "x", "ball_y": "y"})


def ball_interpolated(spark: SparkSession, base: str) -> DataFrame:
    return rounded(bl.interpolate(_ball(spark, base), config=SHORT), "x", "y")


def ball_smoothed(spark: SparkSession, base: str) -> DataFrame:
    return rounded(bl.smooth(_ball(spark, base)), "x", "y")


def ball_accepted(spark: SparkSession, base: str) -> DataFrame:
    return rounded(bl.reject_outliers(_ball(spark, base)), "x", "y")


def ball_repaired(spark: SparkSession, base: str) -> DataFrame:
    return rounded(bl.repair(_ball(spark, base), config=SHORT), "x", "y")


def _candidates(spark: SparkSession, base: str) -> DataFrame:
    objects = objects_from_events(spark, base)
    return objects.where(F.col("ord").isin(0, 11, 23) & F.col("seen")).select("match_no", "frame_index", "ord", "x", "y", "confidence")


def ball_best_candidate(spark: SparkSession, base: str) -> DataFrame:
    return bl.best_candidate(_candidates(spark, base))


def ball_path(spark: SparkSession, base: str) -> DataFrame:
    return bl.best_path(_candidates(spark, base), _ball(spark, base))


def run_counters(spark: SparkSession, base: str) -> DataFrame:
    """Per match: frames, frames with a seen ball and with a repaired one, frames with possession."""
    seen = _ball(spark, base).select("match_no", "frame_index", F.col("x").isNotNull().alias("seen"))
    fixed = bl.repair(_ball(spark, base), config=SHORT).select("match_no", "frame_index", F.col("x").isNotNull().alias("known"))
    held = scenes(spark, base).select("match_no", "frame_index", F.col("attacking_team").isNotNull().alias("held"))
    rows = seen.join(fixed, ["match_no", "frame_index"]).join(held, ["match_no", "frame_index"])
    return rows.groupBy("match_no").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if("seen").alias("ball_seen"), F.count_if(F.col("known") & ~F.col("seen")).alias("ball_recovered"), F.count_if(F.col("seen") & ~F.col("known")).alias("ball_rejected"), F.count_if("held").alias("with_possession")
    )


def track_spans(spark: SparkSession, base: str) -> DataFrame:
    players, _ = tracking_from_events(spark, base)
    return rounded(track_extents(with_velocity(players)), "first_x", "first_y", "last_x", "last_y", "last_vx", "last_vy")


def team_votes(spark: SparkSession, base: str) -> DataFrame:
    players, _ = tracking_from_events(spark, base)
    noisy = F.when((F.col("frame_index") * 7 + F.col("ord") * 3) % 5 == 0, g.opponent(F.col("team"))).when((F.col("frame_index") + F.col("ord")) % 11 != 0, F.col("team"))
    return tm.running_votes(players.withColumn("vote", noisy).drop("team")).select("match_no", "frame_index", "track_id", "team")


def goalkeepers(spark: SparkSession, base: str) -> DataFrame:
    """Tracks whose mean place is at either end of the pitch, per job, with the side that their span names.

    The pitch is that of the job's match, 105 m where that is unknown. Places beyond 0 to 120 m, the longest permitted pitch, do not count.
    """
    sides = table(spark, base, "track_span").groupBy("job_id", "track_id").agg(F.min("team").alias("team"))
    places = table(spark, base, "player_frame_score").where(F.col("pitch_x").between(0, 120)).select("job_id", "track_id", F.col("pitch_x").alias("x"))
    key = lambda c: F.regexp_replace(F.lower(F.trim(c)), "-", "")
    pitches = table(spark, base, "match_info").groupBy(key("match_id").alias("k")).agg(F.max("pitch_length").cast("double").alias("length"))
    jobs = table(spark, base, "analysis_job").groupBy("job_id").agg(F.max(key("match_id")).alias("k"))
    lengths = jobs.join(pitches, "k").select("job_id", "length")
    placed = places.join(sides, ["job_id", "track_id"]).join(lengths, "job_id", "left").withColumn("length", F.coalesce("length", F.lit(105.0)))
    return tm.goalkeepers(placed, length="length", match="job_id").withColumn("mean_x", F.round("mean_x", 10))


_BOX = ("x1", "y1", "x2", "y2")


def _boxes(spark: SparkSession, base: str) -> DataFrame:
    """Image boxes around the objects, ten pixels a metre."""
    x, y = F.col("x") * 10, F.col("y") * 10
    boxes = {"x1": x - 10, "y1": y - 40, "x2": x + 10, "y2": y + 10}
    return objects_from_events(spark, base).where("seen").withColumns(boxes).withColumn("label", F.when(F.col("ord") == 0, "ball").otherwise("player")).drop("x", "y", "seen")


def box_overlaps(spark: SparkSession, base: str) -> DataFrame:
    """Overlap of every object's box with its box in the frame before, and the point it stands on."""
    line = Window.partitionBy("match_no", "ord").orderBy("frame_index")
    boxes = _boxes(spark, base)
    now, before = [F.col(c) for c in _BOX], [F.lag(c).over(line) for c in _BOX]
    foot = g.ground_point(F.col("x1"), F.col("x2"), F.col("y2"))
    out = boxes.select("match_no", "frame_index", "ord", g.box_iou(now, before).alias("iou"), g.box_area(*now).alias("area"), foot[0].alias("foot_x"), foot[1].alias("foot_y"))
    return rounded(out, "iou", "area", "foot_x", "foot_y")


def projected_places(spark: SparkSession, base: str) -> DataFrame:
    """Places seen through the camera and put back on the pitch by its inverse."""
    camera = [g.lit(v) for v in CAMERA]
    seen = g.project(camera, F.col("x"), F.col("y"))
    image = objects_from_events(spark, base).select("match_no", "frame_index", "ord", seen[0].alias("img_x"), seen[1].alias("img_y"))
    back = g.project(g.matrix_inverse(camera), F.col("img_x"), F.col("img_y"))
    return rounded(image.withColumns({"x": back[0], "y": back[1]}), "img_x", "img_y", "x", "y")


def tracked_detections(spark: SparkSession, base: str) -> DataFrame:
    """Tracks built from the boxes alone."""
    _, frames = tracking_from_events(spark, base)
    boxes = _boxes(spark, base).withColumn("confidence", F.greatest("confidence", F.lit(0.5)))
    return track_detections(boxes, frames)


def _keypoints(spark: SparkSession, base: str) -> DataFrame:
    """Objects as point pairs; every ninth image point is wrong."""
    camera = [g.lit(v) for v in CAMERA]
    seen = g.project(camera, F.col("x"), F.col("y"))
    wrong = F.when((F.col("ord") + F.col("frame_index")) % 9 == 0, 60.0).otherwise(0.0)
    return objects_from_events(spark, base).where("seen").select("match_no", "frame_index", "ord", (seen[0] + wrong).alias("img_x"), (seen[1] - wrong).alias("img_y"), F.col("x").alias("pitch_x"), F.col("y").alias("pitch_y"))


def calibrations(spark: SparkSession, base: str) -> DataFrame:
    """Fitted cameras and their error against the true one."""
    truth = np.linalg.inv(np.array(CAMERA).reshape(3, 3)).ravel().tolist()
    fits = cal.with_truth_error(cal.calibrate(_keypoints(spark, base)).withColumn("truth", F.array(*[g.lit(v) for v in truth])), "h", "truth")
    return rounded(fits.select("match_no", "frame_index", "inliers", "total_keypoints", "error", "truth_error"), "error", "truth_error")


def calibration_quality(spark: SparkSession, base: str) -> DataFrame:
    return cal.tail_summary(calibrations(spark, base), ["match_no"], "truth_error")


def gated_calibrations(spark: SparkSession, base: str) -> DataFrame:
    _, frames = tracking_from_events(spark, base)
    fits = frames.select("match_no", "frame_index").join(cal.calibrate(_keypoints(spark, base)), ["match_no", "frame_index"], "left")
    return cal.gate_calibrations(fits).groupBy("match_no", "status").agg(F.count(F.lit(1)).alias("frames"))


def distance_tails(spark: SparkSession, base: str) -> DataFrame:
    """Median, p90 and worst predicted distance of the compared tracks of each job."""
    return rounded(cal.tail_summary(table(spark, base, "track_pair"), ["job_id"], "predicted_distance"), "median", "p90", "worst")


def track_lines(spark: SparkSession, base: str) -> DataFrame:
    """The straight line nearest to each track."""
    players, _ = tracking_from_events(spark, base)
    return rounded(cal.fitted_lines(players, ["match_no", "track_id"]), "a", "b", "c")


def calibration_rates(spark: SparkSession, base: str) -> DataFrame:
    """Share of each match's frames that could be calibrated."""
    _, frames = tracking_from_events(spark, base)
    fits = frames.select("match_no", "frame_index").join(cal.calibrate(_keypoints(spark, base)), ["match_no", "frame_index"], "left")
    return fits.groupBy("match_no").agg(F.avg(F.col("h").isNotNull().cast("double")).alias("rate"), F.avg("inliers").alias("mean_inliers"))


def _line_table(spark: SparkSession, base: str) -> DataFrame:
    players, _ = tracking_from_events(spark, base)
    lines = cal.fitted_lines(players, ["match_no", "track_id"])
    rho, theta = g.line_normal_form(F.col("c"), F.atan2("b", "a"))
    return lines.select("match_no", "track_id", rho.alias("rho"), theta.alias("theta"), (1000.0 - F.col("track_id")).alias("strength"))


def merged_track_lines(spark: SparkSession, base: str) -> DataFrame:
    """Track lines without near repeats, in two families of direction."""
    kept = ln.merge_lines(_line_table(spark, base), ["match_no"], least_gap=2.0, extent=40.0)
    return rounded(ln.line_families(kept, ["match_no"]), "rho", "theta")


def strongest_track_lines(spark: SparkSession, base: str) -> DataFrame:
    """The five strongest track lines of each match."""
    return rounded(ln.strongest_lines(_line_table(spark, base), ["match_no"], 5).select("match_no", "track_id", "rho", "theta"), "rho", "theta")


def side_ellipses(spark: SparkSession, base: str) -> DataFrame:
    """Centre and half axes of the ellipse nearest to a side's players, where it is one."""
    players, _ = tracking_from_events(spark, base)
    conics = ln.fitted_conics(players, ["match_no", "frame_index", "team"])
    shape = g.ellipse_of([F.get("conic", F.lit(i)) for i in range(6)])
    return rounded(conics.select("match_no", "frame_index", "team", *[shape[c].alias(c) for c in ("cx", "cy", "major", "minor")]).where(F.col("cx").isNotNull()), "cx", "cy", "major", "minor")


def _analysis(spark: SparkSession, base: str) -> Analysis:
    """The whole analysis, from boxes and keypoints seen through the camera."""
    camera = [g.lit(v) for v in CAMERA]
    seen = g.project(camera, F.col("x"), F.col("y"))
    objects = objects_from_events(spark, base).where("seen").withColumns({"u": seen[0], "v": seen[1]})
    box = {"x1": F.col("u") - 20, "y1": F.col("v") - 90, "x2": F.col("u") + 20, "y2": F.col("v")}
    boxes = objects.where(F.col("ord") != 23).withColumns(box).withColumn("label", F.when(F.col("ord") == 0, "ball").otherwise("player"))
    boxes = boxes.withColumn("confidence", F.greatest("confidence", F.lit(0.5)))
    votes = boxes.where(F.col("ord") > 0).select("match_no", "frame_index", "x1", "y1", F.when(F.col("ord") <= 11, "home").otherwise("away").alias("vote"))
    _, frames = tracking_from_events(spark, base)
    detections = boxes.select("match_no", "frame_index", "ord", "label", "confidence", "x1", "y1", "x2", "y2")
    return analyse(detections, _keypoints(spark, base), frames, votes)


def full_analysis(spark: SparkSession, base: str) -> DataFrame:
    """Counters of the whole analysis of every match."""
    return rounded(_analysis(spark, base).counters, "coverage")


QUERIES = {
    f.__name__: f
    for f in (full_analysis, calibration_rates, merged_track_lines, strongest_track_lines, side_ellipses, ball_interpolated, ball_smoothed, ball_accepted, ball_repaired, ball_best_candidate, ball_path, run_counters, track_spans, team_votes, goalkeepers, box_overlaps, projected_places,
              tracked_detections, calibrations, calibration_quality, gated_calibrations, distance_tails, track_lines)
}

_D = "CAST({} AS DOUBLE)".format
_BALL = f"""WITH RECURSIVE {OBJECTS_SQL},
track AS (SELECT match_no, frame_index, max(CASE WHEN ord = 0 AND seen THEN x END) AS x, max(CASE WHEN ord = 0 AND seen THEN y END) AS y FROM objects GROUP BY ALL)"""


def _between(source: str, gap: int, hold: int) -> str:
    cases = "CASE WHEN {0} IS NOT NULL THEN {0} WHEN p.f IS NOT NULL AND n.f IS NOT NULL THEN CASE WHEN n.f - p.f - 1 <= {1} THEN p.{0} + (n.{0} - p.{0}) * (CAST(frame_index - p.f AS DOUBLE) / (n.f - p.f)) END WHEN n.f - frame_index <= {2} THEN n.{0} WHEN frame_index - p.f <= {2} THEN p.{0} END"
    return f"""(SELECT match_no, frame_index, {cases.format("x", gap, hold)} AS x, {cases.format("y", gap, hold)} AS y FROM (
  SELECT *, last_value(CASE WHEN x IS NOT NULL THEN {{'f': frame_index, 'x': x, 'y': y}} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
    first_value(CASE WHEN x IS NOT NULL THEN {{'f': frame_index, 'x': x, 'y': y}} END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n
  FROM {source} WINDOW w AS (PARTITION BY match_no ORDER BY frame_index)))"""


def _averaged(source: str) -> str:
    return f"""(SELECT match_no, frame_index, CASE WHEN x IS NOT NULL THEN avg(x) OVER w END AS x, CASE WHEN x IS NOT NULL THEN avg(y) OVER w END AS y FROM (
  SELECT *, frame_index - row_number() OVER (PARTITION BY match_no, x IS NULL ORDER BY frame_index) AS run FROM {source})
  WINDOW w AS (PARTITION BY match_no, x IS NULL, run ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


_ACCEPTED = """,
known AS (SELECT *, row_number() OVER (PARTITION BY match_no ORDER BY frame_index) AS k FROM track WHERE x IS NOT NULL),
fold AS (
  SELECT match_no, frame_index, x, y, k, frame_index AS af, x AS ax, y AS ay, true AS ok FROM known WHERE k = 1
  UNION ALL
  SELECT n.match_no, n.frame_index, n.x, n.y, n.k, CASE WHEN good THEN n.frame_index ELSE af END, CASE WHEN good THEN n.x ELSE ax END, CASE WHEN good THEN n.y ELSE ay END, good
  FROM (SELECT n.*, af, ax, ay, sqrt((n.x - ax) ** 2 + (n.y - ay) ** 2) / ((n.frame_index - af) * CAST(0.04 AS DOUBLE)) <= 45 AS good FROM fold f JOIN known n ON n.match_no = f.match_no AND n.k = f.k + 1) n),
accepted AS (SELECT t.match_no, t.frame_index, f.x, f.y FROM track t LEFT JOIN fold f ON t.match_no = f.match_no AND t.frame_index = f.frame_index AND f.ok)"""
_XY = " SELECT match_no, frame_index, round(x, 6) AS x, round(y, 6) AS y FROM "
_FIXED = _averaged(_between("accepted", 3, 2))
_BOXES = f"WITH {OBJECTS_SQL}, boxes AS (SELECT match_no, frame_index, ord, x * 10 - 10 AS x1, y * 10 - 40 AS y1, x * 10 + 10 AS x2, y * 10 + 10 AS y2 FROM objects WHERE seen)"
_H = "({0} * {3} + {1} * {4} + {2})".format
_SEEN = f"SELECT match_no, frame_index, ord, x, y, {_H(_D(9.5), _D(2.1), 180, 'x', 'y')} / {_H(_D(-0.0012), _D(0.0041), 1, 'x', 'y')} AS ix, {_H(_D(-0.4), _D(6.2), 90, 'x', 'y')} / {_H(_D(-0.0012), _D(0.0041), 1, 'x', 'y')} AS iy FROM objects"

# The keypoints are made so that the outcome is known: every pair that is not shifted is an inlier, and the camera is recovered.
_FITS = f"""WITH {OBJECTS_SQL}, fits AS (SELECT match_no, frame_index, CAST(count(*) FILTER ((ord + frame_index) % 9 <> 0) AS INTEGER) AS inliers, CAST(count(*) AS INTEGER) AS total_keypoints FROM objects WHERE seen GROUP BY ALL)"""
_PATH = f"""WITH RECURSIVE {OBJECTS_SQL},
spine AS (SELECT match_no, frame_index, dense_rank() OVER (PARTITION BY match_no ORDER BY frame_index) AS k FROM (SELECT DISTINCT match_no, frame_index FROM objects)),
options AS (
  SELECT s.match_no, s.frame_index, s.k, row_number() OVER (PARTITION BY s.match_no, s.k ORDER BY ord) AS j, x, y, 1 - confidence AS emit FROM spine s JOIN objects o ON s.match_no = o.match_no AND s.frame_index = o.frame_index WHERE ord IN (0, 11, 23) AND seen
  UNION ALL SELECT match_no, frame_index, k, 99, NULL, NULL, {_D(1.2)} FROM spine),
walk AS (
  SELECT match_no, k, j, x, y, emit AS cost, [{{'f': frame_index, 'x': x, 'y': y}}] AS path FROM options WHERE k = 1
  UNION ALL
  SELECT match_no, k, j, x, y, best.total + emit, list_append(best.path, {{'f': frame_index, 'x': x, 'y': y}}) FROM (
    SELECT o.match_no, o.frame_index, o.k, o.j, o.x, o.y, o.emit, min({{'total': w.cost + CASE WHEN o.x IS NULL OR w.x IS NULL THEN 0 ELSE {_D(0.05)} * sqrt((o.x - w.x) ** 2 + (o.y - w.y) ** 2) END, 'j': w.j, 'path': w.path}}) AS best
    FROM walk w JOIN options o ON o.match_no = w.match_no AND o.k = w.k + 1
    WHERE o.x IS NULL OR w.x IS NULL OR sqrt((o.x - w.x) ** 2 + (o.y - w.y) ** 2) / {_D(0.04)} <= 45 GROUP BY ALL)),
ends AS (SELECT match_no, arg_min(path, {{'cost': cost, 'j': j}}) AS path FROM walk w WHERE k = (SELECT max(k) FROM spine s WHERE s.match_no = w.match_no) GROUP BY match_no)"""

ORACLES = {
    "ball_path": _PATH + " SELECT match_no, s.f AS frame_index, s.x AS x, s.y AS y FROM (SELECT match_no, unnest(path) AS s FROM ends)",
    "calibrations": _FITS + " SELECT match_no, frame_index, inliers, total_keypoints, CAST(0 AS DOUBLE) AS error, CAST(0 AS DOUBLE) AS truth_error FROM fits",
    "calibration_rates": _FITS + " SELECT match_no, CAST(1 AS DOUBLE) AS rate, avg(inliers) AS mean_inliers FROM fits GROUP BY ALL",
    "calibration_quality": _FITS + " SELECT match_no, count(*) AS n, CAST(0 AS DOUBLE) AS median, CAST(0 AS DOUBLE) AS p90, CAST(0 AS DOUBLE) AS worst FROM fits GROUP BY ALL",
    "gated_calibrations": _FITS + " SELECT match_no, 'fitted' AS status, count(*) AS frames FROM fits GROUP BY ALL",
    "ball_interpolated": _BALL + _XY + _between("track", 3, 2),
    "ball_smoothed": _BALL + _XY + _averaged("track"),
    "ball_accepted": _BALL + _ACCEPTED + _XY + "accepted",
    "ball_repaired": _BALL + _ACCEPTED + _XY + _FIXED,
    "ball_best_candidate": f"WITH {OBJECTS_SQL} SELECT match_no, frame_index, x, y, confidence FROM (SELECT *, row_number() OVER (PARTITION BY match_no, frame_index ORDER BY confidence DESC, ord) AS rn FROM objects WHERE ord IN (0, 11, 23) AND seen) WHERE rn = 1",
    "run_counters": SCENES.replace("WITH ", "WITH RECURSIVE ", 1) + ", track AS (SELECT match_no, frame_index, bx AS x, byy AS y FROM frames)" + _ACCEPTED + f""", fixed AS {_FIXED}
SELECT t.match_no, count(*) AS frames, count(t.x) AS ball_seen, count(*) FILTER (t.x IS NULL AND f.x IS NOT NULL) AS ball_recovered, count(*) FILTER (t.x IS NOT NULL AND f.x IS NULL) AS ball_rejected, count(h.team) AS with_possession
FROM track t JOIN fixed f USING (match_no, frame_index) JOIN held h USING (match_no, frame_index) GROUP BY ALL""",
    "track_spans": SCENES + " SELECT match_no, track_id, min(frame_index) AS first_frame, max(frame_index) AS last_frame, " + ", ".join(f"round(arg_{f}({c}, frame_index), 6) AS {a}" for f, c, a in (("min", "x", "first_x"), ("min", "y", "first_y"), ("max", "x", "last_x"), ("max", "y", "last_y"), ("max", "vx", "last_vx"), ("max", "vy", "last_vy"))) + ", any_value(team) AS team, count(*) AS observations FROM moving GROUP BY ALL",
    "team_votes": SCENES + """, votes AS (SELECT *, CASE WHEN (frame_index * 7 + ord * 3) % 5 = 0 THEN CASE team WHEN 'home' THEN 'away' ELSE 'home' END WHEN (frame_index + ord) % 11 <> 0 THEN team END AS vote FROM moving)
SELECT match_no, frame_index, track_id, CASE WHEN count(vote) OVER w < 5 THEN 'unknown' WHEN count(*) FILTER (vote = 'home') OVER w > count(*) FILTER (vote = 'away') OVER w THEN 'home'
  WHEN count(*) FILTER (vote = 'home') OVER w < count(*) FILTER (vote = 'away') OVER w THEN 'away' ELSE first_value(vote IGNORE NULLS) OVER w END AS team
FROM votes WINDOW w AS (PARTITION BY match_no, track_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "goalkeepers": f"""WITH sides AS (SELECT job_id, track_id, min(team) AS team FROM track_span GROUP BY ALL), pitches AS (SELECT replace(lower(trim(match_id)), '-', '') AS k, CAST(max(pitch_length) AS DOUBLE) AS length FROM match_info GROUP BY ALL),
jobs AS (SELECT job_id, max(replace(lower(trim(match_id)), '-', '')) AS k FROM analysis_job GROUP BY ALL), lengths AS (SELECT job_id, length FROM jobs JOIN pitches USING (k)), m AS (SELECT p.job_id, p.track_id, s.team, avg(pitch_x) AS mean_x FROM player_frame_score p JOIN sides s ON p.job_id = s.job_id AND p.track_id = s.track_id WHERE pitch_x BETWEEN 0 AND 120 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY mean_x, track_id) AS lo, row_number() OVER (PARTITION BY job_id ORDER BY mean_x DESC, track_id DESC) AS hi, count(*) OVER (PARTITION BY job_id) AS n FROM m)
SELECT job_id, track_id, team, round(mean_x, 10) AS mean_x FROM r LEFT JOIN lengths USING (job_id) WHERE n >= 2 AND ((lo = 1 AND mean_x < coalesce(length, 105) * {_D(0.12)}) OR (hi = 1 AND mean_x > coalesce(length, 105) * {_D(0.88)}))""",
    "box_overlaps": _BOXES + """, pairs AS (SELECT *, lag(x1) OVER w AS a1, lag(y1) OVER w AS b1, lag(x2) OVER w AS a2, lag(y2) OVER w AS b2 FROM boxes WINDOW w AS (PARTITION BY match_no, ord ORDER BY frame_index)),
i AS (SELECT *, greatest(least(x2, a2) - greatest(x1, a1), 0) * greatest(least(y2, b2) - greatest(y1, b1), 0) AS inter FROM pairs)
SELECT match_no, frame_index, ord, round(CASE WHEN a1 IS NULL THEN 0 ELSE inter / ((x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - inter) END, 6) AS iou, round((x2 - x1) * (y2 - y1), 6) AS area, round((x1 + x2) / 2, 6) AS foot_x, round(y2, 6) AS foot_y FROM i""",
    "projected_places": f"WITH {OBJECTS_SQL}, seen_at AS ({_SEEN}) SELECT match_no, frame_index, ord, round(ix, 6) AS img_x, round(iy, 6) AS img_y, round(x, 6) AS x, round(y, 6) AS y FROM seen_at",
    "distance_tails": """SELECT job_id, n, round(median, 6) AS median, round(v[1 + least(n - 1, CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT))], 6) AS p90, round(v[n], 6) AS worst FROM (
  SELECT job_id, count(*) AS n, median(predicted_distance) AS median, list_sort(list(predicted_distance)) AS v FROM track_pair WHERE predicted_distance IS NOT NULL AND NOT isnan(predicted_distance) GROUP BY ALL)""",
    "strongest_track_lines": SCENES + """, t AS (SELECT match_no, track_id, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS th FROM moving GROUP BY ALL HAVING count(*) >= 2),
l AS (SELECT match_no, track_id, atan2(cos(th), -sin(th)) AS theta, -sin(th) * mx + cos(th) * my AS rho FROM t),
n AS (SELECT match_no, track_id, CASE WHEN CAST(floor(theta / pi()) AS BIGINT) % 2 <> 0 THEN -rho ELSE rho END AS rho, theta - floor(theta / pi()) * pi() AS theta FROM l)
SELECT match_no, track_id, round(rho, 6) AS rho, round(theta, 6) AS theta FROM (SELECT *, row_number() OVER (PARTITION BY match_no ORDER BY track_id) AS k FROM n) WHERE k <= 5""",
    "track_lines": SCENES + """, t AS (SELECT match_no, track_id, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS th FROM moving GROUP BY ALL HAVING count(*) >= 2)
SELECT match_no, track_id, round(-sin(th), 6) AS a, round(cos(th), 6) AS b, round(-sin(th) * mx + cos(th) * my, 6) AS c FROM t""",
}
