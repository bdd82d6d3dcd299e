"""Queries that score the tracking derived from events, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions import geometry as g
from fieldglass.operators.control import team_shape, with_space
from fieldglass.operators.scenes import KEY, assemble, gated, supporting_players, with_carrier, with_offside_line, with_possession, with_support, with_velocity
from fieldglass.sources.tracking import OBJECTS_SQL, tracking_from_events


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def scenes(spark: SparkSession, base: str) -> DataFrame:
    """Frames with players, velocities and possession."""
    players, frames = tracking_from_events(spark, base)
    return with_possession(assemble(with_velocity(players), frames))


def lined(spark: SparkSession, base: str) -> DataFrame:
    """Gated scenes with offside line and carrier."""
    return with_carrier(with_offside_line(gated(scenes(spark, base))))


def velocity(spark: SparkSession, base: str) -> DataFrame:
    players, _ = tracking_from_events(spark, base)
    moving = with_velocity(players).withColumn("speed", F.hypot("vx", "vy"))
    return rounded(moving.select(*KEY, "track_id", "vx", "vy", "speed"), "vx", "vy", "speed")


def possession(spark: SparkSession, base: str) -> DataFrame:
    return scenes(spark, base).select(*KEY, "attacking_team")


def frame_gate(spark: SparkSession, base: str) -> DataFrame:
    return gated(scenes(spark, base)).select(*KEY, "attacking_team", "flip", F.size("attackers").alias("n_attackers"), F.size("defenders").alias("n_defenders"))


def offside_line(spark: SparkSession, base: str) -> DataFrame:
    return rounded(lined(spark, base).select(*KEY, "offside_line", "carrier_id"), "offside_line")


_PLAYER = ("offside_margin", "lane_clearance", "nearest_opponent", "marking_pressure", "position_value")


def support_metrics(spark: SparkSession, base: str) -> DataFrame:
    rows = supporting_players(lined(spark, base)).select(*KEY, "track_id", *_PLAYER, "lane_open", "blockers", "is_available")
    return rounded(rows, *_PLAYER)


def available_options(spark: SparkSession, base: str) -> DataFrame:
    return supporting_players(lined(spark, base)).groupBy(*KEY).agg(F.count_if("is_available").cast("int").alias("available_options"))


def offside_report(spark: SparkSession, base: str) -> DataFrame:
    """Per match and track: frames off the ball, offside rate and median margin."""
    rows = supporting_players(lined(spark, base))
    return rows.groupBy("match_no", "track_id").agg(
        F.count(F.lit(1)).alias("frames"), r6(F.avg(g.is_offside(F.col("offside_margin")).cast("double"))).alias("offside_rate"), r6(F.median("offside_margin")).alias("median_offside_margin")
    )


def space_control(spark: SparkSession, base: str) -> DataFrame:
    """Controlled and dangerous space of the attack, on one-metre cells."""
    out = with_space(gated(scenes(spark, base))).select(*KEY, "team_space", "team_dangerous_space")
    return out.withColumns({c: F.round(c, 3) for c in ("team_space", "team_dangerous_space")})


def space_ownership(spark: SparkSession, base: str) -> DataFrame:
    """Area each attacker reaches first."""
    rows = with_space(gated(scenes(spark, base))).select(*KEY, F.explode(F.arrays_zip("attackers", "ownership")).alias("p"))
    return rows.select(*KEY, F.col("p.attackers.track_id").alias("track_id"), F.round("p.ownership", 3).alias("space_owned"))


def hulls(spark: SparkSession, base: str) -> DataFrame:
    out = team_shape(with_space(gated(scenes(spark, base))), "defenders")
    return rounded(out.select(*KEY, "attacking_hull", "defending_hull", "depth", "width", "centroid_x", "centroid_y"), "attacking_hull", "defending_hull", "depth", "width", "centroid_x", "centroid_y")


def defensive_banks(spark: SparkSession, base: str) -> DataFrame:
    """Lines of the defence per frame and how many players of the attack are beyond each number of them."""
    rows = supporting_players(with_space(lined(spark, base)))
    return rows.groupBy(*KEY).agg(*[F.count_if(F.col("lines_broken") >= k).cast("int").alias(f"beyond_{k}") for k in (1, 2, 3)])


def frame_scores(spark: SparkSession, base: str) -> DataFrame:
    """All measures of every scored frame."""
    frames = with_support(with_space(lined(spark, base))).where(F.size("support") > 0)
    banks = F.array_join(F.transform("defensive_lines", lambda c: F.format_string("%.6f", c)), " ").alias("banks")
    options = F.size(F.filter("support", lambda s: s["is_available"])).alias("available_options")
    out = frames.select(*KEY, "attacking_team", "team_space", "team_dangerous_space", "attacking_hull", "defending_hull", "offside_line", banks, options, F.size("support").alias("n_players"))
    return rounded(out, "team_space", "team_dangerous_space", "attacking_hull", "defending_hull", "offside_line")


def match_player_summary(spark: SparkSession, base: str) -> DataFrame:
    """Per match and track over the scored frames: medians, rates and means."""
    rows = supporting_players(with_space(lined(spark, base)))
    out = rows.groupBy("match_no", "track_id").agg(
        F.count(F.lit(1)).alias("frames"), *[F.median(c).alias(f"median_{c}") for c in ("space_owned", "position_value", "offside_margin", "nearest_opponent")],
        F.avg(F.col("is_available").cast("double")).alias("availability_rate"), F.avg(g.is_offside(F.col("offside_margin")).cast("double")).alias("offside_rate"), F.avg("lines_broken").alias("mean_lines_broken"), F.avg("marking_pressure").alias("mean_pressure"),
    )
    return rounded(out, *[c for c in out.columns if c not in ("match_no", "track_id", "frames")])


QUERIES = {
    f.__name__: f
    for f in (velocity, possession, frame_gate, offside_line, support_metrics, available_options, offside_report, space_control, space_ownership, hulls, defensive_banks, frame_scores, match_player_summary)
}

_D = "CAST({} AS DOUBLE)".format
_DIST = "sqrt(({0}.x - {1}) * ({0}.x - {1}) + ({0}.y - {2}) * ({0}.y - {2}))".format

SCENES = f"""WITH {OBJECTS_SQL},
frames AS (SELECT match_no, frame_index, max(CASE WHEN ord = 0 AND seen THEN x END) AS bx, max(CASE WHEN ord = 0 AND seen THEN y END) AS byy FROM objects GROUP BY ALL),
players AS (
  SELECT *, (x - first_value(x) OVER w) AS mx, (y - first_value(y) OVER w) AS my, (frame_index - first_value(frame_index) OVER w) * {_D(0.04)} AS span
  FROM (SELECT match_no, frame_index, ord, CASE WHEN ord <= 11 THEN 100 ELSE 200 END + ord AS track_id, CASE WHEN ord <= 11 THEN 'home' ELSE 'away' END AS team, x, y FROM objects WHERE ord BETWEEN 1 AND 22)
  WINDOW w AS (PARTITION BY match_no, track_id ORDER BY frame_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
moving AS (SELECT match_no, frame_index, ord, track_id, team, x, y, CASE WHEN span > 0 THEN mx / span ELSE 0 END AS vx, CASE WHEN span > 0 THEN my / span ELSE 0 END AS vy FROM players),
near AS (
  SELECT f.match_no, f.frame_index, f.bx, f.byy, coalesce(min({_DIST("p", "f.bx", "f.byy")}) FILTER (team = 'home'), 'inf'::DOUBLE) AS h, coalesce(min({_DIST("p", "f.bx", "f.byy")}) FILTER (team = 'away'), 'inf'::DOUBLE) AS a,
    arg_min(team, ord) AS listed
  FROM frames f LEFT JOIN moving p ON f.match_no = p.match_no AND f.frame_index = p.frame_index GROUP BY ALL),
claims AS (
  SELECT *, CASE WHEN bx IS NOT NULL AND least(h, a) <= 4 THEN CASE WHEN h < a THEN 'home' WHEN a < h THEN 'away' ELSE listed END END AS any_side FROM near),
held AS (
  SELECT match_no, frame_index, bx, byy, coalesce(last_value(CASE WHEN least(h, a) + {_D(1.5)} < greatest(h, a) THEN any_side END IGNORE NULLS) OVER w, first_value(any_side IGNORE NULLS) OVER w) AS team
  FROM claims WINDOW w AS (PARTITION BY match_no ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
gate AS (
  SELECT h.match_no, h.frame_index, h.team AS attacking_team, avg(p.x) FILTER (p.team <> h.team) < avg(p.x) FILTER (p.team = h.team) AS flip, count(*) FILTER (p.team = h.team) AS na, count(*) FILTER (p.team <> h.team) AS nd, h.bx, h.byy
  FROM held h JOIN moving p ON h.match_no = p.match_no AND h.frame_index = p.frame_index WHERE h.team IS NOT NULL AND h.bx IS NOT NULL GROUP BY ALL HAVING na >= 2 AND nd >= 2),
ball AS (SELECT match_no, frame_index, CASE WHEN flip THEN 105 - bx ELSE bx END AS bx, CASE WHEN flip THEN 68 - byy ELSE byy END AS byy FROM gate),
placed AS (
  SELECT p.match_no, p.frame_index, p.ord, p.track_id, p.team = s.attacking_team AS attacks, CASE WHEN flip THEN 105 - x ELSE x END AS x, CASE WHEN flip THEN 68 - y ELSE y END AS y, CASE WHEN flip THEN -vx ELSE vx END AS vx, CASE WHEN flip THEN -vy ELSE vy END AS vy
  FROM moving p JOIN gate s ON p.match_no = s.match_no AND p.frame_index = s.frame_index),
att AS (SELECT * FROM placed WHERE attacks), def AS (SELECT * FROM placed WHERE NOT attacks),
line AS (
  SELECT d.match_no, d.frame_index, greatest(list_sort(list(d.x), 'DESC')[2], any_value(b.bx)) AS offside_line FROM def d JOIN ball b ON d.match_no = b.match_no AND d.frame_index = b.frame_index GROUP BY ALL),
carrier AS (
  SELECT match_no, frame_index, track_id AS carrier_id FROM (
    SELECT a.*, row_number() OVER (PARTITION BY a.match_no, a.frame_index ORDER BY (a.x - bx) * (a.x - bx) + (a.y - byy) * (a.y - byy), ord) AS rn FROM att a JOIN ball b ON a.match_no = b.match_no AND a.frame_index = b.frame_index)
  WHERE rn = 1),
pairs AS (
  SELECT a.match_no, a.frame_index, a.track_id, a.x, a.y, d.x AS dx, d.y AS dy, bx, byy,
    CASE WHEN (a.x - bx) * (a.x - bx) + (a.y - byy) * (a.y - byy) > {_D("1e-18")} THEN least(greatest(((d.x - bx) * (a.x - bx) + (d.y - byy) * (a.y - byy)) / ((a.x - bx) * (a.x - bx) + (a.y - byy) * (a.y - byy)), 0), 1) ELSE 0 END AS t
  FROM att a JOIN def d ON a.match_no = d.match_no AND a.frame_index = d.frame_index JOIN ball b ON a.match_no = b.match_no AND a.frame_index = b.frame_index
  JOIN carrier c ON a.match_no = c.match_no AND a.frame_index = c.frame_index WHERE a.track_id <> c.carrier_id),
metrics AS (
  SELECT p.match_no, p.frame_index, p.track_id, p.x, p.y, p.x - l.offside_line AS offside_margin, min(sqrt((dx - (bx + (p.x - bx) * t)) ** 2 + (dy - (byy + (p.y - byy) * t)) ** 2)) AS lane_clearance,
    count(*) FILTER (sqrt((dx - (bx + (p.x - bx) * t)) ** 2 + (dy - (byy + (p.y - byy) * t)) ** 2) <= {_D(1.2)}) AS blockers, min(sqrt((dx - p.x) ** 2 + (dy - p.y) ** 2)) AS nearest_opponent
  FROM pairs p JOIN line l ON p.match_no = l.match_no AND p.frame_index = l.frame_index GROUP BY ALL),
scored AS (
  SELECT *, least(greatest(exp(-nearest_opponent / 5), 0), 1) AS marking_pressure, blockers = 0 AS lane_open,
    least(greatest(exp(-sqrt((105 - x) ** 2 + (34 - y) ** 2) / 25) * {_D(0.65)} + abs(atan2(abs((105 - x) * ({_D(37.66)} - y) - ({_D(30.34)} - y) * (105 - x)), (105 - x) * (105 - x) + ({_D(30.34)} - y) * ({_D(37.66)} - y))) / pi() * {_D(0.35)}, 0), 1) AS position_value
  FROM metrics),
rated AS (SELECT *, lane_open AND NOT offside_margin > 0 AND marking_pressure < {_D(0.6)} AS is_available FROM scored)"""

CELLS = f""",
cells AS (SELECT i * 68 + j AS cell, (i + {_D(0.5)}) AS cx, (j + {_D(0.5)}) AS cy FROM range(105) a(i), range(68) b(j)),
worth AS (
  SELECT *, least(greatest(exp(-sqrt((105 - cx) ** 2 + (34 - cy) ** 2) / 25) * {_D(0.65)} + abs(atan2(abs((105 - cx) * ({_D(37.66)} - cy) - ({_D(30.34)} - cy) * (105 - cx)), (105 - cx) * (105 - cx) + ({_D(30.34)} - cy) * ({_D(37.66)} - cy))) / pi() * {_D(0.35)}, 0), 1) AS v FROM cells),
times AS (SELECT p.match_no, p.frame_index, p.ord, p.track_id, p.attacks, c.cell, c.v, {_D(0.7)} + sqrt((x + vx * {_D(0.7)} - cx) ** 2 + (y + vy * {_D(0.7)} - cy) ** 2) / {_D(7.8)} AS t FROM placed p, worth c)"""

_HULL = """,
pts AS (SELECT DISTINCT match_no, frame_index, attacks, x, y FROM placed),
edges AS (
  SELECT p.match_no, p.frame_index, p.attacks, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM pts p JOIN pts q ON p.match_no = q.match_no AND p.frame_index = q.frame_index AND p.attacks = q.attacks AND (p.x <> q.x OR p.y <> q.y)
  WHERE NOT EXISTS (SELECT 1 FROM pts r WHERE r.match_no = p.match_no AND r.frame_index = p.frame_index AND r.attacks = p.attacks
    AND ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0 OR ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0 AND (r.x - p.x) * (r.x - q.x) + (r.y - p.y) * (r.y - q.y) > 0)))),
areas AS (SELECT match_no, frame_index, attacks, abs(sum(px * qy - qx * py)) / 2 AS area FROM edges GROUP BY ALL)"""

ORACLES = {
    "velocity": SCENES + " SELECT match_no, frame_index, track_id, round(vx, 6) AS vx, round(vy, 6) AS vy, round(sqrt(vx * vx + vy * vy), 6) AS speed FROM moving",
    "possession": SCENES + " SELECT match_no, frame_index, team AS attacking_team FROM held",
    "frame_gate": SCENES + " SELECT match_no, frame_index, attacking_team, flip, CAST(na AS INTEGER) AS n_attackers, CAST(nd AS INTEGER) AS n_defenders FROM gate",
    "offside_line": SCENES + " SELECT match_no, frame_index, round(offside_line, 6) AS offside_line, carrier_id FROM line JOIN carrier USING (match_no, frame_index)",
    "support_metrics": SCENES + " SELECT match_no, frame_index, track_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _PLAYER) + ", lane_open, CAST(blockers AS INTEGER) AS blockers, is_available FROM rated",
    "available_options": SCENES + " SELECT match_no, frame_index, CAST(count(*) FILTER (is_available) AS INTEGER) AS available_options FROM rated GROUP BY ALL",
    "offside_report": SCENES + " SELECT match_no, track_id, count(*) AS frames, round(avg(CASE WHEN offside_margin > 0 THEN 1.0 ELSE 0.0 END), 6) AS offside_rate, round(median(offside_margin), 6) AS median_offside_margin FROM rated GROUP BY ALL",
    "space_control": SCENES + CELLS + f""", firsts AS (SELECT match_no, frame_index, cell, any_value(v) AS v, min(t) FILTER (attacks) AS ta, min(t) FILTER (NOT attacks) AS td FROM times GROUP BY match_no, frame_index, cell)
SELECT match_no, frame_index, round(sum(1 / (1 + exp((ta - td) / {_D(0.45)}))), 3) AS team_space, round(sum(v / (1 + exp((ta - td) / {_D(0.45)}))), 3) AS team_dangerous_space FROM firsts GROUP BY ALL""",
    "space_ownership": SCENES + CELLS + """, winners AS (SELECT match_no, frame_index, cell, arg_min(track_id, t) AS track_id FROM times GROUP BY match_no, frame_index, cell),
areas AS (SELECT match_no, frame_index, track_id, count(*) AS n FROM winners GROUP BY ALL)
SELECT a.match_no, a.frame_index, a.track_id, CAST(coalesce(n, 0) AS DOUBLE) AS space_owned FROM att a LEFT JOIN areas USING (match_no, frame_index, track_id)""",
    "hulls": SCENES + _HULL + """, shape AS (SELECT match_no, frame_index, max(x) - min(x) AS depth, max(y) - min(y) AS width, avg(x) AS centroid_x, avg(y) AS centroid_y FROM def GROUP BY ALL)
SELECT s.match_no, s.frame_index, round(coalesce(a.area, 0), 6) AS attacking_hull, round(coalesce(d.area, 0), 6) AS defending_hull, round(depth, 6) AS depth, round(width, 6) AS width, round(centroid_x, 6) AS centroid_x, round(centroid_y, 6) AS centroid_y
FROM shape s LEFT JOIN areas a ON a.match_no = s.match_no AND a.frame_index = s.frame_index AND a.attacks LEFT JOIN areas d ON d.match_no = s.match_no AND d.frame_index = s.frame_index AND NOT d.attacks""",
}

_BANKS = """,
seeds AS (
  SELECT match_no, frame_index, xs, list_transform(range(least(3, len(xs))), lambda i: xs[1 + CAST(floor((i + CAST(0.5 AS DOUBLE)) / least(3, len(xs)) * len(xs)) AS BIGINT) % len(xs)]) AS centres
  FROM (SELECT match_no, frame_index, list_sort(list(x)) AS xs FROM def GROUP BY ALL)),
steps AS (
  SELECT match_no, frame_index, xs, centres, 0 AS step, false AS done FROM seeds
  UNION ALL
  SELECT match_no, frame_index, xs, moved, step + 1, list_max(list_transform(range(1, len(moved) + 1), lambda i: abs(moved[i] - centres[i]))) <= 1e-9 FROM (
    SELECT *, list_transform(range(1, len(centres) + 1), lambda i: coalesce(list_avg(list_filter(xs, lambda x:
      list_position(list_transform(centres, lambda c: abs(x - c)), list_min(list_transform(centres, lambda c: abs(x - c)))) = i)), centres[i])) AS moved
    FROM steps WHERE step < 50 AND NOT done)),
banks AS (SELECT match_no, frame_index, list_sort(arg_max(centres, step)) AS centres FROM steps GROUP BY ALL),
broken AS (SELECT r.*, len(list_filter(b.centres, lambda c: r.x > c)) AS lines_broken FROM rated r JOIN banks b ON r.match_no = b.match_no AND r.frame_index = b.frame_index)"""
_RECURSIVE = SCENES.replace("WITH ", "WITH RECURSIVE ", 1)
_SPACE = CELLS + f""",
firsts AS (SELECT match_no, frame_index, cell, any_value(v) AS v, min(t) FILTER (attacks) AS ta, min(t) FILTER (NOT attacks) AS td, arg_min(track_id, t) AS track_id FROM times GROUP BY match_no, frame_index, cell),
space AS (SELECT match_no, frame_index, sum(1 / (1 + exp((ta - td) / {_D(0.45)}))) AS team_space, sum(v / (1 + exp((ta - td) / {_D(0.45)}))) AS team_dangerous_space FROM firsts GROUP BY ALL),
owned AS (SELECT match_no, frame_index, track_id, count(*) AS n FROM firsts GROUP BY ALL)"""

ORACLES |= {
    "defensive_banks": _RECURSIVE + _BANKS + " SELECT match_no, frame_index, " + ", ".join(f"CAST(count(*) FILTER (lines_broken >= {k}) AS INTEGER) AS beyond_{k}" for k in (1, 2, 3)) + " FROM broken GROUP BY ALL",
    "frame_scores": _RECURSIVE + _BANKS + _SPACE + _HULL + """,
counts AS (SELECT match_no, frame_index, CAST(count(*) FILTER (is_available) AS INTEGER) AS available_options, CAST(count(*) AS INTEGER) AS n_players FROM rated GROUP BY ALL)
SELECT c.match_no, c.frame_index, attacking_team, round(team_space, 6) AS team_space, round(team_dangerous_space, 6) AS team_dangerous_space, round(coalesce(a.area, 0), 6) AS attacking_hull, round(coalesce(d.area, 0), 6) AS defending_hull,
  round(offside_line, 6) AS offside_line, array_to_string(list_transform(centres, lambda x: printf('%.6f', x)), ' ') AS banks, available_options, n_players
FROM counts c JOIN gate USING (match_no, frame_index) JOIN space USING (match_no, frame_index) JOIN line USING (match_no, frame_index) JOIN banks USING (match_no, frame_index)
LEFT JOIN areas a ON a.match_no = c.match_no AND a.frame_index = c.frame_index AND a.attacks LEFT JOIN areas d ON d.match_no = c.match_no AND d.frame_index = c.frame_index AND NOT d.attacks""",
    "match_player_summary": _RECURSIVE + _BANKS + _SPACE + """
SELECT b.match_no, b.track_id, count(*) AS frames, round(median(CAST(coalesce(n, 0) AS DOUBLE)), 6) AS median_space_owned, round(median(position_value), 6) AS median_position_value, round(median(offside_margin), 6) AS median_offside_margin,
  round(median(nearest_opponent), 6) AS median_nearest_opponent, round(avg(CASE WHEN is_available THEN 1.0 ELSE 0.0 END), 6) AS availability_rate, round(avg(CASE WHEN offside_margin > 0 THEN 1.0 ELSE 0.0 END), 6) AS offside_rate,
  round(avg(lines_broken), 6) AS mean_lines_broken, round(avg(marking_pressure), 6) AS mean_pressure
FROM broken b LEFT JOIN owned o ON b.match_no = o.match_no AND b.frame_index = o.frame_index AND b.track_id = o.track_id GROUP BY ALL""",
}
