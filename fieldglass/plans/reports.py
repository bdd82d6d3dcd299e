"""Queries over stored scores, runs and track extents, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators import report as rp
from fieldglass.operators import stitching as st
from fieldglass.operators.scenes import with_velocity
from fieldglass.plans.scoring import rounded
from fieldglass.schemas import duplicate_keys, player_summary_rules, table_rules, violations
from fieldglass.sources.tables import report_json, table

FEW = 100  # frames that count as reliable in runs as short as these


def _numbers(df: DataFrame, skip: tuple[str, ...]) -> DataFrame:
    return rounded(df, *[c for c, kind in df.dtypes if kind == "double" and c not in skip])


def player_summary(spark: SparkSession, base: str) -> DataFrame:
    out = rp.player_summary(table(spark, base, "player_frame_score"))
    return _numbers(out, ("mean_pressure",)).withColumn("mean_pressure", F.round("mean_pressure", 10))


def team_summary(spark: SparkSession, base: str) -> DataFrame:
    return _numbers(rp.team_summary(table(spark, base, "frame_score")), ())


def team_threat(spark: SparkSession, base: str) -> DataFrame:
    teams = rp.team_summary(table(spark, base, "frame_score"))
    return teams.select("job_id", "attacking_side", F.round(rp.threat_efficiency(F.col("median_dangerous_space"), F.col("median_controlled_space")), 6).alias("threat_efficiency"))


def run_coverage(spark: SparkSession, base: str) -> DataFrame:
    share = rp.coverage(F.col("frames_scored").cast("double"), F.col("frames_total").cast("double"))
    return table(spark, base, "analysis_job").select("job_id", F.round(share, 9).alias("coverage"), F.round(share, 4).alias("stored_coverage"))


def _report(spark: SparkSession, base: str) -> DataFrame:
    summaries = table(spark, base, "player_match_summary").dropDuplicates(["job_id", "track_id", "player_id", "frames"])
    return rp.player_report(summaries, table(spark, base, "analysis_job"), table(spark, base, "track_span"), table(spark, base, "player"))


def player_report(spark: SparkSession, base: str) -> DataFrame:
    return _report(spark, base).select("job_id", "track_id", "player_id", "player_name", "side", "frames", F.col("coverage").cast("double").alias("coverage"), "pipeline_version", "is_reliable")


def report_documents(spark: SparkSession, base: str) -> DataFrame:
    """The report's rows as JSON."""
    return report_json(_report(spark, base).select("job_id", "track_id", "side", "frames", "is_reliable"))


def _summaries(spark: SparkSession, base: str) -> DataFrame:
    values = ["frames", "median_space_owned", "availability_rate", "median_offside_margin", "mean_pressure"]
    return rp.once(table(spark, base, "player_match_summary"), ["job_id", "track_id"], values)


def top_space(spark: SparkSession, base: str) -> DataFrame:
    return rp.rank_by(_summaries(spark, base), "median_space_owned", min_frames=FEW, limit=25).select("job_id", "track_id", "frames", "median_space_owned")


def reliable_players(spark: SparkSession, base: str) -> DataFrame:
    return rp.reliable(_summaries(spark, base), FEW).select("job_id", "track_id", "frames")


def shoulder_runners(spark: SparkSession, base: str) -> DataFrame:
    return rp.shoulder_runners(_summaries(spark, base), 2.0, FEW).select("job_id", "track_id", "median_offside_margin")


def unreachable_players(spark: SparkSession, base: str) -> DataFrame:
    return rp.unreachable_players(_summaries(spark, base), 0.3, FEW).select("job_id", "track_id", "median_space_owned", "availability_rate")


def run_quality(spark: SparkSession, base: str) -> DataFrame:
    out = rp.run_quality(table(spark, base, "analysis_job"), _summaries(spark, base), FEW)
    return out.select("job_id", "confidence", F.array_join("warnings", " ").alias("warnings"))


def latest_runs(spark: SparkSession, base: str) -> DataFrame:
    """The newest runs, as a report lists them."""
    return table(spark, base, "analysis_job").orderBy(F.col("created_at").desc(), "job_id").limit(20).select("job_id", F.lower("status").alias("status"), F.col("progress"))


def summary_violations(spark: SparkSession, base: str) -> DataFrame:
    return violations(table(spark, base, "player_match_summary"), player_summary_rules())


def table_violations(spark: SparkSession, base: str) -> DataFrame:
    """Rows of every stored table, and how many break each of its rules."""
    found = [violations(table(spark, base, name), rules).select(F.lit(name).alias("table_name"), "rule", "n_rows", "n_violations") for name, rules in table_rules().items()]
    return reduce(DataFrame.unionAll, found)


def _stored_positions(spark: SparkSession, base: str) -> DataFrame:
    """One row per stored frame of a track, with the rate of its job and the side of its span; NaN is no place.

    Of rows that differ the larger place counts; tracks whose job has no row have no rate and are left out.
    """
    scores = table(spark, base, "player_frame_score").repartition("job_id", "track_id")  # the one shuffle of the readings
    readings = rp.once(scores, ["job_id", "track_id", "frame_index"], ["pitch_x", "pitch_y"]).withColumnsRenamed({"pitch_x": "x", "pitch_y": "y"})
    rates = table(spark, base, "analysis_job").where(F.col("fps") > 0).groupBy("job_id").agg(F.max("fps").cast("double").alias("fps"))
    sides = table(spark, base, "track_span").groupBy("job_id", "track_id").agg(F.min("team").alias("team"))
    moving = with_velocity(readings.join(rates, "job_id").join(sides, ["job_id", "track_id"], "left"), fps=1.0, match="job_id")
    return moving.withColumns({c: F.col(c) * F.col("fps") for c in ("vx", "vy")})


def stored_velocity(spark: SparkSession, base: str) -> DataFrame:
    """Velocity of the stored, gappy readings; null where a reading has no place."""
    # ten digits: stored places have few, and their quotients fall on ties at six
    return _stored_positions(spark, base).select("job_id", "track_id", "frame_index", *[F.round(c, 10).alias(c) for c in ("vx", "vy")])


def stored_extents(spark: SparkSession, base: str) -> DataFrame:
    """First and last place, velocity and number of placed readings of the stored tracks."""
    out = st.track_extents(_stored_positions(spark, base), match="job_id")
    return out.withColumns({c: F.round(c, 10) for c in ("first_x", "first_y", "last_x", "last_y", "last_vx", "last_vy")})


def repeated_summaries(spark: SparkSession, base: str) -> DataFrame:
    return duplicate_keys(table(spark, base, "player_match_summary"), ["job_id", "track_id"])


def _links(spark: SparkSession, base: str) -> DataFrame:
    return st.candidate_links(table(spark, base, "track_span"), table(spark, base, "analysis_job"))


def link_candidates(spark: SparkSession, base: str) -> DataFrame:
    return rounded(_links(spark, base), "distance", "gap_seconds")


def fragment_matches(spark: SparkSession, base: str) -> DataFrame:
    return rounded(st.best_first_matching(_links(spark, base)), "distance")


def fragment_chains(spark: SparkSession, base: str) -> DataFrame:
    """Canonical id of every linked fragment."""
    return st.chain_heads(st.best_first_matching(_links(spark, base)))


def relabelled_tracks(spark: SparkSession, base: str) -> DataFrame:
    """Readings per canonical track of a job."""
    heads = st.chain_heads(st.best_first_matching(_links(spark, base)))
    rows = st.relabel(table(spark, base, "player_frame_score").select("job_id", "track_id", "frame_index"), heads)
    return rows.groupBy("job_id", "track_id").agg(F.countDistinct("frame_index").alias("n_frames"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"))


QUERIES = {
    f.__name__: f
    for f in (player_summary, team_summary, team_threat, run_coverage, player_report, report_documents, top_space, reliable_players, shoulder_runners, unreachable_players, run_quality, latest_runs,
              summary_violations, table_violations, stored_velocity, stored_extents, repeated_summaries, link_candidates, fragment_matches, fragment_chains, relabelled_tracks)
}

_D = "CAST({} AS DOUBLE)".format
_CLEAN = "max(CASE WHEN NOT isnan({0}) THEN {0} END) AS {0}".format
_KEYED = r"CASE WHEN regexp_full_match(lower(regexp_replace({0}, '[\s-]', '', 'g')), '[0-9a-f]{{32}}') THEN lower(regexp_replace({0}, '[\s-]', '', 'g')) ELSE lower(trim({0})) END".format
_ROUND = "round({0}, 6) AS {1}".format
_SUMS = "WITH s AS (SELECT job_id, track_id, max(frames) AS frames, " + ", ".join(_CLEAN(c) for c in ("median_space_owned", "availability_rate", "median_offside_margin", "mean_pressure")) + " FROM player_match_summary GROUP BY ALL)"
_TEAM = "SELECT job_id, attacking_side, frame_index, " + ", ".join(_CLEAN(c) for c in ("team_space", "team_dangerous_space", "attacking_hull", "defending_hull")) + ", max(available_options) AS available_options FROM frame_score WHERE attacking_side IS NOT NULL GROUP BY ALL"
_REPORT = f"""WITH runs AS (SELECT job_id, max(coverage) AS coverage, max(pipeline_version) AS pipeline_version FROM analysis_job GROUP BY ALL), sides AS (SELECT job_id, track_id, min(team) AS side FROM track_span GROUP BY ALL),
names AS (SELECT {_KEYED("player_id")} AS k, max(known_as) AS player_name FROM player GROUP BY ALL),
rep AS (
  SELECT s.job_id, s.track_id, s.player_id, n.player_name, d.side, s.frames, CAST(r.coverage AS DOUBLE) AS coverage, r.pipeline_version, s.frames >= 500 AND r.coverage >= 0.6 AS is_reliable
  FROM (SELECT DISTINCT job_id, track_id, player_id, frames FROM player_match_summary) s JOIN runs r ON s.job_id = r.job_id JOIN sides d ON s.job_id = d.job_id AND s.track_id = d.track_id LEFT JOIN names n ON {_KEYED("s.player_id")} = n.k)"""
_LINKS = f"""WITH RECURSIVE spans AS (
  SELECT DISTINCT s.job_id, track_id, first_frame, last_frame, first_x, first_y, last_x, last_y, coalesce(last_vx, 0) AS vx, coalesce(last_vy, 0) AS vy, coalesce(team, 'unknown') AS team, CAST(j.fps AS DOUBLE) AS fps
  FROM track_span s JOIN (SELECT job_id, max(fps) AS fps FROM analysis_job GROUP BY ALL) j ON s.job_id = j.job_id WHERE first_frame <= last_frame AND j.fps > 0 AND first_x + first_y + last_x + last_y IS NOT NULL),
links AS (
  SELECT p.job_id, p.track_id AS pred, q.track_id AS succ, (q.first_frame - p.last_frame) / p.fps AS gap_seconds,
    sqrt((p.last_x + p.vx * ((q.first_frame - p.last_frame) / p.fps) - q.first_x) ** 2 + (p.last_y + p.vy * ((q.first_frame - p.last_frame) / p.fps) - q.first_y) ** 2) AS distance,
    sqrt((p.last_x - q.first_x) ** 2 + (p.last_y - q.first_y) ** 2) AS straight
  FROM spans p JOIN spans q ON p.job_id = q.job_id AND p.track_id <> q.track_id AND p.last_frame < q.first_frame AND (p.team = 'unknown' OR q.team = 'unknown' OR p.team = q.team)),
kept AS (SELECT job_id, pred, succ, distance, gap_seconds FROM links WHERE gap_seconds <= 2 AND distance <= 7 AND straight / gap_seconds <= {_D(9.5)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY distance, pred, succ) AS k, count(*) OVER (PARTITION BY job_id) AS n FROM kept),
greedy AS (
  SELECT job_id, k, n, pred, succ, distance, [pred] AS preds, [succ] AS succs, true AS taken FROM ranked WHERE k = 1
  UNION ALL
  SELECT r.job_id, r.k, r.n, r.pred, r.succ, r.distance, CASE WHEN ok THEN list_append(preds, r.pred) ELSE preds END, CASE WHEN ok THEN list_append(succs, r.succ) ELSE succs END, ok
  FROM (SELECT r.*, g.preds, g.succs, NOT list_contains(g.preds, r.pred) AND NOT list_contains(g.succs, r.succ) AS ok FROM greedy g JOIN ranked r ON r.job_id = g.job_id AND r.k = g.k + 1) r),
matched AS (SELECT job_id, pred, succ, distance FROM greedy WHERE taken),
walk AS (SELECT job_id, succ AS track_id, pred AS head FROM matched UNION ALL SELECT w.job_id, w.track_id, m.pred FROM walk w JOIN matched m ON m.job_id = w.job_id AND m.succ = w.head),
heads AS (SELECT job_id, track_id, head AS canonical_id FROM walk w WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.job_id = w.job_id AND m.succ = w.head))"""

_RULES = {
    "analysis_job": {"fps_positive": "fps > 0", "stride_positive": "stride >= 1", "progress_is_share": "progress BETWEEN 0 AND 1", "coverage_is_share": "coverage BETWEEN 0 AND 1", "frames_total_not_negative": "frames_total >= 0", "frames_scored_not_negative": "frames_scored >= 0",
                     "scored_within_total": "frames_scored <= frames_total", "failure_explained": "lower(trim(status)) <> 'failed' OR error IS NOT NULL"},
    "match_info": {"length_permitted": "pitch_length BETWEEN 90 AND 120", "width_permitted": "pitch_width BETWEEN 45 AND 90", "clubs_differ": "home_club_id IS DISTINCT FROM away_club_id"},
    "player": {"full_name_not_blank": "length(trim(full_name)) > 0", "foot_known": "primary_foot IN ('left', 'right', 'both')"},
    "frame_score": {**{f"{c}_not_negative": f"{c} >= 0" for c in ("frame_index", "team_space", "team_dangerous_space", "attacking_hull", "defending_hull", "available_options")}, "side_known": "attacking_side IN ('home', 'away')"},
    "player_frame_score": {**{f"{c}_not_negative": f"{c} >= 0" for c in ("space_owned", "lines_broken", "nearest_opponent")}, **{f"{c}_is_share": f"{c} BETWEEN 0 AND 1" for c in ("marking_pressure", "position_value")}},
    "player_match_summary": {"frames_positive": "frames > 0", "duration_not_negative": "duration_seconds >= 0", "space_not_negative": "median_space_owned >= 0", "value_is_share": "median_position_value BETWEEN 0 AND 1", "availability_is_share": "availability_rate BETWEEN 0 AND 1",
                             "offside_rate_is_share": "offside_rate BETWEEN 0 AND 1", "lines_not_negative": "mean_lines_broken >= 0", "separation_not_negative": "median_separation >= 0", "pressure_is_share": "mean_pressure BETWEEN 0 AND 1"},
}
_STORED = f"""WITH p AS (SELECT job_id, track_id, frame_index, {_CLEAN("pitch_x")}, {_CLEAN("pitch_y")} FROM player_frame_score GROUP BY ALL),
r AS (SELECT job_id, CAST(max(fps) AS DOUBLE) AS fps FROM analysis_job WHERE fps > 0 GROUP BY ALL), sides AS (SELECT job_id, track_id, min(team) AS team FROM track_span GROUP BY ALL),
t AS (SELECT p.*, fps, team, pitch_x IS NOT NULL AND pitch_y IS NOT NULL AS placed FROM p JOIN r USING (job_id) LEFT JOIN sides USING (job_id, track_id)),
w AS (SELECT *, first_value(frame_index) OVER o AS f0, first_value(pitch_x) OVER o AS x0, first_value(pitch_y) OVER o AS y0 FROM t WINDOW o AS (PARTITION BY job_id, track_id, placed ORDER BY frame_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
moving AS (SELECT *, CASE WHEN NOT placed THEN NULL WHEN frame_index > f0 THEN (pitch_x - x0) / (frame_index - f0) * fps ELSE 0 END AS vx, CASE WHEN NOT placed THEN NULL WHEN frame_index > f0 THEN (pitch_y - y0) / (frame_index - f0) * fps ELSE 0 END AS vy FROM w)"""

ORACLES = {
    "table_violations": " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{r}' AS rule, count(*) AS n_rows, count(*) FILTER (NOT ({c})) AS n_violations FROM {t}" for t, rules in _RULES.items() for r, c in rules.items()),
    "stored_velocity": _STORED + " SELECT job_id, track_id, frame_index, round(vx, 10) AS vx, round(vy, 10) AS vy FROM moving",
    "stored_extents": _STORED + " SELECT job_id, track_id, min(frame_index) AS first_frame, max(frame_index) AS last_frame, " + ", ".join(f"round(arg_{f}({c}, frame_index), 10) AS {a}" for f, c, a in (("min", "pitch_x", "first_x"), ("min", "pitch_y", "first_y"), ("max", "pitch_x", "last_x"), ("max", "pitch_y", "last_y"), ("max", "vx", "last_vx"), ("max", "vy", "last_vy")))
    + ", any_value(team) AS team, count(*) AS observations FROM moving WHERE placed GROUP BY job_id, track_id",
    "player_summary": "SELECT job_id, track_id, count(*) AS frames, " + ", ".join(_ROUND(f"median({c})", a) for c, a in (("space_owned", "median_space_owned"), ("position_value", "median_position_value"), ("offside_margin", "median_offside_margin"), ("nearest_opponent", "median_separation")))
    + ", " + _ROUND(f"avg(CASE WHEN lane_open AND NOT coalesce(offside_margin > 0, false) AND marking_pressure < {_D(0.6)} THEN 1.0 ELSE 0.0 END)", "availability_rate") + ", " + _ROUND("avg(CASE WHEN offside_margin > 0 THEN 1.0 ELSE 0.0 END)", "offside_rate")
    + ", " + _ROUND("avg(lines_broken)", "mean_lines_broken") + ", " + "round(avg(marking_pressure), 10) AS mean_pressure"
    + " FROM (SELECT job_id, track_id, frame_index, " + ", ".join(_CLEAN(c) for c in ("space_owned", "position_value", "offside_margin", "nearest_opponent", "marking_pressure")) + ", max(lines_broken) AS lines_broken, bool_or(lane_open) AS lane_open FROM player_frame_score GROUP BY ALL) GROUP BY ALL",
    "team_summary": "SELECT job_id, attacking_side, count(*) AS frames, " + ", ".join(_ROUND(f"median({c})", a) for c, a in (("team_space", "median_controlled_space"), ("team_dangerous_space", "median_dangerous_space"), ("attacking_hull", "median_attacking_hull"), ("defending_hull", "median_defending_hull")))
    + ", " + _ROUND("avg(available_options)", "mean_passing_options") + f" FROM ({_TEAM}) GROUP BY ALL",
    "team_threat": f"SELECT job_id, attacking_side, round(CASE WHEN c > 0 THEN d / c ELSE 0 END, 6) AS threat_efficiency FROM (SELECT job_id, attacking_side, median(team_space) AS c, median(team_dangerous_space) AS d FROM ({_TEAM}) GROUP BY ALL)",
    "run_coverage": "SELECT job_id, round(c, 9) AS coverage, round(c, 4) AS stored_coverage FROM (SELECT job_id, CASE WHEN frames_total > 0 THEN CAST(frames_scored AS DOUBLE) / CAST(frames_total AS DOUBLE) ELSE 0 END AS c FROM analysis_job)",
    "player_report": _REPORT + " SELECT * FROM rep",
    "report_documents": _REPORT + " SELECT CAST(to_json({'job_id': job_id, 'track_id': track_id, 'side': side, 'frames': frames, 'is_reliable': is_reliable}) AS VARCHAR) AS report FROM rep",
    "top_space": _SUMS + f" SELECT job_id, track_id, frames, median_space_owned FROM s WHERE frames >= {FEW} ORDER BY median_space_owned DESC NULLS LAST, job_id, track_id LIMIT 25",
    "reliable_players": _SUMS + f" SELECT job_id, track_id, frames FROM s WHERE frames >= {FEW}",
    "shoulder_runners": _SUMS + f" SELECT job_id, track_id, median_offside_margin FROM s WHERE frames >= {FEW} AND median_offside_margin BETWEEN -2 AND 0",
    "unreachable_players": _SUMS + f" SELECT job_id, track_id, median_space_owned, availability_rate FROM s WHERE frames >= {FEW} AND median_space_owned >= (SELECT median(median_space_owned) FROM s WHERE frames >= {FEW}) AND availability_rate <= {_D(0.3)}",
    "run_quality": _SUMS + f""", c AS (SELECT job_id, count(*) AS n, count(*) FILTER (frames < {FEW}) AS thin FROM s GROUP BY ALL),
w AS (SELECT j.job_id, list_filter([CASE WHEN coalesce(frames_total, 0) = 0 THEN 'No frames were analysed.' WHEN coverage < 0.6 THEN 'Only ' || CAST(round(coverage * 100) AS INTEGER) || '% of frames could be scored.' END,
  CASE WHEN thin > 0 THEN thin || ' of ' || n || ' players have fewer than {FEW} scored frames.' END, CASE WHEN coalesce(n, 0) = 0 THEN 'No players were scored.' END], lambda x: x IS NOT NULL) AS l FROM analysis_job j LEFT JOIN c ON j.job_id = c.job_id)
SELECT job_id, CASE WHEN len(l) = 0 THEN 'high' ELSE 'low' END AS confidence, array_to_string(l, ' ') AS warnings FROM w""",
    "latest_runs": "SELECT job_id, lower(status) AS status, progress FROM analysis_job ORDER BY created_at DESC, job_id LIMIT 20",
    "summary_violations": "SELECT unnest(['frames_positive', 'duration_not_negative', 'space_not_negative', 'value_is_share', 'availability_is_share', 'offside_rate_is_share', 'lines_not_negative', 'separation_not_negative', 'pressure_is_share']) AS rule, n AS n_rows, unnest(v) AS n_violations FROM (SELECT count(*) AS n, ["
    + ", ".join(f"count(*) FILTER (NOT ({c}))" for c in ("frames > 0", "duration_seconds >= 0", "median_space_owned >= 0", "median_position_value BETWEEN 0 AND 1", "availability_rate BETWEEN 0 AND 1", "offside_rate BETWEEN 0 AND 1", "mean_lines_broken >= 0", "median_separation >= 0", "mean_pressure BETWEEN 0 AND 1"))
    + "] AS v FROM player_match_summary)",
    "repeated_summaries": "SELECT job_id, track_id, count(*) AS n_rows FROM player_match_summary GROUP BY ALL HAVING count(*) > 1",
    "link_candidates": _LINKS + " SELECT job_id, pred, succ, round(distance, 6) AS distance, round(gap_seconds, 6) AS gap_seconds FROM kept",
    "fragment_matches": _LINKS + " SELECT job_id, pred, succ, round(distance, 6) AS distance FROM matched",
    "fragment_chains": _LINKS + " SELECT * FROM heads",
    "relabelled_tracks": _LINKS + " SELECT p.job_id, coalesce(h.canonical_id, p.track_id) AS track_id, count(DISTINCT frame_index) AS n_frames, min(frame_index) AS first_frame, max(frame_index) AS last_frame FROM player_frame_score p LEFT JOIN heads h ON p.job_id = h.job_id AND p.track_id = h.track_id GROUP BY p.job_id, coalesce(h.canonical_id, p.track_id)",
}
