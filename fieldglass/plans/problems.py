"""Queries of the general data-quality problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators.anomalies import SpikeModel, implausible_readings, line_readings, position_readings
from fieldglass.operators.gridding import regular_grid
from fieldglass.operators.references import Parent, Reference, orphan_references, orphan_report
from fieldglass.sources.tables import table


def grid(spark: SparkSession, base: str) -> DataFrame:
    """Positions of every track on the stride grid of its job."""
    return regular_grid(table(spark, base, "player_frame_score"), table(spark, base, "analysis_job"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return grid(spark, base).where(F.col("status") != "observed").select("job_id", "track_id", F.col("grid_time").alias("grid_frame"))


def p2_grid(spark: SparkSession, base: str) -> DataFrame:
    return grid(spark, base).select("job_id", "track_id", F.col("grid_time").alias("grid_frame"), F.round("pitch_x", 6).alias("pitch_x"), F.round("pitch_y", 6).alias("pitch_y"), "status")


def spikes(spark: SparkSession, base: str) -> DataFrame:
    """Flagged positions of tracks and offside lines of attacking sides."""
    return implausible_readings(position_readings(table(spark, base, "player_frame_score")).unionByName(line_readings(table(spark, base, "frame_score"))))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return spikes(spark, base).select("table_name", "job_id", "track_id", "frame_index").distinct()


def p3_rates(spark: SparkSession, base: str) -> DataFrame:
    """Flagged readings and their sources per table and kind, and how many of them the model put forward."""
    likely = F.col("p_spike") + F.col("p_stuck") + F.col("p_range") >= SpikeModel().candidate_probability
    source = F.struct(F.coalesce("job_id", F.lit("")), F.coalesce("track_id", F.lit(-2)), F.coalesce("side", F.lit("")))
    return spikes(spark, base).groupBy("table_name", "flag").agg(F.count(F.lit(1)).alias("n_readings"), F.countDistinct(source).alias("n_sources"), F.count_if(likely).alias("n_likely"))


def orphans(spark: SparkSession, base: str) -> DataFrame:
    scores, summaries = table(spark, base, "player_frame_score"), table(spark, base, "player_match_summary")
    return orphan_references(
        [
            Reference("player_frame_score", "job_id", scores, "job_id", "ingested_at", "analysis_job"),
            Reference("player_frame_score", "match_id", scores, "match_id", "ingested_at", "match_info"),
            Reference("player_match_summary", "player_id", summaries, "player_id", "created_at", "player"),
        ],
        [
            Parent("analysis_job", table(spark, base, "analysis_job"), "job_id"),
            Parent("match_info", table(spark, base, "match_info"), "match_id"),
            Parent("player", table(spark, base, "player"), "player_id"),
        ],
    )


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return orphans(spark, base)


def p5_report(spark: SparkSession, base: str) -> DataFrame:
    return orphan_report(orphans(spark, base))


QUERIES = {f.__name__: f for f in (p2_found, p2_grid, p3_found, p3_rates, p5_found, p5_report)}

_GRID = """
WITH usable AS (
  SELECT p.job_id, p.track_id, p.frame_index, CAST(floor(p.frame_index / j.stride) AS BIGINT) AS k, j.stride, avg(p.pitch_x) AS x, avg(p.pitch_y) AS y
  FROM player_frame_score p JOIN (SELECT job_id, min(stride) AS stride FROM analysis_job WHERE stride > 0 GROUP BY job_id) j ON p.job_id = j.job_id
  WHERE isfinite(p.pitch_x) AND isfinite(p.pitch_y) AND p.track_id IS NOT NULL AND p.frame_index IS NOT NULL GROUP BY ALL),
observed AS (SELECT job_id, track_id, stride, k, avg(x) AS x, avg(y) AS y FROM usable GROUP BY ALL),
spine AS (SELECT job_id, track_id, stride, unnest(generate_series(min(k), max(k))) AS k FROM observed GROUP BY job_id, track_id, stride)"""

_KEY = r"CASE WHEN regexp_full_match(lower(regexp_replace({0}, '[\s-]', '', 'g')), '[0-9a-f]{{32}}') THEN regexp_replace(lower(regexp_replace({0}, '[\s-]', '', 'g')), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\1-\2-\3-\4-\5') ELSE lower(trim({0})) END"

_ORPHANS = f"""
WITH refs AS (
  SELECT 'player_frame_score' AS table_name, 'job_id' AS field_name, job_id, {_KEY.format("job_id")} AS ref_key, ingested_at AT TIME ZONE 'UTC' AS t, 'j' AS p FROM player_frame_score WHERE job_id IS NOT NULL
  UNION ALL SELECT 'player_frame_score', 'match_id', job_id, {_KEY.format("match_id")}, ingested_at AT TIME ZONE 'UTC', 'm' FROM player_frame_score WHERE match_id IS NOT NULL
  UNION ALL SELECT 'player_match_summary', 'player_id', job_id, {_KEY.format("player_id")}, created_at AT TIME ZONE 'UTC', 'p' FROM player_match_summary WHERE player_id IS NOT NULL),
parents AS (
  SELECT 'j' AS p, {_KEY.format("job_id")} AS k, created_at AT TIME ZONE 'UTC' AS created, deleted_at AT TIME ZONE 'UTC' AS deleted FROM analysis_job
  UNION ALL SELECT 'm', {_KEY.format("match_id")}, created_at AT TIME ZONE 'UTC', deleted_at AT TIME ZONE 'UTC' FROM match_info
  UNION ALL SELECT 'p', {_KEY.format("player_id")}, created_at AT TIME ZONE 'UTC', deleted_at AT TIME ZONE 'UTC' FROM player),
found AS (
  SELECT DISTINCT table_name, field_name, job_id, ref_key, strftime(t, '%Y-%m') AS ref_month,
    CASE WHEN parents.k IS NULL THEN 'missing' WHEN deleted <= t THEN 'deleted' WHEN created > t THEN 'late' END AS kind
  FROM refs LEFT JOIN parents ON refs.p = parents.p AND refs.ref_key = parents.k)"""

# The rule alone, without a model: from the readings far off the median of their neighbours, all readings are judged anew against
# the nearest ones that are no cases, eight times. On the test tables that settles, and where the model settles.
_SPIKES = """
WITH RECURSIVE readings AS (
  SELECT 'player_frame_score' AS table_name, job_id, track_id, CAST(NULL AS VARCHAR) AS side, frame_index, min(pitch_x) AS x, min(pitch_y) AS y FROM player_frame_score WHERE isfinite(pitch_x) AND isfinite(pitch_y) AND frame_index IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'frame_score', job_id, -1, attacking_side, frame_index, min(offside_line), CAST(NULL AS DOUBLE) FROM frame_score WHERE isfinite(offside_line) AND frame_index IS NOT NULL GROUP BY ALL),
sources AS (SELECT *, dense_rank() OVER (ORDER BY table_name, job_id, track_id, side) AS source FROM readings),
steps AS (
  SELECT *, x < 0 OR x > 120 OR coalesce(y < 0 OR y > 90, false) AS outside, sqrt((x - px) ** 2 + coalesce((y - py) ** 2, 0)) AS step,
    sum(CASE WHEN x = px THEN 0 ELSE 1 END) OVER w AS run_x, sum(CASE WHEN y = py THEN 0 ELSE 1 END) OVER w AS run_y
  FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM sources WINDOW w AS (PARTITION BY source ORDER BY frame_index)) WINDOW w AS (PARTITION BY source ORDER BY frame_index)),
base AS (
  SELECT *, outside OR count(*) OVER (PARTITION BY source, run_x) >= 6 OR (y IS NOT NULL AND count(*) OVER (PARTITION BY source, run_y) >= 6) AS hard, greatest(4, coalesce(8 * median(step) OVER (PARTITION BY source), 0)) AS lim FROM steps),
sweeps AS (
  SELECT source, frame_index, x, y, hard, lim, hard OR coalesce(sqrt((x - median(CASE WHEN NOT hard THEN x END) OVER w) ** 2 + coalesce((y - median(CASE WHEN NOT hard THEN y END) OVER w) ** 2, 0)) > lim, false) AS flagged, 0 AS k
  FROM base WINDOW w AS (PARTITION BY source ORDER BY frame_index ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
  UNION ALL
  SELECT source, frame_index, x, y, hard, lim, CASE WHEN odd > 0 THEN NOT flagged ELSE flagged END, k + 1
  FROM (SELECT *, CASE WHEN hard THEN 0 WHEN flagged AND NOT off > lim THEN lim - off WHEN NOT flagged AND off > lim THEN off ELSE 0 END AS odd FROM (
    SELECT *, coalesce(sqrt((x - (p.x + (n.x - p.x) * w)) ** 2 + coalesce((y - (p.y + (n.y - p.y) * w)) ** 2, 0)), 0) AS off FROM (SELECT *, (frame_index - p.f) / CAST(n.f - p.f AS DOUBLE) AS w FROM (
    SELECT *, last_value(CASE WHEN NOT flagged THEN {'f': frame_index, 'x': x, 'y': y} END IGNORE NULLS) OVER (PARTITION BY source ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
      first_value(CASE WHEN NOT flagged THEN {'f': frame_index, 'x': x, 'y': y} END IGNORE NULLS) OVER (PARTITION BY source ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n
    FROM sweeps WHERE k < 8))))),
cases AS (SELECT b.*, CASE WHEN b.outside THEN 'out_of_range' WHEN b.hard THEN 'stuck' ELSE 'spike' END AS flag FROM sweeps s JOIN base b USING (source, frame_index) WHERE k = 8 AND flagged)"""

ORACLES = {
    "p3_found": _SPIKES + " SELECT DISTINCT table_name, job_id, track_id, frame_index FROM cases",
    "p3_rates": _SPIKES + " SELECT table_name, flag, count(*) AS n_readings, count(DISTINCT source) AS n_sources, count(*) AS n_likely FROM cases GROUP BY ALL",
    "p2_found": _GRID + " SELECT s.job_id, s.track_id, CAST(s.k * s.stride AS INTEGER) AS grid_frame FROM spine s LEFT JOIN observed o ON s.job_id = o.job_id AND s.track_id = o.track_id AND s.k = o.k WHERE o.k IS NULL",
    "p2_grid": _GRID
    + """, line AS (
  SELECT s.job_id, s.track_id, s.stride, s.k, o.k AS ok, last_value(o.k IGNORE NULLS) OVER w AS lk, last_value(o.x IGNORE NULLS) OVER w AS lx, last_value(o.y IGNORE NULLS) OVER w AS ly
  FROM spine s LEFT JOIN observed o ON s.job_id = o.job_id AND s.track_id = o.track_id AND s.k = o.k
  WINDOW w AS (PARTITION BY s.job_id, s.track_id ORDER BY s.k))
SELECT job_id, track_id, CAST(k * stride AS INTEGER) AS grid_frame, CASE WHEN k - lk <= 5 THEN round(lx, 6) END AS pitch_x, CASE WHEN k - lk <= 5 THEN round(ly, 6) END AS pitch_y,
  CASE WHEN ok IS NOT NULL THEN 'observed' WHEN k - lk <= 5 THEN 'filled' ELSE 'missing' END AS status FROM line""",
    "p5_found": _ORPHANS + " SELECT * FROM found WHERE kind IS NOT NULL",
    "p5_report": _ORPHANS + " SELECT table_name, field_name, ref_month, kind, count(*) AS n_references, count(DISTINCT ref_key) AS n_keys FROM found WHERE kind IS NOT NULL GROUP BY ALL",
}
