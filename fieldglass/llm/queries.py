"""Queries of the corpus problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.components import group_extents, match_groups
from fieldglass.llm.encoding import repair_documents
from fieldglass.llm.mixing import draw_mixture, mixing_rates, mixture_report
from fieldglass.llm.packing import fill_report, pack_documents
from fieldglass.llm.quantiles import quantile_summaries, readings_once, summary_percentiles, wrong_medians
from fieldglass.sources.tables import table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return match_groups(table(spark, base, "track_span"), table(spark, base, "track_pair"))


def p1_groups(spark: SparkSession, base: str) -> DataFrame:
    spans = table(spark, base, "track_span")
    return group_extents(match_groups(spans, table(spark, base, "track_pair")), spans)


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return wrong_medians(table(spark, base, "player_match_summary"), table(spark, base, "player_frame_score"))


def p4_team_space(spark: SparkSession, base: str) -> DataFrame:
    """Percentiles of team_space per attacking side and period, frames counted once, with their bounds (equal to them in small groups)."""
    frames = table(spark, base, "frame_score").where(F.col("team_space").isNotNull())
    once = frames.groupBy("job_id", "frame_index").agg(F.max(F.struct("ingested_at", "attacking_side", "period", "team_space")).alias("r"))
    once = once.select("r.attacking_side", F.coalesce("r.period", F.lit(0)).cast("int").alias("period"), "r.team_space")  # 0: unknown
    keys = ["attacking_side", "period"]
    out = summary_percentiles(quantile_summaries(once, keys, "team_space", error=0.0005), keys, (0.1, 0.5, 0.9))
    return out.withColumns({c: F.round(c, 6) for c in ("estimate", "low", "high")})


def p4_track_percentiles(spark: SparkSession, base: str) -> DataFrame:
    """Quartiles of space_owned per job and track; groups this small keep every value, so the result is exact."""
    once = readings_once(table(spark, base, "player_frame_score"), "space_owned")
    keys = ["job_id", "track_id"]
    out = summary_percentiles(quantile_summaries(once, keys, "space_owned"), keys, (0.25, 0.5, 0.75))
    return out.select(*keys, "percentile", "n", F.round("estimate", 6).alias("estimate"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    packed = pack_documents(table(spark, base, "documents"), table(spark, base, "pack_target"))
    return packed.where((F.col("n_pieces") > 1) & (F.col("piece") == 0)).select("capacity_name", "doc_id")


def p6_fill(spark: SparkSession, base: str) -> DataFrame:
    """Per capacity: tokens and documents placed, documents cut, whether no container is over its capacity and whether few are needed."""
    targets = table(spark, base, "pack_target")
    report = fill_report(pack_documents(table(spark, base, "documents"), targets), targets)
    few = F.col("n_containers") <= F.ceil(F.col("tokens") / F.col("capacity_tokens") / 0.97) + 2
    return report.select("capacity_name", "capacity_tokens", "tokens", "documents", "documents_cut", (F.col("fullest") <= F.col("capacity_tokens")).alias("kept"), few.alias("few_containers"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return mixing_rates(table(spark, base, "documents"), table(spark, base, "mix_target")).where("capped").select("source")


def p7_mixture(spark: SparkSession, base: str) -> DataFrame:
    """The drawn documents."""
    documents = table(spark, base, "documents")
    return draw_mixture(documents, mixing_rates(documents, table(spark, base, "mix_target"))).select("source", "doc_id", "copy", "size_tokens")


def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    """Shares wanted and reached."""
    documents = table(spark, base, "documents")
    rates = mixing_rates(documents, table(spark, base, "mix_target"))
    report = mixture_report(draw_mixture(documents, rates), rates)
    return report.withColumns({c: F.round(c, 6) for c in ("target_share", "wanted_tokens", "rate", "reached_share")})


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return repair_documents(table(spark, base, "documents")).select("doc_id")


def p8_mappings(spark: SparkSession, base: str) -> DataFrame:
    """Damaged documents by the mappings that restored them."""
    repaired = repair_documents(table(spark, base, "documents"))
    return repaired.groupBy(F.array_join(F.array_sort("mappings"), ", ").alias("mappings"), "restorable").agg(F.count(F.lit(1)).alias("n_documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p4_found, p4_team_space, p4_track_percentiles, p6_found, p6_fill, p7_found, p7_mixture, p7_shares, p8_found, p8_mappings)}

_GROUPS = """
WITH RECURSIVE spans AS (SELECT DISTINCT job_id, track_id FROM track_span WHERE job_id IS NOT NULL AND track_id IS NOT NULL),
links AS (
  SELECT p.job_id, p.track_a AS a, p.track_b AS b FROM track_pair p JOIN spans s ON p.job_id = s.job_id AND p.track_a = s.track_id JOIN spans t ON p.job_id = t.job_id AND p.track_b = t.track_id
  WHERE p.is_match AND p.track_a <> p.track_b),
both_ways AS (SELECT job_id, a, b FROM links UNION SELECT job_id, b, a FROM links),
reach AS (
  SELECT job_id, a AS track_id, b AS other FROM both_ways
  UNION SELECT r.job_id, r.track_id, l.b FROM reach r JOIN both_ways l ON r.job_id = l.job_id AND r.other = l.a),
groups AS (SELECT job_id, track_id, min(least(track_id, other)) AS group_track_id FROM reach GROUP BY job_id, track_id)"""

_ONCE = "SELECT job_id, track_id, frame_index, max(space_owned) AS v FROM player_frame_score WHERE space_owned IS NOT NULL AND NOT isnan(space_owned) GROUP BY ALL"

_SIZES = """
WITH sizes AS (SELECT t.source, t.target_share, t.max_repeats, coalesce(sum(strlen(d.text)), 0) AS size FROM mix_target t LEFT JOIN documents d ON t.source = d.source GROUP BY ALL)"""

_MIXTURE = """
WITH targets AS (SELECT source, coalesce(sum(CAST(target_share AS DOUBLE)), 0) AS target_share, CAST(coalesce(min(max_repeats), 0) AS BIGINT) AS max_repeats FROM mix_target WHERE source IS NOT NULL GROUP BY source),
sizes AS (SELECT t.*, CAST(coalesce((SELECT sum(strlen(text)) FROM documents d WHERE d.source = t.source), 0) AS BIGINT) AS size_tokens FROM targets t),
wanted AS (SELECT *, target_share * CAST((SELECT sum(size_tokens) FROM sizes) AS DOUBLE) AS wanted_tokens FROM sizes),
rates AS (SELECT *, CASE WHEN size_tokens > 0 THEN least(wanted_tokens / size_tokens, CAST(max_repeats AS DOUBLE)) ELSE 0 END AS rate, max_repeats * size_tokens < wanted_tokens AS capped FROM wanted),
copies AS (
  SELECT d.source, d.doc_id, CAST(coalesce(strlen(d.text), 0) AS BIGINT) AS size_tokens,
    CAST(floor(rate) AS INTEGER) + CASE WHEN CAST(concat('0x', substr(md5(concat('17:', d.doc_id)), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END AS n
  FROM documents d JOIN rates r ON d.source = r.source),
drawn AS (SELECT source, doc_id, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy, size_tokens FROM copies)"""

ORACLES = {
    "p7_mixture": _MIXTURE + " SELECT source, doc_id, copy, size_tokens FROM drawn",
    "p7_shares": _MIXTURE
    + """, sums AS (SELECT source, count(*) AS drawn_documents, CAST(sum(size_tokens) AS BIGINT) AS drawn_tokens, max(copy) AS most_copies FROM drawn GROUP BY source)
SELECT r.source, round(target_share, 6) AS target_share, max_repeats, size_tokens, round(wanted_tokens, 6) AS wanted_tokens, round(rate, 6) AS rate, capped, coalesce(drawn_documents, 0) AS drawn_documents, coalesce(drawn_tokens, 0) AS drawn_tokens,
  coalesce(most_copies, 0) AS most_copies, round(coalesce(drawn_tokens, 0) / greatest((SELECT sum(drawn_tokens) FROM sums), 1), 6) AS reached_share FROM rates r LEFT JOIN sums s ON r.source = s.source""",
    "p1_found": _GROUPS + " SELECT * FROM groups",
    "p1_groups": _GROUPS
    + """ SELECT g.job_id, g.group_track_id, count(DISTINCT g.track_id) AS n_tracks, min(least(s.first_frame, s.last_frame)) AS first_frame, max(greatest(s.first_frame, s.last_frame)) AS last_frame
FROM groups g JOIN track_span s ON g.job_id = s.job_id AND g.track_id = s.track_id GROUP BY g.job_id, g.group_track_id""",
    "p4_found": f"""SELECT DISTINCT s.job_id, s.track_id FROM player_match_summary s JOIN (SELECT job_id, track_id, median(v) AS m FROM ({_ONCE}) GROUP BY ALL) r
ON s.job_id = r.job_id AND s.track_id = r.track_id WHERE NOT isnan(s.median_space_owned) AND abs(s.median_space_owned - m) > CAST(0.05 AS DOUBLE) * abs(m)""",
    "p4_team_space": """SELECT attacking_side, CAST(coalesce(period, 0) AS INTEGER) AS period, q AS percentile, n, round(e, 6) AS estimate, round(e, 6) AS low, round(e, 6) AS high FROM (
  SELECT attacking_side, period, count(*) AS n, unnest([CAST(0.1 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.9 AS DOUBLE)]) AS q, unnest(quantile_cont(team_space, [0.1, 0.5, 0.9])) AS e FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id, frame_index ORDER BY ingested_at DESC NULLS LAST, attacking_side DESC NULLS LAST, period DESC NULLS LAST, team_space DESC) AS k FROM frame_score WHERE team_space IS NOT NULL)
  WHERE k = 1 AND NOT isnan(team_space) GROUP BY attacking_side, period)""",
    "p4_track_percentiles": f"""SELECT job_id, track_id, q AS percentile, n, round(e, 6) AS estimate FROM (
  SELECT job_id, track_id, count(*) AS n, unnest([CAST(0.25 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.75 AS DOUBLE)]) AS q, unnest(quantile_cont(v, [0.25, 0.5, 0.75])) AS e FROM ({_ONCE}) GROUP BY job_id, track_id)""",
    "p6_found": "SELECT capacity_name, doc_id FROM pack_target JOIN documents ON strlen(text) > capacity_tokens",
    "p6_fill": """SELECT capacity_name, capacity_tokens, tokens, documents, documents_cut, true AS kept, true AS few_containers FROM (
  SELECT capacity_name, capacity_tokens, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS tokens, count(*) AS documents, CAST(count(*) FILTER (strlen(text) > capacity_tokens) AS BIGINT) AS documents_cut FROM pack_target CROSS JOIN documents GROUP BY ALL)""",
    "p7_found": _SIZES + " SELECT source FROM sizes WHERE max_repeats * size < target_share * (SELECT sum(size) FROM sizes)",
}
