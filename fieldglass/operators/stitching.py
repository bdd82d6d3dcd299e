"""Track fragments: extents, candidate links, one-to-one matching, and relabelling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fieldglass.functions import geometry as g
from fieldglass.session import Materialised


@dataclass(frozen=True)
class StitchConfig:
    max_gap_seconds: float = 2.0
    max_distance: float = 7.0
    max_speed: float = 9.5
    respect_teams: bool = True


def track_extents(observations: DataFrame, match: str = "match_no") -> DataFrame:
    """Per track its first and last frame, place and velocity there, modal team (the first seen of equals) and observations.

    Rows without a position are passed over; an unknown velocity is a standing player.
    """
    placed = observations.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    by_team = placed.groupBy(match, "track_id", "team").agg(
        F.count(F.lit(1)).alias("_n"), F.min("frame_index").alias("_seen"), F.min_by(F.struct("x", "y"), "frame_index").alias("_first"),
        F.max("frame_index").alias("_until"), F.max_by(F.struct("x", "y", F.coalesce("vx", F.lit(0.0)).alias("vx"), F.coalesce("vy", F.lit(0.0)).alias("vy")), "frame_index").alias("_last"),
    )
    return by_team.groupBy(match, "track_id").agg(
        F.min("_seen").alias("first_frame"), F.max("_until").alias("last_frame"), F.min_by("_first", "_seen").alias("_first"), F.max_by("_last", "_until").alias("_last"),
        F.max_by("team", F.struct("_n", -F.col("_seen"))).alias("team"), F.sum("_n").alias("observations"),
    ).select(match, "track_id", "first_frame", "last_frame", F.col("_first.x").alias("first_x"), F.col("_first.y").alias("first_y"), F.col("_last.x").alias("last_x"), F.col("_last.y").alias("last_y"),
             F.col("_last.vx").alias("last_vx"), F.col("_last.vy").alias("last_vy"), "team", "observations")


def candidate_links(spans: DataFrame, rates: DataFrame, config: StitchConfig = StitchConfig(), key: str = "job_id") -> DataFrame:
    """Pairs (key, pred, succ, distance) of fragments that may be one player: no overlap, a short gap, near the predicted place.

    rates gives fps per key; fragments without a positive rate link to nothing. Repeated spans count once, spans whose
    extent runs backwards or lacks a place are left out, a null velocity is a standing player. The end of a fragment
    meets only beginnings within one bucket of the longest gap, so a match is never paired with itself as a whole.
    """
    fps = rates.groupBy(key).agg(F.max(F.col("fps").cast("double")).alias("_fps")).where(F.col("_fps") > 0)
    used = spans.where((F.col("first_frame") <= F.col("last_frame")) & F.col("first_x").isNotNull() & F.col("first_y").isNotNull() & F.col("last_x").isNotNull() & F.col("last_y").isNotNull())
    cols = [key, "track_id", "first_frame", "last_frame", "first_x", "first_y", "last_x", "last_y", "last_vx", "last_vy", "team"]
    used = used.select(*cols).dropDuplicates([key, "track_id"]).join(fps, key).withColumn("_reach", F.col("_fps") * config.max_gap_seconds)
    bucket = lambda c: F.floor(F.try_divide(F.col(c), F.col("_reach")))
    ends = used.withColumn("_bucket", F.explode(F.array(bucket("last_frame"), bucket("last_frame") + 1)))
    ends = ends.select(key, "_bucket", "_fps", F.col("track_id").alias("pred"), F.col("last_frame").alias("_until"), "last_x", "last_y", F.coalesce("last_vx", F.lit(0.0)).alias("_vx"), F.coalesce("last_vy", F.lit(0.0)).alias("_vy"), F.col("team").alias("_team"))
    starts = used.select(key, bucket("first_frame").alias("_bucket"), F.col("track_id").alias("succ"), F.col("first_frame").alias("_from"), "first_x", "first_y", "team")
    pairs = ends.join(starts, [key, "_bucket"]).where((F.col("_until") < F.col("_from")) & (F.col("pred") != F.col("succ")))
    gap = F.try_divide(F.col("_from") - F.col("_until"), F.col("_fps"))
    pairs = pairs.withColumn("gap_seconds", gap).where(F.col("gap_seconds") <= config.max_gap_seconds)
    if config.respect_teams:
        known = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
        pairs = pairs.where((known("_team") == "unknown") | (known("team") == "unknown") | (F.col("_team") == F.col("team")))
    x, y = F.col("last_x") + F.col("_vx") * F.col("gap_seconds"), F.col("last_y") + F.col("_vy") * F.col("gap_seconds")
    pairs = pairs.withColumn("distance", g.distance(x, y, F.col("first_x"), F.col("first_y"))).where(F.col("distance") <= config.max_distance)
    straight = g.distance(F.col("last_x"), F.col("last_y"), F.col("first_x"), F.col("first_y"))
    return pairs.where(straight <= config.max_speed * F.col("gap_seconds")).select(key, "pred", "succ", "distance", "gap_seconds")


def best_first_matching(links: DataFrame, key: str = "job_id", max_rounds: int = 10_000) -> DataFrame:
    """One-to-one links taken in order of (distance, pred, succ), each end used once: rows (key, pred, succ, distance).

    In a round every link that is the best of both its ends is taken and all links at these ends are dropped. With a
    strict order that is what taking them one by one gives, and no match has to fit one task.
    """
    left = Materialised(links.select(key, "pred", "succ", "distance"), "links")
    taken = None
    rank = F.struct("distance", "pred", "succ")
    for _ in range(max_rounds):
        if left.df.isEmpty():
            return taken if taken is not None else left.df
        marked = left.df.withColumns({f"_{end}": F.min(rank).over(Window.partitionBy(key, end)) for end in ("pred", "succ")}).withColumn("_me", rank)
        best = Materialised(marked.where((F.col("_me") == F.col("_pred")) & (F.col("_me") == F.col("_succ"))).select(key, "pred", "succ", "distance"), "taken")
        taken = best.df if taken is None else taken.union(best.df)
        rest = left.df.join(best.df.select(key, "pred"), [key, "pred"], "left_anti").join(best.df.select(key, "succ"), [key, "succ"], "left_anti")
        after = Materialised(rest.select(key, "pred", "succ", "distance"), "links")
        left.drop()
        left = after
    raise RuntimeError(f"links left after {max_rounds} rounds")


def chain_heads(matches: DataFrame, key: str = "job_id", max_rounds: int = 64) -> DataFrame:
    """Per linked fragment the first fragment of its chain: rows (key, track_id, canonical_id), by pointer doubling."""
    heads = matches.select(key, F.col("succ").alias("track_id"), F.col("pred").alias("canonical_id"))
    held = Materialised(heads, "heads")
    for _ in range(max_rounds):
        up = held.df.select(key, F.col("track_id").alias("canonical_id"), F.col("canonical_id").alias("_next"))
        moved = held.df.join(up, [key, "canonical_id"], "left")
        after = Materialised(moved.select(key, "track_id", F.coalesce("_next", "canonical_id").alias("canonical_id"), F.col("_next").isNotNull().alias("_moved")), "heads")
        if after.df.where("_moved").isEmpty():
            return after.df.drop("_moved")
        held.drop()
        held = after
    raise RuntimeError(f"chains longer than 2 to the power {max_rounds}")


def relabel(observations: DataFrame, heads: DataFrame, key: str = "job_id") -> DataFrame:
    """Observations under the canonical ids of their tracks; tracks without a link keep theirs."""
    return observations.join(heads, [key, "track_id"], "left").withColumn("track_id", F.coalesce("canonical_id", "track_id")).drop("canonical_id")
