"""From observations to scored scenes: assembly, velocity, possession, the gate, and the direction of play.

A frame is one row with its players as an array in their order of listing. Everything that compares players of one
frame is then an array expression of that row: no self-join, no further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fieldglass.functions import geometry as g
from fieldglass.operators.ordered import carried

KEY = ("match_no", "frame_index")


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """df with these columns worked out once per row, as a one-element explode: what is written inside the functions of
    array expressions would else be worked out again for every element."""
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.explode(F.array(F.struct(*columns))).alias("_settled")).select(*others, *[F.col(f"_settled.{c}").alias(c) for c in columns])


def with_velocity(observations: DataFrame, *, fps: float = 25.0, window: int = 5, match: str = "match_no") -> DataFrame:
    """vx, vy in metres a second over the last observations of the track, at most so many; 0 for the first.

    Rows without a position get no velocity and are no observations of their track.
    """
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    line = Window.partitionBy(match, "track_id", placed).orderBy("frame_index").rowsBetween(-(max(2, window) - 1), Window.currentRow)
    first = F.first(F.struct("frame_index", "x", "y")).over(line)
    dt = 1.0 / fps if fps > 0 else 0.04
    span = (F.col("frame_index") - F.col("_first.frame_index")) * F.lit(dt)
    slope = lambda c: F.when(placed, F.when(span > 0, (F.col(c) - F.col(f"_first.{c}")) / span).otherwise(0.0))
    return observations.withColumn("_first", first).withColumns({"vx": slope("x"), "vy": slope("y")}).drop("_first")


def assemble(observations: DataFrame, frames: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """frames with players: array of (ord, track_id, team, x, y, vx, vy) in order of ord. Frames without any keep an empty array."""
    fields = ["ord", "track_id", "team", "x", "y", "vx", "vy"]
    given = observations if "vx" in observations.columns else observations.withColumns({"vx": F.lit(None).cast("double"), "vy": F.lit(None).cast("double")})
    players = given.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("players"))
    kind = players.schema["players"].dataType.simpleString()
    return frames.join(players, list(key), "left").withColumn("players", F.coalesce("players", F.expr(f"CAST(array() AS {kind})")))


def _least_distance(side: str):
    near = F.filter("players", lambda p: (p["team"] == side) & p["x"].isNotNull() & p["y"].isNotNull())
    return F.array_min(F.transform(near, lambda p: g.distance(p["x"], p["y"], F.col("ball_x"), F.col("ball_y"))))


def with_possession(scenes: DataFrame, *, hysteresis: float = 1.5, max_distance: float = 4.0, match: str = "match_no") -> DataFrame:
    """attacking_team: the side in possession, null until there is one.

    The nearest side within max_distance of the ball takes it first; afterwards only a side nearer than the other by
    more than hysteresis takes it over. A loose or unseen ball leaves it where it was. As two look-ups among the
    frames up to this one: the last side that was nearer by the margin, or else the first that was near at all.
    """
    home, away = _least_distance("home"), _least_distance("away")
    inf = F.lit(float("inf"))
    held = scenes.withColumns({"_h": F.coalesce(home, inf), "_a": F.coalesce(away, inf)})
    first_listed = F.get(F.transform(F.filter("players", lambda p: p["team"].isin("home", "away") & p["x"].isNotNull()), lambda p: p["team"]), F.lit(0))
    near = F.when(F.col("_h") < F.col("_a"), "home").when(F.col("_a") < F.col("_h"), "away").otherwise(first_listed)
    by, other = F.least("_h", "_a"), F.greatest("_h", "_a")
    held = held.withColumn("_any", F.when(F.col("ball_x").isNotNull() & (by <= max_distance), near))
    held = held.withColumn("_force", F.when(by + hysteresis < other, F.col("_any")))
    held = carried(held, {"_forced": (F.col("_force"), "last"), "_began": (F.col("_any"), "first")}, match=match)
    return held.withColumn("attacking_team", F.coalesce("_forced", "_began")).drop("_h", "_a", "_any", "_force", "_forced", "_began")


def gated(scenes: DataFrame, *, length: float = g.PITCH_LENGTH, width: float = g.PITCH_WIDTH) -> DataFrame:
    """Frames that can be scored, with attackers, defenders and ball turned so that the attack goes to +x.

    A frame needs a side in possession, a seen ball and two placed players on either side; others give no row. The
    attack is turned round where the defenders stand, on average, nearer x = 0 than the attackers. A missing velocity
    is a standing player. The gate is made of column expressions, so frames drop out before any Python runs.
    """
    placed = lambda side: F.filter("players", lambda p: (p["team"] == side) & p["x"].isNotNull() & p["y"].isNotNull())
    sides = scenes.where(g.is_side(F.col("attacking_team")) & F.col("ball_x").isNotNull() & F.col("ball_y").isNotNull())
    sides = settled(sides, "players").withColumns({"_att": placed(F.col("attacking_team")), "_def": placed(g.opponent(F.col("attacking_team")))})
    sides = sides.where((F.size("_att") >= 2) & (F.size("_def") >= 2))
    mean_x = lambda c: F.aggregate(c, F.lit(0.0), lambda s, p: s + p["x"]) / F.size(c)
    sides = sides.withColumn("flip", mean_x("_def") < mean_x("_att"))

    def turned(p):
        sign = F.when(F.col("flip"), -1.0).otherwise(1.0)
        zero = F.lit(0.0)
        return F.struct(
            p["ord"].alias("ord"), p["track_id"].alias("track_id"), g.flipped(p["x"], F.col("flip"), length).alias("x"), g.flipped(p["y"], F.col("flip"), width).alias("y"),
            (F.coalesce(p["vx"], zero) * sign).alias("vx"), (F.coalesce(p["vy"], zero) * sign).alias("vy"),
        )

    out = sides.withColumns({
        "attackers": F.transform("_att", turned), "defenders": F.transform("_def", turned),
        "ball_x": g.flipped(F.col("ball_x"), F.col("flip"), length), "ball_y": g.flipped(F.col("ball_y"), F.col("flip"), width),
    }).drop("_att", "_def", "players")
    return settled(out, "attackers", "defenders", "ball_x", "ball_y")


def with_offside_line(scenes: DataFrame) -> DataFrame:
    """offside_line: the second-last defender or the ball, whichever is further; null with fewer than two defenders."""
    second = F.get(F.sort_array(F.transform("defenders", lambda d: d["x"]), asc=False), F.lit(1))
    return scenes.withColumn("offside_line", F.when(second.isNotNull(), F.greatest(second, F.col("ball_x"))))


def with_carrier(scenes: DataFrame) -> DataFrame:
    """carrier_id: track id of the attacker nearest the ball, the first listed of equals."""
    near = F.transform("attackers", lambda a: F.struct(((a["x"] - F.col("ball_x")) * (a["x"] - F.col("ball_x")) + (a["y"] - F.col("ball_y")) * (a["y"] - F.col("ball_y"))).alias("d"), a["ord"].alias("ord"), a["track_id"].alias("id")))
    return scenes.withColumn("carrier_id", F.array_min(near)["id"])


def with_support(scenes: DataFrame) -> DataFrame:
    """support: array with all metrics of every attacker without the ball that compare players of the frame.

    Needs offside_line and carrier_id; lines_broken and space_owned too where defensive_lines and ownership are there.
    lane_clearance is infinite without defenders, nearest_opponent null. All attackers with the carrier's track id are
    left out. Each attacker meets the defenders once, for all metrics.
    """
    ball_x, ball_y = F.col("ball_x"), F.col("ball_y")
    nobody = F.struct(F.lit(float("inf")).alias("lane"), F.lit(None).cast("double").alias("near"), F.lit(0).alias("blockers"))

    def met(a, i):
        """Position in the list, place, and what the defenders make of it."""
        dx, dy = a["x"] - ball_x, a["y"] - ball_y
        lane = dx * dx + dy * dy

        def seen(so_far, d):
            share = F.when(lane > 1e-18, g.clamp(((d["x"] - ball_x) * dx + (d["y"] - ball_y) * dy) / lane, 0, 1)).otherwise(0.0)
            off = g.distance(d["x"], d["y"], ball_x + dx * share, ball_y + dy * share)
            return F.struct(
                F.least(so_far["lane"], off).alias("lane"), F.least(so_far["near"], g.distance(d["x"], d["y"], a["x"], a["y"])).alias("near"), (so_far["blockers"] + (off <= g.LANE_CORRIDOR).cast("int")).alias("blockers")
            )

        return F.struct(i.alias("i"), a["track_id"].alias("track_id"), a["x"].alias("x"), a["y"].alias("y"), F.aggregate("defenders", nobody, seen).alias("d"))

    def measured(m):
        d = m["d"]
        out = {
            "track_id": m["track_id"], "x": m["x"], "y": m["y"], "offside_margin": m["x"] - F.col("offside_line"), "lane_open": d["blockers"] == 0, "lane_clearance": d["lane"], "blockers": d["blockers"],
            "nearest_opponent": d["near"], "marking_pressure": g.pressure(d["near"]), "position_value": g.pitch_value(m["x"], m["y"]),
        }
        if "defensive_lines" in scenes.columns:
            out["lines_broken"] = F.size(F.filter("defensive_lines", lambda c: m["x"] > c))
        if "ownership" in scenes.columns:
            out["space_owned"] = F.get("ownership", m["i"])
        out["is_available"] = g.is_available(out["lane_open"], out["offside_margin"], out["marking_pressure"])
        return F.struct(*[c.alias(name) for name, c in out.items()])

    listed = F.filter(F.transform("attackers", met), lambda m: ~m["track_id"].eqNullSafe(F.col("carrier_id")))
    met_once = settled(settled(scenes, "offside_line", "carrier_id").withColumn("_met", listed), "_met")
    return settled(met_once.withColumn("support", F.transform("_met", measured)).drop("_met"), "support")


def supporting_players(scenes: DataFrame) -> DataFrame:
    """One row per attacker without the ball, with the metrics of with_support."""
    return with_support(scenes).select(*KEY, F.explode("support").alias("_s")).select(*KEY, "_s.*")
