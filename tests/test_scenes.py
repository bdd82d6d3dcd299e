import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.operators.control import Grid, with_space
from fieldglass.operators.ordered import carried
from fieldglass.operators.scenes import assemble, gated, supporting_players, with_carrier, with_offside_line, with_possession, with_velocity

OBS = "match_no bigint, frame_index int, ord int, track_id int, team string, x double, y double, vx double, vy double, extra string"
FRAMES = "match_no bigint, frame_index int, ball_x double, ball_y double, attacking_team string"


def lined_up(spark, text, ball, side="home"):
    """Gated scenes of one frame written as 'h7 60 20, a3 80 30, ...': side, shirt and place of every player; '-' is an unknown number."""
    number = lambda v: None if v == "-" else float(v)
    rows = []
    for i, entry in enumerate(text.split(",")):
        shirt, x, y = entry.split()
        rows.append((7, 3, i, int(shirt[1:]) + (500 if shirt[0] == "a" else 0), {"h": "home", "a": "away"}[shirt[0]], number(x), number(y), None, None, "more"))
    frames = spark.createDataFrame([(7, 3, *map(number, ball.split()), side)], FRAMES)
    return gated(assemble(spark.createDataFrame(rows, OBS), frames))


def supporters(scenes):
    return {r.track_id: r for r in supporting_players(with_carrier(with_offside_line(scenes))).collect()}


@pytest.mark.parametrize("ball,want", [("33 20", 71.5), ("80 20", 80.0)])
def test_offside_line_is_second_last_defender_or_ball(spark, ball, want):
    scenes = lined_up(spark, "h1 30 12, h2 31 50, a1 4 33, a2 64 20, a3 71.5 44, a4 77 29", ball)
    assert [r.offside_line for r in with_offside_line(scenes).collect()] == [want]


def test_margins_are_signed_and_the_carrier_has_none(spark):
    got = supporters(lined_up(spark, "h9 88 20, h8 51 44, h6 22 30, a2 79 31, a5 83 12, a6 90 60", "21 31"))
    assert {t: r.offside_margin for t, r in got.items()} == {9: 5.0, 8: -32.0}


def test_lanes(spark):
    closed = supporters(lined_up(spark, "h4 5 9, h7 35 9, a1 18 9.7, a2 97 61", "5 9"))[7]
    assert not closed.lane_open and closed.blockers == 1 and closed.lane_clearance == pytest.approx(0.7)
    past = supporters(lined_up(spark, "h4 14 9, h7 44 9, a1 6 9, a2 97 61", "14 9"))[7]
    assert past.lane_open and past.blockers == 0 and past.lane_clearance == pytest.approx(8.0)


@pytest.mark.parametrize(
    "players,ball,side",
    [
        ("h1 9 9, h2 12 40, a1 60 8", "10 10", "home"),
        ("h1 9 9, h2 - 40, a1 60 8, a2 61 9", "10 10", "home"),
        ("h1 9 9, h2 12 40, a1 60 8, a2 61 9", "- -", "home"),
        ("h1 9 9, h2 12 40, a1 60 8, a2 61 9", "10 10", None),
        ("h1 9 9, h2 12 40, a1 60 8, a2 61 9", "10 10", "referee"),
    ],
)
def test_frames_that_cannot_be_scored_give_no_row(spark, players, ball, side):
    assert lined_up(spark, players, ball, side).count() == 0


def test_a_half_turn_of_the_pitch_changes_nothing(spark):
    rng = np.random.default_rng(8)
    places = [(f"h{i}", *np.round(rng.uniform((15, 5), (60, 60)), 1)) for i in range(4)] + [(f"a{i}", *np.round(rng.uniform((50, 5), (100, 60)), 1)) for i in range(4)]
    ball = (places[0][1] + 1, places[0][2])
    out = []
    for turn in (lambda x, y: (x, y), lambda x, y: (105 - x, 68 - y)):
        text = ", ".join("{} {} {}".format(name, *turn(x, y)) for name, x, y in places)
        scored = with_space(with_carrier(with_offside_line(lined_up(spark, text, "{} {}".format(*turn(*ball))))), Grid(21, 14))
        frame = scored.collect()[0]
        rows = {r.track_id: (r.offside_margin, r.lane_clearance, r.space_owned, r.lines_broken) for r in supporting_players(scored).collect()}
        out.append(([frame.offside_line, frame.team_dangerous_space, frame.attacking_hull, frame.defending_hull], rows))
    assert out[0][0] == pytest.approx(out[1][0], abs=1e-6) and set(out[0][1]) == set(out[1][1]) == {1, 2, 3}
    assert all(out[0][1][t] == pytest.approx(out[1][1][t], abs=1e-6) for t in out[0][1])


def test_possession_passes_over_chunks(spark):
    """The look-up among earlier frames is the same whatever chunks the frames are ordered in."""
    rng = np.random.default_rng(2)
    rows = [(m, f, None if rng.random() < 0.7 else int(rng.integers(0, 5)), int(rng.integers(0, 3))) for m in (1, None) for f in range(0, 400, 3)]
    df = spark.createDataFrame(rows, "match_no bigint, frame_index int, v int, w int")
    ways = {"last_v": (F.col("v"), "last"), "first_v": (F.col("v"), "first"), "next_v": (F.col("v"), "next"), "sum_w": (F.col("w"), "sum")}
    got = {chunk: sorted(map(str, carried(df, ways, chunk=chunk).collect())) for chunk in (7, 50, 10_000)}
    assert got[7] == got[50] == got[10_000]
    for m in (1, None):
        own = [r for r in rows if r[0] == m]
        for r in carried(df, ways, chunk=50).where(F.col("match_no").eqNullSafe(F.lit(m))).collect():
            upto, on = [x for x in own if x[1] <= r.frame_index], [x for x in own if x[1] >= r.frame_index]
            known = [x[2] for x in upto if x[2] is not None]
            assert (r.last_v, r.first_v) == ((known[-1], known[0]) if known else (None, None))
            assert r.next_v == next((x[2] for x in on if x[2] is not None), None) and r.sum_w == sum(x[3] for x in upto)


def test_possession_with_hysteresis(spark):
    home, away = (50.0, 30.0), (54.0, 30.0)
    balls = [None, (50.0, 30.0), (52.4, 30.0), (52.9, 30.0), (85.0, 30.0), None, (50.5, 30.0)]
    obs = [(1, f, o, 100 + o, t, *p, None, None, "e") for f in range(len(balls)) for o, (t, p) in enumerate((("home", home), ("away", away), ("referee", (50.0, 30.0)), ("unknown", (50.0, 30.0))))]
    frames = spark.createDataFrame([(1, f, *(b or (None, None)), None) for f, b in enumerate(balls)], FRAMES).drop("attacking_team")
    got = with_possession(assemble(spark.createDataFrame(obs, OBS), frames)).orderBy("frame_index").collect()
    assert [r.attacking_team for r in got] == [None, "home", "home", "away", "away", "away", "home"]


def test_velocity_counts_observations_not_frames(spark):
    obs = [(1, f, 0, 1, "home", float(f), 0.0, None, None, "e") for f in (0, 10, 20, 30, 40, 50)] + [(1, 5, 0, 1, "home", None, 0.0, None, None, "e")]
    rows = with_velocity(spark.createDataFrame(obs, OBS).drop("vx", "vy")).orderBy("frame_index").collect()
    assert [(r.frame_index, r.vx) for r in rows] == [(0, 0.0), (5, None), (10, 25.0), (20, 25.0), (30, 25.0), (40, 25.0), (50, 25.0)]


def test_empty_tables(spark):
    obs, frames = spark.createDataFrame([], OBS), spark.createDataFrame([(1, 0, 1.0, 1.0, "home")], FRAMES)
    assert [len(r.players) for r in assemble(obs, frames).collect()] == [0]
    assert with_space(gated(assemble(obs, frames))).count() == 0
    assert with_possession(assemble(obs, frames.drop("attacking_team"))).select("attacking_team").collect()[0][0] is None


def test_clearance_without_lanes_and_pressure_without_opponents(spark):
    from fieldglass.functions import geometry as g

    row = spark.range(1).select(g.pressure(F.lit(None).cast("double")).alias("p"), g.is_offside(F.lit(None).cast("double")).alias("o")).collect()[0]
    assert (row.p, row.o) == (0.0, False) and math.isinf(float("inf"))
