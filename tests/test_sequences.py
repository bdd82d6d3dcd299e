import itertools

import numpy as np
import pytest

from fieldglass.operators.ball import BallConfig, best_candidate, best_path, interpolate, reject_outliers, repair, smooth
from fieldglass.operators.calibration import calibrate_annotations, fitted_lines, ground_truth, tail_summary, with_truth_error
from fieldglass.operators.stitching import best_first_matching, candidate_links, chain_heads, relabel, track_extents
from fieldglass.operators.teams import dominant_colours, goalkeepers, kit_profiles

TRACK = "match_no bigint, frame_index int, x double, y double"


def track(spark, xs, y=0.0, match=1):
    return spark.createDataFrame([(match, i, None if x is None else float(x), None if x is None else y) for i, x in enumerate(xs)], TRACK)


def xs(df):
    return [r.x for r in df.orderBy("frame_index").collect()]


def test_outliers_against_the_last_accepted(spark):
    assert xs(reject_outliers(track(spark, [0, 0.3, 90, 0.9, None, 90.5, 1.5]))) == [0, 0.3, None, 0.9, None, None, 1.5]
    assert xs(reject_outliers(track(spark, [0, 1.2]))) == [0, 1.2]  # a shot of 30 m/s stays
    assert reject_outliers(track(spark, [])).count() == 0


def test_gaps(spark):
    got = xs(interpolate(track(spark, [None] * 20 + [10, None, None, 13] + [None] * 4 + [20]), config=BallConfig(max_gap=3, max_extrapolate=3)))
    assert got[16] is None and got[17] == 10 and got[21:23] == [11, 12] and got[24:28] == [None] * 4
    assert xs(interpolate(track(spark, [None, None]))) == [None, None]
    assert xs(interpolate(track(spark, [1.0, None, None]), config=BallConfig(max_extrapolate=1))) == [1.0, 1.0, None]


def test_smoothing_stays_within_runs(spark):
    assert xs(smooth(track(spark, [0, 3, 6, None, 100, 106]), config=BallConfig(smoothing_window=3))) == [1.5, 3, 4.5, None, 103, 103]


def test_repair_of_a_straight_course(spark):
    rng = np.random.default_rng(3)
    truth = [0.3 * i for i in range(200)]
    seen = [None if rng.random() < 0.3 else t for t in truth]
    seen[50], seen[120] = 90.0, -40.0
    got = xs(repair(track(spark, seen)))
    assert max(abs(a - b) for a, b in zip(got, truth) if a is not None) < 1.5 and sum(g is not None for g in got) > 190


def brute_path(lists, config=BallConfig(), dt=0.04):
    best = None
    for path in itertools.product(*[range(len(c) + 1) for c in lists]):
        cost = 0.0
        for i, j in enumerate(path):
            real = j < len(lists[i])
            cost += 1 - lists[i][j][2] if real else config.missing_cost
            if i and real and path[i - 1] < len(lists[i - 1]):
                a, b = lists[i - 1][path[i - 1]], lists[i][j]
                d = float(np.hypot(a[0] - b[0], a[1] - b[1]))
                cost += np.inf if d / dt > config.max_speed else config.metre_cost * d
        if best is None or cost < best[0] - 1e-12:
            best = (cost, path)
    return [lists[i][j][0] if j < len(lists[i]) else None for i, j in enumerate(best[1])]


def test_best_path_against_all_paths(spark):
    rng = np.random.default_rng(11)
    for case in range(4):
        lists = [[(float(rng.uniform(0, 4)), float(rng.uniform(0, 4)), float(rng.uniform(0, 1))) for _ in range(rng.integers(0, 3))] for _ in range(7)]
        rows = [(1, f, o, *c) for f, own in enumerate(lists) for o, c in enumerate(own)]
        candidates = spark.createDataFrame(rows, "match_no bigint, frame_index int, ord int, x double, y double, confidence double")
        assert xs(best_path(candidates, track(spark, [None] * 7))) == brute_path(lists)
    assert best_path(candidates.limit(0), track(spark, [None] * 3)).where("x is not null").count() == 0


def test_best_candidate_takes_the_first_of_equals(spark):
    rows = [(1, 0, 2, 5.0, 0.0, 0.8), (1, 0, 1, 4.0, 0.0, 0.8), (1, 0, 0, 3.0, 0.0, 0.1)]
    (r,) = best_candidate(spark.createDataFrame(rows, "match_no bigint, frame_index int, ord int, x double, y double, confidence double")).collect()
    assert r.x == 4.0


SPAN = "job_id string, track_id int, first_frame int, last_frame int, first_x double, first_y double, last_x double, last_y double, last_vx double, last_vy double, team string"


def links(spark, spans, fps=25.0):
    rates = spark.createDataFrame([("j", fps)], "job_id string, fps double")
    df = spark.createDataFrame([("j", i, a, b, x0, 0.0, x1, 0.0, v, 0.0, t) for i, a, b, x0, x1, v, t in spans], SPAN)
    return candidate_links(df, rates)


def pairs(df):
    return sorted((r.pred, r.succ) for r in df.collect())


def test_links(spark):
    ok = (1, 0, 9, 0.0, 1.0, 4.0, "home")
    assert pairs(links(spark, [ok, (2, 14, 23, 1.8, 3.0, 0.0, "home")])) == [(1, 2)]
    assert pairs(links(spark, [ok, ok, (2, 14, 23, 1.8, 3.0, None, "unknown")])) == [(1, 2)]
    for other in [(2, 5, 23, 1.8, 3.0, 0.0, "home"), (2, 9, 23, 1.8, 3.0, 0.0, "home"), (2, 124, 140, 1.8, 3.0, 0.0, "home"), (2, 14, 23, 40.0, 41.0, 0.0, "home"), (2, 14, 23, 1.8, 3.0, 0.0, "away"), (2, 14, 3, 1.8, 3.0, 0.0, "home")]:
        assert pairs(links(spark, [ok, other])) == []
    assert pairs(links(spark, [ok, (2, 14, 23, 1.8, 3.0, 0.0, "home")], 0.0)) == [] and pairs(links(spark, [])) == []


def greedy(rows):
    used_p, used_s, out = set(), set(), []
    for _, p, s in sorted(rows):
        if p not in used_p and s not in used_s:
            used_p.add(p)
            used_s.add(s)
            out.append((p, s))
    return sorted(out)


def test_matching_and_chains_equal_one_by_one(spark):
    rng = np.random.default_rng(5)
    rows = list({(int(p), int(s)): (float(rng.integers(0, 9)), int(p), int(s)) for p, s in rng.integers(0, 40, (150, 2)) if p < s}.values())
    df = spark.createDataFrame([("j", p, s, d) for d, p, s in rows], "job_id string, pred int, succ int, distance double")
    matched = best_first_matching(df)
    want = greedy(rows)
    assert pairs(matched) == want
    back = dict((s, p) for p, s in want)

    def head(t):
        while t in back:
            t = back[t]
        return t

    heads = chain_heads(matched)
    assert sorted((r.track_id, r.canonical_id) for r in heads.collect()) == sorted((s, head(s)) for s in back)
    obs = spark.createDataFrame([("j", 0, 1), ("j", max(back), 2), ("k", 3, 3)], "job_id string, track_id int, frame_index int")
    assert sorted((r.job_id, r.track_id) for r in relabel(obs, heads).collect()) == sorted([("j", head(0)), ("j", head(max(back))), ("k", 3)])
    assert chain_heads(best_first_matching(df.limit(0))).count() == 0


def test_extents_take_the_first_seen_of_equal_teams(spark):
    rows = [(1, f, 5, t, x, 0.0, None, None) for f, t, x in ((0, "away", None), (1, "home", 1.0), (2, "away", 2.0), (3, "away", 3.0), (4, "home", 4.0))]
    (r,) = track_extents(spark.createDataFrame(rows, "match_no bigint, frame_index int, track_id int, team string, x double, y double, vx double, vy double")).collect()
    assert (r.first_frame, r.last_frame, r.first_x, r.last_x, r.team, r.observations, r.last_vx) == (1, 4, 1.0, 4.0, "home", 4, 0.0)


def test_tails_truth_and_ground_truth(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(10)] + [("b", 1.0), ("b", None)], "k string, v double")
    got = {r.k: (r.n, r["median"], r.p90, r.worst) for r in tail_summary(df, ["k"], "v").collect()}
    assert got == {"a": (10, 4.5, 9.0, 9.0), "b": (1, 1.0, 1.0, 1.0)}
    eye, moved, flat = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [1.0, 0.0, 3.0, 0.0, 1.0, 4.0, 0.0, 0.0, 1.0], [0.0] * 9
    pair = spark.createDataFrame([(1, eye, eye), (2, moved, eye), (3, eye, flat), (4, None, eye)], "i int, e array<double>, t array<double>")
    assert {r.i: r.truth_error for r in with_truth_error(pair, "e", "t").collect()} == {1: 0.0, 2: 5.0, 3: None, 4: None}
    rows = ground_truth(spark.createDataFrame([("[[1,0,0,0,1,0,0,0,1], null]",)], "json string")).collect()
    assert [r.h for r in rows] == [eye, None]
    with pytest.raises(Exception, match="nine elements"):
        ground_truth(spark.createDataFrame([("[[1,2]]",)], "json string")).collect()


def test_lines_and_annotated_images(spark):
    pts = spark.createDataFrame([("v", 3.0, float(i)) for i in range(5)] + [("d", float(i), 2.0 * i + 1) for i in range(5)] + [("one", 1.0, 1.0)], "k string, x double, y double")
    got = {r.k: (r.a, r.b, r.c) for r in fitted_lines(pts, ["k"]).collect()}
    assert set(got) == {"v", "d"}
    for k, (x, y) in {"v": (3.0, 9.0), "d": (10.0, 21.0)}.items():
        a, b, c = got[k]
        assert a * x + b * y == pytest.approx(c)
    h = np.array([[9.5, 2.1, 180], [-0.4, 6.2, 90], [-0.0012, 0.0041, 1]])
    image = lambda x, y: (h @ [x, y, 1])[:2] / (h @ [x, y, 1])[2]
    rows = []
    for name, ends in {"Side line left": ((0, 5), (0, 60)), "Middle line": ((52.5, 5), (52.5, 60)), "Side line top": ((5, 0), (90, 0)), "Big rect. left bottom": ((0, 54.16), (16.5, 54.16)), "Circle central": ((50, 30), (55, 40))}.items():
        for e in ends:
            u, v = image(*e)
            rows.append(("img", name, float(u / 1919), float(v / 1079)))
    rows += [("few", *r[1:]) for r in rows[:4]]
    (fit,) = calibrate_annotations(spark.createDataFrame(rows, "image_id string, class string, x double, y double"), 1920, 1080).collect()
    u, v = image(30.0, 20.0)
    back = np.array(fit.h).reshape(3, 3) @ [u, v, 1]
    assert fit.image_id == "img" and back[:2] / back[2] == pytest.approx([30, 20], abs=1e-6)


def test_kits_and_goalkeepers(spark):
    pixels = [("a", 1, 200.0, 20.0, 20.0)] * 10 + [("a", 1, 20.0, 200.0, 20.0)] * 20 + [("a", 2, 20.0, 200.0, 20.0)] * 30
    (crop,) = dominant_colours(spark.createDataFrame(pixels, "match_no string, crop int, r double, g double, b double"), ["match_no", "crop"]).collect()
    assert (crop.crop, crop.r) == (1, 200.0)
    colours = [("m", float(v), float(v), float(v)) for v in (10, 12, 11, 200, 205, 202)] + [("few", 1.0, 1.0, 1.0), ("m", None, 1.0, 1.0)]
    (kit,) = kit_profiles(spark.createDataFrame(colours, "match_no string, r double, g double, b double")).collect()
    assert kit.home_r == 11 and kit.away_r == pytest.approx(202.333, abs=0.01) and kit.is_reliable
    places = [("m", 1, "home", 3.0), ("m", 1, "home", 5.0), ("m", 2, "away", 100.0), ("m", 3, "home", 2.0), ("m", 3, "home", 60.0), ("solo", 1, "home", 1.0), ("m", 4, "home", None)]
    got = goalkeepers(spark.createDataFrame(places, "match_no string, track_id int, team string, x double"))
    assert sorted((r.track_id, r.team) for r in got.collect()) == [(1, "home"), (2, "away")]


def test_nearest_kit(spark):
    from pyspark.sql import functions as F

    from fieldglass.operators.teams import nearest_kit

    rows = [(10.0, 10.0, 10.0), (190.0, 190.0, 190.0), (100.0, 100.0, 100.0)]
    df = spark.createDataFrame([(*r, 0.0, 0.0, 0.0, 200.0, 200.0, 200.0) for r in rows], "r double, g double, b double, home_r double, home_g double, home_b double, away_r double, away_g double, away_b double")
    got = [r[0] for r in df.orderBy("r").select(nearest_kit(F.col("r"), F.col("g"), F.col("b"))).collect()]
    assert got == ["home", "home", "away"]


def test_goalkeepers_by_length_of_the_pitch(spark):
    places = [(m, t, side, x, length) for m, length in (("long", 120.0), ("short", 90.0), ("unknown", None)) for t, side, x in ((4, "home", 12.0), (9, "away", 97.0), (5, "home", 50.0))]
    df = spark.createDataFrame(places, "match_no string, track_id int, team string, x double, length double")
    got = {(r.match_no, r.track_id) for r in goalkeepers(df, length="length").collect()}
    assert got == {("long", 4), ("short", 9)}
    assert {r.track_id for r in goalkeepers(df.where("match_no = 'short'")).collect()} == {4, 9}
    assert goalkeepers(df.limit(0), length="length").count() == 0
