import numpy as np

from fieldglass.operators.anomalies import SourceStatistics, SpikeModel, flag_sequences, implausible_readings

SCHEMA = "table_name string, job_id string, track_id int, side string, frame_index int, x double, y double, _block int, flag string"


def flags(spark, rows, model=SpikeModel()):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    return sorted((r.job_id or "", r.track_id, r.frame_index, r.flag) for r in implausible_readings(df, model).collect())


def walk(n, job="j", track=1, seed=1):
    rng = np.random.default_rng(seed)
    xy = np.cumsum(rng.normal(0.1, 0.15, (n, 2)), axis=0) + (40, 30)
    return [["t", job, track, None, 2 * i, float(a), float(b)] for i, (a, b) in enumerate(xy)]


def test_each_kind(spark):
    rows = walk(120)
    rows[30][5:] = [3.0, 70.0]
    for i in (50, 51, 52):
        rows[i][5:] = [90.0, 5.0 + i]
    for i in range(70, 77):
        rows[i][5] = rows[70][5]
    rows[100][5] = -999.0
    rows[110][6] = 90.5
    want = [("j", 1, 60, "spike"), *[("j", 1, 2 * i, "spike") for i in (50, 51, 52)], *[("j", 1, 2 * i, "stuck") for i in range(70, 77)], ("j", 1, 200, "out_of_range"), ("j", 1, 220, "out_of_range")]
    assert flags(spark, rows) == sorted(want)
    assert flags(spark, rows + rows[20:60]) == sorted(want)  # repeated rows count once
    small = SpikeModel(block=32, context=16)
    assert flags(spark, rows, small) == sorted(want)  # blocks with context decide alike


def test_ends_short_sources_and_nulls(spark):
    assert flags(spark, []) == []
    assert flags(spark, [["t", "j", 1, None, 0, 50.0, 50.0]]) == []
    assert flags(spark, [["t", "j", 1, None, 0, 50.0, 50.0], ["t", "j", 1, None, 5, 121.0, 1.0]]) == [("j", 1, 5, "out_of_range")]
    rows = walk(40, None, None)
    rows[20][5:] = [100.0, 80.0]
    assert flags(spark, rows) == [("", None, 40, "spike")]
    rows = walk(40)
    rows[0][5:] = [110.0, 5.0]  # nothing before it: the course is unknown
    assert ("j", 1, 0, "spike") not in flags(spark, rows)


def test_one_dimension_and_sides(spark):
    rows = [["f", "j", -1, side, 2 * i, 40.0 + 0.1 * i + (30 if i == 9 else 0), None] for side in ("home", "away") for i in range(30)]
    assert flags(spark, rows) == [("j", -1, 18, "spike"), ("j", -1, 18, "spike")]
    rows = [["f", "j", -1, "home", i, 40.0 if i < 6 else 41.0 + i * 0.1, None] for i in range(20)]
    assert flags(spark, rows) == [("j", -1, i, "stuck") for i in range(6)]


def test_slow_and_fast_sources_differ():
    t = np.arange(60.0)
    fast = 20 + 1.2 * t
    bumped = fast.copy()
    bumped[30] += 8  # beyond 4 m, yet within eight steps of this source
    _, flag = flag_sequences(t, bumped, np.full(60, 30.0) + t * 0.01, np.ones(60, bool), SourceStatistics.of_step(np.full(60, 1.2)), np.zeros(60))
    assert not flag.any()
    slow = 20 + 0.1 * t
    slow[30] += 8
    _, flag = flag_sequences(t, slow, np.full(60, 30.0) + t * 0.01, np.ones(60, bool), SourceStatistics.of_step(np.full(60, 0.1)), np.zeros(60))
    assert flag.nonzero()[0].tolist() == [30]


def meets_the_rule(x, flag, limit=4.0):
    calm = np.flatnonzero(flag == 0)
    for i in range(len(x)):
        a, b = calm[calm < i], calm[calm > i]
        off = len(a) and len(b) and abs(x[i] - x[a[-1]] - (i - a[-1]) / (b[0] - a[-1]) * (x[b[0]] - x[a[-1]])) > limit
        if bool(off) != (flag[i] == 1):
            return False
    return True


def test_lasting_jumps_end_in_flags_that_meet_the_rule():
    for jump in (6.0, 8.5, 10.0, 11.9, 12.5, 15.0, 21.0, 30.0):
        x = 20 + 0.1 * np.arange(60) + np.where(np.arange(60) >= 30, jump, 0.0)
        _, flag = flag_sequences(np.arange(60.0), x, np.full(60, 30.0) + 0.01 * np.arange(60), np.ones(60, bool), SourceStatistics.of_step(np.full(60, 0.1)), np.zeros(60))
        assert set(flag.tolist()) <= {0, 1} and meets_the_rule(x, flag), jump
        if 8.5 <= jump < 12:
            assert flag.sum() == 1 and flag[29:31].any()


def test_noisy_series_end_and_meet_the_rule():
    """300 series of 400 readings with 5 to 50 % displaced by 3 to 9 m: simultaneous sweeps alone cycle on many of them."""
    rng = np.random.default_rng(11)
    open_readings = 0
    for i in range(300):
        x = 20 + np.cumsum(rng.normal(0.02, 0.1, 400)) + np.where(rng.random(400) < 0.05 + 0.0015 * i, rng.choice([-1, 1], 400) * rng.uniform(3, 9, 400), 0.0)
        step = np.median(np.abs(np.diff(x)))
        _, flag = flag_sequences(np.arange(400.0), x, np.zeros(400), np.zeros(400, bool), SourceStatistics.of_step(np.full(400, step)), np.zeros(400))
        open_readings += int((flag == 4).sum())
        if (flag < 2).all() and (x >= 0).all():
            calm = flag == 0
            assert calm[0] and calm[-1]
    assert open_readings <= 0.002 * 300 * 400


def test_flags_need_the_model():
    """Bounds and rule decide only about readings that the posteriors put forward."""
    x = 20 + 0.1 * np.arange(60)
    x[20:28] = x[20]
    x[40], x[50] = 130.0, 60.0
    args = (np.arange(60.0), x, np.zeros(60), np.zeros(60, bool), SourceStatistics.of_step(np.full(60, 0.1)), np.zeros(60))
    gamma, flag = flag_sequences(*args)
    assert flag[20:28].tolist() == [2] * 8 and flag[40] == 3 and flag[50] == 1 and (flag > 0).sum() == 10
    assert gamma[20:28, 2].min() > 0.9 and gamma[40, 3] > 0.8 and gamma[50, 1] > 0.9
    assert not flag_sequences(*args, SpikeModel(candidate_probability=1.1))[1][[20, 40]].any()


def test_where_blocks_end_does_not_matter(spark):
    """A source of 20,000 readings, with spikes and with stuck stretches longer than block and context."""
    rng = np.random.default_rng(5)
    n = 20_000
    x, y = 50 + 20 * np.sin(np.arange(n) / 300) + rng.normal(0, 0.05, n), 40 + 20 * np.cos(np.arange(n) / 500) + rng.normal(0, 0.05, n)
    x[rng.choice(n, 200, replace=False)] += 15
    x[5000:6500] = x[5000]
    x[6501] += 20
    y[12_000:12_900] = y[12_000]
    rows = [["t", "j", 1, None, 2 * i, float(a), float(b)] for i, (a, b) in enumerate(zip(x, y))]
    small, large = flags(spark, rows, SpikeModel(block=512, context=64)), flags(spark, rows, SpikeModel(block=8192))
    assert small == large and len(large) > 2000 and ("j", 1, 2 * 6501, "spike") in large


def test_query_is_consistent_with_the_rule_on_every_reading(spark, sf):
    """Brute force over all readings: a reading is flagged iff the rule, given the other flags, says so."""
    import duckdb

    from fieldglass.plans.problems import p3_found

    flagged = {tuple(r) for r in p3_found(spark, sf).collect()}
    readings = duckdb.sql(f"""
        SELECT 'player_frame_score' AS t, job_id, track_id, '' AS side, frame_index AS f, any_value(pitch_x) AS x, any_value(pitch_y) AS y FROM '{sf}/player_frame_score.parquet' WHERE isfinite(pitch_x) AND isfinite(pitch_y) GROUP BY ALL
        UNION ALL SELECT 'frame_score', job_id, -1, attacking_side, frame_index, any_value(offside_line), NULL FROM '{sf}/frame_score.parquet' WHERE isfinite(offside_line) GROUP BY ALL ORDER BY 1, 2, 3, 4, 5""").fetchdf()
    checked = 0
    for (t, job, track, _), own in readings.groupby(["t", "job_id", "track_id", "side"], sort=False):
        f, x = own.f.to_numpy(float), own.x.to_numpy()
        y = own.y.fillna(0.0).to_numpy()
        n = len(f)
        step = np.hypot(np.diff(x), np.diff(y))
        limit = max(4.0, 8 * np.median(step)) if n > 1 else 4.0
        case = np.array([(t, job, int(track), int(k)) in flagged for k in own.f])
        hard = (x < 0) | (x > 120) | (y < 0) | (y > 90)
        for v in (x, y) if t == "player_frame_score" else (x,):
            for i in range(n - 5):
                if (v[i : i + 6] == v[i]).all():
                    hard[i : i + 6] = True
        calm = np.flatnonzero(~case)
        for i in range(n):
            before, after = calm[calm < i], calm[calm > i]
            off = False
            if len(before) and len(after):
                a, b = before[-1], after[0]
                w = (f[i] - f[a]) / (f[b] - f[a])
                off = np.hypot(x[i] - x[a] - w * (x[b] - x[a]), y[i] - y[a] - w * (y[b] - y[a])) > limit
            assert case[i] == (hard[i] or off), (t, job, track, f[i])
            checked += 1
    assert checked > 2000 and flagged
