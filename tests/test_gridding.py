from fieldglass.operators.gridding import regular_grid

READ = "job_id string, track_id int, frame_index int, pitch_x double, pitch_y double, stride int, status string, period int"
STEP = "job_id string, stride int, track_id int, pitch_x double"


def rows(spark, readings, strides, **kw):
    r = spark.createDataFrame([(*x, 9, "clash", 7) for x in readings], READ)
    s = spark.createDataFrame([(*x, 1, 0.0) for x in strides], STEP)
    out = regular_grid(r, s, **kw).collect()
    return sorted((x.job_id, x.track_id, x.grid_time, x.status, x.pitch_x, x.n_readings) for x in out)


def test_gap_is_filled_then_missing(spark):
    got = rows(spark, [("j", 1, 0, 1.0, 2.0), ("j", 1, 45, 5.0, 2.0)], [("j", 5)], max_gap=3)
    assert [(g[2], g[3], g[4]) for g in got] == [
        (0, "observed", 1.0), (5, "filled", 1.0), (10, "filled", 1.0), (15, "filled", 1.0),
        *[(k, "missing", None) for k in (20, 25, 30, 35, 40)], (45, "observed", 5.0),
    ]


def test_nulls_repeats_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    got = rows(
        spark,
        [("j", 1, 0, 1.0, 1.0), ("j", 1, 0, 1.0, 1.0), ("j", 1, 1, 3.0, 1.0), ("j", 1, 2, nan, 1.0), ("j", 1, 3, 1.0, None), ("j", 1, 4, inf, 1.0), ("j", 1, None, 1.0, 1.0),
         (None, 1, 0, 1.0, 1.0), ("j", None, 0, 1.0, 1.0), ("k", 1, 0, 1.0, 1.0), ("z", 1, 0, 1.0, 1.0), ("n", 1, 0, 1.0, 1.0)],
        [("j", 2), ("z", 0), ("n", None), ("j", 2), (None, 3)],
    )
    assert got == [("j", 1, 0, "observed", 2.0, 2)]


def test_blocks_do_not_change_the_result(spark):
    readings = [("j", 1, f, float(f), 0.0) for f in (0, 3, 11, 12, 31, 64, 90)] + [("j", 2, -7, 1.0, 1.0), ("j", 2, 9, 1.0, 1.0)]
    assert rows(spark, readings, [("j", 2)], block=8, max_gap=4) == rows(spark, readings, [("j", 2)], block=4096, max_gap=4)


def test_empty(spark):
    assert rows(spark, [], [("j", 1)]) == [] and rows(spark, [("j", 1, 0, 1.0, 1.0)], []) == []
