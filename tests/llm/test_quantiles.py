import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldglass.llm.quantiles import _Stack, compress, estimate, exact_summary, merge, merged_summaries, partial_summaries, quantile_summaries, summary_percentiles, value_bounds, wrong_medians

values = st.lists(st.integers(-20, 20).map(float), min_size=1, max_size=60)


@settings(max_examples=150, deadline=None)
@given(values, values, values, st.integers(2, 12))
def test_bounds_hold_after_merging_and_compressing(a, b, c, permitted):
    one = compress(merge(exact_summary(np.array(a)), exact_summary(np.array(b))), permitted)
    s = compress(merge(one, compress(exact_summary(np.array(c)), permitted)), permitted)
    truth = np.sort(np.array(a + b + c))
    assert s[2][-1] == len(truth)
    for rank in range(1, len(truth) + 1):
        low, high = value_bounds(s, rank)
        assert low <= truth[rank - 1] <= high
    _, low, high = estimate(s, 0.5)
    assert low <= np.median(truth) <= high


def test_merging_exact_summaries_is_exact():
    a, b = np.array([3.0, 1.0, 2.0, 2.0]), np.array([2.0, 5.0])
    s = merge(exact_summary(a), exact_summary(b))
    assert estimate(s, 0.5) == (2.0, 2.0, 2.0)


def test_large_groups_stay_within_the_error(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", float(v), 1) for v in rng.normal(0, 10, 30_000)] + [(None, float(v), 1) for v in range(7)] + [("one", 4.0, 1), ("none", None, 1), ("none", float("nan"), 1)]
    df = spark.createDataFrame(rows, "g string, value double, n int").repartition(9)
    got = {(r.g, r.percentile): r for r in summary_percentiles(quantile_summaries(df, ["g"], "value", error=0.005), ["g"], (0.1, 0.5, 0.99)).collect()}
    truth = np.sort([v for g, v, _ in rows if g == "hot"])
    for q in (0.1, 0.5, 0.99):
        r = got["hot", q]
        assert r.low <= np.quantile(truth, q) <= r.high
        assert (np.searchsorted(truth, r.high) - np.searchsorted(truth, r.low)) / len(truth) < 0.02
    assert got[None, 0.5].estimate == 3.0 and got["one", 0.99].estimate == 4.0 and ("none", 0.5) not in got
    assert summary_percentiles(quantile_summaries(df.limit(0), ["g"], "value"), ["g"]).collect() == []


def test_summaries_of_days_are_mergeable(spark):
    from pyspark.sql import functions as F

    days = [quantile_summaries(spark.range(d * 1000, d * 1000 + 1000).select(F.lit("g").alias("g"), "id"), ["g"], "id").withColumn("part", F.lit(d)) for d in range(3)]
    both = merged_summaries(days[0].union(days[1]).union(days[2]), ["g"], error=0.001)
    (r,) = summary_percentiles(both, ["g"]).collect()
    assert r.n == 3000 and r.low <= 1499.5 <= r.high and r.high - r.low <= 12


def test_wrong_medians_decides_exactly_where_summaries_cannot(spark):
    rng = np.random.default_rng(5)
    reads, claims, want = [], [], set()
    for track in range(12):
        v = np.round(rng.uniform(50, 150, 400), 2)
        m = float(np.median(v))
        stored = m * (1 + (0.0499, 0.0501, -0.0499, -0.0501, 0.2, 0.0)[track % 6])
        reads += [("j", track, i, float(x)) for i, x in enumerate(v)] + [("j", track, 0, float(v[0]))]
        claims.append(("j", track, stored, 1.0))
        if abs(stored - m) > 0.05 * abs(m):
            want.add(("j", track))
    reads += [("j", 0, 900, None), ("j", 0, 901, float("nan")), (None, 1, 1, 5.0)]
    claims += [("j", 99, 5.0, 1.0), ("j", 3, None, 1.0), ("j", 5, float("nan"), 1.0), (None, 1, 90.0, 1.0), claims[1]]
    scores = spark.createDataFrame(reads, "job_id string, track_id int, frame_index int, space_owned double")
    summary = spark.createDataFrame(claims, "job_id string, track_id int, median_space_owned double, low double")
    for error in (0.02, 0.001):
        assert {tuple(r) for r in wrong_medians(summary, scores, error=error).collect()} == want
    assert wrong_medians(summary, scores.limit(0)).collect() == [] and wrong_medians(summary.limit(0), scores).collect() == []


def test_equal_readings_at_the_bounds_are_counted_not_gathered(spark):
    rng = np.random.default_rng(7)
    reads, claims, want = [], [], set()
    for track in range(6):
        v = np.sort(np.concatenate([np.full(700, 100.0), rng.uniform(100, 110, 300 + 2 * track), np.full(380, 110.0), rng.uniform(20, 99, 200 + 101 * track)]))
        m = float(np.median(v))
        stored = m * (1.0499, 1.0501)[track % 2]
        reads += [("j", track, i, float(x)) for i, x in enumerate(rng.permutation(v))]
        claims.append(("j", track, stored))
        if track % 2:
            want.add(("j", track))
    scores = spark.createDataFrame(reads, "job_id string, track_id int, frame_index int, space_owned double").repartition(4)
    summary = spark.createDataFrame(claims, "job_id string, track_id int, median_space_owned double")
    found = wrong_medians(summary, scores, error=0.2)
    assert {tuple(r) for r in found.collect()} == want
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_one_row_per_partition_and_group(spark):
    df = spark.range(0, 300_000, 1, 3).selectExpr("'g' AS g", "CAST(id % 1000 AS DOUBLE) AS v")
    parts = partial_summaries(df, ["g"], "v", error=0.01, buffer=1000, fan_in=8).collect()
    assert sorted(r.part for r in parts) == [0, 1, 2] and sum(r.n for r in parts) == 300_000
    assert max(len(r.v) for r in parts) < 2000
    for r in parts:
        hi = np.array(r.rmax)
        assert np.max(hi[1:] - np.array(r.rmin)[:-1]) <= 0.01 * r.n / 2 + 1


def test_ten_thousand_parts_of_one_group_are_merged_by_fan_in(spark, monkeypatch):
    """A hot group: no merge has more than fan_in inputs, and the error holds over all levels."""
    rng = np.random.default_rng(3)
    rows, everything = [], []
    for part in range(10_000):
        v = np.sort(np.round(rng.gamma(2, 10, 12), 2))
        everything.append(v)
        rows.append(("hot" if part % 3 else None, part, 12, v.tolist(), None, None))
    schema = "g string, part int, n bigint, v array<double>, rmin array<bigint>, rmax array<bigint>"
    parts = spark.createDataFrame(rows, schema).repartition(8)
    got = merged_summaries(parts, ["g"], error=0.005, fan_in=16)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    for r in summary_percentiles(got, ["g"], (0.01, 0.5, 0.97)).collect():
        truth = np.sort(np.concatenate([v for p, v in enumerate(everything) if bool(p % 3) == (r.g == "hot")]))
        assert r.n == len(truth) and r.low <= np.quantile(truth, r.percentile) <= r.high
        assert np.searchsorted(truth, r.high, "left") - np.searchsorted(truth, r.low, "right") <= 2 * 0.005 * len(truth) + 1


def test_a_stack_never_holds_more_than_fan_in():
    rng = np.random.default_rng(9)
    stack, everything = _Stack(0.01, (0.25, 0.375, 0.5), 4), []
    for _ in range(300):
        v = rng.normal(size=500)
        everything.append(v)
        stack.add(compress(exact_summary(v), 0.01 * 0.25 * 500))
        assert all(len(level) < 4 for level in stack.levels)
    s, truth = stack.all(), np.sort(np.concatenate(everything))
    assert s[2][-1] == len(truth) and len(s[0]) < 4000
    for rank in range(1, len(truth), 997):
        low, high = value_bounds(s, rank)
        assert low <= truth[rank - 1] <= high and np.searchsorted(truth, high) - np.searchsorted(truth, low, "right") <= 0.01 * 2 * len(truth)
