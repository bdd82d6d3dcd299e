import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldglass.operators.control import Grid, with_space
from fieldglass.operators.scenes import assemble, gated, with_possession
from fieldglass.schemas import Rule, duplicate_keys, table_rules, violations
from fieldglass.session import Materialised, clear_scratch, materialise, shared_dir
from fieldglass.sources.tables import annotated_images, camel_case, image_files, report_json, sample_frames, shown, write_tracking
from fieldglass.sources.tracking import marking_polylines, pitch_landmarks


def test_images_keep_their_order_and_missing_notes(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"im{i}.png").write_bytes(bytes([i]))
    (tmp_path / "im0.json").write_text('{"a": 1}')
    (tmp_path / "im2.json").write_text("not json")
    assert [r.stem for r in image_files(spark, str(tmp_path), stride=2).orderBy("i").collect()] == ["im0", "im2", "im4"]
    got = {r.stem: r.annotation for r in annotated_images(spark, str(tmp_path), "a int").collect()}
    assert set(got) == {f"im{i}" for i in range(5)} and got["im0"].a == 1 and got["im1"] is None and (got["im2"] is None or got["im2"].a is None)


def test_sampling(spark):
    frames = spark.range(20).select(F.col("id").cast("int").alias("frame_index"))
    assert [r[0] for r in sample_frames(frames, stride=5, start=2).orderBy("frame_index").collect()] == [2, 7, 12, 17]
    assert [r[0] for r in sample_frames(frames, stride=5, start=2, limit=2).collect()] == [2, 7]
    with pytest.raises(ValueError):
        sample_frames(frames, stride=0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", 1, 2, 62.5), ("n", 1, 3, None)], "match_id string, frame_index int, track_id int, pitch_x double")
    write_tracking(df, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.where("match_id = 'n'").count() == 1 and (tmp_path / "t" / "match_id=m").exists()
    assert json.loads(report_json(df).orderBy("report").collect()[0][0])["match_id"] == "m"
    assert camel_case(df).columns == ["matchId", "frameIndex", "trackId", "pitchX"]
    assert sorted(r[0] for r in df.select(shown("pitch_x")).collect()) == ["63", "n/a"]


def test_rules_of_jobs(spark):
    rows = [("failed", None, 25.0, 1, 0.5, 0.5, 10, 11), (" FAILED", "lost", 0.0, 0, 1.5, None, -1, -2), (None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "status string, error string, fps double, stride int, progress double, coverage double, frames_total int, frames_scored int")
    got = {r.rule: r.n_violations for r in violations(df, table_rules()["analysis_job"]).collect()}
    assert got == {"fps_positive": 1, "stride_positive": 1, "progress_is_share": 1, "coverage_is_share": 0, "frames_total_not_negative": 1, "frames_scored_not_negative": 1, "scored_within_total": 1, "failure_explained": 1}
    empty = violations(df.limit(0), table_rules()["analysis_job"]).collect()
    assert {(r.n_rows, r.n_violations) for r in empty} == {(0, 0)}


def test_rules_and_keys(spark):
    df = spark.createDataFrame([(1, 5), (1, -5), (2, None)], "k int, v int")
    assert [tuple(r) for r in violations(df, [Rule("positive", F.col("v") > 0), Rule("small", F.col("v") < 9)]).collect()] == [("positive", 3, 1), ("small", 3, 0)]
    assert [tuple(r) for r in duplicate_keys(df, ["k"]).collect()] == [(1, 2)]


def test_scratch(spark):
    df = spark.range(5).toDF("v")
    held = Materialised(df, "x")
    assert held.path.startswith(shared_dir(spark)) and held.df.count() == 5
    held.drop()
    with pytest.raises(Exception):
        held.df.count()
    assert materialise(df.limit(0), "empty").collect() == []
    clear_scratch(spark)


def test_markings(spark):
    names = dict((n, (x, y)) for n, x, y in pitch_landmarks())
    assert names["left_spot"] == (11.0, 34.0) and names["right_penalty_near"] == (88.5, pytest.approx(13.84)) and len(names) == len(pitch_landmarks())
    rows = marking_polylines(spark).groupBy("marking").agg(F.min("x"), F.max("x"), F.count("x")).collect()
    got = {r[0]: tuple(r)[1:] for r in rows}
    assert got["halfway"] == (52.5, 52.5, 65) and got["circle"][2] == 65 and got["left_arc"][0] >= 16.5 and got["right_arc"][1] <= 88.5


def synthetic_move(spark, frames: int = 120, fps: float = 25.0):
    """(observations, frames) of a made-up attack for tests: five home players advancing, seven away holding, and a ball."""
    f = spark.range(frames).select(F.lit(0).cast("bigint").alias("match_no"), F.col("id").cast("int").alias("frame_index"))
    start = [("home", 101, 8.0, 34.0, 0.2), ("home", 102, 45.0, 20.0, 2.5), ("home", 103, 48.0, 48.0, 2.0), ("home", 104, 55.0, 30.0, 4.0), ("home", 105, 58.0, 40.0, 5.0)]
    start += [("away", 201 + i, 65.0 + 5 * (i % 3), 12.0 + 7.5 * i, -0.3) for i in range(6)] + [("away", 207, 101.0, 34.0, 0.0)]
    names = ("team", "track_id", "x0", "y0", "speed")
    players = F.array(*[F.struct(F.lit(i).alias("ord"), *[F.lit(v).alias(n) for n, v in zip(names, p)]) for i, p in enumerate(start)])
    t = F.col("frame_index") / fps
    moving = f.withColumn("p", F.explode(players)).select("match_no", "frame_index", "p.ord", "p.track_id", "p.team", (F.col("p.x0") + F.col("p.speed") * t).alias("x"), F.col("p.y0").alias("y"))
    line = Window.partitionBy("track_id").orderBy("frame_index")
    rate = lambda c: F.coalesce((F.col(c) - F.lag(c).over(line)) * fps, F.lit(0.0))
    ball = f.select("*", (46.0 + 2.5 * t).alias("ball_x"), F.lit(21.0).alias("ball_y"))
    return moving.withColumns({"vx": rate("x"), "vy": rate("y")}), ball


def test_synthetic_move_can_be_scored(spark):
    players, frames = synthetic_move(spark, 20)
    scored = with_space(gated(with_possession(assemble(players, frames))), Grid(21, 14))
    rows = scored.collect()
    assert len(rows) == 20 and all(0 < r.team_space < 7140 and r.attacking_team == "home" for r in rows)
