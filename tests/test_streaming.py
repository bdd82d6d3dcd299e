import pytest
from pyspark.sql import functions as F

from fieldglass.operators.calibration import calibrate, gate_calibrations
from fieldglass.operators.scenes import assemble, with_possession, with_velocity
from fieldglass.operators.teams import running_votes
from fieldglass.operators.tracking import track_detections
from fieldglass.plans import sequences as sq
from fieldglass.sources.tracking import tracking_from_events
from fieldglass.streaming import folds


def through(spark, tmp_path, df, make, name):
    """Write df in three micro-batches by frame, run the stream over them, and give what it emitted."""
    step = 16
    for part in range(3):
        low, high = part * step, (part + 1) * step if part < 2 else 10**6
        piece = df.where((F.col("frame_index") >= low) & (F.col("frame_index") < high)).orderBy(F.rand(part)).coalesce(1)
        piece.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def same(a, b, columns):
    rows = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.select(*columns).collect())
    assert rows(a) == rows(b) and a.count()


def test_velocity(spark, sf, tmp_path):
    players, _ = tracking_from_events(spark, sf)
    got = through(spark, tmp_path, players, folds.velocity_stream, "vel")
    same(got, with_velocity(players), ["match_no", "frame_index", "track_id", "vx", "vy"])


def test_possession(spark, sf, tmp_path):
    players, frames = tracking_from_events(spark, sf)
    rows = players.join(frames, ["match_no", "frame_index"])
    got = through(spark, tmp_path, rows, folds.possession_stream, "pos")
    same(got, with_possession(assemble(players, frames)), ["match_no", "frame_index", "attacking_team"])


def test_votes(spark, sf, tmp_path):
    players, _ = tracking_from_events(spark, sf)
    votes = players.withColumn("vote", F.when(F.col("frame_index") % 3 == 0, "away").when(F.col("frame_index") % 7 != 1, F.col("team"))).drop("team")
    same(through(spark, tmp_path, votes, folds.vote_stream, "vot"), running_votes(votes), ["match_no", "frame_index", "track_id", "team"])


def test_tracks(spark, sf, tmp_path):
    boxes = sq._boxes(spark, sf).withColumn("confidence", F.greatest("confidence", F.lit(0.5)))
    got = through(spark, tmp_path, boxes, folds.track_stream, "trk")
    _, frames = tracking_from_events(spark, sf)
    same(got, track_detections(boxes, frames), ["match_no", "frame_index", "track_id", "x1", "confidence"])


def test_gate(spark, sf, tmp_path):
    fits = calibrate(sq._keypoints(spark, sf)).withColumn("h", F.when(F.col("frame_index") % 5 != 3, F.col("h"))).select("match_no", "frame_index", "h")
    got = through(spark, tmp_path, fits, folds.gate_stream, "gat")
    same(got, gate_calibrations(fits), ["match_no", "frame_index", "status"])


def test_ball_holds_and_late_frames_are_marked():
    fold = folds.BallFold(config=folds.BallConfig(max_gap=2))
    import pandas as pd

    steps = [(0, 10.0), (1, 90.0), (2, None), (3, None), (4, None), (5, 12.0)]
    got = [fold.step(f, pd.DataFrame({"x": [x], "y": [0.0]}))[0] for f, x in steps]
    assert got == [(10.0, 0.0, "seen"), (10.0, 0.0, "rejected"), (10.0, 0.0, "missing"), (None, None, "missing"), (None, None, "missing"), (12.0, 0.0, "seen")]
    assert folds.BallFold(fold.state()).last == [5, 12.0, 0.0] and fold.rejected == 1


def test_late_rows(spark, tmp_path):
    schema = "match_no bigint, frame_index int, x double, y double"
    for rows in ([(1, 5, 1.0, 1.0), (1, 4, 1.0, 1.0)], [(1, 3, 2.0, 2.0), (1, 6, 1.1, 1.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = folds.ball_stream(stream).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.frame_index: (r.late, r.x) for r in spark.table("late").collect()}
    assert got[4] == (False, 1.0) and got[5] == (False, 1.0) and got[6] == (False, 1.1) and got[3] == (True, None)


@pytest.mark.parametrize("fold", [folds.PossessionFold, folds.VelocityFold, folds.VoteFold])
def test_state_is_json(fold):
    import json

    assert json.loads(json.dumps(fold().state())) == fold().state()
