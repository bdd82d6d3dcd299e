import pytest
from pyspark.sql import functions as F

from fieldglass.operators.scenes import gated, with_offside_line
from fieldglass.operators.tracking import usable_detections
from fieldglass.plans import scoring, sequences
from fieldglass.schemas import validate_run


def test_analysis_recovers_the_scenes_it_was_made_from(spark, sf):
    found = sequences._analysis(spark, sf)
    (c,) = found.counters.collect()
    assert c.calibrated == c.frames == 42 and c.tracks == 22 and c.coverage > 0.7
    near = found.observations.where("x is not null").groupBy("track_id").agg(F.countDistinct("frame_index").alias("n")).collect()
    assert len(near) == 22 and min(r.n for r in near) >= 38
    truth = {r.frame_index: r.offside_line for r in with_offside_line(gated(scoring.scenes(spark, sf))).collect()}
    got = {r.frame_index: r.offside_line for r in found.frame_scores.collect()}
    both = [f for f in got if f in truth and f > 8]
    assert len(both) > 20
    # the ball differs where it was repaired, so compare where the defence sets the line
    close = [f for f in both if abs(got[f] - truth[f]) < 0.5]
    assert len(close) > 0.8 * len(both)
    assert found.player_scores.where("space_owned < 0 or space_owned > 7140").count() == 0


def test_parameters_are_checked():
    validate_run(fps=25)
    for bad in ({"fps": 0}, {"fps": 130}, {"fps": 25, "stride": 0}, {"fps": 25, "length": 80}, {"fps": 25, "width": 91}):
        with pytest.raises(ValueError):
            validate_run(**bad)


def test_detection_floors(spark):
    df = spark.createDataFrame([("person", 0.9), ("person", 0.2), ("sports ball", 0.1), ("sports ball", None), ("dog", 0.9), (None, 0.9)], "label string, confidence double")
    got = usable_detections(df, labels={"person": "player", "sports ball": "ball"}, floors={"player": 0.3, "ball": 0.05})
    assert sorted(tuple(r) for r in got.collect()) == [("ball", 0.1), ("player", 0.9)]
