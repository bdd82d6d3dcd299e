import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.functions import geometry as g
from fieldglass.operators.camera import fit_camera, fit_cameras, see
from fieldglass.operators.lines import angle_families, conic_inliers, fit_conic, fitted_conics, line_families, merge_lines, strongest_lines, template_support


def value(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()[0]
    return tuple(row)


L = g.lit


def test_boxes(spark):
    a, b = [L(0), L(0), L(10), L(20)], [L(5), L(0), L(15), L(20)]
    assert value(spark, g.box_iou(a, b), g.box_iou(a, a), g.box_iou([L(1)] * 4, [L(1)] * 4), g.box_area(*a)) == (pytest.approx(1 / 3), 1.0, 0.0, 200.0)
    assert value(spark, *g.ground_point(L(0), L(10), L(20)), *g.box_scaled(*a, 0.5)) == (5.0, 20.0, 2.5, 5.0, 7.5, 15.0)
    assert value(spark, g.box_valid(*a), g.box_valid(L(3), L(0), L(2), L(1))) == (True, False)


def test_homographies(spark):
    h = np.array([[9.5, 2.1, 180], [-0.4, 6.2, 90], [-0.0012, 0.0041, 1]])
    cells = [L(v) for v in h.ravel()]
    assert np.allclose(value(spark, *g.matrix_inverse(cells)), np.linalg.inv(h).ravel())
    assert value(spark, *g.matrix_inverse([L(1)] * 9)) == (None,) * 9
    assert np.allclose(value(spark, *g.matrix_product(cells, cells)), (h @ h).ravel())
    assert value(spark, *g.project([L(v) for v in (1, 0, 0, 0, 1, 0, 0, 0, 0)], L(3), L(4))) == (None, None)
    both = g.mirrored_homographies([L(v) for v in np.eye(3).ravel()])
    assert {k: value(spark, *g.project(m, L(5), L(8))) for k, m in both.items()} == {"none": (5, 8), "length": (100, 8), "width": (5, 60), "both": (100, 60)}


def test_camera(spark):
    truth = np.array([1800.0, 0.15, 0.22, 48.0, -30.0, 18.0])
    pitch = np.array([[x, y] for x in (20.0, 45.0, 70.0, 88.0) for y in (5.0, 30.0, 60.0)])
    image = see(truth, (960, 540), pitch)
    h = np.array(value(spark, *g.camera_homography(L(1800), L(960), L(540), L(0.15), L(0.22), (L(48), L(-30), L(18))))).reshape(3, 3)
    q = np.column_stack([pitch, np.ones(len(pitch))]) @ h.T
    assert np.allclose(q[:, :2] / q[:, 2:], image)
    found, error = fit_camera(image, pitch, (960, 540))
    assert error < 1e-3 and np.allclose(found, truth, rtol=1e-3)
    assert fit_camera(image[:3], pitch[:3], (960, 540)) is None
    rows = [(1, 0, i, float(a), float(b), float(c), float(d)) for i, ((a, b), (c, d)) in enumerate(zip(image, pitch))] + [(1, 1, 0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "match_no bigint, frame_index int, ord int, img_x double, img_y double, pitch_x double, pitch_y double")
    got = {r.frame_index: r.focal for r in fit_cameras(df).collect()}
    assert got[0] == pytest.approx(1800, rel=1e-3) and got[1] is None


def test_pitch(spark):
    assert value(spark, g.segment_distance(L(10), L(0.5), L(0), L(0), L(20), L(0)), g.segment_distance(L(3), L(4), L(0), L(0), L(0), L(0))) == (0.5, 5.0)
    near, far, off = value(spark, g.pitch_value(L(104), L(34)), g.pitch_value(L(10), L(34)), g.pitch_value(L(60), L(60)))
    assert 0 <= far < off < near <= 1
    assert value(spark, g.opponent(F.lit("home")), g.opponent(F.lit("unknown")), g.is_side(F.lit(None)), g.clamp(L(200), 0, 105), g.on_pitch(L(105), L(68))) == ("away", "unknown", False, 105.0, True)
    assert value(spark, g.arrival_time(L(0), L(0), L(None or 0), L(0), L(7.8), L(0)))[0] == pytest.approx(1.7)
    assert value(spark, g.seconds(F.lit(50), 25.0), g.seconds(F.lit(50), 0)) == (2.0, 0.0)
    assert value(spark, g.is_available(F.lit(True), F.lit(None).cast("double"), L(0.59)), g.is_available(F.lit(True), L(0.1), L(0.1)), g.is_available(F.lit(True), L(-1), L(0.6))) == (True, False, False)


def test_lines_and_conics(spark):
    assert value(spark, *g.line_normal_form(L(2), L(math.pi + 1))) == (-2.0, pytest.approx(1.0))
    assert value(spark, *g.line_intersection(L(3), L(0), L(4), L(math.pi / 2))) == (pytest.approx(3), pytest.approx(4))
    assert value(spark, *g.line_intersection(L(3), L(1), L(4), L(1)), g.line_y_at(L(3), L(0), L(1))) == (None, None, None)
    turn = np.linspace(0, 6, 20)
    x, y = 50 + 9 * np.cos(turn) * np.cos(0.3) - 4 * np.sin(turn) * np.sin(0.3), 34 + 9 * np.cos(turn) * np.sin(0.3) + 4 * np.sin(turn) * np.cos(0.3)
    conic = fit_conic(x, y)
    shape = g.ellipse_of([L(v) for v in conic])
    assert value(spark, *[shape[k] for k in ("cx", "cy", "major", "minor")]) == pytest.approx((50, 34, 9, 4), abs=1e-6)
    assert fit_conic(x[:4], y[:4]) is None and value(spark, g.ellipse_of([L(v) for v in (1, 0, -1, 0, 0, -1)])["cx"]) == (None,)
    points = F.array(*[F.struct(L(a).alias("x"), L(b).alias("y")) for a, b in [*zip(x[:3], y[:3]), (0.0, 0.0)]])
    assert value(spark, F.size(conic_inliers(points, F.array(*[L(v) for v in conic]), 0.5))) == (3,)
    df = spark.createDataFrame([("a", float(u), float(v)) for u, v in zip(x, y)] + [("few", 1.0, 1.0), ("a", None, 2.0)], "k string, x double, y double")
    assert [r.k for r in fitted_conics(df, ["k"]).collect()] == ["a"]


def test_merging_and_families(spark):
    rows = [("i", 10.0, 0.1, 5.0), ("i", 10.4, 0.1, 3.0), ("i", 30.0, 0.12, 2.0), ("i", 5.0, 1.6, 4.0), ("i", 8.0, 3.1, 1.0)]
    df = spark.createDataFrame(rows, "k string, rho double, theta double, strength double")
    assert sorted(r.strength for r in merge_lines(df, ["k"], least_gap=2.0, extent=20.0).collect()) == [1.0, 2.0, 4.0, 5.0]
    assert {r.strength: r.family for r in line_families(df, ["k"]).collect()} == {5.0: 0, 3.0: 0, 2.0: 0, 1.0: 0, 4.0: 1}
    assert [r.strength for r in strongest_lines(df, ["k"], 2).orderBy("strength").collect()] == [4.0, 5.0]
    assert angle_families(np.array([0.3])).tolist() == [0]
    probes = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("b", 1.0), *[("b", None)] * 5], "k string, distance double")
    assert {r.k: r.support for r in template_support(probes, ["k"]).collect()} == {"a": 0.5, "b": 0.0}
