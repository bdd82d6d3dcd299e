import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldglass.operators.calibration import CalibrationConfig, Gate, apply_homography, fit_homographies, robust_homography
from fieldglass.operators.control import Grid, arrival_times, banks, control_of, hull_area, owned_areas
from fieldglass.operators.teams import two_kits
from fieldglass.operators.tracking import TrackFold, best_first, overlaps

RNG = np.random.default_rng(7)
GRID = Grid(30, 20)


def field(n):
    return arrival_times(GRID, GRID.centres(), *RNG.uniform(0, 60, (2, n)), *RNG.normal(0, 3, (2, n)))


def test_control_of_one_side_and_of_nobody():
    t = field(4)
    assert (control_of(GRID, t, 4) == 1).all() and (control_of(GRID, t, 0) == 0).all() and (control_of(GRID, t[:0], 0) == 0.5).all()


def test_swapping_sides_turns_control_round():
    t = field(6)
    assert np.allclose(control_of(GRID, t, 2) + control_of(GRID, np.concatenate([t[2:], t[:2]]), 4), 1)


def test_control_survives_a_tiny_tau():
    assert np.isfinite(control_of(Grid(30, 20, tau=1e-9), field(6), 3)).all()


def test_ownership_tiles_the_pitch_and_first_wins():
    assert owned_areas(GRID, field(7)).sum() == pytest.approx(105 * 68)
    t = np.repeat(field(1), 3, axis=0)
    assert owned_areas(GRID, t).tolist() == pytest.approx([7140, 0, 0])
    with pytest.raises(ValueError):
        Grid(0, 3)


def relational_hull(points):
    points = sorted(set(points))
    area = 0.0
    for p in points:
        for q in points:
            if p == q:
                continue
            cross = [(q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]) for r in points]
            dots = [(r[0] - p[0]) * (r[0] - q[0]) + (r[1] - p[1]) * (r[1] - q[1]) for r in points]
            if not any(c < 0 or (c == 0 and d > 0) for c, d in zip(cross, dots)):
                area += p[0] * q[1] - q[0] * p[1]
    return abs(area) / 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6).map(float), st.integers(0, 6).map(float)), max_size=9))
def test_hull_area_equals_the_sum_over_hull_edges(points):
    assert hull_area(np.array([p[0] for p in points]), np.array([p[1] for p in points])) == pytest.approx(relational_hull(points))


def test_banks_of_a_442():
    x = [29.5, 30.0, 30.5, 30.4, 49.5, 50.0, 50.5, 50.4, 70.0, 71.0]
    assert banks(np.array(x)) == pytest.approx([30.1, 50.1, 70.5], abs=1)
    assert banks(np.array([])) == [] and banks(np.array([5.0]), 3) == [5.0] and banks(np.array([4.0, 4.0, 4.0])) == [4.0, 4.0, 4.0]


def test_homography_is_recovered_despite_wrong_pairs():
    h = np.array([[9.5, 2.1, 180], [-0.4, 6.2, 90], [-0.0012, 0.0041, 1]])
    pitch = RNG.uniform((0, 0), (105, 68), (14, 2))
    image = apply_homography(h, pitch)
    image[[3, 8]] += 200
    found, inside = robust_homography(image, pitch)
    assert inside.sum() == 12 and not inside[[3, 8]].any()
    assert np.abs(apply_homography(found, image[inside]) - pitch[inside]).max() < 1e-6
    assert robust_homography(image[:3], pitch[:3]) is None
    line = np.stack([np.arange(6.0), np.arange(6.0)], 1)
    assert robust_homography(line, line) is None
    assert np.isnan(fit_homographies(line[:4], line[:4])).all()


def test_gate_rejects_jumps_coasts_and_can_reacquire():
    still, away = np.eye(3).ravel().tolist(), [1, 0, 40, 0, 1, 0, 0, 0, 1]
    gate = Gate(CalibrationConfig(max_coast=2))
    assert [gate.push(h)[1] for h in (None, still, away, None, away, still)] == ["lost", "fitted", "coasted", "coasted", "lost", "fitted"]
    gate = Gate(CalibrationConfig(reacquire_after=2))
    assert [gate.push(h)[1] for h in (still, away, away, away, away)] == ["fitted", "coasted", "coasted", "fitted", "fitted"]


def test_tracks_confirm_survive_gaps_and_keep_ids():
    tracker, seen = TrackFold(), []
    for f in range(14):
        box = np.array([[4.0 * f, 0, 4.0 * f + 20, 50]])
        boxes = box if f not in (6, 7) else box[:0]
        tracker = TrackFold(state=tracker.state())  # as a stream would carry it
        seen.append([r[0] for r in tracker.step(boxes, np.full(len(boxes), 0.9))])
    assert seen[:2] == [[], []] and seen[2] == [1] and seen[6:8] == [[], []] and seen[8:] == [[1]] * 6
    assert TrackFold().step(np.array([[0.0, 0, 9, 9]]), np.array([0.2])) == []
    assert len(TrackFold().ids) == 0


def test_overlaps_and_greedy_ties():
    a = np.array([[0.0, 0, 10, 10], [5, 5, 5, 5]])
    assert overlaps(a, a).tolist() == [[1.0, 0.0], [0.0, 0.0]]
    assert best_first(np.array([[0.5, 0.5], [0.5, 0.9]]), 0.25) == [(1, 1), (0, 0)]
    assert best_first(np.array([[0.5, 0.5], [0.5, 0.5]]), 0.25) == [(0, 0), (1, 1)]


def test_kits_darker_first():
    colours = np.concatenate([RNG.normal(200, 5, (10, 3)), RNG.normal(40, 5, (10, 3))])
    kits = two_kits(colours)
    assert kits[0].sum() < kits[1].sum() and np.linalg.norm(kits[0] - kits[1]) > 40
