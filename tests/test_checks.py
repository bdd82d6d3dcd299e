"""Queries without SQL, against plain restatements of what they should give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.operators.lines import fit_conic
from fieldglass.plans import sequences
from fieldglass.sources.tracking import tracking_from_events


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def test_tracked_detections_equal_a_plain_fold(spark, sf):
    rows = sequences._boxes(spark, sf).where("label = 'player'").select("match_no", "frame_index", "ord", F.greatest("confidence", F.lit(0.5)).alias("c"), "x1", "y1", "x2", "y2").collect()
    want = set()
    for match in {r.match_no for r in rows}:
        tracks, following = [], 1
        for frame in sorted({r.frame_index for r in rows if r.match_no == match}):
            boxes = [(r.x1, r.y1, r.x2, r.y2) for r in sorted((r for r in rows if r.match_no == match and r.frame_index == frame), key=lambda r: r.ord)]
            for t in tracks:
                t["ahead"] = [b + v for b, v in zip(t["box"], t["v"] * 2)]
            scored = sorted((-iou(t["ahead"], b), i, j) for i, t in enumerate(tracks) for j, b in enumerate(boxes))
            used_t, used_b = set(), set()
            for s, i, j in scored:
                if -s >= 0.25 and i not in used_t and j not in used_b:
                    used_t.add(i)
                    used_b.add(j)
                    t, b = tracks[i], boxes[j]
                    moved = [(b[k] + b[k + 2]) / 2 - (t["box"][k] + t["box"][k + 2]) / 2 for k in (0, 1)]
                    t["v"] = [0.6 * v + 0.4 * m for v, m in zip(t["v"], moved)]
                    t["box"], t["age"], t["hits"] = list(b), 0, t["hits"] + 1
            for i, t in enumerate(tracks):
                if i not in used_t:
                    t["box"], t["age"] = t["ahead"], t["age"] + 1
            for j, b in enumerate(boxes):
                if j not in used_b:
                    tracks.append({"id": following, "box": list(b), "v": [0.0, 0.0], "age": 0, "hits": 1})
                    following += 1
            tracks = [t for t in tracks if t["age"] <= 30]
            want |= {(match, frame, t["id"], *np.round(t["box"], 6).tolist()) for t in tracks if t["age"] == 0 and t["hits"] >= 3}
    got = {(r.match_no, r.frame_index, r.track_id, *np.round([r.x1, r.y1, r.x2, r.y2], 6).tolist()) for r in sequences.tracked_detections(spark, sf).collect()}
    assert got == want and len(got) > 500


def test_merged_lines_are_apart_and_none_is_lost(spark, sf):
    every = sequences._line_table(spark, sf).collect()
    kept = sequences.merged_track_lines(spark, sf).collect()

    def gap(a, b):
        """Mean distance from b of three places on a."""
        out = []
        for s in (-20.0, 0.0, 20.0):
            x, y = a.rho * np.cos(a.theta) - s * np.sin(a.theta), a.rho * np.sin(a.theta) + s * np.cos(a.theta)
            out.append(abs(x * np.cos(b.theta) + y * np.sin(b.theta) - b.rho))
        return np.mean(out)

    for match in {r.match_no for r in every}:
        own = [r for r in kept if r.match_no == match]
        ids = {r.track_id for r in own}
        assert all(gap(a, b) > 1.999 for a in own for b in own if a.strength > b.strength)
        for r in every:
            if r.match_no == match and r.track_id not in ids:
                assert any(k.strength > r.strength and gap(k, r) < 2.001 for k in own)
        assert min(own, key=lambda r: (r.theta, r.rho)).family == 0
        turn = lambda r: np.array([np.cos(2 * r.theta), np.sin(2 * r.theta)])
        means = {f: sum(turn(r) for r in own if r.family == f) for f in {r.family for r in own}}
        for r in own:
            assert all(turn(r) @ means[r.family] / np.linalg.norm(means[r.family]) >= turn(r) @ m / np.linalg.norm(m) - 1e-6 for m in means.values())


def test_ellipses_have_the_centre_and_axes_of_their_conic(spark, sf):
    players, _ = tracking_from_events(spark, sf)
    points = {k: g for k, g in players.toPandas().groupby(["match_no", "frame_index", "team"])}
    rows = {(r.match_no, r.frame_index, r.team): r for r in sequences.side_ellipses(spark, sf).collect()}
    assert rows
    for key, own in points.items():
        own = own.sort_values(["x", "y"])
        conic = fit_conic(own.x.to_numpy(), own.y.to_numpy())
        if conic is None:
            assert key not in rows
            continue
        a, b, c, d, e, f = conic
        form = np.array([[a, b / 2], [b / 2, c]])
        if np.linalg.det(form) <= 0:
            assert key not in rows
            continue
        centre = np.linalg.solve(2 * form, [-d, -e])
        level = -(f + (d * centre[0] + e * centre[1]) / 2)
        axes = level / np.linalg.eigvalsh(form)
        if (axes > 0).all() and key in rows:
            r = rows[key]
            assert (r.cx, r.cy) == pytest.approx(tuple(centre), rel=1e-4, abs=1e-4)
            assert sorted((r.major, r.minor)) == pytest.approx(sorted(np.sqrt(axes)), rel=1e-4, abs=1e-4)
