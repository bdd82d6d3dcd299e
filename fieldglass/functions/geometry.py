"""Geometry as column expressions: pixels and pitch metres, never mixed in one call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the game and of the scoring model.
PITCH_LENGTH, PITCH_WIDTH, GOAL_WIDTH = 105.0, 68.0, 7.32
REACTION_TIME, MAX_SPEED, TAU = 0.7, 7.8, 0.45
LANE_CORRIDOR, PRESSURE_SCALE, AVAILABLE_PRESSURE = 1.2, 5.0, 0.6


def lit(x: float) -> Column:
    return F.lit(float(x))


# boxes -----------------------------------------------------------------------------------------------------------
def box_width(x1: Column, x2: Column) -> Column:
    return x2 - x1


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def box_valid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 >= x1) & (y2 >= y1)


def ground_point(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Where a standing player's box meets the ground: the middle of its lower edge."""
    return (x1 + x2) / 2, y2


def box_scaled(x1: Column, y1: Column, x2: Column, y2: Column, factor: float) -> tuple[Column, Column, Column, Column]:
    """The box grown or shrunk about its centre."""
    cx, cy, hw, hh = (x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) / 2 * factor, (y2 - y1) / 2 * factor
    return cx - hw, cy - hh, cx + hw, cy + hh


def box_iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of two boxes; 0 where both are empty."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), lit(0))
    union = box_area(*a) + box_area(*b) - w * h
    return F.when(union > 0, w * h / union).otherwise(lit(0))


# homographies: nine columns or numbers, row by row ----------------------------------------------------------------
def project(h: Sequence[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a homography; null on the horizon."""
    w = h[6] * x + h[7] * y + h[8]
    seen = F.abs(w) >= 1e-12
    return F.when(seen, (h[0] * x + h[1] * y + h[2]) / w), F.when(seen, (h[3] * x + h[4] * y + h[5]) / w)


def matrix_product(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [sum((a[3 * r + k] * b[3 * k + c] for k in range(1, 3)), a[3 * r] * b[c]) for r in range(3) for c in range(3)]


def matrix_inverse(m: Sequence[Column]) -> list[Column]:
    """Inverse by cofactors; all null where the determinant vanishes."""
    minor = lambda r, c: (lambda i, j: m[3 * i[0] + j[0]] * m[3 * i[1] + j[1]] - m[3 * i[0] + j[1]] * m[3 * i[1] + j[0]])([k for k in range(3) if k != r], [k for k in range(3) if k != c])
    cofactor = {(r, c): minor(r, c) if (r + c) % 2 == 0 else -minor(r, c) for r in range(3) for c in range(3)}
    det = m[0] * cofactor[0, 0] + m[1] * cofactor[0, 1] + m[2] * cofactor[0, 2]
    return [F.when(F.abs(det) >= 1e-12, cofactor[c, r] / det) for r in range(3) for c in range(3)]


def mirrored_homographies(h: Sequence[Column], length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> dict[str, list[Column]]:
    """The homography and its reflections in the pitch's middle lines."""
    l, w = lit(length), lit(width)
    along = [l * h[6 + i] - h[i] for i in range(3)]
    across = [w * h[6 + i] - h[3 + i] for i in range(3)]
    own, last = list(h), list(h[6:9])
    return {"none": own, "length": along + own[3:6] + last, "width": own[:3] + across + last, "both": along + across + last}


def camera_homography(focal: Column, cx: Column, cy: Column, pan: Column, tilt: Column, position: Sequence[Column]) -> list[Column]:
    """Pitch plane to image of a pinhole camera without roll, scaled so that the last entry is 1; null if that is 0.

    pan turns about the vertical from looking across the pitch (+y), tilt looks down from the horizon, both in radians.
    """
    s, c, st, ct = F.sin(pan), F.cos(pan), F.sin(tilt), F.cos(tilt)
    right, down, ahead = (c, -s, lit(0)), (-s * st, -c * st, -ct), (s * ct, c * ct, -st)
    dot = lambda axis: -(axis[0] * position[0] + axis[1] * position[1] + axis[2] * position[2])
    rows = []
    for axis, centre in ((right, cx), (down, cy)):
        rows += [focal * axis[0] + centre * ahead[0], focal * axis[1] + centre * ahead[1], focal * dot(axis) + centre * dot(ahead)]
    rows += [ahead[0], ahead[1], dot(ahead)]
    return [F.when(F.abs(rows[8]) >= 1e-12, r / rows[8]) for r in rows]


# pitch -----------------------------------------------------------------------------------------------------------
def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, lit(low)), lit(high))


def on_pitch(x: Column, y: Column, length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> Column:
    return x.between(0, length) & y.between(0, width)


def flipped(v: Column, flip: Column, extent: float) -> Column:
    return F.when(flip, lit(extent) - v).otherwise(v)


def opponent(team: Column) -> Column:
    return F.when(team == "home", "away").when(team == "away", "home").otherwise("unknown")


def is_side(team: Column) -> Column:
    return F.coalesce(team.isin("home", "away"), F.lit(False))


def distance(x: Column, y: Column, px: Column, py: Column) -> Column:
    """Euclidean distance; spelled out, so that another engine rounds alike."""
    return F.sqrt((x - px) * (x - px) + (y - py) * (y - py))


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from the segment a-b, or from a if both ends coincide."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 1e-18, clamp(((x - ax) * dx + (y - ay) * dy) / length2, 0, 1)).otherwise(lit(0))
    return distance(x, y, ax + dx * t, ay + dy * t)


def arrival_time(x: Column, y: Column, vx: Column, vy: Column, qx: Column, qy: Column) -> Column:
    """Seconds until a player gets to q: keeps going for the reaction time, then sprints."""
    r = lit(REACTION_TIME)
    return r + distance(x + F.coalesce(vx, lit(0)) * r, y + F.coalesce(vy, lit(0)) * r, qx, qy) / lit(MAX_SPEED)


def pitch_value(x: Column, y: Column, length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> Column:
    """Threat of a place in [0, 1] for a side attacking +x: nearness of the goal and the angle its mouth spans."""
    ax, ay, by = lit(length) - x, lit(width / 2 - GOAL_WIDTH / 2) - y, lit(width / 2 + GOAL_WIDTH / 2) - y
    near = F.exp(-distance(x, y, lit(length), lit(width / 2)) / 25.0)
    angle = F.abs(F.atan2(F.abs(ax * by - ay * ax), ax * ax + ay * by)) / F.pi()
    return clamp(near * 0.65 + angle * 0.35, 0, 1)


def is_offside(margin: Column) -> Column:
    return F.coalesce(margin > 0, F.lit(False))


def is_available(lane_open: Column, margin: Column, pressure: Column) -> Column:
    return lane_open & ~is_offside(margin) & (pressure < AVAILABLE_PRESSURE)


def pressure(nearest: Column, scale: float = PRESSURE_SCALE) -> Column:
    """Marking pressure in [0, 1] from the distance of the nearest opponent; 0 without one."""
    return F.coalesce(clamp(F.exp(-nearest / max(scale, 1e-6)), 0, 1), lit(0))


def seconds(frame: Column, fps: float) -> Column:
    return frame / lit(fps) if fps > 0 else lit(0)


# lines and conics ------------------------------------------------------------------------------------------------
def line_normal_form(rho: Column, theta: Column) -> tuple[Column, Column]:
    """(rho, theta) with theta in [0, pi)."""
    turns = F.floor(theta / F.pi())
    odd = F.pmod(turns, F.lit(2)) == 1
    return F.when(odd, -rho).otherwise(rho), theta - turns * F.pi()


def line_intersection(r1: Column, t1: Column, r2: Column, t2: Column) -> tuple[Column, Column]:
    """Where two lines x cos t + y sin t = r meet; null if they are parallel."""
    det = F.sin(t2 - t1)
    crossing = F.abs(det) >= 1e-6
    return F.when(crossing, (r1 * F.sin(t2) - r2 * F.sin(t1)) / det), F.when(crossing, (r2 * F.cos(t1) - r1 * F.cos(t2)) / det)


def line_y_at(rho: Column, theta: Column, x: Column) -> Column:
    """y of a line at x; null where the line is vertical."""
    return F.when(F.abs(F.sin(theta)) >= 1e-6, (rho - x * F.cos(theta)) / F.sin(theta))


def sampson_distance(conic: Sequence[Column], x: Column, y: Column) -> Column:
    """First-order distance of a point from the conic a x2 + b xy + c y2 + d x + e y + f = 0; null at its centre."""
    a, b, c, d, e, f = conic
    value = a * x * x + b * x * y + c * y * y + d * x + e * y + f
    gx, gy = 2 * a * x + b * y + d, b * x + 2 * c * y + e
    g = F.sqrt(gx * gx + gy * gy)
    return F.when(g > 1e-12, F.abs(value) / g)


def ellipse_of(conic: Sequence[Column]) -> dict[str, Column]:
    """Centre, half axes and turn of the ellipse that a conic is; null for other conics."""
    a, b, c, d, e, f = conic
    disc = b * b - 4 * a * c
    real = disc < 0
    cx, cy = (2 * c * d - b * e) / disc, (2 * a * e - b * d) / disc
    at = a * cx * cx + b * cx * cy + c * cy * cy + d * cx + e * cy + f
    spread = F.sqrt((a - c) * (a - c) + b * b)
    half = lambda s: F.sqrt(F.when(-2 * at / s > 0, -2 * at / s))
    own = {"cx": cx, "cy": cy, "major": F.greatest(half(a + c - spread), half(a + c + spread)), "minor": F.least(half(a + c - spread), half(a + c + spread)), "angle": 0.5 * F.atan2(b, a - c)}
    return {k: F.when(real, v) for k, v in own.items()}
