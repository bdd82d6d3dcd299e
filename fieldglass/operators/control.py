"""Pitch control and space ownership over a grid, and what else needs numbers per frame rather than columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions import geometry as g
from fieldglass.operators.scenes import KEY
from fieldglass.session import spread


@dataclass(frozen=True)
class Grid:
    """A grid over the pitch and the arrival-time model on it."""

    nx: int = 105
    ny: int = 68
    length: float = g.PITCH_LENGTH
    width: float = g.PITCH_WIDTH
    reaction_time: float = g.REACTION_TIME
    max_speed: float = g.MAX_SPEED
    tau: float = g.TAU

    def __post_init__(self):
        if self.nx <= 0 or self.ny <= 0:
            raise ValueError("grid dimensions must be positive")

    @property
    def cell_area(self) -> float:
        return self.length * self.width / (self.nx * self.ny)

    def centres(self) -> tuple[np.ndarray, np.ndarray]:
        """x and y of the cells' centres, row by row."""
        x, y = (np.arange(self.nx) + 0.5) * self.length / self.nx, (np.arange(self.ny) + 0.5) * self.width / self.ny
        return np.tile(x, self.ny), np.repeat(y, self.nx)

    def values(self) -> np.ndarray:
        """Threat value of every cell."""
        x, y = self.centres()
        ax, ay, by = self.length - x, self.width / 2 - g.GOAL_WIDTH / 2 - y, self.width / 2 + g.GOAL_WIDTH / 2 - y
        angle = np.abs(np.arctan2(np.abs(ax * by - ay * ax), ax * ax + ay * by)) / np.pi
        return np.clip(np.exp(-np.hypot(self.length - x, self.width / 2 - y) / 25.0) * 0.65 + angle * 0.35, 0, 1)


def arrival_times(grid: Grid, cells: tuple[np.ndarray, np.ndarray], x, y, vx, vy) -> np.ndarray:
    """Seconds from every player (rows) to every cell (columns)."""
    dx = (x + vx * grid.reaction_time)[:, None] - cells[0][None, :]
    dy = (y + vy * grid.reaction_time)[:, None] - cells[1][None, :]
    np.multiply(dx, dx, out=dx)
    np.multiply(dy, dy, out=dy)
    np.add(dx, dy, out=dx)
    np.sqrt(dx, out=dx)
    dx /= max(grid.max_speed, 1e-6)
    dx += grid.reaction_time
    return dx


def control_of(grid: Grid, times: np.ndarray, attackers: int) -> np.ndarray:
    """Probability per cell that the attack controls it; 1 without defenders, 0 without attackers, 0.5 without both."""
    n = times.shape[1]
    if not len(times):
        return np.full(n, 0.5)
    if not attackers or attackers == len(times):
        return np.full(n, 1.0 if attackers else 0.0)
    late = (times[:attackers].min(axis=0) - times[attackers:].min(axis=0)) / grid.tau
    return 1.0 / (1.0 + np.exp(np.minimum(late, 700.0)))


def owned_areas(grid: Grid, times: np.ndarray) -> np.ndarray:
    """Area per player of the cells they reach first; the first listed of equals."""
    return np.bincount(times.argmin(axis=0), minlength=len(times)) * grid.cell_area if len(times) else np.zeros(0)


def hull_area(x: np.ndarray, y: np.ndarray) -> float:
    """Area of the convex hull; 0 for fewer than three distinct points or points in one line."""
    points = sorted(set(zip(x.tolist(), y.tolist())))
    if len(points) < 3:
        return 0.0
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def chain(seq):
        out = []
        for p in seq:
            while len(out) > 1 and cross(out[-2], out[-1], p) <= 0:
                del out[-1]
            out.append(p)
        return out

    ring = chain(points)[:-1] + chain(reversed(points))[:-1]
    a = np.array(ring)
    b = np.roll(a, -1, axis=0)
    return float(abs((a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]).sum()) / 2)


def banks(x: np.ndarray, k: int = 3, rounds: int = 50) -> list[float]:
    """Lines of a defence: one-dimensional k-means from quantile seeds, ascending; a centre without players stays where it is."""
    xs = np.sort(np.asarray(x, float))
    k = min(k, len(xs))
    if k <= 0:
        return []
    centres = xs[((np.arange(k) + 0.5) / k * len(xs)).astype(int) % len(xs)]
    for _ in range(rounds):
        own = np.abs(xs[:, None] - centres[None, :]).argmin(axis=1)
        sizes, sums = np.bincount(own, minlength=k), np.bincount(own, weights=xs, minlength=k)
        moved = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)
        done = np.abs(moved - centres).max() <= 1e-9
        centres = moved
        if done:
            break
    return sorted(centres.tolist())


_D = T.DoubleType()
SCORED = [T.StructField(c, _D) for c in ("team_space", "team_dangerous_space", "attacking_hull", "defending_hull")] + [T.StructField(c, T.ArrayType(_D)) for c in ("ownership", "defensive_lines")]


def with_space(scenes: DataFrame, grid: Grid = Grid(), *, k: int = 3) -> DataFrame:
    """Scenes with team_space, team_dangerous_space, hulls, ownership (per attacker, in order) and defensive_lines.

    One arrival-time field per frame serves control and ownership. Frames come in Arrow batches and are worked off one
    by one, so a task holds one field (players x cells) at a time. They are spread by frame first, as a match may have a
    large part of all frames and possession has left each match in one partition.
    """
    parts = ("ord", "track_id", "x", "y", "vx", "vy")
    plain = [c for c in scenes.columns if c not in ("attackers", "defenders")]
    flat = scenes.select(*plain, *[F.col(f"{side}.{c}").alias(f"_{side}_{c}") for side in ("attackers", "defenders") for c in parts])
    names = list(flat.columns)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, values = grid.centres(), grid.values()
        for b in batches:
            rows = []
            for ax, ay, avx, avy, dx, dy, dvx, dvy in zip(*[b[f"_{side}_{c}"] for side in ("attackers", "defenders") for c in ("x", "y", "vx", "vy")]):
                times = arrival_times(grid, cells, *[np.concatenate([p, q]) for p, q in ((ax, dx), (ay, dy), (avx, dvx), (avy, dvy))])
                control = control_of(grid, times, len(ax))
                rows.append((control.sum() * grid.cell_area, (control * values).sum() * grid.cell_area, hull_area(ax, ay), hull_area(dx, dy), owned_areas(grid, times)[: len(ax)], banks(dx, k)))
            yield pd.concat([b[names].reset_index(drop=True), pd.DataFrame(rows, columns=[f.name for f in SCORED])], axis=1)

    scored = spread(flat, *KEY).mapInPandas(score, T.StructType(list(flat.schema.fields) + SCORED))
    for side in ("attackers", "defenders"):
        zipped = F.arrays_zip(*[F.col(f"_{side}_{c}") for c in parts])
        scored = scored.withColumn(side, F.transform(zipped, _renamed(side, parts)))
    return scored.select(*plain, "attackers", "defenders", *[f.name for f in SCORED])


def _renamed(side: str, parts: tuple[str, ...]):
    return lambda p: F.struct(*[p[f"_{side}_{c}"].alias(c) for c in parts])


def team_shape(scenes: DataFrame, side: str) -> DataFrame:
    """depth, width and centroid of one side of each scene, as column expressions; null for nobody."""
    xs, ys = F.transform(side, lambda p: p["x"]), F.transform(side, lambda p: p["y"])
    mean = lambda c: F.when(F.size(side) > 0, F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(side))
    return scenes.withColumns({"depth": F.array_max(xs) - F.array_min(xs), "width": F.array_max(ys) - F.array_min(ys), "centroid_x": mean(xs), "centroid_y": mean(ys)})
