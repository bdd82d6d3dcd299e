"""Ordered stages over live tracking: one state per match, frames in order.

A micro-batch may hold the frames of a match in any order; they are sorted before they are folded. The rows of one frame
come in one micro-batch. Rows of frames at or before the last folded one come too late to change what was emitted: they
are returned with late = true and no result. Results for frames in order equal those of the batch operators.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldglass.operators.ball import BallConfig
from fieldglass.operators.calibration import CalibrationConfig, Gate
from fieldglass.operators.tracking import TrackerConfig, TrackFold


class Fold(Protocol):
    """State of one match; step gives the result columns of each output row of a frame."""

    def state(self) -> dict: ...

    def step(self, frame: int, rows: pd.DataFrame) -> list[tuple]: ...


def fold_stream(stream: DataFrame, make: Callable[[dict | None], Fold], result: str, *, match: str = "match_no") -> DataFrame:
    """Rows (match, frame_index, result columns, late) of a stateful fold per match."""
    kind = stream.schema[match].dataType.simpleString()
    names = [c.strip().split(" ")[0] for c in result.split(", ")]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved, last = (json.loads(state.get[0]), state.get[1]) if state.exists else (None, None)
        fold = make(saved)
        rows = pd.concat(list(batches))
        out = []
        for frame, own in rows.sort_values([c for c in ("frame_index", "ord") if c in rows]).groupby("frame_index", sort=True):
            if last is not None and frame <= last:
                out.append((key[0], frame, *[None] * len(names), True))
                continue
            out += [(key[0], frame, *r, False) for r in fold.step(int(frame), own)]
            last = int(frame)
        state.update((json.dumps(fold.state()), last))
        yield pd.DataFrame(out, columns=[match, "frame_index", *names, "late"], dtype=object)

    grouped = stream.groupBy(match)
    return grouped.applyInPandasWithState(update, f"{match} {kind}, frame_index int, {result}, late boolean", "state string, last bigint", "append", GroupStateTimeout.NoTimeout)


def _known(*values) -> bool:
    return all(v is not None and not pd.isna(v) for v in values)


class BallFold:
    """Rejects impossible jumps and holds the last place through short gaps; one row (x, y) a frame."""

    def __init__(self, state: dict | None = None, *, fps: float = 25.0, config: BallConfig = BallConfig()):
        self.dt, self.config = (1.0 / fps if fps > 0 else 0.04), config
        self.last, self.rejected = (state or {}).get("last"), (state or {}).get("rejected", 0)

    def state(self) -> dict:
        return {"last": self.last, "rejected": self.rejected}

    def step(self, frame: int, rows: pd.DataFrame) -> list[tuple]:
        x, y = rows.x.iloc[0], rows.y.iloc[0]
        status = "seen" if _known(x, y) else "missing"
        if status == "seen" and self.last is not None:
            f, px, py = self.last
            if frame > f and np.hypot(x - px, y - py) / ((frame - f) * self.dt) > self.config.max_speed:
                self.rejected += 1
                status = "rejected"
        if status == "seen":
            self.last = [frame, float(x), float(y)]
            return [(float(x), float(y), status)]
        if self.last is not None and frame - self.last[0] <= self.config.max_gap:
            return [(self.last[1], self.last[2], status)]
        return [(None, None, status)]


class PossessionFold:
    """Side in possession; rows are the players of the frame with ball_x and ball_y repeated on each."""

    def __init__(self, state: dict | None = None, *, hysteresis: float = 1.5, max_distance: float = 4.0):
        self.side, self.hysteresis, self.max_distance = (state or {}).get("side"), hysteresis, max_distance

    def state(self) -> dict:
        return {"side": self.side}

    def step(self, frame: int, rows: pd.DataFrame) -> list[tuple]:
        bx, by = rows.ball_x.iloc[0], rows.ball_y.iloc[0]
        placed = rows[rows.team.isin(["home", "away"]) & rows.x.notna() & rows.y.notna()]
        if _known(bx, by) and len(placed):
            d = np.hypot(placed.x - bx, placed.y - by).groupby(placed.team, sort=False).min()
            near = d.idxmin()
            if d[near] <= self.max_distance and (self.side is None or d[near] + self.hysteresis < d.get(self.side, np.inf)):
                self.side = near
        return [(self.side,)]


class VelocityFold:
    """Velocity over the last observations of each track; rows are observations."""

    def __init__(self, state: dict | None = None, *, fps: float = 25.0, window: int = 5):
        self.dt, self.window, self.past = (1.0 / fps if fps > 0 else 0.04), max(2, window), (state or {})

    def state(self) -> dict:
        return self.past

    def step(self, frame: int, rows: pd.DataFrame) -> list[tuple]:
        out = []
        for track, x, y in zip(rows.track_id.tolist(), rows.x.tolist(), rows.y.tolist()):
            if not _known(x, y):
                out.append((track, None, None))
                continue
            past = self.past.setdefault(str(track), [])
            past.append([frame, x, y])
            del past[: -self.window]
            span = (frame - past[0][0]) * self.dt
            out.append((track, (x - past[0][1]) / span, (y - past[0][2]) / span) if span > 0 else (track, 0.0, 0.0))
        return out


class VoteFold:
    """Running side of each track; rows are observations with a vote."""

    def __init__(self, state: dict | None = None, *, least: int = 5):
        self.votes, self.least = (state or {}), least

    def state(self) -> dict:
        return self.votes

    def step(self, frame: int, rows: pd.DataFrame) -> list[tuple]:
        out = []
        for track, vote in zip(rows.track_id.tolist(), rows.vote.tolist()):
            held = self.votes.setdefault(str(track), {})
            if vote in ("home", "away"):
                held[vote] = held.get(vote, 0) + 1  # keeps the order in which sides were first seen
            best = max(held, key=held.__getitem__) if sum(held.values()) >= self.least else "unknown"
            out.append((track, best))
        return out


class DetectionFold(TrackFold):
    """Tracks from the boxes of each frame."""

    def __init__(self, state: dict | None = None, *, config: TrackerConfig = TrackerConfig()):
        super().__init__(config, state)

    def step(self, frame: int, rows: pd.DataFrame) -> list[tuple]:  # type: ignore[override]
        own = rows[(rows.label != "ball") & rows.x1.notna()]
        return super().step(own[["x1", "y1", "x2", "y2"]].to_numpy(float), own.confidence.fillna(0).to_numpy(float))


class GateFold(Gate):
    """The calibration gate; one row (h) a frame."""

    def __init__(self, state: dict | None = None, *, config: CalibrationConfig = CalibrationConfig()):
        super().__init__(config, state)

    def step(self, frame: int, rows: pd.DataFrame) -> list[tuple]:
        h = rows.h.iloc[0]
        return [self.push(None if h is None else list(h))]


def ball_stream(stream: DataFrame, **kw) -> DataFrame:
    return fold_stream(stream, lambda s: BallFold(s, **kw), "x double, y double, status string")


def possession_stream(stream: DataFrame, **kw) -> DataFrame:
    return fold_stream(stream, lambda s: PossessionFold(s, **kw), "attacking_team string")


def velocity_stream(stream: DataFrame, **kw) -> DataFrame:
    return fold_stream(stream, lambda s: VelocityFold(s, **kw), "track_id int, vx double, vy double")


def vote_stream(stream: DataFrame, **kw) -> DataFrame:
    return fold_stream(stream, lambda s: VoteFold(s, **kw), "track_id int, team string")


def track_stream(stream: DataFrame, **kw) -> DataFrame:
    return fold_stream(stream, lambda s: DetectionFold(s, **kw), "track_id int, x1 double, y1 double, x2 double, y2 double, confidence double")


def gate_stream(stream: DataFrame, **kw) -> DataFrame:
    return fold_stream(stream, lambda s: GateFold(s, **kw), "h array<double>, status string")
