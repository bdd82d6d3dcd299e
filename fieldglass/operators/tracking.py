"""Detections to tracks: greedy overlap matching, frame by frame."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.operators.ordered import fold_in_order


@dataclass(frozen=True)
class TrackerConfig:
    iou: float = 0.25
    max_age: int = 30
    inertia: float = 0.6
    init_confidence: float = 0.5
    confirm_hits: int = 3


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes (rows x1, y1, x2, y2), each with each."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.clip(high - low, 0, None).prod(axis=2)
    area = lambda c: (c[:, 2] - c[:, 0]) * (c[:, 3] - c[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1.0), 0.0)


def best_first(score: np.ndarray, least: float) -> list[tuple[int, int]]:
    """One-to-one pairs in order of falling score, then row, then column."""
    rows, cols = np.nonzero(score >= least)
    order = np.lexsort((cols, rows, -score[rows, cols]))
    taken_r, taken_c, out = set(), set(), []
    for r, c in zip(rows[order].tolist(), cols[order].tolist()):
        if r not in taken_r and c not in taken_c:
            taken_r.add(r)
            taken_c.add(c)
            out.append((r, c))
    return out


class TrackFold:
    """Tracks of one match: a row per track with id, box, velocity, age, hits and confidence."""

    def __init__(self, config: TrackerConfig = TrackerConfig(), state: dict | None = None):
        self.config = config
        state = state or {"next": 1, "tracks": []}
        self.next_id = state["next"]
        t = np.array(state["tracks"], float).reshape(-1, 10)
        self.ids, self.boxes, self.speed, self.age, self.hits, self.confidence = t[:, 0].astype(int), t[:, 1:5], t[:, 5:7], t[:, 7].astype(int), t[:, 8].astype(int), t[:, 9]

    def state(self) -> dict:
        table = np.column_stack([self.ids, self.boxes, self.speed, self.age, self.hits, self.confidence])
        return {"next": self.next_id, "tracks": table.tolist()}

    def step(self, boxes: np.ndarray, confidence: np.ndarray) -> list[tuple]:
        """(track id, box, confidence) of the confirmed tracks that a detection of this frame belongs to."""
        ahead = self.boxes + np.tile(self.speed, 2)
        pairs = best_first(overlaps(ahead, boxes), self.config.iou) if len(ahead) and len(boxes) else []
        held, found = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
        middle = lambda b: (b[:, :2] + b[:, 2:]) / 2
        moved = middle(boxes[found]) - middle(self.boxes[held])
        self.speed[held] = self.config.inertia * self.speed[held] + (1 - self.config.inertia) * moved
        missed = np.ones(len(self.ids), bool)
        missed[held] = False
        self.boxes = np.where(missed[:, None], ahead, self.boxes)
        self.boxes[held], self.confidence[held] = boxes[found], confidence[found]
        self.age = np.where(missed, self.age + 1, 0)
        self.hits = self.hits + ~missed
        new = np.setdiff1d(np.flatnonzero(confidence >= self.config.init_confidence), found)
        n = len(new)
        self.ids = np.append(self.ids, np.arange(self.next_id, self.next_id + n))
        self.next_id += n
        self.boxes, self.speed = np.concatenate([self.boxes, boxes[new]]), np.concatenate([self.speed, np.zeros((n, 2))])
        self.age, self.hits = np.append(self.age, np.zeros(n, int)), np.append(self.hits, np.ones(n, int))
        self.confidence = np.append(self.confidence, confidence[new])
        keep = self.age <= self.config.max_age
        for name in ("ids", "boxes", "speed", "age", "hits", "confidence"):
            setattr(self, name, getattr(self, name)[keep])
        out = np.flatnonzero((self.hits >= self.config.confirm_hits) & (self.age == 0))
        return [(int(self.ids[i]), *self.boxes[i].tolist(), float(self.confidence[i])) for i in out]


TRACKED = "track_id int, x1 double, y1 double, x2 double, y2 double, confidence double"


def track_detections(detections: DataFrame, frames: DataFrame, config: TrackerConfig = TrackerConfig(), match: str = "match_no") -> DataFrame:
    """Rows (match, frame_index, track_id, box, confidence) of confirmed tracks.

    detections: match, frame_index, ord, label, confidence, x1, y1, x2, y2; those labelled 'ball' and boxes with a null
    or reversed corner are left out, a null confidence is 0. Frames without detections age the tracks. The frames of a
    match are folded in order, an Arrow batch at a time.
    """
    boxes = ["x1", "y1", "x2", "y2"]
    players = detections.where(~F.col("label").eqNullSafe("ball") & (F.col("x2") >= F.col("x1")) & (F.col("y2") >= F.col("y1")))
    rows = frames.select(match, "frame_index").distinct().join(players.select(match, "frame_index", "ord", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), *boxes), [match, "frame_index"], "left")
    kind = rows.schema[match].dataType.simpleString()

    class Fold:
        def __init__(self) -> None:
            self.tracker = TrackFold(config)

        def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for frame, own in pdf.groupby("frame_index", sort=True):
                own = own[own.x1.notna()]
                out += [(pdf[match].iat[0], frame, *row) for row in self.tracker.step(own[boxes].to_numpy(float), own.confidence.to_numpy(float))]
            return pd.DataFrame(out, columns=[match, "frame_index", "track_id", *boxes, "confidence"])

    return fold_in_order(rows, match, ["frame_index", "ord"], Fold, f"{match} {kind}, frame_index int, {TRACKED}")


def usable_detections(detections: DataFrame, *, labels: dict[str, str] | None = None, floors: dict[str, float] | None = None) -> DataFrame:
    """Detections with their classes named (others dropped) and those below their class's floor of confidence left out."""
    named = detections
    if labels:
        named = named.withColumn("label", F.coalesce(*[F.when(F.col("label") == k, v) for k, v in labels.items()])).where(F.col("label").isNotNull())
    for label, floor in (floors or {}).items():
        named = named.where(~F.col("label").eqNullSafe(label) | (F.coalesce("confidence", F.lit(0.0)) >= floor))
    return named
