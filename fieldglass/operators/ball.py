"""The ball's trajectory: outliers, gaps, smoothing, and the likeliest path through candidates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from fieldglass.operators.ordered import CHUNK, carried, fold_in_order


@dataclass(frozen=True)
class BallConfig:
    max_speed: float = 45.0
    max_gap: int = 50
    max_extrapolate: int = 5
    smoothing_window: int = 5
    missing_cost: float = 1.2
    metre_cost: float = 0.05


def _schema(df: DataFrame, *more: T.StructField) -> T.StructType:
    return T.StructType(list(df.schema.fields) + list(more))


def reject_outliers(track: DataFrame, *, fps: float = 25.0, config: BallConfig = BallConfig(), match: str = "match_no") -> DataFrame:
    """x, y of one row per frame with a point made null if it cannot be reached from the last accepted one at max_speed.

    What is accepted decides about what follows, so a match is folded in order of its frames, an Arrow batch at a time.
    """
    dt = 1.0 / fps if fps > 0 else 0.04

    class Fold:
        anchor: tuple[float, float, float] | None = None

        def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
            f, x, y = pdf.frame_index.to_numpy(float), pdf.x.to_numpy(float), pdf.y.to_numpy(float)
            drop = []
            for i in np.flatnonzero(~(np.isnan(x) | np.isnan(y))).tolist():
                if self.anchor is not None:
                    elapsed = (f[i] - self.anchor[0]) * dt
                    if elapsed > 0 and np.hypot(x[i] - self.anchor[1], y[i] - self.anchor[2]) / elapsed > config.max_speed:
                        drop.append(i)
                        continue
                    if elapsed <= 0:
                        continue
                self.anchor = (f[i], x[i], y[i])
            pdf.loc[drop, ["x", "y"]] = np.nan
            return pdf

    out = fold_in_order(track, match, ["frame_index"], Fold, track.schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y")})


def interpolate(track: DataFrame, *, config: BallConfig = BallConfig(), match: str = "match_no") -> DataFrame:
    """x, y of one row per frame with gaps of at most max_gap frames filled in a straight line.

    Before the first and after the last known point it is held for max_extrapolate frames.
    """
    known = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("frame_index", "x", "y"))
    both = carried(track, {"_p": (known, "last"), "_n": (known, "next")}, match=match)
    f, p, n = F.col("frame_index"), F.col("_p.frame_index"), F.col("_n.frame_index")
    w = F.when(n > p, (f - p) / (n - p)).otherwise(F.lit(0.0))

    def value(c: str):
        return (
            F.when(f == p, F.col(c))
            .when(p.isNotNull() & n.isNotNull(), F.when(n - p - 1 <= config.max_gap, F.col(f"_p.{c}") + (F.col(f"_n.{c}") - F.col(f"_p.{c}")) * w))
            .when(n.isNotNull(), F.when(n - f <= config.max_extrapolate, F.col(f"_n.{c}")))
            .when(p.isNotNull(), F.when(f - p <= config.max_extrapolate, F.col(f"_p.{c}")))
        )

    return both.withColumns({"_x": value("x"), "_y": value("y")}).withColumns({"x": F.col("_x"), "y": F.col("_y")}).drop("_p", "_n", "_x", "_y")


def smooth(track: DataFrame, *, config: BallConfig = BallConfig(), match: str = "match_no") -> DataFrame:
    """Centred moving average within runs of consecutive known frames; nothing is averaged across a gap."""
    half = max(1, config.smoothing_window | 1) // 2
    home, at = F.floor(F.col("frame_index") / CHUNK), F.pmod("frame_index", F.lit(CHUNK))
    chunks = F.array_compact(F.array(home, F.when(at < half, home - 1), F.when(at >= CHUNK - half, home + 1)))  # with a copy of what lies next to it
    rows = track.withColumn("_chunk", F.explode(chunks)).withColumn("_own", F.col("_chunk") == home)
    known = F.col("x").isNotNull()
    keys = [match, "_chunk", known]
    runs = rows.withColumn("_run", F.col("frame_index") - F.row_number().over(Window.partitionBy(*keys).orderBy("frame_index")))
    near = Window.partitionBy(*keys, "_run").orderBy("frame_index").rowsBetween(-half, half)
    return runs.withColumns({c: F.when(known, F.avg(c).over(near)) for c in ("x", "y")}).where("_own").drop("_run", "_own", "_chunk")


def repair(track: DataFrame, *, fps: float = 25.0, config: BallConfig = BallConfig(), match: str = "match_no") -> DataFrame:
    """Outliers out, gaps filled, then smoothed."""
    return smooth(interpolate(reject_outliers(track, fps=fps, config=config, match=match), config=config, match=match), config=config, match=match)


def best_candidate(candidates: DataFrame, match: str = "match_no") -> DataFrame:
    """The most confident candidate of each frame, the first listed of equals."""
    best = F.min_by(F.struct("x", "y", "confidence"), F.struct(-F.col("confidence"), "ord"))
    return candidates.groupBy(match, "frame_index").agg(best.alias("b")).select(match, "frame_index", "b.*")


def best_path(candidates: DataFrame, frames: DataFrame, *, fps: float = 25.0, config: BallConfig = BallConfig(), match: str = "match_no") -> DataFrame:
    """x, y per frame of the cheapest path through the candidates, null where it has none.

    A candidate costs 1 - confidence, a frame without one missing_cost, and motion between candidates of adjacent
    frames metre_cost a metre, at most at max_speed. Of equal costs the first listed candidate counts, none last. A task
    holds the frames from one without candidates to the next.
    """
    dt = 1.0 / fps if fps > 0 else 0.04
    lists = candidates.groupBy(match, "frame_index").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y", "confidence"))).alias("_c"))
    rows = frames.select(match, "frame_index").distinct().join(lists, [match, "frame_index"], "left")
    rows = rows.select(match, "frame_index", *[F.coalesce(F.col(f"_c.{c}"), F.array().cast("array<double>")).alias(f"_{c}") for c in ("x", "y", "confidence")])
    fields = T.StructType([rows.schema[match], rows.schema["frame_index"], T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

    # all paths meet in a frame without candidates, so what lies between two such frames is a problem of its own
    rows = carried(rows, {"_part": (F.when(F.size("_x") == 0, 1).otherwise(0), "sum")}, match=match)

    def viterbi(pdf: pd.DataFrame) -> pd.DataFrame:
        cost, back = None, []
        px = py = np.zeros(0)
        for x, y, c in zip(pdf._x, pdf._y, pdf._confidence):
            x, y = np.asarray(x, float), np.asarray(y, float)
            emit = np.append(1.0 - np.asarray(c, float), config.missing_cost)
            if cost is None:
                cost = emit
                back.append(np.full(len(emit), -1))
            else:
                step = np.zeros((len(emit), len(cost)))  # to, from; the last of either is 'missing'
                d = np.hypot(x[:, None] - px[None, :], y[:, None] - py[None, :])
                step[:-1, :-1] = np.where(d / dt > config.max_speed, np.inf, config.metre_cost * d)
                total = cost[None, :] + step
                pick = total.argmin(axis=1)
                cost = total[np.arange(len(emit)), pick] + emit
                back.append(pick)
            px, py = x, y
        j = int(cost.argmin())
        path = [j]
        for pick in back[:0:-1]:
            j = int(pick[j])
            path.append(j)
        path.reverse()
        at = [(x[j], y[j]) if j < len(x) else (None, None) for x, y, j in zip(pdf._x, pdf._y, path)]
        return pd.DataFrame({match: pdf[match], "frame_index": pdf.frame_index, "x": [a[0] for a in at], "y": [a[1] for a in at]})

    return fold_in_order(rows, match, ["frame_index"], lambda: viterbi, fields, segment="_part")
