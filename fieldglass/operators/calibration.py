"""Homographies from point pairs, their gate over time, and calibration quality."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from fieldglass.functions import geometry as g
from fieldglass.operators.ordered import fold_in_order
from fieldglass.session import spread


@dataclass(frozen=True)
class CalibrationConfig:
    threshold: float = 1.5
    samples: int = 1000
    seed: int = 0
    max_error: float = 3.0
    min_inliers: int = 5
    max_jump: float = 15.0
    max_coast: int = 10
    probe: tuple[float, float] = (960.0, 540.0)
    reacquire_after: int | None = None  # accept a new place after so many rejections in a row; None: never


def _centred(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved to their mean and scaled to a mean distance of the root of two, and the matrix that does it; batched."""
    mean = p.mean(axis=-2, keepdims=True)
    spread = np.linalg.norm(p - mean, axis=-1).mean(axis=-1)
    s = np.where(spread > 1e-12, np.sqrt(2.0) / np.maximum(spread, 1e-12), 1.0)
    t = np.zeros((*p.shape[:-2], 3, 3))
    t[..., 0, 0] = t[..., 1, 1] = s
    t[..., :2, 2] = -s[..., None] * mean[..., 0, :]
    t[..., 2, 2] = 1.0
    return (p - mean) * s[..., None, None], t


def fit_homographies(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Least-squares homographies (..., 3, 3) over all pairs (..., n, 2), in normalised coordinates; NaN where degenerate."""
    a, ta = _centred(src)
    b, tb = _centred(dst)
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], -1)], axis=-2)
    right = np.concatenate([u, v], axis=-1)
    normal, rhs = np.swapaxes(rows, -1, -2) @ rows, np.einsum("...ij,...i->...j", rows, right)
    flat = np.abs(np.linalg.det(normal)) < 1e-12
    normal = np.where(flat[..., None, None], np.eye(8), normal)
    h = np.concatenate([np.linalg.solve(normal, rhs[..., None])[..., 0], np.ones((*rhs.shape[:-1], 1))], axis=-1).reshape(*rhs.shape[:-1], 3, 3)
    out = np.linalg.inv(tb) @ h @ ta
    out[flat] = np.nan
    return out


def apply_homography(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Points through homographies; NaN on the horizon."""
    q = p @ np.swapaxes(h[..., :2], -1, -2) + h[..., None, :, 2]
    w = np.where(np.abs(q[..., 2:]) < 1e-12, np.nan, q[..., 2:])
    return q[..., :2] / w


def robust_homography(src: np.ndarray, dst: np.ndarray, config: CalibrationConfig = CalibrationConfig()) -> tuple[np.ndarray, np.ndarray] | None:
    """(homography, inlier mask) by consensus of random samples of four, refitted on the inliers; None if there is none.

    All samples are fitted and judged in one batch. The first sample with most inliers counts.
    """
    n = len(src)
    if n < 4:
        return None
    if n == 4:
        h = fit_homographies(src, dst)
        return None if np.isnan(h).any() else (h, np.ones(4, bool))
    rng = np.random.default_rng(config.seed)
    pick = rng.random((config.samples, n)).argpartition(3, axis=1)[:, :4]
    with np.errstate(all="ignore"):
        tried = fit_homographies(src[pick], dst[pick])
        off = np.linalg.norm(apply_homography(tried, src[None]) - dst[None], axis=-1)
    inside = off <= config.threshold  # NaN is not
    best = inside[inside.sum(axis=1).argmax()]
    if best.sum() < 4:
        return None
    h = fit_homographies(src[best], dst[best])
    return None if np.isnan(h).any() else (h, best)


CALIBRATION = [T.StructField("h", T.ArrayType(T.DoubleType())), T.StructField("error", T.DoubleType()), T.StructField("inliers", T.IntegerType()), T.StructField("total_keypoints", T.IntegerType())]


def calibrate(keypoints: DataFrame, key: tuple[str, ...] = ("match_no", "frame_index"), config: CalibrationConfig = CalibrationConfig()) -> DataFrame:
    """Per frame with keypoints (img_x, img_y, pitch_x, pitch_y, in order of ord) its homography h, row by row.

    h, error and inliers are null where there are fewer than four pairs, no consensus, too few inliers or too large an
    error. Pairs with a null coordinate are left out. Frames are worked off in Arrow batches.
    """
    whole = keypoints.where(F.col("img_x").isNotNull() & F.col("img_y").isNotNull() & F.col("pitch_x").isNotNull() & F.col("pitch_y").isNotNull())
    lists = spread(whole, *key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", "img_x", "img_y", "pitch_x", "pitch_y"))).alias("_k"))
    lists = lists.select(*key, *[F.col(f"_k.{c}").alias(c) for c in ("img_x", "img_y", "pitch_x", "pitch_y")])
    fields = T.StructType([lists.schema[k] for k in key] + CALIBRATION)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ix, iy, px, py in zip(b.img_x, b.img_y, b.pitch_x, b.pitch_y):
                src, dst = np.stack([ix, iy], 1).astype(float), np.stack([px, py], 1).astype(float)
                found = robust_homography(src, dst, config)
                row = (None, None, None, len(src))
                if found is not None and found[1].sum() >= config.min_inliers:
                    error = float(np.linalg.norm(apply_homography(found[0], src[found[1]]) - dst[found[1]], axis=1).mean())
                    if error <= config.max_error:
                        row = (found[0].ravel(), error, int(found[1].sum()), len(src))
                rows.append(row)
            yield pd.concat([b[list(key)].reset_index(drop=True), pd.DataFrame(rows, columns=[f.name for f in CALIBRATION])], axis=1)

    return lists.mapInPandas(fit, fields)


class Gate:
    """Fold over the calibrations of a match: rejects jumps of the view, coasts over short losses."""

    def __init__(self, config: CalibrationConfig = CalibrationConfig(), state: dict | None = None):
        self.config = config
        self.last, self.coasted, self.rejected = (state or {}).get("last"), (state or {}).get("coasted", 0), (state or {}).get("rejected", 0)

    def state(self) -> dict:
        return {"last": self.last, "coasted": self.coasted, "rejected": self.rejected}

    def _seen(self, h: list[float]) -> np.ndarray:
        return apply_homography(np.array(h, float).reshape(3, 3), np.array([self.config.probe]))[0]

    def push(self, h: list[float] | None) -> tuple[list[float] | None, str]:
        """(the homography to use, 'fitted', 'coasted' or 'lost')."""
        if h is not None and self.last is not None:
            jump = np.linalg.norm(self._seen(h) - self._seen(self.last))
            limit = self.config.reacquire_after
            if jump > self.config.max_jump and not (limit is not None and self.rejected >= limit):
                self.rejected += 1
                h = None
        if h is not None:
            self.last, self.coasted = list(map(float, h)), 0
            if self.config.reacquire_after is not None:
                self.rejected = 0
            return self.last, "fitted"
        if self.last is not None and self.coasted < self.config.max_coast:
            self.coasted += 1
            return self.last, "coasted"
        return None, "lost"


def gate_calibrations(calibrations: DataFrame, match: str = "match_no", config: CalibrationConfig = CalibrationConfig()) -> DataFrame:
    """Rows (match, frame_index, h, status) after the gate; needs a row per frame, with a null h where there is no fit."""
    fields = T.StructType([calibrations.schema[match], calibrations.schema["frame_index"], T.StructField("h", T.ArrayType(T.DoubleType())), T.StructField("status", T.StringType())])

    class Fold:
        def __init__(self) -> None:
            self.gate = Gate(config)

        def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
            out = [self.gate.push(None if h is None else list(h)) for h in pdf.h]
            return pd.DataFrame({match: pdf[match], "frame_index": pdf.frame_index, "h": [o[0] for o in out], "status": [o[1] for o in out]})

    return fold_in_order(calibrations.select(match, "frame_index", "h"), match, ["frame_index"], Fold, fields)


# The places on the pitch at which two calibrations are compared.
PROBES = [(x, y) for x in (2.0, 26.0, 52.5, 79.0, 103.0) for y in (2.0, 34.0, 66.0)]


def with_truth_error(df: DataFrame, estimate: str, truth: str) -> DataFrame:
    """truth_error: mean distance in metres between where two image-to-pitch homographies put the same image points.

    Both are arrays of nine. The image points are the probes seen through the true camera; null if the truth has no
    inverse or a probe no image.
    """
    cell = lambda a: [F.get(a, F.lit(i)) for i in range(9)]
    probes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in PROBES])
    df = df.withColumn("_back", F.array(*g.matrix_inverse(cell(truth))))

    def image(p):
        x, y = g.project(cell("_back"), p["x"], p["y"])
        return F.struct(x.alias("ix"), y.alias("iy"), p["x"].alias("x"), p["y"].alias("y"))

    def gap(p):
        x, y = g.project(cell(estimate), p["ix"], p["iy"])
        return g.distance(x, y, p["x"], p["y"])

    df = df.withColumn("_image", F.transform(probes, image)).withColumn("_gaps", F.filter(F.transform("_image", gap), lambda d: d.isNotNull()))
    whole = F.forall("_image", lambda p: p["ix"].isNotNull()) & (F.size("_gaps") > 0)
    mean = F.aggregate("_gaps", F.lit(0.0), lambda s, d: s + d) / F.greatest(F.size("_gaps"), F.lit(1))
    return df.withColumn("truth_error", F.when(whole, mean)).drop("_back", "_image", "_gaps")


def tail_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, p90 (the value at place floor(0.9 n) of the sorted ones, the last at most) and worst of non-null values."""
    # equal values count as one row, and rows get their ranks from counts per range of values: no group is ordered in one task
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ends = known.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("worst"), F.sum("_c").alias("n"))
    same = lambda a, b, on: functools.reduce(operator.and_, [a[k].eqNullSafe(b[k]) for k in on], F.lit(True))
    k, e = known.alias("k"), ends.alias("e")
    share = (F.col("_v") - F.col("_low")) / F.greatest(F.col("worst") - F.col("_low"), F.lit(1e-300))
    binned = k.join(e, same(known, ends, keys)).select(*[F.col(f"k.{c}") for c in keys], "_v", "_c", "_low", "worst", "n").withColumn("_bin", F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 1000).cast("int"))
    own = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_here"))
    own = own.withColumn("_under", F.sum("_here").over(Window.partitionBy(*keys).orderBy("_bin")) - F.col("_here"))  # 1,001 rows a group at most
    b, o = binned.alias("b"), own.alias("o")
    placed = b.join(o, same(binned, own, [*keys, "_bin"])).select(*[F.col(f"b.{c}") for c in keys], "b._bin", "_v", "_c", "worst", "n", "_under")
    places = [F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2), F.least(F.col("n") - 1, F.floor(F.col("n") * 0.9))]
    upto = F.col("_under") + F.sum("_c").over(Window.partitionBy(*keys, "_bin").orderBy("_v"))
    ranked = placed.withColumn("_upto", upto)
    at = lambda p: F.min(F.when(F.col("_upto") > p, F.col("_v")))
    out = ranked.groupBy(*keys).agg(F.first("n").alias("n"), at(places[0]).alias("_a"), at(places[1]).alias("_b"), at(places[2]).alias("p90"), F.first("worst").alias("worst"))
    return out.select(*keys, "n", ((F.col("_a") + F.col("_b")) / 2).alias("median"), "p90", "worst")


def ground_truth(df: DataFrame, column: str = "json") -> DataFrame:
    """Rows (frame_index, h) of JSON lists with one entry a frame, null or nine numbers; another length is an error."""
    parsed = df.select(F.posexplode(F.from_json(column, T.ArrayType(T.ArrayType(T.DoubleType())))).alias("frame_index", "h"))
    wrong = F.raise_error(F.format_string("a homography has nine elements, not %d", F.size("h")))
    return parsed.withColumn("h", F.when(F.col("h").isNull() | (F.size("h") == 9), F.col("h")).otherwise(wrong.cast("array<double>")))


def fitted_lines(points: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Per group the line a x + b y = c that is nearest to its points, by distance from the line; null below two points."""
    sums = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_pop(x).alias("_xx"), F.var_pop(y).alias("_yy"), F.covar_pop(x, y).alias("_xy"))
    theta = 0.5 * F.atan2(2 * F.col("_xy"), F.col("_xx") - F.col("_yy"))
    lines = sums.where(F.col("_n") >= 2).withColumns({"a": -F.sin(theta), "b": F.cos(theta)})
    return lines.withColumn("c", F.col("a") * F.col("_mx") + F.col("b") * F.col("_my")).select(*keys, "a", "b", "c")


# Annotated line classes, the axis they are constant in, and where, for a pitch of 105 by 68 metres.
LINE_CLASSES = {
    "Side line left": ("x", 0.0), "Side line right": ("x", 105.0), "Middle line": ("x", 52.5),
    "Big rect. left main": ("x", 16.5), "Big rect. right main": ("x", 88.5), "Small rect. left main": ("x", 5.5), "Small rect. right main": ("x", 99.5),
    "Side line top": ("y", 0.0), "Side line bottom": ("y", 68.0),
    "Big rect. left top": ("y", 13.84), "Big rect. left bottom": ("y", 54.16), "Big rect. right top": ("y", 13.84), "Big rect. right bottom": ("y", 54.16),
    "Small rect. left top": ("y", 24.84), "Small rect. left bottom": ("y", 43.16), "Small rect. right top": ("y", 24.84), "Small rect. right bottom": ("y", 43.16),
}


def calibrate_annotations(points: DataFrame, image_width: int, image_height: int, min_lines: int = 4) -> DataFrame:
    """Homographies of images from points (image_id, class, x, y in shares of the image) on annotated pitch lines.

    A line is fitted to the points of each known class; crossings of lines along and across the pitch are the point
    pairs. Images with fewer than min_lines lines, or fewer than two either way, give no row.
    """
    spark = points.sparkSession
    classes = spark.createDataFrame([(k, a, c) for k, (a, c) in LINE_CLASSES.items()], "class string, axis string, at double")
    known = points.join(F.broadcast(classes), "class")  # seventeen rows
    pixels = known.withColumns({"px": F.col("x") * (image_width - 1), "py": F.col("y") * (image_height - 1)})
    lines = fitted_lines(pixels, ["image_id", "class", "axis", "at"], "px", "py")
    enough = lines.groupBy("image_id").agg(F.count_if(F.col("axis") == "x").alias("_x"), F.count_if(F.col("axis") == "y").alias("_y"))
    enough = enough.where((F.col("_x") >= 2) & (F.col("_y") >= 2) & (F.col("_x") + F.col("_y") >= min_lines)).select("image_id")
    lines = lines.join(enough, "image_id", "left_semi")
    one = lines.where(F.col("axis") == "x").select("image_id", *[F.col(c).alias(f"{c}1") for c in ("at", "a", "b", "c")])
    two = lines.where(F.col("axis") == "y").select("image_id", *[F.col(c).alias(f"{c}2") for c in ("at", "a", "b", "c")])
    det = F.col("a1") * F.col("b2") - F.col("a2") * F.col("b1")
    crossings = one.join(two, "image_id").where(F.abs(det) >= 1e-9).select(
        "image_id", F.row_number().over(Window.partitionBy("image_id").orderBy("at1", "at2")).alias("ord"),
        ((F.col("c1") * F.col("b2") - F.col("c2") * F.col("b1")) / det).alias("img_x"), ((F.col("a1") * F.col("c2") - F.col("a2") * F.col("c1")) / det).alias("img_y"), F.col("at1").alias("pitch_x"), F.col("at2").alias("pitch_y"),
    )
    return calibrate(crossings, ("image_id",), CalibrationConfig(threshold=2.0, samples=200, seed=3, min_inliers=4, max_error=float("inf")))
