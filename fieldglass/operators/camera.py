"""Pinhole cameras fitted to point pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.session import spread

#: focal length (pixels), pan, tilt (radians), position (metres).
PARAMETERS = ("focal", "pan", "tilt", "x", "y", "z")


def see(p: np.ndarray, centre: tuple[float, float], pitch: np.ndarray) -> np.ndarray:
    """Image points of pitch points; NaN behind the camera. pan turns from looking along +y, tilt looks down."""
    focal, pan, tilt, x, y, z = p
    s, c, st, ct = np.sin(pan), np.cos(pan), np.sin(tilt), np.cos(tilt)
    turn = np.array([[c, -s, 0.0], [-s * st, -c * st, -ct], [s * ct, c * ct, -st]])
    local = (np.column_stack([pitch, np.zeros(len(pitch))]) - [x, y, z]) @ turn.T
    depth = np.where(local[:, 2] > 1e-6, local[:, 2], np.nan)
    return np.column_stack([focal * local[:, 0] / depth + centre[0], focal * local[:, 1] / depth + centre[1]])


def fit_camera(image: np.ndarray, pitch: np.ndarray, centre: tuple[float, float], rounds: int = 200) -> tuple[np.ndarray, float] | None:
    """(parameters, root mean square error in pixels) by damped least squares from places on either touchline; None below four pairs.

    The scale of each parameter is its own, so that metres, radians and pixels are damped alike.
    """
    if len(image) < 4:
        return None
    scale = np.array([1000.0, 0.3, 0.1, 20.0, 20.0, 10.0])
    best = None
    for start in ((1500.0, 0.0, 0.25, 52.5, -40.0, 15.0), (1500.0, np.pi, 0.25, 52.5, 108.0, 15.0)):
        p, damp = np.array(start), 1e-2
        off = lambda q: np.nan_to_num(see(q, centre, pitch) - image, nan=1e4).ravel()
        r = off(p)
        for _ in range(rounds):
            jac = np.stack([(off(p + 1e-6 * scale * e) - r) / 1e-6 for e in np.eye(6)], axis=1)
            step = np.linalg.solve(jac.T @ jac + damp * np.diag(np.maximum(np.diag(jac.T @ jac), 1e-9)), -jac.T @ r)
            q = p + step * scale
            s = off(q)
            if s @ s < r @ r:
                small = abs(r @ r - s @ s) <= 1e-14 * (r @ r)
                p, r, damp = q, s, max(damp / 5, 1e-12)
                if small or r @ r < 1e-18:
                    break
            elif damp > 1e12:
                break
            else:
                damp *= 4
        error = float(np.sqrt(r @ r / len(image)))
        if best is None or error < best[1]:
            best = (p, error)
    return best


def fit_cameras(keypoints: DataFrame, key: tuple[str, ...] = ("match_no", "frame_index"), *, centre: tuple[float, float] = (960.0, 540.0), max_error: float = 50.0) -> DataFrame:
    """Per frame with keypoints (img_x, img_y, pitch_x, pitch_y) its camera, or nulls where none fits within max_error pixels."""
    whole = keypoints.where(F.col("img_x").isNotNull() & F.col("img_y").isNotNull() & F.col("pitch_x").isNotNull() & F.col("pitch_y").isNotNull())
    columns = ["img_x", "img_y", "pitch_x", "pitch_y"]
    lists = spread(whole, *key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_k")).select(*key, *[F.col(f"_k.{c}").alias(c) for c in columns])
    fields = T.StructType([lists.schema[k] for k in key] + [T.StructField(c, T.DoubleType()) for c in (*PARAMETERS, "error")])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ix, iy, px, py in zip(b.img_x, b.img_y, b.pitch_x, b.pitch_y):
                found = fit_camera(np.column_stack([ix, iy]), np.column_stack([px, py]), centre)
                rows.append((*found[0], found[1]) if found and found[1] <= max_error else (None,) * 7)
            yield pd.concat([b[list(key)].reset_index(drop=True), pd.DataFrame(rows, columns=[*PARAMETERS, "error"], dtype=float)], axis=1)

    return lists.mapInPandas(fit, fields)
