"""Image lines and conics: merging, families, strongest lines, conic fits, support of a projected template."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from fieldglass.functions import geometry as g
from fieldglass.session import spread


def strongest_lines(lines: DataFrame, keys: list[str], n: int) -> DataFrame:
    """At most n lines of each image by strength, then in order of rho: a cap that is the feature."""
    order = Window.partitionBy(*keys).orderBy(F.col("strength").desc(), "rho", "theta")
    return lines.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def line_gap(r1, t1, r2, t2, xs) -> np.ndarray:
    """Mean distance of two lines, measured along the normal of the first at three places on it."""
    nx, ny = np.cos(t1), np.sin(t1)
    along = np.asarray(xs)
    px, py = r1 * nx - along * ny, r1 * ny + along * nx
    return np.abs(px * np.cos(t2) + py * np.sin(t2) - r2).mean()


def merge_lines(lines: DataFrame, keys: list[str], *, least_gap: float, extent: float) -> DataFrame:
    """Lines (keys, rho, theta, strength) without those nearer than least_gap to a stronger one that is kept.

    The lines of one image are compared in order of strength, which is a fold; an image has tens of lines.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["strength", "rho", "theta"], ascending=[False, True, True], ignore_index=True)
        kept: list[int] = []
        places = (-extent / 2, 0.0, extent / 2)
        for i in range(len(pdf)):
            own = (pdf.rho[i], pdf.theta[i])
            if all(line_gap(pdf.rho[j], pdf.theta[j], *own, places) >= least_gap for j in kept):
                kept.append(i)
        return pdf.iloc[kept]

    return lines.groupBy(*keys).applyInPandas(fold, lines.schema)


def angle_families(theta: np.ndarray, rounds: int = 20) -> np.ndarray:
    """0 or 1 per angle: circular 2-means on doubled angles, so that an angle and its opposite are one; seeded by the two furthest apart."""
    v = np.stack([np.cos(2 * theta), np.sin(2 * theta)], axis=1)
    if len(v) < 2:
        return np.zeros(len(v), int)
    apart = v @ v.T
    i, j = np.unravel_index(apart.argmin(), apart.shape)
    centres = v[[min(i, j), max(i, j)]]
    for _ in range(rounds):
        own = (v @ centres.T).argmax(axis=1)
        sums = np.stack([v[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in (0, 1)])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
        if np.allclose(moved, centres, atol=1e-12):
            break
        centres = moved
    return (v @ centres.T).argmax(axis=1)


def line_families(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with family 0 or 1 by direction; family 0 holds the line of the smallest angle."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["theta", "rho"], ignore_index=True)
        own = angle_families(pdf.theta.to_numpy(float))
        return pdf.assign(family=(own != own[0]).astype("int32"))

    return lines.groupBy(*keys).applyInPandas(label, T.StructType(list(lines.schema.fields) + [T.StructField("family", T.IntegerType())]))


def fit_conic(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Conic a x2 + b xy + c y2 + d x + e y + f = 0 nearest to the points, of unit norm; None below five points or if they fix none."""
    if len(x) < 5:
        return None
    mx, my = x.mean(), y.mean()
    s = max(np.hypot(x - mx, y - my).mean(), 1e-12) / np.sqrt(2)
    u, v = (x - mx) / s, (y - my) / s
    _, sizes, vt = np.linalg.svd(np.stack([u * u, u * v, v * v, u, v, np.ones_like(u)], axis=1))
    if len(sizes) > 4 and sizes[4] < 1e-9:
        return None
    a, b, c, d, e, f = vt[-1]
    out = np.array([
        a / s**2, b / s**2, c / s**2,
        d / s - 2 * a * mx / s**2 - b * my / s**2, e / s - 2 * c * my / s**2 - b * mx / s**2,
        a * mx**2 / s**2 + b * mx * my / s**2 + c * my**2 / s**2 - d * mx / s - e * my / s + f,
    ])
    return out / np.linalg.norm(out)


def fitted_conics(points: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, conic array of six) of the groups whose points fix a conic. A group's points are one row's arrays."""
    fields = T.StructType([points.schema[k] for k in keys] + [T.StructField("conic", T.ArrayType(T.DoubleType()))])
    placed = points.select(*keys, "x", "y").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    lists = spread(placed, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("_p")).select(*keys, F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            conics = [fit_conic(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(b.x, b.y)]
            found = b[list(keys)].assign(conic=pd.Series(conics, index=b.index, dtype=object))
            yield found[[c is not None for c in conics]]

    return lists.mapInPandas(fit, fields)


def conic_inliers(points: Column, conic: Column, within: float) -> Column:
    """Of an array of points (x, y) those within a Sampson distance of the conic (array of six)."""
    parts = [F.get(conic, F.lit(i)) for i in range(6)]
    return F.filter(points, lambda p: g.sampson_distance(parts, p["x"], p["y"]) <= within)


def template_support(probes: DataFrame, keys: list[str], *, distance: str = "distance", hit: float = 3.0, least_share: float = 0.25) -> DataFrame:
    """Share of visible template points that lie on painted pixels: rows (keys, support).

    distance is how far the nearest line pixel is from a projected template point, null where the point is out of view.
    Support is 0 where fewer than least_share of the points are in view.
    """
    seen = F.count(distance)
    hits = F.count_if(F.col(distance) <= hit)
    return probes.groupBy(*keys).agg(F.when(seen >= least_share * F.count(F.lit(1)), hits / F.greatest(seen, F.lit(1))).otherwise(0.0).alias("support"))
