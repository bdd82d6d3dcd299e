"""Which side a track plays for: kit colours, running votes, goalkeepers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window


def dominant_colours(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean red, green, blue per crop without the grass; crops with fewer than 8 pixels or a tenth left give no row."""
    grass = (F.col("g") > 1.15 * F.col("r")) & (F.col("g") > 1.15 * F.col("b"))
    seen = lambda c: F.avg(F.when(~grass, F.col(c))).alias(c)
    sums = pixels.groupBy(*keys).agg(seen("r"), seen("g"), seen("b"), F.count_if(~grass).alias("_kit"), F.count(F.lit(1)).alias("_all"))
    return sums.where(F.col("_kit") >= F.greatest(F.lit(8), F.col("_all") * 0.1)).select(*keys, "r", "g", "b")


def two_kits(colours: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Two mean colours (darker first) by 2-means from the two colours furthest apart."""
    d = ((colours[:, None, :] - colours[None, :, :]) ** 2).sum(axis=2)
    i, j = np.unravel_index(np.argmax(np.triu(d, 1) - np.tri(len(colours))), d.shape)
    centres, own = colours[[i, j]].astype(float), None
    for _ in range(rounds):
        now = ((colours - centres[1]) ** 2).sum(axis=1) < ((colours - centres[0]) ** 2).sum(axis=1)
        if own is not None and (now == own).all():
            break
        own = now
        for c, mask in enumerate((~own, own)):
            if mask.any():
                centres[c] = colours[mask].mean(axis=0)
    return centres if centres[0].sum() <= centres[1].sum() else centres[::-1]


def kit_profiles(colours: DataFrame, match: str = "match_no", least: int = 6) -> DataFrame:
    """Per match the kit colours of home (darker) and away and their separation; matches with fewer samples give no row.

    The samples of a match are those of its sampled frames; the seed compares them pairwise in one task.
    """
    d, kind = T.DoubleType(), colours.schema[match]
    fields = T.StructType([kind, *[T.StructField(f"{side}_{c}", d) for side in ("home", "away") for c in "rgb"], T.StructField("separation", d), T.StructField("is_reliable", T.BooleanType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf[["r", "g", "b"]].dropna().to_numpy(float)
        if len(values) < least:
            return pd.DataFrame(columns=fields.names)
        kits = two_kits(values)
        apart = float(np.linalg.norm(kits[0] - kits[1]))
        return pd.DataFrame([(pdf[match].iloc[0], *kits[0], *kits[1], apart, apart >= 40)], columns=fields.names)

    return colours.select(match, "r", "g", "b").groupBy(match).applyInPandas(fit, fields)


def nearest_kit(r: Column, g: Column, b: Column) -> Column:
    """Side whose kit is nearer, home if neither is; needs the columns of kit_profiles."""
    far = lambda side: (r - F.col(f"{side}_r")) ** 2 + (g - F.col(f"{side}_g")) ** 2 + (b - F.col(f"{side}_b")) ** 2
    return F.when(far("home") <= far("away"), "home").otherwise("away")


def running_votes(votes: DataFrame, *, least: int = 5, match: str = "match_no") -> DataFrame:
    """team: the side a track was taken for most often up to this frame, the first seen of equals; unknown below least votes.

    vote is 'home', 'away' or null; a null is no vote.
    """
    line = Window.partitionBy(match, "track_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    home, away = F.count_if(F.col("vote") == "home").over(line), F.count_if(F.col("vote") == "away").over(line)
    counted = votes.withColumns({"_h": home, "_a": away, "_f": F.first("vote", ignorenulls=True).over(line)})
    side = F.when(F.col("_h") > F.col("_a"), "home").when(F.col("_a") > F.col("_h"), "away").otherwise(F.col("_f"))
    return counted.withColumn("team", F.when(F.col("_h") + F.col("_a") >= least, side).otherwise("unknown")).drop("_h", "_a", "_f")


def goalkeepers(positions: DataFrame, *, length: float | str = 105.0, match: str = "match_no", share: float = 0.12) -> DataFrame:
    """Rows (match, track_id, team, mean_x): the track nearest either goal line by mean x, if within share of the pitch.

    length is that of all pitches, or the column that holds it; a match of unknown length gives no row.
    """
    size = F.col(length) if isinstance(length, str) else F.lit(float(length))
    means = positions.where(F.col("x").isNotNull()).groupBy(match, "track_id").agg(F.avg("x").alias("mean_x"), F.min("team").alias("team"), F.max(size).alias("_length"))
    row = F.struct("track_id", "team", "mean_x")
    ends = means.groupBy(match).agg(F.min_by(row, F.struct("mean_x", "track_id")).alias("_deep"), F.max_by(row, F.struct("mean_x", "track_id")).alias("_high"), F.count(F.lit(1)).alias("_n"), F.max("_length").alias("_length"))
    near = F.array_compact(F.array(F.when(F.col("_deep.mean_x") < F.col("_length") * share, F.col("_deep")), F.when(F.col("_high.mean_x") > F.col("_length") * (1 - share), F.col("_high"))))
    return ends.where(F.col("_n") >= 2).select(match, F.explode(near).alias("k")).select(match, "k.*").distinct()
