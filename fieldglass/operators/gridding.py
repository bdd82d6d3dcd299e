"""Irregular readings onto a regular grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def finite(col: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def regular_grid(
    readings: DataFrame,
    strides: DataFrame,
    *,
    keys: Sequence[str] = ("job_id", "track_id"),
    stride_key: str = "job_id",
    time: str = "frame_index",
    values: Sequence[str] = ("pitch_x", "pitch_y"),
    stride: str = "stride",
    max_gap: int = 5,
    block: int = 4096,
) -> DataFrame:
    """One row per source and period between its first and last usable reading.

    A reading is usable if all values are finite. Period k covers the times k*stride to (k+1)*stride - 1. Columns:
    the keys, stride, period, grid_time (k*stride), n_readings, the values, and status: 'observed' (mean of the
    period's readings, those of one time averaged first, so that repeated rows count once), 'filled' (the last
    observed values, at most max_gap periods old) or 'missing' (null values). Sources without usable readings, with a
    null key, or without a positive stride give no rows; a stride key with several rows uses the smallest.

    The time line of a source is cut into blocks of so many periods, each preceded by a copy of the last max_gap
    periods of the block before, so a source of any length is spread over tasks and the fill stays exact.
    """
    key_cols = [F.col(k) for k in keys]
    usable = readings.select(*key_cols, F.col(time).cast("long").alias("_time"), *[F.col(v).cast("double").alias(v) for v in values])
    for v in values:
        usable = usable.where(finite(F.col(v)))
    usable = usable.where(F.col("_time").isNotNull())
    for k in keys:
        usable = usable.where(F.col(k).isNotNull())
    steps = strides.groupBy(F.col(stride_key)).agg(F.min(F.when(F.col(stride) > 0, F.col(stride).cast("long"))).alias("stride")).where(F.col("stride").isNotNull())
    period = lambda c: F.floor(c / F.col("stride"))

    extents = (
        usable.groupBy(*keys)
        .agg(F.min("_time").alias("_from"), F.max("_time").alias("_to"))
        .join(steps, stride_key)
        .withColumns({"_from": period(F.col("_from")), "_to": period(F.col("_to"))})
    )
    spine = (
        extents.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor(F.col("_to") / block))))
        .withColumn("period", F.explode(F.sequence(F.greatest("_from", F.col("_block") * block - max_gap), F.least("_to", F.col("_block") * block + (block - 1)))))
        .select(*keys, "stride", "_block", "period")
    )

    home = F.floor(F.col("period") / block)
    placed = usable.join(steps, stride_key).withColumn("period", period(F.col("_time")))
    placed = placed.withColumn("_block", F.explode(F.when(F.pmod("period", F.lit(block)) >= block - max_gap, F.array(home, home + 1)).otherwise(F.array(home))))
    placed = placed.select(*keys, "_block", "period", "_time", *values).repartition(*keys, "_block")
    by_time = placed.groupBy(*keys, "_block", "period", "_time").agg(*[F.avg(v).alias(v) for v in values])
    observed = by_time.groupBy(*keys, "_block", "period").agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n_readings"))

    line = Window.partitionBy(*keys, "_block").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = spine.join(observed, [*keys, "_block", "period"], "left")
    carried = joined.withColumn("_seen", F.last(F.when(F.col("n_readings").isNotNull(), F.struct(F.col("period").alias("at"), *values)), ignorenulls=True).over(line))
    carried = carried.where(F.col("period") >= F.col("_block") * block)
    near = F.col("period") - F.col("_seen.at") <= max_gap
    return carried.select(
        *keys,
        "stride",
        "period",
        (F.col("period") * F.col("stride")).cast("int").alias("grid_time"),
        F.coalesce("n_readings", F.lit(0)).alias("n_readings"),
        *[F.when(near, F.col(f"_seen.{v}")).alias(v) for v in values],
        F.when(F.col("n_readings").isNotNull(), "observed").when(near, "filled").otherwise("missing").alias("status"),
    )
