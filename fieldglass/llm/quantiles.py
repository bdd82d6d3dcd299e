"""Percentiles of very large columns from mergeable rank-interval summaries.

A summary of n values is a sorted list of tuples (value, rmin, rmax): the value's rank among the n lies between rmin and
rmax. Merging two summaries adds rank intervals and loses nothing; compressing drops tuples as long as the uncertainty
between neighbours stays within what is permitted, and that uncertainty is carried along with the summary.

What is permitted grows from level to level of merging, up to the error asked for: a summary that has used up all it may
could not be compressed after the next merge.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from fieldglass.session import materialise

Summary = tuple[np.ndarray, np.ndarray, np.ndarray]


def compress(s: Summary, permitted: float) -> Summary:
    """Fewest tuples, with both ends, such that ranks between neighbours are uncertain by at most permitted where s allows it."""
    v, lo, hi = s
    if permitted < 2 or len(v) <= 3:
        return s
    keep = [0]
    at = 0
    while at < len(v) - 1:
        # hi is ascending: the furthest tuple whose upper rank is within reach of the kept one's lower rank
        far = int(np.searchsorted(hi, lo[at] + permitted, side="right")) - 1
        at = min(max(far, at + 1), len(v) - 1)
        keep.append(at)
    i = np.array(keep)
    return v[i], lo[i], hi[i]


def merge(a: Summary, b: Summary) -> Summary:
    """Summary of both sets of values together; rank intervals add."""
    if not len(a[0]):
        return b
    if not len(b[0]):
        return a

    def among(s: Summary, other: Summary, side: str) -> tuple[np.ndarray, np.ndarray]:
        below = np.searchsorted(other[0], s[0], side=side)  # other's tuples that come before
        lo = np.where(below > 0, other[1][np.maximum(below - 1, 0)], 0)
        n = other[2][-1]
        hi = np.where(below < len(other[0]), other[2][np.minimum(below, len(other[0]) - 1)] - 1, n)
        return s[1] + lo, s[2] + hi

    (la, ha), (lb, hb) = among(a, b, "left"), among(b, a, "right")
    v = np.concatenate([a[0], b[0]])
    order = np.lexsort((np.concatenate([la, lb]), v))
    lo, hi = np.concatenate([la, lb])[order], np.concatenate([ha, hb])[order]
    return v[order], np.maximum.accumulate(lo), np.minimum.accumulate(hi[::-1])[::-1]


def exact_summary(values: np.ndarray) -> Summary:
    v = np.sort(values)
    ranks = np.arange(1, len(v) + 1, dtype=np.int64)
    return v, ranks, ranks


def value_bounds(s: Summary, rank: int) -> tuple[float, float]:
    """Values between which the value of that rank (1 is the smallest) lies."""
    v, lo, hi = s
    below = int(np.searchsorted(hi, rank, side="right")) - 1
    above = int(np.searchsorted(lo, rank, side="left"))
    return float(v[max(below, 0)]), float(v[min(above, len(v) - 1)])


def estimate(s: Summary, q: float) -> tuple[float, float, float]:
    """Percentile q of the usual continuous kind (the median is the mean of the two middle values), and its bounds."""
    n = int(s[2][-1])
    at = q * (n - 1)
    w = at - int(at)
    (l0, h0), (l1, h1) = value_bounds(s, int(at) + 1), value_bounds(s, min(int(at) + 2, n))
    low, high = l0 + w * (l1 - l0), h0 + w * (h1 - h0)
    return (low + high) / 2, low, high


_SUMMARY = [T.StructField("n", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("rmin", T.ArrayType(T.LongType())), T.StructField("rmax", T.ArrayType(T.LongType()))]


def _row(s: Summary) -> tuple:
    exact = len(s[0]) == s[2][-1]  # its ranks are 1, 2, ...: not sent
    return int(s[2][-1]), s[0], None if exact else s[1], None if exact else s[2]


def _summary(v, rmin, rmax) -> Summary:
    v = np.asarray(v, dtype=float)
    if rmin is None:
        ranks = np.arange(1, len(v) + 1, dtype=np.int64)
        return v, ranks, ranks
    return v, np.asarray(rmin, dtype=np.int64), np.asarray(rmax, dtype=np.int64)


def _schema(df: DataFrame, names: Sequence[str], *more: T.StructField) -> T.StructType:
    return T.StructType([df.schema[c] for c in names] + list(more))


FAN_IN = 64  # summaries that are merged at a time
_IN_TASK = (0.25, 0.375, 0.5)  # shares of the error that the levels within one task may use, from the buffer upwards


def merged(several: list[Summary], permitted: float) -> Summary:
    """One summary of all; in pairs, the smallest first, so that none is passed over once per other."""
    todo = sorted(several, key=lambda s: len(s[0]))
    while len(todo) > 1:
        todo = [merge(todo[i], todo[i + 1]) if i + 1 < len(todo) else todo[i] for i in range(0, len(todo), 2)]
    return compress(todo[0], permitted * int(todo[0][2][-1]))


class _Stack:
    """Running summary of a group: at most fan_in summaries of every level are held, and merged into one of the next."""

    def __init__(self, error: float, shares: Sequence[float], fan_in: int):
        self.error, self.shares, self.fan_in = error, shares, fan_in
        self.levels: list[list[Summary]] = [[]]

    def add(self, s: Summary, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(s)
        if len(self.levels[level]) == self.fan_in:
            full, self.levels[level] = self.levels[level], []
            self.add(merged(full, self.error * self.shares[min(level + 1, len(self.shares) - 1)]), level + 1)

    def all(self) -> Summary:
        return merged([s for level in self.levels for s in level], self.error * self.shares[-1])


def _changes(b: pd.DataFrame, keys: Sequence[str]) -> tuple[np.ndarray, list[tuple]]:
    """Where the keys of consecutive rows change, and the keys from there on; equal nulls do not."""
    change = np.zeros(len(b), bool)
    change[:1] = True
    for k in keys:
        c = b[k].to_numpy()
        differs = c[1:] != c[:-1]
        if c.dtype.kind in "Of":
            differs = differs & ~(pd.isna(c[1:]) & pd.isna(c[:-1]))
        change[1:] |= np.asarray(differs, bool)
    starts = np.flatnonzero(change)
    heads = [tuple(None if pd.isna(h) else h for h in head) for head in b.iloc[starts][list(keys)].itertuples(index=False, name=None)]
    return starts, heads


def partial_summaries(df: DataFrame, keys: Sequence[str], value: str, *, error: float, buffer: int = 65_536, fan_in: int = FAN_IN) -> DataFrame:
    """Summaries of each partition: one row (keys, part, n, v, rmin, rmax) per group of a partition, with half the error at most.

    Nulls and NaN are no values. Nothing is shuffled; a partition is sorted by the keys, and of the group at hand one
    buffer and at most fan_in summaries of each level are held.
    """
    keys = list(keys)
    fields = _schema(df, keys, T.StructField("part", T.IntegerType()), *_SUMMARY)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        group, held, size, stack = None, [], 0, _Stack(error, _IN_TASK, fan_in)

        def flush() -> None:
            nonlocal held, size
            if size:
                s = exact_summary(np.concatenate(held))
                stack.add(compress(s, error * _IN_TASK[0] * len(s[0])))
            held, size = [], 0

        for b in batches:
            rows = []
            values = b[value].to_numpy(float)
            starts, heads = _changes(b, keys)
            for head, i, j in zip(heads, starts, [*starts[1:], len(b)]):
                if group is not None and head != group:
                    flush()
                    rows.append((*group, part, *_row(stack.all())))
                    stack = _Stack(error, _IN_TASK, fan_in)
                group = head
                held.append(values[i:j])
                size += j - i
                if size >= buffer:
                    flush()
            if rows:
                yield pd.DataFrame(rows, columns=fields.names)
        if group is not None:
            flush()
            yield pd.DataFrame([(*group, part, *_row(stack.all()))], columns=fields.names)

    usable = df.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value))
    return usable.sortWithinPartitions(*keys).mapInPandas(build, fields)


def merged_summaries(parts: DataFrame, keys: Sequence[str], *, error: float, fan_in: int = FAN_IN) -> DataFrame:
    """One summary per group of rows (keys, part, n, v, rmin, rmax), such as those of partitions or of days.

    Parts are written first, and their numbers say how many levels there are: at each level a task merges the rows of
    fan_in neighbouring parts, one after the other, and never holds more than fan_in of them. A hot group is so spread
    over tasks until few parts are left. The levels share the error from one half upwards.
    """
    keys = list(keys)
    parts = materialise(parts, "summaries")
    top = parts.agg(F.max("part")).first()[0] or 0
    levels = 1
    while fan_in**levels <= top:
        levels += 1
    fields = _schema(parts, [*keys, "part"], *_SUMMARY)
    for level in range(levels):
        share = 0.5 + 0.5 * (level + 1) / levels

        def combine(batches: Iterator[pd.DataFrame], share: float = share) -> Iterator[pd.DataFrame]:
            group, stack = None, None
            for b in batches:
                out = []
                starts, heads = _changes(b, [*keys, "part"])
                for head, i, j in zip(heads, starts, [*starts[1:], len(b)]):
                    if head != group:
                        if group is not None:
                            out.append((*group, *_row(stack.all())))
                        group, stack = head, _Stack(error, (share,), fan_in)
                    for k in range(i, j):
                        stack.add(_summary(b["v"].iat[k], b["rmin"].iat[k], b["rmax"].iat[k]))
                if out:
                    yield pd.DataFrame(out, columns=fields.names)
            if group is not None:
                yield pd.DataFrame([(*group, *_row(stack.all()))], columns=fields.names)

        parts = parts.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).repartition(*keys, "part").sortWithinPartitions(*keys, "part").mapInPandas(combine, fields)
    return parts.drop("part")


def quantile_summaries(df: DataFrame, keys: Sequence[str], value: str, *, error: float = 0.001, fan_in: int = FAN_IN) -> DataFrame:
    """Rows (keys, n, v, rmin, rmax), exact for up to 2 / error values; beyond, bounds of a rank lie within error * n of it.

    A null key forms a group of its own. Summaries kept from other days or partitions are merged by merged_summaries
    alone. Groups without a value give no row.
    """
    return merged_summaries(partial_summaries(df, keys, value, error=error, fan_in=fan_in), keys, error=error, fan_in=fan_in)


def summary_percentiles(summaries: DataFrame, keys: Sequence[str], percentiles: Sequence[float] = (0.5,)) -> DataFrame:
    """Rows (keys, percentile, n, estimate, low, high): the true percentile lies between low and high."""
    keys = list(keys)
    d = T.DoubleType()
    fields = _schema(summaries, keys, T.StructField("percentile", d), T.StructField("n", T.LongType()), *[T.StructField(c, d) for c in ("estimate", "low", "high")])

    def query(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            heads = list(b[keys].itertuples(index=False, name=None))
            rows = []
            for head, n, v, lo, hi in zip(heads, b.n, b.v, b.rmin, b.rmax):
                s = _summary(v, lo, hi)
                rows += [(*(None if pd.isna(h) else h for h in head), q, n, *estimate(s, q)) for q in percentiles]
            yield pd.DataFrame(rows, columns=fields.names)

    return summaries.mapInPandas(query, fields)


def readings_once(scores: DataFrame, value: str, *, frames: int = 16_384) -> DataFrame:
    """job_id, track_id, value with repeated readings of one frame counted once (of differing values the largest)."""
    chunk = F.floor(F.col("frame_index") / frames).alias("_chunk")
    usable = scores.where(F.col(value).isNotNull() & ~F.isnan(value)).select("job_id", "track_id", chunk, "frame_index", value)
    once = usable.repartition("job_id", "track_id", "_chunk").groupBy("job_id", "track_id", "_chunk", "frame_index").agg(F.max(value).alias(value))
    return once.select("job_id", "track_id", value)


def wrong_medians(summary: DataFrame, scores: DataFrame, *, stored: str = "median_space_owned", value: str = "space_owned", tolerance: float = 0.05, error: float = 0.001) -> DataFrame:
    """Distinct (job_id, track_id) whose stored median differs by more than tolerance from that of the readings.

    Summaries decide wherever the stored value is within tolerance of neither or of both ends of the median's bounds.
    Where the bounds leave it open, the median is taken exactly from counts of equal readings between the bounds and the
    number below them: at most about 2 * error of the group's readings, and the bounds themselves as one row each
    however often they occur. Null or NaN stored medians and groups without
    readings are no cases; of a repeated summary row any that differs counts. Null ids match nothing.
    """
    keys = ["job_id", "track_id"]
    readings = materialise(readings_once(scores, value), "readings")
    medians = summary_percentiles(quantile_summaries(readings, keys, value, error=error), keys)
    claims = summary.select(*keys, F.col(stored).cast("double").alias("_stored")).where(F.col("_stored").isNotNull() & ~F.isnan("_stored")).distinct()
    off = lambda m: F.abs(F.col("_stored") - m) > tolerance * F.abs(m)
    # the stored value's distance beyond tolerance, as a function of the median, changes sign at two places only
    edges = [F.col("_stored") / (1 + tolerance), F.col("_stored") / (1 - tolerance)]
    crossed = F.lit(False)
    for e in edges:
        crossed = crossed | ((F.col("low") <= e) & (e <= F.col("high")))
    judged = materialise(claims.join(medians, keys).withColumn("_open", crossed & (F.col("low") < F.col("high"))).withColumn("_off", off(F.col("estimate"))), "medians")
    sure = judged.where(~F.col("_open") & F.col("_off")).select(*keys)
    open_groups = judged.where("_open").groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    near = readings.join(open_groups, keys).where(F.col(value) <= F.col("high"))
    # rows of equal readings, those below the bounds as one null value
    inside = F.when(F.col(value) >= F.col("low"), F.col(value)).alias("_value")
    equal = near.groupBy(*keys, inside).agg(F.count(F.lit(1)).alias("_equal"))
    ranked = equal.withColumn("_upto", F.sum("_equal").over(Window.partitionBy(*keys).orderBy(F.col("_value").asc_nulls_first())))
    sized = ranked.join(judged.where("_open").groupBy(*keys).agg(F.min("n").alias("n")), keys)
    at = lambda rank: F.min(F.when(F.col("_upto") > F.floor(rank), F.col("_value")))
    exact = sized.groupBy(*keys).agg(((at((F.col("n") - 1) / 2) + at(F.col("n") / 2)) / 2).alias("_middle"))
    exact = exact.join(judged.where("_open"), keys)
    middle = F.col("_middle")
    return sure.union(exact.where(off(middle)).select(*keys)).distinct()
