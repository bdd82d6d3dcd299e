"""Rows in order: windows that pass over chunks, and folds that pass over batches, so that no match is held whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from fieldglass.session import spread

CHUNK = 16_384  # frames that are ordered in one task


def whole_groups(batches: Iterator[pd.DataFrame], column: str, rows: int) -> Iterator[pd.DataFrame]:
    """Batches joined to about so many rows, never cutting a run of equal values of column."""
    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size < rows:
            continue
        whole = pd.concat(held, ignore_index=True)
        ids = whole[column].to_numpy()
        other = np.flatnonzero(ids != ids[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield whole.iloc[:cut].reset_index(drop=True)
        held, size = [whole.iloc[cut:]], len(whole) - cut
    if size:
        yield pd.concat(held, ignore_index=True)


def fold_in_order(df: DataFrame, key: str, order: Sequence[str], start: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: T.StructType | str, *, segment: str | None = None) -> DataFrame:
    """What a fold makes of the rows of each key (and segment) in order; order[0] names the frame, whose rows come together.

    start() begins a fold for a key; it is called with the key's rows part by part, and all that it keeps from one part
    to the next is its own state. A key is one task, but only an Arrow batch of it is held at a time. With a segment,
    the segments of a key may go to different tasks, and each comes in one part.
    """
    keys = [key] if segment is None else [key, segment]
    rows = df.withColumn("_whole", F.xxhash64(*keys, *([order[0]] if segment is None else [])))
    rows = spread(rows, *keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, fold = None, None
        for b in whole_groups(batches, "_whole", 1):
            change = np.zeros(len(b), bool)
            for k in keys:
                v = b[k].to_numpy()
                change[1:] |= np.asarray((v[1:] != v[:-1]) & ~(pd.isna(v[1:]) & pd.isna(v[:-1])), bool)
            starts = np.flatnonzero(np.append(True, change[1:]))
            for i, j in zip(starts, [*starts[1:], len(b)]):
                head = tuple(None if pd.isna(b[k].iat[i]) else b[k].iat[i] for k in keys)
                if fold is None or head != current:
                    current, fold = head, start()
                out = fold(b.iloc[i:j].drop(columns="_whole").reset_index(drop=True))
                if len(out):
                    yield out

    return rows.mapInPandas(run, schema)


def _chunked(df: DataFrame, match: str, frame: str, chunk: int) -> DataFrame:
    return spread(df.withColumn("_chunk", F.floor(F.col(frame) / chunk)), match, "_chunk")  # what follows may compute much on few bytes


def carried(df: DataFrame, past: dict[str, tuple[Column, str]], *, match: str = "match_no", frame: str = "frame_index", chunk: int = CHUNK) -> DataFrame:
    """df with a column for each entry (value, way): the value looked up among the rows of the match in order of frame.

    way 'last' is the last non-null value up to the row, 'first' the first one up to it, 'next' the first one from it
    on, 'sum' the sum up to it. Rows are ordered within chunks of frames only; what comes from other chunks is worked out from one
    row per chunk. Frames must be known.
    """
    rows = _chunked(df.withColumns({f"_v_{c}": v for c, (v, _) in past.items()}), match, frame, chunk)
    pick = {"last": F.max_by, "first": F.min_by, "next": F.min_by}
    each = rows.groupBy(match, "_chunk").agg(*[F.sum(f"_v_{c}").alias(f"_c_{c}") if way == "sum" else pick[way](f"_v_{c}", F.when(F.col(f"_v_{c}").isNotNull(), F.col(frame))).alias(f"_c_{c}") for c, (_, way) in past.items()])
    line = Window.partitionBy(match).orderBy("_chunk")
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    over = {
        "last": lambda c: F.last(c, ignorenulls=True).over(before), "first": lambda c: F.first(c, ignorenulls=True).over(before),
        "next": lambda c: F.first(c, ignorenulls=True).over(after), "sum": lambda c: F.sum(c).over(before),
    }
    each = each.select(F.col(match).alias("_match"), F.col("_chunk").alias("_other"), *[over[way](f"_c_{c}").alias(f"_c_{c}") for c, (_, way) in past.items()])
    joined = rows.join(each, rows[match].eqNullSafe(each["_match"]) & (rows["_chunk"] == each["_other"]), "left")
    own = Window.partitionBy(match, "_chunk").orderBy(frame)
    upto, onward = own.rowsBetween(Window.unboundedPreceding, Window.currentRow), own.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    here = {
        "last": lambda v, c: F.coalesce(F.last(v, ignorenulls=True).over(upto), F.col(c)), "first": lambda v, c: F.coalesce(F.col(c), F.first(v, ignorenulls=True).over(upto)),
        "next": lambda v, c: F.coalesce(F.first(v, ignorenulls=True).over(onward), F.col(c)), "sum": lambda v, c: F.coalesce(F.col(c), F.lit(0)) + F.sum(v).over(upto),
    }
    out = joined.withColumns({c: here[way](f"_v_{c}", f"_c_{c}") for c, (_, way) in past.items()})
    return out.select(*df.columns, *past)
