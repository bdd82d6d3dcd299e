"""Implausible spikes in measurements.

Every source (a track, or an attacking side) has a hidden Markov model with the states normal, spike, stuck and
out of range; scales and transitions are the source's own. Spark orders the readings of a source and cuts them into
blocks with overlapping context; inside a task the forward-backward recursion runs over many blocks at once. Nothing is
flagged that the posteriors do not put forward, and nothing that the hard bounds do not bear out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fieldglass.operators.ordered import whole_groups
from fieldglass.session import materialise


@dataclass(frozen=True)
class SpikeModel:
    """Parameters of the model and of the hard rules."""

    x_max: float = 120.0
    y_max: float = 90.0
    stuck_run: int = 6
    min_offset: float = 4.0
    step_factor: float = 8.0
    candidate_probability: float = 0.01  # of not being normal, from which a reading is put forward
    reach: int = 8  # readings on either side that the local course is judged from
    spike_scale: float = 30.0  # metres, of the wide spike emission, of a source that has shown none
    repeated: float = 0.98  # probability that a stuck reading repeats a coordinate
    outside_normal: float = 1e-6  # probability that a normal or stuck reading lies where no pitch is
    block: int = 2048  # readings a block decides about
    context: int = 256  # readings of the neighbouring blocks it also sees
    anchors: int = 16  # readings beyond them, free of repeats, that hold the course where all of those are stuck
    most_sweeps: int = 200  # of the exact rule over all candidates; what still changes is searched
    most_between: int = 400  # readings that a searched choice may pass over at once
    leaving: tuple[tuple[float, ...], ...] = (  # from spike, stuck and out of range
        (0.550, 0.430, 0.010, 0.010),
        (0.080, 0.010, 0.900, 0.010),
        (0.500, 0.050, 0.050, 0.400),
    )
    prior: float = 100.0  # readings that the prior rates of a source's transitions are worth


@dataclass(frozen=True)
class SourceStatistics:
    """Per reading, what its whole source shows; the same wherever blocks end."""

    step: np.ndarray  # median distance of successive readings
    n: np.ndarray  # readings
    repeats: np.ndarray  # readings that repeat a coordinate
    leaps: np.ndarray  # steps of more than min_offset
    leap: np.ndarray  # their mean

    @classmethod
    def of_step(cls, step: np.ndarray) -> SourceStatistics:
        none = np.zeros(len(step))
        return cls(step, none, none, none, np.full(len(step), np.nan))


def _runs(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length of the run of equal values that each reading belongs to."""
    new = first.copy()
    new[1:] |= values[1:] != values[:-1]
    run = np.cumsum(new) - 1
    return np.bincount(run)[run]


def _residuals(t, x, y, begin, end, good, model: SpikeModel) -> np.ndarray:
    """Distance of each reading from the median of the courses between its k-th good neighbours on both sides."""
    n = len(t)
    held = np.flatnonzero(good)
    if not len(held):
        return np.zeros(n)
    before = np.searchsorted(held, np.arange(n), side="left")
    after = np.searchsorted(held, np.arange(n), side="right")
    lo, hi = np.searchsorted(held, begin), np.searchsorted(held, end) - 1  # the group's good readings
    ex, ey = np.full((model.reach, n), np.nan), np.full((model.reach, n), np.nan)
    sided = (before - 1 >= lo) & (after <= hi)
    at = np.flatnonzero(sided)
    for k in range(model.reach):
        left = held[np.maximum(before[at] - 1 - k, lo[at])]
        right = held[np.minimum(after[at] + k, hi[at])]
        w = (t[at] - t[left]) / (t[right] - t[left])
        ex[k, at] = x[left] + w * (x[right] - x[left])
        ey[k, at] = y[left] + w * (y[right] - y[left])
    out = np.zeros(n)
    out[at] = np.hypot(x[at] - np.median(ex[:, at], axis=0), y[at] - np.median(ey[:, at], axis=0))
    return out


def _posteriors(emission: np.ndarray, begin: np.ndarray, length: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward state probabilities of every reading; begin, length and transitions (4, 4) of the sequences."""
    gamma = np.empty_like(emission)
    order = np.argsort(-length, kind="stable")
    for s in range(0, len(order), 256):
        slab = order[s : s + 256]
        longest = int(length[slab[0]])
        steps = np.arange(longest)
        inside = steps[:, None] < length[slab][None, :]
        where = np.where(inside, begin[slab][None, :] + steps[:, None], 0)
        e = np.where(inside[:, :, None], emission[where], 1.0)
        onward, back_to = transitions[slab], np.ascontiguousarray(np.swapaxes(transitions[slab], 1, 2))
        forward = np.empty_like(e)
        state = np.full((len(slab), 4), [0.97, 0.01, 0.01, 0.01]) * e[0]
        forward[0] = state / state.sum(axis=1, keepdims=True)
        for i in range(1, longest):
            state = np.matmul(forward[i - 1][:, None, :], onward)[:, 0, :] * e[i]
            forward[i] = state / state.sum(axis=1, keepdims=True)
        back = np.ones((len(slab), 4))
        for i in range(longest - 1, -1, -1):
            both = forward[i] * back
            forward[i] = both / both.sum(axis=1, keepdims=True)
            back = np.matmul((e[i] * back)[:, None, :], back_to)[:, 0, :]
            back /= back.sum(axis=1, keepdims=True)
        gamma[where[inside]] = forward[inside]
    return gamma


def _consistent(t, x, y, limit, most_between: int) -> np.ndarray | None:
    """Which readings of a stretch are no cases, so that the rule holds for every one; None if that cannot be.

    The first and last are no cases whatever the others are. Such a choice is a path from the first to the last: all
    readings passed over are off the course between the path's two around them, and none on the path is off the course
    between its own two. Of several the one with the fewest cases counts, then the one whose last differing case comes first.
    """

    def off(k, i, j):
        w = (t[k] - t[i]) / (t[j] - t[i])
        return np.hypot(x[k] - (x[i] + w * (x[j] - x[i])), y[k] - (y[i] + w * (y[j] - y[i]))) > limit[k]

    n = len(t)
    steps: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]  # at j: (i, cases so far, place of the step before in steps[i])
    for i in range(n - 1):
        if i and not steps[i]:
            continue
        h, cases = np.array([(s[0], s[1]) for s in steps[i]], int).reshape(-1, 2).T
        for j in range(i + 1, min(n, i + 2 + most_between)):
            if not off(np.arange(i + 1, j), i, j).all():
                continue
            if not i:
                steps[j].append((0, j - 1, -1))
                continue
            fits = np.flatnonzero(~off(i, h, j))
            if len(fits):
                best = int(fits[np.argmin(cases[fits])])
                steps[j].append((i, int(cases[best]) + j - i - 1, best))
    if not steps[-1]:
        return None
    good = np.zeros(n, bool)
    at, place = n - 1, min(range(len(steps[-1])), key=lambda s: steps[-1][s][1])
    while place >= 0:
        good[at] = True
        at, _, place = steps[at][place]
    good[at] = True
    return good


def flag_sequences(t, x, y, has_y, source: SourceStatistics, group, model: SpikeModel = SpikeModel()) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (n, 4) and a flag per reading (0 none, 1 spike, 2 stuck, 3 out of range, 4 open).

    The readings of one group are contiguous and in order of t. The observation of a reading is its distance from the
    local course, whether it repeats a coordinate of a neighbour, and whether it lies outside; every state has a density
    of all three. Two rounds of forward-backward, the second judging the course without the readings that the first took
    for something else than normal. A reading put forward by the posteriors is out of range or stuck if the bounds say so, and a spike by the
    exact rule against the nearest readings that are no cases, until nothing changes. Where that never ends (at a lasting jump two readings can
    each be a case only if the other is none) a choice that meets the rule is searched for; where there is none, the
    readings that contradict the rule are open.
    """
    n = len(t)
    first = np.ones(n, bool)
    first[1:] = group[1:] != group[:-1]
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, n))
    begin, end = np.repeat(starts, lengths), np.repeat(starts + lengths, lengths)
    y = np.where(has_y, y, 0.0)

    outside = (x < 0) | (x > model.x_max) | (y < 0) | (y > model.y_max)
    stuck = (_runs(x, first) >= model.stuck_run) | (has_y & (_runs(y, first) >= model.stuck_run))
    bound = outside | stuck
    step = np.nan_to_num(source.step)
    scale, wide = np.maximum(step, 0.5), np.clip(np.where(np.isnan(source.leap), model.spike_scale, source.leap), model.min_offset, 100.0)
    same = np.zeros(n, bool)  # as the reading before or after it
    again = ~first[1:] & ((x[1:] == x[:-1]) | (has_y[1:] & has_y[:-1] & (y[1:] == y[:-1])))
    same[1:] |= again
    same[:-1] |= again
    repeat = np.clip((source.repeats + 1) / (source.n + model.prior), 0.01, 0.1)
    seen = np.stack([np.where(same, p, 1 - p) for p in (repeat, repeat, np.full(n, model.repeated), repeat)], axis=1)
    seen *= np.where(outside[:, None], [model.outside_normal, 0.05, model.outside_normal, 1.0], [1.0, 1.0, 1.0, model.outside_normal])
    enter = np.clip((source.leaps / 2 + 0.01 * model.prior) / (source.n + model.prior), 0.002, 0.3)[starts]
    transitions = np.empty((len(starts), 4, 4))
    transitions[:, 0, :] = np.stack([1 - enter - 0.01, enter, np.full(len(starts), 0.005), np.full(len(starts), 0.005)], axis=1)
    transitions[:, 1:, :] = model.leaving
    good, gamma = ~bound, None
    for _ in range(2):
        r = np.minimum(_residuals(t, x, y, begin, end, good, model), 1e3)
        near, far = np.maximum(np.exp(-r / scale) / scale, 1e-30), np.exp(-r / wide) / wide
        gamma = _posteriors(np.stack([near, far, (near + far) / 2, far], axis=1) * seen, starts, lengths, transitions)
        good = ~bound & (gamma[:, 0] >= 0.5)

    forward = 1 - gamma[:, 0] >= model.candidate_probability
    hard = bound & forward
    candidate = ~bound & forward
    case = hard | (~bound & (gamma[:, 0] < 0.5))  # a few repeats may be stuck by the model and no case by the bounds, yet off the course
    limit = np.maximum(model.min_offset, model.step_factor * step)
    rows = np.arange(n)
    c = np.flatnonzero(candidate)

    def swept(case: np.ndarray) -> np.ndarray:
        prev = np.maximum.accumulate(np.where(~case, rows, -1))
        after = np.minimum.accumulate(np.where(~case, rows, n)[::-1])[::-1]
        left = np.where(c > 0, prev[c - 1], -1)
        right = np.where(c + 1 < n, after[np.minimum(c + 1, n - 1)], n)
        sided = (left >= begin[c]) & (right < end[c])
        left, right = np.where(sided, left, 0), np.where(sided, right, n - 1)
        span = np.where(sided, t[right] - t[left], 1.0)
        w = (t[c] - t[left]) / span
        off = np.hypot(x[c] - (x[left] + w * (x[right] - x[left])), y[c] - (y[left] + w * (y[right] - y[left])))
        now = hard.copy()
        now[c] = sided & (off > limit[c])
        return now

    before, now = case, swept(case)
    for _ in range(model.most_sweeps):
        after = swept(now)
        if (after == now).all() or (after == before).all():
            break
        before, now = now, after
    case = now
    moving = np.flatnonzero(swept(case) != case)
    if len(moving):
        soft = np.flatnonzero(~hard)
        edge = ~candidate[soft]  # their state depends on no other reading; so does that of a group's outermost ones
        edge[1:] |= group[soft[1:]] != group[soft[:-1]]
        edge[:-1] |= group[soft[1:]] != group[soft[:-1]]
        edge[[0, -1]] = True
        edges = np.flatnonzero(edge)
        for e in np.unique(np.searchsorted(edges, np.searchsorted(soft, moving))):
            own = soft[edges[e - 1] : edges[e] + 1]
            good = _consistent(t[own], x[own], y[own], limit[own], model.most_between)
            if good is not None:
                case[own] = ~good
    flag = np.where(case, np.where(outside, 3, np.where(stuck, 2, 1)), 0)
    flag[swept(case) != case] = 4
    return gamma, flag


_SOURCE = ["table_name", "job_id", "track_id", "side"]
_FLAGS = np.array([None, "spike", "stuck", "out_of_range", "open"], dtype=object)


def implausible_readings(readings: DataFrame, model: SpikeModel = SpikeModel()) -> DataFrame:
    """The implausible readings with flag and posteriors p_spike, p_stuck, p_range.

    readings: table_name, job_id, track_id, side (null where the source has none), frame_index, x, y (null for one
    measurement only). Rows with a null or non-finite x, a non-finite y, or a null frame_index must be left out before;
    nulls in the key form sources of their own. A frame counts once (repeated rows carry the same values; of differing
    ones the smallest counts). A source with fewer than three readings has no spikes.

    A reading's rank in its source comes from counts per chunk of frames, so no source is sorted in one task; a block
    of ranks is decided in one task with context readings of its neighbours on both sides, and, where a source has
    several blocks, with the nearest readings beyond them that are inside and repeat nothing: the course is known across
    a stretch of any length that is stuck or out of range. Statistics are those of the whole source; the median step comes
    from mergeable quantile digests (rank error under 1/100,000, exact for sources of fewer readings).
    """
    frames = 16_384
    key = [*_SOURCE, "_chunk"]
    placed = readings.select(*_SOURCE, F.col("frame_index").cast("long").alias("_t"), "x", "y").withColumn("_chunk", F.floor(F.col("_t") / frames))
    once = placed.repartition(*key).groupBy(*key, "_t").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    in_chunk = Window.partitionBy(*key).orderBy("_t")
    before, after = F.lag(F.struct("x", "y")).over(in_chunk), F.lead(F.struct("x", "y")).over(in_chunk)
    ordered = once.withColumns({"_rn": F.row_number().over(in_chunk), "_before": before, "_after": after})
    apart = lambda p, q: F.hypot(p("x") - q("x"), F.coalesce(p("y") - q("y"), F.lit(0.0)))
    repeats = lambda p, q: (p("x") == q("x")) | F.coalesce(p("y") == q("y"), F.lit(False))
    here, past, next_ = F.col, lambda c: F.col(f"_before.{c}"), lambda c: F.col(f"_after.{c}")
    inside = F.col("x").between(0, model.x_max) & F.coalesce(F.col("y").between(0, model.y_max), F.lit(True))
    ordered = ordered.select(
        *key, "_t", "x", "y", "_rn", apart(here, past).alias("_step"), repeats(here, past).alias("_again"),
        (inside & ~repeats(here, past) & ~repeats(here, next_)).alias("_free"),  # null at the ends of a chunk
    )
    ordered = materialise(ordered, "readings")

    # one row per source and chunk: readings before it, and the step across its start
    by_chunk = Window.partitionBy(*_SOURCE).orderBy("_chunk")
    chunks = ordered.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(F.struct("x", "y"), "_rn").alias("_head"), F.max_by(F.struct("x", "y"), "_rn").alias("_tail")
    )
    chunks = chunks.withColumns({"_before": F.sum("_n").over(by_chunk) - F.col("_n"), "_last": F.lag("_tail").over(by_chunk)})
    head, last = lambda c: F.col(f"_head.{c}"), lambda c: F.col(f"_last.{c}")
    steps = ordered.select(*_SOURCE, "_step", "_again").union(chunks.select(*_SOURCE, apart(head, last), repeats(head, last))).where(F.col("_step").isNotNull())
    lower, upper = F.percentile_approx("_step", 0.5, 100_000), -F.percentile_approx(-F.col("_step"), 0.5, 100_000)
    leap = F.col("_step") > model.min_offset
    medians = steps.groupBy(*_SOURCE).agg(
        ((lower + upper) / 2).alias("_median"), F.count(F.lit(1)).alias("_total"), F.count_if("_again").alias("_repeats"), F.count_if(leap).alias("_leaps"), F.avg(F.when(leap, F.col("_step"))).alias("_leap")
    )

    same = lambda a, b, on: [a[c].eqNullSafe(b[c]) for c in on]
    c, m = chunks.alias("c"), medians.alias("m")
    statistics = ["_median", "_total", "_repeats", "_leaps", "_leap"]
    offsets = c.join(m, same(chunks, medians, _SOURCE), "left").select(*[F.col(f"c.{k}") for k in key], "_before", *statistics)
    ranked = ordered.alias("r").join(offsets.alias("o"), [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key])
    ranked = ranked.select(*[F.col(f"r.{k}") for k in _SOURCE], "_t", "x", "y", "_free", *statistics, (F.col("_before") + F.col("_rn") - 1).alias("_rank"))

    home, at = F.floor(F.col("_rank") / model.block), F.pmod("_rank", F.lit(model.block))
    blocks = F.array_compact(
        F.array(home, F.when((at < model.context) & (home > 0), home - 1), F.when(at >= model.block - model.context, home + 1))
    )
    spread = ranked.withColumn("_block", F.explode(blocks)).withColumn("_core", F.col("_block") == home)
    columns = [*_SOURCE, "_block", "_rank", "_core", "_t", "x", "y", *statistics]
    spread = spread.select(*columns).union(_anchors(ranked, statistics, model).select(*columns))
    spread = spread.repartition(*_SOURCE, "_block").sortWithinPartitions(*_SOURCE, "_block", "_rank")
    spread = spread.withColumn("_group", F.xxhash64(*_SOURCE, "_block"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, "_group", 50_000):
            source = SourceStatistics(*(b[c].fillna(0.0 if c != "_leap" else np.nan).to_numpy(float) for c in statistics))
            gamma, flag = flag_sequences(b._t.to_numpy(float), b.x.to_numpy(float), b.y.to_numpy(float), b.y.notna().to_numpy(), source, b._group.to_numpy(), model)
            keep = b._core.to_numpy(bool) & (flag > 0)
            out = b.loc[keep, [*_SOURCE, "_t", "x", "y"]].rename(columns={"_t": "frame_index"})
            yield out.assign(flag=_FLAGS[flag[keep]], p_spike=gamma[keep, 1], p_stuck=gamma[keep, 2], p_range=gamma[keep, 3])

    return spread.mapInPandas(
        decide, "table_name string, job_id string, track_id int, side string, frame_index int, x double, y double, flag string, p_spike double, p_stuck double, p_range double"
    )


def _anchors(ranked: DataFrame, statistics: Sequence[str], model: SpikeModel) -> DataFrame:
    """Of every block of the sources that have several, the nearest free readings before and after its context."""
    home = F.floor(F.col("_rank") / model.block)
    reading = F.when(F.col("_free"), F.struct("_rank", "_t", "x", "y"))
    own = ranked.where(F.col("_total") >= model.block).withColumn("_block", home).groupBy(*_SOURCE, "_block").agg(
        F.array_sort(F.collect_list(reading)).alias("_all"), *[F.first(c).alias(c) for c in statistics]  # of one block
    )
    ends = own.select(
        *_SOURCE, "_block", *statistics, F.when(F.size("_all") > 0, F.slice("_all", 1, model.anchors)).alias("_head"), F.when(F.size("_all") > 0, F.slice("_all", -F.least(F.size("_all"), F.lit(model.anchors)), model.anchors)).alias("_tail")
    )
    line = Window.partitionBy(*_SOURCE).orderBy("_block")
    before = F.last("_tail", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_head", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    none = F.expr("CAST(array() AS array<struct<_rank: bigint, _t: bigint, x: double, y: double>>)")
    far = F.concat(
        F.filter(F.coalesce(before, none), lambda r: r["_rank"] < F.col("_block") * model.block - model.context),
        F.filter(F.coalesce(after, none), lambda r: r["_rank"] >= (F.col("_block") + 1) * model.block + model.context),
    )
    rows = ends.withColumn("_a", far).select(*_SOURCE, "_block", *statistics, F.explode("_a").alias("_a"))
    return rows.select(*_SOURCE, "_block", *statistics, F.col("_a._rank").alias("_rank"), F.lit(False).alias("_core"), F.col("_a._t").alias("_t"), F.col("_a.x").alias("x"), F.col("_a.y").alias("y"))


def position_readings(scores: DataFrame) -> DataFrame:
    """player_frame_score as readings of tracks."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return scores.where(ok("pitch_x") & ok("pitch_y") & F.col("frame_index").isNotNull()).select(
        F.lit("player_frame_score").alias("table_name"), "job_id", F.col("track_id").cast("int").alias("track_id"), F.lit(None).cast("string").alias("side"), "frame_index", F.col("pitch_x").alias("x"), F.col("pitch_y").alias("y")
    )


def line_readings(frames: DataFrame) -> DataFrame:
    """offside_line of frame_score as readings of attacking sides; its track_id is -1."""
    ok = F.col("offside_line").isNotNull() & ~F.isnan("offside_line") & (F.abs("offside_line") < float("inf"))
    return frames.where(ok & F.col("frame_index").isNotNull()).select(
        F.lit("frame_score").alias("table_name"), "job_id", F.lit(-1).alias("track_id"), F.col("attacking_side").alias("side"), "frame_index", F.col("offside_line").alias("x"), F.lit(None).cast("double").alias("y")
    )
