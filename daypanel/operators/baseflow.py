"""Baseflow separation by a recursive filter, and the totals of a series that need its order.

The filter's state at one day depends on the state it just wrote for the day before, so no window function can express it. Rows are
shuffled once by entity and sorted; a task gathers whole series (at most one row per day each, so bounded by the calendar) into buckets
of bounded size and steps through the days of a bucket, all its series and values at once, as one array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.schema import DATE, ENTITY, OBS, PRED

ALPHA = 0.925
PASSES = 3
#: Rows of a bucket; a longer series is a bucket of its own.
BUCKET_ROWS = 400_000


def slow_parts(flows: Sequence[np.ndarray], alpha: float = ALPHA, passes: int = PASSES) -> list[np.ndarray]:
    """Baseflow of each series: passes run forward, backward, forward, each on the result of the one before.

    Within a pass the neighbour's baseflow is the value this pass has already lowered. Series that differ by less than half in
    length share an array, so padding never doubles it.
    """
    longest_first = sorted(range(len(flows)), key=lambda i: -len(flows[i]))
    found: list[np.ndarray] = [np.empty(0)] * len(flows)
    start = 0
    while start < len(longest_first):
        days = len(flows[longest_first[start]])
        stop = start + 1
        while stop < len(longest_first) and 2 * len(flows[longest_first[stop]]) >= days:
            stop += 1
        chosen = longest_first[start:stop]
        slow = _stepped([flows[i] for i in chosen], alpha, passes)
        for column, i in enumerate(chosen):
            found[i] = slow[: len(flows[i]), column]
        start = stop
    return found


def _stepped(flows: Sequence[np.ndarray], alpha: float, passes: int) -> np.ndarray:
    """Baseflow with a row per day and a column per series, longest series first."""
    sizes = np.array([len(f) for f in flows])
    days = int(sizes[0])
    total = np.zeros((days, len(flows)))
    for column, flow in enumerate(flows):
        total[: len(flow), column] = np.maximum(flow, 0.0)
    reaching = np.searchsorted(-sizes, -np.arange(days + 1), "left").tolist()  # series that have the day
    slow, gain = total.copy(), (1 + alpha) / 2
    for number in range(passes):
        quick = np.zeros(len(flows))
        forward = number % 2 == 0
        for day in range(1, days) if forward else range(days - 2, -1, -1):
            before = day - 1 if forward else day + 1
            n = reaching[max(day, before)]
            here, now = slow[day, :n], quick[:n]
            np.maximum(alpha * now + gain * (here - slow[before, :n]), 0.0, out=now)
            np.minimum(here, total[day, :n] - now, out=here, where=now < total[day, :n])
    return slow


def _by_series(rows: DataFrame, solve: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``solve`` of whole series in date order, many at once: a table sorted by entity and the place where each entity starts."""

    def starts(table: pa.Table) -> np.ndarray:
        codes = table.column(ENTITY).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        return np.concatenate([[0], np.flatnonzero(np.diff(codes.indices.to_numpy(zero_copy_only=False))) + 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, limit = [], 0, BUCKET_ROWS
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            held += batch.num_rows
            if held < limit:
                continue
            table = pa.Table.from_batches(waiting).combine_chunks()
            at = starts(table)
            last = int(at[-1])  # the last series may go on in the next batch
            if last:
                yield from solve(table.slice(0, last), at[:-1]).to_batches()
            waiting, held = table.slice(last).to_batches(), table.num_rows - last
            limit = max(BUCKET_ROWS, 2 * held)
        if held:
            table = pa.Table.from_batches(waiting).combine_chunks()
            yield from solve(table, starts(table)).to_batches()

    return rows.repartition(ENTITY).sortWithinPartitions(ENTITY, DATE).mapInArrow(run, schema)


def _known(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Entity, date and the values as doubles, of the rows where all of them are known."""
    for value in values:
        df = df.where(F.col(value).isNotNull())
    return df.select(ENTITY, DATE, *[F.col(v).cast("double").alias(v) for v in values])


def _pieces(table: pa.Table, starts: np.ndarray, values: Sequence[str]) -> list[list[np.ndarray]]:
    """Of each value its series."""
    return [np.split(table.column(v).to_numpy(), starts[1:]) for v in values]


def baseflows(df: DataFrame, names: Mapping[str, str], alpha: float = ALPHA, passes: int = PASSES) -> DataFrame:
    """Rows ``(entity, date, values, baseflows)`` where all values are known; ``names`` maps a value to the name of its baseflow."""
    values = list(names)
    rows = _known(df, values)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def solve(table: pa.Table, starts: np.ndarray) -> pa.Table:
        sides = _pieces(table, starts, values)
        slow = slow_parts([flow for side in sides for flow in side], alpha, passes)
        for i, value in enumerate(values):
            table = table.append_column(names[value], pa.array(np.concatenate(slow[i * len(starts) : (i + 1) * len(starts)])))
        return table

    return _by_series(rows, solve, schema + "".join(f", `{n}` double" for n in names.values()))


def baseflow(df: DataFrame, value: str, name: str = "baseflow", alpha: float = ALPHA, passes: int = PASSES) -> DataFrame:
    """Rows ``(entity, date, value, baseflow)`` of the entities' non-null values."""
    return baseflows(df, {value: name}, alpha, passes)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.try_divide(part, whole)).otherwise(F.lit(0.0))


def baseflow_indices(df: DataFrame, names: Mapping[str, str], alpha: float = ALPHA, passes: int = PASSES) -> DataFrame:
    """Per entity the share of baseflow in the total flow of each value, 0 where there is no flow; one pass for all values."""
    slow = baseflows(df, {v: f"_slow_{i}" for i, v in enumerate(names)}, alpha, passes)
    shares = [_share(F.sum(f"_slow_{i}"), F.sum(F.greatest(F.col(v), F.lit(0.0)))).alias(n) for i, (v, n) in enumerate(names.items())]
    return slow.groupBy(ENTITY).agg(*shares)


def baseflow_index(df: DataFrame, value: str, name: str = "bfi", alpha: float = ALPHA, passes: int = PASSES) -> DataFrame:
    """Share of baseflow in each entity's total flow; 0 where there is no flow."""
    return baseflow_indices(df, {value: name}, alpha, passes)


def sequence_totals(df: DataFrame, quantile: float = 0.95, reach: int = 3) -> DataFrame:
    """Per entity what the signatures of its order add up to: ``rows``, ``flow`` (observed), baseflow and positive flow of both sides,
    observed ``peaks`` at or above its high-flow quantile and the ``hits`` among them, with a prediction within ``reach`` rows that gets there."""
    rows = _known(df, [OBS, PRED])
    kind = rows.schema[ENTITY].dataType.simpleString()
    sums = ["flow", "slow_obs", "slow_pred", "total_obs", "total_pred"]
    schema = f"`{ENTITY}` {kind}, rows long, peaks long, hits long, " + ", ".join(f"{s} double" for s in sums)

    def solve(table: pa.Table, starts: np.ndarray) -> pa.Table:
        observed, predicted = _pieces(table, starts, [OBS, PRED])
        slow = slow_parts([*observed, *predicted])
        found = []
        for i, (flow, guess) in enumerate(zip(observed, predicted, strict=True)):
            peak = flow >= _quantile(flow, quantile)
            padded = np.concatenate([np.full(reach, -np.inf), guess, np.full(reach, -np.inf)])
            near = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1).max(axis=1)
            hit = peak & (near >= _quantile(flow, quantile))
            positive = [float(np.maximum(side, 0.0).sum()) for side in (flow, guess)]
            both = [float(slow[i].sum()), float(slow[len(starts) + i].sum())]
            found.append((len(flow), int(peak.sum()), int(hit.sum()), float(flow.sum()), *both, *positive))
        names = ["rows", "peaks", "hits", *sums]
        columns = {n: pa.array(c, pa.int64() if i < 3 else pa.float64()) for i, (n, c) in enumerate(zip(names, zip(*found, strict=True), strict=True))}
        return pa.table({ENTITY: table.column(ENTITY).take(pa.array(starts)), **columns})

    return _by_series(rows, solve, schema)


def _quantile(values: np.ndarray, q: float) -> float:
    """The quantile with linear interpolation, rounded as the built-in aggregate rounds it."""
    place = (len(values) - 1) * q
    low, high = int(np.floor(place)), int(np.ceil(place))
    ends = np.partition(values, (low, high))
    a, b = float(ends[low]), float(ends[high])
    return a if a == b else a * (high - place) + b * (place - low)
