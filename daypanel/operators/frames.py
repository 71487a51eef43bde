"""Statistics of trailing rows, put together from frames of 1, 2, 4, ... rows.

A frame of 2p rows is a frame of p rows joined with the one p rows before it. Extremes of n rows come from two overlapping frames,
sums and centred squares from the powers of two that add up to n; squares are joined by the means of both sides, so no digits are
lost. A column of m rows thus costs a few vector operations for each doubling instead of n updates for each row and frame. Spark deals and sorts
the rows; a task sees them in Arrow batches and carries no more than the longest frame from one batch to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a column over whole entities and days that a task works on at once.
DENSE_CELLS = 50_000
KNOWN = "_known"
_EMPTY = {"low": np.inf, "high": -np.inf, "n": 0.0, "sum": 0.0, "squares": 0.0}
STATS = ("min", "max", "sum", "mean", "count", "std", "var", "dry", "median", "lag")
_PARTS = {"min": ("low",), "max": ("high",), "sum": ("sum",), "dry": ("sum",), "mean": ("sum",), "std": ("sum", "squares"), "var": ("sum", "squares")}


@dataclass(frozen=True)
class Frame:
    """One statistic of ``rows`` values of a column, the newest of which is ``shift`` rows old.

    NULLs are skipped; ``std`` and ``var`` are those of a sample (NULL for one value), ``dry`` counts rows whose value is below ``below``,
    ``lag`` is the value of the one row that is ``shift`` rows old, NULL or not.
    """

    column: str
    stat: str
    rows: int
    name: str
    shift: int = 0
    below: float = 0.0

    def __post_init__(self) -> None:
        if self.stat not in STATS:
            raise ValueError(f"unknown statistic: {self.stat}")

    @property
    def reach(self) -> int:
        return self.rows + self.shift

    @property
    def sql_type(self) -> str:
        return "bigint" if self.stat == "dry" else "double"


def _back(values: np.ndarray, by: int, age: np.ndarray | None, empty: float) -> np.ndarray:
    """The value ``by`` rows before each row, ``empty`` before the start of its series; ``age`` counts the rows before it there.

    Without ``age`` each series has empty cells before it, no fewer than the longest frame reaches back."""
    if not by:
        return values
    if age is None and by < len(values):
        out = np.empty(len(values))
        out[:by] = empty
        out[by:] = values[:-by]
        return out
    out = np.full(len(values), empty)
    out[by:] = values[:-by] if by < len(values) else out[by:]
    if age is not None:
        out[age < by] = empty
    return out


def _joined(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The parts of two frames put together."""
    out = {"n": a["n"] + b["n"]}
    if "low" in a:
        out["low"] = np.fmin(a["low"], b["low"])
    if "high" in a:
        out["high"] = np.fmax(a["high"], b["high"])
    if "sum" in a:
        out["sum"] = a["sum"] + b["sum"]
    if "squares" in a:
        gap, own = np.maximum(b["n"], 1.0), np.maximum(a["n"], 1.0)
        np.divide(b["sum"], gap, out=gap)
        np.divide(a["sum"], own, out=own)
        gap -= own
        gap *= gap
        gap *= np.multiply(a["n"], b["n"], out=own)
        gap /= np.maximum(out["n"], 1.0, out=own)
        out["squares"] = np.add(a["squares"], b["squares"], out=own)
        out["squares"] += gap
    return out


class _Doubling:
    """Frames of 1, 2, 4, ... rows of one column, with the parts that the statistics need."""

    def __init__(self, values: np.ndarray, known: np.ndarray, age: np.ndarray | None, stats: Sequence[str] = STATS):
        needed = {"n", *(part for s in stats for part in _PARTS.get(s, ()))}
        first = {
            "low": lambda: np.where(known, values, np.inf),
            "high": lambda: np.where(known, values, -np.inf),
            "n": lambda: known.astype(float),
            "sum": lambda: np.where(known, values, 0.0),
            "squares": lambda: np.zeros(len(values)),
        }
        self.age = age
        self.level = [{part: make() for part, make in first.items() if part in needed}]
        self.whole: dict[int, dict[str, np.ndarray]] = {}

    def power(self, k: int) -> dict[str, np.ndarray]:
        while len(self.level) <= k:
            last = self.level[-1]
            self.level.append(_joined(last, self.back(last, 1 << (len(self.level) - 1))))
        return self.level[k]

    def back(self, parts: dict[str, np.ndarray], by: int) -> dict[str, np.ndarray]:
        return {p: _back(v, by, self.age, _EMPTY[p]) for p, v in parts.items()}

    def frame(self, rows: int) -> dict[str, np.ndarray]:
        """The parts of the last ``rows`` rows, put together once for all statistics of them."""
        if rows in self.whole:
            return self.whole[rows]
        largest = rows.bit_length() - 1
        parts, done = self.power(largest), 1 << largest
        overlap = self.back({p: v for p, v in parts.items() if p in ("low", "high")}, rows - done) if done < rows else None
        whole = parts
        while done < rows:
            k = (rows - done).bit_length() - 1
            whole = _joined(whole, self.back(self.power(k), done))
            done += 1 << k
        if overlap is not None:
            whole = whole | {p: pick(parts[p], overlap[p]) for p, pick in (("low", np.fmin), ("high", np.fmax)) if p in parts}
        self.whole[rows] = whole
        return whole


def _median(values: np.ndarray, known: np.ndarray, age: np.ndarray | None, rows: int) -> tuple[np.ndarray, np.ndarray]:
    seen = np.where(known, values, np.inf)
    table = np.sort(np.stack([_back(seen, k, age, np.inf) for k in range(rows)], 1), axis=1)
    n = np.isfinite(table).sum(1)
    at, row = np.maximum(n - 1, 0), np.arange(len(values))
    return (table[row, at // 2] + table[row, np.minimum((at + 1) // 2, rows - 1)]) / 2, n == 0


def _result(frame: Frame, parts: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values and where they are NULL."""
    n = parts["n"]
    if frame.stat in ("min", "max"):
        return parts["low" if frame.stat == "min" else "high"], n == 0
    if frame.stat in ("sum", "dry"):
        return parts["sum"], (n == 0) & (frame.stat == "sum")
    if frame.stat == "count":
        return n, np.zeros(len(n), bool)
    if frame.stat == "mean":
        return parts["sum"] / np.maximum(n, 1.0), n == 0
    variance = parts["squares"] / np.maximum(n - 1.0, 1.0)
    return np.sqrt(variance) if frame.stat == "std" else variance, n <= 1


def _same_as_before(column: pa.Array) -> np.ndarray:
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    both_null = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(pc.equal(a, b), False), both_null).to_numpy(zero_copy_only=False)


def _framing(frames: Sequence[Frame], series: Sequence[str], names: Sequence[str], keep: str | None):
    reach = max(f.reach for f in frames)
    shown = [c for c in names if c != keep]
    columns = list(dict.fromkeys(f.column for f in frames))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch]).select([*series, *columns])
            rows = (pa.concat_tables([held, own]) if held is not None else own).combine_chunks()
            new = np.concatenate([[True], ~np.logical_and.reduce([_same_as_before(rows[c].combine_chunks()) for c in series])])
            age = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            made: dict[str, pa.Array] = {}
            with np.errstate(invalid="ignore"):
                for c in columns:
                    cells = rows[c].combine_chunks()
                    known = pc.is_valid(cells).to_numpy(zero_copy_only=False)
                    values = pc.fill_null(pc.cast(cells, pa.float64()), 0.0).to_numpy(zero_copy_only=False)
                    made |= _frames_of_column([f for f in frames if f.column == c], values, known, age, slice(len(new) - batch.num_rows, None))
            held = rows.slice(max(0, len(new) - reach))
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in shown], *[made[f.name] for f in frames]], [*shown, *[f.name for f in frames]])
            yield out.filter(batch.column(keep)) if keep else out

    return run


def _cells_of_column(frames: Sequence[Frame], values: np.ndarray, known: np.ndarray, age: np.ndarray | None, pick: slice | np.ndarray):
    """Values of each frame at the picked rows, and where they are NULL."""
    made, doubled = {}, {}
    for f in frames:
        below = f.below if f.stat == "dry" else None
        kind = (f.shift, below)
        if kind not in doubled:
            seen = known if below is None else np.ones(len(values), bool)
            cells = values if below is None else (known & (values < below)).astype(float)
            shown = _back(seen.astype(float), f.shift, age, 0.0) > 0
            stats = {g.stat for g in frames if (g.shift, g.below if g.stat == "dry" else None) == kind}
            doubled[kind] = (shifted := _back(cells, f.shift, age, 0.0)), shown, _Doubling(shifted, shown, age, stats)
        cells, shown, doubling = doubled[kind]
        if f.stat == "lag":
            made[f.name] = cells[pick], ~shown[pick]
            continue
        found, null = _median(cells, shown, age, f.rows) if f.stat == "median" else _result(f, doubling.frame(f.rows))
        made[f.name] = found[pick].astype(np.int64) if f.stat == "dry" else found[pick], null[pick]
    return made


def _frames_of_column(frames: Sequence[Frame], values: np.ndarray, known: np.ndarray, age: np.ndarray, pick: slice) -> dict[str, pa.Array]:
    return {name: pa.array(found, mask=null) for name, (found, null) in _cells_of_column(frames, values, known, age, pick).items()}


def add_frames(df: DataFrame, frames: Sequence[Frame], series: Sequence[str], order: str, keep: str | None = None) -> DataFrame:
    """Add the frames to rows that are already dealt by ``series``; they are sorted within their partitions first.

    ``keep`` names a column of true and false: rows that are not true feed the frames of others and are left out by the task itself.
    """
    if not frames:
        return df.where(F.col(keep)).drop(keep) if keep else df
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != keep]
    schema = ", ".join([*kinds, *[f"`{f.name}` {f.sql_type}" for f in frames]])
    return df.sortWithinPartitions(*series, order).mapInArrow(_framing(frames, series, df.columns, keep), schema)


def _carrying(columns: Sequence[str], series: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch]).select([series, *columns])
            rows = (pa.concat_tables([held, own]) if held is not None else own).combine_chunks()
            skip, place = rows.num_rows - batch.num_rows, np.arange(rows.num_rows)
            start = np.maximum.accumulate(np.where(np.concatenate([[True], ~_same_as_before(rows[series].combine_chunks())]), place, 0))
            made = {}
            for c in columns:
                cells = rows[c].combine_chunks()
                known = pc.is_valid(cells).to_numpy(zero_copy_only=False)
                newest = np.maximum.accumulate(np.where(known, place, -1))
                made[c] = cells.take(pa.array(newest, mask=newest < start))
            held = pa.table([rows[series].combine_chunks(), *made.values()], [series, *columns]).slice(rows.num_rows - 1)
            yield pa.RecordBatch.from_arrays([made[c].slice(skip) if c in made else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return run


def carry_ordered(df: DataFrame, columns: Sequence[str], series: str) -> DataFrame:
    """Each column's last known value carried forward, for rows that stand in their partitions by series and in its order, as
    :func:`add_frames` leaves them. Only the last row of a batch is handed to the next one."""
    return df.mapInArrow(_carrying(columns, series), df.schema) if columns else df


# --- frames over the days of a calendar ----------------------------------------------------------


def _calendar_rows(batch: pa.RecordBatch, first: int, length: int, reach: int):
    """The rows of whole entities over ``length`` days of a calendar, each series behind ``reach`` empty cells.

    Returns for each row its entity, its day (below 0 for an empty cell), its attribute row, and the value row it shows (-1 for none),
    with the flattened attributes and values. An entity with several attribute rows, or a day with several values, has a row for each.
    """
    seen, copies = batch.column("_seen"), batch.column("_copies")
    parent, flat = pc.list_parent_indices(seen).to_numpy(), pc.list_flatten(seen)
    fields = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
    n, width = batch.num_rows, reach + length
    at = fields.pop("at").to_numpy(zero_copy_only=False) - 1 - first
    inside = (at >= 0) & (at < length)
    if not inside.all():
        parent, at, chosen = parent[inside], at[inside], pa.array(inside)
        fields = {c: column.filter(chosen) for c, column in fields.items()}
    cell = parent * width + reach + at
    times = pc.list_value_length(copies).to_numpy(zero_copy_only=False).astype(np.int64)
    found = np.bincount(cell, minlength=n * width)
    which = np.full(n * width, -1)
    place = np.arange(n * width)
    first_copy = np.cumsum(times) - times
    if (times == 1).all() and (not len(cell) or found.max() == 1):
        which[cell] = np.arange(len(cell))
        copy = first_copy[place // width]
    else:
        day = place % width >= reach
        repeat = np.where(day, np.maximum(found, 1) * times[place // width], 1)
        first_seen, first_row = np.cumsum(found) - found, np.cumsum(repeat) - repeat
        place = np.repeat(place, repeat)
        nth, m = np.arange(len(place)) - first_row[place], times[place // width]
        which = np.where(found[place] > 0, first_seen[place] + nth // m, -1)
        copy = first_copy[place // width] + nth % m
    attributes = pc.list_flatten(copies)
    return place // width, place % width - reach, copy, which, dict(zip([f.name for f in attributes.type], attributes.flatten(), strict=True)), fields


def _opening(frames: Sequence[Frame], made: Callable, key: str, shown: Sequence[str], start: int, skip: int, days: tuple[int, int], usable: str | None, carried: bool, counted: Sequence[str], then: Callable | None = None):
    reach = max([1, *(f.reach for f in frames)])
    # Days that no wanted row looks back to are left out.
    lowest = max(0, max(skip, days[0]) - reach)
    length = max(0, days[1] - lowest + 1)
    columns = list(dict.fromkeys(f.column for f in frames))
    returned = {*shown, *counted}

    def opened(batch: pa.RecordBatch) -> pa.RecordBatch:
        entity, day, copy, which, attributes, fields = _calendar_rows(batch, lowest, length, reach)
        keep = (day >= 0) & (day >= max(skip, days[0]) - lowest)
        filled = np.flatnonzero(which >= 0)
        values, known = {}, {}
        for c in dict.fromkeys([*columns, *([usable] if usable else [])]):
            cells, source = fields[c], which[filled]
            values[c], known[c] = np.zeros(len(which)), np.zeros(len(which), bool)
            values[c][filled] = pc.fill_null(cells, 0.0).to_numpy(zero_copy_only=False)[source]
            known[c][filled] = pc.is_valid(cells).to_numpy(zero_copy_only=False)[source]
        if usable:
            keep &= known[usable] & ~(values[usable] < 0)
        rows = np.flatnonzero(keep)
        cells = {}
        with np.errstate(invalid="ignore"):
            for c in columns:
                cells |= _cells_of_column([f for f in frames if f.column == c], values[c], known[c], None, rows)
            cells = made(cells)
        owner, copy, which = entity[rows], copy[rows], which[rows]
        place = np.arange(len(rows))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], owner[1:] != owner[:-1]])[: len(rows)], place, 0))

        def newest(null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of each row the newest one of its series, itself or before it, that has a value; where there is none."""
            at = np.maximum.accumulate(np.where(null, -1, place))
            return np.maximum(at, 0), at < first

        seen = {}
        out = {key: batch.column(key).take(pa.array(owner)), "date": pa.array((start + lowest + day[rows]).astype(np.int32)).cast(pa.date32())}
        several = carried and len(attributes) and len(copy) and len(next(iter(attributes.values()))) > batch.num_rows
        for c, column in attributes.items():
            if c not in returned:
                continue
            out[c] = column.take(pa.array(copy))
            seen[c] = len(rows) - out[c].null_count
            if several and pa.types.is_floating(column.type):
                at, none = newest(pc.is_null(out[c]).to_numpy(zero_copy_only=False))
                out[c] = out[c].take(pa.array(at, mask=none))
        for c, column in fields.items():
            if c not in returned:
                continue
            out[c] = column.take(pa.array(which, mask=which < 0))
            seen[c] = len(rows) - out[c].null_count
        for c, (found, null) in cells.items():
            if c not in returned:
                continue
            seen[c] = int(len(rows) - null.sum())
            if carried and null.any():
                at, null = newest(null)
                found = found[at]
            out[c] = pa.array(found, mask=null)
        out["pos"] = pa.array((lowest + day[rows] + 1).astype(np.int32))
        if counted:
            out[KNOWN] = pa.array([[seen[c] for c in counted], *[None] * (len(rows) - 1)][: len(rows)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([out[c] for c in shown], list(shown))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, DENSE_CELLS // (reach + length))
            for at in range(0, batch.num_rows, step):
                if (out := opened(batch.slice(at, step))).num_rows:
                    yield out

    return (lambda batches: then(each(batches))) if then else each


def calendar_frames(
    held: DataFrame,
    frames: Sequence[Frame],
    made: Callable[[dict[str, tuple]], dict[str, tuple]],
    names: Sequence[tuple[str, str]],
    start: str,
    end: str,
    key: str,
    skip: int = 0,
    since: str | None = None,
    until: str | None = None,
    usable: str | None = None,
    carried: bool = False,
    counted: Sequence[str] = (),
    then: tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str] | None = None,
) -> DataFrame:
    """Frames over every day of a calendar of entities that are held one a row, without forming the rows that nobody wants.

    ``held``: see :func:`daypanel.operators.panel.hold_panel`. ``made`` turns the cells of the frames, each with the places where it is NULL,
    into those of the columns to return; ``names`` are all returned columns with their types. Returned are the rows after the first
    ``skip`` days, in the closed span of days and, with ``usable``, those where this column is known and not negative; ``carried`` carries
    what is made forward over the returned rows of an entity. They stand by entity and day in each partition. ``counted`` adds the column
    :data:`KNOWN`: on one row of each batch, and NULL on the others, how many values of these columns the batch had before any was carried.
    ``then``, a function and the schema of what it returns, is applied by the task to its batches of rows, each of which has whole entities.
    """
    day = np.datetime64
    first = int(day(start, "D").astype(int))
    length = int(day(end, "D").astype(int)) - first + 1
    days = (
        max(0, int(day(since, "D").astype(int)) - first) if since else 0,
        min(length - 1, int(day(until, "D").astype(int)) - first) if until else length - 1,
    )
    schema = ", ".join(f"`{c}` {t}" for c, t in names)
    shown = [c for c, _ in names]
    if counted:
        schema, shown = f"{schema}, {KNOWN} array<bigint>", [*shown, KNOWN]
    run = _opening(frames, made, key, shown, first, skip, days, usable, carried, counted, then[0] if then else None)
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return held.repartition(parts, key).mapInArrow(run, then[1] if then else schema)
