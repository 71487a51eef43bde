"""Exact order over data of any size: row positions, global ranks and order statistics.

None of these sorts a whole table, or a whole large group, in one task. Rows are first put into
buckets that keep the order and depend only on the row itself (a year, a date and id prefix, a value
range). Counting rows per bucket gives each bucket's starting rank, and the exact order is then
needed only inside a bucket. Because a row's bucket never depends on how Spark laid out its
partitions, a recomputed task gives the same ranks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daypanel.schema import DATE, ENTITY
from daypanel.session import durable

_BEFORE = (Window.unboundedPreceding, -1)


def with_position(df: DataFrame, key: str = ENTITY, order: str = DATE, name: str = "pos") -> DataFrame:
    """Number the rows of each entity 1, 2, ... by date. A year of an entity is the largest unit one task sorts."""
    marked = df.withColumn("_year", F.year(order))
    starts = (
        marked.groupBy(key, "_year")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            key,
            "_year",
            F.coalesce(
                F.sum("_rows").over(Window.partitionBy(key).orderBy("_year").rowsBetween(*_BEFORE)), F.lit(0)
            ).alias("_start"),
        )
    )
    inside = Window.partitionBy(key, "_year").orderBy(order)
    return (
        marked.join(starts, [key, "_year"])
        .withColumn(name, F.col("_start") + F.row_number().over(inside))
        .drop("_year", "_start")
    )


def global_rank(
    df: DataFrame, order: str = DATE, tie: str = ENTITY, rank: str = "rank0", total: str = "n_rows", day_start: str | None = None
) -> DataFrame:
    """0-based rank of every row by (date, hash of the id, id), and the row count beside it.

    ``day_start`` names a column for the first rank of the row's day.

    Rows of one day are ordered by the hash of their id, which is fixed, unrelated to the id's own
    order, and splits even a huge day into 256 buckets. The only unpartitioned step is a running
    sum over one count per day, whose length is the length of the calendar.
    """
    digest = F.md5(F.col(tie).cast("string"))
    marked = df.withColumn("_digest", digest).withColumn(
        "_part", F.coalesce(F.substring("_digest", 1, 2), F.lit(""))
    )
    parts = marked.groupBy(order, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    days = parts.groupBy(order).agg(F.sum("_rows").alias("_day_rows"))
    day_starts = days.select(
        order,
        F.coalesce(F.sum("_day_rows").over(Window.orderBy(order).rowsBetween(*_BEFORE)), F.lit(0)).alias("_day_start"),
        F.sum("_day_rows")
        .over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias(total),
    )
    part_starts = parts.select(
        order,
        "_part",
        F.coalesce(
            F.sum("_rows").over(Window.partitionBy(order).orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0)
        ).alias("_part_start"),
    ).join(day_starts, order)
    inside = Window.partitionBy(order, "_part").orderBy("_digest", tie)
    ranked = marked.join(part_starts, [order, "_part"]).withColumn(
        rank, F.col("_day_start") + F.col("_part_start") + F.row_number().over(inside) - 1
    )
    if day_start:
        ranked = ranked.withColumn(day_start, F.col("_day_start"))
    return ranked.drop("_digest", "_part", "_part_start", "_day_start")


def hashed_rank(
    df: DataFrame, keys: Sequence[str], seed: int = 42, rank: str = "rank0", total: str = "n_rows", coarse_bits: int = 10, fine_bits: int = 10
) -> DataFrame:
    """0-based rank in an order drawn from the hash of the row keys: a repeatable shuffle of the table.

    Rows are counted under the top bits of the draw on two levels, so that one task orders about one row in ``2 ** (coarse_bits + fine_bits)``.
    """
    draw = F.xxhash64(F.lit(seed), *keys)
    top = lambda bits: F.shiftrightunsigned("_draw", bits).cast("int")
    marked = df.withColumn("_draw", draw).withColumn("_part", top(64 - coarse_bits)).withColumn("_sub", top(64 - coarse_bits - fine_bits))
    # The unsigned top bits order the parts and the sub-parts in them; inside a sub-part the rest of the draw and the keys decide.
    subs = marked.groupBy("_part", "_sub").agg(F.count(F.lit(1)).alias("_rows"))
    parts = subs.groupBy("_part").agg(F.sum("_rows").alias("_rows"))
    everything = Window.orderBy("_part")  # at most ``2 ** coarse_bits`` rows
    starts = parts.select(
        "_part",
        F.coalesce(F.sum("_rows").over(everything.rowsBetween(*_BEFORE)), F.lit(0)).alias("_start"),
        F.sum("_rows")
        .over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias(total),
    )
    earlier = F.coalesce(F.sum("_rows").over(Window.partitionBy("_part").orderBy("_sub").rowsBetween(*_BEFORE)), F.lit(0))
    placed = subs.select("_part", "_sub", earlier.alias("_inner")).join(starts, "_part")
    inside = Window.partitionBy("_part", "_sub").orderBy("_draw", *keys)
    return (
        marked.join(placed, ["_part", "_sub"])
        .withColumn(rank, F.col("_start") + F.col("_inner") + F.row_number().over(inside) - 1)
        .drop("_draw", "_part", "_sub", "_start", "_inner")
    )


def join_groups(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet each other, as they do in a grouping; ``df`` gives the keys."""
    renamed = other.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys])
    return df.join(renamed, same, how).drop(*[f"_other_{k}" for k in keys])


def value_range(value: Column) -> Column:
    """An integer that grows with the value: 64 steps per power of two, on both sides of zero."""
    step = F.floor(F.log2(F.abs(value)) * 64).cast("int") + F.lit(70000)
    return F.when(value > 0, step).when(value < 0, -step).otherwise(F.lit(0))


def range_step(value: Column, low: str = "_lo", high: str = "_hi") -> Column:
    """Which of 1,024 equal steps between the ends of its value range a value is in."""
    share = F.try_divide(value - F.col(low), F.col(high) - F.col(low))
    return F.coalesce(F.least(F.floor(share * 1024).cast("int"), F.lit(1023)), F.lit(0))


def order_statistics(
    df: DataFrame,
    value: str,
    picks: Mapping[str, Callable[[Column], Column]],
    by: Sequence[str] = (),
    count_name: str = "n",
    null_groups: bool = False,
) -> DataFrame:
    """Exact elements of each group's ascending order: ``picks`` maps a name to ``n -> 0-based position``.

    Pass 1 counts rows per value range (combined on the map side, so a hot group costs a few
    thousand rows per task) and finds the ranges that hold a wanted position. Pass 2 keeps only the
    rows of those ranges, splits each range into 1,024 equal steps and orders distinct values inside
    one step. Groups whose key is NULL are left out unless ``null_groups`` asks for them, as a grouping would keep them.

    What a range is searched for travels with its rows as grouping columns (``_rest_i``), so each
    pass reads the input once.
    """
    by = list(by)
    v = F.col("_v")
    usable = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    if not null_groups:
        for key in by:
            usable = usable & F.col(key).isNotNull()
    rows = df.where(usable).select(*by, F.col(value).cast("double").alias("_v"))
    rows = rows.withColumn("_range", F.coalesce(value_range(v), F.lit(0)))
    ranges = rows.groupBy(*by, "_range").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    placed = _placed(ranges, by)
    targets = _targets(placed, picks, by)
    values = (
        join_groups(rows, targets, [*by, "_range"])
        .withColumn("_step", range_step(v))
        .groupBy(*by, "_range", "_step", "_v", "_n", *_rests(picks))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    return _picked(values, picks, by, count_name)


def _rests(picks: Mapping) -> list[str]:
    return [f"_rest_{i}" for i in range(len(picks))]


def _placed(ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ranges with the number of rows before them and in their whole group."""
    in_group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return ranges.select(
        "*",
        F.coalesce(F.sum("_rows").over(in_group.orderBy("_range").rowsBetween(*_BEFORE)), F.lit(0)).alias("_start"),
        F.sum("_rows").over(in_group).alias("_n"),
    )


def _targets(placed: DataFrame, picks: Mapping[str, Callable[[Column], Column]], by: Sequence[str]) -> DataFrame:
    """The ranges that hold a wanted position, with the position inside of them."""
    rest, wanted = [], []
    for i, name in enumerate(picks):
        at = picks[name](F.col("_n")).cast("bigint") - F.col("_start")
        wanted.append((at >= 0) & (at < F.col("_rows")))
        rest.append(F.when(wanted[i], at).alias(f"_rest_{i}"))
    # Filtered before the columns get names: a filter on all of them would double what the optimizer infers with each one.
    return placed.where(reduce(or_, wanted)).select(*by, "_range", "_lo", "_hi", "_n", *rest)


def _picked(values: DataFrame, picks: Mapping, by: Sequence[str], count_name: str) -> DataFrame:
    """The wanted elements, from the distinct values of the ranges that hold them."""
    rests = _rests(picks)
    one_range, one_step = [*by, "_range"], [*by, "_range", "_step"]
    steps = (
        values.groupBy(*one_step)
        .agg(F.sum("_rows").alias("_step_rows"))
        .select(
            *one_step,
            F.coalesce(
                F.sum("_step_rows").over(Window.partitionBy(*one_range).orderBy("_step").rowsBetween(*_BEFORE)),
                F.lit(0),
            ).alias("_step_start"),
        )
    )
    upto = F.col("_step_start") + F.sum("_rows").over(Window.partitionBy(*one_step).orderBy("_v"))
    ordered = join_groups(values, steps, one_step).withColumn("_upto", upto)

    def chosen(i: int) -> Column:
        here = (F.col(rests[i]) < F.col("_upto")) & (F.col(rests[i]) >= F.col("_upto") - F.col("_rows"))
        return F.max(F.when(here, F.col("_v")))

    return ordered.groupBy(*by).agg(
        F.max("_n").alias(count_name), *[chosen(i).alias(name) for i, name in enumerate(picks)]
    )


def _bit_ranges(values: np.ndarray) -> np.ndarray:
    """An integer that grows with the value: 64 steps per power of two, on both sides of zero, taken from the bits of the number."""
    size = ((values.view(np.int64) & np.int64(2**63 - 1)) >> 46).astype(np.int64)
    return np.where(values < 0, -size, size)


def _known_values(column: pa.Array) -> np.ndarray:
    found = column.drop_null().to_numpy(zero_copy_only=False)
    return found[~np.isnan(found)]


def range_counts(names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[dict[int, int]] = [{} for _ in names]
        for batch in batches:
            for held, column in zip(counts, batch.columns, strict=True):
                if len(found := _bit_ranges(_known_values(column))):
                    low = found.min()
                    rows = np.bincount(found - low)
                    for k in np.flatnonzero(rows).tolist():
                        held[low + k] = held.get(low + k, 0) + int(rows[k])
        out = [(n, int(k), m) for n, held in zip(names, counts, strict=True) for k, m in held.items()]
        if out:
            n, k, m = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.string()), pa.array(k, pa.int32()), pa.array(m, pa.int64())], ["column", "_range", "_rows"])

    return run


def _values_in(names: Sequence[str], wanted: Mapping[str, Sequence[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, column in zip(names, batch.columns, strict=True):
                found = _known_values(column)
                ranges = _bit_ranges(found)
                for k in wanted.get(name, ()):
                    values, rows = np.unique(found[ranges == k], return_counts=True)
                    if len(values):
                        parts = [pa.array([name] * len(values)), pa.array(np.full(len(values), k, np.int32)), pa.array(values), pa.array(rows.astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(parts, ["column", "_range", "_v", "_rows"])

    return run


RANGES = "column string, _range int, _rows long"


def column_statistics(
    df: DataFrame, columns: Sequence[str], picks: Mapping[str, Callable[[Column], Column]], name: str = "column", count_name: str = "n"
) -> DataFrame:
    """:func:`order_statistics` of each column of a wide table, as a group of its own, without a row for each cell.

    Tasks count the cells of each column in value ranges, and then the distinct values in the ranges that hold a wanted position, which
    are a few a column and pass through the driver; the values themselves are put in order as there.
    """
    names = list(columns)
    cells = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    ranges = cells.mapInArrow(range_counts(names), RANGES).groupBy("column", "_range").agg(F.sum("_rows").alias("_rows"))
    return ranged_statistics(ranges, cells.mapInArrow, names, picks, name, count_name)


def ranged_statistics(
    ranges: DataFrame, scan: Callable[..., DataFrame], names: Sequence[str], picks: Mapping[str, Callable[[Column], Column]], name: str = "column", count_name: str = "n"
) -> DataFrame:
    """:func:`column_statistics` from the rows of each column in each value range; ``scan`` maps the batches of its columns ``names``."""
    by = ["column"]
    marked = ranges.select("*", F.lit(None).cast("double").alias("_lo"), F.lit(None).cast("double").alias("_hi"))
    found = _targets(_placed(marked, by), picks, by).drop("_lo", "_hi")
    rows = found.collect()  # at most a range a column and pick
    wanted: dict[str, list[int]] = {}
    for r in rows:
        wanted.setdefault(r["column"], []).append(r["_range"])
    targets = ranges.sparkSession.createDataFrame(rows, found.schema)
    values = scan(_values_in(names, wanted), "column string, _range int, _v double, _rows long").groupBy(*by, "_range", "_v").agg(F.sum("_rows").alias("_rows"))
    values = durable(values, "values")  # read three times
    ends = values.groupBy(*by, "_range").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    stepped = join_groups(join_groups(values, targets, [*by, "_range"]), ends, [*by, "_range"]).withColumn("_step", range_step(F.col("_v"))).drop("_lo", "_hi")
    return _picked(stepped, picks, by, count_name).withColumnRenamed("column", name)


def quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (),
    others: Mapping[str, Callable[[Column], Column]] | None = None, null_groups: bool = False,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per name, for groups of any size.

    ``others`` are elements at given positions, as in :func:`order_statistics`, found in the same two passes; ``null_groups`` is as there.
    """
    picks: dict[str, Callable[[Column], Column]] = {**(others or {}), **_sides(probs)}
    found = order_statistics(df, value, picks, by, "_n", null_groups)
    return found.select(*by, *_between(probs), *(others or {}))


def _between(probs: Mapping[str, float]) -> list[Column]:
    """The quantiles between the elements below and above them."""

    def between(name: str, q: float) -> Column:
        place = (F.col("_n") - 1) * F.lit(float(q))
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        mixed = low * (F.ceil(place) - place) + high * (place - F.floor(place))
        return F.when(low == high, low).otherwise(mixed).alias(name)

    return [between(name, q) for name, q in probs.items()]


def _sides(probs: Mapping[str, float]) -> dict[str, Callable[[Column], Column]]:
    """Positions of the elements below and above each quantile."""

    def at(q: float, edge: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda n: edge((n - 1) * F.lit(float(q)))

    return {f"_{side}_{name}": at(q, edge) for name, q in probs.items() for side, edge in (("low", F.floor), ("high", F.ceil))}


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float], name: str = "column") -> DataFrame:
    """:func:`quantiles` of each column of a wide table; see :func:`column_statistics`."""
    return column_statistics(df, columns, _sides(probs), name, "_n").select(name, *_between(probs))


def ranged_quantiles(ranges: DataFrame, scan: Callable[..., DataFrame], columns: Sequence[str], probs: Mapping[str, float], name: str = "column") -> DataFrame:
    """:func:`column_quantiles` from the rows of each column in each value range; see :func:`ranged_statistics`."""
    return ranged_statistics(ranges, scan, columns, _sides(probs), name, "_n").select(name, *_between(probs))


def series_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (ENTITY,)) -> DataFrame:
    """Exact quantiles per entity with the built-in aggregate.

    Only for groups that contain the entity: one entity has at most one row per day, so its value
    map is bounded by the calendar. Use :func:`quantiles` for every other grouping.
    """
    asked = list(probs.items())
    found = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(q)) for _, q in asked]))
    return (
        df.groupBy(*by)
        .agg(found.alias("_q"))
        .select(*by, *[F.col("_q")[i].alias(name) for i, (name, _) in enumerate(asked)])
    )


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the columns of a per-group table to the rows; a single-row table is read as a scalar subquery."""
    by = list(by)
    if by:
        return join_groups(df, stats, by)
    names = stats.columns
    packed = stats.select(F.struct(*names).alias("_stats")).scalar()
    return df.withColumn("_stats", packed).select(*df.columns, *[F.col("_stats")[c].alias(c) for c in names])


def stride_sample(df: DataFrame, max_rows: int, order: str = DATE, tie: str = ENTITY) -> DataFrame:
    """``max_rows`` rows at even steps through the date order (all rows if there are not more).

    The i-th kept rank is ``floor(i * (n-1)/(m-1))``. A row decides for itself whether its rank is
    one of those, so no join with the list of ranks is needed.
    """
    ranked = global_rank(df, order, tie)
    r, n = F.col("rank0").cast("double"), F.col("n_rows")
    if max_rows == 1:
        return ranked.where(F.col("rank0") == 0).drop("rank0", "n_rows")
    last = F.lit(max_rows - 1)
    step = (n - 1).cast("double") / F.lit(float(max_rows - 1))
    near = F.floor(r / F.greatest(step, F.lit(1.0)))

    def hits(i: Column) -> Column:
        return (i >= 0) & (i < last) & (F.floor(i * step) == r)

    kept = hits(near) | hits(near + 1) | hits(near - 1) | (r == n - 1)
    return ranked.where((n <= max_rows) | kept).drop("rank0", "n_rows")


def fraction_split(df: DataFrame, fraction: float = 0.8, order: str = DATE, tie: str = ENTITY) -> DataFrame:
    """Label the first ``int(fraction * n)`` rows by date ``train`` and the rest ``test``."""
    ranked = global_rank(df, order, tie)
    cut = F.floor(F.col("n_rows") * F.lit(fraction))
    return ranked.withColumn("split", F.when(F.col("rank0") < cut, "train").otherwise("test")).drop("rank0", "n_rows")


def time_series_folds(
    df: DataFrame, folds: int, order: str = DATE, tie: str = ENTITY, whole_days: bool = False
) -> DataFrame:
    """Number the validation fold of each row in an expanding-window split (NULL: only ever trained on).

    Fold ``i`` is validated with its own rows and trained on all rows before it, that is on rows
    whose fold is NULL or smaller. ``whole_days`` moves each cut to the start of its day, so that no
    day is in training and validation of the same fold.
    """
    ranked = global_rank(df, order, tie, day_start="_cut_rank" if whole_days else None)
    place = F.col("_cut_rank") if whole_days else F.col("rank0")
    size = F.floor(F.try_divide(F.col("n_rows"), F.lit(folds + 1))).cast("bigint")
    behind = place - (F.col("n_rows") - folds * size)
    fold = F.when((behind >= 0) & (size > 0), F.floor(F.try_divide(behind, size)).cast("int"))
    return ranked.withColumn("fold", fold).drop("n_rows", "_cut_rank")


def sample_rows(df: DataFrame, n: int, keys: Sequence[str] = (ENTITY, DATE), seed: int = 42) -> DataFrame:
    """``n`` distinct rows chosen by the hash of their keys: the same rows for any partitioning.

    The hash is that of the seed and the keys as text, joined by a bar; a NULL key is left out of it.
    """
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *keys).limit(n)
