"""Operators along each entity's date order: lags, rolling frames, gap filling, runs, windows.

A series is not tied to one task. Frames that reach a known number of rows back or ahead run on
fixed-size blocks of the series, each with copies of the rows its frames reach into
(:func:`over_series`). Values that travel any distance (last known value, open run) are carried from
block to block through one summary row per block (:func:`known_before`, :func:`known_after`). A
single entity holding a third of all rows is therefore spread over many tasks, and the results
equal those of one long window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from daypanel.functions.scalar import linear_fill
from daypanel.operators.frames import Frame, add_frames
from daypanel.operators.order import attach, series_quantiles, with_position
from daypanel.schema import DATE, ENTITY, OBS, PRECIP, PRED, TARGET

BLOCK_ROWS = 4096
_UP_TO_NOW = (Window.unboundedPreceding, Window.currentRow)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """The shuffle a window needs, with a fixed number of partitions.

    Window columns cost far more than the few narrow columns they are made of, so partitions must not
    be merged by the size of those columns, which adaptive execution would do.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def over_series(
    df: DataFrame,
    build: Callable[[WindowSpec], Sequence[Column]],
    before: int = 0,
    after: int = 0,
    key: str = ENTITY,
    order: str = DATE,
    pos: str = "pos",
    block_rows: int = BLOCK_ROWS,
    frames: Sequence[Frame] = (),
    dealt: bool = False,
    keep: Column | None = None,
) -> DataFrame:
    """Add window columns whose frames reach ``before`` rows back and ``after`` rows ahead.

    ``build`` gets the window (entity order by row position) and returns the columns; ``frames`` are trailing
    frames to add by :func:`add_frames`, which reach their own rows back. If ``df`` has
    a row position (1, 2, ... per entity) under the name ``pos`` it is used, which makes this one
    shuffle; otherwise the position is computed first and dropped again.

    ``dealt`` says that all rows of a series are in one partition, as :func:`daypanel.operators.panel.dense_panel` leaves them. Its
    series must be short enough for that (a row a day); nothing is shuffled or copied then. Rows for which ``keep`` is not true are
    left out at the end.
    """
    if dealt:
        return _over_dealt(df, build, key, order, pos, frames, keep)
    before = max([before, *(f.reach for f in frames)])
    if max(before, after) >= block_rows:
        raise ValueError("a block must be longer than the frames that cross its border")
    given = pos in df.columns
    placed = df if given else with_position(df, key, order, pos)
    index = F.col(pos) - 1
    home = F.floor(index / block_rows).cast("bigint")
    inside = F.pmod(index, F.lit(block_rows))
    wanted_by = [home]
    if before:
        wanted_by.append(F.when(inside >= block_rows - before, home + 1))
    if after:
        wanted_by.append(F.when((inside < after) & (home > 0), home - 1))
    copies = placed.withColumn("_home", home).withColumn("_block", F.explode(F.array_compact(F.array(*wanted_by))))
    window = Window.partitionBy(key, "_block").orderBy(pos)
    built = _spread(copies, key, "_block").select("*", *build(window))
    own = F.col("_block") == F.col("_home")
    marked = built.withColumn("_keep", own if keep is None else own & keep)
    return add_frames(marked, frames, [key, "_block"], pos, "_keep").drop("_home", "_block", *([] if given else [pos]))


def placed_dealt(df: DataFrame, key: str = ENTITY, order: str = DATE, pos: str = "pos") -> DataFrame:
    """Positions of dealt rows; rows without a key or a day have none and are left out, as :func:`with_position` does."""
    known = df.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    return known.withColumn(pos, F.row_number().over(Window.partitionBy(key).orderBy(order)))


def _over_dealt(
    df: DataFrame, build: Callable[[WindowSpec], Sequence[Column]], key: str, order: str, pos: str, frames: Sequence[Frame], keep: Column | None
) -> DataFrame:
    given = pos in df.columns
    placed = df if given else placed_dealt(df, key, order, pos)
    built = placed.select("*", *build(Window.partitionBy(key).orderBy(pos)))
    marked = built if keep is None else built.withColumn("_keep", keep)
    out = add_frames(marked, frames, [key], pos, None if keep is None else "_keep")
    return out if given else out.drop(pos)


def _carried(
    df: DataFrame, values: Mapping[str, Column], forward: bool, key: str, order: str, block_days: int
) -> DataFrame:
    """Add, under each name, the nearest non-null value at or before (or at or after) each row."""
    marked = df.select("*", *[c.alias(f"_in_{name}") for name, c in values.items()]).withColumn(
        "_block", F.floor(F.datediff(F.col(order), F.lit("1970-01-01").cast("date")) / block_days).cast("bigint")
    )
    newest = F.max_by if forward else F.min_by
    # Backwards the rows are read in descending order: a frame that looks ahead to the end of its
    # partition would be evaluated anew for every row.
    direction = F.asc if forward else F.desc
    blocks = marked.groupBy(key, "_block").agg(
        *[newest(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col(order))).alias(f"_edge_{n}") for n in values]
    )
    across = Window.partitionBy(key).orderBy(direction("_block")).rowsBetween(Window.unboundedPreceding, -1)
    edges = blocks.select(
        key, "_block", *[F.last(f"_edge_{n}", ignorenulls=True).over(across).alias(f"_far_{n}") for n in values]
    )
    within = Window.partitionBy(key, "_block").orderBy(direction(order)).rowsBetween(*_UP_TO_NOW)
    return _spread(marked, key, "_block").join(edges, [key, "_block"]).select(
        *df.columns,
        *[
            F.coalesce(F.last(f"_in_{n}", ignorenulls=True).over(within), F.col(f"_far_{n}")).alias(n)
            for n in values
        ],
    )


def known_before(
    df: DataFrame, values: Mapping[str, Column], key: str = ENTITY, order: str = DATE, block_days: int = BLOCK_ROWS
) -> DataFrame:
    """Add the last non-null value at or before each row."""
    return _carried(df, values, True, key, order, block_days)


def known_after(
    df: DataFrame, values: Mapping[str, Column], key: str = ENTITY, order: str = DATE, block_days: int = BLOCK_ROWS
) -> DataFrame:
    """Add the first non-null value at or after each row."""
    return _carried(df, values, False, key, order, block_days)


# --- column and frame builders, to be combined in one over_series call ---------------------------


def lag_columns(column: str, lags: Sequence[int], w: WindowSpec) -> list[Column]:
    """Row shifts of a column; the shift counts rows, not days."""
    return [F.lag(column, k).over(w).alias(f"{column}_lag_{k}") for k in lags]


def rolling_frames(column: str, windows: Sequence[int], stats: Sequence[str], include_current: bool = True) -> list[Frame]:
    shift = 0 if include_current else 1
    return [Frame(column, stat, n, f"{column}_roll{n}_{stat}", shift) for n in windows for stat in stats]


def cumulative_frames(column: str, windows: Sequence[int] = (3, 7, 14, 30)) -> list[Frame]:
    return [Frame(column, "sum", n, f"{column}_cumsum_{n}") for n in windows]


def dry_day_frame(column: str, rows: int = 7, below: float = 0.1) -> Frame:
    """Days below the limit among the trailing rows; a missing value is not a dry day."""
    return Frame(column, "dry", rows, f"{column}_dry_days_{rows}", 0, below)


# --- operators ---------------------------------------------------------------------------------


def lag_target(df: DataFrame, lags: Sequence[int] = (1, 2, 3, 5, 7, 14, 30), target: str = TARGET, dealt: bool = False) -> DataFrame:
    return over_series(df, lambda w: lag_columns(target, lags, w), before=max(lags), dealt=dealt)


def lag_covariates(df: DataFrame, columns: Sequence[str], lags: Sequence[int] = (1, 3, 7)) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return over_series(df, lambda w: [c for name in present for c in lag_columns(name, lags, w)], before=max(lags))


def rolling_stats(
    df: DataFrame,
    columns: Sequence[str],
    windows: Sequence[int] = (3, 7, 14, 30),
    stats: Sequence[str] = ("mean", "std", "min", "max"),
    include_current: bool = True,
    dealt: bool = False,
) -> DataFrame:
    frames = [f for name in columns for f in rolling_frames(name, windows, stats, include_current)]
    return over_series(df, lambda w: [], frames=frames, dealt=dealt)


def rolling_sum(df: DataFrame, column: str = PRECIP, windows: Sequence[int] = (3, 7, 14, 30), dealt: bool = False) -> DataFrame:
    return over_series(df, lambda w: [], frames=cumulative_frames(column, windows), dealt=dealt)


def dry_days(df: DataFrame, column: str = PRECIP, rows: int = 7, below: float = 0.1, dealt: bool = False) -> DataFrame:
    return over_series(df, lambda w: [], frames=[dry_day_frame(column, rows, below)], dealt=dealt)


def drop_warmup(df: DataFrame, rows: int = 30, pos: str = "pos") -> DataFrame:
    """Drop the first rows of each entity by position, whose features have no full history."""
    if pos in df.columns:
        return df.where(F.col(pos) > rows)
    return with_position(df, name=pos).where(F.col(pos) > rows).drop(pos)


def _carried_dealt(df: DataFrame, values: Mapping[str, Column], forward: bool, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.asc(order) if forward else F.desc(order)).rowsBetween(*_UP_TO_NOW)
    return df.select("*", *[F.last(c, ignorenulls=True).over(w).alias(n) for n, c in values.items()])


def interpolate_linear(df: DataFrame, columns: Sequence[str], pos: str = "pos", dealt: bool = False) -> DataFrame:
    """Fill gaps on a straight line by row position; before the first value take the first, after the last the last.

    With ``dealt`` (see :func:`over_series`) both neighbours come from windows over the whole series, without a shuffle.
    """
    placed = df if pos in df.columns else with_position(df, name=pos)
    seen = {}
    for c in columns:
        seen[c] = F.col(c)
        seen[f"{c}__at"] = F.when(F.col(c).isNotNull(), F.col(pos))
    lefts, rights = ({f"_{side}_{n}": e for n, e in seen.items()} for side in "lr")
    if dealt:
        both = _carried_dealt(_carried_dealt(placed, lefts, True, ENTITY, DATE), rights, False, ENTITY, DATE)
    else:
        both = known_after(known_before(placed, lefts), rights)
    filled = {
        c: linear_fill(
            F.col(c),
            F.col(pos),
            F.col(f"_l_{c}"),
            F.col(f"_l_{c}__at"),
            F.col(f"_r_{c}"),
            F.col(f"_r_{c}__at"),
        )
        for c in columns
    }
    return both.select(*[filled.get(c, F.col(c)).alias(c) for c in df.columns])


def ffill(df: DataFrame, columns: Sequence[str], dealt: bool = False) -> DataFrame:
    """Carry each column's last known value forward within the entity; without a shuffle if ``dealt`` (see :func:`over_series`)."""
    values = {f"_kept_{c}": F.col(c) for c in columns}
    carried = _carried_dealt(df, values, True, ENTITY, DATE) if dealt else known_before(df, values)
    return carried.select(*[F.col(f"_kept_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def longest_run_below(df: DataFrame, value: str, limit: str, key: str = ENTITY, order: str = DATE) -> DataFrame:
    """Longest run of consecutive rows with ``value < limit`` per entity (0 if there is none).

    Rows below the limit belong to the run that started after the last row not below it, so a run
    is a group that Spark counts with partial aggregation, however long it is.
    """
    below = F.coalesce(F.col(value) < F.col(limit), F.lit(False))
    broken = known_before(df.select(key, order, value, limit), {"_since": F.when(~below, F.col(order))}, key, order)
    runs = broken.groupBy(key, "_since").agg(F.count(F.when(below, F.lit(1))).alias("_run"))
    return runs.groupBy(key).agg(F.max("_run").alias("longest_run"))


def peak_hits(df: DataFrame, quantile: float = 0.95, reach: int = 3) -> DataFrame:
    """The rows at or above each entity's high-flow quantile, with ``hit`` = a prediction within
    ``reach`` rows on either side gets to the observed threshold."""
    limits = series_quantiles(df, OBS, {"threshold": quantile})
    near = over_series(
        df,
        lambda w: [F.max(PRED).over(w.rowsBetween(-reach, reach)).alias("near_max")],
        before=reach,
        after=reach,
    )
    flagged = attach(near, limits, [ENTITY]).where(F.col(OBS) >= F.col("threshold"))
    return flagged.withColumn("hit", F.coalesce(F.col("near_max") >= F.col("threshold"), F.lit(False)).cast("int"))


def sequence_windows(
    df: DataFrame, features: Sequence[str], lookback: int, validation_share: float = 0.1
) -> DataFrame:
    """One row per date with a full look-back: the features of rows ``t-L+1 .. t`` as an array.

    ``part`` marks the last ``validation_share`` (at least one) of each entity's windows. The first
    ``L-1`` rows of an entity have no window; see :func:`fill_first_prediction`.
    """
    placed = with_position(df)
    lasts = placed.groupBy(ENTITY).agg(F.max("pos").alias("_last"))
    framed = over_series(
        placed,
        lambda w: [F.collect_list(F.struct(*features)).over(w.rowsBetween(-(lookback - 1), 0)).alias("window")],
        before=lookback,
    ).where(F.col("pos") >= lookback)
    windows = F.col("_last") - (lookback - 1)
    held_out = F.greatest(F.lit(1), F.floor(windows * F.lit(validation_share)))
    return (
        framed.join(lasts, ENTITY)
        .withColumn("part", F.when(F.col("pos") > F.col("_last") - held_out, "validation").otherwise("train"))
        .drop("_last")
    )


def fill_first_prediction(df: DataFrame, prediction: str) -> DataFrame:
    """Rows before the first window take the entity's first prediction."""
    firsts = df.groupBy(ENTITY).agg(
        F.min_by(prediction, F.when(F.col(prediction).isNotNull(), F.col(DATE))).alias("_first")
    )
    return df.join(firsts, ENTITY).select(
        *[F.coalesce(F.col(c), F.col("_first")).alias(c) if c == prediction else F.col(c) for c in df.columns]
    )


def running_best(trials: DataFrame, model: str = "model", trial: str = "trial", score: str = "score") -> DataFrame:
    """Best score so far in the trial order of each model (a trial table has one row per trial)."""
    w = Window.partitionBy(model).orderBy(trial).rowsBetween(*_UP_TO_NOW)
    return trials.withColumn("best_so_far", F.max(score).over(w))
