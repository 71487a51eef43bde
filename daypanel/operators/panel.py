"""Building and cutting the entity x day panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.functions.scalar import normalize_id, rate_to_depth
from daypanel.schema import BASIN, DATE, ENTITY, OBS, PRED, TARGET

# --- shape -------------------------------------------------------------------------------------


def canonical_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns whose trimmed lower-case header is in ``mapping``; keep the others as they are."""
    return df.withColumnsRenamed({c: mapping[c.strip().lower()] for c in df.columns if c.strip().lower() in mapping})


def wide_to_long(
    df: DataFrame, id_columns: Sequence[str], value: str, entity: str = ENTITY, normalize: bool = True
) -> DataFrame:
    """One row per (id columns, entity) from one column per entity; NULL cells stay as rows."""
    names = [c for c in df.columns if c not in id_columns]
    long = df.unpivot(list(id_columns), names, entity, value)
    return long.withColumn(entity, normalize_id(F.col(entity))) if normalize else long


def densify(entities: DataFrame, start: str, end: str, pos: str | None = "pos") -> DataFrame:
    """One row per entity and calendar day, with the day's position; a generator per row, not a join."""
    first = F.lit(start).cast("date")
    days = F.sequence(first, F.lit(end).cast("date"), F.expr("INTERVAL 1 DAY"))
    dense = entities.withColumn(DATE, F.explode(days))
    return dense.withColumn(pos, F.datediff(F.col(DATE), first) + 1) if pos else dense


def dense_panel(entities: DataFrame, seen: DataFrame, start: str, end: str, pos: str = "pos") -> DataFrame:
    """The rows of :func:`densify` with the values seen on each day, as a left join of both on entity and day gives them.

    Only the seen days are shuffled: those of an entity travel as one array, no longer than the calendar, and the days between them are
    generated where the rows are used. All rows of an entity are in one partition (in no promised order), so that operators told so by
    ``dealt`` need no further shuffle.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    values = {c: t for c, t in seen.dtypes if c not in (ENTITY, DATE)}
    at = (F.datediff(F.col(DATE), first) + 1).alias("at")
    inside = seen.where(F.col(DATE).between(first, last) & F.col(ENTITY).isNotNull())
    held = inside.groupBy(ENTITY).agg(F.sort_array(F.collect_list(F.struct(at, *values))).alias("_seen"))
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = entities.join(held, ENTITY, "left").repartition(parts, ENTITY)
    gap = F.array(F.struct(F.lit(1).alias("at"), *[F.lit(None).cast(t).alias(c) for c, t in values.items()]))
    length = F.datediff(last, first) + 1
    whole = F.when(F.col("_seen").isNull(), gap).when(F.col("_seen")[0]["at"] > 1, F.concat(gap, F.col("_seen"))).otherwise(F.col("_seen"))
    listed = placed.where(length > 0).select(*entities.columns, whole.alias("_days"))
    following = F.transform(F.slice("_days", F.lit(2), F.size("_days")), lambda x: x["at"])
    spans = F.zip_with(
        "_days", following, lambda x, n: F.struct(x["at"].alias("_at"), F.coalesce(n, length + 1).alias("_next"), *[x[c].alias(f"_v_{c}") for c in values])
    )
    opened = listed.select(*entities.columns, F.inline(spans))
    days = opened.withColumn(pos, F.explode(F.sequence(F.col("_at"), F.greatest(F.col("_at"), F.col("_next") - 1))))
    others = [c for c in entities.columns if c != ENTITY]
    shown = [F.when(F.col(pos) == F.col("_at"), F.col(f"_v_{c}")).alias(c) for c in values]
    return days.select(ENTITY, F.date_add(first, F.col(pos) - 1).alias(DATE), *others, pos, *shown)


@dataclass(frozen=True)
class HeldPanel:
    """The rows of :func:`dense_panel` before the days without values are generated: a row an entity, see :func:`hold_panel`."""

    rows: DataFrame
    start: str
    end: str

    def fields(self, column: str) -> dict[str, str]:
        """Names and types of the attributes (``_copies``) or of the values (``_seen``)."""
        inner = self.rows.schema[column].dataType.elementType
        return {f.name: f.dataType.simpleString() for f in inner.fields if f.name != "at"}


def hold_panel(entities: DataFrame, seen: DataFrame, start: str, end: str) -> HeldPanel:
    """The panel of :func:`dense_panel` as one row an entity: its attribute rows (``_copies``) and the values seen in the calendar in the
    order of their day (``_seen``, ``at`` counts from 1). A row is no longer than the calendar, and any scan of a written copy has whole
    entities."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    at = (F.datediff(F.col(DATE), first) + 1).alias("at")
    inside = seen.where(F.col(DATE).between(first, last) & F.col(ENTITY).isNotNull())
    values = [c for c in seen.columns if c not in (ENTITY, DATE)]
    held = inside.groupBy(ENTITY).agg(F.sort_array(F.collect_list(F.struct(at, *values))).alias("_seen"))
    others = [c for c in entities.columns if c != ENTITY] or [F.lit(True).alias("_there")]
    known = entities.groupBy(ENTITY).agg(F.collect_list(F.struct(*others)).alias("_copies"))
    return HeldPanel(known.join(held, ENTITY, "left"), start, end)


def stack_entities(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack sources with different optional columns, aligned by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# --- joins -------------------------------------------------------------------------------------


def outer_merge_dims(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join of two attribute tables; a column both have is taken from the left one."""
    fresh = [c for c in right.columns if c == key or c not in left.columns]
    return left.join(right.select(*fresh), key, "outer")


def join_target(forcings: DataFrame, target: DataFrame) -> DataFrame:
    """Days present in both the forcing and the target series of an entity."""
    return forcings.join(target, [ENTITY, DATE], "inner")


def attach_static(panel: DataFrame, attributes: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Add the named attributes (those that exist) and identity columns of each entity.

    The attribute table grows with the number of entities, so no broadcast is forced: Spark
    broadcasts it while it is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond.
    """
    carried = [c for c in dict.fromkeys([*columns, BASIN, "latitude", "longitude"]) if c in attributes.columns]
    return panel.join(attributes.select(ENTITY, *[c for c in carried if c not in panel.columns]), ENTITY, how)


def target_depth(rates: DataFrame, attributes: DataFrame, rate: str, name: str, area: str = "area_km2") -> DataFrame:
    """Rates converted to depth with each entity's area; entities without a usable area are left out."""
    usable = attributes.where(F.col(area) > 0).select(ENTITY, area)
    return rates.join(usable, ENTITY).withColumn(name, rate_to_depth(F.col(rate), F.col(area))).drop(area)


def entity_intersection(*sources: DataFrame) -> DataFrame:
    """Ids present in every source, in numeric order."""
    ids = [s.select(F.col(ENTITY).cast("string").alias(ENTITY)) for s in sources]
    return reduce(lambda a, b: a.intersect(b), ids).orderBy(F.col(ENTITY).try_cast("bigint"), ENTITY)


def join_predictions(
    predictions: DataFrame, baseline: DataFrame, baseline_value: str, start: str, end: str
) -> DataFrame:
    """Both predictions of each (day, entity) inside the closed test window, complete rows only."""
    window = baseline.where(F.col(DATE).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    both = predictions.join(window.select(ENTITY, DATE, baseline_value), [ENTITY, DATE])
    return both.dropna(subset=[OBS, PRED, baseline_value])


def attach_risk_attrs(risk: DataFrame, attributes: DataFrame) -> DataFrame:
    """Position, area and basin beside each risk row, NULL for an entity without attributes."""
    wanted = [c for c in ("latitude", "longitude", "area_km2", BASIN) if c in attributes.columns]
    return risk.join(attributes.select(ENTITY, *wanted), ENTITY, "left")


def join_key_overlap(left: DataFrame, ids: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """For each column of ``left``: how many of the wanted ids its normalised values contain."""
    names = list(columns or left.columns)
    cells = left.select(*[normalize_id(F.col(c), lenient=True).alias(c) for c in names]).unpivot(
        [], names, "column", "id"
    )
    wanted = ids.select(F.col(ENTITY).cast("string").alias("id")).distinct()
    found = cells.join(wanted, "id", "left_semi").distinct().groupBy("column").agg(F.count("id").alias("overlap"))
    order = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))])
    needed = wanted.agg(F.greatest(F.lit(1), F.floor(F.count("id") / 2)).alias("needed")).scalar()
    return found.select("column", "overlap", order[F.col("column")].alias("place"), needed.alias("needed"))


def detect_join_key(left: DataFrame, ids: DataFrame, columns: Sequence[str] | None = None) -> str | None:
    """The first column that matches at least half of the wanted ids (one job; None if no column does)."""
    hit = join_key_overlap(left, ids, columns).where("overlap >= needed").orderBy("place").select("column").head()
    return hit["column"] if hit else None


def join_on_detected_key(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> DataFrame | None:
    """Inner join on the detected id column of ``left``; None when no column matches."""
    key = detect_join_key(left, right, columns)
    if key is None:
        return None
    normal = right.withColumn(ENTITY, F.col(ENTITY).cast("string"))
    return left.withColumn(ENTITY, normalize_id(F.col(key), lenient=True)).join(normal, ENTITY)


# --- filters and splits ------------------------------------------------------------------------


def filter_groups_ci(df: DataFrame, names: str | Sequence[str], column: str = BASIN) -> DataFrame:
    """Rows whose group name is one of ``names``, ignoring case."""
    wanted = [names] if isinstance(names, str) else list(names)
    return df.where(F.lower(column).isin(*[n.lower() for n in wanted]))


def filter_min_history(df: DataFrame, rows: int, start: str, end: str, target: str = TARGET) -> DataFrame:
    """All rows of the entities with at least ``rows`` known targets inside the closed window."""
    inside = F.col(DATE).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    enough = df.where(inside).groupBy(ENTITY).agg(F.count(target).alias("_known")).where(F.col("_known") >= rows)
    return df.join(enough.select(ENTITY), ENTITY, "left_semi")


def drop_invalid_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.where(F.col(target).isNotNull() & (F.col(target) >= 0))


def split_label(
    train_end: str, test_start: str, train_start: str | None = None, test_end: str | None = None
) -> tuple[Column, Column]:
    """Conditions for the training and the test period, both closed."""
    day = F.col(DATE)
    train, test = day <= F.lit(train_end).cast("date"), day >= F.lit(test_start).cast("date")
    if train_start:
        train = train & (day >= F.lit(train_start).cast("date"))
    if test_end:
        test = test & (day <= F.lit(test_end).cast("date"))
    return train, test


def temporal_split(
    df: DataFrame, train_end: str, test_start: str, train_start: str | None = None, test_end: str | None = None
) -> tuple[DataFrame, DataFrame]:
    train, test = split_label(train_end, test_start, train_start, test_end)
    return df.where(train), df.where(test)


def date_floor_filter(df: DataFrame, start: str) -> DataFrame:
    return df.where(F.col(DATE) >= F.lit(start).cast("date"))
