"""Reading attribute tables, per-entity series and wide tables from CSV."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from daypanel.functions.scalar import date_from_parts, normalize_id
from daypanel.operators.panel import canonical_columns, outer_merge_dims, target_depth
from daypanel.schema import ATTRIBUTE_COLUMNS, DATE, ENTITY, FORCING_COLUMNS, TARGET
from daypanel.session import durable

DATE_PARTS = ("year", "month", "day")
#: Cells of wide files that a task hands on at once.
CELLS = 100_000


def _csv(spark: SparkSession, path: str, infer: bool) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", infer).csv(path)


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob on the file system of the pattern, sorted by name."""
    try:
        found = spark.read.format("binaryFile").load(pattern).select("path")  # contents are not read
    except AnalysisException:  # nothing there
        return []
    return sorted(r["path"] for r in found.collect())


def read_attributes(
    spark: SparkSession,
    paths: Sequence[str],
    key: str = "gauge_id",
    mapping: Mapping[str, str] = ATTRIBUTE_COLUMNS,
) -> DataFrame:
    """One row per entity from several attribute tables, in the order of the paths.

    Tables without the key are skipped; a column that an earlier table already has is ignored.
    Attribute tables have one row per entity, so their types are inferred.
    """
    tables = [t for t in (_csv(spark, p, infer=True) for p in paths) if key in t.columns]
    if not tables:
        raise ValueError(f"no table with the column {key}")
    merged = reduce(lambda a, b: outer_merge_dims(a, b, key), tables)
    return canonical_columns(merged, mapping).withColumn(ENTITY, normalize_id(F.col(key)))


def _dated(df: DataFrame) -> DataFrame:
    parts = {p: F.col(p).cast("int") for p in DATE_PARTS}
    return df.withColumn(DATE, date_from_parts(parts["year"], parts["month"], parts["day"]))


def _decoded(path: Column) -> Column:
    """A file's path as it is named; Spark gives it with escapes."""
    return F.coalesce(F.try_url_decode(path), path)


def _first_lines(spark: SparkSession, path: str) -> DataFrame:
    """The first line of each file below a folder, ``(path, header)``, read as one Spark job; files without a line have none."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    place = lines.where("start = 0").withColumn("place", F.monotonically_increasing_id())
    return place.groupBy("path").agg(F.min_by("value", "place").alias("header"))


def _names(header: str) -> tuple[str, ...]:
    return tuple(next(csv.reader([header.removeprefix("\ufeff").rstrip("\r")]), []))


def header_catalogue(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files below a folder by their header, read from their first lines as one Spark job.

    The driver gets the distinct headers and the paths, which it would list for any scan. Files without a line are left out.
    """
    found: dict[tuple[str, ...], list[str]] = {}
    for r in _first_lines(spark, path).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect():
        found.setdefault(_names(r["header"]), []).extend(unquote(p) for p in r["paths"])
    return dict(sorted(found.items()))


def read_entity_series(
    spark: SparkSession,
    path: str,
    mapping: Mapping[str, str] = FORCING_COLUMNS,
    id_pattern: str = r"0*(\d+)\.csv$",
) -> DataFrame:
    """All entities' daily series from a folder of one file per entity, whose files may differ in columns.

    The id is the group of ``id_pattern`` in the file's path. All files are scanned together by place; what stands at a place follows from
    the header of the file, which is joined by its path, so that no list of files is named to a reader. Only the date and the mapped
    columns are kept, as doubles, and a column that a file lacks is NULL for its entity. Values are not inferred. Files whose
    header lacks a part of the date have no day and are left out.
    """
    firsts = durable(_first_lines(spark, path), "headers")
    forms: list[tuple[str, dict[str, int]]] = []
    width = 0
    for header in sorted(r["header"] for r in firsts.select("header").distinct().collect()):
        names = _names(header)
        if not set(DATE_PARTS) <= set(names):
            continue
        wanted = [mapping.get(n.strip().lower(), n) for n in names]
        if twice := sorted({n for n in wanted if wanted.count(n) > 1 and n in (*DATE_PARTS, *mapping.values())}):
            raise ValueError(f"columns that a file has twice: {twice}")
        forms.append((header, {n: i for i, n in enumerate(wanted)}))
        width = max(width, len(names))
    if not forms:
        return spark.createDataFrame([], f"{ENTITY} string, {DATE} date")
    schema = StructType([StructField(f"_c{i}", StringType()) for i in range(width)])
    raw = spark.read.option("header", False).option("recursiveFileLookup", True).schema(schema).csv(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("path"))
    form = F.when(F.lit(False), F.lit(0))
    for i, (header, _) in enumerate(forms):
        form = form.when(F.col("header") == header, F.lit(i))
    located = raw.join(firsts.select("path", form.alias("_form")).where("_form IS NOT NULL"), "path")

    def at(name: str) -> Column:
        """The cell of a column, by the form of the file."""
        cell = F.when(F.lit(False), F.lit(None).cast("string"))
        for i, (_, places) in enumerate(forms):
            if name in places:
                cell = cell.when(F.col("_form") == i, F.col(f"_c{places[name]}"))
        return cell

    values = [c for c in dict.fromkeys(mapping.values()) if any(c in places for _, places in forms)]
    cells = located.select(F.col("path").alias("_path"), *[at(c).alias(c) for c in (*DATE_PARTS, *values)])
    headers = [F.coalesce(F.replace(F.col(p), F.lit("\ufeff"), F.lit("")) == p, F.lit(False)) for p in DATE_PARTS]
    return _dated(cells.where(~reduce(and_, headers))).select(
        normalize_id(F.regexp_extract(_decoded(F.col("_path")), id_pattern, 1)).alias(ENTITY),
        DATE,
        *[F.col(c).try_cast("double").alias(c) for c in values],
    )


def _cells(names: Sequence[str], known: bool):
    """The cells of each line of a wide file, a row a cell; the lines that repeat the header are left out."""
    places = [names.index(p) for p in DATE_PARTS]
    shown = [(i, n or f"_c{i}") for i, n in enumerate(names) if n not in DATE_PARTS]
    columns = [*DATE_PARTS, "id", "cell"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for lines in batches:
            for line in lines.column(0):
                found = next(csv.reader([line.as_py().removeprefix("\ufeff").rstrip("\r")]), [])
                if not found or found == list(names):
                    continue
                found += [""] * (len(names) - len(found))
                day = [found[i] or None for i in places]
                rows.extend((*day, n, found[i] or None) for i, n in shown if found[i] or not known)
                if len(rows) >= CELLS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return run


def read_wide(spark: SparkSession, path: str, value: str, known: bool = False) -> DataFrame:
    """A wide table ``year, month, day, <id>, ...`` as ``(date, entity, value)``, without the empty cells if ``known``.

    A file may have any number of columns: lines are cut into cells by tasks, and no plan holds an expression for each column.
    """
    parts = []
    for names, paths in header_catalogue(spark, path).items():
        if missing := set(DATE_PARTS) - set(names):
            raise ValueError(f"a wide file without the columns {sorted(missing)}: {paths[0]}")
        parts.append(spark.read.text(paths).mapInArrow(_cells(names, known), "year string, month string, day string, id string, cell string"))
    if not parts:
        return spark.createDataFrame([], f"{DATE} date, {ENTITY} string, {value} double")
    cells = _dated(reduce(DataFrame.union, parts))
    return cells.select(DATE, normalize_id(F.col("id")).alias(ENTITY), F.col("cell").try_cast("double").alias(value))


def read_observations(spark: SparkSession, path: str, attributes: DataFrame, name: str = TARGET, known: bool = False) -> DataFrame:
    """The wide observed rates as depth per day of the entities with a usable area; only filled cells if ``known``."""
    return target_depth(read_wide(spark, path, "_rate", known), attributes, "_rate", name).drop("_rate")


def read_panel(
    spark: SparkSession, attributes: Sequence[str], forcings: str, observations: str, id_pattern: str = r"0*(\d+)\.csv$"
) -> DataFrame:
    """The panel of all entities from their files: attribute tables, one file of forcings per entity and a wide table of observed rates.

    One row per entity and day of its forcings, with the observed depth where it is known and the attributes of the entity.
    """
    known = read_attributes(spark, attributes)
    days = read_entity_series(spark, forcings, id_pattern=id_pattern).where(F.col(DATE).isNotNull())
    observed = read_observations(spark, observations, known, known=True).select(ENTITY, DATE, TARGET)
    static = known.drop(*[c for c in known.columns if c != ENTITY and c in days.columns])
    return days.join(observed, [ENTITY, DATE], "left").join(static, ENTITY, "left")


def read_predictions(
    spark: SparkSession, path: str | None, attributes: DataFrame, name: str = "baseline_mm_day"
) -> DataFrame:
    """A wide table of another model's predictions; an empty table of the same shape if there is none."""
    empty = spark.createDataFrame([], f"{ENTITY} string, {DATE} date, {name} double")
    if not path:
        return empty
    try:
        wide = read_wide(spark, path, "_rate")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            return empty
        raise
    return target_depth(wide, attributes, "_rate", name).select(ENTITY, DATE, name)
