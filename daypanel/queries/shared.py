"""The panel the queries run on, derived from the driver tables.

An entity is a supplier, its basin the supplier's region, a day a ship date; the observed flow is the
shipped quantity of that day (whole numbers, so sums are exact in any order) and precipitation the
returned part of it. Days without shipments have no flow. Both the number of entities and the
number of rows grow with the tables.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daypanel.operators.panel import HeldPanel, dense_panel, hold_panel
from daypanel.operators.series import over_series
from daypanel.queries.registry import fragment
from daypanel.schema import BASIN, DATE, ENTITY, OBS, PET, PRECIP, PRED, TARGET, TMAX, TMIN
from daypanel.session import durable

TRAIN_END, TEST_START = "1998-12-31", "1999-01-01"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def calendar(spark: SparkSession, folder: str) -> tuple[str, str]:
    """First and last ship date."""
    day = F.col("l_shipdate").cast("date")
    first, last = table(spark, folder, "lineitem").agg(F.min(day).cast("string"), F.max(day).cast("string")).first()
    return first or "1970-01-01", last or "1970-01-01"


def observed(spark: SparkSession, folder: str) -> DataFrame:
    """One row per supplier and ship date; combined before the shuffle, so a hot supplier stays small."""
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(F.lit(0.0))
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias(ENTITY), F.col("l_shipdate").cast("date").alias(DATE))
        .agg(
            F.sum("l_quantity").alias(TARGET),
            F.sum(returned).alias(PRECIP),
            F.max("l_quantity").alias(TMAX),
            F.min("l_quantity").alias(TMIN),
            F.sum("l_linenumber").cast("double").alias(PET),
        )
    )


def attributes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per supplier. The account balance stands for the area; some are not positive."""
    supplier, nation, region = (table(spark, folder, t) for t in ("supplier", "nation", "region"))
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return joined.select(
        F.col("s_suppkey").alias(ENTITY),
        F.col("r_name").alias(BASIN),
        F.col("s_acctbal").alias("area_km2"),
        (F.col("n_nationkey") + 8).cast("double").alias("latitude"),
        (F.col("n_regionkey") + 72).cast("double").alias("longitude"),
    )


def panel(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Every supplier on every day of the calendar, with the row position; with only ``columns`` beside these, if any are named.

    The rows of a supplier are in one partition: there is one for each day of the calendar.
    """
    return dense_panel(*_sources(spark, folder, *columns), *calendar(spark, folder))


def _sources(spark: SparkSession, folder: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    places, seen = attributes(spark, folder), observed(spark, folder)
    if columns:
        places, seen = (t.select(*[c for c in t.columns if c in (ENTITY, DATE, *columns)]) for t in (places, seen))
    return places, seen


def held(spark: SparkSession, folder: str, *columns: str) -> HeldPanel:
    """The :func:`panel` as one row a supplier, written once."""
    panel = hold_panel(*_sources(spark, folder, *columns), *calendar(spark, folder))
    return replace(panel, rows=durable(panel.rows, "held"))


def dealt(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df``, with at most one row for each entity and day, with the rows of an entity in one partition."""
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), ENTITY)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Test days with the flow, the flow observed before it (``y_pred``) and the train mean of the month (``clim``)."""
    seen = observed(spark, folder).select(ENTITY, DATE, TARGET, PRECIP)
    shifted = over_series(seen, lambda w: [F.lag(TARGET, 1).over(w).alias(PRED)], before=1)
    climate = (
        seen.where(F.col(DATE) <= F.lit(TRAIN_END).cast("date"))
        .groupBy(ENTITY, F.month(DATE).alias("_month"))
        .agg(F.avg(TARGET).alias("clim"))
    )
    test = shifted.where(F.col(DATE) >= F.lit(TEST_START).cast("date")).withColumn("_month", F.month(DATE))
    return test.join(climate, [ENTITY, "_month"], "left").select(
        ENTITY, DATE, F.col(TARGET).alias(OBS), PRED, "clim", PRECIP
    )


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """A second, short-series panel: cents of event value per user and day."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias(ENTITY), F.col("ts").cast("date").alias(DATE))
        .agg(F.sum(cents).cast("double").alias(TARGET))
    )


fragment(
    "obs",
    """
SELECT l_suppkey AS catchment_id, CAST(l_shipdate AS DATE) AS date,
       SUM(l_quantity) AS streamflow_mm_day,
       SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END) AS precipitation_mm,
       MAX(l_quantity) AS temperature_max_c, MIN(l_quantity) AS temperature_min_c,
       CAST(SUM(l_linenumber) AS DOUBLE) AS pet_mm
FROM lineitem GROUP BY 1, 2""",
)
fragment(
    "attrs",
    """
SELECT s_suppkey AS catchment_id, r_name AS basin, s_acctbal AS area_km2,
       CAST(n_nationkey + 8 AS DOUBLE) AS latitude, CAST(n_regionkey + 72 AS DOUBLE) AS longitude
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
fragment("days", "SELECT MIN(CAST(l_shipdate AS DATE)) AS first, MAX(CAST(l_shipdate AS DATE)) AS last FROM lineitem")
fragment(
    "spine",
    """
SELECT s.*, CAST(date_diff('day', first, date) + 1 AS INTEGER) AS pos FROM (
  SELECT attrs.*, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS date FROM attrs JOIN days ON true) s JOIN days ON true""",
    "days",
    "attrs",
)
fragment("panel", "SELECT * FROM spine LEFT JOIN obs USING (catchment_id, date)", "spine", "obs")
fragment(
    "preds",
    f"""
SELECT t.catchment_id, t.date, t.y_true, t.y_pred, c.clim, t.precipitation_mm
FROM (SELECT catchment_id, date, streamflow_mm_day AS y_true, precipitation_mm,
             LAG(streamflow_mm_day) OVER (PARTITION BY catchment_id ORDER BY date) AS y_pred FROM obs) t
LEFT JOIN (SELECT catchment_id, month(date) AS m, AVG(streamflow_mm_day) AS clim FROM obs
           WHERE date <= DATE '{TRAIN_END}' GROUP BY 1, 2) c
  ON c.catchment_id = t.catchment_id AND c.m = month(t.date)
WHERE t.date >= DATE '{TEST_START}'""",
    "obs",
)
# Rows that can be scored, with predictions at or above zero.
fragment(
    "scored",
    """
SELECT catchment_id, date, y_true, greatest(y_pred, 0.0) AS y_pred, clim, precipitation_mm
FROM preds WHERE y_true IS NOT NULL AND y_pred IS NOT NULL""",
    "preds",
)
fragment(
    "activity",
    """
SELECT user_id AS catchment_id, CAST(ts AS DATE) AS date,
       CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS streamflow_mm_day
FROM events GROUP BY 1, 2""",
)

NSE = """CASE WHEN COUNT(o) = 0 THEN NULL WHEN VAR_POP(o) * COUNT(o) = 0 THEN 0.0
  ELSE 1.0 - SUM((o - p) * (o - p)) / (VAR_POP(o) * COUNT(o)) END"""
KGE = """1.0 - sqrt(
  pow((CASE WHEN VAR_POP(o) > 0 THEN COVAR_POP(o, p) / nullif(STDDEV_POP(o) * STDDEV_POP(p), 0) ELSE 0.0 END) - 1, 2)
+ pow((CASE WHEN VAR_POP(o) > 0 THEN STDDEV_POP(p) / STDDEV_POP(o) ELSE 0.0 END) - 1, 2)
+ pow((CASE WHEN AVG(o) <> 0 THEN AVG(p) / AVG(o) ELSE 0.0 END) - 1, 2))"""
RMSE = "sqrt(AVG((o - p) * (o - p)))"
PBIAS = "CASE WHEN SUM(o) = 0 THEN 0.0 ELSE 100.0 * SUM(o - p) / SUM(o) END"
SUITE = f"""round({NSE}, 4) + 0.0 AS nse, round({KGE}, 4) + 0.0 AS kge, round({RMSE}, 4) + 0.0 AS rmse,
  round({PBIAS}, 4) + 0.0 AS pbias, round({NSE}, 4) + 0.0 AS r2"""
