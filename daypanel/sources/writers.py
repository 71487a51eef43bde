"""Writing predictions, point features and reports. All of them are ordinary distributed writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.functions.scalar import clamp_nonnegative
from daypanel.schema import DATE, ENTITY


def prediction_rows(df: DataFrame, prediction: str, name: str = "predicted_streamflow_mm_day") -> DataFrame:
    """``(date, entity, prediction)`` at or above zero, rounded for output."""
    return df.select(DATE, ENTITY, F.round(clamp_nonnegative(F.col(prediction)), 4).alias(name))


def write_predictions(df: DataFrame, path: str, prediction: str) -> None:
    prediction_rows(df, prediction).write.mode("errorifexists").option("header", True).csv(path)


def point_feature(lat: str, lon: str, properties: Sequence[str]) -> Column:
    """A GeoJSON point feature as text: longitude first, NULL properties written as null."""
    geometry = F.struct(
        F.lit("Point").alias("type"),
        F.array(F.col(lon).cast("double"), F.col(lat).cast("double")).alias("coordinates"),
    )
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return F.to_json(feature, {"ignoreNullFields": "false"})


def to_geojson_lines(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """One feature per row; every other column becomes a property."""
    return df.select(point_feature(lat, lon, [c for c in df.columns if c not in (lat, lon)]).alias("value"))


def write_geojson(df: DataFrame, path: str, lat: str = "latitude", lon: str = "longitude") -> None:
    """Newline-delimited features, one file per task."""
    to_geojson_lines(df, lat, lon).write.mode("errorifexists").text(path)


def report_rows(df: DataFrame, section: str, keys: Sequence[str] = ()) -> DataFrame:
    """A result table as long rows ``(section, group, metric, value)``, values as text."""
    names = [c for c in df.columns if c not in keys]
    group = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("all")
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in names])
    return df.select(F.lit(section).alias("section"), group.alias("group"), F.explode(cells).alias("c")).select(
        "section", "group", "c.*"
    )


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
