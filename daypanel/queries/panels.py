"""Sources, filters, joins and set operations on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from daypanel.functions import scalar as S
from daypanel.operators import fitted, order, panel as P
from daypanel.operators.features import FeatureConfig, engineer_features
from daypanel.operators.scores import extreme_flags
from daypanel.queries import shared as X
from daypanel.queries.registry import fragment, query, rounded, rounded_sql, with_
from daypanel.schema import BASIN, DATE, ENTITY, OBS, PRECIP, PRED, TARGET, TMAX, TMIN
from daypanel.session import fresh_path
from daypanel.sources import readers, state, writers

VALUES = [TARGET, PRECIP, TMAX, TMIN, "pet_mm"]


# --- sources and sinks -------------------------------------------------------------------------


@query(
    """
SELECT CAST(s_suppkey AS INTEGER) AS gauge_id, r_name AS basin, s_name AS site_name, s_acctbal AS area_km2,
       CAST(n_nationkey AS DOUBLE) + 8.5 AS latitude, CAST(s_suppkey AS VARCHAR) AS catchment_id
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
)
def read_attributes(spark, folder):
    supplier = X.table(spark, folder, "supplier")
    places = X.table(spark, folder, "nation").join(
        X.table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    joined = supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    root = fresh_path(spark, "attributes")
    names = joined.select(
        F.col("s_suppkey").alias("gauge_id"), F.col("r_name").alias("river_basin"), F.col("s_name").alias("site_name")
    )
    topo = joined.select(
        F.col("s_suppkey").alias("gauge_id"),
        F.lit("ignored").alias("site_name"),
        F.col("s_acctbal").alias("cwc_area"),
        (F.col("n_nationkey").cast("double") + 8.5).alias("cwc_lat"),
    )
    keyless = joined.select(F.col("s_name").alias("other"))
    for part, frame in (("1_name", names), ("2_note", keyless), ("3_topo", topo)):
        frame.write.option("header", True).csv(f"{root}/attr_{part}.csv")
    return readers.read_attributes(spark, readers.list_paths(spark, f"{root}/attr_*.csv"))


@query(
    """SELECT l_orderkey AS order_id, l_quantity AS precipitation_mm, l_discount AS temperature_max_c, l_tax AS "Kept As Is"
FROM lineitem"""
)
def canonical_columns(spark, folder):
    raw = X.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_quantity").alias(" PRCP(mm/day) "),
        F.col("l_discount").alias("tmax(C)"),
        F.col("l_tax").alias("Kept As Is"),
    )
    from daypanel.schema import FORCING_COLUMNS

    return P.canonical_columns(raw, FORCING_COLUMNS)


@query(
    """
SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS strict_id, CAST(c_custkey AS VARCHAR) AS float_id, c_name AS text_id,
       lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS file_id FROM customer"""
)
def normalize_id(spark, folder):
    key = F.col("c_custkey")
    return X.table(spark, folder, "customer").select(
        "c_custkey",
        S.normalize_id(F.lpad(key.cast("string"), 8, "0")).alias("strict_id"),
        S.normalize_id(F.concat(key.cast("string"), F.lit(".0")), lenient=True).alias("float_id"),
        S.normalize_id(F.col("c_name"), lenient=True).alias("text_id"),
        S.padded_id(key, 8).alias("file_id"),
    )


@query(
    with_(
        """SELECT CAST(catchment_id AS VARCHAR) AS catchment_id, date, precipitation_mm, temperature_max_c,
       temperature_min_c, pet_mm FROM obs""",
        "obs",
    )
)
def read_entity_series(spark, folder):
    return readers.read_entity_series(spark, _series_files(spark, folder), id_pattern=r"station=0*(\d+)/")


def _series_files(spark, folder):
    raw = X.observed(spark, folder).select(
        S.padded_id(F.col(ENTITY)).alias("station"),
        F.year(DATE).alias("year"),
        F.month(DATE).alias("month"),
        F.dayofmonth(DATE).alias("day"),
        F.col(PRECIP).alias("prcp(mm/day)"),
        F.col(TMAX).alias("tmax(C)"),
        F.col(TMIN).alias("tmin(C)"),
        F.col("pet_mm").alias("pet_gleam(mm/day)"),
        F.col(TARGET).alias("not_mapped"),
    )
    path = fresh_path(spark, "forcings")
    raw.repartition("station").write.partitionBy("station").option("header", True).csv(path)
    return path


@query(
    with_(
        """SELECT CAST(catchment_id AS VARCHAR) AS catchment_id, date, precipitation_mm,
       CASE WHEN catchment_id % 3 <> 0 THEN temperature_max_c END AS temperature_max_c, CASE WHEN catchment_id % 3 = 0 THEN pet_mm END AS pet_mm FROM obs""",
        "obs",
    )
)
def read_entity_series_of_two_forms(spark, folder):
    seen = X.observed(spark, folder).withColumns(
        {"station": S.padded_id(F.col(ENTITY)), "year": F.year(DATE), "month": F.month(DATE), "day": F.dayofmonth(DATE)}
    )
    path = fresh_path(spark, "forcings")
    third = F.col(ENTITY) % 3 == 0
    first = seen.where(~third).select("station", "year", "month", "day", F.col(PRECIP).alias("prcp(mm/day)"), F.col(TMAX).alias("tmax(C)"))
    second = seen.where(third).select("station", F.col("pet_mm").alias("pet_gleam(mm/day)"), F.col(PRECIP).alias("PRCP(mm/day)"), "day", "month", "year")
    for form in (first, second):
        form.repartition("station").write.mode("append").partitionBy("station").option("header", True).csv(path)
    return readers.read_entity_series(spark, path, id_pattern=r"station=0*(\d+)/")


@query(
    with_(
        """SELECT CAST(o.catchment_id AS VARCHAR) AS catchment_id, date, basin,
  round(CASE WHEN area_km2 > 0 THEN streamflow_mm_day * 86400.0 / (area_km2 * 1e6) * 1000.0 END, 6) + 0.0 AS streamflow_mm_day,
  round(precipitation_mm, 6) + 0.0 AS precipitation_mm, round(pet_mm, 6) + 0.0 AS pet_mm, round(area_km2, 6) + 0.0 AS area_km2
FROM obs o JOIN attrs a ON a.catchment_id = o.catchment_id""",
        "obs",
        "attrs",
    )
)
def read_panel(spark, folder):
    root = fresh_path(spark, "files")
    static = X.attributes(spark, folder)
    static.select(F.col(ENTITY).alias("gauge_id"), F.col("area_km2").alias("cwc_area"), F.col(BASIN).alias("river_basin")).coalesce(1).write.option(
        "header", True
    ).csv(f"{root}/topo.csv")
    seen = X.observed(spark, folder)
    ids = [r[0] for r in X.table(spark, folder, "supplier").select("s_suppkey").distinct().orderBy("s_suppkey").collect()]  # the columns of a wide file
    _write_wide(spark, seen, [i for i in ids if i is not None], f"{root}/observed.csv")
    panel = readers.read_panel(spark, [f"{root}/topo.csv"], _series_files(spark, folder), f"{root}/observed.csv", r"station=0*(\d+)/")
    return rounded(panel.select(ENTITY, DATE, BASIN, TARGET, PRECIP, "pet_mm", "area_km2"))


def _write_wide(spark, seen, ids, path):
    """A wide file: a line a day with a cell for each id, put together from the filled cells of the day."""
    places = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], f"{ENTITY} {dict(seen.dtypes)[ENTITY]}, place int")
    cell = F.struct("place", F.coalesce(F.col(TARGET).cast("string"), F.lit("")).alias("text"))
    days = seen.where(F.col(DATE).isNotNull()).join(places, ENTITY).groupBy(DATE).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    before = F.concat(F.array(F.lit(-1)), F.transform(F.slice("cells", F.lit(1), F.size("cells") - 1), lambda x: x["place"]))
    filled = F.array_join(F.zip_with("cells", before, lambda x, b: F.concat(F.repeat(F.lit(","), x["place"] - b), x["text"])), "")
    rest = F.repeat(F.lit(","), F.lit(len(ids) - 1) - F.element_at("cells", -1)["place"])
    line = F.concat(F.concat_ws(",", F.year(DATE), F.month(DATE), F.dayofmonth(DATE)), filled, rest)
    header = ",".join(["year", "month", "day", *map(str, ids)])
    # One column whose name is the header line, so that every file begins with it.
    days.select(line.alias(header)).write.option("header", True).option("sep", "\u0001").csv(path)


_REGION_DAY = """
SELECT n_regionkey AS k, CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS q
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2"""


def _wide(spark, folder):
    """One column per region and one row per day: a wide observation table."""
    located = (
        X.table(spark, folder, "lineitem")
        .join(X.table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(X.table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    regions = _region_ids(spark, folder)
    return located.groupBy(F.col("l_shipdate").cast("date").alias(DATE)).agg(
        *[F.sum(F.when(F.col("n_regionkey") == k, F.col("l_quantity"))).alias(f"000{k}") for k in regions]
    )


def _region_ids(spark, folder):
    return [r[0] for r in X.table(spark, folder, "region").select("r_regionkey").distinct().orderBy("r_regionkey").collect()]


_WIDE_LONG = f"""
SELECT days.date, CAST(r_regionkey AS VARCHAR) AS catchment_id, q.q AS flow
FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) days JOIN region ON true
LEFT JOIN ({_REGION_DAY}) q ON q.date = days.date AND q.k = r_regionkey"""


@query(_WIDE_LONG)
def wide_to_long(spark, folder):
    return P.wide_to_long(_wide(spark, folder), [DATE], "flow")


@query(
    f"""SELECT catchment_id, date, round(flow * 86400.0 / ((CAST(catchment_id AS INTEGER) + 1) * 100.0 * 1e6) * 1000.0, 6) + 0.0 AS baseline_mm_day
FROM ({_WIDE_LONG}) WHERE catchment_id <> '4'"""
)
def read_predictions(spark, folder):
    wide = _wide(spark, folder).select(
        F.year(DATE).alias("year"),
        F.month(DATE).alias("month"),
        F.dayofmonth(DATE).alias("day"),
        *[f"000{k}" for k in _region_ids(spark, folder)],
    )
    path = fresh_path(spark, "predictions")
    wide.write.option("header", True).csv(path)
    areas = X.table(spark, folder, "region").select(
        F.col("r_regionkey").cast("string").alias(ENTITY),
        F.when(F.col("r_regionkey") < 4, (F.col("r_regionkey") + 1) * 100.0).alias("area_km2"),
    )
    return rounded(readers.read_predictions(spark, path, areas))


@query(
    with_(
        "SELECT date, catchment_id, round(greatest(y_pred - 20.0, 0.0), 4) + 0.0 AS predicted_streamflow_mm_day FROM preds WHERE y_pred IS NOT NULL",
        "preds",
    )
)
def write_predictions(spark, folder):
    shifted = X.predictions(spark, folder).where(F.col(PRED).isNotNull()).withColumn("p", F.col(PRED) - 20.0)
    path = fresh_path(spark, "written")
    writers.write_predictions(shifted, path, "p")
    schema = f"{DATE} date, {ENTITY} bigint, predicted_streamflow_mm_day double"
    return spark.read.option("header", True).schema(schema).csv(path)


@query(
    with_(
        """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || CAST(longitude AS VARCHAR) || ','
  || CAST(latitude AS VARCHAR) || ']},"properties":{"catchment_id":' || CAST(catchment_id AS VARCHAR)
  || ',"basin":"' || basin || '"}}' AS value FROM attrs""",
        "attrs",
    )
)
def to_geojson_lines(spark, folder):
    return writers.to_geojson_lines(X.attributes(spark, folder).select(ENTITY, BASIN, "latitude", "longitude"))


@query(
    with_(
        f"""SELECT section, "group", metric, value FROM (
  SELECT 'per_catchment' AS section, CAST(catchment_id AS VARCHAR) AS "group", 'n_samples' AS metric, CAST(COUNT(*) AS VARCHAR) AS value
  FROM scored GROUP BY catchment_id
  UNION ALL
  SELECT 'per_catchment', CAST(catchment_id AS VARCHAR), 'max_obs', CAST(CAST(MAX(y_true) AS BIGINT) AS VARCHAR)
  FROM scored GROUP BY catchment_id)""",
        "scored",
    )
)
def write_report(spark, folder):
    from daypanel.operators.scores import scored

    stats = scored(X.predictions(spark, folder)).groupBy(ENTITY).agg(
        F.count(F.lit(1)).alias("n_samples"), F.max(OBS).cast("bigint").alias("max_obs")
    )
    path = fresh_path(spark, "report")
    writers.write_report(writers.report_rows(stats, "per_catchment", [ENTITY]), path)
    return spark.read.schema("section string, `group` string, metric string, value string").json(path)


# --- projections and filters -------------------------------------------------------------------


@query(
    rounded_sql(
        "SELECT catchment_id, date, streamflow_mm_day * 86400.0 / (area_km2 * 1e6) * 1000.0 AS depth FROM obs JOIN attrs USING (catchment_id) WHERE area_km2 > 0",
        "catchment_id date",
        "depth",
        "obs",
        "attrs",
    )
)
def rate_to_depth(spark, folder):
    depth = P.target_depth(X.observed(spark, folder), X.attributes(spark, folder), TARGET, "depth")
    return rounded(depth.select(ENTITY, DATE, "depth"))


@query(
    """
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day,
  CASE WHEN CAST(l_quantity AS INTEGER) BETWEEN 1 AND 31 AND l_linenumber * 2 <= 12
       THEN TRY_CAST('2001-' || lpad(CAST(l_linenumber * 2 AS VARCHAR), 2, '0') || '-' || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 2, '0') AS DATE) END AS odd_day
FROM lineitem"""
)
def date_from_parts(spark, folder):
    day = F.col("l_shipdate").cast("date")
    return X.table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        S.date_from_parts(F.year(day), F.month(day), F.dayofmonth(day)).alias("day"),
        S.date_from_parts(F.lit(2001), F.col("l_linenumber") * 2, F.col("l_quantity").cast("int")).alias("odd_day"),
    )


@query(with_("SELECT * FROM attrs WHERE lower(basin) IN ('asia', 'region_1', 'region_3', 'europe')", "attrs"))
def filter_groups_ci(spark, folder):
    return P.filter_groups_ci(X.attributes(spark, folder), ["Asia", "region_1", "REGION_3", "eUrope"])


@query(
    with_(
        """SELECT catchment_id, date, streamflow_mm_day FROM activity WHERE catchment_id IN (
  SELECT catchment_id FROM activity WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28'
  GROUP BY 1 HAVING COUNT(streamflow_mm_day) >= 24)""",
        "activity",
    )
)
def filter_min_history(spark, folder):
    return P.filter_min_history(X.activity(spark, folder), 24, "2024-01-03", "2024-01-28")


@query(with_("SELECT catchment_id, date, streamflow_mm_day - 10.0 AS streamflow_mm_day FROM panel WHERE streamflow_mm_day - 10.0 >= 0", "panel"))
def drop_invalid_target(spark, folder):
    shifted = X.panel(spark, folder).select(ENTITY, DATE, (F.col(TARGET) - 10.0).alias(TARGET))
    return P.drop_invalid_target(shifted)


@query(
    with_(
        """SELECT catchment_id, date, streamflow_mm_day, 'train' AS split FROM obs WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
UNION ALL SELECT catchment_id, date, streamflow_mm_day, 'test' FROM obs WHERE date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31'""",
        "obs",
    )
)
def temporal_split(spark, folder):
    rows = X.observed(spark, folder).select(ENTITY, DATE, TARGET)
    train, test = P.temporal_split(rows, X.TRAIN_END, X.TEST_START, "1996-01-01", "2000-12-31")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


_RANKED = """SELECT *, row_number() OVER (ORDER BY date, md5(CAST(catchment_id AS VARCHAR)), catchment_id) - 1 AS rank0,
  COUNT(*) OVER () AS n_rows FROM (SELECT catchment_id, date, streamflow_mm_day FROM obs)"""


def _plain(spark, folder):
    return X.observed(spark, folder).select(ENTITY, DATE, TARGET)


@query(with_(f"SELECT * FROM ({_RANKED})", "obs"))
def global_rank(spark, folder):
    return order.global_rank(_plain(spark, folder))


@query(
    with_(
        f"SELECT catchment_id, date, streamflow_mm_day, CASE WHEN rank0 < floor(n_rows * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM ({_RANKED})",
        "obs",
    )
)
def fraction_split(spark, folder):
    return order.fraction_split(_plain(spark, folder), 0.8)


@query(
    with_(
        f"""SELECT r.catchment_id, r.date, r.streamflow_mm_day FROM ({_RANKED}) r
WHERE r.rank0 IN (SELECT CASE WHEN i = 999 THEN n - 1 ELSE CAST(floor(i * ((n - 1)::DOUBLE / 999.0::DOUBLE)) AS BIGINT) END
  FROM (SELECT COUNT(*) AS n FROM obs) JOIN (SELECT unnest(generate_series(0, 999)) AS i) ON true)""",
        "obs",
    )
)
def stride_sample(spark, folder):
    return order.stride_sample(_plain(spark, folder), 1000)


@query(
    rounded_sql(
        """SELECT catchment_id, date, sin(2 * pi() * dayofyear(date) / 365.25::DOUBLE) AS day_sin, cos(2 * pi() * dayofyear(date) / 365.25::DOUBLE) AS day_cos,
  sin(2 * pi() * month(date) / 12) AS month_sin, cos(2 * pi() * month(date) / 12) AS month_cos FROM obs""",
        "catchment_id date",
        "day_sin day_cos month_sin month_cos",
        "obs",
    )
)
def seasonal_cyclical(spark, folder):
    return rounded(X.observed(spark, folder).select(ENTITY, DATE, *S.seasonal_cyclical(F.col(DATE))))


@query(with_("SELECT catchment_id, date, CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(month(date) AS INTEGER) AS month FROM obs", "obs"))
def seasonal_raw(spark, folder):
    return X.observed(spark, folder).select(ENTITY, DATE, *S.seasonal_raw(F.col(DATE)))


@query(
    with_(
        """SELECT catchment_id, date, CAST(month(date) IN (6,7,8,9) AS INTEGER) AS is_monsoon, CAST(month(date) IN (3,4,5) AS INTEGER) AS is_pre_monsoon,
  CAST(month(date) IN (10,11) AS INTEGER) AS is_post_monsoon, CAST(month(date) IN (12,1,2) AS INTEGER) AS is_winter FROM obs""",
        "obs",
    )
)
def season_flags(spark, folder):
    return X.observed(spark, folder).select(ENTITY, DATE, *S.season_flags(F.col(DATE)))


@query(
    with_(
        "SELECT catchment_id, date, temperature_max_c - temperature_min_c AS temperature_range_c, (temperature_max_c + temperature_min_c) / 2.0 AS temperature_mean_c FROM panel",
        "panel",
    )
)
def temp_features(spark, folder):
    return X.panel(spark, folder).select(ENTITY, DATE, *S.temp_features(F.col(TMAX), F.col(TMIN)))


@query(
    rounded_sql(
        "SELECT catchment_id, date, precipitation_mm / (pet_mm + 0.01::DOUBLE) AS precip_pet_ratio, precipitation_mm - pet_mm AS water_balance_mm FROM panel",
        "catchment_id date",
        "precip_pet_ratio water_balance_mm",
        "panel",
    )
)
def water_balance(spark, folder):
    return rounded(X.panel(spark, folder).select(ENTITY, DATE, *S.water_balance(F.col(PRECIP), F.col("pet_mm"))))


@query(
    with_(
        """SELECT catchment_id, date, CASE WHEN precipitation_mm > 0 THEN precipitation_mm ELSE 0.0 END AS precip_intensity,
  CASE WHEN precipitation_mm > 1.0 THEN 1 ELSE 0 END AS is_rainy_day FROM panel""",
        "panel",
    )
)
def rain_features(spark, folder):
    return X.panel(spark, folder).select(ENTITY, DATE, *S.rain_features(F.col(PRECIP)))


@query(with_("SELECT catchment_id, date, CASE WHEN y_pred IS NOT NULL THEN greatest(y_pred - 20.0, 0.0) END AS clamped FROM preds", "preds"))
def clamp_nonnegative(spark, folder):
    return X.predictions(spark, folder).select(ENTITY, DATE, S.clamp_nonnegative(F.col(PRED) - 20.0).alias("clamped"))


_INPUTS = (PRECIP, TMAX, TMIN, "pet_mm", "area_km2")


@query(
    rounded_sql(
        " UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS feature, COUNT({c}) AS known, SUM({c}) AS total FROM panel" for i, c in enumerate(_INPUTS)),
        "place feature known",
        "total",
        "panel",
        digits=2,
    )
)
def select_features(spark, folder):
    joined = X.panel(spark, folder).select(ENTITY, DATE, BASIN, *VALUES, "area_km2", "latitude", "longitude", "pos")
    from daypanel.operators import features

    names = features.select_features(joined)
    cells = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("feature"), F.count(c).alias("known"), F.sum(c).alias("total")) for i, c in enumerate(names)]
    return rounded(joined.agg(F.array(*cells).alias("cells")).select(F.inline("cells")), 2)


@query(
    with_(
        """SELECT "column", rows, known, varies FROM (
  SELECT 'empty' AS "column", COUNT(*) AS rows, CAST(0 AS BIGINT) AS known, false AS varies FROM panel
  UNION ALL SELECT 'flat', COUNT(*), COUNT(*), false FROM panel
  UNION ALL SELECT 'streamflow_mm_day', COUNT(*), COUNT(streamflow_mm_day), min(streamflow_mm_day) < max(streamflow_mm_day) FROM panel
  UNION ALL SELECT 'precipitation_mm', COUNT(*), COUNT(precipitation_mm), min(precipitation_mm) < max(precipitation_mm) FROM panel)""",
        "panel",
    )
)
def column_profile(spark, folder):
    marked = X.panel(spark, folder).select(
        TARGET, PRECIP, F.lit(None).cast("double").alias("empty"), F.lit(7.0).alias("flat")
    )
    return fitted.column_profile(marked, marked.columns)


@query(with_("SELECT catchment_id, date, streamflow_mm_day, precipitation_mm FROM panel", "panel"))
def prune_constant_columns(spark, folder):
    marked = X.panel(spark, folder).select(
        ENTITY, DATE, TARGET, PRECIP, F.lit(None).cast("double").alias("empty"), F.lit(7.0).alias("flat")
    )
    return fitted.prune_constant_columns(marked, fitted.fit_pruning(marked))


@query(with_("SELECT catchment_id, date, area_km2 FROM panel", "panel"))
def drop_sparse_columns(spark, folder):
    marked = X.panel(spark, folder).select(ENTITY, DATE, "area_km2", TARGET, PRECIP)
    train = marked.where(F.col(DATE) <= F.lit(X.TRAIN_END).cast("date"))
    return fitted.drop_sparse_columns(marked, fitted.fit_sparse(train, 0.3))


@query(with_("SELECT catchment_id, date, precipitation_mm, 0.0::DOUBLE AS wind_speed_ms, temperature_max_c FROM obs", "obs"))
def apply_feature_schema(spark, folder):
    return fitted.apply_feature_schema(
        X.observed(spark, folder), [PRECIP, "wind_speed_ms", TMAX], keep=[ENTITY, DATE]
    )


@query(with_("SELECT catchment_id, date, streamflow_mm_day FROM obs WHERE date >= DATE '2000-06-01'", "obs"))
def date_floor_filter(spark, folder):
    return P.date_floor_filter(_plain(spark, folder), "2000-06-01")


@query(
    with_(
        """SELECT catchment_id, date, y_true, hi AS high_threshold, lo AS low_threshold,
  CAST(y_true >= hi AS INTEGER) AS is_flood, CAST(y_true <= lo AS INTEGER) AS is_drought
FROM scored JOIN (SELECT quantile_cont(y_true, 0.95) AS hi, quantile_cont(y_true, 0.05) AS lo FROM scored) ON true""",
        "scored",
    )
)
def extreme_flags_pooled(spark, folder):
    from daypanel.operators.scores import scored

    return extreme_flags(scored(X.predictions(spark, folder)).select(ENTITY, DATE, OBS))


@query(
    with_(
        """SELECT s.catchment_id, date, y_true, hi AS high_threshold, lo AS low_threshold,
  CAST(y_true >= hi AS INTEGER) AS is_flood, CAST(y_true <= lo AS INTEGER) AS is_drought
FROM scored s JOIN (SELECT catchment_id, quantile_cont(y_true, 0.95) AS hi, quantile_cont(y_true, 0.05) AS lo FROM scored GROUP BY 1) t
  ON s.catchment_id = t.catchment_id""",
        "scored",
    ),
    name="extreme_flags",
)
def extreme_flags_by_entity(spark, folder):
    from daypanel.operators.scores import scored

    return extreme_flags(scored(X.predictions(spark, folder)).select(ENTITY, DATE, OBS), by=[ENTITY])


# --- joins and sets ----------------------------------------------------------------------------


@query(with_("SELECT s.catchment_id, s.date, s.pos, o.streamflow_mm_day FROM spine s JOIN obs o ON s.catchment_id = o.catchment_id AND s.date = o.date", "spine", "obs"))
def join_target(spark, folder):
    spine = P.densify(X.attributes(spark, folder), *X.calendar(spark, folder)).select(ENTITY, DATE, "pos")
    return P.join_target(spine, X.observed(spark, folder).select(ENTITY, DATE, TARGET))


@query(with_("SELECT o.catchment_id, date, streamflow_mm_day, area_km2, basin, latitude, longitude FROM obs o JOIN attrs a ON o.catchment_id = a.catchment_id", "obs", "attrs"))
def attach_static(spark, folder):
    return P.attach_static(_plain(spark, folder), X.attributes(spark, folder), ["area_km2", "not_there"])


@query(
    """SELECT coalesce(s_nationkey, c_nationkey) AS nation, suppliers, balance, customers FROM
(SELECT s_nationkey, COUNT(*) AS suppliers, round(AVG(s_acctbal), 4) AS balance FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
FULL JOIN (SELECT c_nationkey, COUNT(*) AS customers FROM customer WHERE c_nationkey >= 5 GROUP BY 1) ON s_nationkey = c_nationkey"""
)
def outer_merge_dims(spark, folder):
    left = (
        X.table(spark, folder, "supplier")
        .where("s_acctbal > 5000")
        .groupBy(F.col("s_nationkey").alias("nation"))
        .agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.avg("s_acctbal"), 4).alias("balance"))
    )
    right = (
        X.table(spark, folder, "customer")
        .where("c_nationkey >= 5")
        .groupBy(F.col("c_nationkey").alias("nation"))
        .agg(F.count(F.lit(1)).alias("customers"), F.max("c_acctbal").alias("balance"))
    )
    return P.outer_merge_dims(left, right, "nation")


@query(
    with_(
        """SELECT catchment_id, date, y_true, y_pred, clim FROM preds
WHERE date BETWEEN DATE '1999-03-01' AND DATE '2001-06-30' AND y_true IS NOT NULL AND y_pred IS NOT NULL AND clim IS NOT NULL""",
        "preds",
    )
)
def join_predictions(spark, folder):
    p = X.predictions(spark, folder)
    joined = P.join_predictions(p.select(ENTITY, DATE, OBS, PRED), p.select(ENTITY, DATE, "clim"), "clim", "1999-03-01", "2001-06-30")
    return joined


@query(
    """SELECT "column", overlap, CAST(place AS INTEGER) AS place, CAST(greatest(1, (SELECT COUNT(*) // 2 FROM supplier)) AS BIGINT) AS needed FROM (
  SELECT 'l_linenumber' AS "column", COUNT(DISTINCT l_linenumber) AS overlap, 0 AS place FROM lineitem WHERE l_linenumber IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT 'l_suppkey', COUNT(DISTINCT l_suppkey), 1 FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT 'l_partkey', COUNT(DISTINCT l_partkey), 2 FROM lineitem WHERE l_partkey IN (SELECT s_suppkey FROM supplier)) WHERE overlap > 0"""
)
def join_key_overlap(spark, folder):
    ids = X.table(spark, folder, "supplier").select(F.col("s_suppkey").alias(ENTITY))
    lines = X.table(spark, folder, "lineitem").select("l_linenumber", "l_suppkey", "l_partkey")
    return P.join_key_overlap(lines, ids)


@query(
    """SELECT l_returnflag, l_suppkey, l_quantity, CAST(l_suppkey AS VARCHAR) AS catchment_id, s_acctbal
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""
)
def detect_join_key(spark, folder):
    ids = X.table(spark, folder, "supplier").select(F.col("s_suppkey").alias(ENTITY), "s_acctbal")
    lines = X.table(spark, folder, "lineitem").select("l_returnflag", "l_suppkey", "l_quantity")
    return P.join_on_detected_key(lines, ids)


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS catchment_id FROM supplier
WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') AND s_suppkey IN (SELECT user_id FROM events)"""
)
def entity_intersection(spark, folder):
    return P.entity_intersection(
        X.table(spark, folder, "supplier").select(F.col("s_suppkey").alias(ENTITY)),
        X.table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias(ENTITY)),
        X.table(spark, folder, "events").select(F.col("user_id").alias(ENTITY)),
    )


@query(
    with_(
        """SELECT catchment_id, date, streamflow_mm_day, precipitation_mm FROM obs
UNION ALL SELECT catchment_id, date, streamflow_mm_day, CAST(NULL AS DOUBLE) FROM activity""",
        "obs",
        "activity",
    )
)
def stack_entities(spark, folder):
    first = X.observed(spark, folder).select(ENTITY, DATE, TARGET, PRECIP)
    return P.stack_entities([first, X.activity(spark, folder)])


# --- fitted state on disk ----------------------------------------------------------------------


fragment(
    "rain_line",
    f"SELECT regr_slope(streamflow_mm_day, precipitation_mm) AS b, regr_intercept(streamflow_mm_day, precipitation_mm) AS a FROM obs WHERE date <= DATE '{X.TRAIN_END}'",
    "obs",
)


@query(
    with_(
        f"SELECT catchment_id, date, round(a + b * precipitation_mm, 4) + 0.0 AS prediction, 1::BIGINT AS n_params FROM obs JOIN rain_line ON true WHERE date >= DATE '{X.TEST_START}'",
        "obs",
        "rain_line",
    )
)
def save_params(spark, folder):
    """A least-squares line saved with its fitted parameters, loaded and applied."""
    rows = X.observed(spark, folder).select(ENTITY, DATE, TARGET, PRECIP)
    return _saved_and_loaded(spark, fitted.preprocess(rows, X.TRAIN_END, X.TEST_START))


@query()
def save_params_of_features(spark, folder):
    return _saved_and_loaded(spark, _ready(spark, folder))


def _saved_and_loaded(spark, ready):
    from daypanel.modelling.search import FAMILIES, model_stages

    model = model_stages(FAMILIES["linear"]({}), ready.features).fit(ready.train)
    path = fresh_path(spark, "model")
    state.save_params(path, ready.params, model, {"model": "linear"})
    params, loaded, _ = state.load_params(spark, path)
    scored = loaded.transform(ready.test).select(ENTITY, DATE, F.round("prediction", 4).alias("prediction"))
    return order.attach(scored, params.agg(F.count(F.lit(1)).alias("n_params")))


MODEL_FEATURES = FeatureConfig(
    lags=(1, 7), windows=(7, 30), stats=("mean", "std"), covariates=(PRECIP,), covariate_lags=(1,), sum_windows=(7, 30), include_current=False
)


#: What the registered models do not learn from.
UNUSED = (PRECIP, "precip_intensity", "is_rainy_day")


def _held(spark, folder):
    """What the features of the registered models are made of."""
    return X.held(spark, folder, BASIN, "area_km2", TARGET, PRECIP)


def _ready(spark, folder, held=None):
    """Leak-free features of the panel, split, filled and scaled."""
    return fitted.preprocess_held(held or _held(spark, folder), MODEL_FEATURES, X.TRAIN_END, X.TEST_START, UNUSED)
