import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from daypanel import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series_of(spark):
    """A panel ``(catchment_id, date, name)`` from lists of values, one entity per list."""

    def make(name, *lists):
        rows = [
            (f"{e}", i, None if v is None else float(v)) for e, values in enumerate(lists) for i, v in enumerate(values)
        ]
        df = spark.createDataFrame(rows, f"catchment_id string, i int, `{name}` double")
        return df.selectExpr("catchment_id", "date_add(DATE'2000-01-01', i) AS date", f"`{name}`")

    return make


@pytest.fixture(scope="session")
def pairs(spark):
    """Predictions ``(catchment_id, date, y_true, y_pred)`` of one entity."""

    def make(obs, pred, entity="a"):
        rows = [(entity, i, float(o), None if p is None else float(p)) for i, (o, p) in enumerate(zip(obs, pred, strict=True))]
        df = spark.createDataFrame(rows, "catchment_id string, i int, y_true double, y_pred double")
        return df.selectExpr("catchment_id", "date_add(DATE'2000-01-01', i) AS date", "y_true", "y_pred")

    return make


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*(order or ("catchment_id", "date"))).collect()]
