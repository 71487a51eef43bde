"""Saving and loading fitted parameters together with the model they belong to."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def save_params(folder: str, params: DataFrame, model: PipelineModel, info: dict | None = None) -> None:
    """Write the parameter table, the model and a short description below one folder."""
    params.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/params")
    model.write().save(f"{folder}/model")
    spark = params.sparkSession
    spark.createDataFrame([(json.dumps(info or {}),)], "info string").coalesce(1).write.json(f"{folder}/info")


def load_params(spark: SparkSession, folder: str) -> tuple[DataFrame, PipelineModel, dict]:
    """The saved pair; an error if the parameters or the model are missing."""
    try:
        params = spark.read.parquet(f"{folder}/params")
        info = json.loads(spark.read.json(f"{folder}/info").head()["info"])
    except AnalysisException as error:
        raise FileNotFoundError(f"{folder} has no complete set of fitted parameters") from error
    try:
        model = PipelineModel.load(f"{folder}/model")
    except Exception as error:
        raise FileNotFoundError(f"{folder} has parameters but no model") from error
    return params, model, info
