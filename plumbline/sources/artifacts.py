"""Models on disk: written once with their settings, read only when their files are those that were recorded."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .tables import write_new


def folder_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the relative names and SHA-256 of all files below a folder, in order of their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", F.concat(F.lit("/"), F.element_at(F.split(F.lit(path.rstrip("/")), "/"), -1), F.lit("/"))), -1)
    each = files.select(F.concat_ws(" ", name, F.sha2("content", 256)).alias("line"))
    return each.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n").cast("binary"), 256)).collect()[0][0]  # a line for each file of a model


def save_model(model: PipelineModel, path: str, settings: dict) -> str:
    """Write a fitted pipeline and its settings where nothing is yet; returns the digest of the model's files."""
    spark = SparkSession.active()
    model.save(f"{path}/model")
    digest = folder_digest(spark, f"{path}/model")
    row = spark.createDataFrame([(json.dumps(settings, sort_keys=True), digest)], "settings string, digest string")
    write_new(row.coalesce(1), f"{path}/record", "json")
    return digest


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """(model, settings); ValueError if the files aren't those that the record names."""
    row = spark.read.schema("settings string, digest string").json(f"{path}/record").collect()[0]
    if folder_digest(spark, f"{path}/model") != row["digest"]:
        raise ValueError(f"the files of {path} differ from its record")
    return PipelineModel.load(f"{path}/model"), json.loads(row["settings"])
