"""Table, feature, model and metric sinks, and reading them back."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

# How Spark stores a vector in Parquet, read as plain columns.
STORED_VECTOR = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def write_table(df: DataFrame, path: str, *partition_by: str, mode: str = "error") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def export_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).csv(
        path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def append_metrics(rows: DataFrame, path: str, keys: dict[tuple[str, str], str] | None = None) -> None:
    """Metric rows, appended per experiment so that finished ones survive a later failure.

    ``keys`` names what each (experiment, model) was run on. The rows of a call, some tens for a pair, are one file an
    experiment, which is there as a whole or not at all.
    """
    if keys:
        known = [(*pair, key) for pair, key in keys.items()]
        named = rows.sparkSession.createDataFrame(known, "experiment string, model string, run_key string")
        rows = rows.join(F.broadcast(named), ["experiment", "model"], "left")
    rows.coalesce(1).write.mode("append").partitionBy("experiment").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "model string, slice string, metric string, value double, error string, run_key string, experiment string"
    ).json(path)


def feature_rows(spark: SparkSession, path: str, names: list[str], *keep: str) -> DataFrame:
    """``(keep..., feature, value)`` for the non-zero entries of a stored ``features`` column.

    The stored vector is read as a struct, so it is unpacked natively and stays sparse. The name table
    is bounded by the vocabulary.
    """
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema if f.name in keep]
    stored = spark.read.schema(", ".join([*kept, f"features {STORED_VECTOR}"])).parquet(path)
    named = spark.createDataFrame(list(enumerate(names)), "idx int, feature string")
    entries = F.arrays_zip(
        F.coalesce("features.indices", F.sequence(F.lit(0), F.size("features.values") - 1)).alias("idx"),
        F.col("features.values").alias("value"),
    )
    return (
        stored.select(*keep, F.inline_outer(entries).alias("idx", "value"))
        .where(F.col("value") != 0)
        .join(F.broadcast(named), "idx")
        .select(*keep, "feature", "value")
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
