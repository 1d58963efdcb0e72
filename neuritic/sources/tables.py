"""Manifests, score tables and reports: sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as text."""
    return spark.read.option("header", True).csv(path)


def read_scores(df: DataFrame) -> DataFrame:
    """file_name, f1 from a score table whose columns may have either of two names; rows without a number go."""
    score = next(c for c in ("neurite_macro_f1_stage23", "neurite_macro_f1", "f1") if c in df.columns)
    path = next(c for c in ("path", "file", "file_name") if c in df.columns)
    name = F.element_at(F.split(F.col(path), r"[/\\]"), -1)
    return df.select(name.alias("file_name"), F.col(score).cast("string").try_cast("double").alias("f1")).dropna()


def read_long_scores(df: DataFrame, order: Column) -> DataFrame:
    """method, file_name, f1 from a long table; an empty score is 0, the last of several rows in this order counts, of rows at
    one place the larger score."""
    name = F.element_at(F.split("path", r"[/\\]"), -1)
    rows = df.select("method", name.alias("file_name"), F.coalesce(F.col("neurite_macro_f1").cast("string").try_cast("double"), F.lit(0.0)).alias("f1"), order.alias("n"))
    return rows.groupBy("method", "file_name").agg(F.max_by("f1", F.struct("n", "f1")).alias("f1"))


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """The overall metrics of a result file: the first of its usual blocks that is there."""
    return overall_block(spark.read.option("multiLine", True).json(path))


def overall_block(df: DataFrame, *keep: str) -> DataFrame:
    """overall: as JSON the first that a row has of the usual blocks; {} if it has none; and the columns to keep."""
    blocks = [F.to_json(c) for c in ("overall_stage23", "overall_metrics", "overall") if c in df.columns]
    return df.select(*keep, F.coalesce(*blocks, F.lit("{}")).alias("overall"))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """cell_type, file_name of the test files in a split file."""
    return split_files(spark.read.schema("seed long, test_size double, data_dir string, test_files map<string,array<string>>").option("multiLine", True).json(path))


def split_files(df: DataFrame) -> DataFrame:
    """cell_type, file_name of the test files in rows of test_files, a map from type to paths."""
    rows = df.select(F.explode("test_files").alias("cell_type", "paths")).select("cell_type", F.explode("paths").alias("path"))
    return rows.select("cell_type", F.element_at(F.split("path", r"[/\\]"), -1).alias("file_name"))


def union_manifests(parts: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns, in the order in which they first come up."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def upsert(old: DataFrame, new: DataFrame, key: str = "file_name") -> DataFrame:
    """Old and new rows merged by key; new ones win."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    # rows that share the key in one table: the one with the smallest hash of all its columns
    first = Window.partitionBy(key).orderBy(F.desc("_new"), F.xxhash64(*both.columns))
    return both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_new")


def stale(outputs: DataFrame, inputs: DataFrame, key: str = "file_name") -> DataFrame:
    """Outputs without an input."""
    return outputs.join(inputs.select(key).distinct(), key, "left_anti")


def write_table(df: DataFrame, path: str, order: list | None = None) -> None:
    """A CSV report with a header, also when there are no rows; sorted if an order is given."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
