"""Node files (SWC text) as one long DataFrame: a row for each node of each cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "cell_id string, seq int, id long, type int, x double, y double, z double, radius double, parent long"


def _number(token: Column, kind: str) -> Column:
    """A whole number written in any way that a float is; null where it is none."""
    value = token.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < 9.0e18), value.cast(kind))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Nodes from (cell_id, seq, line). Blank lines, comments and rows that are malformed are left out."""
    t = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    # exploded, as a plain column of tokens would be split anew by every expression that takes one of them
    rows = lines.filter(~F.trim("line").startswith("#")).select("cell_id", "seq", F.explode(F.array(t)).alias("t")).filter(F.size("t") >= 7)
    named = [_number(F.get("t", 0), "long").alias("id"), _number(F.get("t", 1), "int").alias("type")]
    named += [F.get("t", k).try_cast("double").alias(c) for k, c in enumerate(("x", "y", "z", "radius"), 2)]
    named.append(_number(F.get("t", 6), "long").alias("parent"))
    return rows.select("cell_id", "seq", *named).dropna()


def file_path() -> Column:
    """The path of the file that a row is from, with its characters as they are."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_swc(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Nodes of all files below a path, with cell_id (the file's path), cell_type (class folder) and their order in the file.

    Files are split into lines inside the tasks that read them; a file is one cell.
    """
    files = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.swc").text(path, wholetext=True)
    files = files.select(file_path().alias("cell_id"), "value")
    lines = files.select("cell_id", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("seq", "line"))
    return parse_lines(lines).withColumn("cell_type", class_folder(F.col("cell_id"))).withColumn("batch", batch_folder(F.col("cell_id")))


def class_folder(path: Column) -> Column:
    """The folder that names the class: the one above `swc`, or above the file."""
    return F.regexp_replace(F.lower(F.regexp_extract(path, r"([^/\\]+)[/\\](?:swc[/\\])?[^/\\]+$", 1)), "[- ]", "_")


def batch_folder(path: Column) -> Column:
    """The `batch_*` folder in a path, empty if there is none."""
    return F.regexp_extract(path, r"(?:^|[/\\])(batch_[^/\\]+)[/\\]", 1)


def batch_part(path: Column) -> Column:
    """Which part of a batch a file is in: `original`, `no_label`, or empty."""
    return F.regexp_extract(path, r"[/\\]batch_[^/\\]+[/\\](original|no_label)[/\\]", 1)


def type_sets(nodes: DataFrame) -> DataFrame:
    """Each cell's labels in order, and as text."""
    got = nodes.groupBy("cell_id").agg(F.sort_array(F.collect_set("type")).alias("types"))
    return got.withColumn("type_set", F.array_join("types", " "))


def render(nodes: DataFrame) -> DataFrame:
    """A line for each node: (cell_id, seq, line)."""
    cols = ("id", "type", "x", "y", "z", "radius", "parent")
    return nodes.select("cell_id", "seq", F.concat_ws(" ", *(F.col(c).cast("string") for c in cols)).alias("line"))


def write_swc(nodes: DataFrame, path: str) -> None:
    """Text files, a folder for each cell, lines in order."""
    lines = render(nodes).repartition("cell_id").sortWithinPartitions("cell_id", "seq")
    lines.select("cell_id", "line").write.partitionBy("cell_id").mode("overwrite").text(path)
