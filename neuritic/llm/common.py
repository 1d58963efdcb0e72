"""Small helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_stored, shared_dir

__all__ = ["WORD", "Query", "arrow_batches", "crc_mod", "dense", "drop_stored", "finite", "numbered", "pick", "shared_dir", "stored", "table", "text_size", "together"]

#: Rows of a batch between Spark and Python.
ARROW_ROWS = 250
#: The white space that separates words, `[\x20\x09-\x0D]`.
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns of these exact names; others, even such that differ in case alone, are left out.

    A name that is missing becomes a null string column.
    """
    cols = df.columns
    plain = df.toDF(*(f"_c{i}" for i in range(len(cols))))
    return plain.select(
        *(F.col(f"_c{cols.index(n)}").alias(n) if n in cols else F.lit(None).cast("string").alias(n) for n in names)
    )


def numbered(df: DataFrame) -> DataFrame:
    """The frame with columns _d0, _d1 ..., so that no name of its own can clash; toDF(*names) undoes it."""
    return df.toDF(*(f"_d{i}" for i in range(len(df.columns))))


def table(spark: SparkSession, sf_dir: str, name: str, *names: str) -> DataFrame:
    """Columns of one of the tables in sf_dir, read by Spark."""
    return pick(spark.read.parquet(f"{sf_dir}/{name}.parquet"), *names)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table written to the shared folder and read back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % F.lit(n)


def text_size(col: str | Column) -> Column:
    """Number of words of a text, in the JVM; null: 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Batches of at most so many rows go to Python, so that very long texts don't add up. The setting holds when a plan
    runs, not when it is made, so operators whose plans run later share one value; tasks put batches together
    where they want more."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def together(batches: Iterator[pd.DataFrame], column: str, most: int) -> Iterator[pd.DataFrame]:
    """Small batches put together until the values of a column are about so long in all; at least one batch, if any has rows."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += int(pdf[column].map(len, na_action="ignore").sum())
        if n >= most:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def finite(vector: str) -> Column:
    """Whether a vector is not null and neither are its components, and all are finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))


def dense(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of whole numbers as the rows of a matrix; short ones are filled with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
        vectors = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy()
    return out


Query = Callable[[SparkSession, str], DataFrame]
