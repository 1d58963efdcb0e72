"""Token ids of documents in files of adaptively coded blocks.

Documents are dealt by ranges of doc_id and sorted; each task tokenizes its range, appends the end id to each
document, cuts the stream of ids into blocks and codes them (see range_coder). A file is a Parquet table in the shared
folder; a row is a segment: whole documents with their lengths, and their blocks, each with header and checksum. Rows
of a file are in ascending order of doc_id, and files by their part number. Reading decodes the segments
independently, and a document's place follows from sums of the segments' lengths.

Results in corner cases: null and empty texts are the end id alone; null ids come first; rows with equal ids are
ordered by a hash of their text; an empty table gives no file rows; other columns are ignored; a damaged block is an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import range_coder, tokens
from .common import arrow_batches, pick, stored, table, together

END = 0
#: Ids after which a segment ends; its blocks are coded side by side.
SEGMENT_IDS = 1 << 23


def write(docs: DataFrame, path: str | None = None, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """The stored table: part, segment, doc_ids, lengths, n_ids, blocks."""
    arrow_batches(docs.sparkSession)
    path = path or tokens.tokenizer_path()
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))  # rows of one id are dealt by their texts
    docs = docs.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context, segment = TaskContext.get(), 0
        part = context.partitionId() if context else 0
        enc = tokens.encoder(path)
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pd.DataFrame:
            blocks = range_coder.encode(np.concatenate(held))
            return pd.DataFrame({"part": [part], "segment": [segment], "doc_ids": [ids], "lengths": [[len(x) for x in held]], "n_ids": [n], "blocks": [blocks]})

        for pdf in together(batches, "text", 2 << 20):
            for i, x in zip(pdf["doc_id"].astype("Int64"), enc.encode(pdf["text"]), strict=True):
                ids.append(None if i is pd.NA else int(i))
                held.append(np.append(x, END))
                n += len(held[-1])
                if n >= segment_ids:
                    yield flush()
                    ids, held, n, segment = [], [], 0, segment + 1
        if held:
            yield flush()

    return stored(docs.mapInPandas(run, "part int, segment int, doc_ids array<long>, lengths array<long>, n_ids long, blocks array<binary>"), "token-files")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded files."""
    spark = files.sparkSession
    arrow_batches(spark)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))  # a row for each part
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")
    places = files.select("part", "segment", "n_ids").withColumn("inside", inside).join(before, "part").select("part", "segment", (F.col("base") + F.col("inside")).alias("base"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, segment, ids, lengths, blocks in zip(*(pdf[c] for c in ("part", "segment", "doc_ids", "lengths", "blocks")), strict=True):
                flat = np.concatenate(range_coder.decode(list(blocks))).astype("<u4")
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends - lengths, ends, strict=True)]
                yield pd.DataFrame({"part": part, "segment": segment, "doc_id": pd.array(ids, dtype="Int64"), "offset": ends - lengths, "n_tokens": np.asarray(lengths, dtype=np.int64), "ids_crc32": crcs})

    docs = files.select("part", "segment", "doc_ids", "lengths", "blocks").mapInPandas(run, "part int, segment int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return docs.join(places, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents", "doc_id", "text")))


QUERIES = {"op8_token_store": op8_token_store}
ORACLE = {}
