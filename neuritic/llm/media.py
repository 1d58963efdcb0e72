"""Media columns: byte strings kept as lossless WebP images, read back as pixel arrays, and features of these.

A text's UTF-8 bytes, filled up with bytes 255 to whole rows of 576, are the red, green and blue samples of rows of
192 pixels. The files stand in a column of a table in the shared folder; they are read back from there, decoded
(see webp_many and webp), and features are computed from the pixels.

Results in corner cases: null and empty texts are one row of bytes 255; texts longer than 16,383 rows become several
files in one value, one after the other; repeated rows give equal rows; null ids are kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import webp_many
from .common import arrow_batches, pick, stored, table, together


def fill(raw: bytes) -> bytes:
    """The bytes with bytes 255 up to a positive multiple of a row."""
    return raw + b"\xff" * (max(1, -(-len(raw) // webp_many.ROW)) * webp_many.ROW - len(raw))


def feature(payload: bytes) -> str:
    """64 bits: which of 64 even parts of the image's samples are brighter than the whole, as hexadecimal digits."""
    p = np.frombuffer(payload, dtype=np.uint8)
    at = np.arange(64) * len(p) // 64
    sums = np.add.reduceat(p, at, dtype=np.int64)
    sizes = np.diff(np.append(at, len(p)))
    bits = sums * len(p) > int(p.sum(dtype=np.int64)) * sizes
    return np.packbits(bits).tobytes().hex()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the texts as image files, in a stored table."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in together(batches, "text", 2 << 20):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": [len(b) for b in raw], "media": webp_many.write_many([fill(b) for b in raw])})

    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(docs.mapInPandas(run, "doc_id long, n_bytes long, media binary"), "media")


def features(media: DataFrame) -> DataFrame:
    """The stored table's digest: payloads decoded from the files, checksums and features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in together(batches, "media", 4 << 20):
            got = webp_many.read_many(list(pdf["media"]))
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"),
                "n_bytes": pdf["n_bytes"],
                "payload_bytes": [len(p) for p in got],
                "payload_sha256": [hashlib.sha256(p).hexdigest() for p in got],
                "tail_crc32": [zlib.crc32(p[-32:]) for p in got],
                "media_bytes": [len(m) for m in pdf["media"]],
                "media_sha256": [hashlib.sha256(m).hexdigest() for m in pdf["media"]],
                "feature": [feature(p) for p in got],
            })

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInPandas(run, schema)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents", "doc_id", "text")))


QUERIES = {"op9_media_columns": op9_media_columns}
ORACLE = {}
