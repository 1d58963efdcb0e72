"""A corpus pipeline of four stages: language ID, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of their documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neuritic.llm.common import arrow_batches, drop_stored, numbered, stored
from neuritic.llm.language_id import UND, learnable, predictor, train
from neuritic.llm.mixing import mix, shuffled
from neuritic.llm.packing import pack
from neuritic.llm.shingle_join import similar

#: Documents whose predicted language is less sure than this are rejected.
MIN_LANG_SCORE = 0.2


def _column(docs: DataFrame, name: str):
    """The column of this name in numbered(docs)."""
    return F.col(f"_d{docs.columns.index(name)}")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: texts that are null or without a letter go, and those of no language to speak of."""
    arrow_batches(spark)
    predict = predictor(spark, train(docs, learn=learnable()))
    told = numbered(docs).withColumn("_told", predict(_column(docs, "text").cast("string")))
    kept = told.filter((F.col("_told.lang_pred") != UND) & (F.col("_told.score") >= MIN_LANG_SCORE))
    return kept.drop("_told").toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of similarity 0.8 and more connect: of its class with the smallest id
    the document with the smallest id, null last, and of equal ids the one with the smallest hash of its text; of rows
    repeated with id and text one stays. Texts without words are all kept."""
    found = similar(docs)
    own = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = found.filter("n > 0 AND first_class").groupBy("cls").agg(F.min(own).alias("own")).select("own.doc_id", "own.text_hash")
    rows = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_n"), F.max("n").alias("n"))
    first = first.select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"))
    keep = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_h")), "left").filter("n = 0 OR _h IS NOT NULL")
    keep = keep.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"), F.when(F.col("n") > 0, F.col("_n")).otherwise(1).alias("_n"))
    kept = numbered(docs).withColumn("_key", _column(docs, "doc_id").cast("long")).withColumn("_hash", F.xxhash64(_column(docs, "text").cast("string")))
    kept = kept.join(keep, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th")))
    repeated = kept.filter("_n > 1").dropDuplicates(["_key", "_hash"])  # rows that stand in the table more than once
    return kept.filter("_n = 1").unionByName(repeated).drop("_id", "_th", "_n", "_key", "_hash").toDF(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as it draws them, dealt to shards and shuffled within."""
    rows = numbered(shuffled(mix(docs)))
    return rows.select(rows.columns[:-1]).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return pack(docs, memory=300_000)  # workers also hold what earlier stages left


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("mixing", mixed), ("packing", packing)]

#: No stage can be said in SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
            if before is not None:
                drop_stored(before)
            before = docs
    return docs
