"""Taking in new node files as a stream: every file once, with late repeats merged by name; and labelling them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forest
from ..plans import labelling
from ..plans.bundle import Bundle
from ..session import checkpointed, temporary
from ..sources.swc import class_folder, file_path, parse_lines
from ..sources.tables import upsert


def stream_nodes(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A streaming frame of the nodes of all files that come up below a path."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.swc").option("maxFilesPerTrigger", max_files).load(path)
    files = files.select(file_path().alias("cell_id"), "value")
    lines = files.select("cell_id", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("seq", "line"))
    return parse_lines(lines).withColumn("cell_type", class_folder(F.col("cell_id")))


def ingest(spark: SparkSession, path: str, table: str, checkpoint: str):
    """Appends new files' nodes to a table of Parquet files by cell type; a restart goes on where the last run ended."""
    writer = stream_nodes(spark, path).writeStream.format("parquet").partitionBy("cell_type").option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start(table)


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The rows of a table that upsert_batches keeps, with bucket and v; None before its first batch."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    rows = spark.read.parquet(table)
    last = rows.groupBy("bucket").agg(F.max("v").alias("v"))  # a row for each bucket
    return rows.join(F.broadcast(last), ["bucket", "v"])


def upsert_batches(stream: DataFrame, table: str, key: str, checkpoint: str, buckets: int = 64):
    """Merges each batch of a stream of rows into a table by key; new rows win.

    Keys are dealt to buckets by a hash. A batch writes a new version of the buckets that it touches, and what these replace
    is deleted; others stay as they are. Running a batch again gives the same table. Read it with current().
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # at most `buckets` numbers
        now = current(spark, table)
        old = new.limit(0) if now is None else now.filter(F.col("bucket").isin(touched))
        before = [] if now is None else [(r.v, r.bucket) for r in spark.read.parquet(table).filter(F.col("bucket").isin(touched)).select("v", "bucket").distinct().collect()]
        upsert(old.drop("v"), new, key).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v={number}")
        new.unpersist()
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for v, bucket in before:
            if v != number:
                path = jvm.org.apache.hadoop.fs.Path(f"{table}/v={v}/bucket={bucket}")
                path.getFileSystem(conf).delete(path, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def labels(spark: SparkSession, table: str) -> DataFrame | None:
    """The labels that label_stream has written: cell_id, id, used_type, label, s2, conf; None before the first."""
    if not _there(spark, f"{table}/files"):
        return None
    whole = spark.read.parquet(f"{table}/files").select("cell_id", "batch")
    return spark.read.parquet(f"{table}/labels").join(whole, ["cell_id", "batch"], "left_semi").drop("batch")


def label_batch(nodes: DataFrame, bundle: Bundle | None, table: str, number: int, **settings) -> int:
    """Labels the cells of a batch that no other batch has labelled; their number. Labels are written first, and then the batch's files
    to the list of those that are done; a batch that runs again writes the same folders again."""
    spark = nodes.sparkSession
    new = nodes
    if _there(spark, f"{table}/files"):
        done = spark.read.parquet(f"{table}/files").filter(F.col("batch") != number).select("cell_id")
        new = nodes.join(done, "cell_id", "left_anti")
    with temporary(spark):
        new = checkpointed(new)
        cells = new.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_nodes"))
        n = cells.count()
        if n:
            got = labelling.label_nodes(checkpointed(forest.topology(new)), bundle, **settings)
            got = got.select("cell_id", "id", "used_type", F.col("s23").alias("label"), "s2", "conf")
            got.write.mode("overwrite").parquet(f"{table}/labels/batch={number}")
            cells.write.mode("overwrite").parquet(f"{table}/files/batch={number}")
    return n


def label_stream(spark: SparkSession, path: str, bundle: Bundle | None, table: str, max_files: int = 1000, **settings):
    """Labels all files below a path that aren't labelled yet, batch by batch, and ends. Without a bundle rules label them.

    A file is labelled once: the stream remembers which it has read, in the table's own folder, and files that are in the list of
    those done are left out even if the stream starts anew. settings: see labelling.label_nodes(). Read the labels with labels().
    """

    def batch(nodes: DataFrame, number: int) -> None:
        label_batch(nodes, bundle, table, number, **settings)

    writer = stream_nodes(spark, path, max_files).writeStream.foreachBatch(batch).option("checkpointLocation", f"{table}/progress")
    return writer.trigger(availableNow=True).start()
