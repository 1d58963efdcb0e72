"""Settings that the operators rely on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the session names in spark.checkpoint.dir, or else the
    context's checkpoint folder. A local one is set only on a local master, as in tests; on a cluster without either
    it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    spark.conf.set("spark.checkpoint.dir", "/tmp/checkpoints/neuritic")
    return "/tmp/checkpoints/neuritic"


_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What checkpointed() writes inside is deleted at the end; results must have been written elsewhere by then."""
    made: list[str] = []
    before = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(before)
        for folder in made:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """The rows as a table written to the shared folder, so that their lineage ends there.

    instead_of: an earlier such table that only this one was made from; its files go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if (made := _SCOPE.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    if instead_of is not None:
        drop_stored(instead_of)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed_count(df: DataFrame, where: Column, instead_of: DataFrame | None = None) -> tuple[DataFrame, int]:
    """checkpointed(), and the number of rows for which something holds, from the columns that it names alone."""
    out = checkpointed(df, instead_of)
    return out, out.filter(where).count()


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a table in the shared folder that nothing reads any more; files elsewhere stay."""
    spark = df.sparkSession
    base = shared_dir(spark).partition(":")[2] or shared_dir(spark)
    base = "/" + base.strip("/") + "/"
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if base in folder + "/":
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_there(df: DataFrame) -> bool:
    """Whether the folders of a stored table still are."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f) for f in {f.rpartition("/")[0] for f in df.inputFiles()}]
    return bool(paths) and all(p.getFileSystem(conf).exists(p) for p in paths)


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and local runs."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("neuritic")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
