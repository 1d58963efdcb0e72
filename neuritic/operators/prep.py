"""Building data sets: source pools, benchmarks with quotas, merged sets, and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import basename, benchmark_id, canonical_labels, holds_labels, in_test, slug, source_of
from ..sources.tables import union_manifests

# Order of sources and their quotas in a benchmark.
PRIORITY = {"pyramidal": ("allen", "lab", "neuromorpho"), "interneuron": ("allen", "neuromorpho", "lab")}
QUOTAS = {"pyramidal": {"allen": 104, "neuromorpho": 400}}


def source_pool(files: DataFrame, metadata: list[DataFrame]) -> DataFrame:
    """Files with a full set of labels, each with the row of the first metadata table that has its name and cell type.

    files: cell_type, source, path, types. metadata: file_name, cell_type and more.
    """
    kept = files.filter(canonical_labels(F.col("cell_type"), F.col("types"))).withColumn("file_name", basename(F.col("path")))
    meta = union_manifests([m.withColumn("_order", F.lit(k)) for k, m in enumerate(metadata)])
    rest = [c for c in meta.columns if c not in ("file_name", "cell_type", "_order")]
    first = meta.groupBy("file_name", "cell_type").agg(F.min_by(F.struct(*rest), "_order").alias("_m"))
    out = kept.join(first, ["file_name", "cell_type"], "left")
    origin = {k: F.col(f"_m.{k}") if k in rest else F.lit(None).cast("string") for k in ("archive", "specimen_id", "batch")}
    name = copied_name(F.col("source"), F.col("file_name"), origin["archive"], origin["specimen_id"], origin["batch"])
    return out.select(*kept.columns, name.alias("copied_file"), F.array_join(F.sort_array("types"), " ").alias("type_set"), *(F.col(f"_m.{c}").alias(f"meta_{c}") for c in rest))


def copied_name(source: Column, file_name: Column, archive: Column, specimen: Column, batch: Column) -> Column:
    """Name of a copied file: its source, what tells its origin there (archive, specimen or batch), and its name."""
    origin = F.when(source == "neuromorpho", archive.cast("string")).when(source == "allen", specimen.cast("string")).otherwise(batch.cast("string"))
    return F.concat_ws("__", source, slug(F.coalesce(F.trim(origin), F.lit("na"))), file_name)


def gather_candidates(files: DataFrame, allen: DataFrame, neuromorpho: DataFrame) -> DataFrame:
    """Files for a benchmark with their source: that of the archive that lists their name, the first of the two; unlisted
    interneurons are the lab's, other unlisted files go. Only full sets of labels. files: cell_type, path, types."""
    f = files.withColumn("file_name", basename(F.col("path")))
    a = allen.select("file_name").distinct().withColumn("_a", F.lit(1))
    n = neuromorpho.select("file_name").distinct().withColumn("_n", F.lit(1))
    source = F.when(F.col("_a") == 1, "allen").when(F.col("_n") == 1, "neuromorpho").when(F.col("cell_type") == "interneuron", "lab")
    out = f.join(a, "file_name", "left").join(n, "file_name", "left").withColumn("source", source).filter("source IS NOT NULL")
    return out.filter(canonical_labels(F.col("cell_type"), F.col("types"))).drop("_a", "_n")


def select_examples(candidates: DataFrame, limit: int, quotas: dict | None = None, priority: dict | None = None) -> DataFrame:
    """Up to `limit` files of each type: first each source's quota, then by the order of sources. (`limit` is the feature.)

    candidates: cell_type, source, path. Adds n, from 1 in order of choice, and benchmark_id. Ranks are counted within
    (type, source), and the global order only among files that their own source's rank lets in.
    """
    quotas, priority = QUOTAS if quotas is None else quotas, PRIORITY if priority is None else priority
    c = candidates.dropDuplicates(["cell_type", "path"])
    q = F.coalesce(F.create_map(*(x for t, own in quotas.items() for s, n in own.items() for x in (F.lit(f"{t}/{s}"), F.lit(n))))[F.concat_ws("/", "cell_type", "source")], F.lit(0)) if quotas else F.lit(0)
    place = {f"{t}/{s}": k for t, own in priority.items() for k, s in enumerate(own)}
    q_place = {f"{t}/{s}": k for t, own in quotas.items() for k, s in enumerate(own)}
    key = F.concat_ws("/", "cell_type", "source")
    p = F.create_map(*(x for k, v in place.items() for x in (F.lit(k), F.lit(v))))[key]
    qp = F.create_map(*(x for k, v in q_place.items() for x in (F.lit(k), F.lit(v))))[key] if q_place else F.lit(None).cast("int")
    c = c.withColumn("_r", F.row_number().over(Window.partitionBy("cell_type", "source").orderBy("path"))).filter(p.isNotNull() & (F.col("_r") <= limit))
    c = c.withColumn("_phase", F.when(F.col("_r") <= q, 0).otherwise(1)).withColumn("_p", F.when(F.col("_phase") == 0, qp).otherwise(p))
    n = F.row_number().over(Window.partitionBy("cell_type").orderBy("_phase", "_p", "_r"))
    out = c.withColumn("n", n).filter(F.col("n") <= limit).drop("_r", "_phase", "_p")
    return out.withColumn("benchmark_id", benchmark_id(F.col("cell_type"), F.col("n")))


def merge_sets(base: DataFrame, extra: DataFrame, required: tuple = (4,), prefix: str = "hpf_ca1__") -> DataFrame:
    """base and those of extra that hold the required labels and whose name, with a prefix, isn't there yet. Both: file_name, cell_type, types."""
    new = extra.filter(holds_labels(F.col("types"), required)).withColumn("file_name", F.concat(F.lit(prefix), "file_name"))
    return union_manifests([base, new.join(base.select("file_name"), "file_name", "left_anti")])


def split(files: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """files with is_test, by a hash of the name; a type that would have no test file gets that with the smallest hash."""
    from ..functions.scalars import hash_share

    f = files.withColumn("is_test", in_test(F.col("file_name"), share, seed)).withColumn("_h", hash_share(F.col("file_name"), seed))
    first = f.groupBy("cell_type").agg(F.max(F.col("is_test").cast("int")).alias("_any"), F.min_by("file_name", "_h").alias("_first"), F.count(F.lit(1)).alias("_n"))
    out = f.join(first, "cell_type")
    return out.withColumn("is_test", F.col("is_test") | ((F.col("_any") == 0) & (F.col("_n") > 1) & (F.col("file_name") == F.col("_first")))).drop("_h", "_any", "_first", "_n")


def folds(files: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """files with fold: the rank by hash within the type, modulo k, so that folds have the same mix of types."""
    # ranked within 256 buckets of the hash, which stand one after the other: no type is sorted in one task
    f = files.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), "file_name"))).withColumn("_b", F.substring("_h", 1, 2))
    sizes = f.groupBy("cell_type", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("cell_type").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")  # 256 rows a type
    f = f.join(sizes.withColumn("_before", before), ["cell_type", "_b"])
    place = F.col("_before") + F.row_number().over(Window.partitionBy("cell_type", "_b").orderBy("_h", "file_name")) - 1
    return f.withColumn("fold", (place % k).cast("int")).drop("_h", "_b", "_n", "_before")


def by_source(files: DataFrame) -> DataFrame:
    """Files with the source that their name begins with."""
    return files.withColumn("source", source_of(F.col("file_name")))


def without_label(cells: DataFrame, cell_type: str = "pyramidal", label: int = 4) -> DataFrame:
    """Cells of a type whose labels lack one. cells: cell_type, types."""
    return cells.filter((F.col("cell_type") == cell_type) & ~F.array_contains("types", label))


def branch_labels(branches: DataFrame, basal: int = 3, apical: int = 4, ignore: int = -100) -> DataFrame:
    """Branches with y for a graph model: 0 basal, 1 apical, `ignore` for the rest."""
    return branches.withColumn("y", F.when(F.col("gt") == basal, 0).when(F.col("gt") == apical, 1).otherwise(ignore))
