"""Quality control: diagnosis of cells, scores against medians, soma cleaning, and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import verdict_class
from .forest import last_of_each_id, lift
from .metrics import examples

# Shares of labels in healthy cells, and limits against the medians of the type.
HEALTHY = {
    "pyramidal": {"axon": (0.30, 0.90), "basal": (0.05, 0.70), "apical": (0.05, 0.40)},
    "interneuron": {"axon": (0.30, 0.95), "basal": (0.05, 0.50)},
}
MEDIAN_FEATURES = ("n_primary_subtrees", "z_span", "max_radial_distance", "mean_radial_distance", "max_radius", "mean_radius", "std_radius", "thickness_ratio")
LOW = {"z_span": 0.35, "max_radial_distance": 0.35, "mean_radial_distance": 0.40, "max_radius": 0.35, "mean_radius": 0.45}
# Weights of the reasons for dropping a cell; the score at which it goes, and reasons that suffice alone.
WEIGHTS = {
    "parse_error": 100, "no_soma_label": 100, "no_axon_label": 2, "single_primary_subtree": 2, "pyramidal_missing_apical_label": 1, "low": 1, "high": 1,
    "compact_single_tree_without_axon": 3, "compact_pyramidal_without_apical": 3, "compact_low_radius_pyramidal": 2, "huge_interneuron_outlier": 3, "broad_radius_interneuron_outlier": 2,
}
DROP_SCORE = 6
SUFFICIENT = ("compact_single_tree_without_axon", "compact_pyramidal_without_apical", "huge_interneuron_outlier")
HIGH = {"z_span": 3.5, "max_radial_distance": 2.5, "mean_radial_distance": 2.5, "max_radius": 3.0, "std_radius": 3.0}


def composition(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_nodes, shares of soma, axon, basal and apical, and apical's mean height above the first soma node."""
    n = F.count(F.lit(1))
    shares = [(F.count_if(F.col("type") == k) / n).alias(name) for k, name in ((1, "soma"), (2, "axon"), (3, "basal"), (4, "apical"))]
    soma = F.min_by("z", F.when(F.col("type") == 1, F.col("seq")))
    return nodes.groupBy(*keys).agg(n.alias("n_nodes"), *shares, F.count_if(F.col("type") == 4).alias("n_apical"), (F.avg(F.when(F.col("type") == 4, F.col("z"))) - soma).alias("apical_dz"))


def diagnose(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """composition with flags (names of what is odd) and a verdict: bad, suspicious, borderline or healthy.

    keys holds cell_type.
    """
    c = composition(nodes, keys)
    present = sum((F.col(k) > 0.01).cast("int") for k in ("axon", "basal", "apical"))
    out_of = [F.when((F.col("cell_type") == t) & ~F.col(k).between(lo, hi), f"{k}_out_of_range") for t, own in HEALTHY.items() for k, (lo, hi) in own.items()]
    flags = F.array_compact(F.array(
        F.when(F.col("axon") < 0.05, "dendrite_only"), F.when(F.col("axon") > 0.95, "axon_only"), F.when(present <= 1, "partial"),
        F.when((F.col("n_apical") >= 10) & (F.col("apical_dz") < 0), "inverted"), *out_of,
    ))
    c = c.withColumn("flags", flags)
    bad = F.arrays_overlap("flags", F.array(*map(F.lit, ("dendrite_only", "axon_only", "partial"))))
    verdict = F.when(F.size("flags") == 0, "healthy").when(bad, "bad").when(F.array_contains("flags", "inverted"), "suspicious").otherwise("borderline")
    return c.withColumn("verdict", verdict)


def type_medians(cells: DataFrame) -> DataFrame:
    """A row for each cell type with the medians of some features, as m_<feature>."""
    return cells.groupBy("cell_type").agg(*(F.percentile(k, 0.5).alias(f"m_{k}") for k in MEDIAN_FEATURES))


def _reason(cond: Column, code: str) -> Column:
    weight = WEIGHTS[code if code in WEIGHTS else code.partition("_")[0]]
    return F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(weight).alias("weight")))


def score(cells: DataFrame) -> DataFrame:
    """cells with reasons (code, weight), qc_score and status. cells: cell_type, types (array), features; no features: unreadable.

    One pass for the medians of each type, a join with these few rows, and expressions over each cell.
    """
    c = cells.join(type_medians(cells.filter("n_nodes > 0")), "cell_type", "left")
    types = F.col("types")

    def under(k: str, x: float) -> Column:
        return (F.col(f"m_{k}") > 1e-9) & (F.col(k) < x * F.col(f"m_{k}"))

    def over(k: str, x: float) -> Column:
        return (F.col(f"m_{k}") > 1e-9) & (F.col(k) > x * F.col(f"m_{k}"))

    pyramidal, inter = F.col("cell_type") == "pyramidal", F.col("cell_type") == "interneuron"
    no_axon, no_apical = ~F.array_contains(types, 2), ~F.array_contains(types, 4)
    single = F.col("n_primary_subtrees") <= 1
    def low(k: str) -> Column:
        return under(k, LOW[k])

    def high(k: str) -> Column:
        return over(k, HIGH[k])

    compact = single & low("z_span") & low("max_radial_distance")
    huge = inter & high("z_span") & high("max_radial_distance")
    broad = inter & (F.col("mean_radial_distance") > 0) & high("mean_radial_distance") & (F.col("std_radius") > 0) & high("std_radius")
    rules = [
        _reason(~F.array_contains(types, 1), "no_soma_label"), _reason(no_axon, "no_axon_label"), _reason(single, "single_primary_subtree"), _reason(pyramidal & no_apical, "pyramidal_missing_apical_label"),
        *(_reason(low(k), f"low_{k}") for k in LOW), *(_reason(high(k), f"high_{k}") for k in HIGH),
        _reason(compact & no_axon, "compact_single_tree_without_axon"), _reason(pyramidal & compact & no_apical, "compact_pyramidal_without_apical"), _reason(pyramidal & compact & low("max_radius"), "compact_low_radius_pyramidal"),
        _reason(huge, "huge_interneuron_outlier"), _reason(broad, "broad_radius_interneuron_outlier"),
    ]
    unreadable = F.array(F.struct(F.lit("parse_error").alias("code"), F.lit(WEIGHTS["parse_error"]).alias("weight")))
    c = c.withColumn("reasons", F.when(F.coalesce("n_nodes", F.lit(0)) == 0, unreadable).otherwise(F.array_compact(F.array(*rules))))
    c = c.withColumn("qc_score", F.aggregate("reasons", F.lit(0), lambda a, r: a + r["weight"]))
    hard = F.exists("reasons", lambda r: (r["weight"] >= 100) | r["code"].isin(*SUFFICIENT))
    return c.withColumn("status", F.when(hard | (F.col("qc_score") >= DROP_SCORE), "drop").otherwise("keep"))


def filter_summary(scored: DataFrame, name: str = "cell_id", n: int = 20) -> DataFrame:
    """cell_type, kept, dropped, and the first n dropped names. (n is the feature.)"""
    counts = scored.groupBy("cell_type").agg(F.count_if(F.col("status") == "keep").alias("kept"), F.count_if(F.col("status") == "drop").alias("dropped"))
    few = examples(scored.filter("status = 'drop'"), ["cell_type"], name, n)
    return counts.join(few.select("cell_type", "examples"), "cell_type", "left")


def without_dropped(rows: DataFrame, dropped: DataFrame, keys: tuple = ("cell_type", "file_name")) -> DataFrame:
    """Rows (nodes, or a manifest) of what a filter or a pruning keeps."""
    return rows.join(dropped.select(*keys).distinct(), list(keys), "left_anti")


def write_pruned(nodes: DataFrame, manifest: DataFrame, dropped: DataFrame, path: str, keys: tuple = ("cell_type", "file_name")) -> None:
    """Nodes and manifest without what is dropped, as tables below a new path; a path that is there is an error."""
    without_dropped(nodes, dropped, keys).write.mode("errorifexists").partitionBy("cell_type").parquet(f"{path}/nodes")
    without_dropped(manifest, dropped, keys).write.mode("errorifexists").option("header", True).csv(f"{path}/manifest")


def reason_counts(scored: DataFrame) -> DataFrame:
    return scored.select("cell_type", F.explode("reasons").alias("r")).groupBy("cell_type", F.col("r.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def prune(scores: DataFrame, diagnosed: DataFrame, top: int = 50, classes: tuple = ("bad",), most: float = 0.85) -> DataFrame:
    """Of the `top` lowest scores those to drop: their verdict is of these classes and the score is not above `most`.

    A missing score counts as 1. Joined by file_name.
    """
    low = scores.withColumn("f1", F.coalesce("f1", F.lit(1.0))).orderBy("f1", "file_name").limit(top)
    out = low.join(diagnosed.select("file_name", "verdict"), "file_name").withColumn("verdict_class", verdict_class(F.col("verdict")))
    return out.withColumn("drop", F.col("verdict_class").isin(*classes) & (F.col("f1") <= most))


def clean_soma(nodes: DataFrame) -> DataFrame:
    """Each connected group of soma nodes becomes one, that nearest the root; children of the others hang from it. Cells
    without soma go. (Our own definition.)"""
    n = last_of_each_id(nodes)
    soma = n.filter("type = 1").select("cell_id", "id", "parent")
    up = soma.select(F.col("cell_id").alias("_c"), F.col("id").alias("_p"))
    linked = soma.join(up, (soma["cell_id"] == up["_c"]) & (soma["parent"] == up["_p"]), "left")
    state = linked.select("cell_id", "id", F.when(F.col("_p").isNotNull(), F.col("parent")).alias("anc"), F.when(F.col("_p").isNull(), F.col("id")).alias("anchor"))
    anchors = lift(state, [], ["anchor"]).select("cell_id", "id", "anchor")
    drop = anchors.filter("id != anchor")
    kept = n.join(drop, ["cell_id", "id"], "left_anti").join(soma.select("cell_id").distinct(), "cell_id", "left_semi")
    of = drop.select(F.col("cell_id").alias("_c"), F.col("id").alias("_p"), "anchor")
    out = kept.join(of, (kept["cell_id"] == of["_c"]) & (kept["parent"] == of["_p"]), "left")
    return out.withColumn("parent", F.coalesce(F.col("anchor").cast(dict(nodes.dtypes)["parent"]), F.col("parent"))).select(*nodes.columns)


def clean_report(nodes: DataFrame, cleaned: DataFrame) -> DataFrame:
    """By cell: soma nodes before and after, nodes removed, and what was done."""
    a = nodes.groupBy("cell_id").agg(F.count_if(F.col("type") == 1).alias("original_soma_count"), F.count(F.lit(1)).alias("_n"))
    b = cleaned.groupBy("cell_id").agg(F.count_if(F.col("type") == 1).alias("cleaned_soma_count"), F.count(F.lit(1)).alias("_m"))
    j = a.join(b, "cell_id", "left")
    action = F.when(F.col("_m").isNull(), "dropped_no_soma").when(F.col("_m") < F.col("_n"), "consolidated").otherwise("unchanged")
    return j.select("cell_id", "original_soma_count", F.coalesce("cleaned_soma_count", F.lit(0)).alias("cleaned_soma_count"), F.coalesce(F.col("_n") - F.col("_m"), F.lit(0)).alias("removed_soma_nodes"), action.alias("cleanup_action"))
