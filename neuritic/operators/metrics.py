"""Label metrics: one confusion table, from which every figure is summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order

LABELS = (1, 2, 3, 4)


def confusion(rows: DataFrame, keys: list[str], gt: str = "type", pred: str = "pred") -> DataFrame:
    """keys, gt, pred, n. All metrics below start from this small table."""
    return rows.groupBy(*keys, F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(table: DataFrame, keys: list[str], labels: tuple = LABELS) -> DataFrame:
    """A row for each true label, a column for each predicted one; others count in `other`."""
    of = table.filter(F.col("gt").isin(*labels)).withColumn("pred", F.when(F.col("pred").isin(*labels), F.col("pred")).otherwise(0))
    wide = of.groupBy(*keys, "gt").pivot("pred", [*labels, 0]).agg(F.sum("n")).na.fill(0)
    return wide.select(*keys, "gt", *(F.col(str(k)).alias(f"pred_{k}") for k in labels), F.col("0").alias("other"))


def per_label(table: DataFrame, keys: list[str], labels: tuple = LABELS) -> DataFrame:
    """keys, label, support, predicted, tp, precision, recall, f1. Rows whose true label isn't in labels don't count;
    a predicted label outside them is a miss and no false positive."""
    t = table.filter(F.col("gt").isin(*labels))
    long = t.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("label")) for k in labels))).alias("l"), "gt", "pred", "n").select(*keys, "l.label", "gt", "pred", "n")
    g, p = F.col("gt") == F.col("label"), F.col("pred") == F.col("label")
    s = long.groupBy(*keys, "label").agg(F.sum(F.when(g, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(p, F.col("n")).otherwise(0)).alias("predicted"), F.sum(F.when(g & p, F.col("n")).otherwise(0)).alias("tp"))
    s = s.withColumn("precision", F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)).withColumn("recall", F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0))
    both = F.col("precision") + F.col("recall")
    return s.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def summary(table: DataFrame, keys: list[str], labels: tuple = LABELS) -> DataFrame:
    """keys, n, accuracy, and macro averages over the labels with support, with and without soma."""
    all_labels = per_label(table, keys, labels)
    there, neurite = F.col("support") > 0, (F.col("support") > 0) & (F.col("label") != 1)

    def mean(c: str, cond: Column) -> Column:
        return F.coalesce(F.avg(F.when(cond, F.col(c))), F.lit(0.0))

    return all_labels.groupBy(*keys).agg(
        F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"),
        mean("f1", there).alias("macro_f1"), mean("precision", there).alias("macro_precision"), mean("recall", there).alias("macro_recall"),
        mean("f1", neurite).alias("neurite_macro_f1"), mean("recall", neurite).alias("neurite_balanced_accuracy"),
    )


def file_scores(rows: DataFrame, keys: list[str], least_neurite: int = 50) -> DataFrame:
    """Metrics of each file that has enough nodes besides soma."""
    t = confusion(rows, keys)
    enough = t.filter("gt != 1").groupBy(*keys).agg(F.sum("n").alias("k")).filter(F.col("k") >= least_neurite).select(*keys)
    return summary(t, keys).join(enough, keys)


def score_summary(scores: DataFrame, keys: list[str], value: str = "f1") -> DataFrame:
    """n, mean, median, 10th and 25th percentile (between neighbours, linearly), least."""
    got = order.quantiles(scores, keys, value, [0.1, 0.25, 0.5])
    return got.select(*keys, F.col("n").alias("n_files"), "mean", F.col("q")[2].alias("median"), F.col("q")[0].alias("p10"), F.col("q")[1].alias("p25"), F.col("low").alias("least"))


def worst(scores: DataFrame, keys: list[str], n: int = 5, value: str = "f1", size: str | None = "n_nodes") -> DataFrame:
    """The n lowest scores of each group, larger files first among equals, with their place. (n is the feature.)"""
    from pyspark.sql import Window

    order = [F.col(value), *([F.desc(size)] if size else []), F.col("file_name")]
    place = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order))
    return scores.withColumn("place", place).filter(F.col("place") <= n)


def examples(rows: DataFrame, keys: list[str], name: str = "file_name", n: int = 20) -> DataFrame:
    """keys, count and the first n names in order. (n is the feature.) Names are ranked before any are gathered."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(name))
    first = rows.select(*keys, name).withColumn("_p", place).filter(F.col("_p") <= n)
    first = first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", name))), lambda s: s[name]).alias("examples"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(first, keys)


def nearest_rank(scores: DataFrame, keys: list[str], value: str = "f1", ranks: tuple = (10, 25, 75, 90)) -> DataFrame:
    """Percentiles that are values of the data: that at place round(p (n - 1)), halves to even; the median at place n // 2.

    Values are found by counting between narrowing bounds (see order), so a group's values are neither sorted nor gathered in one task.
    """
    places = [F.floor(F.col("n") / 2), *(F.bround((F.col("n") - 1) * (p / 100)) for p in ranks)]
    got, v = order.at_places(scores, keys, value, places), F.col("values")
    return got.select(*keys, "n", "mean", v[0].alias("median"), *(v[k].alias(f"p{p}") for k, p in enumerate(ranks, 1)), F.col("low").alias("least"), F.col("high").alias("most"))


def breakdown(scores: DataFrame, value: str = "f1") -> DataFrame:
    """n, mean, least and most overall, by source, by cell type and by both; `*` stands for all."""
    sets = scores.groupingSets([[], ["source"], ["cell_type"], ["cell_type", "source"]], "cell_type", "source")
    got = sets.agg(F.grouping("cell_type").alias("_c"), F.grouping("source").alias("_s"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return got.select(F.when(F.col("_c") == 1, "*").otherwise(F.col("cell_type")).alias("cell_type"), F.when(F.col("_s") == 1, "*").otherwise(F.col("source")).alias("source"), "n", "mean", "least", "most")


def tail_head(scores: DataFrame, value: str = "f1", share: float = 0.1) -> DataFrame:
    """part (tail: at or below the percentile), n, mean."""
    cut = scores.agg(F.percentile(value, share).alias("cut"))
    part = scores.crossJoin(F.broadcast(cut)).withColumn("part", F.when(F.col(value) <= F.col("cut"), "tail").otherwise("head"))  # cut is one row
    return part.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def balanced_weights(rows: DataFrame, label: str = "type", weight: str = "w") -> DataFrame:
    """Rows with `balanced`: weights scaled so that every label has the same sum."""
    sums = rows.groupBy(label).agg(F.sum(weight).alias("_own"))
    total = sums.agg(F.sum("_own").alias("_all"), F.count(F.lit(1)).alias("_k"))
    sums = sums.crossJoin(F.broadcast(total))  # total is one row
    return rows.join(sums, label).withColumn("balanced", F.col(weight) * F.col("_all") / (F.col("_k") * F.col("_own"))).drop("_own", "_all", "_k")


def rows_per_label(branches: DataFrame, valid: tuple = (2, 3, 4), dendrite_weight: float | None = None) -> DataFrame:
    """A row for each branch and label that some of its nodes have, with the number of such nodes as weight; what training
    takes in place of a row for each node. branches: gt_label_counts. dendrite_weight: a factor for other labels than axon."""
    out = branches.select("*", F.explode("gt_label_counts").alias("label", "weight")).filter(F.col("label").isin(*valid))
    w = F.col("weight").cast("double")
    return out.withColumn("weight", w if dendrite_weight is None else F.when(F.col("label") != 2, w * dendrite_weight).otherwise(w))


def dataset_stats(vertices: DataFrame) -> DataFrame:
    """One row: files, pyramidal and other files, branches, branches with a label for the graph model, apical and basal ones.
    vertices: cell_id, cell_type, y."""
    files = vertices.select("cell_id", "cell_type").distinct().agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("cell_type") == "pyramidal").alias("n_pyramidal"), F.count_if(F.col("cell_type") != "pyramidal").alias("n_interneuron"))
    rows = vertices.agg(F.count(F.lit(1)).alias("n_branches_total"), F.count_if(F.col("y") >= 0).alias("n_apical_basal_total"), F.count_if(F.col("y") == 1).alias("n_apical"), F.count_if(F.col("y") == 0).alias("n_basal"))
    return files.crossJoin(rows)  # one row each


def prior(rows: DataFrame, label: str = "type") -> DataFrame:
    """label, share of each label but soma."""
    n = rows.filter(F.col(label) != 1).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_all"))
    return n.crossJoin(F.broadcast(total)).select("label", (F.col("n") / F.col("_all")).alias("share"))  # one row


def compare(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """keys, missing_in_gt, missing_in_pred, parent_mismatch: what keeps two labellings of the same cells from being compared."""
    a = gt.select(*keys, "id", F.col("parent").alias("_pa"), F.lit(1).alias("_a"))
    b = pred.select(*keys, "id", F.col("parent").alias("_pb"), F.lit(1).alias("_b"))
    both = a.join(b, [*keys, "id"], "full")
    return both.groupBy(*keys).agg(F.count_if(F.col("_a").isNull()).alias("missing_in_gt"), F.count_if(F.col("_b").isNull()).alias("missing_in_pred"), F.count_if(F.col("_pa") != F.col("_pb")).alias("parent_mismatch"))


def batch_summary(rows: DataFrame) -> DataFrame:
    """By batch: files, nodes, pooled accuracy and macro F1, medians of both over files. rows: batch, cell_id, type, pred."""
    one = confusion(rows, ["batch", "cell_id"])
    files = summary(one, ["batch", "cell_id"])
    pooled = summary(one.groupBy("batch", "gt", "pred").agg(F.sum("n").alias("n")), ["batch"])
    med = files.groupBy("batch").agg(F.count(F.lit(1)).alias("files"), F.percentile("accuracy", 0.5).alias("accuracy_median"), F.percentile("macro_f1", 0.5).alias("macro_f1_median"))
    return pooled.join(med, "batch").select("batch", "files", "n", "accuracy", "accuracy_median", "macro_f1", "macro_f1_median")


def subtree_records(topo: DataFrame, gt: str = "type", pred: str = "pred") -> DataFrame:
    """For every child of a true soma node: majority of true and of predicted labels in its subtree (the root's own
    label wins ties, then the smaller), and whether they agree. topo's primary_root must come from the soma nodes."""
    t = topo.filter("primary_root IS NOT NULL")
    roots = t.filter("id = primary_root").select("cell_id", "primary_root", F.col(gt).alias("rg"), F.col(pred).alias("rp"))
    out = roots
    for c, r, name in ((gt, "rg", "gt_label"), (pred, "rp", "pred_label")):
        n = t.filter(F.col(c).isin(2, 3, 4)).groupBy("cell_id", "primary_root", F.col(c).alias("l")).agg(F.count(F.lit(1)).alias("n"))
        n = n.join(roots.select("cell_id", "primary_root", r), ["cell_id", "primary_root"])
        best = n.groupBy("cell_id", "primary_root").agg(F.max_by("l", F.struct("n", (F.col("l") == F.col(r)).cast("int"), -F.col("l"))).alias(name))
        out = out.join(best, ["cell_id", "primary_root"], "left" if name == "pred_label" else "inner")
    out = out.withColumn("pred_label", F.coalesce("pred_label", F.lit(0)))
    return out.select("cell_id", "primary_root", "gt_label", "pred_label", (F.col("gt_label") == F.col("pred_label")).cast("int").alias("correct"))


def across_seeds(rows: DataFrame) -> DataFrame:
    """By path: tests, errors, their rate, mean confidence of errors, most frequent prediction. rows: path, seed, gt, pred, conf."""
    wrong = F.col("gt") != F.col("pred")
    n = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n_tested"), F.count_if(wrong).alias("n_wrong"), F.avg(F.when(wrong, F.col("conf"))).alias("mean_wrong_conf"))
    mode = rows.groupBy("path", "pred").agg(F.count(F.lit(1)).alias("k")).groupBy("path").agg(F.max_by("pred", F.struct("k", -F.col("pred"))).alias("mode_pred"))
    return n.withColumn("wrong_rate", F.col("n_wrong") / F.col("n_tested")).join(mode, "path")


def seed_summary(rows: DataFrame) -> DataFrame:
    """One row: seeds, and mean and deviation of their accuracies. rows: seed, gt, pred."""
    one = rows.groupBy("seed").agg(F.avg((F.col("gt") == F.col("pred")).cast("double")).alias("accuracy"))
    return one.agg(F.count(F.lit(1)).alias("seeds"), F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"))


def mean_confusion(rows: DataFrame) -> DataFrame:
    """gt, pred, n: confusion counts, averaged over the seeds. rows: seed, gt, pred."""
    seeds = rows.agg(F.count_distinct("seed").alias("_s"))
    return rows.groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(seeds)).select("gt", "pred", (F.col("_n") / F.col("_s")).alias("n"))  # one row


def misclassified(rows: DataFrame, classes: list[str], keep: tuple = ("path",)) -> DataFrame:
    """Wrong rows with the probability of each class, the most confident first. rows: gt, pred, conf, probability (a map)."""
    wrong = rows.filter(F.col("gt") != F.col("pred"))
    return wrong.select(*keep, F.col("gt").alias("ground_truth"), F.col("pred").alias("predicted"), F.col("conf").alias("confidence"), *(F.col("probability")[c].alias(c) for c in classes)).orderBy(F.desc("confidence"), *keep)


def per_file_table(s2: DataFrame, s23: DataFrame) -> DataFrame:
    """path, cell_type, n_nodes and both stages' scores, worst after refinement first; 0 where that score is missing.
    s2, s23: path, cell_type, n_nodes, f1."""
    after = s23.select("path", F.col("f1").alias("f1_s23"))
    out = s2.select("path", "cell_type", "n_nodes", F.col("f1").alias("f1_s2")).join(after, "path", "left").na.fill(0.0, ["f1_s23"])
    return out.orderBy("f1_s23", "f1_s2", "path")


def with_errors(files: DataFrame, done: DataFrame) -> DataFrame:
    """All files with their score and whether they were scored; files with an error count 0 as rows and not in means.
    files: file_name, cell_type. done: file_name, f1."""
    return files.join(done.select("file_name", "f1"), "file_name", "left").withColumn("ok", F.col("f1").isNotNull()).na.fill(0.0, ["f1"])


def medians_and_scale(rows: DataFrame, features: list[str], by: str = "cell_type") -> DataFrame:
    """by, feature, median, and scale: the median distance from it, 1 where that is 0."""
    long = rows.unpivot([by], features, "feature", "v")
    med = order.quantiles(long, [by, "feature"], "v", [0.5]).select(by, "feature", F.col("q")[0].alias("median"))
    away = long.join(med, [by, "feature"]).withColumn("v", F.abs(F.col("v") - F.col("median")))
    off = order.quantiles(away, [by, "feature", "median"], "v", [0.5]).withColumn("s", F.col("q")[0])
    return off.select(by, "feature", "median", F.when(F.col("s") > 1e-9, F.col("s")).otherwise(1.0).alias("scale"))


def error_drivers(errors: DataFrame, features: list[str], medians: DataFrame, top: int = 8) -> DataFrame:
    """For every wrong row (path, gt, pred) the features that are nearer to the predicted class, best first."""
    from pyspark.sql import Window

    long = errors.unpivot(["path", "gt", "pred"], features, "feature", "v")
    a = medians.select(F.col("cell_type").alias("gt"), "feature", F.col("median").alias("mg"), "scale")
    b = medians.select(F.col("cell_type").alias("pred"), "feature", F.col("median").alias("mp"))
    d = long.join(a, ["gt", "feature"]).join(b, ["pred", "feature"]).withColumn("delta", (F.abs(F.col("v") - F.col("mg")) - F.abs(F.col("v") - F.col("mp"))) / F.col("scale")).filter("delta > 0")
    n = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("delta"), "feature"))
    return d.withColumn("n", n).filter(F.col("n") <= top).select("path", "n", "feature", "delta")


def binary(rows: DataFrame, keys: list[str], weight: str = "w", positive: int = 2, gt: str = "type", pred: str = "pred") -> DataFrame:
    """keys: accuracy, and the weighted recall of the positive label (axon) and of the others."""
    g, p = F.col(gt) == positive, F.col(pred) == positive
    w = F.col(weight)

    def recall(of: Column) -> Column:
        return F.sum(F.when(of & (g == p), w).otherwise(0)) / F.greatest(F.sum(F.when(of, w).otherwise(0)), F.lit(1))

    return rows.groupBy(*keys).agg(F.avg((g == p).cast("double")).alias("accuracy"), recall(g).alias("axon_recall"), recall(~g).alias("dendrite_recall"))


def graph_metrics(rows: DataFrame, keys: list[str], gt: str = "gt", pred: str = "pred", ignore: int = -100) -> DataFrame:
    """One row: macro F1 over labels 0 and 1 of all vertices, each label's F1, and the mean macro F1 over graphs with labels."""
    known = rows.filter(F.col(gt) != ignore)

    def f1(by: list[str]) -> DataFrame:
        t = known.groupBy(*by).agg(*(F.count_if((F.col(gt) == a) & (F.col(pred) == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)))

        def one(tp: str, fp: str, fn: str) -> Column:
            total = 2 * F.col(tp) + F.col(fp) + F.col(fn)
            return F.when(total > 0, 2 * F.col(tp) / total).otherwise(0.0)

        return t.withColumn("f0", one("n00", "n10", "n01")).withColumn("f1", one("n11", "n01", "n10")).withColumn("macro", (F.col("f0") + F.col("f1")) / 2)

    per = f1(keys).agg(F.avg("macro").alias("graph_mean_macro_f1"))
    return f1([]).select(F.col("macro").alias("macro_f1"), F.col("f0").alias("f1_0"), F.col("f1").alias("f1_1")).crossJoin(per)  # one row each


def false_rate(rows: DataFrame, keys: list[str], label: int = 4, gt: str = "type", pred: str = "pred") -> DataFrame:
    """One row: cells that truly lack the label, those of them where it is predicted, and their share."""
    cells = rows.groupBy(*keys).agg(F.max((F.col(gt) == label).cast("int")).alias("has"), F.max((F.col(pred) == label).cast("int")).alias("said")).filter("has = 0")
    return cells.agg(F.count(F.lit(1)).alias("n_cells"), F.coalesce(F.sum("said"), F.lit(0)).alias("n_false"), F.coalesce(F.avg("said"), F.lit(0.0)).alias("rate"))
