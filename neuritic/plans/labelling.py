"""The whole way from nodes to refined labels, and its evaluation, as one chain of DataFrames.

Cells of a training part teach three kinds of models: the type of a cell from its features; what each primary subtree
is (the owners) from subtree features; and the label of each branch from branch features and its subtree's owner, one
model for each cell type. The other cells are then labelled. A cell whose type isn't sure is tried as both types and keeps the one
under which its branches are surer; where there are no models, rules tell types and branches are basal. A graph network, if there is one, tells basal
from apical branches where a cell has both. Branch labels spread to nodes, and rules refine them, with the likeliest apical
subtree as a constraint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import in_test
from ..operators import features, forest, graph, metrics, ml, prep, rules
from ..session import checkpointed
from .bundle import CELL_CLASSES, LABELS, Bundle

#: Columns of branch and subtree features that aren't measures.
NOT_FEATURES = ("cell_id", "branch", "anchor", "primary_root", "cell_type")
#: Beyond so many micrometres a branch is cut in training and labelling.
CUT = 180.0
#: Label of branches where there is no model at all.
NO_MODEL = 3
CELL_MEASURES = ("n_nodes", "n_root_nodes", "n_branch_points", "n_primary_subtrees", "branch_point_ratio", "mean_path_length", "std_path_length", "max_radial_distance", "mean_radius", "std_radius", "z_span", "z_asymmetry", "xy_aspect_ratio", "max_subtree_size", "subtree_size_std")


def cell_table(topo: DataFrame) -> DataFrame:
    """Measures of each cell that its type is told from, and its type."""
    c = features._aggregated(topo, features.COUNTS, features.PATHS, features.RADIUS, features.EXTENT)
    return checkpointed(c.join(features.cell_subtrees(topo), "cell_id").join(topo.select("cell_id", "cell_type").distinct(), "cell_id"))


def branch_table(topo: DataFrame, cut: float | None = CUT) -> tuple[DataFrame, list[str]]:
    """Branch features with true labels (gt_label and gt_label_counts), and the features' names without the type's."""
    b = features.branch_features(topo, cut)
    names = [c for c in b.columns if c not in NOT_FEATURES and c not in [f"is_{k}" for k in features.CELL_TYPES]]
    truth = features.branch_truth(topo, forest.branches(topo, cut, ("type", "seq")))
    return checkpointed(b.drop(*(f"is_{k}" for k in features.CELL_TYPES)).join(truth, ["cell_id", "branch"])), names


def subtree_table(topo: DataFrame) -> tuple[DataFrame, list[str]]:
    """Features of primary subtrees with their true label, and the features' names."""
    s = features.subtree_features(topo)
    names = [c for c in s.columns if c not in NOT_FEATURES]
    inside = topo.filter("primary_root IS NOT NULL")
    truth = features.branch_truth(topo, inside.select("cell_id", "id", "primary_root", "type", "seq"), ("cell_id", "primary_root"))
    kinds = topo.select("cell_id", "cell_type").distinct()
    return checkpointed(s.join(truth, ["cell_id", "primary_root"]).join(kinds, "cell_id")), names


def _probability() -> Column:
    """An array of three, for labels 2, 3, 4, of a model's array of two or three."""
    return F.slice(F.concat("probability", F.array(F.lit(0.0), F.lit(0.0))), 1, 3)


def train_owners(subtrees: DataFrame, names: list[str], trees: int) -> dict:
    """A vote of owners for each cell type that has subtrees of two labels, with weights balanced over nodes."""
    out = {}
    for kind in rules.TYPE_ORDER:
        own = subtrees.filter((F.col("cell_type") == kind) & F.array_contains(rules.legal(F.col("cell_type")), F.col("gt_label")))
        labels = [r[0] for r in own.select("gt_label").distinct().collect()]  # three at most
        if len(labels) > 1:
            of = F.aggregate(F.map_values("gt_label_counts"), F.lit(0.0), lambda a, n: a + n)
            w = metrics.balanced_weights(own.withColumn("label", (F.col("gt_label") - 2).cast("double")).withColumn("w", of), "label")
            out[kind] = ml.train_owner(checkpointed(w), names, max(labels) - 1, weight="balanced", trees=trees)
    return out


def owners_of(subtrees: DataFrame, models: dict, names: list[str]) -> DataFrame | None:
    """owner_map of the subtrees of cells tried as a type (cell_type), by that type's vote."""
    parts = [rules.owner_map(ml.predict_vote(m, subtrees.filter(F.col("cell_type") == kind), names, len(LABELS))).withColumn("cell_type", F.lit(kind)) for kind, m in models.items()]
    return reduce(DataFrame.unionByName, parts) if parts else None


def train_branches(branches: DataFrame, names: list[str], trees: int, folds: int = 0) -> tuple[dict, dict]:
    """A model of branch labels for each cell type with training rows: a row for each label in a branch, weighted by its nodes; and, if
    branches have folds of whole cells, the calibration of its probabilities on cells that it didn't see."""
    out, fits = {}, {}
    for kind in rules.TYPE_ORDER:
        valid = (2, 3, 4) if kind == "pyramidal" else (2, 3)
        own = metrics.rows_per_label(branches.filter(F.col("cell_type") == kind), valid)
        if not own.isEmpty():
            own = checkpointed(own.withColumn("label", (F.col("label") - 2).cast("double")))
            out[kind] = ml.train_labels(own, names, weight="weight", trees=trees)
            if folds > 1:
                fits[kind] = ml.calibration(own, names, len(valid), k=folds, trees=trees, weight="weight")
    return out, fits


def pick_model(models: dict, kind: str, defaults: dict | None = None):
    """The type's model, else None where the type has a default label, else any that there is."""
    if kind in models or kind in (defaults or {}):
        return models.get(kind)
    return next(iter(models.values()), None)


def graph_rows(topo: DataFrame, cut: float | None = CUT) -> tuple[DataFrame, DataFrame, list[str]]:
    """Branches of pyramidal cells as vertices of a graph (cell_id, id, y: 0 basal, 1 apical, and features), edges between those that
    touch, in both directions, and the features' names."""
    topo = topo.filter("cell_type = 'pyramidal'")
    branches, names = branch_table(topo, cut)
    vertices = prep.branch_labels(branches.withColumnRenamed("gt_label", "gt")).withColumn("id", F.col("branch").cast("long"))
    return vertices, _graph_edges(topo, cut), names


def _graph_edges(topo: DataFrame, cut: float | None) -> DataFrame:
    edges = forest.branch_edges(forest.branches(topo, cut))
    return checkpointed(edges.select("cell_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))


def by_graph(decoded: DataFrame, said: DataFrame) -> DataFrame:
    """Decoded branches of cells that have both basal and apical ones, with these two told by a graph network; the network's
    confidence counts where it changes a label. said: cell_id, id (the branch), probability of basal and of apical."""
    p = F.col("probability")
    said = said.select("cell_id", F.col("id").alias("branch"), F.when(p[1] > p[0], 4).otherwise(3).alias("gnn"), F.array_max(p).alias("_sure"))
    out = rules.override(decoded.withColumn("_before", F.col("pred")).join(said, ["cell_id", "branch"], "left"))
    return out.withColumn("conf", F.when(F.col("pred") != F.col("_before"), F.col("_sure")).otherwise(F.col("conf"))).select(*decoded.columns)


def train_bundle(topo: DataFrame, trees: int = 100, folds: int = 0, seed: int = 42, graph_epochs: int = 0, hidden: int = 64) -> Bundle:
    """Models of cell types, owners and branches, fitted on all cells of a topology; with graph_epochs also a graph network of
    that many epochs and so many hidden units, on pyramidal cells.

    folds: branches learn with owners as these are told for new cells, by models fitted on the other folds of whole cells, and
    their probabilities are calibrated on such folds; with 0 or 1 owners are told by the models that are used later, which saw the
    same cells, and nothing is calibrated.
    """
    cells, (branches, branch_names), (subtrees, subtree_names) = cell_table(topo), branch_table(topo), subtree_table(topo)
    learn = cells.withColumn("label", (F.col("cell_type") == CELL_CLASSES[1]).cast("double"))
    cell_type = ml.train_cell_type(learn, list(CELL_MEASURES), trees=trees) if learn.select("label").distinct().count() > 1 else None
    owner_models = train_owners(subtrees, subtree_names, trees)
    if folds > 1:
        of = checkpointed(prep.folds(cells.select("cell_id", "cell_type").withColumn("file_name", F.col("cell_id").cast("string")), folds, seed).select("cell_id", "fold"))
        branches = branches.join(of, "cell_id")
        dealt, parts = checkpointed(subtrees.join(of, "cell_id")), []
        for k in range(folds):
            got = owners_of(dealt.filter(F.col("fold") == k), train_owners(dealt.filter(F.col("fold") != k), subtree_names, trees), subtree_names)
            parts += [] if got is None else [got]
        known = reduce(DataFrame.unionByName, parts) if parts else None
    else:
        known = owners_of(subtrees, owner_models, subtree_names)
    names = [*branch_names, *rules.OWNER_FEATURES]
    branch_models, fits = ({}, {}) if known is None else train_branches(rules.with_owner(branches, checkpointed(known)), names, trees, folds)
    network = graph.fit(*graph_rows(topo), epochs=graph_epochs, hidden=hidden, seed=seed) if graph_epochs else None
    return Bundle({"cell": list(CELL_MEASURES), "subtree": subtree_names, "branch": names}, cell_type, owner_models, branch_models, network, fits, {"purkinje": 3}, {"cut": CUT})


def _trials(cells: DataFrame, models: list | None, threshold: float) -> DataFrame:
    """cell_id, cell_type (tried), own_type, type_conf: each cell as the type that models or rules say, and as every type where they aren't sure."""
    said = ml.detect_cell_type(cells, list(CELL_MEASURES), models)
    said = said.select("cell_id", F.col("guess").alias("own_type"), F.greatest("p_pyramidal", "p_interneuron").alias("type_conf"))
    return said.withColumn("cell_type", F.explode(F.array(*map(F.lit, rules.TYPE_ORDER)))).filter((F.col("cell_type") == F.col("own_type")) | (F.col("type_conf") < threshold))


def label_nodes(
    topo: DataFrame, bundle: Bundle | None = None, threshold: float = 0.65, by_subtree: bool = False, known_types: bool = False, owners: DataFrame | None = None
) -> DataFrame:
    """Labels all cells of a topology with a bundle's models: cell_id, cell_type (as given), used_type, id, type, s2 (decoded), s23 (refined), conf.

    Without a bundle types are told by rules and branches are basal. by_subtree: branches take their primary subtree's label in
    place of a label of their own. known_types: cells are labelled as what they are; else their type is predicted, and tried both ways
    where its probability is below the threshold. owners: cell_id, primary_root and probability, in place of the models'.
    """
    bundle, topo = bundle or Bundle({}), topo.drop("pred", "conf")
    # what a cell is tried as
    if known_types:
        trials = topo.select("cell_id", "cell_type").distinct().select("cell_id", "cell_type", F.col("cell_type").alias("own_type"), F.lit(1.0).alias("type_conf"))
    else:
        trials = _trials(cell_table(topo).drop("cell_type"), bundle.cell_type, threshold)
    trials = checkpointed(trials)
    tried = trials.select("cell_id", "cell_type")
    (branches, branch_names), owner_rows = branch_table(topo, bundle.settings.get("cut", CUT)), None
    if owners is not None:
        owner_rows = rules.owner_map(owners).join(tried, "cell_id")
    elif bundle.owners:
        subtrees, subtree_names = subtree_table(topo)
        if subtree_names != bundle.names["subtree"]:
            raise ValueError("the bundle's owners were fitted on other features")
        owner_rows = owners_of(subtrees.drop("cell_type").join(tried, "cell_id"), bundle.owners, subtree_names)
    none = topo.select("cell_id", "primary_root", *(F.lit(0.0).alias(f"prob_{k}") for k in rules.NEURITE), F.lit(3).alias("pred"), F.lit(0.5).alias("conf"), "cell_type").limit(0)
    owner_rows = none if owner_rows is None else checkpointed(owner_rows)
    names = [*branch_names, *rules.OWNER_FEATURES]
    if bundle.branches and names != bundle.names["branch"]:
        raise ValueError("the bundle's branches were fitted on other features")
    branches, parts = branches.drop("cell_type").join(tried, "cell_id"), []
    for kind in rules.TYPE_ORDER:
        own, of = branches.filter(F.col("cell_type") == kind), owner_rows.filter(F.col("cell_type") == kind).drop("cell_type")
        model = pick_model(bundle.branches, kind, bundle.defaults)
        if by_subtree:
            got = rules.subtree_mode(own, of)
        elif model is None:
            got = own.withColumn("pred", F.lit(bundle.defaults.get(kind, NO_MODEL))).withColumn("conf", F.lit(0.5))
        else:
            got = ml.predict_labels(model, rules.with_owner(own, of), names)
            if model is bundle.branches.get(kind) and kind in bundle.calibrations:
                got = ml.calibrate(got, bundle.calibrations[kind])
            got = rules.decode(got.withColumn("probability", _probability()))
        got = got.select("cell_id", "cell_type", "branch", "pred", "conf")
        if bundle.graph and kind == rules.TYPE_ORDER[0]:
            if bundle.graph.names != branch_names:
                raise ValueError("the bundle's graph network was fitted on other features")
            edges = _graph_edges(topo, bundle.settings.get("cut", CUT)).join(own.select("cell_id").distinct(), "cell_id")
            got = by_graph(got, graph.predict(bundle.graph, own.withColumn("id", F.col("branch").cast("long")), edges))
        parts.append(got)
    decoded = checkpointed(reduce(DataFrame.unionByName, parts))
    # the type that stays
    sure = decoded.groupBy("cell_id", "cell_type").agg(F.avg("conf").alias("branch_conf"))
    chosen = rules.soft_handoff(trials.join(sure, ["cell_id", "cell_type"], "left").na.fill(0.0, ["branch_conf"]), threshold)
    chosen = checkpointed(chosen.select("cell_id", F.col("cell_type").alias("used_type")))
    decoded = decoded.join(chosen.withColumnRenamed("used_type", "cell_type"), ["cell_id", "cell_type"])
    truth = topo.select("cell_id", F.col("cell_type").alias("true_type")).distinct()
    needed = [c for c in (*rules.REFINED, "type") if c not in ("cell_type", "pred", "conf")]
    rows = topo.select(*needed).join(chosen.withColumnRenamed("used_type", "cell_type"), "cell_id")
    s2 = checkpointed(rules.strip_soma(rules.to_nodes(rows, forest.branches(topo, bundle.settings.get("cut", CUT)), decoded)))
    apical = rules.apical_owner(owner_rows.filter("cell_type = 'pyramidal'").join(chosen.filter("used_type = 'pyramidal'"), "cell_id"))
    final = rules.refine(s2.select(*rules.REFINED), apical)
    out = s2.select("cell_id", F.col("cell_type").alias("used_type"), "id", "type", F.col("pred").alias("s2"), "conf").join(final.select("cell_id", "id", F.col("pred").alias("s23")), ["cell_id", "id"])
    return out.join(truth.withColumnRenamed("true_type", "cell_type"), "cell_id")


def in_parts(topo: DataFrame, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The topologies of the cells to learn from and of the test cells, split by the hash of the cell's id."""
    files = topo.select("cell_id", "cell_type").distinct().withColumn("file_name", F.col("cell_id").cast("string"))
    said, by_hash = checkpointed(prep.split(files, share, seed).select("cell_id", "is_test")), in_test(F.col("cell_id").cast("string"), share, seed)
    # rows tell by themselves where they belong; only a type's first cell may be moved, so no rows are exchanged
    moved = [r[0] for r in said.filter(F.col("is_test") & ~by_hash).select("cell_id").distinct().collect()]  # one for each type at most
    untyped = checkpointed(files.filter("cell_type IS NULL").select("cell_id").join(said, "cell_id", "left_anti"))
    rows = topo if untyped.isEmpty() else topo.join(untyped, "cell_id", "left_anti")
    test = by_hash | F.col("cell_id").isin(moved)
    return rows.filter(~test), rows.filter(test)


def label_cells(nodes: DataFrame, share: float = 0.2, seed: int = 42, trees: int = 20, threshold: float = 0.65, by_subtree: bool = False, known_types: bool = False, folds: int = 0) -> DataFrame:
    """Trains a bundle on some cells and labels the others; see train_bundle() and label_nodes(), and in_parts() for the split."""
    learn, test = in_parts(checkpointed(forest.topology(nodes)), share, seed)
    return label_nodes(checkpointed(test), train_bundle(checkpointed(learn), trees, folds, seed), threshold, by_subtree, known_types)


def evaluate(labelled: DataFrame) -> DataFrame:
    """stage, cell_type, n and metrics, before and after refinement."""
    stages = [metrics.summary(metrics.confusion(labelled, ["cell_type"], "type", c), ["cell_type"]).withColumn("stage", F.lit(c)) for c in ("s2", "s23")]
    return stages[0].unionByName(stages[1])


def file_table(labelled: DataFrame) -> DataFrame:
    """The scores of each cell with enough nodes, before and after refinement, worst first."""
    rows = labelled.withColumn("path", F.col("cell_id").cast("string"))
    parts = [metrics.summary(metrics.confusion(rows, ["path", "cell_type"], "type", c), ["path", "cell_type"]).select("path", "cell_type", F.col("n").alias("n_nodes"), F.col("neurite_macro_f1").alias("f1")) for c in ("s2", "s23")]
    enough = rows.filter("type != 1").groupBy("path").agg(F.count(F.lit(1)).alias("k")).filter("k >= 50").select("path")
    return metrics.per_file_table(*parts).join(enough, "path", "left_semi")
