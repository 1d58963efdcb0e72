"""Feature tables: whole cells, primary subtrees, branches, and the sets of three baselines.

All take a topology (see forest.topology), best checkpointed, and are aggregations over it. Means and deviations are
those of the population. Every ratio has its own default where it isn't defined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .forest import branches, label_mode, rank_share, stack_order, strahler, subtree_stats, trunk

CELL = ["cell_id"]
TREE = ["cell_id", "primary_root"]


def _ratio(a: Column, b: Column, default: float, eps: float = 1e-9) -> Column:
    return F.when(b > eps, a / b).otherwise(F.lit(default))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def with_soma(topo: DataFrame) -> DataFrame:
    """Adds is_proxy, radial (distance to the proxy) and dx, dy, dz."""
    d = topo.withColumn("dx", F.col("x") - F.col("sx")).withColumn("dy", F.col("y") - F.col("sy")).withColumn("dz", F.col("z") - F.col("sz"))
    return d.withColumn("radial", F.sqrt(F.pow("dx", F.lit(2)) + F.pow("dy", F.lit(2)) + F.pow("dz", F.lit(2)))).withColumn("is_proxy", F.col("id") == F.col("proxy"))


def _aggregated(topo: DataFrame, *parts) -> DataFrame:
    """Several sets of features from one aggregation by cell. A part: aggregates over with_soma(topo), and what follows from them."""
    out = with_soma(topo).groupBy(*CELL).agg(*(c for aggregates, _ in parts for c in aggregates()))
    for _, more in parts:
        out = more(out)
    return out


def _count_aggregates() -> list[Column]:
    n = F.count(F.lit(1))
    trees = F.count_if(~F.col("is_root") & (F.col("parent") == F.col("proxy")))
    forks, tips = F.count_if(F.col("n_children") >= 2), F.count_if((F.col("n_children") == 0) & ~F.col("is_root"))
    return [
        n.alias("n_nodes"), F.count_if("is_root").alias("n_root_nodes"), forks.alias("n_branch_points"), tips.alias("n_terminals"),
        F.when(trees > 0, trees).otherwise(F.greatest(F.count_if("is_root") - 1, F.lit(0))).alias("n_primary_subtrees"), (forks / n).alias("branch_point_ratio"), (tips / n).alias("terminal_ratio"),
    ]


def _path_aggregates() -> list[Column]:
    path = F.when(~F.col("is_proxy"), F.col("path"))
    return [
        _zero(F.max(path)).alias("max_path_length"), _zero(F.avg(path)).alias("mean_path_length"), _zero(F.stddev_pop(path)).alias("std_path_length"),
        F.max("radial").alias("max_radial_distance"), F.avg("radial").alias("mean_radial_distance"), F.stddev_pop("radial").alias("std_radial_distance"),
        F.coalesce(F.avg(F.when(~F.col("is_proxy") & (F.col("radial") > 1e-6), F.col("path") / F.col("radial"))), F.lit(1.0)).alias("path_radial_ratio_mean"),
    ]


def _radius_aggregates() -> list[Column]:
    r = F.when(~F.col("is_proxy"), F.col("radius"))
    return [_zero(F.avg(r)).alias("mean_radius"), _zero(F.stddev_pop(r)).alias("std_radius"), _zero(F.max(r)).alias("max_radius")]


def _extent_aggregates() -> list[Column]:
    return [
        (F.max("z") - F.min("z")).alias("z_span"), F.greatest(F.lit(0.0), F.max("dz")).alias("z_max_above_soma"), F.greatest(F.lit(0.0), -F.min("dz")).alias("z_max_below_soma"),
        (F.max("x") - F.min("x")).alias("x_span"), (F.max("y") - F.min("y")).alias("y_span"),
    ]


def _extent_ratios(got: DataFrame) -> DataFrame:
    got = got.withColumn("z_asymmetry", _ratio(F.col("z_max_above_soma") - F.col("z_max_below_soma"), F.col("z_span"), 0.0))
    return got.withColumn("xy_aspect_ratio", _ratio(F.greatest("x_span", "y_span"), F.least("x_span", "y_span"), 1.0))


def _terminal_aggregates() -> list[Column]:
    r = F.when((F.col("n_children") == 0) & ~F.col("is_root"), F.col("radial"))
    return [_zero(F.avg(r)).alias("terminal_radial_mean"), _zero(F.stddev_pop(r)).alias("terminal_radial_std")]


COUNTS = (_count_aggregates, lambda d: d)
PATHS = (_path_aggregates, lambda d: d)
RADIUS = (_radius_aggregates, lambda d: d.withColumn("radius_cv", _ratio(F.col("std_radius"), F.col("mean_radius"), 0.0)))
EXTENT = (_extent_aggregates, _extent_ratios)
TERMINALS = (_terminal_aggregates, lambda d: d)


def cell_counts(topo: DataFrame) -> DataFrame:
    """Numbers of nodes, roots, forks, tips and primary subtrees (those of other roots if nothing is below the proxy), and the shares
    of forks and tips."""
    return _aggregated(topo, COUNTS)


def cell_paths(topo: DataFrame) -> DataFrame:
    """Path and radial statistics and their mean ratio."""
    return _aggregated(topo, PATHS)


def cell_radius(topo: DataFrame) -> DataFrame:
    return _aggregated(topo, RADIUS)


def cell_extent(topo: DataFrame) -> DataFrame:
    """Spans along the axes, and the balance above and below the soma."""
    return _aggregated(topo, EXTENT)


def covariance(rows: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """keys, n and the six covariances of x, y, z."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *_covariances())


def _covariances() -> list[Column]:
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    return [F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in pairs]


def eigenvalues(cov: DataFrame) -> DataFrame:
    """l1 >= l2 >= l3 of the covariances, in closed form."""
    q = (F.col("cxx") + F.col("cyy") + F.col("czz")) / 3
    p1 = F.pow("cxy", F.lit(2)) + F.pow("cxz", F.lit(2)) + F.pow("cyz", F.lit(2))
    p2 = F.pow(F.col("cxx") - q, 2) + F.pow(F.col("cyy") - q, 2) + F.pow(F.col("czz") - q, 2) + 2 * p1
    t = cov.withColumn("_q", q).withColumn("_p", F.sqrt(p2 / 6))
    a, b, c = ((F.col(k) - F.col("_q")) / F.col("_p") for k in ("cxx", "cyy", "czz"))
    d, e, f = (F.col(k) / F.col("_p") for k in ("cxy", "cxz", "cyz"))
    det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
    t = t.withColumn("_a", F.when(F.col("_p") > 1e-12, angle).otherwise(0.0))
    t = t.withColumn("l1", F.col("_q") + 2 * F.col("_p") * F.cos("_a")).withColumn("l3", F.col("_q") + 2 * F.col("_p") * F.cos(F.col("_a") + 2 * np.pi / 3))
    return t.withColumn("l2", 3 * F.col("_q") - F.col("l1") - F.col("l3")).drop("_q", "_p", "_a")


def _shape_aggregates() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *_covariances()]


def _shape_ratios(cov: DataFrame) -> DataFrame:
    e = eigenvalues(cov)
    ok = (F.col("n") >= 3) & (F.col("l1") > 1e-12)
    ratios = {"planarity": (F.col("l2") - F.col("l3")) / F.col("l1"), "linearity": (F.col("l1") - F.col("l2")) / F.col("l1"), "thickness_ratio": F.col("l3") / F.col("l1")}
    return e.withColumns({k: F.when(ok, v).otherwise(0.0) for k, v in ratios.items()}).drop("n", "cxx", "cyy", "czz", "cxy", "cxz", "cyz", "l1", "l2", "l3")


SHAPE = (_shape_aggregates, _shape_ratios)


def cell_shape(topo: DataFrame) -> DataFrame:
    """Planarity, linearity and thickness from the eigenvalues; 0 for cells of fewer than three nodes."""
    return _aggregated(topo, SHAPE)


def principal_axis(rows: DataFrame, least: int = 3) -> DataFrame:
    """cell_id, ax, ay, az, strength: the first eigenvector of each cell's points, turned so that its largest part is positive.

    A covariance is one row for each cell; only these small matrices go to numpy. Fewer than `least` points: +z, 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = np.array([[[r.cxx, r.cxy, r.cxz], [r.cxy, r.cyy, r.cyz], [r.cxz, r.cyz, r.czz]] for r in pdf.itertuples()]).reshape(-1, 3, 3)
            ok = (pdf["n"].to_numpy() >= least) & np.isfinite(m).all(axis=(1, 2))
            values, vectors = np.linalg.eigh(np.where(ok[:, None, None], m, 0.0))
            axis = vectors[:, :, 2]
            axis = axis * np.sign(axis[np.arange(len(axis)), np.abs(axis).argmax(axis=1)])[:, None]
            total = values.sum(axis=1)
            ok &= total > 1e-12
            axis = np.where(ok[:, None], axis, [0.0, 0.0, 1.0])
            yield pd.DataFrame({"cell_id": pdf["cell_id"], "ax": axis[:, 0], "ay": axis[:, 1], "az": axis[:, 2], "strength": np.where(ok, values[:, 2] / np.where(total > 0, total, 1), 0.0)})

    kind = dict(rows.dtypes)["cell_id"]
    return covariance(rows).mapInPandas(run, f"cell_id {kind}, ax double, ay double, az double, strength double")


def cell_principal(topo: DataFrame) -> DataFrame:
    """Spans and balance along the first axis, turned towards the mean of the nodes, and the best aligned primary subtree."""
    axis = principal_axis(topo).drop("strength")
    t = with_soma(topo).join(axis, "cell_id").withColumn("p", F.col("dx") * F.col("ax") + F.col("dy") * F.col("ay") + F.col("dz") * F.col("az"))
    turn = t.groupBy(*CELL).agg(F.when(F.avg("p") < 0, -1.0).otherwise(1.0).alias("turn"))
    t = t.join(turn, "cell_id").withColumn("p", F.col("p") * F.col("turn"))
    whole = t.groupBy(*CELL).agg(
        (F.max("p") - F.min("p")).alias("pc1_span"), F.greatest(F.lit(0.0), F.max("p")).alias("pc1_max_above_soma"), F.greatest(F.lit(0.0), -F.min("p")).alias("pc1_max_below_soma"), F.max(F.abs("p")).alias("pc1_radial_max"),
    ).withColumn("pc1_asymmetry", _ratio(F.col("pc1_max_above_soma") - F.col("pc1_max_below_soma"), F.col("pc1_span"), 0.0))
    trees = t.filter("primary_root IS NOT NULL").groupBy(*TREE).agg(F.avg("p").alias("m"), F.sum(F.abs("p")).alias("mass"))
    top = trees.groupBy(*CELL).agg(F.max_by(F.struct("m", "mass"), F.struct("m", -F.col("primary_root"))).alias("t"), F.sum("mass").alias("all_mass"))
    got = whole.join(top, "cell_id", "left")
    return got.withColumn("subtree_pc1_concentration", _zero(_ratio(F.col("t.mass"), F.col("all_mass"), 0.0))).withColumn("subtree_pc1_top_alignment", _zero(_ratio(F.col("t.m"), F.col("pc1_radial_max"), 0.0))).drop("t", "all_mass")


def cell_subtrees(topo: DataFrame) -> DataFrame:
    """Sizes and paths of the primary subtrees of a cell; of the trees of its other roots if nothing is below the proxy."""
    trees = topo.filter("reached").groupBy(*TREE, "root", "proxy").agg(F.count(F.lit(1)).alias("n"), F.max("path").alias("p"))
    below = trees.groupBy(*CELL).agg(F.max(F.col("primary_root").isNotNull()).alias("_below"))
    trees = trees.join(below, "cell_id").filter((F.col("_below") & F.col("primary_root").isNotNull()) | (~F.col("_below") & (F.col("root") != F.col("proxy"))))
    got = trees.groupBy(*CELL).agg(F.max("n").alias("max_subtree_size"), F.min("n").alias("min_subtree_size"), F.stddev_pop("n").alias("subtree_size_std"), F.max("p").alias("max_subtree_path"), F.stddev_pop("p").alias("subtree_path_std"), F.sum("n").alias("_n"), F.sum("p").alias("_p"))
    got = got.withColumn("max_subtree_size_ratio", _ratio(F.col("max_subtree_size"), F.col("_n"), 0.0)).withColumn("max_subtree_path_ratio", _ratio(F.col("max_subtree_path"), F.col("_p"), 0.0))
    return topo.select("cell_id").distinct().join(got.drop("_n", "_p"), "cell_id", "left").na.fill(0)


def sholl_histogram(topo: DataFrame, bins: int = 20) -> DataFrame:
    """cell_id, bin, n: nodes but roots by radial distance, in even bins up to the largest; empty bins are there too."""
    t = with_soma(topo).filter("parent != -1").select("cell_id", "radial")
    top = t.groupBy(*CELL).agg(F.max("radial").alias("top")).filter("top >= 1e-6")
    b = t.join(top, "cell_id").select("cell_id", F.least(F.floor(F.col("radial") / F.col("top") * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    n = b.groupBy("cell_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    every = top.select("cell_id", "top", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(n, ["cell_id", "bin"], "left").select("cell_id", "bin", F.coalesce("n", F.lit(0)).alias("n"), "top")


def cell_sholl(topo: DataFrame, bins: int = 20) -> DataFrame:
    """Largest count, the middle of its bin, and by how much the later bins fall below it."""
    h = sholl_histogram(topo, bins)
    peak = h.groupBy(*CELL).agg(F.max_by(F.struct("bin", "n", "top"), F.struct("n", -F.col("bin"))).alias("k"))
    after = h.join(peak, "cell_id").filter("bin > k.bin").groupBy(*CELL).agg(F.avg("n").alias("later"))
    got = topo.select("cell_id").distinct().join(peak, "cell_id", "left").join(after, "cell_id", "left")
    return got.select("cell_id", _zero(F.col("k.n").cast("double")).alias("sholl_max_intersections"), _zero((F.col("k.bin") + 0.5) * F.col("k.top") / bins).alias("sholl_peak_distance"), _zero(F.when(F.col("k.n") > 0, (F.col("k.n") - F.col("later")) / F.col("k.n"))).alias("sholl_decay_rate"))


def cell_terminals(topo: DataFrame) -> DataFrame:
    """Radial distances of the tips."""
    return _aggregated(topo, TERMINALS)


def cell_strahler(topo: DataFrame) -> DataFrame:
    return strahler(topo).groupBy(*CELL).agg(F.max("strahler").alias("max_strahler"), F.avg("strahler").alias("mean_strahler"))


def cell_features(topo: DataFrame) -> DataFrame:
    """All 49 features of each cell; what is keyed by cell alone comes from one aggregation."""
    out = _aggregated(topo, COUNTS, PATHS, RADIUS, EXTENT, SHAPE, TERMINALS)
    for part in (cell_subtrees, cell_strahler, cell_sholl, cell_principal):
        out = out.join(part(topo), "cell_id", "left")
    return out.na.fill(0)


def subtree_features(topo: DataFrame) -> DataFrame:
    """The features of each primary subtree, by cell_id and primary_root. Its first leaves are those that a stack gives away first."""
    order = stack_order(topo)
    inside = with_soma(topo).filter("primary_root IS NOT NULL")
    t = inside.join(order.select("cell_id", "id", "tip_place"), ["cell_id", "id"])
    root = t.filter("id = primary_root").select(*TREE, F.col("seq").alias("root_seq"), F.col("path").alias("root_path"), F.col("depth").alias("root_depth"), F.col("radius").alias("root_radius"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"), F.col("radial").alias("root_radial_dist"), F.col("tip_place").alias("_first"))
    t = t.join(root, TREE)
    away = F.sqrt(F.pow(F.col("x") - F.col("rx"), 2) + F.pow(F.col("y") - F.col("ry"), 2) + F.pow(F.col("z") - F.col("rz"), 2))
    t = t.withColumn("away", away)
    leaf = F.col("n_children") == 0
    t = t.withColumn("leaf_no", F.when(leaf, F.col("tip_place") - F.col("_first") + 1))
    # grouped by the keys that it was joined by alone, so that rows needn't be sorted anew
    g = t.groupBy(*TREE).agg(
        *(F.max(c).alias(c) for c in ("root_seq", "root_path", "root_radius", "root_radial_dist")),
        F.count(F.lit(1)).alias("size"), F.max(F.col("depth") - F.col("root_depth")).alias("depth"), F.max(F.col("path") - F.col("root_path")).alias("max_path"), F.max("away").alias("max_radial"),
        F.avg("radius").alias("mean_radius"), F.stddev_pop("radius").alias("std_radius"), F.min("radius").alias("min_radius"),
        F.avg(F.when(F.col("leaf_no") <= 3, F.col("radius"))).alias("_leaf_radius"), F.avg("dz").alias("mean_z_rel"), (F.max("z") - F.min("z")).alias("z_span"),
        F.max_by(F.struct("z", "away", "rz"), F.when(leaf, F.struct("dz", -F.col("seq")))).alias("_top"),
        F.avg((F.col("n_children") >= 2).cast("double")).alias("branch_density"), F.avg(leaf.cast("double")).alias("terminal_density"),
    )
    w, all_rows = Window.partitionBy("cell_id"), inside.groupBy(*CELL).agg(F.avg("radius").alias("_cell_radius"))
    g = g.join(all_rows, "cell_id")
    up = F.col("_top.z") - F.col("_top.rz")
    clamp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (up / F.col("_top.away") + 1) / 2))
    g = g.withColumn("taper", _ratio(F.col("_leaf_radius"), F.col("root_radius"), 1.0)).withColumn("up_alignment", F.when(F.col("_top.away") > 1e-9, clamp).otherwise(0.5))
    for c in ("size", "max_path", "z_span"):
        g = g.withColumn(f"{c}_ratio", _ratio(F.col(c), F.max(c).over(w), 0.0))
    g = g.withColumn("radius_ratio", _ratio(F.col("mean_radius"), F.col("_cell_radius"), 1.0))
    first = F.row_number().over(w.orderBy(F.desc("max_path"), "root_seq"))
    g = g.withColumn("is_longest_subtree", (first == 1).cast("int")).withColumn("z_rank", rank_share("mean_z_rel", CELL, F.col("root_seq"))).withColumn("radius_rank", rank_share("root_radius", CELL, F.col("root_seq"))).withColumn("n_primary", F.count(F.lit(1)).over(w))
    return g.withColumnRenamed("root_path", "root_path_dist").drop("_leaf_radius", "_top", "_cell_radius", "root_seq")


def branch_geometry(topo: DataFrame, cut: float | None = None) -> DataFrame:
    """Geometry of each branch (B1-B7, B9, B10, B12, B13, B17-B19): a row for cell_id, branch."""
    more = ("parent", "proxy", "primary_root", "branch_order", "n_children", "x", "y", "z", "radius", "edge", "path", "radial", "dx", "dy", "dz", "sx", "sy", "sz")
    of_parent = {"ax": "px", "ay": "py", "az": "pz", "anchor_radius": "parent_radius", "anchor_children": "parent_children"}
    w = Window.partitionBy("cell_id", "branch")
    t = branches(with_soma(topo), cut, (*more, *of_parent.values())).withColumnRenamed("pos", "p").withColumn("n", F.count(F.lit(1)).over(w))
    # the anchor is the parent of a branch's first node, so it is known there, and rows go by branch alone
    t = t.withColumn("_a", F.max(F.when(F.col("p") == 0, F.struct(*of_parent.values()))).over(w)).drop(*of_parent.values())
    t = t.select("*", *(F.col(f"_a.{v}").alias(c) for c, v in of_parent.items()))
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    to_anchor = F.sqrt(F.pow(F.col("x") - F.col("ax"), 2) + F.pow(F.col("y") - F.col("ay"), 2) + F.pow(F.col("z") - F.col("az"), 2))
    first, last = F.col("p") == 0, F.col("p") == F.col("n") - 1
    mid = F.col("p") == F.floor(F.col("n") / 2)
    near, far = F.col("p") < third, F.col("p") >= F.col("n") - third
    g = t.groupBy("cell_id", "branch", "anchor", "anchor_radius", "anchor_children", "proxy", "sx", "sy", "sz").agg(
        F.sum(F.when(F.col("p") > 0, F.col("edge")).otherwise(0.0)).alias("path_length"), F.max(to_anchor).alias("radial_extent"), F.count(F.lit(1)).alias("n_nodes"),
        F.avg("radius").alias("mean_radius"), F.stddev_pop("radius").alias("std_radius"), F.min("radius").alias("min_radius"), F.max("radius").alias("max_radius"),
        F.avg(F.when(F.col("p") < 3, F.col("radius"))).alias("_prox"), F.avg(F.when(F.col("p") >= F.col("n") - 3, F.col("radius"))).alias("_dist"),
        F.max(F.when(first, F.struct("x", "y", "z", "radius", "branch_order"))).alias("_f"), F.max(F.when(last, F.struct("x", "y", "z"))).alias("_l"),
        F.avg((F.col("n_children") >= 2).cast("double")).alias("branchiness"), F.max(F.when(mid, F.col("path"))).alias("root_path_dist"), F.max(F.when(mid, F.col("radial"))).alias("root_radial_dist"), F.max(F.when(mid, F.struct("dx", "dy", "dz", "radial"))).alias("_m"),
        F.avg("dz").alias("z_rel_soma"), (F.max("z") - F.min("z")).alias("z_span"), F.avg((F.col("radius") < 0.5).cast("double")).alias("thin_fraction"),
        F.avg(F.when(near, F.col("radius"))).alias("proximal_mean_radius"), F.avg(F.when(far, F.col("radius"))).alias("distal_mean_radius"),
        F.sum(F.when(near & (F.col("p") > 0), F.col("edge"))).alias("_np"), F.sum(F.when(far & (F.col("p") > F.col("n") - third), F.col("edge"))).alias("_fp"),
        F.max(F.when(F.col("p") == third - 1, F.struct("x", "y", "z"))).alias("_n1"), F.max(F.when(F.col("p") == F.col("n") - third, F.struct("x", "y", "z"))).alias("_f0"),
        F.count_if(F.col("n_children") >= 2).alias("_forks"), F.max(F.when(first, (F.col("parent") == F.col("proxy")).cast("int"))).alias("is_primary"),
        F.max("primary_root").alias("primary_root"),
    )
    chord = F.sqrt(F.pow(F.col("_l.x") - F.col("_f.x"), 2) + F.pow(F.col("_l.y") - F.col("_f.y"), 2) + F.pow(F.col("_l.z") - F.col("_f.z"), 2))
    g = g.withColumn("_chord", chord).withColumn("taper_ratio", _ratio(F.col("_dist"), F.col("_prox"), 1.0)).withColumn("persistence", _ratio(F.col("_chord"), F.col("path_length"), 0.5))
    lift = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("_l.z") - F.col("_f.z")) / F.col("_chord") + 1) / 2))
    g = g.withColumn("up_alignment", F.when(F.col("_chord") > 1e-9, lift).otherwise(0.5))
    def between(a: str, b: str) -> Column:
        return F.sqrt(F.pow(F.col(f"{a}.x") - F.col(f"{b}.x"), 2) + F.pow(F.col(f"{a}.y") - F.col(f"{b}.y"), 2) + F.pow(F.col(f"{a}.z") - F.col(f"{b}.z"), 2))

    for name, a, b, way in (("proximal_persistence", "_f", "_n1", "_np"), ("distal_persistence", "_f0", "_l", "_fp")):
        g = g.withColumn(name, F.when((F.col("n_nodes") >= 3) & (F.col(way) > 1e-9), between(a, b) / F.col(way)).otherwise(F.col("persistence")))
    g = g.withColumn("bifurcations_per_micron", _ratio(F.col("_forks"), F.col("path_length"), 0.0)).withColumn("mean_internode_distance", F.when(F.col("n_nodes") > 1, F.col("path_length") / (F.col("n_nodes") - 1)).otherwise(0.0))
    soma = F.col("anchor") == F.col("proxy")
    g = g.withColumn("parent_radius", F.coalesce("anchor_radius", F.lit(0.0))).withColumn("radius_ratio_to_parent", _ratio(F.col("mean_radius"), F.col("anchor_radius"), 1.0))
    g = g.withColumn("n_siblings", F.when(soma, F.col("anchor_children") - 1).otherwise(F.col("anchor_children"))).withColumn("starts_at_soma", soma.cast("int")).withColumn("branch_order", F.col("_f.branch_order"))
    g = g.withColumn("radius_drop_at_anchor", F.coalesce(_ratio(F.col("anchor_radius") - F.col("_prox"), F.col("anchor_radius"), 0.0), F.lit(0.0)))
    g = g.withColumn("polar_angle_from_up", _angle(F.col("_m.dz"), F.col("_m.radial")))
    return g.withColumnRenamed("_m", "mid").drop("_prox", "_dist", "_f", "_l", "_chord", "_np", "_fp", "_n1", "_f0", "_forks", "anchor_radius", "anchor_children", "sx", "sy", "sz", "proxy")


def _angle(along: Column, length: Column) -> Column:
    """Angle between a vector and an axis, from its part along the axis; a right angle if it has no length."""
    return F.when(length > 1e-9, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), along / length)))).otherwise(np.pi / 2)


def branch_symmetry(topo: DataFrame) -> DataFrame:
    """cell_id, anchor, symmetry (B8): how alike the radii of a node's children are; 0.5 where their median is 0."""
    kids = topo.filter("NOT is_root").select("cell_id", F.col("parent").alias("anchor"), "radius")
    med = kids.groupBy("cell_id", "anchor").agg(F.percentile("radius", 0.5).alias("med"))
    mad = kids.join(med, ["cell_id", "anchor"]).groupBy("cell_id", "anchor", "med").agg(F.avg(F.abs(F.col("radius") - F.col("med"))).alias("mad"))
    return mad.select("cell_id", "anchor", F.when(F.col("med") > 1e-9, 1 - F.least(F.lit(1.0), F.col("mad") / F.col("med"))).otherwise(0.5).alias("symmetry"))


def branch_relative(topo: DataFrame, geometry: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Branch measures relative to the cell (B14) and to the primary subtree (B16, B20, B22, B25, B26, B27)."""
    t = with_soma(topo)
    cell = t.groupBy(*CELL).agg(F.max("path").alias("_mp"), F.max("radial").alias("_mr"), F.avg(F.when(~F.col("is_proxy"), F.col("radius"))).alias("_r"), F.count(F.lit(1)).alias("_n"), (F.max("z") - F.min("z")).alias("_z"))
    stats = checkpointed(subtree_stats(topo)) if stats is None else stats
    own = stats.select("cell_id", F.col("id").alias("branch"), "sub_size", "sub_max_depth", "sub_max_path")
    g = geometry.join(cell, "cell_id").join(own, ["cell_id", "branch"])
    g = g.withColumn("path_length_rel", _ratio(F.col("path_length"), F.col("_mp"), 0.0)).withColumn("radial_extent_rel", _ratio(F.col("radial_extent"), F.col("_mr"), 0.0))
    g = g.withColumn("radius_rel", _ratio(F.col("mean_radius"), F.col("_r"), 1.0)).withColumn("subtree_size_rel", F.col("sub_size") / F.col("_n")).withColumn("soma_z_offset_norm", F.col("z_rel_soma") / F.greatest(F.col("_z"), F.lit(1e-6)))
    sub = primary_measures(topo, stats)
    g = g.join(sub, TREE, "left")
    g = g.withColumn("path_to_first_bifurcation_norm", _ratio(_zero(F.col("_first_fork")), F.col("_mp"), 0.0)).withColumn("subtree_trunk_length_norm", _ratio(_zero(F.col("_trunk")), F.col("_mp"), 0.0))
    along = F.col("mid.dx") * F.col("ax") + F.col("mid.dy") * F.col("ay") + F.col("mid.dz") * F.col("az")
    g = g.withColumn("principal_axis_projection", along / F.col("_top")).withColumn("polar_angle_from_principal_axis", _angle(along, F.col("mid.radial")))
    return g.drop("_mp", "_mr", "_r", "_n", "_z", "_first_fork", "_trunk", "_top", "ax", "ay", "az", "mid")


def primary_measures(topo: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """By primary subtree: the longest one, shares and ranks of path, height and distance, polar spread, trunk and forks."""
    stats = checkpointed(subtree_stats(topo)) if stats is None else stats
    neurites = with_soma(topo).filter("NOT is_proxy")
    axis = outward_axis(neurites, 5)
    t = with_soma(topo).filter("primary_root IS NOT NULL").join(axis, "cell_id").withColumn("p", F.col("dx") * F.col("ax") + F.col("dy") * F.col("ay") + F.col("dz") * F.col("az"))
    polar = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("dz") / F.col("radial"))))
    forks = F.count_if(F.col("n_children") >= 2)
    g = t.groupBy(*TREE, "ax", "ay", "az", "_top", F.col("strength").alias("principal_axis_alignment_strength")).agg(
        F.min(F.when(F.col("id") == F.col("primary_root"), F.col("seq"))).alias("_seq"), F.max("path").alias("_path"), F.avg("dz").alias("_z"), F.max("radial").alias("_radial"), F.avg("p").alias("subtree_principal_projection"),
        F.stddev_pop(F.when(F.col("radial") > 1e-9, polar)).alias("primary_subtree_polar_spread"), ((F.max("z") - F.min("z")) / F.greatest(F.sqrt(F.pow(F.max("x") - F.min("x"), 2) + F.pow(F.max("y") - F.min("y"), 2)), F.lit(1e-6))).alias("vertical_horizontal_span_ratio"),
        (F.max("z") - F.min("z")).alias("_span"), F.sum(F.when(F.col("id") != F.col("primary_root"), F.col("edge")).otherwise(0.0)).alias("_cable"), forks.alias("_forks"), F.min("radius").alias("min_radius_in_subtree"),
    )
    w = Window.partitionBy("cell_id")
    g = g.withColumn("is_longest_subtree", (F.col("_path") >= F.max("_path").over(w) - 1e-9).cast("int"))
    g = g.withColumn("subtree_path_ratio", _ratio(F.col("_path"), F.max("_path").over(w), 1.0)).withColumn("subtree_z_ratio", _ratio(F.col("_span"), F.max("_span").over(w), 0.0))
    g = g.withColumn("subtree_z_rank", rank_share("_span", CELL, F.col("_seq"))).withColumn("subtree_max_radial_rank", rank_share("_radial", CELL, F.col("_seq"))).withColumn("subtree_principal_rank", rank_share("subtree_principal_projection", CELL, F.col("_seq")))
    g = g.withColumn("subtree_principal_projection", F.col("subtree_principal_projection") / F.col("_top"))
    score = F.when(F.col("_z") > 0, F.col("_z") + 0.1 * F.col("_span"))
    g = g.withColumn("is_trunk_primary", (score.isNotNull() & (F.row_number().over(w.orderBy(score.desc_nulls_last(), "_seq")) == 1)).cast("int"))
    g = g.withColumn("subtree_bifurcations_per_micron", _ratio(F.col("_forks"), F.col("_cable"), 0.0))
    length = trunk(topo, stats).groupBy(*TREE).agg((F.max("path") - F.min("path")).alias("_trunk"))
    first = stats.select("cell_id", F.col("id").alias("primary_root"), F.col("sub_first_fork").alias("_first_fork"))
    g = g.join(length, TREE, "left").join(first, TREE, "left").withColumn("subtree_trunk_fraction", _ratio(F.col("_trunk"), F.col("_cable"), 0.0))
    return g.drop("_seq", "_path", "_z", "_radial", "_span", "_cable", "_forks").na.fill(0.0, ["primary_subtree_polar_spread"])


def outward_axis(neurites: DataFrame, least: int) -> DataFrame:
    """principal_axis turned towards the mean of a cell's neurites, and _top, their largest distance from the soma along it
    (1 where there are too few). neurites: cell_id, x, y, z, dx, dy, dz."""
    axis = principal_axis(neurites, least)
    p = F.col("dx") * F.col("ax") + F.col("dy") * F.col("ay") + F.col("dz") * F.col("az")
    got = neurites.join(axis, "cell_id").groupBy("cell_id", "ax", "ay", "az", "strength").agg(F.avg(p).alias("_mean"), F.max(F.abs(p)).alias("_far"), F.count(F.lit(1)).alias("_n"))
    turn = F.when((F.col("_n") >= least) & (F.col("_mean") < 0), -1.0).otherwise(1.0)
    top = F.when(F.col("_n") >= least, F.greatest(F.col("_far"), F.lit(1e-6))).otherwise(1.0)
    return got.select("cell_id", *((F.col(c) * turn).alias(c) for c in ("ax", "ay", "az")), "strength", top.alias("_top"))


#: One-hot columns for cell types.
CELL_TYPES = ("pyramidal", "interneuron", "purkinje")


def with_types(rows: DataFrame) -> DataFrame:
    """Rows with is_pyramidal, is_interneuron and is_purkinje, from cell_type."""
    return rows.withColumns({f"is_{k}": (F.col("cell_type") == k).cast("int") for k in CELL_TYPES})


def branch_features(topo: DataFrame, cut: float | None = None) -> DataFrame:
    """All measures of each branch, with the cell type as three columns if the nodes have it."""
    stats = checkpointed(subtree_stats(topo))
    g = branch_geometry(topo, cut)
    g = g.join(branch_symmetry(topo), ["cell_id", "anchor"], "left").na.fill(0.5, ["symmetry"])
    on = trunk(topo, stats).select("cell_id", F.col("id").alias("branch"), F.lit(1).alias("on_longest_path"))
    out = branch_relative(topo, g, stats).join(on, ["cell_id", "branch"], "left").na.fill(0, ["on_longest_path"])
    if "cell_type" in topo.columns:
        out = with_types(out.join(topo.select("cell_id", "cell_type").distinct(), "cell_id"))
    return out


def branch_truth(topo: DataFrame, member: DataFrame, keys: tuple = ("cell_id", "branch"), label: str = "type") -> DataFrame:
    """keys, gt_label, gt_label_counts: the most frequent label of a branch's (or subtree's) nodes but soma, 3 if there is
    none, and the number of nodes of each such label. member: cell_id, id and the keys; label and seq too, if at hand."""
    rows = member if {label, "seq"} <= set(member.columns) else member.join(topo.select("cell_id", "id", label, "seq"), ["cell_id", "id"])
    n = rows.filter(F.col(label) != 1).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    counts = n.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "n")))).alias("gt_label_counts"))  # a few labels
    return label_mode(rows, list(keys), label).withColumnRenamed("label", "gt_label").join(counts, list(keys), "left")


#: Radii of the spheres of a Sholl analysis, in micrometres.
SHOLL_RADII = (10, 25, 50, 100, 200, 400, 800)


def sholl_crossings(topo: DataFrame, radii: tuple = SHOLL_RADII) -> DataFrame:
    """primary subtree, radius, crossings: edges with one end within and one beyond a sphere around the proxy."""
    t = with_soma(topo)
    up = t.select("cell_id", F.col("id").alias("parent"), F.col("radial").alias("up"))
    e = t.filter("primary_root IS NOT NULL").join(up, ["cell_id", "parent"])
    e = e.select(*TREE, F.least("up", "radial").alias("lo"), F.greatest("up", "radial").alias("hi"))
    # a row for each edge; the few radii are columns, so no edge is repeated
    counts = e.groupBy(*TREE).agg(*(F.count_if((F.col("lo") < r) & (F.col("hi") >= r)).alias(f"r{r}") for r in radii))
    return counts.select(*TREE, F.explode(F.array(*(F.struct(F.lit(r).alias("radius"), F.col(f"r{r}").alias("crossings")) for r in radii))).alias("c")).select(*TREE, "c.radius", "c.crossings")


def lmeasure_totals(topo: DataFrame) -> DataFrame:
    """Counts, lengths, surface, volume, box and distances of each primary subtree."""
    up = topo.select("cell_id", F.col("id").alias("parent"), F.col("radius").alias("up_radius"))
    t = with_soma(topo).filter("primary_root IS NOT NULL").join(up, ["cell_id", "parent"], "left")
    mean = (F.col("radius") + F.coalesce("up_radius", "radius")) / 2
    forks = F.count_if(F.col("n_children") >= 2)
    return t.groupBy(*TREE).agg(
        F.count(F.lit(1)).alias("n_nodes"), forks.alias("n_bifs"), F.count_if(F.col("n_children") == 0).alias("n_tips"), F.greatest(F.lit(1), 2 * forks + 1).alias("n_branches"),
        F.sum("edge").alias("length"), F.sum(2 * np.pi * mean * F.col("edge")).alias("surface"), F.sum(np.pi * mean * mean * F.col("edge")).alias("volume"),
        (2 * F.avg("radius")).alias("mean_diameter"), (F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height"), (F.max("z") - F.min("z")).alias("depth"),
        F.max("radial").alias("euc_max"), F.max("path").alias("path_max"), F.max("branch_order").alias("max_branch_order"),
    )


def partition_asymmetry(topo: DataFrame) -> DataFrame:
    """primary subtree, mean and largest |a - b| / max(1, a + b) of the tips below the first two children of each fork."""
    tips = subtree_stats(topo).select("cell_id", "id", "sub_tips")
    kids = topo.filter("NOT is_root").select("cell_id", "id", "parent", "seq").join(tips, ["cell_id", "id"])
    n = F.row_number().over(Window.partitionBy("cell_id", "parent").orderBy("seq"))
    two = kids.withColumn("n", n).filter("n <= 2").groupBy("cell_id", F.col("parent").alias("id")).agg(F.sum("sub_tips").alias("s"), F.max("sub_tips").alias("a"), F.min("sub_tips").alias("b"), F.count(F.lit(1)).alias("k")).filter("k = 2")
    two = two.withColumn("asym", (F.col("a") - F.col("b")) / F.greatest(F.lit(1), F.col("s")))
    of = topo.filter("primary_root IS NOT NULL").select("cell_id", "id", "primary_root")
    return two.join(of, ["cell_id", "id"]).groupBy(*TREE).agg(F.avg("asym").alias("mean_asymmetry"), F.max("asym").alias("max_asymmetry"))


def neurom_branches(topo: DataFrame) -> DataFrame:
    """Branch measures with the hop from the anchor, and what hangs below the branch's last node."""
    t = with_soma(topo).join(branches(topo).select("cell_id", "id", "branch", F.col("pos").alias("p")), ["cell_id", "id"])
    stats = subtree_stats(topo)
    t = t.join(stats.select("cell_id", "id", "sub_size", "sub_forks", "sub_cable"), ["cell_id", "id"])
    ends = F.struct("p", "radial", "radius", "sub_size", "sub_forks", "sub_cable", "id")
    g = t.groupBy("cell_id", "branch").agg(
        F.sum("edge").alias("path_len"), F.max("radial").alias("radial_max"), F.avg("dz").alias("z_above"), F.avg("radius").alias("mean_radius"), F.min("radius").alias("min_radius"), F.max("radius").alias("max_radius"), F.min(ends).alias("h"), F.max(ends).alias("t"),
    )
    kids = topo.filter("NOT is_root").select("cell_id", F.col("parent").alias("_p"), "seq", "id").join(stats.select("cell_id", "id", "sub_size"), ["cell_id", "id"])
    n = F.row_number().over(Window.partitionBy("cell_id", "_p").orderBy(F.desc("sub_size"), "seq"))
    two = kids.withColumn("n", n).filter("n <= 2").groupBy("cell_id", F.col("_p").alias("_tail")).agg(F.max("sub_size").alias("a"), F.min("sub_size").alias("b"), F.count(F.lit(1)).alias("k")).filter("k = 2")
    two = two.select("cell_id", "_tail", ((F.col("a") - F.col("b")) / F.greatest(F.lit(1), F.col("a") + F.col("b"))).alias("partition_asymmetry"))
    g = g.withColumn("_tail", F.col("t.id")).join(two, ["cell_id", "_tail"], "left").na.fill(0.0, ["partition_asymmetry"])
    if "cell_type" in topo.columns:
        g = with_types(g.join(topo.select("cell_id", "cell_type").distinct(), "cell_id"))
    kinds = [F.col(c) for c in ("is_pyramidal", "is_interneuron") if c in g.columns]
    return g.select(
        "cell_id", "branch", "partition_asymmetry", *kinds, "path_len", F.col("h.radial").alias("radial_head"), F.col("t.radial").alias("radial_tail"), "radial_max", "z_above", "mean_radius", "min_radius", "max_radius", F.col("h.radius").alias("head_radius"), F.col("t.radius").alias("tail_radius"),
        ((F.col("h.radius") - F.col("t.radius")) / F.greatest(F.lit(1e-6), F.col("h.radius"))).alias("taper"), F.col("t.sub_size").alias("subtree_nodes"), F.col("t.sub_forks").alias("subtree_bifs"), F.col("t.sub_cable").alias("subtree_length"),
    )


def sholl_vector(topo: DataFrame, radii: tuple = SHOLL_RADII) -> DataFrame:
    """By primary subtree: crossings at each radius, their peak and where it is, counts, distances, length, longest way to a
    tip, the size of the first axis' parts, and heights."""
    c = sholl_crossings(topo, radii)
    wide = c.groupBy(*TREE).agg(*(F.max(F.when(F.col("radius") == r, F.col("crossings"))).alias(f"crossings_{r}") for r in radii), F.max("crossings").alias("max_crossings"), F.max_by("radius", F.struct("crossings", -F.col("radius"))).alias("peak_radius"))
    t = with_soma(topo).filter("primary_root IS NOT NULL")
    g = t.groupBy(*TREE).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("n_children") >= 2).alias("n_bifs"), F.max("radial").alias("max_radial"), F.avg("radius").alias("mean_radius"), F.sum("edge").alias("total_length"), F.max("path").alias("max_path"), F.max("dz").alias("z_max"), F.min("dz").alias("z_min"))
    one = t.select(F.struct("cell_id", "primary_root").alias("cell_id"), "x", "y", "z")
    axis = principal_axis(one.withColumn("cell_id", F.to_json("cell_id"))).select("cell_id", *(F.abs(a).alias(f"pc1_{a[1]}") for a in ("ax", "ay", "az")))
    key = F.to_json(F.struct("cell_id", "primary_root"))
    return _with_pyr(g.join(wide, TREE).withColumn("_k", key).join(axis.withColumnRenamed("cell_id", "_k"), "_k").drop("_k"), topo)


def _with_pyr(rows: DataFrame, topo: DataFrame) -> DataFrame:
    """Rows with is_pyr, if the nodes have a cell type."""
    if "cell_type" not in topo.columns:
        return rows
    return rows.join(topo.select("cell_id", (F.col("cell_type") == "pyramidal").cast("int").alias("is_pyr")).distinct(), "cell_id")


def lmeasure_vector(topo: DataFrame) -> DataFrame:
    """By primary subtree: totals, asymmetry of forks, mean contraction and taper of branches, and the root's radius."""
    b = branch_geometry(topo).groupBy(*TREE).agg(F.avg("persistence").alias("mean_contraction"), F.avg("taper_ratio").alias("mean_taper"))
    root = topo.filter("id = primary_root").select(*TREE, F.col("radius").alias("root_radius"), "parent_radius")
    return _with_pyr(lmeasure_totals(topo).join(partition_asymmetry(topo), TREE, "left").join(b, TREE, "left").join(root, TREE).na.fill(0.0), topo)
