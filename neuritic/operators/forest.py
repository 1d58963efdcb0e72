"""Forests of nodes: parents, roots, paths, subtrees, branches and regions, by joins and pointer doubling.

Doubling joins every node with the ancestor that it has reached so far, so a tree of depth d takes about log2(d) rounds.
All joins and aggregations are keyed by cell and node, so a cell of any size is spread over the cluster. Each round is
checkpointed. Cells of up to small.SMALL nodes take the same steps on arrays inside tasks, after one exchange by cell. Nodes that no root reaches (cycles, nodes that are their own parent) keep path 0 and depth 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, checkpointed_count
from . import small

KEY = ["cell_id", "id"]


def last_of_each_id(nodes: DataFrame) -> DataFrame:
    """The last row of each node id counts."""
    rest = [c for c in nodes.columns if c not in KEY]
    best = nodes.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("_n"))
    return best.select(*KEY, *(F.col(f"_n.{c}").alias(c) for c in rest))


def forest(nodes: DataFrame) -> DataFrame:
    """Nodes with is_root (no parent, or none that is there), n_children and edge (length to the parent, 0 for roots)."""
    nodes = last_of_each_id(nodes)
    parents = nodes.select(F.col("cell_id").alias("_c"), F.col("id").alias("_p"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.col("radius").alias("parent_radius"))
    joined = nodes.join(parents, (nodes["cell_id"] == parents["_c"]) & (nodes["parent"] == parents["_p"]), "left")
    joined = joined.withColumn("is_root", F.col("_p").isNull()).drop("_c", "_p")
    edge = F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2) + F.pow(F.col("z") - F.col("pz"), 2))
    joined = joined.withColumn("edge", F.when(F.col("is_root"), 0.0).otherwise(edge))
    kids = joined.filter("NOT is_root").groupBy(F.col("cell_id").alias("_c"), F.col("parent").alias("_p")).agg(F.count(F.lit(1)).alias("n_children"))
    out = joined.join(kids, (joined["cell_id"] == kids["_c"]) & (joined["id"] == kids["_p"]), "left").drop("_c", "_p")
    return out.withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def proxy_soma(trees: DataFrame) -> DataFrame:
    """cell_id, proxy and its place: the root with the largest radius, then most children, then first in the file."""
    roots = trees.filter("is_root")
    best = roots.groupBy("cell_id").agg(F.max_by(F.struct("id", "x", "y", "z", "radius", "type"), F.struct("radius", "n_children", -F.col("seq"))).alias("s"))
    return best.select("cell_id", F.col("s.id").alias("proxy"), F.col("s.x").alias("sx"), F.col("s.y").alias("sy"), F.col("s.z").alias("sz"), F.col("s.radius").alias("soma_radius"))


def lift(state: DataFrame, adds: list[str] = (), firsts: list[str] = ()) -> DataFrame:
    """Doubling from (cell_id, id, anc, ...): adds are summed along the way to the root, firsts take the nearest
    ancestor's value where a node has none of its own.

    Two steps are taken between checkpoints. It ends when no node is on its way any more; nodes on cycles always are, so it
    also ends when a round settles none, which can't happen while a root is still to be reached. Small cells are settled by
    small.lift().
    """
    of_tasks, state = small.parts(state)
    settled = checkpointed(small.lift(of_tasks, list(adds), list(firsts)))
    return settled if state is None else settled.unionByName(_spread(state, adds, firsts))


def _spread(state: DataFrame, adds: list[str], firsts: list[str]) -> DataFrame:
    """lift() of cells of any size."""

    def step(state: DataFrame) -> DataFrame:
        up = state.select(F.col("cell_id").alias("_c"), F.col("id").alias("_i"), F.col("anc").alias("_anc"), *(F.col(c).alias(f"_{c}") for c in (*adds, *firsts)))
        return state.join(up, (state["cell_id"] == up["_c"]) & (state["anc"] == up["_i"]), "left").select(
            *KEY,
            F.col("_anc").alias("anc"),
            *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in adds),
            *(F.coalesce(c, f"_{c}").alias(c) for c in firsts),
        )

    moving = F.col("anc").isNotNull()
    state, left = checkpointed_count(state, moving)
    before = None
    while left and left != before:
        before = left
        state, left = checkpointed_count(step(step(state)), moving, state)
    return state


def topology(nodes: DataFrame) -> DataFrame:
    """Nodes of a forest with proxy, path and depth from the root, branch order, root and primary_root (the child of the proxy)
    that they descend from, head (first node of their branch) and pos (place in it, from 0). Small cells come from small.topology()."""
    nodes = nodes.filter("cell_id IS NOT NULL AND id IS NOT NULL")
    odd = reduce(Column.__or__, (F.col(c).isNull() for c in ("seq", "x", "y", "z", "radius")))
    of_tasks, nodes = small.parts(nodes, odd)
    out = small.topology(of_tasks)
    return out if nodes is None else out.unionByName(_topology(nodes))


def _topology(nodes: DataFrame) -> DataFrame:
    """topology() of cells of any size."""
    first = checkpointed(forest(nodes))
    trees = first.join(proxy_soma(first), "cell_id", "left")
    above = first.select(F.col("cell_id").alias("_c"), F.col("id").alias("_p"), F.col("n_children").alias("_kids"))
    trees = checkpointed(trees.join(above, (trees["cell_id"] == above["_c"]) & (trees["parent"] == above["_p"]), "left").drop("_c", "_p").withColumnRenamed("_kids", "parent_children"), first)
    child = ~F.col("is_root")
    forks = child & (F.col("parent_children") > 1)
    state = trees.select(
        *KEY,
        F.when(child, F.col("parent")).alias("anc"),
        F.col("edge").alias("path"),
        child.cast("int").alias("depth"),
        forks.cast("int").alias("branch_order"),
        F.when(F.col("parent") == F.col("proxy"), F.col("id")).alias("primary_root"),
        F.when(child & ((F.col("parent") == F.col("proxy")) | (F.col("parent_children") > 1)), F.col("id")).alias("head"),
        F.when(~child, F.col("id")).alias("root"),
    )
    lifted = lift(state, ["path", "depth", "branch_order"], ["primary_root", "head", "root"])
    reached = F.col("anc").isNull()
    lifted = lifted.select(*KEY, *(F.when(reached, F.col(c)).otherwise(F.lit(0)).cast(t).alias(c) for c, t in (("path", "double"), ("depth", "int"), ("branch_order", "int"))), *(F.when(reached, F.col(c)).alias(c) for c in ("primary_root", "head", "root")), reached.alias("reached"))
    out = trees.join(lifted, KEY)
    head = lifted.select(F.col("cell_id").alias("_c"), F.col("id").alias("_h"), F.col("depth").alias("_d"), F.col("path").alias("_hp"))
    out = out.join(head, (out["cell_id"] == head["_c"]) & (out["head"] == head["_h"]), "left")
    return out.withColumn("pos", F.col("depth") - F.col("_d")).withColumn("path_in_branch", F.col("path") - F.col("_hp")).drop("_c", "_h", "_d", "_hp")


def subtree_stats(topo: DataFrame) -> DataFrame:
    """For every node the size, depth, longest path, number of forks and tips, cable length below, smallest radius
    of its subtree (itself included), the way to the first node below that doesn't have exactly one child, and the tip
    with the longest path from the root, first in the file among equals.

    Doubling from the tips: after k rounds a node knows all descendants less than 2^k steps away. Small cells are settled by small.below().
    """
    rows = topo.filter("reached").select(*KEY, "is_root", "parent", "edge", "n_children", "radius", "path", "seq")
    of_tasks, rest = small.parts(rows, reduce(Column.__or__, (F.col(c).isNull() for c in ("edge", "radius", "path", "seq"))))
    start = of_tasks.select(
        *KEY, F.when(~F.col("is_root"), F.col("parent")).alias("anc"), F.col("edge").alias("far"), F.lit(1).cast("long").alias("size"), (F.col("n_children") >= 2).cast("long").alias("forks"),
        (F.col("n_children") == 0).cast("long").alias("tips"), F.lit(0.0).alias("cable"), F.lit(0.0).alias("max_path"), F.lit(0).alias("max_depth"), F.when(F.col("n_children") != 1, 0.0).alias("first_fork"), F.col("radius").alias("min_radius"), "path", "seq",
    )
    settled = checkpointed(small.below(start))
    settled = settled.select(*KEY, *(F.col(c).alias(f"sub_{c}") for c in settled.columns[2:]))
    return settled if rest is None else settled.unionByName(_subtree_stats(rest.withColumn("reached", F.lit(True))))


def _subtree_stats(topo: DataFrame) -> DataFrame:
    """subtree_stats() of cells of any size."""
    sums, tops, lows = ["size", "forks", "tips", "cable"], ["max_path", "max_depth"], ["first_fork", "min_radius"]
    tip = F.struct(F.col("path").alias("path"), (-F.col("seq")).alias("seq"), F.col("id").alias("id"))
    state = topo.filter("reached").select(
        *KEY, F.when(~F.col("is_root"), F.col("parent")).alias("anc"), F.col("edge").alias("far"), F.lit(1).alias("hops"),
        F.lit(1).cast("long").alias("size"), (F.col("n_children") >= 2).cast("long").alias("forks"), (F.col("n_children") == 0).cast("long").alias("tips"),
        F.lit(0.0).alias("cable"), F.lit(0.0).alias("max_path"), F.lit(0).alias("max_depth"), F.when(F.col("n_children") != 1, 0.0).alias("first_fork"), F.col("radius").alias("min_radius"),
        tip.alias("far_tip"), F.col("edge").alias("step"),
    )
    moving = F.col("anc").isNotNull()
    state, left = checkpointed_count(state, moving)
    while left:  # all are reached from roots
        got = state.filter(moving).groupBy(F.col("cell_id").alias("_c"), F.col("anc").alias("_i")).agg(
            *(F.sum(c).alias(f"_{c}") for c in ("size", "forks", "tips")),
            F.sum(F.col("cable") + F.col("step")).alias("_cable"),
            F.max(F.col("max_path") + F.col("far")).alias("_max_path"),
            F.max(F.col("max_depth") + F.col("hops")).alias("_max_depth"),
            F.min(F.col("first_fork") + F.col("far")).alias("_first_fork"),
            F.min("min_radius").alias("_min_radius"),
            F.max("far_tip").alias("_far_tip"),
        )
        up = state.select(F.col("cell_id").alias("_c2"), F.col("id").alias("_i2"), F.col("anc").alias("_anc"), F.col("far").alias("_far"), F.col("hops").alias("_hops"))
        new = state.join(got, (state["cell_id"] == got["_c"]) & (state["id"] == got["_i"]), "left")
        new = new.join(up, (F.col("cell_id") == F.col("_c2")) & (F.col("anc") == F.col("_i2")), "left").select(
            *KEY, F.col("_anc").alias("anc"), (F.col("far") + F.coalesce("_far", F.lit(0.0))).alias("far"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
            *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums),
            *(F.greatest(c, F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in tops),
            *(F.least(c, f"_{c}").alias(c) for c in lows),
            F.greatest("far_tip", F.coalesce("_far_tip", "far_tip")).alias("far_tip"), "step",
        )
        state, left = checkpointed_count(new, moving, state)
    return state.select(*KEY, *(F.col(c).alias(f"sub_{c}") for c in (*sums, *tops, *lows)), F.col("far_tip.id").alias("sub_far_tip"))


def stack_order(topo: DataFrame) -> DataFrame:
    """cell_id, id, place, tip_place: the place of every reached node, and of every tip among tips, in the order in which a stack gives
    nodes away: a node before what is below it, its last child in the file first; from 0 below each root.

    Sizes of subtrees come from subtree_stats(); a node stands behind its parent and all that is below the children given away before it, and
    these steps are added up along the way to the root by doubling again. No subtree is sorted; only the children of one node are.
    """
    sizes = subtree_stats(topo).select(*KEY, F.col("sub_size").alias("size"), F.col("sub_tips").alias("tips"))
    rows = topo.filter("reached").select(*KEY, "parent", "is_root", "seq").join(sizes, KEY)
    before = Window.partitionBy("cell_id", "is_root", "parent").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    child = ~F.col("is_root")
    steps = rows.select(*KEY, F.when(child, F.col("parent")).alias("anc"), *(F.when(child, first + F.coalesce(F.sum(c).over(before), F.lit(0))).otherwise(0).cast("long").alias(n) for c, n, first in (("size", "place", 1), ("tips", "tip_place", 0))))
    return lift(steps, ["place", "tip_place"]).select(*KEY, "place", "tip_place")


def trunk(topo: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """cell_id, primary_root, id, path of the nodes on the way from each primary root to its farthest tip, the first in
    the file among equals: those that lead to the same tip as the primary root. stats: subtree_stats(topo), if at hand."""
    stats = subtree_stats(topo) if stats is None else stats
    inside = topo.filter("primary_root IS NOT NULL").select(*KEY, "primary_root", "path").join(stats.select(*KEY, "sub_far_tip"), KEY)
    ends = inside.filter("id = primary_root").select("cell_id", "primary_root", F.col("sub_far_tip").alias("end"))
    return inside.join(ends, ["cell_id", "primary_root"]).filter("sub_far_tip = end").select("cell_id", "primary_root", "id", "path")


def strahler(topo: DataFrame) -> DataFrame:
    """Strahler order of every node: 1 for tips; the largest order of the children, one more if two share it.

    Order k are the chains that end in tips once all nodes of lower orders are cut off, so there is a round for each
    order, and in it a lift along chains. Chains of single children are left out at first: forks and tips only are cut.
    """
    # each node's nearest fork or tip at or below it; of forks and tips also the nearest fork above
    single = topo.filter("reached AND n_children = 1").select("cell_id", F.col("id").alias("c"))
    nodes = topo.filter("reached").select(*KEY, "parent", "n_children", "is_root")
    child = nodes.join(single, (nodes["cell_id"] == single["cell_id"]) & (nodes["parent"] == single["c"])).select(nodes["cell_id"], F.col("c").alias("id"), F.col("id").alias("anc"), F.lit(None).cast("long").alias("joint"))
    ends = nodes.filter("n_children != 1").select(*KEY, F.lit(None).cast("long").alias("anc"), F.col("id").cast("long").alias("joint"))
    below = lift(child.unionByName(ends), [], ["joint"]).select(*KEY, "joint")
    # a chain hangs from the fork above its uppermost node
    tops = nodes.filter("NOT is_root").join(topo.filter("n_children > 1").select("cell_id", F.col("id").alias("parent")), ["cell_id", "parent"]).select(*KEY, F.col("parent").cast("long").alias("next"))
    hang = tops.join(below, KEY).select("cell_id", F.col("joint").alias("id"), "next")
    tree = checkpointed(below.filter("id = joint").select(*KEY).join(hang, KEY, "left"))
    done, order = [], 1
    while True:
        kids = tree.filter("next IS NOT NULL").groupBy("cell_id", F.col("next").alias("id")).agg(F.count(F.lit(1)).alias("k"), F.max("id").alias("only"))
        state = tree.join(kids, KEY, "left").select(*KEY, F.when(F.col("k") == 1, F.col("only")).alias("anc"), F.when(F.col("k").isNull(), 1).when(F.col("k") > 1, 0).alias("ends"))
        cut = lift(state, [], ["ends"]).filter("ends = 1").select(*KEY)
        done.append(checkpointed(cut.withColumn("strahler", F.lit(order))))
        tree, left = checkpointed_count(tree.join(cut, KEY, "left_anti"), F.lit(True), tree)
        if not left:
            break
        order += 1
    orders = reduce(DataFrame.unionByName, done).withColumnRenamed("id", "joint")
    return below.join(orders, ["cell_id", "joint"]).select(*KEY, "strahler")


def regions(topo: DataFrame, label: str) -> DataFrame:
    """cell_id, id, region: connected nodes of one label below the proxy; named after the node nearest the root."""
    up = topo.select(F.col("cell_id").alias("_c"), F.col("id").alias("_p"), F.col(label).alias("_l"), (F.col("id") == F.col("proxy")).alias("_soma"))
    t = topo.filter((F.col("id") != F.col("proxy")) & F.col("reached"))
    t = t.join(up, (t["cell_id"] == up["_c"]) & (t["parent"] == up["_p"]), "left")
    cut = F.col("is_root") | F.col("_soma") | (F.col("_l") != F.col(label))
    state = t.select(*KEY, F.when(~cut, F.col("parent")).alias("anc"), F.when(cut, F.col("id")).alias("region"))
    return lift(state, [], ["region"]).select(*KEY, "region")


def branches(topo: DataFrame, cut: float | None = None, more: Sequence[str] = ()) -> DataFrame:
    """cell_id, branch (its head), anchor, id, pos of the nodes in branches below the proxy.

    cut: only the nodes up to the first whose path in the branch exceeds it, and nothing beyond that node.
    more: further columns of the nodes, so that they needn't be joined again.
    """
    b = topo.filter("head IS NOT NULL AND primary_root IS NOT NULL")
    if cut is not None:
        over = b.filter(F.col("path_in_branch") > cut).groupBy("cell_id", F.col("head").alias("_h")).agg(F.min("pos").alias("_last"))
        b = b.join(over.withColumnRenamed("cell_id", "_c"), (F.col("cell_id") == F.col("_c")) & (F.col("head") == F.col("_h")), "left")
        # branches whose way from the primary root passes a cut are never reached
        ends = b.filter("_last IS NOT NULL").groupBy("cell_id", "head").agg(F.max(F.col("pos") > F.col("_last")).alias("cut"))
        ends = ends.filter("cut").select("cell_id", F.col("head").alias("_cut"))
        heads = topo.filter("head = id").select("cell_id", "id", "parent")
        of = topo.select(F.col("cell_id").alias("_c2"), F.col("id").alias("_i2"), F.col("head").alias("up"))
        up = heads.join(of, (heads["cell_id"] == of["_c2"]) & (heads["parent"] == of["_i2"]), "left").select("cell_id", "id", "up")
        bad = up.join(ends, (up["cell_id"] == ends["cell_id"]) & (up["up"] == ends["_cut"]), "left").select(up["cell_id"], "id", F.col("up").alias("anc"), F.when(F.col("_cut").isNotNull(), F.lit(1)).alias("lost"))
        lost = lift(bad, [], ["lost"]).filter("lost = 1").select("cell_id", F.col("id").alias("head"))
        b = b.drop("_c", "_h").join(lost, ["cell_id", "head"], "left_anti").filter("_last IS NULL OR pos <= _last")
    anchors = topo.filter("head = id").select(F.col("cell_id").alias("_c"), F.col("id").alias("_h"), F.col("parent").alias("anchor"))
    out = b.join(anchors, (b["cell_id"] == anchors["_c"]) & (b["head"] == anchors["_h"]))
    return out.select("cell_id", F.col("head").alias("branch"), "anchor", "id", "pos", *more)


def branch_edges(member: DataFrame) -> DataFrame:
    """cell_id, a, b: branches that touch, in both directions; the branch of an anchor is linked with what starts there."""
    of = member.select("cell_id", F.col("id").alias("anchor"), F.col("branch").alias("a"))
    starts = member.filter("pos = 0").select("cell_id", "anchor", F.col("branch").alias("b"))
    one = of.join(starts, ["cell_id", "anchor"]).filter("a != b").select("cell_id", "a", "b")
    return one.unionByName(one.select("cell_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def label_mode(rows: DataFrame, keys: list[str], label: str = "type", order: str = "seq", default: int = 3) -> DataFrame:
    """keys, label: the most frequent label but soma, the first seen among equals; the default if there is none."""
    n = rows.filter(F.col(label) != 1).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = n.groupBy(*keys).agg(F.max_by(label, F.struct("n", -F.col("first"))).alias("mode"))
    return rows.select(*keys).distinct().join(best, keys, "left").select(*keys, F.coalesce("mode", F.lit(default)).alias("label"))


def rank_share(value: str, keys: list[str], ties: Column) -> Column:
    """1 for the largest value of a group down to 0 for the smallest; 1 if there is one only."""
    w = Window.partitionBy(*keys)
    k = F.count(F.lit(1)).over(w)
    r = F.row_number().over(w.orderBy(F.desc(value), ties)) - 1
    return F.when(k > 1, 1 - r / (k - 1)).otherwise(1.0)
