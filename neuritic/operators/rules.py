"""Rules on labels: first guesses of the cell type, decoding, refinement of node labels, and simple baselines.

Labels: 1 soma, 2 axon, 3 basal, 4 apical. Frames of nodes are topologies (see forest.topology) with a column of
predicted labels (`pred`) and one of confidences (`conf`). Equal votes go to the smaller label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, hash_share
from ..session import checkpointed
from . import forest, small

TREE = ["cell_id", "primary_root"]
NEURITE = (2, 3, 4)


# Cell types in order of preference among equals, and the settings of smoothing and island flips by type.
TYPE_ORDER = ("pyramidal", "interneuron")
SMOOTHING = {
    "pyramidal": {"rounds": 3, "threshold": 0.75},
    "interneuron": {"rounds": 2, "parent_weight": 0.15, "child_weight": 0.10, "threshold": 0.55},
    "purkinje": {"rounds": 2, "threshold": 0.60},
    "other": {"rounds": 2, "threshold": 0.60},
}
ISLANDS = {"pyramidal": {"most": 15, "threshold": 0.70}, "interneuron": {"most": 8, "threshold": 0.60}}


def legal(cell_type: Column) -> Column:
    """Neurite labels that a cell type may have; purkinje cells have basal only."""
    three, two = F.array(*map(F.lit, (2, 3, 4))), F.array(F.lit(2), F.lit(3))
    return F.when(cell_type == "pyramidal", three).when(cell_type == "purkinje", F.array(F.lit(3))).otherwise(two)


def structure_flags(cells: DataFrame) -> DataFrame:
    """Adds flags: a map of what is notable about a cell's features."""
    z, span = F.abs("z_asymmetry"), F.col("z_span")
    flags = {
        "multi_root": F.col("n_root_nodes") > 1,
        "z_asymmetric": (z > 0.3) & (span > 100),
        "apical_candidate": (F.col("cell_type") == "pyramidal") & (z > 0.2) & (span > 150),
        "large_morphology": F.col("n_nodes") > 5000,
        "high_branching": F.col("branch_point_ratio") > 0.15,
    }
    return cells.withColumn("flags", F.create_map(*(x for k, v in flags.items() for x in (F.lit(k), v))))


def guess_cell_type(cells: DataFrame) -> DataFrame:
    """Adds p_pyramidal, p_interneuron and guess, by added-up scores."""
    z, span, std, ratio = F.abs("z_asymmetry"), F.col("z_span"), F.col("subtree_size_std"), F.col("branch_point_ratio")
    many = F.col("n_primary_subtrees") >= 3

    def add(*terms: tuple[Column, float]) -> Column:
        return sum((F.when(c, w).otherwise(0.0) for c, w in terms), F.lit(0.0))

    pyramidal = add((many, 0.15), ((span > 200) & (z > 0.2), 0.2), ((F.col("max_subtree_size") > 1000) & (std > 200), 0.2), ((ratio > 0.05) & (ratio < 0.18), 0.1), (many & (std > 200), 0.1))
    inter = add(((z < 0.15) & (span < 250), 0.2), (z < 0.15, 0.15), (ratio > 0.1, 0.1), (many & (std < 300), 0.1), (F.col("n_nodes") < 3000, 0.05))
    out = cells.withColumn("_p", pyramidal).withColumn("_i", inter)
    total = F.col("_p") + F.col("_i")
    out = out.withColumn("p_pyramidal", F.when(total > 0, F.col("_p") / total).otherwise(0.5)).withColumn("p_interneuron", F.when(total > 0, F.col("_i") / total).otherwise(0.5))
    return out.withColumn("guess", F.when(F.col("p_pyramidal") >= F.col("p_interneuron"), "pyramidal").otherwise("interneuron")).drop("_p", "_i")


def label_sets(cells: DataFrame) -> DataFrame:
    """Adds label_set for the guess: without apical where an interneuron is nearly as likely and nothing speaks for apical."""
    apical = F.coalesce(F.col("flags")["apical_candidate"], F.lit(False)) | F.coalesce(F.col("flags")["z_asymmetric"], F.lit(False))
    down = (F.col("guess") == "pyramidal") & (F.col("p_interneuron") > 0.7 * F.col("p_pyramidal")) & ~apical
    return cells.withColumn("label_set", F.when((F.col("guess") == "pyramidal") & ~down, F.array(*map(F.lit, (1, 2, 3, 4)))).otherwise(F.array(*map(F.lit, (1, 2, 3)))))


def soft_handoff(trials: DataFrame, threshold: float = 0.65) -> DataFrame:
    """One trial for each cell: that of its own type if that was sure enough, else the one with the larger mean branch
    confidence, pyramidal first. trials: cell_id, cell_type (tried), own_type, type_conf, branch_conf."""
    open_ = (F.col("type_conf") < threshold) | (F.col("cell_type") == F.col("own_type"))
    first = (F.col("cell_type") == TYPE_ORDER[0]).cast("int")
    best = trials.filter(open_).groupBy("cell_id").agg(F.max_by("cell_type", F.struct("branch_conf", first)).alias("cell_type"), F.max("own_type").alias("own_type"))
    return best.withColumn("handed_off", F.col("cell_type") != F.col("own_type"))


def decode(rows: DataFrame, probability: str = "probability") -> DataFrame:
    """Adds pred and conf: the most likely legal label of an array of probabilities for labels 2, 3, 4."""
    p = F.transform(F.col(probability), lambda x, i: F.when(F.array_contains(legal(F.col("cell_type")), i + 2), x).otherwise(0.0))
    out = rows.withColumn("_p", p).withColumn("_s", F.aggregate("_p", F.lit(0.0), lambda a, x: a + x))
    out = out.withColumn("_p", F.when(F.col("_s") > 0, F.transform("_p", lambda x: x / F.col("_s"))).otherwise(F.col("_p")))
    return out.withColumn("conf", F.array_max("_p")).withColumn("pred", (F.array_position("_p", F.col("conf")) + 1).cast("int")).drop("_p", "_s")


def decode_binary(rows: DataFrame, p_axon: str = "p_axon") -> DataFrame:
    """Adds pred and conf: axon where its probability is above one half, else basal."""
    p = F.col(p_axon)
    return rows.withColumn("pred", F.when(p > 0.5, 2).otherwise(3)).withColumn("conf", F.when(p > 0.5, p).otherwise(1 - p))


def owner_map(subtrees: DataFrame, probability: str = "probability") -> DataFrame:
    """cell_id, primary_root, prob_2, prob_3, prob_4, pred, conf: what each primary subtree is, from an array of
    probabilities for labels 2, 3, 4; the smallest label among equals."""
    p = [F.coalesce(F.get(F.col(probability), F.lit(k)), F.lit(0.0)) for k in range(3)]
    top = F.greatest(*p)
    pred = F.when(p[0] >= top, 2).when(p[1] >= top, 3).otherwise(4)
    return subtrees.select(*TREE, *(c.alias(f"prob_{k + 2}") for k, c in enumerate(p)), pred.alias("pred"), top.alias("conf"))


#: What the owner of a branch's primary subtree adds to its features.
OWNER_FEATURES = ("owner_prob_2", "owner_prob_3", "owner_prob_4", "owner_is_2", "owner_is_3", "owner_is_4", "owner_conf")


def with_owner(branches: DataFrame, owners: DataFrame) -> DataFrame:
    """Branches with their subtree's owner as seven more features, zeros where it has none. owners: see owner_map."""
    of = owners.select(*TREE, *(F.col(f"prob_{k}").alias(f"owner_prob_{k}") for k in NEURITE), *((F.col("pred") == k).cast("double").alias(f"owner_is_{k}") for k in NEURITE), F.col("conf").alias("owner_conf"))
    return branches.join(of, TREE, "left").na.fill(0.0, list(OWNER_FEATURES))


def subtree_mode(branches: DataFrame, owners: DataFrame) -> DataFrame:
    """Branches with pred and conf of their primary subtree's owner; basal where that label isn't legal for the cell type, and
    basal with confidence 0.5 where there is no owner."""
    out = branches.drop("pred", "conf").join(owners.select(*TREE, F.col("pred").alias("_o"), F.col("conf").alias("_oc")), TREE, "left")
    ok = F.array_contains(legal(F.col("cell_type")), F.col("_o"))
    return out.withColumn("pred", F.when(ok, F.col("_o")).otherwise(3)).withColumn("conf", F.coalesce("_oc", F.lit(0.5))).drop("_o", "_oc")


def valid_branches(branches: DataFrame) -> DataFrame:
    """Branches whose true label (gt) is a neurite label that their cell type may have."""
    return branches.filter(F.array_contains(legal(F.col("cell_type")), F.col("gt")))


def to_nodes(nodes: DataFrame, member: DataFrame, decoded: DataFrame) -> DataFrame:
    """Nodes with pred and conf of their branch; nodes of no branch are filled. member: cell_id, id, branch."""
    of = member.select("cell_id", "id", "branch").join(decoded.select("cell_id", "branch", "pred", "conf"), ["cell_id", "branch"]).drop("branch")
    return fill_unassigned(nodes.join(of, ["cell_id", "id"], "left"))


def fill_unassigned(nodes: DataFrame) -> DataFrame:
    """Nodes without a label get axon at confidence 0.3."""
    none = F.col("pred").isNull() | (F.col("pred") == 0)
    return nodes.withColumn("conf", F.when(none, 0.3).otherwise(F.col("conf"))).withColumn("pred", F.when(none, 2).otherwise(F.col("pred")))


def apical_owner(owners: DataFrame, least: float = 0.45) -> DataFrame:
    """cell_id, owner: the primary subtree most likely to be apical, if it is likely enough. owners: primary_root, prob_4, seq."""
    best = owners.groupBy("cell_id").agg(F.max_by(F.struct("primary_root", "prob_4"), F.struct("prob_4", -F.col("primary_root"))).alias("b"))
    return best.filter(F.col("b.prob_4") >= least).select("cell_id", F.col("b.primary_root").alias("owner"))


def override(branches: DataFrame, evidence: Column | None = None) -> DataFrame:
    """Replaces basal by apical and back as a graph model says (gnn), in cells that have both, or evidence of apical."""
    has = branches.groupBy("cell_id").agg((F.max((F.col("pred") == 3).cast("int")) + F.max((F.col("pred") == 4).cast("int"))).alias("_k"))
    gate = (F.col("_k") == 2) if evidence is None else (F.col("_k") == 2) | evidence
    swap = gate & F.col("pred").isin(3, 4) & F.col("gnn").isin(3, 4)
    return branches.join(has, "cell_id").withColumn("pred", F.when(swap, F.col("gnn")).otherwise(F.col("pred"))).drop("_k")


def strip_soma(nodes: DataFrame) -> DataFrame:
    """Only the proxy is soma; others that say so become the type's first neurite label."""
    return nodes.withColumn("pred", F.when(F.col("id") == F.col("proxy"), 1).when(F.col("pred") == 1, legal(F.col("cell_type"))[0]).otherwise(F.col("pred")))


def _whole_votes(nodes: DataFrame, keys: list[str], weight: Column, names: str = "v") -> DataFrame:
    """Votes for each neurite label in whole billionths, so that they don't depend on the order in which they are added up, and equal votes are equal."""
    units = F.round(finite(weight) * 1e9).cast("long")
    return nodes.groupBy(*keys).agg(*(F.sum(F.when(F.col("pred") == k, units).otherwise(0)).alias(f"{names}{k}") for k in NEURITE))


def _votes(nodes: DataFrame, keys: list[str], weight: Column, names: str = "v") -> DataFrame:
    """Votes for each neurite label as doubles: the one next to the exact sum, so that they don't depend on the order in which they are added up, and two
    votes add up to what doubles say, 0.91 + 0.52 > 0.82 + 0.61. Weights are added up in two whole parts, to 2^-62, which is all that those above 2^-10 have."""
    units = finite(weight) * 2.0**31
    high = F.floor(units)
    parts = {"h": high, "l": F.floor((units - high) * 2.0**31)}
    sums = nodes.groupBy(*keys).agg(*(F.sum(F.when(F.col("pred") == k, part).otherwise(0)).alias(f"_{at}{k}") for k in NEURITE for at, part in parts.items()))
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    return sums.select(*keys, *(((whole(f"_h{k}") * F.lit(2**31) + whole(f"_l{k}")).cast("double") / 2.0**62).alias(f"{names}{k}") for k in NEURITE))


def _winner(names: str = "v", allowed: Column | None = None) -> Column:
    """The label with the most votes, the smallest among equals."""
    v = [F.col(f"{names}{k}") if allowed is None else F.when(F.array_contains(allowed, k), F.col(f"{names}{k}")).otherwise(-1.0) for k in NEURITE]
    return F.when((v[0] >= v[1]) & (v[0] >= v[2]), 2).when(v[1] >= v[2], 3).otherwise(4)


def subtree_vote(nodes: DataFrame) -> DataFrame:
    """Every primary subtree gets the label with the most confidence in it (its legal ones)."""
    t = nodes.filter("primary_root IS NOT NULL")
    votes = _votes(t, [*TREE, "cell_type"], F.col("conf")).withColumn("winner", _winner(allowed=legal(F.col("cell_type"))))
    allowed = legal(F.col("cell_type"))
    good = sum(F.when(F.array_contains(allowed, k), F.col(f"v{k}")).otherwise(0.0) for k in NEURITE) > 0
    out = nodes.join(votes.filter(good).select(*TREE, "winner"), TREE, "left")
    mine = F.col("winner").isNotNull() & F.array_contains(allowed, F.col("pred"))
    return out.withColumn("pred", F.when(mine, F.col("winner")).otherwise(F.col("pred"))).drop("winner")


def single_class(nodes: DataFrame, target: int, fallback: int) -> DataFrame:
    """At most one primary subtree of a cell keeps the target label: that with the most confidence for it.

    A subtree owns the label that most of its neurite confidence has.
    """
    t = nodes.filter("primary_root IS NOT NULL")
    votes = _votes(t, TREE, F.col("conf")).withColumn("winner", _winner()).filter(F.col("winner") == target)
    seq = t.filter("id = primary_root").select(*TREE, F.col("seq").alias("_seq"))
    n = F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc(f"v{target}"), "_seq"))
    losers = votes.join(seq, TREE).withColumn("n", n).filter("n > 1").select(*TREE, F.lit(1).alias("_lost"))
    out = nodes.join(losers, TREE, "left")
    return out.withColumn("pred", F.when((F.col("_lost") == 1) & (F.col("pred") == target), fallback).otherwise(F.col("pred"))).drop("_lost")


def single_apical(nodes: DataFrame) -> DataFrame:
    """Of several apical subtrees the one farthest along the cell's first axis stays; the others become basal."""
    from .features import principal_axis, with_soma

    t = with_soma(nodes).filter("primary_root IS NOT NULL")
    apical = _votes(t, TREE, F.col("conf")).withColumn("w", _winner()).filter("w = 4").select(*TREE)
    axis = principal_axis(t).drop("strength")
    p = t.join(axis, "cell_id").withColumn("p", F.col("dx") * F.col("ax") + F.col("dy") * F.col("ay") + F.col("dz") * F.col("az"))
    turn = p.groupBy("cell_id").agg(F.when(F.avg("p") < 0, -1.0).otherwise(1.0).alias("turn"))
    mean = p.join(apical, TREE).groupBy(*TREE).agg(F.avg("p").alias("m")).join(turn, "cell_id").withColumn("m", F.col("m") * F.col("turn"))
    n = F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc("m"), "primary_root"))
    losers = mean.withColumn("n", n).filter("n > 1").select(*TREE, F.lit(1).alias("_lost"))
    out = nodes.join(losers, TREE, "left")
    return out.withColumn("pred", F.when((F.col("_lost") == 1) & (F.col("pred") == 4), 3).otherwise(F.col("pred"))).drop("_lost")


def constrain_apical(nodes: DataFrame, owners: DataFrame, keep: float = 0.93) -> DataFrame:
    """Apical nodes outside the owner's subtree become basal unless very sure. owners: cell_id, owner."""
    out = nodes.join(owners, "cell_id", "left")
    outside = F.col("owner").isNotNull() & (F.coalesce("primary_root", F.lit(-1)) != F.col("owner")) & (F.col("id") != F.col("proxy"))
    return out.withColumn("pred", F.when(outside & (F.col("pred") == 4) & (F.col("conf") < keep), 3).otherwise(F.col("pred"))).drop("owner")


def smooth(nodes: DataFrame, rounds: int = 3, parent_weight: float = 0.25, child_weight: float = 0.15, threshold: float = 0.7, labels: Column | None = None) -> DataFrame:
    """Unsure nodes take the label with the most votes of themselves, their parent and their children, all nodes at once,
    several rounds. labels: those that may win; by default those of the cell's type. Small cells are settled by small.smooth().
    nodes are read more than once, so they had better be stored."""
    labels = legal(F.col("cell_type")) if labels is None else labels
    rest, allowed = [c for c in nodes.columns if c not in ("cell_id", "id", "pred")], [f"_may{k}" for k in NEURITE]
    near, far = small.parts(nodes)
    near = near.select("cell_id", "id", "pred", *rest, *(F.array_contains(labels, k).cast("int").alias(c) for k, c in zip(NEURITE, allowed, strict=True)))
    near = checkpointed(small.smooth(near, rounds, parent_weight, child_weight, threshold, allowed))
    return near if far is None else near.unionByName(_smooth(far, rounds, parent_weight, child_weight, threshold, labels))


def _smooth(nodes: DataFrame, rounds: int, parent_weight: float, child_weight: float, threshold: float, labels: Column) -> DataFrame:
    """smooth() of cells of any size."""
    rest = [c for c in nodes.columns if c not in ("cell_id", "id", "pred")]
    out = nodes
    for _ in range(rounds):
        now = out.select("cell_id", "id", "pred", "parent", (F.col("id") == F.col("proxy")).alias("soma"))
        up = now.filter("NOT soma").select(F.col("cell_id").alias("_c"), F.col("id").alias("_p"), F.col("pred").alias("up"))
        down = now.filter("NOT soma").groupBy(F.col("cell_id").alias("_c2"), F.col("parent").alias("_p2")).agg(*(F.count_if(F.col("pred") == k).alias(f"k{k}") for k in NEURITE))
        j = out.join(up, (out["cell_id"] == up["_c"]) & (out["parent"] == up["_p"]), "left").join(down, (F.col("cell_id") == F.col("_c2")) & (F.col("id") == F.col("_p2")), "left")
        for k in NEURITE:
            vote = F.when(F.col("pred") == k, F.col("conf")).otherwise(0.0) + F.when(F.col("up") == k, parent_weight).otherwise(0.0) + child_weight * F.coalesce(f"k{k}", F.lit(0))
            j = j.withColumn(f"v{k}", vote)
        open_ = (F.col("id") != F.col("proxy")) & (F.col("pred") != 1) & (F.col("conf") < threshold)
        out = checkpointed(j.withColumn("pred", F.when(open_, _winner(allowed=labels)).otherwise(F.col("pred"))).select("cell_id", "id", "pred", *rest))
    return out


def soft_majority(nodes: DataFrame, high: float = 0.7, low: float = 0.55, margin: float = 0.6) -> DataFrame:
    """Where sure nodes of a primary subtree agree by a margin, unsure ones follow; subtrees of fewer than four nodes are left."""
    t = nodes.filter("primary_root IS NOT NULL")
    allowed = legal(F.col("cell_type"))
    sure = F.when(F.col("conf") >= high, F.col("conf")).otherwise(0.0)
    votes = _whole_votes(t, [*TREE, "cell_type"], sure).join(t.groupBy(*TREE).agg(F.count(F.lit(1)).alias("size")), TREE)
    votes = votes.withColumn("winner", _winner(allowed=allowed))
    total = sum(F.when(F.array_contains(allowed, k), F.col(f"v{k}")).otherwise(0.0) for k in NEURITE)
    top = F.when(F.col("winner") == 2, F.col("v2")).when(F.col("winner") == 3, F.col("v3")).otherwise(F.col("v4"))
    votes = votes.withColumn("total", total).filter((F.col("size") >= 4) & (F.col("total") > 0)).filter(top / F.col("total") >= margin).select(*TREE, "winner")
    out = nodes.join(votes, TREE, "left")
    flip = F.col("winner").isNotNull() & (F.col("conf") < low) & F.array_contains(allowed, F.col("pred"))
    return out.withColumn("pred", F.when(flip, F.col("winner")).otherwise(F.col("pred"))).drop("winner")


def axon_bias(nodes: DataFrame, low: float = 0.6, least: int = 20, thin: float = 0.25) -> DataFrame:
    """In the primary subtree that is thinnest and longest, if it is clearly thin, unsure nodes become axon."""
    t = nodes.filter("primary_root IS NOT NULL")
    root = t.filter("id = primary_root").select(*TREE, F.col("path").alias("_rp"), F.col("seq").alias("_seq"))
    s = t.join(root, TREE).groupBy(*TREE, "_seq").agg(F.avg("radius").alias("r"), F.max(F.col("path") - F.col("_rp")).alias("p"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    cell = s.groupBy("cell_id").agg(F.count(F.lit(1)).alias("k"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.max("p").alias("p1"), F.avg("r").alias("ra")).filter("k >= 2 AND r1 - r0 >= 1e-9 AND p1 >= 1e-9")
    s = s.join(cell, "cell_id").withColumn("score", 0.6 * (1 - (F.col("r") - F.col("r0")) / (F.col("r1") - F.col("r0"))) + 0.4 * F.col("p") / F.col("p1"))
    best = s.groupBy("cell_id").agg(F.max_by(F.struct("primary_root", "r", "ra"), F.struct("score", -F.col("_seq"))).alias("b"))
    best = best.filter(F.col("b.r") <= F.col("b.ra") * (1 - thin)).select("cell_id", F.col("b.primary_root").alias("primary_root"), F.lit(1).alias("_axon"))
    out = nodes.join(best, TREE, "left")
    flip = (F.col("_axon") == 1) & (F.col("pred") != 1) & (F.col("conf") < low)
    return out.withColumn("pred", F.when(flip, 2).otherwise(F.col("pred"))).drop("_axon")


def flip_islands(nodes: DataFrame, most: int | Column = 15, threshold: float | Column = 0.75) -> DataFrame:
    """Small unsure regions of one label take the most frequent label around them; among equals the one that is met first.

    Regions are looked at in the order of their first nodes in the file, and what was looked at before doesn't count as
    around. Labels around are those of before, as a region changes only once it is looked at itself, so all regions are
    settled at once. What is around a region is met breadth first from its first node, parents before children. Only small regions,
    of at most `most` nodes, are ever put together; nodes that no root reaches stay as they are.
    """
    most, threshold = (v if isinstance(v, Column) else F.lit(v) for v in (most, threshold))
    found = forest.regions(nodes, "pred")
    n = checkpointed(nodes.select(*forest.KEY, "seq", "parent", "pred", "conf", most.alias("_most"), threshold.alias("_sure")).join(found, forest.KEY))
    inside = n.filter(F.col("region").isNotNull() & (F.col("pred") != 1)).select("cell_id", "id", "seq", F.coalesce("parent", F.lit(-1)).alias("parent"), "pred", "conf", "region", "_most", "_sure")
    whole = inside.groupBy("cell_id", "region").agg(F.count(F.lit(1)).alias("size"), F.min("seq").alias("first"), F.avg("conf").alias("mean"), F.max("_most").alias("most"), F.max("_sure").alias("sure"))
    whole = checkpointed(whole.withColumn("open", (F.col("size") <= F.col("most")) & (F.round("mean", 12) < F.col("sure"))))
    # a region touches others above its uppermost node, which it is named after, and below any of its nodes
    heads = inside.filter("id = region").join(whole.select("cell_id", "region", "first"), ["cell_id", "region"])
    above = inside.select(F.col("cell_id").alias("_c"), F.col("id").alias("_p"), F.col("pred").alias("up"), F.col("region").alias("up_region"))
    touch = heads.join(above, (F.col("cell_id") == F.col("_c")) & (F.col("parent") == F.col("_p")))
    of = whole.select(F.col("cell_id").alias("_c2"), F.col("region").alias("_r2"), F.col("first").alias("up_first"))
    touch = touch.join(of, (F.col("cell_id") == F.col("_c2")) & (F.col("up_region") == F.col("_r2")))
    touch = checkpointed(touch.select("cell_id", "id", "seq", "pred", "region", "first", "up", "up_region", "up_first", "_p"))
    around = touch.filter("up_first > first").select("cell_id", "region", F.col("id").alias("at"), F.lit(-1).alias("place"), F.col("up").alias("label"))
    around = around.unionByName(touch.filter("first > up_first").select("cell_id", F.col("up_region").alias("region"), F.col("_p").alias("at"), F.col("seq").cast("int").alias("place"), F.col("pred").alias("label")))
    small = whole.filter("open").select("cell_id", "region")
    around = around.filter(F.col("label").isin(*NEURITE)).join(small, ["cell_id", "region"]).groupBy("cell_id", "region", "at", "label").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    around = around.groupBy("cell_id", "region").agg(F.collect_list(F.struct("at", "label", "n", "place")).alias("around"))  # three for each node of a small region at most
    inner = inside.join(small, ["cell_id", "region"]).groupBy("cell_id", "region").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), F.col("id").cast("long").alias("id"), F.col("parent").cast("long").alias("parent")))).alias("inner"))

    def after(met: Column, k: Column) -> Column:
        """What is met once the k-th node is left: its parent, then its children in file order, where they are new."""
        u = F.get(met, k)
        new = F.filter("inner", lambda x: ((x["id"] == u["parent"]) | (x["parent"] == u["id"])) & ~F.exists(met, lambda y: y["id"] == x["id"]))
        return F.concat(met, F.filter(new, lambda x: x["id"] == u["parent"]), F.filter(new, lambda x: x["id"] != u["parent"]))

    met = F.aggregate(F.sequence(F.lit(0), F.size("inner") - 1), F.slice("inner", 1, 1), after)
    times = lambda label: F.aggregate(F.filter("around", lambda e: e["label"] == label), F.lit(0).cast("long"), lambda a, e: a + e["n"])
    named = around.join(inner, ["cell_id", "region"]).withColumn("met", F.transform(met, lambda x: x["id"]))
    top = F.greatest(*(times(k) for k in NEURITE))
    named = named.withColumn("top", top).withColumn("best", F.filter("around", lambda e: times(e["label"]) == F.col("top")))
    to = F.array_min(F.transform("best", lambda e: F.struct(F.array_position("met", e["at"]).alias("a"), e["place"].alias("p"), e["label"].alias("label"))))["label"]
    flips = named.select("cell_id", "region", to.cast("int").alias("_to"))
    # whole rows are exchanged once, to meet their new labels
    to = inside.select(*forest.KEY, "region").join(flips, ["cell_id", "region"]).select(*forest.KEY, "_to")
    return nodes.join(to, forest.KEY, "left").withColumn("pred", F.coalesce("_to", "pred")).select(*nodes.columns)


def legal_only(nodes: DataFrame) -> DataFrame:
    """Labels that the cell type can't have become its first neurite label."""
    allowed = legal(F.col("cell_type"))
    keep = (F.col("pred") == 1) | F.array_contains(allowed, F.col("pred"))
    return nodes.withColumn("pred", F.when(keep, F.col("pred")).otherwise(allowed[0]))


#: Columns of nodes that refine() looks at.
REFINED = ("cell_id", "id", "cell_type", "seq", "parent", "is_root", "reached", "proxy", "primary_root", "path", "radius", "x", "y", "z", "sx", "sy", "sz", "pred", "conf")


def refine(nodes: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """The whole chain of rules, by cell type, on predicted labels; cells with one neurite label at most are left as they
    are. owners: cell_id, owner (see apical_owner)."""
    n = nodes.withColumn("pred", F.when(F.col("id") == F.col("proxy"), 1).otherwise(F.col("pred")))
    n = checkpointed(legal_only(n))
    few = F.size(legal(F.col("cell_type"))) <= 1
    p, i = n.filter("cell_type = 'pyramidal'"), n.filter("cell_type = 'interneuron'")
    other = n.filter(~few & ~F.col("cell_type").isin("pyramidal", "interneuron"))
    p = single_class(single_apical(single_class(subtree_vote(p), 2, 3)), 4, 3)
    if owners is not None:
        p = constrain_apical(p, owners)
    p, i = checkpointed(p), checkpointed(soft_majority(axon_bias(i)))
    p, i = smooth(p, **SMOOTHING["pyramidal"]), smooth(i, **SMOOTHING["interneuron"])
    of = lambda key: F.when(F.col("cell_type") == "pyramidal", ISLANDS["pyramidal"][key]).otherwise(ISLANDS["interneuron"][key])
    flipped = checkpointed(flip_islands(p.select(*n.columns).unionByName(i.select(*n.columns)), of("most"), of("threshold")))
    p, i = flipped.filter("cell_type = 'pyramidal'"), flipped.filter("cell_type = 'interneuron'")
    if owners is not None:
        p = constrain_apical(p, owners)
    parts = [x.select(*n.columns) for x in (p, i, n.filter(few), smooth(other, **SMOOTHING["other"]))]
    return strip_soma(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))


def majority_labels(nodes: DataFrame, prior: DataFrame) -> DataFrame:
    """Every node but soma gets the legal label that is most frequent in training."""
    shares = prior.agg(*(F.coalesce(F.max(F.when(F.col("label") == k, F.col("share"))), F.lit(0.0)).alias(f"v{k}") for k in NEURITE))
    out = nodes.crossJoin(F.broadcast(shares))  # one row
    return out.withColumn("pred", F.when(F.col("type") == 1, 1).otherwise(_winner(allowed=legal(F.col("cell_type"))))).drop("v2", "v3", "v4")


def random_labels(nodes: DataFrame, prior: DataFrame, seed: int = 42) -> DataFrame:
    """Labels drawn from the shares of training, by a hash of cell and node, so that reruns agree."""
    shares = prior.agg(*(F.coalesce(F.max(F.when(F.col("label") == k, F.col("share"))), F.lit(0.0)).alias(f"v{k}") for k in NEURITE))
    out = nodes.crossJoin(F.broadcast(shares))  # one row
    four = F.when(F.col("cell_type") == "pyramidal", F.col("v4")).otherwise(0.0)
    u = hash_share(F.concat_ws(":", "cell_id", "id"), seed) * (F.col("v2") + F.col("v3") + four)
    drawn = F.when(u < F.col("v2"), 2).when(u < F.col("v2") + F.col("v3"), 3).otherwise(F.when(F.col("cell_type") == "pyramidal", 4).otherwise(3))
    return out.withColumn("pred", F.when(F.col("type") == 1, 1).otherwise(drawn)).drop("v2", "v3", "v4")


def heuristic_labels(topo: DataFrame) -> DataFrame:
    """cell_id, id, pred: the thinnest primary subtree is axon; of pyramidal cells the one that reaches highest above the soma
    (more than 5) is apical, unless it is the axon; the rest is basal, the proxy soma."""
    t = topo.filter("primary_root IS NOT NULL")
    root = t.filter("id = primary_root").select(*TREE, F.col("seq").alias("_seq"))
    s = t.groupBy(*TREE, "cell_type").agg(F.avg("radius").alias("r"), F.max(F.col("z") - F.col("sz")).alias("h")).join(root, TREE)
    w = Window.partitionBy("cell_id")
    s = s.withColumn("a", F.row_number().over(w.orderBy("r", "_seq"))).withColumn("t", F.row_number().over(w.orderBy(F.desc("h"), "_seq")))
    s = s.select(*TREE, F.when(F.col("a") == 1, 2).when((F.col("t") == 1) & (F.col("cell_type") == "pyramidal") & (F.col("h") > 5), 4).otherwise(3).alias("_l"))
    out = topo.join(s, TREE, "left")
    return out.select("cell_id", "id", F.when(F.col("id") == F.col("proxy"), 1).otherwise(F.coalesce("_l", F.lit(3))).alias("pred"))
