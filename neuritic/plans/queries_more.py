"""More of the library's queries: whole feature tables, rules, training rows, evaluation and reports, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import features, forest, graph, metrics, ml, prep, qc, rules, stats
from ..sources import swc, tables
from ..session import checkpointed
from . import labelling
from .bundle import Bundle
from . import queries as own
from .fixtures import FILES, NODES, PRED, SCORES, files, nodes, pred, scores
from .queries import _D, _F, _S, _SQL_DIAGNOSED, BELOW, TREE, _file_scores, _scores, query


def topo(spark, sf):
    return own.topo(spark, sf)


# ---------------------------------------------------------------- SQL that several queries share


def _axis(name: str, rel: str, least: int) -> str:
    """The first eigenvector of the covariance of x, y, z of each cell in SQL, from the cross products of two rows of A - l1 I."""
    return f"""
{name}_c AS (SELECT cell_id, count(*) AS n, covar_samp(x,x) AS cxx, covar_samp(y,y) AS cyy, covar_samp(z,z) AS czz, covar_samp(x,y) AS cxy, covar_samp(x,z) AS cxz, covar_samp(y,z) AS cyz FROM {rel} GROUP BY 1),
{name}_q AS (SELECT *, (cxx+cyy+czz)/3 AS q, sqrt(((cxx-(cxx+cyy+czz)/3)*(cxx-(cxx+cyy+czz)/3) + (cyy-(cxx+cyy+czz)/3)*(cyy-(cxx+cyy+czz)/3) + (czz-(cxx+cyy+czz)/3)*(czz-(cxx+cyy+czz)/3) + 2*(cxy*cxy+cxz*cxz+cyz*cyz))/6) AS p FROM {name}_c),
{name}_l AS (SELECT *, q + 2*p*cos(acos(greatest(-1.0, least(1.0, (((cxx-q)*((cyy-q)*(czz-q)-cyz*cyz) - cxy*(cxy*(czz-q)-cyz*cxz) + cxz*(cxy*cyz-(cyy-q)*cxz)) / (p*p*p)) / 2))) / 3) AS l FROM {name}_q),
{name}_v AS (SELECT *, [cxy*cyz - cxz*(cyy-l), cxz*cxy - (cxx-l)*cyz, (cxx-l)*(cyy-l) - cxy*cxy] AS a, [cxy*(czz-l) - cxz*cyz, cxz*cxz - (cxx-l)*(czz-l), (cxx-l)*cyz - cxy*cxz] AS b, [(cyy-l)*(czz-l) - cyz*cyz, cyz*cxz - cxy*(czz-l), cxy*cyz - (cyy-l)*cxz] AS c FROM {name}_l),
{name}_b AS (SELECT *, CASE WHEN list_inner_product(a,a) >= list_inner_product(b,b) AND list_inner_product(a,a) >= list_inner_product(c,c) THEN a WHEN list_inner_product(b,b) >= list_inner_product(c,c) THEN b ELSE c END AS v FROM {name}_v),
{name} AS (SELECT cell_id, CASE WHEN n >= {least} THEN v[1] / sqrt(list_inner_product(v,v)) ELSE 0 END AS ax, CASE WHEN n >= {least} THEN v[2] / sqrt(list_inner_product(v,v)) ELSE 0 END AS ay, CASE WHEN n >= {least} THEN v[3] / sqrt(list_inner_product(v,v)) ELSE 1 END AS az, CASE WHEN n >= {least} THEN l / (cxx+cyy+czz) ELSE 0 END AS strength, n FROM {name}_b)
"""


def _strahler(most: int = 8) -> str:
    """Orders by cutting: order k are the nodes below which no fork is left once lower orders are gone."""
    parts, alive = [], "topo"
    for k in range(1, most + 1):
        parts.append(f"fk{k} AS (SELECT cell_id, parent AS id FROM {alive} WHERE NOT is_root GROUP BY 1, 2 HAVING count(*) > 1)")
        parts.append(f"up{k} AS (SELECT DISTINCT b.cell_id, b.anc AS id FROM below b JOIN fk{k} f ON f.cell_id = b.cell_id AND f.id = b.id)")
        parts.append(f"st{k} AS (SELECT a.cell_id, a.id, {k} AS strahler FROM {alive} a ANTI JOIN up{k} u ON u.cell_id = a.cell_id AND u.id = a.id)")
        parts.append(f"al{k} AS (SELECT a.* FROM {alive} a SEMI JOIN up{k} u ON u.cell_id = a.cell_id AND u.id = a.id)")
        alive = f"al{k}"
    return ", " + ", ".join(parts) + ", st AS (" + " UNION ALL ".join(f"SELECT * FROM st{k}" for k in range(1, most + 1)) + ")"


_NEURITES = "neurites AS (SELECT * FROM topo WHERE id <> proxy)"
_TURNED = _NEURITES + "," + _axis("ax0", "neurites", 5) + """,
axis AS (SELECT a.cell_id, a.ax * s AS ax, a.ay * s AS ay, a.az * s AS az, strength, top FROM ax0 a JOIN (SELECT t.cell_id, CASE WHEN max(a.n) >= 5 AND avg(dx*ax+dy*ay+dz*az) < 0 THEN -1.0 ELSE 1.0 END AS s, CASE WHEN max(a.n) >= 5 THEN greatest(max(abs(dx*ax+dy*ay+dz*az)), 1e-6) ELSE 1.0 END AS top FROM neurites t JOIN ax0 a ON a.cell_id = t.cell_id GROUP BY 1) u ON u.cell_id = a.cell_id)"""
#: Primary subtrees with what their branches take from them.
_PRIMARY = """,
prim0 AS (SELECT t.cell_id, t.primary_root AS pr, max(r.seq) AS rseq, max(r.path) AS rpath, max(t.path) AS mpath, max(t.z) - min(t.z) AS span, max(t.radial) AS mrad, min(t.radius) AS minr, avg(t.dz) AS mdz,
  (max(t.z) - min(t.z)) / greatest(sqrt((max(t.x)-min(t.x))*(max(t.x)-min(t.x)) + (max(t.y)-min(t.y))*(max(t.y)-min(t.y))), 1e-6) AS vh,
  coalesce(stddev_pop(CASE WHEN t.radial > 1e-9 THEN acos(greatest(-1.0, least(1.0, t.dz / t.radial))) END), 0) AS spread, sum(CASE WHEN t.id <> t.primary_root THEN t.edge ELSE 0 END) AS cable, count(*) FILTER (WHERE t.n_children >= 2) AS forks,
  min(CASE WHEN t.n_children <> 1 THEN t.path END) - max(r.path) AS ff, (list(t.id ORDER BY t.path DESC, t.seq))[1] AS tip, avg(t.dx*ax + t.dy*ay + t.dz*az) AS proj, max(a.top) AS top, max(strength) AS strength
  FROM topo t JOIN topo r ON r.cell_id = t.cell_id AND r.id = t.primary_root JOIN axis a ON a.cell_id = t.cell_id GROUP BY 1, 2),
prim AS (SELECT *, max(mpath) OVER w AS allpath, max(span) OVER w AS allspan, count(*) OVER w AS k,
  row_number() OVER (PARTITION BY cell_id ORDER BY span DESC, rseq) AS zr, row_number() OVER (PARTITION BY cell_id ORDER BY mrad DESC, rseq) AS rr, row_number() OVER (PARTITION BY cell_id ORDER BY proj DESC, rseq) AS axr,
  row_number() OVER (PARTITION BY cell_id ORDER BY CASE WHEN mdz > 0 THEN mdz + 0.1 * span END DESC NULLS LAST, rseq) AS tr
  FROM prim0 WINDOW w AS (PARTITION BY cell_id)),
cellstat AS (SELECT cell_id, max(path) AS mp, max(radial) AS mr, avg(radius) FILTER (WHERE id <> proxy) AS r, count(*) AS n, max(z) - min(z) AS zrange FROM topo GROUP BY 1),
segs AS (SELECT t.*, count(*) OVER (PARTITION BY t.cell_id, t.head) AS n, greatest(1, count(*) OVER (PARTITION BY t.cell_id, t.head) // 3) AS third FROM topo t WHERE t.primary_root IS NOT NULL),
br0 AS (SELECT cell_id, head AS branch, max(primary_root) AS pr, max(n) AS n, max(cell_type) AS cell_type, sum(CASE WHEN pos > 0 THEN edge ELSE 0 END) AS len, avg(radius) AS mr, avg(dz) AS mz, avg(CASE WHEN radius < 0.5 THEN 1.0 ELSE 0 END) AS thin, avg(radius) FILTER (WHERE pos < 3) AS r3,
  avg(radius) FILTER (WHERE pos < third) AS pmr, avg(radius) FILTER (WHERE pos >= n - third) AS dmr, sum(edge) FILTER (WHERE pos > 0 AND pos < third) AS ppath, sum(edge) FILTER (WHERE pos > n - third) AS dpath, count(*) FILTER (WHERE n_children >= 2) AS forks,
  max({'x': x, 'y': y, 'z': z}) FILTER (WHERE pos = 0) AS f, max({'x': x, 'y': y, 'z': z}) FILTER (WHERE pos = n - 1) AS l, max({'x': x, 'y': y, 'z': z}) FILTER (WHERE pos = third - 1) AS f1, max({'x': x, 'y': y, 'z': z}) FILTER (WHERE pos = n - third) AS l0,
  max({'x': dx, 'y': dy, 'z': dz, 'r': radial}) FILTER (WHERE pos = n // 2) AS m FROM segs GROUP BY 1, 2),
br AS (SELECT b.*, h.parent AS anchor, h.branch_order, a.radius AS ar, a.n_children AS ak, h.parent = h.proxy AS atsoma, sqrt((l.x-f.x)*(l.x-f.x)+(l.y-f.y)*(l.y-f.y)+(l.z-f.z)*(l.z-f.z)) AS chord,
  sqrt((f1.x-f.x)*(f1.x-f.x)+(f1.y-f.y)*(f1.y-f.y)+(f1.z-f.z)*(f1.z-f.z)) AS pchord, sqrt((l.x-l0.x)*(l.x-l0.x)+(l.y-l0.y)*(l.y-l0.y)+(l.z-l0.z)*(l.z-l0.z)) AS dchord FROM br0 b JOIN topo h ON h.cell_id = b.cell_id AND h.id = b.branch JOIN topo a ON a.cell_id = h.cell_id AND a.id = h.parent)
"""
_BRANCH_COLUMNS = {
    "n_nodes:l": "b.n", "path_length_rel:d": "b.len / c.mp", "radius_rel:d": "b.mr / c.r", "subtree_size_rel:d": "s.size * 1.0 / c.n", "sub_size:l": "s.size", "sub_max_depth:l": "s.depth", "sub_max_path:d": "s.path", "branch_order:l": "b.branch_order",
    "parent_radius:d": "b.ar", "radius_ratio_to_parent:d": "b.mr / b.ar", "n_siblings:l": "CASE WHEN atsoma THEN ak - 1 ELSE ak END", "is_primary:l": "CAST(atsoma AS INT)",
    "is_pyramidal:l": "CAST(cell_type = 'pyramidal' AS INT)", "is_interneuron:l": "CAST(cell_type = 'interneuron' AS INT)", "is_purkinje:l": "0",
    "is_longest_subtree:l": "CAST(p.mpath >= p.allpath - 1e-9 AS INT)", "subtree_path_ratio:d": "p.mpath / p.allpath", "subtree_z_ratio:d": "p.span / p.allspan",
    "subtree_z_rank:d": "CASE WHEN k > 1 THEN 1 - (zr - 1) * 1.0 / (k - 1) ELSE 1 END", "subtree_max_radial_rank:d": "CASE WHEN k > 1 THEN 1 - (rr - 1) * 1.0 / (k - 1) ELSE 1 END",
    "starts_at_soma:l": "CAST(atsoma AS INT)", "radius_drop_at_anchor:d": "(b.ar - r3) / b.ar", "thin_fraction:d": "thin", "min_radius_in_subtree:d": "p.minr", "proximal_mean_radius:d": "pmr", "distal_mean_radius:d": "dmr",
    "persistence:d": "CASE WHEN len > 1e-9 THEN chord / len ELSE 0.5 END",
    "proximal_persistence:d": "CASE WHEN b.n >= 3 AND ppath > 1e-9 THEN pchord / ppath WHEN len > 1e-9 THEN chord / len ELSE 0.5 END", "distal_persistence:d": "CASE WHEN b.n >= 3 AND dpath > 1e-9 THEN dchord / dpath WHEN len > 1e-9 THEN chord / len ELSE 0.5 END",
    "polar_angle_from_up:d": "CASE WHEN m.r > 1e-9 THEN acos(greatest(-1.0, least(1.0, m.z / m.r))) ELSE pi() / 2 END", "vertical_horizontal_span_ratio:d": "p.vh", "soma_z_offset_norm:d": "mz / greatest(c.zrange, 1e-6)",
    "is_trunk_primary:l": "CAST(p.mdz > 0 AND p.tr = 1 AS INT)", "primary_subtree_polar_spread:d": "p.spread", "principal_axis_projection:d": "(m.x*ax + m.y*ay + m.z*az) / p.top",
    "polar_angle_from_principal_axis:d": "CASE WHEN m.r > 1e-9 THEN acos(greatest(-1.0, least(1.0, (m.x*ax + m.y*ay + m.z*az) / m.r))) ELSE pi() / 2 END", "principal_axis_alignment_strength:d": "a.strength",
    "subtree_principal_projection:d": "p.proj / p.top", "subtree_principal_rank:d": "CASE WHEN k > 1 THEN 1 - (p.axr - 1) * 1.0 / (k - 1) ELSE 1 END",
    "bifurcations_per_micron:d": "CASE WHEN len > 1e-9 THEN b.forks / len ELSE 0 END", "mean_internode_distance:d": "CASE WHEN b.n > 1 THEN len / (b.n - 1) ELSE 0 END", "subtree_bifurcations_per_micron:d": "CASE WHEN p.cable > 1e-9 THEN p.forks / p.cable ELSE 0 END",
    "path_to_first_bifurcation_norm:d": "coalesce(p.ff, 0) / c.mp", "subtree_trunk_length_norm:d": "(p.mpath - p.rpath) / c.mp", "subtree_trunk_fraction:d": "CASE WHEN p.cable > 1e-9 THEN (p.mpath - p.rpath) / p.cable ELSE 0 END", "on_longest_path:l": "CAST(o.id IS NOT NULL AS INT)",
}


# ---------------------------------------------------------------- trees and feature tables

query("strahler", "cell_id:l id:l strahler:l", "SELECT * FROM st", TREE + BELOW + _strahler())(lambda spark, sf: forest.strahler(topo(spark, sf)))


@query("branch_segments_cut", "cell_id:l branch:l n:l", "SELECT t.cell_id, t.head AS branch, count(*) AS n FROM topo t JOIN bl ON bl.cell_id = t.cell_id AND bl.head = t.head ANTI JOIN lost ON lost.cell_id = t.cell_id AND lost.head = t.head WHERE t.primary_root IS NOT NULL AND (last IS NULL OR pos <= last) GROUP BY 1, 2", TREE + """,
bl AS (SELECT cell_id, head, min(pos) FILTER (WHERE pib > 180) AS last, max(pos) AS mx FROM topo WHERE primary_root IS NOT NULL GROUP BY 1, 2),
up AS (SELECT h.cell_id, h.id AS head, p.head AS uphead FROM topo h JOIN topo p ON p.cell_id = h.cell_id AND p.id = h.parent WHERE h.head = h.id AND p.head IS NOT NULL),
lost AS (SELECT up.cell_id, up.head FROM up JOIN bl ON bl.cell_id = up.cell_id AND bl.head = up.uphead WHERE bl.last < bl.mx UNION SELECT up.cell_id, up.head FROM up JOIN lost ON lost.cell_id = up.cell_id AND lost.head = up.uphead)""")
def _(spark, sf):
    return forest.branches(topo(spark, sf), 180.0).groupBy("cell_id", "branch").agg(F.count(F.lit(1)).alias("n"))


_EIGEN = _axis("sh", "topo", 3)
_SHOLL = """,
sx AS (SELECT cell_id, radial, max(radial) OVER (PARTITION BY cell_id) AS top FROM topo WHERE parent <> -1),
sh_n AS (SELECT cell_id, least(CAST(floor(radial / top * 20) AS INT), 19) AS bin, count(*) AS n, max(top) AS top FROM sx GROUP BY 1, 2),
sh_k AS (SELECT cell_id, arg_max(bin, n * 100 - bin) AS bin, max(n) AS n, max(top) AS top FROM sh_n GROUP BY 1),
sh_f AS (SELECT k.cell_id, k.n AS peak, (k.bin + 0.5) * k.top / 20 AS peak_at, CASE WHEN k.bin < 19 THEN (k.n - coalesce((SELECT sum(n) FROM sh_n s WHERE s.cell_id = k.cell_id AND s.bin > k.bin), 0) * 1.0 / (19 - k.bin)) / k.n ELSE 0 END AS decay FROM sh_k k)
"""


@query("cell_features", "cell_id:l n_nodes:l n_terminals:l terminal_ratio:d mean_path_length:d planarity:d linearity:d thickness_ratio:d max_strahler:l mean_strahler:d sholl_max_intersections:d sholl_peak_distance:d sholl_decay_rate:d terminal_radial_mean:d terminal_radial_std:d y_span:d",
       """SELECT t.cell_id, n_nodes, n_terminals, n_terminals * 1.0 / n_nodes AS terminal_ratio, mean_path_length, (l2 - l3) / l1 AS planarity, (l1 - l2) / l1 AS linearity, l3 / l1 AS thickness_ratio, max_strahler, mean_strahler, peak AS sholl_max_intersections, peak_at AS sholl_peak_distance, decay AS sholl_decay_rate, tm AS terminal_radial_mean, ts AS terminal_radial_std, y_span
 FROM (SELECT cell_id, count(*) AS n_nodes, count(*) FILTER (WHERE n_children = 0 AND NOT is_root) AS n_terminals, avg(path) FILTER (WHERE id <> proxy) AS mean_path_length, coalesce(avg(radial) FILTER (WHERE n_children = 0 AND NOT is_root), 0) AS tm, coalesce(stddev_pop(radial) FILTER (WHERE n_children = 0 AND NOT is_root), 0) AS ts, max(y) - min(y) AS y_span FROM topo GROUP BY 1) t
 JOIN (SELECT cell_id, max(strahler) AS max_strahler, avg(strahler) AS mean_strahler FROM st GROUP BY 1) s ON s.cell_id = t.cell_id JOIN sh_f ON sh_f.cell_id = t.cell_id
 JOIN (SELECT cell_id, l AS l1, l3, 3*q - l - l3 AS l2 FROM (SELECT *, q + 2*p*cos(acos(greatest(-1.0, least(1.0, (((cxx-q)*((cyy-q)*(czz-q)-cyz*cyz) - cxy*(cxy*(czz-q)-cyz*cxz) + cxz*(cxy*cyz-(cyy-q)*cxz)) / (p*p*p)) / 2))) / 3 + 2*pi()/3) AS l3 FROM sh_l) e) e ON e.cell_id = t.cell_id""", TREE + BELOW + _strahler() + "," + _EIGEN + _SHOLL)
def _(spark, sf):
    return features.cell_features(topo(spark, sf))


@query("cell_principal", "cell_id:l pc1_span:d pc1_max_above_soma:d pc1_max_below_soma:d pc1_radial_max:d pc1_asymmetry:d subtree_pc1_concentration:d subtree_pc1_top_alignment:d",
       """SELECT w.*, b.mass / b.every AS subtree_pc1_concentration, b.m / w.pc1_radial_max AS subtree_pc1_top_alignment FROM (SELECT cell_id, max(p) - min(p) AS pc1_span, greatest(0, max(p)) AS pc1_max_above_soma, greatest(0, -min(p)) AS pc1_max_below_soma, max(abs(p)) AS pc1_radial_max, (greatest(0, max(p)) - greatest(0, -min(p))) / (max(p) - min(p)) AS pc1_asymmetry FROM pp GROUP BY 1) w
 JOIN (SELECT cell_id, arg_max(mass, m) AS mass, max(m) AS m, sum(mass) AS every FROM (SELECT cell_id, primary_root, avg(p) AS m, sum(abs(p)) AS mass FROM pp WHERE primary_root IS NOT NULL GROUP BY 1, 2) g GROUP BY 1) b ON b.cell_id = w.cell_id""", TREE + "," + _EIGEN + """,
pp AS (SELECT t.cell_id, primary_root, (dx*ax+dy*ay+dz*az) * CASE WHEN avg(dx*ax+dy*ay+dz*az) OVER (PARTITION BY t.cell_id) < 0 THEN -1 ELSE 1 END AS p FROM topo t JOIN sh a ON a.cell_id = t.cell_id)""")
def _(spark, sf):
    return features.cell_principal(topo(spark, sf))


query("branch_features", "cell_id:l branch:l " + " ".join(_BRANCH_COLUMNS), "SELECT b.cell_id, b.branch, " + ", ".join(f"{v} AS {k.split(':')[0]}" for k, v in _BRANCH_COLUMNS.items()) + """
 FROM br b JOIN cellstat c ON c.cell_id = b.cell_id JOIN prim p ON p.cell_id = b.cell_id AND p.pr = b.pr JOIN axis a ON a.cell_id = b.cell_id
 JOIN (SELECT b.cell_id, b.anc, count(*) AS size, max(d.depth) - max(a.depth) AS depth, max(d.path) - max(a.path) AS path FROM below b JOIN topo d ON d.cell_id = b.cell_id AND d.id = b.id JOIN topo a ON a.cell_id = b.cell_id AND a.id = b.anc GROUP BY 1, 2) s ON s.cell_id = b.cell_id AND s.anc = b.branch
 LEFT JOIN (SELECT b.cell_id, b.anc, p.tip AS id FROM below b JOIN prim p ON p.cell_id = b.cell_id AND p.tip = b.id) o ON o.cell_id = b.cell_id AND o.anc = b.branch""", TREE + BELOW + "," + _TURNED + _PRIMARY)(lambda spark, sf: features.branch_features(topo(spark, sf)))


_ASYM = """(SELECT f.cell_id, t.primary_root, avg(abs(f.a - f.b) * 1.0 / greatest(1, f.a + f.b)) AS mean_asymmetry, max(abs(f.a - f.b) * 1.0 / greatest(1, f.a + f.b)) AS max_asymmetry FROM (SELECT cell_id, parent AS id, max(CASE WHEN rn = 1 THEN tips END) AS a, max(CASE WHEN rn = 2 THEN tips END) AS b FROM (
 SELECT k.cell_id, k.parent, row_number() OVER (PARTITION BY k.cell_id, k.parent ORDER BY k.seq) AS rn, g.tips FROM topo k JOIN (SELECT b.cell_id, b.anc, count(*) FILTER (WHERE d.n_children = 0) AS tips FROM below b JOIN topo d ON d.cell_id = b.cell_id AND d.id = b.id GROUP BY 1, 2) g ON g.cell_id = k.cell_id AND g.anc = k.id WHERE NOT k.is_root) q GROUP BY 1, 2) f
 JOIN topo t ON t.cell_id = f.cell_id AND t.id = f.id WHERE f.b IS NOT NULL AND t.primary_root IS NOT NULL GROUP BY 1, 2)"""


query("partition_asymmetry", "cell_id:l primary_root:l mean_asymmetry:d max_asymmetry:d", f"SELECT * FROM {_ASYM} a", TREE + BELOW)(lambda spark, sf: features.partition_asymmetry(topo(spark, sf)))


@query("lmeasure_vector", "cell_id:l primary_root:l mean_contraction:d mean_taper:d root_radius:d parent_radius:d mean_asymmetry:d is_pyr:l", f"""SELECT g.cell_id, g.pr AS primary_root, avg(CASE WHEN len > 1e-9 THEN chord / len ELSE 0.5 END) AS mean_contraction, avg(tp) AS mean_taper, max(r.radius) AS root_radius, max(r.pr) AS parent_radius, coalesce(max(a.mean_asymmetry), 0) AS mean_asymmetry, max(CAST(r.cell_type = 'pyramidal' AS INT)) AS is_pyr
 FROM br g JOIN (SELECT cell_id, head, avg(radius) FILTER (WHERE pos >= n - 3) / avg(radius) FILTER (WHERE pos < 3) AS tp FROM segs GROUP BY 1, 2) h ON h.cell_id = g.cell_id AND h.head = g.branch JOIN topo r ON r.cell_id = g.cell_id AND r.id = g.pr LEFT JOIN {_ASYM} a ON a.cell_id = g.cell_id AND a.primary_root = g.pr GROUP BY 1, 2""", TREE + BELOW + "," + _TURNED + _PRIMARY)
def _(spark, sf):
    return features.lmeasure_vector(topo(spark, sf))


@query("neurom_asymmetry", "cell_id:l branch:l partition_asymmetry:d is_pyramidal:l is_interneuron:l", """SELECT t.cell_id, t.branch, coalesce(k.asym, 0) AS partition_asymmetry, CAST(cell_type = 'pyramidal' AS INT) AS is_pyramidal, CAST(cell_type = 'interneuron' AS INT) AS is_interneuron
 FROM (SELECT cell_id, head AS branch, arg_max(id, pos) AS tail, max(cell_type) AS cell_type FROM topo WHERE primary_root IS NOT NULL GROUP BY 1, 2) t
 LEFT JOIN (SELECT cell_id, parent, (max(size) - min(size)) * 1.0 / greatest(1, max(size) + min(size)) AS asym FROM (SELECT k.cell_id, k.parent, g.size, row_number() OVER (PARTITION BY k.cell_id, k.parent ORDER BY g.size DESC, k.seq) AS rn FROM topo k JOIN (SELECT cell_id, anc, count(*) AS size FROM below GROUP BY 1, 2) g ON g.cell_id = k.cell_id AND g.anc = k.id WHERE NOT k.is_root) q WHERE rn <= 2 GROUP BY 1, 2 HAVING count(*) = 2) k ON k.cell_id = t.cell_id AND k.parent = t.tail""", TREE + BELOW)
def _(spark, sf):
    return features.neurom_branches(topo(spark, sf))


@query("branch_truth", "cell_id:l branch:l gt_label:l n2:l n3:l n4:l", "SELECT b.*, c.n2, c.n3, c.n4 FROM (SELECT cell_id, branch, label AS gt_label FROM (SELECT cell_id, head AS branch, type AS label, row_number() OVER (PARTITION BY cell_id, head ORDER BY count(*) DESC, min(seq)) AS rn FROM topo WHERE primary_root IS NOT NULL AND type <> 1 GROUP BY 1, 2, 3) q WHERE rn = 1) b JOIN (SELECT cell_id, head, count(*) FILTER (WHERE type = 2) AS n2, count(*) FILTER (WHERE type = 3) AS n3, count(*) FILTER (WHERE type = 4) AS n4 FROM topo WHERE primary_root IS NOT NULL GROUP BY 1, 2) c ON c.cell_id = b.cell_id AND c.head = b.branch", TREE)
def _(spark, sf):
    t = topo(spark, sf)
    got = features.branch_truth(t, forest.branches(t).select("cell_id", "id", "branch"))
    return got.select("*", *(F.coalesce(F.try_element_at("gt_label_counts", F.lit(k)), F.lit(0)).alias(f"n{k}") for k in (2, 3, 4)))


@query("subtree_truth", "cell_id:l primary_root:l gt_label:l n_labels:l", "SELECT b.*, c.n_labels FROM (SELECT cell_id, primary_root, label AS gt_label FROM (SELECT cell_id, primary_root, type AS label, row_number() OVER (PARTITION BY cell_id, primary_root ORDER BY count(*) DESC, min(seq)) AS rn FROM topo WHERE primary_root IS NOT NULL AND type <> 1 GROUP BY 1, 2, 3) q WHERE rn = 1) b JOIN (SELECT cell_id, primary_root, count(DISTINCT type) AS n_labels FROM topo WHERE primary_root IS NOT NULL AND type <> 1 GROUP BY 1, 2) c ON c.cell_id = b.cell_id AND c.primary_root = b.primary_root", TREE)
def _(spark, sf):
    t = topo(spark, sf).filter("primary_root IS NOT NULL")
    return features.branch_truth(t, t.select("cell_id", "id", "primary_root"), ("cell_id", "primary_root")).withColumn("n_labels", F.size("gt_label_counts"))


_TRUTH = "(SELECT cell_id, head AS branch, max(primary_root) AS primary_root, max(cell_type) AS cell_type, type AS label, count(*) AS n FROM topo WHERE primary_root IS NOT NULL AND type <> 1 GROUP BY cell_id, head, type)"


@query("rows_per_label", "cell_id:l branch:l label:l weight:d", f"SELECT cell_id, branch, label, n * CASE WHEN label <> 2 THEN 2.0 ELSE 1.0 END AS weight FROM {_TRUTH} t", TREE)
def _(spark, sf):
    t = topo(spark, sf)
    return metrics.rows_per_label(features.branch_truth(t, forest.branches(t).select("cell_id", "id", "branch")), dendrite_weight=2.0)


_MODE = "(SELECT * FROM (SELECT cell_id, head AS branch, max(cell_type) AS cell_type, max(primary_root) AS primary_root, type AS gt, row_number() OVER (PARTITION BY cell_id, head ORDER BY count(*) DESC, min(seq)) AS rn FROM topo WHERE primary_root IS NOT NULL AND type <> 1 GROUP BY cell_id, head, type) q WHERE rn = 1)"


def _branch_labels(spark, sf):
    t = topo(spark, sf)
    rows = forest.branches(t, more=("type", "seq", "cell_type", "primary_root"))
    kinds = rows.select("cell_id", "branch", "cell_type", "primary_root").distinct()
    return forest.label_mode(rows, ["cell_id", "branch"]).withColumnRenamed("label", "gt").join(kinds, ["cell_id", "branch"])


@query("valid_branches", "cell_type:s gt:l n:l", f"SELECT cell_type, gt, count(*) AS n FROM {_MODE} b WHERE gt IN (2, 3) OR (cell_type = 'pyramidal' AND gt = 4) GROUP BY 1, 2", TREE)
def _(spark, sf):
    return rules.valid_branches(_branch_labels(spark, sf)).groupBy("cell_type", "gt").agg(F.count(F.lit(1)).alias("n"))


@query("graph_vertices", "cell_id:l branch:l y:l", f"SELECT cell_id, branch, CASE gt WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE -100 END AS y FROM {_MODE} b", TREE)
def _(spark, sf):
    return prep.branch_labels(_branch_labels(spark, sf))


@query("dataset_stats", "n_files:l n_pyramidal:l n_interneuron:l n_branches_total:l n_apical_basal_total:l n_apical:l n_basal:l", f"SELECT count(DISTINCT cell_id) AS n_files, count(DISTINCT CASE WHEN cell_type = 'pyramidal' THEN cell_id END) AS n_pyramidal, count(DISTINCT CASE WHEN cell_type <> 'pyramidal' THEN cell_id END) AS n_interneuron, count(*) AS n_branches_total, count(*) FILTER (WHERE gt IN (3, 4)) AS n_apical_basal_total, count(*) FILTER (WHERE gt = 4) AS n_apical, count(*) FILTER (WHERE gt = 3) AS n_basal FROM {_MODE} b", TREE)
def _(spark, sf):
    return metrics.dataset_stats(prep.branch_labels(_branch_labels(spark, sf)))


# ---------------------------------------------------------------- rules

#: Probabilities for labels 2, 3, 4 that follow from a branch's number, the same in both engines.
_P = "[(branch % 7 + 1) / 20.0, (branch % 5 + 1) / 20.0, (branch % 3 + 1) / 20.0]"


def _proba(df):
    return df.withColumn("probability", F.array((F.col("branch") % 7 + 1) / 20.0, (F.col("branch") % 5 + 1) / 20.0, (F.col("branch") % 3 + 1) / 20.0))


_DECODED = f"(SELECT *, q[1] + q[2] + CASE WHEN cell_type = 'pyramidal' THEN q[3] ELSE 0 END AS s, CASE WHEN cell_type = 'pyramidal' THEN greatest(q[1], q[2], q[3]) ELSE greatest(q[1], q[2]) END AS top, CASE WHEN q[1] >= q[2] AND (cell_type <> 'pyramidal' OR q[1] >= q[3]) THEN 2 WHEN cell_type <> 'pyramidal' OR q[2] >= q[3] THEN 3 ELSE 4 END AS pred FROM (SELECT *, {_P} AS q FROM {_MODE} b) d)"


@query("decode", "cell_id:l branch:l pred:l conf:d", f"SELECT cell_id, branch, pred, top / s AS conf FROM {_DECODED} d", TREE)
def _(spark, sf):
    return rules.decode(_proba(_branch_labels(spark, sf)))


@query("decode_binary", "cell_id:l branch:l pred:l conf:d", f"SELECT cell_id, branch, CASE WHEN p > 0.5 THEN 2 ELSE 3 END AS pred, greatest(p, 1 - p) AS conf FROM (SELECT *, (branch % 11) / 10.0 AS p FROM {_MODE} b) d", TREE)
def _(spark, sf):
    return rules.decode_binary(_branch_labels(spark, sf).withColumn("p_axon", (F.col("branch") % 11) / 10.0))


_OWNERS = f"(SELECT cell_id, pr AS primary_root, q[1] AS p2, q[2] AS p3, q[3] AS p4, greatest(q[1], q[2], q[3]) AS conf, CASE WHEN q[1] >= q[2] AND q[1] >= q[3] THEN 2 WHEN q[2] >= q[3] THEN 3 ELSE 4 END AS pred FROM (SELECT cell_id, branch AS pr, {_P} AS q FROM (SELECT DISTINCT cell_id, primary_root AS branch FROM topo WHERE primary_root % 4 <> 0) x) d)"


def _owners(t):
    subs = t.filter("primary_root IS NOT NULL AND primary_root % 4 != 0").select("cell_id", "primary_root").distinct().withColumn("branch", F.col("primary_root"))
    return rules.owner_map(_proba(subs))


@query("owner_map", "cell_id:l primary_root:l prob_2:d prob_3:d prob_4:d pred:l conf:d", f"SELECT cell_id, primary_root, p2 AS prob_2, p3 AS prob_3, p4 AS prob_4, pred, conf FROM {_OWNERS} o", TREE)
def _(spark, sf):
    return _owners(topo(spark, sf))


@query("branch_owner", "cell_id:l branch:l owner_prob_2:d owner_prob_4:d owner_is_2:d owner_is_3:d owner_conf:d", f"SELECT b.cell_id, b.branch, coalesce(p2, 0) AS owner_prob_2, coalesce(p4, 0) AS owner_prob_4, CASE WHEN pred = 2 THEN 1 ELSE 0 END AS owner_is_2, CASE WHEN pred = 3 THEN 1 ELSE 0 END AS owner_is_3, coalesce(conf, 0) AS owner_conf FROM {_MODE} b LEFT JOIN {_OWNERS} o ON o.cell_id = b.cell_id AND o.primary_root = b.primary_root", TREE)
def _(spark, sf):
    return rules.with_owner(_branch_labels(spark, sf), _owners(topo(spark, sf)))


@query("subtree_mode", "cell_id:l branch:l pred:l conf:d", f"SELECT b.cell_id, b.branch, CASE WHEN o.pred IN (2, 3) OR (o.pred = 4 AND cell_type = 'pyramidal') THEN o.pred ELSE 3 END AS pred, coalesce(o.conf, 0.5) AS conf FROM {_MODE} b LEFT JOIN {_OWNERS} o ON o.cell_id = b.cell_id AND o.primary_root = b.primary_root", TREE)
def _(spark, sf):
    return rules.subtree_mode(_branch_labels(spark, sf), _owners(topo(spark, sf)))


@query("apical_owner", "cell_id:l owner:l", f"SELECT cell_id, owner FROM (SELECT cell_id, arg_max(primary_root, p4 * 1000000 - primary_root) AS owner, max(p4) AS p FROM {_OWNERS} o GROUP BY 1) q WHERE p >= 0.1", TREE)
def _(spark, sf):
    return rules.apical_owner(_owners(topo(spark, sf)), least=0.1)


@query("graph_override", "cell_id:l branch:l pred:l", f"SELECT d.cell_id, branch, CASE WHEN k.n = 2 AND pred IN (3, 4) THEN 3 + branch % 2 ELSE pred END AS pred FROM {_DECODED} d JOIN (SELECT cell_id, count(DISTINCT pred) FILTER (WHERE pred IN (3, 4)) AS n FROM {_DECODED} e GROUP BY 1) k ON k.cell_id = d.cell_id", TREE)
def _(spark, sf):
    return rules.override(rules.decode(_proba(_branch_labels(spark, sf))).withColumn("gnn", (3 + F.col("branch") % 2).cast("int")))


@query("fill_unassigned", "cell_id:l id:l pred:l conf:d", f"SELECT cell_id, id, CASE WHEN seq % 6 = 0 OR seq % 7 = 0 THEN 2 ELSE pred END AS pred, CASE WHEN seq % 6 = 0 OR seq % 7 = 0 THEN 0.3 ELSE conf END AS conf FROM ({PRED}) p")
def _(spark, sf):
    p = pred(spark, sf).withColumn("pred", F.when(F.col("seq") % 6 == 0, F.lit(None)).when(F.col("seq") % 7 == 0, 0).otherwise(F.col("pred")))
    return rules.fill_unassigned(p)


@query("labels_to_nodes", "cell_id:l id:l pred:l conf:d", f"SELECT t.cell_id, t.id, CASE WHEN t.id = t.proxy THEN 1 ELSE coalesce(d.pred, 2) END AS pred, coalesce(top / s, 0.3) AS conf FROM topo t LEFT JOIN {_DECODED} d ON d.cell_id = t.cell_id AND d.branch = t.head AND t.primary_root IS NOT NULL", TREE)
def _(spark, sf):
    t = topo(spark, sf)
    return rules.strip_soma(rules.to_nodes(t.drop("pred", "conf"), forest.branches(t), rules.decode(_proba(_branch_labels(spark, sf)))))


@query("legal_only", "cell_id:l id:l pred:l", f"SELECT cell_id, id, CASE WHEN pred = 4 AND cell_type <> 'pyramidal' THEN 2 ELSE pred END AS pred FROM ({PRED}) p")
def _(spark, sf):
    return rules.legal_only(pred(spark, sf))


_VOTES = "(SELECT cell_id, primary_root, sum(CASE WHEN pred = 2 THEN conf ELSE 0 END) AS v2, sum(CASE WHEN pred = 3 THEN conf ELSE 0 END) AS v3, sum(CASE WHEN pred = 4 THEN conf ELSE 0 END) AS v4, avg(dx*ax+dy*ay+dz*az) AS m FROM trees GROUP BY 1, 2)"


@query("single_apical", "cell_id:l id:l pred:l", f"SELECT t.cell_id, t.id, CASE WHEN l.n > 1 AND t.pred = 4 THEN 3 ELSE t.pred END AS pred FROM topo t LEFT JOIN (SELECT v.cell_id, v.primary_root, row_number() OVER (PARTITION BY v.cell_id ORDER BY m * s DESC, primary_root) AS n FROM {_VOTES} v JOIN (SELECT cell_id, CASE WHEN avg(dx*ax+dy*ay+dz*az) < 0 THEN -1 ELSE 1 END AS s FROM trees GROUP BY 1) u ON u.cell_id = v.cell_id WHERE v4 > v2 AND v4 > v3) l ON l.cell_id = t.cell_id AND l.primary_root = t.primary_root", TREE + ", below_soma AS (SELECT * FROM topo WHERE primary_root IS NOT NULL)," + _axis("pa", "below_soma", 3) + ", trees AS (SELECT t.*, ax, ay, az FROM below_soma t JOIN pa ON pa.cell_id = t.cell_id)")
def _(spark, sf):
    return rules.single_apical(topo(spark, sf))


@query("axon_bias", "cell_id:l id:l pred:l", """SELECT t.cell_id, t.id, CASE WHEN b.pr IS NOT NULL AND t.pred <> 1 AND t.conf < 0.6 THEN 2 ELSE t.pred END AS pred FROM topo t LEFT JOIN (SELECT cell_id, pr FROM (
 SELECT s.*, c.ra, row_number() OVER (PARTITION BY s.cell_id ORDER BY 0.6 * (1 - (r - r0) / (r1 - r0)) + 0.4 * p / p1 DESC, rseq) AS n FROM sub s JOIN (SELECT cell_id, min(r) AS r0, max(r) AS r1, max(p) AS p1, avg(r) AS ra FROM sub GROUP BY 1 HAVING count(*) >= 2 AND max(r) - min(r) >= 1e-9 AND max(p) >= 1e-9) c ON c.cell_id = s.cell_id) q WHERE n = 1 AND r <= ra * 0.75) b ON b.cell_id = t.cell_id AND b.pr = t.primary_root""", TREE + """,
sub AS (SELECT t.cell_id, t.primary_root AS pr, max(r.seq) AS rseq, avg(t.radius) AS r, max(t.path - r.path) AS p FROM topo t JOIN topo r ON r.cell_id = t.cell_id AND r.id = t.primary_root GROUP BY 1, 2 HAVING count(*) >= 10)""")
def _(spark, sf):
    return rules.axon_bias(topo(spark, sf), least=10)


own.QUERIES.pop("island_flip", None)


_ISLANDS = """,
reg AS (SELECT t.cell_id, t.id, t.seq, t.parent, t.pred, t.conf, t.id AS region FROM topo t LEFT JOIN topo u ON u.cell_id = t.cell_id AND u.id = t.parent
   WHERE t.id <> t.proxy AND (t.is_root OR u.id = u.proxy OR u.pred <> t.pred)
  UNION ALL SELECT t.cell_id, t.id, t.seq, t.parent, t.pred, t.conf, r.region FROM reg r JOIN topo t ON t.cell_id = r.cell_id AND t.parent = r.id AND t.pred = r.pred AND t.id <> t.proxy AND NOT t.is_root),
reg1 AS (SELECT * FROM reg WHERE pred <> 1),
whole AS (SELECT cell_id, region, min(seq) AS first, count(*) <= 15 AND round(avg(conf), 12) < 0.75 AS open FROM reg1 GROUP BY 1, 2),
touch AS (SELECT c.cell_id, c.id, c.seq, c.pred, c.region, cw.first, p.id AS up, p.pred AS up_pred, p.region AS up_region, pw.first AS up_first
  FROM reg1 c JOIN reg1 p ON p.cell_id = c.cell_id AND p.id = c.parent AND p.region <> c.region JOIN whole cw ON cw.cell_id = c.cell_id AND cw.region = c.region JOIN whole pw ON pw.cell_id = p.cell_id AND pw.region = p.region),
around AS (SELECT cell_id, region, id AS at_, -1 AS place, up_pred AS label FROM touch WHERE up_first > first UNION ALL SELECT cell_id, up_region, up, seq, pred FROM touch WHERE first > up_first),
bfs AS (SELECT w.cell_id, w.region, r.id, r.parent, CAST(NULL AS INT) AS prev, CAST([] AS BIGINT[]) AS way FROM whole w JOIN reg1 r ON r.cell_id = w.cell_id AND r.region = w.region AND r.seq = w.first WHERE w.open
  UNION ALL SELECT b.cell_id, b.region, y.id, y.parent, b.id, list_append(b.way, CASE WHEN y.id = b.parent THEN -1 ELSE y.seq END) FROM bfs b JOIN reg1 y ON y.cell_id = b.cell_id AND y.region = b.region AND (y.id = b.parent OR y.parent = b.id) AND (b.prev IS NULL OR y.id <> b.prev)),
said AS (SELECT a.cell_id, a.region, a.label, count(*) AS n, min(list_concat([CAST(len(b.way) AS BIGINT)], list_append(b.way, a.place))) AS met FROM around a JOIN bfs b ON b.cell_id = a.cell_id AND b.region = a.region AND b.id = a.at_ GROUP BY 1, 2, 3),
flips AS (SELECT cell_id, region, label FROM said QUALIFY row_number() OVER (PARTITION BY cell_id, region ORDER BY n DESC, met) = 1)
"""


@query("island_flip", "cell_id:l id:l pred:l", "SELECT t.cell_id, t.id, coalesce(f.label, t.pred) AS pred FROM topo t LEFT JOIN reg1 r ON r.cell_id = t.cell_id AND r.id = t.id LEFT JOIN flips f ON f.cell_id = r.cell_id AND f.region = r.region", TREE + _ISLANDS)
def _(spark, sf):
    return rules.flip_islands(topo(spark, sf))


@query("random_labels", "cell_type:s pred:l n:l", f"""SELECT cell_type, pred, count(*) AS n FROM (SELECT cell_type, CASE WHEN type = 1 THEN 1 WHEN u < v2 THEN 2 WHEN u < v2 + v3 OR cell_type <> 'pyramidal' THEN 3 ELSE 4 END AS pred FROM (
 SELECT n.*, v2, v3, CAST(CAST('0x' || substr(md5('42:' || cell_id || ':' || id), 1, 8) AS BIGINT) AS DOUBLE) / 4294967295.0 * (v2 + v3 + CASE WHEN cell_type = 'pyramidal' THEN v4 ELSE 0 END) AS u FROM ({NODES}) n CROSS JOIN (SELECT count(*) FILTER (WHERE type = 2) * 1.0 / count(*) AS v2, count(*) FILTER (WHERE type = 3) * 1.0 / count(*) AS v3, count(*) FILTER (WHERE type = 4) * 1.0 / count(*) AS v4 FROM ({NODES}) m WHERE type <> 1) s) q) r GROUP BY 1, 2""")
def _(spark, sf):
    n = nodes(spark, sf)
    return rules.random_labels(n, metrics.prior(n)).groupBy("cell_type", "pred").agg(F.count(F.lit(1)).alias("n"))


_CELLS = """(SELECT t.cell_id, max(cell_type) AS cell_type, count(*) AS n_nodes, count(*) FILTER (WHERE is_root) AS n_root_nodes, count(*) FILTER (WHERE n_children >= 2) * 1.0 / count(*) AS ratio, count(*) FILTER (WHERE parent = proxy AND NOT is_root) AS trees, max(z) - min(z) AS z_span, abs((greatest(0, max(dz)) - greatest(0, -min(dz))) / (max(z) - min(z))) AS za, max(s.top) AS top, max(s.std) AS std
 FROM topo t LEFT JOIN (SELECT cell_id, max(n) AS top, stddev_pop(n) AS std FROM (SELECT cell_id, primary_root, count(*) AS n FROM topo WHERE primary_root IS NOT NULL GROUP BY 1, 2) x GROUP BY 1) s ON s.cell_id = t.cell_id GROUP BY 1)"""
_FLAGS = f"(SELECT *, n_root_nodes > 1 AS multi, za > 0.3 AND z_span > 100 AS zasym, cell_type = 'pyramidal' AND za > 0.2 AND z_span > 150 AS apical, n_nodes > 5000 AS large, ratio > 0.15 AS high FROM {_CELLS} c)"
_GUESS = f"""(SELECT *, CASE WHEN p + i > 0 THEN p / (p + i) ELSE 0.5 END AS pp, CASE WHEN p + i > 0 THEN i / (p + i) ELSE 0.5 END AS pi FROM (SELECT *,
 CASE WHEN trees >= 3 THEN 0.15 ELSE 0 END + CASE WHEN z_span > 200 AND za > 0.2 THEN 0.2 ELSE 0 END + CASE WHEN top > 1000 AND std > 200 THEN 0.2 ELSE 0 END + CASE WHEN ratio > 0.05 AND ratio < 0.18 THEN 0.1 ELSE 0 END + CASE WHEN trees >= 3 AND std > 200 THEN 0.1 ELSE 0 END AS p,
 CASE WHEN za < 0.15 AND z_span < 250 THEN 0.2 ELSE 0 END + CASE WHEN za < 0.15 THEN 0.15 ELSE 0 END + CASE WHEN ratio > 0.1 THEN 0.1 ELSE 0 END + CASE WHEN trees >= 3 AND std < 300 THEN 0.1 ELSE 0 END + CASE WHEN n_nodes < 3000 THEN 0.05 ELSE 0 END AS i FROM {_FLAGS} f) g)"""


def _cells(spark, sf):
    t = topo(spark, sf)
    return features.cell_counts(t).join(features.cell_extent(t), "cell_id").join(features.cell_subtrees(t), "cell_id").join(t.select("cell_id", "cell_type").distinct(), "cell_id")


@query("structure_flags", "cell_id:l multi:l zasym:l apical:l large:l high:l", f"SELECT cell_id, CAST(multi AS INT) AS multi, CAST(zasym AS INT) AS zasym, CAST(apical AS INT) AS apical, CAST(large AS INT) AS large, CAST(high AS INT) AS high FROM {_FLAGS} f", TREE)
def _(spark, sf):
    names = {"multi": "multi_root", "zasym": "z_asymmetric", "apical": "apical_candidate", "large": "large_morphology", "high": "high_branching"}
    return rules.structure_flags(_cells(spark, sf)).select("cell_id", *(F.col("flags")[v].cast("int").alias(k) for k, v in names.items()))


@query("guess_cell_type", "cell_id:l p_pyramidal:d p_interneuron:d guess:s n_labels:l", f"SELECT cell_id, pp AS p_pyramidal, pi AS p_interneuron, CASE WHEN pp >= pi THEN 'pyramidal' ELSE 'interneuron' END AS guess, CASE WHEN pp >= pi AND NOT (pi > 0.7 * pp AND NOT apical AND NOT zasym) THEN 4 ELSE 3 END AS n_labels FROM {_GUESS} g", TREE)
def _(spark, sf):
    return rules.label_sets(rules.guess_cell_type(rules.structure_flags(_cells(spark, sf)))).withColumn("n_labels", F.size("label_set"))


@query("soft_handoff", "cell_id:l cell_type:s handed_off:l", f"""SELECT cell_id, chosen AS cell_type, CAST(chosen <> own AS INT) AS handed_off FROM (SELECT cell_id, CASE WHEN conf >= 0.65 THEN own WHEN bp >= bi THEN 'pyramidal' ELSE 'interneuron' END AS chosen, own FROM (SELECT cell_id, max(cell_type) AS own, max(cell_id % 10) / 10.0 AS conf, avg(CASE WHEN seq % 2 = 0 THEN radius ELSE 0 END) AS bp, avg(CASE WHEN seq % 3 = 0 THEN radius ELSE 0 END) AS bi FROM ({NODES}) n GROUP BY 1) q) r""")
def _(spark, sf):
    c = nodes(spark, sf).groupBy("cell_id").agg(F.max("cell_type").alias("own_type"), (F.max(F.col("cell_id") % 10) / 10.0).alias("type_conf"), F.avg(F.when(F.col("seq") % 2 == 0, F.col("radius")).otherwise(0.0)).alias("p"), F.avg(F.when(F.col("seq") % 3 == 0, F.col("radius")).otherwise(0.0)).alias("i"))
    trials = c.select("cell_id", "own_type", "type_conf", F.explode(F.array(F.struct(F.lit("pyramidal").alias("t"), F.col("p").alias("b")), F.struct(F.lit("interneuron").alias("t"), F.col("i").alias("b")))).alias("x"))
    return rules.soft_handoff(trials.select("cell_id", "own_type", "type_conf", F.col("x.t").alias("cell_type"), F.col("x.b").alias("branch_conf")))


# ---------------------------------------------------------------- quality control

_QC = """(SELECT *, CASE WHEN array_contains(types, 1) THEN 0 ELSE 100 END + CASE WHEN array_contains(types, 2) THEN 0 ELSE 2 END + CASE WHEN trees <= 1 THEN 2 ELSE 0 END + CASE WHEN cell_type = 'pyramidal' AND NOT array_contains(types, 4) THEN 1 ELSE 0 END
 + CAST(z < 0.35 * mz AS INT) + CAST(xr < 0.35 * mxr AS INT) + CAST(ar < 0.40 * mar AS INT) + CAST(xd < 0.35 * mxd AS INT) + CAST(ad < 0.45 * mad AS INT) + CAST(z > 3.5 * mz AS INT) + CAST(xr > 2.5 * mxr AS INT) + CAST(ar > 2.5 * mar AS INT) + CAST(xd > 3.0 * mxd AS INT) + CAST(sd > 3.0 * msd AS INT)
 + 3 * CAST(compact AND NOT array_contains(types, 2) AS INT) + 3 * CAST(compact AND cell_type = 'pyramidal' AND NOT array_contains(types, 4) AS INT) + 2 * CAST(compact AND cell_type = 'pyramidal' AND xd < 0.35 * mxd AS INT) + 3 * CAST(cell_type = 'interneuron' AND z > 3.5 * mz AND xr > 2.5 * mxr AS INT) + 2 * CAST(cell_type = 'interneuron' AND ar > 2.5 * mar AND sd > 3.0 * msd AS INT) AS qc_score,
 (compact AND NOT array_contains(types, 2)) OR (compact AND cell_type = 'pyramidal' AND NOT array_contains(types, 4)) OR (cell_type = 'interneuron' AND z > 3.5 * mz AND xr > 2.5 * mxr) OR NOT array_contains(types, 1) AS hard
 FROM (SELECT f.*, mz, mxr, mar, mxd, mad, msd, trees <= 1 AND z < 0.35 * mz AND xr < 0.35 * mxr AS compact FROM feat f JOIN (SELECT cell_type, quantile_cont(z, 0.5) AS mz, quantile_cont(xr, 0.5) AS mxr, quantile_cont(ar, 0.5) AS mar, quantile_cont(xd, 0.5) AS mxd, quantile_cont(ad, 0.5) AS mad, quantile_cont(sd, 0.5) AS msd FROM feat GROUP BY 1) m ON m.cell_type = f.cell_type) g)"""
_FEAT = """,
feat AS (SELECT cell_id, max(cell_type) AS cell_type, list(DISTINCT type) AS types, count(*) FILTER (WHERE parent = proxy AND NOT is_root) AS trees, max(z) - min(z) AS z, max(radial) AS xr, avg(radial) AS ar, max(radius) FILTER (WHERE id <> proxy) AS xd, avg(radius) FILTER (WHERE id <> proxy) AS ad, stddev_pop(radius) FILTER (WHERE id <> proxy) AS sd FROM topo GROUP BY 1)"""


def _qc(spark, sf):
    t = topo(spark, sf)
    c = features._aggregated(t, features.COUNTS, features.PATHS, features.RADIUS, features.EXTENT, features.SHAPE)
    return qc.score(c.join(t.select("cell_id", "cell_type").distinct(), "cell_id").join(swc.type_sets(t), "cell_id"))


query("qc_filter", "cell_id:l qc_score:l status:s", f"SELECT cell_id, qc_score, CASE WHEN hard OR qc_score >= 6 THEN 'drop' ELSE 'keep' END AS status FROM {_QC} q", TREE + _FEAT)(lambda spark, sf: _qc(spark, sf))


@query("qc_summary", "cell_type:s kept:l dropped:l examples:s", f"SELECT k.cell_type, kept, dropped, e.examples FROM (SELECT cell_type, count(*) FILTER (WHERE NOT (hard OR qc_score >= 2)) AS kept, count(*) FILTER (WHERE hard OR qc_score >= 2) AS dropped FROM {_QC} q GROUP BY 1) k LEFT JOIN (SELECT cell_type, string_agg(CAST(cell_id AS VARCHAR), ' ' ORDER BY cell_id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY cell_id) AS n FROM {_QC} q WHERE hard OR qc_score >= 2) r WHERE n <= 20 GROUP BY 1) e ON e.cell_type = k.cell_type", TREE + _FEAT)
def _(spark, sf):
    s = _qc(spark, sf)
    hard = F.exists("reasons", lambda r: (r["weight"] >= 100) | r["code"].isin(*qc.SUFFICIENT))
    return qc.filter_summary(s.withColumn("status", F.when(hard | (F.col("qc_score") >= 2), "drop").otherwise("keep"))).withColumn("examples", F.array_join("examples", " "))


@query("reason_counts", "cell_type:s n:l low:l high:l", f"SELECT cell_type, sum(lo + hi) AS n, sum(lo) AS low, sum(hi) AS high FROM (SELECT cell_type, CAST(z < 0.35 * mz AS INT) + CAST(xr < 0.35 * mxr AS INT) + CAST(ar < 0.40 * mar AS INT) + CAST(xd < 0.35 * mxd AS INT) + CAST(ad < 0.45 * mad AS INT) AS lo, CAST(z > 3.5 * mz AS INT) + CAST(xr > 2.5 * mxr AS INT) + CAST(ar > 2.5 * mar AS INT) + CAST(xd > 3.0 * mxd AS INT) + CAST(sd > 3.0 * msd AS INT) AS hi FROM {_QC} q) c GROUP BY 1 HAVING sum(lo + hi) > 0", TREE + _FEAT)
def _(spark, sf):
    n = qc.reason_counts(_qc(spark, sf)).filter(F.col("code").rlike("^(low|high)_"))
    return n.groupBy("cell_type").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("code").startswith("low_"), F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(F.col("code").startswith("high_"), F.col("n")).otherwise(0)).alias("high"))


_PRUNED = f"(SELECT s.file_name, s.cell_type, s.f1_milli AS f1, d.verdict, d.verdict IN ('borderline', 'bad') AND s.f1_milli <= 850 AS drop_ FROM (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY f1_milli, file_name) AS n FROM {_F} q) r WHERE n <= 1500) s JOIN (SELECT 'allen__' || cell_id || '_m0.swc' AS file_name, verdict FROM ({_SQL_DIAGNOSED}) x) d ON d.file_name = s.file_name)"


def _pruned(spark, sf):
    d = qc.diagnose(nodes(spark, sf), ["cell_id", "cell_type"]).withColumn("file_name", F.concat(F.lit("allen__"), F.col("cell_id"), F.lit("_m0.swc"))).select("file_name", "verdict")
    return qc.prune(_file_scores(spark, sf).select("file_name", "cell_type", "f1"), d, 1500, ("borderline", "bad"), 850)


query("qc_prune", "file_name:s f1:l drop:l", f"SELECT file_name, f1, CAST(drop_ AS INT) AS drop FROM {_PRUNED} p")(lambda spark, sf: _pruned(spark, sf))


@query("drop_list", "cell_type:s n:l", f"SELECT cell_type, count(*) AS n FROM ({FILES}) s WHERE NOT EXISTS (SELECT 1 FROM {_PRUNED} p WHERE p.drop_ AND p.file_name = s.file_name AND p.cell_type = s.cell_type) GROUP BY 1")
def _(spark, sf):
    return qc.without_dropped(files(spark, sf), _pruned(spark, sf).filter("drop")).groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"))


@query("clean_soma", "cell_id:l id:l type:l parent:l", "SELECT n.cell_id, n.id, n.type, coalesce(g.anchor, n.parent) AS parent FROM n LEFT JOIN grp s ON s.cell_id = n.cell_id AND s.id = n.id LEFT JOIN grp g ON g.cell_id = n.cell_id AND g.id = n.parent AND g.id <> g.anchor WHERE s.anchor IS NULL OR s.anchor = n.id", f"""
n AS (SELECT cell_id, seq, id, CASE WHEN id <= 4 THEN 1 ELSE type END AS type, parent FROM ({NODES}) q),
grp AS (SELECT s.cell_id, s.id, s.id AS anchor FROM n s LEFT JOIN n p ON p.cell_id = s.cell_id AND p.id = s.parent AND p.type = 1 WHERE s.type = 1 AND p.id IS NULL UNION ALL SELECT s.cell_id, s.id, g.anchor FROM grp g JOIN n s ON s.cell_id = g.cell_id AND s.parent = g.id AND s.type = 1)""")
def _(spark, sf):
    return qc.clean_soma(nodes(spark, sf).withColumn("type", F.when(F.col("id") <= 4, 1).otherwise(F.col("type"))))


@query("clean_report", "cell_id:l original_soma_count:l cleaned_soma_count:l removed_soma_nodes:l cleanup_action:s", f"SELECT cell_id, least(count(*), 4) AS original_soma_count, 1 AS cleaned_soma_count, least(count(*), 4) - 1 AS removed_soma_nodes, CASE WHEN count(*) > 1 THEN 'consolidated' ELSE 'unchanged' END AS cleanup_action FROM ({NODES}) n GROUP BY 1")
def _(spark, sf):
    n = nodes(spark, sf).withColumn("type", F.when(F.col("id") <= 4, 1).otherwise(F.col("type")))
    return qc.clean_report(n, qc.clean_soma(n))


# ---------------------------------------------------------------- names, sources and data sets

_PATHS = f"(SELECT file_name, cell_type, f1_milli, '/data/' || CASE WHEN f1_milli % 3 = 0 THEN '' ELSE 'batch_' || (f1_milli % 4) || '/' || CASE WHEN f1_milli % 3 = 1 THEN 'original' ELSE 'no_label' END || '/' END || CASE WHEN cell_type = 'pyramidal' THEN 'Pyra-midal Cells/swc/' ELSE 'Interneuron/' END || file_name AS path FROM ({FILES}) s)"


def _paths(spark, sf):
    k = F.col("f1_milli")
    batch = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("batch_"), k % 4, F.lit("/"), F.when(k % 3 == 1, "original").otherwise("no_label"), F.lit("/")))
    kind = F.when(F.col("cell_type") == "pyramidal", "Pyra-midal Cells/swc/").otherwise("Interneuron/")
    return files(spark, sf).withColumn("path", F.concat(F.lit("/data/"), batch, kind, "file_name"))


@query("path_parts", "file_name:s kind:s batch:s part:s base:s", f"SELECT file_name, CASE WHEN cell_type = 'pyramidal' THEN 'pyra_midal_cells' ELSE 'interneuron' END AS kind, regexp_extract(path, '/(batch_[^/]+)/', 1) AS batch, regexp_extract(path, '/batch_[^/]+/(original|no_label)/', 1) AS part, split_part(path, '/', -1) AS base FROM {_PATHS} p")
def _(spark, sf):
    p = F.col("path")
    return _paths(spark, sf).select("file_name", swc.class_folder(p).alias("kind"), swc.batch_folder(p).alias("batch"), swc.batch_part(p).alias("part"), scalars.basename(p).alias("base"))


@query("score_columns", "file_name:s f1:d", f"SELECT file_name, f1_milli / 1000.0 AS f1 FROM {_PATHS} p WHERE f1_milli % 10 <> 0")
def _(spark, sf):
    df = _paths(spark, sf).select("path", F.when(F.col("f1_milli") % 10 == 0, "n/a").otherwise((F.col("f1_milli") / 1000.0).cast("string")).alias("neurite_macro_f1_stage23"), F.lit("0").alias("neurite_macro_f1"))
    return tables.read_scores(df)


@query("long_scores", "method:s file_name:s f1:d", f"SELECT method, file_name, CASE WHEN f1_milli % 10 = 0 THEN 0 ELSE f1_milli / 1000.0 END AS f1 FROM ({SCORES}) s")
def _(spark, sf):
    s = scores(spark, sf).select("method", F.concat(F.lit("a/b/"), "file_name").alias("path"), F.when(F.col("f1_milli") % 10 == 0, "").otherwise((F.col("f1_milli") / 1000.0).cast("string")).alias("neurite_macro_f1"))
    return tables.read_long_scores(s.withColumn("line", F.lit(2)).unionByName(s.withColumns({"neurite_macro_f1": F.lit("0.5"), "line": F.lit(1)})), F.col("line"))


@query("result_block", "k:l overall:s", "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN '{\"f1\":' || n_regionkey || '}' WHEN n_nationkey % 3 = 1 THEN '{\"f1\":' || (n_regionkey + 10) || '}' ELSE '{}' END AS overall FROM nation")
def _(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("v"))
    j = n.select("k", F.when(F.col("k") % 3 == 0, F.struct(F.col("v").alias("f1"))).alias("overall_stage23"), F.when(F.col("k") % 3 == 1, F.struct((F.col("v") + 10).alias("f1"))).alias("overall"))
    return tables.overall_block(j, "k")


@query("split_file", "cell_type:s file_name:s", f"SELECT cell_type, file_name FROM ({SCORES}) s WHERE method = 'm1' AND f1_milli < 200")
def _(spark, sf):
    s = scores(spark, sf).filter("method = 'm1' AND f1_milli < 200").select("cell_type", F.concat(F.lit("x\\y/"), "file_name").alias("p"))
    one = s.groupBy("cell_type").agg(F.collect_list("p").alias("p"))  # the list that a split file holds
    return tables.split_files(one.select(F.create_map("cell_type", "p").alias("test_files")))


@query("scalars", "file_name:s verdict:s pct:s ratio:d half:d clean:s error:l cls:s copied:s", f"""SELECT file_name, CASE WHEN f1_milli % 2 = 0 THEN 'BAD' ELSE 'OK' END AS verdict, printf('%.1f%%', f1_milli / 10.0) AS pct, CASE WHEN f1_milli % 5 = 0 THEN 0 ELSE f1_milli * 1.0 / (f1_milli % 5) END AS ratio, round_even(f1_milli / 8.0, 2) AS half, replace(replace(replace('a;b c/' || file_name, ';', '_'), ' ', '_'), '/', '_') AS clean, CAST(f1_milli % 2 = 0 AS INT) AS error, CASE f1_milli % 4 WHEN 0 THEN 'pyramidal' WHEN 1 THEN 'interneuron' WHEN 2 THEN 'interneuron' END AS cls,
 CASE split_part(file_name, '__', 1) WHEN 'neuromorpho' THEN 'neuromorpho__Smith_lab__' ELSE split_part(file_name, '__', 1) || '__' || CASE split_part(file_name, '__', 1) WHEN 'allen' THEN CAST(f1_milli AS VARCHAR) ELSE 'na' END || '__' END || file_name AS copied FROM ({SCORES}) s WHERE method = 'm2'""")
def _(spark, sf):
    k = F.col("f1_milli")
    s = scores(spark, sf).filter("method = 'm2'").withColumn("src", scalars.source_of(F.col("file_name")))
    return s.select(
        "file_name", scalars.verdict_class(F.concat(F.when(k % 2 == 0, "BAD").otherwise("OK"), F.lit(" — see notes"))).alias("verdict"), scalars.percent(k / 1000.0).alias("pct"), scalars.safe_div(k.cast("double"), (k % 5).cast("double")).alias("ratio"), scalars.rounded(scalars.finite(k / 8.0), 2).alias("half"),
        scalars.clean_name(F.concat(F.lit("a;b c/"), "file_name")).alias("clean"), scalars.is_error_page(F.when(k % 2 == 0, "<!doctype><HTML>").otherwise("1 1 0 0 0 1 -1")).cast("int").alias("error"),
        scalars.dendrite_class(F.element_at(F.array(*map(F.lit, ("spiny", "aspiny", "sparsely spiny", "other"))), (k % 4 + 1).cast("int"))).alias("cls"),
        prep.copied_name(F.col("src"), F.col("file_name"), F.lit(" Smith lab "), k, F.lit(None).cast("string")).alias("copied"),
    )


_TYPES = f"(SELECT cell_id, max(cell_type) AS cell_type, list_sort(list(DISTINCT t)) AS types FROM (SELECT cell_id, cell_type, CASE WHEN type = 4 AND cell_id % 3 = 0 THEN 3 WHEN type = 1 AND cell_id % 7 = 0 THEN 2 ELSE type END AS t FROM ({NODES}) n) q GROUP BY 1)"


def _types(spark, sf):
    n = nodes(spark, sf).withColumn("type", F.when((F.col("type") == 4) & (F.col("cell_id") % 3 == 0), 3).when((F.col("type") == 1) & (F.col("cell_id") % 7 == 0), 2).otherwise(F.col("type")))
    return swc.type_sets(n).join(n.select("cell_id", "cell_type").distinct(), "cell_id")


@query("label_gates", "cell_id:l complete:l apical:l neurites:s", f"SELECT cell_id, CAST((cell_type = 'pyramidal' AND types IN ([1,2,3], [1,2,3,4])) OR (cell_type = 'interneuron' AND types IN ([1,2], [1,3], [1,2,3])) AS INT) AS complete, CAST(list_contains(types, 4) AS INT) AS apical, array_to_string(list_filter(types, lambda x: x <> 1), ' ') AS neurites FROM {_TYPES} t")
def _(spark, sf):
    t = F.col("types")
    return _types(spark, sf).select("cell_id", scalars.canonical_labels(F.col("cell_type"), t).cast("int").alias("complete"), scalars.holds_labels(t, (4,)).cast("int").alias("apical"), F.array_join(scalars.neurite_labels(t), " ").alias("neurites"))


_FILES = f"(SELECT cell_type, types, 'd/' || (cell_id % 50) || '.swc' AS path, (cell_id % 50) || '.swc' AS file_name, cell_id FROM {_TYPES} t)"


def _files(spark, sf):
    return _types(spark, sf).select("cell_type", "types", F.concat(F.lit("d/"), F.col("cell_id") % 50, F.lit(".swc")).alias("path"), "cell_id")


@query("merged_sets", "file_name:s cell_type:s", f"SELECT 'c' || cell_id AS file_name, cell_type FROM {_TYPES} t WHERE cell_id % 2 = 0 UNION ALL SELECT 'hpf_ca1__' || cell_id, cell_type FROM {_TYPES} t WHERE cell_id % 2 = 1 AND list_contains(types, 4)")
def _(spark, sf):
    t = _types(spark, sf)
    return prep.merge_sets(t.filter("cell_id % 2 = 0").withColumn("file_name", F.concat(F.lit("c"), "cell_id")), t.filter("cell_id % 2 = 1").withColumn("file_name", F.col("cell_id").cast("string")))


@query("source_pool", "cell_id:l copied_file:s type_set:s meta_archive:s", f"""SELECT f.cell_id, 'neuromorpho__' || coalesce(a.archive, b.archive, 'na') || '__' || file_name AS copied_file, array_to_string(types, ' ') AS type_set, coalesce(a.archive, b.archive) AS meta_archive FROM {_FILES} f LEFT JOIN (SELECT n_nationkey || '.swc' AS fn, 'A' || n_nationkey AS archive FROM nation WHERE n_nationkey % 2 = 0) a ON a.fn = f.file_name AND f.cell_type = 'pyramidal' LEFT JOIN (SELECT n_nationkey || '.swc' AS fn, 'B' || n_nationkey AS archive FROM nation) b ON b.fn = f.file_name AND f.cell_type = 'pyramidal'
 WHERE (f.cell_type = 'pyramidal' AND types IN ([1,2,3], [1,2,3,4])) OR (f.cell_type = 'interneuron' AND types IN ([1,2], [1,3], [1,2,3]))""")
def _(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.col("n_nationkey"), F.lit(".swc")).alias("file_name"), F.lit("pyramidal").alias("cell_type"), "n_nationkey")
    meta = [n.filter("n_nationkey % 2 = 0").select("file_name", "cell_type", F.concat(F.lit("A"), "n_nationkey").alias("archive")), n.select("file_name", "cell_type", F.concat(F.lit("B"), "n_nationkey").alias("archive"))]
    return prep.source_pool(_files(spark, sf).withColumn("source", F.lit("neuromorpho")), meta)


@query("benchmark_candidates", "source:s cell_type:s n:l", f"""SELECT source, cell_type, count(*) AS n FROM (SELECT *, CASE WHEN CAST(cell_id % 50 AS INT) IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0) THEN 'allen' WHEN CAST(cell_id % 50 AS INT) IN (SELECT n_nationkey FROM nation) THEN 'neuromorpho' WHEN cell_type = 'interneuron' THEN 'lab' END AS source FROM {_FILES} f
 WHERE (f.cell_type = 'pyramidal' AND types IN ([1,2,3], [1,2,3,4])) OR (f.cell_type = 'interneuron' AND types IN ([1,2], [1,3], [1,2,3]))) q WHERE source IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.col("n_nationkey"), F.lit(".swc")).alias("file_name"), "n_nationkey")
    return prep.gather_candidates(_files(spark, sf), n.filter("n_nationkey % 2 = 0"), n).groupBy("source", "cell_type").agg(F.count(F.lit(1)).alias("n"))


@query("folds", "file_name:s fold:l", f"SELECT file_name, (row_number() OVER (PARTITION BY cell_type ORDER BY md5('42:' || file_name), file_name) - 1) % 5 AS fold FROM ({FILES}) s")
def _(spark, sf):
    return prep.folds(files(spark, sf))


@query("split_with_guarantee", "file_name:s is_test:l", f"SELECT file_name, CAST(h < 0.002 OR (n > 1 AND NOT bool_or(h < 0.002) OVER w AND row_number() OVER (PARTITION BY cell_type ORDER BY h) = 1) AS INT) AS is_test FROM (SELECT *, count(*) OVER (PARTITION BY cell_type) AS n, CAST('0x' || substr(md5('42:' || file_name), 1, 8) AS BIGINT) / 4294967295.0 AS h FROM ({FILES}) s) q WINDOW w AS (PARTITION BY cell_type)")
def _(spark, sf):
    return prep.split(files(spark, sf), 0.002).withColumn("is_test", F.col("is_test").cast("int"))


@query("settings_grid", "hidden:l n_layers:l dropout:d", "SELECT hidden, n_layers, dropout FROM (SELECT unnest([64, 128, 256]) AS hidden) a CROSS JOIN (SELECT unnest([2, 3]) AS n_layers) b CROSS JOIN (SELECT unnest([0.1, 0.3, 0.5]) AS dropout) c")
def _(spark, sf):
    return stats.grid(spark, [64, 128, 256], [2, 3], [0.1, 0.3, 0.5])


# ---------------------------------------------------------------- evaluation and reports


@query("bootstrap_intervals", "method:s statistic:s value:d low:d high:d std:d", f"""SELECT w.method, w.statistic, w.value, q.low, q.high, q.std FROM (SELECT method, unnest(['mean', 'median', 'p10']) AS statistic, unnest([avg(f1_milli), quantile_cont(f1_milli, 0.5), quantile_cont(f1_milli, 0.1)]) AS value FROM ({SCORES}) s GROUP BY method) w JOIN (
 SELECT method, statistic, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high, stddev_samp(v) AS std FROM (SELECT method, r, unnest(['mean', 'median', 'p10']) AS statistic, unnest([avg(f1_milli), quantile_cont(f1_milli, 0.5), quantile_cont(f1_milli, 0.1)]) AS v FROM (
  SELECT method, r, f1_milli, unnest(range(CAST(len(list_filter({list(stats.POISSON)}, lambda p: p <= u)) AS INT))) AS i FROM (SELECT *, CAST('0x' || substr(md5('42:' || r || ':' || file_name), 1, 8) AS BIGINT) / 4294967295.0 AS u FROM ({SCORES}) s CROSS JOIN (SELECT unnest(range(40)) AS r) b) x) y GROUP BY method, r) z GROUP BY 1, 2) q ON q.method = w.method AND q.statistic = w.statistic""")
def _(spark, sf):
    return stats.bootstrap(scores(spark, sf), ["method"], "f1_milli", resamples=40)


@query("worst_files", "method:s file_name:s f1:l place:l", f"SELECT method, file_name, f1_milli AS f1, place FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY f1_milli, f1_milli % 7 DESC, file_name) AS place FROM ({SCORES}) s) q WHERE place <= 5")
def _(spark, sf):
    return metrics.worst(_scores(spark, sf).withColumn("n_nodes", F.col("f1") % 7), ["method"])


@query("worst_overall", "file_name:s cell_type:s source:s place:l", f"SELECT file_name, cell_type, source, place FROM (SELECT *, row_number() OVER (ORDER BY f1_milli, file_name) AS place FROM {_F} s) q WHERE place <= 10")
def _(spark, sf):
    return metrics.worst(_file_scores(spark, sf), [], 10, size=None)


@query("named_examples", "cell_type:s n:l first:s", f"SELECT cell_type, max(k) AS n, string_agg(file_name, ' ' ORDER BY file_name) AS first FROM (SELECT *, count(*) OVER (PARTITION BY cell_type) AS k, row_number() OVER (PARTITION BY cell_type ORDER BY file_name) AS r FROM ({FILES}) s) q WHERE r <= 20 GROUP BY 1")
def _(spark, sf):
    return metrics.examples(_file_scores(spark, sf), ["cell_type"]).withColumn("first", F.array_join("examples", " "))


@query("per_file_table", "path:s cell_type:s f1_s2:d f1_s23:d", f"SELECT a.file_name AS path, a.cell_type, a.f1_milli / 1000.0 AS f1_s2, coalesce(b.f1_milli / 1000.0, 0) AS f1_s23 FROM ({SCORES}) a LEFT JOIN ({SCORES}) b ON b.file_name = a.file_name AND b.method = 'm1' WHERE a.method = 'm0'")
def _(spark, sf):
    s = scores(spark, sf).select("method", F.col("file_name").alias("path"), "cell_type", F.lit(1).alias("n_nodes"), (F.col("f1_milli") / 1000.0).alias("f1"))
    return metrics.per_file_table(s.filter("method = 'm0'"), s.filter("method = 'm1'"))


@query("scored_with_errors", "cell_type:s rows:l ok:l mean_ok:d", f"SELECT a.cell_type, count(*) AS rows, count(b.f1_milli) AS ok, avg(b.f1_milli) AS mean_ok FROM ({SCORES}) a LEFT JOIN ({SCORES}) b ON b.file_name = a.file_name AND b.method = 'm1' WHERE a.method = 'm0' GROUP BY 1")
def _(spark, sf):
    s = _scores(spark, sf)
    got = metrics.with_errors(s.filter("method = 'm0'").select("file_name", "cell_type"), s.filter("method = 'm1'").select("file_name", F.col("f1").cast("double").alias("f1")))
    return got.groupBy("cell_type").agg(F.count(F.lit(1)).alias("rows"), F.count_if("ok").alias("ok"), F.avg(F.when(F.col("ok"), F.col("f1"))).alias("mean_ok"))


_SEEDS = f"(SELECT file_name AS path, method AS seed, f1_milli % 2 AS gt, CASE WHEN f1_milli % 5 = 0 THEN 1 - f1_milli % 2 ELSE f1_milli % 2 END AS pred, (f1_milli % 50 + 50) / 100.0 AS conf FROM ({SCORES}) s)"


def _seeds(spark, sf):
    k = F.col("f1_milli")
    return scores(spark, sf).select(F.col("file_name").alias("path"), F.col("method").alias("seed"), (k % 2).alias("gt"), F.when(k % 5 == 0, 1 - k % 2).otherwise(k % 2).alias("pred"), ((k % 50 + 50) / 100.0).alias("conf"))


@query("across_seeds", "path:s n_tested:l n_wrong:l wrong_rate:d mean_wrong_conf:d mode_pred:l", f"SELECT a.path, n_tested, n_wrong, n_wrong * 1.0 / n_tested AS wrong_rate, mean_wrong_conf, mode_pred FROM (SELECT path, count(*) AS n_tested, count(*) FILTER (WHERE gt <> pred) AS n_wrong, avg(conf) FILTER (WHERE gt <> pred) AS mean_wrong_conf FROM {_SEEDS} s GROUP BY 1) a JOIN (SELECT path, arg_max(pred, k * 10 - pred) AS mode_pred FROM (SELECT path, pred, count(*) AS k FROM {_SEEDS} s GROUP BY 1, 2) q GROUP BY 1) b ON b.path = a.path")
def _(spark, sf):
    return metrics.across_seeds(_seeds(spark, sf))


@query("seed_summary", "seeds:l accuracy_mean:d accuracy_std:d", f"SELECT count(*) AS seeds, avg(a) AS accuracy_mean, stddev_pop(a) AS accuracy_std FROM (SELECT seed, avg(CASE WHEN gt = pred THEN 1.0 ELSE 0 END) AS a FROM {_SEEDS} s GROUP BY 1) q")
def _(spark, sf):
    return metrics.seed_summary(_seeds(spark, sf))


@query("mean_confusion", "gt:l pred:l n:d", f"SELECT gt, pred, count(*) / 3.0 AS n FROM {_SEEDS} s GROUP BY 1, 2")
def _(spark, sf):
    return metrics.mean_confusion(_seeds(spark, sf))


@query("misclassified", "path:s ground_truth:l predicted:l confidence:d p_a:d p_b:d", f"SELECT path, gt AS ground_truth, pred AS predicted, conf AS confidence, conf AS p_a, 1 - conf AS p_b FROM {_SEEDS} s WHERE gt <> pred")
def _(spark, sf):
    return metrics.misclassified(_seeds(spark, sf).withColumn("probability", F.create_map(F.lit("p_a"), F.col("conf"), F.lit("p_b"), 1 - F.col("conf"))), ["p_a", "p_b"])


_MED = f"(SELECT cell_type, feature, median, CASE WHEN s > 1e-9 THEN s ELSE 1.0 END AS scale FROM (SELECT cell_type, feature, max(m) AS median, quantile_cont(abs(v - m), 0.5) AS s FROM (SELECT cell_type, feature, v, quantile_cont(v, 0.5) OVER (PARTITION BY cell_type, feature) AS m FROM (SELECT cell_type, 'radius' AS feature, radius AS v FROM ({NODES}) n UNION ALL SELECT cell_type, 'x', x FROM ({NODES}) n UNION ALL SELECT cell_type, 'y', y FROM ({NODES}) n) a) b GROUP BY 1, 2) c)"


@query("error_drivers", "path:l n:l feature:s delta:d", f"""SELECT path, n, feature, delta FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY delta DESC, feature) AS n FROM (
 SELECT l.seq AS path, l.feature, (abs(v - a.median) - abs(v - b.median)) / a.scale AS delta FROM (SELECT seq, cell_type AS gt, CASE WHEN cell_type = 'pyramidal' THEN 'interneuron' ELSE 'pyramidal' END AS pred, unnest(['radius', 'x', 'y']) AS feature, unnest([radius, x, y]) AS v FROM ({NODES}) n WHERE seq % 50 = 0) l JOIN {_MED} a ON a.cell_type = l.gt AND a.feature = l.feature JOIN {_MED} b ON b.cell_type = l.pred AND b.feature = l.feature) q WHERE delta > 0) r WHERE n <= 2""")
def _(spark, sf):
    n = nodes(spark, sf)
    wrong = n.filter("seq % 50 = 0").select(F.col("seq").alias("path"), F.col("cell_type").alias("gt"), F.when(F.col("cell_type") == "pyramidal", "interneuron").otherwise("pyramidal").alias("pred"), "radius", "x", "y")
    return metrics.error_drivers(wrong, ["radius", "x", "y"], metrics.medians_and_scale(n, ["radius", "x", "y"]), top=2)


@query("result_table", "method:s n_files:d accuracy:d n_pairs:l mean_diff:d", f"SELECT r.method, n_files, accuracy, coalesce(n_pairs, 0) AS n_pairs, diff AS mean_diff FROM (SELECT method, count(*) AS n_files, NULL AS accuracy FROM ({SCORES}) s GROUP BY 1 UNION ALL SELECT 'floor', NULL, 0.5) r LEFT JOIN (SELECT b AS method, count(*) AS n_pairs, -avg(d) AS diff FROM {_D} q WHERE a = 'm0' GROUP BY 1 UNION ALL SELECT a, count(*), avg(d) FROM {_D} q WHERE b = 'm0' GROUP BY 1) t ON t.method = r.method")
def _(spark, sf):
    s = _scores(spark, sf)
    parts = [s.groupBy("method").agg(F.count(F.lit(1)).cast("double").alias("n_files")), spark.createDataFrame([("floor", 0.5)], "method string, accuracy double")]
    return stats.result_table(parts, stats.wilcoxon(stats.method_pairs(s)), "m0").na.fill(0, ["n_pairs"])


@query("epoch_leaderboard", "source:s mean:d std:d median_epoch:d rank:l", f"SELECT source, mean, std, median_epoch, row_number() OVER (ORDER BY mean DESC, source) AS rank FROM (SELECT source, avg(f1_milli) AS mean, stddev_pop(f1_milli) AS std, quantile_cont(f1_milli % 40, 0.5) AS median_epoch FROM {_S} q GROUP BY 1) r")
def _(spark, sf):
    return stats.leaderboard(_scores(spark, sf).withColumn("epoch", F.col("f1") % 40), ["source"], "f1")


@query("predicted_type_sets", "cell_id:l gt:s predicted:s", f"SELECT cell_id, string_agg(DISTINCT CAST(type AS VARCHAR), ' ' ORDER BY CAST(type AS VARCHAR)) AS gt, string_agg(DISTINCT CAST(pred AS VARCHAR), ' ' ORDER BY CAST(pred AS VARCHAR)) AS predicted FROM ({PRED}) p WHERE cell_type = 'pyramidal' GROUP BY 1")
def _(spark, sf):
    p = checkpointed(pred(spark, sf).filter("cell_type = 'pyramidal'"))
    said = swc.type_sets(p.withColumn("type", F.col("pred"))).select("cell_id", F.col("type_set").alias("predicted"))
    return swc.type_sets(p).select("cell_id", F.col("type_set").alias("gt")).join(said, "cell_id")


# ---------------------------------------------------------------- the labelling chain


#: Cells that labels are told for, and owners by a formula: subtree 2 of a cell is axon or apical, the others axon or basal.
_TESTED = """,
tested AS (SELECT cell_id FROM (SELECT *, count(*) OVER w AS n, bool_or(h < 0.2) OVER w AS any_, row_number() OVER (PARTITION BY cell_type ORDER BY h) AS r FROM (SELECT cell_id, max(cell_type) AS cell_type, CAST('0x' || substr(md5('42:' || cell_id), 1, 8) AS BIGINT) / 4294967295.0 AS h FROM topo GROUP BY 1) a WINDOW w AS (PARTITION BY cell_type)) b WHERE h < 0.2 OR (n > 1 AND NOT any_ AND r = 1)),
owned AS (SELECT DISTINCT t.cell_id, cell_type, primary_root, (t.cell_id + 3 * primary_root) % 5 < 2 AS axon, 0.625 + (t.cell_id + primary_root) % 5 / 16.0 AS top FROM topo t JOIN tested USING (cell_id) WHERE primary_root IS NOT NULL),
owner AS (SELECT cell_id, cell_type, primary_root, top AS conf, CASE WHEN axon THEN 2 WHEN primary_root = 2 AND cell_type = 'pyramidal' THEN 4 ELSE 3 END AS pred FROM owned),
votes AS (SELECT o.cell_id, o.primary_root, row_number() OVER (PARTITION BY o.cell_id ORDER BY count(*) * max(o.conf) DESC, min(t.seq) FILTER (WHERE t.id = t.primary_root)) AS place FROM owner o JOIN topo t ON t.cell_id = o.cell_id AND t.primary_root = o.primary_root WHERE o.pred = 2 AND o.cell_type = 'pyramidal' GROUP BY 1, 2)
"""


def _formula_owners(t):
    """cell_id, primary_root, probability of the rows above."""
    n, axon = F.col("cell_id"), (F.col("cell_id") + 3 * F.col("primary_root")) % 5 < 2
    top = 0.625 + (n + F.col("primary_root")) % 5 / 16.0
    at = F.when(axon, 0).when(F.col("primary_root") == 2, 2).otherwise(1)
    return t.filter("primary_root IS NOT NULL").select("cell_id", "primary_root").distinct().withColumn("probability", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.when(k == at, top).otherwise((1 - top) / 2)))


@query("labelled_by_subtree", "cell_id:l used_type:s id:l s2:l s23:l conf:d", """SELECT t.cell_id, t.cell_type AS used_type, t.id, CASE WHEN t.id = t.proxy THEN 1 ELSE coalesce(o.pred, 2) END AS s2,
  CASE WHEN t.id = t.proxy THEN 1 WHEN o.pred IS NULL THEN 2 WHEN v.place > 1 THEN 3 ELSE o.pred END AS s23, coalesce(o.conf, 0.3) AS conf
  FROM topo t JOIN tested USING (cell_id) LEFT JOIN owner o ON o.cell_id = t.cell_id AND o.primary_root = t.primary_root LEFT JOIN votes v ON v.cell_id = t.cell_id AND v.primary_root = t.primary_root""", TREE + _TESTED)
def _(spark, sf):
    """The labels of the test cells from given owners: legal for the type, one axon a pyramidal cell, refined by all rules."""
    _, test = labelling.in_parts(topo(spark, sf))
    test = checkpointed(test)
    return labelling.label_nodes(test, Bundle({}, settings={"cut": None}), by_subtree=True, known_types=True, owners=_formula_owners(test))


@query("labelled_without_models", "cell_id:l used_type:s id:l s2:l s23:l conf:d", f"""SELECT t.cell_id, CASE WHEN pp >= pi OR pi < 0.65 THEN 'pyramidal' ELSE 'interneuron' END AS used_type, t.id, CASE WHEN t.id = t.proxy THEN 1 WHEN t.primary_root IS NULL THEN 2 ELSE 3 END AS s2,
  CASE WHEN t.id = t.proxy THEN 1 WHEN t.primary_root IS NULL THEN 2 ELSE 3 END AS s23, CASE WHEN t.primary_root IS NULL THEN 0.3 ELSE 0.5 END AS conf FROM topo t JOIN {_GUESS} g ON g.cell_id = t.cell_id""", TREE + BELOW)
def _(spark, sf):
    """Without a bundle: types by rules, and branches basal."""
    return labelling.label_nodes(topo(spark, sf), Bundle({}, settings={"cut": None}))


def _owner_rows(spark, sf):
    """Primary subtrees of all cells with features, label and fold of their cell, and the features' names."""
    s, names = labelling.subtree_table(topo(spark, sf))
    of = prep.folds(s.select("cell_id", "cell_type").distinct().withColumn("file_name", F.col("cell_id").cast("string"))).select("cell_id", "fold")
    return checkpointed(s.join(of, "cell_id").withColumn("label", (F.col("gt_label") - 2).cast("double"))), names


@query("feature_importance", "feature:s drop:d std:d")
def _(spark, sf):
    rows, names = _owner_rows(spark, sf)
    return ml.importance(ml.train_labels(rows.filter("fold > 0"), names, trees=50), rows.filter("fold = 0"), names, repeats=10)


@query("settings_sweep", "trees:l depth:l fold:l n:l accuracy:d")
def _(spark, sf):
    rows, names = _owner_rows(spark, sf)
    return ml.sweep(rows, names, [{"trees": t, "depth": d} for t in (5, 10, 20) for d in (3, 5, 8)], k=5)


_STACK = """,
stk AS (SELECT cell_id, id, id AS top, CAST([] AS BIGINT[]) AS way FROM topo WHERE is_root
  UNION ALL SELECT t.cell_id, t.id, s.top, list_append(s.way, -t.seq) FROM stk s JOIN topo t ON t.cell_id = s.cell_id AND t.parent = s.id AND NOT t.is_root),
placed AS (SELECT s.cell_id, s.id, row_number() OVER w - 1 AS place, coalesce(sum(CASE WHEN t.n_children = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY s.cell_id, s.top ORDER BY way ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tip_place
  FROM stk s JOIN topo t ON t.cell_id = s.cell_id AND t.id = s.id WINDOW w AS (PARTITION BY s.cell_id, s.top ORDER BY way))
"""


@query("stack_order", "cell_id:l id:l place:l tip_place:l", "SELECT * FROM placed", TREE + _STACK)
def _(spark, sf):
    return forest.stack_order(topo(spark, sf))


@query("subtree_taper", "cell_id:l primary_root:l taper:d", "SELECT r.cell_id, r.id AS primary_root, coalesce(l.mean / r.radius, 1.0) AS taper FROM topo r LEFT JOIN (SELECT cell_id, primary_root, avg(radius) AS mean FROM (SELECT t.cell_id, t.primary_root, t.radius, row_number() OVER (PARTITION BY t.cell_id, t.primary_root ORDER BY p.place) AS n FROM topo t JOIN placed p ON p.cell_id = t.cell_id AND p.id = t.id WHERE t.n_children = 0 AND t.primary_root IS NOT NULL) q WHERE n <= 3 GROUP BY 1, 2) l ON l.cell_id = r.cell_id AND l.primary_root = r.id WHERE r.id = r.primary_root", TREE + _STACK)
def _(spark, sf):
    return features.subtree_features(topo(spark, sf))


@query("graph_folds", "fold:l best_epoch:l macro_f1:d basal_f1:d apical_f1:d loss_first:d loss_best:d")
def _(spark, sf):
    """Cross-validation of the graph network over whole pyramidal cells, all folds side by side."""
    vertices, edges, names = labelling.graph_rows(topo(spark, sf))
    of = prep.folds(vertices.select("cell_id", "cell_type").distinct().withColumn("file_name", F.col("cell_id").cast("string"))).select("cell_id", "fold")
    fits = graph.cross_validate(checkpointed(vertices.join(of, "cell_id")), edges, names, epochs=20, patience=6)
    rows = [(k, f.best_epoch, f.best_f1, *f.by_class[f.best_epoch], f.losses[0], f.losses[f.best_epoch]) for k, f in fits.items()]  # a row for each fold
    return spark.createDataFrame(rows, "fold int, best_epoch int, macro_f1 double, basal_f1 double, apical_f1 double, loss_first double, loss_best double")
