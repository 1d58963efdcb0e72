"""The library's own queries over the test tables, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import features, forest, metrics, ml, prep, qc, rules, stats
from ..sources import swc, tables
from ..session import checkpointed, is_there
from . import labelling
from .fixtures import FILES, NODES, PRED, SCORES, files, nodes, pred, scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Forest, walk from the roots, and pairs of ancestors and descendants, in SQL.
TREE = f"""
nodes AS ({PRED}),
kids AS (SELECT cell_id, parent, count(*) AS k FROM nodes GROUP BY 1, 2),
t0 AS (SELECT n.*, p.id IS NULL AS is_root, coalesce(k.k, 0) AS n_children, p.x AS px, p.y AS py, p.z AS pz, p.radius AS pr,
   CASE WHEN p.id IS NULL THEN 0.0 ELSE sqrt((n.x-p.x)*(n.x-p.x)+(n.y-p.y)*(n.y-p.y)+(n.z-p.z)*(n.z-p.z)) END AS edge
  FROM nodes n LEFT JOIN nodes p ON n.cell_id = p.cell_id AND n.parent = p.id LEFT JOIN kids k ON k.cell_id = n.cell_id AND k.parent = n.id),
prox AS (SELECT cell_id, id AS proxy, x AS sx, y AS sy, z AS sz FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY radius DESC, n_children DESC, seq) AS rn FROM t0 WHERE is_root) q WHERE rn = 1),
t AS (SELECT t0.*, u.n_children AS pk, prox.proxy, sx, sy, sz, t0.x - sx AS dx, t0.y - sy AS dy, t0.z - sz AS dz,
   sqrt((t0.x-sx)*(t0.x-sx)+(t0.y-sy)*(t0.y-sy)+(t0.z-sz)*(t0.z-sz)) AS radial
  FROM t0 LEFT JOIN t0 u ON t0.cell_id = u.cell_id AND t0.parent = u.id JOIN prox ON prox.cell_id = t0.cell_id),
walk AS (SELECT cell_id, id, CAST(0.0 AS DOUBLE) AS path, 0 AS depth, 0 AS branch_order, CAST(NULL AS INT) AS primary_root, CAST(NULL AS INT) AS head, 0 AS pos, CAST(0.0 AS DOUBLE) AS pib FROM t WHERE is_root
  UNION ALL SELECT t.cell_id, t.id, w.path + t.edge, w.depth + 1, w.branch_order + CASE WHEN t.pk > 1 THEN 1 ELSE 0 END,
   CASE WHEN t.parent = t.proxy THEN t.id ELSE w.primary_root END, CASE WHEN t.parent = t.proxy OR t.pk > 1 THEN t.id ELSE w.head END,
   CASE WHEN t.parent = t.proxy OR t.pk > 1 THEN 0 ELSE w.pos + 1 END, CASE WHEN t.parent = t.proxy OR t.pk > 1 THEN 0.0 ELSE w.pib + t.edge END
  FROM walk w JOIN t ON t.cell_id = w.cell_id AND t.parent = w.id AND NOT t.is_root),
topo AS (SELECT t.*, path, depth, branch_order, primary_root, head, pos, pib FROM t JOIN walk USING (cell_id, id))
"""
BELOW = """,
below AS (SELECT cell_id, id AS anc, id, parent FROM topo
  UNION ALL SELECT b.cell_id, p.id, b.id, p.parent FROM below b JOIN topo p ON p.cell_id = b.cell_id AND p.id = b.parent)
"""


def query(name: str, spec: str, sql: str | None = None, with_: str = "") -> Callable:
    """Registers a query. spec: the columns of its result, `name:kind` with kind l (whole number), d (rounded), s (text)."""
    cols = [c.split(":") for c in spec.split()]

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            of = {"l": lambda c: F.col(c).cast("long"), "d": lambda c: F.round(F.round(F.col(c).cast("double"), 9), 4) + F.lit(0.0), "s": lambda c: F.col(c).cast("string")}
            return f(spark, sf_dir).select(*(of[k](c).alias(c) for c, k in cols))

        QUERIES[name] = run
        if sql:
            of = {"l": "CAST({0} AS BIGINT) AS {0}", "d": "round(round(CAST({0} AS DOUBLE), 9), 4) + 0.0 AS {0}", "s": "CAST({0} AS VARCHAR) AS {0}"}
            ORACLE[name] = (f"WITH RECURSIVE {with_} " if with_ else "") + f"SELECT {', '.join(of[k].format(c) for c, k in cols)} FROM ({sql}) AS q_"
        return f

    return register


#: Whether queries of one session share the topology of a table, as a user would who asks several things of the same
#: cells. bench.py turns it off, so that every time there includes the query's own topology.
SHARE = True
_MADE: dict[tuple, DataFrame] = {}


def topo(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
    key = spark.sparkContext.applicationId, sf_dir, status.getModificationTime(), status.getLen()  # a table that is written again is read again
    if not SHARE or key not in _MADE or not is_there(_MADE[key]):
        _MADE[key] = checkpointed(forest.topology(pred(spark, sf_dir)))
    return _MADE[key]


# ---------------------------------------------------------------- sources, scalars, joins

@query("swc_parse", "cell_id:s seq:l id:l type:l x:d radius:d parent:l", f"SELECT cell_id, 4 * (id - 1) AS seq, id, type, x, radius, parent FROM ({NODES}) n")
def _(spark, sf):
    n = nodes(spark, sf).withColumn("seq", (F.col("id") - 1) * 4).withColumn("cell_id", F.col("cell_id").cast("string"))
    line = (F.regexp_replace("line", r"^(\d+) ", "  $1.0  "), F.lit("# comment"), F.lit("  "), F.regexp_replace("line", r"^\S+", "nan_id"))
    lines = swc.render(n).select("cell_id", "seq", F.posexplode(F.array(*line)).alias("k", "line"))
    lines = lines.select("cell_id", (F.col("seq") + F.col("k")).alias("seq"), "line")
    return swc.parse_lines(lines)


@query("type_sets", "cell_id:l type_set:s", f"SELECT cell_id, string_agg(DISTINCT CAST(type AS VARCHAR), ' ' ORDER BY CAST(type AS VARCHAR)) AS type_set FROM ({NODES}) n GROUP BY 1")
def _(spark, sf):
    return swc.type_sets(nodes(spark, sf))


@query("hash_split", "file_name:s is_test:l", f"SELECT file_name, CAST(CAST('0x' || substr(md5('42:' || file_name), 1, 8) AS BIGINT) / 4294967295.0 < 0.2 AS INT) AS is_test FROM ({FILES}) s")
def _(spark, sf):
    return files(spark, sf).withColumn("is_test", scalars.in_test(F.col("file_name")))


@query("names", "file_name:s source:s slug:s hint:s", f"SELECT file_name, split_part(lower(file_name), '__', 1) AS source, trim(regexp_replace(file_name || ' (x)', '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS slug, CASE WHEN position('pyramidal' in cell_type) > 0 THEN 'pyramidal' ELSE 'interneuron' END AS hint FROM ({SCORES}) s WHERE method = 'm1'")
def _(spark, sf):
    s = scores(spark, sf).filter("method = 'm1'")
    return s.select("file_name", scalars.source_of(F.col("file_name")).alias("source"), scalars.slug(F.concat("file_name", F.lit(" (x)"))).alias("slug"), scalars.cell_type_hint(F.concat(F.lit("/a/"), "cell_type", F.lit("/f.swc"))).alias("hint"))


@query("test_anti_join", "cell_type:s n:l", f"SELECT cell_type, count(*) AS n FROM ({FILES}) s WHERE NOT (CAST('0x' || substr(md5('42:' || file_name), 1, 8) AS BIGINT) / 4294967295.0 < 0.2) GROUP BY 1")
def _(spark, sf):
    s = files(spark, sf)
    test = s.filter(scalars.in_test(F.col("file_name"))).select("file_name")
    return s.join(test, "file_name", "left_anti").groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"))


@query("manifest_union", "k:l a:s b:s", "SELECT n_nationkey AS k, n_name AS a, NULL AS b FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def _(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("a"))
    r = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("b"))
    return tables.union_manifests([n, r])


@query("metadata_upsert", "file_name:l v:s", "SELECT o_custkey AS file_name, max(CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END) AS v FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) o GROUP BY 1 HAVING true".replace("max(CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END)", "CASE WHEN bool_or(o_orderkey % 2 = 0) THEN 'new' ELSE 'old' END"))
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("file_name"), "o_orderkey")
    old = o.filter("o_orderkey % 2 != 0").select("file_name", F.lit("old").alias("v")).distinct()
    new = o.filter("o_orderkey % 2 = 0").select("file_name", F.lit("new").alias("v")).distinct()
    return tables.upsert(old, new)


@query("stale_outputs", "n:l", "SELECT count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) e")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("file_name"))
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("file_name"))
    return tables.stale(c.distinct(), o).agg(F.count(F.lit(1)).alias("n"))


_POOL = f"SELECT 'pyramidal' AS cell_type, split_part(file_name, '__', 1) AS source, file_name AS path FROM ({FILES}) s"


@query("quota_sample", "source:s path:s n:l", f"""
SELECT source, path, n FROM (
 SELECT *, row_number() OVER (ORDER BY phase, p, r) AS n FROM (
  SELECT *, CASE WHEN r <= q THEN 0 ELSE 1 END AS phase, CASE WHEN r <= q THEN (CASE source WHEN 'allen' THEN 0 ELSE 1 END) ELSE (CASE source WHEN 'allen' THEN 0 WHEN 'lab' THEN 1 ELSE 2 END) END AS p FROM (
   SELECT *, row_number() OVER (PARTITION BY source ORDER BY path) AS r, CASE source WHEN 'allen' THEN 20 WHEN 'neuromorpho' THEN 30 ELSE 0 END AS q FROM ({_POOL}) a WHERE source IN ('allen', 'lab', 'neuromorpho')) b) c) d WHERE n <= 100""")
def _(spark, sf):
    s = files(spark, sf).select(F.lit("pyramidal").alias("cell_type"), scalars.source_of(F.col("file_name")).alias("source"), F.col("file_name").alias("path"))
    return prep.select_examples(s, 100, {"pyramidal": {"allen": 20, "neuromorpho": 30}})


@query("compare_labellings", "cell_id:l missing_in_gt:l missing_in_pred:l parent_mismatch:l", f"SELECT cell_id, 0 AS missing_in_gt, count(*) FILTER (WHERE id % 9 = 0) AS missing_in_pred, count(*) FILTER (WHERE id % 5 = 0 AND id % 9 <> 0) AS parent_mismatch FROM ({NODES}) n GROUP BY 1")
def _(spark, sf):
    n = nodes(spark, sf)
    p = n.filter("id % 9 != 0").withColumn("parent", F.when(F.col("id") % 5 == 0, F.col("parent") + 1).otherwise(F.col("parent")))
    return metrics.compare(n, p, ["cell_id"])


# ---------------------------------------------------------------- forest

@query("forest_adjacency", "cell_id:l id:l is_root:l n_children:l edge:d", "SELECT cell_id, id, CAST(is_root AS INT) AS is_root, n_children, edge FROM t0", TREE)
def _(spark, sf):
    return forest.forest(nodes(spark, sf))


@query("proxy_soma", "cell_id:l proxy:l sx:d", "SELECT cell_id, proxy, sx FROM prox", TREE)
def _(spark, sf):
    return forest.proxy_soma(forest.forest(nodes(spark, sf)))


@query("primary_roots", "cell_id:l id:l", "SELECT cell_id, id FROM topo WHERE id = primary_root", TREE)
def _(spark, sf):
    return topo(spark, sf).filter("id = primary_root")


@query("path_from_root", "cell_id:l id:l path:d depth:l branch_order:l", "SELECT * FROM topo", TREE)
def _(spark, sf):
    return topo(spark, sf)


@query("subtree_membership", "cell_id:l primary_root:l n:l", "SELECT cell_id, primary_root, count(*) AS n FROM topo WHERE primary_root IS NOT NULL GROUP BY 1, 2", TREE)
def _(spark, sf):
    return topo(spark, sf).filter("primary_root IS NOT NULL").groupBy("cell_id", "primary_root").agg(F.count(F.lit(1)).alias("n"))


@query("subtree_stats", "cell_id:l id:l sub_size:l sub_max_depth:l sub_max_path:d sub_forks:l sub_tips:l sub_cable:d sub_first_fork:d",
       "SELECT b.cell_id, b.anc AS id, count(*) AS sub_size, max(d.depth) - max(a.depth) AS sub_max_depth, max(d.path) - max(a.path) AS sub_max_path, count(*) FILTER (WHERE d.n_children >= 2) AS sub_forks, count(*) FILTER (WHERE d.n_children = 0) AS sub_tips, sum(d.edge) - max(a.edge) AS sub_cable, min(CASE WHEN d.n_children <> 1 THEN d.path END) - max(a.path) AS sub_first_fork FROM below b JOIN topo d ON d.cell_id = b.cell_id AND d.id = b.id JOIN topo a ON a.cell_id = b.cell_id AND a.id = b.anc GROUP BY 1, 2", TREE + BELOW)
def _(spark, sf):
    return forest.subtree_stats(topo(spark, sf))


@query("branch_segments", "cell_id:l branch:l n:l length:d", "SELECT cell_id, head AS branch, count(*) AS n, max(pib) AS length FROM topo WHERE primary_root IS NOT NULL GROUP BY 1, 2", TREE)
def _(spark, sf):
    t = topo(spark, sf)
    b = forest.branches(t).join(t.select("cell_id", "id", "path_in_branch"), ["cell_id", "id"])
    return b.groupBy("cell_id", "branch").agg(F.count(F.lit(1)).alias("n"), F.max("path_in_branch").alias("length"))


@query("trunk_length", "cell_id:l primary_root:l length:d", "SELECT cell_id, primary_root, max(path) - min(path) AS length FROM topo WHERE primary_root IS NOT NULL GROUP BY 1, 2", TREE)
def _(spark, sf):
    return forest.trunk(topo(spark, sf)).groupBy("cell_id", "primary_root").agg((F.max("path") - F.min("path")).alias("length"))


@query("label_regions", "cell_id:l region:l n:l", "SELECT cell_id, region, count(*) AS n FROM reg GROUP BY 1, 2", TREE + """,
reg AS (SELECT t.cell_id, t.id, t.id AS region, t.type FROM topo t LEFT JOIN topo p ON p.cell_id = t.cell_id AND p.id = t.parent WHERE t.id <> t.proxy AND (t.is_root OR p.id = p.proxy OR p.type <> t.type)
  UNION ALL SELECT t.cell_id, t.id, r.region, t.type FROM reg r JOIN topo t ON t.cell_id = r.cell_id AND t.parent = r.id AND t.type = r.type)""")
def _(spark, sf):
    return forest.regions(topo(spark, sf), "type").groupBy("cell_id", "region").agg(F.count(F.lit(1)).alias("n"))


@query("branch_edges", "cell_id:l a:l b:l", "SELECT DISTINCT cell_id, a, b FROM (SELECT s.cell_id, p.head AS a, s.id AS b FROM topo s JOIN topo p ON p.cell_id = s.cell_id AND p.id = s.parent WHERE s.head = s.id AND p.head IS NOT NULL UNION ALL SELECT s.cell_id, s.id, p.head FROM topo s JOIN topo p ON p.cell_id = s.cell_id AND p.id = s.parent WHERE s.head = s.id AND p.head IS NOT NULL) e", TREE)
def _(spark, sf):
    return forest.branch_edges(forest.branches(topo(spark, sf)))


@query("subtree_label_mode", "cell_id:l primary_root:l label:l", "SELECT cell_id, primary_root, label FROM (SELECT cell_id, primary_root, type AS label, row_number() OVER (PARTITION BY cell_id, primary_root ORDER BY count(*) DESC, min(seq)) AS rn FROM topo WHERE primary_root IS NOT NULL AND type <> 1 GROUP BY 1, 2, 3) q WHERE rn = 1", TREE)
def _(spark, sf):
    return forest.label_mode(topo(spark, sf).filter("primary_root IS NOT NULL"), ["cell_id", "primary_root"])


# ---------------------------------------------------------------- features

@query("cell_counts", "cell_id:l n_nodes:l n_root_nodes:l n_branch_points:l n_terminals:l n_primary_subtrees:l branch_point_ratio:d", "SELECT cell_id, count(*) AS n_nodes, count(*) FILTER (WHERE is_root) AS n_root_nodes, count(*) FILTER (WHERE n_children >= 2) AS n_branch_points, count(*) FILTER (WHERE n_children = 0 AND NOT is_root) AS n_terminals, count(*) FILTER (WHERE parent = proxy AND NOT is_root) AS n_primary_subtrees, count(*) FILTER (WHERE n_children >= 2) * 1.0 / count(*) AS branch_point_ratio FROM topo GROUP BY 1", TREE)
def _(spark, sf):
    return features.cell_counts(topo(spark, sf))


@query("cell_path_stats", "cell_id:l max_path_length:d mean_path_length:d std_path_length:d max_radial_distance:d std_radial_distance:d path_radial_ratio_mean:d", "SELECT cell_id, max(path) FILTER (WHERE id <> proxy) AS max_path_length, avg(path) FILTER (WHERE id <> proxy) AS mean_path_length, stddev_pop(path) FILTER (WHERE id <> proxy) AS std_path_length, max(radial) AS max_radial_distance, stddev_pop(radial) AS std_radial_distance, avg(path / radial) FILTER (WHERE id <> proxy AND radial > 1e-6) AS path_radial_ratio_mean FROM topo GROUP BY 1", TREE)
def _(spark, sf):
    return features.cell_paths(topo(spark, sf))


@query("cell_radius", "cell_id:l mean_radius:d std_radius:d max_radius:d radius_cv:d", "SELECT cell_id, avg(radius) AS mean_radius, stddev_pop(radius) AS std_radius, max(radius) AS max_radius, stddev_pop(radius) / avg(radius) AS radius_cv FROM topo WHERE id <> proxy GROUP BY 1", TREE)
def _(spark, sf):
    return features.cell_radius(topo(spark, sf))


@query("cell_extent", "cell_id:l z_span:d z_asymmetry:d z_max_above_soma:d z_max_below_soma:d x_span:d xy_aspect_ratio:d", "SELECT cell_id, max(z) - min(z) AS z_span, (greatest(0, max(dz)) - greatest(0, -min(dz))) / (max(z) - min(z)) AS z_asymmetry, greatest(0, max(dz)) AS z_max_above_soma, greatest(0, -min(dz)) AS z_max_below_soma, max(x) - min(x) AS x_span, greatest(max(x) - min(x), max(y) - min(y)) / least(max(x) - min(x), max(y) - min(y)) AS xy_aspect_ratio FROM topo GROUP BY 1", TREE)
def _(spark, sf):
    return features.cell_extent(topo(spark, sf))


@query("cell_covariance", "cell_id:l n:l cxx:d cyy:d czz:d cxy:d cxz:d cyz:d", f"SELECT cell_id, count(*) AS n, covar_samp(x,x) AS cxx, covar_samp(y,y) AS cyy, covar_samp(z,z) AS czz, covar_samp(x,y) AS cxy, covar_samp(x,z) AS cxz, covar_samp(y,z) AS cyz FROM ({NODES}) n GROUP BY 1")
def _(spark, sf):
    return features.covariance(nodes(spark, sf))


@query("cell_covariance_eigen", "cell_id:l l1:d l2:d l3:d", f"""
SELECT cell_id, q + 2*p*cos(a) AS l1, 3*q - (q + 2*p*cos(a)) - (q + 2*p*cos(a + 2*pi()/3)) AS l2, q + 2*p*cos(a + 2*pi()/3) AS l3 FROM (
 SELECT cell_id, q, p, acos(greatest(-1.0, least(1.0, (((cxx-q)*((cyy-q)*(czz-q)-cyz*cyz) - cxy*(cxy*(czz-q)-cyz*cxz) + cxz*(cxy*cyz-(cyy-q)*cxz)) / (p*p*p)) / 2))) / 3 AS a FROM (
  SELECT *, sqrt(((cxx-q)*(cxx-q)+(cyy-q)*(cyy-q)+(czz-q)*(czz-q)+2*(cxy*cxy+cxz*cxz+cyz*cyz))/6) AS p FROM (
   SELECT *, (cxx+cyy+czz)/3 AS q FROM (SELECT cell_id, covar_samp(x,x) AS cxx, covar_samp(y,y) AS cyy, covar_samp(z,z) AS czz, covar_samp(x,y) AS cxy, covar_samp(x,z) AS cxz, covar_samp(y,z) AS cyz FROM ({NODES}) n GROUP BY 1) c) d) e) f""")
def _(spark, sf):
    return features.eigenvalues(features.covariance(nodes(spark, sf)))


@query("cell_subtrees", "cell_id:l max_subtree_size:l min_subtree_size:l subtree_size_std:d max_subtree_path:d max_subtree_size_ratio:d", "SELECT cell_id, max(n) AS max_subtree_size, min(n) AS min_subtree_size, stddev_pop(n) AS subtree_size_std, max(p) AS max_subtree_path, max(n) * 1.0 / sum(n) AS max_subtree_size_ratio FROM (SELECT cell_id, primary_root, count(*) AS n, max(path) AS p FROM topo WHERE primary_root IS NOT NULL GROUP BY 1, 2) s GROUP BY 1", TREE)
def _(spark, sf):
    return features.cell_subtrees(topo(spark, sf))


@query("sholl_hist", "cell_id:l bin:l n:l", "SELECT e.cell_id, e.bin, coalesce(h.n, 0) AS n FROM (SELECT cell_id, bin FROM (SELECT DISTINCT cell_id FROM topo WHERE parent <> -1) c CROSS JOIN (SELECT unnest(range(20)) AS bin) b) e LEFT JOIN (SELECT cell_id, bin, count(*) AS n FROM (SELECT cell_id, least(CAST(floor(radial / max(radial) OVER (PARTITION BY cell_id) * 20) AS INT), 19) AS bin FROM topo WHERE parent <> -1) x GROUP BY 1, 2) h ON h.cell_id = e.cell_id AND h.bin = e.bin", TREE)
def _(spark, sf):
    return features.sholl_histogram(topo(spark, sf))


@query("subtree_features", "cell_id:l primary_root:l size:l depth:l max_path:d mean_radius:d mean_z_rel:d z_span:d size_ratio:d is_longest_subtree:l z_rank:d radius_rank:d",
       """SELECT *, size * 1.0 / max(size) OVER w AS size_ratio, CASE WHEN row_number() OVER (PARTITION BY cell_id ORDER BY max_path DESC, seq) = 1 THEN 1 ELSE 0 END AS is_longest_subtree,
 1 - (row_number() OVER (PARTITION BY cell_id ORDER BY mean_z_rel DESC, seq) - 1) * 1.0 / (count(*) OVER w - 1) AS z_rank, 1 - (row_number() OVER (PARTITION BY cell_id ORDER BY rr DESC, seq) - 1) * 1.0 / (count(*) OVER w - 1) AS radius_rank
 FROM (SELECT t.cell_id, t.primary_root, max(r.seq) AS seq, max(r.radius) AS rr, count(*) AS size, max(t.depth) - max(r.depth) AS depth, max(t.path - r.path) AS max_path, avg(t.radius) AS mean_radius, avg(t.dz) AS mean_z_rel, max(t.z) - min(t.z) AS z_span FROM topo t JOIN topo r ON r.cell_id = t.cell_id AND r.id = t.primary_root GROUP BY 1, 2) s WINDOW w AS (PARTITION BY cell_id)""", TREE)
def _(spark, sf):
    return features.subtree_features(topo(spark, sf))


@query("branch_geometry", "cell_id:l branch:l n_nodes:l path_length:d radial_extent:d mean_radius:d std_radius:d branchiness:d z_rel_soma:d thin_fraction:d", "SELECT t.cell_id, t.head AS branch, count(*) AS n_nodes, sum(CASE WHEN t.pos > 0 THEN t.edge ELSE 0 END) AS path_length, max(sqrt((t.x-a.x)*(t.x-a.x)+(t.y-a.y)*(t.y-a.y)+(t.z-a.z)*(t.z-a.z))) AS radial_extent, avg(t.radius) AS mean_radius, stddev_pop(t.radius) AS std_radius, avg(CASE WHEN t.n_children >= 2 THEN 1.0 ELSE 0.0 END) AS branchiness, avg(t.dz) AS z_rel_soma, avg(CASE WHEN t.radius < 0.5 THEN 1.0 ELSE 0.0 END) AS thin_fraction FROM topo t JOIN topo h ON h.cell_id = t.cell_id AND h.id = t.head JOIN topo a ON a.cell_id = h.cell_id AND a.id = h.parent WHERE t.primary_root IS NOT NULL GROUP BY 1, 2", TREE)
def _(spark, sf):
    return features.branch_geometry(topo(spark, sf))


@query("proximal_distal", "cell_id:l branch:l proximal_mean_radius:d distal_mean_radius:d taper_ratio:d", "SELECT cell_id, head AS branch, avg(radius) FILTER (WHERE pos < greatest(1, n // 3)) AS proximal_mean_radius, avg(radius) FILTER (WHERE pos >= n - greatest(1, n // 3)) AS distal_mean_radius, avg(radius) FILTER (WHERE pos >= n - 3) / avg(radius) FILTER (WHERE pos < 3) AS taper_ratio FROM (SELECT *, count(*) OVER (PARTITION BY cell_id, head) AS n FROM topo WHERE primary_root IS NOT NULL) q GROUP BY 1, 2", TREE)
def _(spark, sf):
    return features.branch_geometry(topo(spark, sf))


@query("branch_symmetry", "cell_id:l anchor:l symmetry:d", f"SELECT cell_id, anchor, CASE WHEN max(med) > 1e-9 THEN 1 - least(1.0, avg(abs(radius - med)) / max(med)) ELSE 0.5 END AS symmetry FROM (SELECT cell_id, parent AS anchor, radius, quantile_cont(radius, 0.5) OVER (PARTITION BY cell_id, parent) AS med FROM ({NODES}) n WHERE parent <> -1) q GROUP BY 1, 2")
def _(spark, sf):
    return features.branch_symmetry(forest.forest(nodes(spark, sf)))


@query("sholl_crossings", "cell_id:l primary_root:l radius:l crossings:l", "SELECT e.cell_id, e.primary_root, r.radius, count(*) FILTER (WHERE e.lo < r.radius AND r.radius <= e.hi) AS crossings FROM (SELECT t.cell_id, t.primary_root, least(t.radial, p.radial) AS lo, greatest(t.radial, p.radial) AS hi FROM topo t JOIN topo p ON p.cell_id = t.cell_id AND p.id = t.parent WHERE t.primary_root IS NOT NULL) e CROSS JOIN (SELECT unnest([10,25,50,100,200,400,800]) AS radius) r GROUP BY 1, 2, 3", TREE)
def _(spark, sf):
    return features.sholl_crossings(topo(spark, sf))


@query("lmeasure_totals", "cell_id:l primary_root:l n_nodes:l n_bifs:l n_tips:l length:d surface:d volume:d euc_max:d path_max:d", "SELECT t.cell_id, t.primary_root, count(*) AS n_nodes, count(*) FILTER (WHERE t.n_children >= 2) AS n_bifs, count(*) FILTER (WHERE t.n_children = 0) AS n_tips, sum(t.edge) AS length, sum(2 * pi() * (t.radius + t.pr) / 2 * t.edge) AS surface, sum(pi() * (t.radius + t.pr) / 2 * (t.radius + t.pr) / 2 * t.edge) AS volume, max(t.radial) AS euc_max, max(t.path) AS path_max FROM topo t WHERE t.primary_root IS NOT NULL GROUP BY 1, 2", TREE)
def _(spark, sf):
    return features.lmeasure_totals(topo(spark, sf))


@query("neurom_branch", "cell_id:l branch:l path_len:d radial_max:d z_above:d taper:d subtree_nodes:l subtree_bifs:l", "SELECT q.cell_id, q.branch, q.path_len, q.radial_max, q.z_above, (h.radius - l.radius) / greatest(1e-6, h.radius) AS taper, s.size AS subtree_nodes, s.forks AS subtree_bifs FROM (SELECT cell_id, head AS branch, sum(edge) AS path_len, max(radial) AS radial_max, avg(dz) AS z_above, arg_max(id, pos) AS last FROM topo WHERE primary_root IS NOT NULL GROUP BY 1, 2) q JOIN topo h ON h.cell_id = q.cell_id AND h.id = q.branch JOIN topo l ON l.cell_id = q.cell_id AND l.id = q.last JOIN (SELECT b.cell_id, b.anc, count(*) AS size, count(*) FILTER (WHERE d.n_children >= 2) AS forks FROM below b JOIN topo d ON d.cell_id = b.cell_id AND d.id = b.id GROUP BY 1, 2) s ON s.cell_id = q.cell_id AND s.anc = q.last", TREE + BELOW)
def _(spark, sf):
    return features.neurom_branches(topo(spark, sf))


# ---------------------------------------------------------------- metrics and statistics

_PER = f"(SELECT cell_type, l.label, sum(CASE WHEN type = l.label THEN 1 ELSE 0 END) AS support, sum(CASE WHEN pred = l.label THEN 1 ELSE 0 END) AS predicted, sum(CASE WHEN type = l.label AND pred = l.label THEN 1 ELSE 0 END) AS tp FROM ({PRED}) p CROSS JOIN (SELECT unnest([1,2,3,4]) AS label) l WHERE type IN (1,2,3,4) GROUP BY 1, 2)"
_F1 = f"(SELECT *, CASE WHEN predicted > 0 THEN tp * 1.0 / predicted ELSE 0 END AS precision_, CASE WHEN support > 0 THEN tp * 1.0 / support ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2.0 * tp / (predicted + support) ELSE 0 END AS f1 FROM {_PER} a)"


@query("confusion", "cell_type:s gt:l pred:l n:l", f"SELECT cell_type, type AS gt, pred, count(*) AS n FROM ({PRED}) p GROUP BY 1, 2, 3")
def _(spark, sf):
    return metrics.confusion(pred(spark, sf), ["cell_type"])


@query("confusion_matrix", "cell_type:s gt:l pred_1:l pred_2:l pred_3:l pred_4:l other:l", f"SELECT cell_type, type AS gt, count(*) FILTER (WHERE pred = 1) AS pred_1, count(*) FILTER (WHERE pred = 2) AS pred_2, count(*) FILTER (WHERE pred = 3) AS pred_3, count(*) FILTER (WHERE pred = 4) AS pred_4, 0 AS other FROM ({PRED}) p GROUP BY 1, 2")
def _(spark, sf):
    return metrics.confusion_matrix(metrics.confusion(pred(spark, sf), ["cell_type"]), ["cell_type"])


@query("node_metrics", "cell_type:s label:l support:l tp:l recall:d f1:d", f"SELECT * FROM {_F1} b")
def _(spark, sf):
    return metrics.per_label(metrics.confusion(pred(spark, sf), ["cell_type"]), ["cell_type"])


@query("overall_metrics", "cell_type:s n:l accuracy:d macro_f1:d neurite_macro_f1:d macro_recall:d", f"SELECT m.cell_type, a.n, a.accuracy, m.macro_f1, m.neurite_macro_f1, m.macro_recall FROM (SELECT cell_type, avg(f1) AS macro_f1, avg(f1) FILTER (WHERE label <> 1) AS neurite_macro_f1, avg(recall) AS macro_recall FROM {_F1} b WHERE support > 0 GROUP BY 1) m JOIN (SELECT cell_type, count(*) AS n, avg(CASE WHEN type = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM ({PRED}) p GROUP BY 1) a ON a.cell_type = m.cell_type")
def _(spark, sf):
    return metrics.summary(metrics.confusion(pred(spark, sf), ["cell_type"]), ["cell_type"])


@query("file_metrics", "cell_id:l n:l accuracy:d", f"SELECT cell_id, count(*) AS n, avg(CASE WHEN type = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM ({PRED}) p GROUP BY 1 HAVING count(*) FILTER (WHERE type <> 1) >= 50")
def _(spark, sf):
    return metrics.file_scores(pred(spark, sf), ["cell_id"])


@query("balanced_weights", "type:l total:d n:l", f"SELECT type, sum(w * (SELECT sum(radius) FROM ({PRED}) a) / ((SELECT count(DISTINCT type) FROM ({PRED}) b) * own)) AS total, count(*) AS n FROM (SELECT type, radius AS w, sum(radius) OVER (PARTITION BY type) AS own FROM ({PRED}) p) q GROUP BY 1")
def _(spark, sf):
    return metrics.balanced_weights(pred(spark, sf).withColumn("w", F.col("radius"))).groupBy("type").agg(F.sum("balanced").alias("total"), F.count(F.lit(1)).alias("n"))


@query("class_prior", "label:l share:d", f"SELECT type AS label, count(*) * 1.0 / (SELECT count(*) FROM ({NODES}) a WHERE type <> 1) AS share FROM ({NODES}) n WHERE type <> 1 GROUP BY 1")
def _(spark, sf):
    return metrics.prior(nodes(spark, sf))


@query("batch_summary", "batch:l files:l n:l accuracy:d accuracy_median:d", f"SELECT batch, count(*) AS files, sum(n) AS n, sum(c) * 1.0 / sum(n) AS accuracy, quantile_cont(c * 1.0 / n, 0.5) AS accuracy_median FROM (SELECT cell_id % 5 AS batch, cell_id, count(*) AS n, count(*) FILTER (WHERE type = pred) AS c FROM ({PRED}) p GROUP BY 1, 2) q GROUP BY 1")
def _(spark, sf):
    return metrics.batch_summary(pred(spark, sf).withColumn("batch", F.col("cell_id") % 5))


@query("subtree_accuracy", "cell_id:l primary_root:l gt_label:l pred_label:l correct:l", """
SELECT g.cell_id, g.primary_root, g.l AS gt_label, coalesce(p.l, 0) AS pred_label, CASE WHEN g.l = coalesce(p.l, 0) THEN 1 ELSE 0 END AS correct FROM (
 SELECT * FROM (SELECT t.cell_id, t.primary_root, t.type AS l, row_number() OVER (PARTITION BY t.cell_id, t.primary_root ORDER BY count(*) DESC, CASE WHEN t.type = max(r.type) THEN 0 ELSE 1 END, t.type) AS rn FROM topo t JOIN topo r ON r.cell_id = t.cell_id AND r.id = t.primary_root WHERE t.type IN (2,3,4) GROUP BY 1, 2, 3) a WHERE rn = 1) g
LEFT JOIN (SELECT * FROM (SELECT t.cell_id, t.primary_root, t.pred AS l, row_number() OVER (PARTITION BY t.cell_id, t.primary_root ORDER BY count(*) DESC, CASE WHEN t.pred = max(r.pred) THEN 0 ELSE 1 END, t.pred) AS rn FROM topo t JOIN topo r ON r.cell_id = t.cell_id AND r.id = t.primary_root WHERE t.pred IN (2,3,4) GROUP BY 1, 2, 3) a WHERE rn = 1) p ON p.cell_id = g.cell_id AND p.primary_root = g.primary_root""", TREE)
def _(spark, sf):
    return metrics.subtree_records(topo(spark, sf))


_S = f"(SELECT *, split_part(file_name, '__', 1) AS source FROM ({SCORES}) s)"


def _scores(spark, sf):
    return prep.by_source(scores(spark, sf)).withColumn("f1", F.col("f1_milli"))


_F = f"(SELECT *, split_part(file_name, '__', 1) AS source FROM ({FILES}) s)"


def _file_scores(spark, sf):
    return prep.by_source(files(spark, sf)).withColumn("f1", F.col("f1_milli"))


@query("f1_summary_linear", "method:s n_files:l mean:d median:d p10:d p25:d least:l", f"SELECT method, count(*) AS n_files, avg(f1_milli) AS mean, quantile_cont(f1_milli, 0.5) AS median, quantile_cont(f1_milli, 0.1) AS p10, quantile_cont(f1_milli, 0.25) AS p25, min(f1_milli) AS least FROM {_S} q GROUP BY 1")
def _(spark, sf):
    return metrics.score_summary(_scores(spark, sf), ["method"])


@query("f1_nearest_rank", "method:s source:s n:l median:l p10:l p25:l p75:l p90:l", f"SELECT method, source, n, l[n // 2 + 1] AS median, " + ", ".join(f"l[CAST(round_even((n - 1) * {p / 100}, 0) AS BIGINT) + 1] AS p{p}" for p in (10, 25, 75, 90)) + f" FROM (SELECT method, source, count(*) AS n, list(f1_milli ORDER BY f1_milli) AS l FROM {_S} q GROUP BY 1, 2) r")
def _(spark, sf):
    return metrics.nearest_rank(_scores(spark, sf), ["method", "source"])


@query("source_grouping_sets", "cell_type:s source:s n:l mean:d least:l most:l", f"SELECT CASE WHEN grouping(cell_type) = 1 THEN '*' ELSE cell_type END AS cell_type, CASE WHEN grouping(source) = 1 THEN '*' ELSE source END AS source, count(*) AS n, avg(f1_milli) AS mean, min(f1_milli) AS least, max(f1_milli) AS most FROM {_F} q GROUP BY GROUPING SETS ((), (source), (cell_type), (cell_type, source))")
def _(spark, sf):
    return metrics.breakdown(_file_scores(spark, sf))


@query("tail_head", "part:s n:l mean:d", f"SELECT CASE WHEN f1_milli <= (SELECT quantile_cont(f1_milli, 0.1) FROM {_F} a) THEN 'tail' ELSE 'head' END AS part, count(*) AS n, avg(f1_milli) AS mean FROM {_F} q GROUP BY 1")
def _(spark, sf):
    return metrics.tail_head(_file_scores(spark, sf))


_D = f"(SELECT x.method AS a, y.method AS b, x.f1_milli - y.f1_milli AS d FROM ({SCORES}) x JOIN ({SCORES}) y ON x.file_name = y.file_name AND x.method < y.method)"


@query("method_pairs", "a:s b:s n:l d:l", f"SELECT a, b, count(*) AS n, sum(d) AS d FROM {_D} p GROUP BY 1, 2")
def _(spark, sf):
    return stats.method_pairs(_scores(spark, sf)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d"))


_RANKED = f"(SELECT a, b, d, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY a, b, abs(d)) AS k FROM {_D} q WHERE d <> 0)"
#: Probability beyond z of the normal distribution on both sides, by Simpson's rule.
_BEYOND = "greatest(0.0, 1 - 2 * abs(z) / 6000.0 / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 3 * exp(-pow(i * abs(z) / 2000.0, 2) / 2))))"


@query("wilcoxon_rank_sums", "a:s b:s n_pairs:l wins:l losses:l ties:l w_plus:d w_minus:d z:d p_value:d p_bonferroni:d", f"SELECT *, least(1.0, p_value * count(*) OVER ()) AS p_bonferroni FROM (SELECT *, {_BEYOND} AS p_value FROM (SELECT p.a, p.b, n_pairs, wins, losses, ties, w_plus, w_minus, (least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - t / 48.0) AS z FROM (SELECT a, b, count(*) AS n_pairs, count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d < 0) AS losses, count(*) FILTER (WHERE d = 0) AS ties FROM {_D} q GROUP BY 1, 2) p JOIN (SELECT a, b, count(*) AS n, sum(k * k - 1) AS t, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM {_RANKED} s GROUP BY 1, 2) w ON w.a = p.a AND w.b = p.b) x) y")
def _(spark, sf):
    return stats.wilcoxon(stats.method_pairs(_scores(spark, sf)))


#: Pairs of methods in groups of about 30 files, with differences that are all of their own size.
_FEW = f"(SELECT concat(x.method, y.method, CAST(CAST(k.c_custkey AS BIGINT) // 37 AS VARCHAR)) AS a, x.f1_milli - y.f1_milli + (k.c_custkey + 1) / 100003.0 AS d FROM ({SCORES}) x JOIN ({SCORES}) y ON x.file_name = y.file_name AND x.method < y.method JOIN customer k ON CAST(k.c_custkey AS VARCHAR) = regexp_extract(x.file_name, '__([0-9]+)', 1))"
_SETS = """
sets(r, c) AS (SELECT 0, list_transform(range(1276), lambda i: CAST(CASE WHEN i = 0 THEN 1 ELSE 0 END AS DOUBLE)) UNION ALL
  SELECT r + 1, list_transform(range(1276), lambda i: c[i + 1] + CASE WHEN i > r THEN c[i - r] ELSE CAST(0 AS DOUBLE) END) FROM sets WHERE r < 50)
"""


@query("signed_rank_exact", "a:s n_pairs:l w_plus:d w_minus:d p_value:d", f"SELECT a, n AS n_pairs, w_plus, w_minus, least(1.0, 2 * list_sum(c[1:CAST(least(w_plus, w_minus) AS INT) + 1]) / pow(2.0, n)) AS p_value FROM (SELECT a, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY abs(d)) AS r FROM {_FEW} f) g GROUP BY 1) w JOIN sets ON r = n", _SETS)
def _(spark, sf):
    pairs = stats.method_pairs(_scores(spark, sf)).withColumn("k", F.regexp_extract("file_name", "__([0-9]+)", 1).cast("long"))
    pairs = pairs.select(F.concat("a", "b", F.expr("k div 37").cast("string")).alias("a"), F.lit("x").alias("b"), (F.col("d") + (F.col("k") + 1) / 100003.0).alias("d"))
    return stats.wilcoxon(pairs)


@query("leaderboard", "source:s mean:d folds:l rank:l", f"SELECT source, mean, folds, row_number() OVER (ORDER BY mean DESC, source) AS rank FROM (SELECT source, avg(f1_milli) AS mean, count(*) AS folds FROM {_S} q GROUP BY 1) r")
def _(spark, sf):
    return stats.leaderboard(_scores(spark, sf), ["source"], "f1")


@query("timing", "method:s total:l median:d p95:d most:l", f"SELECT method, sum(f1_milli) AS total, quantile_cont(f1_milli, 0.5) AS median, quantile_cont(f1_milli, 0.95) AS p95, max(f1_milli) AS most FROM {_S} q GROUP BY 1")
def _(spark, sf):
    return stats.timing(_scores(spark, sf), ["method"], "f1")


@query("medians_and_scale", "cell_type:s feature:s median:d scale:d", f"SELECT cell_type, feature, median, CASE WHEN s > 1e-9 THEN s ELSE 1.0 END AS scale FROM (SELECT cell_type, feature, max(m) AS median, quantile_cont(abs(v - m), 0.5) AS s FROM (SELECT cell_type, feature, v, quantile_cont(v, 0.5) OVER (PARTITION BY cell_type, feature) AS m FROM (SELECT cell_type, 'radius' AS feature, radius AS v FROM ({NODES}) n UNION ALL SELECT cell_type, 'x', x FROM ({NODES}) n) a) b GROUP BY 1, 2) c")
def _(spark, sf):
    return metrics.medians_and_scale(nodes(spark, sf), ["radius", "x"])


@query("label_eval_docs", "label:l support:l tp:l f1:d", "SELECT l.label, count(*) FILTER (WHERE quality = l.label) AS support, count(*) FILTER (WHERE quality = l.label AND toxic = l.label) AS tp, CASE WHEN count(*) FILTER (WHERE quality = l.label AND toxic = l.label) > 0 THEN 2.0 * count(*) FILTER (WHERE quality = l.label AND toxic = l.label) / (count(*) FILTER (WHERE quality = l.label) + count(*) FILTER (WHERE toxic = l.label)) ELSE 0 END AS f1 FROM labels CROSS JOIN (SELECT unnest([0, 1]) AS label) l WHERE quality IN (0, 1) GROUP BY 1")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/labels.parquet").withColumn("g", F.lit(0))
    return metrics.per_label(metrics.confusion(rows, ["g"], "quality", "toxic"), ["g"], (0, 1))


@query("binary_metrics", "cell_type:s accuracy:d axon_recall:d dendrite_recall:d", f"SELECT cell_type, avg(CASE WHEN (type = 2) = (pred = 2) THEN 1.0 ELSE 0.0 END) AS accuracy, sum(CASE WHEN type = 2 AND pred = 2 THEN radius ELSE 0 END) / greatest(sum(CASE WHEN type = 2 THEN radius ELSE 0 END), 1) AS axon_recall, sum(CASE WHEN type <> 2 AND pred <> 2 THEN radius ELSE 0 END) / greatest(sum(CASE WHEN type <> 2 THEN radius ELSE 0 END), 1) AS dendrite_recall FROM ({PRED}) p GROUP BY 1")
def _(spark, sf):
    return metrics.binary(pred(spark, sf), ["cell_type"], "radius")


_G = f"(SELECT cell_id, CASE type WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE -100 END AS g, CASE pred WHEN 4 THEN 1 ELSE 0 END AS p FROM ({PRED}) p)"


@query("graph_metrics", "macro_f1:d f1_0:d f1_1:d graph_mean_macro_f1:d", f"SELECT (f0 + f1) / 2 AS macro_f1, f0 AS f1_0, f1 AS f1_1, (SELECT avg((f0 + f1) / 2) FROM (SELECT cell_id, coalesce(2.0 * sum(CAST(g = 0 AND p = 0 AS INT)) / nullif(2 * sum(CAST(g = 0 AND p = 0 AS INT)) + sum(CAST(g <> p AS INT)), 0), 0) AS f0, coalesce(2.0 * sum(CAST(g = 1 AND p = 1 AS INT)) / nullif(2 * sum(CAST(g = 1 AND p = 1 AS INT)) + sum(CAST(g <> p AS INT)), 0), 0) AS f1 FROM {_G} a WHERE g <> -100 GROUP BY 1) b) AS graph_mean_macro_f1 FROM (SELECT coalesce(2.0 * sum(CAST(g = 0 AND p = 0 AS INT)) / nullif(2 * sum(CAST(g = 0 AND p = 0 AS INT)) + sum(CAST(g <> p AS INT)), 0), 0) AS f0, coalesce(2.0 * sum(CAST(g = 1 AND p = 1 AS INT)) / nullif(2 * sum(CAST(g = 1 AND p = 1 AS INT)) + sum(CAST(g <> p AS INT)), 0), 0) AS f1 FROM {_G} c WHERE g <> -100) d")
def _(spark, sf):
    n = prep.branch_labels(pred(spark, sf).withColumn("gt", F.col("type"))).select("cell_id", F.col("y").alias("gt"), (F.col("pred") == 4).cast("int").alias("pred"))
    return metrics.graph_metrics(n, ["cell_id"])


@query("false_apical_rate", "n_cells:l n_false:l rate:d", f"SELECT count(*) AS n_cells, coalesce(sum(said), 0) AS n_false, coalesce(avg(said), 0) AS rate FROM (SELECT cell_id, max(CAST(type = 4 AND seq % 3 = 0 AS INT)) AS has, max(CAST(pred = 4 AND seq % 5 = 0 AS INT)) AS said FROM ({PRED}) p GROUP BY 1) q WHERE has = 0")
def _(spark, sf):
    p = pred(spark, sf).withColumn("type", F.when(F.col("seq") % 3 == 0, F.col("type")).otherwise(2)).withColumn("pred", F.when(F.col("seq") % 5 == 0, F.col("pred")).otherwise(2))
    return metrics.false_rate(p, ["cell_id"])


@query("no_apical_pyramidal", "cell_id:l", f"SELECT cell_id FROM ({NODES}) n WHERE cell_type = 'pyramidal' GROUP BY 1 HAVING NOT bool_or(type = 4 AND seq % 9 = 0)")
def _(spark, sf):
    n = nodes(spark, sf).withColumn("type", F.when((F.col("type") == 4) & (F.col("seq") % 9 != 0), 3).otherwise(F.col("type")))
    return prep.without_label(swc.type_sets(n).join(n.select("cell_id", "cell_type").distinct(), "cell_id"))


@query("sholl_vector", "cell_id:l primary_root:l crossings_50:l peak_radius:l total_length:d z_max:d", "SELECT a.cell_id, a.primary_root, b.c50 AS crossings_50, b.peak AS peak_radius, a.total_length, a.z_max FROM (SELECT cell_id, primary_root, sum(edge) AS total_length, max(dz) AS z_max FROM topo WHERE primary_root IS NOT NULL GROUP BY 1, 2) a JOIN (SELECT cell_id, primary_root, max(CASE WHEN radius = 50 THEN n END) AS c50, arg_max(radius, n * 10000 - radius) AS peak FROM (SELECT e.cell_id, e.primary_root, r.radius, count(*) FILTER (WHERE e.lo < r.radius AND r.radius <= e.hi) AS n FROM (SELECT t.cell_id, t.primary_root, least(t.radial, p.radial) AS lo, greatest(t.radial, p.radial) AS hi FROM topo t JOIN topo p ON p.cell_id = t.cell_id AND p.id = t.parent WHERE t.primary_root IS NOT NULL) e CROSS JOIN (SELECT unnest([10,25,50,100,200,400,800]) AS radius) r GROUP BY 1, 2, 3) c GROUP BY 1, 2) b ON a.cell_id = b.cell_id AND a.primary_root = b.primary_root", TREE)
def _(spark, sf):
    return features.sholl_vector(topo(spark, sf))


# ---------------------------------------------------------------- rules and quality control

_LEGAL = "(CASE WHEN cell_type = 'pyramidal' THEN [2,3,4] ELSE [2,3] END)"
_VOTE = "SELECT cell_id, primary_root, cell_type, sum(CASE WHEN pred = 2 THEN conf ELSE 0 END) AS v2, sum(CASE WHEN pred = 3 THEN conf ELSE 0 END) AS v3, CASE WHEN cell_type = 'pyramidal' THEN sum(CASE WHEN pred = 4 THEN conf ELSE 0 END) ELSE -1 END AS v4 FROM topo WHERE primary_root IS NOT NULL GROUP BY 1, 2, 3"
_WIN = "CASE WHEN v2 >= v3 AND v2 >= v4 THEN 2 WHEN v3 >= v4 THEN 3 ELSE 4 END"


@query("subtree_vote", "cell_id:l id:l pred:l", f"SELECT t.cell_id, t.id, CASE WHEN v.w IS NOT NULL AND list_contains({_LEGAL}, t.pred) THEN v.w ELSE t.pred END AS pred FROM topo t LEFT JOIN (SELECT cell_id, primary_root, {_WIN} AS w FROM ({_VOTE}) a WHERE v2 + v3 + greatest(v4, 0) > 0) v ON v.cell_id = t.cell_id AND v.primary_root = t.primary_root", TREE)
def _(spark, sf):
    return rules.subtree_vote(topo(spark, sf))


@query("single_class", "cell_id:l id:l pred:l", f"SELECT t.cell_id, t.id, CASE WHEN o.n > 1 AND t.pred = 2 THEN 3 ELSE t.pred END AS pred FROM topo t LEFT JOIN (SELECT v.cell_id, v.primary_root, row_number() OVER (PARTITION BY v.cell_id ORDER BY v2 DESC, r.seq) AS n FROM ({_VOTE.replace('CASE WHEN cell_type = ' + chr(39) + 'pyramidal' + chr(39) + ' THEN sum(CASE WHEN pred = 4 THEN conf ELSE 0 END) ELSE -1 END', 'sum(CASE WHEN pred = 4 THEN conf ELSE 0 END)')}) v JOIN topo r ON r.cell_id = v.cell_id AND r.id = v.primary_root WHERE {_WIN} = 2) o ON o.cell_id = t.cell_id AND o.primary_root = t.primary_root", TREE)
def _(spark, sf):
    return rules.single_class(topo(spark, sf), 2, 3)


def _round(k: int) -> str:
    """One round of smoothing in SQL, from s{k} to s{k + 1}."""
    votes = ", ".join(f"CASE WHEN s.pred = {v} THEN s.conf ELSE 0 END + CASE WHEN p.id <> p.proxy AND p.pred = {v} THEN 0.25 ELSE 0 END + 0.15 * coalesce(c.k{v}, 0) AS v{v}" for v in (2, 3, 4))
    return f"""s{k + 1} AS (SELECT cell_id, id, parent, proxy, conf, CASE WHEN id <> proxy AND pred <> 1 AND conf < 0.7 THEN {_WIN} ELSE pred END AS pred FROM (SELECT s.*, {votes} FROM s{k} s LEFT JOIN s{k} p ON p.cell_id = s.cell_id AND p.id = s.parent LEFT JOIN (SELECT cell_id, parent, count(*) FILTER (WHERE pred = 2) AS k2, count(*) FILTER (WHERE pred = 3) AS k3, count(*) FILTER (WHERE pred = 4) AS k4 FROM s{k} WHERE id <> proxy GROUP BY 1, 2) c ON c.cell_id = s.cell_id AND c.parent = s.id) q)"""


@query("smoothing_k3", "cell_id:l id:l pred:l", "SELECT cell_id, id, pred FROM s3", TREE + ", s0 AS (SELECT cell_id, id, parent, proxy, conf, pred FROM topo), " + ", ".join(_round(k) for k in range(3)))
def _(spark, sf):
    return rules.smooth(topo(spark, sf), 3, labels=F.array(*map(F.lit, (2, 3, 4))))


@query("soft_majority", "cell_id:l id:l pred:l", f"SELECT t.cell_id, t.id, CASE WHEN v.w IS NOT NULL AND t.conf < 0.55 AND list_contains({_LEGAL}, t.pred) THEN v.w ELSE t.pred END AS pred FROM topo t LEFT JOIN (SELECT cell_id, primary_root, {_WIN} AS w FROM ({_VOTE.replace('THEN conf', 'AND conf >= 0.7 THEN conf').replace(' FROM topo', ', count(*) AS size FROM topo')}) a WHERE size >= 4 AND v2 + v3 + greatest(v4, 0) > 0 AND greatest(v2, v3, v4) / (v2 + v3 + greatest(v4, 0)) >= 0.6) v ON v.cell_id = t.cell_id AND v.primary_root = t.primary_root", TREE)
def _(spark, sf):
    return rules.soft_majority(topo(spark, sf))


@query("strip_soma", "cell_id:l id:l pred:l", "SELECT cell_id, id, CASE WHEN id = proxy THEN 1 WHEN pred = 1 THEN 2 ELSE pred END AS pred FROM topo", TREE)
def _(spark, sf):
    return rules.strip_soma(topo(spark, sf))


@query("constrain_apical", "cell_id:l id:l pred:l", "SELECT t.cell_id, t.id, CASE WHEN o.owner IS NOT NULL AND coalesce(t.primary_root, -1) <> o.owner AND t.id <> t.proxy AND t.pred = 4 AND t.conf < 0.93 THEN 3 ELSE t.pred END AS pred FROM topo t LEFT JOIN (SELECT cell_id, min(primary_root) AS owner FROM topo WHERE cell_type = 'pyramidal' GROUP BY 1) o ON o.cell_id = t.cell_id", TREE)
def _(spark, sf):
    t = topo(spark, sf)
    return rules.constrain_apical(t, t.filter("cell_type = 'pyramidal'").groupBy("cell_id").agg(F.min("primary_root").alias("owner")))


@query("heuristic_labels", "cell_id:l id:l pred:l", "SELECT t.cell_id, t.id, CASE WHEN t.id = t.proxy THEN 1 WHEN s.a = 1 THEN 2 WHEN s.h1 = 1 AND t.cell_type = 'pyramidal' AND s.h > 5 THEN 4 ELSE 3 END AS pred FROM topo t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY r, seq) AS a, row_number() OVER (PARTITION BY cell_id ORDER BY h DESC, seq) AS h1 FROM (SELECT u.cell_id, u.primary_root, avg(u.radius) AS r, max(u.dz) AS h, max(q.seq) AS seq FROM topo u JOIN topo q ON q.cell_id = u.cell_id AND q.id = u.primary_root GROUP BY 1, 2) x) s ON s.cell_id = t.cell_id AND s.primary_root = t.primary_root", TREE)
def _(spark, sf):
    return rules.heuristic_labels(topo(spark, sf))


@query("majority_labels", "cell_type:s pred:l n:l", f"SELECT cell_type, pred, count(*) AS n FROM (SELECT n.cell_type, CASE WHEN type = 1 THEN 1 WHEN cell_type = 'pyramidal' THEN (SELECT type FROM ({NODES}) a WHERE type <> 1 GROUP BY 1 ORDER BY count(*) DESC, type LIMIT 1) ELSE (SELECT type FROM ({NODES}) a WHERE type IN (2,3) GROUP BY 1 ORDER BY count(*) DESC, type LIMIT 1) END AS pred FROM ({NODES}) n) q GROUP BY 1, 2")
def _(spark, sf):
    n = nodes(spark, sf)
    return rules.majority_labels(n, metrics.prior(n)).groupBy("cell_type", "pred").agg(F.count(F.lit(1)).alias("n"))


_SQL_DIAGNOSED = f"""
SELECT cell_id, axon, CASE WHEN n_flags = 0 THEN 'healthy' WHEN axon < 0.05 OR axon > 0.95 OR present <= 1 THEN 'bad' WHEN inv THEN 'suspicious' ELSE 'borderline' END AS verdict, n_flags FROM (
 SELECT *, CAST(axon < 0.05 AS INT) + CAST(axon > 0.95 AS INT) + CAST(present <= 1 AS INT) + CAST(inv AS INT) + CASE cell_type WHEN 'pyramidal' THEN CAST(NOT axon BETWEEN 0.30 AND 0.90 AS INT) + CAST(NOT basal BETWEEN 0.05 AND 0.70 AS INT) + CAST(NOT apical BETWEEN 0.05 AND 0.40 AS INT) ELSE CAST(NOT axon BETWEEN 0.30 AND 0.95 AS INT) + CAST(NOT basal BETWEEN 0.05 AND 0.50 AS INT) END AS n_flags FROM (
  SELECT *, CAST(axon > 0.01 AS INT) + CAST(basal > 0.01 AS INT) + CAST(apical > 0.01 AS INT) AS present, coalesce(na >= 10 AND adz < 0, false) AS inv FROM (
   SELECT cell_id, cell_type, avg(CASE WHEN type = 2 THEN 1.0 ELSE 0 END) AS axon, avg(CASE WHEN type = 3 THEN 1.0 ELSE 0 END) AS basal, avg(CASE WHEN type = 4 THEN 1.0 ELSE 0 END) AS apical, count(*) FILTER (WHERE type = 4) AS na, avg(z) FILTER (WHERE type = 4) - arg_min(z, seq) FILTER (WHERE type = 1) AS adz FROM ({NODES}) n GROUP BY 1, 2) a) b) c"""


@query("qc_diagnose", "cell_id:l axon:d verdict:s n_flags:l", _SQL_DIAGNOSED)
def _(spark, sf):
    return qc.diagnose(nodes(spark, sf), ["cell_id", "cell_type"]).withColumn("n_flags", F.size("flags"))


# ---------------------------------------------------------------- models

@query("cell_type_model", "cell_id:l prediction:l p1:d")
def _(spark, sf):
    """The types of the test cells, told by a vote of three that learned from the others."""
    learn, test = (checkpointed(labelling.cell_table(x)) for x in labelling.in_parts(topo(spark, sf)))
    names = list(labelling.CELL_MEASURES)
    models = ml.train_cell_type(learn.withColumn("label", (F.col("cell_type") == "pyramidal").cast("double")), names, trees=10)
    return ml.predict_cell_type(models, test, names)


@query("scaler_stats", "feature:s mean:d std:d", f"SELECT 'radius' AS feature, avg(radius) AS mean, stddev_pop(radius) AS std FROM ({NODES}) n UNION ALL SELECT 'x', avg(x), stddev_pop(x) FROM ({NODES}) n")
def _(spark, sf):
    return ml.scaler_stats(nodes(spark, sf), ["radius", "x"])


@query("neighbour_mean", "cell_id:l id:l m:d", "SELECT v.cell_id, v.id, coalesce(avg(b.radius), 0) AS m FROM topo v LEFT JOIN topo b ON b.cell_id = v.cell_id AND (b.parent = v.id OR v.parent = b.id) GROUP BY 1, 2", TREE)
def _(spark, sf):
    n = nodes(spark, sf)
    up = n.filter("parent > 0").select("cell_id", F.col("id").alias("a"), F.col("parent").alias("b"))
    edges = up.unionByName(up.select("cell_id", F.col("b").alias("a"), F.col("a").alias("b")))
    v = n.select("cell_id", "id", F.array("radius").alias("x"))
    return ml.neighbour_mean(v, edges, ["cell_id"]).withColumn("m", F.col("mean")[0])


@query("label_cells", "stage:s cell_type:s n:l accuracy:d")
def _(spark, sf):
    return labelling.evaluate(labelling.label_cells(nodes(spark, sf), trees=5))
