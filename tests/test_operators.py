"""Small cases whose answers can be worked out on paper."""

import math

import pytest
from pyspark.sql import functions as F

from neuritic.functions import scalars
from neuritic.operators import features, forest, metrics, ml, prep, qc, rules, stats
from neuritic.sources import swc, tables
from neuritic.streaming import ingest

SCHEMA = "cell_id string, cell_type string, seq int, id long, type int, x double, y double, z double, radius double, parent long"


def cell(spark, rows, cell_type="pyramidal"):
    """rows: (id, parent, x, radius, type)."""
    return spark.createDataFrame([("c", cell_type, k, i, t, float(x), 0.0, 0.0, float(r), p) for k, (i, p, x, r, t) in enumerate(rows)], SCHEMA)


def by_id(df, *cols):
    return {r["id"]: (r[cols[0]] if len(cols) == 1 else tuple(r[c] for c in cols)) for r in df.collect()}


def test_chain(spark):
    t = forest.topology(cell(spark, [(k, k - 1 if k > 1 else -1, k, 1, 3) for k in range(1, 6)]))
    assert by_id(t, "path", "depth") == {k: (k - 1.0, k - 1) for k in range(1, 6)}
    assert set(by_id(forest.strahler(t), "strahler").values()) == {1}
    f = features.cell_features(t).first()
    assert f["n_terminals"] == 1 and f["path_radial_ratio_mean"] == 1


def test_y(spark):
    t = forest.topology(cell(spark, [(1, -1, 0, 5, 1), (2, 1, 1, 1, 3), (3, 2, 2, 1, 3), (4, 3, 3, 1, 3), (5, 3, 3, 1, 3)]))
    assert by_id(forest.strahler(t), "strahler") == {1: 2, 2: 2, 3: 2, 4: 1, 5: 1}
    assert features.cell_counts(t).first()["n_branch_points"] == 1
    assert features.partition_asymmetry(t).first()["max_asymmetry"] == 0


def test_roots_and_proxy(spark):
    rows = [(1, -1, 0, 1, 1), (2, 99, 5, 3, 1), (3, 2, 6, 1, 3), (4, -1, 9, 3, 1)]
    n = cell(spark, rows)
    assert by_id(forest.forest(n), "is_root") == {1: True, 2: True, 3: False, 4: True}
    assert forest.proxy_soma(forest.forest(n)).first()["proxy"] == 2  # radius, then children


def test_duplicates_and_cycles(spark):
    rows = [(1, -1, 0, 5, 1), (2, 1, 7, 1, 3), (2, 1, 3, 1, 3), (3, 3, 1, 1, 3), (4, 5, 1, 1, 3), (5, 4, 2, 1, 3)]
    got = by_id(forest.topology(cell(spark, rows)), "path", "depth", "reached")
    assert got == {1: (0.0, 0, True), 2: (3.0, 1, True), 3: (0.0, 0, False), 4: (0.0, 0, False), 5: (0.0, 0, False)}


def test_malformed_lines(spark):
    lines = ["# head", "", "1 1 0 0 0 5 -1", " 3.0  3 1 2 3 0.5 1 extra", "4 3 1 2 3 0.5", "nan_id 3 1 2 3 0.5 1", "nan 3 1 2 3 0.5 1", "5 3 x 2 3 0.5 1"]
    df = spark.createDataFrame([("c", k, v) for k, v in enumerate(lines)], "cell_id string, seq int, line string")
    assert [(r.id, r.type, r.parent) for r in swc.parse_lines(df).orderBy("seq").collect()] == [(1, 1, -1), (3, 3, 1)]


def test_long_branch(spark):
    rows = [(1, -1, 0, 5, 1)] + [(k, k - 1, (k - 1) * 40, 1, 3) for k in range(2, 12)]
    t = forest.topology(cell(spark, rows))
    assert forest.branches(t).count() == 10
    kept = forest.branches(t, 180.0)  # 0, 40, ..., 200 within the branch
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4, 5, 6, 7]
    fork = rows + [(12, 11, 500, 1, 3), (13, 11, 510, 1, 3)]
    assert forest.branches(forest.topology(cell(spark, fork)), 180.0).count() == 6  # nothing beyond the cut


def test_percentiles_differ(spark):
    s = spark.createDataFrame([(float(k), "m") for k in range(1, 7)], "f1 double, method string")
    assert metrics.score_summary(s, ["method"]).first()["p10"] == 1.5
    assert metrics.nearest_rank(s, ["method"]).first()["p10"] == 1.0
    assert metrics.nearest_rank(s, ["method"]).first()["median"] == 4.0


def test_illegal_predictions(spark):
    rows = spark.createDataFrame([(2, 2), (2, 9), (3, 2), (3, 3), (9, 3)], "type int, pred int").withColumn("k", F.lit(1))
    m = {r.label: r for r in metrics.per_label(metrics.confusion(rows, ["k"]), ["k"]).collect()}
    assert m[2].support == 2 and m[2].recall == 0.5 and m[2].precision == 0.5 and m[3].precision == 1.0
    assert metrics.summary(metrics.confusion(rows, ["k"]), ["k"]).first()["n"] == 4
    wide = metrics.confusion_matrix(metrics.confusion(rows, ["k"]), ["k"]).filter("gt = 2").first()
    assert wide["other"] == 1


def test_single_apical(spark):
    rows = [(1, -1, 0, 5, 1), (2, 1, -10, 1, 4), (3, 2, -12, 1, 4), (4, 1, 20, 1, 4), (5, 4, 30, 1, 4), (6, 5, 40, 1, 4)]
    n = forest.topology(cell(spark, rows).withColumn("pred", F.col("type")).withColumn("conf", F.lit(0.9)))
    assert by_id(rules.single_apical(n), "pred") == {1: 1, 2: 3, 3: 3, 4: 4, 5: 4, 6: 4}


def test_smoothing_and_islands(spark):
    rows = [(1, -1, 0, 5, 1)] + [(k, k - 1, k, 1, 3) for k in range(2, 8)]
    n = forest.topology(cell(spark, rows).withColumn("pred", F.when(F.col("id") == 1, 1).when(F.col("id") == 4, 2).otherwise(3)).withColumn("conf", F.when(F.col("id") == 4, 0.2).otherwise(0.9)))
    want = {1: 1} | dict.fromkeys(range(2, 8), 3)
    assert by_id(rules.smooth(n, 1), "pred") == want
    assert by_id(rules.flip_islands(n), "pred") == want
    assert by_id(rules.flip_islands(n, threshold=0.1), "pred")[4] == 2


def test_refine_and_decode(spark):
    rows = [(1, -1, 0, 5, 1), (2, 1, -10, 1, 2), (3, 2, -12, 1, 2), (4, 1, 20, 1, 4), (5, 4, 30, 1, 3)]
    for kind in ("pyramidal", "interneuron"):
        n = forest.topology(cell(spark, rows, kind).withColumn("pred", F.lit(1)).withColumn("conf", F.lit(0.5)))
        got = by_id(rules.refine(n), "pred")
        assert got[1] == 1 and set(got.values()) <= {1, 2, 3, 4} and list(got.values()).count(1) == 1
    p = spark.createDataFrame([("interneuron", [0.2, 0.3, 0.5]), ("pyramidal", [0.2, 0.3, 0.5])], "cell_type string, probability array<double>")
    got = {r.cell_type: (r.pred, round(r.conf, 3)) for r in rules.decode(p).collect()}
    assert got == {"interneuron": (3, 0.6), "pyramidal": (4, 0.5)}


def test_cell_type_rules(spark):
    c = spark.createDataFrame([("a", "pyramidal", 4, 0.3, 300.0, 0.1, 6000, 2000, 300.0, 1)], "cell_id string, cell_type string, n_primary_subtrees int, z_asymmetry double, z_span double, branch_point_ratio double, n_nodes int, max_subtree_size int, subtree_size_std double, n_root_nodes int")
    r = rules.label_sets(rules.guess_cell_type(rules.structure_flags(c))).first()
    assert r.guess == "pyramidal" and r.flags["large_morphology"] and not r.flags["multi_root"] and r.label_set == [1, 2, 3, 4]
    trials = spark.createDataFrame([("a", "pyramidal", "pyramidal", 0.5, 0.6), ("a", "interneuron", "pyramidal", 0.5, 0.7), ("b", "pyramidal", "pyramidal", 0.9, 0.1), ("b", "interneuron", "pyramidal", 0.9, 0.7)], "cell_id string, cell_type string, own_type string, type_conf double, branch_conf double")
    assert {r.cell_id: (r.cell_type, r.handed_off) for r in rules.soft_handoff(trials).collect()} == {"a": ("interneuron", True), "b": ("pyramidal", False)}


def test_owners_and_override(spark):
    o = spark.createDataFrame([("a", 2, 0.5), ("a", 3, 0.7), ("b", 2, 0.4)], "cell_id string, primary_root long, prob_4 double")
    assert [tuple(r) for r in rules.apical_owner(o).collect()] == [("a", 3)]
    b = spark.createDataFrame([("a", 3, 4), ("a", 4, 4), ("b", 3, 4), ("a", 2, 4)], "cell_id string, pred int, gnn int")
    assert sorted(tuple(r) for r in rules.override(b).select("cell_id", "pred").collect()) == [("a", 2), ("a", 4), ("a", 4), ("b", 3)]


def test_scalars(spark):
    r = spark.range(1).select(
        scalars.slug(F.lit("  a b/c?.swc ")).alias("slug"), scalars.slug(F.lit("??")).alias("none"), scalars.basename(F.lit("a\\b/c.swc")).alias("base"), scalars.benchmark_id(F.lit("pyr"), F.lit(7)).alias("bid"),
        scalars.verdict_class(F.lit("BAD GT — incomplete")).alias("v"), scalars.safe_div(F.lit(1), F.lit(0)).alias("d"), scalars.finite(F.lit(float("inf"))).alias("f"), scalars.percent(F.lit(0.1234)).alias("p"),
        scalars.clean_name(F.lit("a;b c/d")).alias("n"), scalars.is_error_page(F.lit("<HTML>")).alias("e"), scalars.dendrite_class(F.lit("sparsely spiny")).alias("t"), scalars.canonical_labels(F.lit("interneuron"), F.array(F.lit(2), F.lit(1))).alias("c"),
    ).first()
    assert tuple(r) == ("a_b_c_.swc", "na", "c.swc", "pyr_0007", "BAD GT", 0.0, 0.0, "12.3%", "a_b_c_d", True, "interneuron", True)


def test_files(spark, tmp_path):
    rows = [(1, -1, 0, 5, 1), (2, 1, 1.5, 1, 3)]
    swc.write_swc(cell(spark, rows), str(tmp_path / "out"))
    folder = tmp_path / "batch_01" / "Pyramidal cells" / "swc"
    folder.mkdir(parents=True)
    (folder / "a.swc").write_text("# x\n1 1 0 0 0 5 -1\r\n2 3 1 0 0 1 1\nbad\n")
    (folder / "skip.txt").write_text("1 1 0 0 0 5 -1")
    got = swc.read_swc(spark, str(tmp_path / "batch_01")).collect()
    assert {(r.seq, r.id, r.cell_type, r.batch) for r in got} == {(1, 1, "pyramidal_cells", "batch_01"), (2, 2, "pyramidal_cells", "batch_01")}
    (tmp_path / "split.json").write_text('{"seed": 42, "test_size": 0.2, "data_dir": "d", "test_files": {"pyramidal": ["x/a.swc"], "interneuron": []}}')
    assert [tuple(r) for r in tables.read_split(spark, str(tmp_path / "split.json")).collect()] == [("pyramidal", "a.swc")]
    (tmp_path / "r.json").write_text('{"overall": {"accuracy": 0.5}}')
    assert tables.read_result(spark, str(tmp_path / "r.json")).first()[0] == '{"accuracy":0.5}'
    s = spark.createDataFrame([("x/a.swc", "0.5"), ("b.swc", "bad"), ("c.swc", None)], "path string, neurite_macro_f1 string")
    assert [tuple(r) for r in tables.read_scores(s).collect()] == [("a.swc", 0.5)]


def test_stream(spark, tmp_path):
    src = tmp_path / "in" / "interneuron"
    src.mkdir(parents=True)
    args = (spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "checkpoint"))
    (src / "a.swc").write_text("1 1 0 0 0 5 -1\n2 3 1 0 0 1 1\n")
    ingest.ingest(*args).awaitTermination(120)
    (src / "b.swc").write_text("1 1 0 0 0 5 -1\n")
    ingest.ingest(*args).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "table"))
    assert got.count() == 3 and {r.cell_type for r in got.collect()} == {"interneuron"}


def test_upserts_by_bucket(spark, tmp_path):
    src, table = tmp_path / "rows", str(tmp_path / "table")
    want = {}
    for number in range(3):
        rows = [(k, number) for k in range(number, 40, number + 1)]
        want |= dict(rows)
        spark.createDataFrame(rows, "file_name long, n int").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("file_name long, n int").parquet(str(src))
        ingest.upsert_batches(stream, table, "file_name", str(tmp_path / "checkpoint"), buckets=4).awaitTermination(120)
        assert {r.file_name: r.n for r in ingest.current(spark, table).collect()} == want
    assert spark.read.parquet(table).count() == len(want)  # what is replaced is gone


def test_pool_and_selection(spark):
    files = spark.createDataFrame([("pyramidal", "allen", "d/a b.swc", [1, 2, 3]), ("pyramidal", "allen", "d/c.swc", [1, 3]), ("interneuron", "lab", "e.swc", [1, 2])], "cell_type string, source string, path string, types array<int>")
    meta = [spark.createDataFrame([("a b.swc", "pyramidal", "L5")], "file_name string, cell_type string, layer string"), spark.createDataFrame([("a b.swc", "pyramidal", "L2"), ("e.swc", "pyramidal", "x")], "file_name string, cell_type string, layer string")]
    got = {r.file_name: (r.copied_file, r.meta_layer, r.type_set) for r in prep.source_pool(files, meta).collect()}
    assert got == {"a b.swc": ("allen__na__a b.swc", "L5", "1 2 3"), "e.swc": ("lab__na__e.swc", None, "1 2")}
    c = spark.createDataFrame([("pyramidal", s, f"{s}{k}") for s in ("allen", "lab", "neuromorpho") for k in range(4)], "cell_type string, source string, path string")
    got = [r.path for r in prep.select_examples(c, 7, {"pyramidal": {"allen": 1, "neuromorpho": 2}}).orderBy("n").collect()]
    assert got == ["allen0", "neuromorpho0", "neuromorpho1", "allen1", "allen2", "allen3", "lab0"]
    few = spark.createDataFrame([(f"f{k}", "a") for k in range(2)], "file_name string, cell_type string")
    assert prep.split(few, 1e-9).filter("is_test").count() == 1
    assert {r.fold for r in prep.folds(c.withColumnRenamed("path", "file_name"), 3).collect()} == {0, 1, 2}
    base = spark.createDataFrame([("hpf_ca1__x", [1, 4])], "file_name string, types array<int>")
    extra = spark.createDataFrame([("x", [1, 4]), ("y", [1, 3]), ("z", [1, 4])], "file_name string, types array<int>")
    assert sorted(r.file_name for r in prep.merge_sets(base, extra).collect()) == ["hpf_ca1__x", "hpf_ca1__z"]


def test_soma_cleaning(spark):
    rows = [(1, -1, 0, 5, 1), (2, 1, 1, 5, 1), (3, 2, 2, 1, 3), (4, 1, 2, 1, 3), (5, 4, 3, 1, 1), (6, 5, 4, 1, 3)]
    n = cell(spark, rows)
    out = qc.clean_soma(n)
    assert by_id(out, "parent") == {1: -1, 3: 1, 4: 1, 5: 4, 6: 5}
    r = qc.clean_report(n, out).first()
    assert (r.original_soma_count, r.cleaned_soma_count, r.removed_soma_nodes, r.cleanup_action) == (3, 2, 1, "consolidated")


def test_qc(spark):
    n = cell(spark, [(1, -1, 0, 5, 1)] + [(k, 1, k, 1, 3) for k in range(2, 30)])
    d = qc.diagnose(n, ["cell_id", "cell_type"]).first()
    assert d.verdict == "bad" and {"dendrite_only", "partial"} <= set(d.flags)
    base = dict.fromkeys(qc.MEDIAN_FEATURES, 10.0)
    cols = ", ".join(f"{k} double" for k in base)
    cells = [(f"c{k}", "pyramidal", 100, [1, 2, 3, 4], *base.values()) for k in range(5)] + [("bad", "pyramidal", 100, [3], 1.0, *[1.0] * 7), ("none", "pyramidal", 0, [], *[0.0] * 8)]
    got = {r.cell_id: r for r in qc.score(spark.createDataFrame(cells, f"cell_id string, cell_type string, n_nodes int, types array<int>, {cols}")).collect()}
    assert got["c0"].status == "keep" and got["c0"].qc_score == 0 and got["bad"].status == "drop" and [r.code for r in got["none"].reasons] == ["parse_error"]
    assert "compact_single_tree_without_axon" in {r.code for r in got["bad"].reasons}


def test_statistics(spark):
    rows = [("a", f"f{k}", float(k)) for k in range(1, 11)] + [("b", f"f{k}", float(k) + (1 if k % 5 else -2)) for k in range(1, 11)]
    w = stats.wilcoxon(stats.method_pairs(spark.createDataFrame(rows, "method string, file_name string, f1 double"))).first()
    assert (w.n_pairs, w.wins, w.losses, w.w_plus, w.w_minus) == (10, 2, 8, 19.0, 36.0) and 0 < w.p_value < 1
    same = [("a", "f", 1.0), ("b", "f", 1.0)]
    assert stats.wilcoxon(stats.method_pairs(spark.createDataFrame(same, "method string, file_name string, f1 double"))).first()["p_value"] == 1.0
    s = spark.createDataFrame([("m", f"f{k}", float(k % 7)) for k in range(200)], "method string, file_name string, f1 double")
    got = {r.statistic: r for r in stats.bootstrap(s, ["method"], resamples=300).collect()}
    r = got["mean"]
    assert set(got) == {"mean", "median", "p10"} and got["median"].value == 3.0 and got["p10"].low <= got["p10"].value <= got["p10"].high
    assert r.low < r.value < r.high and abs((r.high - r.low) - 2 * 1.96 * 2 / math.sqrt(200)) < 0.2
    assert stats.bootstrap(s.repartition(5), ["method"], resamples=300).filter("statistic = 'mean'").first()["low"] == pytest.approx(r.low)
    for z in (0.0, 0.3, -1.0, 1.96, 2.8, 2.9, 4.0, 8.0):
        assert spark.range(1).select(stats.two_sided(F.lit(z))).first()[0] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-9)
    assert stats.grid(spark, [1, 2], [3], [0.0, 0.5]).count() == 4


def test_models(spark):
    rows = spark.createDataFrame([(float(k % 10), float(k % 3), float(k % 10 > 4), k // 10 % 2) for k in range(200)], "a double, b double, label double, fold int")
    with pytest.raises(ValueError):
        ml.assemble(rows, ["nope"])
    got = ml.predict_cell_type(ml.train_cell_type(rows, ["a", "b"], trees=5), rows, ["a", "b"])
    assert got.filter("prediction != label").count() == 0
    assert all(r.accuracy == 1.0 for r in ml.cross_validated(rows, ["a", "b"], k=2).collect())
    model, fits = ml.calibrated(rows, ["a", "b"], 2, k=2, trees=5)
    assert ml.predict_calibrated(model, fits, rows, ["a", "b"]).filter("prediction != label").count() == 0
    assert ml.predict_labels(ml.train_binary(rows, ["a", "b"], trees=5), rows, ["a", "b"]).filter("prediction != label").count() == 0
    drops = {r.feature: r["drop"] for r in ml.importance(ml.train_labels(rows, ["a", "b"], trees=5), rows, ["a", "b"], repeats=1).collect()}
    assert drops["a"] > drops["b"]


def test_saved_models_and_the_way_without(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{k}", float(k % 10), float(k % 10 > 4), k // 10 % 2) for k in range(100)], "cell_id string, a double, label double, fold int")
    assert ml.load_models(spark, str(tmp_path / "none")) is None
    ml.save_models(ml.train_cell_type(rows, ["a"], trees=5), str(tmp_path / "model"))
    got = ml.detect_cell_type(rows, ["a"], ml.load_models(spark, str(tmp_path / "model")))
    assert got.filter("(guess = 'pyramidal') != (label = 1)").count() == 0
    cells = spark.createDataFrame([("a", 4, 0.3, 300.0, 0.1, 6000, 2000, 300.0)], "cell_id string, n_primary_subtrees int, z_asymmetry double, z_span double, branch_point_ratio double, n_nodes int, max_subtree_size int, subtree_size_std double")
    assert ml.detect_cell_type(cells, ["a"], None).first()["guess"] == "pyramidal"
    assert ml.predict_labels(ml.train_perceptron(rows, ["a"], 2, hidden=(4,)), rows, ["a"]).filter("prediction = label").count() > 80
    got = ml.sweep(rows, ["a"], [{"trees": 2, "depth": 2}], k=2).collect()
    assert [(r.fold, r.accuracy) for r in sorted(got, key=lambda r: r.fold)] == [(0, 1.0), (1, 1.0)]


def test_pruned_copy(spark, tmp_path):
    n = cell(spark, [(1, -1, 0, 5, 1), (2, 1, 1, 1, 3)]).withColumn("file_name", F.lit("a.swc"))
    keep = n.withColumn("file_name", F.lit("b.swc"))
    manifest = spark.createDataFrame([("pyramidal", "a.swc"), ("pyramidal", "b.swc"), ("interneuron", "a.swc")], "cell_type string, file_name string")
    dropped = manifest.filter("cell_type = 'pyramidal' AND file_name = 'a.swc'")
    qc.write_pruned(n.unionByName(keep), manifest, dropped, str(tmp_path / "out"))
    assert {r.file_name for r in spark.read.parquet(str(tmp_path / "out" / "nodes")).collect()} == {"b.swc"}
    assert sorted((r.cell_type, r.file_name) for r in tables.read_manifest(spark, str(tmp_path / "out" / "manifest")).collect()) == [("interneuron", "a.swc"), ("pyramidal", "b.swc")]
    with pytest.raises(Exception, match="(?i)exist"):
        qc.write_pruned(n, manifest, dropped, str(tmp_path / "out"))


def test_caterpillar_orders(spark):
    """A long spine with a tip at each node has order 2 from its last fork up, in two rounds."""
    rows = [(1, -1, 0, 5, 1)] + [(k, k - 1, k, 1, 3) for k in range(2, 40)] + [(100 + k, k, k, 1, 3) for k in range(2, 39)]
    got = by_id(forest.strahler(forest.topology(cell(spark, rows))), "strahler")
    assert all(got[k] == 2 for k in range(1, 39)) and got[39] == 1 and all(got[100 + k] == 1 for k in range(2, 39))


def test_neighbour_mean_and_layer(spark):
    import numpy as np

    v = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 2, [3.0, 4.0]), (1, 3, [5.0, 6.0]), (1, 4, [0.0, 0.0])], "g int, id int, x array<double>")
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 1, 3), (1, 3, 1)], "g int, a int, b int")
    got = {r.id: r["mean"] for r in ml.neighbour_mean(v, e, ["g"]).collect()}
    assert got == {1: [4.0, 5.0], 2: [1.0, 2.0], 3: [1.0, 2.0], 4: [0.0, 0.0]}
    out = {r.id: r.x for r in ml.sage_layer(v, e, ["g"], np.eye(2), -np.eye(2), np.zeros(2)).collect()}
    assert out == {1: [0.0, 0.0], 2: [2.0, 2.0], 3: [4.0, 4.0], 4: [0.0, 0.0]}


@pytest.mark.parametrize("verb", ["diagnose", "filter", "clean-soma", "split"])
def test_verbs(spark, tmp_path, verb):
    from neuritic import __main__ as cli

    for kind in ("pyramidal", "interneuron"):
        (tmp_path / "in" / kind).mkdir(parents=True)
        for k in range(3):
            lines = ["1 1 0 0 0 5 -1", *(f"{i} {2 + i % 3} {i} {i * k} {i % 4} 0.5 {i - 1}" for i in range(2, 30))]
            (tmp_path / "in" / kind / f"{kind}{k}.swc").write_text("\n".join(lines))
    cli.run(spark, verb, str(tmp_path / "in"), str(tmp_path / "out"))
    assert tables.read_manifest(spark, str(tmp_path / "out")).count() == 6


def test_subtrees_of_other_roots(spark):
    """Without children of the proxy the trees of the other roots count as primary subtrees."""
    rows = [(1, -1, 0, 9, 1), (2, -1, 5, 1, 3), (3, 2, 6, 1, 3), (4, 3, 8, 1, 3), (5, 99, 1, 1, 2)]
    t = forest.topology(cell(spark, rows))
    assert by_id(t, "root") == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5} and features.cell_counts(t).first()["n_primary_subtrees"] == 2
    s = features.cell_subtrees(t).first()
    assert (s["max_subtree_size"], s["min_subtree_size"], s["max_subtree_path"]) == (3, 1, 3.0)
    t = forest.topology(cell(spark, [*rows, (6, 1, 2, 1, 3)]))
    s = features.cell_subtrees(t).first()
    assert (s["max_subtree_size"], s["min_subtree_size"]) == (1, 1) and features.cell_counts(t).first()["n_primary_subtrees"] == 1


def test_lines_are_split_once(spark):
    """A line's tokens are taken by seven columns and a filter; each used to split the line again."""
    line = F.concat(F.lit(" 1.0 3 0 1e1 2.5 2 "), F.col("id"))
    got = swc.parse_lines(spark.range(3).select(F.lit("c").alias("cell_id"), F.col("id").alias("seq"), line.alias("line")))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted(tuple(r) for r in got.select("id", "type", "y", "z", "parent").collect()) == [(1, 3, 10.0, 2.5, k) for k in range(3)]
