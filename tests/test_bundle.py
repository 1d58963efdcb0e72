"""Saved models: the whole way from training to labelling new files, twice."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from neuritic import __main__ as cli
from neuritic import session
from neuritic.operators import forest, ml, rules
from neuritic.plans import bundle, labelling
from neuritic.session import checkpointed
from neuritic.sources import swc
from neuritic.streaming import ingest


def write_cells(folder, cells, start=0):
    """Node files of both types: pyramidal cells have a long thick subtree upwards (4), all have a thin one (2) and others (3)."""
    rng = random.Random(start)
    for k in range(start, start + cells):
        kind = "pyramidal" if k % 2 else "interneuron"
        (folder / kind).mkdir(parents=True, exist_ok=True)
        lines, at = ["# made up", "1 1 0 0 0 6 -1"], 2
        for label, steps, dz, radius in ((2, 22, -1, 0.2), (3, 14, 0.3, 0.7), (3, 12, -0.4, 0.6), (4 if kind == "pyramidal" else 3, 26 if kind == "pyramidal" else 10, 6.0 if kind == "pyramidal" else 0.2, 1.5)):
            parent, x, z = 1, 0.0, 0.0
            for step in range(steps):
                x, z = x + rng.uniform(1, 3), z + dz * rng.uniform(0.8, 1.2)
                lines.append(f"{at} {label} {x:.3f} {rng.uniform(-2, 2):.3f} {z:.3f} {radius} {parent}")
                parent = at if step % 5 else parent
                at += 1
        (folder / kind / f"cell{k}.swc").write_text("\n".join(lines))


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("cells")
    write_cells(base / "train", 16)
    topo = checkpointed(forest.topology(swc.read_swc(spark, str(base / "train")).drop("batch")))
    made = labelling.train_bundle(topo, trees=3, graph_epochs=3, hidden=8)
    assert bundle.load(spark, str(base / "models")) is None
    assert bundle.save(spark, made, str(base / "models")) == 1
    return base, made


def rows(df, label="label"):
    return {(r.cell_id.rpartition("/")[2], r.id): (r.used_type, r[label], r.s2, r.conf) for r in df.collect()}


def test_label_a_folder_twice(spark, trained):
    """A session of its own labels a folder with the saved models; again, it labels nothing; new files only are labelled then."""
    base, made = trained
    new, table = base / "new", str(base / "labels")
    write_cells(new, 4, 100)
    want = rows(labelling.label_nodes(checkpointed(forest.topology(swc.read_swc(spark, str(new)).drop("batch"))), made), "s23")
    other = spark.newSession()
    loaded = bundle.load(other, str(base / "models"))
    assert loaded.names == made.names and loaded.graph.names == made.graph.names and set(loaded.branches) == set(made.branches)
    for k in range(2):
        ingest.label_stream(other, str(new), loaded, table).awaitTermination()
        assert rows(ingest.labels(other, table)) == want
        assert other.read.parquet(f"{table}/files").count() == 4
    write_cells(new, 2, 200)
    cli.run(spark, "label", str(new), table, str(base / "models"))
    got = rows(ingest.labels(spark, table))
    assert {k: v for k, v in got.items() if k in want} == want and len({c for c, _ in got}) == 6
    assert spark.read.parquet(f"{table}/files").groupBy("batch").count().count() == 2
    truth = {(r.cell_id.rpartition("/")[2], r.id): r.type for r in swc.read_swc(spark, str(new)).collect()}
    assert sum(got[k][1] == truth[k] for k in got) > 0.9 * len(got)


def test_a_batch_that_runs_again_and_lost_progress(spark, tmp_path, monkeypatch):
    """Running a batch again, or the stream anew without its progress, gives the same table."""
    monkeypatch.setattr(labelling, "label_nodes", lambda topo, made: topo.select("cell_id", "id", F.lit("t").alias("used_type"), (F.col("id") % 3).alias("s23"), F.lit(2).alias("s2"), F.lit(0.5).alias("conf")))
    write_cells(tmp_path / "in", 3, 300)
    nodes = swc.read_swc(spark, str(tmp_path / "in")).drop("batch")
    table = str(tmp_path / "out")
    assert ingest.labels(spark, table) is None
    assert ingest.label_batch(nodes, None, table, 0) == 3
    once = rows(ingest.labels(spark, table))
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path / "shared"))
    assert ingest.label_batch(nodes, None, table, 0) == 3 and os.listdir(tmp_path / "shared") == []  # nothing of a batch stays behind
    assert len(once) == nodes.count()
    assert ingest.label_batch(nodes, None, table, 0) == 3 and rows(ingest.labels(spark, table)) == once
    assert ingest.label_batch(nodes, None, table, 1) == 0 and rows(ingest.labels(spark, table)) == once
    assert ingest.label_batch(nodes.limit(0), None, table, 2) == 0


def test_only_whole_bundles_that_fit_are_loaded(spark, trained, tmp_path):
    base, made = trained
    path = str(tmp_path / "models")
    assert bundle.save(spark, made, path) == 1 and bundle.save(spark, made, path) == 2 and bundle.versions(spark, path) == [1, 2]
    (tmp_path / "models" / "v=3" / "owners").mkdir(parents=True)  # a version that broke off
    assert bundle.versions(spark, path) == [1, 2] and bundle.load(spark, path, 3) is None and bundle.load(spark, path, 1).names == made.names

    def described(**change):
        said = json.loads(spark.read.text(f"{path}/v=2/description", wholetext=True).first()[0]) | change
        spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/v=4/description")
        for part in ("cell_type", "owners", "branches"):
            if not (tmp_path / "models" / "v=4" / part).exists():
                import shutil

                shutil.copytree(tmp_path / "models" / "v=2" / part, tmp_path / "models" / "v=4" / part)

    described()
    assert bundle.load(spark, path).names == made.names
    names = made.names
    for change in ({"format": 9}, {"labels": [3, 2, 4]}, {"cell_classes": ["pyramidal", "interneuron"]}, {"names": names | {"cell": names["cell"][1:]}}, {"names": names | {"branch": names["branch"][1:]}}, {"names": names | {"subtree": [*names["subtree"], "type"]}}):
        described(**change)
        with pytest.raises(ValueError):
            bundle.load(spark, path)


def test_features_of_new_cells_must_be_those_of_training(spark, trained, tmp_path):
    base, made = trained
    write_cells(tmp_path / "in", 2, 400)
    topo = checkpointed(forest.topology(swc.read_swc(spark, str(tmp_path / "in")).drop("batch")))
    stale = bundle.Bundle(made.names | {"branch": made.names["branch"][::-1]}, made.cell_type, made.owners, made.branches)
    with pytest.raises(ValueError, match="features"):
        labelling.label_nodes(topo, stale)
    # no models at all: rules tell the type, branches are basal
    got = labelling.label_nodes(topo, None).collect()
    assert {r.s23 for r in got} <= {1, 2, 3} and {r.s23 for r in got if r.conf == 0.5} == {3} and len(got) == topo.count()
    # a type's default label comes before another type's model
    assert labelling.pick_model({"pyramidal": "p"}, "purkinje", {"purkinje": 3}) is None
    assert labelling.pick_model({"pyramidal": "p"}, "interneuron", {"purkinje": 3}) == "p" and labelling.pick_model({}, "pyramidal") is None


def test_branches_learn_from_owners_out_of_fold(spark, trained, monkeypatch):
    """With folds no branch learns from an owner told by a model that saw its cell."""
    base, _ = trained
    topo = checkpointed(forest.topology(swc.read_swc(spark, str(base / "train")).drop("batch")))
    fitted, asked, train, told = [], [], labelling.train_owners, labelling.owners_of

    def cells(df):
        return {r.cell_id for r in df.select("cell_id").distinct().collect()}

    def fit(subtrees, names, trees):
        out = train(subtrees, names, trees)
        fitted.append((out, cells(subtrees)))
        return out

    def tell(subtrees, models, names):
        asked.append((cells(subtrees), next(seen for m, seen in fitted if m is models)))
        return told(subtrees, models, names)

    monkeypatch.setattr(labelling, "train_owners", fit)
    monkeypatch.setattr(labelling, "owners_of", tell)
    calibrated = []

    def on_folds(rows, names, classes, k, **settings):
        calibrated.append((k, classes, rows.groupBy("cell_id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count(), rows.select("fold").distinct().count()))
        return real(rows, names, classes, k=k, **settings)

    real = ml.calibration
    monkeypatch.setattr(ml, "calibration", on_folds)
    made = labelling.train_bundle(topo, trees=1, folds=3)
    assert calibrated == [(3, 3, 0, 3), (3, 2, 0, 3)]  # folds of whole cells
    assert {k: len(v) for k, v in made.calibrations.items()} == {"pyramidal": 3, "interneuron": 2}
    path = str(base / "calibrated")
    bundle.save(spark, made, path)
    assert {k: [tuple(map(list, f)) for f in v] for k, v in bundle.load(spark, path).calibrations.items()} == {k: [tuple(map(list, f)) for f in v] for k, v in made.calibrations.items()}
    assert len(asked) == 3 and all(not of & seen for of, seen in asked) and set().union(*(of for of, _ in asked)) == cells(topo)
    assert set(made.branches) == set(rules.TYPE_ORDER)


def test_train_verb(spark, trained, tmp_path):
    base, made = trained
    write_cells(tmp_path / "few", 4, 500)
    cli.run(spark, "train", str(tmp_path / "few"), str(tmp_path / "models"), trees=1)
    assert bundle.load(spark, str(tmp_path / "models")).names == made.names


def test_the_graph_decides_between_basal_and_apical(spark):
    decoded = spark.createDataFrame([("a", "pyramidal", 1, 3, 0.6), ("a", "pyramidal", 2, 4, 0.6), ("a", "pyramidal", 3, 2, 0.6), ("a", "pyramidal", 4, 3, 0.6), ("b", "pyramidal", 1, 3, 0.6)], "cell_id string, cell_type string, branch long, pred int, conf double")
    said = spark.createDataFrame([("a", 1, [0.2, 0.8]), ("a", 2, [0.1, 0.9]), ("a", 3, [0.1, 0.9]), ("b", 1, [0.1, 0.9])], "cell_id string, id long, probability array<double>")
    got = {(r.cell_id, r.branch): (r.pred, r.conf) for r in labelling.by_graph(decoded, said).collect()}
    assert got == {("a", 1): (4, 0.8), ("a", 2): (4, 0.6), ("a", 3): (2, 0.6), ("a", 4): (3, 0.6), ("b", 1): (3, 0.6)}


def test_calibration_moves_along_the_fit(spark):
    from pyspark.ml.regression import IsotonicRegression

    rng = random.Random(8)
    p = [rng.random() for _ in range(300)]
    rows = spark.createDataFrame([(v, float(rng.random() < v * v)) for v in p], "p double, y double")
    fit = IsotonicRegression(featuresCol="p", labelCol="y").fit(rows)
    points = ([float(v) for v in fit.boundaries], [float(v) for v in fit.predictions])
    want = [r.prediction for r in fit.transform(rows).collect()]
    flat = ([0.0], [0.0])
    got = [r.probability for r in ml.calibrate(rows.select(F.array("p", 1 - F.col("p")).alias("probability")), [points, flat]).collect()]
    assert all(abs(g[0] - (1.0 if w > 0 else 0.5)) < 1e-12 for g, w in zip(got, want))
    whole = ([0.0, 1.0], [0.0, 1.0])
    got = [r.probability for r in ml.calibrate(rows.select(F.array("p", F.lit(0.25)).alias("probability")), [points, whole]).collect()]
    assert all(abs(g[0] - w / (w + 0.25)) < 1e-9 and abs(sum(g) - 1) < 1e-12 for g, w in zip(got, want))
