"""Models with Spark ML: cell types, owners of primary subtrees, branches; and the neighbour means of a graph network."""

from __future__ import annotations

import hashlib
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed, shared_dir
from . import metrics, rules
from .trees import Trees, train_random
from .trees import train_boosted as train_boosted_trees


def assemble(rows: DataFrame, features: list[str]) -> DataFrame:
    """Adds `features`; a name that isn't there is an error, what isn't finite counts as 0."""
    missing = [f for f in features if f not in rows.columns]
    if missing:
        raise ValueError(f"unknown features: {missing}")
    values = [F.when(F.isnan(F.col(f).cast("double")) | F.col(f).isNull(), 0.0).otherwise(F.col(f).cast("double")) for f in features]
    return rows.withColumn("features", array_to_vector(F.array(*values)))


def train_cell_type(rows: DataFrame, features: list[str], label: str = "label", trees: int = 100) -> list:
    """A forest and extremely randomized trees with balanced weights, and boosted trees of as many rounds, for labels 0 and 1;
    predict_cell_type averages their probabilities."""
    x = checkpointed(metrics.balanced_weights(rows.withColumn("w", F.lit(1.0)), label))
    return [train_labels(x, features, label, "balanced", trees), train_random(x, features, label, trees=trees, weight="balanced"), train_boosted_trees(x, features, label, rounds=trees, depth=8)]


def train_owner(rows: DataFrame, features: list[str], classes: int, label: str = "label", weight: str | None = None, trees: int = 100) -> list:
    """A forest and boosted trees of as many rounds; predict_vote averages their probabilities."""
    return [train_labels(rows, features, label, weight, trees), train_boosted_trees(rows, features, label, classes, rounds=trees, rate=0.08, least=3, weight=weight)]


def predict_vote(models: list, rows: DataFrame, features: list[str], classes: int) -> DataFrame:
    """Adds probability, the mean of the models' for each class, and prediction."""
    out = rows
    for k, m in enumerate(models):
        out = (m.predict(out) if isinstance(m, Trees) else predict_labels(m, out, features)).withColumnRenamed("probability", f"_p{k}").drop("prediction")
    mean = [sum(F.coalesce(F.get(f"_p{k}", F.lit(c)), F.lit(0.0)) for k in range(len(models))) / len(models) for c in range(classes)]
    out = out.withColumn("probability", F.array(*mean)).drop(*(f"_p{k}" for k in range(len(models))))
    return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


def predict_cell_type(models: list, rows: DataFrame, features: list[str]) -> DataFrame:
    """Adds p1, the mean probability of label 1, and prediction."""
    out = predict_vote(models, rows, features, 2).withColumn("p1", F.col("probability")[1]).drop("probability")
    return out.withColumn("prediction", (F.col("p1") > 0.5).cast("int"))


def save_models(models: list, path: str) -> None:
    """Writes the models of a vote below a path, in place of what is there."""
    spark = SparkSession.active()
    for k, m in enumerate(models):
        if isinstance(m, Trees):
            m.save(spark, f"{path}/{k}")
        else:
            m.write().overwrite().save(f"{path}/{k}")


def load_models(spark: SparkSession, path: str) -> list | None:
    """The models that save_models wrote; None if there are none at this path."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm

    def there(part: str) -> bool:
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
        return where.getFileSystem(conf).exists(where)

    out: list = []
    while there(f"{len(out)}/metadata") or there(f"{len(out)}/description"):
        of = f"{path}/{len(out)}"
        out.append(Trees.load(spark, of) if there(f"{len(out)}/description") else RandomForestClassificationModel.load(of))
    return out or None


def detect_cell_type(cells: DataFrame, features: list[str], models: list | None) -> DataFrame:
    """cells with guess and p_pyramidal: by the models, or by rules if there are none."""
    if models is None:
        return rules.guess_cell_type(cells)
    got = predict_cell_type(models, cells, features)
    return got.withColumn("p_pyramidal", F.col("p1")).withColumn("p_interneuron", 1 - F.col("p1")).withColumn("guess", F.when(F.col("prediction") == 1, "pyramidal").otherwise("interneuron")).drop("p1", "prediction")


def train_perceptron(rows: DataFrame, features: list[str], classes: int, label: str = "label", hidden: tuple = (64, 32)):
    """A multilayer perceptron on scaled features (Spark's has sigmoid layers)."""
    x = assemble(rows, features)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    return Pipeline(stages=[scaler, MultilayerPerceptronClassifier(featuresCol="scaled", labelCol=label, layers=[len(features), *hidden, classes], maxIter=60, seed=42)]).fit(x)


def setting_key(setting: dict) -> str:
    """What names a setting, whatever the order of its parts."""
    return hashlib.sha256(json.dumps(setting, sort_keys=True).encode()).hexdigest()[:16]


def sweep(rows: DataFrame, features: list[str], grid: list[dict], label: str = "label", k: int = 5, path: str | None = None, side_by_side: int = 4, fit=None) -> DataFrame:
    """The settings' values, fold, n, accuracy for each setting of a grid and each fold left out. rows: fold and label.

    path: a folder that results are added to, each under its setting's key and fold as soon as it is there; what is there
    already isn't computed again, so a sweep that broke off goes on where it was. fit: from rows, features, label and setting to a model for
    predict_labels; by default a forest of so many trees and levels. side_by_side: fits that run at once.
    """
    spark = rows.sparkSession
    path = path or f"{shared_dir(spark)}/sweep-{uuid.uuid4().hex}"
    fit = fit or (lambda learn, setting: RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=setting["trees"], maxDepth=setting["depth"], seed=42).fit(assemble(learn, features)))
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/setting=*/fold=*/_SUCCESS")
    found = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(there) or []
    done = {f.getPath().getParent().toString().split("/setting=")[1] for f in found}

    def one(job: tuple[dict, int]) -> None:
        setting, fold = job
        got = predict_labels(fit(rows.filter(F.col("fold") != fold), setting), rows.filter(F.col("fold") == fold), features)
        said = got.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"))
        said.coalesce(1).write.mode("overwrite").parquet(f"{path}/setting={setting_key(setting)}/fold={fold}")

    jobs = [(s, f) for s in grid for f in range(k) if f"{setting_key(s)}/fold={f}" not in done]
    with ThreadPoolExecutor(side_by_side) as pool:
        list(pool.map(one, jobs))
    parts = [spark.read.schema("n long, accuracy double").parquet(f"{path}/setting={setting_key(s)}/fold={f}").select(*(F.lit(v).alias(n) for n, v in s.items()), F.lit(f).alias("fold"), "n", "accuracy") for s in grid for f in range(k)]
    return reduce(DataFrame.unionByName, parts)


def train_labels(rows: DataFrame, features: list[str], label: str = "label", weight: str | None = None, trees: int = 100):
    """A forest for several labels (from 0), with weights if there are any."""
    extra = {"weightCol": weight} if weight else {}
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=10, minInstancesPerNode=2, seed=42, **extra).fit(assemble(rows, features))


def train_boosted(rows: DataFrame, features: list[str], label: str = "label"):
    """Boosted trees for several labels, one against the rest."""
    return OneVsRest(classifier=GBTClassifier(featuresCol="features", maxIter=10, seed=42), labelCol=label).fit(assemble(rows, features))


def train_linear(rows: DataFrame, features: list[str], label: str = "label"):
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), LogisticRegression(labelCol=label)]).fit(rows)


def predict_labels(model, rows: DataFrame, features: list[str]) -> DataFrame:
    """Adds probability (an array) and prediction."""
    return model.transform(assemble(rows, features)).withColumn("probability", vector_to_array("probability")).drop("features", "rawPrediction")


def cross_validated(rows: DataFrame, features: list[str], label: str = "label", k: int = 5) -> DataFrame:
    """fold, n, accuracy; rows: fold and label."""
    parts = []
    for fold in range(k):
        got = predict_labels(train_labels(rows.filter(F.col("fold") != fold), features, label), rows.filter(F.col("fold") == fold), features)
        parts.append(got.agg(F.lit(fold).alias("fold"), F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def importance(model, rows: DataFrame, features: list[str], label: str = "label", repeats: int = 3) -> DataFrame:
    """feature, drop: how much accuracy falls, on average, when a feature's values are dealt to other rows.

    Rows exchange values along a hash order within salted buckets, so no global sort is needed.
    """
    # every row stands once as it is and once for each feature and repeat with that feature's value of another row: all are
    # scored in one pass. The other row is the next one along a hash order of row and repeat.
    base = checkpointed(rows.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).alias("_y"), F.monotonically_increasing_id().alias("_n")))
    buckets = max(1, base.count() // 4096)
    versions = [base.withColumn("_f", F.lit("")).withColumn("_r", F.lit(0))]
    for r in range(repeats):
        w = Window.partitionBy(F.pmod(F.xxhash64(F.lit(r), "_n"), F.lit(buckets))).orderBy(F.xxhash64(F.lit(r + 1), "_n"))
        other = base.withColumn("_o", F.coalesce(F.lead(F.struct(*features)).over(w), F.first(F.struct(*features)).over(w)))
        each = other.withColumn("_f", F.explode(F.array(*map(F.lit, features)))).withColumn("_r", F.lit(r))
        versions.append(each.select(*(F.when(F.col("_f") == f, F.col(f"_o.{f}")).otherwise(F.col(f)).alias(f) for f in features), "_y", "_n", "_f", "_r"))
    got = predict_labels(model, reduce(DataFrame.unionByName, versions), features)
    acc = got.groupBy("_f", "_r").agg(F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("a"))
    whole = acc.filter("_f = ''").select(F.col("a").alias("_base"))
    drops = acc.filter("_f != ''").crossJoin(F.broadcast(whole)).withColumn("d", F.col("_base") - F.col("a"))  # whole is one row
    return drops.groupBy(F.col("_f").alias("feature")).agg(F.avg("d").alias("drop"), F.stddev_pop("d").alias("std"))


def scaler_stats(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, mean, std of the population; deviations below 1e-8 count as 1."""
    s = rows.agg(*(F.struct(F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")).alias(f) for f in features))
    long = s.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in features))).alias("r"))
    return long.select("r.feature", "r.v.mean", F.when(F.col("r.v.std") < 1e-8, 1.0).otherwise(F.col("r.v.std")).alias("std"))


def neighbour_mean(vertices: DataFrame, edges: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """keys, id, value: element by element the mean of the neighbours' arrays, zeros without neighbours. edges: a, b in both directions."""
    v = vertices.select(*keys, F.col("id").alias("b"), F.posexplode(value).alias("i", "e"))
    got = edges.join(v, [*keys, "b"]).groupBy(*keys, F.col("a").alias("id"), "i").agg(F.avg("e").alias("m"))
    arr = got.groupBy(*keys, "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("_m"))
    return vertices.join(arr, [*keys, "id"], "left").select(*keys, "id", F.coalesce("_m", F.transform(value, lambda e: F.lit(0.0).cast("double"))).alias("mean"))


def sage_layer(vertices: DataFrame, edges: DataFrame, keys: list[str], own: np.ndarray, other: np.ndarray, bias: np.ndarray, relu: bool = True) -> DataFrame:
    """One layer of a mean-aggregating graph network; weights are small matrices that go with the code."""
    j = vertices.join(neighbour_mean(vertices, edges, keys), [*keys, "id"])

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series, m: pd.Series) -> pd.Series:
        out = np.stack(x.to_list()) @ own + np.stack(m.to_list()) @ other + bias
        return pd.Series(list(np.maximum(out, 0) if relu else out))

    return j.select(*keys, "id", apply("x", "mean").alias("x"))


def train_binary(rows: DataFrame, features: list[str], label: str = "label", dendrite_weight: float = 2.0, trees: int = 100):
    """A forest for axon (1) against dendrites (0), which weigh more."""
    w = rows.withColumn("_w", F.when(F.col(label) == 0, dendrite_weight).otherwise(1.0))
    return train_labels(w, features, label, "_w", trees)


def calibration(rows: DataFrame, features: list[str], classes: int, label: str = "label", k: int = 3, trees: int = 100, weight: str | None = None) -> list[tuple[list[float], list[float]]]:
    """For each class the points of an isotonic fit of its probability, on predictions for folds left out; see calibrate(). rows: fold and label."""
    from pyspark.ml.regression import IsotonicRegression

    own = [weight] if weight else []
    out = [predict_labels(train_labels(rows.filter(F.col("fold") != i), features, label, weight, trees), rows.filter(F.col("fold") == i), features).select(label, "probability", *own) for i in range(k)]
    held = checkpointed(reduce(DataFrame.unionByName, out))
    fits = []
    for c in range(classes):
        of = held.select(F.coalesce(F.get("probability", F.lit(c)), F.lit(0.0)).alias("p"), (F.col(label) == c).cast("double").alias("y"), *own)
        fit = IsotonicRegression(featuresCol="p", labelCol="y", **({"weightCol": weight} if weight else {})).fit(of)
        fits.append(([float(v) for v in fit.boundaries], [float(v) for v in fit.predictions]))
    return fits


def calibrate(rows: DataFrame, fits: list[tuple[list[float], list[float]]]) -> DataFrame:
    """Rows with probability, an array, moved along the points of each class's fit, linearly between them, so that it sums to 1."""

    @F.pandas_udf("array<double>")
    def moved(p: pd.Series) -> pd.Series:
        x = np.zeros((len(p), len(fits)))
        for i, v in enumerate(p):
            x[i, : min(len(v), len(fits))] = v[: len(fits)]
        y = np.stack([np.interp(x[:, c], *points) for c, points in enumerate(fits)], axis=1)
        total = y.sum(axis=1, keepdims=True)
        return pd.Series(list(np.where(total > 0, y / np.where(total > 0, total, 1), 1 / len(fits))))

    return rows.withColumn("probability", moved("probability"))


def calibrated(rows: DataFrame, features: list[str], classes: int, label: str = "label", k: int = 3, trees: int = 100):
    """A forest on all rows and the points of calibration(); predict_calibrated applies both. rows: fold and label."""
    return train_labels(rows, features, label, trees=trees), calibration(rows, features, classes, label, k, trees)


def predict_calibrated(model, fits: list, rows: DataFrame, features: list[str]) -> DataFrame:
    """Adds probability (calibrated, summing to 1) and prediction."""
    out = calibrate(predict_labels(model, rows, features), fits)
    return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))
