"""A thin entry for spark-submit: python -m neuritic VERB INPUT OUTPUT, over a folder of node files.

train INPUT BUNDLE saves models; label INPUT OUTPUT --models BUNDLE labels the files that aren't labelled yet, by rules where there
are no models.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import features, forest, prep, qc
from .plans import bundle, labelling
from .session import checkpointed, temporary
from .sources import swc, tables
from .streaming import ingest


def _kinds(nodes: DataFrame) -> DataFrame:
    return nodes.select("cell_id", "cell_type").distinct()


def diagnose(nodes: DataFrame) -> DataFrame:
    d = qc.diagnose(nodes, ["cell_id", "cell_type"])
    return d.withColumn("flags", F.array_join("flags", "; "))


def cell_features(nodes: DataFrame) -> DataFrame:
    return features.cell_features(checkpointed(forest.topology(nodes))).join(_kinds(nodes), "cell_id")


def quality(nodes: DataFrame) -> DataFrame:
    cells = cell_features(nodes).join(swc.type_sets(nodes), "cell_id")
    s = qc.score(cells)
    return s.select("cell_id", "cell_type", "type_set", "status", "qc_score", F.array_join(F.transform("reasons", lambda r: r["code"]), ";").alias("reason_codes"))


def clean(nodes: DataFrame) -> DataFrame:
    return qc.clean_report(nodes, qc.clean_soma(nodes))


def split(nodes: DataFrame) -> DataFrame:
    return prep.split(_kinds(nodes).withColumn("file_name", F.element_at(F.split("cell_id", "/"), -1)))


def evaluate(nodes: DataFrame) -> DataFrame:
    return labelling.evaluate(labelling.label_cells(nodes))


VERBS = {"diagnose": diagnose, "features": cell_features, "filter": quality, "clean-soma": clean, "split": split, "evaluate": evaluate}


def train(spark: SparkSession, source: str, target: str, models: str | None = None, trees: int = 100) -> None:
    """Fits all models on the files below source and saves them as the next version of the bundle target."""
    with temporary(spark):
        topo = checkpointed(forest.topology(swc.read_swc(spark, source).drop("batch")))
        bundle.save(spark, labelling.train_bundle(topo, trees), target)


def label_files(spark: SparkSession, source: str, target: str, models: str | None = None, trees: int = 100) -> None:
    """Labels the files below source that target doesn't have yet."""
    ingest.label_stream(spark, source, bundle.load(spark, models) if models else None, target).awaitTermination()


#: Verbs that don't end in one table.
WORKS = {"train": train, "label": label_files}


def run(spark: SparkSession, verb: str, source: str, target: str, models: str | None = None, trees: int = 100) -> None:
    """Reads the node files below source and writes the verb's table as CSV, or does what the verb does."""
    if verb in WORKS:
        WORKS[verb](spark, source, target, models, trees)
    else:
        tables.write_table(VERBS[verb](swc.read_swc(spark, source).drop("batch")), target)


def main() -> None:
    parser = argparse.ArgumentParser(prog="neuritic", description=__doc__)
    parser.add_argument("verb", choices=sorted({*VERBS, *WORKS}))
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--models", help="a bundle that train has saved")
    parser.add_argument("--trees", type=int, default=100, help="trees of each forest, and rounds of boosting, that train fits")
    args = parser.parse_args()
    run(SparkSession.builder.appName("neuritic").getOrCreate(), args.verb, args.source, args.target, args.models, args.trees)


if __name__ == "__main__":
    main()
