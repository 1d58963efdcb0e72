"""Plug-in predictors side by side: each labels the same cells, and a row for each of them and each cell says how well, or what went wrong.

A predictor is a function from a topology without true labels to cell_id, id and pred. Those that are expressions over DataFrames work on cells of any
size; those that look at one cell in Python are made by per_cell(), which hands them large cells in files.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, rules, small
from ..session import checkpointed
from . import labelling
from .bundle import Bundle

Predictor = Callable[[DataFrame], DataFrame]
#: Columns that tell what is to be predicted.
HIDDEN = ("type", "pred", "conf")
#: Rows of a large cell that are handed on at a time.
OUT = 10_000


def per_cell(predict: Callable[[pd.DataFrame], pd.Series], most: int | None = None) -> Predictor:
    """A predictor from a function that gets one cell's nodes in file order and returns their labels, however many they are: those of cells
    of more than small.SMALL nodes come to it as columns mapped from files of the task. Cells at which it fails or returns too few or too many
    labels become a row with an error; so do those of more than `most` nodes, where a caller sets such a bound."""

    def labels(cell: pd.DataFrame) -> tuple[pd.Series | None, str | None]:
        try:
            said = predict(cell)
            said = said.to_numpy() if isinstance(said, pd.Series) else said if isinstance(said, np.ndarray) else list(said)
            if len(said) != len(cell):
                raise ValueError(f"{len(said)} labels for {len(cell)} nodes")
            return pd.Series(said).astype("Int32"), None
        except Exception as e:  # whatever a plug-in raises
            return None, f"{type(e).__name__}: {e}"

    def rows(cell: pd.DataFrame, said: pd.Series | None, error: str | None) -> pd.DataFrame:
        if said is None:
            return pd.DataFrame({"cell_id": cell["cell_id"][:1], "id": pd.Series([None], dtype="Int64"), "pred": pd.Series([None], dtype="Int32"), "error": [error]})
        return pd.DataFrame({"cell_id": cell["cell_id"], "id": cell["id"], "pred": said, "error": pd.Series([None] * len(cell), dtype=object, index=cell.index)})

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("seq", ignore_index=True)
        return rows(cell, *labels(cell))

    def run_large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _mapped_cells(batches):
            said, error = labels(cell)
            schema = pa.schema([("cell_id", pa.array(cell["cell_id"][:1]).type), ("id", pa.int64()), ("pred", pa.int32()), ("error", pa.string())])
            for k in range(0, len(cell) if error is None else 1, OUT):
                part = slice(k, k + OUT)
                yield pa.RecordBatch.from_pandas(rows(cell[part], said if said is None else said[part], error), schema=schema, preserve_index=False)

    def predictor(topo: DataFrame) -> DataFrame:
        schema = f"cell_id {dict(topo.dtypes)['cell_id']}, id long, pred int, error string"
        over = None
        if most is not None:
            sizes = topo.groupBy("cell_id").agg(F.count(F.lit(1)).alias("_size"))
            over = sizes.filter(F.col("_size") > most).select("cell_id", F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("pred"), F.concat(F.lit("too large: "), F.col("_size").cast("string"), F.lit(" nodes")).alias("error"))
            topo = topo.join(sizes.filter(F.col("_size") <= most).select("cell_id"), "cell_id")
        near, far = small.parts(topo)
        parts = [near.groupBy("cell_id").applyInPandas(run, schema)]
        if far is not None:
            parts.append(far.repartition("cell_id").sortWithinPartitions("cell_id", "seq").mapInArrow(run_large, schema))
        return reduce(DataFrame.unionByName, parts if over is None else [*parts, over])

    return predictor


def _mapped_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The cells of a task one after another, from rows sorted by cell, each as a frame whose numbers stay in files; only texts, and what is neither, are held."""
    pieces = (b.slice(at, size) for b in batches if b.num_rows for at, size in _same(b))
    piece = next(pieces, None)
    while piece is not None:
        last = piece["cell_id"][0]
        with tempfile.TemporaryDirectory() as folder:
            with pa.OSFile(f"{folder}/rows", "wb") as file, pa.ipc.new_file(file, piece.schema) as out:
                while piece is not None and piece["cell_id"][0] == last:
                    out.write_batch(piece)
                    piece = next(pieces, None)
            with pa.memory_map(f"{folder}/rows") as file:
                yield _mapped(pa.ipc.open_file(file).read_all(), folder)


def _same(b: pa.RecordBatch) -> list[tuple[int, int]]:
    """Where the rows of each cell of a batch begin, and how many they are."""
    c = b["cell_id"]
    cuts = [0, *(np.flatnonzero(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist(), len(c)]
    return [(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)]


def _mapped(t: pa.Table, folder: str) -> pd.DataFrame:
    """What t.to_pandas() says, with numbers in files."""
    out = {}
    for k, name in enumerate(t.column_names):
        if not (pa.types.is_integer(t[name].type) or pa.types.is_floating(t[name].type)):
            out[name] = t[name].to_pandas().to_numpy()
            continue
        kind = np.float64 if t[name].null_count and pa.types.is_integer(t[name].type) else t[name].type.to_pandas_dtype()
        out[name], at = np.memmap(f"{folder}/{k}", kind, "w+", shape=len(t)), 0
        for c in t[name].chunks:
            out[name][at : at + len(c)] = c.to_numpy(zero_copy_only=False)
            at += len(c)
    return pd.DataFrame(out, copy=False)


def standard(prior: DataFrame, bundle: Bundle | None = None) -> dict[str, Predictor]:
    """Random and majority labels by the shares of training, the heuristic of subtrees, and the chain with a bundle or by rules.
    prior: label and share (see metrics.prior)."""
    soma = lambda topo: topo.withColumn("type", F.when(F.col("id") == F.col("proxy"), 1).otherwise(0))
    return {
        "random": lambda topo: rules.random_labels(soma(topo), prior).select("cell_id", "id", "pred"),
        "majority": lambda topo: rules.majority_labels(soma(topo), prior).select("cell_id", "id", "pred"),
        "heuristic": rules.heuristic_labels,
        "chain": lambda topo: labelling.label_nodes(topo.withColumn("type", F.lit(0)), bundle).select("cell_id", "id", F.col("s23").alias("pred")),
    }


def run(topo: DataFrame, predictors: dict[str, Predictor]) -> DataFrame:
    """method, cell_id, cell_type, n_nodes, accuracy, neurite_macro_f1, macro_f1, error: a row for each predictor and cell, scores null where there
    is an error. Nodes that a predictor leaves out are misses."""
    seen, parts = topo.drop(*HIDDEN), []
    cells = topo.groupBy("cell_id", "cell_type").agg(F.count(F.lit(1)).alias("n_nodes"))
    truth = topo.select("cell_id", "id", "type")
    for name, predict in predictors.items():
        said = predict(seen)
        said = checkpointed(said if "error" in said.columns else said.withColumn("error", F.lit(None).cast("string")))
        wrong = said.filter("error IS NOT NULL").groupBy("cell_id").agg(F.min("error").alias("error"))
        # a row for each node: its files are small when labels repeat, which the planner takes for a table that fits into the driver
        rows = truth.join(said.filter("error IS NULL").select("cell_id", "id", "pred").hint("merge"), ["cell_id", "id"], "left").withColumn("pred", F.coalesce("pred", F.lit(0)))
        scores = metrics.summary(metrics.confusion(rows, ["cell_id"]), ["cell_id"]).select("cell_id", "accuracy", "neurite_macro_f1", "macro_f1")
        of = cells.join(wrong, "cell_id", "left").join(scores, "cell_id", "left")
        kept = [F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("accuracy", "neurite_macro_f1", "macro_f1")]
        parts.append(of.select(F.lit(name).alias("method"), "cell_id", "cell_type", "n_nodes", *kept, "error"))
    return reduce(DataFrame.unionByName, parts)


def table(rows: DataFrame) -> DataFrame:
    """method, n_files, n_errors, mean accuracy and mean F1 of neurites, best first: what run() says of all cells."""
    out = rows.groupBy("method").agg(F.count("neurite_macro_f1").alias("n_files"), F.count("error").alias("n_errors"), F.avg("accuracy").alias("accuracy"), F.avg("neurite_macro_f1").alias("neurite_macro_f1"))
    return out.orderBy(F.desc_nulls_last("neurite_macro_f1"), "method")
