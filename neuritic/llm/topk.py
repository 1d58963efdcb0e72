"""Exact top-k inner products by no-random-access aggregation.

Every component of the vectors is a list of candidates sorted by its value, read from the top for positive query
components and from the bottom for negative ones. After each round of sequential reading a candidate's score is known
to lie between two bounds: what has been read counts as it is, what hasn't lies between the list's end and the last
value read. A query is done once no candidate outside its k best lower bounds can reach the k-th; those
that still can get their final scores resolved.

Candidates are dealt into groups by a hash, queries into blocks; each pair of group and block is one task's
work, which goes through the group's candidates about a thousand at a time and carries the k-th best score on: a few of the longest
vectors are scored in full at first, then lists are read in steps from the top. A query stops reading when few outsiders
are left, and these get their final scores; what it reads to the end it would have to read anyhow. Bounds
for all queries of a block are matrix products. Spark merges the k best of all groups.

Results in corner cases: vectors that are null, empty, or hold null or non-finite components take no part, neither as
queries nor as candidates; vectors of unequal length are compared over their common prefix; a query's candidates are all rows but
its own, also such as repeat its vec_id; repeated rows are candidates and queries each; null ids take no part; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, pick, stored, table

#: Candidates whose lists are sorted and read together.
BLOCK = 1024
#: Candidates of a group, those with the longest vectors, that are scored in full at first, so that a bar is known.
SEED = 128
#: How far lists are read before bounds are compared.
DEPTHS = (0.125, 0.25, 0.375, 0.5, 0.5625, 0.625, 0.6875, 0.75, 0.8125, 0.875, 1.0)


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _exact(q: np.ndarray, x: np.ndarray) -> np.dtype:
    """The cheapest type in which all sums of products are exact integers."""
    top = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return np.dtype(np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64)


def search(q_rows: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, block: int = BLOCK, stops: list | None = None) -> pd.DataFrame:
    """The k best candidates of every query but its own row, (query_row, vec_id, score), in order of score and then id.

    stops: takes (share of the lists read, queries that stopped there) for every block.
    """
    best = [np.zeros((0, 2), dtype=np.int64)] * len(q)  # per query: score, id
    kth = np.full(len(q), -np.inf)
    kind = _exact(q, x)
    qt = q.astype(kind)
    up, down = np.maximum(qt, 0), np.maximum(-qt, 0)
    strong = np.argsort(-(x.astype(float) ** 2).sum(axis=1), kind="stable")  # long vectors first: they raise the bar
    rows, ids, x = rows[strong], ids[strong], x[strong]
    cuts = [0, *range(min(SEED, len(x)), len(x), block), len(x)] if len(x) else [0]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        xs, own = x[lo:hi].astype(kind), ids[lo:hi]
        n = hi - lo
        if not n:
            continue
        lists = np.sort(xs, axis=0)
        open_q, rest = np.arange(len(q)), []
        for depth in sorted({max(1, int(n * d)) for d in DEPTHS} if lo else {n}):  # the first candidates are read to the end
            top, low = lists[n - depth], lists[depth - 1]  # the last values read from above and from below
            if depth == n:
                upper = lower = qt[open_q] @ xs.T
            else:
                upper = up[open_q] @ np.where(xs >= top, xs, top).T + down[open_q] @ np.where(xs <= low, -xs, -low).T
                lower = up[open_q] @ np.where(xs >= top, xs, lists[0]).T + down[open_q] @ np.where(xs <= low, -xs, -lists[-1]).T
            lower = np.where(rows[None, lo:hi] == q_rows[open_q, None], -np.inf, lower)
            bar = kth[open_q]
            if n > k:
                bar = np.maximum(bar, np.partition(lower, n - k, axis=1)[:, n - k])
            alive = (upper >= bar[:, None]) & (lower > -np.inf)
            # reading on costs more than final scores for a few that are left
            few = alive.sum(axis=1) <= max(4 * k, n // 10) if depth < n else np.ones(len(open_q), dtype=bool)
            i, j = np.nonzero(alive[few])
            rest.append((open_q[few][i], j))
            if stops is not None and lo:
                stops.append((depth / n, int(few.sum())))
            open_q = open_q[~few]
            if not len(open_q):
                break
        qi, ci = (np.concatenate(z) for z in zip(*rest, strict=True))
        score = np.empty(len(qi), dtype=np.int64)
        for s in range(0, len(qi), 100_000):  # the final scores of those that could still qualify
            score[s : s + 100_000] = (q[qi[s : s + 100_000]] * x[lo + ci[s : s + 100_000]]).sum(axis=1)
        order = np.lexsort((own[ci], -score, qi))
        qi, ci, score = qi[order], ci[order], score[order]
        first = np.searchsorted(qi, np.arange(len(q) + 1))
        for j in range(len(q)):
            a, b = first[j], min(first[j + 1], first[j] + k)
            if a < b:
                new = np.concatenate([best[j], np.stack([score[a:b], own[ci[a:b]]], axis=1)])
                best[j] = new[np.lexsort((new[:, 1], -new[:, 0]))[:k]]
                if len(best[j]) == k:
                    kth[j] = best[j][-1, 0]
    flat = np.concatenate(best) if best else np.zeros((0, 2), dtype=np.int64)
    return pd.DataFrame({"query_row": np.repeat(q_rows, [len(b) for b in best]), "vec_id": flat[:, 1], "score": flat[:, 0]})


def top_k(vectors: DataFrame, k: int = 5, scale: int = 256, is_query: Column | None = None, group_rows: int = 16384, query_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all other vectors."""
    spark = vectors.sparkSession
    arrow_batches(spark)
    x = pick(vectors, "vec_id", "embedding")
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    x = x.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(whole)
    v = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    x = stored(x.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")), "rows")
    is_query = F.col("vec_id") % 50 == 0 if is_query is None else is_query
    n, n_query = x.agg(F.count(F.lit(1)), F.coalesce(F.sum(is_query.cast("long")), F.lit(0))).first()
    groups, blocks = max(1, math.ceil(n / group_rows)), max(1, math.ceil(n_query / query_rows))
    h = F.xxhash64("row")

    def numbers(m: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    candidates = x.select("row", "vec_id", "v", F.pmod(h, F.lit(groups)).cast("int").alias("g"), numbers(blocks).alias("b"))
    queries = x.filter(is_query).select(F.col("row").alias("row"), F.col("vec_id").alias("query_id"), F.col("v").alias("v"), numbers(groups).alias("g"), F.pmod(h, F.lit(blocks)).cast("int").alias("b"))

    def run(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
        width = max(c["v"].map(len).max(), q["v"].map(len).max())
        c = c.sort_values(["vec_id", "row"])
        got = search(q["row"].to_numpy(), _matrix(q["v"], width), c["row"].to_numpy(), c["vec_id"].to_numpy(), _matrix(c["v"], width), k)
        return got.merge(q[["row", "query_id"]].rename(columns={"row": "query_row"}), on="query_row")[["query_row", "query_id", "vec_id", "score"]]

    found = candidates.groupBy("g", "b").cogroup(queries.groupBy("g", "b")).applyInPandas(run, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES = {"op6_exact_topk": op6_exact_topk}
ORACLE = {
    "op6_exact_topk": """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5
"""
}
