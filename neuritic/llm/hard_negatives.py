"""Hard negatives by distributed radix selection.

For each anchor and each of its positives there is a window of scores in which negatives are looked for. The k best rows
of a window are found without sorting or gathering its rows: each pass counts, per window, how many rows have which value of one digit
of their distance from the window's upper end, most significant digit first; sums of these histograms tell in which bucket the k-th row
lies, and the next pass refines that bucket only. Rows of equal score are refined by digits of their id. A window is
closed once few rows lie up to its bucket's end; one last pass gathers these, and only these. Positives are selected the same way,
in windows that take all scores.

Scores are products of integer matrices: candidates are dealt into groups and windows into blocks, both by the number of
their row, so no id or vector weighs more than another; each pair of group and block is one task's work, in memory that
follows from the sizes of group and block. A task gives on at most a number for each window and bucket, at the end
k rows for each window, so copies of a vector, however many, are never gathered.

Results in corner cases: rows with a null label or vector, or a null or non-finite component, take no part; short vectors count as
filled up with zeros; null ids come last among equal scores and are no anchors; repeated rows are rows each, anchors as well;
anchors without rows of their label, or without other rows in a window, give none; an empty table gives an empty result; other
columns are ignored. Products beyond 62 bits are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, dense, drop_stored, finite, pick, stored, table

#: Bits of a digit.
DIGIT = 8
#: A window is closed when at most so many rows for each one wanted lie up to its bucket's end.
FEW = 8
#: Scores of a block of windows that are held at once.
SCORES = 1 << 19
#: Digits of an id's 64 bits.
ID_SHIFTS = tuple(range(64 - DIGIT, -1, -DIGIT))

#: The state of a window, and at first. need: rows still wanted from the open bucket, which begins at distance d0, and there at ids that are null or not
#: (null0) and have the leading bits t0. Rows of a closed window have a distance below d_end, or are at d_end with null-ness below null_end, or at that with
#: the bits of their id up to t_last.
STATE = {"need": 0, "d0": 0, "null0": 0, "t0": 0, "d_end": 0, "null_end": -1, "t_last": 0, "open": 1}


def _rows(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """row, vec_id, label, v: the rows that take part, numbered, in a stored table."""
    rows = pick(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    rows = rows.filter(finite("embedding") & F.col("label").isNotNull())
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", label.alias("label"), v.alias("v")), "rows")


def _unsigned(ids: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits in the order of the ids."""
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


class Task:
    """The scores of a group of candidates in a block of windows, a part at a time."""

    def __init__(self, rows: pa.Table, windows: pa.Table, width: int, same: bool):
        get = lambda t, c: t[c].to_numpy()
        self.x, self.row, self.label = dense(rows["v"], width), get(rows, "row"), get(rows, "label")
        ids = rows["vec_id"].combine_chunks()
        ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
        self.null = np.asarray(ids.is_null()).astype(np.int8)
        self.id = _unsigned(np.asarray(ids.fill_null(0)))
        self.names = windows.column_names
        self.w = {c: get(windows, c) for c in self.names if c not in ("v", "g", "b")}
        self.q, self.same = dense(windows["v"], width), same
        top = int(np.abs(self.x).max(initial=0)) * int(np.abs(self.q).max(initial=0)) * max(1, width)
        self.kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
        self.xt = self.x.T.astype(self.kind)

    def parts(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Windows, the distances of all candidates from their upper ends, and which candidates are in the window at all."""
        step = max(1, SCORES // max(1, len(self.row)))
        for lo in range(0, len(self.q), step):
            at = slice(lo, lo + step)
            score = (self.q[at].astype(self.kind) @ self.xt).astype(np.int64)
            hit = (score >= self.w["lo"][at, None]) & (score <= self.w["hi"][at, None]) & (self.row[None, :] != self.w["anchor_row"][at, None])
            hit &= (self.label[None, :] == self.w["label"][at, None]) == self.same
            yield at, self.w["hi"][at, None] - score, hit

    def counts(self, level: str, shift: int) -> pa.Table:
        """w, bucket, n of the open buckets' next digit. level: d, null or t."""
        out = []
        for at, d, hit in self.parts():
            i, j = np.nonzero(hit & (d >= self.w["d0"][at, None]))
            d, d0 = d[i, j], self.w["d0"][at][i]
            if level == "d":
                digit, here = (d - d0) >> shift, np.ones(len(i), dtype=bool)
                here = digit < 1 << DIGIT
            else:
                here = d == d0
                if level == "null":
                    digit = self.null[j].astype(np.int64)
                else:
                    here &= self.null[j] == self.w["null0"][at][i]
                    away = (self.id[j] ^ self.w["t0"][at][i].view(np.uint64)) >> np.uint64(shift)  # leading bits that are t0's vanish
                    here &= away < 1 << DIGIT
                    digit = (away & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
            n = np.bincount(i[here] << DIGIT | digit[here], minlength=1)
            full = np.flatnonzero(n)
            out.append((self.w["w"][at][full >> DIGIT], full & (1 << DIGIT) - 1, n[full]))
        w, bucket, n = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 3
        return pa.table({"w": pa.array(w, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "n": pa.array(n, pa.int64())})

    def best(self, k: int) -> pa.Table:
        """w, d, vec_id: the first k of the rows up to each closed window's end."""
        out = []
        for at, d, hit in self.parts():
            ends = self.w["d_end"][at, None]
            hit &= d <= ends
            i, j = np.nonzero(hit)
            d, null, ids = d[i, j], self.null[j], self.id[j]
            until_null, until = self.w["null_end"][at][i], self.w["t_last"][at][i].view(np.uint64)
            keep = (d < self.w["d_end"][at][i]) | (null < until_null) | ((null == until_null) & (ids <= until))
            i, j, d, null, ids = (c[keep] for c in (i, j, d, null, ids))
            order = np.lexsort((ids, null, d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            keep = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
            out.append((self.w["w"][at][i[keep]], d[keep], j[keep]))
        w, d, j = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 3
        ids = (self.id[j] ^ np.uint64(1 << 63)).view(np.int64)
        return pa.table({"w": pa.array(w, pa.int64()), "d": pa.array(d, pa.int64()), "vec_id": pa.array(ids, pa.int64(), mask=self.null[j].astype(bool))})


class Selection:
    """Selects the k best rows of many windows over one table of rows.

    group_rows, window_rows: candidates of a group and windows of a block; their product is a task's work.
    """

    def __init__(self, rows: DataFrame, k: int = 5, group_rows: int = 4096, window_rows: int = 4096):
        self.rows, self.k, self.window_rows = rows, k, window_rows
        arrow_batches(rows.sparkSession)
        norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        n, width, far = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
        self.n, self.width = n, width or 0
        #: No score is beyond this bound, by the longest vector.
        self.top = math.floor((far or 0.0) * (1 + 1e-12)) + 1
        if self.top >= 1 << 61:
            raise ValueError("products of these vectors don't fit 62 bits")
        self.groups = max(1, math.ceil(n / group_rows))
        self.passes = 0

    def _run(self, windows: DataFrame, same: bool, schema: str, call) -> DataFrame:
        """What a call of each task gives, for all groups and blocks. windows: w, anchor_row, label, lo, hi and state, with vectors v."""
        blocks, width = max(1, math.ceil(windows.count() / self.window_rows)), self.width
        self.passes += 1

        def run(rows: pa.Table, of: pa.Table) -> pa.Table:
            return call(Task(rows, of, width, same))

        def numbers(m: int) -> Column:
            return F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

        rows = self.rows.select(*(F.col(c).alias(c) for c in ("row", "vec_id", "label", "v")), F.pmod(F.xxhash64("row"), F.lit(self.groups)).cast("int").alias("g"), numbers(blocks).alias("b"))
        of = windows.withColumn("b", F.pmod(F.xxhash64("anchor_row"), F.lit(blocks)).cast("int")).withColumn("g", numbers(self.groups))
        return rows.groupBy("g", "b").cogroup(of.groupBy("g", "b")).applyInArrow(run, schema)

    def best(self, windows: DataFrame, same: bool) -> DataFrame:
        """w, rank, score, vec_id: the k rows of each window with the highest scores, ties to smaller ids, null ids last.

        windows: w, anchor_row, lo, hi. A window takes rows with the anchor's label, or with another (same), with scores from lo to hi,
        but the anchor's own row.
        """
        k = self.k
        anchors = self.rows.select(*(F.col(c).alias(n) for c, n in (("row", "anchor_row"), ("label", "label"), ("v", "v"))))
        first = STATE | {"need": k}
        start = windows.select("w", "anchor_row", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
        state = stored(start.select("*", *(F.lit(first[c]).cast("long").alias(c) for c in STATE)), "windows")
        widest = state.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
        done, used = [], [state]
        if widest is not None:
            bits = max(1, int(widest).bit_length())
            levels = [("d", s) for s in range((bits - 1) // DIGIT * DIGIT, -1, -DIGIT)] + [("null", 0)] + [("t", s) for s in ID_SHIFTS]
            for level, shift in levels:
                found = self._run(state.join(anchors, "anchor_row"), same, "w long, bucket long, n long", lambda task, level=level, shift=shift: task.counts(level, shift))
                state = stored(self._refined(state, found, level, shift, last=(level, shift) == levels[-1]), "windows")
                used.append(state)
                done.append(state.filter("open = 0"))
                state = state.filter("open = 1")
                if not state.count():
                    break
        closed = done[0] if done else state
        for more in done[1:]:
            closed = closed.unionByName(more)
        found = self._run(closed.join(anchors, "anchor_row"), same, "w long, d long, vec_id long", lambda task: task.best(k))
        order = Window.partitionBy("w").orderBy("d", F.col("vec_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        out = stored(ranked.join(start.select("w", "hi"), "w").select("w", "rank", (F.col("hi") - F.col("d")).alias("score"), "vec_id"), "best")
        for x in used:
            drop_stored(x)
        return out

    def _refined(self, state: DataFrame, found: DataFrame, level: str, shift: int, last: bool) -> DataFrame:
        """The windows' state after the sums of a digit's histograms: each one's bucket of the last row wanted, open or closed."""
        sums = found.groupBy("w", "bucket").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("w").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # 256 buckets at most
        sums = sums.withColumn("upto", F.sum("n").over(upto))
        hit = sums.join(state.select("w", "need"), "w").filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        s = state.join(hit.select("w", "bucket", "n", "upto"), "w", "left")
        none, bucket = F.col("bucket").isNull(), F.coalesce("bucket", F.lit(0))
        close = none | (F.col("upto") <= FEW * self.k) | F.lit(last)
        if level == "d":  # fewer rows than wanted: all of the window's; that can happen to the first digit only
            new = {"d0": F.col("d0") + bucket * (1 << shift)}
            ends = {"d_end": F.when(none, F.col("hi") - F.col("lo") + 1).otherwise(F.col("d0") + (bucket + 1) * (1 << shift))}
        elif level == "null":
            close, new, ends = F.lit(False), {"null0": bucket}, {}
        else:
            bits = F.col("t0").bitwiseOR(F.shiftleft(bucket.cast("long"), shift))
            new, ends = {"t0": bits}, {"d_end": F.col("d0"), "null_end": F.col("null0"), "t_last": bits.bitwiseOR(F.lit((1 << shift) - 1).cast("long"))}
        out = {c: F.col(c) for c in STATE} | {c: F.when(close, F.col(c)).otherwise(v) for c, v in new.items()} | {c: F.when(close, v).otherwise(F.col(c)) for c, v in ends.items()}
        out |= {"need": F.when(none, F.col("need")).otherwise(F.col("need") - F.col("upto") + F.col("n")), "open": F.when(close, 0).otherwise(1)}
        return s.select("w", "anchor_row", "lo", "hi", *(out[c].cast("long").alias(c) for c in STATE))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column | None = None, label: Column | None = None, positives: int = 5, k: int = 5, least: int = 80, scale: int = 256, group_rows: int = 4096, window_rows: int = 4096
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best rows of the same
    label, the k best rows of other labels with at least `least` percent of the positive's score and at most all of it.

    is_anchor: over vec_id; by default ids divisible by 100. label: over vec_id and label; by default the label.
    """
    rows = _rows(vectors, F.col("label") if label is None else label, scale)
    few, many = Selection(rows, positives, group_rows, window_rows), Selection(rows, k, group_rows, window_rows)
    is_anchor = F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor
    anchors = rows.filter(is_anchor).select("row", F.col("vec_id").alias("anchor_id"))
    near = few.best(anchors.select(F.col("row").alias("w"), F.col("row").alias("anchor_row"), F.lit(-few.top).alias("lo"), F.lit(few.top).alias("hi")), same=True)
    p = F.col("score")
    less = F.expr(f"(score div 100) * {100 - least} + (score % 100) * {100 - least} div 100")  # rounded down
    near = near.filter(p >= 0).select(F.col("w").alias("anchor_row"), (F.col("w") * positives + F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), p.alias("hi"), (p - less).alias("lo"))
    near = stored(near, "positives")
    found = many.best(near.select("w", "anchor_row", "lo", "hi"), same=False)
    named = near.join(anchors.withColumnRenamed("row", "anchor_row"), "anchor_row").select("w", "anchor_id", "positive_id", F.col("hi").alias("positive_score"))
    return named.join(found, "w").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), label=label)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLE = {
    "op11_hard_negatives": """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS MATERIALIZED (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.r <> c.r WHERE a.vec_id % 100 = 0
), p AS (
  SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER w AS place
  FROM s WHERE same WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) QUALIFY place <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.r = p.r AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST)
QUALIFY row_number() OVER w <= 5
"""
}
