"""Best-fit packing by minimum bin slack.

Every piece shorter than a sequence has one of at most seq_len - 1 lengths, so the whole problem is a histogram of
lengths, of fixed size however many documents there are. For a bin, a subset-sum dynamic program over the available
lengths (sets of reachable sums as the bits of an integer) finds the fullest feasible combination; it is taken out
of the histogram as often as the histogram allows, and the next is sought. Spark then deals every document its
place: it ranks the pieces of each length (salted, so that a length that a third of all documents share is spread),
and looks the rank up in the plan of combinations.

Results in corner cases: null and empty texts are one piece of length 1 (the end id); repeated rows are packed as
separate documents; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import arrow_batches, pick, stored, table, together

#: The end-of-document id.
END = 0


def fullest(counts: np.ndarray, seq_len: int) -> dict[int, int]:
    """The combination {length: how often} of available lengths with the largest sum that is at most seq_len.

    Contains the longest available length, as minimum bin slack does: the hardest piece is placed first.
    """
    lengths = [int(x) for x in np.nonzero(counts)[0][::-1]]
    first = lengths[0]
    room = seq_len - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for x in lengths:
        if x > room:
            continue
        left, k = min(int(counts[x]) - (x == first), room // x), 1
        while left > 0:  # copies in groups of 1, 2, 4 ...: any number of copies is a sum of groups
            k = min(k, left)
            new = (reach | reach << (k * x)) & mask
            if new != reach:
                steps.append((x, k, reach))
                reach = new
            left, k = left - k, 2 * k
        if reach >> room:
            break
    out, at = {first: 1}, reach.bit_length() - 1
    for x, k, before in reversed(steps):
        if not before >> at & 1:  # only with this group is the sum reached
            out[x] = out.get(x, 0) + k
            at -= k * x
    return out


def plan(histogram: dict[int, int], seq_len: int) -> pd.DataFrame:
    """The bins for a histogram of lengths, as ranges of ranks.

    Columns: length, lo (first rank), times (bins of this combination), each (pieces of this length in a bin), bin
    (first bin number), at (offset of the first of them). At most a few rows for each length are ever needed, since
    each combination is taken until a length in it runs short.
    """
    counts = np.zeros(seq_len + 1, dtype=np.int64)
    for x, n in histogram.items():
        counts[x] = n
    used = np.zeros(seq_len + 1, dtype=np.int64)
    rows, bins = [], 0
    while counts.any():
        combination = fullest(counts, seq_len)
        times = min(int(counts[x]) // k for x, k in combination.items())
        at = 0
        for x, k in combination.items():
            rows.append((x, int(used[x]), times, k, bins, at))
            used[x] += k * times
            counts[x] -= k * times
            at += k * x
        bins += times
    return pd.DataFrame(rows, columns=["length", "lo", "times", "each", "bin", "at"], dtype="int64")


PIECES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("tail", T.IntegerType()), T.StructField("crcs", T.ArrayType(T.LongType())), T.StructField("part", T.IntegerType())]
)


def tokenized(docs: DataFrame, seq_len: int, path: str, memory: int = tokens.MEMORY) -> DataFrame:
    """Per document: its number of ids, the length of its short piece (0: none), the crc32 of every piece in order, and the
    number of the task that read it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        enc = tokens.encoder(path, memory)
        for pdf in together(batches, "text", 2 << 20):
            n_ids, tails, crcs = [], [], []
            for ids in enc.encode(pdf["text"]):
                ids = np.append(ids, END).astype("<u4")
                tail = len(ids) % seq_len
                cuts = [0, *range(tail or seq_len, len(ids) + 1, seq_len)] if len(ids) >= seq_len else [0, len(ids)]
                n_ids.append(len(ids))
                tails.append(tail)
                crcs.append([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_ids": n_ids, "tail": np.array(tails, dtype=np.int32), "crcs": crcs, "part": np.int32(part)})

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, PIECES)


def pack(docs: DataFrame, seq_len: int = 2048, path: str | None = None, salts: int = 256, memory: int = tokens.MEMORY) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    memory: distinct runs of characters that a Python worker remembers; it changes speed only.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    path = path or tokens.tokenizer_path()
    pieces = stored(tokenized(docs, seq_len, path, memory), "pieces").withColumn("full", F.floor(F.col("n_ids") / seq_len))
    # ranks within each length, by salt (with the part, so that rows repeated very often spread too); the sums by (length, salt) are a table of bounded size
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_ids", F.element_at("crcs", 1), "part"), F.lit(salts)))
    sums = pieces.groupBy("tail", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("n_full"))
    sums = sums.toPandas().sort_values(["tail", "salt"], ignore_index=True)  # at most seq_len * salts rows
    histogram = sums[sums["tail"] > 0].groupby("tail")["n"].sum().to_dict()
    bins = plan(histogram, seq_len)
    n_bins = int((bins["times"] + bins["bin"]).max()) if len(bins) else 0
    first_rank = sums.groupby("tail")["n"].cumsum() - sums["n"]
    first_full = n_bins + sums["n_full"].cumsum() - sums["n_full"]
    base = np.zeros((2, seq_len, salts), dtype=np.int64)
    base[0, sums["tail"], sums["salt"]] = first_rank
    base[1, sums["tail"], sums["salt"]] = first_full
    by_length = {int(x): g.sort_values("lo")[["lo", "times", "each", "bin", "at"]].to_numpy() for x, g in bins.groupby("length")}
    within = Window.partitionBy("tail", "salt").orderBy("doc_id", "n_ids", "crcs")
    ranked = pieces.select(
        "*",
        (F.row_number().over(within) - 1).alias("rank"),
        (F.sum("full").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full")).alias("fulls"),
    )
    shared = spark.sparkContext.broadcast((base, by_length))  # bounded: a few MB

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, by_length = shared.value
        for pdf in batches:
            tail, salt = pdf["tail"].to_numpy(), pdf["salt"].to_numpy()
            rank = pdf["rank"].to_numpy() + base[0, tail, salt]
            seq, offset = np.full(len(pdf), -1, dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            for x in np.unique(tail[tail > 0]):
                own = np.nonzero(tail == x)[0]
                rows = by_length[int(x)]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                i = rank[own] - row[:, 0]
                seq[own] = row[:, 3] + i // row[:, 2]
                offset[own] = row[:, 4] + i % row[:, 2] * x
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_ids": pdf["n_ids"], "tail": pdf["tail"], "crcs": pdf["crcs"], "seq": seq, "at": offset, "first_full": pdf["fulls"].to_numpy() + base[1, tail, salt]})

    schema = "doc_id long, n_ids long, tail int, crcs array<long>, seq long, at long, first_full long"
    placed = ranked.select("doc_id", "n_ids", "tail", "crcs", "salt", "rank", "fulls").mapInPandas(place, schema)
    short = F.col("tail") > 0
    i = F.col("piece")
    number = i - short.cast("int")  # of the full piece, from 0
    return placed.select("*", F.posexplode("crcs").alias("piece", "ids_crc32")).select(
        "doc_id",
        i.cast("int").alias("piece"),
        F.when(short & (i == 0), F.lit(0)).otherwise(F.col("tail") + number * seq_len).cast("long").alias("start"),
        F.when(short & (i == 0), F.col("tail")).otherwise(seq_len).cast("long").alias("length"),
        "ids_crc32",
        F.when(short & (i == 0), F.col("seq")).otherwise(F.col("first_full") + number).alias("sequence_id"),
        F.when(short & (i == 0), F.col("at")).otherwise(0).cast("long").alias("offset"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLE = {}
