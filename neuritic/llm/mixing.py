"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. A source's target is its weight's share of all words, at most `most` times its own size; what is
above is shared again among the others by weight. Documents are dealt into blocks of their source by a hash; a source
gives its blocks in a permuted order, pass after pass, until its target is met, the last block document by document.
Exact quotas of these block draws are split recursively between the two halves of the output shards: the left half's
share of each source is one multivariate-hypergeometric draw. Each shard then takes the next disjoint blocks of every
source's order, and is shuffled by a hash within itself. Everything follows from seed and hashes, so reruns agree.

What goes through the driver is a row for each source and its quota for each shard; blocks and documents don't.

Shards hold about `shard_words` words each. Blocks grow with the table where their draws would otherwise reach 10**9 in number, so
every draw of the tree is a true hypergeometric one.

Results in corner cases: null and empty texts have size 0 and are taken with 0 words; a null source is a source of its
own, the last; rows repeated with id and text are taken together; null ids are ids like others, told apart by their texts; an empty table gives an empty result;
other columns are kept by mix() and don't matter.
"""

from __future__ import annotations


import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, numbered, pick, stored, table, text_size

#: Blocks summed up together when the end of a source's draws is looked for.
CHUNK = 1024
#: Quotas of all sources and shards that are held on the driver and broadcast at most; more sources make fewer shards.
QUOTAS = 1 << 22
#: Draws that the generator of hypergeometric numbers takes.
DRAWS = 10**9


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Words that each source should give: shares of the sum by weight, none above `most` times the source's size."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free, left = [k for k, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while free and total > 0:
        w = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / w > most * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * weights[k] / w
            break
        for k in over:
            out[k] = most * sizes[k]
        left -= sum(out[k] for k in over)
        free = [k for k in free if k not in set(over)]
    return out


def split(quotas: np.ndarray, shards: int, seed: int = 0) -> np.ndarray:
    """Exact quotas (source x shard) whose rows add up to quotas and whose columns differ by one at most; fewer than DRAWS in all."""
    if int(quotas.sum()) >= DRAWS:
        raise ValueError(f"{DRAWS} draws or more; make blocks larger")
    out = np.zeros((len(quotas), shards), dtype=np.int64)

    def down(left: np.ndarray, a: int, b: int, node: int) -> None:
        if b - a == 1:
            out[:, a] = left
            return
        mid = (a + b) // 2
        n = int(left.sum())
        take = n * mid // shards - n * a // shards if (a, b) == (0, shards) else n * (mid - a) // (b - a)
        rng = np.random.default_rng([seed, node])
        part, rest, want = np.zeros_like(left), n, take
        for k, have in enumerate(left.tolist()):  # one hypergeometric draw a source, given those before
            got = int(rng.hypergeometric(have, rest - have, want)) if want and have else 0
            part[k] = min(have, max(got, want - (rest - have)))
            rest, want = rest - have, want - int(part[k])
        down(part, a, mid, 2 * node)
        down(left - part, mid, b, 2 * node + 1)

    if len(quotas):
        down(quotas.astype(np.int64), 0, shards, 1)
    return out


def _coprime(n: int, start: int) -> int:
    a = start % n or 1
    while np.gcd(a, n) != 1:
        a += 1
    return a


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, most: float = 3.0, shards: int | None = None, block_docs: int = 256, seed: int = 17, shard_words: int = 4_000_000) -> DataFrame:
    """The documents with a column `_mix`: size, source_size, target, copies (how often it is taken) and draws, an
    array of (shard, place): the output shards that it goes to and the hash that orders it there.

    weights: by source; by default 1, 2, 3, 1, ... in code-point order, null last. shards: by default one for each
    shard_words words. block_docs: documents of a block at least.
    """
    spark = docs.sparkSession
    source = F.col("source").cast("string")
    size = text_size("text")
    rows = pick(docs, "doc_id", "text", "source").select(source.alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "size", F.col("text").cast("string")).alias("h"))
    rows = stored(rows, "sizes")
    found = sorted(rows.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sources_, sums = [r["source"] for r in found], [int(r["s"]) for r in found]
    given = [float((weights or {}).get(n, 1.0)) if weights else float(k % 3 + 1) for k, n in enumerate(sources_)]
    goal = targets(sums, given, most)
    block_docs = max(block_docs, math.ceil(sum(r["n"] for r in found) * (most + 1) / (DRAWS // 2)))
    blocks = [max(1, -(-int(r["n"]) // block_docs)) for r in found]
    shards = shards or max(1, min(-(-sum(sums) // shard_words), QUOTAS // max(1, len(found))))
    small = len(found) * shards <= QUOTAS  # else joins are left to Spark
    table_rows = []
    for k, name in enumerate(sources_):
        whole = int(goal[k] // sums[k]) if sums[k] else 0
        rest = int(round(goal[k] - whole * sums[k]))
        if sums[k] and rest >= sums[k]:  # so near to a further pass that it rounds to one
            whole, rest = whole + 1, 0
        table_rows.append((k, name, sums[k], goal[k], blocks[k], _coprime(blocks[k], 7919 + 31 * k + seed), whole, rest))
    schema = "k int, source string, source_size long, target double, blocks long, step long, whole int, rest long"
    sources = _perhaps_broadcast(spark.createDataFrame(table_rows, schema), small)

    def place(h: str) -> Column:
        """Place of the block in the source's permuted order."""
        return F.pmod(F.pmod(F.col(h), F.col("blocks")) * F.col("step"), F.col("blocks"))

    # where the last pass ends: the chunk, in it the block, in it the documents
    where = rows.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).filter("rest > 0").select("k", "size", "h", "rest", place("h").alias("place"))
    per_block = stored(where.groupBy("k", "place").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")), "blocks")
    chunk = F.floor(F.col("place") / CHUNK)
    upto = Window.partitionBy("k").rowsBetween(Window.unboundedPreceding, 0)
    chunks = per_block.groupBy("k", chunk.alias("chunk")).agg(F.sum("words").alias("words"), F.first("rest").alias("rest"))
    chunks = chunks.withColumn("before", F.sum("words").over(upto.orderBy("chunk")) - F.col("words")).filter("before <= rest AND before + words > rest")
    inside = per_block.withColumn("chunk", chunk).join(chunks.select("k", "chunk", "before"), ["k", "chunk"])
    inside = inside.withColumn("b", F.col("before") + F.sum("words").over(upto.orderBy("place")) - F.col("words"))
    last = stored(inside.filter("b <= rest AND b + words > rest").select("k", F.col("place").alias("last"), (F.col("rest") - F.col("b")).alias("room")), "last")
    drawn = {r["k"]: int(r["last"]) + 1 for r in last.collect()}  # a row for each source
    where_ends = where.join(_perhaps_broadcast(last.withColumnRenamed("k", "_k"), small), (where["k"] == F.col("_k")) & (where["place"] == last["last"]))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.groupby("h", as_index=False).agg(k=("k", "first"), size=("size", "sum"), room=("room", "first")).sort_values("h")
        size, best, least = pdf["size"].to_numpy(), None, None
        rng = np.random.default_rng([seed, int(pdf["k"].iloc[0])])
        for _ in range(32):  # the order that leaves the smallest gap
            room, keep = int(pdf["room"].iloc[0]), np.zeros(len(size), dtype=bool)
            for i in rng.permutation(len(size)):
                if 0 < size[i] <= room:
                    keep[i] = True
                    room -= size[i]
            over = np.where(keep | (size <= 0), np.iinfo(np.int64).max, size - room)
            nearer = int(over.argmin())  # the target may be passed by less than it would be missed
            if over[nearer] < room:
                keep[nearer], room = True, int(over[nearer])
            if least is None or room < least:
                best, least = keep, room
        return pdf.loc[best, ["k", "h"]]

    ends = where_ends.select("k", "size", "h", "room")
    ends = stored(ends.groupBy("k").applyInPandas(fill, "k int, h long"), "ends")  # one block a source
    for used in (rows, per_block, last):
        drop_stored(used)
    quotas = np.array([r[6] * r[4] + drawn.get(r[0], 0) for r in table_rows], dtype=np.int64)
    upper = np.cumsum(split(quotas, shards, seed), axis=1)
    limits = spark.createDataFrame([(*r, drawn.get(r[0], 0) - 1, upper[r[0]].tolist()) for r in table_rows], schema + ", last long, upper array<long>")
    limits = _perhaps_broadcast(limits, small)
    ends = _perhaps_broadcast(ends, len(found) * block_docs <= QUOTAS)

    names, out = docs.columns, numbered(docs)
    key, text, origin = (F.col(f"_d{names.index(c)}") if c in names else F.lit(None).cast("string") for c in ("doc_id", "text", "source"))
    out = out.withColumn("_size", text_size(text)).withColumn("_h", F.xxhash64(F.lit(seed), key, "_size", text.cast("string")))
    limits, ends = limits.toDF(*(f"_m_{c}" for c in limits.columns)), ends.toDF("_e_k", "_e_h")
    out = out.join(limits, origin.cast("string").eqNullSafe(F.col("_m_source")), "left")
    out = out.join(ends, (F.col("_h") == F.col("_e_h")) & (F.col("_m_k") == F.col("_e_k")), "left")
    at = F.pmod(F.pmod(F.col("_h"), F.col("_m_blocks")) * F.col("_m_step"), F.col("_m_blocks"))
    more = (at < F.col("_m_last")) | ((at == F.col("_m_last")) & F.col("_e_h").isNotNull())
    copies = (F.col("_m_whole") + F.coalesce(more, F.lit(False)).cast("int")).cast("int")
    draws = F.transform(
        F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>")),
        lambda p: F.struct(
            _shard(p * F.col("_m_blocks") + at, F.col("_m_upper"), shards).alias("shard"),
            F.xxhash64(F.lit(seed + 1), F.col("_h"), p).alias("place"),
        ),
    )
    mixed = F.struct(F.col("_size").alias("size"), F.col("_m_source_size").alias("source_size"), F.col("_m_target").alias("target"), copies.alias("copies"), draws.alias("draws"))
    return out.select(*(f"_d{i}" for i in range(len(names))), mixed.alias("_mix")).toDF(*names, "_mix")


def _perhaps_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _shard(draw: Column, upper: Column, shards: int) -> Column:
    """Number of the shard that takes a source's draw: how many of the ascending bounds it reaches, by halving steps."""
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(shards.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda acc, p: F.when((acc + p <= shards) & (F.get(upper, acc + p - 1) <= draw), acc + p).otherwise(acc))


def shuffled(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each draw, with its shard (the last column), each shard in one partition in its shuffled order."""
    names = mixed.columns[:-1]
    rows = numbered(mixed).withColumn("_d", F.explode(F.col(f"_d{len(names)}.draws"))).withColumn("_shard", F.col("_d.shard")).withColumn("_place", F.col("_d.place"))
    rows = rows.repartition("_shard").sortWithinPartitions("_shard", "_place")
    return rows.select(*(f"_d{i}" for i in range(len(names))), "_shard").toDF(*names, "_shard")


def op7_columns(docs: DataFrame) -> DataFrame:
    return mix(docs).select(
        "doc_id", "source", "_mix.size", "_mix.source_size", "_mix.target", (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"), "_mix.draws"
    )


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_columns(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


QUERIES = {"op7_mix_sources": op7_mix_sources}
ORACLE = {}
