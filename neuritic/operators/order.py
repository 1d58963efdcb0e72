"""Exact order statistics of many groups at once, in a bounded number of passes.

A value at a place is looked for between two bounds. While more values lie between them than may be put together, a pass takes approximate quantiles
of these as marks and counts exactly how many values lie at each mark and between neighbouring ones; the part that has the place gives the
next bounds. A pass leaves about one of a few hundred values, whatever their distribution, so a thousand million distinct values of a group take
three passes. What is put together in the end is at most `limit` values for a place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, drop_stored

#: Values that may be put together, and marks of a pass.
LIMIT, MARKS = 4096, 256


def values_at(rows: DataFrame, places: DataFrame, limit: int = LIMIT, marks: int = MARKS) -> DataFrame:
    """g, place, v: the values at places (from 0, in ascending order) of groups. rows: g, v, without nulls. places: g, place, and of the group n, low
    and high."""
    state = checkpointed(places.select("g", "place", F.lit(0).cast("long").alias("skip"), F.col("n").alias("count"), F.col("low").alias("lo"), F.col("high").alias("hi")))
    done, used = [], []

    def inside(of: DataFrame) -> DataFrame:
        of = of.withColumnRenamed("g", "_g")
        return rows.join(of, (F.col("g") == F.col("_g")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).drop("_g")

    while True:
        used.append(state)
        settled = F.col("lo") == F.col("hi")
        done.append(state.filter(settled).select("g", "place", F.col("lo").alias("v")))
        few = inside(state.filter(~settled & (F.col("count") <= limit))).groupBy("g", "place", "skip").agg(F.sort_array(F.collect_list("v")).alias("all"))
        done.append(few.select("g", "place", F.get("all", (F.col("place") - F.col("skip")).cast("int")).alias("v")))
        wide = state.filter(~settled & (F.col("count") > limit))
        if wide.isEmpty():
            break
        found = inside(wide).groupBy("g", "place").agg(F.array_distinct(F.percentile_approx("v", [k / marks for k in range(1, marks)], 20 * marks)).alias("marks"))
        marked = checkpointed(wide.join(found, ["g", "place"]))
        # each mark is a part of its own, so the parts between hold other values only
        at = 2 * F.size(F.filter("marks", lambda m: m < F.col("v"))) + F.array_contains("marks", F.col("v")).cast("int")
        parts = inside(marked).withColumn("part", at).groupBy("g", "place", "skip", "part").agg(F.count(F.lit(1)).alias("count"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("count").over(Window.partitionBy("g", "place").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))  # 2 * marks + 1 rows at most
        parts = parts.withColumn("before", F.col("skip") + upto - F.col("count"))
        hit = parts.filter((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("count")))
        state = checkpointed(hit.select("g", "place", F.col("before").alias("skip"), "count", "lo", "hi"))
        used.append(marked)
    out = checkpointed(reduce(DataFrame.unionByName, done))
    for x in used:
        drop_stored(x)
    return out


def at_places(rows: DataFrame, keys: list[str], value: str, places: list[Column], limit: int = LIMIT, marks: int = MARKS) -> DataFrame:
    """keys, n, mean, low, high and values: those at places that follow from n, in their order. Nulls don't count; a group of nulls only isn't there."""
    rows = rows.filter(F.col(value).isNotNull()).select(F.to_json(F.struct(F.lit(1).alias("_"), *keys)).alias("g"), *keys, F.col(value).cast("double").alias("v"))
    groups = checkpointed(rows.groupBy("g", *keys).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high")))
    wanted = groups.select("g", "n", "low", "high", F.explode(F.array(*(p.cast("long") for p in places))).alias("place")).distinct()
    found = values_at(rows.select("g", "v"), wanted, limit, marks).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("_at"))  # as many as places
    return groups.join(found, "g").select(*keys, "n", "mean", "low", "high", F.array(*(F.element_at("_at", p.cast("long")) for p in places)).alias("values"))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], limit: int = LIMIT, marks: int = MARKS) -> DataFrame:
    """keys, n, mean, low, high and q: quantiles between neighbouring values, linearly."""
    of = [(F.col("n") - 1) * F.lit(float(s)) for s in shares]
    got = at_places(rows, keys, value, [p for s in of for p in (F.floor(s), F.ceil(s))], limit, marks)
    v = F.col("values")
    return got.withColumn("q", F.array(*(v[2 * k] + (v[2 * k + 1] - v[2 * k]) * (s - F.floor(s)) for k, s in enumerate(of)))).drop("values")
