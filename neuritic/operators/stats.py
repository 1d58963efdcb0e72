"""Paired tests, resampling and leaderboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_share


def method_pairs(scores: DataFrame, value: str = "f1") -> DataFrame:
    """a, b, file_name, d: differences of two methods on the files that both have, each pair of methods once."""
    x = scores.select(F.col("method").alias("a"), "file_name", F.col(value).alias("va"))
    y = scores.select(F.col("method").alias("b"), "file_name", F.col(value).alias("vb"))
    return x.join(y, "file_name").filter("a < b").select("a", "b", "file_name", (F.col("va") - F.col("vb")).alias("d"))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """a, b: pairs, wins, losses, ties, mean and median difference, rank sums w_plus and w_minus, z, p and p_bonferroni.

    Zero differences take no part in the ranks, equal ones share theirs. p is exact for up to EXACT pairs without zeros or equal sizes, beyond that
    that of the normal approximation with the correction for ties; 1 if all differences are zero. Equal sizes are counted
    before they are ranked.
    """
    base = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"), F.avg("d").alias("mean_diff"), F.percentile("d", 0.5).alias("median_diff"))
    sizes = pairs.filter("d != 0").groupBy("a", "b", F.abs("d").alias("s")).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("d") > 0).alias("up"))
    w = Window.partitionBy("a", "b").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sizes.withColumn("rank", F.sum("k").over(w) - (F.col("k") - 1) / 2)
    sums = ranked.groupBy("a", "b").agg(F.sum("k").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("k") - F.col("up"))).alias("w_minus"), F.sum(F.col("k") * F.col("k") * F.col("k") - F.col("k")).alias("t"), F.max("k").alias("most"))
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48)
    sums = sums.withColumn("z", F.when(spread > 0, (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / spread).otherwise(0.0))

    out = base.join(sums.select("a", "b", "w_plus", "w_minus", "z", "n", "most"), ["a", "b"], "left").na.fill(0.0, ["w_plus", "w_minus", "z"])
    m = F.count(F.lit(1)).over(Window.partitionBy())  # a row for each pair of methods
    exact = (F.col("ties") == 0) & (F.col("most") == 1) & (F.col("n") <= EXACT)
    p = F.when(exact, signed_rank(F.when(exact, F.col("n")).otherwise(1).cast("int"), F.least("w_plus", "w_minus"))).otherwise(two_sided(F.col("z")))
    return out.withColumn("p_value", p).drop("n", "most").withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p_value") * m))


#: Pairs up to which p values of signed ranks are exact.
EXACT = 50


def signed_rank(n: Column, w: Column) -> Column:
    """Probability that the smaller of two sums of the signed ranks 1 to n is at most w: twice the share of all sets of ranks
    with a sum up to w. Sets are counted by their sum, a rank at a time; up to 2^50 of them, so counts are exact."""
    top = (n * (n + 1) / 2).cast("int")
    none = F.transform(F.sequence(F.lit(0), top), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    counts = F.aggregate(F.sequence(F.lit(1), n), none, lambda c, r: F.transform(c, lambda v, s: v + F.when(s >= r, F.get(c, s - r)).otherwise(0.0)))
    up_to = F.aggregate(F.slice(counts, 1, F.floor(w).cast("int") + 1), F.lit(0.0), lambda a, v: a + v)
    return F.least(F.lit(1.0), up_to * 2 / F.pow(F.lit(2.0), n))


def two_sided(z: Column, terms: int = 60) -> Column:
    """Probability that a standard normal number is at least as far from 0 as z: the series of the error function below 3,
    its continued fraction above."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    # erf(x) = 2 / sqrt(pi) * exp(-x^2) * sum of 2^k x^(2k+1) / (1 * 3 * ... (2k+1))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(x.alias("term"), x.alias("sum")), lambda a, k: F.struct((a["term"] * 2 * x * x / (2 * k + 1)).alias("term"), (a["sum"] + a["term"] * 2 * x * x / (2 * k + 1)).alias("sum")))["sum"]
    near = 1 - 1.1283791670955126 * F.exp(-x * x) * series
    fraction = F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), x, lambda a, k: x + (k / 2.0) / a)
    far = F.exp(-x * x) / (fraction * 1.7724538509055159)
    return F.when(x < 2, near).otherwise(far)


# Shares of a Poisson distribution with mean 1 up to 0, 1, 2 ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020)


def bootstrap(scores: DataFrame, keys: list[str], value: str = "f1", resamples: int = 1000, seed: int = 42) -> DataFrame:
    """keys, statistic (mean, median, p10), value, and its 2.5th and 97.5th percentile and deviation over resamples of the files.

    Each file draws how often it is in each resample from a Poisson distribution with mean 1 (the bootstrap for data that is
    spread over machines), by a hash of seed, resample and file, so files never meet and reruns agree.
    """
    rows = scores.select(*keys, "file_name", F.col(value).cast("double").alias("v")).dropna()
    # a table of scores is often one small file, which one task would read and draw for
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drawn = rows.repartition(tasks, "file_name").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    # one hash a draw: k names u nine times, so the optimizer leaves u a column of its own
    drawn = drawn.withColumn("u", hash_share(F.concat_ws(":", "r", "file_name"), seed))
    drawn = drawn.withColumn("k", reduce(Column.__add__, ((F.col("u") >= p).cast("int") for p in POISSON)))
    # equal values are drawn together, so what follows is as long as the values of a resample that differ
    drawn = drawn.groupBy(*keys, "r", "v").agg(F.sum("k").alias("k")).filter("k > 0")
    p = F.percentile("v", F.array(F.lit(0.5), F.lit(0.1)), F.col("k"))
    one = drawn.groupBy(*keys, "r").agg((F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"), p.alias("p"))

    def long(df: DataFrame, *more: str) -> DataFrame:
        parts = F.array(*(F.struct(F.lit(n).alias("statistic"), c.alias("v")) for n, c in (("mean", F.col("mean")), ("median", F.col("p")[0]), ("p10", F.col("p")[1]))))
        return df.select(*keys, *more, F.explode(parts).alias("s")).select(*keys, *more, "s.statistic", "s.v")

    ci = long(one, "r").groupBy(*keys, "statistic").agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.stddev_samp("v").alias("std"))
    whole = long(rows.groupBy(*keys).agg(F.avg("v").alias("mean"), F.percentile("v", F.array(F.lit(0.5), F.lit(0.1))).alias("p")))
    return whole.join(ci, [*keys, "statistic"]).select(*keys, "statistic", F.col("v").alias("value"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "std")


def grid(spark: SparkSession, hidden: list[int], layers: list[int], dropout: list[float]) -> DataFrame:
    """All points of a grid of settings."""
    return spark.createDataFrame([(h, n, d) for h in hidden for n in layers for d in dropout], "hidden int, n_layers int, dropout double")


def leaderboard(folds: DataFrame, by: list[str], value: str) -> DataFrame:
    """Settings by their mean over folds, best first, with deviation and, if folds have an epoch, its median."""
    more = [F.percentile("epoch", 0.5).alias("median_epoch")] if "epoch" in folds.columns else []
    got = folds.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("folds"), *more)
    return got.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), *by)))  # a row for each setting


def timing(rows: DataFrame, keys: list[str], value: str = "elapsed_sec") -> DataFrame:
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    return rows.groupBy(*keys).agg(F.sum(value).alias("total"), p.alias("p"), F.max(value).alias("most")).select(*keys, "total", F.col("p")[0].alias("median"), F.col("p")[1].alias("p95"), "most")


#: Columns of the table of all results.
RESULT_COLUMNS = ("method", "source", "n_files", "accuracy", "macro_f1", "neurite_macro_f1", "median_f1", "p10_f1", "n_pairs", "mean_diff", "p_bonferroni", "mark")


def result_table(parts: list[DataFrame], tests: DataFrame, reference: str) -> DataFrame:
    """Rows of several results under twelve columns, null where a result lacks one, with the test against the reference
    method; `*` below 0.05. Differences are those of the row's method less the reference."""
    from ..sources.tables import union_manifests

    rows = union_manifests(parts)
    for c in RESULT_COLUMNS:
        if c not in rows.columns and c not in ("n_pairs", "mean_diff", "p_bonferroni", "mark"):
            rows = rows.withColumn(c, F.lit(None).cast("string" if c == "source" else "double"))
    one = tests.filter(F.col("a") == reference).select(F.col("b").alias("method"), "n_pairs", (-F.col("mean_diff")).alias("mean_diff"), "p_bonferroni")
    two = tests.filter(F.col("b") == reference).select(F.col("a").alias("method"), "n_pairs", "mean_diff", "p_bonferroni")
    out = rows.join(one.unionByName(two), "method", "left").withColumn("mark", F.when(F.col("p_bonferroni") < 0.05, "*").otherwise(""))
    return out.select(*RESULT_COLUMNS)
