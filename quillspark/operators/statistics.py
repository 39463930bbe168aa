"""Agreement and significance statistics over counted pairs and small blocks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Z95 = 1.959963984540054


def kappa(cells: DataFrame) -> DataFrame:
    """Agreement and Cohen's kappa from counts n of marks (a, b); 1 if there are fewer than two marks or chance is certain."""
    n = F.sum("n")
    both = cells.select(F.explode(F.array(F.struct(F.col("a").alias("k"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("nb")), F.struct(F.col("b").alias("k"), F.lit(0).cast("bigint").alias("na"), F.col("n").alias("nb")))).alias("x"))
    chance = both.groupBy("x.k").agg((F.sum("x.na") * F.sum("x.nb")).cast("double").alias("m"), F.sum("x.na").alias("na")).agg((F.sum("m") / (F.sum("na") * F.sum("na"))).alias("pe"), F.count("*").alias("labels"))
    seen = cells.agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)) / n).alias("po"))
    value = F.when((F.col("labels") < 2) | (F.col("pe") >= 1), 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return seen.withColumn("j", F.lit(1)).join(chance.withColumn("j", F.lit(1)), "j").select(F.round("po", 6).alias("agreement"), F.round(value, 6).alias("kappa"))


def ordinal_agreement(cells: DataFrame) -> DataFrame:
    """Exact and within-one agreement, quadratic weighted kappa and Pearson r from counts of marks, by moments."""
    n = F.sum("n").cast("double")
    total = lambda c: F.sum(c * F.col("n")).cast("double")
    a, b = F.col("a"), F.col("b")
    m = cells.agg(n.alias("n"), total((a == b).cast("int")).alias("e"), total((F.abs(a - b) <= 1).cast("int")).alias("w"), *[total(x).alias(k) for k, x in (("sa", a), ("sb", b), ("saa", a * a), ("sbb", b * b), ("sab", a * b))])
    seen = F.col("saa") + F.col("sbb") - 2 * F.col("sab")
    chance = F.col("saa") + F.col("sbb") - 2 * F.col("sa") * F.col("sb") / F.col("n")
    cov, va, vb = (F.col(x) - F.col(y) * F.col(z) / F.col("n") for x, y, z in (("sab", "sa", "sb"), ("saa", "sa", "sa"), ("sbb", "sb", "sb")))
    return m.select(F.round(F.col("e") / F.col("n"), 6).alias("exact"), F.round(F.col("w") / F.col("n"), 6).alias("within1"), F.round(1 - seen / chance, 6).alias("qwk"), F.round(cov / F.sqrt(va * vb), 6).alias("pearson"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k out of n."""
    p = k / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def mcnemar(rows: DataFrame, first_only: Column, second_only: Column) -> DataFrame:
    """Discordant counts and the continuity-corrected statistic."""
    c = rows.agg(F.count_if(first_only).alias("b"), F.count_if(second_only).alias("c"))
    both = F.col("b") + F.col("c")
    return c.withColumn("chi2", F.round(F.when(both == 0, 0.0).otherwise(F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / both), 6))


def holm(tests: DataFrame, name: str, p: str) -> DataFrame:
    """Step-down adjusted p-values; the window orders one row a test."""
    order = Window.orderBy(p, name)
    m = F.count("*").over(Window.partitionBy())
    ranked = tests.withColumn("_q", (m - F.row_number().over(order) + 1) * F.col(p))
    run = F.max("_q").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.select(name, F.round(p, 6).alias(p), F.round(F.least(F.lit(1.0), run), 6).alias("p_holm"))


def cliffs_delta(rows: DataFrame, first: str, x: str) -> DataFrame:
    """Cliff's delta by counts of each value, without pairs: a running sum over distinct values."""
    by = rows.groupBy(x).agg(F.count_if(F.col(first)).alias("na"), F.count_if(~F.col(first)).alias("nb"))
    below = Window.orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    wins = by.select("na", "nb", (F.col("na") * F.coalesce(F.sum("nb").over(below), F.lit(0))).alias("more"), (F.col("nb") * F.coalesce(F.sum("na").over(below), F.lit(0))).alias("less"))
    return wins.agg(F.round((F.sum("more") - F.sum("less")) / (F.sum("na") * F.sum("nb")), 6).alias("delta"))


def _mean_rank(block: str | None, value: str) -> Column:
    """Rank within a block, equal values sharing the mean of theirs."""
    w = Window.partitionBy(*([block] if block else []))
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*([block] if block else []), value)) - 1) / 2


def chi2_survival(x: Column, df: int) -> Column:
    """P(chi-square > x): a closed form for an even number of degrees of freedom, and with the normal tail for an odd one."""
    half = x / 2
    if df % 2 == 0:
        start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
        add = lambda acc, i: F.struct((acc["t"] * half / i).alias("t"), (acc["s"] + acc["t"] * half / i).alias("s"))
        total = F.aggregate(F.sequence(F.lit(1), F.lit(df // 2 - 1)), start, add, lambda acc: acc["s"]) if df > 2 else F.lit(1.0)
        return F.exp(-half) * total
    term, total = F.sqrt(2 * x / math.pi) * F.exp(-half), F.lit(0.0)
    for i in range((df - 1) // 2):
        total, term = total + term, term * x / (2 * i + 3)
    return normal_two_sided(F.sqrt(x)) + total


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| > z) of a standard normal; for one row a test."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")


def friedman(cells: DataFrame, levels: int) -> DataFrame:
    """Friedman's chi-square with mean ranks and tie correction, its p-value, and Kendall's W, over blocks that have all levels."""
    w = Window.partitionBy("block")
    ranks = cells.withColumn("k", F.count("*").over(w)).where(F.col("k") == levels).withColumn("r", _mean_rank("block", "v"))
    ties = F.count("*").over(Window.partitionBy("block", "v"))  # summed over the t members of a group, t * t - 1 is its t ** 3 - t
    sums = ranks.withColumn("tie", ties * ties - 1).groupBy("level").agg(F.sum("r").alias("rs"), F.count("*").alias("n"), F.sum("tie").alias("tie"))
    t = sums.agg(F.max("n").alias("n"), F.sum(F.col("rs") * F.col("rs")).alias("sq"), F.sum("tie").alias("tie"))
    n = F.col("n").cast("double")
    plain = 12 / (n * levels * (levels + 1)) * F.col("sq") - 3 * n * (levels + 1)
    left = 1 - F.col("tie") / (n * levels * (levels * levels - 1))
    out = t.withColumn("chi", F.when(left > 0, plain / left).otherwise(0.0))
    return out.select(F.col("n").alias("n_blocks"), F.round("chi", 6).alias("chi2"), F.round(chi2_survival(F.col("chi"), levels - 1), 6).alias("p"), F.round(F.col("chi") / (n * (levels - 1)), 6).alias("kendall_w"))


def wilcoxon(pairs: DataFrame, a: str, b: str, digits: int | None = 9) -> DataFrame:
    """Signed-rank statistic without zero differences, z with tie correction (no continuity correction) and n; z is null and
    the pairs are equal where no difference is left. Differences count as equal to so many digits; None: bit by bit."""
    d = F.col(a) - F.col(b)
    d = pairs.select((d if digits is None else F.round(d, digits)).alias("d")).where("d <> 0")
    by = d.groupBy(F.abs("d").alias("m")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by.withColumn("r", before + (F.col("t") + 1) / 2)
    t = ranked.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.sum(F.col("r") * F.col("up")).alias("w"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    stat = F.least(F.col("w"), n * (n + 1) / 2 - F.col("w"))
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return t.select("n", F.coalesce(stat, F.lit(0.0)).alias("statistic"), F.when(spread > 0, (stat - n * (n + 1) / 4) / spread).alias("z"))


def exact_mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact p-value of discordant counts, summed in logarithms."""
    n, k = b + c, F.least(b, c)
    start = F.struct((-n * math.log(2)).alias("l"), F.exp(-n * math.log(2)).alias("s"))
    step = lambda acc, i: F.struct((acc["l"] + F.log((n - i + 1) / i)).alias("l"), (acc["s"] + F.exp(acc["l"] + F.log((n - i + 1) / i))).alias("s"))
    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>")), start, step, lambda acc: acc["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def binomial_test(k: Column, n: Column, p: float) -> Column:
    """Two-sided p-value: the outcomes that are no likelier than k (within 1e-7), summed."""
    logs = F.aggregate(
        F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"))).otherwise(F.array().cast("array<bigint>")), F.array(n * math.log(1 - p)),
        lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + F.log((n - i + 1) / i) + math.log(p / (1 - p)))),
    )
    own = F.element_at(logs, (k + 1).cast("int"))
    return F.least(F.lit(1.0), F.aggregate(logs, F.lit(0.0), lambda acc, x: acc + F.when(x <= own + 1e-7, F.exp(x)).otherwise(0.0)))


def _uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a digest of the parts: the same in any engine."""
    return F.conv(F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(8)), 16, 10).cast("bigint") / F.lit(4294967296.0)


#: P(Poisson(1) <= k) for k = 0, 1 ...
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]


def _weight(*parts: Column | str) -> Column:
    """A Poisson(1) weight from a digest."""
    u = _uniform(*parts)
    return sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0))


def nearest_rank(replicates: DataFrame, value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """low and high: the values at places round((n - 1) p), halves to even, of the sorted replicates."""
    ordered = replicates.select(value, (F.row_number().over(Window.orderBy(value)) - 1).alias("i"), (F.count("*").over(Window.partitionBy()) - 1).alias("last"))
    at = lambda p: F.max(F.when(F.col("i") == F.bround(F.col("last") * p), F.col(value)))
    return ordered.agg(at(low).alias("low"), at(high).alias("high"))


def bootstrap_mean(rows: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """Mean and 95 % interval (nearest ranks) by a Poisson(1) bootstrap whose weights are digests of id and replicate."""
    drawn = rows.select("id", "x", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    drawn = drawn.withColumn("w", _weight(F.lit(str(seed)), F.col("id").cast("string"), F.col("rep").cast("string")))
    means = drawn.groupBy("rep").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    return rows.agg(F.count("x").alias("n"), F.avg("x").alias("mean")).join(nearest_rank(means, "m"), F.lit(True))


def paired_median_ci(pairs: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """Median of paired differences d, numbered i = 0 .. n - 1, and its 95 % interval (linear percentiles) over resamples of n.
    For the few blocks of a study: a resample is one group."""
    n = pairs.agg(F.count("*").alias("n"))
    draws = n.select(F.col("n"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).select("rep", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("j"))
    picked = draws.withColumn("i", F.floor(_uniform(F.lit(str(seed)), F.col("rep").cast("string"), F.col("j").cast("string")) * F.col("n")))
    medians = picked.join(F.broadcast(pairs), "i").groupBy("rep").agg(F.median("d").alias("m"))
    spread = medians.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return pairs.agg(F.median("d").alias("median")).join(spread, F.lit(True))


def cluster_bootstrap(rows: DataFrame, cluster: str, a: str, b: str, replicates: int, seed: int = 42) -> DataFrame:
    """Mean paired difference and its 95 % interval when whole clusters are drawn: rows are summed by cluster first."""
    sums = rows.groupBy(cluster).agg(F.sum(F.col(a) - F.col(b)).alias("d"), F.count("*").alias("n"))
    drawn = sums.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).withColumn("w", _weight(F.lit(str(seed)), F.col(cluster).cast("string"), F.col("rep").cast("string")))
    means = drawn.groupBy("rep").agg((F.sum(F.col("w") * F.col("d")) / F.sum(F.col("w") * F.col("n"))).alias("m")).where("m is not null")
    return sums.agg((F.sum("d") / F.sum("n")).alias("delta"), F.count("*").alias("clusters")).join(nearest_rank(means, "m"), F.lit(True))
