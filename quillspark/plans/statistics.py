"""Queries of agreement and significance statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import statistics as S
from quillspark.plans.registry import query
from quillspark.sources.tables import table

PAIRS_SQL = "p AS (SELECT CASE WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 25 THEN 2 WHEN l_quantity < 40 THEN 3 ELSE 4 END AS a, CASE WHEN l_quantity + l_linenumber < 11 THEN 1 WHEN l_quantity + l_linenumber < 28 THEN 2 WHEN l_quantity + l_linenumber < 41 THEN 3 ELSE 4 END AS b FROM lineitem)"


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters' marks from 1 to 4, counted: a table of at most 16 rows."""
    q, s = F.col("l_quantity"), F.col("l_quantity") + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.when(q < 10, 1).when(q < 25, 2).when(q < 40, 3).otherwise(4).alias("a"), F.when(s < 11, 1).when(s < 28, 2).when(s < 41, 3).otherwise(4).alias("b"))
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"))


@query("cohen_kappa", f"""WITH {PAIRS_SQL}, t AS (SELECT count(*)::DOUBLE AS n FROM p), o AS (SELECT count(CASE WHEN a = b THEN 1 END) / (SELECT n FROM t) AS po FROM p),
    e AS (SELECT sum(x.c * y.c) / ((SELECT n FROM t) * (SELECT n FROM t)) AS pe FROM (SELECT a AS k, count(*) AS c FROM p GROUP BY a) x JOIN (SELECT b AS k, count(*) AS c FROM p GROUP BY b) y USING (k))
    SELECT round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM o, e""")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.kappa(rated(spark, sf_dir))


@query("exact_within1_qwk", f"""WITH {PAIRS_SQL}, n AS (SELECT count(*)::DOUBLE AS n FROM p), ma AS (SELECT a, count(*) AS c FROM p GROUP BY a), mb AS (SELECT b, count(*) AS c FROM p GROUP BY b),
    e AS (SELECT sum(ma.c * mb.c * (a - b) * (a - b)) / (SELECT n FROM n) AS d FROM ma, mb)
    SELECT round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END), 6) AS exact, round(avg(CASE WHEN abs(a - b) <= 1 THEN 1.0 ELSE 0 END), 6) AS within1, round(1 - sum((a - b) * (a - b)) / (SELECT d FROM e), 6) AS qwk, round(corr(a, b), 6) AS pearson FROM p""")
def exact_within1_qwk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ordinal_agreement(rated(spark, sf_dir))


@query("wilson_ci", """WITH c AS (SELECT toxic, count(*)::DOUBLE AS n, count(CASE WHEN quality = 1 THEN 1 END)::DOUBLE AS k FROM labels GROUP BY toxic), z AS (SELECT toxic, n, k, k / n AS p, 1.959963984540054 AS z FROM c)
    SELECT toxic, CAST(n AS BIGINT) AS n, round(p, 6) AS p, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM z""")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "labels").groupBy("toxic").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return c.select("toxic", "n", F.round(F.col("k") / F.col("n"), 6).alias("p"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("mcnemar_counts", """WITH c AS (SELECT CAST(count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS BIGINT) AS b, CAST(count(CASE WHEN quality = 0 AND toxic = 1 THEN 1 END) AS BIGINT) AS c FROM labels) SELECT b, c, round(CASE WHEN b + c = 0 THEN 0 ELSE power(abs(b - c) - 1, 2) / (b + c)::DOUBLE END, 6) AS chi2 FROM c""")
def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return S.mcnemar(table(spark, sf_dir, "labels"), q & ~t, ~q & t)


@query("holm_adjust", """WITH p AS (SELECT n_name, (n_nationkey + 1) * (n_nationkey % 7 + 1) / 2000.0::DOUBLE AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p, n_name) AS i, count(*) OVER () AS m FROM p)
    SELECT n_name, round(p, 6) AS p, round(least(1, max((m - i + 1) * p) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM r""")
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("n_nationkey") + 1) * (F.col("n_nationkey") % 7 + 1) / F.lit(2000.0)
    return S.holm(table(spark, sf_dir, "nation").select("n_name", p.alias("p")), "n_name", "p")


@query("cliffs_delta", """WITH a AS (SELECT round(s_acctbal) AS x FROM supplier WHERE s_suppkey % 2 = 0), b AS (SELECT round(s_acctbal) AS x FROM supplier WHERE s_suppkey % 2 = 1)
    SELECT round(sum(CASE WHEN a.x > b.x THEN 1 WHEN a.x < b.x THEN -1 ELSE 0 END) / count(*)::DOUBLE, 6) AS delta FROM a, b""")
def cliffs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 2 == 0).alias("first"), F.round("s_acctbal").alias("x"))
    return S.cliffs_delta(rows, "first", "x")


# prices are rounded to ten thousands, so that there are ties
@query("friedman_stat", """WITH c AS (SELECT o_custkey AS block, o_orderpriority AS level, round(avg(o_totalprice) / 50000) AS v FROM orders GROUP BY 1, 2), f AS (SELECT block FROM c GROUP BY block HAVING count(*) = 5), k AS (SELECT c.* FROM c SEMI JOIN f USING (block)),
    r AS (SELECT x.block, x.level, count(CASE WHEN y.v < x.v THEN 1 END) + (count(CASE WHEN y.v = x.v THEN 1 END) + 1) / 2.0 AS r FROM k x JOIN k y USING (block) GROUP BY ALL), s AS (SELECT sum(rs * rs) AS sq FROM (SELECT sum(r) AS rs FROM r GROUP BY level)),
    t AS (SELECT coalesce(sum(t * t * t - t), 0) AS ties FROM (SELECT count(*) AS t FROM k GROUP BY block, v)), n AS (SELECT count(DISTINCT block)::DOUBLE AS n FROM k),
    x AS (SELECT n, (12 / (n * 30) * sq - 18 * n) / (1 - ties / (n * 120)) AS chi FROM s, t, n) SELECT CAST(n AS BIGINT) AS n_blocks, round(chi, 6) AS chi2, round(exp(-chi / 2) * (1 + chi / 2), 6) AS p, round(chi / (n * 4), 6) AS kendall_w FROM x""")
def friedman_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("block"), F.col("o_orderpriority").alias("level")).agg(F.round(F.avg("o_totalprice") / 50000).alias("v"))
    return S.friedman(cells, 5)


PAIRED_SQL = "p AS (SELECT s_suppkey, round(s_acctbal / 500) AS a, round((s_acctbal + s_nationkey * 40 - 500) / 500) AS b FROM supplier)"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") / 500).alias("a"), F.round((F.col("s_acctbal") + F.col("s_nationkey") * 40 - 500) / 500).alias("b"))


@query("wilcoxon_signed", f"""WITH {PAIRED_SQL}, d AS (SELECT a - b AS d FROM p WHERE a <> b), r AS (SELECT x.d, (SELECT count(*) FROM d y WHERE abs(y.d) < abs(x.d)) + ((SELECT count(*) FROM d y WHERE abs(y.d) = abs(x.d)) + 1) / 2.0 AS r FROM d x),
    w AS (SELECT count(*)::DOUBLE AS n, coalesce(sum(CASE WHEN d > 0 THEN r END), 0) AS up, coalesce(sum(CASE WHEN d < 0 THEN r END), 0) AS down FROM r), t AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*) AS t FROM d GROUP BY abs(d)))
    SELECT CAST(n AS BIGINT) AS n, least(up, down)::DOUBLE AS statistic, round((least(up, down) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM w, t""")
def wilcoxon_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.wilcoxon(paired(spark, sf_dir), "a", "b").withColumn("z", F.round("z", 6))


@query("exact_tests", """WITH c AS (SELECT n_nationkey AS k, n_nationkey % 9 AS b, n_nationkey % 5 + n_nationkey // 6 AS c FROM nation), f AS (SELECT k, b, c, least(b, c) AS m, b + c AS n FROM c)
    SELECT k, CAST(b AS INTEGER) AS b, CAST(c AS INTEGER) AS c, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, m + 1), lambda i: factorial(CAST(n AS INTEGER)) / (factorial(CAST(i AS INTEGER)) * factorial(CAST(n - i AS INTEGER)))::DOUBLE)) / power(2, n)) END, 6)::DOUBLE AS mcnemar_p,
    round(CASE WHEN n = 0 THEN 1.0 ELSE list_sum(list_filter(list_transform(range(0, n + 1), lambda i: factorial(CAST(n AS INTEGER)) / (factorial(CAST(i AS INTEGER)) * factorial(CAST(n - i AS INTEGER)))::DOUBLE * power(0.25, i) * power(0.75, n - i)),
      lambda x: x <= 1.0000001 * (factorial(CAST(n AS INTEGER)) / (factorial(CAST(b AS INTEGER)) * factorial(CAST(n - b AS INTEGER)))::DOUBLE * power(0.25, b) * power(0.75, n - b)))) END, 6)::DOUBLE AS binomial_p FROM f""")
def exact_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(k.cast("int").alias("k"), (k % 9).cast("int").alias("b"), (k % 5 + F.floor(k / 6)).cast("int").alias("c"))
    return rows.select("k", "b", "c", F.round(S.exact_mcnemar(F.col("b"), F.col("c")), 6).alias("mcnemar_p"), F.round(S.binomial_test(F.col("b"), F.col("b") + F.col("c"), 0.25), 6).alias("binomial_p"))


UNIFORM_SQL = "CAST('0x' || substr(sha256({}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
WEIGHT_SQL = "(" + " + ".join(f"CASE WHEN u >= {c} THEN 1 ELSE 0 END" for c in S.POISSON) + ")"
RANKS_SQL = "o AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS i, count(*) OVER () - 1 AS k FROM {}), q AS (SELECT max(CASE WHEN i = round_even(k * 0.025, 0) THEN m END) AS low, max(CASE WHEN i = round_even(k * 0.975, 0) THEN m END) AS high FROM o)"


@query("bootstrap_mean_ci", f"""WITH d AS (SELECT rep, c_acctbal AS x, {UNIFORM_SQL.format("'42|' || c_custkey || '|' || rep")} AS u FROM customer, range(1, 201) r(rep)), w AS (SELECT rep, x, {WEIGHT_SQL} AS w FROM d), b AS (SELECT rep, sum(w * x) / sum(w) AS m FROM w GROUP BY rep), {RANKS_SQL.format('b')}
    SELECT (SELECT count(*) FROM customer) AS n, round((SELECT avg(c_acctbal) FROM customer), 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM q""")
def bootstrap_mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poisson bootstrap of the mean account balance, seeded by digests: no random state, any partitioning."""
    out = S.bootstrap_mean(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x")), replicates=200)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query("paired_median_ci", f"""WITH {PAIRED_SQL}, d AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, a - b AS d FROM p WHERE s_suppkey <= 14), n AS (SELECT count(*) AS n FROM d), g AS (SELECT rep, CAST(floor({UNIFORM_SQL.format("'7|' || rep || '|' || j")} * n) AS BIGINT) AS i FROM n, range(1, 301) r(rep), (SELECT unnest(range(1, n + 1)) AS j FROM n)),
    b AS (SELECT rep, quantile_cont(d, 0.5) AS m FROM g JOIN d USING (i) GROUP BY rep) SELECT (SELECT quantile_cont(d, 0.5) FROM d)::DOUBLE AS median, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM b""")
def paired_median_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = paired(spark, sf_dir).where("s_suppkey <= 14").select((F.row_number().over(Window.orderBy("s_suppkey")) - 1).cast("bigint").alias("i"), (F.col("a") - F.col("b")).alias("d"))
    return S.paired_median_ci(d, 300, 7).select("median", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("cluster_bootstrap", f"""WITH s AS (SELECT o_custkey AS c, sum(CAST(o_orderkey % 4 = 0 AS INT) - CAST(o_orderkey % 5 = 0 AS INT)) AS d, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT rep, d, n, {UNIFORM_SQL.format("'42|' || c || '|' || rep")} AS u FROM s, range(1, 101) r(rep)), w AS (SELECT rep, d, n, {WEIGHT_SQL} AS w FROM g),
    b AS (SELECT rep, sum(w * d) / sum(w * n)::DOUBLE AS m FROM w GROUP BY rep), {RANKS_SQL.format('b')} SELECT (SELECT count(*) FROM s) AS clusters, round((SELECT sum(d) / sum(n)::DOUBLE FROM s), 6) AS delta, round(low, 6) AS low, round(high, 6) AS high FROM q""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", (k % 4 == 0).cast("int").alias("a"), (k % 5 == 0).cast("int").alias("b"))
    return S.cluster_bootstrap(rows, "o_custkey", "a", "b", 100).select("clusters", *[F.round(c, 6).alias(c) for c in ("delta", "low", "high")])


@query("block_composites", "WITH c AS (SELECT l_orderkey AS cell, avg(l_quantity) AS q, avg(l_discount) AS d, count(DISTINCT l_returnflag) AS judges FROM lineitem GROUP BY 1) SELECT cell, round((q + d) / 2, 6) AS composite FROM c WHERE judges = 2")
def block_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the dimensions of every cell that two judges marked."""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cell")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.count_distinct("l_returnflag").alias("judges"))
    return cells.where("judges = 2").select("cell", F.round((F.col("q") + F.col("d")) / 2, 6).alias("composite"))


@query("complete_blocks", "SELECT o_custkey AS block, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS cells FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 5")
def complete_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("block"), "o_orderpriority").distinct()
    return cells.groupBy("block").agg(F.count("*").alias("cells")).where("cells = 5")


@query("funnel_ratio", """WITH c AS (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT year(d) AS y, sum(n) AS n FROM c GROUP BY 1)
    SELECT y, CAST(n AS BIGINT) AS n, round(n / lag(n) OVER (ORDER BY y)::DOUBLE, 6) AS step FROM m""")
def funnel_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("bigint").alias("y")).agg(F.count("*").alias("n"))
    return years.select("y", "n", F.round(F.col("n") / F.lag("n").over(Window.orderBy("y")), 6).alias("step"))
