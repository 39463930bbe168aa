"""Statistics against published values of small studies, and against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import statistics as S

# marks of 14 blocks at three levels, with the published results
DEPTH = (
    [1.1667, 1, 1, 1, 1.1667, 1.5, 1.5, 2.1667, 1.8333, 1.1667, 1, 1.3333, 1.8333, 1.6667],
    [1.5, 1.3333, 1, 1, 1.3333, 1.5, 1.3333, 1.8333, 1.8333, 1.5, 1, 1.1667, 2.1667, 1.1667],
    [1.3333, 1.5, 1.3333, 1.5, 1.1667, 1.8333, 1.6667, 2.1667, 1, 1.5, 1.3333, 1.3333, 2.6667, 1.6667],
)


def test_friedman_with_ties(spark):
    rows = [(i, str(k), float(v)) for k, values in enumerate(DEPTH) for i, v in enumerate(values)]
    r = S.friedman(spark.createDataFrame(rows, "block int, level string, v double"), 3).first()
    assert (r.n_blocks, r.chi2, r.p, r.kendall_w) == (14, pytest.approx(7.434783, abs=1e-6), pytest.approx(0.024297, abs=1e-6), pytest.approx(0.265528, abs=1e-6))


@pytest.mark.parametrize(("a", "b", "statistic", "p"), [(0, 1, 19.5, 0.7172451837847029), (0, 2, 9.5, 0.06442954657983999), (1, 2, 18.0, 0.053444577319817915)])
def test_wilcoxon_with_ties(spark, a, b, statistic, p):
    pairs = spark.createDataFrame([(round(x * 6) / 6, round(y * 6) / 6) for x, y in zip(DEPTH[a], DEPTH[b])], "a double, b double").select("a", "b")
    r = S.wilcoxon(pairs, "a", "b", digits=None).first()
    assert r.statistic == statistic and math.erfc(abs(r.z) / math.sqrt(2)) == pytest.approx(p, abs=1e-6)
    same = S.wilcoxon(pairs.select("a", F.col("a").alias("b")), "a", "b").first()
    assert same.n == 0 and same.statistic == 0 and same.z is None


def test_exact_p_values(spark):
    r = spark.range(1).select(S.exact_mcnemar(F.lit(7), F.lit(1)).alias("a"), S.exact_mcnemar(F.lit(5), F.lit(3)).alias("b"), S.exact_mcnemar(F.lit(0), F.lit(0)).alias("c"), S.exact_mcnemar(F.lit(4000), F.lit(4000)).alias("d"), S.binomial_test(F.lit(21), F.lit(24), 0.25).alias("e")).first()
    assert r.a == pytest.approx(0.0703125) and r.b == pytest.approx(0.7266, abs=1e-4) and r.c == 1.0 and r.d == pytest.approx(1.0) and r.e < 1e-9
    assert spark.range(1).select(S.chi2_survival(F.lit(3.0), 1), S.chi2_survival(F.lit(3.0), 3), S.chi2_survival(F.lit(3.0), 6)).first()[:] == pytest.approx((0.0832645, 0.3916252, 0.8088468), abs=1e-6)


def test_nearest_ranks(spark):
    rng = random.Random(4)
    values = [rng.random() for _ in range(200)]
    r = S.nearest_rank(spark.createDataFrame([(v,) for v in values], "m double"), "m").first()
    values.sort()
    assert (r.low, r.high) == (values[round(199 * 0.025)], values[round(199 * 0.975)])
