import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import cost, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("k", "n", "low", "high"), [(5, 6, 0.4365, 0.9699), (6, 6, 0.6097, 1.0), (14021, 14034, 0.9984156612843686, 0.9994585518624151)])
def test_wilson(spark, k, n, low, high):
    a, b = stats.wilson(F.lit(k), F.lit(n))
    assert one(spark, a) == pytest.approx(low, abs=1e-4 if n < 10 else 1e-12)
    assert one(spark, b) == pytest.approx(high, abs=1e-4 if n < 10 else 1e-12)


def test_wilson_of_nothing_is_null(spark):
    assert one(spark, stats.wilson(F.lit(0), F.lit(0))[0]) is None


@pytest.mark.parametrize(("b", "c", "p"), [(6, 0, 0.03125), (0, 0, 1.0), (2868, 2703, 0.027994410760450086), (42, 7, 3.6245783263666453e-07)])
def test_mcnemar(spark, b, c, p):
    assert one(spark, stats.mcnemar_exact(F.lit(b), F.lit(c))) == pytest.approx(p, rel=1e-10)


def test_mcnemar_against_integers(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)]
    got = spark.createDataFrame(rows, "b int, c int").select("b", "c", stats.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()
    for r in got:
        n = r["b"] + r["c"]
        want = 1.0 if not n else min(1.0, 2 * sum(math.comb(n, k) for k in range(min(r["b"], r["c"]) + 1)) / 2**n)
        assert r["p"] == pytest.approx(want, rel=1e-10)


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "id string, p double")
    assert {r["id"]: round(r["holm_p_value"], 12) for r in stats.with_holm(df, "p", ["id"]).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_rank_leaves_null_unranked(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 1.0), ("d", None)], "id string, v double")
    assert {r["id"]: r["r"] for r in df.select("id", stats.rank_present(F.col("v")).alias("r")).collect()} == {"a": 1, "b": 1, "c": 3, "d": None}


def test_floor_quantile(spark):
    assert one(spark, stats.floor_quantile(F.array(*map(F.lit, [5, 1, 3, 2, 4])), 0.95)) == 4
    assert one(spark, stats.floor_quantile(F.array().cast("array<int>"), 0.95)) is None


def test_token_cost(spark):
    price = lambda p, c, o: one(spark, cost.token_cost(*(F.lit(x).cast("long") for x in (p, c, o)), F.lit(2.0), F.lit(0.5), F.lit(8.0)))
    assert price(1000, 200, 100) == pytest.approx((800 * 2 + 200 * 0.5 + 100 * 8) / 1e6)
    assert price(None, 0, 1) is None and price(10, 11, 1) is None and price(-1, 0, 1) is None
    assert price(10, None, 0) == pytest.approx(20 / 1e6)


def test_four_cost_totals(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("c", None)], "m string, v double")
    v, n = F.col("v"), F.count(F.lit(1))
    got = df.groupBy("m").agg(cost.complete_sum(v, n).alias("c"), cost.observed_sum(v).alias("o"), cost.filled_sum(v).alias("f")).orderBy("m").collect()
    assert [tuple(r) for r in got] == [("a", None, 1.0, 1.0), ("b", 2.0, 2.0, 2.0), ("c", None, None, 0.0)]


def test_mcnemar_of_many_cases(spark):
    """Few terms are summed, and they give what exact integers give."""
    from fractions import Fraction
    from math import comb

    pairs = [(0, 0), (1, 0), (300, 260), (5000, 4700), (9000, 9000), (20_000, 19_500), (3, 4000)]
    got = spark.createDataFrame(pairs, "b long, c long").select("b", "c", stats.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()
    for b, c, p in got:
        n, term, total = b + c, 1, 1
        for k in range(1, min(b, c) + 1):
            term = term * (n - k + 1) // k
            total += term
        assert term == comb(n, min(b, c)) and p == pytest.approx(min(1.0, float(Fraction(2 * total, 2**n))), rel=1e-9)
    huge = spark.createDataFrame([(500_000_000, 499_950_000)], "b long, c long").select(stats.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).first()["p"]
    assert huge == pytest.approx(0.1138, abs=0.002)  # z = 1.5811
