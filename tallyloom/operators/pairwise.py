"""Paired comparisons of models on the same cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import mcnemar_exact, ratio, with_holm


def _pairs(results: DataFrame, case: str, model: str) -> DataFrame:
    """Every case of every two models in order of name, from one grouping by case: models are few, cases many. Rows without a case or a model pair with none."""
    known = results.where("final_passed is not null and final_score is not null").where(F.col(case).isNotNull() & F.col(model).isNotNull())
    side = F.struct(F.col(model).alias("model"), F.col("final_passed").alias("passed"), F.col("final_score").cast("double").alias("score"))
    wide = known.groupBy(case).agg(F.array_sort(F.collect_list(side)).alias("s"))
    pairs = wide.select(F.posexplode("s").alias("k", "a"), "s").select("a", F.explode(F.expr("slice(s, k + 2, size(s))")).alias("b"))
    return pairs.select(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"), F.col("a.passed").alias("pa"), F.col("b.passed").alias("pb"), F.col("a.score").alias("sa"), F.col("b.score").alias("sb"))


def compare_models(results: DataFrame, case: str = "case_id", model: str = "model_name", alpha: float = 0.05) -> DataFrame:
    """Contingency counts, rates and their difference, exact McNemar p, Holm-adjusted p and the clear winner of each pair.

    A case counts for a pair if pass and score are known for both."""
    pa, pb = F.col("pa"), F.col("pb")
    out = _pairs(results, case, model).groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("paired_cases"), F.count_if(pa & pb).alias("both_passed"), F.count_if(pa & ~pb).alias("a_only_passed"), F.count_if(~pa & pb).alias("b_only_passed"),
        F.count_if(~pa & ~pb).alias("both_failed"), F.avg(F.col("sa") - F.col("sb")).alias("mean_score_difference"),
    )
    rate_a, rate_b = (ratio(F.col("both_passed") + F.col(c), F.col("paired_cases")) for c in ("a_only_passed", "b_only_passed"))
    out = out.withColumns({"pass_rate_a": rate_a, "pass_rate_b": rate_b, "pass_rate_difference": rate_a - rate_b, "p_value": mcnemar_exact(F.col("a_only_passed"), F.col("b_only_passed"))})
    out = with_holm(out, "p_value", ["model_a", "model_b"])
    winner = F.when(F.col("a_only_passed") > F.col("b_only_passed"), F.col("model_a")).when(F.col("a_only_passed") < F.col("b_only_passed"), F.col("model_b"))
    return out.withColumns({"significant": F.col("holm_p_value") < alpha, "clear_winner": F.when(F.col("holm_p_value") < alpha, winner)})


def net_wins(results: DataFrame, case: str = "case_id", model: str = "model_name") -> DataFrame:
    """Wins of either side and their net count."""
    pa, pb = F.col("pa"), F.col("pb")
    out = _pairs(results, case, model).groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("paired_cases"), F.count_if(pa & ~pb).alias("a_wins"), F.count_if(~pa & pb).alias("b_wins"))
    return out.withColumn("net_wins", F.col("a_wins") - F.col("b_wins"))


def incremental_cost(comparisons: DataFrame, overview: DataFrame) -> DataFrame:
    """Comparisons with both models' costs and the cost of one more pass, where the costlier one passes more.

    overview: (model_name, total_cost_usd), one row for each model."""
    cost = lambda side: overview.select(F.col("model_name").alias(f"model_{side}"), F.col("total_cost_usd").alias(f"cost_{side}"))
    out = comparisons.join(cost("a"), "model_a", "left").join(cost("b"), "model_b", "left")
    net = F.col("a_only_passed") - F.col("b_only_passed")
    extra = F.col("cost_a") - F.col("cost_b")
    return out.withColumns({"net_passes": net, "cost_difference_usd": extra, "cost_per_net_pass_usd": F.when(net * F.signum(extra) > 0, ratio(F.abs(extra), F.abs(net)))})
