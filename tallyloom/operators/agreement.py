"""Agreement of raters and judges: kappa, alpha, confusion, conditions, biases, gates and levels."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import ratio, wilson

#: Levels of judge validation, weakest first.
LEVELS = ["exploratory", "calibrated", "decision_grade", "publishable"]


def cohen_kappa(df: DataFrame, reference: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """n, observed and expected agreement, and kappa of nominal labels; null where chance alone agrees fully
    and the labels do not, 1 where both do."""
    by = by or []
    cells = df.where(F.col(reference).isNotNull() & F.col(predicted).isNotNull()).groupBy(*by, F.col(reference).alias("r"), F.col(predicted).alias("p")).count()
    total = cells.groupBy(*by).agg(F.sum("count").alias("n"), F.sum(F.when(F.col("r") == F.col("p"), F.col("count")).otherwise(0)).alias("same"))
    margins = cells.select(*by, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("r").alias("label")), F.struct(F.lit(1).alias("side"), F.col("p").alias("label")))).alias("x"), "count")
    margins = margins.groupBy(*by, "x.label").agg(F.sum(F.when(F.col("x.side") == 0, F.col("count")).otherwise(0)).alias("a"), F.sum(F.when(F.col("x.side") == 1, F.col("count")).otherwise(0)).alias("b"))
    chance = margins.groupBy(*by).agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    both = total.join(chance, by) if by else total.crossJoin(chance)
    observed, expected = ratio(F.col("same"), F.col("n")), ratio(F.col("ab"), F.col("n") * F.col("n"))
    kappa = F.when(expected < 1, (observed - expected) / (1 - expected)).when(observed == 1, 1.0)
    return both.select(*by, "n", observed.alias("observed_agreement"), expected.alias("expected_agreement"), kappa.alias("kappa"))


def _ratings(df: DataFrame, item: str, label: str, by: list[str]) -> DataFrame:
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, item, label).agg(F.count(F.lit(1)).alias("c"))
    of_item = W.partitionBy(*by, item)
    return counts.withColumn("n", F.sum("c").over(of_item)).where("n >= 2")


def krippendorff_alpha(df: DataFrame, item: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Nominal alpha of items with two ratings or more, however many raters each has; null without disagreement by chance."""
    by = by or []
    counts = _ratings(df, item, label, by)
    by_label = counts.groupBy(*by, label).agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1) / (F.col("n") - 1)).alias("o"))
    out = by_label.groupBy(*by).agg(F.sum("m").alias("ratings"), F.sum("o").alias("o"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    n = F.col("ratings").cast("double")
    expected = F.try_divide(n * n - F.col("mm"), n * (n - 1))
    return out.select(*by, "ratings", (1 - F.try_divide(1 - F.col("o") / n, expected)).alias("alpha"))


def pair_agreement(df: DataFrame, item: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Share of rater pairs within items that agree."""
    by = by or []
    counts = _ratings(df, item, label, by)
    per_item = counts.groupBy(*by, item).agg(F.max("n").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same"))
    out = per_item.groupBy(*by).agg(F.sum("same").alias("agreeing_pairs"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    return out.select(*by, "agreeing_pairs", "pairs", ratio(F.col("agreeing_pairs"), F.col("pairs")).alias("raw_agreement"))


def confusion(df: DataFrame, reference: str, predicted: str, positive: object, negative: object, by: list[str] | None = None) -> DataFrame:
    """Binary counts with failure as the positive class, rates, and intervals; labels outside the two fail the query."""
    known = lambda c: F.when(F.col(c).isin(positive, negative), F.col(c) == F.lit(positive)).when(F.col(c).isNotNull(), F.raise_error(F.lit(f"unknown label in {c}")).cast("boolean"))
    r, p = known(reference), known(predicted)
    tp, fp, fn, tn = (F.count_if(x) for x in (r & p, ~r & p, r & ~p, ~r & ~p))
    recall_low, recall_high = wilson(tp, tp + fn)
    precision_low, precision_high = wilson(tp, tp + fp)
    return df.groupBy(*(by or [])).agg(
        tp.alias("true_positive"), fp.alias("false_positive"), fn.alias("false_negative"), tn.alias("true_negative"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(fn, tp + fn).alias("false_approval_rate"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        precision_low.alias("precision_low"), precision_high.alias("precision_high"), recall_low.alias("recall_low"), recall_high.alias("recall_high"),
        (1 - recall_high).alias("false_approval_low"), (1 - recall_low).alias("false_approval_high"),
    )


def kappa_interval(df: DataFrame, reference: str, predicted: str, replicates: int = 1000, seed: int = 0, order: str = "case_id") -> DataFrame:
    """Percentile bootstrap interval (95 %) of kappa. Human-labelled cases are few by nature; above a million the query fails
    rather than load them at once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > 1_000_000:
            raise ValueError("too many labelled cases for one bootstrap")
        pairs = list(pdf.sort_values(order)[[reference, predicted]].itertuples(index=False, name=None))
        draw, found = random.Random(seed), []
        for _ in range(replicates if pairs else 0):
            taken = [pairs[draw.randrange(len(pairs))] for _ in pairs]
            n = len(taken)
            same = sum(a == b for a, b in taken) / n
            left, right = pd.Series([a for a, _ in taken]).value_counts(), pd.Series([b for _, b in taken]).value_counts()
            chance = sum(left.get(k, 0) * right.get(k, 0) for k in left.index) / (n * n)
            if chance < 1 or same == 1:  # one label alone on both sides agrees fully
                found.append((same - chance) / (1 - chance) if chance < 1 else 1.0)
        s = pd.Series(found, dtype=float)
        return pd.DataFrame({"kappa_low": [s.quantile(0.025)], "kappa_high": [s.quantile(0.975)], "replicates": [len(s)]})

    return df.where(F.col(reference).isNotNull() & F.col(predicted).isNotNull()).select(order, reference, predicted).groupBy().applyInPandas(run, "kappa_low double, kappa_high double, replicates long")


def human_metrics(annotations: DataFrame, item: list[str], label: str = "label", rater: str = "reviewer_id") -> DataFrame:
    """Raters per item: fewest and average, items with two or more, and items on which they disagree."""
    per = annotations.groupBy(*item).agg(F.count_distinct(rater).alias("raters"), F.count_distinct(label).alias("labels"))
    return per.agg(
        F.count(F.lit(1)).alias("items"), F.min("raters").alias("raters_min"), F.avg("raters").alias("raters_avg"),
        ratio(F.count_if(F.col("raters") >= 2), F.count(F.lit(1))).alias("double_rated"), ratio(F.count_if(F.col("labels") > 1), F.count(F.lit(1))).alias("disagreement_rate"),
    )


def condition_metrics(df: DataFrame, case: str, condition: str, label: str, conditions: int) -> DataFrame:
    """Over cases with a label in every condition: how many there are, and how often the label flips."""
    per = df.groupBy(case).agg(F.count_distinct(F.when(F.col(label).isNotNull(), F.col(condition))).alias("seen"), F.count_distinct(label).alias("labels"))
    whole = F.col("seen") == conditions
    return per.agg(F.count(F.lit(1)).alias("cases"), F.count_if(whole).alias("complete_cases"), ratio(F.count_if(whole), F.count(F.lit(1))).alias("coverage"), ratio(F.count_if(whole & (F.col("labels") > 1)), F.count_if(whole)).alias("flip_rate"))


def control_frames(observations: DataFrame, baseline: dict[str, str]) -> dict[str, DataFrame]:
    """For each factor, the observations in which every other factor is at its baseline."""
    return {factor: observations.where(" and ".join(f"{k} = '{v}'" for k, v in baseline.items() if k != factor) or "true") for factor in baseline}


def position_bias(df: DataFrame, order: str = "presentation_order", label: str = "label") -> DataFrame:
    """How often the answer shown first is chosen (AB with A, or BA with B), among clear choices."""
    first = ((F.col(order) == "AB") & (F.col(label) == "A")) | ((F.col(order) == "BA") & (F.col(label) == "B"))
    clear = F.col(order).isin("AB", "BA") & F.col(label).isin("A", "B")
    return df.agg(F.count_if(clear).alias("choices"), F.count_if(clear & first).alias("first_chosen"), ratio(F.count_if(clear & first), F.count_if(clear)).alias("first_position_rate"))


def self_preference(df: DataFrame, own: Column, condition: str = "identity_condition") -> DataFrame:
    """Rate at which own output is preferred when named, less that when blinded."""
    rate = lambda c: F.avg(F.when(F.col(condition) == c, own.cast("double")))
    return df.agg(rate("named").alias("named_rate"), rate("blinded").alias("blinded_rate"), (rate("named") - rate("blinded")).alias("shift"))


def gate_results(gates: DataFrame, metrics: DataFrame) -> DataFrame:
    """gates (gate, level, metric, comparison, threshold) against metrics (metric, value): passed is false where a value is missing."""
    near = F.when(F.col("comparison") == ">=", F.col("value") >= F.col("threshold")).when(F.col("comparison") == "<=", F.col("value") <= F.col("threshold"))
    return gates.join(metrics, "metric", "left").withColumn("passed", F.coalesce(near, F.lit(False)))


def achieved_level(results: DataFrame, levels: list[str] = LEVELS, synthetic: bool = False) -> DataFrame:
    """One row: the highest level that is reached by results (level, passed).

    A level is reached if there are gates for it or for levels below, all of these passed, and the levels before it are
    reached; so without a gate of the second level nothing above the first is. Synthetic cases stay at the lowest. No gates, a
    gate of the first or an unknown level, or one whose `passed` is null, fail the query."""
    if synthetic:
        return results.sparkSession.createDataFrame([(levels[0],)], "level string")
    rank = F.array_position(F.lit(levels), F.coalesce("level", F.lit("")))
    found = results.agg(F.count(F.lit(1)).alias("n"), F.count_if(rank < 2).alias("odd"), F.count_if(F.col("passed").isNull()).alias("unknown"), F.min(rank).alias("least"), F.min(F.when(~F.col("passed"), rank)).alias("failed"))
    wrong = F.when(F.col("n") == 0, "there are no gates").when(F.col("odd") > 0, "a gate's level is the first or unknown").when(F.col("unknown") > 0, "a gate has no result")
    best = F.when(F.col("least") > 2, 1).otherwise(F.coalesce(F.col("failed") - 1, F.lit(len(levels))))
    return found.select(F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.try_element_at(F.lit(levels), best.cast("int"))).alias("level"))


def claim_block(results: DataFrame, level: str, required: str, levels: list[str] = LEVELS) -> DataFrame:
    """One row: the weakest judge level among judged rows, and whether a claim that needs `required` is blocked.

    Judged rows are those whose evaluation_source is llm_judge. Rows without a level don't count; if none has one, or there is no such column, the
    level is the first. An unknown level fails the query. Without judged rows nothing is blocked and the level is null."""
    given = F.col(level).cast("string") if level in results.columns else F.lit(None).cast("string")
    rank = F.array_position(F.lit(levels), given)
    low = results.where("evaluation_source = 'llm_judge'").agg(F.min(rank).alias("low"), F.min(F.when(rank == 0, given)).alias("odd"), F.count("*").alias("judged_rows"))
    low = low.withColumn("low", F.when(F.col("odd").isNotNull(), F.raise_error(F.concat(F.lit("unknown judge level: "), F.col("odd"))).cast("long")).when(F.col("judged_rows") > 0, F.coalesce("low", F.lit(1))))
    return low.select("judged_rows", F.try_element_at(F.lit(levels), F.col("low").cast("int")).alias("lowest_level"), F.coalesce(F.col("low") < levels.index(required) + 1, F.lit(False)).alias("blocked"))
