"""Selection policies and decisions over a model summary, which has one row per model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cost import bounded_inverse
from ..functions.stats import rank_present, ratio


@dataclass(frozen=True)
class Policy:
    """Hard limits (None: no limit) and weights of a selection."""

    min_pass_rate: float | None = None
    min_pass_rate_low: float | None = None
    max_failure_rate: float | None = None
    max_p95_seconds: float | None = None
    max_average_cost: float | None = None
    capabilities: tuple[str, ...] = ()
    need_profile: bool = False
    quality: float = 1.0
    cost: float = 0.0
    latency: float = 0.0
    reliability: float = 0.0
    min_margin: float = 0.0


def _percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def select_models(summary: DataFrame, policy: Policy, profiles: DataFrame | None = None) -> DataFrame:
    """Status, decision score and rank of each model. A failed limit makes it ineligible, missing evidence unknown; failure comes first.

    profiles: (model_name, available, capabilities array). Reasons stand in the order of the checks."""
    spark = summary.sparkSession
    if profiles is None:
        profiles = spark.createDataFrame([], "model_name string, available boolean, capabilities array<string>")
    df = summary.join(profiles.select("model_name", "available", "capabilities", F.lit(True).alias("__profile")), "model_name", "left")
    has = lambda c: F.col(c) if c in summary.columns else F.lit(None).cast("double")
    profile = F.col("__profile").isNotNull()
    rate, low, failing = has("pass_rate"), has("pass_rate_ci_low"), has("generation_failure_rate")
    p95 = F.when(has("generation_latency_coverage") == 1, has("generation_p95_seconds"))
    requests = F.coalesce(has("generation_requests"), F.lit(0))
    cost = F.when(requests > 0, ratio(has("generation_cost_usd"), requests))
    failures: list[Column] = [F.when(~F.col("available"), "model is not available for deployment")]
    missing: list[Column] = [F.when(F.lit(policy.need_profile) & ~profile, "model profile"), F.when(F.col("available").isNull(), "deployment availability")]
    if policy.capabilities:
        absent = F.array_sort(F.array_except(F.lit(list(policy.capabilities)), F.coalesce("capabilities", F.array().cast("array<string>"))))
        failures.append(F.when(profile & (F.size(absent) > 0), F.concat(F.lit("missing required capabilities: "), F.array_join(absent, ", "))))
        missing.append(F.when(~profile, "model profile"))
    missing.append(F.when(F.coalesce(has("unscored_cases"), F.lit(0)) > 0, "complete quality results"))
    show = {"percent": _percent, "seconds": lambda c: F.format_string("%.2f s", c), "usd": lambda c: F.format_string("$%.6f", c)}
    checks = [
        (rate, policy.min_pass_rate, 0, "least", "pass rate", "pass rate", "percent"),
        (low, policy.min_pass_rate_low, 0, "least", "pass-rate confidence bound", "95% pass-rate lower bound", "percent"),
        (F.when(requests > 0, failing), policy.max_failure_rate, policy.reliability, "most", "generation failure rate", "generation failure rate", "percent"),
        (p95, policy.max_p95_seconds, policy.latency, "most", "complete generation latency", "p95 latency", "seconds"),
        (cost, policy.max_average_cost, policy.cost, "most", "complete generation cost", "average request cost", "usd"),
    ]
    for value, limit, weight, kind, lacks, says, unit in checks:
        if limit is not None or weight > 0:
            missing.append(F.when(value.isNull(), lacks))
        if limit is not None:
            wrong = value < limit if kind == "least" else value > limit
            between = " is below " if kind == "least" else " exceeds "
            failures.append(F.when(wrong, F.concat(F.lit(f"{says} "), show[unit](value), F.lit(between), show[unit](F.lit(float(limit))))))
    if policy.quality > 0:
        missing.append(F.when(rate.isNull(), "pass rate"))
    parts = [
        (policy.quality, rate, "quality_component"),
        (policy.cost, bounded_inverse(cost, policy.max_average_cost) if policy.max_average_cost else F.lit(None).cast("double"), "cost_component"),
        (policy.latency, bounded_inverse(p95, policy.max_p95_seconds) if policy.max_p95_seconds else F.lit(None).cast("double"), "latency_component"),
        (policy.reliability, 1 - failing, "reliability_component"),
    ]
    weighed = [(w, c) for w, c, _ in parts if w > 0]
    score = sum((w * c for w, c in weighed), F.lit(0.0)) / sum(w for w, _ in weighed)
    df = df.withColumns({"__failures": F.array_compact(F.array(*failures)), "__missing": F.array_distinct(F.array_compact(F.array(*missing))), "__score": score})
    df = df.withColumn("__missing", F.when((F.size("__failures") == 0) & (F.size("__missing") == 0) & F.col("__score").isNull(), F.array(F.lit("weighted decision metric"))).otherwise(F.col("__missing")))
    status = F.when(F.size("__failures") > 0, "ineligible").when(F.size("__missing") > 0, "unknown").otherwise("eligible")
    df = df.withColumns({"selection_status": status, "decision_score": F.when(status == "eligible", F.col("__score"))})
    return df.select(
        "model_name", "selection_status", rank_present(F.col("decision_score")).alias("selection_rank"), "decision_score", *[c.alias(n) for _, c, n in parts],
        rate.alias("pass_rate"), low.alias("pass_rate_ci_low"), cost.alias("generation_average_cost_usd"), p95.alias("generation_p95_seconds"), failing.alias("generation_failure_rate"),
        "available", F.array_join(F.array_sort(F.coalesce("capabilities", F.array().cast("array<string>"))), ", ").alias("capabilities"),
        F.array_join("__failures", "; ").alias("constraint_failures"), F.array_join("__missing", "; ").alias("missing_evidence"),
    ).orderBy(F.col("selection_rank").asc_nulls_last(), "model_name")


@dataclass
class Decision:
    status: str
    leader: str | None = None
    recommended: str | None = None
    top: list[str] = field(default_factory=list)
    undistinguished: list[str] = field(default_factory=list)
    margin: float | None = None


def quality_decision(summary: DataFrame, comparisons: DataFrame | None = None) -> Decision:
    """What the pass rates support. Reads one row per model and one per pair of models."""
    models = [r.asDict() for r in summary.select("model_name", "rank", "unscored_cases").collect()]
    if not models:
        return Decision("no_results")
    ranks = [m["rank"] for m in models if m["rank"] is not None]
    top = sorted(m["model_name"] for m in models if ranks and m["rank"] == min(ranks))
    leader = top[0] if len(top) == 1 else None
    if sum(m["unscored_cases"] or 0 for m in models):
        return Decision("incomplete_evaluation", leader, top=top)
    if len(models) == 1:
        return Decision("single_model", leader, top=top)
    if leader is None:
        return Decision("observed_tie", top=top, undistinguished=top)
    won = set()
    if comparisons is not None:
        for r in comparisons.select("model_a", "model_b", "clear_winner").collect():
            if r["clear_winner"] == leader:
                won |= {r["model_a"], r["model_b"]} - {leader}
    rest = sorted({m["model_name"] for m in models} - {leader} - won)
    return Decision("insufficient_evidence" if rest else "clear_leader", leader, top=top, undistinguished=rest)


def recommendation(summary: DataFrame, comparisons: DataFrame, selection: DataFrame | None = None, policy: Policy | None = None, blocked: str | None = None) -> Decision:
    """The decision after quality evidence, judge validation (blocked names what it lacks) and, with a policy, selection."""
    quality = quality_decision(summary, comparisons)
    if blocked and quality.status not in ("no_results", "incomplete_evaluation", "single_model"):
        quality.status = "insufficient_judge_validation"
        return quality
    if policy is None or quality.status in ("no_results", "incomplete_evaluation", "single_model"):
        return quality
    rows = selection.select("model_name", "selection_status", "decision_score").collect()
    if any(r["selection_status"] == "unknown" for r in rows):
        return Decision("insufficient_operational_data", quality.leader)
    fit = sorted(((-r["decision_score"], r["model_name"]) for r in rows if r["selection_status"] == "eligible"))
    if not fit:
        return Decision("no_eligible_models", quality.leader)
    best = [name for score, name in fit if score == fit[0][0]]
    if len(fit) == 1:
        return Decision("sole_eligible_model", quality.leader, best[0], best)
    if len(best) > 1:
        return Decision("policy_tie", quality.leader, top=best, margin=0.0)
    margin = fit[1][0] - fit[0][0]
    if margin < policy.min_margin:
        return Decision("insufficient_policy_margin", quality.leader, top=best, margin=margin)
    if policy.cost + policy.latency + policy.reliability == 0:
        among = summary.where(F.col("model_name").isin([name for _, name in fit]))
        among = quality_decision(among.withColumn("rank", rank_present(F.col("pass_rate"))), comparisons)
        if among.status != "clear_leader" or among.leader != best[0]:
            return Decision("insufficient_quality_evidence", quality.leader, top=best, undistinguished=among.undistinguished, margin=margin)
        return Decision("quality_leader", quality.leader, best[0], best, margin=margin)
    return Decision("policy_leader", quality.leader, best[0], best, margin=margin)


def leader_margin(df: DataFrame, group: str, name: str, score: str) -> DataFrame:
    """Leader, runner-up and margin of each group, by score and then name."""
    order = W.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), F.col(name).asc())
    rows = df.withColumns({"__k": F.row_number().over(order), "__next": F.lead(score).over(order), "__name": F.lead(name).over(order)})
    return rows.where("__k = 1").select(group, F.col(name).alias("leader"), F.col("__name").alias("runner_up"), F.col(score).alias("leader_score"), (F.col(score) - F.col("__next")).alias("margin"))


def result_status(failure_rate: Column, most: float, ranked: Column) -> Column:
    """ranked, descriptive, or ineligible for a published run."""
    return F.when(failure_rate > most, "ineligible").when(ranked, "ranked").otherwise("descriptive")


def promoted(summary: DataFrame, min_pass_rate: float, max_failure_rate: float) -> DataFrame:
    """Models that go on to the next tier; without requests the failure rate counts as 1."""
    failing = F.when(F.coalesce("generation_requests", F.lit(0)) == 0, 1.0).otherwise(F.coalesce("generation_failure_rate", F.lit(1.0)))
    return summary.where((F.col("pass_rate") >= min_pass_rate) & (failing <= max_failure_rate))
