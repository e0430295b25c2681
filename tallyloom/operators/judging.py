"""Validation of a judge against human labels: label joins, agreement by slice, conditions, and the gates of each level."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio, wilson
from .agreement import cohen_kappa, krippendorff_alpha, pair_agreement
from .validate import duplicate_keys, observation_violations, unknown_keys, unknown_values, violations

#: Columns that tell observations of one case and criterion apart.
FACTORS = ["judge_variant_id", "trial_id", "prompt_variant_id", "identity_condition", "presentation_order"]
STAGES, IDENTITIES, ORDERS = ["independent", "adjudicated"], ["blinded", "named"], {"pointwise": ["pointwise"], "pairwise": ["AB", "BA"]}
OBSERVATION_KEY = ["case_id", "criterion", *FACTORS]


@dataclass(frozen=True)
class Protocol:
    """What a validation plan fixes. thresholds and checks: by gate, see GATES; a check is a yes or no of the plan."""

    labels: tuple[str, ...]
    criteria: tuple[str, ...]
    baseline: dict[str, str]
    pass_label: str | None = "pass"
    failure_label: str | None = "fail"
    mode: str = "pointwise"
    split_column: str = "split"
    validation_split: str = "validation"
    calibration_split: str = "calibration"
    pair_labels: tuple[str, str, str] = ("A", "B", "tie")
    slices: dict[str, tuple[str, ...]] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)
    checks: dict[str, bool] = field(default_factory=dict)
    identity_test: bool = True
    synthetic: bool = False

    @property
    def criterion(self) -> str:
        return self.criteria[0]


#: Gates that every plan has, as (gate, level, table, metric, comparison, least or most that a plan may ask).
GATES = [
    ("validation_case_count", "calibrated", "judge", "cases", ">=", None),
    ("independent_human_raters", "calibrated", "human", "minimum_independent_raters", ">=", 2.0),
    ("independent_human_label_coverage", "calibrated", "human", "independent_label_coverage", ">=", 1.0),
    ("adjudication_coverage", "calibrated", "human", "adjudication_coverage", ">=", 1.0),
    ("human_krippendorff_alpha", "calibrated", "human", "krippendorff_alpha", ">=", None),
    ("judge_human_cohen_kappa", "calibrated", "judge", "cohen_kappa", ">=", None),
    ("failure_precision", "calibrated", "judge", "failure_precision", ">=", None),
    ("failure_recall", "calibrated", "judge", "failure_recall", ">=", None),
    ("false_approval_rate", "calibrated", "judge", "false_approval_rate", "<=", None),
    ("observation_failure_rate", "calibrated", "judge", "observation_failure_rate", "<=", None),
    ("independent_trial_count", "decision_grade", "trial_id", "observed_value_count", ">=", 3.0),
    ("test_retest_alpha", "decision_grade", "trial_id", "krippendorff_alpha", ">=", None),
    ("independent_trial_coverage", "decision_grade", "trial_id", "complete_condition_coverage", ">=", 1.0),
    ("prompt_variant_count", "decision_grade", "prompt_variant_id", "observed_value_count", ">=", 2.0),
    ("prompt_flip_rate", "decision_grade", "prompt_variant_id", "flip_rate", "<=", None),
    ("prompt_variant_coverage", "decision_grade", "prompt_variant_id", "complete_condition_coverage", ">=", 1.0),
]
#: Gates of plans that test identity, of plans that compare pairs, and of labels that name the judge's own output.
IDENTITY_GATES = [
    ("identity_condition_count", "decision_grade", "identity_condition", "observed_value_count", ">=", 2.0),
    ("identity_flip_rate", "decision_grade", "identity_condition", "flip_rate", "<=", None),
    ("identity_condition_coverage", "decision_grade", "identity_condition", "complete_condition_coverage", ">=", 1.0),
]
PAIR_GATES = [
    ("position_order_count", "decision_grade", "presentation_order", "observed_value_count", ">=", 2.0),
    ("position_flip_rate", "decision_grade", "presentation_order", "flip_rate", "<=", None),
    ("position_bias", "decision_grade", "position", "position_bias", "<=", None),
    ("position_order_coverage", "decision_grade", "presentation_order", "complete_condition_coverage", ">=", 1.0),
]
OWN_GATES = [("self_preference_shift", "decision_grade", "own", "absolute_shift", "<=", None)]
#: What a plan has to say yes to, by level.
CHECKS = {
    "calibrated": ["not_synthetic_fixture", "runtime_candidate_identity_blinded"],
    "decision_grade": ["independent_before_adjudication", "human_candidate_identity_blinded", "human_judge_identity_blinded", "response_cache_disabled", "identity_bias_test_required", "required_subgroups_declared"],
    "publishable": ["protocol_frozen", "heldout_not_used_for_development", "independent_review", "conflicts_documented", "raw_artifacts_preserved", "judge_selection_documented"],
}


def input_violations(cases: DataFrame, humans: DataFrame, observations: DataFrame, plan: Protocol) -> DataFrame:
    """(rule, key, detail) of what breaks the contract of a validation's three tables."""
    human_key = ["case_id", "criterion", "reviewer_id", "annotation_stage"]
    return violations(
        duplicate_keys(cases, ["case_id"]),
        unknown_keys(humans, cases, "case_id"),
        unknown_values(humans, "criterion", list(plan.criteria)),
        unknown_values(humans, "annotation_stage", STAGES),
        unknown_values(humans, "label", list(plan.labels)),
        duplicate_keys(humans, human_key),
        duplicate_keys(humans.where("annotation_stage = 'adjudicated'"), ["case_id", "criterion"]),
        unknown_values(observations, "criterion", list(plan.criteria)),
        unknown_values(observations, "identity_condition", IDENTITIES),
        unknown_values(observations, "presentation_order", ORDERS[plan.mode]),
        observation_violations(observations, cases, list(plan.labels), OBSERVATION_KEY),
    )


def baseline_observations(observations: DataFrame, plan: Protocol, free: tuple[str, ...] = (), criterion: str | None = None) -> DataFrame:
    """Observations of a criterion (None: the first) with every factor at its baseline but the free ones."""
    out = observations if "criterion" in free else observations.where(F.col("criterion") == (criterion or plan.criterion))
    for name, value in plan.baseline.items():
        if name not in free:
            out = out.where(F.col(name) == value)
    return out


def labelled(cases: DataFrame, humans: DataFrame, observations: DataFrame, plan: Protocol, by: tuple[str, ...] = ()) -> DataFrame:
    """cases with criterion, reference_label (adjudicated), judge_label, status and uncertainty of the baseline observation.

    by: factors (or criterion) that stay free; every case then has a row for each value that is observed. A case without
    label or observation stays, with nulls."""
    reference = humans.where("annotation_stage = 'adjudicated'").select("case_id", "criterion", F.col("label").alias("reference_label"))
    seen = baseline_observations(observations, plan, by)
    grid = cases
    if by:  # every case meets every observed value: that many rows are the result
        grid = cases.join(seen.select(*by).distinct(), how="cross")
    if "criterion" not in by:
        grid = grid.withColumn("criterion", F.lit(plan.criterion))
    seen = seen.select("case_id", "criterion", *[b for b in by if b != "criterion"], F.col("label").alias("judge_label"), "status", "uncertainty")
    return grid.join(reference, ["case_id", "criterion"], "left").join(seen, ["case_id", "criterion", *[b for b in by if b != "criterion"]], "left")


def judge_metrics(frame: DataFrame, plan: Protocol, by: list[str] | None = None) -> DataFrame:
    """Coverage, agreement, kappa and, with a pass label, failure detection of labelled rows, by the columns given."""
    by = by or []
    same = F.col("reference_label") == F.col("judge_label")
    both = (F.col("status") == "success") & F.col("reference_label").isNotNull() & F.col("judge_label").isNotNull()
    both = F.coalesce(both, F.lit(False))
    n, agree = F.count(F.lit(1)), F.count_if(both & same)
    missing, errors, abstained = F.count_if(F.col("status").isNull()), F.count_if(F.col("status") == "error"), F.count_if(F.col("status") == "abstain")
    low, high = wilson(agree, F.count_if(both))
    unsure = F.col("uncertainty").cast("string").try_cast("double")
    aggs = [
        n.alias("cases"), F.count("reference_label").alias("human_reference_cases"), F.count_if(both).alias("comparable_cases"), missing.alias("missing_observations"), errors.alias("judge_errors"),
        abstained.alias("judge_abstentions"), ratio(missing + errors + abstained, n).alias("observation_failure_rate"), ratio(agree, F.count_if(both)).alias("raw_agreement"), low.alias("accuracy_ci_low"), high.alias("accuracy_ci_high"),
        ratio(F.count_if(both & unsure.isNotNull()), F.count_if(both)).alias("reported_uncertainty_coverage"), F.avg(F.when(both, unsure)).alias("average_reported_uncertainty"),
    ]
    if plan.pass_label is not None:
        fails = lambda c: both & (F.col(c) == plan.failure_label)
        hit, r, p = F.count_if(fails("reference_label") & fails("judge_label")), F.count_if(fails("reference_label")), F.count_if(fails("judge_label"))
        recall, precision = wilson(hit, r), wilson(hit, p)
        aggs += [
            hit.alias("true_failure"), (r - hit).alias("false_approval"), (p - hit).alias("false_failure"), (F.count_if(both) - r - p + hit).alias("true_approval"),
            ratio(hit, p).alias("failure_precision"), ratio(hit, r).alias("failure_recall"), ratio(r - hit, r).alias("false_approval_rate"),
            precision[0].alias("failure_precision_ci_low"), precision[1].alias("failure_precision_ci_high"), recall[0].alias("failure_recall_ci_low"), recall[1].alias("failure_recall_ci_high"),
            (1 - recall[1]).alias("false_approval_rate_ci_low"), (1 - recall[0]).alias("false_approval_rate_ci_high"),
        ]
    measured = frame.groupBy(*by).agg(*aggs)
    kappa = cohen_kappa(frame.where(both), "reference_label", "judge_label", by).select(*by, F.col("kappa").alias("cohen_kappa"))
    if not by:
        return measured.join(kappa, F.lit(True), "left")
    on = [F.col(f"m.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by]
    return measured.alias("m").join(kappa.alias("k"), on, "left").select("m.*", "k.cohen_kappa")


def slice_metrics(frame: DataFrame, plan: Protocol, columns: list[str]) -> DataFrame:
    """judge_metrics of each value of each slice column (null is a value), as slice_column and slice_value."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("slice_column"), F.col(c).cast("string").alias("slice_value")) for c in columns])).alias("x")
    rows = frame.select("reference_label", "judge_label", "status", "uncertainty", each).select("*", "x.slice_column", "x.slice_value").drop("x")
    return judge_metrics(rows, plan, ["slice_column", "slice_value"])


def human_review(cases: DataFrame, humans: DataFrame, plan: Protocol, split: str) -> DataFrame:
    """One row: raters, coverage, agreement and adjudication of a split's cases on the first criterion."""
    own = cases.where(F.col(plan.split_column) == split).select("case_id")
    mine = humans.where(F.col("criterion") == plan.criterion).join(own, "case_id", "left_semi")
    free = mine.where("annotation_stage = 'independent'")
    per = free.groupBy("case_id").agg(F.count_distinct("reviewer_id").alias("raters"), F.count_distinct("label").alias("kinds"))
    counted = per.agg(F.count(F.lit(1)).alias("cases_with_independent_labels"), F.coalesce(F.min("raters"), F.lit(0)).alias("minimum_independent_raters"), F.coalesce(F.avg("raters"), F.lit(0.0)).alias("average_independent_raters"), F.count_if(F.col("kinds") > 1).alias("human_disagreement_cases"))
    judged = mine.where("annotation_stage = 'adjudicated'").agg(F.count_distinct("case_id").alias("adjudicated_cases"))
    total = own.agg(F.count_distinct("case_id").alias("cases"))
    out = total.join(counted, F.lit(True), "left").join(judged, F.lit(True), "left")
    out = out.join(pair_agreement(free, "case_id", "label").select(F.col("pairs").alias("pair_comparisons"), F.col("raw_agreement").alias("raw_pairwise_agreement")), F.lit(True), "left")
    out = out.join(krippendorff_alpha(free, "case_id", "label").select(F.col("alpha").alias("krippendorff_alpha")), F.lit(True), "left")
    return out.select(F.lit(split).alias("split"), "*", ratio(F.col("cases_with_independent_labels"), F.col("cases")).alias("independent_label_coverage"), ratio(F.col("adjudicated_cases"), F.col("cases")).alias("adjudication_coverage"))


def condition_review(observations: DataFrame, condition: str, cases: DataFrame) -> DataFrame:
    """One row: how labels of the same case agree over the values of a condition.

    cases: the cases expected. complete: a case with a label for every value that is observed at all; flip_rate is one less
    the share of agreeing pairs of labels of a case."""
    done = observations.where("status = 'success'")
    values = done.agg(F.count_distinct(condition).alias("observed_value_count"), F.count_distinct("case_id").alias("cases_with_observations"))
    per = done.groupBy("case_id").agg(F.count_distinct(condition).alias("seen"), F.count(F.lit(1)).alias("labels"))
    expected = cases.select("case_id").distinct().join(per, "case_id", "left")
    out = expected.join(values, F.lit(True), "cross").groupBy("observed_value_count", "cases_with_observations").agg(F.count(F.lit(1)).alias("expected_cases"), F.count_if((F.col("seen") == F.col("observed_value_count")) & (F.col("seen") > 0)).alias("cases_with_all_conditions"))
    out = out.join(per.agg(F.count_if(F.col("labels") >= 2).alias("cases_with_comparisons")), F.lit(True), "left")
    out = out.join(pair_agreement(done, "case_id", "label").select(F.col("pairs").alias("pair_comparisons"), "raw_agreement"), F.lit(True), "left")
    out = out.join(krippendorff_alpha(done, "case_id", "label").select(F.col("alpha").alias("krippendorff_alpha")), F.lit(True), "left")
    return out.select(F.lit(condition).alias("condition"), "*", ratio(F.col("cases_with_all_conditions"), F.col("expected_cases")).alias("complete_condition_coverage"), (1 - F.col("raw_agreement")).alias("flip_rate"))


def position_review(observations: DataFrame, plan: Protocol) -> DataFrame:
    """One row: how often the answer shown first is chosen among choices that are no tie, and how far from a half that is."""
    first, second, tie = plan.pair_labels
    chosen = F.when(F.col("presentation_order") == "AB", F.col("label") == first).otherwise(F.col("label") == second)
    clear = (F.col("status") == "success") & (F.col("label") != tie)
    rate = F.avg(F.when(clear, chosen.cast("double")))
    return observations.agg(F.count_if(clear).alias("decisive_observations"), rate.alias("first_position_selection_rate"), F.abs(rate - 0.5).alias("position_bias"))


def own_preference(observations: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: how often a judge picks the label of its own output when it is named, less when it is blinded.

    cases: (case_id, self_preference_label); a blank label is none."""
    own = cases.select("case_id", F.trim("self_preference_label").alias("own")).where("own <> ''")
    met = observations.where("status = 'success'").join(own, "case_id")
    rate = lambda c: F.avg(F.when(F.col("identity_condition") == c, (F.col("label") == F.col("own")).cast("double")))
    return met.agg(F.count(F.lit(1)).alias("observations"), rate("named").alias("named_selection_rate"), rate("blinded").alias("blinded_selection_rate"), (rate("named") - rate("blinded")).alias("self_preference_shift"), F.abs(rate("named") - rate("blinded")).alias("absolute_shift"))


def _threshold(gate: str, comparison: str, bound: float | None, plan: Protocol) -> float | None:
    asked = plan.thresholds.get(gate)
    if asked is None or bound is None:
        return asked if bound is None else bound
    return max(asked, bound) if comparison == ">=" else min(asked, bound)


def gate_table(cases: DataFrame, humans: DataFrame, observations: DataFrame, plan: Protocol) -> DataFrame:
    """(gate, level, observed, comparison, threshold, passed) of all gates that the plan has.

    A gate without observation or threshold fails. Measures are one-row tables, joined by gate, so nothing but gates meets the driver."""
    held = cases.where(F.col(plan.split_column) == plan.validation_split)
    mine = observations.join(held.select("case_id"), "case_id", "left_semi")
    frame = labelled(held, humans, observations, plan)
    tables = {"judge": judge_metrics(frame, plan), "human": human_review(cases, humans, plan, plan.validation_split)}
    for factor in ("trial_id", "prompt_variant_id", "identity_condition", "presentation_order"):
        tables[factor] = condition_review(baseline_observations(mine, plan, (factor,)), factor, held)
    gates = list(GATES) + (IDENTITY_GATES if plan.identity_test else [])
    if plan.mode == "pairwise":
        gates += PAIR_GATES
        tables["position"] = position_review(baseline_observations(mine, plan, ("presentation_order",)), plan)
    if "self_preference_label" in cases.columns:
        tables["own"] = own_preference(baseline_observations(mine, plan, ("identity_condition",)), cases)
        gates += OWN_GATES
    spark = cases.sparkSession
    schema = "gate string, level string, source string, metric string, comparison string, threshold double"
    wanted = spark.createDataFrame([(g, level, table, metric, how, _threshold(g, how, bound, plan)) for g, level, table, metric, how, bound in gates], schema)
    measures = None
    for name, table in tables.items():
        metrics = sorted({m for _, _, t, m, _, _ in gates if t == name})
        if metrics:
            one = table.select(F.lit(name).alias("source"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("observed")) for m in metrics])).alias("x")).select("source", "x.*")
            measures = one if measures is None else measures.unionByName(one)
    found = wanted.join(measures, ["source", "metric"], "left")
    if plan.slices:
        subgroups = slice_metrics(frame, plan, list(plan.slices)).select("slice_column", "slice_value", F.col("cases").cast("double").alias("observed"))
        asked = spark.createDataFrame([(f"subgroup_cases:{c}={v}", c, v) for c, values in plan.slices.items() for v in values], "gate string, slice_column string, slice_value string")
        least = F.lit(plan.thresholds.get("subgroup_cases")).cast("double")
        found = found.unionByName(asked.join(subgroups, ["slice_column", "slice_value"], "left").select("gate", F.lit("decision_grade").alias("level"), F.lit("slice").alias("source"), F.lit("cases").alias("metric"), F.lit(">=").alias("comparison"), least.alias("threshold"), "observed"))
    given = plan.checks | {"not_synthetic_fixture": not plan.synthetic, "identity_bias_test_required": plan.identity_test, "required_subgroups_declared": bool(plan.slices)}
    checks = [(c, level, float(given.get(c, False)), "==", 1.0) for level, names in CHECKS.items() for c in names]
    if plan.mode == "pairwise":
        checks.append(("position_swap_required", "decision_grade", float(given.get("position_swap_required", False)), "==", 1.0))
    found = found.select("gate", "level", "observed", "comparison", "threshold").unionByName(spark.createDataFrame(checks, "gate string, level string, observed double, comparison string, threshold double"))
    return found.withColumn("passed", F.coalesce(_holds(), F.lit(False)))


def _holds() -> Column:
    x, y, how = F.col("observed"), F.col("threshold"), F.col("comparison")
    return F.when(how == ">=", x >= y).when(how == "<=", x <= y).when(how == "==", x == y)
