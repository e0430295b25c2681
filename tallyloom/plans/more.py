"""Queries of judge validation, census comparison, eligibility and tables of results, each with its SQL.

The census is made of customers: two in a row are the English and French case of one product, and the key decides by
arithmetic what each of three models puts out. Judges and reviewers rate the labelled documents."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.jsonscore import Shape
from ..operators import board, census, cohort, contracts, family, judging, reshape, validate
from ..sources import manifest, tables
from .registry import query, rounded, wilson_sql  # noqa: F401

MODELS = ["m0", "m1", "m2"]
SHAPE = Shape(frozenset({"s"}), frozenset({"l"}), frozenset({"l"}))
#: What a model says by the last digit of (key * (model + 3)); above, the right answer.
SAID = ['{"s": ["v"], "l": ["a, b", "c"]}', '{"s": "v", "l": ["a, b", "c", "c"]}', '{"s": "v"}', "no json", None, '{"s": "w", "l": ["a, b", "c"]}']
RIGHT = '{"s": "v", "l": ["a, b", "c"]}'
CLASSES = ["schema_type_only", "duplicate_items_only", "missing_or_extra_fields", "invalid_json", "generation_error", "text_or_value_error"]


def census_rows(t: Callable) -> DataFrame:
    k = F.col("c_custkey")
    product = F.floor(k / 2)
    x = F.col("x")
    said = F
    for n, out in enumerate(SAID):
        said = said.when(x == n, F.lit(out))
    base = t("customer").select(F.col("c_custkey").alias("case_id"), product.alias("product_id"), F.when(k % 2 == 0, "en").otherwise("fr").alias("language"), F.element_at(F.lit(census.STRATA), (product % 4 + 1).cast("int")).alias("stratum"), F.posexplode(F.lit(MODELS)).alias("i", "model_name"))
    return base.withColumn("x", F.col("case_id") * (F.col("i") + 3) % 10).select(
        "case_id", "product_id", "language", "stratum", F.lit("in").alias("input"), F.lit(RIGHT).alias("expected_output"), F.lit("{}").alias("source_metadata"), "model_name",
        said.otherwise(RIGHT).alias("model_output"), F.when(x == 4, "error").otherwise("success").alias("generation_status"), x.cast("double").alias("generation_seconds"),
        (x / 100).alias("generation_cost_usd"), (x / 10).alias("final_score"), (x >= 6).alias("final_passed"),
    )


_CLASS = "CASE x " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CLASSES)) + " ELSE 'pass' END"
_STRATUM = "CASE (c_custkey // 2) % 4 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(census.STRATA)) + " END"
CENSUS = f"""c AS (SELECT c_custkey AS case_id, c_custkey // 2 AS product_id, CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'fr' END AS language, {_STRATUM} AS stratum, 'm' || i AS model_name, c_custkey * (i + 3) % 10 AS x FROM customer, range(3) r(i)),
 d AS (SELECT *, {_CLASS} AS error_type, x >= 6 AS ok FROM c)"""


def diagnosed(t: Callable) -> DataFrame:
    return census.diagnosed(census_rows(t), SHAPE)


@query(f"WITH {CENSUS} SELECT model_name, language, error_type, count(*) AS cases FROM d GROUP BY ALL")
def error_classes(t):
    return diagnosed(t).groupBy("model_name", "language", "error_type").agg(F.count(F.lit(1)).alias("cases"))


@query(f"""WITH {CENSUS}, p AS (SELECT model_name, product_id, sum(ok::INT) AS n FROM d GROUP BY ALL HAVING count(*) = 2),
 q AS (SELECT model_name, count(*) AS product_families, count(*) FILTER (n = 2) AS both_languages_passed_products, count(*) FILTER (n = 1) AS one_language_failed_products, count(*) FILTER (n = 0) AS both_languages_failed_products, round(count(*) FILTER (n = 2) / count(*)::DOUBLE, 9) AS bilingual_product_pass_rate FROM p GROUP BY 1),
 o AS (SELECT model_name, count(*) AS cases, count(*) FILTER (ok) AS passed_cases, count(*) FILTER (NOT ok) AS failed_cases, round(count(*) FILTER (ok) / count(*)::DOUBLE, 9) AS pass_rate, round(avg(x / 10.0::DOUBLE), 9) AS average_field_score,
 count(*) FILTER (x = 4) AS generation_failures, round(avg(x), 9) AS average_latency_seconds, round(quantile_cont(x::DOUBLE, 0.95), 9) AS p95_latency_seconds, round(sum(x / 100.0::DOUBLE), 9) AS total_cost_usd, round(sum(x / 100.0::DOUBLE) / count(*) * 1000, 9) AS cost_per_1000_cases_usd,
 count(*) FILTER (x = 0) AS schema_type_only_failures, count(*) FILTER (ok OR x = 0) AS schema_type_repair_sensitivity_passes, round(count(*) FILTER (ok OR x = 0) / count(*)::DOUBLE, 9) AS schema_type_repair_sensitivity_rate,
 count(*) FILTER (x IN (0, 1)) AS all_structural_failures, count(*) FILTER (ok OR x IN (0, 1)) AS structural_repair_sensitivity_passes, round(count(*) FILTER (ok OR x IN (0, 1)) / count(*)::DOUBLE, 9) AS structural_repair_sensitivity_rate,
 count(*) FILTER (x = 5) AS remaining_text_or_value_failures FROM d GROUP BY 1)
 SELECT * FROM o JOIN q USING (model_name)""")
def model_overview(t):
    return census.model_overview(diagnosed(t))


@query(f"""WITH {CENSUS}, a AS (SELECT model_name, unnest(['all', language]) AS language, x FROM d), f(field_name, bad) AS (VALUES ('s', [0, 3, 4, 5]), ('l', [1, 2, 3, 4]), ('__schema_contract__', [2, 3, 4]))
 SELECT model_name, language, field_name, count(*) AS cases, count(*) FILTER (NOT list_contains(bad, x)) AS matching_cases, count(*) FILTER (list_contains(bad, x)) AS mismatched_cases, round(count(*) FILTER (NOT list_contains(bad, x)) / count(*)::DOUBLE, 9) AS field_accuracy FROM a, f GROUP BY 1, 2, 3""")
def field_accuracy_by_language(t):
    return census.field_accuracy_by_language(diagnosed(t), ["s", "l"])


@query(f"""WITH {CENSUS}, a AS (SELECT model_name, unnest(['all', language]) AS language, error_type, ok FROM d), n AS (SELECT model_name, language, count(*) AS cases, count(*) FILTER (NOT ok) AS bad FROM a GROUP BY ALL)
 SELECT model_name, language, error_type, count(*) AS count, round(count(*) / any_value(bad)::DOUBLE, 9) AS share_of_failures, round(count(*) / any_value(cases)::DOUBLE, 9) AS share_of_cases FROM a JOIN n USING (model_name, language) WHERE NOT ok GROUP BY ALL""")
def error_taxonomy_by_language(t):
    return census.taxonomy_by_language(diagnosed(t))


@query(f"""WITH {CENSUS}, w AS (SELECT case_id, any_value(language) AS language, bool_or(ok) FILTER (model_name = 'm0') AS a, bool_or(ok) FILTER (model_name = 'm1') AS b, list(error_type) FILTER (NOT ok AND model_name <> 'm2') AS e FROM d GROUP BY 1)
 SELECT case_id, language, CASE WHEN NOT a AND NOT b THEN 'both_failed' WHEN a THEN 'm0_only_passed' ELSE 'm1_only_passed' END AS pair_outcome,
 CASE WHEN list_contains(e, 'schema_type_only') THEN '{census.FOCUS[1][1]}' WHEN list_contains(e, 'duplicate_items_only') THEN '{census.FOCUS[2][1]}' WHEN list_contains(e, 'text_or_value_error') THEN '{census.FOCUS[3][1]}'
 WHEN list_contains(e, 'missing_or_extra_fields') THEN '{census.FOCUS[4][1]}' WHEN list_contains(e, 'invalid_json') THEN '{census.FOCUS[5][1]}' ELSE '{census.NO_FOCUS}' END AS diagnostic_focus FROM w WHERE NOT (a AND b)""")
def frontier_cases(t):
    return census.frontier_cases(diagnosed(t), MODELS, "m0", "m1").select("case_id", "language", "pair_outcome", "diagnostic_focus")


@query()
def review_groups(t):
    """No SQL: each quota depends on the products that the quotas before it took. A brute-force test holds it."""
    return census.review_cases(diagnosed(t), MODELS, "m0", "m1", ["m2"], 4, 0, 7).select("audit_case_id", "case_id", "selection_group", "selection_priority", "diagnostic_focus")


@query()
def review_passes(t):
    """The group of cases that all models pass, which m2 never does. No SQL, as for review_groups."""
    rows = diagnosed(t).where("model_name <> 'm2'")
    return census.review_cases(rows, MODELS[:2], "m0", "m1", [], 0, 4, 7).select("audit_case_id", "case_id", "selection_group", "selection_priority", "diagnostic_focus")


@query("SELECT 'language pair' AS rule, product_id::VARCHAR AS key, string_agg(DISTINCT language, ',' ORDER BY language) AS detail FROM (SELECT c_custkey // 2 AS product_id, CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'fr' END AS language FROM customer WHERE c_custkey % 9 <> 0) GROUP BY product_id HAVING count(DISTINCT language) < 2")
def result_contract(t):
    return census.result_violations(census_rows(t).where("case_id % 9 <> 0"), MODELS)


PLAN = judging.Protocol(("pass", "fail"), ("quality",), {"judge_variant_id": "j0", "trial_id": "t0", "prompt_variant_id": "p0", "identity_condition": "blinded", "presentation_order": "pointwise"}, slices={"lang": ("en", "de")}, thresholds={"validation_case_count": 10.0, "human_krippendorff_alpha": 0.5, "judge_human_cohen_kappa": 0.9, "failure_recall": 0.5, "subgroup_cases": 20.0})
_WORD = "CASE WHEN {} THEN 'pass' ELSE 'fail' END"


def judged_tables(t: Callable) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, human annotations and judge observations of the labelled documents."""
    d, word = F.col("doc_id"), lambda c: F.when(c, "pass").otherwise("fail")
    rows = t("labels").select("doc_id", "quality").join(t("documents").groupBy("doc_id").agg(F.min("lang").alias("lang")), "doc_id")
    cases = rows.select(d.alias("case_id"), F.when(d % 3 == 0, "calibration").otherwise("validation").alias("split"), "lang")
    good = F.col("quality") == 1
    say = lambda who, stage, c: F.struct(F.lit(who).alias("reviewer_id"), F.lit(stage).alias("annotation_stage"), word(c).alias("label"))
    humans = rows.select(d.alias("case_id"), F.lit("quality").alias("criterion"), F.explode(F.array(say("r1", "independent", good), say("r2", "independent", good != (d % 7 == 0)), say("lead", "adjudicated", good))).alias("x")).select("case_id", "criterion", "x.*")
    judged = rows.select("*", F.explode(F.lit([0, 1, 2])).alias("k"))
    status = F.when((d % 13 == 0) & (F.col("k") == 0), "error").otherwise("success")
    observations = judged.select(
        d.alias("case_id"), F.lit("quality").alias("criterion"), F.lit("j0").alias("judge_variant_id"), F.concat(F.lit("t"), F.col("k")).alias("trial_id"), F.lit("p0").alias("prompt_variant_id"), F.lit("blinded").alias("identity_condition"),
        F.lit("pointwise").alias("presentation_order"), F.when(status == "success", word(good != (d % 11 == F.col("k")))).alias("label"), status.alias("status"), F.when(d % 2 == 0, "0.25").alias("uncertainty"),
    )
    return cases, humans, observations


JUDGED = f"""l AS (SELECT labels.doc_id, quality = 1 AS good, (SELECT min(lang) FROM documents WHERE documents.doc_id = labels.doc_id) AS lang FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)),
 o AS (SELECT doc_id, k, CASE WHEN doc_id % 13 = 0 AND k = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN doc_id % 13 = 0 AND k = 0 THEN NULL ELSE {_WORD.format("good <> (doc_id % 11 = k)")} END AS label FROM l, range(3) r(k)),
 f AS (SELECT l.doc_id AS case_id, CASE WHEN l.doc_id % 3 = 0 THEN 'calibration' ELSE 'validation' END AS split, lang, {_WORD.format("good")} AS reference_label, o.label AS judge_label, status, CASE WHEN l.doc_id % 2 = 0 THEN 0.25 END AS uncertainty FROM l JOIN o ON o.doc_id = l.doc_id AND k = 0)"""


@query(f"WITH {JUDGED} SELECT case_id, split, reference_label, judge_label, status FROM f")
def baseline_labels(t):
    return judging.labelled(*judged_tables(t), PLAN).select("case_id", "split", "reference_label", "judge_label", "status")


def _interval(k: str, n: str, names: tuple[str, str], flipped: bool = False) -> str:
    low, high = wilson_sql(k, n)
    return f"1 - ({high}) AS {names[0]}, 1 - ({low}) AS {names[1]}" if flipped else f"{low} AS {names[0]}, {high} AS {names[1]}"


@query(f"""WITH {JUDGED}, g AS (SELECT *, status = 'success' AS done FROM f),
 c AS (SELECT split, count(*) AS cases, count(reference_label) AS human_reference_cases, count(*) FILTER (done) AS n, count(*) FILTER (status = 'error') AS judge_errors, count(*) FILTER (done AND reference_label = judge_label) AS same, count(uncertainty) FILTER (done) AS said,
 avg(uncertainty) FILTER (done) AS unsure, count(*) FILTER (done AND reference_label = 'fail') AS r, count(*) FILTER (done AND judge_label = 'fail') AS p, count(*) FILTER (done AND reference_label = 'fail' AND judge_label = 'fail') AS hit FROM g GROUP BY 1),
 k AS (SELECT *, same / n::DOUBLE AS o, (r * p + (n - r) * (n - p)) / (n * n)::DOUBLE AS e FROM c)
 SELECT split, cases, human_reference_cases, n AS comparable_cases, judge_errors, round((cases - n) / cases::DOUBLE, 9) AS observation_failure_rate, round(o, 9) AS raw_agreement, {_interval("same", "n", ("accuracy_ci_low", "accuracy_ci_high"))},
 round(said / n::DOUBLE, 9) AS reported_uncertainty_coverage, round(unsure, 9) AS average_reported_uncertainty, hit AS true_failure, r - hit AS false_approval, p - hit AS false_failure, n - r - p + hit AS true_approval,
 round(hit / p::DOUBLE, 9) AS failure_precision, round(hit / r::DOUBLE, 9) AS failure_recall, round((r - hit) / r::DOUBLE, 9) AS false_approval_rate, {_interval("hit", "p", ("failure_precision_ci_low", "failure_precision_ci_high"))},
 {_interval("hit", "r", ("failure_recall_ci_low", "failure_recall_ci_high"))}, {_interval("hit", "r", ("false_approval_rate_ci_low", "false_approval_rate_ci_high"), True)}, round(CASE WHEN e < 1 THEN (o - e) / (1 - e) WHEN o = 1 THEN 1.0 END, 9) AS cohen_kappa FROM k""")
def judge_agreement(t):
    """Judges against adjudicated labels by split: coverage, agreement, kappa, failure detection and their intervals."""
    names = "cases human_reference_cases comparable_cases judge_errors observation_failure_rate raw_agreement accuracy_ci_low accuracy_ci_high reported_uncertainty_coverage average_reported_uncertainty true_failure false_approval false_failure true_approval"
    names += " failure_precision failure_recall false_approval_rate failure_precision_ci_low failure_precision_ci_high failure_recall_ci_low failure_recall_ci_high false_approval_rate_ci_low false_approval_rate_ci_high cohen_kappa"
    return judging.judge_metrics(judging.labelled(*judged_tables(t), PLAN), PLAN, ["split"]).select("split", *names.split())


@query(f"""WITH {JUDGED}, s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (label = 'pass') AS a FROM o WHERE status = 'success' GROUP BY 1),
 u AS (SELECT sum(n) FILTER (n > 1) AS m, sum((a * (a - 1) + (n - a) * (n - a - 1)) / (n - 1)::DOUBLE) FILTER (n > 1) AS same, sum(a) FILTER (n > 1) AS pa, sum(n - a) FILTER (n > 1) AS pf,
 sum(a * (a - 1) / 2 + (n - a) * (n - a - 1) / 2) FILTER (n > 1) / sum(n * (n - 1) / 2) FILTER (n > 1) AS agree, count(*) FILTER (n = 3) AS whole, (SELECT count(*) FROM l) AS every FROM s)
 SELECT 'trial_id' AS condition, 3::BIGINT AS observed_value_count, every AS expected_cases, whole AS cases_with_all_conditions, round(whole / every::DOUBLE, 9) AS complete_condition_coverage, round(agree, 9) AS raw_agreement, round(1 - agree, 9) AS flip_rate,
 round(1 - (1 - same / m) / ((m::DOUBLE * m - pa::DOUBLE * pa - pf::DOUBLE * pf) / (m::DOUBLE * (m - 1))), 9) AS krippendorff_alpha FROM u""")
def alpha_by_condition(t):
    cases, _, observations = judged_tables(t)
    found = judging.condition_review(judging.baseline_observations(observations, PLAN, ("trial_id",)), "trial_id", cases)
    return found.select("condition", "observed_value_count", "expected_cases", "cases_with_all_conditions", "complete_condition_coverage", "raw_agreement", "flip_rate", "krippendorff_alpha")


@query(f"""WITH {JUDGED}, v AS (SELECT * FROM f WHERE split = 'validation') SELECT 'subgroup_cases:lang=' || s AS gate, 'decision_grade' AS level, n::DOUBLE AS observed, 20.0::DOUBLE AS threshold, coalesce(n >= 20, false) AS passed FROM (SELECT s, (SELECT nullif(count(*), 0) FROM v WHERE lang = s) AS n FROM (VALUES ('en'), ('de')) x(s))
 UNION ALL SELECT 'validation_case_count', 'calibrated', count(*)::DOUBLE, 10.0, count(*) >= 10 FROM v
 UNION ALL SELECT 'independent_human_raters', 'calibrated', 2.0, 2.0, true""")
def judge_gates(t):
    found = judging.gate_table(*judged_tables(t), PLAN).where("gate like 'subgroup%' or gate in ('validation_case_count', 'independent_human_raters')")
    return found.select("gate", "level", "observed", "threshold", "passed")


def extract(t: Callable) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, DataFrame]]:
    """Drug records and their child tables, made of parts."""
    k = F.col("p_partkey")
    p = t("part")
    code = k.alias("drug_code")
    drug = p.select(code, F.when(k % 19 == 0, "12").otherwise(F.lpad(k.cast("string"), 8, "0")).alias("din"), F.when(k % 23 == 0, " ").otherwise(F.col("p_name")).alias("brand_name"), F.when(k % 5 == 0, "Animal").otherwise(" HUMAN").alias("class"))
    status = p.where("p_partkey % 7 <> 0").select(code, F.when(k % 11 == 0, "Dormant").otherwise("Marketed").alias("status"), F.lit("x").alias("status_f"), F.lit(True).alias("current"))
    company = p.select(code, F.lit("1").alias("company_code"), F.when(k % 13 == 0, "").otherwise("co").alias("company_name"), F.lit("DIN_OWNER").alias("company_type"))
    part = lambda odd: p.where(k % odd != 0).select(code, F.lit("v").alias("value"))
    ingred = p.select(code, F.lit("v").alias("value"), F.when(k % 17 == 0, "some").otherwise("5.0").alias("strength"))
    return drug, status, company, {"ingred": ingred, "form": part(29), "route": part(31), "schedule": part(37)}


@query("""WITH r AS (SELECT p_partkey AS k, CASE WHEN k % 5 = 0 THEN 'not_human' WHEN k % 7 = 0 THEN 'missing_or_ambiguous_current_status' WHEN k % 11 = 0 THEN 'current_status_not_marketed' WHEN k % 19 = 0 THEN 'invalid_din' WHEN k % 23 = 0 THEN 'missing_brand_name'
 WHEN k % 13 = 0 THEN 'incomplete_din_owner' WHEN k % 29 = 0 THEN 'incomplete_form_rows' WHEN k % 31 = 0 THEN 'incomplete_route_rows' WHEN k % 37 = 0 THEN 'incomplete_schedule_rows' WHEN k % 17 = 0 THEN 'non_numeric_strength' END AS reason FROM part)
 SELECT k AS drug_code, reason FROM r""")
def eligibility_reasons(t):
    drug, status, company, children = extract(t)
    required = {n: ["value"] for n in children} | {"ingred": ["value", "strength"]}
    return family.eligibility(drug, status, company, children, required).select("drug_code", "reason")


@query("SELECT s_suppkey, s_acctbal, CASE WHEN s_acctbal > 5000 THEN 'ineligible' WHEN s_nationkey % 2 = 0 THEN 'ranked' ELSE 'descriptive' END AS status, CASE WHEN s_acctbal <= 5000 AND s_nationkey % 2 = 0 THEN (SELECT count(*) + 1 FROM supplier o WHERE o.s_acctbal <= 5000 AND o.s_nationkey % 2 = 0 AND o.s_acctbal > supplier.s_acctbal)::INTEGER END AS rank, (row_number() OVER (ORDER BY CASE WHEN s_acctbal > 5000 THEN 3 WHEN s_nationkey % 2 = 0 THEN 1 ELSE 2 END, CASE WHEN s_acctbal <= 5000 AND s_nationkey % 2 = 0 THEN -s_acctbal END, s_suppkey))::INTEGER AS place FROM supplier")
def leaderboard(t):
    s = t("supplier").select("s_suppkey", "s_acctbal", F.when(F.col("s_acctbal") > 5000, "ineligible").when(F.col("s_nationkey") % 2 == 0, "ranked").otherwise("descriptive").alias("status"))
    return board.leaderboard(s, "s_acctbal", "s_suppkey")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F') WHERE k <= 10")
def first_failures(t):
    return board.first_failures(t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice", (F.col("o_orderstatus") != "F").alias("final_passed")), ["o_orderpriority"], ["o_totalprice", "o_orderkey"], 10).drop("final_passed")


@query("SELECT n_regionkey AS model_name, count(*) AS samples, round(avg(score), 9) AS accuracy, round(CASE WHEN count(*) > 1 THEN sqrt(var_samp(score) / count(*)) END, 9) AS stderr FROM (SELECT n_regionkey, (n_nationkey % 2)::DOUBLE AS score FROM nation) GROUP BY 1")
def scorer_metrics(t):
    return board.scorer_metrics(t("nation").select(F.col("n_regionkey").alias("model_name"), (F.col("n_nationkey") % 2).cast("double").alias("score")), ["model_name"])


@query("SELECT l_orderkey::VARCHAR AS v, replace(replace(format('{:,}', l_orderkey), ',', ' '), '_', '') AS grouped, CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::BIGINT::VARCHAR ELSE l_quantity::VARCHAR END AS strength FROM (SELECT DISTINCT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey >= 1000)")
def number_texts(t):
    rows = t("lineitem").where("l_orderkey >= 1000").select("l_orderkey", "l_quantity").distinct()
    v = F.col("l_orderkey").cast("string")
    return rows.select(v.alias("v"), F.element_at(text.number_spellings(v), -1).alias("grouped"), text.strength(F.col("l_quantity").cast("string")).alias("strength"))


@query("SELECT pricing_id, n AS requests, first_seen FROM (SELECT o_orderpriority AS pricing_id, count(*) AS n, min(o_orderkey) AS first_seen FROM orders GROUP BY 1)")
def observed_prices(t):
    return board.observed(t("orders").select(F.col("o_orderpriority").alias("pricing_id"), "o_orderkey"), ["pricing_id"], "o_orderkey").select("pricing_id", F.col("rows").alias("requests"), "first_seen")


@query("SELECT o_custkey AS case_id, count(DISTINCT o_orderpriority) || ' of 5' AS detail FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) < 5")
def short_cases(t):
    return validate.short_cases(t("orders"), "o_custkey", "o_orderpriority").select(F.col("key").cast("long").alias("case_id"), "detail")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice::VARCHAR AS shown FROM lineitem WHERE l_linenumber = 1 AND l_extendedprice::VARCHAR NOT LIKE '%e%' AND l_extendedprice <> floor(l_extendedprice)")
def shown_doubles(t):
    x = F.col("l_extendedprice")
    return t("lineitem").where((F.col("l_linenumber") == 1) & (x != F.floor(x))).select("l_orderkey", "l_linenumber", "l_partkey", tables.shown_double(x).alias("shown"))


AS_OF = datetime.date(2026, 1, 1)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'superseded' WHEN o_orderdate::DATE < DATE '1995-06-01' THEN 'stale' ELSE 'current' END AS effective_status, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE greatest(0, DATE '1995-06-01' - o_orderdate::DATE) END::INTEGER AS overdue_days FROM orders")
def evidence_status(t):
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "superseded").otherwise("current").alias("status"), F.col("o_orderdate").cast("date").alias("review_by"))
    return contracts.evidence_status(rows, datetime.date(1995, 6, 1)).select("id", "effective_status", "overdue_days")


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'blocked' WHEN p_size > 40 THEN 'blocked' WHEN p_size < 10 THEN 'stale' WHEN p_size % 7 = 0 THEN 'free' ELSE 'ready' END AS status FROM part")
def price_readiness(t):
    n = F.col("p_size")
    rate = F.when(n % 5 != 0, F.when(n % 7 == 0, 0.0).otherwise(F.col("p_retailprice")))
    day = F.when(n > 40, F.lit(datetime.date(2026, 2, 1))).when(n < 10, F.lit(datetime.date(2025, 1, 1))).otherwise(F.lit(datetime.date(2025, 12, 1)))
    return t("part").select("p_partkey", contracts.price_status(rate, rate, day, AS_OF).alias("status"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'not a JSON object' WHEN 1 THEN 'fit: no reason' WHEN 2 THEN 'tone: score out of range' WHEN 3 THEN 'missing criteria: tone' WHEN 4 THEN 'unexpected criteria: ' || event_type END AS error,
 CASE WHEN event_id % 7 > 4 THEN round((3 * (event_id % 6) / 5.0 + (event_id % 4) / 5.0) / 4, 9)::DOUBLE END AS score FROM events""")
def judge_responses(t):
    """Two criteria with weights 3 and 1 on a scale to 5, scores by the event's number, and a fault in five of seven."""
    e = F.col("event_id")
    one = lambda score, reason="r": F.struct(score.alias("score"), F.lit(reason).alias("reason"))
    fit, tone = e % 6, e % 4
    answer = lambda *c: F.to_json(F.struct(F.struct(*c).alias("criteria"), F.lit("o").alias("overall_reason")))
    full = answer(one(fit).alias("fit"), one(tone).alias("tone"))
    more = F.regexp_replace(full, '"tone":', F.concat(F.lit('"'), F.col("event_type"), F.lit('":{},"tone":')))
    said = F.when(e % 7 == 0, F.concat(full, F.lit(" so"))).when(e % 7 == 1, answer(one(fit, " ").alias("fit"), one(tone).alias("tone"))).when(e % 7 == 2, answer(one(fit).alias("fit"), one(tone + 6).alias("tone")))
    said = said.when(e % 7 == 3, answer(one(fit).alias("fit"))).when(e % 7 == 4, more).otherwise(F.concat(F.lit("```json\n"), full, F.lit("\n```")))
    return t("events").select("event_id", contracts.judge_response(said, {"fit": 3.0, "tone": 1.0}, 0, 5).alias("x")).select("event_id", "x.error", "x.score")


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def merged_scores(t):
    s = t("supplier")
    return contracts.one_to_one(s.select("s_suppkey", "s_nationkey"), s.select("s_suppkey", "s_acctbal"), ["s_suppkey"])


@query("SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'missing member' ELSE 'extra member' END AS rule, lower(n_name) AS key FROM nation WHERE n_nationkey % 3 <> 1 UNION ALL SELECT 'repeated member', lower(n_name) FROM nation WHERE n_nationkey % 3 = 1 AND n_nationkey % 2 = 0")
def member_differences(t):
    n = t("nation")
    twice = n.where("n_nationkey % 3 = 1 and n_nationkey % 2 = 0").select(F.lower("n_name").alias("id"))
    mine = n.where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("id")).unionByName(twice)
    return manifest.membership_violations(mine, "id", n.where("n_nationkey % 3 <> 2").select(F.upper("n_name").alias("id"))).select("rule", "key")


@query("SELECT c_mktsegment AS \"column\", c_nationkey::VARCHAR AS value, count(*) AS rows FROM (SELECT 'c_mktsegment' AS c_mktsegment, c_mktsegment AS c_nationkey FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR FROM customer) GROUP BY 1, 2")
def value_counters(t):
    return board.counters(t("customer"), ["c_mktsegment", "c_nationkey"])


@query("""WITH s AS (SELECT s_nationkey AS model_name, s_suppkey % 7 AS c, (s_acctbal > 0)::INT::DOUBLE AS score FROM supplier), m AS (SELECT *, avg(score) OVER (PARTITION BY model_name) AS accuracy, count(*) OVER (PARTITION BY model_name) AS n FROM s),
 r AS (SELECT model_name, c, accuracy, n, sum(score - accuracy) AS r FROM m GROUP BY ALL)
 SELECT model_name, count(*) AS clusters, round(accuracy, 9) AS accuracy, n AS samples, round(CASE WHEN count(*) > 1 THEN sqrt(sum(r * r) * count(*) / (count(*) - 1)) / n END, 9) AS stderr FROM r GROUP BY model_name, accuracy, n""")
def clustered_scores(t):
    rows = t("supplier").select(F.col("s_nationkey").alias("model_name"), (F.col("s_suppkey") % 7).alias("c"), (F.col("s_acctbal") > 0).cast("double").alias("score"))
    return board.clustered_error(rows, ["model_name"], "c").select("model_name", "clusters", "accuracy", "samples", "stderr")


@query(f"""WITH {CENSUS}, w AS (SELECT case_id, coalesce(list(DISTINCT error_type) FILTER (NOT ok), []) AS e FROM d GROUP BY 1)
 SELECT case_id, CASE WHEN len(e) = 0 THEN 'none' ELSE 'model' END AS error_owner, CASE WHEN len(e) = 0 THEN 'none' WHEN list_contains(e, 'text_or_value_error') THEN 'medium' ELSE 'low' END AS operational_severity,
 CASE WHEN len(e) = 0 THEN 'control' WHEN len(list_filter(e, lambda c: c NOT IN ('schema_type_only', 'duplicate_items_only'))) = 0 THEN 'shape' ELSE 'text' END AS ground FROM w""")
def audit_decisions(t):
    bad = ~F.col("final_passed")
    per = diagnosed(t).groupBy("case_id").agg(F.collect_set(F.when(bad, F.col("error_type"))).alias("e"), F.flatten(F.collect_set(F.when(bad, F.col("json_mismatched_fields")))).alias("m"))
    return per.select("case_id", board.audit_decision(F.col("e"), F.col("m"), ["s"]).alias("x")).select("case_id", "x.*")


@query()
def diverse_demo(t):
    """No SQL: each product depends on the ingredients of those before it. A brute-force test holds it."""
    p = t("part")
    rows = p.select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_size") > 25, "large").otherwise("small").alias("stratum"), F.array(F.col("p_brand"), F.col("p_type")).alias("ingredients"), F.array(F.pmod("p_partkey", F.lit(3)).cast("string")).alias("routes"))
    chosen = cohort.diverse_products(rows, {"large": 3, "small": 3}, {"first": ["0"]}, 5)
    return p.sparkSession.createDataFrame([(c, k + 1) for k, c in enumerate(chosen)], "product_id string, pick int")


@query("SELECT model_name, rows, cases FROM (SELECT l_returnflag AS model_name, count(*) AS rows, count(DISTINCT l_orderkey) AS cases FROM lineitem GROUP BY 1)")
def group_records(t):
    return reshape.group_records(t("lineitem"), ["l_returnflag"], "l_orderkey").select(F.col("l_returnflag").alias("model_name"), "rows", "cases")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def keep_first(t):
    return reshape.keep_first(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])
