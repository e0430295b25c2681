"""Comparison of models on a census of bilingual cases: contract, overview, fields, frontier and review samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.jsonscore import STRUCTURAL, JsonRules, Shape, json_error, json_score
from ..functions.stats import ratio
from ..functions.text import hash_order
from .summary import error_taxonomy, mean_of, paired_language
from .validate import definition_conflicts, duplicate_keys, require_columns, short_cases, unknown_values, violations

#: Columns of a result table, and those that are the same for every model.
REQUIRED = [
    "case_id", "product_id", "language", "stratum", "input", "expected_output", "source_metadata",
    "model_name", "model_output", "generation_status", "generation_seconds", "generation_cost_usd", "final_score", "final_passed",
]
INVARIANT = ["product_id", "language", "stratum", "input", "expected_output", "source_metadata"]
LANGUAGES = ["en", "fr"]
#: Order in which strata are sampled for review.
STRATA = ["multi_ingredient_multi_variant", "multi_variant", "multi_ingredient", "single_ingredient"]
#: What a reviewer looks at, by the error classes of a case, the first that is there.
FOCUS = [
    (["compound_label_split_only"], "Adjudicate whether the rendered compound DPD label is unambiguous."),
    (["schema_type_only"], "Verify the strict scalar and list JSON contract."),
    (["duplicate_items_only", "schema_and_duplicates"], "Verify distinct-fact aggregation across product variants."),
    (["text_or_value_error"], "Compare the transcription with the frozen source label."),
    (["missing_or_extra_fields"], "Verify required and prohibited JSON fields."),
    (["invalid_json"], "Verify JSON parseability and retained source facts."),
]
NO_FOCUS = "Verify the source record, expected answer, and strict score."
#: Review groups in order of priority.
GROUPS = ["primary_model_failure", "comparison_only_failure", "lower_tier_shared_failure_sample", "all_model_pass_sample"]


def result_violations(results: DataFrame, models: list[str] | None = None) -> DataFrame:
    """(rule, key, detail): repeated pairs, cases without every model, cases that differ between models, languages, and products that
    lack one case of each language; models: names that must be there."""
    require_columns(results, REQUIRED)
    products = results.groupBy("product_id").agg(F.array_sort(F.collect_set("language")).alias("languages"))
    lone = products.where(F.col("languages") != F.lit(LANGUAGES)).select(F.lit("language pair").alias("rule"), F.col("product_id").cast("string").alias("key"), F.concat_ws(",", "languages").alias("detail"))
    found = [duplicate_keys(results, ["case_id", "model_name"]), short_cases(results, "case_id", "model_name"), definition_conflicts(results, "case_id", INVARIANT), unknown_values(results, "language", LANGUAGES), lone]
    if models:
        have = results.select("model_name").distinct()
        absent = results.sparkSession.createDataFrame([(m,) for m in models], "model_name string").join(have, "model_name", "left_anti")
        found.append(absent.select(F.lit("missing model").alias("rule"), F.col("model_name").alias("key"), F.lit("absent").alias("detail")))
    return violations(*found)


def diagnosed(results: DataFrame, shape: Shape, rules: JsonRules = JsonRules()) -> DataFrame:
    """results with error_type and the fields of each output that are missing, extra or mismatched. An output that is no object
    has all fields missing."""
    score = json_score(F.col("expected_output"), F.coalesce("model_output", F.lit("")), rules)
    out = results.withColumns({"error_type": json_error(F.col("expected_output"), F.col("model_output"), shape, rules, F.col("generation_status")), "scored": score})
    none = F.array().cast("array<string>")
    names = ["output_is_json", "json_missing_fields", "json_extra_fields", "json_mismatched_fields"]
    return out.select(*results.columns, "error_type", F.col("scored.output_is_json").alias(names[0]), *[F.coalesce(F.col(f"scored.{n}"), none).alias(n) for n in names[1:]])


def model_overview(diagnosed_rows: DataFrame) -> DataFrame:
    """Quality, latency, cost, bilingual products and what repairs of shape would add, per model. One shuffle, one more by product."""
    cases, passed = F.count(F.lit(1)), F.count_if("final_passed")
    failed = ~F.coalesce(F.col("final_passed"), F.lit(False))
    of_class = lambda *names: F.count_if(failed & F.col("error_type").isin(*names))
    cost = F.coalesce(F.sum(F.col("generation_cost_usd").cast("string").try_cast("double")), F.lit(0.0))
    seconds = F.col("generation_seconds").cast("string").try_cast("double")
    out = diagnosed_rows.groupBy("model_name").agg(
        cases.alias("cases"), passed.alias("passed_cases"), (cases - passed).alias("failed_cases"), ratio(passed, cases).alias("pass_rate"), F.avg("final_score").alias("average_field_score"),
        F.count_if(F.coalesce(F.col("generation_status"), F.lit("")) != "success").alias("generation_failures"), F.avg(seconds).alias("average_latency_seconds"), F.percentile(seconds, F.lit(0.95)).alias("p95_latency_seconds"),
        cost.alias("total_cost_usd"), (cost / cases * 1000).alias("cost_per_1000_cases_usd"),
        of_class("schema_type_only").alias("schema_type_only_failures"), (passed + of_class("schema_type_only")).alias("schema_type_repair_sensitivity_passes"), ratio(passed + of_class("schema_type_only"), cases).alias("schema_type_repair_sensitivity_rate"),
        of_class(*STRUCTURAL).alias("all_structural_failures"), (passed + of_class(*STRUCTURAL)).alias("structural_repair_sensitivity_passes"), ratio(passed + of_class(*STRUCTURAL), cases).alias("structural_repair_sensitivity_rate"),
        of_class("text_or_value_error").alias("remaining_text_or_value_failures"),
    )
    pairs = paired_language(diagnosed_rows, "product_id", tuple(LANGUAGES)).select(
        "model_name", F.col("pairs").alias("product_families"), F.col("both_passed").alias("both_languages_passed_products"), F.col("one_failed").alias("one_language_failed_products"),
        F.col("both_failed").alias("both_languages_failed_products"), F.col("bilingual_pass_rate").alias("bilingual_product_pass_rate"),
    )
    return out.join(pairs, "model_name")


def _with_all(rows: DataFrame) -> DataFrame:
    """Each row under its own language and under `all`."""
    return rows.withColumn("language", F.explode(F.array(F.lit("all"), F.col("language"))))


def field_accuracy_by_language(diagnosed_rows: DataFrame, fields: list[str]) -> DataFrame:
    """How often each field matches, per model and language and over all, with `__schema_contract__`: no field missing or extra."""
    # an output that is no object has all fields missing
    wrong = F.array_union("json_missing_fields", "json_mismatched_fields")
    fine = F.size("json_missing_fields") + F.size("json_extra_fields") == 0
    checks = F.array(*[F.struct(F.lit(f).alias("field_name"), (~F.array_contains(wrong, f)).alias("ok")) for f in fields], F.struct(F.lit("__schema_contract__").alias("field_name"), fine.alias("ok")))
    rows = _with_all(diagnosed_rows.select("model_name", "language", F.explode(checks).alias("x")))
    n, ok = F.count(F.lit(1)), F.count_if("x.ok")
    return rows.groupBy("model_name", "language", "x.field_name").agg(n.alias("cases"), ok.alias("matching_cases"), (n - ok).alias("mismatched_cases"), mean_of(F.col("x.ok")).alias("field_accuracy"))


def taxonomy_by_language(diagnosed_rows: DataFrame) -> DataFrame:
    """Error classes of failed cases, per model and language and over all, as shares of failures and of cases."""
    rows = diagnosed_rows.select("model_name", "language", F.when(~F.coalesce(F.col("final_passed"), F.lit(False)), F.col("error_type")).alias("error_type"))
    return error_taxonomy(_with_all(rows), ["model_name", "language"])


def audit_focus(error_types: Column) -> Column:
    """What to look at, by the first entry of FOCUS of which a class is among the error types."""
    out = F
    for classes, said in FOCUS:
        out = out.when(F.arrays_overlap(error_types, F.lit(classes)), said)
    return out.otherwise(NO_FOCUS)


def case_records(diagnosed_rows: DataFrame, models: list[str], focus: list[str] | None = None) -> DataFrame:
    """One row per case: its metadata, five columns for each model, and the focus from failures of the focus models."""
    meta = [c for c in ("product_id", "language", "stratum", "brand_name", "input", "expected_output", "source_metadata") if c in diagnosed_rows.columns]
    shown = {"passed": "final_passed", "field_score": "final_score", "error_type": "error_type", "mismatched_fields": "json_mismatched_fields", "model_output": "model_output"}
    each = [F.max(F.when(F.col("model_name") == m, F.col(c))).alias(f"{m}_{n}") for m in models for n, c in shown.items()]
    failed = F.col("model_name").isin(*(focus or models)) & ~F.coalesce(F.col("final_passed"), F.lit(False))
    out = diagnosed_rows.groupBy("case_id").agg(*[F.max(c).alias(c) for c in meta], *each, F.collect_set(F.when(failed, F.col("error_type"))).alias("failed_types"))
    return out.withColumn("diagnostic_focus", audit_focus(F.col("failed_types"))).drop("failed_types")


def frontier_cases(diagnosed_rows: DataFrame, models: list[str], primary: str, comparison: str) -> DataFrame:
    """Cases that either of two models fails, with who passed."""
    a, b = F.coalesce(F.col(f"{primary}_passed"), F.lit(False)), F.coalesce(F.col(f"{comparison}_passed"), F.lit(False))
    outcome = F.when(~a & ~b, "both_failed").when(a, f"{primary}_only_passed").otherwise(f"{comparison}_only_passed")
    return case_records(diagnosed_rows, models, [primary, comparison]).where(~(a & b)).withColumn("pair_outcome", outcome)


def stratified_cases(cases: DataFrame, count: int, seed: int, purpose: str) -> list[str]:
    """`count` case ids, at most one per product: a quota from each stratum and language in order, by seeded hash, and the rest from
    whatever is left, by another.

    A group takes the first row of each of its products, and the groups before it can take at most `count` products away, so its first
    2 * count products are all that the driver has to see. The fill is another query, over the products that no quota took. Too few cases are an error."""
    if count <= 0:
        return []
    order = lambda what: hash_order(seed, F.lit(what), F.col("case_id").cast("string"), separator="|")
    ranked = cases.select(F.col("case_id").cast("string").alias("case_id"), F.col("product_id").cast("string").alias("product_id"), "stratum", "language", order(purpose).alias("h"), order(f"{purpose}:fill").alias("fill"))
    heads = ranked.groupBy("stratum", "language", "product_id").agg(F.min_by("case_id", "h").alias("case_id"), F.min("h").alias("h"))
    group = W.partitionBy("stratum", "language").orderBy("h")
    first = heads.withColumn("k", F.row_number().over(group)).where(F.col("k") <= 2 * count).orderBy("h").collect()
    chosen: list[str] = []
    used: set[str] = set()
    groups = [(s, x) for s in STRATA for x in LANGUAGES]
    for k, key in enumerate(groups):
        quota = count // len(groups) + (k < count % len(groups))
        for r in first:
            if quota and (r["stratum"], r["language"]) == key and r["product_id"] not in used:
                chosen.append(r["case_id"])
                used.add(r["product_id"])
                quota -= 1
    # the fill may repeat products of its own, but none that a quota took
    if len(chosen) < count:
        free = ranked.where(~F.coalesce(F.col("product_id").isin(sorted(used)), F.lit(False))) if used else ranked
        chosen += [r["case_id"] for r in free.orderBy("fill").limit(count - len(chosen)).collect()]
    if len(chosen) < count:
        raise ValueError(f"{purpose}: {len(chosen)} of {count} cases")
    return chosen


def review_cases(diagnosed_rows: DataFrame, models: list[str], primary: str, comparison: str, lower: list[str], shared: int = 25, passes: int = 25, seed: int = 0, prefix: str = "audit") -> DataFrame:
    """Cases for people to review, in four groups: all failures of the primary model, those of the comparison model alone,
    and stratified samples of cases that all lower models fail, or that all models pass; numbered in order."""
    flags = [F.coalesce(F.max(F.when(F.col("model_name") == m, F.col("final_passed"))), F.lit(False)).alias(f"ok_{k}") for k, m in enumerate(models)]
    each = diagnosed_rows.groupBy("case_id").agg(*[F.max(c).alias(c) for c in ("product_id", "stratum", "language")], *flags)
    ok = {m: F.col(f"ok_{k}") for k, m in enumerate(models)}
    apart = each.where(ok[primary] & ok[comparison])
    low = []
    if lower and all(m in ok for m in lower):
        failing = apart
        for m in lower:
            failing = failing.where(~ok[m])
        low = stratified_cases(failing, shared, seed, "lower_tier_shared_failure")
    every = apart.where(~F.col("case_id").cast("string").isin(low))
    for m in models:
        every = every.where(ok[m])
    fine = stratified_cases(every, passes, seed, "all_model_pass")
    spark = diagnosed_rows.sparkSession
    sampled = spark.createDataFrame([(c, p, k) for p, ids in ((3, low), (4, fine)) for k, c in enumerate(ids)], "case_id string, selection_priority int, place long")
    failures = each.where(~(ok[primary] & ok[comparison])).select(F.col("case_id").cast("string").alias("case_id"), F.when(~ok[primary], 1).otherwise(2).alias("selection_priority"), F.lit(0).cast("long").alias("place"))
    picked = failures.unionByName(sampled)
    number = F.row_number().over(W.orderBy("selection_priority", "place", "case_id"))  # as many rows as people review
    picked = picked.select("case_id", "selection_priority", F.element_at(F.lit(GROUPS), F.col("selection_priority")).alias("selection_group"), F.format_string(f"{prefix}-%04d", number).alias("audit_case_id"))
    out = None
    for priority, focus in ((1, [primary, comparison]), (2, [primary, comparison]), (3, lower), (4, models)):
        if priority != 2:  # the first two groups have one focus
            rows = diagnosed_rows.withColumn("case_id", F.col("case_id").cast("string")).join(picked.where(F.col("selection_priority").isin([1, 2] if priority == 1 else [priority])).select("case_id"), "case_id", "left_semi")
            part = case_records(rows, models, focus)
            out = part if out is None else out.unionByName(part)
    return picked.join(out, "case_id")
