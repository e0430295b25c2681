"""Results per row and summaries per model, slice, field and case."""

from __future__ import annotations

import math

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cost import complete_sum
from ..functions.stats import rank_present, ratio, wilson


def mean_of(flag: Column) -> Column:
    """Share of true among known values, null if none is known."""
    return F.avg(flag.cast("double"))


def final_results(scored: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Deterministic scores and stored judge results to final_score, final_passed, evaluation_source.

    A failed generation scores 0 and fails. A judge error stays null: it is unscored. A row that needs a judge and has no judge result at all fails the query.
    judged: (case_id, model_name, judge_status, judge_score, judge_passed)."""
    keys = ["case_id", "model_name"]
    df = scored if judged is None else scored.join(judged.withColumn("__judged", F.lit(True)), keys, "left")
    there = F.lit("judge_status" in scored.columns) if judged is None else F.col("__judged").isNotNull()
    for name, kind in (("judge_status", "string"), ("judge_score", "double"), ("judge_passed", "boolean"), ("generation_status", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    failed = generation_failed(F.col("generation_status"))
    judge_ok = F.lower(F.trim("judge_status")) == "success"
    fixed = F.when(F.col("evaluation_type") == "exact", F.col("metric_passed").cast("double")).when(F.col("evaluation_type") == "json", F.coalesce("json_field_match_rate", F.col("metric_passed").cast("double")))
    asks = ~failed & ~F.coalesce(F.col("metric_applicable"), F.lit(False)) & ~there
    absent = F.raise_error(F.concat(F.lit("no judge result for case "), F.col("case_id").cast("string"), F.lit(" of model "), F.col("model_name")))
    return df.withColumns(
        {
            "final_score": F.when(asks, absent.cast("double")).when(failed, 0.0).when(F.col("metric_applicable"), fixed).when(judge_ok, F.col("judge_score")),
            "final_passed": F.when(failed, False).when(F.col("metric_applicable"), F.col("metric_passed")).when(judge_ok, F.col("judge_passed")),
            "evaluation_source": F.when(asks, absent.cast("string")).when(failed, "generation_error").when(F.col("metric_applicable"), "deterministic").when(judge_ok, "llm_judge").otherwise("judge_error"),
        }
    ).drop("__judged")


def generation_failed(status: Column) -> Column:
    """Null is not failed; anything but success is."""
    return F.coalesce(F.lower(F.trim(status)) != "success", F.lit(False))


def is_request(status: Column) -> Column:
    return F.lower(F.trim(F.coalesce(status, F.lit("")))).isin("success", "error")


def stage_measures(prefix: str, columns: list[str]) -> list[Column]:
    """The measures of an operational stage (generation or judge) as aggregates: missing stays missing, and coverage stands
    beside each total. Absent columns count as all missing."""

    def value(name: str) -> Column:
        column = f"{prefix}_{name}"
        given = F.col(column).cast("string").try_cast("double") if column in columns else F.lit(None).cast("double")
        return F.when(asked, given)

    status = F.col(f"{prefix}_status") if f"{prefix}_status" in columns else F.lit(None).cast("string")
    asked = is_request(status)
    said = F.lower(F.trim(status))
    n = F.count_if(asked)
    share = lambda k: ratio(k, n)
    seconds = value("seconds")
    source = F.trim(F.col(f"{prefix}_cost_source")) if f"{prefix}_cost_source" in columns else F.lit(None).cast("string")
    out = {
        "requests": n,
        "successes": F.count_if(said == "success"),
        "errors": F.count_if(said == "error"),
        "failure_rate": share(F.count_if(said == "error")),
        "average_seconds": F.avg(seconds),
        "p95_seconds": F.percentile(seconds, F.lit(0.95)),
        "latency_observations": F.count(seconds),
        "latency_coverage": share(F.count(seconds)),
    }
    for name, column in (("api_attempts", "attempts"), ("failed_api_attempts", "failed_attempts"), *((t, t) for t in ("prompt_tokens", "cached_prompt_tokens", "completion_tokens", "total_tokens"))):
        out[name] = complete_sum(value(column), n).cast("long")
    out |= {"token_observations": F.count(value("total_tokens")), "token_coverage": share(F.count(value("total_tokens")))}
    for name in ("cost_usd", "configured_cost_usd", "provider_reported_cost_usd"):
        short = name.removesuffix("_usd")
        seen = F.count(value(name))
        out |= {name: complete_sum(value(name), n), f"{short}_observations": seen, f"{short}_coverage": share(seen), f"{short}_complete": F.when(n > 0, seen == n)}
    out["cost_sources"] = F.concat_ws(", ", F.array_sort(F.collect_set(F.when(asked & (source != ""), source))))
    return [c.alias(f"{prefix}_{name}") for name, c in out.items()]


def stage_operations(df: DataFrame, prefix: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*stage_measures(prefix, df.columns))


def quality_measures() -> list[Column]:
    passed, scored = F.count_if(F.col("final_passed")), F.count("final_passed")
    low, high = wilson(passed, scored)
    return [
        F.count(F.lit(1)).alias("cases"),
        scored.alias("scored_cases"),
        (F.count(F.lit(1)) - scored).alias("unscored_cases"),
        passed.alias("passed_cases"),
        (scored - passed).alias("failed_cases"),
        ratio(passed, scored).alias("pass_rate"),
        low.alias("pass_rate_ci_low"),
        high.alias("pass_rate_ci_high"),
        F.avg("final_score").alias("average_score"),
    ]


def model_summary(results: DataFrame, by: str = "model_name", operations: tuple[str, ...] = ()) -> DataFrame:
    """Quality, Wilson interval and, as asked for, operations of each model, ranked by pass rate; one shuffle."""
    measures = quality_measures()
    for prefix in operations:
        measures += stage_measures(prefix, results.columns)
    out = results.groupBy(by).agg(*measures)
    return out.select(rank_present(F.col("pass_rate")).alias("rank"), *out.columns)


def metrics_summary(scored: DataFrame) -> DataFrame:
    """Counts by route and rates of deterministic metrics per model."""
    exact, is_json = F.col("evaluation_type") == "exact", F.col("evaluation_type") == "json"
    rate = lambda name, route: F.avg(F.when(F.col("metric_applicable") & route, F.col(name).cast("double")))
    out = scored.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if("metric_applicable").alias("evaluated_cases"),
        F.count_if(~F.col("metric_applicable")).alias("skipped_cases"),
        F.count_if(exact).alias("exact_cases"),
        F.count_if(is_json).alias("json_cases"),
        rate("metric_passed", F.lit(True)).alias("metric_pass_rate"),
        rate("exact_match", exact).alias("exact_match_rate"),
        rate("normalized_exact_match", exact).alias("normalized_exact_match_rate"),
        rate("output_is_json", is_json).alias("valid_json_rate"),
        rate("json_exact_match", is_json).alias("json_exact_match_rate"),
        rate("json_canonical_match", is_json).alias("json_canonical_match_rate"),
        rate("json_field_match_rate", is_json).alias("average_json_field_match_rate"),
    )
    return out.select(rank_present(F.col("metric_pass_rate")).alias("rank"), *out.columns)


def judge_summary(judged: DataFrame) -> DataFrame:
    """Per model: cases, mean score and pass rate, the mean of every criterion's score, total tokens, rank."""
    criteria = sorted(c for c in judged.columns if c.endswith("_score") and c != "judge_score")
    tokens = [F.sum(c).alias(c) for c in judged.columns if c.endswith("_tokens")]
    out = judged.groupBy("model_name").agg(F.count(F.lit(1)).alias("cases"), F.avg("judge_score").alias("average_score"), mean_of(F.col("judge_passed")).alias("pass_rate"), *[F.avg(c).alias(f"average_{c}") for c in criteria], *tokens)
    return out.select(rank_present(F.col("average_score")).alias("rank"), *out.columns)


def slice_summary(results: DataFrame, slices: list[str], by: str = "model_name") -> DataFrame:
    """(model, slice_type, slice_value) summaries of each slice column, null values as a group of their own. One shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("slice_type"), F.col(s).cast("string").alias("slice_value")) for s in slices])).alias("x")
    return results.select(by, "final_passed", "final_score", each).groupBy(by, "x.slice_type", "x.slice_value").agg(*quality_measures())


def slice_sets(results: DataFrame, by: str, sets: list[list[str]]) -> DataFrame:
    """Summaries by model over grouping sets of slice columns, labelled by the set; one scan."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    out = results.groupingSets([[by, *s] for s in sets], by, *columns).agg(F.grouping_id(by, *columns).alias("__set"), *quality_measures())
    label = None
    for s in sets:
        bits = sum(1 << (len(columns) - 1 - k) for k, c in enumerate(columns) if c not in s)
        name = "_by_".join(s) or "overall"
        label = F.when(F.col("__set") == bits, name) if label is None else label.when(F.col("__set") == bits, name)
    return out.withColumn("slice_type", label).drop("__set")


def field_accuracy(scored: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """How often each field matches: the output is JSON, and the field neither missing nor mismatched."""
    wrong = F.array_union(F.coalesce("json_missing_fields", F.array().cast("array<string>")), F.coalesce("json_mismatched_fields", F.array().cast("array<string>")))
    each = scored.select(*by, F.col("output_is_json").alias("ok"), wrong.alias("wrong"), F.explode(F.lit(fields)).alias("field_name"))
    match = F.coalesce(F.col("ok"), F.lit(False)) & ~F.array_contains("wrong", F.col("field_name"))
    return each.groupBy(*by, "field_name").agg(F.count(F.lit(1)).alias("cases"), F.count_if(match).alias("matching_cases"), F.count_if(~match).alias("mismatched_cases"), mean_of(match).alias("field_accuracy"))


def case_outcomes(results: DataFrame, models: list[str], case: str = "case_id", model: str = "model_name") -> DataFrame:
    """What the models make of each case, with one column passed__<model> each."""
    wide = results.groupBy(case).agg(
        F.count("final_passed").alias("scored"),
        F.count_if("final_passed").alias("passes"),
        *[F.max(F.when(F.col(model) == m, F.col("final_passed"))).alias(f"passed__{m}") for m in models],
    )
    n = len(models)
    one = F.when(F.col("passes") == 1, "passed").otherwise("failed")
    label = F.when(F.col("scored") < n, "incomplete").when(F.lit(n == 1), one).when(F.col("passes") == n, "all_passed").when(F.col("passes") == 0, "all_failed").otherwise("disagreement")
    return wide.withColumn("outcome", label)


def error_taxonomy(errors: DataFrame, by: list[str], error: str = "error_type") -> DataFrame:
    """Counts of error types, as shares of failures (rows with an error) and of all cases of the group."""
    from pyspark.sql import Window as W

    counts = errors.groupBy(*by, error).agg(F.count(F.lit(1)).alias("count"))
    every = W.partitionBy(*by)
    out = counts.withColumns({"__cases": F.sum("count").over(every), "__failures": F.sum(F.when(F.col(error).isNotNull(), F.col("count"))).over(every)})
    return out.where(F.col(error).isNotNull()).select(*by, error, "count", ratio(F.col("count"), F.col("__failures")).alias("share_of_failures"), ratio(F.col("count"), F.col("__cases")).alias("share_of_cases"))


def bundle_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Summary of a result bundle: totals of observed costs even where some are missing, median and p95 latency."""
    failed = F.lower(F.trim(F.coalesce("generation_status", F.lit("success")))) != "success"
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("final_passed").alias("passed"), mean_of(F.col("final_passed")).alias("pass_rate"),
        F.count_if(failed).alias("generation_failures"), F.sum("generation_cost_usd").alias("observed_cost_usd"), F.avg("generation_cost_usd").alias("average_observed_cost_usd"),
        F.median("generation_seconds").alias("median_seconds"), F.percentile("generation_seconds", F.lit(0.95)).alias("p95_seconds"),
    )


def paired_language(results: DataFrame, item: str, languages: tuple[str, str], by: str = "model_name", language: str = "language") -> DataFrame:
    """Items whose two language versions both pass, one fails, or both fail, per model."""
    a, b = (F.max(F.when(F.col(language) == x, F.col("final_passed").cast("int"))) for x in languages)
    each = results.groupBy(by, item).agg((a + b).alias("passes"))
    return each.groupBy(by).agg(
        F.count("passes").alias("pairs"), F.count_if(F.col("passes") == 2).alias("both_passed"), F.count_if(F.col("passes") == 1).alias("one_failed"), F.count_if(F.col("passes") == 0).alias("both_failed"),
        ratio(F.count_if(F.col("passes") == 2), F.count("passes")).alias("bilingual_pass_rate"),
    )


#: Parts into which a round of order_statistics cuts each interval.
PARTS = 1024


def order_statistics(each: DataFrame, places: dict[str, list[int]], bounds: dict[str, tuple[float, float]]) -> dict[tuple[str, int], float]:
    """The values at the given places, from 0 in ascending order, of each measure of `each` (measure, v); bounds: least and greatest value of a measure.

    Each round cuts the intervals that still hold a wanted place in equal parts and counts their values, which tasks combine before the shuffle; the
    driver sees at most PARTS rows an interval and goes on with the part that holds the place, between the least and greatest value found
    there. Values and their order are exact, none is sorted, and no task holds a measure's values. The rounds end as soon as these two are one."""
    state = {(m, k): (*bounds[m], 0) for m, ks in places.items() for k in ks}  # low, high, values below
    while wide := sorted({(m, low, high) for (m, _), (low, high, _) in state.items() if low < high}):
        cuts = each.sparkSession.createDataFrame(wide, "measure string, low double, high double")
        met = each.join(F.broadcast(cuts), "measure").where("v between low and high")  # cuts: at most one row a wanted place
        part = F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * PARTS)
        ends = F.when(F.col("v") == F.col("low"), 0).when(F.col("v") == F.col("high"), PARTS)
        infinite = (F.abs("low") == float("inf")) | (F.abs("high") == float("inf"))
        part = F.when(infinite, F.coalesce(ends, F.lit(PARTS // 2))).otherwise(F.coalesce(F.when(F.col("v") == F.col("high"), PARTS), F.least(part, F.lit(PARTS - 1))))
        found: dict[tuple, list] = {}
        for r in met.groupBy("measure", "low", "high", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect():
            found.setdefault((r["measure"], r["low"], r["high"]), []).append((r["part"], r["n"], r["least"], r["most"]))
        for (m, k), (low, high, below) in state.items():
            if low < high:
                for _, n, least, most in sorted(found[m, low, high]):
                    if k < below + n:
                        state[m, k] = (least, most, below)
                        break
                    below += n
    return {key: low for key, (low, _, _) in state.items()}


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """(measure, n, total, minimum, median, p95 at the floor index, maximum) of each column; null and NaN are no values, and a column without values has no row.

    Order statistics are exact, by order_statistics; the driver sees a row a column and counts."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").where("v is not null and not isnan(v)")
    totals = {r["measure"]: r for r in each.groupBy("measure").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("minimum"), F.max("v").alias("maximum")).collect()}
    three = lambda n: ((n - 1) // 2, n // 2, math.floor(0.95 * (n - 1)))
    found = order_statistics(each, {m: sorted(set(three(r["n"]))) for m, r in totals.items()}, {m: (r["minimum"], r["maximum"]) for m, r in totals.items()})
    rows = []
    for m, r in totals.items():
        low, high, p95 = (found[m, k] for k in three(r["n"]))
        rows.append((m, r["n"], r["total"], r["minimum"], (low + high) / 2, p95, r["maximum"]))
    return df.sparkSession.createDataFrame(rows, "measure string, n long, total double, minimum double, median double, p95 double, maximum double")


def run_counters(results: DataFrame) -> DataFrame:
    """Rows, distinct cases and models, rows by evaluation type and, where there is the column, by evaluation source, of a run; one row."""
    sources = [F.count_if(F.col("evaluation_source") == s).alias(f"{s}_source_rows") for s in ("deterministic", "llm_judge", "generation_error", "judge_error")] if "evaluation_source" in results.columns else []
    return results.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("case_id").alias("cases"), F.count_distinct("model_name").alias("models"),
        F.array_sort(F.collect_set("model_name")).alias("model_names"),
        *[F.count_if(F.col("evaluation_type") == t).alias(f"{t}_rows") for t in ("exact", "json", "judge")], *sources,
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
