"""The registered analytics queries, each with the SQL that gives the same rows.

The supplied tables hold no model outputs, so results are derived: a user's events of one type stand for a case
and a model, mean value for the score. Doubles are rounded to nine digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cost, jsonscore, stats, text
from ..operators import agreement, cohort, family, pairwise, reshape, selection, summary, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f"`{n}`", 9).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def query(sql: str | None = None) -> Callable:
    """Register a query (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def reaches(value: str, least: int) -> Column:
    """The mean of a group's values is at least `least`, decided on exact sums, as a mean of doubles depends on their order.

    Groups with values that have no such decimal (NaN, infinite, finer or larger ones) go by the mean of doubles."""
    exact = F.col(value).try_cast("decimal(18,6)")
    exact = F.when(exact.cast("double") == F.col(value), exact)
    return F.when(F.count(exact) == F.count(value), F.sum(exact) >= F.count(value) * least).otherwise(F.avg(value) >= least)


def results(t: Callable) -> DataFrame:
    return t("events").groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("model_name")).agg(F.least(F.lit(1.0), F.avg("value") / 100).alias("final_score"), reaches("value", 50).alias("final_passed"))


RES = "res AS (SELECT user_id AS case_id, event_type AS model_name, least(1.0, avg(value) / 100) AS final_score, avg(value) >= 50 AS final_passed FROM events GROUP BY 1, 2)"
Z = "1.9599639845400536"


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    centre, half, scale = f"({k}/{n}::DOUBLE + {Z}*{Z}/(2*{n}))", f"({Z}*sqrt({k}/{n}::DOUBLE*(1-{k}/{n}::DOUBLE)/{n} + {Z}*{Z}/(4.0*{n}*{n})))", f"(1 + {Z}*{Z}/{n})"
    return f"CASE WHEN {n} > 0 THEN round(greatest(0.0, ({centre}-{half})/{scale}), 9) END", f"CASE WHEN {n} > 0 THEN round(least(1.0, ({centre}+{half})/{scale}), 9) END"


LOW, HIGH = wilson_sql("passed_cases", "scored_cases")
QUALITY = "count(*) AS cases, count(final_passed) AS scored_cases, count(*) FILTER (final_passed) AS passed_cases, avg(final_score) AS average_score"
QUALITY_OUT = f"cases, scored_cases, cases - scored_cases AS unscored_cases, passed_cases, scored_cases - passed_cases AS failed_cases, round(CASE WHEN scored_cases > 0 THEN passed_cases / scored_cases::DOUBLE END, 9) AS pass_rate, {LOW} AS pass_rate_ci_low, {HIGH} AS pass_rate_ci_high, round(average_score, 9) AS average_score"


@query(f"WITH {RES}, s AS (SELECT model_name, {QUALITY} FROM res GROUP BY 1) SELECT (rank() OVER (ORDER BY passed_cases / scored_cases::DOUBLE DESC))::INTEGER AS rank, model_name, {QUALITY_OUT} FROM s")
def model_summary(t):
    return summary.model_summary(results(t))


STAGE = """st AS (SELECT event_type AS model_name,
 CASE event_id % 7 WHEN 0 THEN ' Error' WHEN 1 THEN NULL ELSE 'success' END AS status,
 CASE WHEN event_id % 13 <> 0 THEN value / 10 END AS seconds, 1 + event_id % 3 AS attempts,
 CASE WHEN event_type = 'click' OR event_id % 11 <> 0 THEN event_id % 1000 END AS tokens,
 CASE WHEN event_type = 'view' OR event_id % 11 <> 0 THEN (event_id % 500) / 1000.0::DOUBLE END AS cost,
 CASE event_id % 3 WHEN 0 THEN 'configured' WHEN 1 THEN 'provider' ELSE ' ' END AS source FROM events),
 rq AS (SELECT *, lower(trim(coalesce(status, ''))) AS s, lower(trim(coalesce(status, ''))) IN ('success', 'error') AS asked FROM st)"""


def stage_frame(t: Callable) -> DataFrame:
    e = F.col("event_id")
    return t("events").select(
        F.col("event_type").alias("model_name"), "user_id", "event_id", "value",
        F.when(e % 7 == 0, " Error").when(e % 7 != 1, "success").alias("generation_status"),
        F.when(e % 13 != 0, F.col("value") / 10).alias("generation_seconds"), (1 + e % 3).alias("generation_attempts"),
        F.when((F.col("event_type") == "click") | (e % 11 != 0), e % 1000).alias("generation_total_tokens"),
        F.when((F.col("event_type") == "view") | (e % 11 != 0), (e % 500) / 1000).alias("generation_cost_usd"),
        F.when(e % 3 == 0, "configured").when(e % 3 == 1, "provider").otherwise(" ").alias("generation_cost_source"),
    )


@query(f"""WITH {STAGE}, g AS (SELECT model_name, count(*) FILTER (asked) AS n, count(*) FILTER (s = 'success') AS ok, count(*) FILTER (s = 'error') AS bad,
 avg(seconds) FILTER (asked) AS sec, quantile_cont(seconds, 0.95) FILTER (asked) AS p95, count(seconds) FILTER (asked) AS nsec, sum(attempts) FILTER (asked) AS att,
 sum(tokens) FILTER (asked) AS tok, count(tokens) FILTER (asked) AS ntok, sum(cost) FILTER (asked) AS usd, count(cost) FILTER (asked) AS nusd,
 string_agg(DISTINCT trim(source), ', ' ORDER BY trim(source)) FILTER (asked AND trim(source) <> '') AS src FROM rq GROUP BY 1)
 SELECT model_name, n AS generation_requests, ok AS generation_successes, bad AS generation_errors, round(bad / n::DOUBLE, 9) AS generation_failure_rate, round(sec, 9) AS generation_average_seconds,
 round(p95, 9) AS generation_p95_seconds, nsec AS generation_latency_observations, round(nsec / n::DOUBLE, 9) AS generation_latency_coverage, att::BIGINT AS generation_api_attempts,
 (CASE WHEN ntok = n THEN tok END)::BIGINT AS generation_total_tokens, ntok AS generation_token_observations, round(ntok / n::DOUBLE, 9) AS generation_token_coverage,
 round(CASE WHEN nusd = n THEN usd END, 9) AS generation_cost_usd, nusd AS generation_cost_observations, round(nusd / n::DOUBLE, 9) AS generation_cost_coverage, nusd = n AS generation_cost_complete, src AS generation_cost_sources FROM g""")
def stage_operations(t):
    out = summary.stage_operations(stage_frame(t), "generation", ["model_name"])
    names = "requests successes errors failure_rate average_seconds p95_seconds latency_observations latency_coverage api_attempts total_tokens token_observations token_coverage cost_usd cost_observations cost_coverage cost_complete cost_sources"
    return out.select("model_name", *[f"generation_{n}" for n in names.split()])


PAIRS = f"""WITH {RES}, p AS (SELECT a.model_name AS model_a, b.model_name AS model_b, count(*) AS paired_cases, count(*) FILTER (a.final_passed AND b.final_passed) AS both_passed,
 count(*) FILTER (a.final_passed AND NOT b.final_passed) AS a_only_passed, count(*) FILTER (NOT a.final_passed AND b.final_passed) AS b_only_passed,
 count(*) FILTER (NOT a.final_passed AND NOT b.final_passed) AS both_failed, avg(a.final_score - b.final_score) AS msd
 FROM res a JOIN res b ON a.case_id = b.case_id AND a.model_name < b.model_name GROUP BY 1, 2)"""


@query(f"""{PAIRS}, q AS (SELECT *, a_only_passed + b_only_passed AS n, least(a_only_passed, b_only_passed) AS m FROM p),
 w AS (SELECT *, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum([exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) - n * ln(2.0)) FOR k IN range(0, m + 1)])) END AS p_value FROM q),
 h AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p_value, model_a, model_b) + 1) * p_value) AS step FROM w),
 i AS (SELECT *, max(step) OVER (ORDER BY p_value, model_a, model_b ROWS UNBOUNDED PRECEDING) AS holm FROM h)
 SELECT model_a, model_b, paired_cases, both_passed, a_only_passed, b_only_passed, both_failed, round(msd, 9) AS mean_score_difference,
 round((both_passed + a_only_passed) / paired_cases::DOUBLE, 9) AS pass_rate_a, round((both_passed + b_only_passed) / paired_cases::DOUBLE, 9) AS pass_rate_b,
 round((both_passed + a_only_passed) / paired_cases::DOUBLE - (both_passed + b_only_passed) / paired_cases::DOUBLE, 9) AS pass_rate_difference,
 round(p_value, 9) AS p_value, round(holm, 9) AS holm_p_value, holm < 0.05 AS significant,
 CASE WHEN holm < 0.05 THEN CASE WHEN a_only_passed > b_only_passed THEN model_a WHEN a_only_passed < b_only_passed THEN model_b END END AS clear_winner FROM i""")
def pairwise_mcnemar_holm(t):
    return pairwise.compare_models(results(t))


@query(f"{PAIRS} SELECT model_a, model_b, paired_cases, a_only_passed AS a_wins, b_only_passed AS b_wins, a_only_passed - b_only_passed AS net_wins FROM p")
def pairwise_net_wins(t):
    return pairwise.net_wins(results(t))


@query(f"""{PAIRS}, c AS (SELECT event_type AS model_name, sum(event_id % 500) / 1000.0::DOUBLE AS usd FROM events GROUP BY 1)
 SELECT model_a, model_b, a_only_passed - b_only_passed AS net_passes, round(a.usd, 9) AS cost_a, round(b.usd, 9) AS cost_b, round(a.usd - b.usd, 9) AS cost_difference_usd,
 round(CASE WHEN (a_only_passed - b_only_passed) * sign(a.usd - b.usd) > 0 THEN abs(a.usd - b.usd) / abs(a_only_passed - b_only_passed) END, 9) AS cost_per_net_pass_usd
 FROM p JOIN c a ON a.model_name = model_a JOIN c b ON b.model_name = model_b""")
def pairwise_incremental_cost(t):
    costs = t("events").groupBy(F.col("event_type").alias("model_name")).agg((F.sum(F.col("event_id") % 500) / 1000.0).alias("total_cost_usd"))
    return pairwise.incremental_cost(pairwise.compare_models(results(t)), costs).select("model_a", "model_b", "net_passes", "cost_a", "cost_b", "cost_difference_usd", "cost_per_net_pass_usd")


def rated(t: Callable) -> DataFrame:
    d = t("documents").select("doc_id", "source", "lang")
    return d.join(t("labels"), "doc_id").select(F.col("source").alias("model_name"), "lang", F.when(F.col("toxic") == 1, "toxic").alias("kind"), (F.col("quality") == 1).alias("final_passed"), F.col("quality").cast("double").alias("final_score"))


RATED = "rated AS (SELECT source AS model_name, lang, CASE WHEN toxic = 1 THEN 'toxic' END AS kind, quality = 1 AS final_passed, quality::DOUBLE AS final_score FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {RATED}, x AS (SELECT model_name, 'lang' AS slice_type, lang AS slice_value, * EXCLUDE (model_name) FROM rated UNION ALL SELECT model_name, 'kind', kind, * EXCLUDE (model_name) FROM rated), s AS (SELECT model_name, slice_type, slice_value, {QUALITY} FROM x GROUP BY 1, 2, 3) SELECT model_name, slice_type, slice_value, {QUALITY_OUT} FROM s")
def slice_summary(t):
    return summary.slice_summary(rated(t), ["lang", "kind"])


@query(f"WITH {RATED}, s AS (SELECT model_name, lang, kind, grouping(lang, kind) AS g, {QUALITY} FROM rated GROUP BY GROUPING SETS ((model_name), (model_name, lang), (model_name, kind), (model_name, lang, kind))) SELECT model_name, lang, kind, {QUALITY_OUT}, CASE g WHEN 3 THEN 'overall' WHEN 1 THEN 'lang' WHEN 2 THEN 'kind' ELSE 'lang_by_kind' END AS slice_type FROM s")
def slice_grouping_sets(t):
    return summary.slice_sets(rated(t), "model_name", [[], ["lang"], ["kind"], ["lang", "kind"]])


TYPES = ["click", "error", "purchase", "signup", "view"]


def _case_sql() -> str:
    columns = ", ".join(f"bool_or(final_passed) FILTER (model_name = '{m}') AS passed__{m}" for m in TYPES)
    return f"WITH {RES}, w AS (SELECT case_id, count(final_passed) AS scored, count(*) FILTER (final_passed) AS passes, {columns} FROM res GROUP BY 1) SELECT *, CASE WHEN scored < 5 THEN 'incomplete' WHEN passes = 5 THEN 'all_passed' WHEN passes = 0 THEN 'all_failed' ELSE 'disagreement' END AS outcome FROM w"


@query(_case_sql())
def case_outcomes(t):
    return summary.case_outcomes(results(t), TYPES)


@query("SELECT 'missing pair' AS rule, c || '|' || p AS key, 'absent' AS detail FROM (SELECT DISTINCT o_custkey AS c FROM orders) CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) WHERE (c, p) NOT IN (SELECT (o_custkey, o_orderpriority) FROM orders)")
def coverage_violations(t):
    return validate.coverage_gaps(t("orders"), "o_custkey", "o_orderpriority")


@query("SELECT 'duplicate key' AS rule, l_orderkey || '|' || l_linenumber AS key, count(*)::VARCHAR AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_keys(t):
    return validate.duplicate_keys(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT 'conflicting definition' AS rule, l_orderkey || '|' || c AS key, n::VARCHAR AS detail FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS l_suppkey, count(DISTINCT l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1) UNPIVOT (n FOR c IN (l_suppkey, l_returnflag)) WHERE n > 1")
def definition_conflicts(t):
    return validate.definition_conflicts(t("lineitem"), "l_orderkey", ["l_suppkey", "l_returnflag"])


@query("SELECT coalesce(a.k, b.k)::VARCHAR AS key, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL OUTER JOIN (SELECT DISTINCT o_custkey + 5 AS k FROM orders) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def schema_diff(t):
    keys = t("orders").select((F.col("o_custkey") + 5).cast("string").alias("key"))
    return validate.set_difference(t("customer").select(F.col("c_custkey").cast("string").alias("key")), keys, "key")


@query("SELECT 'changed reference' AS rule, a.o_orderkey::VARCHAR AS key, c AS detail FROM orders a CROSS JOIN (SELECT unnest(['o_orderstatus', 'o_orderpriority']) AS c) WHERE (c = 'o_orderstatus' AND a.o_orderkey % 10 = 3 AND a.o_orderstatus <> 'X') OR (c = 'o_orderpriority' AND a.o_orderkey % 25 = 1)")
def frozen_differences(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    changed = o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 3, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 25 != 1, F.col("o_orderpriority")).alias("o_orderpriority"))
    return validate.frozen_differences(changed, o, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("WITH x AS (SELECT quality AS r, toxic AS p FROM labels), n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (r = p) AS same FROM x), e AS (SELECT sum(a * b) AS ab FROM (SELECT (SELECT count(*) FROM x WHERE r = k) AS a, (SELECT count(*) FROM x WHERE p = k) AS b FROM (SELECT unnest([0, 1]) AS k))) SELECT n::BIGINT AS n, round(same / n, 9) AS observed_agreement, round(ab / (n * n), 9) AS expected_agreement, round((same / n - ab / (n * n)) / (1 - ab / (n * n)), 9) AS kappa FROM n, e")
def cohen_kappa(t):
    return agreement.cohen_kappa(t("labels"), "quality", "toxic")


RECALL, PRECISION = wilson_sql("tp", "(tp + fn)"), wilson_sql("tp", "(tp + fp)")


@query(f"""WITH c AS (SELECT count(*) FILTER (quality = 0 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn, count(*) FILTER (quality = 1 AND toxic = 1) AS tn FROM labels)
 SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / (tp + fn)::DOUBLE, 9) AS recall, round(fn / (tp + fn)::DOUBLE, 9) AS false_approval_rate,
 round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 9) AS accuracy, {PRECISION[0]} AS precision_low, {PRECISION[1]} AS precision_high, {RECALL[0]} AS recall_low, {RECALL[1]} AS recall_high, round(1 - {RECALL[1]}, 9) AS false_approval_low, round(1 - {RECALL[0]}, 9) AS false_approval_high FROM c""")
def confusion(t):
    return agreement.confusion(t("labels"), "quality", "toxic", 0, 1)


RATINGS = "c AS (SELECT l_orderkey AS i, l_returnflag AS l, count(*) AS c FROM lineitem GROUP BY 1, 2), d AS (SELECT *, sum(c) OVER (PARTITION BY i) AS n FROM c QUALIFY n >= 2)"


@query(f"WITH {RATINGS}, m AS (SELECT l, sum(c)::DOUBLE AS m, sum(c * (c - 1) / (n - 1)::DOUBLE) AS o FROM d GROUP BY 1), z AS (SELECT sum(m) AS n, sum(o) AS o, sum(m * m) AS mm FROM m) SELECT n::BIGINT AS ratings, round(1 - (1 - o / n) / ((n * n - mm) / (n * (n - 1))), 9) AS alpha FROM z")
def krippendorff_alpha(t):
    return agreement.krippendorff_alpha(t("lineitem"), "l_orderkey", "l_returnflag")


@query(f"WITH {RATINGS}, p AS (SELECT i, max(n) AS n, sum(c * (c - 1) / 2.0) AS same FROM d GROUP BY 1) SELECT round(sum(same)::DOUBLE, 9) AS agreeing_pairs, round(sum(n * (n - 1) / 2.0)::DOUBLE, 9) AS pairs, round(sum(same)::DOUBLE / sum(n * (n - 1) / 2.0)::DOUBLE, 9) AS raw_agreement FROM p")
def raw_agreement(t):
    return agreement.pair_agreement(t("lineitem"), "l_orderkey", "l_returnflag")


@query("WITH p AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS seen, count(DISTINCT o_orderstatus) AS labels FROM orders GROUP BY 1) SELECT count(*) AS cases, count(*) FILTER (seen = 5) AS complete_cases, round(count(*) FILTER (seen = 5) / count(*)::DOUBLE, 9) AS coverage, round(count(*) FILTER (seen = 5 AND labels > 1) / nullif(count(*) FILTER (seen = 5), 0)::DOUBLE, 9) AS flip_rate FROM p")
def condition_metrics(t):
    return agreement.condition_metrics(t("orders"), "o_custkey", "o_orderpriority", "o_orderstatus", 5)


@query("WITH p AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_suppkey) AS r, count(DISTINCT l_returnflag) AS l FROM lineitem GROUP BY 1, 2) SELECT count(*) AS items, min(r) AS raters_min, round(avg(r), 9) AS raters_avg, round(count(*) FILTER (r >= 2) / count(*)::DOUBLE, 9) AS double_rated, round(count(*) FILTER (l > 1) / count(*)::DOUBLE, 9) AS disagreement_rate FROM p")
def human_metrics(t):
    return agreement.human_metrics(t("lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag", "l_suppkey")


@query("WITH x AS (SELECT CASE event_id % 3 WHEN 0 THEN 'AB' WHEN 1 THEN 'BA' ELSE 'pointwise' END AS o, CASE WHEN value > 50 THEN 'A' WHEN value > 10 THEN 'B' ELSE 'tie' END AS l FROM events), y AS (SELECT count(*) FILTER (o <> 'pointwise' AND l <> 'tie') AS n, count(*) FILTER ((o = 'AB' AND l = 'A') OR (o = 'BA' AND l = 'B')) AS f FROM x) SELECT n AS choices, f AS first_chosen, round(f / n::DOUBLE, 9) AS first_position_rate FROM y")
def position_bias(t):
    e = F.col("event_id") % 3
    return agreement.position_bias(t("events").select(F.when(e == 0, "AB").when(e == 1, "BA").otherwise("pointwise").alias("presentation_order"), F.when(F.col("value") > 50, "A").when(F.col("value") > 10, "B").otherwise("tie").alias("label")))


@query("SELECT round(avg((value > 50)::INT) FILTER (event_id % 2 = 0), 9) AS named_rate, round(avg((value > 50)::INT) FILTER (event_id % 2 = 1), 9) AS blinded_rate, round(avg((value > 50)::INT) FILTER (event_id % 2 = 0) - avg((value > 50)::INT) FILTER (event_id % 2 = 1), 9) AS shift FROM events")
def self_preference(t):
    return agreement.self_preference(t("events").select("value", F.when(F.col("event_id") % 2 == 0, "named").otherwise("blinded").alias("identity_condition")), F.col("value") > 50)


GATES = [("accuracy_floor", "calibrated", "accuracy", ">=", 0.05), ("recall_floor", "calibrated", "recall", ">=", 0.2), ("kappa_floor", "decision_grade", "kappa", ">=", 0.6), ("unknown", "publishable", "absent", "<=", 0.1)]
METRICS = """m AS (SELECT 'accuracy' AS metric, count(*) FILTER (quality = 1 - toxic) / count(*)::DOUBLE AS value FROM labels UNION ALL SELECT 'recall', count(*) FILTER (quality = 0 AND toxic = 0) / count(*) FILTER (quality = 0)::DOUBLE FROM labels UNION ALL SELECT 'kappa', 0.25::DOUBLE)"""
GATE_ROWS = "g(gate, level, metric, comparison, threshold) AS (VALUES " + ", ".join(f"('{g}', '{v}', '{m}', '{c}', {x}::DOUBLE)" for g, v, m, c, x in GATES) + ")"


def gates(t: Callable) -> DataFrame:
    share = lambda a, b=F.lit(True): F.count_if(a) / F.count_if(b)
    q, x = F.col("quality"), F.col("toxic")
    one = t("labels").agg(share(q == 1 - x).alias("accuracy"), share((q == 0) & (x == 0), q == 0).alias("recall"), F.lit(0.25).alias("kappa"))
    values = one.unpivot([], ["accuracy", "recall", "kappa"], "metric", "value")
    return agreement.gate_results(one.sparkSession.createDataFrame(GATES, "gate string, level string, metric string, comparison string, threshold double"), values)


GATE_SQL = f"WITH {GATE_ROWS}, {METRICS}, r AS (SELECT g.*, round(value, 9) AS value, coalesce(CASE comparison WHEN '>=' THEN value >= threshold ELSE value <= threshold END, false) AS passed FROM g LEFT JOIN m USING (metric))"


@query(f"{GATE_SQL} SELECT gate, level, metric, comparison, threshold, value, passed FROM r")
def validation_gates(t):
    return gates(t)


@query(f"{GATE_SQL}, l(k, level) AS (VALUES (1, 'exploratory'), (2, 'calibrated'), (3, 'decision_grade'), (4, 'publishable')), f AS (SELECT min(k) AS least, coalesce(min(k) FILTER (NOT passed), 5) AS k FROM r JOIN l USING (level)) SELECT level FROM l, f WHERE l.k = CASE WHEN f.least > 2 THEN 1 ELSE f.k - 1 END")
def achieved_level(t):
    return agreement.achieved_level(gates(t))


@query("WITH e AS (SELECT *, lag(props) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), s AS (SELECT event_type AS model_name, (json_extract_string(props, '$.k'))::BIGINT % 3 AS a, (json_extract_string(before, '$.k'))::BIGINT % 3 AS b FROM e WHERE before IS NOT NULL) SELECT model_name, count(*) AS cases, count(*) FILTER (a = b) AS exact, count(*) FILTER (a <> b) AS mismatched FROM s GROUP BY 1")
def json_fields(t):
    from pyspark.sql import Window as W

    k = lambda c: F.concat(F.lit('{"k": '), (F.get_json_object(c, "$.k").cast("long") % 3).cast("string"), F.lit("}"))
    e = t("events").withColumn("before", F.lag("props").over(W.partitionBy("user_id").orderBy("event_id"))).where("before is not null")
    rows = e.select(F.col("event_id").alias("case_id"), F.col("event_type").alias("model_name"), F.lit("json").alias("evaluation_type"), k("before").alias("expected_output"), k("props").alias("model_output"))
    s = jsonscore.score_outputs(rows)
    return s.groupBy("model_name").agg(F.count(F.lit(1)).alias("cases"), F.count_if("json_exact_match").alias("exact"), F.count_if(F.array_contains("json_mismatched_fields", "k")).alias("mismatched"))


@query("SELECT event_type AS model_name, 'k' AS field_name, count(*) AS cases, count(*) FILTER (k = 7) AS matching_cases, count(*) FILTER (k <> 7) AS mismatched_cases, round(count(*) FILTER (k = 7) / count(*)::DOUBLE, 9) AS field_accuracy FROM (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1")
def field_accuracy(t):
    rows = t("events").select(F.col("event_id").alias("case_id"), F.col("event_type").alias("model_name"), F.lit("json").alias("evaluation_type"), F.lit('{"k":7.0}').alias("expected_output"), F.col("props").alias("model_output"))
    return summary.field_accuracy(jsonscore.score_outputs(rows), ["k"], ["model_name"])


@query("""WITH s AS (SELECT role AS model_name, turn % 2 = 0 AS fixed, upper(coalesce(text, '')) AS wanted, coalesce(text, '') AS given FROM conversations),
 n AS (SELECT *, lower(nfc_normalize(trim(regexp_replace(wanted, '\\s+', ' ', 'g')))) = lower(nfc_normalize(trim(regexp_replace(upper(given), '\\s+', ' ', 'g')))) AS same FROM s)
 SELECT model_name, count(*) AS cases, count(*) FILTER (fixed) AS evaluated_cases, count(*) FILTER (NOT fixed) AS skipped_cases, round(avg((wanted = given)::INT) FILTER (fixed), 9) AS exact_match_rate,
 round(avg(same::INT) FILTER (fixed), 9) AS normalized_exact_match_rate FROM n GROUP BY 1""")
def text_normalized_match(t):
    return turns_match(t("conversations"))


def turns_match(turns: DataFrame) -> DataFrame:
    """Match rates of turns with their upper-cased text, whatever the script."""
    rows = turns.select(F.col("conv_id").alias("case_id"), F.col("role").alias("model_name"), F.when(F.col("turn") % 2 == 0, "exact").otherwise("judge").alias("evaluation_type"), F.upper("text").alias("expected_output"), F.col("text").alias("model_output"))
    return summary.metrics_summary(jsonscore.score_outputs(rows)).select("model_name", "cases", "evaluated_cases", "skipped_cases", "exact_match_rate", "normalized_exact_match_rate")


@query("SELECT c_mktsegment, c_custkey, pick FROM (SELECT *, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('5:' || c_custkey), c_custkey))::INTEGER AS pick FROM customer) WHERE pick <= 20")
def stable_hash_sample(t):
    return cohort.hash_sample(t("customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], "c_custkey", 20, 5)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 6 = 0)")
def tier_delta(t):
    c = t("customer").select("c_custkey", "c_mktsegment")
    return cohort.tier_delta(c.where("c_custkey % 3 = 0"), c.where("c_custkey % 6 = 0"), "c_custkey")


@query("SELECT r_name AS model_name, c_custkey AS case_id FROM customer CROSS JOIN region WHERE (c_custkey + r_regionkey) % 4 <> 0")
def work_items(t):
    cases, models = t("customer").select(F.col("c_custkey").alias("case_id")), t("region").select(F.col("r_name").alias("model_name"), "r_regionkey")
    done = cases.crossJoin(models).where("(case_id + r_regionkey) % 4 = 0").select("case_id", "model_name")
    return cohort.work_items(cases, models.select("model_name"), done, ["case_id", "model_name"])


@query("WITH w AS (SELECT c_mktsegment AS v, count(*) / (SELECT count(*) FROM customer)::DOUBLE AS b FROM customer GROUP BY 1), s AS (SELECT c_mktsegment AS v, count(*) / (SELECT count(*) FROM customer WHERE c_custkey % 7 = 0)::DOUBLE AS a FROM customer WHERE c_custkey % 7 = 0 GROUP BY 1) SELECT 'c_mktsegment' AS \"column\", round(sum(abs(coalesce(a, 0) - coalesce(b, 0))), 9) AS distance FROM w FULL OUTER JOIN s USING (v)")
def share_distance(t):
    c = t("customer")
    return cohort.share_distance(c.where("c_custkey % 7 = 0"), c, ["c_mktsegment"])


PRICES = [("small", 0.15, 0.075, 0.6), ("medium", 1.1, 0.275, 4.4), ("large", 2.5, None, 10.0)]


@query("WITH p(pricing_id, i, c, o) AS (VALUES ('small', 0.15, 0.075, 0.6), ('medium', 1.1, 0.275, 4.4), ('large', 2.5, NULL, 10.0)), x AS (SELECT pricing_id, source, ((n_chars - n_chars // 4) * i + (n_chars // 4) * coalesce(c, i) + (n_chars // 10) * o)::DOUBLE / 1000000 AS usd FROM documents, p) SELECT pricing_id, source, count(*) AS requests, round(sum(usd), 9) AS cost_usd FROM x GROUP BY 1, 2")
def token_cost(t):
    d = t("documents")
    prices = d.sparkSession.createDataFrame(PRICES, "pricing_id string, rate_in double, rate_cached double, rate_out double")
    n = F.col("n_chars")
    usd = cost.token_cost(n, F.floor(n / 4), F.floor(n / 10), F.col("rate_in"), F.col("rate_cached"), F.col("rate_out"))
    return d.select("source", "n_chars").crossJoin(F.broadcast(prices)).groupBy("pricing_id", "source").agg(F.count(F.lit(1)).alias("requests"), F.sum(usd).alias("cost_usd"))


@query(f"WITH {STAGE} SELECT model_name, count(*) AS requests, round(CASE WHEN count(cost) = count(*) THEN sum(cost) END, 9) AS complete_usd, round(sum(cost), 9) AS observed_usd, round(sum(coalesce(cost, 0)), 9) AS filled_usd, round(coalesce(sum(cost), 0), 9) AS skipping_usd FROM st GROUP BY 1")
def cost_totals(t):
    c = F.col("generation_cost_usd")
    return stage_frame(t).groupBy("model_name").agg(F.count(F.lit(1)).alias("requests"), cost.complete_sum(c, F.count(F.lit(1))).alias("complete_usd"), cost.observed_sum(c).alias("observed_usd"), cost.filled_sum(c).alias("filled_usd"), cost.skipping_sum(c).alias("skipping_usd"))


@query(f"WITH {STAGE}, s AS (SELECT model_name, avg(cost) AS m, max(cost) AS x FROM st GROUP BY 1), p AS (SELECT event_type AS model_name, count(*) AS pending FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT model_name, pending, round(m, 9) AS sample_mean_usd, round(x, 9) AS sample_max_usd, round(pending * m * 1.5, 9) AS expected_usd, round(x * 1.5, 9) AS request_ceiling_usd, pending * m * 1.5 <= 400 AS within_limit FROM p LEFT JOIN s USING (model_name)")
def cost_preflight(t):
    f = stage_frame(t)
    return cohort.cost_preflight(f.where("event_id % 2 = 0"), f, 1.5, 400.0)


@query(f"""WITH {STAGE}, {RES}, q AS (SELECT model_name, avg(final_passed::INT) AS pr FROM res GROUP BY 1),
 o AS (SELECT model_name, count(*) FILTER (asked) AS n, count(*) FILTER (s = 'error') / (count(*) FILTER (asked))::DOUBLE AS fr, CASE WHEN count(cost) FILTER (asked) = count(*) FILTER (asked) THEN sum(cost) FILTER (asked) / (count(*) FILTER (asked)) END AS ac FROM rq GROUP BY 1),
 x AS (SELECT *, CASE WHEN pr < 0.4 THEN 'ineligible' WHEN ac IS NULL THEN 'unknown' WHEN ac > 0.3 THEN 'ineligible' ELSE 'eligible' END AS st FROM q JOIN o USING (model_name)),
 y AS (SELECT *, CASE WHEN st = 'eligible' THEN (0.5 * pr + 0.25 * greatest(0, least(1, 1 - ac / 0.3)) + 0.25 * (1 - fr)) / 1.0 END AS ds FROM x)
 SELECT model_name, st AS selection_status, (CASE WHEN ds IS NOT NULL THEN rank() OVER (ORDER BY ds DESC NULLS LAST) END)::INTEGER AS selection_rank, round(ds, 9) AS decision_score, round(ac, 9) AS generation_average_cost_usd,
 CASE WHEN pr < 0.4 THEN printf('pass rate %.1f%% is below 40.0%%', pr * 100) ELSE '' END || CASE WHEN pr < 0.4 AND ac > 0.3 THEN '; ' ELSE '' END || CASE WHEN ac > 0.3 THEN printf('average request cost $%.6f exceeds $0.300000', ac) ELSE '' END AS constraint_failures,
 CASE WHEN ac IS NULL THEN 'complete generation cost' ELSE '' END AS missing_evidence FROM y""")
def selection_status(t):
    quality = summary.model_summary(results(t))
    both = quality.join(summary.stage_operations(stage_frame(t), "generation", ["model_name"]), "model_name")
    profiles = quality.select("model_name", F.lit(True).alias("available"), F.array(F.lit("json")).alias("capabilities"))
    policy = selection.Policy(min_pass_rate=0.4, max_average_cost=0.3, quality=0.5, cost=0.25, reliability=0.25, capabilities=("json",))
    return selection.select_models(both, policy, profiles).select("model_name", "selection_status", "selection_rank", "decision_score", "generation_average_cost_usd", "constraint_failures", "missing_evidence")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_name) AS k, lead(s_acctbal) OVER w AS nx, lead(s_name) OVER w AS nn FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_name)) SELECT s_nationkey, s_name AS leader, nn AS runner_up, round(s_acctbal, 9) AS leader_score, round(s_acctbal - nx, 9) AS margin FROM r WHERE k = 1")
def leader_margin(t):
    return selection.leader_margin(t("supplier"), "s_nationkey", "s_name", "s_acctbal")


@query(f"WITH {RES}, s AS (SELECT model_name, {QUALITY} FROM res GROUP BY 1), {STAGE}, o AS (SELECT model_name, count(*) FILTER (s = 'error') / (count(*) FILTER (asked))::DOUBLE AS fr FROM rq GROUP BY 1) SELECT model_name, round(passed_cases / scored_cases::DOUBLE, 9) AS pass_rate, round(fr, 9) AS generation_failure_rate FROM s JOIN o USING (model_name) WHERE passed_cases / scored_cases::DOUBLE >= 0.4 AND fr <= 0.17")
def promoted_models(t):
    both = summary.model_summary(results(t)).join(summary.stage_operations(stage_frame(t), "generation", ["model_name"]), "model_name")
    return selection.promoted(both, 0.4, 0.17).select("model_name", "pass_rate", "generation_failure_rate")


STAR = "SELECT c_custkey, c_name, r_name, n_name, c_mktsegment, n.orders, CASE WHEN coalesce(n.orders, 0) = 0 THEN 'no orders' WHEN c_acctbal < 0 THEN 'negative balance' WHEN r_name = 'ASIA' THEN 'other region' END AS exclusion_reason FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) n ON o_custkey = c_custkey"


def star(t: Callable) -> DataFrame:
    places = F.broadcast(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")))  # 25 rows by definition
    orders = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    df = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    rules = [("no orders", F.coalesce("orders", F.lit(0)) > 0), ("negative balance", F.col("c_acctbal") >= 0), ("other region", F.col("r_name") != "ASIA")]
    return family.screened(df, rules)


@query(f"SELECT coalesce(exclusion_reason, 'eligible') AS outcome, count(*) AS rows FROM ({STAR}) GROUP BY 1")
def exclusion_counts(t):
    return family.exclusion_counts(star(t))


@query(f"WITH s AS ({STAR}), e AS (SELECT n_name AS owner, lower(c_mktsegment) AS k, c_mktsegment, r_name FROM s WHERE exclusion_reason IS NULL) SELECT 'family_' || substr(sha256(owner || chr(31) || k || chr(31) || r_name), 1, 16) AS family_id, owner AS n_name, min(c_mktsegment) AS c_mktsegment, r_name AS parts, count(*) AS variants, CASE WHEN count(*) > 1 THEN 'multi_variant' ELSE 'single' END AS stratum FROM e GROUP BY owner, k, r_name")
def family_rollup(t):
    return family.families(star(t).where("exclusion_reason is null").withColumn("p", F.array("r_name")), "n_name", "c_mktsegment", "p", [])


@query("SELECT l_orderkey, to_json({'flags': list_sort(list_distinct(list(l_returnflag))), 'status': min(l_linestatus)})::VARCHAR AS expected_output FROM lineitem GROUP BY 1")
def expected_answers(t):
    return family.expected_answers(t("lineitem"), ["l_orderkey"], {"flags": F.col("l_returnflag")}, {"status": F.col("l_linestatus")})


@query("WITH x AS (SELECT list_sort(list(n_chars::DOUBLE)) AS v FROM documents) SELECT 'n_chars' AS measure, len(v) AS n, round(list_sum(v), 9) AS total, v[1] AS minimum, (v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2 AS median, v[floor(0.95 * (len(v) - 1))::BIGINT + 1] AS p95, v[len(v)] AS maximum FROM x")
def distribution(t):
    return summary.distribution(t("documents"), ["n_chars"])


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def keep_last(t):
    return reshape.keep_last(t("events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(f"WITH {RES} SELECT case_id, " + ", ".join(f"round(max(final_score) FILTER (model_name = '{m}'), 9) AS score__{m}" for m in TYPES) + " FROM res GROUP BY 1")
def long_to_wide(t):
    return reshape.long_to_wide(results(t), "case_id", "model_name", TYPES, {"final_score": "score"})


@query("SELECT s_suppkey, measure, value FROM (SELECT s_suppkey, s_acctbal AS balance, s_nationkey::DOUBLE AS nation FROM supplier) UNPIVOT (value FOR measure IN (balance, nation))")
def wide_to_long(t):
    return reshape.wide_to_long(t("supplier").withColumn("nk", F.col("s_nationkey").cast("double")), ["s_suppkey"], {"s_acctbal": "balance", "nk": "nation"}, "measure", "value")


@query("WITH e AS (SELECT event_type, CASE WHEN value < 10 THEN 'low' WHEN value > 100 THEN 'high' END AS error_type FROM events), c AS (SELECT event_type, error_type, count(*) AS n FROM e GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY event_type) AS cases, sum(CASE WHEN error_type IS NOT NULL THEN n END) OVER (PARTITION BY event_type) AS failures FROM c) SELECT event_type, error_type, n AS \"count\", round(n / failures::DOUBLE, 9) AS share_of_failures, round(n / cases::DOUBLE, 9) AS share_of_cases FROM w WHERE error_type IS NOT NULL")
def error_taxonomy(t):
    return summary.error_taxonomy(t("events").select("event_type", F.when(F.col("value") < 10, "low").when(F.col("value") > 100, "high").alias("error_type")), ["event_type"])


@query("WITH p AS (SELECT c_mktsegment AS model_name, c_nationkey AS item, max((c_acctbal > 0)::INT) FILTER (c_custkey % 2 = 0) + max((c_acctbal > 0)::INT) FILTER (c_custkey % 2 = 1) AS k FROM customer GROUP BY 1, 2) SELECT model_name, count(k) AS pairs, count(*) FILTER (k = 2) AS both_passed, count(*) FILTER (k = 1) AS one_failed, count(*) FILTER (k = 0) AS both_failed, round(count(*) FILTER (k = 2) / count(k)::DOUBLE, 9) AS bilingual_pass_rate FROM p GROUP BY 1")
def paired_language(t):
    rows = t("customer").select(F.col("c_mktsegment").alias("model_name"), F.col("c_nationkey").alias("item"), F.when(F.col("c_custkey") % 2 == 0, "en").otherwise("fr").alias("language"), (F.col("c_acctbal") > 0).alias("final_passed"))
    return summary.paired_language(rows, "item", ("en", "fr"))


@query("SELECT event_type AS model_name, count(*) AS cases, count(*) FILTER (ok) AS passed, round(avg(ok::INT), 9) AS pass_rate, count(*) FILTER (event_id % 7 = 0) AS generation_failures, round(sum(CASE WHEN event_type = 'view' OR event_id % 11 <> 0 THEN (event_id % 500) / 1000.0::DOUBLE END), 9) AS observed_cost_usd, round(avg(CASE WHEN event_type = 'view' OR event_id % 11 <> 0 THEN (event_id % 500) / 1000.0::DOUBLE END), 9) AS average_observed_cost_usd, round(median(CASE WHEN event_id % 13 <> 0 THEN value / 10 END), 9) AS median_seconds, round(quantile_cont(CASE WHEN event_id % 13 <> 0 THEN value / 10 END, 0.95), 9) AS p95_seconds FROM (SELECT *, value >= 50 AS ok FROM events) GROUP BY 1")
def bundle_summary(t):
    return summary.bundle_summary(stage_frame(t).withColumn("final_passed", F.col("value") >= 50), ["model_name"])


@query("WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 100) SELECT count(*) AS rows, count(DISTINCT user_id) AS cases, count(DISTINCT event_type) AS models FROM a")
def run_counters(t):
    rows = t("events").where("value > 100").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("model_name"), F.lit("json").alias("evaluation_type")).distinct()
    return summary.run_counters(rows).select("rows", "cases", "models")


@query("SELECT count(*) AS compared, 0::BIGINT AS only_a, 0::BIGINT AS only_b, count(*) FILTER (o_orderkey % 10 = 0) AS o_totalprice_differs FROM orders")
def parity_report(t):
    o = t("orders").select("o_orderkey", "o_totalprice")
    return validate.contract_parity(o, o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1e-6).otherwise(F.col("o_totalprice")).alias("o_totalprice")), ["o_orderkey"], ["o_totalprice"])


@query("SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(p_name || ' (' || p_size || ')', '\\s*\\([^)]*\\)\\s*', ' ', 'g'), '\\s+', ' ', 'g'))) AS name, CASE WHEN length(p_size::VARCHAR) < 3 THEN lpad(p_size::VARCHAR, 3, '0') ELSE p_size::VARCHAR END AS padded, 'part_' || substr(sha256(p_brand || chr(31) || p_type), 1, 16) AS part_id FROM part")
def text_functions(t):
    said = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))
    return t("part").select("p_partkey", text.normalized(text.without_parentheses(said)).alias("name"), text.zero_padded(F.col("p_size").cast("string"), 3).alias("padded"), text.stable_id("part", F.col("p_brand"), F.col("p_type")).alias("part_id"))


@query("SELECT s_suppkey, round(greatest(0, least(1, 1 - s_acctbal / 10000)), 9) AS component, CASE WHEN s_acctbal > 5000 THEN 'ineligible' WHEN s_nationkey % 2 = 0 THEN 'ranked' ELSE 'descriptive' END AS status FROM supplier")
def policy_expressions(t):
    return t("supplier").select("s_suppkey", cost.bounded_inverse(F.col("s_acctbal"), 10000.0).alias("component"), selection.result_status(F.col("s_acctbal"), 5000.0, F.col("s_nationkey") % 2 == 0).alias("status"))


_FOLDED = "trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}_\\s%]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT item_id, min(doc_id) AS page FROM (SELECT item_id, {_FOLDED} AS c FROM benchmark) b LEFT JOIN (SELECT doc_id, {_FOLDED} AS t FROM documents) d ON doc_id % 8 = item_id % 8 AND contains(t, c) GROUP BY 1")
def evidence_pages(t):
    """The first page with a whole item, in the one document of eight that the item belongs to."""
    pages = t("documents").select(F.pmod("doc_id", F.lit(8)).alias("document_id"), F.col("doc_id").alias("page"), "text")
    wanted = t("benchmark").select(F.pmod("item_id", F.lit(8)).alias("document_id"), F.col("item_id").alias("field"), F.array("text").alias("candidates"))
    return family.first_evidence_page(pages, wanted).select(F.col("field").alias("item_id"), "page")


@query()
def balanced_cohort(t):
    return cohort.balanced_units(t("customer"), "c_custkey", ["c_mktsegment", "c_nationkey"], 60, 5)


@query("SELECT s_suppkey, (rank() OVER (ORDER BY s_nationkey DESC))::INTEGER AS rank FROM supplier")
def competition_rank(t):
    return t("supplier").select("s_suppkey", stats.rank_present(F.col("s_nationkey")).alias("rank"))


from . import more, saved  # noqa: E402, F401  register further queries
