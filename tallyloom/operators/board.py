"""Leaderboards, first failures, scorer metrics, counters of records, and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import rank_present
from .validate import _found, violations

#: Statuses in the order in which a leaderboard shows them.
STATUSES = ["ranked", "descriptive", "ineligible"]
#: Readiness of a task, best first, by what is in the way.
READINESS = ["ready", "cost_blocked", "unresolved", "invalid"]


def leaderboard(results: DataFrame, score: str, key: str, status: str = "status") -> DataFrame:
    """results with rank, by score among ranked rows alone (ties share the least), and place: ranked rows by rank, then
    descriptive, then ineligible ones, by key. A row per result bundle, so places come from one small sort."""
    rank = rank_present(F.when(F.col(status) == "ranked", F.col(score)))
    ranked = results.withColumn("rank", rank)
    order = F.array_position(F.lit(STATUSES), F.coalesce(F.col(status), F.lit("")))
    order = F.when(order == 0, len(STATUSES) + 1).otherwise(order)
    return ranked.withColumn("place", F.row_number().over(W.orderBy(order, F.col("rank").asc_nulls_last(), key)))


def first_failures(results: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first failed rows of each group in order; a null verdict is no failure. The limit is kept before the shuffle ends."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return results.where(~F.col("final_passed")).withColumn("place", place).where(F.col("place") <= most).drop("place")


def scorer_metrics(samples: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Mean score and its standard error per group; the error is null below two scores."""
    n = F.count(score)
    return samples.groupBy(*by).agg(n.alias("samples"), F.avg(score).alias("accuracy"), F.when(n > 1, F.sqrt(F.var_samp(score) / n)).alias("stderr"))


def clustered_error(samples: DataFrame, by: list[str], cluster: str, score: str = "score") -> DataFrame:
    """Mean score and standard error by the delta method where samples of a cluster hang together: the root of the sum of
    squared cluster sums of residuals, over the number of scores, with the small-sample factor c / (c - 1)."""
    mean = samples.groupBy(*by).agg(F.avg(score).alias("accuracy"), F.count(score).alias("samples"))
    joined = samples.where(F.col(score).isNotNull()).join(mean, by)
    residual = joined.groupBy(*by, "accuracy", "samples", cluster).agg(F.sum(F.col(score) - F.col("accuracy")).alias("r"))
    c = F.count(F.lit(1))
    return residual.groupBy(*by, "accuracy", "samples").agg(c.alias("clusters"), F.when(c > 1, F.sqrt(F.sum(F.col("r") * F.col("r")) * c / (c - 1)) / F.col("samples")).alias("stderr"))


def observed(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Distinct combinations, with how many rows have each and where each is first seen."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("first_seen"))


def counters(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, rows): how often each value of each column occurs; a null counts as `<null>`. One scan."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("<null>")).alias("value")) for c in columns])).alias("x")
    return rows.select(each).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("rows"))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over parts that decide whether results may be compared; a null part differs from an empty one."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]), 256)


def scope(allowed: Column, wanted: Column) -> Column:
    """Which of the wanted scopes a reader gets: those that are allowed, in order; `*` allows all."""
    return F.when(F.array_contains(allowed, "*"), F.array_sort(F.array_distinct(wanted))).otherwise(F.array_sort(F.array_intersect(wanted, allowed)))


def readiness(structural: Column, unresolved: Column, expected_cost: Column, budget: Column) -> Column:
    """The first thing in the way of a task: broken structure, unresolved values, an unknown or too high cost."""
    return F.when(F.coalesce(structural, F.lit(1)) > 0, "invalid").when(F.coalesce(unresolved, F.lit(1)) > 0, "unresolved").when(~F.coalesce(expected_cost <= budget, F.lit(False)), "cost_blocked").otherwise("ready")


def audit_decision(error_types: Column, mismatched: Column, material: list[str]) -> Column:
    """struct(error_owner, operational_severity, ground) of an audited case whose source, expected answer and score were reproduced.

    error_types: classes of the failures of the models in focus; mismatched: fields that these get wrong. Without failures nobody owns an error;
    else the models do, at medium severity where a text or value is wrong in a material field, at low severity otherwise. ground is
    control, compound_label (labels split at a comma alone), shape (types and duplicates alone), or text."""
    shape = ["schema_type_only", "duplicate_items_only", "schema_and_duplicates"]
    kinds = F.array_distinct(error_types)
    bad = F.array_contains(kinds, "text_or_value_error") & F.arrays_overlap(mismatched, F.lit(material).cast("array<string>"))
    ground = F.when(kinds == F.array(F.lit("compound_label_split_only")), "compound_label").when(F.size(F.array_except(kinds, F.lit(shape))) == 0, "shape").otherwise("text")
    made = lambda owner, severity, why: F.struct(F.lit(owner).alias("error_owner"), severity.alias("operational_severity"), why.alias("ground"))
    return F.when(F.size(kinds) == 0, made("none", F.lit("none"), F.lit("control"))).otherwise(made("model", F.when(F.coalesce(bad, F.lit(False)), "medium").otherwise("low"), ground))


def resume_violations(records: DataFrame, wanted: DataFrame, fingerprint_column: str, value: str, keys: tuple[str, str] = ("case_id", "model_name")) -> DataFrame:
    """(rule, key, detail) of checkpoint records that a run may not go on from: repeated pairs, pairs that are not
    wanted, and records of another fingerprint."""
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("<null>")) for k in keys])
    repeated = records.groupBy(*keys).count().where("count > 1")
    unknown = records.join(wanted.select(*keys).distinct(), list(keys), "left_anti")
    other = records.where(~F.col(fingerprint_column).eqNullSafe(F.lit(value)))
    return violations(_found(repeated, "repeated record", key, F.col("count")), _found(unknown, "unknown pair", key, F.lit("not wanted")), _found(other, "other fingerprint", key, F.col(fingerprint_column)))
