"""Contracts of tables, as violation tables: (rule, key, detail). An empty one means the contract holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized


class ContractError(ValueError):
    pass


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def violations(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def enforce(found: DataFrame, first: int = 10) -> None:
    """Raise with the first offenders, in order."""
    if rows := found.orderBy("rule", "key").limit(first).collect():
        raise ContractError("; ".join(f"{r['rule']}: {r['key']} ({r['detail']})" for r in rows))


def _key(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns])


def _found(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def blank_keys(df: DataFrame, column: str) -> DataFrame:
    said = F.trim(F.col(column).cast("string"))
    return _found(df.where(said.isNull() | (said == "")).groupBy().count().where("count > 0"), f"blank {column}", F.lit(column), F.col("count"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return _found(df.groupBy(*keys).count().where("count > 1"), "duplicate key", _key(keys), F.col("count"))


def definition_conflicts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys with more than one value in a column that defines them; null counts as a value.

    Least and greatest values find the conflicts in one pre-aggregated pass; values are counted for these keys and columns only."""
    differ = [(F.min(c).isNotNull() & ((F.min(c) != F.max(c)) | (F.count(c) < F.count(F.lit(1))))).alias(c) for c in columns]
    wide = df.groupBy(key).agg(*differ)
    odd = wide.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("differs")) for c in columns])).alias("x")).where("x.differs").select(key, "x.column")
    each = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select(key, "x.column", "x.value")
    kinds = each.join(odd, [key, "column"], "left_semi").distinct().groupBy(key, "column").agg(F.count(F.lit(1)).alias("kinds"))
    return _found(kinds, "conflicting definition", F.concat_ws("|", F.col(key).cast("string"), F.col("column")), F.col("kinds"))


def short_cases(df: DataFrame, case: str, model: str) -> DataFrame:
    """Cases that lack a model: (rule, case, models that it has of all). One pre-aggregated pass and one row of totals."""
    have = df.groupBy(case).agg(F.count_distinct(model).alias("have"))
    every = df.agg(F.count_distinct(model).alias("every"))
    short = have.join(F.broadcast(every), F.col("have") < F.col("every"))  # one row
    return _found(short, "missing models", F.col(case), F.concat_ws(" of ", "have", "every"))


def coverage_gaps(df: DataFrame, case: str, model: str, most_models: int = 10_000) -> DataFrame:
    """Pairs of a case and a model that have no row: only cases that lack a model are expanded, by the list of all models, of
    which there may be most_models."""
    names = df.agg(F.array_sort(F.collect_set(model)).alias("every"))
    few = names.select(F.when(F.size("every") > most_models, F.raise_error(F.lit("too many models"))).otherwise(F.col("every")).alias("every"))
    have = df.groupBy(case).agg(F.collect_set(model).alias("have"))
    gaps = have.join(F.broadcast(few), F.size("have") < F.size("every"))  # one row
    return _found(gaps.select(case, F.explode(F.array_except("every", "have")).alias(model)), "missing pair", _key([case, model]), F.lit("absent"))


def unknown_keys(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return _found(df.join(known, key, "left_anti").groupBy(key).count(), f"unknown {key}", F.col(key), F.col("count"))


def unknown_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return _found(df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).groupBy(column).count(), f"unknown {column}", F.coalesce(F.col(column), F.lit("<null>")), F.col("count"))


def set_difference(left: DataFrame, right: DataFrame, key: str, fold: bool = False) -> DataFrame:
    """(key, side): keys that only one side has."""
    at = normalized(F.col(key)) if fold else F.col(key)
    a, b = left.select(at.alias(key)).distinct().withColumn("l", F.lit(1)), right.select(at.alias(key)).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").where("l is null or r is null").select(key, F.when(F.col("r").isNull(), "missing").otherwise("extra").alias("side"))


def frozen_differences(df: DataFrame, reference: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose frozen columns differ from the reference's, column by column, null safe."""
    ref = reference.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (~F.col(c).eqNullSafe(F.col(f"__{c}"))).alias("differs")) for c in columns]))
    return _found(df.join(ref, key).select(key, each.alias("x")).where("x.differs"), "changed reference", F.col(key), F.col("x.column"))


def split_leakage(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return _found(df.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1), "group across splits", F.col(group), F.concat_ws(",", "s"))


def quota_gaps(df: DataFrame, columns: list[str], quotas: DataFrame) -> DataFrame:
    """Groups whose count is not the quota's (columns..., quota)."""
    have = df.groupBy(*columns).count()
    both = have.join(quotas, columns, "full_outer").where("not (coalesce(count, 0) <=> coalesce(quota, 0))")
    return _found(both, "quota", _key(columns), F.concat_ws(" of ", F.coalesce("count", F.lit(0)), F.coalesce("quota", F.lit(0))))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that fails, in order; null where none does. A null condition fails."""
    out = None
    for name, holds in rules:
        failed = ~F.coalesce(holds, F.lit(False))
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out


def missing_items(required: Column, have: Column) -> Column:
    return F.array_sort(F.array_except(required, have))


def observation_violations(observations: DataFrame, cases: DataFrame, labels: list[str], keys: list[str]) -> DataFrame:
    """Judge observations: known cases, known labels, unique keys, success has a label and only success has, uncertainty within 0 and 1."""
    done = F.col("status") == "success"
    odd = F.coalesce(done, F.lit(False)) != F.col("label").isNotNull()
    outside = F.col("uncertainty").cast("string").try_cast("double")
    return violations(
        unknown_keys(observations, cases, "case_id"),
        unknown_values(observations.where("label is not null"), "label", labels),
        unknown_values(observations, "status", ["success", "error", "abstain"]),
        duplicate_keys(observations, keys),
        _found(observations.where(odd), "label and status", _key(keys), F.col("status")),
        _found(observations.where(outside.isNotNull() & ~outside.between(0, 1)), "uncertainty", _key(keys), F.col("uncertainty")),
    )


def contract_parity(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """One row: rows compared, rows on one side only, and for each column how many values disagree beyond a tolerance."""
    both = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("a")).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("b")), keys, "full_outer")
    matched = F.col("a").isNotNull() & F.col("b").isNotNull()

    def differs(c: str) -> Column:
        x, y = F.col(f"a_{c}").cast("double"), F.col(f"b_{c}").cast("double")
        return matched & ~F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull())

    return both.agg(F.count_if(matched).alias("compared"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), *[F.count_if(differs(c)).alias(f"{c}_differs") for c in columns])
