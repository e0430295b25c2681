"""Reshaping and row choice: pivots, unpivots, keep-last, shares, order restoration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def long_to_wide(df: DataFrame, key: str, name: str, names: list[str], values: dict[str, str]) -> DataFrame:
    """One row per key; for each name and value column <value>__<name>. Names are given, so no extra scan looks for them."""
    each = [F.max(F.when(F.col(name) == n, F.col(v))).alias(f"{out}__{n}") for n in names for v, out in values.items()]
    return df.groupBy(key).agg(*each)


def wide_to_long(df: DataFrame, key: list[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    """One row per key and column; columns maps a column to its name in the long form."""
    renamed = df.select(*key, *[F.col(c).alias(n) for c, n in columns.items()])
    return renamed.unpivot(key, list(columns.values()), name, value)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a pre-aggregated maximum, not a sort of each group."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    out = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("x"))
    return out.select(*keys, *[F.col(f"x.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def share_of_total(df: DataFrame, value: str, within: list[str], out: str = "share") -> DataFrame:
    return df.withColumn(out, F.try_divide(F.col(value).cast("double"), F.sum(value).over(W.partitionBy(*within)).cast("double")))


def restore_order(df: DataFrame, reference: DataFrame, key: str, position: str) -> DataFrame:
    return df.join(reference.select(key, position), key, "left").orderBy(F.col(position).asc_nulls_last(), key)


def nested_slices(bundles: DataFrame, column: str, key: str) -> DataFrame:
    """Slice records of a JSON text {slice: {value: {pass_rate, cases}}} as rows."""
    kind = "map<string,map<string,struct<pass_rate:double,cases:bigint>>>"
    outer = bundles.select(key, F.explode(F.from_json(column, kind)).alias("slice_type", "values"))
    return outer.select(key, "slice_type", F.explode("values").alias("slice_value", "x")).select(key, "slice_type", "slice_value", "x.*")


def attach(df: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Left join to a table with one row per key; a repeated key fails the query."""
    one = metadata.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in metadata.columns if c != key])
    checked = one.withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.col(key).cast("string"))).cast("long")).otherwise(F.col("__n")))
    return df.join(checked.where("__n = 1").drop("__n"), key, "left")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order: a pre-aggregated minimum. Rows that tie are told apart by their other columns."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    out = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("x"))
    return out.select(*keys, *[F.col(f"x.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def group_records(df: DataFrame, by: list[str], case: str) -> DataFrame:
    """How many rows and distinct cases each group has, null groups included."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(case).alias("cases"))


def restricted(df: DataFrame, keys: DataFrame, columns: list[str], models: list[str] | None = None) -> DataFrame:
    """Rows whose key is among those given and, if there is a list of models, whose model is."""
    out = df.join(keys.select(*columns).distinct(), columns, "left_semi")
    return out.where(F.col("model_name").isin(models)) if models else out


def display_pivot(df: DataFrame, row: str, column: str, values: list[str], value: str) -> DataFrame:
    """A table to look at: one row per `row`, one column for each of the values given, blank where there is none."""
    return df.groupBy(row).pivot(column, values).agg(F.first(value))
