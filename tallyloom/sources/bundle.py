"""Verified bundles: Parquet parts with digests beside them, and the contract of a published release.

    <path>/rows      the parts
    <path>/digests   a row for each part: name, bytes, sha256 of the file; rows and an order-free digest of what it holds
    <path>/facts     one JSON line: status, dataset, models, counts, fingerprint

A row's SHA-256 is cut into four numbers, and a digest is the four sums over rows. So it neither depends on order nor on how rows lie in files, adds up over
parts, and is had by any engine in one aggregation; two sets of rows agree only if their rows do. File hashes find damage that rows don't show.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import ContractError, enforce, violations

SUMS = ["d0", "d1", "d2", "d3"]


def row_text(columns: list[str]) -> Column:
    """The text of a row: each value behind its length, n for null."""
    said = lambda c: F.col(f"`{c}`").cast("string")
    return F.concat(*[F.coalesce(F.concat(F.length(said(c)).cast("string"), F.lit(":"), said(c)), F.lit("n")) for c in columns])


def digested(df: DataFrame, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """rows and the sums d0 to d3 of df, for each value of `by`. Columns count in the order given (None: by name), nested ones as Spark shows them."""
    digest = F.sha2(row_text(columns or sorted(set(df.columns) - set(by or []))), 256)
    number = lambda k: F.conv(F.substring("__digest", 1 + 16 * k, 15), 16, 10).cast("decimal(20,0)")
    sums = [F.coalesce(F.sum(number(k)), F.lit(0)).cast("decimal(38,0)").alias(d) for k, d in enumerate(SUMS)]
    return df.withColumn("__digest", digest).groupBy(*(by or [])).agg(F.count("*").alias("rows"), *sums)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and SHA-256 of each part, hashed where it is read."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{path}/rows")
    return parts.select(F.element_at(F.split("path", "/"), -1).alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """Rows and digest of each part, in one scan."""
    rows = spark.read.parquet(f"{path}/rows")
    return digested(rows.withColumn("part", F.col("_metadata.file_name")), ["part"], sorted(rows.columns))


def write_verified(df: DataFrame, path: str, facts: dict, files: int | None = None) -> None:
    """Write df and its digests. files: parts to write (None: as df is dealt). The facts are written last; a bundle without them is not there."""
    spark = df.sparkSession
    (df.repartition(files) if files else df).write.parquet(f"{path}/rows")
    _files(spark, path).join(_parts(spark, path), "part", "left").coalesce(1).write.parquet(f"{path}/digests")
    spark.createDataFrame([(json.dumps(facts, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{path}/facts")


def bundle_facts(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/facts").first()["value"])


def file_violations(spark: SparkSession, path: str) -> DataFrame:
    """(rule, key, detail) of parts that are missing, not listed, or whose bytes are not those written."""
    listed = spark.read.parquet(f"{path}/digests").select("part", F.col("bytes").alias("was"), F.col("sha256").alias("hash"))
    both = listed.join(_files(spark, path), "part", "full")
    rule = F.when(F.col("sha256").isNull(), "missing part").when(F.col("hash").isNull(), "unlisted part").when(F.col("was") != F.col("bytes"), "part size").when(F.col("hash") != F.col("sha256"), "part hash")
    return both.where(rule.isNotNull()).select(rule.alias("rule"), F.col("part").alias("key"), F.concat_ws(" for ", F.coalesce(F.col("bytes").cast("string"), F.lit("none")), F.coalesce(F.col("was").cast("string"), F.lit("none"))).alias("detail"))


def row_violations(spark: SparkSession, path: str) -> DataFrame:
    """(rule, key, detail) of parts whose rows are not those written: as many, and with the same digest."""
    listed = spark.read.parquet(f"{path}/digests").where("rows is not null").alias("w")
    both = listed.join(_parts(spark, path).alias("f"), "part", "full")
    same = F.lit(True)
    for d in SUMS:
        same &= F.col(f"w.{d}").eqNullSafe(F.col(f"f.{d}"))
    rule = F.when(~F.col("w.rows").eqNullSafe(F.col("f.rows")), "part rows").when(~same, "part digest")
    shown = F.concat_ws(" for ", F.coalesce(F.col("f.rows").cast("string"), F.lit("none")), F.coalesce(F.col("w.rows").cast("string"), F.lit("none")))
    return both.where(rule.isNotNull()).select(rule.alias("rule"), F.col("part").alias("key"), shown.alias("detail"))


def read_verified(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    """The rows of a bundle whose files, rows and, if one is given, fingerprint are as written; anything else is a ContractError."""
    if fingerprint is not None and (found := bundle_facts(spark, path).get("fingerprint")) != fingerprint:
        raise ContractError(f"bundle of fingerprint {found}, {fingerprint} is wanted")
    enforce(file_violations(spark, path))  # before the rows, which a damaged file may not give
    enforce(row_violations(spark, path))
    return spark.read.parquet(f"{path}/rows")


def release_violations(outputs: DataFrame, facts: dict, dataset: str, version: str, models: list[str]) -> DataFrame:
    """(rule, key, detail) of a published release and the outputs (case_id, model_name, ...) that claim to be it.

    The facts: status published, dataset and version, release_id, models that are known, case_count, rows as many as both make,
    and the digest of all rows. The outputs: no row of another model, every model with each case once, the digest."""
    spark = outputs.sparkSession
    named = [m for m in facts.get("models") or [] if m]
    cases = int(facts.get("case_count") or 0)
    said = [
        ("status", facts.get("status") == "published", facts.get("status")),
        ("dataset", (facts.get("dataset"), str(facts.get("dataset_version"))) == (dataset, str(version)), f"{facts.get('dataset')} {facts.get('dataset_version')}"),
        ("release id", bool(str(facts.get("release_id") or "").strip()), facts.get("release_id")),
        ("models", bool(named) and set(named) <= set(models), ", ".join(sorted(set(named) - set(models))) or "none"),
        ("case count", cases > 0, cases),
        ("rows", int(facts.get("rows") or 0) == cases * len(named), facts.get("rows")),
    ]
    wrong = spark.createDataFrame([(rule, "facts", str(detail)) for rule, fine, detail in said if not fine], "rule string, key string, detail string")
    # one pass by model gives counts and digests, which add up to those of all rows
    by_model = digested(outputs.withColumn("__model", F.col("model_name")), ["__model"], sorted(outputs.columns))
    kinds = outputs.groupBy("model_name", "case_id").agg(F.count("*").alias("n")).groupBy(F.col("model_name").alias("__model")).agg(F.count("*").alias("cases"), F.count_if(F.col("n") > 1).alias("repeated"))
    each = by_model.alias("b").join(kinds.alias("k"), F.col("b.__model").eqNullSafe(F.col("k.__model")))
    known = F.coalesce(F.col("b.__model").isin(named), F.lit(False)) if named else F.lit(False)
    rule = F.when(~known, "unknown model").when(F.col("repeated") > 0, "repeated cases").when(F.col("cases") != cases, "cases of a model")
    odd = each.where(rule.isNotNull()).select(rule.alias("rule"), F.coalesce("b.__model", F.lit("null")).alias("key"), F.col("cases").cast("string").alias("detail"))
    seen = spark.createDataFrame([(m,) for m in named], "m string")
    absent = seen.join(by_model, F.col("m") == F.col("__model"), "left_anti").select(F.lit("absent model").alias("rule"), F.col("m").alias("key"), F.lit("0").alias("detail"))
    total = by_model.agg(*[F.coalesce(F.sum(d), F.lit(0)).cast("decimal(38,0)").cast("string").alias(d) for d in SUMS])
    wanted = [str(x) for x in facts.get("digest") or []]
    differs = total.where(F.array(*SUMS) != F.lit(wanted if len(wanted) == len(SUMS) else [""])).select(F.lit("digest").alias("rule"), F.lit("outputs").alias("key"), F.concat_ws(" ", *SUMS).alias("detail"))
    return violations(wrong, odd, absent, differs)


def total_digest(df: DataFrame) -> list[str]:
    """The digest of all rows, for the facts of a release."""
    row = digested(df, None, sorted(df.columns)).first()
    return [str(row[d]) for d in SUMS]
