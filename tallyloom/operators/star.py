"""Joins in which each base row must find exactly one row on every side, and checks of many tables by rules that are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variants import fields, strict_json
from .validate import ContractError, enforce


def _shown(columns: list[str], source: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(f"{source}.`{c}`").cast("string"), F.lit("<null>")) for c in columns])


class StarJoin:
    """base joined to sides, each {name: (table, keys)} with keys that both have.

    Every side is grouped by its keys before it is joined, so a key that repeats neither multiplies rows nor makes a hot task. A null key finds
    nothing. `rows` has the base's columns and a struct column for each side; `violations` says what is absent or repeated."""

    def __init__(self, base: DataFrame, sides: dict[str, tuple[DataFrame, list[str]]]) -> None:
        self.base, self.sides = base, sides
        if clash := sorted({n.lower() for n in sides} & {c.lower() for c in base.columns}):
            raise ContractError(f"sides are named like columns: {', '.join(clash)}")
        out = base.select(F.struct("*").alias("__base"))
        for name, (table, keys) in sides.items():
            one = table.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count("*").alias("n"), F.first(F.struct(*[f"`{c}`" for c in table.columns])).alias("row"))
            one = one.select(F.struct(*[f"__{k}" for k in keys]).alias(f"{name}__key"), F.struct("n", "row").alias(name))
            on = [F.col(f"__base.`{k}`") == F.col(f"{name}__key.`__{k}`") for k in keys]
            out = out.join(one, on if len(on) > 1 else on[0], "left").drop(f"{name}__key")
        self.checked = out

    def count(self, name: str) -> Column:
        return F.coalesce(F.col(f"{name}.n"), F.lit(0))

    def rows(self) -> DataFrame:
        """Base rows that find exactly one row on every side."""
        fine = F.lit(True)
        for name in self.sides:
            fine &= self.count(name) == 1
        return self.checked.where(fine).select("__base.*", *[F.col(f"{name}.row").alias(name) for name in self.sides])

    def violations(self) -> DataFrame:
        """(rule, key, detail): for each side, base keys that find no row or several, and how many base rows ask for them."""
        found = [F.struct(F.lit(name).alias("side"), _shown(keys, "__base").alias("key"), self.count(name).alias("n")) for name, (_, keys) in self.sides.items()]
        each = self.checked.select(F.explode(F.array(*found)).alias("x")).select("x.*").where("n <> 1").groupBy("side", "key", "n").agg(F.count("*").alias("asked"))
        return each.select(F.concat(F.when(F.col("n") == 0, "absent ").otherwise("repeated "), F.col("side")).alias("rule"), "key", F.concat(F.col("n").cast("string"), F.lit(" rows for "), F.col("asked").cast("string")).alias("detail"))

    def strict(self) -> DataFrame:
        """rows(), or a ContractError with the first offenders."""
        enforce(self.violations())
        return self.rows()


#: Kinds of rules: a value is there; is filled; is of one kind, whatever its case; is a JSON object with the fields that the argument lists; occurs once.
KINDS = ("column", "filled", "type", "json", "unique")


def rule_violations(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations (rule, key, detail) of cases (benchmark, case_id, cells map<string,string>) by rules (benchmark, column, kind, argument).

    Rules are rows, so any number of benchmarks is one scan: cells meet the rules of their column, and partial counts by rule (for `unique`, by
    value) are all that is shuffled. A rule whose column no case of its benchmark has is `absent`, whatever its kind; an unknown kind is an error. Null and
    blank cells are values like others but for `filled` and `json`."""
    odd = rules.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).select("kind").first()
    if odd:
        raise ContractError(f"unknown kind of rule: {odd['kind']}")
    rules = rules.select("benchmark", "column", "kind", "argument").distinct()
    cells = cases.select("benchmark", F.col("case_id").cast("string").alias("case_id"), F.explode("cells").alias("column", "value"))
    met = cells.join(rules, ["benchmark", "column"])
    said = F.coalesce(F.trim("value"), F.lit(""))
    keys = F.map_keys(fields(strict_json(F.col("value"))))
    lacks = F.when(keys.isNull(), F.array(F.lit("no object"))).otherwise(F.array_except(F.coalesce(F.from_json("argument", "array<string>"), F.array().cast("array<string>")), keys))
    bad = F.when(F.col("kind") == "filled", said == "").when(F.col("kind") == "type", F.lower(F.coalesce("value", F.lit(""))) != F.lower("argument")).when(F.col("kind") == "json", F.size(lacks) > 0).otherwise(F.lit(False))
    value = F.when(F.col("kind") == "unique", F.col("value"))
    counted = met.groupBy("benchmark", "column", "kind", "argument", value.alias("value")).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.min(F.when(bad, F.col("case_id"))).alias("first"))
    twice = (F.col("kind") == "unique") & (F.col("n") > 1)
    each = counted.groupBy("benchmark", "column", "kind", "argument").agg(F.sum(F.col("bad") + F.when(twice, 1).otherwise(0)).alias("bad"), F.min(F.when(twice, F.col("value")).otherwise(F.col("first"))).alias("first"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("benchmark", "column", "kind", "argument")]
    both = rules.alias("r").join(each.alias("e"), same[0] & same[1] & same[2] & same[3], "left")
    rule = F.when(F.col("e.kind").isNull(), "absent").when(F.col("bad") > 0, F.col("r.kind"))
    return both.where(rule.isNotNull()).select(rule.alias("rule"), F.concat_ws("|", "r.benchmark", "r.column", F.when(F.col("e.kind").isNull(), F.col("r.kind"))).alias("key"), F.coalesce(F.concat(F.col("bad").cast("string"), F.lit(", first "), F.coalesce("first", F.lit("null"))), F.lit("no case has it")).alias("detail"))
