"""Dataset construction from relational extracts: eligibility with counted reasons, families, expected answers, evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded_text, number_spellings, stable_id, trimmed
from .validate import first_reason


def single_child(child: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key: how many child rows it has, and the columns of the only one."""
    n = F.count(F.lit(1))
    return child.groupBy(key).agg(n.alias("n"), *[F.when(n == 1, F.max(c)).alias(c) for c in columns])


def child_lists(child: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """Sorted distinct values of each expression per key."""
    return child.groupBy(key).agg(*[F.array_sort(F.collect_set(c)).alias(n) for n, c in columns.items()])


def all_present(value: Column) -> Column:
    """Aggregate: there are child rows, and none of them is blank."""
    return (F.count(F.lit(1)) > 0) & F.bool_and(F.coalesce(F.trim(value) != "", F.lit(False)))


def screened(df: DataFrame, rules: list[tuple[str, Column]], reason: str = "exclusion_reason") -> DataFrame:
    """df with the first failing rule of each row, null where it is eligible."""
    return df.withColumn(reason, first_reason(rules))


def exclusion_counts(df: DataFrame, reason: str = "exclusion_reason") -> DataFrame:
    return df.groupBy(F.coalesce(reason, F.lit("eligible")).alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))


def families(df: DataFrame, owner: str, name: str, parts: str, consistent: list[str], prefix: str = "family") -> DataFrame:
    """Rows grouped by owner, folded name and sorted set of parts; only families that agree on the consistent columns.

    A family has a stable id, its size, and a stratum by number of parts and variants."""
    folded = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    keyed = df.select("*", folded.alias("__name"), F.array_join(F.array_sort(F.array_distinct(parts)), ",").alias("__parts"))
    agree = [F.count_distinct(F.lower(F.trim(c))).alias(f"kinds_{c}") for c in consistent]
    out = keyed.groupBy(owner, "__name", "__parts").agg(F.count(F.lit(1)).alias("variants"), F.min(name).alias(name), *agree, *[F.min(c).alias(c) for c in consistent])
    several, many = F.size(F.split("__parts", ",")) > 1, F.col("variants") > 1
    stratum = F.when(several & many, "both").when(several, "multi_part").when(many, "multi_variant").otherwise("single")
    for c in consistent:
        out = out.where(F.col(f"kinds_{c}") <= 1).drop(f"kinds_{c}")
    family = stable_id(prefix, F.col(owner).cast("string"), F.col("__name"), F.col("__parts"))
    return out.select(family.alias("family_id"), owner, name, F.col("__parts").alias("parts"), "variants", stratum.alias("stratum"), *consistent)


def expected_answers(df: DataFrame, key: list[str], lists: dict[str, Column], scalars: dict[str, Column]) -> DataFrame:
    """JSON answers per key: sorted distinct lists and single values."""
    aggs = [F.array_sort(F.collect_set(c)).alias(n) for n, c in lists.items()] + [F.min(c).alias(n) for n, c in scalars.items()]
    out = df.groupBy(*key).agg(*aggs)
    return out.select(*key, F.to_json(F.struct(*lists, *scalars)).alias("expected_output"))


def rendered_record(fields: list[tuple[str, Column]], separator: str = " | ") -> Column:
    """`label: value` lines; lists are joined, empty values left out."""
    lines = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}: "), v.cast("string"))) for label, v in fields]
    return F.concat_ws("\n", *lines)


def parsed_record(text: Column) -> Column:
    """map<label, value> of a rendered record."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains(": "))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.split_part(x, F.lit(": "), F.lit(1)).alias("k"), F.substr(x, F.instr(x, ": ") + 2).alias("v"))))


def first_evidence_page(pages: DataFrame, wanted: DataFrame, document: str = "document_id") -> DataFrame:
    """wanted (document, field, candidates array) with the first page that holds any candidate; pages: (document, page, text).

    Both are searched as folded_text, whole; a candidate of which nothing is left is not searched. Pages meet the
    candidates of their own document only."""
    # a text that can be null would be folded once more, to see whether it is
    each = wanted.select(document, "field", F.explode("candidates").alias("candidate")).select(document, "field", folded_text(F.col("candidate")).alias("candidate")).where("candidate <> ''")
    met = each.join(pages.select(document, "page", F.coalesce(folded_text(F.col("text")), F.lit("")).alias("said")), document).where(F.col("said").contains(F.col("candidate")))
    found = met.groupBy(document, "field").agg(F.min("page").alias("page"))
    return wanted.join(found, [document, "field"], "left")


def number_candidates(value: Column) -> Column:
    """Spellings of a number to search for."""
    return F.coalesce(number_spellings(value), F.array().cast("array<string>"))


#: Why a drug record is no variant, in the order in which it is found.
INELIGIBLE = [
    "not_human", "missing_or_ambiguous_current_status", "current_status_not_marketed", "missing_french_status", "invalid_din", "missing_brand_name", "missing_or_ambiguous_din_owner",
    "incomplete_din_owner", "incomplete_ingred_rows", "incomplete_form_rows", "incomplete_route_rows", "incomplete_schedule_rows", "non_numeric_strength",
]


def eligibility(drug: DataFrame, status: DataFrame, company: DataFrame, children: dict[str, DataFrame], required: dict[str, list[str]], strength: tuple[str, str] = ("ingred", "strength")) -> DataFrame:
    """drug (drug_code, din, brand_name, class) with `reason`: the first that keeps it from being a variant, or null.

    status: (drug_code, status, status_f, current) rows, of which one has to be current; company: (drug_code, company_code,
    company_name, company_type), of which one has to own the DIN; children: tables by name whose required columns have to have
    a value in every row, and that have to have rows. Each table is brought to a row per drug before it is joined."""
    has = lambda c: F.coalesce(trimmed(F.col(c).cast("string")), F.lit("")) != ""
    same = lambda c, word: F.lower(trimmed(F.col(c).cast("string"))) == word
    now = status.where(F.coalesce(F.col("current"), F.lit(False))).groupBy("drug_code").agg(F.count(F.lit(1)).alias("n_status"), F.bool_and(F.coalesce(same("status", "marketed"), F.lit(False))).alias("marketed"), F.bool_and(has("status_f")).alias("french"))
    owner = company.where(same("company_type", "din_owner")).groupBy("drug_code").agg(F.count(F.lit(1)).alias("n_owner"), F.bool_and(has("company_code") & has("company_name")).alias("owner"))
    out = drug.join(now, "drug_code", "left").join(owner, "drug_code", "left")
    for name, rows in children.items():
        whole = [has(c) for c in required[name]]
        fine = F.bool_and(reduce(lambda a, b: a & b, whole, F.lit(True)))
        extra = [F.bool_and(F.coalesce(F.col(strength[1]).try_cast("decimal(38,10)").isNotNull(), F.lit(False))).alias("numeric")] if name == strength[0] else []
        out = out.join(rows.groupBy("drug_code").agg(fine.alias(f"whole_{name}"), *extra), "drug_code", "left")
    rules = [same("class", "human"), F.col("n_status") == 1, F.col("marketed"), F.col("french"), trimmed(F.col("din")).rlike(r"^\d{8}$"), has("brand_name"), F.col("n_owner") == 1, F.col("owner")]
    rules += [F.col(f"whole_{n}") for n in ("ingred", "form", "route", "schedule")] + [F.col("numeric")]
    return out.select(*drug.columns, first_reason(list(zip(INELIGIBLE, rules, strict=True))).alias("reason"))


def stratum(ingredients: Column, variants: Column) -> Column:
    """Complexity of a product family by its distinct ingredients and its variants."""
    many, several = ingredients >= 2, variants >= 2
    return F.when(many & several, "multi_ingredient_multi_variant").when(several, "multi_variant").when(many, "multi_ingredient").otherwise("single_ingredient")
