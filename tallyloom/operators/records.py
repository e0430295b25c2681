"""Rendered product records, English or French: written from variants, and read again by a grammar of array expressions.

A record is a line for each variant and, below it, lines of labels and of ingredients. The reader knows nothing of the writer but the labels, and says what is wrong with a
record instead of failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strength
from ..functions.variants import let

#: Labels of a record's lines.
LABELS = {
    "en": {"din": "DIN: ", "brand_name": "BRAND_NAME: ", "dosage_forms": "DOSAGE_FORMS: ", "routes": "ROUTES: ", "schedule": "SCHEDULES: ", "product_status": "PRODUCT_STATUS: ", "company": "COMPANY: "},
    "fr": {"din": "DIN: ", "brand_name": "NOM_COMMERCIAL: ", "dosage_forms": "FORMES_PHARMACEUTIQUES: ", "routes": "VOIES_ADMINISTRATION: ", "schedule": "ANNEXES: ", "product_status": "ÉTAT_DU_PRODUIT: ", "company": "ENTREPRISE: "},
}
#: The line of a variant, of its ingredients, the parts of an ingredient, and labels that carry nothing.
VARIANT = {"en": "VARIANT", "fr": "VARIANTE"}
HEADING = {"en": "ACTIVE_INGREDIENTS:", "fr": "INGRÉDIENTS_ACTIFS:"}
INGREDIENT = {"en": ("NAME", "STRENGTH", "UNIT"), "fr": ("NOM", "CONCENTRATION", "UNITÉ")}
CODE = "DRUG_CODE: "
LISTS, SINGLE = ("dosage_forms", "routes", "schedule"), ("brand_name", "product_status", "company")
BETWEEN = " | "


def rendered(variants: Column, language: str) -> Column:
    """The record of variants, array of (din, brand_name, dosage_forms, routes, schedule, product_status, company, ingredients array of (name, strength, unit))."""
    labels, (name, amount, unit) = LABELS[language], INGREDIENT[language]
    value = lambda v, f: F.array_join(v[f], BETWEEN) if f in LISTS else v[f]
    ingredient = lambda i: F.concat(F.lit(f"- {name}="), i["name"], F.lit(f"; {amount}="), i["strength"], F.lit(f"; {unit}="), i["unit"])
    one = lambda v, k: F.concat_ws("\n", F.concat(F.lit(f"{VARIANT[language]} "), (k + 1).cast("string")), *[F.concat(F.lit(label), value(v, f)) for f, label in labels.items()], F.lit(HEADING[language]), F.array_join(F.transform(v["ingredients"], ingredient), "\n"))
    return F.array_join(F.transform(variants, one), "\n\n")


def _key(text: Column) -> Column:
    """What order goes by: blanks and case apart."""
    plain = text.rlike(r"\A[!-~]+(?: [!-~]+)*\z")  # most are, and need no search for blanks of all scripts
    return F.lower(F.when(plain, text).otherwise(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"\A | \z", "")))


def trimmed_line(line: Column) -> Column:
    """A line without blanks of any script at its ends; most begin and end with a printed ASCII character, which is quickly seen."""
    return F.when(line.rlike(r"\A[!-~](?:.*[!-~])?\z"), line).otherwise(F.regexp_replace(line, r"(?U)\A\s+|\s+\z", ""))


def _ordered(values: Column) -> Column:
    pairs = F.array_sort(F.transform(F.array_distinct(values), lambda v: F.struct(_key(v).alias("key"), v.alias("value"))))
    return F.transform(pairs, lambda p: p["value"])


def parsed(text: Column, language: str) -> Column:
    """struct(din, brand_name, active_ingredients array of (name, strength, unit), dosage_forms, routes, schedule, product_status, company, error) of a rendered record.

    Lists are distinct and in order, ingredients by name, strength and unit; a list's values are parted by ` | `, so commas stay. What stands before the first variant is
    passed over. error, null for a good record, is the first of: no variants, an unknown line, fields that a variant lacks, a strength that is no number,
    a field in which variants differ. Then all else is null; so it is for a null text."""
    labels, (name, amount, unit) = LABELS[language], INGREDIENT[language]
    item = rf"\A- {name}=(.*); {amount}=([^;]+); {unit}=(.*)\z"
    known = "|".join([rf"{v}.*" for v in labels.values()] + [rf"{CODE}.*", rf"{HEADING[language]}.*", item[2:-2]])
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), trimmed_line), lambda x: x != "")

    def variant(own: Column) -> Column:
        def field(f: str) -> Column:
            last = F.try_element_at(F.filter(own, lambda x: x.startswith(labels[f])), F.lit(-1))
            said = F.substr(last, F.lit(len(labels[f]) + 1))
            return (F.split(said, r" \| ") if f in LISTS else said).alias(f)

        part = lambda x, k: F.regexp_extract(x, item, k)
        parts = F.transform(F.filter(own, lambda x: x.rlike(item)), lambda x: F.struct(part(x, 1).alias("name"), strength(part(x, 2)).alias("strength"), part(x, 3).alias("unit")))
        odd = F.try_element_at(F.filter(own, lambda x: ~x.rlike(rf"(?s)\A(?:{known})\z")), F.lit(1))
        return F.struct(*[field(f) for f in labels], parts.alias("ingredients"), odd.alias("odd"))

    def cut(all_lines: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(all_lines)), lambda k: F.element_at(all_lines, k).rlike(rf"\A{VARIANT[language]} \d+\z"))
        past = lambda s, k: F.coalesce(F.get(s, k + 1), F.size(all_lines) + 1)
        return let(starts, lambda s: F.transform(s, lambda at, k: let(F.slice(all_lines, at + 1, past(s, k) - at - 1), variant)))

    def whole(vs: Column) -> Column:
        of = lambda f: F.transform(vs, lambda v: v[f])
        lack = lambda v: F.array_compact(F.array(*[F.when(v[f].isNull(), f) for f in sorted(labels)]))
        odd = F.try_element_at(F.filter(of("odd"), lambda x: x.isNotNull()), F.lit(1))
        lacking = F.try_element_at(F.filter(F.transform(vs, lambda v, k: F.when(F.size(lack(v)) > 0, F.concat(F.lit("variant "), (k + 1).cast("string"), F.lit(" lacks "), F.array_join(lack(v), ", ")))), lambda x: x.isNotNull()), F.lit(1))
        parts = F.flatten(of("ingredients"))
        ordered = F.array_sort(F.transform(F.array_distinct(parts), lambda i: F.struct(_key(i["name"]).alias("a"), i["strength"].cast("double").alias("b"), _key(i["unit"]).alias("c"), i.alias("i"))))
        error = F.coalesce(F.when(F.size(vs) == 0, F.lit("no variants")), F.concat(F.lit("unknown line: "), odd), lacking, F.when(F.exists(parts, lambda i: i["strength"].isNull()), F.lit("a strength is no number")), *[F.when(F.size(F.array_distinct(of(f))) > 1, F.lit(f"variants differ in {f}")) for f in SINGLE])

        def made(e: Column) -> Column:
            fine = lambda value, n: F.when(e.isNull(), value).alias(n)
            return F.struct(
                fine(F.array_sort(of("din")), "din"), fine(F.get(of("brand_name"), F.lit(0)), "brand_name"), fine(F.transform(ordered, lambda o: o["i"]), "active_ingredients"),
                *[fine(_ordered(F.flatten(of(f))), f) for f in LISTS], *[fine(F.get(of(f), F.lit(0)), f) for f in SINGLE[1:]], e.alias("error"),
            )

        return let(error, made)

    return F.when(text.isNotNull(), let(let(lines, lambda found: F.when(F.size(found) > 0, cut(found)).otherwise(F.array())), whole))


def parsed_records(records: DataFrame, text: str = "input", language: str = "language") -> DataFrame:
    """records with `parsed`, by each row's language; another language is an error of the row's own."""
    out = None
    for known in LABELS:
        part = records.where(F.lower(F.col(language)) == known).withColumn("parsed", parsed(F.col(text), known))
        out = part if out is None else out.unionByName(part)
    kind = out.schema["parsed"].dataType
    other = records.where(~F.coalesce(F.lower(F.col(language)).isin(*LABELS), F.lit(False)))
    said = F.concat(F.lit("unknown language: "), F.coalesce(F.col(language), F.lit("null")))
    return out.unionByName(other.withColumn("parsed", F.struct(*[(said if f.name == "error" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])))
