"""Text normalisation and stable identifiers.

Normal forms and case folding have no built-in counterpart, so texts outside ASCII go through one Arrow-batched
function; ASCII texts stay in built-in expressions, where both agree.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .variants import let

#: Signs that become blanks.
SIGNS = "™®©"
_SPACES = r"[\t-\r\x1c-\x1f ]"
_BLANK = {ord(c): " " for c in SIGNS}


@dataclass(frozen=True)
class TextRules:
    case_sensitive: bool = False
    trim: bool = True
    collapse: bool = True
    form: str = "NFC"
    strip_marks: bool = False
    strip_punctuation: bool = False


def normal_text(text: str | None, rules: TextRules) -> str:
    """Signs to blanks, Unicode form, marks, punctuation, trim, collapse, fold: in this order."""
    out = unicodedata.normalize(rules.form, (text or "").translate(_BLANK))
    if rules.strip_marks:
        out = "".join(c for c in unicodedata.normalize("NFKD", out) if not unicodedata.combining(c))
    for wanted, pattern, by in ((rules.strip_punctuation, r"[^\w\s%]", " "), (rules.trim, r"\A\s+|\s+\Z", ""), (rules.collapse, r"\s+", " ")):
        if wanted:
            out = re.sub(pattern, by, out)
    return out if rules.case_sensitive else out.casefold()


def plain_form(text: Column, rules: TextRules = TextRules()) -> Column:
    """Column form of normal_text for ASCII texts, built-in."""
    plain = text
    for wanted, pattern, by in ((rules.strip_punctuation, r"[^\w\t-\r\x1c-\x1f %]", " "), (rules.trim, rf"\A{_SPACES}+|{_SPACES}+\z", ""), (rules.collapse, rf"{_SPACES}+", " ")):
        if wanted:
            plain = F.regexp_replace(plain, pattern, by)
    return plain if rules.case_sensitive else F.lower(plain)


def normalized(text: Column, rules: TextRules = TextRules()) -> Column:
    """Column form of normal_text: built-in for ASCII, an Arrow-batched function for the rest."""
    text = F.coalesce(text, F.lit(""))
    plain = plain_form(text, rules)

    @F.pandas_udf("string")
    def general(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: normal_text(t, rules), na_action="ignore")

    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, plain).otherwise(general(F.when(~ascii_only, text)))


def casefolded(text: Column) -> Column:
    """Full case folding (ß as ss): built-in for ASCII, an Arrow-batched function for the rest; null stays null."""

    @F.pandas_udf("string")
    def general(texts: pd.Series) -> pd.Series:
        return texts.map(str.casefold, na_action="ignore")

    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(general(F.when(~ascii_only, text)))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def without_parentheses(text: Column, by: str = " ") -> Column:
    return F.regexp_replace(text, r"\s*\([^)]*\)\s*", by)


def zero_padded(text: Column, width: int) -> Column:
    """Decimal digits padded with zeros, never cut."""
    return F.when(text.rlike(r"\A\p{Nd}+\z") & (F.length(text) < width), F.lpad(text, width, "0")).otherwise(text)


def aliased(text: Column, aliases: dict[str, str], rules: TextRules = TextRules()) -> Column:
    """Text replaced by its alias, both sides normalised once on the driver."""
    if not aliases:
        return text
    pairs = {normal_text(k, rules): normal_text(v, rules) for k, v in aliases.items()}
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(table, text), text)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 16 hex digits of SHA-256 over the parts, joined by the unit separator."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 16))


def hash_order(seed: object, *parts: Column, separator: str = ":") -> Column:
    """Hex key for a deterministic order."""
    return F.sha2(F.concat_ws(separator, F.lit(str(seed)), *parts), 256)


def numeric_key(text: Column) -> Column:
    """Sort key: whole numbers by value, other texts after them."""
    return F.struct(F.coalesce(text.try_cast("bigint"), F.lit((1 << 63) - 1)), text)


def tri_state(text: Column, yes: tuple[str, ...], no: tuple[str, ...]) -> Column:
    said = F.lower(F.trim(text.cast("string")))
    return F.when(said.isin(*yes), True).when(said.isin(*no), False)


def outcome_flag(text: Column) -> Column:
    """true/1 and false/0; anything else is null."""
    return tri_state(text, ("true", "1"), ("false", "0"))


def answer_flag(text: Column) -> Column:
    """true/1/yes and false/0/no; anything else is null."""
    return tri_state(text, ("true", "1", "yes"), ("false", "0", "no"))


def grade_flag(text: Column) -> Column:
    """The mark of an external evaluation log: c or correct is true, any other mark false."""
    said = F.lower(F.trim(text.cast("string")))
    return F.when(said.isNotNull(), said.isin("c", "correct", "true", "1"))


def number(text: Column) -> Column:
    """A number, or null where the text is none."""
    return text.cast("string").try_cast("double")


def number_spellings(value: Column) -> Column:
    """Ways in which a document may write a number, in order: as it is, without a closing .0, with a comma or a blank for the
    point, and, for whole numbers of four digits or more, grouped by commas or by blanks."""
    grouped = F.format_number(value.try_cast("decimal(38,0)"), 0)
    whole = value.rlike("^[0-9]{4,38}$")
    every = F.array(
        value,
        F.when(value.endswith(".0"), F.substr(value, F.lit(1), F.length(value) - 2)),
        F.translate(value, ".", ","),
        F.translate(value, ".", " "),
        F.when(whole, grouped),
        F.when(whole, F.translate(grouped, ",", " ")),
    )
    return F.when(value.isNotNull(), F.array_distinct(F.array_compact(every)))


def folded_text(value: Column) -> Column:
    """Text for search in monographs: without signs, marks, punctuation and trade-mark letters, case folded, with a blank
    around each % and single blanks between words."""
    said = normalized(value, TextRules(form="NFKD", strip_marks=True, strip_punctuation=True))
    said = F.regexp_replace(said, r"(?<![\p{L}\p{N}_])(?:pr|mc|tm)(?![\p{L}\p{N}_])", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(said, "%", " % "), r"\s+", " "))


def json_strings(text: Column, strict: bool = False) -> Column:
    """A JSON list as an array of strings. What is no list is an empty array or, strict, fails the query; null is empty."""
    found = F.from_json(text, "array<string>")
    fine = F.trim(text).startswith("[") & found.isNotNull()
    other = F.raise_error(F.concat(F.lit("not a JSON list: "), F.substring(text, 1, 100))).cast("array<string>") if strict else F.array().cast("array<string>")
    return F.when(text.isNull(), F.array().cast("array<string>")).when(fine, found).otherwise(other)


def canonical_sha256(text: Column) -> Column:
    """SHA-256 of a JSON document with sorted keys and no blanks, so that equal documents have one hash; null if it is no JSON."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str | None:
            try:
                return hashlib.sha256(json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
            except ValueError:
                return None

        return texts.map(one, na_action="ignore")

    return run(text)


def with_settings(text: str, settings: dict[str, str]) -> str:
    """${NAME} and ${NAME:-default} replaced by settings, in defaults as well; a name without either is an error."""
    pattern = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-((?:[^{}]|\{[^{}]*\})*))?\}")

    def put(m: re.Match) -> str:
        if settings.get(m[1]):
            return settings[m[1]]
        if m[2] is None:
            raise KeyError(f"{m[1]} is not set")
        return with_settings(m[2], settings)

    return pattern.sub(put, text)


def filled(template: str, columns: list[str]) -> Column:
    """A prompt: {name} becomes the column's text (null: empty), {{ and }} are braces, and a name that is no column stays."""
    parts = []
    for m in re.finditer(r"\{\{|\}\}|\{([^{}]*)\}|[^{}]+|[{}]", template):
        known = m[1] is not None and m[1] in columns
        parts.append(F.coalesce(F.col(f"`{m[1]}`").cast("string"), F.lit("")) if known else F.lit({"{{": "{", "}}": "}"}.get(m[0], m[0])))
    return F.concat(*parts) if parts else F.lit("")


def percent(value: Column, digits: int = 1) -> Column:
    """0.1234 as 12.3%; null as an empty text."""
    return F.when(value.isNull(), "").otherwise(F.concat(F.format_string(f"%.{digits}f", value * 100), F.lit("%")))


def dollars(value: Column, digits: int = 4) -> Column:
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("$"), F.format_string(f"%,.{digits}f", value)))


def strength(text: Column) -> Column:
    """A strength as a number without needless zeros: whole where it is whole, all of its digits else. Null where the text is no number.

    A sign, digits with or without a point and an exponent make a number."""
    pattern = r"\A([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d{1,3}))?\z"

    def moved(sign: Column, whole: Column, rest: Column, power: Column) -> Column:
        # the point moves by the exponent, over zeros where digits end
        left, right = F.greatest(F.lit(0), -power), F.greatest(F.lit(0), power)
        digits = F.concat(F.repeat(F.lit("0"), left), whole, rest, F.repeat(F.lit("0"), right))
        point = left + F.length(whole) + power
        short = let(digits, lambda d: F.struct(F.ltrim(F.substr(d, F.lit(1), point), F.lit("0")).alias("whole"), F.rtrim(F.substr(d, point + 1), F.lit("0")).alias("rest")))
        shown = let(short, lambda s: F.concat(F.when(s["whole"] == "", "0").otherwise(s["whole"]), F.when(s["rest"] == "", "").otherwise(F.concat(F.lit("."), s["rest"]))))
        return let(shown, lambda s: F.concat(F.when((sign == "-") & (s != "0"), "-").otherwise(""), s))

    def of(said: Column) -> Column:
        parts = F.array(*[F.regexp_extract(said, pattern, k) for k in (1, 2, 3, 4)])
        known = lambda p: moved(p[0], p[1], p[2], F.coalesce(F.nullif(p[3], F.lit("")).cast("int"), F.lit(0)))
        return F.when(said.rlike(r"\A[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d{1,3})?\z"), let(parts, known))

    return let(trimmed(text), of)


def complexity(pages: Column) -> Column:
    return F.when(pages <= 30, "short").when(pages <= 60, "medium").otherwise("long")
