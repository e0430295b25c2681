"""JSON texts as Spark's VARIANT, taken strictly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"(?U)\A\s+|\s+\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value written and computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unfenced(text: Column) -> Column:
    """The text inside a code fence, if it stands in one."""
    text = F.regexp_replace(text, _BLANK, "")
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\A(?:```json\s*)?(?:```\s*)?", ""), r"(?U)\s*```\z", "")


def strict_json(text: Column) -> Column:
    """The value of a text that is one JSON value and nothing else; null for any other.

    Spark's parser stops behind the first value. So the text is parsed as a field of an object that goes on behind it, under a name
    that no text can hold, its own hash."""

    def parsed(said: Column, mark: Column) -> Column:
        whole = F.try_parse_json(F.concat(F.lit('{"v":'), said, F.lit(',"'), mark, F.lit('":0}'))).cast("map<string,variant>")
        return let(whole, lambda w: F.when((F.size(w) == 2) & F.map_contains_key(w, mark), F.element_at(w, F.lit("v"))))

    return let(text, lambda said: let(F.sha2(said, 256), lambda mark: parsed(said, mark)))


def fields(value: Column) -> Column:
    """map<string, variant> of an object, null for any other value."""
    return let(value, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v.cast("map<string,variant>")))


def text_of(value: Column) -> Column:
    """A string value, null for any other."""
    return let(value, lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string")))


def number_of(value: Column) -> Column:
    """A number, null for any other value."""
    return let(value, lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), v.cast("double")))
