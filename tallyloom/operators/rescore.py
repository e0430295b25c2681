"""A second scorer of JSON outputs, over Spark's VARIANT, and rescoring of saved outputs by what has changed.

The second scorer shares no code with functions.jsonscore but the normal form of texts: values become canonical texts from the innermost level on, in which
unordered lists are sorted and sets made distinct. Built-in functions do so in place where texts are ASCII. Values with other texts are exploded to rows of
path and canonical text, level by level, and folded back by grouping; their distinct (expected, output) pairs are scored once. Both scorers agree where Spark's JSON is Python's: repeated keys, NaN and Infinity are not JSON here, and numbers of more
digits than a double holds are compared exactly up to 38 digits.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonscore import JsonRules, score_outputs, steps
from ..functions.text import aliased, normalized, plain_form, without_parentheses, zero_padded
from ..functions.variants import let, strict_json, unfenced

#: Levels of nesting; deeper JSON is an error.
MOST_LEVELS = 64
#: Up to so many opening brackets, a text's levels are not counted any closer.
FEW_LEVELS = 4
#: Deeper values are scored as rows, as built-in functions nested so deep are slow to plan.
PLACE_LEVELS = 12
_NUMBER = r"\A([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d+))?\z"
_NUMERIC = r"\A[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\z"


def plain_number(number: Column) -> Column:
    """One spelling for equal numbers: digits without zeros at either end, and the power of ten."""
    part = lambda k: F.regexp_extract(number, _NUMBER, k)
    digits = F.ltrim(F.concat(part(2), part(3)), F.lit("0"))
    short = F.rtrim(digits, F.lit("0"))
    power = F.coalesce(F.nullif(part(4), F.lit("")).cast("long"), F.lit(0)) - F.length(part(3)) + F.length(digits) - F.length(short)
    return F.when(short == "", "0").otherwise(F.concat(F.when(part(1) == "-", "-").otherwise(""), short, F.lit("e"), power.cast("string")))


def fits(path: Column, pointers: tuple[str, ...]) -> Column:
    """Whether a path is one of these pointers, in which * stands for any step."""
    out = F.lit(False)
    for pointer in pointers:
        wanted = steps(pointer)
        one = F.size(path) == len(wanted)
        for k, step in enumerate(wanted):
            if step != "*":
                one &= F.get(path, F.lit(k)) == step
        out |= one
    return out


def depth(text: Column) -> Column:
    """Levels of nesting of a JSON text."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*+"', "")
    marks = F.filter(F.split(F.regexp_replace(bare, r"[^\[\]{}]+", ""), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, mark: Column) -> Column:
        now = at["now"] + F.when(mark.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(marks, start, step)["most"]


def leaf(value: Column, path: Column, rules: JsonRules) -> Column:
    """The canonical text of a value that holds no others; texts carry their length, so that no two joins of them look alike."""
    kind, said = F.schema_of_variant(value), value.cast("string")
    text = F.when(fits(path, rules.parenthetical), without_parentheses(said)).otherwise(said) if rules.parenthetical else said
    text = normalized(text, rules.text)
    for pointer, width in rules.zero_pad:
        text = F.when(fits(path, (pointer,)), zero_padded(text, width)).otherwise(text)
    other = text
    for pointer, table in rules.aliases:
        text = F.when(fits(path, (pointer,)), aliased(other, dict(table), rules.text)).otherwise(text)
    numeric = fits(path, rules.numeric)
    number = plain_number(said)
    return (
        F.when(kind == "STRING", F.when(numeric & text.rlike(_NUMERIC), F.concat(F.lit("#"), plain_number(text))).otherwise(F.concat(F.lit("s"), F.length(text).cast("string"), F.lit(":"), text)))
        .when(kind == "BOOLEAN", F.concat(F.lit("b"), said))
        .when(kind == "VOID", "z")
        .when(kind.startswith("OBJECT"), "o()")
        .when(kind.startswith("ARRAY"), "l()")
        .otherwise(F.concat(F.when(numeric, "#").otherwise("n"), number))
    )


def _exploded(sides: DataFrame, levels: int) -> DataFrame:
    """(key, side, root, v) -> a row for each leaf: path, and of each step its place and whether it is in a list."""
    rows = sides.withColumns({"path": F.array().cast("array<string>"), "places": F.array().cast("array<int>"), "lists": F.array().cast("array<boolean>")})
    for _ in range(levels):
        rows = sides.sparkSession.sql("SELECT r.*, e.pos, e.key AS name, e.value FROM {rows} r, LATERAL variant_explode_outer(r.v) e", rows=rows)
        inner = F.col("pos").isNotNull()
        rows = rows.select(
            "key", "side", "root", F.when(inner, F.col("value")).otherwise(F.col("v")).alias("v"),
            *[F.when(inner, F.array_append(c, x)).otherwise(F.col(c)).alias(c) for c, x in (("path", F.coalesce("name", F.col("pos").cast("string"))), ("places", F.col("pos")), ("lists", F.col("name").isNull()))],
        )
    return rows


def _folded(rows: DataFrame, level: int, rules: JsonRules) -> DataFrame:
    """Rows whose path has `level` steps become one row for what holds them; an object at the root stays in fields."""
    deep = (F.size("path") == level) & ((F.lit(level) > 1) | F.get("lists", F.lit(0)))
    up = lambda c: F.when(deep, F.slice(c, 1, level - 1)).otherwise(F.col(c)).alias(c)
    item = F.struct(F.when(deep, F.get("places", F.lit(level - 1))).alias("place"), F.when(deep, F.get("path", F.lit(level - 1))).alias("name"), "said")
    within = F.when(deep, F.get("lists", F.lit(level - 1))).alias("within")
    grouped = rows.select("key", "side", "root", up("path"), up("places"), up("lists"), within, item.alias("item")).groupBy("key", "side", "root", "path", "places", "lists", "within").agg(F.sort_array(F.collect_list("item")).alias("items"))
    said = F.col("items.said")
    listed = F.when(fits(F.col("path"), rules.sets), F.array_sort(F.array_distinct(said))).when(fits(F.col("path"), rules.unordered), F.array_sort(said)).otherwise(said)
    named = F.transform("items", lambda i: F.concat(F.length(i["name"]).cast("string"), F.lit(":"), i["name"], F.lit("="), i["said"]))
    whole = F.when(F.col("within"), F.concat(F.lit("l("), F.array_join(listed, ","), F.lit(")"))).when(~F.col("within"), F.concat(F.lit("o("), F.array_join(named, ","), F.lit(")")))
    return grouped.select("key", "side", "root", "path", "places", "lists", F.coalesce(whole, F.get(said, F.lit(0))).alias("said"))


def _short_number(said: Column) -> Column:
    """plain_number of a whole number's digits, without patterns."""
    digits = F.ltrim(said, F.lit("-"))
    short = F.rtrim(digits, F.lit("0"))
    return F.when(short == "", "0").otherwise(F.concat(F.when(said.startswith("-"), "-").otherwise(""), short, F.lit("e"), (F.length(digits) - F.length(short)).cast("string")))


def _here(keys: tuple[Column, ...], pointers: tuple[str, ...]) -> Column | None:
    """fits() of a path whose steps are these columns; None where no pointer has as many."""
    out = None
    for wanted in map(steps, pointers):
        if len(wanted) == len(keys):
            one = reduce(and_, [k == w for k, w in zip(keys, wanted, strict=True) if w != "*"], F.lit(True))
            out = one if out is None else out | one
    return out


def _plain_leaf(value: Column, kind: Column, keys: tuple[Column, ...], rules: JsonRules) -> Column:
    """leaf() of a value whose texts are ASCII, each part computed once."""
    numeric, bare = _here(keys, rules.numeric), _here(keys, rules.parenthetical)

    def number(said: Column) -> Column:
        spelled = F.when(kind == "BIGINT", _short_number(said)).otherwise(plain_number(said))
        return F.concat(F.lit("n") if numeric is None else F.when(numeric, "#").otherwise("n"), spelled)

    def text(said: Column) -> Column:
        for pointer, width in rules.zero_pad:
            if (here := _here(keys, (pointer,))) is not None:
                said = F.when(here, zero_padded(said, width)).otherwise(said)
        other = said
        for pointer, table in rules.aliases:
            if (here := _here(keys, (pointer,))) is not None:
                said = F.when(here, aliased(other, dict(table), rules.text)).otherwise(said)

        def shown(one: Column) -> Column:
            as_text = F.concat(F.lit("s"), F.length(one).cast("string"), F.lit(":"), one)
            return as_text if numeric is None else F.when(numeric & one.rlike(_NUMERIC), F.concat(F.lit("#"), plain_number(one))).otherwise(as_text)

        return let(said, shown)

    said = value.cast("string")
    read = said if bare is None else F.when(bare, without_parentheses(said)).otherwise(said)
    return (
        F.when(kind == "STRING", let(plain_form(read, rules.text), text))
        .when(kind == "BOOLEAN", F.concat(F.lit("b"), said))
        .when(kind == "VOID", "z")
        .when(kind.startswith("OBJECT"), "o()")
        .when(kind.startswith("ARRAY"), "l()")
        .otherwise(let(said, number))
    )


def _entries(value: Column, kind: Column) -> Column:
    """(key, value) of what an object or a list holds; null for any other value."""
    items = lambda: F.transform(value.cast("array<variant>"), lambda x, k: F.struct(k.cast("string").alias("key"), x.alias("value")))
    return F.when(kind.startswith("OBJECT"), F.map_entries(value.cast("map<string,variant>"))).when(kind.startswith("ARRAY"), items())


def _plain_said(value: Column, keys: tuple[Column, ...], levels: int, rules: JsonRules) -> Column:
    """The canonical text of a value of so many levels whose texts are ASCII: what leaf() and _folded() make of its rows."""

    def one(kind: Column) -> Column:
        if not levels:
            return _plain_leaf(value, kind, keys, rules)

        def held(e: Column) -> Column:
            # the inner text stands here once, so that expressions grow with levels and do not double with each
            name = F.when(kind.startswith("OBJECT"), F.concat(F.length(e["key"]).cast("string"), F.lit(":"), e["key"], F.lit("="))).otherwise("")
            return F.concat(name, _plain_said(e["value"], (*keys, e["key"]), levels - 1, rules))

        def listed(items: Column) -> Column:
            out = items
            if (here := _here(keys, rules.unordered)) is not None:
                out = F.when(here, F.sort_array(items)).otherwise(out)
            if (here := _here(keys, rules.sets)) is not None:
                out = F.when(here, F.sort_array(F.array_distinct(items))).otherwise(out)
            return F.concat(F.lit("l("), F.array_join(out, ","), F.lit(")"))

        parts = F.transform(_entries(value, kind), held)
        whole = let(parts, lambda p: F.when(kind.startswith("ARRAY"), listed(p)).otherwise(F.concat(F.lit("o("), F.array_join(p, ","), F.lit(")"))))
        return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), whole).otherwise(_plain_leaf(value, kind, keys, rules))

    return let(F.schema_of_variant(value), one)


def _plain_side(value: Column, levels: int, rules: JsonRules) -> Column:
    """(root, whole, fields) of a value whose texts are ASCII: an object has fields, any other value a whole."""

    def one(value: Column, kind: Column) -> Column:
        field = lambda e: F.struct(e["key"].alias("name"), _plain_said(e["value"], (e["key"],), max(levels - 1, 0), rules).alias("said"))
        is_object = kind.startswith("OBJECT")
        fields = F.map_from_entries(F.transform(F.map_entries(value.cast("map<string,variant>")), field))
        return F.struct(
            F.coalesce(F.substring(kind, 1, 6), F.lit("none")).alias("root"),
            F.when(kind.isNotNull() & ~is_object, _plain_said(value, (), levels, rules)).alias("whole"),
            F.coalesce(F.when(is_object, fields), F.create_map().cast("map<string,string>")).alias("fields"),
        )

    return let(value, lambda v: let(F.schema_of_variant(v), lambda kind: one(v, kind)))


def _verdict(e: Column, g: Column) -> Column:
    """The five columns of a pair of sides (root, whole, fields)."""
    names = F.map_keys
    is_object, objects = e["root"] == "OBJECT", (e["root"] == "OBJECT") & (g["root"] == "OBJECT")
    missing = F.sort_array(F.array_except(names(e["fields"]), names(g["fields"])))
    extra = F.sort_array(F.array_except(names(g["fields"]), names(e["fields"])))
    wrong = F.sort_array(F.filter(F.array_intersect(names(e["fields"]), names(g["fields"])), lambda k: F.element_at(e["fields"], k) != F.element_at(g["fields"], k)))

    def shown(x: Column) -> Column:
        match = F.when(objects, (F.size(x["missing"]) == 0) & (F.size(x["extra"]) == 0) & (F.size(x["wrong"]) == 0)).otherwise(F.coalesce((g["root"] != "none") & (e["whole"] == g["whole"]), F.lit(False)))
        none = F.array().cast("array<string>")
        return F.struct(
            (g["root"] != "none").alias("output_is_json"), match.alias("json_canonical_match"),
            F.when(is_object, x["missing"]).alias("json_missing_fields"), F.when(objects, x["extra"]).alias("json_extra_fields"),
            F.when(is_object, F.when(objects, x["wrong"]).otherwise(none)).alias("json_mismatched_fields"),
        )

    return let(F.struct(missing.alias("missing"), extra.alias("extra"), wrong.alias("wrong")), shown)


def _wanted(text: Column) -> Column:
    """The value of an expected answer, which must be JSON."""
    return F.coalesce(strict_json(text), F.try_parse_json(F.raise_error(F.concat(F.lit("expected output is not JSON: "), F.substring(text, 1, 100))).cast("string")))


def _most_levels(found: int | None) -> int:
    levels = found or 0
    if levels > MOST_LEVELS:
        raise ValueError(f"JSON of {levels} levels; {MOST_LEVELS} are the most")
    return levels


def rescored(outputs: DataFrame, expected: str = "expected_output", output: str = "model_output", rules: JsonRules = JsonRules()) -> DataFrame:
    """outputs with output_is_json, json_canonical_match, json_missing_fields, json_extra_fields and json_mismatched_fields of the second scorer.

    A null output is no JSON; an expected output that is none fails the query. Fields are null where functions.jsonscore leaves them null: all of
    them if the expected value is no object, extra ones if the output is none. Rows whose texts are ASCII, of up to PLACE_LEVELS levels, are scored where they lie, without a shuffle;
    the others as rows of values."""
    e, g = F.coalesce(F.col(expected), F.lit("")), F.coalesce(F.col(output), F.lit(""))
    both = F.concat(e, g)
    # a text may name other letters by escapes
    other = (F.octet_length(both) != F.length(both)) | both.contains("\\u")

    def levels_of(text: Column) -> Column:
        # few opening brackets bound the levels as well, and need no parser
        opened = F.length(text) - F.length(F.translate(text, "[{", ""))
        bare = unfenced(text)
        return F.when(opened <= FEW_LEVELS, opened).when(strict_json(bare).isNotNull(), depth(bare)).otherwise(0)

    deepest = F.greatest(levels_of(e), levels_of(g))
    odd = other | (deepest > PLACE_LEVELS)
    seen = outputs.agg(F.max(F.when(~odd, deepest)).alias("levels"), F.coalesce(F.max(odd), F.lit(False)).alias("odd")).first()
    levels = seen["levels"] or 0
    sides = F.struct(_plain_side(_wanted(unfenced(e)), levels, rules).alias("e"), _plain_side(strict_json(unfenced(g)), levels, rules).alias("g"))
    names = ("output_is_json", "json_canonical_match", "json_missing_fields", "json_extra_fields", "json_mismatched_fields")
    here = outputs.where(~odd) if seen["odd"] else outputs
    plain = here.withColumn("__score", let(sides, lambda s: _verdict(s["e"], s["g"])))
    plain = plain.withColumns({n: F.col(f"__score.{n}") for n in names}).drop("__score")
    return plain.unionByName(_rescored_by_rows(outputs.where(odd), e, g, rules)) if seen["odd"] else plain


def _rescored_by_rows(outputs: DataFrame, e: Column, g: Column, rules: JsonRules) -> DataFrame:
    """rescored() of texts in any script: values become rows, so that their normal forms can be made in Arrow batches."""
    key = F.sha2(F.concat(F.length(e).cast("string"), F.lit(":"), e, g), 256)
    keyed = outputs.withColumn("__pair", key)
    pairs = keyed.groupBy(F.col("__pair").alias("key")).agg(F.first(unfenced(e)).alias("e"), F.first(unfenced(g)).alias("g"))
    found = pairs.select(F.max(F.greatest(*[F.coalesce(F.when(strict_json(F.col(c)).isNotNull(), depth(F.col(c))), F.lit(0)) for c in ("e", "g")]))).first()[0]
    levels = _most_levels(found)
    wanted = _wanted(F.col("e"))
    sides = pairs.select("key", F.explode(F.array(F.struct(F.lit(0).alias("side"), wanted.alias("v")), F.struct(F.lit(1).alias("side"), strict_json(F.col("g")).alias("v")))).alias("x")).select("key", "x.side", "x.v")
    root = F.substring(F.schema_of_variant("v"), 1, 6)
    rows = _exploded(sides.select("key", "side", F.when(F.col("v").isNull(), "none").otherwise(root).alias("root"), "v"), levels)
    rows = rows.withColumn("said", leaf(F.col("v"), F.col("path"), rules)).drop("v")
    for level in range(levels, 0, -1):
        rows = _folded(rows, level, rules)
    field = F.when(F.size("path") == 1, F.struct(F.get("path", F.lit(0)).alias("name"), "said"))
    of = lambda side: F.map_from_entries(F.collect_list(F.when(F.col("side") == side, field)))
    one = lambda side, c: F.max(F.when(F.col("side") == side, c))
    whole = F.when(F.size("path") == 0, F.col("said"))
    scored = rows.groupBy("key").agg(of(0).alias("e"), of(1).alias("g"), one(0, F.col("root")).alias("e_root"), one(1, F.col("root")).alias("g_root"), one(0, whole).alias("e_said"), one(1, whole).alias("g_said"))
    both = F.array_intersect(F.map_keys("e"), F.map_keys("g"))
    objects = (F.col("e_root") == "OBJECT") & (F.col("g_root") == "OBJECT")
    is_object = F.col("e_root") == "OBJECT"
    missing = F.array_sort(F.array_except(F.map_keys("e"), F.map_keys("g")))
    extra = F.array_sort(F.array_except(F.map_keys("g"), F.map_keys("e")))
    wrong = F.array_sort(F.filter(both, lambda k: F.element_at("e", k) != F.element_at("g", k)))
    match = F.when(objects, (F.size(missing) == 0) & (F.size(extra) == 0) & (F.size(wrong) == 0)).otherwise(F.coalesce((F.col("g_root") != "none") & (F.col("e_said") == F.col("g_said")), F.lit(False)))
    result = scored.select(
        F.col("key").alias("__pair"), (F.col("g_root") != "none").alias("output_is_json"), match.alias("json_canonical_match"),
        F.when(is_object, F.when(objects, missing).otherwise(F.array_sort(F.map_keys("e")))).alias("json_missing_fields"), F.when(objects, extra).alias("json_extra_fields"),
        F.when(is_object, F.when(objects, wrong).otherwise(F.array().cast("array<string>"))).alias("json_mismatched_fields"),
    )
    return keyed.join(result.hint("merge"), "__pair").drop("__pair")  # as many rows as outputs, which small estimates would send through the driver


def fingerprint(rules: JsonRules = JsonRules(), expected: str = "expected_output", output: str = "model_output", route: str = "evaluation_type") -> Column:
    """What a deterministic score depends on, as one hash: route, expected answer, output and rules."""
    part = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    said = [F.coalesce(F.lower(F.trim(F.col(route))), F.lit("")), F.coalesce(F.col(expected), F.lit("")), F.coalesce(F.col(output), F.lit(""))]
    return F.sha2(F.concat(*[part(c) for c in said], F.lit(repr(rules))), 256)


def changed(outputs: DataFrame, saved: DataFrame | None, rules: JsonRules = JsonRules()) -> DataFrame:
    """Distinct contents (fingerprint, evaluation_type, expected_output, model_output) of outputs that `saved` has no score of."""
    each = outputs.withColumn("fingerprint", fingerprint(rules)).groupBy("fingerprint").agg(*[F.first(c).alias(c) for c in ("evaluation_type", "expected_output", "model_output")])
    return each if saved is None else each.join(saved.select("fingerprint").hint("merge"), "fingerprint", "left_anti")


def rescore_saved(outputs: DataFrame, model: str, saved: DataFrame | None = None, rules: JsonRules = JsonRules()) -> DataFrame:
    """Saved outputs of one model with their scores, fingerprint, and `reused`: whether the score is one of `saved` (saved_scores of an earlier run).

    Only contents without a score are scored, each once, however many cases share it; a change of rules changes all fingerprints. Outputs of no or another model,
    and rows that a judge has to score, are a ValueError, as there is nobody to ask."""
    route = F.lower(F.trim("evaluation_type"))
    other = ~F.col("model_name").eqNullSafe(F.lit(model))
    found = outputs.agg(F.count("*").alias("n"), F.count_if(other).alias("other"), F.min(F.when(other, F.coalesce("model_name", F.lit("null")))).alias("name"), F.count_if(route == "judge").alias("judged")).first()
    if not found["n"] or found["other"]:
        raise ValueError(f"outputs of {model} alone are wanted; {found['other']} of {found['n']} rows are another's, such as {found['name']}")
    if found["judged"]:
        raise ValueError(f"{found['judged']} rows need a judge")
    fresh = score_outputs(changed(outputs, saved, rules), rules).withColumn("reused", F.lit(False))
    names = [c for c in fresh.columns if c not in ("evaluation_type", "expected_output", "model_output")]
    known = fresh.select(*names)
    if saved is not None:
        known = known.unionByName(saved.withColumn("reused", F.lit(True)).select(*names))
    return outputs.withColumn("fingerprint", fingerprint(rules)).join(known.hint("merge"), "fingerprint")


def saved_scores(scored: DataFrame) -> DataFrame:
    """What a later rescore_saved needs of this one: a row for each content."""
    names = [c for c in scored.columns if c.startswith(("json_", "metric_", "exact_", "normalized_", "expected_is", "output_is"))]
    return scored.groupBy("fingerprint").agg(*[F.first(c).alias(c) for c in names])
