"""The second scorer against the first, on random JSON."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import jsonscore
from tallyloom.operators import rescore
from tallyloom.plans import registry

RULES = jsonscore.JsonRules(unordered=("/u", "/deep/*/u"), sets=("/s",), numeric=("/n/*", "/m"), parenthetical=("/p",), zero_pad=(("/z", 4),), aliases=(("/a", (("tab", "tablet"),)),))
NAMES = ["output_is_json", "json_canonical_match", "json_missing_fields", "json_extra_fields", "json_mismatched_fields"]


def value(rng, deep=0):
    kind = rng.randrange(9 if deep < 3 else 6)
    if kind == 6:
        return [value(rng, deep + 1) for _ in range(rng.randrange(4))]
    if kind == 7:
        return {rng.choice("abuxyz"): value(rng, deep + 1) for _ in range(rng.randrange(3))}
    return [None, True, rng.choice([0, 1, -3, 12]), rng.choice([1.0, 0.5, -2.25, 1e3]), rng.choice(["A", " a ", "Éa", "7", "tab", "x (y) z", "1.0"]), "", "", "", [1, "1"]][kind]


def damage(rng, doc):
    doc = dict(doc)
    for _ in range(rng.randrange(3)):
        k = rng.choice([*doc, "new"])
        if rng.random() < 0.4:
            doc.pop(k, None)
        else:
            doc[k] = value(rng)
    for k in ("u", "s"):
        if isinstance(doc.get(k), list):
            rng.shuffle(doc[k])
    return doc


def pairs():
    rng = random.Random(4)
    out = []
    for _ in range(250):
        doc = {k: value(rng) for k in rng.sample(["u", "s", "n", "m", "p", "z", "a", "deep", "q"], 4)}
        doc |= {"u": [value(rng, 2) for _ in range(3)], "s": ["b", "B", "a"], "n": [1, "1.0", "x"]}
        out.append((json.dumps(doc), json.dumps(damage(rng, doc))))
    fixed = [("1", "1.0"), ("true", "1"), ("[1, 2]", "[2, 1]"), ("{}", "{}"), ("{}", "[]"), ("[]", "[]"), ('{"a": 1}', "7"), ('{"a": 1}', None), ('{"a": 1}', "nope"), ("null", "null"), ("null", "nul"), ('"x"', '" X"'), ('{"a": {}}', '{"a": []}'), ('{"a": [[], {}]}', '```json\n{"a": [[], {}]}\n```'), ('{"s": ["x"]}', '{"s": ["x", "X "]}'), ('{"z": "7", "p": "a (b)"}', '{"z": "0007", "p": "a"}'), ('{"m": "1e2"}', '{"m": 100.0}'), ('{"a": 1}', '{"a": 1} x'), ('{"a": 1}', '{"a": 1}, {"a": 1}'), ("1", "1] , [1"), ("1", '1} , {"v": 1'), ("1", ""), ('{"a": ["x,s1:y"]}', '{"a": ["x", "y"]}')]
    return out + fixed + fixed[:3]


def test_rescorer_equals_scorer(spark):
    rows = spark.createDataFrame([(k, e, g, "json") for k, (e, g) in enumerate(pairs())], "case_id int, expected_output string, model_output string, evaluation_type string")
    first = {r["case_id"]: tuple(r[n] for n in NAMES) for r in jsonscore.score_outputs(rows, RULES).collect()}
    again = {r["case_id"]: tuple(r[n] for n in NAMES) for r in rescore.rescored(rows, rules=RULES).collect()}
    assert again == first
    assert {m for _, m, *_ in first.values()} == {True, False}


def test_odd_rescores(spark):
    rows = spark.createDataFrame([("{", "{}")], "expected_output string, model_output string")
    with pytest.raises(Exception, match="not JSON"):
        rescore.rescored(rows).collect()
    assert rescore.rescored(rows.where("false")).collect() == []
    deep = spark.createDataFrame([("[" * 70 + "]" * 70, "1")], rows.schema)
    with pytest.raises(ValueError, match="70 levels"):
        rescore.rescored(deep)
    many = spark.range(1000).select("id", F.lit('{"a": 1}').alias("expected_output"), F.lit('{"a": 2}').alias("model_output"))
    assert rescore.rescored(many).where("json_mismatched_fields = array('a')").count() == 1000


def test_sides_that_grow_are_not_broadcast(spark):
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(1, '{"a": 1}', '{"a": 2}', "json", "m")], "case_id int, expected_output string, model_output string, evaluation_type string, model_name string")
    assert "Broadcast" not in shown(rescore.rescored(rows))
    saved = rescore.saved_scores(rescore.rescore_saved(rows, "m"))
    assert "Broadcast" not in shown(rescore.rescore_saved(rows, "m", saved))
    for name in ("rescored", "scorers_agree", "rescore_delta"):
        assert "Broadcast" not in shown(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_answers_are_made_once(spark):
    """Scorers read the answers of orders back: no plan holds the tables that they are made of."""
    for name in ("rescored", "scorers_agree", "rescore_delta"):
        files = registry.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert files and not [f for f in files if "lineitem" in f or "orders.parquet" in f]


def test_ascii_rows_are_scored_where_they_lie(spark):
    """Neither values nor pairs of ASCII texts go through a shuffle or Python; other rows beside them do, and none is lost."""
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(1, '{"u": ["B ", "a"], "q": [[1, {"x": 10.0}]]}', '{"q": [[1.0, {"x": 10}]], "u": ["a", "b"]}'), (2, '{"u": 100}', '{"u": "100"}')], "case_id int, expected_output string, model_output string")
    plain = rescore.rescored(rows, rules=RULES)
    assert "Exchange" not in shown(plain) and "Python" not in shown(plain)
    assert [r["json_canonical_match"] for r in plain.orderBy("case_id").collect()] == [True, False]
    mixed = rescore.rescored(rows.union(spark.createDataFrame([(3, '{"a": "É"}', '{"a": "\\u00e9"}'), (4, '{"a": "É"}', None)], rows.schema)), rules=RULES)
    assert {r["case_id"]: r["json_canonical_match"] for r in mixed.collect()} == {1: True, 2: False, 3: True, 4: False}


def test_values_of_objects_are_compared_twice_at_most(monkeypatch):
    """Once as they are and once in canonical form: fields decide on the whole."""
    seen, real = [], jsonscore.frozen
    monkeypatch.setattr(jsonscore, "frozen", lambda value: (seen.append(value), real(value))[1])
    found = jsonscore.Comparer(RULES).score('{"u": [11, 12]}', '{"u": [12, 11]}')
    assert (found["json_exact_match"], found["json_canonical_match"], found["json_mismatched_fields"]) == (False, True, [])
    assert seen.count(11) == seen.count(12) == 4  # two sides
    nan = jsonscore.Comparer(RULES).score('{"a": NaN}', '{"a": NaN}')
    assert (nan["json_canonical_match"], nan["json_mismatched_fields"]) == (False, ["a"])


def test_deep_rows_beside_shallow_ones(spark):
    deep = "[" * (rescore.PLACE_LEVELS + 2) + "1" + "]" * (rescore.PLACE_LEVELS + 2)
    rows = spark.createDataFrame([(1, deep, deep), (2, "[1]", "[1.0]"), (3, "[1]", deep)], "case_id int, expected_output string, model_output string")
    assert {r["case_id"]: r["json_canonical_match"] for r in rescore.rescored(rows).collect()} == {1: True, 2: True, 3: False}
