import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.functions.jsonscore import Comparer, JsonRules, Shape, json_error, number_of, read_json, score_outputs
from tallyloom.operators import summary

TEXTS = ["", None, "  A\t b ", "Straße™ é", "x_y, 5%!", "ÉCOLE  2", "a\x1cb", "İx", "ﬁn"]


@pytest.mark.parametrize("rules", [text.TextRules(), text.TextRules(case_sensitive=True, trim=False), text.TextRules(collapse=False), text.TextRules(form="NFKC", strip_marks=True, strip_punctuation=True)])
def test_column_form_equals_function(spark, rules):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", text.normalized(F.col("t"), rules).alias("n")).collect():
        assert r["n"] == text.normal_text(r["t"], rules)


def test_text_helpers(spark):
    row = spark.range(1).select(
        text.without_parentheses(F.lit("12 (abc) mg")).alias("p"), text.zero_padded(F.lit("12345"), 3).alias("z"), text.zero_padded(F.lit("7"), 3).alias("y"), text.aliased(F.lit("mg"), {"MG": "Milligram"}).alias("a"),
        text.outcome_flag(F.lit(" TRUE")).alias("t"), text.outcome_flag(F.lit("yes")).alias("u"), text.answer_flag(F.lit("yes")).alias("v"), text.grade_flag(F.lit("C")).alias("w"), text.number(F.lit("1.5x")).alias("n"),
    ).first()
    assert tuple(row) == ("12 mg", "12345", "007", "milligram", True, None, True, True, None)


@pytest.mark.parametrize(("a", "b"), [("1", 1), ("1.0", 1), ("1e2", 100), ("-0.50", -0.5), ("0.0", 0)])
def test_equal_numbers(a, b):
    assert number_of(a) == number_of(b) is not None


@pytest.mark.parametrize("value", [True, "1,000", "abc", "", None, "NaN"])
def test_not_numbers(value):
    assert number_of(value) is None


def test_fences():
    assert read_json('```json\n{"a": 1}\n```') == (True, {"a": 1})
    assert read_json("nope") == (False, None)


def test_rules():
    rules = JsonRules(unordered=("/u",), sets=("/s",), numeric=("/n/*",), parenthetical=("/p",), zero_pad=(("/z", 4),), aliases=(("/a", (("tab", "tablet"),)),))
    c = Comparer(rules)
    a = {"u": ["b", "a", "a"], "s": ["x", "X"], "n": ["1.0", 2], "p": "mg (daily)", "z": "7", "a": "TAB"}
    b = {"u": ["a", "b", "a"], "s": ["x"], "n": [1, "2.00"], "p": "mg", "z": "0007", "a": "tablet"}
    assert c.score(json.dumps(a), json.dumps(b))["json_canonical_match"]
    assert not c.score('{"u": ["a", "a"]}', '{"u": ["a"]}')["json_canonical_match"]
    assert not c.score("true", "1")["json_exact_match"] and c.score("1", "1.0")["json_exact_match"]


def test_error_classes(spark):
    shape = Shape(frozenset({"name"}), frozenset({"forms", "codes"}), frozenset({"forms"}))
    want = {"name": "Ab", "forms": ["tablet, coated", "gel"], "codes": ["1", "2"]}
    say = lambda **other: Comparer(JsonRules()).error_class(json.dumps(want), json.dumps(want | other), shape)
    assert say() == "pass" == say(name=" AB ")
    assert say(name=["ab"]) == "schema_type_only" and say(codes=["1", "2", "1"]) == "duplicate_items_only"
    one = want | {"forms": ["tablet, coated"]}
    other = lambda **given: Comparer(JsonRules()).error_class(json.dumps(one), json.dumps(one | given), shape)
    assert other(forms=["tablet", "coated"]) == "compound_label_split_only" and other(forms="tablet, coated") == "schema_type_only"
    assert other(name=["Ab"], codes=["1", "1", "2"]) == "schema_and_duplicates" and other(name=["Ab"], forms=["tablet", "coated"]) == "schema_and_label_split"
    assert other(name=["Ab"], forms=["tablet", "coated"], codes=["1", "1", "2"]) == "multiple_repairable"
    assert other(name=["Ab", "Cd"]) == "text_or_value_error" and other(codes=["2", "1"]) == "text_or_value_error" and other(more=1) == "missing_or_extra_fields"
    c = Comparer(JsonRules())
    assert c.error_class(json.dumps(one), "{", shape) == c.error_class(json.dumps(one), "[1]", shape) == "invalid_json"
    with pytest.raises(ValueError, match="not one JSON object"):
        c.error_class("[1]", "{}", shape)
    df = spark.createDataFrame([("{}", None, "success"), ("{}", "{}", "error"), ("{}", "{}", None)], "e string, o string, s string")
    got = df.select(json_error(F.col("e"), F.col("o"), shape, status=F.col("s")).alias("x")).collect()
    assert [r["x"] for r in got] == ["invalid_json", "generation_error", "pass"]


def rows(spark):
    return spark.createDataFrame(
        [
            ("1", "m", "exact", "Yes", " yes "), ("2", "m", "JSON", '{"a": 1, "b": 2}', '{"a": 1, "c": 3}'), ("3", "m", "json", '{"a": 1}', None), ("4", "m", "judge", "x", "y"), ("5", "k", "judge", "x", "y"),
        ], "case_id string, model_name string, evaluation_type string, expected_output string, model_output string",
    )


def test_score_outputs(spark):
    got = {r["case_id"]: r for r in score_outputs(rows(spark)).collect()}
    assert got["1"]["metric_passed"] and not got["1"]["exact_match"]
    two = got["2"]
    assert (two["json_missing_fields"], two["json_extra_fields"], two["json_mismatched_fields"], two["json_field_match_rate"]) == (["b"], ["c"], [], 0.5)
    assert got["3"]["output_is_json"] is False and got["3"]["json_field_match_rate"] == 0.0
    assert got["4"]["metric_status"] == "skipped" and got["4"]["metric_passed"] is None


def test_scores_fail_on_bad_input(spark):
    bad = rows(spark).where("case_id = '2'").withColumn("expected_output", F.lit("{"))
    with pytest.raises(Exception, match="not JSON"):
        score_outputs(bad).collect()
    with pytest.raises(Exception, match="unknown evaluation_type"):
        score_outputs(rows(spark).withColumn("evaluation_type", F.lit("other"))).collect()


def test_metrics_summary_ranks_only_models_with_scores(spark):
    got = {r["model_name"]: r for r in summary.metrics_summary(score_outputs(rows(spark))).collect()}
    assert got["m"]["rank"] == 1 and got["k"]["rank"] is None and got["k"]["metric_pass_rate"] is None
    assert got["m"]["metric_pass_rate"] == pytest.approx(1 / 3)


def test_final_results(spark):
    scored = score_outputs(rows(spark)).withColumn("generation_status", F.when(F.col("case_id") == "1", "error"))
    judged = spark.createDataFrame([("4", "m", "success", 0.75, True), ("5", "k", "error", None, None)], "case_id string, model_name string, judge_status string, judge_score double, judge_passed boolean")
    got = {r["case_id"]: (r["final_score"], r["final_passed"], r["evaluation_source"]) for r in summary.final_results(scored, judged).collect()}
    assert got == {"1": (0.0, False, "generation_error"), "2": (0.5, False, "deterministic"), "3": (0.0, False, "deterministic"), "4": (0.75, True, "llm_judge"), "5": (None, None, "judge_error")}
    with pytest.raises(Exception, match="no judge result for case 5 of model k"):
        summary.final_results(scored, judged.where("case_id = '4'")).collect()
    with pytest.raises(Exception, match="no judge result"):
        summary.final_results(scored).collect()
    assert summary.final_results(scored.where("metric_applicable")).count() == 3
