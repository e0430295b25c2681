"""Census comparison, judge validation, eligibility and tables of results on small rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.functions.jsonscore import Shape
from tallyloom.operators import board, census, family, judging, validate

SHAPE = Shape(frozenset({"s"}), frozenset({"l"}), frozenset())
RIGHT = '{"s": "v", "l": ["a"]}'
KIND = "case_id string, product_id string, language string, stratum string, input string, expected_output string, source_metadata string, model_name string, model_output string, generation_status string, generation_seconds double, generation_cost_usd double, final_score double, final_passed boolean"


def census_rows(products=40):
    out = []
    for p in range(products):
        for j, language in enumerate(("en", "fr")):
            for i, m in enumerate(("a", "b", "c")):
                x = (7 * p + 3 * j + 5 * i * p) % 6
                said = {0: '{"s": ["v"], "l": ["a"]}', 1: None}.get(x, RIGHT)
                out.append((f"c{p}-{language}", f"p{p}", language, census.STRATA[p % 4], "in", RIGHT, "{}", m, said, "error" if x == 1 else "success", float(x), x / 10, x / 5, x > 1))
    return out


def test_result_contract(spark):
    rows = census_rows(4)
    assert census.result_violations(spark.createDataFrame(rows, KIND), ["a"]).count() == 0
    bad = [r for r in rows if r[:1] + r[7:8] != ("c0-en", "b") and r[0] != "c1-fr"]
    bad[-1] = (*bad[-1][:4], "other", *bad[-1][5:])
    found = {(r["rule"], r["key"]) for r in census.result_violations(spark.createDataFrame([*bad, bad[0]], KIND), ["a", "z"]).collect()}
    assert found == {("duplicate key", "c0-en|a"), ("missing models", "c0-en"), ("conflicting definition", "c3-fr|input"), ("language pair", "p1"), ("missing model", "z")}


def test_overview_and_records(spark):
    rows = census_rows()
    df = census.diagnosed(spark.createDataFrame(rows, KIND).repartition(3), SHAPE)
    for r in census.model_overview(df).collect():
        mine = [x for x in rows if x[7] == r["model_name"]]
        ok = {x[0]: x[13] for x in mine}
        both = sum(ok[f"c{p}-en"] and ok[f"c{p}-fr"] for p in range(40))
        fixed = sum(x[8] is not None and x[8] != RIGHT for x in mine)
        assert (r["cases"], r["passed_cases"], r["both_languages_passed_products"], r["schema_type_only_failures"]) == (80, sum(ok.values()), both, fixed)
        assert r["structural_repair_sensitivity_passes"] == sum(ok.values()) + fixed and r["generation_failures"] == sum(x[9] == "error" for x in mine)
        assert r["total_cost_usd"] == pytest.approx(sum(x[11] for x in mine)) and r["cost_per_1000_cases_usd"] == pytest.approx(sum(x[11] for x in mine) / 80 * 1000)
    fields = {(r["model_name"], r["language"], r["field_name"]): r["matching_cases"] for r in census.field_accuracy_by_language(df, ["s", "l"]).collect()}
    assert len(fields) == 27 and all(fields[m, "all", f] == fields[m, "en", f] + fields[m, "fr", f] for m in "abc" for f in ("s", "l", "__schema_contract__"))
    assert fields["a", "all", "l"] == sum(x[7] == "a" and x[8] is not None for x in rows) == fields["a", "all", "__schema_contract__"]
    frontier = {r["case_id"]: r for r in census.frontier_cases(df, ["a", "b", "c"], "a", "b").collect()}
    ok = {(x[0], x[7]): x[13] for x in rows}
    assert set(frontier) == {x[0] for x in rows if not (ok[x[0], "a"] and ok[x[0], "b"])}
    for c, r in frontier.items():
        assert r["pair_outcome"] == ("both_failed" if not ok[c, "a"] and not ok[c, "b"] else "a_only_passed" if ok[c, "a"] else "b_only_passed") and r["a_passed"] == ok[c, "a"]


def brute_sample(cases, count, seed, purpose):
    rank = lambda what, c: hashlib.sha256(f"{seed}|{what}|{c}".encode()).hexdigest()
    chosen, used, n = [], set(), 0
    for s in census.STRATA:
        for language in ("en", "fr"):
            quota, n = count // 8 + (n < count % 8), n + 1
            for c, p, *_ in sorted((x for x in cases if x[2:] == (s, language)), key=lambda x: rank(purpose, x[0])):
                if quota and p not in used:
                    chosen.append(c)
                    used.add(p)
                    quota -= 1
    left = sorted((x for x in cases if x[0] not in chosen and x[1] not in used), key=lambda x: rank(f"{purpose}:fill", x[0]))
    return chosen + [x[0] for x in left[: count - len(chosen)]]


def test_review_against_brute_force(spark):
    rows = census_rows()
    df = census.diagnosed(spark.createDataFrame(rows, KIND).repartition(3), SHAPE)
    cases = sorted({(x[0], x[1], x[3], x[2]) for x in rows})
    for count in (1, 5, 8, 13, 17):
        assert census.stratified_cases(spark.createDataFrame(cases, "case_id string, product_id string, stratum string, language string"), count, 3, "why") == brute_sample(cases, count, 3, "why")
    few = [x for x in cases if x[2] == census.STRATA[0]]
    assert census.stratified_cases(spark.createDataFrame(few, "case_id string, product_id string, stratum string, language string"), 9, 3, "why") == brute_sample(few, 9, 3, "why")
    with pytest.raises(ValueError, match="of 99 cases"):
        census.stratified_cases(spark.createDataFrame(few, "case_id string, product_id string, stratum string, language string"), 99, 3, "why")
    ok = {(x[0], x[7]): x[13] for x in rows}
    groups = [sorted(c for c, *_ in cases if not ok[c, "a"]), sorted(c for c, *_ in cases if ok[c, "a"] and not ok[c, "b"])]
    apart = [x for x in cases if ok[x[0], "a"] and ok[x[0], "b"]]
    low = brute_sample([x for x in apart if not ok[x[0], "c"]], 3, 11, "lower_tier_shared_failure")
    fine = brute_sample([x for x in apart if ok[x[0], "c"] and x[0] not in low], 6, 11, "all_model_pass")
    got = census.review_cases(df, ["a", "b", "c"], "a", "b", ["c"], 3, 6, 11).orderBy("audit_case_id").collect()
    assert [r["case_id"] for r in got] == [*groups[0], *groups[1], *low, *fine] and got[0]["audit_case_id"] == "audit-0001"
    assert [r["selection_group"] for r in got] == [g for g, n in zip(census.GROUPS, (len(groups[0]), len(groups[1]), 3, 6), strict=True) for _ in range(n)]
    assert all(r["diagnostic_focus"] == census.NO_FOCUS for r in got if r["selection_priority"] == 4)


def test_audit_focus(spark):
    df = spark.createDataFrame([(["invalid_json", "schema_type_only"],), ([],), (["schema_and_duplicates", "text_or_value_error"],)], "e array<string>")
    assert [r["f"] for r in df.select(census.audit_focus(F.col("e")).alias("f")).collect()] == [census.FOCUS[1][1], census.NO_FOCUS, census.FOCUS[2][1]]


PLAN = judging.Protocol(("pass", "fail"), ("quality", "tone"), {"judge_variant_id": "j1", "trial_id": "t1", "prompt_variant_id": "p1", "identity_condition": "blinded", "presentation_order": "pointwise"}, thresholds={"failure_recall": 0.5, "prompt_flip_rate": 0.6, "independent_human_raters": 1.0}, checks={"protocol_frozen": True})
CASES = [("1", "validation", "en"), ("2", "validation", "fr"), ("3", "validation", None), ("4", "calibration", "en")]
HUMANS = [(c, "quality", r, "independent", x) for c, a, b in (("1", "pass", "pass"), ("2", "fail", "pass"), ("3", "fail", "fail")) for r, x in (("r1", a), ("r2", b))] + [(c, "quality", "lead", "adjudicated", x) for c, x in (("1", "pass"), ("2", "fail"), ("3", "fail"))]
OBSERVED = [(c, "quality", "j1", t, p, "blinded", "pointwise", x, s, u) for c, t, p, x, s, u in (
    ("1", "t1", "p1", "pass", "success", "0.2"), ("2", "t1", "p1", "fail", "success", None), ("3", "t1", "p1", None, "error", None), ("1", "t2", "p1", "pass", "success", None),
    ("2", "t2", "p1", "pass", "success", None), ("1", "t1", "p2", "fail", "success", None), ("2", "t1", "p2", "fail", "success", None),
)]


def judged(spark, observed=OBSERVED, humans=HUMANS):
    return (
        spark.createDataFrame(CASES, "case_id string, split string, lang string"),
        spark.createDataFrame(humans, "case_id string, criterion string, reviewer_id string, annotation_stage string, label string"),
        spark.createDataFrame(observed, "case_id string, criterion string, judge_variant_id string, trial_id string, prompt_variant_id string, identity_condition string, presentation_order string, label string, status string, uncertainty string"),
    )


def test_judge_validation(spark):
    cases, humans, observed = judged(spark)
    assert judging.input_violations(cases, humans, observed, PLAN).count() == 0
    frame = judging.labelled(cases, humans, observed, PLAN)
    got = {r["case_id"]: (r["reference_label"], r["judge_label"], r["status"]) for r in frame.collect()}
    assert got == {"1": ("pass", "pass", "success"), "2": ("fail", "fail", "success"), "3": ("fail", None, "error"), "4": (None, None, None)}
    held = frame.where("split = 'validation'")
    m = judging.judge_metrics(held, PLAN).first()
    assert (m["cases"], m["comparable_cases"], m["judge_errors"], m["true_failure"], m["false_approval"]) == (3, 2, 1, 1, 0)
    assert m["observation_failure_rate"] == pytest.approx(1 / 3) and m["cohen_kappa"] == 1.0 and m["failure_recall"] == 1.0 and m["average_reported_uncertainty"] == 0.2
    slices = {r["slice_value"]: r["cases"] for r in judging.slice_metrics(held, PLAN, ["lang"]).collect()}
    assert slices == {"en": 1, "fr": 1, None: 1}
    by_trial = {(r["case_id"], r["trial_id"]): r["judge_label"] for r in judging.labelled(cases, humans, observed, PLAN, ("trial_id",)).collect()}
    assert len(by_trial) == 8 and by_trial["2", "t2"] == "pass" and by_trial["4", "t1"] is None
    h = judging.human_review(cases, humans, PLAN, "validation").first()
    assert (h["cases"], h["minimum_independent_raters"], h["human_disagreement_cases"], h["adjudication_coverage"]) == (3, 2, 1, 1.0) and h["raw_pairwise_agreement"] == pytest.approx(2 / 3)
    t = judging.condition_review(judging.baseline_observations(observed, PLAN, ("trial_id",)), "trial_id", cases.where("split = 'validation'")).first()
    assert (t["observed_value_count"], t["expected_cases"], t["cases_with_all_conditions"], t["flip_rate"]) == (2, 3, 2, 0.5)


def test_judge_gates(spark):
    gates = {r["gate"]: (r["observed"], r["threshold"], r["passed"]) for r in judging.gate_table(*judged(spark), PLAN).collect()}
    assert gates["failure_recall"] == (1.0, 0.5, True) and gates["prompt_flip_rate"] == (0.5, 0.6, True) and gates["failure_precision"] == (1.0, None, False)
    assert gates["independent_human_raters"] == (2.0, 2.0, True) and gates["independent_trial_count"] == (2.0, 3.0, False)
    assert gates["protocol_frozen"][2] and gates["not_synthetic_fixture"][2] and not gates["independent_review"][2] and not gates["required_subgroups_declared"][2]
    assert gates["identity_condition_count"] == (1.0, 2.0, False) and "position_bias" not in gates
    wrong = [*OBSERVED, OBSERVED[0], ("9", "size", "j1", "t1", "p1", "open", "AB", "maybe", "success", "3")]
    found = {r["rule"] for r in judging.input_violations(*judged(spark, wrong, [*HUMANS, ("1", "quality", "other", "adjudicated", "so")]), PLAN).collect()}
    assert found == {"unknown case_id", "unknown criterion", "unknown identity_condition", "unknown presentation_order", "unknown label", "duplicate key", "uncertainty"}


def test_pairwise_judges(spark):
    plan = judging.Protocol(("A", "B", "tie"), ("quality",), {"presentation_order": "AB", "identity_condition": "blinded"}, pass_label=None, mode="pairwise")
    rows = [("1", "AB", "blinded", "A", "success"), ("1", "BA", "blinded", "B", "success"), ("2", "AB", "blinded", "tie", "success"), ("2", "BA", "blinded", "A", "success"), ("1", "AB", "named", "B", "success"), ("2", "AB", "named", "B", "error")]
    df = spark.createDataFrame(rows, "case_id string, presentation_order string, identity_condition string, label string, status string")
    p = judging.position_review(df.where("identity_condition = 'blinded'"), plan).first()
    assert (p["decisive_observations"], p["first_position_selection_rate"]) == (3, pytest.approx(2 / 3)) and p["position_bias"] == pytest.approx(1 / 6)
    cases = spark.createDataFrame([("1", "B"), ("2", " ")], "case_id string, self_preference_label string")
    s = judging.own_preference(df, cases).first()
    assert (s["named_selection_rate"], s["blinded_selection_rate"], s["self_preference_shift"]) == (1.0, 0.5, 0.5)


def test_eligibility_takes_the_first_reason(spark):
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    drug = make([("1", "00000001", "a", "Human"), ("2", "1", "a", " human "), ("3", "00000003", "a", "vet"), ("4", "00000004", "a", "human"), ("5", "00000005", "a", "human"), ("6", "00000006", "a", "human")], "drug_code string, din string, brand_name string, class string")
    status = make([(k, "MARKETED", "f", True) for k in "12356"] + [("1", "dormant", "f", False), ("4", "marketed", "f", True), ("4", "marketed", "f", True)], "drug_code string, status string, status_f string, current boolean")
    company = make([(k, "9", "c", "DIN_OWNER") for k in "12346"] + [("5", "9", "c", "other")], "drug_code string, company_code string, company_name string, company_type string")
    child = make([(k, "v") for k in "12345"] + [("6", "v"), ("6", None)], "drug_code string, v string")
    ingred = child.where("drug_code <> '6'").withColumn("strength", F.lit("1.5")).unionByName(make([("6", "v", "1")], "drug_code string, v string, strength string"))
    got = family.eligibility(drug, status, company, {"ingred": ingred, "form": child, "route": child, "schedule": child}, dict.fromkeys(("ingred", "form", "route", "schedule"), ["v"]))
    assert {r["drug_code"]: r["reason"] for r in got.collect()} == {"1": None, "2": "invalid_din", "3": "not_human", "4": "missing_or_ambiguous_current_status", "5": "missing_or_ambiguous_din_owner", "6": "incomplete_form_rows"}


def test_board(spark):
    df = spark.createDataFrame([("a", 0.5, "ranked"), ("b", 0.9, "ineligible"), ("c", 0.5, "ranked"), ("d", 0.1, "descriptive"), ("e", 0.9, "ranked"), ("f", 0.9, None)], "k string, s double, status string")
    got = {r["k"]: (r["place"], r["rank"]) for r in board.leaderboard(df, "s", "k").collect()}
    assert got == {"e": (1, 1), "a": (2, 2), "c": (3, 2), "d": (4, None), "b": (5, None), "f": (6, None)}
    scores = spark.createDataFrame([("m", "x", 1.0), ("m", "x", 0.0), ("m", "y", 1.0), ("n", "x", 1.0)], "m string, c string, score double")
    one = {r["m"]: r for r in board.scorer_metrics(scores, ["m"]).collect()}
    assert one["m"]["accuracy"] == pytest.approx(2 / 3) and one["m"]["stderr"] == pytest.approx(1 / 3) and one["n"]["stderr"] is None
    r = {r["m"]: r for r in board.clustered_error(scores, ["m"], "c").collect()}["m"]
    assert r["clusters"] == 2 and r["stderr"] == pytest.approx((2 * (1 / 9 + 1 / 9)) ** 0.5 / 3)
    state = spark.createDataFrame([(0, 0, 1.0, 2.0), (1, 0, 1.0, 2.0), (0, None, 1.0, 2.0), (0, 0, None, 2.0)], "a int, b int, c double, d double")
    assert [x[0] for x in state.select(board.readiness(*map(F.col, "abcd"))).collect()] == ["ready", "invalid", "unresolved", "cost_blocked"]
    print_of = spark.range(1).select(board.fingerprint(F.lit("a"), F.lit(None)).alias("x"), board.fingerprint(F.lit("a"), F.lit("")).alias("y")).first()
    assert print_of["x"] != print_of["y"]
    wanted = spark.createDataFrame([("1", "m"), ("2", "m")], "case_id string, model_name string")
    records = spark.createDataFrame([("1", "m", "f"), ("1", "m", "f"), ("3", "m", "g")], "case_id string, model_name string, f string")
    assert {(r["rule"], r["key"]) for r in board.resume_violations(records, wanted, "f", "f").collect()} == {("repeated record", "1|m"), ("unknown pair", "3|m"), ("other fingerprint", "3|m")}


def test_contracts(spark):
    df = spark.createDataFrame([("1", "a", "x", None), ("1", "b", "x", "y"), ("2", "a", "z", None), ("3", "a", "z", "w"), ("3", "b", "q", "w")], "c string, m string, p string, q string")
    assert {(r["key"], r["detail"]) for r in validate.definition_conflicts(df, "c", ["p", "q"]).collect()} == {("1|q", "2"), ("3|p", "2")}
    assert {r["key"] for r in validate.coverage_gaps(df, "c", "m").collect()} == {"2|b"} and [tuple(r) for r in validate.short_cases(df, "c", "m").collect()] == [("missing models", "2", "1 of 2")]


def test_texts(spark):
    df = spark.createDataFrame([('["a", 1]',), ("no",), (None,), ("[]",)], "t string")
    assert [r["x"] for r in df.select(text.json_strings(F.col("t")).alias("x")).collect()] == [["a", "1"], [], [], []]
    with pytest.raises(Exception, match="not a JSON list"):
        df.select(text.json_strings(F.col("t"), True)).collect()
    docs = spark.createDataFrame([('{"b": 1, "a": "é"}',), ('{"a":"é","b":1}',), ("{",)], "t string").select(text.canonical_sha256(F.col("t")).alias("x")).collect()
    assert docs[0]["x"] == docs[1]["x"] == hashlib.sha256(json.dumps({"a": "é", "b": 1}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() and docs[2]["x"] is None
    assert text.with_settings("${A}-${B:-x${A}}-${C:-}", {"A": "1"}) == "1-x1-"
    with pytest.raises(KeyError):
        text.with_settings("${Z}", {})
    row = spark.createDataFrame([("q", None)], "a string, b string").select(text.filled("{a}{b} {{x}} {other}", ["a", "b"]).alias("x"), text.percent(F.lit(0.1234)).alias("p"), text.dollars(F.lit(1234.5), 2).alias("d"), text.percent(F.lit(None).cast("double")).alias("n")).first()
    assert tuple(row) == ("q {x} {other}", "12.3%", "$1,234.50", "")
    values = spark.createDataFrame([("5.0",), ("0.50",), ("100",), ("x",), ("10.00",)], "v string").select(text.strength(F.col("v")).alias("s"))
    assert [r["s"] for r in values.collect()] == ["5", "0.5", "100", None, "10"]


def test_audit_decision(spark):
    rows = [([], []), (["compound_label_split_only"], ["l"]), (["schema_type_only", "schema_and_duplicates"], ["l"]), (["text_or_value_error"], ["l"]), (["text_or_value_error", "invalid_json"], ["s", "l"])]
    df = spark.createDataFrame(rows, "e array<string>, m array<string>")
    got = [tuple(r["x"]) for r in df.select(board.audit_decision(F.col("e"), F.col("m"), ["s"]).alias("x")).collect()]
    assert got == [("none", "none", "control"), ("model", "low", "compound_label"), ("model", "low", "shape"), ("model", "low", "text"), ("model", "medium", "text")]
