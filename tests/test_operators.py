import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.text import folded_text
from tallyloom.operators import agreement, cohort, family, reshape, selection, summary, validate
from tallyloom.sources import tables
from tallyloom.streaming import checkpoint


def test_stage_operations_keeps_missing_missing(spark):
    df = spark.createDataFrame([("m", "success", 1.0, 2, 0.1), ("m", " Error", 3.0, 1, None), ("m", None, 9.0, 5, 9.0)], "model_name string, generation_status string, generation_seconds double, generation_attempts long, generation_cost_usd double")
    r = summary.stage_operations(df, "generation", ["model_name"]).first()
    assert (r["generation_requests"], r["generation_errors"], r["generation_failure_rate"]) == (2, 1, 0.5)
    assert r["generation_p95_seconds"] == pytest.approx(2.9) and r["generation_api_attempts"] == 3
    assert r["generation_cost_usd"] is None and r["generation_cost_coverage"] == 0.5 and r["generation_cost_complete"] is False
    assert r["generation_prompt_tokens"] is None and r["generation_cost_sources"] == ""


def test_validators(spark):
    df = spark.createDataFrame([("1", "a", "x"), ("1", "a", "y"), ("2", "b", None), (" ", "a", "z")], "case_id string, model_name string, input string")
    assert [tuple(r) for r in validate.duplicate_keys(df, ["case_id", "model_name"]).collect()] == [("duplicate key", "1|a", "2")]
    assert [r["key"] for r in validate.definition_conflicts(df, "case_id", ["input"]).collect()] == ["1|input"]
    assert {r["key"] for r in validate.coverage_gaps(df, "case_id", "model_name").collect()} == {"1|b", "2|a", " |b"}
    assert validate.blank_keys(df, "case_id").count() == 1
    with pytest.raises(validate.ContractError, match="duplicate key"):
        validate.enforce(validate.duplicate_keys(df, ["case_id"]))
    validate.enforce(validate.duplicate_keys(df.where("case_id = '2'"), ["case_id"]))


def test_observation_contract(spark):
    cases = spark.createDataFrame([("1",)], "case_id string")
    rows = [("1", "c", "success", "pass", "0.5"), ("9", "c", "success", None, "2"), ("1", "d", "error", "pass", None)]
    obs = spark.createDataFrame(rows, "case_id string, criterion string, status string, label string, uncertainty string")
    found = {(r["rule"], r["key"]) for r in validate.observation_violations(obs, cases, ["pass", "fail"], ["case_id", "criterion"]).collect()}
    assert found == {("unknown case_id", "9"), ("label and status", "9|c"), ("label and status", "1|d"), ("uncertainty", "9|c")}


def test_agreement(spark):
    df = spark.createDataFrame([("a", "x", "x"), ("b", "x", "y"), ("c", "y", "y"), ("d", "y", "y")], "i string, r string, p string")
    k = agreement.cohen_kappa(df, "r", "p").first()
    assert k["kappa"] == pytest.approx(0.5) and k["n"] == 4
    same = spark.createDataFrame([("x", "x")] * 3, "r string, p string")
    assert agreement.cohen_kappa(same, "r", "p").first()["kappa"] == 1.0
    ratings = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b"), ("2", "b"), ("3", "a"), ("3", "b"), ("4", "a")], "i string, l string")
    assert agreement.pair_agreement(ratings, "i", "l").first()["raw_agreement"] == pytest.approx(2 / 3)
    assert agreement.krippendorff_alpha(ratings, "i", "l").first()["alpha"] == pytest.approx(1 - (1 / 3) / (18 / 30))
    ci = agreement.kappa_interval(df, "r", "p", 50, 1, "i").first()
    assert ci["kappa_low"] <= 0.5 <= ci["kappa_high"] and 0 < ci["replicates"] <= 50
    with pytest.raises(Exception, match="unknown label"):
        agreement.confusion(df, "r", "p", "x", "z").collect()


def test_levels(spark):
    gates = spark.createDataFrame([("g1", "calibrated", "a", ">=", 0.5), ("g2", "calibrated", "b", "<=", 0.1), ("g3", "decision_grade", "c", ">=", 0.1)], "gate string, level string, metric string, comparison string, threshold double")
    values = spark.createDataFrame([("a", 0.6), ("b", 0.1)], "metric string, value double")
    got = agreement.gate_results(gates, values)
    assert {r["gate"]: r["passed"] for r in got.collect()} == {"g1": True, "g2": True, "g3": False}
    assert agreement.achieved_level(got).first()["level"] == "calibrated"
    assert agreement.achieved_level(got, synthetic=True).first()["level"] == "exploratory"
    level = lambda *rows: agreement.achieved_level(spark.createDataFrame(list(rows), "level string, passed boolean")).first()["level"]
    assert level(("calibrated", True)) == "publishable"  # no gate stands against it
    assert level(("publishable", True)) == "exploratory" == level(("calibrated", False), ("decision_grade", True))
    assert level(("calibrated", True), ("decision_grade", True), ("publishable", False)) == "decision_grade"
    for rows, why in (((), "no gates"), ((("exploratory", True),), "first or unknown"), ((("other", True),), "first or unknown"), ((("calibrated", None),), "no result")):
        with pytest.raises(Exception, match=why):
            level(*rows)


def test_kappa_interval_counts_full_agreement(spark):
    one = spark.createDataFrame([(k, "a", "a") for k in range(5)], "i int, r string, p string")
    got = agreement.kappa_interval(one, "r", "p", 20, 1, "i").first()
    assert (got["kappa_low"], got["kappa_high"], got["replicates"]) == (1.0, 1.0, 20)


SUMMARY = "rank int, model_name string, unscored_cases long, pass_rate double, pass_rate_ci_low double, generation_requests long, generation_failure_rate double, generation_p95_seconds double, generation_latency_coverage double, generation_cost_usd double"


def models(spark, *rows):
    return spark.createDataFrame(list(rows), SUMMARY)


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "model_a string, model_b string, clear_winner string")


def test_selection(spark):
    s = models(spark, (1, "a", 0, 0.9, 0.8, 10, 0.0, 2.0, 1.0, 1.0), (2, "b", 0, 0.5, 0.4, 10, 0.1, 1.0, 1.0, 0.5), (3, "c", 0, 0.8, 0.7, 10, 0.0, 1.0, 0.5, None))
    profiles = spark.createDataFrame([(m, True, ["json"]) for m in "abc"], "model_name string, available boolean, capabilities array<string>")
    policy = selection.Policy(min_pass_rate=0.6, max_average_cost=0.2, quality=0.5, cost=0.5)
    got = {r["model_name"]: r for r in selection.select_models(s, policy, profiles).collect()}
    assert got["a"]["selection_status"] == "eligible" and got["a"]["decision_score"] == pytest.approx(0.5 * 0.9 + 0.5 * 0.5)
    assert got["b"]["constraint_failures"] == "pass rate 50.0% is below 60.0%"
    assert (got["c"]["selection_status"], got["c"]["missing_evidence"], got["c"]["selection_rank"]) == ("unknown", "complete generation cost", None)
    no_profile = selection.select_models(s, selection.Policy()).first()
    assert no_profile["missing_evidence"] == "deployment availability"


def test_decisions(spark):
    a, b = (1, "a", 0, 0.9, 0.8, 1, 0.0, 1.0, 1.0, 1.0), (2, "b", 0, 0.5, 0.4, 1, 0.0, 1.0, 1.0, 1.0)
    two = models(spark, a, b)
    clear, unclear = pairs(spark, ("a", "b", "a")), pairs(spark, ("a", "b", None))
    say = lambda s, c: selection.quality_decision(s, c).status
    assert say(two.where("false"), clear) == "no_results"
    assert say(two.withColumn("unscored_cases", F.lit(1)), clear) == "incomplete_evaluation"
    assert say(two.where("rank = 1"), clear) == "single_model"
    assert say(two.withColumn("rank", F.lit(1)), clear) == "observed_tie"
    assert say(two, unclear) == "insufficient_evidence" and say(two, clear) == "clear_leader"
    chosen = lambda rows: spark.createDataFrame(rows, "model_name string, selection_status string, decision_score double")
    rec = lambda rows, policy, c=clear: selection.recommendation(two, c, chosen(rows), policy).status
    p = selection.Policy(quality=0.5, cost=0.5, min_margin=0.1)
    assert rec([("a", "unknown", None), ("b", "eligible", 0.5)], p) == "insufficient_operational_data"
    assert rec([("a", "ineligible", None), ("b", "ineligible", None)], p) == "no_eligible_models"
    assert rec([("a", "ineligible", None), ("b", "eligible", 0.5)], p) == "sole_eligible_model"
    assert rec([("a", "eligible", 0.5), ("b", "eligible", 0.5)], p) == "policy_tie"
    assert rec([("a", "eligible", 0.55), ("b", "eligible", 0.5)], p) == "insufficient_policy_margin"
    assert rec([("a", "eligible", 0.9), ("b", "eligible", 0.5)], p) == "policy_leader"
    assert rec([("a", "eligible", 0.9), ("b", "eligible", 0.5)], selection.Policy()) == "quality_leader"
    assert rec([("a", "eligible", 0.9), ("b", "eligible", 0.5)], selection.Policy(), unclear) == "insufficient_quality_evidence"
    assert selection.recommendation(two, clear, blocked="no judge evidence").status == "insufficient_judge_validation"


def test_balanced_cohort_is_order_free_and_balanced(spark):
    rows = [(f"u{k}", "en" if k % 2 else "fr", "s" if k % 3 else "c") for k in range(30)]
    df = spark.createDataFrame(rows, "unit string, lang string, stratum string")
    a = cohort.balanced_units(df, "unit", ["lang", "stratum"], 12, 7)
    b = cohort.balanced_units(df.repartition(7), "unit", ["lang", "stratum"], 12, 7)
    assert a.orderBy("pick").collect() == b.orderBy("pick").collect()
    distance = cohort.share_distance(df.join(a, "unit"), df, ["lang", "stratum"])
    assert all(r["distance"] < 0.01 for r in distance.collect())
    more = cohort.balanced_units(df, "unit", ["lang", "stratum"], 12, 7, [r["unit"] for r in a.where("pick <= 4").collect()])
    assert more.count() == 12


def test_samples(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"))
    got = cohort.audit_sample(df, ["g"], "k", 4, 1, "audit")
    assert got.count() == 12 and {r["audit_id"] for r in got.collect()} == {f"audit-{k:04d}" for k in range(1, 13)}


def test_reshape(spark):
    df = spark.createDataFrame([("1", 1, "a"), ("1", 2, "b"), ("2", 1, "c")], "k string, t int, v string")
    assert {(r["k"], r["v"]) for r in reshape.keep_last(df, ["k"], ["t"]).collect()} == {("1", "b"), ("2", "c")}
    with pytest.raises(Exception, match="repeated key"):
        reshape.attach(df, df.select("k", F.lit(1).alias("m")), "k").collect()
    nested = spark.createDataFrame([("m", '{"lang": {"en": {"pass_rate": 0.5, "cases": 4}}}')], "model string, slices string")
    assert tuple(reshape.nested_slices(nested, "slices", "model").first()) == ("m", "lang", "en", 0.5, 4)


def test_records_and_evidence(spark):
    df = spark.createDataFrame([("Aspirin", ["325 mg", "500 mg"], None)], "name string, strengths array<string>, note string")
    text = family.rendered_record([("name", F.col("name")), ("strength", F.array_join("strengths", " | ")), ("note", F.col("note"))])
    row = df.select(text.alias("t")).select("t", family.parsed_record(F.col("t")).alias("m")).first()
    assert row["t"] == "name: Aspirin\nstrength: 325 mg | 500 mg" and row["m"] == {"name": "Aspirin", "strength": "325 mg | 500 mg"}
    pages = spark.createDataFrame([("d", 1, "none"), ("d", 2, "takes 1,250.5 mg"), ("d", 3, "1250.5")], "document_id string, page int, text string")
    wanted = spark.createDataFrame([("d", "dose", "1250.5"), ("d", "none", "77")], "document_id string, field string, v string").withColumn("candidates", family.number_candidates(F.col("v"))).drop("v")
    assert {r["field"]: r["page"] for r in family.first_evidence_page(pages, wanted).collect()} == {"dose": 3, "none": None}
    folded = pages.limit(1).select(F.explode(F.array(F.lit("Tylenol\u2122 5%"), F.lit("PR CRÈME, 2,5 mg"), F.lit("apres tm"))).alias("t")).select(folded_text(F.col("t")).alias("t"))
    assert [r["t"] for r in folded.collect()] == ["tylenol 5 %", "creme 2 5 mg", "apres"]
    spelt = spark.createDataFrame([("5.0",), ("1250",), ("1.5",), ("12",), (None,)], "v string").select(family.number_candidates(F.col("v")).alias("c"))
    assert [r["c"] for r in spelt.collect()] == [["5.0", "5", "5,0", "5 0"], ["1250", "1,250", "1 250"], ["1.5", "1,5", "1 5"], ["12"], []]


def test_families(spark):
    df = spark.createDataFrame([("o", "Drug  A", ["x", "y"], "t"), ("o", "drug a", ["y", "x"], "T"), ("o", "B", ["x"], "t"), ("o", "b", ["x"], "u")], "owner string, name string, parts array<string>, form string")
    got = family.families(df, "owner", "name", "parts", ["form"]).collect()
    assert len(got) == 1 and (got[0]["variants"], got[0]["stratum"], got[0]["parts"]) == (2, "both", "x,y")


def test_sources(spark, tmp_path):
    (tmp_path / "o.csv").write_text('case_id, input,expected_output,model_name,model_output\n007,"a ""q""\nb",NA,m,null\n')
    row = tables.read_outputs(spark, str(tmp_path / "o.csv")).first()
    assert (row["case_id"], row["input"], row["expected_output"], row["model_output"], row["evaluation_type"]) == ("007", 'a "q"\nb', "NA", "null", "judge")
    with pytest.raises(ValueError, match="evaluation_type"):
        tables.read_cases(spark, str(tmp_path / "o.csv"))
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("drug.txt", '"1","a"\n"2","b"\n')
    assert [tuple(r) for r in tables.read_archive(spark, str(tmp_path / "x.zip"), "drug.txt", ["code", "name"]).collect()] == [("1", "a", 1), ("2", "b", 2)]
    lines = [json.dumps({"schema_version": "1.0", "record": {"case_id": str(k)}}) for k in range(3)]
    (tmp_path / "c.jsonl").write_text("\n".join([*lines, '{"schema_ver']))
    assert tables.read_checkpoint(spark, str(tmp_path / "c.jsonl"), "case_id string").count() == 3
    (tmp_path / "d.jsonl").write_text("\n".join([lines[0], "{torn", lines[1]]))
    with pytest.raises(Exception, match="torn"):
        tables.read_checkpoint(spark, str(tmp_path / "d.jsonl"), "case_id string").collect()
    with pytest.raises(Exception, match="version 1.0 is not 2.0"):
        tables.read_checkpoint(spark, str(tmp_path / "c.jsonl"), "case_id string", "2.0").collect()
    tables.repair_checkpoint(spark, str(tmp_path / "c.jsonl"), str(tmp_path / "whole"), "case_id string")
    tables.write_checkpoint(spark.createDataFrame([("9",)], "case_id string"), str(tmp_path / "whole"))
    assert sorted(r["case_id"] for r in tables.read_checkpoint(spark, str(tmp_path / "whole"), "case_id string").collect()) == ["0", "1", "2", "9"]
    (tmp_path / "n.csv").write_text('a,b\n1,"x\ny"\n2,z\n\n')
    assert tables.record_count(spark, str(tmp_path / "n.csv"), "csv") == 2 and tables.record_count(spark, str(tmp_path / "c.jsonl")) == 4
    (tmp_path / "g.csv").write_text("case_id,input,evaluation_type\n 1 ,a, JSON \n2,b,exact\n")
    assert [(r["case_id"], r["evaluation_type"]) for r in tables.read_generation_cases(spark, str(tmp_path / "g.csv")).collect()] == [("1", "json"), ("2", "exact")]
    (tmp_path / "h.csv").write_text("case_id,input\n1,a\n1,b\n")
    with pytest.raises(ValueError, match="duplicate key"):
        tables.read_generation_cases(spark, str(tmp_path / "h.csv"))
    df = spark.createDataFrame([("m", 1.5), ("n", float("nan"))], "model string, v double")
    assert sorted(r["record"] for r in tables.records(df).collect()) == ['{"model":"m","v":1.5}', '{"model":"n","v":null}']
    tables.write_bundle(df, str(tmp_path / "b"), ["model"], {"rows": 2})
    scores, manifest = tables.read_bundle(spark, str(tmp_path / "b"))
    assert scores.count() == 2 and manifest == {"rows": 2}


def test_stream_takes_each_record_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    line = lambda k: json.dumps({"schema_version": "1.0", "record": {"case_id": str(k), "model_name": "m"}})
    (tmp_path / "in" / "1.jsonl").write_text("\n".join([line(1), line(2), '{"torn']))
    for add in (None, "\n".join([line(2), line(3)])):
        if add:
            (tmp_path / "in" / "2.jsonl").write_text(add)
        stream = checkpoint.first_records(checkpoint.record_stream(spark, source, "case_id string, model_name string"), ["case_id", "model_name"])
        checkpoint.materialize(stream, out, state).awaitTermination()
    assert sorted(r["case_id"] for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]


def test_doubles_as_c_writes_them(spark, tmp_path):
    rng = random.Random(3)
    values = [0.5, 0.0, -1.0, 100.0, 1e11, 123456789012.0, 1e12, 1.5e300, 1e-4, 1e-5, 0.1 + 0.2, 2 / 3, -1234.5678901234567, None, float("inf"), float("-inf"), 999999999999.5]
    values += [rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 16) for _ in range(300)]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", tables.shown_double(F.col("v")).alias("s")).collect()
    assert {r["k"]: r["s"] for r in got} == {k: None if v is None else "%.12g" % v for k, v in enumerate(values)}
    tables.write_csv(spark.createDataFrame([("b", None, "x,y"), ("a", 0.5, 'q"')], "k string, v double, t string"), str(tmp_path / "out"), ["k"])
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text == 'k,v,t\na,0.5,"q"""\nb,,"x,y"\n'
