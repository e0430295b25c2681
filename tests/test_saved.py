"""Rescoring of saved outputs, verified bundles, guarded joins and rules as rows, on small tables."""

import os

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.jsonscore import JsonRules
from tallyloom.operators import rescore, star
from tallyloom.operators.validate import ContractError
from tallyloom.sources import bundle

KIND = "case_id int, model_name string, evaluation_type string, expected_output string, model_output string"


def outputs(spark, rows):
    return spark.createDataFrame([(k, "m", kind, e, g) for k, (kind, e, g) in enumerate(rows)], KIND)


def test_rescoring_scores_only_what_changed(spark):
    rows = [("json", '{"a": 1}', '{"a": 1}'), ("json", '{"a": 1}', '{"a": 2}'), ("exact", "Yes", " yes "), ("exact", "Yes", "No"), (" EXACT", "Yes", "No"), ("exact", "Yes", None)]
    first = rescore.rescore_saved(outputs(spark, rows), "m").cache()
    assert [r["metric_passed"] for r in first.orderBy("case_id").collect()] == [True, False, True, False, False, False]
    assert not first.where("reused").count()
    saved = rescore.saved_scores(first).cache()
    assert saved.count() == 5  # two rows share one content
    assert rescore.changed(outputs(spark, rows), saved).count() == 0
    again = rescore.rescore_saved(outputs(spark, rows), "m", saved)
    assert again.where("reused").count() == 6
    same = lambda df: [tuple(r) for r in df.drop("reused").select(sorted(set(df.columns) - {"reused"})).orderBy("case_id").collect()]
    assert same(again) == same(first)
    rows[1] = ("json", '{"a": 1}', '{"a": 1.0}')
    now = {r["case_id"]: (r["reused"], r["metric_passed"]) for r in rescore.rescore_saved(outputs(spark, rows), "m", saved).collect()}
    assert now[1] == (False, True) and all(now[k][0] for k in (0, 2, 3, 4, 5))
    assert rescore.changed(outputs(spark, rows), saved, JsonRules(numeric=("/a",))).count() == 5  # other rules, other scores


@pytest.mark.parametrize(("change", "said"), [("'other'", "2 of 2 rows"), ("if(case_id > 0, 'm', null)", "1 of 2 rows are another's, such as null")])
def test_rescoring_takes_one_model(spark, change, said):
    with pytest.raises(ValueError, match=said):
        rescore.rescore_saved(outputs(spark, [("exact", "a", "a"), ("exact", "a", "b")]).withColumn("model_name", F.expr(change)), "m")


def test_rescoring_takes_no_judge_rows_and_no_empty_table(spark):
    with pytest.raises(ValueError, match="1 rows need a judge"):
        rescore.rescore_saved(outputs(spark, [("exact", "a", "a"), ("Judge ", "a", "b")]), "m")
    with pytest.raises(ValueError, match="alone are wanted"):
        rescore.rescore_saved(outputs(spark, [("exact", "a", "a")]).where("false"), "m")


def rows_of(spark):
    return spark.range(200).select(F.col("id").alias("case_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), F.col("id").cast("string"))).alias("text"), (F.col("id") % 2 == 0).alias("ok"))


def part_files(path):
    return sorted(os.path.join(path, "rows", f) for f in os.listdir(f"{path}/rows") if f.endswith(".parquet"))


def test_bundles_are_verified(spark, tmp_path):
    rows = rows_of(spark)
    for k in range(4):
        bundle.write_verified(rows, f"{tmp_path}/b{k}", {"fingerprint": "f"}, files=3)
    assert sorted(map(tuple, bundle.read_verified(spark, f"{tmp_path}/b0", "f").collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    with pytest.raises(ContractError, match="fingerprint"):
        bundle.read_verified(spark, f"{tmp_path}/b0", "g")
    # one flipped byte
    part = part_files(f"{tmp_path}/b1")[1]
    data = bytearray(open(part, "rb").read())
    data[len(data) // 2] ^= 1
    open(part, "wb").write(data)
    crc = os.path.join(os.path.dirname(part), f".{os.path.basename(part)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    assert [r["rule"] for r in bundle.file_violations(spark, f"{tmp_path}/b1").collect()] == ["part hash"]
    with pytest.raises(ContractError, match="part hash"):
        bundle.read_verified(spark, f"{tmp_path}/b1")
    # a missing and a foreign part
    os.remove(part_files(f"{tmp_path}/b2")[0])
    assert [r["rule"] for r in bundle.file_violations(spark, f"{tmp_path}/b2").collect()] == ["missing part"]
    rows.limit(1).write.mode("append").parquet(f"{tmp_path}/b3/rows")
    assert [r["rule"] for r in bundle.file_violations(spark, f"{tmp_path}/b3").collect()] == ["unlisted part"]
    # one row less, whatever its file
    digests = spark.read.parquet(f"{tmp_path}/b0/digests")
    short = spark.read.parquet(f"{tmp_path}/b0/rows").where("case_id <> 7").withColumn("part", F.input_file_name())
    assert short.count() == 199 and digests.agg(F.sum("rows")).first()[0] == 200
    bundle.write_verified(rows.where("case_id <> 7").coalesce(1), f"{tmp_path}/c", {})
    spark.read.parquet(f"{tmp_path}/c/digests").withColumn("rows", F.col("rows") + 1).coalesce(1).write.parquet(f"{tmp_path}/c/digests2")
    os.rename(f"{tmp_path}/c/digests", f"{tmp_path}/c/old")
    os.rename(f"{tmp_path}/c/digests2", f"{tmp_path}/c/digests")
    assert [r["rule"] for r in bundle.row_violations(spark, f"{tmp_path}/c").collect()] == ["part rows"]


def test_digests_do_not_depend_on_order(spark):
    rows = rows_of(spark)
    assert bundle.total_digest(rows) == bundle.total_digest(rows.orderBy(F.rand(3)).repartition(7).select("ok", "text", "case_id"))
    assert bundle.total_digest(rows) != bundle.total_digest(rows.where("case_id <> 3"))
    assert bundle.total_digest(rows) != bundle.total_digest(rows.withColumn("text", F.coalesce("text", F.lit(""))))
    assert bundle.total_digest(rows.where("false")) == ["0"] * 4


def test_release_contract(spark):
    out = spark.createDataFrame([(c, m, f"{c}{m}") for c in range(5) for m in ("x", "y")], "case_id int, model_name string, model_output string")
    facts = {"status": "published", "dataset": "d", "dataset_version": 2, "release_id": "r1", "models": ["x", "y"], "case_count": 5, "rows": 10, "digest": bundle.total_digest(out)}
    rules = lambda df, f, **more: sorted(r["rule"] for r in bundle.release_violations(df, f, "d", "2", ["x", "y", "z"]).collect())
    assert rules(out, facts) == []
    assert rules(out, facts | {"status": "draft", "dataset_version": 3, "rows": 9, "release_id": " "}) == ["dataset", "release id", "rows", "status"]
    assert rules(out.where("case_id <> 2 or model_name <> 'x'"), facts) == ["cases of a model", "digest"]
    assert rules(out.where("model_name = 'x'"), facts) == ["absent model", "digest"]
    assert rules(out.unionByName(out.where("case_id = 1 and model_name = 'y'")), facts) == ["digest", "repeated cases"]
    assert rules(out, facts | {"models": ["x", "q"]}) == ["absent model", "models", "unknown model"]


def test_star_join(spark):
    base = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 4), (4, 4)], "id int, side_id int")
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (4, "d")], "side_id int, name string")
    b = spark.createDataFrame([(1, 1, "p"), (2, 2, "q"), (4, 4, "r")], "id int, side_id int, mark string")
    joined = star.StarJoin(base, {"a": (a, ["side_id"]), "b": (b, ["id", "side_id"])})
    assert sorted((r["id"], r["a"]["name"], r["b"]["mark"]) for r in joined.rows().collect()) == [(1, "a", "p"), (4, "d", "r"), (4, "d", "r")]
    assert sorted(map(tuple, joined.violations().collect())) == [("absent a", "<null>", "0 rows for 1"), ("absent b", "3|<null>", "0 rows for 1"), ("repeated a", "2", "2 rows for 1")]
    with pytest.raises(ContractError, match="repeated a: 2"):
        joined.strict()
    with pytest.raises(ContractError, match="named like columns"):
        star.StarJoin(base, {"ID": (a, ["side_id"])})
    assert star.StarJoin(base.where("id = 1"), {"a": (a, ["side_id"])}).strict().count() == 1


def test_rules_as_rows(spark):
    cells = [("b1", 1, {"x": "1", "j": '{"a": 1, "b": 2}', "t": "JSON"}), ("b1", 2, {"x": "1", "j": '{"a": 1}', "t": " json"}), ("b1", 3, {"x": None, "j": "[]", "t": "exact"}), ("b2", 1, {"x": " "})]
    cases = spark.createDataFrame(cells, "benchmark string, case_id int, cells map<string,string>")
    rules = spark.createDataFrame(
        [("b1", "x", "unique", None), ("b1", "x", "filled", None), ("b1", "j", "json", '["a", "b"]'), ("b1", "t", "type", "json"), ("b1", "y", "column", None), ("b2", "x", "filled", None), ("b2", "x", "unique", None), ("b3", "x", "filled", None)],
        "benchmark string, column string, kind string, argument string",
    )
    got = sorted(map(tuple, star.rule_violations(cases, rules).collect()))
    assert got == [
        ("absent", "b1|y|column", "no case has it"), ("absent", "b3|x|filled", "no case has it"), ("filled", "b1|x", "1, first 3"), ("filled", "b2|x", "1, first 1"),
        ("json", "b1|j", "2, first 2"), ("type", "b1|t", "2, first 2"), ("unique", "b1|x", "1, first 1"),
    ]
    with pytest.raises(ContractError, match="unknown kind"):
        star.rule_violations(cases, rules.withColumn("kind", F.lit("odd")))
