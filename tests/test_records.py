"""Rendered records, exact order statistics and dated prices on small rows."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import cost
from tallyloom.operators import records, summary

VARIANT = "array<struct<din:string,brand_name:string,dosage_forms:array<string>,routes:array<string>,schedule:array<string>,product_status:string,company:string,ingredients:array<struct<name:string,strength:string,unit:string>>>>"


def variant(din, forms=("Tablet, coated",), routes=("Oral",), ingredients=(("Zinc", "5.0", "mg"),), brand="Ab", schedule=("OTC",)):
    return (din, brand, list(forms), list(routes), list(schedule), "Marketed", "Co", [tuple(i) for i in ingredients])


@pytest.mark.parametrize("language", ["en", "fr"])
def test_records_round_trip(spark, language):
    rows = [(1, [variant("00000002", ("b", "A, x"), ("Oral", "Nasal")), variant("00000001", ("A, x", "c"), ("Oral",), (("zinc", "10", "mg"), ("Ácid; X=1", "0.50", "%"), ("Zinc", "5", "mg")))]), (2, [variant("3", ingredients=())])]
    made = spark.createDataFrame(rows, f"id int, v {VARIANT}").select("id", records.rendered(F.col("v"), language).alias("input"), F.lit(language.upper()).alias("language"))
    got = {r["id"]: r["parsed"] for r in records.parsed_records(made).collect()}
    one = got[1]
    assert (one["error"], one["din"], one["brand_name"], one["dosage_forms"], one["routes"], one["company"]) == (None, ["00000001", "00000002"], "Ab", ["A, x", "b", "c"], ["Nasal", "Oral"], "Co")
    assert [tuple(i) for i in one["active_ingredients"]] == [("Zinc", "5", "mg"), ("zinc", "10", "mg"), ("Ácid; X=1", "0.5", "%")]
    assert got[2]["active_ingredients"] == [] and got[2]["din"] == ["3"]


def test_bad_records(spark):
    full = "intro\n\nVARIANT 1\nDIN: 1\nBRAND_NAME: B\nDOSAGE_FORMS: f\nROUTES: r\nSCHEDULES: s\nPRODUCT_STATUS: p\nCOMPANY: c\nDRUG_CODE: 9\nACTIVE_INGREDIENTS:\n- NAME=n; STRENGTH=1; UNIT=u\n"
    said = {
        full: None, "": "no variants", "DIN: 1": "no variants", full.replace("DIN: 1\n", "").replace("ROUTES: r\n", ""): "variant 1 lacks din, routes", full + "what: x": "unknown line: what: x", full.replace("STRENGTH=1", "STRENGTH=one"): "a strength is no number",
        full + full[7:].replace("BRAND_NAME: B", "BRAND_NAME: C").replace("VARIANT 1", "VARIANT 2"): "variants differ in brand_name", full.replace("\n", "\r\n"): None, full + "DIN: 7": None, full + "VARIANT 2": "variant 2 lacks brand_name, company, din, dosage_forms, product_status, routes, schedule",
    }
    rows = spark.createDataFrame([(k, x, "en") for k, x in enumerate(said)] + [(90, full, "de"), (91, None, "en"), (92, full, None)], "id int, input string, language string")
    got = {r["id"]: r["parsed"] for r in records.parsed_records(rows).collect()}
    assert [got[k]["error"] for k in range(len(said))] == list(said.values())
    assert got[90]["error"] == "unknown language: de" and got[92]["error"] == "unknown language: null" and got[91] is None
    assert got[8]["din"] == ["7"] and got[1]["din"] is None


@pytest.mark.parametrize("kind", ["one", "two", "ints", "normal", "powers", "hot", "infinite"])
def test_distributions_are_exact(spark, kind, monkeypatch):
    rng = random.Random(kind)
    make = {
        "one": [7.0], "two": [1.0, 2.0], "ints": [float(rng.randrange(20)) for _ in range(500)], "normal": [rng.gauss(0, 1) for _ in range(501)], "powers": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(400)],
        "hot": [3.5] * 900 + [rng.random() for _ in range(40)], "infinite": [float("-inf"), float("inf")] * 3 + [rng.random() for _ in range(60)],
    }[kind]
    monkeypatch.setattr(summary, "PARTS", 8)
    df = spark.createDataFrame([(v,) for v in make] + [(None,), (float("nan"),)], "v double").withColumn("gone", F.lit(None).cast("double"))
    got = summary.distribution(df, ["v", "gone"]).collect()
    v = sorted(make)
    n = len(v)
    middle = (v[(n - 1) // 2] + v[n // 2]) / 2
    assert [(r["measure"], r["n"], r["minimum"], r["p95"], r["maximum"]) for r in got] == [("v", n, v[0], v[math.floor(0.95 * (n - 1))], v[-1])]
    assert got[0]["median"] == middle
    assert summary.distribution(df.where("false"), ["v"]).collect() == []


def test_prices_in_force(spark):
    day = datetime.date
    prices = spark.createDataFrame(
        [("a", "r", day(2026, 1, 1), 1.0, None, 10.0), ("a", "r", day(2026, 6, 1), 2.0, 0.5, 20.0), ("b", "r", day(2026, 1, 1), 1.0, 1.0, 1.0), ("b", "r", day(2026, 1, 1), 9.0, 1.0, 1.0), (None, "r", day(2026, 1, 1), 1.0, 1.0, 1.0)],
        "pricing_id string, route string, effective_on date, rate_in double, rate_cached double, rate_out double",
    )
    asked = [
        (1, "a", "r", day(2026, 3, 1), 1000, 100, 10), (2, "a", "r", day(2026, 6, 1), 1000, 100, 10), (3, "a", "r", day(2025, 12, 31), 1, 0, 1), (4, "a", "x", day(2026, 6, 1), 1, 0, 1), (5, "z", "r", day(2026, 6, 1), 1, 0, 1), (6, "b", "r", day(2026, 6, 1), 1, 0, 1),
        (7, None, "r", day(2026, 6, 1), 1, 0, 1), (8, "a", "r", day(2026, 6, 1), None, 0, 1), (9, "a", "r", day(2026, 6, 1), 1, 5, 1), (10, "a", None, day(2026, 6, 1), 1, 0, 1),
    ]
    requests = spark.createDataFrame(asked, "id int, pricing_id string, route string, requested_on date, prompt_tokens long, cached_tokens long, completion_tokens long")
    got = {r["id"]: (r["price_problem"], r["cost_usd"]) for r in cost.priced(requests, prices).collect()}
    assert got[1] == (None, pytest.approx((900 + 100 + 100) / 1e6)) and got[2] == (None, pytest.approx((1800 + 50 + 200) / 1e6))
    assert {k: got[k] for k in (3, 4, 5, 6, 7, 8, 9, 10)} == {
        3: ("no price in force", None), 4: ("price of another route", None), 5: ("no price of that id", None), 6: ("several prices of one day", None), 7: (None, None), 8: (None, None), 9: (None, None), 10: ("price of another route", None),
    }


def test_blanks_of_all_scripts_at_ends_of_lines(spark):
    said = ["plain", "a b", " a", "a ", " a  b ", "", " ", "é ", "a "]
    rows = spark.createDataFrame([(x,) for x in said], "x string").select("x", records.trimmed_line(F.col("x")).alias("trimmed"), records._key(F.col("x")).alias("key"))
    assert [(r["trimmed"], r["key"]) for r in rows.collect()] == [(x.strip(), " ".join(x.split()).lower()) for x in said]
