"""Manifests, archives, attachments, task and evidence contracts, merges, tiers and demonstrations."""

import datetime
import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import agreement, cohort, contracts
from tallyloom.sources import configs, manifest

RULES = lambda df: {(r["rule"], r["key"]) for r in df.collect()}


def test_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("a.txt", b"one"), ("sub/b.txt", b"two"), ("c.txt", b"three")):
        (tmp_path / name).write_bytes(text)
    found = manifest.files(spark, str(tmp_path))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert {(r["path"], r["bytes"], r["sha256"]) for r in found.collect()} == {("a.txt", 3, sha(b"one")), ("sub/b.txt", 3, sha(b"two")), ("c.txt", 5, sha(b"three"))}
    rows = [("a.txt", 3, sha(b"one")), ("sub/b.txt", 4, sha(b"x")), ("../d.txt", 1, sha(b"")), ("/e.txt", 1, "zz"), ("a.txt", 3, sha(b"one"))]
    listed = spark.createDataFrame(rows, "path string, bytes long, sha256 string")
    assert RULES(manifest.manifest_violations(listed, found)) == {
        ("outside the root", "../d.txt"), ("outside the root", "/e.txt"), ("not a hash", "/e.txt"), ("listed twice", "a.txt"), ("missing file", "../d.txt"), ("missing file", "/e.txt"), ("not listed", "c.txt"), ("size", "sub/b.txt"), ("hash", "sub/b.txt"),
    }
    ids = spark.createDataFrame([("A",), ("a ",), ("b",)], "id string")
    assert RULES(manifest.membership_violations(ids, "id", spark.createDataFrame([("a",), ("C",)], "id string"))) == {("repeated member", "a"), ("missing member", "c"), ("extra member", "b")}
    folded = manifest.membership_violations(spark.createDataFrame([("Straße",), ("STRASSE",), ("É",)], "id string"), "id", spark.createDataFrame([("strasse",), ("é",), ("É",)], "id string"))
    assert {tuple(r) for r in folded.collect()} == {("repeated member", "strasse", "2")}
    cases = spark.createDataFrame([("1", "a.txt", 3, sha(b"one"), "text/plain"), ("2", "x/c.txt", 5, sha(b"three"), "text/plain"), ("3", "c.txt", 6, sha(b"other"), "application/pdf"), ("4", "c.txt", 51 << 20, sha(b"three"), "text/plain")], "case_id string, name string, bytes long, sha256 string, media_type string")
    assert RULES(manifest.attachment_violations(cases, found, {".txt": "text/plain"})) == {("not a file name", "2|x/c.txt"), ("missing file", "2|x/c.txt"), ("size", "3|c.txt"), ("hash", "3|c.txt"), ("media type", "3|c.txt"), ("size", "4|c.txt"), ("too large", "4|c.txt"), ("too many", "4")}


def test_archive(spark, tmp_path):
    def member(z, name, text, day=(2026, 7, 2, 0, 0, 0)):
        z.writestr(zipfile.ZipInfo(name, day), text)

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        member(z, "good.txt", '"1","a"\n"2","b\nc"\n')
        member(z, "wide.txt", "1,2,3\n4,5\n\n")
        member(z, "old.txt", "1,2\n", (2026, 7, 1, 0, 0, 0))
        member(z, "empty.txt", "")
        member(z, "latin.txt", "é,1\n".encode("latin-1"))
        member(z, "sub/more.txt", "1,2\n")
    names = ["good.txt", "wide.txt", "old.txt", "empty.txt", "latin.txt", "absent.txt"]
    got = manifest.archive_violations(spark, str(tmp_path / "x.zip"), dict.fromkeys(names, 2), datetime.date(2026, 7, 2))
    found = {(r["rule"], r["key"], r["detail"]) for r in got.collect() if r["rule"] == "member"}
    assert found == {("member", "wide.txt", "1 rows not of 2 columns"), ("member", "wide.txt", "1 blank rows"), ("member", "old.txt", "date 2026-07-01"), ("member", "empty.txt", "no records"), ("member", "latin.txt", "not UTF-8")}
    assert RULES(got) >= {("missing member", "absent.txt"), ("extra member", "sub/more.txt")}
    (tmp_path / "y.zip").write_bytes(b"nothing")
    assert {r["rule"] for r in manifest.archive_violations(spark, str(tmp_path / "y.zip"), {}, datetime.date(2026, 7, 2)).collect()} == {"not an archive"}


def test_tasks_and_answers(spark):
    assert manifest.placeholders("{a} {{b}} {c} {a}") == ["a", "c"]
    cases = spark.createDataFrame([("1", "EXACT", "dev"), ("1", "other", "test"), (" ", "json", "dev")], "case_id string, evaluation_type string, split string")
    assert RULES(contracts.case_violations(cases, ["case_id"], ["dev"])) == {("blank case_id", "case_id"), ("duplicate key", "1"), ("unknown evaluation_type", "other"), ("unknown split", "test")}
    assert RULES(contracts.case_violations(cases, ["input"], names=["q"])) == {("missing column", "input"), ("missing column", "q")}
    one = lambda score, reason="r": {"score": score, "reason": reason}
    answer = lambda overall="why", **c: json.dumps({"criteria": c, "overall_reason": overall})
    said = {
        answer(a=one(5), b=one(1.5)): None, "```json\n" + answer(a=one(0), b=one(5)) + "\n```": None, "no": "not a JSON object", None: "no answer", "[1]": "not a JSON object", answer(a=one(5), b=one(1)) + " more": "not a JSON object",
        '{"criteria": [], "overall_reason": "x"}': "criteria are no object", answer(a=one(1)): "missing criteria: b", answer(a=one(1), b=one(1), d=one(1), c=one(1)): "unexpected criteria: c, d", answer(a=1, b=one(1)): "a: no object",
        answer(a=one("1"), b=one(1)): "a: score is no number", answer(a=one(True), b=one(1)): "a: score is no number", answer(a=one(1), b=one(6)): "b: score out of range", answer(a=one(1), b=one(float("1e308"))).replace("1e+308", "1e999"): "b: score out of range",
        answer(a=one(1, " "), b=one(1)): "a: no reason", answer(a=one(1, None), b=one(1)): "a: no reason", answer(" ", a=one(1), b=one(1)): "no overall reason", '{"criteria": {"a": {"score": 1, "reason": "r"}, "b": {"score": 1, "reason": "r"}}}': "no overall reason",
    }
    got = spark.createDataFrame([(x,) for x in said], "t string").select(contracts.judge_response(F.col("t"), {"a": 3.0, "b": 1.0}, 0, 5).alias("x")).select("x.*").collect()
    assert [r["error"] for r in got] == list(said.values())
    assert got[0]["score"] == pytest.approx((3 * 1 + 0.3) / 4) and got[0]["scores"] == {"a": 5.0, "b": 1.5} and got[0]["reason"] == "why" and got[1]["score"] == 0.25
    assert all(r["score"] is None and r["scores"] is None and r["reason"] is None for r in got[2:])
    day = datetime.date
    prices = spark.createDataFrame([(1.0, 2.0, day(2026, 7, 1)), (None, 2.0, day(2026, 7, 1)), (1.0, 2.0, day(2026, 9, 1)), (1.0, 2.0, day(2025, 7, 1)), (0.0, 0.0, day(2026, 7, 1))], "i double, o double, d date")
    assert [r["s"] for r in prices.select(contracts.price_status(F.col("i"), F.col("o"), F.col("d"), day(2026, 8, 1)).alias("s")).collect()] == ["ready", "blocked", "blocked", "stale", "free"]


def test_evidence_records(spark):
    day = datetime.date
    kind = "id string, title string, evidence_type string, source_kind string, status string, last_reviewed date, review_by date, document string, section string, source_urls array<string>, version_scope string, review_trigger string, superseded_by string, supersession_note string"

    def record(id_, status="current", by=None, note=None, urls=("https://x.org/y",), kind="static", title="t", reviewed=day(2026, 1, 1), due=day(2026, 6, 1), section="s"):
        return (id_, title, "e", kind, status, reviewed, due, "d", section, list(urls) if urls is not None else None, "v", "r", by, note)

    rows = [record("a.b-1"), record("c", "Superseded", "a.b-1"), record("n", "superseded", note="withdrawn"), record("loc", kind="Local", urls=()), record("st", "stale")]
    good = spark.createDataFrame(rows, kind)
    assert contracts.evidence_violations(good).count() == 0
    assert {r["id"]: (r["effective_status"], r["overdue_days"]) for r in contracts.evidence_status(good.where("id in ('a.b-1', 'c')"), day(2026, 6, 11)).collect()} == {"a.b-1": ("stale", 10), "c": ("superseded", 0)}
    assert contracts.evidence_status(good.where("id = 'a.b-1'"), day(2026, 6, 1)).where("effective_status = 'current'").count() == 1
    bad = [record("A b", "old", title=" ", reviewed=day(2026, 2, 1), due=day(2026, 1, 1), urls=["ftp://x"]), record("c", "superseded", "z"), record("d", "superseded"), record("self", "superseded", "self"), record("e", note="old"), record("f", urls=()), record("g", kind="web"), record("h", urls=None), record("i", section=None)]
    assert RULES(contracts.evidence_violations(spark.createDataFrame([*rows, *bad], kind))) == {
        ("record id", "A b"), ("duplicate key", "c"), ("blank text", "A b"), ("blank text", "i"), ("unknown status", "old"), ("unknown source_kind", "web"), ("date order", "A b"), ("link", "A b"), ("link", "f"), ("link", "h"),
        ("superseded without successor or note", "d"), ("unknown successor", "c"), ("supersedes itself", "self"), ("supersession of a record that is not superseded", "e"),
    }


def test_claims_need_the_weakest_judge(spark):
    rows = lambda *levels: spark.createDataFrame([(x, "llm_judge") for x in levels] + [("calibrated", "deterministic")], "level string, evaluation_source string")
    block = lambda df: tuple(agreement.claim_block(df, "level", agreement.LEVELS[1]).first())
    first, second, third = agreement.LEVELS[:3]
    assert block(rows(second, third)) == (2, second, False) and block(rows(first, third)) == (2, first, True)
    assert block(rows(second, None)) == (2, second, False)  # nulls don't count
    assert block(rows(None, None)) == (2, first, True) and block(rows(second).drop("level")) == (1, first, True)
    assert block(rows()) == (0, None, False)
    with pytest.raises(Exception, match="unknown judge level: odd"):
        block(rows(second, "odd"))


@pytest.mark.parametrize(("said", "shown"), [("5.0", "5"), ("0.50", "0.5"), (" 100 ", "100"), ("0.12345678912345", "0.12345678912345"), ("1e3", "1000"), ("2.5E-3", "0.0025"), ("-0.0", "0"), ("-.5", "-0.5"), ("12.", "12"), ("123456789012345678901234567890.10", "123456789012345678901234567890.1"), ("x", None), ("1 2", None), ("", None), ("1e", None), ("0012", "12"), ("1.5e1", "15")])
def test_strengths(spark, said, shown):
    assert spark.createDataFrame([(said,)], "t string").select(text.strength(F.col("t"))).first()[0] == shown


def test_merges(spark):
    a = spark.createDataFrame([("1", 1), ("2", 2)], "k string, x int")
    b = spark.createDataFrame([("2", 5), ("1", 4)], "k string, y int")
    assert {tuple(r) for r in contracts.one_to_one(a, b, ["k"]).collect()} == {("1", 1, 4), ("2", 2, 5)}
    for other in (b.where("k = '1'"), b.unionByName(b)):
        with pytest.raises(Exception, match="not one to one"):
            contracts.one_to_one(a, other, ["k"]).collect()
    claims = spark.createDataFrame([("p", "h1", "c1"), ("q", "h1", "c2"), ("r", "h9", "c1")], "claim_id string, report_sha256 string, contract string")
    reports = spark.createDataFrame([("h1", "c1", "calibrated")], "sha256 string, contract string, level string")
    assert {r["claim_id"]: (r["level"], r["evidence"]) for r in contracts.resolved_evidence(claims, reports).collect()} == {"p": ("calibrated", "matched"), "q": (None, "other_contract"), "r": (None, "absent")}


def test_tiers_and_demonstrations(spark):
    assert cohort.tier_chain({"a": None, "b": "a", "c": "b"}, "c") == ["c", "b", "a"]
    for parents, why in (({"a": "b", "b": "a"}, "circle"), ({"a": "z"}, "unknown")):
        with pytest.raises(ValueError, match=why):
            cohort.tier_chain(parents, "a")
    rows = [(f"p{k}", ("s", "m")[k % 2], [f"i{k % 7}"] + ([f"i{k % 5}"] if k % 2 else []), [("oral", "skin", "eye")[k % 3]]) for k in range(40)]
    df = spark.createDataFrame(rows, "product_id string, stratum string, ingredients array<string>, routes array<string>")
    got = cohort.diverse_products(df, {"s": 2, "m": 1}, {"eyes": ["eye"], "skins": ["skin"]}, 9)
    chosen, used, taken = [], set(), {"s": 0, "m": 0}
    rank = lambda what, group, p: hashlib.sha256(f"9|{what}|{group}|{p}".encode()).hexdigest()
    for what, group, fits in (("route", "eyes", lambda r: "eye" in r[3]), ("route", "skins", lambda r: "skin" in r[3]), *[("fill", s, lambda r, s=s: r[1] == s) for s in ("s", "s", "m")]):
        if what == "fill" and taken[group] == {"s": 2, "m": 1}[group]:
            continue
        free = [r for r in rows if r[0] not in chosen and not used & set(r[2]) and fits(r) and taken[r[1]] < {"s": 2, "m": 1}[r[1]]]
        best = min(free, key=lambda r: rank(what, group, r[0]))
        chosen.append(best[0])
        used |= set(best[2])
        taken[best[1]] += 1
    assert got == chosen and len(got) == 3
    with pytest.raises(ValueError, match="of 9 products"):
        cohort.diverse_products(df, {"s": 9, "m": 0}, {}, 9)


def test_configs(tmp_path):
    (tmp_path / "a.json").write_text('{"id": "plan-a", "benchmark": "b", "fingerprint": "f", "capabilities": ["json"]}')
    (tmp_path / "b.yaml").write_text("id: plan-b\nbenchmark: b\nfingerprint: g\n") if configs.yaml else None
    plans = configs.load_folder(tmp_path)
    assert configs.run_plans(plans, "b", "f") == ["plan-a"] and configs.run_plans(plans, "b", capabilities=set()) == (["plan-b"] if configs.yaml else [])
    bad = {"c.json": ('{"id": "x", "id": "y"}', "repeated key"), "d.json": ("[1]", "not a mapping"), "e.json": ('{"id": "Bad Id"}', "no identifier"), "f.json": ('{"id": "plan-a"}', "registered twice")}
    if configs.yaml:
        bad["g.yaml"] = ("id: x\nid: y\n", "repeated key")
    for name, (text, why) in bad.items():
        (tmp_path / name).write_text(text)
        with pytest.raises(configs.ConfigError, match=why):
            configs.load_folder(tmp_path)
        (tmp_path / name).unlink()


def test_balanced_cohort_against_brute_force(spark):
    rows = [(k // 2, ("en", "fr", None)[k % 3], ("x", "y")[(k * k) % 5 % 2]) for k in range(60)]
    df = spark.createDataFrame(rows, "unit int, lang string, kind string").repartition(3)
    got = [r["unit"] for r in cohort.balanced_units(df, "unit", ["lang", "kind"], 9, 4).orderBy("pick").collect()]
    values = lambda r: [("lang", r[1] or "<null>"), ("kind", r[2])]
    share = lambda units: {v: n / len(units) for v in {v for r in rows for v in values(r)} for n in [sum(v in values(r) for r in units)]}
    target, chosen = share(rows), []
    rank = {u: hashlib.sha256(f"4:{u}".encode()).hexdigest() for u in range(30)}
    for _ in range(9):
        def cost(u):
            mine = share([r for r in rows if r[0] in (*chosen, u)])
            return round(sum(abs(mine[v] - target[v]) for v in target), 12), rank[u], u

        chosen.append(min((u for u in range(30) if u not in chosen), key=cost))
    assert got == chosen


def test_record_counts_of_a_manifest(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines"\n\n2,"a ""quoted"" word"\n')
    (tmp_path / "sub dir" / "b.csv").write_text("x\n1\n2\n3\n")
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n\n  \n{"a": 2}')
    (tmp_path / "empty.jsonl").write_text("\n")
    rows = [("a.csv", 2, "csv_rows"), ("sub dir/b.csv", 4, "csv_rows"), ("c.jsonl", 2, "jsonl_records"), ("empty.jsonl", 1, "jsonl_records"), ("d.pdf", 1, "not_applicable"), ("e.pdf", None, "not_applicable"), ("../f.csv", None, "csv_rows")]
    listed = spark.createDataFrame(rows, "path string, records long, method string")
    counts = manifest.record_counts(spark, str(tmp_path), listed)
    assert {tuple(r) for r in counts.collect()} == {("a.csv", 2), ("sub dir/b.csv", 3), ("c.jsonl", 2)}
    got = {tuple(r) for r in manifest.record_violations(listed, counts).collect()}
    assert got == {("record count", "sub dir/b.csv", "3 of 4"), ("record count", "empty.jsonl", "0 of 1"), ("count without a method", "d.pdf", "0 of 1"), ("no count", "../f.csv", "0 of none")}
    assert manifest.record_counts(spark, str(tmp_path), listed.where("false")).collect() == []
