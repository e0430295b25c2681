"""Queries over all rows or whole texts, on tables small enough for brute force."""

from tallyloom.functions.text import TextRules, normal_text
from tallyloom.plans import registry


def test_text_normalized_match_takes_every_script(spark, tmp_path):
    said = ["plain", "LOUD", "Straße", "ÉCOLE", "日本", "naïve\u00a0 Ünï", None, "Ωmega", ""]
    rows = [(k, turn, "user" if k % 2 else "assistant", s) for k, s in enumerate(said) for turn in (0, 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["model_name"]: r for r in registry.QUERIES["text_normalized_match"](spark, str(tmp_path)).collect()}
    for role in ("user", "assistant"):
        mine = [s for k, _, r, s in rows if r == role]
        assert got[role]["cases"] == len(mine) and got[role]["skipped_cases"] == len(mine) // 2
    mine = [s for k, _, r, s in rows if r == "user"][::2]
    assert got["user"]["evaluated_cases"] == len(mine)
    assert got["user"]["exact_match_rate"] == round(sum(s.upper() == s for s in mine) / len(mine), 9)
    assert got["user"]["normalized_exact_match_rate"] == round(sum(normal_text(s.upper(), TextRules()) == normal_text(s, TextRules()) for s in mine) / len(mine), 9)


def test_evidence_pages_search_whole_texts(spark, tmp_path):
    item = "an opening of more than forty characters, and then the rest of it"
    spark.createDataFrame([(15, item[:50]), (23, f"before {item.upper()} after"), (31, item), (2, item)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item), (15, item + " elsewhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: r["page"] for r in registry.QUERIES["evidence_pages"](spark, str(tmp_path)).collect()}
    assert got == {7: 23, 15: None}
