"""Evidence pages fold each text once."""

from tallyloom.operators import family


def test_pages_are_folded_once(spark):
    pages = spark.createDataFrame([(1, 1, "One two"), (1, 2, None), (1, 0, "x ONE two, é")], "document_id int, page int, text string")
    wanted = spark.createDataFrame([(1, "a", ["one two"]), (1, "b", [""]), (1, "c", ["none"])], "document_id int, field string, candidates array<string>")
    found = family.first_evidence_page(pages, wanted)
    assert {r["field"]: r["page"] for r in found.collect()} == {"a": 0, "b": None, "c": None}
    parts = family.first_evidence_page(pages, wanted)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [x for x in parts if "Filter" in x and "isnotnull(trim(" in x]
