"""Results that must not depend on a bound: more factor values, or more cases a product, than any prefix."""

from tallyloom.operators import census, judging


def test_every_factor_value_has_its_row(spark):
    cases = spark.createDataFrame([("c1", "s")], "case_id string, lang string")
    humans = spark.createDataFrame([("c1", "quality", "lead", "adjudicated", "pass")], "case_id string, criterion string, reviewer_id string, annotation_stage string, label string")
    seen = spark.range(1500).selectExpr("'c1' as case_id", "'quality' as criterion", "concat('v', id) as judge_variant_id", "'t0' as trial_id", "'p0' as prompt_variant_id", "'blinded' as identity_condition", "'pointwise' as presentation_order", "'pass' as label", "'success' as status", "0.5 as uncertainty")
    plan = judging.Protocol(("pass", "fail"), ("quality",), {"judge_variant_id": "v0", "trial_id": "t0", "prompt_variant_id": "p0", "identity_condition": "blinded", "presentation_order": "pointwise"})
    assert judging.labelled(cases, humans, seen, plan, ("judge_variant_id",)).where("judge_label = 'pass'").count() == 1500


def test_a_product_of_many_cases_does_not_crowd_others_out(spark):
    """One product holds 200 cases of each group; seven others hold one case each of one group."""
    rows = [(f"big-{s}-{x}-{k}", "big", s, x) for s in census.STRATA for x in census.LANGUAGES for k in range(200)]
    rows += [(f"small-{k}", f"p{k}", census.STRATA[0], census.LANGUAGES[0]) for k in range(7)]
    cases = spark.createDataFrame(rows, "case_id string, product_id string, stratum string, language string")
    chosen = census.stratified_cases(cases, 8, 3, "t")
    assert len(chosen) == len(set(chosen)) == 8
    big = [c for c in chosen if c.startswith("big")]
    assert len(big) <= 8 and len([c for c in chosen if c.startswith("small")]) >= 1
