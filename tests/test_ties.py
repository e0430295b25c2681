"""Pass marks that a mean meets exactly, and rows without a key."""

import itertools
from functools import reduce
from operator import add

from pyspark.sql import functions as F

from tallyloom.operators import pairwise
from tallyloom.plans import registry


def test_means_at_the_mark_pass_in_any_order(spark, tmp_path):
    # in some orders the sum of these doubles falls short of 200
    orders = list(itertools.permutations((99.53, 0.35, 72.98, 27.14)))
    assert {reduce(add, order) >= 200 for order in orders} == {True, False}
    rows = [(case, kind, v) for case, order in enumerate(orders) for kind in ("click", "view") for v in order] + [(None, "click", 1.0), (None, "view", 99.0), (99, "click", float("nan")), (99, "view", 49.99999999)]
    rows = [(k, case, kind, v) for k, (case, kind, v) in enumerate(rows)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = {r["case_id"]: (r["passed__click"], r["passed__view"]) for r in registry.QUERIES["case_outcomes"](spark, str(tmp_path)).collect()}
    assert found == {k: (True, True) for k in range(len(orders))} | {None: (False, True), 99: (True, False)}
    wins = registry.QUERIES["pairwise_net_wins"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in wins] == [("click", "view", len(orders) + 1, 1, 0, 1)]


def test_rows_without_a_key_make_no_pair(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "b"), (1, None), (1, "a"), (1, "b")], "case_id int, model_name string").withColumns({"final_passed": F.lit(True), "final_score": F.lit(1.0)})
    assert [r["paired_cases"] for r in pairwise.net_wins(rows).collect()] == [1]
