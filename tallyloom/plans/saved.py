"""Queries on saved results: the second scorer, rescoring by what changed, verified bundles, guarded joins and rules as rows.

Answers are made of orders: an order's key, status and parts are expected, and its key modulo 7 decides what becomes of them in the output."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cost
from ..functions.jsonscore import JsonRules
from ..operators import records, rescore, star, summary
from ..sources import bundle, manifest, tables
from ..streaming import checkpoint
from .registry import query

RULES = JsonRules(unordered=("/parts",), numeric=("/order",))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; where a local session has none, a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tallyloom-")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def order_answers(t: Callable) -> DataFrame:
    """case_id, expected_output, model_output, evaluation_type, model_name and the kind of damage x of each order with parts.

    Written to the shared folder and read back: scorers read the answers several times over, and their plans need not hold, nor run, the making of them."""
    parts = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_partkey")).alias("parts"))
    o = t("orders").select("o_orderkey", "o_orderstatus").join(parts.hint("merge"), "o_orderkey").withColumn("x", F.col("o_orderkey") % 7)
    key, status, x = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("x")
    full = F.to_json(F.struct(key.alias("order"), status.alias("status"), F.col("parts")))
    said = (
        F.when(x == 0, F.to_json(F.struct(key.alias("order"), F.reverse("parts").alias("parts"), status.alias("status"))))
        .when(x == 1, F.to_json(F.struct(F.concat(key.cast("string"), F.lit(".0")).alias("order"), status.alias("status"), F.col("parts"))))
        .when(x == 2, F.to_json(F.struct(key.alias("order"), F.col("parts"))))
        .when(x == 3, F.to_json(F.struct(key.alias("order"), status.alias("status"), F.col("parts"), F.lit("n").alias("note"))))
        .when(x == 4, F.to_json(F.struct(key.alias("order"), F.concat(F.lit(" "), F.lower(status)).alias("status"), F.col("parts"))))
        .when(x == 5, F.to_json(F.struct(key.alias("order"), status.alias("status"), F.slice("parts", 2, 1000).alias("parts"))))
        .otherwise(F.substring(full, 1, 20))
    )
    rows = o.select(key.alias("case_id"), full.alias("expected_output"), said.alias("model_output"), F.lit("json").alias("evaluation_type"), F.lit("m").alias("model_name"), "x")
    path = shared_folder(rows.sparkSession, "order-answers")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


ORDERS = "o AS (SELECT o_orderkey AS case_id, o_orderkey % 7 AS x FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"


@query(f"""WITH {ORDERS} SELECT case_id, x <> 6 AS output_is_json, x IN (0, 1, 4) AS json_canonical_match, CASE x WHEN 2 THEN 'status' WHEN 6 THEN 'order,parts,status' ELSE '' END AS missing,
 CASE x WHEN 3 THEN 'note' WHEN 6 THEN NULL ELSE '' END AS extra, CASE x WHEN 5 THEN 'parts' ELSE '' END AS mismatched FROM o""")
def rescored(t):
    """Orders' answers by the second scorer."""
    out = rescore.rescored(order_answers(t), rules=RULES)
    shown = [F.array_join(f"json_{n}_fields", ",").alias(n) for n in ("missing", "extra", "mismatched")]
    return out.select("case_id", "output_is_json", "json_canonical_match", *shown)


@query(f"WITH {ORDERS} SELECT case_id, true AS same FROM o")
def scorers_agree(t):
    """Both scorers on every answer."""
    names = ["output_is_json", "json_canonical_match", "json_missing_fields", "json_extra_fields", "json_mismatched_fields"]
    rows = order_answers(t)
    second = rescore.rescored(rows, rules=RULES).select("case_id", F.struct(*names).alias("second"))
    first = rescore.rescore_saved(rows, "m", None, RULES).select("case_id", F.struct(*names).alias("first"))
    return first.join(second.hint("merge"), "case_id").select("case_id", F.col("first").eqNullSafe(F.col("second")).alias("same"))


@query(f"""WITH {ORDERS} SELECT case_id, case_id % 5 <> 0 AS reused, CASE WHEN case_id % 5 = 0 THEN true ELSE x IN (0, 1, 4) END AS metric_passed FROM o""")
def rescore_delta(t):
    """Every fifth order's output has been put right since the saved scores; only these are scored."""
    rows = order_answers(t)
    saved = rescore.saved_scores(rescore.rescore_saved(rows, "m", None, RULES))
    # a blank behind makes even a right output another one
    now = rows.withColumn("model_output", F.when(F.col("case_id") % 5 == 0, F.concat("expected_output", F.lit(" "))).otherwise(F.col("model_output")))
    return rescore.rescore_saved(now, "m", saved, RULES).select("case_id", "reused", "metric_passed")


_SAID = "coalesce(length({0}) || ':' || {0}, 'n')"
_SUMS = ", ".join(f"sum(('0x' || substr(h, {1 + 16 * k}, 15))::BIGINT)::VARCHAR AS d{k}" for k in range(4))


@query(f"""WITH r AS (SELECT event_type AS model_name, sha256({_SAID.format("event_id::VARCHAR")} || {_SAID.format("event_type")} || {_SAID.format("props")} || {_SAID.format("user_id::VARCHAR")}) AS h FROM events)
 SELECT model_name, count(*) AS rows, {_SUMS} FROM r GROUP BY 1""")
def bundle_digests(t):
    """Events as a verified bundle, read back and digested by type."""
    rows = t("events").select("event_id", "event_type", "props", "user_id")
    spark = rows.sparkSession
    path = shared_folder(spark, "bundle")
    bundle.write_verified(rows, path, {"status": "published", "fingerprint": "f"}, files=4)
    back = bundle.read_verified(spark, path, "f").withColumn("model_name", F.col("event_type"))
    out = bundle.digested(back, ["model_name"], ["event_id", "event_type", "props", "user_id"])
    return out.select("model_name", "rows", *[F.col(d).cast("string").alias(d) for d in bundle.SUMS])


def order_sides(t: Callable) -> star.StarJoin:
    """Orders with their customer, their first and their second line, and the supplier of the order's number."""
    line = lambda n: t("lineitem").where(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber")
    base = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 200).alias("s_suppkey"))
    return star.StarJoin(base, {"customer": (t("customer"), ["c_custkey"]), "first": (line(1), ["o_orderkey"]), "second": (line(2), ["o_orderkey"]), "supplier": (t("supplier"), ["s_suppkey"])})


_SIDES = """b AS (SELECT o_orderkey, o_custkey AS c_custkey, o_orderkey % 200 AS s_suppkey FROM orders), n AS (SELECT o_orderkey, c_custkey, s_suppkey, (SELECT count(*) FROM customer c WHERE c.c_custkey = b.c_custkey) AS customer,
 (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1) AS one, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 2) AS two, (SELECT count(*) FROM supplier s WHERE s.s_suppkey = b.s_suppkey) AS supplier FROM b)"""


@query(f"""WITH {_SIDES}, e AS (SELECT 'customer' AS side, c_custkey AS key, customer AS n FROM n UNION ALL SELECT 'first', o_orderkey, one FROM n UNION ALL SELECT 'second', o_orderkey, two FROM n UNION ALL SELECT 'supplier', s_suppkey, supplier FROM n)
 SELECT CASE n WHEN 0 THEN 'absent ' ELSE 'repeated ' END || side AS rule, key::VARCHAR AS key, n || ' rows for ' || count(*) AS detail FROM e WHERE n <> 1 GROUP BY side, key, n""")
def cohort_sources(t):
    """What keeps orders from having exactly one row on every side."""
    return order_sides(t).violations()


@query(f"""WITH {_SIDES} SELECT n.o_orderkey, c_name, x.l_partkey AS first_part, y.l_partkey AS second_part, s_name FROM n JOIN customer USING (c_custkey) JOIN supplier USING (s_suppkey)
 JOIN lineitem x ON x.l_orderkey = n.o_orderkey AND x.l_linenumber = 1 JOIN lineitem y ON y.l_orderkey = n.o_orderkey AND y.l_linenumber = 2 WHERE customer = 1 AND one = 1 AND two = 1 AND supplier = 1""")
def cohort_rows(t):
    """Orders that have."""
    return order_sides(t).rows().select("o_orderkey", "customer.c_name", F.col("first.l_partkey").alias("first_part"), F.col("second.l_partkey").alias("second_part"), "supplier.s_name")


def registry_cases(t: Callable) -> DataFrame:
    """Each order priority is a benchmark, its orders are the cases."""
    k = F.col("o_orderkey")
    answer = F.when(k % 13 == 0, "{").when(k % 17 == 0, '{"a": 1}').when(k % 19 == 0, "[1]").otherwise('{"b": 2, "a": 1}')
    cells = {"answer": answer, "type": F.when(k % 11 == 0, "exact").otherwise("JSON"), "name": F.when(k % 23 == 0, " ").when(k % 29 != 0, "x"), "group": (k % 500).cast("string")}
    return t("orders").select(F.col("o_orderpriority").alias("benchmark"), k.alias("case_id"), F.create_map(*[x for n, c in cells.items() for x in (F.lit(n), c)]).alias("cells"))


@query("""WITH o AS (SELECT o_orderpriority AS b, o_orderkey AS k FROM orders), p AS (SELECT DISTINCT b FROM o),
 j AS (SELECT b, k::VARCHAR AS c, k % 13 = 0 OR k % 17 = 0 OR k % 19 = 0 AS bad FROM o), y AS (SELECT b, k::VARCHAR AS c, k % 11 = 0 AS bad FROM o), f AS (SELECT b, k::VARCHAR AS c, k % 23 = 0 OR k % 29 = 0 AS bad FROM o),
 g AS (SELECT b, (k % 500)::VARCHAR AS c, count(*) > 1 AS bad FROM o GROUP BY ALL),
 e AS (SELECT 'json' AS rule, b || '|answer' AS key, * FROM j UNION ALL SELECT 'type', b || '|type', * FROM y UNION ALL SELECT 'filled', b || '|name', * FROM f UNION ALL SELECT 'unique', b || '|group', * FROM g)
 SELECT rule, key, count(*) || ', first ' || min(c) AS detail FROM e WHERE bad GROUP BY ALL UNION ALL SELECT 'absent', b || '|slice|column', 'no case has it' FROM p""")
def registry_case_violations(t):
    """The same five rules for every benchmark."""
    cases = registry_cases(t)
    rules = [("answer", "json", '["a", "b"]'), ("type", "type", "json"), ("name", "filled", None), ("group", "unique", None), ("slice", "column", None), ("type", "column", None)]
    of = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.lit(a).cast("string").alias("argument")) for c, k, a in rules]))
    return star.rule_violations(cases, cases.select("benchmark").distinct().select("benchmark", of.alias("r")).select("benchmark", "r.*"))


@query("""WITH r AS (SELECT row_number() OVER () AS id, l_partkey % 50 AS p, l_shipdate::DATE AS d, l_quantity::BIGINT * 100 AS a, l_partkey % 40 AS c, l_suppkey % 90 AS o, CASE WHEN l_partkey % 11 = 0 THEN 'x' ELSE 'r' END AS route FROM lineitem),
 v AS (SELECT p, k, DATE '1994-01-01' + (INTERVAL 1 DAY) * (k * 365 + p) AS e, ((p + 1) * (k + 1))::DOUBLE / 10 AS i, CASE WHEN p % 2 = 0 THEN (p + 1)::DOUBLE / 100 END AS h, (p + 2)::DOUBLE / 5 AS u FROM range(45) x(p), range(8) y(k)),
 j AS (SELECT r.*, v.k, v.e, i, coalesce(h, i) AS h, u, row_number() OVER (PARTITION BY id ORDER BY e DESC NULLS LAST) AS n FROM r LEFT JOIN v ON v.p = r.p AND e <= d AND route = 'r')
 SELECT route, CASE WHEN p >= 45 THEN 'no price of that id' WHEN route = 'x' THEN 'price of another route' WHEN k IS NULL THEN 'no price in force' END AS price_problem, k AS version, count(*) AS requests,
 round(sum(CASE WHEN c <= a THEN ((a - c) * i + c * h + o * u) / 1000000 END), 9) AS cost_usd FROM j WHERE n = 1 OR k IS NULL GROUP BY ALL""")
def priced_requests(t):
    """Line items as requests, parts as price ids with a new price every year."""
    part, day = F.col("l_partkey"), F.col("l_shipdate").cast("date")
    asked = t("lineitem").select(
        (part % 50).alias("pricing_id"), F.when(part % 11 == 0, "x").otherwise("r").alias("route"), day.alias("requested_on"),
        (F.col("l_quantity").cast("long") * 100).alias("prompt_tokens"), (part % 40).alias("cached_tokens"), (F.col("l_suppkey") % 90).alias("completion_tokens"),
    )
    p, k = F.col("p"), F.col("k")
    versions = t("nation").sparkSession.range(45).select(F.col("id").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    prices = versions.select(p.alias("pricing_id"), F.lit("r").alias("route"), F.date_add(F.lit("1994-01-01").cast("date"), (k * 365 + p).cast("int")).alias("effective_on"), ((p + 1) * (k + 1) / 10).alias("rate_in"), F.when(p % 2 == 0, (p + 1) / 100).alias("rate_cached"), ((p + 2) / 5).alias("rate_out"))
    found = cost.priced(asked, prices)
    version = F.when(F.col("price_problem").isNull(), ((F.datediff("effective_on", F.lit("1994-01-01").cast("date")) - F.col("pricing_id")) / 365).cast("long")).alias("version")
    return found.groupBy("route", "price_problem", version).agg(F.count("*").alias("requests"), F.sum("cost_usd").alias("cost_usd"))


@query("""WITH x AS (SELECT 'price' AS measure, list_sort(list(l_extendedprice::DOUBLE)) AS v FROM lineitem UNION ALL SELECT 'quantity', list_sort(list(l_quantity::DOUBLE)) FROM lineitem UNION ALL SELECT 'line', list_sort(list(l_linenumber::DOUBLE)) FROM lineitem)
 SELECT measure, len(v) AS n, v[1] AS minimum, (v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2 AS median, v[floor(0.95 * (len(v) - 1))::BIGINT + 1] AS p95, v[len(v)] AS maximum FROM x""")
def distributions(t):
    """Three measures of all line items."""
    rows = t("lineitem").select(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_linenumber").alias("line"))
    return summary.distribution(rows, ["price", "quantity", "line"]).drop("total")


_SORTED = "array_to_string(list_sort(list_distinct(list({0}))), ' | ')"


@query(f"""WITH l AS (SELECT l_orderkey AS k, l_partkey::VARCHAR AS din, 'f, ' || l_returnflag AS form, 'r' || (l_linenumber % 3) AS route, l_linestatus AS schedule, 'Ing ' || (l_partkey % 4) AS name, (l_partkey % 5)::VARCHAR || CASE WHEN l_partkey % 3 = 0 THEN '.5' ELSE '' END AS strength FROM lineitem)
 SELECT k AS case_id, CASE WHEN k % 10 = 9 THEN 'unknown line: NOTE: x' END AS error, CASE WHEN k % 10 <> 9 THEN array_to_string(list_sort(list(din)), ' | ') END AS din, CASE WHEN k % 10 <> 9 THEN {_SORTED.format("form")} END AS forms, CASE WHEN k % 10 <> 9 THEN {_SORTED.format("route")} END AS routes,
 CASE WHEN k % 10 <> 9 THEN {_SORTED.format("schedule")} END AS schedules, CASE WHEN k % 10 <> 9 THEN 'Brand ' || k END AS brand_name, CASE WHEN k % 10 <> 9 THEN array_to_string(list_sort(list_distinct(list(name || '=' || strength))), ' | ') END AS ingredients FROM l GROUP BY k""")
def parsed_families(t):
    """Orders as product records, every line item a variant, in English or French; every tenth holds a line that no grammar knows."""
    k, part = F.col("l_orderkey"), F.col("l_partkey")
    amount = F.concat((part % 5).cast("string"), F.when(part % 3 == 0, ".50").otherwise(""))
    ingredient = F.struct(F.concat(F.lit("Ing "), (part % 4).cast("string")).alias("name"), amount.alias("strength"), F.lit("mg").alias("unit"))
    variant = F.struct(
        part.cast("string").alias("din"), F.concat(F.lit("Brand "), k.cast("string")).alias("brand_name"), F.array(F.concat(F.lit("f, "), F.col("l_returnflag"))).alias("dosage_forms"), F.array(F.concat(F.lit("r"), (F.col("l_linenumber") % 3).cast("string"))).alias("routes"),
        F.array("l_linestatus").alias("schedule"), F.lit("marketed").alias("product_status"), F.lit("Co").alias("company"), F.array(ingredient).alias("ingredients"),
    )
    families = t("lineitem").groupBy(k.alias("case_id")).agg(F.collect_list(variant).alias("v")).withColumn("language", F.when(F.col("case_id") % 2 == 0, "en").otherwise("fr"))
    said = F.when(F.col("language") == "en", records.rendered(F.col("v"), "en")).otherwise(records.rendered(F.col("v"), "fr"))
    made = families.select("case_id", "language", F.when(F.col("case_id") % 10 == 9, F.concat(said, F.lit("\nNOTE: x"))).otherwise(said).alias("input"))
    shown = lambda c: F.array_join(f"parsed.{c}", " | ")
    ingredients = F.array_join(F.array_sort(F.transform("parsed.active_ingredients", lambda i: F.concat(i["name"], F.lit("="), i["strength"]))), " | ")
    out = records.parsed_records(made)
    return out.select("case_id", "parsed.error", shown("din").alias("din"), shown("dosage_forms").alias("forms"), shown("routes").alias("routes"), shown("schedule").alias("schedules"), "parsed.brand_name", ingredients.alias("ingredients"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def resumed_requests(t):
    """Events as checkpoint files, taken as a stream in two runs: the second finds a third of the first's records again."""
    events = t("events").select("event_id", "user_id", "event_type", "value")
    spark, record = events.sparkSession, "event_id bigint, user_id bigint, event_type string, value double"
    source, taken, state = (shared_folder(spark, what) for what in ("records", "resumed", "state"))
    half = F.col("event_id") % 2 == 0
    for part in (events.where(half), events.where(~half | (F.col("event_id") % 3 == 0))):
        tables.write_checkpoint(part, source)
        checkpoint.resume(checkpoint.record_stream(spark, source, record), taken, ["event_id"], state).awaitTermination()
    return checkpoint.resumed(spark, taken, record)


@query("""SELECT method, event_type, 'record count' AS rule, n || ' of ' || (n + 1) AS detail
 FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), (VALUES ('csv_rows'), ('jsonl_records')) m(method) WHERE n % 2 = (method = 'csv_rows')::INT""")
def manifest_counts(t):
    """Events as a CSV and a JSON lines file for each type, against a manifest whose odd counts of CSV rows and even counts of lines are one too high."""
    events = t("events").select("event_id", "user_id", "value", "event_type").repartition("event_type")
    spark, root = events.sparkSession, shared_folder(events.sparkSession, "release")
    events.write.partitionBy("event_type").option("header", True).csv(f"{root}/csv_rows")
    events.write.partitionBy("event_type").json(f"{root}/jsonl_records")
    found = manifest.files(spark, root, "part-*").select("path", F.split_part("path", F.lit("/"), F.lit(1)).alias("method"), F.regexp_extract("path", "event_type=([^/]*)/", 1).alias("event_type"))
    n, odd = F.col("n"), F.col("method") == "csv_rows"
    listed = found.join(events.groupBy("event_type").agg(F.count("*").alias("n")), "event_type").select("path", "method", (n + (n % 2 == odd.cast("int")).cast("int")).alias("records"))
    faults = manifest.record_violations(listed, manifest.record_counts(spark, root, listed))
    return faults.join(found, faults["key"] == found["path"]).select("method", "event_type", "rule", "detail")
