"""Contracts of tasks, prices, evidence records and merges, as violation tables (rule, key, detail) or columns."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..functions.variants import fields, let, number_of, strict_json, text_of, unfenced
from .validate import _found, blank_keys, duplicate_keys, unknown_values, violations

#: What an evidence record may be, and how ids are written.
EVIDENCE_STATUSES, SOURCE_KINDS, RECORD_ID = ["current", "stale", "superseded"], ["living", "versioned", "static", "local"], r"^[a-z0-9]+(?:[._-][a-z0-9]+)*$"
#: Texts that an evidence record has to have.
EVIDENCE_TEXTS = ["title", "evidence_type", "document", "section", "version_scope", "review_trigger"]
IDENTIFIER, VERSION = r"^[a-z0-9][a-z0-9._-]*$", r"^\d+\.\d+\.\d+$"


def case_violations(cases: DataFrame, required: list[str], splits: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Cases of a task: required columns, case_ids that are neither blank nor repeated, evaluation types, splits, and the columns that a prompt's
    names (see manifest.placeholders) need."""
    missing = sorted({*required, *(names or [])} - set(cases.columns))
    if missing:
        return cases.sparkSession.createDataFrame([("missing column", c, "absent") for c in missing], "rule string, key string, detail string")
    found = [blank_keys(cases, "case_id"), duplicate_keys(cases, ["case_id"])]
    if "evaluation_type" in cases.columns:
        found.append(unknown_values(cases.withColumn("evaluation_type", F.lower(F.trim("evaluation_type"))), "evaluation_type", ["exact", "json", "judge"]))
    if splits:
        found.append(unknown_values(cases, "split", splits))
    return violations(*found)


def judge_response(text: Column, criteria: dict[str, float], low: float = 0.0, high: float = 1.0) -> Column:
    """struct(score, scores, reason, error) of a judge's JSON answer {"criteria": {name: {"score", "reason"}}, "overall_reason"}.

    criteria: weights by name; each has to be there, no other may be, with a number from low to high and a reason. score is the weighted mean of the scores
    brought to 0 to 1. error, null for a valid answer, says the first fault; then the others are null."""
    if high <= low:
        raise ValueError("the highest score must be above the lowest")
    filled = lambda value: F.coalesce(F.length(trimmed(text_of(value))) > 0, F.lit(False))
    names, weights = F.lit(sorted(criteria)), sum(criteria.values())

    def judged(answer: Column, given: Column, each: Column, overall: Column) -> Column:
        """answer and given: fields; each: (score, reason, whole) by name, in order of criteria."""
        missing, more = F.array_except(names, F.map_keys(given)), F.array_except(F.map_keys(given), names)
        error = F.when(answer.isNull(), "not a JSON object").when(given.isNull(), "criteria are no object")
        error = error.when(F.size(missing) > 0, F.concat(F.lit("missing criteria: "), F.array_join(missing, ", "))).when(F.size(more) > 0, F.concat(F.lit("unexpected criteria: "), F.array_join(F.array_sort(more), ", ")))
        scores, total = [], F.lit(0.0)
        for k, (name, weight) in enumerate(criteria.items()):
            one = F.get(each, F.lit(k))
            error = error.when(~one["whole"], f"{name}: no object").when(one["score"].isNull(), f"{name}: score is no number").when(~one["score"].between(low, high), f"{name}: score out of range").when(~one["filled"], f"{name}: no reason")
            scores += [F.lit(name), one["score"]]
            total += weighted_share(one["score"], low, high) * weight
        error = error.when(~filled(overall), "no overall reason")
        return let(error, lambda e: F.struct(F.when(e.isNull(), total / weights if weights else F.lit(0.0)).alias("score"), F.when(e.isNull(), F.create_map(*scores)).alias("scores"), F.when(e.isNull(), text_of(overall)).alias("reason"), e.alias("error")))

    def one_of(given: Column, name: str) -> Column:
        part = lambda f: F.struct(number_of(F.element_at(f, F.lit("score"))).alias("score"), filled(F.element_at(f, F.lit("reason"))).alias("filled"), f.isNotNull().alias("whole"))
        return let(fields(F.element_at(given, F.lit(name))), part)

    def of(answer: Column) -> Column:
        given = fields(F.element_at(answer, F.lit("criteria")))
        return let(given, lambda g: let(F.array(*[one_of(g, name) for name in criteria]), lambda each: judged(answer, g, each, F.element_at(answer, F.lit("overall_reason")))))

    none = F.struct(F.lit(None).cast("double").alias("score"), F.lit(None).cast("map<string,double>").alias("scores"), F.lit(None).cast("string").alias("reason"), F.lit("no answer").alias("error"))
    return F.when(text.isNull(), none).otherwise(let(fields(strict_json(unfenced(text))), of))


def weighted_share(score: Column, low: float, high: float) -> Column:
    """A score as a share of its range, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - low) / (high - low)))


def price_status(rate_in: Column, rate_out: Column, effective: Column, as_of: datetime.date, stale_days: int = 180) -> Column:
    """What a price is worth: blocked where a rate is missing or negative, or it is not yet in force; stale where it is old; free
    where both rates are 0; else ready."""
    age = F.datediff(F.lit(as_of), effective)
    blocked = ~F.coalesce((rate_in >= 0) & (rate_out >= 0) & (age >= 0), F.lit(False))
    return F.when(blocked, "blocked").when(age > stale_days, "stale").when((rate_in == 0) & (rate_out == 0), "free").otherwise("ready")


def evidence_violations(records: DataFrame) -> DataFrame:
    """Evidence records (id, title, evidence_type, source_kind, status, last_reviewed, review_by, document, section, source_urls array, version_scope,
    review_trigger, superseded_by, supersession_note).

    Ids are well formed and not repeated, texts are filled, statuses and kinds known in any case, dates in order; links are HTTP and, but for local
    sources, there; a superseded record, and no other, names a known successor other than itself, or says in a note what became of it."""
    key = F.coalesce(F.col("id"), F.lit("<null>"))
    filled = lambda c: F.coalesce(F.length(trimmed(F.col(c))) > 0, F.lit(False))
    superseded = F.coalesce(F.lower(trimmed(F.col("status"))) == "superseded", F.lit(False))
    local = F.coalesce(F.lower(trimmed(F.col("source_kind"))) == "local", F.lit(False))
    said = filled("superseded_by") | filled("supersession_note")
    linked = F.coalesce(F.forall("source_urls", lambda u: F.coalesce(trimmed(u).rlike(r"^https?://[^/\s]+"), F.lit(False))), F.lit(False))
    blank = F.array_compact(F.array(*[F.when(~filled(c), c) for c in EVIDENCE_TEXTS]))
    found = [
        (~F.coalesce(trimmed(F.col("id")).rlike(RECORD_ID), F.lit(False)), "record id", F.col("id")),
        (F.size(blank) > 0, "blank text", F.array_join(blank, ",")),
        (~F.coalesce(F.col("review_by") >= F.col("last_reviewed"), F.lit(False)), "date order", F.col("review_by").cast("string")),
        (~linked | ((F.size("source_urls") == 0) & ~local), "link", F.concat_ws(",", "source_urls")),
        (superseded & ~said, "superseded without successor or note", F.lit("")),
        (~superseded & (F.col("superseded_by").isNotNull() | F.col("supersession_note").isNotNull()), "supersession of a record that is not superseded", F.coalesce("superseded_by", "supersession_note")),
        (F.coalesce(F.col("superseded_by") == F.col("id"), F.lit(False)), "supersedes itself", F.col("superseded_by")),
    ]
    each = F.filter(F.array(*[F.struct(bad.alias("bad"), F.lit(rule).alias("rule"), detail.alias("detail")) for bad, rule, detail in found]), lambda x: x["bad"])
    rows = records.select(key.alias("key"), F.explode(each).alias("x")).select("x.rule", "key", "x.detail")  # all rules of a row in one scan
    known = records.select(F.col("id").alias("known")).distinct()
    gone = records.where("superseded_by is not null").join(known, F.col("superseded_by") == F.col("known"), "left_anti")
    plain = lambda c: records.withColumn(c, F.lower(trimmed(F.col(c))))
    return violations(
        rows, duplicate_keys(records, ["id"]), unknown_values(plain("status"), "status", EVIDENCE_STATUSES), unknown_values(plain("source_kind"), "source_kind", SOURCE_KINDS),
        _found(gone, "unknown successor", key, F.col("superseded_by")),
    )


def evidence_status(records: DataFrame, as_of: datetime.date) -> DataFrame:
    """records with effective_status (a current record past its review date is stale) and overdue_days."""
    late = F.greatest(F.datediff(F.lit(as_of), F.col("review_by")), F.lit(0))
    replaced = F.lower("status") == "superseded"
    return records.withColumns({"effective_status": F.when(replaced, "superseded").when(late > 0, "stale").otherwise("current"), "overdue_days": F.when(replaced, 0).otherwise(late)})


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails the query where a key is repeated on a side or stands on one side only."""
    count = F.count(F.lit(1))
    a = left.groupBy(*keys).agg(count.alias("in_left"))
    b = right.groupBy(*keys).agg(count.alias("in_right"))
    both = a.join(b, keys, "full_outer").where("not (in_left <=> 1 and in_right <=> 1)")
    name = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("<null>")) for k in keys])
    wrong = both.select(F.min(name).alias("wrong"))  # one row, null if all is well
    guard = wrong.select(F.when(F.col("wrong").isNotNull(), F.raise_error(F.concat(F.lit("not one to one: "), F.col("wrong"))).cast("boolean")).otherwise(F.lit(True)).alias("fine"))
    return left.join(right, keys).join(F.broadcast(guard), F.col("fine")).drop("fine")


def resolved_evidence(claims: DataFrame, reports: DataFrame) -> DataFrame:
    """claims (claim_id, report_sha256, contract) with the level of the judge report of that hash and contract, and `evidence`: matched,
    other_contract, or absent. A report of several rows counts with its least level."""
    one = reports.groupBy(F.col("sha256").alias("report_sha256"), F.col("contract").alias("reported")).agg(F.min("level").alias("level"))
    any_of = reports.select(F.col("sha256").alias("report_sha256"), F.lit(True).alias("known")).distinct()
    met = claims.join(one, (claims["report_sha256"] == one["report_sha256"]) & (claims["contract"] == one["reported"]), "left").select(claims["*"], "level")
    return met.join(any_of, "report_sha256", "left").withColumn("evidence", F.when(F.col("level").isNotNull(), "matched").when(F.col("known"), "other_contract").otherwise("absent")).drop("known")
