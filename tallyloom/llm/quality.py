"""Quality classifier: ordinal cumulative-link regression of graded ratings on hashed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .hashtext import SAMPLE_DOCS, fit_cumulative_link, sampled, scored

#: Grades: 0 harmful, 1 poor, 2 good.
GRADES = 3
#: A document is kept when the probability of the highest grade reaches it.
KEEP = 0.5


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels (doc_id, quality, toxic): toxic ones 0, else of low quality 1, else 2.
    A row with either rating missing is left out, unless it is known to be toxic."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("toxic").isNull(), None).otherwise(F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2))
    return labels.select("doc_id", grade.cast("int").alias("grade")).where("grade is not null")


def _rated(docs: DataFrame, labels: DataFrame, sample_docs: int) -> tuple[DataFrame, str, Column, Column]:
    """docs with a linear score, the name of its column, and the expected grade and tail probability on it."""
    name = fresh(docs, "linear_score")
    above = lambda cut: 1 / (1 + F.exp(F.lit(float(cut)) - F.col(name)))
    design, grade, _, weight = sampled(docs, grades(labels), sample_docs)
    if len(set(grade.tolist())) < 2:
        return docs.withColumn(name, F.lit(0.0)), name, F.lit(float(GRADES - 1)), F.lit(1.0)
    weights, cuts = fit_cumulative_link(design, grade, GRADES, weight)
    return scored(docs, weights, name), name, sum((above(c) for c in cuts[1:]), above(cuts[0])), above(cuts[-1])


def rate(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """docs with expected_grade (0 to 2), tail_probability (of the highest grade) and kept, in place of columns of these names.

    The model is fitted on at most sample_docs labelled documents of each grade. Every row of docs
    is rated on its whole text and stays, with all its columns; repeated rows are rated alike. A null or
    empty text has no features and scores 0 before the thresholds. Without labels of two grades there is no
    model: all tail probabilities are 1 and all rows are kept. An empty table gives an empty result."""
    out, name, expected, tail = _rated(docs, labels, sample_docs)
    return out.withColumns({"expected_grade": expected, "tail_probability": tail, "kept": tail >= keep}).drop(name)


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of docs whose tail probability reaches keep, as they are; without a model, all of them.

    Null and empty texts, ties, repeated rows and empty tables are as in rate(); columns may have any name."""
    out, name, _, tail = _rated(docs, labels, sample_docs)
    return out.where(tail >= keep).drop(name)
