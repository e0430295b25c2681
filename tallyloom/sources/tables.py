"""Sources and sinks: text tables as strings, archives, logs, bundles."""

from __future__ import annotations

import csv
import io
import json
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validate import blank_keys, duplicate_keys, enforce, require_columns, unknown_values, violations

#: Required columns.
OUTPUT_COLUMNS = ["case_id", "input", "expected_output", "model_name", "model_output"]
GENERATION_COLUMNS = ["case_id", "input"]
CASE_COLUMNS = ["case_id", "input", "expected_output", "evaluation_type"]


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file (gzip by its name) with a header, all columns strings, kept as written: NA and null are text. Names are trimmed.

    columns: only these are read."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="\u0000", emptyValue="", enforceSchema=False)
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.select(*require_columns(df, columns).select(*columns).columns) if columns else df


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation outputs; without evaluation_type every row is judged."""
    df = require_columns(read_csv(spark, path), OUTPUT_COLUMNS)
    return df if "evaluation_type" in df.columns else df.withColumn("evaluation_type", F.lit("judge"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(read_csv(spark, path), CASE_COLUMNS)


def read_generation_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases to generate outputs for, with input as text, a known evaluation_type and ids that are neither blank nor repeated."""
    cases = require_columns(read_csv(spark, path), GENERATION_COLUMNS)
    if "evaluation_type" not in cases.columns:
        cases = cases.withColumn("evaluation_type", F.lit("judge"))
    kinds = F.lower(F.trim("evaluation_type"))
    enforce(violations(blank_keys(cases, "case_id"), duplicate_keys(cases, ["case_id"]), unknown_values(cases.withColumn("evaluation_type", kinds), "evaluation_type", ["exact", "json", "judge"])))
    return cases.withColumns({"case_id": F.trim("case_id"), "evaluation_type": kinds})


def record_count(spark: SparkSession, path: str, kind: str = "lines") -> int:
    """Records of plain or gzip text. lines: those that aren't blank, as of JSON lines; csv: records after the header, where quoted
    line breaks do not count, nor do blank lines."""
    if kind == "csv":
        return spark.read.csv(path, header=True, multiLine=True, escape='"').select(F.lit(1)).count()
    return spark.read.text(path).where(F.trim("value") != "").count()


def members(df: DataFrame, column: str) -> DataFrame:
    """Member ids; a blank one fails the query."""
    said = F.trim(F.col(column).cast("string"))
    return df.select(F.when(F.coalesce(said, F.lit("")) == "", F.raise_error(F.lit(f"blank {column}"))).otherwise(said).alias(column))


def read_archive(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """Rows of a headerless CSV member of ZIP archives: the columns as strings, and row_number from 1. A row of another width fails."""
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField("row_number", T.LongType())])

    def unpack(frames):
        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = list(csv.reader(io.TextIOWrapper(z.open(member), "utf-8-sig", newline=""), strict=True))
                for k, row in enumerate(rows, 1):
                    if len(row) != len(columns):
                        raise ValueError(f"{member}, row {k}: {len(row)} values, not {len(columns)}")
                yield pd.DataFrame([[*row, k] for k, row in enumerate(rows, 1)], columns=schema.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, schema)


#: Fixed value: version of checkpoint lines.
CHECKPOINT_VERSION = "1.0"


def _checkpoint_lines(spark: SparkSession, path: str, record: str) -> DataFrame:
    """value, file_path, x (schema_version, record) of whole lines; a torn line before a file's last fails the query."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("at"))
    parsed = lines.where(F.trim("value") != "").select("*", F.from_json("value", f"schema_version string, record struct<{record}>").alias("x"))
    last = parsed.groupBy("file_path").agg(F.max("at").alias("last"))
    whole = F.get_json_object("value", "$.record").isNotNull()
    marked = parsed.join(last, "file_path")
    torn = F.when(~whole & (F.col("at") < F.col("last")), F.raise_error(F.lit("a checkpoint line before the last is torn")).cast("boolean")).otherwise(whole)
    return marked.where(torn)


def read_checkpoint(spark: SparkSession, path: str, record: str, version: str = CHECKPOINT_VERSION) -> DataFrame:
    """Records of checkpoint lines {"schema_version", "record"}; a torn last line is left out, any other torn line fails, and so
    does a line of another schema version.

    record: DDL of a record."""
    other = ~F.col("x.schema_version").eqNullSafe(F.lit(version))
    said = F.concat(F.lit("checkpoint version "), F.coalesce("x.schema_version", F.lit("none")), F.lit(f" is not {version}"))
    return _checkpoint_lines(spark, path, record).select(F.when(other, F.raise_error(said).cast(f"struct<{record}>")).otherwise(F.col("x.record")).alias("r")).select("r.*")


def write_checkpoint(df: DataFrame, path: str, version: str = CHECKPOINT_VERSION, mode: str = "append") -> None:
    """Append records as checkpoint lines: new files whose appearance Spark commits as a whole, so no line is torn."""
    line = F.to_json(F.struct(F.lit(version).alias("schema_version"), F.struct("*").alias("record")), {"ignoreNullFields": "false"})
    df.select(line.alias("value")).write.mode(mode).text(path)


def repair_checkpoint(spark: SparkSession, path: str, repaired: str, record: str) -> None:
    """Write the whole lines of a checkpoint anew, without a torn last line."""
    _checkpoint_lines(spark, path, record).select("value").write.mode("overwrite").text(repaired)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Samples of evaluation logs {"model", "created", "samples": [{"id", "score", "output"}]}, one row each, the last of each id kept."""
    kind = "model string, created string, samples array<struct<id:string,score:string,output:string>>"
    rows = spark.read.schema(kind).json(path, multiLine=True).select("model", "created", F.explode("samples").alias("s")).select("model", "created", "s.*")
    return rows.groupBy("model", "id").agg(F.max(F.struct("created", "score", "output")).alias("x")).select("model", "id", "x.*")


def records(df: DataFrame) -> DataFrame:
    """Strict JSON of each row; NaN becomes null."""
    clean = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("record"))


def write_bundle(df: DataFrame, path: str, partitions: list[str], manifest: dict) -> None:
    """A result bundle: Parquet partitioned for pruning, and its manifest beside it."""
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/scores")
    text = json.dumps(manifest, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/scores"), json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def shown_double(value: Column, digits: int = 12) -> Column:
    """A double with so many significant digits as C's %g writes it: no zeros at the end, an exponent of two digits at
    least for very small and very large values, null as null."""
    # %e rounds to the digits and so has the exponent that decides the form
    shown = F.format_string(f"%.{digits - 1}e", value)
    exponent = F.split_part(shown, F.lit("e"), F.lit(2)).cast("int")
    plain = lambda text: F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    fixed = None
    for k in range(-4, digits):
        fixed = (F if fixed is None else fixed).when(exponent == k, F.format_string(f"%.{digits - 1 - k}f", value))
    scientific = F.concat(plain(F.split_part(shown, F.lit("e"), F.lit(1))), F.lit("e"), F.split_part(shown, F.lit("e"), F.lit(2)))
    odd = F.when(F.isnan(value), F.lit("")).when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").when(value == 0, F.lit("0"))
    return F.when(value.isNotNull(), odd.when(exponent.between(-4, digits - 1), plain(fixed)).otherwise(scientific))


def write_csv(df: DataFrame, path: str, order: list[str], digits: int = 12) -> None:
    """One ordered CSV file of a small result, doubles with so many significant digits at most, nulls and NaN empty."""
    shown = [shown_double(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema]
    df.orderBy(*order).select(*shown).coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')
