"""Files against their manifests: sizes, hashes, counts, membership, archives and attachments, as violation tables."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import casefolded

#: The largest archive and attachment, what an archive may hold, and how many attachments a case may have.
MAX_ARCHIVE, MAX_UNPACKED, MAX_ATTACHED, MAX_ATTACHMENTS = 100 << 20, 250 << 20, 50 << 20, 50
VIOLATION = "rule string, key string, detail string"
SHA256 = r"^[0-9a-f]{64}$"


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files below a folder, path relative to it. A file is read by one task, and only its hash goes on."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = F.lit(root.rstrip("/").removeprefix("file://") + "/")
    return found.select(F.expr("path").alias("full"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).select(F.split_part("full", base, F.lit(-1)).alias("path"), "bytes", "sha256")


def contained(path: Column) -> Column:
    """Whether a relative path stays below its root: not absolute, no drive, and no step upwards."""
    return ~path.rlike(r"^([/\\]|[A-Za-z]:)") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)") & (F.length(F.trim(path)) > 0)


def manifest_violations(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(rule, key, detail) of a manifest (path, bytes, sha256) against files(): paths out of the root, files that are missing or not
    listed, listed twice, of another size or hash, and hashes that are none."""
    out = lambda df, rule, detail: df.select(F.lit(rule).alias("rule"), F.col("path").alias("key"), detail.cast("string").alias("detail"))
    both = listed.select("path", F.col("bytes").alias("want"), F.col("sha256").alias("hash")).join(found, "path", "full_outer")
    met = both.where("hash is not null and sha256 is not null")
    return (
        out(listed.where(~F.coalesce(contained(F.col("path")), F.lit(False))), "outside the root", F.lit("path"))
        .unionByName(out(listed.where(~F.coalesce(F.col("sha256").rlike(SHA256), F.lit(False))), "not a hash", F.col("sha256")))
        .unionByName(out(listed.groupBy("path").count().where("count > 1"), "listed twice", F.col("count")))
        .unionByName(out(both.where("sha256 is null"), "missing file", F.col("want")))
        .unionByName(out(both.where("hash is null"), "not listed", F.col("bytes")))
        .unionByName(out(met.where("want <> bytes"), "size", F.concat_ws(" of ", "bytes", "want")))
        .unionByName(out(met.where("hash <> sha256"), "hash", F.col("sha256")))
    )


def record_counts(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """(path, records) of the files that a manifest (path, method) counts by csv_rows or jsonl_records: rows behind a header, where quoted line breaks
    do not count, or lines that aren't blank. All files of a method are one scan; lines of a file are counted by as many tasks as it has splits. A file without records has none here.

    Rows of nothing but separators count as records, and lines aren't parsed."""
    base = F.lit(root.rstrip("/").removeprefix("file://") + "/")
    readers = {"csv_rows": lambda paths: spark.read.csv(paths, header=True, multiLine=True, escape='"'), "jsonl_records": lambda paths: spark.read.text(paths).where(F.trim("value") != "")}
    out = spark.createDataFrame([], "path string, records long")
    names: dict[str, list[str]] = {}
    for r in listed.where(contained(F.col("path"))).where(F.col("method").isin(*readers)).select("method", "path").distinct().collect():  # a manifest's rows are a release's files
        names.setdefault(r["method"], []).append(f"{root.rstrip('/')}/{r['path']}")
    for method, paths in names.items():
        path = F.split_part(F.url_decode("_metadata.file_path"), base, F.lit(-1)).alias("path")
        out = out.unionByName(readers[method](sorted(paths)).select(path).groupBy("path").agg(F.count(F.lit(1)).alias("records")))
    return out


def record_violations(listed: DataFrame, counts: DataFrame) -> DataFrame:
    """(rule, key, detail) of a manifest (path, records, method) against record_counts(): a count where the method is not_applicable, no count where there is
    one, and another number of records."""
    none = F.col("method") == "not_applicable"
    said = listed.select("path", F.col("records").alias("want"), "method")
    met = said.join(counts, "path", "left").withColumn("have", F.coalesce("records", F.lit(0)))
    rule = F.when(none & F.col("want").isNotNull(), "count without a method").when(~none & F.col("want").isNull(), "no count").when(~none & (F.col("want") != F.col("have")), "record count")
    return met.select(rule.alias("rule"), F.col("path").alias("key"), F.concat(F.col("have").cast("string"), F.lit(" of "), F.coalesce(F.col("want").cast("string"), F.lit("none"))).alias("detail")).where("rule is not null")


def membership_violations(ids: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """Member ids against those expected, by full case folding: repeated, missing, or extra. Both sides meet in one grouping by folded id."""
    fold = lambda df, here: df.select(casefolded(F.trim(F.col(column).cast("string"))).alias("key"), F.lit(here).alias("here"))
    both = fold(ids, 1).unionByName(fold(expected, 0)).groupBy("key").agg(F.sum("here").alias("mine"), F.sum(1 - F.col("here")).alias("wanted"))
    fault = lambda when, rule, detail: F.when(when, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))
    faults = F.array(
        fault(F.col("mine") > 1, "repeated member", F.col("mine")),
        fault(F.col("mine") == 0, "missing member", F.lit("absent")),
        fault(F.col("wanted") == 0, "extra member", F.lit("not expected")),
    )
    return both.select("key", F.explode(F.array_compact(faults)).alias("x")).select("x.rule", "key", "x.detail")


def _member_faults(archive: zipfile.ZipFile, info: zipfile.ZipInfo, columns: int, day: date) -> list[str]:
    """What is wrong with one member, read as a stream: no member is held whole."""
    if info.flag_bits & 1:
        return ["encrypted"]
    if info.is_dir() or "/" in info.filename or "\\" in info.filename:
        return ["unsafe path"]
    out = [] if datetime(*info.date_time).date() == day else [f"date {datetime(*info.date_time).date()}"]
    rows = blank = wide = 0
    try:
        with archive.open(info) as raw:
            for row in csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""), strict=True):
                if not any(cell.strip() for cell in row):
                    blank += 1
                    continue
                rows += 1
                wide += len(row) != columns
                if any("\x00" in cell for cell in row):
                    return [*out, "NUL bytes"]
    except UnicodeDecodeError:
        return [*out, "not UTF-8"]
    except (csv.Error, OSError, RuntimeError, zipfile.BadZipFile) as error:
        return [*out, f"unreadable: {error}"]
    out += [f"{wide} rows not of {columns} columns"] * bool(wide) + ["no records"] * (not rows) + [f"{blank} blank rows"] * bool(blank)
    return out


def archive_violations(spark: SparkSession, path: str, members: dict[str, int], day: date) -> DataFrame:
    """(rule, key, detail) of ZIP archives: size, unpacked size, repeated, missing and extra members, and, per member, encryption, path, date, UTF-8,
    NUL bytes, CSV, width, records and blank rows. members: columns by name. An archive of bounded size is the work of one task."""

    def run(frames):
        for frame in frames:
            found = []
            for where, size, content in zip(frame["path"], frame["length"], frame["content"], strict=True):
                if size > MAX_ARCHIVE:
                    found.append(("archive size", where, str(size)))
                    continue
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile as error:
                    found.append(("not an archive", where, str(error)))
                    continue
                names = [i.filename for i in archive.infolist()]
                found += [("repeated member", n, where) for n in sorted({n for n in names if names.count(n) > 1})]
                found += [("missing member", n, where) for n in sorted(set(members) - set(names))] + [("extra member", n, where) for n in sorted(set(names) - set(members))]
                unpacked = sum(i.file_size for i in archive.infolist())
                if unpacked > MAX_UNPACKED:
                    found.append(("unpacked size", where, str(unpacked)))
                    continue
                found += [("member", i.filename, fault) for i in archive.infolist() if i.filename in members for fault in _member_faults(archive, i, members[i.filename], day)]
            yield pd.DataFrame(found, columns=["rule", "key", "detail"])

    return spark.read.format("binaryFile").load(path).select("path", "length", "content").mapInPandas(run, VIOLATION)


def attachment_violations(cases: DataFrame, found: DataFrame, types: dict[str, str]) -> DataFrame:
    """cases (case_id, name, bytes, sha256, media_type), a row per attached file, against files(): names with a folder, unknown suffixes or other
    media types, missing files, other sizes or hashes, files beyond the limit, and cases with too many files or bytes."""
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    key = F.concat_ws("|", F.col("case_id").cast("string"), F.col("name"))
    out = lambda df, rule, detail: df.select(F.lit(rule).alias("rule"), key.alias("key"), detail.cast("string").alias("detail"))
    met = cases.join(found.select(F.col("path").alias("name"), F.col("bytes").alias("real"), F.col("sha256").alias("hash")), "name", "left")
    per = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total")).where(f"n > {MAX_ATTACHMENTS} or total > {MAX_ATTACHED}")
    return (
        out(cases.where(F.col("name").rlike(r"[/\\]") | F.col("name").isin("", ".", "..")), "not a file name", F.col("name"))
        .unionByName(out(cases.where(~F.col("media_type").eqNullSafe(F.try_element_at(kinds, suffix))), "media type", F.col("media_type")))
        .unionByName(out(met.where("hash is null"), "missing file", F.col("bytes")))
        .unionByName(out(met.where("bytes <> real"), "size", F.concat_ws(" of ", "real", "bytes")))
        .unionByName(out(met.where("sha256 <> hash"), "hash", F.col("hash")))
        .unionByName(out(cases.where(f"bytes > {MAX_ATTACHED}"), "too large", F.col("bytes")))
        .unionByName(per.select(F.lit("too many").alias("rule"), F.col("case_id").cast("string").alias("key"), F.concat_ws(" files, ", "n", "total").alias("detail")))
    )


def placeholders(template: str) -> list[str]:
    """Names in braces of a prompt template, in order, without doubled braces."""
    return list(dict.fromkeys(m[1] for m in re.finditer(r"\{\{|\}\}|\{([^{}]+)\}", template) if m[1]))
