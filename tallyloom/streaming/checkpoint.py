"""Checkpoint records as a stream: each request's record once, however often its file or batch comes again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def record_stream(spark: SparkSession, path: str, record: str, files: int = 1000) -> DataFrame:
    """Records of new checkpoint files {"schema_version", "record"} in a folder, at most so many files a batch; lines that aren't whole are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    return lines.select(F.from_json("value", f"schema_version string, record struct<{record}>").alias("x")).where("x.record is not null").select("x.record.*")


def first_records(stream: DataFrame, keys: list[str], time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first record of each key. With an event time, state is kept as long as records may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if time else stream.dropDuplicates(keys)


def materialize(stream: DataFrame, path: str, state: str) -> StreamingQuery:
    """Append all that is there to a Parquet table, exactly once by the state folder, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()


def merge_batch(table: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch function that adds each key's record to a Parquet table once, in a folder `batch=N` of its own.

    A batch looks for its keys in the folders of earlier batches only and replaces its own, so a batch that comes again after a loss, whether before, amid or
    behind its write, leaves the same rows. Of several records of a key in one batch the least by its JSON stays; null keys equal each other. Keys are
    kept in no state: the table itself is what is known, and only its key columns are read."""

    def merge(batch: DataFrame, number: int) -> None:
        schema = T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])
        known = batch.sparkSession.read.schema(schema).parquet(table).where(F.col("batch") < number)
        known = known.select(*[F.col(k).alias(f"__{k}") for k in keys])
        row = F.struct(*batch.columns)
        one = batch.groupBy(*keys).agg(F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias("__row")).select("__row.*")
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        one.join(known, same, "left_anti").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return merge


def resume(stream: DataFrame, table: str, keys: list[str], state: str, merge: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Take all that is there into the table by merge_batch(), go on from where the state folder says, and stop."""
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("append").parquet(table)  # a folder to read from, before the first batch
    return stream.writeStream.foreachBatch(merge or merge_batch(table, keys)).option("checkpointLocation", state).trigger(availableNow=True).start()


def resumed(spark: SparkSession, table: str, record: str) -> DataFrame:
    """The records that resume() has taken."""
    return spark.read.schema(f"{record}, batch bigint").parquet(table).drop("batch")


def windowed_operations(events: DataFrame, time: str, model: str, seconds: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Requests and latency per model and event-time window, closed when the watermark passes it."""
    at = F.window(time, width)
    return events.withWatermark(time, late).groupBy(at, model).agg(F.count(F.lit(1)).alias("requests"), F.avg(seconds).alias("average_seconds"), F.max(seconds).alias("max_seconds")).select(F.col("window.start").alias("start"), model, "requests", "average_seconds", "max_seconds")


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items without a record yet, so that a restart repeats none."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")
