"""Checkpoint records as a stream that is lost between, amid and behind batches: each key's record is in the table once."""

import pytest
from pyspark.errors import StreamingQueryException

from tallyloom.sources import tables
from tallyloom.streaming import checkpoint

RECORD = "case_id string, model_name string, score double"


def records(spark, rows):
    return spark.createDataFrame(rows, RECORD).coalesce(1)


def taken(spark, table):
    return sorted(((r["case_id"], r["model_name"], r["score"]) for r in checkpoint.resumed(spark, table, RECORD).collect()), key=repr)


@pytest.mark.parametrize("at", ["before the write", "behind the write", "amid the write"])
def test_lost_between_two_batches(spark, tmp_path, at):
    source, table, state = (str(tmp_path / name) for name in ("source", "table", "state"))
    for rows in ([("a", "m", 1.0), ("b", "m", 2.0), ("a", "m", 1.0)], [("b", "m", 9.0), ("c", "m", 3.0), (None, "m", 4.0)], [(None, "m", 5.0), ("d", None, None), ("c", "n", 6.0)]):
        tables.write_checkpoint(records(spark, rows), source)
    merge, seen = checkpoint.merge_batch(table, ["case_id", "model_name"]), []

    def lost(batch, number):
        seen.append(number)
        if number == 1 and at == "before the write":
            raise RuntimeError("lost")
        merge(batch, number)
        if number == 1:
            if at == "amid the write":  # what a task has left when the driver goes
                records(batch.sparkSession, [("zz", "m", 0.0)]).write.mode("overwrite").parquet(f"{table}/batch=1")
            raise RuntimeError("lost")

    stream = checkpoint.record_stream(spark, source, RECORD, files=1)
    with pytest.raises(StreamingQueryException):
        checkpoint.resume(stream, table, ["case_id", "model_name"], state, lost).awaitTermination()
    assert seen == [0, 1]
    checkpoint.resume(checkpoint.record_stream(spark, source, RECORD, files=1), table, ["case_id", "model_name"], state).awaitTermination()
    got = taken(spark, table)
    assert len(got) == 6 and [(c, m) for c, m, _ in got] == sorted([("a", "m"), ("b", "m"), ("c", "m"), ("c", "n"), ("d", None), (None, "m")], key=repr)
    again = taken(spark, table)
    checkpoint.resume(checkpoint.record_stream(spark, source, RECORD, files=1), table, ["case_id", "model_name"], state).awaitTermination()
    assert taken(spark, table) == again == got


def test_records_of_one_key_in_one_batch_and_no_records(spark, tmp_path):
    source, table, state = (str(tmp_path / name) for name in ("source", "table", "state"))
    tables.write_checkpoint(records(spark, []), source)
    checkpoint.resume(checkpoint.record_stream(spark, source, RECORD), table, ["case_id"], state).awaitTermination()
    assert taken(spark, table) == []
    tables.write_checkpoint(records(spark, [("a", "n", 2.0), ("a", "m", 2.0), ("a", "m", 7.0)]), source)
    checkpoint.resume(checkpoint.record_stream(spark, source, RECORD), table, ["case_id"], state).awaitTermination()
    assert taken(spark, table) == [("a", "m", 2.0)]
