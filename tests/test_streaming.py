"""Sessions on streams: equal to the batch, late events dropped, open sessions kept over restarts."""

from datetime import datetime, timedelta

from sparkwarden.streaming.sessions import sessions, write_sessions

SCHEMA = "user_id long, ts timestamp, event_type string, value double"
START = datetime(2024, 1, 1)


def rows(*events):
    return [(u, START + timedelta(minutes=m), t, 1.0) for u, m, t in events]


def add(spark, path, name, events):
    spark.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")


def run(spark, path):
    write_sessions(spark.readStream.schema(SCHEMA).parquet(f"{path}/in"), f"{path}/out", f"{path}/state").awaitTermination()
    return sorted((r.user_id, int((r.session_start - START).total_seconds() // 60), r.n, r.kinds) for r in spark.read.parquet(f"{path}/out").collect())


def test_a_stream_in_parts_equals_the_batch(spark, tmp_path):
    path = str(tmp_path)
    first = rows((1, 0, "a"), (1, 60, "b"), (2, 30, "a"), (1, 400, "a"), (2, 410, "c"))
    add(spark, path, "one", first)
    # the watermark is at 350: what ended before it is closed
    assert run(spark, path) == [(1, 0, 2, "a,b"), (2, 30, 1, "a")]
    # joins the open session of user 1, is too late for user 3, and closes the others
    second = rows((1, 380, "b"), (3, 100, "late"), (3, 360, "in time"), (9, 2000, "x"))
    add(spark, path, "two", second)
    want = [(1, 0, 2, "a,b"), (1, 380, 2, "a,b"), (2, 30, 1, "a"), (2, 410, 1, "c"), (3, 360, 1, "in time")]
    assert run(spark, path) == want
    assert run(spark, path) == want  # nothing new, nothing twice
    batch = sessions(spark.createDataFrame([e for e in first + second if e[2] != "late"], SCHEMA)).where("user_id <> 9")
    assert sorted((r.user_id, int((r.session_start - START).total_seconds() // 60), r.n, r.kinds) for r in batch.collect()) == want


def test_nulls_and_no_rows(spark):
    assert sessions(spark.createDataFrame([(None, START, "a", 1.0), (1, None, "a", 1.0)], SCHEMA)).count() == 0
    assert sessions(spark.createDataFrame([(1, START, None, None)], SCHEMA)).first().n == 1
