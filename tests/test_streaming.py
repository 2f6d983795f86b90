import datetime as dt

from tracewright.operators import tokens
from tracewright.streaming import counts

SCHEMA = "file_name string, line_no int, msg string, read_at timestamp"


def test_streams_equal_batch(spark, tmp_path):
    rows = [(f"f{i % 3}", i, f"type=SYSCALL uid={i % 2}" if i % 4 else None, dt.datetime(2025, 1, 1, i % 5, 0)) for i in range(40)]
    batch = spark.createDataFrame(rows, SCHEMA)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = counts.running_counts(stream).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("running").collect()}
    assert got == {tuple(r) for r in tokens.counts_per_file(batch).collect()}
    q = counts.windowed_counts(stream, late="1 day").writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("windows").collect():
        last[r["start"], r["token"]] = max(r["count"], last.get((r["start"], r["token"]), 0))
    assert sum(last.values()) == 2 * 30
