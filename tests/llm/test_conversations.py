import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tracewright.llm import conversations as cv

ITEM = "struct<type:string,text:string,id:string,name:string,arguments:string>"
SCHEMA = f"entry_id bigint, session_id string, line_no int, logged_at timestamp, type string, message struct<role:string,api:string,content:array<{ITEM}>>"


def text(t):
    return ("text", t, None, None, None)


def call(i):
    return ("toolCall", None, i, "n", "{}")


def answer(i):
    return ("text", "out", i, None, None)


def session(name, *messages, start=0):
    """Rows of a session: (role, items), or a type name for lines that are no messages."""
    rows = []
    for i, m in enumerate(messages, 1):
        body = None if isinstance(m, str) else (m[0], None, m[1])
        rows.append((start + i, name, i, None, m if isinstance(m, str) else "message", body))
    return rows


SOUND = ("session", ("Human", [text("hi")]), ("ai", [text("let me see"), call("1")]), ("tool_result", [answer("1")]), ("model", [text("done")]))


def run(spark, tmp_path, rows, parts=3, **options):
    path = str(tmp_path / "log.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(path)
    return sorted(tuple(r) for r in cv.replay(spark, path, **options).collect())


def test_sound_and_unsound(spark, tmp_path):
    u, a = ("user", [text("q")]), ("assistant", [text("r")])
    cases = {
        "sound": (SOUND, [2, 3, 4, 5]),
        "repeat": ((u, a, a, ("debug", [text("x")]), ("assistant", [text("  ")]), a), [1, 2]),
        "blank": ((("system", [text("s")]), u, ("user", [text(" \n")]), a), [1, 2, 4]),
        "call_repeat": ((u, a, ("assistant", [text("r"), call("k")]), ("tool", [answer("k")])), [1, 2, 3, 4]),
        "no_reply": ((u, u, a), None),
        "no_reply_at_end": ((u, a, u), None),
        "no_user": ((a,), None),
        "unanswered": ((u, ("assistant", [call("k")])), None),
        "answered_before": ((u, ("tool", [answer("k")]), ("assistant", [call("k")])), None),
        "no_id": ((u, a, ("tool", [text("x")])), None),
        "null_role": ((u, a, (None, [text("x")])), None),
        "empty": (("session",), None),
    }
    rows, want = [], []
    for k, (name, (messages, kept)) in enumerate(cases.items()):
        mine = session(name, *messages, start=k * 100)
        rows += mine + mine[:2]
        want += [(name, i, k * 100 + e) for i, e in enumerate(kept or [], 1)]
    rows += [(900, "lost", 2, None, "message", ("user", None, [text("q")])), (901, "lost", 3, None, "message", ("assistant", None, [text("q")]))]
    rows += [(902, "null", 1, None, "message", None), (903, None, 1, None, "message", None), (904, "null", None, None, "message", None)]
    rows.reverse()
    assert [r[:3] for r in run(spark, tmp_path, rows)] == sorted(want)
    again = cv.replay(spark, str(tmp_path / "log.parquet"), files_per_batch=1)
    assert sorted(tuple(r)[:3] for r in again.collect()) == sorted(want)


def test_empty_and_long(spark, tmp_path):
    assert run(spark, tmp_path, [], parts=1) == []
    (tmp_path / "b").mkdir()
    turns = [m for i in range(3000) for m in (("user", [text("x" * 100 + str(i))]), ("assistant", [text(str(i))]))]
    assert len(run(spark, tmp_path / "b", session("hot", *turns))) == 6000


def test_closure_timeout_and_late_lines(spark, tmp_path):
    """Event times drive a stream of three files: one session closes by its line, one by timeout, one line is late."""
    src, out = tmp_path / "in", tmp_path / "out"
    at = lambda m: dt.datetime(2025, 1, 1, 0, m)
    closing = session("closed", *SOUND, "end")
    idle = session("idle", *SOUND, start=50)
    files = [closing[:3] + idle[:2], closing[3:] + idle[2:], session("other", *SOUND, start=80)]
    for k, rows in enumerate(files):
        rows = [(*r[:3], at(0 if k < 2 else 59), *r[4:]) for r in reversed(rows)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        newest = max((p for p in src.glob("*.parquet")), key=lambda p: p.stat().st_ctime_ns)
        os.utime(newest, (1_700_000_000 + k * 10, 1_700_000_000 + k * 10))
    log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    stream = cv.conversation_stream(cv.lines_for_state(log, F.col("logged_at")), closing=("end",), delay="1 minute", idle_ms=60_000)
    stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted({r["session_id"] for r in spark.read.parquet(str(out)).collect()})
    assert got == ["closed", "idle"]  # "other" is still waited for


def test_batches_of_files_written_days_apart(spark, tmp_path):
    """A session with rows in files of different days is whole, in any number of batches."""
    src = tmp_path / "log.parquet"
    rows = session("split", *SOUND) + session("late", *SOUND, start=50)
    others = [session(f"other{k}", *SOUND, start=80 + k * 10) for k in range(3)]
    files = [rows[:2] + rows[7:9], *others, rows[2:7] + rows[9:]]
    for k, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        newest = max(src.glob("*.parquet"), key=lambda p: p.stat().st_ctime_ns)
        os.utime(newest, (1_700_000_000 + k * 259_200,) * 2)
    once, parts = (sorted(tuple(r) for r in cv.replay(spark, str(src), files_per_batch=n).collect()) for n in (None, 1))
    assert parts == once and {r[0] for r in parts} == {"split", "late", "other0", "other1", "other2"} and len(parts) == 20


@pytest.mark.parametrize("name,speaker", [("Tool_Result", "tool"), (" USER", "user"), ("telemetry", "other"), (None, None)])
def test_speakers(spark, name, speaker):
    assert spark.createDataFrame([(name,)], "r string").select(cv.speaker_of(F.col("r"))).first()[0] == speaker
