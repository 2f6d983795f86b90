"""Rebuilding conversations from message rows, as keyed streaming state.

Rows of a session log are read as a stream and reduced in the JVM to what validation needs: speaker,
whether a message has text or calls, ids of calls and answers, and a digest of its texts. No text goes
through the shuffle or into state; a line takes some tens of bytes there. State is keyed by session: a list
that lines are appended to in any order, so no batch rewrites what earlier ones brought. A session is
validated and emitted once: when a closing line is there and no line before it is missing, or when the
watermark passes the timer set by its last line, so late lines are waited for. State lies in RocksDB.

The event time of a row in a live stream is a time of its delivery, as ``logged_at`` may be null or wrong.
``replay`` runs a bounded table through the stream: all its rows have one event time, whenever their files
were written, so no session times out before all files are read; then an end-of-input row moves the
watermark beyond every timeout.

Defined cases: a line delivered again (same entry) counts once; null or blank texts are no text; rows
without a session or line number belong to no session; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewright.runtime import scratch

# The names of the speakers, in lower case and without blanks, underscores and hyphens.
SPEAKERS = {
    "user": ("user", "human"),
    "assistant": ("assistant", "ai", "agent", "model"),
    "tool": ("tool", "toolresult", "environment"),
    "system": ("system",),
}
DELAY = "1 hour"
IDLE_MS = 3_600_000
READ = "2000-01-01 00:00:00"
END = "2200-01-01 00:00:00"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

TURNS = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("turn_no", T.LongType()),
        T.StructField("entry_id", T.LongType()),
        T.StructField("speaker", T.StringType()),
    ]
)


def speaker_of(role: Column) -> Column:
    """The speaker behind a role under any of its names; ``other`` if it is none, null if it is null."""
    name = F.regexp_replace(F.lower(role), r"[\s_\-]+", "")
    out = F.when(role.isNull(), None)
    for speaker, names in SPEAKERS.items():
        out = out.when(name.isin(*names), speaker)
    return out.otherwise("other")


def lines_for_state(log: DataFrame, seen_at: Column) -> DataFrame:
    """The columns that state keeps of each row of a session log (batch or stream)."""
    items = F.coalesce(F.col("message.content"), F.array().cast(log.schema["message"].dataType["content"].dataType))
    texts = F.transform(F.filter(items, lambda i: (i["type"] == "text") & i["text"].rlike(r"\S")), lambda i: i["text"])
    calls = F.filter(items, lambda i: i["type"] == "toolCall")
    speaker = speaker_of(F.col("message.role"))
    number, answers = F.col("line_no").cast("bigint"), F.array_distinct(F.filter(F.transform(items, lambda i: i["id"]), lambda i: i.isNotNull()))
    line = F.struct(
        number,
        F.col("entry_id").cast("bigint"),
        F.coalesce(F.col("type") == "message", F.lit(False)),
        speaker,
        F.size(texts) > 0,
        F.when(F.size(texts) > 0, F.md5(F.to_json(F.struct(texts.alias("t"))))),
        F.transform(calls, lambda i: i["id"]),
        F.when(speaker == "tool", answers).otherwise(F.array().cast("array<string>")),
    )
    return log.filter(F.col("session_id").isNotNull() & F.col("line_no").isNotNull()).select(
        "session_id", number.alias("line_no"), F.to_json(line, {"ignoreNullFields": "false"}).alias("line"), F.col("type").alias("kind"), seen_at.cast("timestamp").alias("seen_at")
    )


def line_values(line: str) -> tuple:
    """(line_no, entry_id, is_message, speaker, has_text, digest, calls, answers) of a line as kept in state."""
    *plain, calls, answers = json.loads(line).values()
    return (*plain, tuple(calls), tuple(answers))


def sound_turns(lines: Iterable[tuple]) -> list[tuple[int, str]] | None:
    """The kept turns (entry_id, speaker) of a session in order; None if the session is not sound.

    lines: (line_no, entry_id, is_message, speaker, has_text, digest, calls, answers), in any order,
    repeats allowed.
    """
    rows = sorted(set(lines), key=lambda r: (r[0], r[1] is not None, r[1]))
    numbers = {r[0] for r in rows}
    if not numbers or min(numbers) < 1 or len(numbers) != max(numbers):
        return None
    kept: list[tuple[int, str]] = []
    asked: set = set()
    open_calls: set = set()
    before = None
    waiting = any_user = False
    for _, entry, is_message, speaker, has_text, digest, calls, answers in rows:
        if not is_message:
            continue
        if speaker is None:
            return None
        if speaker == "other":
            continue
        if speaker == "tool":
            if not answers or any(a not in asked for a in answers):
                return None
            open_calls.difference_update(answers)
        else:
            if not has_text and not calls:
                continue
            if speaker == "assistant" and not calls and before == ("assistant", digest):
                continue
        if None in calls:
            return None
        asked.update(calls)
        open_calls.update(calls)
        if speaker == "user":
            if waiting:
                return None
            waiting = any_user = True
        elif speaker == "assistant":
            waiting = False
        before = (speaker, digest)
        kept.append((entry, speaker))
    if waiting or not any_user or open_calls:
        return None
    return kept


class Conversations(StatefulProcessor):
    """Lines of a session kept as a list, validated on closure or timeout."""

    def __init__(self, closing: tuple[str, ...], idle_ms: int):
        self.closing, self.idle_ms = closing, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "line string, until bigint")
        self.closed = handle.getValueState("closed", "line_no bigint, emitted boolean")

    def emitted(self, session: str, lines: Iterable[tuple]) -> Iterator[Row]:
        for i, (entry, speaker) in enumerate(sound_turns(lines) or (), 1):
            yield Row(session_id=session, turn_no=i, entry_id=entry, speaker=speaker)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh, last, closed_at = {}, 0, 0
        for r in rows:
            if r.line is None:  # the end-of-input row
                return
            fresh[r.line] = None
            last = max(last, r.seen_ms or 0)
            if r.kind in self.closing:
                closed_at = max(closed_at, r.line_no)
        until = max(last, timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        closed, was_emitted = (self.closed.get() or (0, False)) if self.closing else (0, False)
        if not was_emitted:
            self.lines.appendList([(line, until) for line in fresh])
        if closed_at > closed:
            closed = closed_at
            self.closed.update((closed, was_emitted))
        if closed and not was_emitted:
            lines = [line_values(x[0]) for x in self.lines.get()]
            if {x[0] for x in lines} >= set(range(1, closed + 1)):
                yield from self.emitted(key[0], lines)
                self.lines.clear()
                self.closed.update((closed, True))
        self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        lines = list(self.lines.get())
        if any(until > now for _, until in lines):  # a later line came
            return
        yield from self.emitted(key[0], [line_values(line) for line, _ in lines])
        self.lines.clear()
        if self.closing:
            self.closed.clear()

    def close(self) -> None:
        pass


def conversation_stream(lines: DataFrame, closing: tuple[str, ...] = (), delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """Validated turns of a stream of ``lines_for_state`` rows, emitted on closure or timeout.

    closing: types of rows that end a session. A session is emitted once; rows that come after that
    and before its timeout are ignored, later ones open a new session. Sets the session's state store to RocksDB.
    """
    lines.sparkSession.conf.set(*STORE)
    return (
        lines.withColumn("seen_ms", F.unix_millis("seen_at"))
        .withWatermark("seen_at", delay)
        .groupBy("session_id")
        .transformWithState(Conversations(closing, idle_ms), TURNS, "Append", "EventTime")
    )


def replay(spark: SparkSession, path: str, closing: tuple[str, ...] = (), files_per_batch: int | None = None) -> DataFrame:
    """All sound conversations of the session log at ``path``: ``session_id, turn_no, entry_id, speaker``.

    The table is streamed with its own checkpoint in the shared folder, so a lost driver can go on. An
    end-of-input row moves the watermark beyond every timeout once all rows are read. In one batch,
    the default, it is read with them, as the watermark moves only after a batch; with
    ``files_per_batch`` the files are read in parts and the row follows in a second run of the same query.
    The result does not depend on the batches: rows of a table have the event time ``READ``, so that the
    watermark stays before every timeout until that row.
    """
    path = path.rstrip("/")
    schema = spark.read.parquet(path).schema
    home = scratch(spark, "conversations")
    # A file source takes a table of a single file only by a pattern; this one matches just the path.
    source = spark.readStream.schema(schema)
    log = (source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source).parquet(f"{path[:-1]}[{path[-1]}]")
    lines = lines_for_state(log, F.lit(READ))
    end = spark.createDataFrame([("", 0)], "session_id string, line_no bigint").select(
        "session_id", "line_no", F.lit(None).cast("string").alias("line"), F.lit(None).cast("string").alias("kind"), F.lit(END).cast("timestamp").alias("seen_at")
    )
    end.limit(0).write.parquet(f"{home}/end")
    both = lines.unionByName(spark.readStream.schema(lines.schema).parquet(f"{home}/end"))
    turns = conversation_stream(both, closing)
    for last in (False, True) if files_per_batch else (True,):
        if last:
            end.coalesce(1).write.mode("append").parquet(f"{home}/end")
        turns.writeStream.format("parquet").option("path", f"{home}/turns").option("checkpointLocation", f"{home}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(TURNS).parquet(f"{home}/turns")


def conversations(turns: DataFrame, log: DataFrame) -> DataFrame:
    """Turns with their role and content, joined from the log by entry."""
    said = log.filter(F.col("entry_id").isNotNull()).select("entry_id", F.col("message.content").alias("content")).dropDuplicates(["entry_id"])
    return turns.join(said, "entry_id", "left").select("session_id", "turn_no", "entry_id", "speaker", "content")
