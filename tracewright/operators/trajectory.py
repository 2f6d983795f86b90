"""Trajectories of sessions: messages deduplicated, cut into rounds and rendered as text.

The reference keeps the roles user, assistant and toolResult as written and walks the messages of a
session in order; here ``next to`` rules are windows over (session, line).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as tx

PROFILE = "Agent with access to tools."


def messages(log: DataFrame) -> DataFrame:
    """Messages of a session log, once each: ``session_id, line_no, role, api, content``."""
    return (
        log.filter((F.col("type") == "message") & F.col("message.role").isNotNull() & F.col("message.content").isNotNull())
        .select("session_id", "line_no", "message.role", "message.api", "message.content")
        .distinct()
    )


def deduplicated(msgs: DataFrame) -> DataFrame:
    """Messages without an assistant message that repeats the last kept message.

    It repeats it if the contents are equal, or if a ``cli`` message has the same texts, at least one,
    as an ``openai-completions`` one. Dropped messages do not count as last kept. Equal contents are an
    equivalence, so runs of them need no walk; only runs that mix in the second rule are folded.
    """
    order = Window.partitionBy("session_id").orderBy("line_no")
    run = F.sum(F.when((F.col("role") == "assistant") & (F.lag("role").over(order) == "assistant"), 0).otherwise(1)).over(order)
    rows = msgs.withColumn("digest", F.md5(F.to_json(F.struct("content")))).withColumn("texts", F.md5(F.to_json(F.struct(tx.item_texts(F.col("content")).alias("t"))))).withColumn("spoken", F.size(tx.item_texts(F.col("content"))) > 0)
    rows = rows.withColumn("run", run)
    item = F.struct("line_no", "api", "digest", "texts", "spoken")
    state = "struct<digest:string,texts:string,api:string,keep:array<{}>>".format(dict(msgs.dtypes)["line_no"])

    def step(a, x):
        same = x["digest"] == a["digest"]
        echo = (x["api"] == "cli") & (a["api"] == "openai-completions") & x["spoken"] & (x["texts"] == a["texts"])
        kept = F.struct(x["digest"].alias("digest"), x["texts"].alias("texts"), x["api"].alias("api"), F.concat(a["keep"], F.array(x["line_no"])).alias("keep"))
        return F.when(F.coalesce(same, F.lit(False)) | F.coalesce(echo, F.lit(False)), a).otherwise(kept.cast(state))

    start = F.struct(F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("texts"), F.lit(None).cast("string").alias("api"), F.array().cast("array<{}>".format(dict(msgs.dtypes)["line_no"])).alias("keep")).cast(state)
    kept = (
        rows.filter(F.col("role") == "assistant")
        .groupBy("session_id", "run")
        .agg(F.array_sort(F.collect_list(item)).alias("m"))
        .select("session_id", F.explode(F.aggregate("m", start, step, lambda a: a["keep"])).alias("line_no"))
    )
    return msgs.filter(F.col("role") != "assistant").unionByName(msgs.join(kept, ["session_id", "line_no"], "left_semi"))


def turns(msgs: DataFrame) -> DataFrame:
    """Turns of the kept messages: ``session_id, line_no, role, content, thought, action``.

    Roles are user, agent and environment; an assistant message with neither text nor call is no turn.
    """
    role = F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "agent").when(F.col("role") == "toolResult", "environment")
    c = F.col("content")
    return (
        deduplicated(msgs)
        .withColumn("speaker", role)
        .filter(F.col("speaker").isNotNull())
        .select(
            "session_id",
            "line_no",
            F.col("speaker").alias("role"),
            F.when(role == "user", tx.user_text(c)).when(role == "environment", tx.result_text(c)).alias("content"),
            F.when(role == "agent", tx.user_text(c)).alias("thought"),
            F.when(role == "agent", tx.action_text(c)).alias("action"),
        )
        .filter((F.col("role") != "agent") | (F.col("thought") != "") | (F.col("action") != ""))
    )


def rounds(rows: DataFrame) -> DataFrame:
    """Turns with ``round_no`` from 1: a round starts at each user turn, and at the first turn."""
    order = Window.partitionBy("session_id").orderBy("line_no")
    starts = F.when((F.col("role") == "user") | (F.row_number().over(order) == 1), 1).otherwise(0)
    return rows.withColumn("__s", starts).withColumn("round_no", F.sum("__s").over(order)).drop("__s")


def rendered(rows: DataFrame, profile: str = PROFILE) -> DataFrame:
    """(session_id, text): a session's turns as the text a judge reads."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    part = (
        F.when((F.col("role") == "user") & (F.col("content") != ""), F.concat(F.lit("\n[USER]: "), "content"))
        .when((F.col("role") == "environment") & (F.col("content") != ""), F.concat(F.lit("\n[ENVIRONMENT]: "), "content"))
        .when(
            F.col("role") == "agent",
            F.concat(
                F.lit("\n[AGENT]:\n"),
                F.concat_ws("\n", F.when(F.col("thought") != "", F.concat(F.lit("[THOUGHT]: "), strip(F.col("thought")))), F.when(F.col("action") != "", F.concat(F.lit("[ACTION]: "), strip(F.col("action"))))),
            ),
        )
    )
    head = (f"=== Agent Profile ===\n{profile}\n\n" if profile else "") + "=== Conversation History ==="
    said = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part"))), lambda x: x["part"])
    return rows.withColumn("part", part).groupBy("session_id").agg(F.array_join(F.concat(F.array(F.lit(head)), F.array_compact(said)), "\n").alias("text"))


def token_windows(documents: DataFrame, key: str, text: str, size: int = 3000, stride: int = 2700, stop_at_end: bool = False) -> DataFrame:
    """(key, window_no, n_tokens, first, last) of overlapping windows over white-space tokens."""
    tokens = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda t: t != "")
    w = F.explode(tx.windows(F.col("t"), size, stride, stop_at_end))
    return documents.select(key, tokens.alias("t")).select(key, w.alias("w")).select(key, F.col("w.window_no").cast("bigint").alias("window_no"), F.size("w.tokens").cast("bigint").alias("n_tokens"), F.get("w.tokens", F.lit(0)).alias("first_token"), F.try_element_at("w.tokens", F.lit(-1)).alias("last_token"))


def unsafe_sessions(judged: DataFrame, key: str) -> DataFrame:
    """(key, unsafe): whether any window of a session was judged unsafe."""
    return judged.groupBy(key).agg(F.bool_or(tx.judged_unsafe(F.col("answer")) == 1).alias("unsafe"))
