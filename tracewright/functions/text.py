"""Scalar text functions: audit tokens, names, windows, turns and judgments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The key=value pattern, the prefixes and the key that are left out, and name endings.
KEY_VALUE = r'(?U)\b([a-zA-Z][\w-]*)=("[^"]*"|\([^)]*\)|[^\s\x1c-\x1f]+)'
SKIPPED = r"^(a[0-3]|pid)="
SKIPPED_KEY = "msg="
AUDIT_ENDING = "_audit-logs.log"
PCAP_ENDING = "_network.pcap"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
WORD_PIECE = r"[\p{L}\p{N}_]{2,}"
JUDGMENT = r"(?i)<Judgment>\s*(safe|unsafe)\s*</Judgment>"
MAX_REPEAT = 30


def kv_tokens(line: Column) -> Column:
    """The ``key=value`` tokens of an audit line, in order, repeats kept, ``msg`` left out.

    Keys and values are in lower case, apostrophes at a value's end are cut, quotes stay. Null lines
    have no tokens.
    """
    found = F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(KEY_VALUE), F.lit(0))
    low = F.transform(found, lambda m: F.regexp_replace(F.lower(m), "'+$", ""))
    whole = F.transform(low, lambda t: F.when(t.rlike('^[^=]*="$'), F.concat(t, F.lit('"'))).otherwise(t))
    return F.filter(whole, lambda t: ~F.startswith(t, F.lit(SKIPPED_KEY)))


def skipped(token: Column) -> Column:
    """Whether a token has one of the prefixes that statistics leave out."""
    return token.rlike(SKIPPED)


def separators_as_blanks(text: Column) -> Column:
    return F.translate(text, "\x1d", " ")


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def capped_document(tokens: Column, cap: int = MAX_REPEAT) -> Column:
    """Text of an array<struct<token, n>>: each token 1 to ``cap`` times, in order of token."""
    kept = F.filter(tokens, lambda t: ~skipped(t["token"]))
    repeated = F.transform(F.array_sort(kept), lambda t: F.array_repeat(t["token"], F.least(F.greatest(t["n"], F.lit(1)), F.lit(cap)).cast("int")))
    return F.array_join(F.flatten(repeated), " ")


def hex_text(value: Column) -> Column:
    """Text of hexadecimal digits, invalid bytes replaced; '' for an odd number of digits."""
    return F.when(F.length(value) % 2 == 0, F.make_valid_utf8(F.unhex(value).cast("string"))).otherwise(F.lit(""))


def pcap_name(audit_name: Column) -> Column:
    """The capture's name of an audit log's name."""
    stem = F.regexp_replace(audit_name, r"_audit-logs\.log$", "")
    return F.concat(stem, F.lit(PCAP_ENDING))


def audit_name(pcap: Column) -> Column:
    """The audit log's name of a capture's name."""
    return F.concat(F.regexp_replace(pcap, r"_network\.pcap$", ""), F.lit(AUDIT_ENDING))


def skill_id(file_name: Column) -> Column:
    """The skill in a file name, or the name without its extension if it has none."""
    skill = F.regexp_extract(file_name, r"^(.+)_prompt_\d+_audit-logs\.log$", 1)
    return F.when(skill != "", skill).otherwise(F.regexp_replace(file_name, r"\.[^.]*$", ""))


def cv_group(label: Column, file_name: Column) -> Column:
    return F.concat_ws(":", class_name(label), skill_id(file_name))


def class_name(label: Column) -> Column:
    return F.when(label == 0, "innocent").when(label == 1, "malicious")


def item_texts(content: Column) -> Column:
    """Texts of the text items of a message's content."""
    return F.transform(F.filter(content, lambda i: (i["type"] == "text") & i["text"].isNotNull()), lambda i: i["text"])


def user_text(content: Column) -> Column:
    return F.array_join(F.coalesce(item_texts(content), F.array().cast("array<string>")), "\n")


def action_text(content: Column) -> Column:
    """JSON of the one tool call, or of the list of calls, or ''."""
    calls = F.transform(F.filter(content, lambda i: i["type"] == "toolCall"), lambda i: F.struct(i["id"].alias("id"), i["name"].alias("name"), i["arguments"].alias("arguments")))
    keep_null = {"ignoreNullFields": "false"}
    return F.when(F.size(calls) == 1, F.to_json(F.get(calls, F.lit(0)), keep_null)).when(F.size(calls) > 1, F.to_json(calls, keep_null)).otherwise(F.lit(""))


def result_text(content: Column) -> Column:
    """Texts of a tool result, or JSON of its items if it has none."""
    texts = item_texts(content)
    return F.when((F.size(texts) == 0) & (F.size(content) > 0), F.to_json(content, {"ignoreNullFields": "false"})).otherwise(user_text(content))


def windows(tokens: Column, size: int, stride: int, stop_at_end: bool) -> Column:
    """array<struct<window_no, tokens>>: overlapping slices of a token array.

    stop_at_end: no window starts after one that reaches the end. Otherwise windows start at every
    stride below the length, so the last may be all overlap. No tokens give one empty window.
    """
    n = F.size(tokens)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(stride)) if stop_at_end else F.ceil(n / F.lit(stride)) - 1).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("window_no"), F.slice(tokens, k * stride + 1, F.lit(size)).alias("tokens")))


def judged_unsafe(answer: Column) -> Column:
    """1 if an answer judges unsafe: by its tag, else by the word."""
    tag = F.lower(F.regexp_extract(answer, JUDGMENT, 1))
    return F.when(tag != "", (tag == "unsafe").cast("int")).otherwise(F.coalesce(F.contains(F.lower(answer), F.lit("unsafe")), F.lit(False)).cast("int"))


def config_tag(**settings: object) -> str:
    return "|".join(f"{k}={v}" for k, v in settings.items())
