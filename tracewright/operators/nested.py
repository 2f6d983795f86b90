"""Deeply nested semi-structured records as related flat tables, by Dewey labels.

Every node of a JSON value gets an ordinal path identifier (``1``, ``1.2``, ``1.2.1`` ...): the label
of its parent followed by its ordinal among its siblings. A parent link is the label cut off behind
its last dot, so no join is needed to build it, and nodes group into tables by their schema path (the
path with every array index replaced by ``[*]``). A node's row is made from its own value alone, in
one narrow pass over Arrow batches; nothing is shuffled or collected.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELDS = ("dewey", "path", "schema_path", "kind", "name", "value")
NODE = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in _FIELDS]))


def _no_constant(text: str) -> None:
    raise ValueError(text)


class _Members(list):
    """Members of an object in order, repeated names kept."""


class _Number(str):
    """The text of a number, kept apart from strings."""


_STRICT = json.JSONDecoder(object_pairs_hook=_Members, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)
_BLANK = " \t\n\r"


def _decode_deep(text: str) -> object:
    """The value of ``text`` by an explicit stack, for nesting beyond the interpreter's recursion."""
    pos, n = 0, len(text)
    scalar = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_no_constant).raw_decode
    stack: list = []

    def skip(i: int) -> int:
        while i < n and text[i] in _BLANK:
            i += 1
        return i

    def key_at(i: int) -> tuple[str, int]:
        if i >= n or text[i] != '"':
            raise ValueError("name expected")
        name, i = scalar(text, i)
        i = skip(i)
        if i >= n or text[i] != ":":
            raise ValueError("colon expected")
        return name, skip(i + 1)

    pos = skip(pos)
    while True:
        if pos >= n:
            raise ValueError("value expected")
        opened = text[pos]
        if opened in "{[":
            pos = skip(pos + 1)
            node = _Members() if opened == "{" else []
            if pos < n and text[pos] == "}]"[opened == "["]:
                value, pos = node, pos + 1
            else:
                name = None
                if opened == "{":
                    name, pos = key_at(pos)
                stack.append((node, name))
                continue
        else:
            value, pos = scalar(text, pos)
        while True:
            pos = skip(pos)
            if not stack:
                if pos != n:
                    raise ValueError("extra data")
                return value
            node, name = stack[-1]
            is_object = isinstance(node, _Members)
            node.append((name, value) if is_object else value)
            if pos >= n:
                raise ValueError("end expected")
            if text[pos] == ",":
                pos = skip(pos + 1)
                if is_object:
                    name, pos = key_at(pos)
                    stack[-1] = (node, name)
                break
            if text[pos] != ("}" if is_object else "]"):
                raise ValueError("end expected")
            pos += 1
            value = node
            stack.pop()


def parse_json(text: str) -> object:
    """The value of a JSON text; ValueError if it is not valid JSON. Any depth, any length of number."""
    try:
        return _STRICT.decode(text)
    except RecursionError:
        return _decode_deep(text)


def _container(text: str) -> object | None:
    """The object or array that is the whole of ``text`` apart from outer blanks, or None."""
    inner = text.strip()
    if len(inner) < 2 or inner[0] not in "{[" or inner[-1] not in "}]":
        return None
    try:
        return parse_json(inner)
    except ValueError:
        return None


def label_nodes(text: str | None) -> list[tuple]:
    """(dewey, path, schema_path, kind, name, value) of every node of a JSON text, in document order.

    Null, empty, blank and invalid texts hold no node. A string whose whole text is an object or array
    counts as that object or array, at the same path and with the same label. Scalars carry their text
    as value. Repeated member names are kept as siblings with their own labels and the same path.
    """
    if not text or not text.strip():
        return []
    try:
        root = parse_json(text)
    except ValueError:
        return []
    out: list[tuple] = []
    todo = [(root, "1", "$", "$", None)]
    while todo:
        value, label, path, schema, name = todo.pop()
        while type(value) is str and (inner := _container(value)) is not None:
            value = inner
        if isinstance(value, _Members):
            out.append((label, path, schema, "object", name, None))
            todo += [(v, f"{label}.{i}", f"{path}.{k}", f"{schema}.{k}", k) for i, (k, v) in reversed(list(enumerate(value, 1)))]
        elif isinstance(value, list):
            out.append((label, path, schema, "array", name, None))
            todo += [(v, f"{label}.{i + 1}", f"{path}[{i}]", f"{schema}[*]", None) for i, v in reversed(list(enumerate(value)))]
        elif value is None:
            out.append((label, path, schema, "null", name, None))
        elif isinstance(value, bool):
            out.append((label, path, schema, "boolean", name, str(value).lower()))
        elif isinstance(value, _Number):
            out.append((label, path, schema, "number", name, str(value)))
        else:
            out.append((label, path, schema, "string", name, value.encode("utf-8", "replace").decode()))
    return out


@F.pandas_udf(NODE)
def dewey_nodes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: [dict(zip(_FIELDS, row)) for row in label_nodes(t)])


def parent_label(label: Column) -> Column:
    """The label of the parent: the label cut off behind its last dot; null at a root."""
    return F.when(F.instr(label, ".") > 0, F.regexp_replace(label, r"\.[^.]*$", ""))


def content_items(log: DataFrame) -> DataFrame:
    """Table of content items: ``entry_id, session_id, line_no, item_no, item_type, call_id, item_name, text, arguments``.

    Repeated deliveries of an entry come out once. Null entry ids, messages and contents hold no item.
    """
    return (
        log.filter(F.col("entry_id").isNotNull() & F.col("message.content").isNotNull())
        .select("entry_id", "session_id", "line_no", F.posexplode("message.content").alias("item_no", "item"))
        .select(
            "entry_id", "session_id", "line_no", F.col("item_no").cast("bigint").alias("item_no"),
            F.col("item.type").alias("item_type"), F.col("item.id").alias("call_id"), F.col("item.name").alias("item_name"),
            F.col("item.text").alias("text"), F.col("item.arguments").alias("arguments"),
        )
        .distinct()
    )


def tool_calls(log: DataFrame) -> DataFrame:
    """Table of tool calls, each linked to its content item by (entry_id, item_no)."""
    return content_items(log).filter(F.col("item_type") == "toolCall").drop("text", "item_type")


def argument_nodes(log: DataFrame) -> DataFrame:
    """Table of all nodes of all call arguments, each linked to its parent node and its call.

    Columns ``entry_id, item_no, dewey, parent, path, schema_path, kind, name, value``; the parent of
    a root (label ``1``) is null: its call is (entry_id, item_no).
    """
    return (
        tool_calls(log)
        .select("entry_id", "item_no", "arguments")
        .filter(F.length("arguments") > 0)
        .withColumn("node", F.explode(dewey_nodes("arguments")))
        .select("entry_id", "item_no", "node.*")
        .withColumn("parent", parent_label(F.col("dewey")))
    )


def nested_objects(log: DataFrame) -> DataFrame:
    """One row per JSON object found in call arguments: ``entry_id, item_no, path``."""
    return argument_nodes(log).filter(F.col("kind") == "object").select("entry_id", "item_no", "path").distinct()


def schema_tables(nodes: DataFrame) -> DataFrame:
    """Nodes folded into one row per object of each schema path, with a map of its scalar members.

    Written with ``partitionBy("schema_path")`` this gives a table per schema path. A repeated member
    name keeps its last value, by label order.
    """
    own = ["entry_id", "item_no"]
    objects = nodes.filter(F.col("kind") == "object").select(*own, "schema_path", "dewey", "parent", "path")
    scalars = (
        nodes.filter(~F.col("kind").isin("object", "array") & F.col("name").isNotNull())
        .groupBy(*own, F.col("parent").alias("dewey"), "name")
        .agg(F.max_by("value", F.length("dewey") * F.lit(1000000) + F.regexp_extract("dewey", r"(\d+)$", 1).cast("bigint")).alias("value"))
        .groupBy(*own, "dewey")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("members"))
    )
    return objects.join(scalars, [*own, "dewey"], "left")


def schema_counts(nodes: DataFrame) -> DataFrame:
    """Nodes counted by schema path and kind: the list of tables."""
    return nodes.groupBy("schema_path", "kind").agg(F.count(F.lit(1)).alias("n"))
