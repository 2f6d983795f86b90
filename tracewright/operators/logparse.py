"""Semi-structured log lines into entries with time, level, component and message.

1. Each line is cut into typed tokens by one regular expression: times, levels, keys, member names, quoted
   strings, words, numbers, punctuation. It is done once, on whole lines; the tokens are written.
2. Token n-gram dictionaries: bigrams and trigrams are counted over all lines, first of the distinct
   forms of lines with their frequencies, combined partially before the shuffle. There are two: one of the words
   as they stand, and one in which all words are alike. Those in at least the share ``SUPPORT`` (``TYPE_SUPPORT``)
   of all lines are kept; with ``n`` tokens a line on average, a dictionary has at most 2 * n / support entries
   at any input size, so it is collected and sent to the workers.
3. Trigrams are looked up first, bigrams where they leave a token open. A token that a kept n-gram covers is
   constant; any but a word also where only one of the second dictionary covers it, as in programs that write
   little; all others are variable. A line's template is its typed slots (times, levels, numbers, strings) and
   constant tokens, with the variable words masked and the tokens that neither dictionary covers marked.
4. Templates receive field roles by type, from the template and nothing else. A template is that of a head if its
   first time and all before it are constant, values of keys excepted. No layout is written down: without the
   dictionaries there is no entry.
5. A line whose template has such a head starts an entry. Files are cut into blocks of
   ``BLOCK`` lines; each block hands the line of its last start on to the later blocks of its file, so no
   file, however long, is sorted in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.runtime import written

SUPPORT = 0.001
#: As all words are alike in the second dictionary, it is small, and programs that write little are in it.
TYPE_SUPPORT = 0.0001
BLOCK = 4096

# Spellings of the five levels.
LEVELS = {
    "DEBUG": ("d", "dbg", "debug", "trace", "verbose"),
    "INFO": ("i", "inf", "info", "information", "notice"),
    "WARN": ("w", "wrn", "warn", "warning"),
    "ERROR": ("e", "err", "error", "severe"),
    "FATAL": ("f", "ftl", "fatal", "crit", "critical", "panic", "emerg"),
}
_LEVEL = {word: level for level, words in LEVELS.items() for word in words}

# Forms of time.
_ISO = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?"
_CLF = r"\d{1,2}/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d(?:\.\d+)?(?: [+-]\d{4})?"
_BSD = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ 0-9]\d \d\d:\d\d:\d\d(?:\.\d+)?"
_GLOG = r"[A-Z]\d{4} \d\d:\d\d:\d\d(?:\.\d+)?"
_EPOCH = r"\d{10}\.\d{3}(?=:\d+\))|\b\d{13}\b"
_TIMES = (_ISO, _CLF, _BSD, _GLOG, _EPOCH)
TOKEN = "|".join(
    (
        *_TIMES,
        r'"[A-Za-z_][\w.]*"\s*:',  # member name
        r'"[^"\\]*+(?:\\.[^"\\]*+)*+"',  # quoted string
        r"[A-Za-z_][\w.]*=",  # key
        r"[^\W0-9][\w./\-]*",  # word
        r"\d+",
        r"\S",
    )
).replace(r"\d", "[0-9]")

LINES = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("line", T.StringType()),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("shape", T.StringType()),
        T.StructField("types", T.StringType()),
    ]
)
ROLES = T.StructType([T.StructField("template", T.StringType()), T.StructField("kind", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("time", "level", "component"))])
#: Tokens or lines whose types or roles a worker remembers before it starts anew.
REMEMBERED = 100_000
#: Stands between the tokens of a shape.
GAP = "\x1f"


def clean_line(msg: Column) -> Column:
    """A line without colour codes and the carriage return at its end."""
    plain = F.when(F.contains(msg, F.lit("\x1b")), F.regexp_replace(msg, r"\x1b\[[0-9;]*m", "")).otherwise(msg)
    return F.when(F.endswith(plain, F.lit("\r")), F.rtrim(plain, F.lit("\r"))).otherwise(plain)


_PY_TOKEN = re.compile(TOKEN)
_PY_TIME = re.compile(("(?:" + "|".join(_TIMES[:4]) + r"|\d{10}\.\d{3}|\d{13})\Z").replace(r"\d", "[0-9]"))
_PY_DIGITS = re.compile("[0-9]+")
_PY_WORD = re.compile(r"[^\W0-9][\w./\-]*\Z")


def token_type(token: str) -> tuple[str, str]:
    """(shape, type) of a token.

    Types: T time, L level, W word, N number, S other quoted string, K key, M member name, else the
    token itself. A quoted string that is a time, level or word has that type. The shape of a word, key or
    member is its text with digits as 0, any other type's is its type in angle brackets.
    """
    if token.isdigit() and token.isascii():
        return ("<T>", "T") if len(token) == 13 else ("<N>", "N")
    last = token[-1]
    if len(token) > 1:
        if token[0] == '"':
            if last == ":":
                return token, "M"
            inner = token[1:-1]
            kind = "T" if _PY_TIME.match(inner) else "L" if inner.lower() in _LEVEL else "W" if _PY_WORD.match(inner) else "S"
            return ("<S>" if kind == "W" else f"<{kind}>"), kind
        if last == "=":
            return token, "K"
        if _PY_TIME.match(token):
            return "<T>", "T"
    if _PY_WORD.match(token):
        return ("<L>", "L") if token.lower() in _LEVEL else (_PY_DIGITS.sub("0", token), "W")
    return token, token


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their tokens, shape and types; what a token is is remembered for ``REMEMBERED`` of them."""
    known: dict[str, tuple[str, str]] = {}
    for batch in batches:
        tokens, shapes, types = [], [], []
        if len(known) > REMEMBERED:
            known.clear()
        for line in batch.column(2).to_pylist():
            found = _PY_TOKEN.findall(line) if line else []
            for t in found:
                if t not in known:
                    known[t] = token_type(t)
            tokens.append(found)
            shapes.append(GAP.join([known[t][0] for t in found]))
            types.append(GAP.join([known[t][1] for t in found]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.list_(pa.string())), pa.array(shapes, pa.string()), pa.array(types, pa.string())], names=[f.name for f in LINES])


def cut_lines(raw: DataFrame) -> DataFrame:
    """Distinct lines of ``raw`` (file_name, line_no, msg) with their tokens.

    A line read twice counts once (the greatest text, should they differ). Rows without file or line
    number belong to no file and are left out; a null line is blank.
    """
    one = raw.filter(F.col("file_name").isNotNull() & F.col("line_no").isNotNull()).groupBy("file_name", F.col("line_no").cast("bigint").alias("line_no")).agg(F.max("msg").alias("msg"))
    return one.select("file_name", "line_no", clean_line(F.col("msg")).alias("line")).mapInArrow(_cut, LINES)


def ngram_counts(shapes: DataFrame) -> DataFrame:
    """(gram, n): bigrams and trigrams of the rows of ``shapes`` (shape, n), counted n times each."""
    at = lambda t, i, k: F.array_join(F.slice(t, i, k), GAP)
    grams = lambda t, k: F.when(F.size(t) >= k, F.transform(F.sequence(F.lit(1), F.size(t) - (k - 1)), lambda i: at(t, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    both = F.get(F.transform(F.array(F.split("shape", GAP)), lambda t: F.concat(grams(t, 2), grams(t, 3))), F.lit(0))
    return shapes.filter(F.col("shape") != "").select("n", F.explode(both).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n"))


def frequent_ngrams(shapes: DataFrame, lines: int, support: float, fewest: int) -> set[str]:
    """The n-grams in at least ``support`` of the lines and ``fewest`` times; at most 2 / support times the tokens of a line."""
    return {r[0] for r in ngram_counts(shapes).filter(F.col("n") >= max(fewest, int(support * lines))).select("gram").collect()}


def dictionaries(lines: DataFrame) -> tuple[set[str], set[str]]:
    """(n-grams of words as they stand, n-grams of types) that are frequent in cut lines."""
    n = lines.filter(F.col("shape") != "").count()
    forms = lambda c: lines.groupBy(F.col(c).alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    return frequent_ngrams(forms("shape"), n, SUPPORT, 2), frequent_ngrams(forms("types"), n, TYPE_SUPPORT, 1)


def covered(tokens: list[str], frequent: set[str]) -> list[bool]:
    """Whether a frequent trigram, or a frequent bigram where no such trigram does, covers each token."""
    out = [False] * len(tokens)
    for k in (3, 2):
        for i in range(len(tokens) - k + 1):
            if not all(out[i : i + k]) and GAP.join(tokens[i : i + k]) in frequent:
                out[i : i + k] = [True] * k
    return out


#: Mark of a variable token of known type in a template.
_MASK = {"W": "<*>", "K": "<*>=", "M": '"<*>":'}


def template_of(shapes: list[str], types: list[str], by_word: list[bool], by_type: list[bool]) -> tuple[str, ...]:
    """The template of a line: a mark for each token.

    A token that the words' dictionary covers stands as its shape. One that only the types' covers does too, but
    the text of words, keys and members is masked. One that neither covers is its type behind a question mark.
    A quoted word is a slot, ``"<W>"`` where its place is constant by the words' dictionary.
    """
    out = []
    for shape, kind, word, known in zip(shapes, types, by_word, by_type):
        if not (word or known):
            out.append("?" + kind)
        elif shape == "<S>" and kind == "W":
            out.append('"<W>"' if word else '"<*>"')
        else:
            out.append(shape if word else _MASK.get(kind, shape))
    return tuple(out)


def mark_type(mark: str) -> tuple[str, bool, bool]:
    """(type, whether it is constant, whether a dictionary covers it) of a mark of a template."""
    if len(mark) > 1 and mark[0] == "?":
        return mark[1:], False, False
    if mark in ("<*>", '"<*>"', '"<W>"'):
        return "W", mark == '"<W>"', True
    if mark in ("<T>", "<L>", "<N>", "<S>"):
        return mark[1], True, True
    return token_type(mark)[1], True, True


def template_roles(template: tuple[str, ...]) -> tuple[str, int, int, int] | None:
    """(kind, time, level, component) of a template as token positions, -1 where absent; None if it has no head.

    kind is ``object`` for a template that opens or holds a JSON object, ``member`` for one that is a
    member of one, else ``line``. Members of the outer object give its fields: the first time, level and word.

    Otherwise the head must be constant up to its first time; a word may vary where a key stands before it.
    Where the time is a key's value, so are the fields behind it. Where it stands further in behind keys, the
    component is the last word before it that is a key's value and has another key behind it. Else the
    component is the first word behind the time that no word follows, up to a colon, and the level is one
    behind the time itself or set off on both sides.
    """
    types, constant, known = zip(*map(mark_type, template))
    n = len(types)
    if types[0] == "{" or types[0] == "M":
        return _object_roles(types, known)  # an object's words are values; they need not be constant
    if "T" not in types:
        return None
    time = types.index("T")
    at = lambda i: types[i] if 0 <= i < n else ""
    if not all(constant[i] or types[i] in ("W", "L", "S") and at(i - 1) == "K" for i in range(time + 1)):
        return None
    keys = [i for i in range(n) if types[i] == "K"]
    if at(time - 1) == "K":
        level = next((i + 1 for i in keys if at(i + 1) == "L"), -1)
        return "line", time, level, next((i + 1 for i in keys if i > time and at(i + 1) == "W"), -1)
    if any(i < time for i in keys):
        named = [i + 1 for i in keys if i < time and at(i + 1) in ("W", "L") and at(i + 2) == "K"]
        return ("line", time, -1, named[-1]) if named else None
    level = component = -1
    for i in range(time + 1, n):
        left, right = at(i - 1), at(i + 1)
        if types[i] == ":":
            break
        if types[i] == "L" and level < 0 and (left == "T" or left not in ("W", "L", "N", "S") and right not in ("W", "L", "N", "S", "")):
            level = i
        elif types[i] in ("W", "L") and component < 0 and right not in ("W", "L", ""):
            component = i
        elif component >= 0 and types[i] in ("W", "S"):
            break
    if level < 0 and component < 0:
        return None
    return "line", time, level, component


def _object_roles(types: tuple[str, ...], known: tuple[bool, ...]) -> tuple[str, int, int, int] | None:
    if types[0] == "M" and not known[0]:
        return None
    found = {"T": -1, "L": -1, "W": -1}
    depth = top = int(types[0] == "{")
    for i in range(1, len(types)):
        depth += (types[i] in ("{", "[")) - (types[i] in ("}", "]"))
        if types[i - 1] == "M" and depth == top and found.get(types[i], 0) < 0 and known[i]:
            found[types[i]] = i
    if types[0] == "M":
        return "member", found["T"], found["L"], found["W"]
    if len(types) > 1 and found["T"] < 0:
        return None
    return "object", found["T"], found["L"], found["W"]


def line_roles(words: set[str], kinds: set[str]):
    """A pandas UDF: shape and types of a line -> its template and the positions of its fields.

    The template of like lines is made once, and a template receives its roles once.
    """

    def make(shape: str, types: str) -> tuple[str, ...]:
        s, t = shape.split(GAP), types.split(GAP)
        return template_of(s, t, covered(s, words), covered(t, kinds))

    @F.pandas_udf(ROLES)
    def roles(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, tuple] = {}
        given: dict[tuple, tuple] = {}
        for shapes, types in batches:
            if len(known) > REMEMBERED:
                known.clear()
                given.clear()
            known["", ""] = (None,) * 5
            rows = []
            for key in zip(shapes, types):
                if key not in known:
                    template = make(*key)
                    if template not in given:
                        given[template] = (" ".join(template), *(template_roles(template) or (None,) * 4))
                    known[key] = given[template]
                rows.append(known[key])
            out = pd.DataFrame(rows, columns=[f.name for f in ROLES], dtype=object)
            yield out.astype({c: "Int32" for c in ("time", "level", "component")})

    return roles


def utc_text(stamp: Column, year: Column) -> Column:
    """A time of any form as UTC ``yyyy-MM-dd HH:mm:ss.SSS``; null if it is none.

    year: the year where the form names none. Digits beyond milliseconds are cut off; a form without a
    zone is UTC.
    """
    fraction = F.rpad(F.substring(F.regexp_extract(stamp, r"\d\d:\d\d:\d\d[.,](\d+)", 1), 1, 3), 3, "0")
    clock = F.regexp_extract(stamp, r"(?:[T ]|/\d{4}:)(\d\d:\d\d:\d\d)", 1)
    zone = F.regexp_extract(stamp, r"\d ?([+-]\d\d:?\d\d)$", 1)
    offset = F.when(zone == "", F.lit(0)).otherwise(
        F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
        * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.regexp_extract(zone, r"(\d\d)$", 1).try_cast("int"))
    )
    iso_day = F.regexp_extract(stamp, r"^(\d{4}-\d\d-\d\d)", 1)
    clf = F.concat_ws(" ", F.regexp_extract(stamp, r"^(\d{1,2})/", 1), F.regexp_extract(stamp, r"/(\w{3})/", 1), F.regexp_extract(stamp, r"/(\d{4}):", 1))
    bsd = F.concat_ws(" ", F.regexp_extract(stamp, r"^\w{3} +(\d+)", 1), F.substring(stamp, 1, 3), year.cast("string"))
    month_day = F.concat_ws("-", year.cast("string"), F.substring(stamp, 2, 2), F.substring(stamp, 4, 2))
    day = (
        F.when(iso_day != "", F.try_to_timestamp(F.concat_ws(" ", iso_day, clock), F.lit("yyyy-MM-dd HH:mm:ss")))
        .when(stamp.rlike(r"^\d{1,2}/"), F.try_to_timestamp(F.concat_ws(" ", clf, clock), F.lit("d MMM yyyy HH:mm:ss")))
        .when(stamp.rlike(r"^[A-Z]\d{4} "), F.try_to_timestamp(F.concat_ws(" ", month_day, clock), F.lit("yyyy-MM-dd HH:mm:ss")))
        .when(stamp.rlike(r"^[A-Z][a-z]{2} "), F.try_to_timestamp(F.concat_ws(" ", bsd, clock), F.lit("d MMM yyyy HH:mm:ss")))
    )
    moved = F.timestamp_seconds(F.unix_timestamp(day) - offset * 60)
    text = F.concat_ws(".", F.date_format(moved, "yyyy-MM-dd HH:mm:ss"), F.when(fraction == "", "000").otherwise(fraction))
    epoch = F.when(stamp.rlike(r"^\d{13}$"), stamp.try_cast("bigint")).when(stamp.rlike(r"^\d{10}\.\d{3}$"), F.regexp_replace(stamp, r"\.", "").try_cast("bigint"))
    return F.when(epoch.isNotNull(), F.date_format(F.timestamp_millis(epoch), "yyyy-MM-dd HH:mm:ss.SSS")).when(moved.isNotNull(), text)


def typed_lines(raw: DataFrame) -> DataFrame:
    """Distinct lines of ``raw`` (file_name, line_no, msg) with their template and the values of its fields."""
    lines = written(cut_lines(raw), "log-tokens")
    value = lambda c: F.regexp_replace(F.get("tokens", F.col(f"r.{c}")), '^"|"$', "")
    word = lambda v: F.coalesce(*[F.when(F.lower(v).isin(*spelt), level) for level, spelt in LEVELS.items()])
    time = value("time")
    by_date = F.when(time.rlike(r"^[A-Z]\d{4} "), word(F.substring(time, 1, 1)))  # the level is the letter before the date
    return lines.withColumn("r", line_roles(*dictionaries(lines))("shape", "types")).select(
        "file_name", "line_no", "line", "r.template", "r.kind",
        time.alias("time"), F.coalesce(by_date, word(value("level")), F.lit("")).alias("level"), value("component").alias("component"),
    )


def mark_starts(lines: DataFrame) -> DataFrame:
    """Typed lines with ``entry``: the line number of the start of the entry each belongs to, or null.

    A line ``{`` alone starts an entry if the next line is a member. The next line is found within the
    block; the first line of each block is also handed to the block before.
    """
    block = F.floor((F.col("line_no") - 1) / F.lit(BLOCK))
    edge = (F.col("line_no") - 1) % BLOCK == 0
    spread = lines.withColumn("at_block", F.explode(F.when(edge, F.array(block, block - 1)).otherwise(F.array(block))))
    order = Window.partitionBy("file_name", "at_block").orderBy("line_no")
    next_member = (F.lead("kind").over(order) == "member") & (F.lead("line_no").over(order) == F.col("line_no") + 1)
    opens = (F.col("kind") == "line") | ((F.col("kind") == "object") & (F.col("time").isNotNull() | F.coalesce(next_member, F.lit(False))))
    started = spread.withColumn("start", F.when(F.coalesce(opens, F.lit(False)), F.col("line_no"))).filter(F.col("at_block") == block)
    carry = (
        started.groupBy("file_name", "at_block")
        .agg(F.max("start").alias("last"))
        .select("file_name", "at_block", F.max("last").over(Window.partitionBy("file_name").orderBy("at_block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
        .filter(F.col("carried").isNotNull())
    )
    local = F.max("start").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return started.withColumn("local", local).join(carry, ["file_name", "at_block"], "left").withColumn("entry", F.coalesce("local", "carried"))


def log_entries(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Entries: ``file_name, first_line, last_line, logged_at, log_level, component, message_line``.

    files: ``file_name, started_at``, for the year where a layout names none (null if the file is not
    listed; the time is then null). Lines before a file's first start belong to no entry; blank lines
    at an entry's end do not belong to it. log_level and component are '' where the layout names none.
    """
    own = mark_starts(written(typed_lines(raw), "log-lines")).filter(F.col("entry").isNotNull())
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != "") & ((F.col("line_no") == F.col("entry")) | (F.col("kind") == "member")), F.col("line_no")))
    entries = own.groupBy("file_name", F.col("entry").alias("first_line")).agg(
        F.max(F.when(F.trim(F.regexp_replace("line", r"\s", " ")) != "", F.col("line_no"))).alias("last_line"),
        first("time").alias("time"),
        first("level").alias("level"),
        first("component").alias("component"),
        F.max(F.when(F.col("line_no") == F.col("entry"), F.col("line"))).alias("message_line"),
    )
    years = files.filter(F.col("file_name").isNotNull()).groupBy("file_name").agg(F.year(F.min("started_at")).alias("year"))
    return entries.join(years, "file_name", "left").select(
        "file_name",
        "first_line",
        "last_line",
        utc_text(F.col("time"), F.col("year")).alias("logged_at"),
        F.coalesce("level", F.lit("")).alias("log_level"),
        F.coalesce("component", F.lit("")).alias("component"),
        "message_line",
    )


def template_counts(raw: DataFrame) -> DataFrame:
    """(template, n): templates of line heads and their numbers of lines."""
    return typed_lines(raw).filter(F.col("template").isNotNull()).groupBy("template").agg(F.count(F.lit(1)).alias("n"))
