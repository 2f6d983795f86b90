"""Visually identical text with different characters.

Texts of an Arrow batch are copied to one numpy array of code points. Lookup tables say for every code
point how many code points it becomes and where they stand in a pool; gathers by repeated offsets expand
the whole batch at once. Combining marks are then put in canonical order and composed with their bases
by searches in sorted pair tables, over the whole batch. No string call is made per row.

One form: compatibility forms (full-width, joined and other presentation forms) become what they
stand for, accents are composed, characters that do not show are dropped, every kind of blank is a
space, look-alike letters and hyphens become one of them. Tabs and line ends stay, as
do case, accents, digits, punctuation and the number of blanks. Null stays null, an empty text empty.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that look like a Latin letter, in pairs (letter, Latin letter).
LOOKALIKES = (
    "АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT УY ХX ҮY ԌG ԚQ ԜW ӀI "  # Cyrillic capitals
    "аa сc ԁd еe һh іi јj оo рp ԛq ѕs ԝw хx уy ѵv ӏl "  # Cyrillic small
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ "  # Greek capitals
    "οo ϲc ϳj νv "  # Greek small
    "ɑa ɡg "  # other Latin
    "ՕO օo ցg հh ոn սu "  # Armenian
    "αa ρp ιi "  # Greek small that differ in few fonts
    "ᎠD ᎡR ᎢT ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᏀG ᏃZ ᏔW ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB "  # Cherokee
    "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU "  # Lisu
    "ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲟo ⲢP ⲣp ⲤC ⲥc ⲦT ⲬX "  # Coptic
)
# Hyphens that look like U+002D.
HYPHENS = "‐‑‒–−﹣－⁃˗"
#: Characters that do not show although their category is no format or control.
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ"
#: Format characters that show, as they stand before the digits they enclose.
SHOWN = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd"
_KEPT_CONTROLS = "\t\n\x0b\x0c\r\x85"
#: Kinds of compatibility form that do not look like what they stand for, and stay.
_STAY = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>")


def _unseen(ch: str) -> bool:
    o = ord(ch)
    if ch in _KEPT_CONTROLS or ch in SHOWN:
        return False
    return ch in UNSEEN or unicodedata.category(ch) in ("Cf", "Cc") or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """The lookup tables, built once per worker from the Unicode database and the values above.

    ``start`` and ``size`` by code point into ``pool``; ``ccc`` combining classes; sorted ``pairs`` (base
    * 2**21 + second) with ``composed``; ``second``: seconds of a pair that are no marks.
    """
    one = {p[0]: p[-1] for p in LOOKALIKES.split()} | {h: "-" for h in HYPHENS}
    n = sys.maxunicode + 1
    size = np.ones(n, np.int32)
    start = np.arange(n, dtype=np.int32)
    pool = list(range(n))
    ccc = np.zeros(n, np.uint8)
    base = []
    for o in range(n):
        if 0xAC00 <= o < 0xD7A4 or 0x3400 <= o < 0xA000 or 0x20000 <= o < 0x2F800 or 0x30000 <= o < 0xE0000 or o >= 0xE0200 or 0xD800 <= o < 0xF900:
            continue
        ch = chr(o)
        if k := unicodedata.combining(ch):
            ccc[o] = k
        if _unseen(ch):
            size[o] = 0
            continue
        d = unicodedata.decomposition(ch)
        if unicodedata.category(ch) == "Zs":
            to = " "
        elif ch in one:
            to = one[ch]
        elif d and not d.startswith(_STAY):
            full = unicodedata.normalize("NFKD", ch)
            to = "".join(" " if unicodedata.category(x) == "Zs" else one.get(x, x) for x in full if not _unseen(x))
            if not d.startswith("<") and len(parts := d.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
                base.append((chr(int(parts[0], 16)), chr(int(parts[1], 16)), ch))
        else:
            continue
        start[o], size[o] = len(pool), len(to)
        pool += map(ord, to)
    # A base that becomes its Latin look-alike has the compositions of that letter.
    best = {ord(b) << 21 | ord(m): ord(c) for b, m, c in base if b not in one}
    pairs = np.array(sorted(best), np.int64)
    composed = np.array([best[int(k)] for k in pairs], np.int32)
    second = np.zeros(n, bool)
    second[pairs & (2**21 - 1)] = True
    second &= ccc == 0
    return {"size": size, "start": start, "pool": np.array(pool, np.int32), "ccc": ccc, "pairs": pairs, "composed": composed, "second": second}


def _ordered(points: np.ndarray, rows: np.ndarray, ccc: np.ndarray) -> np.ndarray:
    """Code points with every run of combining marks in the order of their classes."""
    classes = ccc[points]
    if not classes.any():
        return points
    run = np.cumsum(classes == 0)
    return points[np.lexsort((np.arange(len(points)), classes, run, rows))]


def unify_points(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of many texts, ``rows`` naming the text of each, in one form."""
    t = tables()
    size = t["size"][points]
    first = np.cumsum(size) - size
    where = np.repeat(t["start"][points] - first, size) + np.arange(int(size.sum()))
    rows = np.repeat(rows, size)
    points = t["pool"][where]
    points = _ordered(points, rows, t["ccc"])
    points, rows = _composed(points, rows, t)
    return _joined(points, rows, t)


def _find(t: dict[str, np.ndarray], base: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The composition of each pair, -1 where there is none."""
    key = base.astype(np.int64) << 21 | second
    at = np.minimum(np.searchsorted(t["pairs"], key), len(t["pairs"]) - 1)
    return np.where(t["pairs"][at] == key, t["composed"][at], -1)


def _composed(points: np.ndarray, rows: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ordered code points with every mark joined to its base where the two have a composition.

    A round tries the first untried mark of every base. One that has no composition stays and blocks those
    of its class behind it, so there are about as many rounds as classes, not as marks.
    """
    classes = t["ccc"][points]
    marks = np.flatnonzero(classes)
    if not len(marks):
        return points, rows
    points = points.copy()
    place = np.arange(len(points))
    base = np.maximum.accumulate(np.where(classes == 0, place, -1))[marks]
    marks, base = marks[base >= 0], base[base >= 0]
    same = rows[marks] == rows[base]
    marks, base = marks[same], base[same]
    keep = np.ones(len(points), bool)
    while len(marks):
        _, first = np.unique(base, return_index=True)
        made = _find(t, points[base[first]], points[marks[first]])
        hit = made >= 0
        points[base[first[hit]]] = made[hit]
        keep[marks[first[hit]]] = False
        rest = np.ones(len(marks), bool)
        rest[first] = False
        missed = base[first[~hit]].astype(np.int64) << 8 | classes[marks[first[~hit]]]
        rest &= ~np.isin(base.astype(np.int64) << 8 | classes[marks], missed)
        marks, base = marks[rest], base[rest]
    return points[keep], rows[keep]


def _joined(points: np.ndarray, rows: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Code points with neighbours joined that compose without being marks: Hangul letters and some vowel signs."""
    for _ in range(3):
        if len(points) < 2:
            break
        a, b = points[:-1], points[1:]
        near = rows[:-1] == rows[1:]
        lead = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        tail = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        made = np.where(lead, 0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28, np.where(tail, a + b - 0x11A7, -1))
        other = near & t["second"][b] & (made < 0)
        made[other] = _find(t, a[other], b[other])
        hit = near & (made >= 0)
        hit[1:] &= ~hit[:-1]
        if not hit.any():
            break
        at = np.flatnonzero(hit)
        points = points.copy()
        points[at] = made[at]
        keep = np.ones(len(points), bool)
        keep[at + 1] = False
        points, rows = points[keep], rows[keep]
    return points, rows


def unify_array(texts: pa.Array) -> pa.Array:
    """A string array with every text in one form."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return texts.cast(pa.string())
    valid = texts.is_valid()
    texts = texts.fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = (buffers[2].to_pybytes() if buffers[2] is not None else b"")[offsets[0] : offsets[-1]]
    raw = np.frombuffer(data, np.uint8)
    heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before each byte
    counts = np.diff(heads[offsets - offsets[0]])
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int32)
    points, rows = unify_points(points, np.repeat(np.arange(n), counts))
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    ends = np.cumsum(np.bincount(rows, weights=width, minlength=n)).astype(np.int64)
    out = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    made = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64).tobytes()), pa.py_buffer(out)])
    return pa.compute.if_else(valid, made, pa.scalar(None, pa.large_string())).cast(pa.string())


def unified(df: DataFrame, column: str = "text", into: str = "form") -> DataFrame:
    """``df`` with the column ``into``: ``column`` in one form. Only the text goes through Arrow batches."""
    import pyarrow.compute  # noqa: F401
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*(f for f in df.schema.fields if f.name != into), StructField(into, StringType())])
    at = df.schema.fieldNames().index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                yield pa.RecordBatch.from_arrays([*part.columns, unify_array(part.column(at))], names=[*part.schema.names, into])

    return df.drop(into).mapInArrow(run, schema)


def _digests(documents: DataFrame) -> DataFrame:
    """(doc_id, form, own): 128-bit digests of a text's form and of itself, as a written table."""
    from tracewright.runtime import written

    texts = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return written(unified(texts).select("doc_id", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("text")).alias("own")), "forms")


def same_look_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, links) of each document: the least doc_id of its form, and how many look like it but differ.

    Exact copies are one text; counts are combined per form and text before they meet, so work is linear
    however large a class. Null texts have no row.
    """
    digests = _digests(documents).distinct()
    per_text = digests.groupBy("form", "own").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    per_form = per_text.groupBy("form").agg(F.min("first").alias("class_id"), F.sum("copies").alias("members"))
    own = per_text.select("form", "own", "copies").join(per_form, "form").select("form", "own", "class_id", (F.col("members") - F.col("copies")).alias("links"))
    return digests.join(own, ["form", "own"]).select("doc_id", "class_id", "links")


def same_look_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents whose texts differ as strings but look the same.

    Texts are compared by 128-bit digests of their form and of themselves. Documents are first reduced
    to distinct texts; only forms with at least two texts go on, and pairs are made between the
    distinct texts of a form and then expanded to their documents. Work thus follows the number of
    pairs, however many exact copies a text has; a document without a look-alike leaves before any join.
    Null texts look like nothing.
    """
    digests = _digests(documents)
    mixed = digests.groupBy("form").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter(F.col("lo") != F.col("hi")).select("form")
    members = digests.join(mixed, "form", "left_semi")
    texts = members.select("form", "own").distinct()
    a = texts.select("form", F.col("own").alias("own_a"))
    b = texts.select("form", F.col("own").alias("own_b"))
    pairs = a.join(b, "form").filter(F.col("own_a") < F.col("own_b")).select("own_a", "own_b")
    left = members.select(F.col("doc_id").alias("x"), F.col("own").alias("own_a")).distinct()
    right = members.select(F.col("doc_id").alias("y"), F.col("own").alias("own_b")).distinct()
    return (
        pairs.join(left, "own_a")
        .join(right, "own_b")
        .filter(F.col("x") != F.col("y"))
        .select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
        .distinct()
    )
