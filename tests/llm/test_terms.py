import datetime as dt
from collections import Counter, defaultdict
from math import log

import duckdb
import pytest

from tracewright.llm import queries, terms

SCHEMA = "file_name string, chunk_no int, token string, count int, loaded_at timestamp, term string, tf int, files int"
T = lambda n: dt.datetime(2025, 1, 1, 0, 0, n)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1) for r in rows], SCHEMA)


ROWS = [
    ("a", 1, " Uid=1''", 2, T(1)),
    ("a", 1, " Uid=1''", 5, T(2)),
    ("a", 1, " Uid=1''", 5, T(2)),
    ("a", 2, "uid=1", 1, T(1)),
    ("b", 1, "uid=1", 1, T(1)),
    ("b", 1, "x", 9, T(1)),
    ("b", 1, "x", 0, T(2)),
    ("c", 1, "A0=z", 4, T(1)),
    ("c", 1, "y", None, T(1)),
    ("c", 1, None, 3, T(1)),
    ("c", 1, "   ", 3, T(1)),
    (None, 1, "uid=1", 3, T(1)),
    ("d", 1, "w" * 100_000, 1, None),
]


def test_frequency_cases(spark):
    got = {r["token"]: tuple(r)[1:] for r in terms.term_frequency(table(spark, ROWS)).collect()}
    assert got == {"uid=1": (7, 2, "kept"), "w" * 100_000: (1, 1, "rare")}
    common = [(f, 1, "t", 1, T(1)) for f in "abcd"]
    assert [tuple(r) for r in terms.term_frequency(table(spark, common)).collect()] == [("t", 4, 4, "common")]


def test_empty(spark):
    empty = table(spark, [])
    assert terms.term_frequency(empty).count() == terms.term_relevance(empty).count() == terms.distinctive_terms(empty).count() == 0


def test_relevance_against_brute_force(spark):
    rows = [(f"f{i % 7}", i % 3, f"t{i * i % 11}", i % 5 + 1, T(i % 60)) for i in range(200)]
    last = {}
    for f, c, t, n, at in rows:
        last[f, c, t] = max(last.get((f, c, t), (T(0), 0)), (at, n))
    tf = Counter()
    for (f, _, t), (_, n) in last.items():
        tf[f, t] += n
    dl, df = Counter(), defaultdict(set)
    for (f, t), n in tf.items():
        dl[f] += n
        df[t].add(f)
    mean = sum(dl.values()) / len(dl)
    for r in terms.term_relevance(table(spark, rows)).collect():
        n, d = tf[r["file_name"], r["token"]], len(df[r["token"]])
        want = log(1 + (7 - d + 0.5) / (d + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl[r["file_name"]] / mean))
        assert r["tf"] == n and abs(r["score"] - want) < 1e-9


def test_hot_file_and_hot_term(spark):
    rows = [("hot", i, f"t{i}", 1, T(1)) for i in range(3000)] + [(f"f{i}", 1, "hot", 1, T(1)) for i in range(3000)]
    got = {r["token"]: (r["occurrences"], r["files"]) for r in terms.term_frequency(table(spark, rows)).collect()}
    assert got["hot"] == (3000, 3000) and len(got) == 3001


@pytest.mark.parametrize("name", ["p2_found", "p2_frequency", "p3_found", "p3_relevance", "p7_found", "p8_decoded"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("per_file_counts", "sample_features", "skill_catalog", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in rel.description]
    got = queries.QUERIES[name](spark, sf).select(*cols).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rel.fetchall()))


def test_score_bound_drops_no_distinctive_term(spark):
    """The rows over the least score hold every row that meets the conditions, at the edges too."""
    rows = [(f"f{i}", 1, f"t{j}", n, T(1)) for i in range(60) for j, n in ((i % 12, 1 + i % 3), (12 + i // 6, 1), (99, 9), (200 + i, 1 + 40 * (i % 2)))]
    scored = terms.term_relevance(table(spark, rows))
    want = scored.filter("tf * 10 >= file_length and tf * total >= term_total * file_length * 10 and files >= 2 and files * 10 <= file_count")
    key = lambda df: sorted((r["file_name"], r["token"]) for r in df.collect())
    assert key(terms.distinctive_terms(table(spark, rows))) == key(want) != []
