import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewright.llm import encoding, packing

SCHEMA = "doc_id bigint, text string, words string, ids int, known int"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(f"{encoding.TOKENIZERS}/{encoding.BYTE_BPE}")
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def table(spark, texts):
    return spark.createDataFrame([(i, t, "w", 1, 2) for i, t in enumerate(texts)], SCHEMA)


def check(spark, library, texts):
    docs = table(spark, texts)
    assert {r["doc_id"]: r["ids"] for r in encoding.encode(docs).collect()} == {i: library(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["tokens"] for r in encoding.token_counts(docs).collect()} == {i: len(library(t)) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in encoding.decode(encoding.encode(docs)).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_cases(spark, library):
    check(
        spark,
        library,
        [None, "", " ", "\n\n \t x", "The user's op's WE'LL 'tis", "<|endoftext|> a", "größe 任务 已完成。", "🚀⚠️✅ ✅", "a\x00b\x01c", "aaaaaaa aaaa", "  x​", "x" * 3000, " " * 2000 + "y", "=-" * 800, "0123456789" * 50],
    )


def test_long_words_and_many_words(spark, library):
    """Windows of long words meet in a common token; many rare words keep their places."""
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    check(spark, library, [letters(5000), "任务已完成日志系统记录会话" * 100, "a" * 5001 + "-" * 3003, " ".join(letters(7) for _ in range(4000)), "x" + "\u0301" * 700])


def test_windows_that_do_not_meet(spark, library, monkeypatch):
    monkeypatch.setattr(encoding, "WINDOWS", (2, 4, 8))
    check(spark, library, ["thequickbrownfoxjumps" * 3, "a" * 99, "任务已完成"])


def test_repeats_and_empty(spark, library):
    docs = table(spark, ["zebrafish quokka", "ok"]).union(table(spark, ["zebrafish quokka"]))
    assert sorted((r["doc_id"], r["ids"]) for r in encoding.encode(docs).collect()) == [(0, library("zebrafish quokka")), (1, library("ok"))]
    assert {r["doc_id"]: r["tokens"] for r in encoding.token_counts(docs).collect()} == {0: len(library("zebrafish quokka")), 1: 1}
    assert encoding.encode(table(spark, [])).count() == 0


@given(st.lists(st.text(max_size=60), min_size=20, max_size=40))
@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
def test_any_text(spark, library, texts):
    check(spark, library, texts)


def test_histogram_packing():
    for counts in ({}, {3000: 4}, {1: 10}, {1500: 3, 1501: 3}, {1000: 100, 700: 99, 300: 500, 2900: 7}, {k: (k * 7919) % 40 for k in range(1, 900)}):
        used = {}
        containers = 0
        for filling, n in packing.pack_histogram(counts, 3000):
            assert 0 < sum(a * b for a, b in filling.items()) <= 3000
            containers += n
            for length, k in filling.items():
                used[length] = used.get(length, 0) + k * n
        assert used == {k: v for k, v in counts.items() if v}
        volume = sum(k * v for k, v in counts.items())
        if max(counts, default=0) <= 1000:
            assert containers <= -(-volume // 3000) * 1.02 + 1


@pytest.mark.parametrize("counts", [{2000: 1_000_000, 300: 10}, {k: 1_000_000 for k in range(1590, 1611)}, {2000: 10**6, 500: 10**6, 7: 999}])
def test_fillings_do_not_grow_with_pieces(counts):
    """Where no filling is nearly full, equal containers are still one filling."""
    fillings = packing.pack_histogram(counts, 3000)
    assert len(fillings) <= 4 * len(counts)
    assert all(0 < sum(a * b for a, b in f.items()) <= 3000 for f, _ in fillings)
    assert {x: sum(f.get(x, 0) * n for f, n in fillings) for x in counts} == counts
    assert sum(n for _, n in fillings) <= sum(n for x, n in counts.items() if x > 1500) + 1


def test_best_fit_against_single_pieces():
    """Groups of equal containers hold what best fit makes piece by piece."""
    rng = np.random.default_rng(0)
    for _ in range(30):
        left = np.zeros(101, np.int64)
        left[rng.integers(1, 101, 12)] = rng.integers(0, 40, 12)
        rooms = []
        for length in np.flatnonzero(left)[::-1]:
            for _ in range(left[length]):
                fits = [r for r in rooms if r >= length]
                room = min(fits, default=100)
                if fits:
                    rooms.remove(room)
                rooms.append(room - int(length))
        got = [(100 - sum(a * b for a, b in f.items()), n) for f, n in packing.best_fit(left, 100)]
        assert sorted(rooms) == sorted(r for r, n in got for _ in range(n))


def test_lower_bound():
    assert packing.lower_bound({}, 10) == 0
    assert packing.lower_bound({6: 5}, 10) == 5  # none fit together
    assert packing.lower_bound({6: 5, 4: 5}, 10) == 5 and packing.lower_bound({6: 5, 5: 5}, 10) == 8
    assert packing.lower_bound({10: 3, 1: 1}, 10) == 4


def test_scaled_histogram():
    """Ten thousand times the pieces: fillings stay bounded by the lengths, containers near the bound."""
    counts = {k: 10_000 * (1 + (k * 7919) % 40) for k in range(1, 900)}
    fillings = packing.pack_histogram(counts, 3000)
    assert len(fillings) <= 4 * len(counts)
    assert sum(n for _, n in fillings) <= packing.lower_bound(counts, 3000) * 1.01 + 1


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)
    sizes = [(i, (i * 37) % 400) for i in range(400)] + [(1000 + i, 120) for i in range(300)] + [(5000, 7001), (5001, None), (None, 5)]
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id bigint, tokens bigint"), capacity=1000).collect()
    filled = {}
    for r in rows:
        filled[r["container"]] = filled.get(r["container"], 0) + r["length"]
    assert max(filled.values()) <= 1000
    assert sorted((r["doc_id"], r["part_no"]) for r in rows) == sorted([(i, 0) for i, n in sizes if i is not None and n and n <= 1000] + [(5000, k) for k in range(8)])
    total = sum(n for i, n in sizes if i is not None and n)
    assert sum(filled.values()) == total and len(filled) <= -(-total // 1000) * 1.02 + 1
    empty = packing.pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"))
    assert empty.count() == 0 and packing.packing_report(empty).first()["containers"] == 0
