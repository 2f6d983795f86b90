import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import lookalikes as lk
from tracewright.llm import splits

SAMPLES = "file_name string, label int, built_at int, last string, key string"
CATALOG = "skill string, renamed_to string, added_at int, name string"


def grouped(spark, names, renames):
    s = spark.createDataFrame([(n, 0, 1, "", "") for n in names], SAMPLES)
    c = spark.createDataFrame([(a, b, i, "") for i, (a, b) in enumerate(renames)], CATALOG)
    return {r["file_name"]: r["group_key"] for r in splits.grouped_samples(s, c).collect()}


def test_group_keys(spark):
    names = ["A_b_Prompt_3_audit-logs.log", "x_prompt_2_y_prompt_4_audit-logs.log", "bare--Name_audit-logs.log", "x_prompt_2_theme_audit-logs.log", "c1_prompt_1_audit-logs.log", None, "", "r0_prompt_1_audit-logs.log"]
    renames = [("a.B", "mid one"), ("MID_ONE", "End"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("same", "same"), (None, "z"), ("z", None), *[(f"r{i}", f"r{i + 1}") for i in range(40)]]
    assert grouped(spark, names, renames) == {names[0]: "end", names[1]: "x-prompt-2-y", names[2]: "bare-name", names[3]: "x-prompt-2-theme", names[4]: "c1", "": "", names[7]: "r40"}
    assert grouped(spark, [], []) == {}


def test_difference_is_balanced():
    rng = np.random.default_rng(1)
    w = rng.integers(1, 50, (2000, 3))
    at = splits.difference(w, 20)
    loads = np.bincount(at, w.sum(1), 20)
    assert loads.max() - loads.min() <= 3 and len(at) == 2000
    assert list(splits.difference(np.array([[5, 0, 0]]), 4)) == [0] and len(splits.difference(np.zeros((0, 3)), 4)) == 0


def test_split_shares(spark):
    rows = [(f"g{i % 400}" if i % 3 else "hot", i % 2 if i % 5 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "group_key string, label int").unionByName(spark.createDataFrame([(None, 1)], "group_key string, label int"))
    for shard in (20_000, 60):
        out = splits.grouped_split(df, bins=40, shard=shard).collect()
        assert len(out) == 6001 and all(r["split"] for r in out)
        where = {}
        for r in out:
            where.setdefault(r["group_key"], set()).add(r["split"])
        assert all(len(v) == 1 for v in where.values())
        n = Counter(r["split"] for r in out)
        ones = Counter(r["split"] for r in out if r["label"] == 1)
        for k, share in splits.SPLITS:
            assert abs(n[k] / 6001 - share) < 0.02
            assert abs(ones[k] / n[k] - 2401 / 6001) < 0.06
    assert splits.grouped_split(df.limit(0)).count() == 0


ONE = {p[0]: p[-1] for p in lk.LOOKALIKES.split()} | {h: "-" for h in lk.HYPHENS}


def plain(s):
    """The same form, text by text, with the library's own normalisation."""
    out = []
    for ch in s:
        if lk._unseen(ch):
            continue
        d = unicodedata.decomposition(ch)
        for x in ch if ch in ONE or d.startswith(lk._STAY) else unicodedata.normalize("NFKD", ch):
            if not lk._unseen(x):
                out.append(" " if unicodedata.category(x) == "Zs" else ONE.get(x, x))
    s = "".join(out)
    return unicodedata.normalize("NFC", s)


alphabet = st.characters(codec="utf-8", max_codepoint=0xABFF) | st.sampled_from("еᄀ가Åéﬁﬃ０Ａ​­ ‑̧̈ё́àạ̀")


@given(st.lists(st.none() | st.text(alphabet, max_size=25), max_size=20))
@settings(max_examples=300, deadline=None)
def test_unify_against_strings(texts):
    got = lk.unify_array(pa.array(texts, pa.string())).to_pylist()
    assert got == [None if t is None else plain(t) for t in texts]
    assert lk.unify_array(pa.array(got, pa.string())).to_pylist() == got


def test_forms():
    pairs = [("ﬁle Ａ１", "file A1"), ("é", "é"), ("a​b﻿­c", "abc"), ("x y　z", "x y z"), ("арр", "app"), ("non‑stop", "non-stop"), ("ḉ", "ḉ")]
    for a, b in pairs:
        assert lk.unify_array(pa.array([a, b])).to_pylist()[0] == lk.unify_array(pa.array([a, b])).to_pylist()[1]
    kept = ["A", "a", "é", "e", "1", "2", "a  b", "a b", "a\tb", "a\nb", "x²", "x2", "", "."]
    assert len(set(lk.unify_array(pa.array(kept)).to_pylist())) == len(kept)


def test_pairs(spark):
    docs = [(1, "file", "f"), (2, "ﬁle", "f"), (3, "file", "f"), (4, None, ""), (5, "", ""), (6, "​", ""), (7, "File", ""), (8, "x" * 300_000, ""), (9, "x" * 300_000 + "​", ""), (2, "ﬁle", "f"), (None, "file​", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, form string")
    assert sorted(map(tuple, lk.same_look_pairs(df).collect())) == [(1, 2), (2, 3), (5, 6), (8, 9)]
    assert lk.same_look_pairs(df.limit(0)).count() == 0


def test_groups_against_pairs(spark):
    texts = ["ab", "\uff41b", "\u0430b", "ab", "x", None, "", "a\u0007b", "\u0600 1"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    groups = {r["doc_id"]: (r["class_id"], r["links"]) for r in lk.same_look_groups(docs).collect()}
    assert groups == {0: (0, 3), 1: (0, 4), 2: (0, 4), 3: (0, 3), 4: (4, 0), 6: (6, 0), 7: (0, 4), 8: (8, 0)}
    pairs = [tuple(r) for r in lk.same_look_pairs(docs).collect()]
    assert sum(n for _, n in groups.values()) == 2 * len(pairs)
    assert lk.same_look_groups(docs.limit(0)).count() == 0
