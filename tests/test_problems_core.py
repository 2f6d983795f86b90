"""Problems 1, 5 and 6: small cases for every defined result, and brute force."""

import datetime as dt
import json

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.operators import logparse, nested, orphans
from tracewright.plans import core_queries
from tracewright.runtime import read_table

D = dt.datetime
SAMPLES = "file_name string, label int, has_audit boolean, has_pcap boolean, built_at timestamp_ntz, retired_at timestamp_ntz, runs string, status string, __num int"
FILES = "file_name string, received_at timestamp_ntz, deleted_at timestamp_ntz, parent int"
PCAPS = "pcap_name string, received_at timestamp_ntz, deleted_at timestamp_ntz"
RESULTS = "result_id bigint, sample_id string, scored_at timestamp_ntz"


def found(spark, samples=(), audit=(), pcap=(), results=()):
    s = spark.createDataFrame([(*r, None, None, None) for r in samples], SAMPLES)
    a = spark.createDataFrame([(*r, 1) for r in audit], FILES)
    df = orphans.session_orphans(s, a, spark.createDataFrame(list(pcap), PCAPS), spark.createDataFrame(list(results), RESULTS))
    return sorted(map(tuple, df.collect()), key=str)


def test_orphans_empty_tables(spark):
    assert found(spark) == []


def test_orphans_every_status(spark):
    built = D(2025, 3, 4)
    rows = [
        ("a_prompt_1_audit-logs.log", 0, True, None, built, None),
        ("a_prompt_2_audit-logs.log", 0, True, True, built, None),
        ("a_prompt_3_audit-logs.log", 0, True, False, built, None),
        ("a_prompt_03_audit-logs.log", 0, True, False, None, None),
        ("b_audit-logs.log", None, True, None, built, None),
        (None, None, True, None, built, None),
    ]
    audit = [
        (" A_Prompt_1_AUDIT-LOGS.LOG\t", D(2025, 1, 1), None),
        ("a_prompt_2_audit-logs.log", D(2025, 1, 1), D(2025, 1, 2)),
        ("a_prompt_3_audit-logs.log", D(2025, 5, 1), None),
        ("a_prompt_3_audit-logs.log", D(2025, 1, 1), D(2025, 1, 2)),
        ("﻿b_audit-logs.log", None, None),
        (None, None, None),
    ]
    got = found(spark, rows + rows[:2], audit, [("a_prompt_2_network.pcap", D(2025, 1, 1), None)])
    assert got == sorted(
        [
            ("audit", "a_prompt_2_audit-logs.log", "2025-03", "deleted"),
            ("audit", "a_prompt_3_audit-logs.log", "2025-03", "late"),
            ("audit", "a_prompt_03_audit-logs.log", "unknown", "missing"),
            ("audit", None, "2025-03", "missing"),
        ],
        key=str,
    )


def test_results_refer_to_samples(spark):
    rows = [("s_prompt_7_audit-logs.log", 0, False, False, D(2025, 2, 1), None), ("s_prompt_8_audit-logs.log", 0, False, False, D(2025, 2, 1), D(2025, 3, 1))]
    results = [(1, "S_prompt_7 ", D(2025, 1, 1)), (2, "s_prompt_7_network.pcap", D(2025, 3, 1)), (3, "s_prompt_8", None), (4, None, None), (5, "", None), (6, "s_prompt_9", D(2025, 3, 1)), (6, "s_prompt_9", D(2025, 3, 1))]
    assert found(spark, rows, results=results) == [
        ("sample", "1", "2025-01", "late"),
        ("sample", "3", "unknown", "deleted"),
        ("sample", "5", "unknown", "missing"),
        ("sample", "6", "2025-03", "missing"),
    ]


def test_runs_are_contiguous_and_bounded(spark):
    names = [f"k_{i}" for i in [*range(5, 9), 11, *range(1020, 1030)]] + ["k_", "k_007", "k_" + "9" * 30]
    p = spark.createDataFrame([("t", n, False, None) for n in names], "parent string, name string, gone boolean, came timestamp")
    runs = {(r["__stem"], x["lo"], x["hi"]) for r in orphans.key_runs(p).collect() for x in r["runs"]}
    assert {("k_", 5, 8), ("k_", 11, 11), ("k_", 1020, 1023), ("k_", 1024, 1029), ("k_00", 7, 7), ("k_", -1, -1)} <= runs


@pytest.mark.parametrize("name", sorted(core_queries.ORACLE))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("sample_features", "audit_files", "pcap_files", "results", "session_log", "audit_raw"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.execute(core_queries.ORACLE[name])
    cols = [c[0] for c in rel.description]
    got = core_queries.QUERIES[name](spark, sf).select(*cols).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rel.fetchall()))


RAW = "file_name string, line_no int, msg string, entry string"


def entries(spark, lines, started=D(2025, 5, 1)):
    raw = spark.createDataFrame([(*x, "x") for x in lines], RAW)
    files = spark.createDataFrame([("f", started)] if started else [], "file_name string, started_at timestamp_ntz")
    return sorted(tuple(r)[1:6] for r in logparse.log_entries(raw, files).collect())


def test_layouts(spark):
    lines = [
        "cut off head",
        "20/Apr/2026:13:07:39.450 +0200 ERR planner: cannot read",
        "  more",
        "",
        "2026-04-20 13:07:56,370 - agent-core - \x1b[31mWarn\x1b[0m - cache holds 3",
        "[2026-04-20T13:08:01.859999Z]\t[information]\t[sandbox]\terror here",
        "<75>1 2025-11-03T05:48:30.096+05:30 box-1 relayd 5426 ID76 - warning count is 3",
        "W0420 12:28:38.247633  6283 executor.go:728] query\r",
        "time=2026-04-20T12:28:39.933Z component=webfetch level=Crit msg=\"error\" n=65",
        "node=box-1 type=CWD msg=audit(1776688120.726:78473): cwd=\"/\"",
        "<25>Jun  1 03:12:20 box-2 sshlet[20549]: lease",
        "Jun 11 03:12:20 box-2 kernel: lease",
        '{"logger": "queue.worker", "msg": "a \\"b\\" ERROR", "lvl": "dbg", "ts": "2025-12-18T17:33:23.955Z", "ctx": {"n": 5}}',
        "{",
        '  "ts": 1766079203954,',
        '  "lvl": "F",',
        '  "logger": "sandbox",',
        '  "msg": "took"',
        "}",
        "Jan was the owner of ladder",
        "{",
        "} end of needle",
        " \r",
    ]
    assert entries(spark, [("f", i, m) for i, m in enumerate(lines, 1)]) == [
        (2, 3, "2026-04-20 11:07:39.450", "ERROR", "planner"),
        (5, 5, "2026-04-20 13:07:56.370", "WARN", "agent-core"),
        (6, 6, "2026-04-20 13:08:01.859", "INFO", "sandbox"),
        (7, 7, "2025-11-03 00:18:30.096", "", "relayd"),
        (8, 8, "2025-04-20 12:28:38.247", "WARN", "executor.go"),
        (9, 9, "2026-04-20 12:28:39.933", "FATAL", "webfetch"),
        (10, 10, "2026-04-20 12:28:40.726", "", "CWD"),
        (11, 11, "2025-06-01 03:12:20.000", "", "sshlet"),
        (12, 12, "2025-06-11 03:12:20.000", "", "kernel"),
        (13, 13, "2025-12-18 17:33:23.955", "DEBUG", "queue.worker"),
        (14, 22, "2025-12-18 17:33:23.954", "FATAL", "sandbox"),
    ]


def test_log_edge_cases(spark):
    assert entries(spark, []) == []
    assert entries(spark, [("f", 1, None), (None, 1, "I0420 12:28:38.2 1 a.go:1] x"), ("f", None, "x")]) == []
    line = "I0420 12:28:38.247633  6283 executor.go:728] x"
    assert entries(spark, [("f", 1, line), ("f", 1, line), ("f", 3, "y" * 200_000)], None) == [(1, 3, None, "INFO", "executor.go")]


def test_layouts_of_frequent_templates(spark):
    """A head that the grammar does not know is a layout where its n-grams are frequent, and text where not."""
    other = ["worker-1|2026-04-20T13:08:01Z|WARN|net.io| took 3", "  more", "worker-2|2026-04-20T13:08:02Z|FATAL|disk.io| lost 4"]
    want = [(1, 2, "2026-04-20 13:08:01.000", "WARN", "net.io"), (3, 3, "2026-04-20 13:08:02.000", "FATAL", "disk.io")]
    assert entries(spark, [("f", i, m) for i, m in enumerate(other, 1)]) == want
    once = ["Jun 11 03:12:20 box-2 kernel: a", other[0]]
    assert [r[:2] for r in entries(spark, [("f", i, m) for i, m in enumerate(once, 1)])] == [(1, 2)]


def test_no_entries_without_dictionaries(spark, sf, monkeypatch):
    """Heads are found by the n-grams: without them no line of the table starts an entry."""
    raw, files = (read_table(spark, sf, n) for n in ("audit_raw", "audit_files"))
    assert logparse.log_entries(raw, files).count() > 100
    monkeypatch.setattr(logparse, "frequent_ngrams", lambda *a: set())
    assert logparse.log_entries(raw, files).count() == 0


def test_roles_come_from_templates(spark, sf, monkeypatch):
    """What a line's template does not say is not known: were all lines of one template, none would start an entry."""
    raw, files = (read_table(spark, sf, n) for n in ("audit_raw", "audit_files"))
    monkeypatch.setattr(logparse, "template_of", lambda *a: ("<*>",))
    assert logparse.log_entries(raw, files).count() == 0


def test_words_dictionary_finds_heads(spark, sf, monkeypatch):
    """The dictionary of words as they stand finds most entries alone; that of types is for what it leaves open."""
    raw, files = (read_table(spark, sf, n) for n in ("audit_raw", "audit_files"))
    both, whole = logparse.dictionaries, logparse.log_entries(raw, files).count()
    monkeypatch.setattr(logparse, "dictionaries", lambda lines: (both(lines)[0], set()))
    assert logparse.log_entries(raw, files).count() > whole / 2


def test_template_holds_what_roles_need():
    """Type and constancy of each token are read from its mark alone."""
    shapes, types = ["<T>", "box-0", "<S>", "key=", '"m":', ":", "<L>", "foo", "<T>"], ["T", "W", "W", "K", "M", ":", "L", "W", "T"]
    template = logparse.template_of(shapes, types, [True, True, True, False, False, True, False, False, False], [True] * 7 + [False] * 2)
    assert template == ("<T>", "box-0", '"<W>"', "<*>=", '"<*>":', ":", "<L>", "?W", "?T")
    assert [logparse.mark_type(m)[0] for m in template] == types
    assert [logparse.mark_type(m)[1] for m in template] == [True] * 7 + [False] * 2
    assert logparse.template_roles(("<T>", "box-0", "sshlet", "[", "<N>", "]", ":", "<*>")) == ("line", 0, -1, 2)
    assert logparse.template_roles(("<*>", "|", "<T>", "|", "<L>", "|", "<*>", "|")) is None
    assert logparse.template_roles(("worker-0", "|", "<T>", "|", "<L>", "|", "<*>", "|")) == ("line", 2, 4, 6)


def test_fields_far_behind(spark):
    """Whole lines count: a head may be long, and an object's time behind many members."""
    far = "[" + " ".join(f"k{i}=v{i}" for i in range(40)) + "] x"
    line = "time=2026-04-20T12:28:39.933Z " + " ".join(f"n{i}={i}" for i in range(40)) + " level=Crit component=webfetch msg=1"
    assert entries(spark, [("f", 1, far), ("f", 2, line)]) == [(2, 2, "2026-04-20 12:28:39.933", "FATAL", "webfetch")]


def test_members_behind_the_head(spark):
    """An object in one line has its time, level and logger behind many members or a nested object."""
    many = "{" + "".join(f'"k{i}": {i}, ' for i in range(30)) + '"ctx": {"at": "2020-01-01T00:00:00Z", "who": "x"}, "ts": "2025-12-18T17:33:23.955Z", "lvl": "dbg", "logger": "queue.worker"}'
    assert entries(spark, [("f", 1, "Jun 11 03:12:20 box-2 kernel: a"), ("f", 2, many)])[1:] == [(2, 2, "2025-12-18 17:33:23.955", "DEBUG", "queue.worker")]


def test_entries_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(logparse, "BLOCK", 4)
    lines = ["Jun 11 03:12:20 box-2 kernel: a", *["more"] * 10, "x", "{", '  "ts": 1766079203954,', "}", *["more"] * 5, " "]
    want = [(1, 12, "2025-06-11 03:12:20.000", "", "kernel"), (13, 20, "2025-12-18 17:33:23.954", "", "")]
    for pad in range(4):
        shifted = [("f", i, m) for i, m in enumerate(["z"] * pad + lines, 1)]
        assert entries(spark, shifted) == [(a + pad, b + pad, *r) for a, b, *r in want]


def brute(value, path, out):
    if isinstance(value, str):
        try:
            inner = json.loads(value.strip())
        except ValueError:
            return
        if isinstance(inner, (dict, list)):
            brute(inner, path, out)
    elif isinstance(value, dict):
        out.add(path)
        for k, v in value.items():
            brute(v, f"{path}.{k}", out)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            brute(v, f"{path}[{i}]", out)


def objects(text):
    return {r[1] for r in nested.label_nodes(text) if r[3] == "object"}


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=4), c, max_size=3) | c.map(json.dumps), max_leaves=12)


@given(values)
@settings(max_examples=150, deadline=None)
def test_nodes_against_brute_force(value):
    text = json.dumps(value)
    want = set()
    brute(json.loads(text), "$", want)
    assert objects(text) == want
    labels = {r[0] for r in nested.label_nodes(text)}
    assert all("." not in x or x.rpartition(".")[0] in labels for x in labels)
    assert nested._decode_deep(text) == nested.parse_json(text)


def test_json_edge_cases():
    assert objects("") == objects(None) == objects("  ") == objects("{") == objects('{"a":NaN}') == objects('{"a":1} x') == set()
    assert objects('{"a":{},"a":[{}]}') == {"$", "$.a", "$.a[0]"}
    assert objects('"{\\"a\\": \\" [{}] \\"}"') == {"$", "$.a[0]"}
    assert objects('{"n":' + "9" * 5000 + "}") == {"$"}
    assert len(nested.label_nodes("[" * 3000 + "]" * 3000)) == 3000


def test_nested_tables(spark):
    item = "struct<type:string,text:string,id:string,name:string,arguments:string>"
    schema = f"entry_id bigint, session_id string, line_no int, message struct<role:string,api:string,content:array<{item}>>, item_no int, node string"
    call = lambda a: ("toolCall", None, "c", "n", a)
    rows = [
        (1, "s", 1, ("assistant", None, [("text", "x", None, None, '{"no":1}'), call('{"a":{"b":1,"c":[1]}}')]), 0, ""),
        (1, "s", 1, ("assistant", None, [("text", "x", None, None, '{"no":1}'), call('{"a":{"b":1,"c":[1]}}')]), 0, ""),
        (2, "s", 2, None, 0, ""),
        (3, "s", 3, ("assistant", None, None), 0, ""),
        (4, "s", 4, ("assistant", None, [call(None), call(""), None]), 0, ""),
        (None, "s", 5, ("assistant", None, [call("{}")]), 0, ""),
    ]
    log = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, nested.nested_objects(log).collect())) == [(1, 1, "$"), (1, 1, "$.a")]
    nodes = {r["dewey"]: r for r in nested.argument_nodes(log).collect()}
    assert nodes["1.1.2.1"]["parent"] == "1.1.2" and nodes["1"]["parent"] is None and nodes["1.1.2.1"]["schema_path"] == "$.a.c[*]"
    tables = {r["path"]: r["members"] for r in nested.schema_tables(nested.argument_nodes(log)).collect()}
    assert tables == {"$": None, "$.a": {"b": "1"}}
    assert nested.nested_objects(log.limit(0)).count() == 0


def test_found_over_table(spark, sf):
    want = set()
    for e, m in duckdb.execute(f"SELECT entry_id, message FROM '{sf}/session_log.parquet' WHERE message IS NOT NULL").fetchall():
        for i, it in enumerate(m["content"] or []):
            if it["type"] == "toolCall" and it["arguments"]:
                out = set()
                try:
                    brute(json.loads(it["arguments"]), "$", out)
                except ValueError:
                    continue
                want |= {(e, i, p) for p in out}
    assert {tuple(r) for r in nested.nested_objects(read_table(spark, sf, "session_log")).collect()} == want
