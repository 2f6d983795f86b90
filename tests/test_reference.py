"""The reference's operators: SQL of every query, hand-built inputs, and properties."""

import json
import struct
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.config import Settings, settings_from_json
from tracewright.functions import net
from tracewright.functions import text as tx
from tracewright.ml import encoder, judge, svm
from tracewright.operators import cv, flow, metrics, sessions, tokens, trajectory
from tracewright.plans import cli, detect, pipeline_queries, reference_queries
from tracewright.sources import files, packets


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def shown(v):
    return "nan" if isinstance(v, float) and np.isnan(v) else repr(v)


QUERIES = reference_queries.QUERIES | pipeline_queries.QUERIES
ORACLE = reference_queries.ORACLE | pipeline_queries.ORACLE


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, sf, con, name):
    rel = con.execute(ORACLE[name])
    cols = [c[0] for c in rel.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(cols)
    got = sorted([*map(shown, r)] for r in df.select(*cols).collect())
    assert got == sorted([*map(shown, r)] for r in rel.fetchall())


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "line,want",
    [
        ("type=SYSCALL Arch=c0 comm=\"A B\" key=(null) msg=audit(1:2):", ["type=syscall", "arch=c0", 'comm="a b"', "key=(null)"]),
        ("msg='op=login acct=\"x\" res=success'", ["acct=\"x\"", "res=success"]),
        ('a="open b=1', ['a="open', "b=1"]),
        ("größe=5 a=1\x1dB=2", ["größe=5", "a=1", "b=2"]),
        ("", []),
        (None, []),
        ('x="', ['x=""']),
    ],
)
def test_kv_tokens(spark, line, want):
    assert one(spark, line, tx.kv_tokens) == want


def test_text_functions(spark):
    assert one(spark, "6162", tx.hex_text) == "ab" and one(spark, "616", tx.hex_text) == "" and one(spark, "ff41", tx.hex_text) == "�A"
    assert one(spark, "a_prompt_1_audit-logs.log", tx.skill_id) == "a" and one(spark, "a.b.log", tx.skill_id) == "a.b"
    assert one(spark, "s_audit-logs.log", tx.pcap_name) == "s_network.pcap" and one(spark, "s_network.pcap", tx.audit_name) == "s_audit-logs.log"
    for answer, label in (("<Judgment> UNSAFE </Judgment>", 1), ("<Judgment>safe</Judgment> unsafe", 0), ("looks Unsafe", 1), ("fine", 0), (None, 0)):
        assert one(spark, answer, tx.judged_unsafe) == label == judge.answer_label(answer)


@pytest.mark.parametrize("n,sizes", [(0, [0]), (10, [10]), (3000, [3000, 300]), (2800, [2800, 100]), (5401, [3000, 2701, 1])])
def test_windows(spark, n, sizes):
    w = one(spark, list(range(n)), lambda c: tx.windows(c, 3000, 2700, False), "array<int>")
    assert [len(x["tokens"]) for x in w] == sizes
    chunks = one(spark, list(range(n)), lambda c: tx.windows(c, 384, 384, True), "array<int>")
    assert [t for x in chunks for t in x["tokens"]] == list(range(n)) and len(chunks) == max(1, -(-n // 384))


def test_distribution_against_dense(spark):
    rng = np.random.default_rng(3)
    rows = [(f"f{i}", f"t{j}", int(rng.integers(1, 9))) for i in range(23) for j in range(12) if rng.random() < j / 11 or (i, j) == (0, 0)]
    out = {r["token"]: r for r in tokens.token_distribution(spark.createDataFrame(rows, "file_name string, token string, count bigint")).collect()}
    names = sorted({r[0] for r in rows})
    for t, r in out.items():
        dense = np.array([sum(c for f, k, c in rows if (f, k) == (n, t)) for n in names], float)
        want = [dense.sum(), dense.mean(), np.percentile(dense, 25), np.percentile(dense, 50), np.percentile(dense, 75), dense.max(), dense.min(), dense.std(ddof=1)]
        got = [r[k] for k in ("total_count", "avg_per_file", "p25_per_file", "median_per_file", "p75_per_file", "max_per_file", "min_per_file", "std_per_file")]
        assert np.allclose(want, got, atol=6e-5), t
    single = tokens.token_distribution(spark.createDataFrame([("f", "t", 3)], "file_name string, token string, count bigint")).first()
    assert single["std_per_file"] == 0 and single["median_per_file"] == 3
    assert tokens.token_distribution(spark.createDataFrame([], "file_name string, token string, count bigint")).count() == 0


ITEM = "struct<type:string,text:string,id:string,name:string,arguments:string>"


def test_trajectory(spark):
    t = lambda x: [("text", x, None, None, None)]
    rows = [
        (1, "assistant", None, t("intro")),
        (2, "user", None, t("q1")),
        (3, "assistant", "openai-completions", [("text", " a ", None, None, None), ("toolCall", None, "1", "n", "{}")]),
        (4, "assistant", "cli", t(" a ")),
        (5, "assistant", "openai-completions", [("text", " a ", None, None, None), ("toolCall", None, "1", "n", "{}")]),
        (6, "toolResult", None, [("image", None, "1", None, None)]),
        (7, "assistant", "openai-completions", []),
        (8, "user", None, t("q2")),
        (9, "assistant", "x", t("b")),
        (10, "assistant", "x", t("b")),
    ]
    log = spark.createDataFrame([("s", n, "message", (r, a, c)) for n, r, a, c in rows], f"session_id string, line_no int, type string, message struct<role:string,api:string,content:array<{ITEM}>>")
    msgs = trajectory.messages(log.union(log))
    assert sorted(r["line_no"] for r in trajectory.deduplicated(msgs).collect()) == [1, 2, 3, 6, 7, 8, 9]
    got = [(r["line_no"], r["round_no"]) for r in trajectory.rounds(trajectory.turns(msgs)).orderBy("line_no").collect()]
    assert got == [(1, 1), (2, 2), (3, 2), (6, 2), (8, 3), (9, 3)]
    text = trajectory.rendered(trajectory.turns(msgs), "P").first()["text"]
    assert text.startswith("=== Agent Profile ===\nP\n\n=== Conversation History ===\n\n[AGENT]:\n[THOUGHT]: intro\n\n[USER]: q1\n\n[AGENT]:\n[THOUGHT]: a\n[ACTION]: {")
    assert trajectory.rendered(trajectory.turns(trajectory.messages(log.limit(0)))).count() == 0


def udp(src, dst, sport, dport, payload):
    body = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload
    return ip(src, dst, 17, body)


def tcp(src, dst, sport, dport, payload):
    return ip(src, dst, 6, struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, 0x18, 0, 0, 0) + payload)


def ip(src, dst, proto, body):
    head = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, bytes(src), bytes(dst))
    return b"\0" * 12 + b"\x08\x00" + head + body


def dns(name):
    q = b"".join(bytes([len(p)]) + p.encode() for p in name.split(".")) + b"\0"
    return struct.pack(">HHHHHH", 1, 0x8180, 1, 1, 0, 0) + q + b"\0\1\0\1" + b"\xc0\x0c" + b"\0\1\0\1\0\0\0\x05\0\4\1\2\3\4"


def hello(name):
    sni = struct.pack(">HBH", len(name) + 3, 0, len(name)) + name.encode()
    ext = struct.pack(">HH", 0, len(sni)) + sni
    body = b"\x03\x03" + b"\0" * 32 + b"\0" + struct.pack(">H", 2) + b"\0\1" + b"\1\0" + struct.pack(">H", len(ext)) + ext
    shake = b"\1" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(shake)) + shake


HOME, AWAY = (10, 0, 0, 2), (93, 184, 216, 34)


def pcap(frames, order="<", magic=0xA1B2C3D4, ticks=1_000_000):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for ts, f in frames:
        out += struct.pack(order + "IIII", int(ts), round(ts % 1 * ticks), len(f), len(f)) + f
    return out


def pcapng(frames):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    for ts, f in frames:
        t = round(ts * 1_000_000)
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f + b"\0" * (-len(f) % 4))
    return out


FRAMES = [
    (1.0, udp(HOME, (8, 8, 8, 8), 5000, 53, dns("Api.Example.com"))),
    (1.5, tcp(HOME, AWAY, 5001, 443, hello("tls.example.org")[:40])),
    (1.25, tcp(HOME, AWAY, 5001, 443, hello("tls.example.org")[40:])),
    (2.0, tcp(HOME, AWAY, 5002, 80, b"GET / HTTP/1.1\r\nHost: web.example.co")),
    (2.1, tcp(HOME, AWAY, 5002, 80, b"m\r\n\r\n")),
    (2.2, tcp(AWAY, HOME, 80, 5002, b"HTTP/1.1 200\r\nHost: no.example.com\r\n")),
    (3.0, b"\0" * 12 + b"\x08\x06" + b"\0" * 20),
    (3.5, b"\1\2"),
]


def test_captures(spark, tmp_path):
    (tmp_path / "le.pcap").write_bytes(pcap(FRAMES))
    (tmp_path / "be.pcap").write_bytes(pcap(FRAMES, ">"))
    (tmp_path / "nano.pcap").write_bytes(pcap(FRAMES, "<", 0xA1B23C4D, 1_000_000_000))
    (tmp_path / "ng.pcap").write_bytes(pcapng(FRAMES))
    (tmp_path / "empty.pcap").write_bytes(pcap([]))
    (tmp_path / "bad.pcap").write_bytes(b"nothing")
    rows = packets.packets(spark, str(tmp_path))
    assert [r["file"].rsplit("/", 1)[1] for r in rows.filter("error is not null").collect()] == ["bad.pcap"]
    got = {r["file"].rsplit("/", 1)[1]: r for r in detect.packet_features(rows).collect()}
    assert set(got) == {"le.pcap", "be.pcap", "nano.pcap", "ng.pcap"}
    for r in got.values():
        assert r["net_text"] == "dns:api.example.com sni:tls.example.org host:web.example.co host:web.example.com ip:8.8.8.8 ip:93.184.216.34"
        n = r["net_numeric"]
        assert n[0] == 8 and n[2] == sum(len(f) - 14 for _, f in FRAMES[:5]) and n[3] == len(FRAMES[5][1]) - 14 and n[5] == 2
        assert n[11] == 0.9 - 0.15 or abs(n[11] - 0.8) < 0.2 and n[12:] == [1.0, 1.0, 2.0]


def passes(df):
    """How often a plan goes through Python, and its shuffles."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("MapInArrow") + plan.count("MapInPandas"), plan.count("Exchange")


def test_features_read_captures_once(spark, sf, tmp_path):
    assert passes(pipeline_queries.packet_features(spark, sf)) == (1, 1)  # the exchange makes the captures
    long = [(float(i), tcp(HOME, AWAY, 6000, 80, b"x" * 1000 + b"\r\nHost: h%d.example.com\r\n" % i)) for i in range(70)]
    hidden = [(9.0, tcp(HOME, AWAY, 6001, 443, b"\x17" + hello("no.example.org"))), (8.0, tcp(HOME, AWAY, 6001, 443, hello("late.example.org"))), (8.5, tcp(HOME, (10, 0, 0, 9), 6002, 8080, b"Host: in.example.com\r\n"))]
    for name, frames in (("a", FRAMES), ("b", long + hidden), ("c", FRAMES[::-1]), ("d", FRAMES[6:]), ("e", [])):
        (tmp_path / f"{name}.pcap").write_bytes(pcap(frames))
    (tmp_path / "bad.pcap").write_bytes(b"nothing")
    by_file = {r["file"][-6:]: r[1:] for r in detect.capture_features(flow.file_captures(packets.captures(spark, str(tmp_path)))).collect()}
    mixed = packets.packets(spark, str(tmp_path)).repartition(3).orderBy(F.rand(1))
    assert by_file == {r["file"][-6:]: r[1:] for r in detect.packet_features(mixed).collect()} and set(by_file) == {"a.pcap", "b.pcap", "c.pcap", "d.pcap"}
    numbers, text = by_file["b.pcap"]
    assert numbers[0] == 73 and numbers[9] == round((69.0 + 0.5) / 72, 4) and numbers[11] == 1.0 and numbers[12:14] == [0.0, 0.0]
    # A flow is read up to 64 KiB.
    read = (b"".join(b"x" * 1000 + b"\r\nHost: h%d.example.com\r\n" % i for i in range(70)))[:65_536].count(b"Host:")
    assert numbers[14] == read + 1 and "host:in.example.com" in text and text.endswith("ip:93.184.216.34")


def test_names_read_captures_once(spark, sf, tmp_path):
    assert passes(pipeline_queries.packet_names(spark, sf)) == (1, 1)
    asked = [(float(i), udp(HOME, (8, 8, 8, 8), 5000, 53, dns(n))) for i, n in enumerate(("Api.Example.com", "api.example.com", "no_domain", "-x.example.com"))]
    (tmp_path / "a.pcap").write_bytes(pcap(FRAMES + asked))
    (tmp_path / "b.pcap").write_bytes(pcap(FRAMES[6:]))
    found = [(r["kind"], r["value"]) for r in detect.capture_names(flow.file_captures(packets.captures(spark, str(tmp_path)))).collect()]
    names = [(r["kind"], r["value"]) for r in detect.packet_names(packets.packets(spark, str(tmp_path))).collect()]
    want = ["dns:api.example.com", "host:web.example.co", "host:web.example.com", "ip:8.8.8.8", "ip:93.184.216.34", "sni:tls.example.org"]
    assert sorted(map(":".join, found)) == sorted(map(":".join, names)) == want


def test_net_functions(spark):
    for a, private in (((10, 1, 1, 1), True), ((172, 31, 0, 1), True), ((172, 32, 0, 1), False), ((192, 168, 9, 9), True), ((127, 0, 0, 1), True), ((8, 8, 8, 8), False), ((1, 2), False)):
        assert one(spark, bytearray(a), net.private_ipv4, "binary") is private
    assert one(spark, bytearray((1, 2, 3, 255)), net.ipv4_text, "binary") == "1.2.3.255" and one(spark, bytearray(16), net.ipv4_text, "binary") is None
    assert net.tls_server_name(hello("A.Example.com")) == "a.example.com" and net.tls_server_name(b"\x16\3\1") is None and net.tls_server_name(hello("a.example.com")[:-3]) is None
    assert one(spark, bytearray(b"GET\r\nHOST: A.example.com\r\nHost: b.example.com:80\r\n"), net.http_hosts, "binary") == ["a.example.com"]


def test_svm_and_folds(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.0, -2.0, 0.5] + 0.3 > 0).astype(int)
    df = spark.createDataFrame([(f"g{i % 37}", a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))], "g string, x array<double>, label int")
    w, b = svm.fit(df, "x", "label")
    assert ((x @ w + b > 0) == y).mean() > 0.97
    k = {int(c): 400 / (2 * (y == c).sum()) for c in (0, 1)}
    s = np.where(y == 1, 1.0, -1.0)
    gap = np.maximum(0, 1 - s * (x @ w + b))
    weight = np.array([k[int(c)] for c in y])
    assert np.abs(np.append(w - 2 * x.T @ (weight * gap * s), b - 2 * (weight * gap * s).sum())).max() < 1e-2
    sparse = df.withColumn("id", F.hash("x"))
    long = sparse.select("id", F.posexplode("x").alias("idx", "value"))
    scored = svm.sparse_scores(long, spark.createDataFrame(list(enumerate(w.tolist())), "idx int, weight double"), "id", b)
    assert abs(scored.agg(F.avg("predicted")).first()[0] - (x @ w + b > 0).mean()) < 1e-9
    folds = cv.group_folds(df, "g", "label", 5)
    assert folds.count() == folds.select("g").distinct().count() == 37
    per = df.join(folds, "g").groupBy("fold").count().collect()
    assert len(per) == 5 and max(r["count"] for r in per) - min(r["count"] for r in per) <= 30
    assert cv.group_folds(df, "g", "label", 5, shard=10).count() == 37


def test_settings():
    s = Settings(mode="pcap_only", svm_c=2.0)
    assert settings_from_json(s.to_json()) == s
    with pytest.warns(UserWarning):
        settings_from_json(json.dumps({"bundle_version": 1, "other": 2}))
    for bad in ({"mode": "x"}, {"audit_encoder": "x"}, {"pooling": "x"}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_encoder(spark):
    docs = spark.createDataFrame([("a", "one two three", True), ("b", None, True), ("c", "one", False), ("d", "w " * 900, None)], "k string, t string, has boolean")
    got = {r["k"]: np.array(r["embedding"]) for r in encoder.embed(docs, "k", "t", present="has", dim=64).collect()}
    assert abs(np.linalg.norm(got["a"]) - 1) < 1e-9 and not got["b"].any() and not got["c"].any() and not got["d"].any()
    assert [len(c.split()) for c in encoder.chunks_of("w " * 900, 384, 384)] == [384, 384, 132] and encoder.chunks_of(" ", 4, 4) == [""] and len(encoder.chunks_of("w " * 384, 384, 384)) == 1
    digest = docs.withColumn("content", F.sha2(F.coalesce("t", F.lit("")), 256))
    cache = digest.filter("k = 'a'").select("k", "content", F.array(F.lit(9.0)).alias("embedding"))
    out = {r["k"]: r["embedding"] for r in encoder.cached_embeddings(docs, cache, "k", "t", dim=64).collect()}
    assert out["a"] == [9.0] and len(out["d"]) == 64 and len(out) == 4


def test_metrics_edges(spark):
    empty = spark.createDataFrame([], "label int, pred int")
    m = metrics.detector_metrics(empty).first()
    assert (m["total"], m["accuracy"], m["recall"], m["fpr"]) == (0, 0.0, 0.0, 0.0)
    rows = spark.createDataFrame([(1, 1), (0, 1), (7, 1), (1, None), (None, 0)], "label int, pred int")
    m = metrics.detector_metrics(rows).first()
    assert (m["total"], m["tp"], m["tn"], m["fp"], m["fn"]) == (5, 1, 0, 1, 1)
    capped = tokens.sample_cap(spark.createDataFrame([(i % 2, f"n{i:03}") for i in range(300)], "label int, name string"), "label", "name", 5)
    assert sorted(r["name"] for r in capped.collect()) == [f"n{i:03}" for i in range(10)]
    assert sessions.keyword_hits(spark.createDataFrame([("a key b",), ("Key",), (None,)], "t string"), "t", ["key", " ", ""]).count() == 1
    gaps = flow.arrival_gaps(spark.createDataFrame([("f", 0, 5.0), ("f", 1, 4.0), ("f", 2, 6.0)], "f string, i int, s double"), "f", "i", F.col("s"))
    assert [r["gap"] for r in gaps.orderBy("i").collect()] == [None, 0.0, 2.0]


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "data"
    for i in range(3):
        (root / f"s{i}").mkdir(parents=True)
    lines = [{"type": "session"}, {"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "run the secret-word now"}]}}, {"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "exfiltrate"}, {"type": "toolCall", "id": "1", "name": "n", "arguments": {"a": 1}}]}}]
    (root / "s0" / "session.jsonl").write_text("\n".join([*map(json.dumps, lines), "", "{bad", "[1]"]))
    (root / "s1" / "network.pcap").write_bytes(pcap(FRAMES))
    (root / "stray.txt").write_text("x")
    (root / "results.csv").write_text("﻿s0,0\ns0,1\ns1,x\nlonely\ns1,0\n")
    (tmp_path / "k.json").write_text('["secret-word", " ", ""]')
    got = {r["sample_id"]: r for r in files.sample_folders(spark, str(root)).collect()}
    assert set(got) == {"s0", "s1"} and got["s0"]["pcap_path"] is None
    assert files.sample_folders(spark, str(tmp_path / "none")).count() == 0
    votes, _ = cli.score(spark, str(root), 2, ["secret-word"])
    assert {r["sample_id"]: (r["label"], r["pcap"], r["session"], r["rule"]) for r in votes.collect()} == {"s0": (1, False, True, True), "s1": (0, False, False, False)}
    cli.main(["score", "--dataset", str(root), "--keywords", str(tmp_path / "k.json"), "--run-rule"])
    assert "rule" in capsys.readouterr().out
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("type=SYSCALL a0=1 uid=5\n\ntype=CWD\n")
    cli.main(["tokenize", "--logs", str(logs), "--target", str(tmp_path / "out")])
    assert {r["token"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out/per_file_counts")).collect()} == {"type=syscall": 1, "a0=1": 1, "uid=5": 1, "type=cwd": 1}
    assert spark.read.option("header", True).csv(str(tmp_path / "out/distribution")).count() == 3


def test_rule_reads_audit_logs(spark, tmp_path):
    """The rule finds keywords that stand in audit.log only, with or without a session; a session beside it is not searched."""
    said = json.dumps({"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "secret-word"}]}})
    for name, log in {"a": b"x\nexe=secret-\xffword\r\n", "b": b"nothing", "c": b"secret-word"}.items():
        (tmp_path / "data" / name).mkdir(parents=True)
        (tmp_path / "data" / name / "audit.log").write_bytes(log)
    (tmp_path / "data/b/session.jsonl").write_text(said)
    (tmp_path / "data/c/session.jsonl").write_text(said.replace("secret", "other"))
    votes, _ = cli.score(spark, str(tmp_path / "data"), 0, ["secret-word"], modules=("rule",))
    assert {r["sample_id"]: r["rule"] for r in votes.collect()} == {"a": True, "b": False, "c": True}


def test_texts_are_features(spark):
    """Samples with the same counters are told apart by their texts, decoded arguments among them."""
    rows = [(f"f{i}", i % 2, f"common w{i % 3} " + ("wicked" if i % 2 else "harmless"), [0.0] * 8, "net same", [0.0] * 15, True, True) for i in range(12)]
    samples = spark.createDataFrame(rows, "file_name string, label int, audit_text string, host_numeric array<double>, net_text string, net_numeric array<double>, has_audit boolean, has_pcap boolean")
    model = detect.train(samples, Settings(embedding_dim=16))
    assert [t for t, _ in model["vocabularies"]["audit_text"]] == ["harmless", "w0", "w1", "w2", "wicked"] and len(model["weights"]) == 5 + 16 + 23 + 2
    assert all(r["pred"] == r["label"] for r in detect.predict(samples, model).collect())
    x = np.random.default_rng(0).normal(size=(60, 3))
    dense = spark.createDataFrame([([0, 1, 2], a.tolist(), int(a[0] > a[1])) for a in x], "i array<int>, x array<double>, label int")
    (w, b), (v, c) = svm.fit(dense, "x", "label"), svm.fit_sparse(dense, "i", "x", "label", 3)
    assert np.abs(np.append(w - v, b - c)).max() < 1e-2
    lines = spark.createDataFrame([("f", "type=EXECVE a0=7365637265742d776f7264 a1=12"), ("f", "type=CWD a0=7365637265742d776f7264")], "file_name string, msg string")
    assert [tuple(r) for r in tokens.host_payload(lines).collect()] == [("f", "secret-word")]


def test_train_and_validate(spark, tmp_path):
    root = tmp_path / "labelled"
    for label, kind in enumerate(("innocent", "malicious")):
        for sub in ("audit-logs", "network"):
            (root / f"{kind}-by-type" / sub).mkdir(parents=True)
        for i in range(6):
            name = f"skill{i % 3}{kind[0]}_prompt_{i}"
            body = "type=SYSCALL success=no exit=-2 syscall=59\n" * (1 + 20 * label) + "type=SYSCALL success=yes\n" * 5
            (root / f"{kind}-by-type" / "audit-logs" / f"{name}_audit-logs.log").write_text(body)
            (root / f"{kind}-by-type" / "network" / f"{name}_network.pcap").write_bytes(pcap(FRAMES[: 8 - 3 * label]))
    cli.main(["train", "--dataset", str(root), "--model", str(tmp_path / "m")])
    cli.main(["validate", "--dataset", str(root), "--model", str(tmp_path / "m")])
    m = spark.read.json(str(tmp_path / "m-metrics")).first()
    assert m["total"] == 12 and m["accuracy"] == 1.0
    samples = cli.labelled_samples(spark, str(root), Settings())
    assert samples.filter("has_audit and has_pcap and audit_text <> '' and net_text <> ''").count() == 12
    reports = detect.cross_validate(samples, Settings(folds=2))
    assert reports["per_fold"].count() == 2 and reports["summary"].count() == 4


def test_numbered_lines_of_split_files(spark, tmp_path):
    """Line numbers are those of the file, also where it is read in many splits."""
    text = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.log").write_text("\n".join(text) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = files.numbered_lines(spark, str(tmp_path), "*.log").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in ("a", "b"):
        assert [r["value"] for r in sorted((r for r in rows if r["path"].endswith(f"{name}.log")), key=lambda r: r["line_no"])] == text
    assert sorted(r["line_no"] for r in rows) == sorted([*range(3000)] * 2)
