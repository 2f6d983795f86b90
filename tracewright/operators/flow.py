"""Packet aggregates, arrival gaps, network names, and captures read packet by packet."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import net
from tracewright.sources import packets as source

FLOW_BYTES = 65_536
WEB_PORTS = (80, 8080, 8000)


def _gap(seconds: Column) -> Column:
    """Not below 0; null where there is no packet before, which no mean or deviation counts."""
    return F.when(seconds.isNotNull(), F.greatest(seconds, F.lit(0.0)))


def arrival_gaps(packets: DataFrame, file: str, order: str, seconds: Column) -> DataFrame:
    """(file, order, gap): seconds since the packet before in file order, not below 0; null for the first."""
    w = Window.partitionBy(file).orderBy(order)
    return packets.withColumn("__s", seconds).select(file, order, _gap(F.col("__s") - F.lag("__s").over(w)).alias("gap"))


def flow_stats(packets: DataFrame, file: str, order: str, seconds: Column, length: Column, up: Column) -> DataFrame:
    """Per file: packets, bytes by direction, frame lengths and arrival gaps; population deviations, 0 over nothing."""
    w = Window.partitionBy(file).orderBy(order)
    rows = packets.select(file, order, seconds.alias("__s"), length.alias("__n"), up.alias("__up")).withColumn("__gap", _gap(F.col("__s") - F.lag("__s").over(w)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    r = lambda c, n: F.round(zero(c), 4).alias(n)
    total, sent = F.sum("__n"), F.sum(F.when(F.col("__up"), F.col("__n")).otherwise(0.0))
    return rows.groupBy(file).agg(
        F.count(F.lit(1)).alias("packet_count"),
        r(total, "total_bytes"),
        r(sent, "up_bytes"),
        r(total - sent, "down_bytes"),
        r(F.try_divide(sent, total), "up_ratio"),
        r(F.min("__n"), "pkt_len_min"),
        r(F.max("__n"), "pkt_len_max"),
        r(F.avg("__n"), "pkt_len_mean"),
        r(F.stddev_pop("__n"), "pkt_len_std"),
        r(F.avg("__gap"), "iat_mean"),
        r(F.stddev_pop("__gap"), "iat_std"),
        r(F.max("__gap"), "iat_max"),
    )


def net_tokens(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, value) of the ``kind:value`` tokens of a network text."""
    token = F.explode(F.filter(F.split(F.col(text), " +"), lambda t: F.contains(t, F.lit(":"))))
    return rows.select(key, token.alias("t")).select(key, F.substring_index("t", ":", 1).alias("kind"), F.regexp_replace("t", "^[^:]*:", "").alias("value"))


def domain_counts(tokens: DataFrame, key: str) -> DataFrame:
    """Distinct names per kind of each record; duplicates are dropped before the count is shuffled."""
    one = tokens.distinct()
    return one.groupBy(key).agg(F.count_if(F.col("kind") == "dns").alias("dns_domain_count"), F.count_if(F.col("kind") == "sni").alias("sni_count"), F.count_if(F.col("kind") == "host").alias("http_host_count"))


def valid_domains(tokens: DataFrame) -> DataFrame:
    """(value, valid) of the distinct names of all records."""
    return tokens.select("value").distinct().select("value", net.valid_domain(F.col("value")).alias("valid"))


def net_meta_text(tokens: DataFrame, key: str) -> DataFrame:
    """(key, net_text): distinct names, sorted within their kind, in the order dns, sni, host, ip."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("dns", "sni", "host", "ip"))), F.col("kind")), F.lit(0))
    one = tokens.filter(F.col("kind").isin("dns", "sni", "host", "ip")).distinct()
    sets = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("value"), F.col("kind")))).alias("s"))
    return sets.select(key, F.array_join(F.transform("s", lambda x: F.concat(x["kind"], F.lit(":"), x["value"])), " ").alias("net_text"))


_DOMAIN = re.compile(net.DOMAIN)
CAPTURES = "file string, packet_count bigint, ip_bytes bigint, ip_up bigint, len_min int, len_max int, len_mean double, len_std double, gap_mean double, gap_std double, gap_max double, dns array<string>, sni array<string>, host array<string>, ip array<string>"
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in CAPTURES.split(", "))])


class _Flow:
    """The payload of one flow that is still to be read, and how much has come."""

    def __init__(self):
        self.data, self.size = bytearray(), 0

    def take(self, port: int, part: bytes) -> Iterator[tuple[str, str]]:
        """(kind, value) that show once a packet has come; only what it brought is read, what is read is dropped."""
        part = part[: FLOW_BYTES - self.size]
        self.data += part
        self.size += len(part)
        if port == 443:
            name = net.tls_server_name(bytes(self.data)) if self.data[0] == 0x16 else None
            if name:
                yield "sni", name
            if name or self.data[0] != 0x16:
                self.size = FLOW_BYTES
        else:
            lines = bytes(self.data).split(b"\r\n")
            self.data = bytearray(lines[-1])
            for line in lines:
                if line[:5].lower() == b"host:" and len(line) < 2048:
                    host = line[5:].decode("utf-8", "replace").strip().lower().rstrip(".")
                    if 1 <= len(host) <= 253 and _DOMAIN.match(host):
                        yield "host", host
        if self.size >= FLOW_BYTES:
            self.data = bytearray()


def _capture(file: str, packets: Iterable[dict]) -> tuple | None:
    """The row of one capture from its packets in file order; None for no packet.

    Means and population deviations are summed as Spark's aggregates sum them and are 0 over nothing.
    """
    count, low, high, length_sum, length_at, length_m2 = 0, math.inf, 0, 0, 0.0, 0.0
    last, gap_sum, gap_at, gap_m2, longest, total, sent = None, 0.0, 0.0, 0.0, 0.0, 0, 0
    names: dict[str, set] = {"dns": set(), "sni": set(), "host": set()}
    far: set[bytes] = set()
    flows: dict[tuple, _Flow] = {}
    for p in packets:
        ts, n, src = p["ts"], p["length"], p.get("src")
        if last is not None:
            gap = ts - last if ts > last else 0.0
            gap_sum += gap
            step = (delta := gap - gap_at) / count
            gap_at += step
            gap_m2 += delta * (delta - step)
            if gap > longest:
                longest = gap
        last = ts
        count += 1
        length_sum += n
        step = (delta := n - length_at) / count
        length_at += step
        length_m2 += delta * (delta - step)
        if n < low:
            low = n
        if n > high:
            high = n
        if src is None:
            continue
        up, dst = net.private_address(src), p["dst"]
        if len(src) == 4:
            total += p["ip_len"]
            if up:
                sent += p["ip_len"]
        there = dst if up else src
        if there not in far and len(there) == 4 and not net.private_address(there):
            far.add(there)
        if p.get("dns"):
            names["dns"].update(p["dns"])
        if p.get("proto") == "tcp" and p["payload"] and ((port := p["dport"]) == 443 or port in WEB_PORTS):
            key = (src, p["sport"], dst, port)
            flow = flows.get(key) or flows.setdefault(key, _Flow())
            if flow.size < FLOW_BYTES:
                for kind, value in flow.take(port, p["payload"]):
                    names[kind].add(value)
    if not count:
        return None
    gaps = count - 1
    means = (length_sum / count, math.sqrt(length_m2 / count), gap_sum / gaps if gaps else 0.0, math.sqrt(gap_m2 / gaps) if gaps else 0.0)
    return (file, count, total, sent, low, high, *means, longest, *map(sorted, (*names.values(), {".".join(map(str, a)) for a in far})))


def capture_batches(captures: Iterable[tuple[str, Iterable[dict]]]) -> Iterator[pa.RecordBatch]:
    """Rows of captures, many to a batch."""
    rows: list[tuple] = []
    held = 0
    for file, packets in captures:
        if row := _capture(file, packets):
            rows.append(row)
            held += 1 + sum(map(len, row[-4:]))
        if held >= 50_000:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def packet_captures(packets: DataFrame) -> DataFrame:
    """One row a capture (``CAPTURES``) of a table of packets, which may lie in any order: counters, lengths, gaps and names.

    Payloads of a TCP flow are joined in packet order up to 64 KiB; hosts are read after every packet, as a
    header cut at a packet's edge shows there; a server name is read once the payload holds it. Flows are not
    evicted, but hold only what is not read yet. A capture is read as a stream of its partition, never held
    as a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packets = (row for batch in batches for part in range(0, batch.num_rows, 1000) for row in batch.slice(part, 1000).to_pylist())
        yield from capture_batches(groupby(packets, lambda p: p["file"]))

    kept = packets.select("file", "pkt_idx", "ts", "length", "ip_len", "src", "dst", "proto", "sport", "dport", "payload", "dns")
    return kept.repartition("file").sortWithinPartitions("file", "pkt_idx").mapInArrow(run, CAPTURES)


def file_captures(files: DataFrame) -> DataFrame:
    """The same of captures given as (path, content): one narrow pass, each read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from capture_batches(
            (path.as_py(), source.capture_packets(content.as_py() or b"")) for batch in batches for path, content in zip(batch.column("path"), batch.column("content"))
        )

    return files.mapInArrow(run, CAPTURES)
