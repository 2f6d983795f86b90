"""Capture files as packets: reading pcap and pcapng, decoding Ethernet, IP, UDP, TCP and DNS.

Captures are read as binary files and decoded in Arrow batches, one narrow pass with no shuffle. A
file that cannot be read gives one row with ``error``; an undecodable packet keeps its time and length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PACKETS = "file string, pkt_idx bigint, ts double, length int, ip_len int, src binary, dst binary, proto string, sport int, dport int, payload binary, dns array<string>, error string"
# First bytes of captures, with byte order and ticks per second.
MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\x3c\x4d": (">", 1e9), b"\x4d\x3c\xb2\xa1": ("<", 1e9)}


def read_capture(data: bytes) -> Iterator[tuple[float, bytes]]:
    """(time, frame) of every packet of a pcap or pcapng file, in file order; ends at a cut packet."""
    if data[:4] in MAGIC:
        order, ticks = MAGIC[data[:4]]
        at = 24
        while at + 16 <= len(data):
            sec, frac, size, _ = struct.unpack_from(order + "IIII", data, at)
            at += 16
            if at + size > len(data):
                return
            yield sec + frac / ticks, data[at : at + size]
            at += size
        return
    if data[:4] != b"\x0a\x0d\x0d\x0a":
        raise ValueError("no capture file")
    at, order, ticks = 0, "<", [1e6]
    while at + 12 <= len(data):
        if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            ticks = []
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or at + size > len(data):
            return
        body = data[at + 8 : at + size - 4]
        if kind == 1:
            unit, p = 1e6, 8
            while p + 4 <= len(body):
                code, n = struct.unpack_from(order + "HH", body, p)
                if code == 9 and n:
                    v = body[p + 4]
                    unit = float(2 ** (v & 0x7F)) if v & 0x80 else float(10**v)
                if code == 0:
                    break
                p += 4 + (n + 3) // 4 * 4
            ticks.append(unit)
        elif kind == 6 and len(body) >= 20:
            iface, high, low, n = struct.unpack_from(order + "IIII", body)
            yield ((high << 32) | low) / (ticks[iface] if iface < len(ticks) else 1e6), body[20 : 20 + n]
        at += size


def dns_names(data: bytes) -> list[str]:
    """Names asked and answered in a DNS message, in lower case without the dot at the end."""
    if len(data) < 12:
        return []
    asked, answers = struct.unpack_from(">HH", data, 4)
    at = 12

    def name(at: int) -> tuple[str, int]:
        labels, end, hops = [], -1, 0
        while True:
            if at >= len(data) or hops > 64:
                raise ValueError("bad name")
            n = data[at]
            if n & 0xC0 == 0xC0:
                if at + 1 >= len(data):
                    raise ValueError("bad name")
                end = end if end >= 0 else at + 2
                at = (n & 0x3F) << 8 | data[at + 1]
                hops += 1
            elif n == 0:
                return b".".join(labels).decode("utf-8", "replace").lower().rstrip("."), end if end >= 0 else at + 1
            else:
                labels.append(data[at + 1 : at + 1 + n])
                at += 1 + n

    out = []
    try:
        for _ in range(asked):
            text, at = name(at)
            out.append(text)
            at += 4
        for _ in range(answers):
            text, at = name(at)
            out.append(text)
            at += 10 + struct.unpack_from(">H", data, at + 8)[0]
    except (ValueError, struct.error):
        pass
    return out


def decode_frame(frame: bytes) -> dict:
    """IP length, addresses, protocol, ports, payload and DNS names of an Ethernet frame; {} if it holds no IPv4 or IPv6."""
    if len(frame) < 14:
        return {}
    at, kind = 14, frame[12:14]
    while kind in (b"\x81\x00", b"\x88\xa8") and len(frame) >= at + 4:
        kind, at = frame[at + 2 : at + 4], at + 4
    out: dict = {}
    if kind == b"\x08\x00" and len(frame) >= at + 20:
        head = (frame[at] & 0x0F) * 4
        out = {"ip_len": int.from_bytes(frame[at + 2 : at + 4], "big"), "src": frame[at + 12 : at + 16], "dst": frame[at + 16 : at + 20]}
        proto, body = frame[at + 9], frame[at + head : at + max(out["ip_len"], head)]
    elif kind == b"\x86\xdd" and len(frame) >= at + 40:
        size = int.from_bytes(frame[at + 4 : at + 6], "big")
        out = {"src": frame[at + 8 : at + 24], "dst": frame[at + 24 : at + 40]}
        proto, body = frame[at + 6], frame[at + 40 : at + 40 + size]
    else:
        return {}
    if proto == 17 and len(body) >= 8:
        out |= {"proto": "udp", "sport": int.from_bytes(body[:2], "big"), "dport": int.from_bytes(body[2:4], "big"), "payload": body[8:]}
        if 53 in (out["sport"], out["dport"]):
            out["dns"] = dns_names(body[8:])
    elif proto == 6 and len(body) >= 20:
        out |= {"proto": "tcp", "sport": int.from_bytes(body[:2], "big"), "dport": int.from_bytes(body[2:4], "big"), "payload": body[(body[12] >> 4) * 4 :]}
    return out


def capture_packets(data: bytes) -> Iterator[dict]:
    """Time, length and fields of every packet of a capture file; none for a file that cannot be read."""
    try:
        for ts, frame in read_capture(data):
            packet = decode_frame(frame)
            packet["ts"], packet["length"] = ts, len(frame)
            yield packet
    except (ValueError, struct.error):
        return


_KINDS = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in PACKETS.split(", "))])


def packets(spark: SparkSession, path: str, name_filter: str = "*.pcap") -> DataFrame:
    """Packets of all captures below ``path``; see the module for errors."""
    return decoded(captures(spark, path, name_filter))


def captures(spark: SparkSession, path: str, name_filter: str = "*.pcap") -> DataFrame:
    """(path, content) of all captures below ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", name_filter).option("recursiveFileLookup", True).load(path).select("path", "content")


def decoded(files: DataFrame) -> DataFrame:
    """Packets of captures given as (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows: list[dict] = []
                try:
                    for i, (ts, frame) in enumerate(read_capture(content.as_py() or b"")):
                        rows.append({"file": path, "pkt_idx": i, "ts": ts, "length": len(frame)} | decode_frame(frame))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                            rows = []
                except (ValueError, struct.error) as e:
                    rows.append({"file": path, "error": str(e)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return files.mapInArrow(run, PACKETS)
