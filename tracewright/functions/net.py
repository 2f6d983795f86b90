"""Functions on network names, addresses and payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a valid domain.
DOMAIN = r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}$"


def dns_name(name: Column) -> Column:
    return F.rtrim(F.lower(F.trim(name)), F.lit("."))


def valid_domain(name: Column) -> Column:
    d = dns_name(name)
    return F.coalesce(d.rlike(DOMAIN) & F.length(d).between(1, 253), F.lit(False))


def _octet(address: Column, i: int) -> Column:
    return F.conv(F.hex(F.substring(address, i, 1)), 16, 10).cast("int")


def private_ipv4(address: Column) -> Column:
    """Whether a 4-byte address is private or loopback; false for any other length and null."""
    a, b = _octet(address, 1), _octet(address, 2)
    inside = (a == 10) | (a == 127) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31))
    return F.coalesce((F.octet_length(address) == 4) & inside, F.lit(False))


def private_address(address: bytes) -> bool:
    """``private_ipv4`` of bytes."""
    return len(address) == 4 and (address[0] in (10, 127) or address[:2] == b"\xc0\xa8" or address[0] == 172 and 16 <= address[1] <= 31)


def ipv4_text(address: Column) -> Column:
    return F.when(F.octet_length(address) == 4, F.concat_ws(".", *[_octet(address, i).cast("string") for i in range(1, 5)]))


def remote_public(src: Column, dst: Column) -> Column:
    """The far address of a packet as text; null if it is private."""
    far = F.when(private_ipv4(src), dst).otherwise(src)
    return F.when(~private_ipv4(far), ipv4_text(far))


def http_hosts(payload: Column) -> Column:
    """Valid domains of the Host headers of a payload; a host with a port is none."""
    lines = F.split(F.decode(payload, "ISO-8859-1"), "\r\n")
    hosts = F.transform(F.filter(lines, lambda x: F.lower(x).startswith("host:")), lambda x: dns_name(F.substring(x, F.lit(6), F.length(x))))
    return F.filter(hosts, lambda h: h.rlike(DOMAIN) & F.length(h).between(1, 253))


def tls_server_name(data: bytes) -> str | None:
    """The first valid host name of a TLS ClientHello record, or None."""
    import re

    def u16(i: int) -> int:
        return int.from_bytes(data[i : i + 2], "big")

    if len(data) < 6 or data[0] != 0x16 or data[5] != 0x01:
        return None
    at = 9 + 34  # record, handshake head, version, random
    if at >= len(data):
        return None
    at += 1 + data[at]  # session id
    at += 2 + u16(at)  # cipher suites
    if at >= len(data):
        return None
    at += 1 + data[at]  # compression
    end = at + 2 + u16(at)
    at += 2
    while at + 4 <= min(end, len(data)):
        kind, size = u16(at), u16(at + 2)
        at += 4
        if kind == 0:
            stop, p = at + size, at + 2
            while p + 3 <= min(stop, len(data)):
                n = u16(p + 1)
                name = data[p + 3 : p + 3 + n]
                if len(name) < n:
                    return None
                text = name.decode("utf-8", "replace").strip().lower().rstrip(".")
                if data[p] == 0 and 1 <= len(text) <= 253 and re.match(DOMAIN, text):
                    return text
                p += 3 + n
        at += size
    return None
