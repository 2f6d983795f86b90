"""Scalar numeric functions of the feature pipeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the counters, those taken through log1p (by position), and weights.
HOST_NAMES = ("syscall_total", "syscall_failed", "syscall_exit_neg2", "syscall_failed_ratio", "execve_total", "execve_failed", "execve_failed_ratio", "execve_payload_chars")
NET_NAMES = ("packet_count", "total_bytes", "up_bytes", "down_bytes", "up_ratio", "pkt_len_min", "pkt_len_max", "pkt_len_mean", "pkt_len_std", "iat_mean", "iat_std", "iat_max", "dns_domain_count", "sni_count", "http_host_count")
HOST_LOG = (0, 1, 2, 7)
NET_LOG = (0, 1, 2, 3, 5, 6, 7, 11, 12, 13, 14)
HOST_WEIGHT, NET_WEIGHT = 1.0, 2.0


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def log_selected(values: Column, positions: tuple[int, ...]) -> Column:
    """An array with log1p of max(x, 0) at the given positions."""
    return F.transform(values, lambda x, i: F.when(i.isin(*positions), F.log1p(F.greatest(x, F.lit(0.0)))).otherwise(x))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low), divided by 1 for a constant; not clipped."""
    span = high - low
    return (value - low) / F.when(span == 0, 1.0).otherwise(span)


def l2_normalized(vector: Column, floor: float = 1e-12) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(norm, F.lit(floor)))


def masked(present: Column, vector: Column, dim: int) -> Column:
    """The vector, or zeros where the modality is absent."""
    return F.when(F.coalesce(present, F.lit(False)) & vector.isNotNull(), vector).otherwise(F.array_repeat(F.lit(0.0), dim))


def flags(*present: Column) -> Column:
    return F.array(*[F.coalesce(p, F.lit(False)).cast("double") for p in present])
