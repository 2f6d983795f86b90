"""Filling fixed-capacity containers with items.

Items longer than the capacity are split into full pieces and a rest; no other item is split. The
histogram of piece lengths, which has at most ``capacity`` rows, goes to the driver. There a
configuration linear program (how often to use each filling of a container) is solved by
multiplicative weights: the prices of lengths still wanted rise, a knapsack dynamic program over the
capacity finds the filling of greatest price, and its use rises. Where no filling is nearly full, the best
there is counts. The uses are rounded down, and what that leaves goes best-fit in decreasing order, equal
containers at once. Pieces then find their container
by their rank among those of their length, which is counted in salted parts, so a length that a third of
all items share is never sorted in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.runtime import written

#: Rows of a length per salted part, about.
PART = 50_000
#: Shares of a container that fillings must reach, one after another; any length in numbers reaches the last.
FULL = (0.999, 0.99, 0.97, 0.9, 0.75, 0.5)
#: Pieces per length, on average, that are left to best fit once no filling is nearly full.
REST = 4


def best_filling(prices: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """How many pieces of each length (index) fill a container at the greatest total price.

    A knapsack dynamic program over the capacity: a length's multiplicity is limited to its count by
    taking it in bundles of 1, 2, 4 ...
    """
    value = np.zeros(capacity + 1)
    taken = []
    for length in np.flatnonzero((prices > 0) & (counts > 0)):
        left, bundle = int(min(counts[length], capacity // length)), 1
        while left > 0:
            k = min(bundle, left)
            size = k * length
            better = np.zeros(capacity + 1, bool)
            offer = value[: capacity + 1 - size] + k * prices[length]
            better[size:] = offer > value[size:] + 1e-12
            value[size:] = np.where(better[size:], offer, value[size:])
            taken.append((length, k, size, better))
            left -= k
            bundle *= 2
    out = np.zeros(capacity + 1, np.int64)
    at = capacity
    for length, k, size, better in reversed(taken):
        if better[at]:
            out[length] += k
            at -= size
    return out


def configuration_program(counts: np.ndarray, capacity: int, step: float = 0.1) -> list[tuple[np.ndarray, float]]:
    """[(filling, use)]: a fractional cover of the pieces by fillings, by multiplicative weights.

    counts[l] pieces of length l are wanted; the price of a length starts as its share of the capacity,
    so full containers are worth most. In each round the knapsack program finds the filling of
    greatest price among lengths that allow at least ``least`` uses of it, the filling is used as often as
    its scarcest length allows, and the prices of the lengths fall by the share of them that was
    covered. Once such fillings leave more than 1 - ``full`` of a container empty, ``least`` is halved, and
    below two uses the next of ``FULL`` holds, as long as more than ``REST`` pieces a length are wanted. As
    every round uses up a length, there are no more rounds than lengths, which alone ends the program. What is
    still wanted is left to the rounding.
    """
    wanted = counts.astype(float).copy()
    weight = np.ones(capacity + 1)
    lengths = np.arange(capacity + 1)
    out: list[tuple[np.ndarray, float]] = []
    many = REST * np.count_nonzero(counts)
    for full in FULL:
        least = 1 << int(max(wanted.max(), 1)).bit_length()
        while full == FULL[0] or wanted.sum() > many:
            prices = weight * lengths / capacity
            filling = None
            while least >= 2:
                allowed = np.floor(wanted / least).astype(np.int64)
                if allowed.any() and (allowed * lengths).sum() >= full * capacity:
                    filling = best_filling(prices, allowed, capacity)
                    if (filling * lengths).sum() >= full * capacity:
                        break
                filling = None
                least //= 2
            if filling is None:
                break
            used = np.flatnonzero(filling)
            use = float((wanted[used] / filling[used]).min())
            covered = use * filling[used] / wanted[used]
            weight[used] *= np.exp(-step * covered)
            wanted[used] = np.maximum(wanted[used] - use * filling[used], 0)
            out.append((filling, use))
        if wanted.sum() <= many:
            break
    return out


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(filling as {length: pieces}, number of containers)] that holds every piece of the histogram once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[dict[int, int], int]] = []
    for filling, use in configuration_program(left, capacity):
        used = np.flatnonzero(filling)
        n = int(min(np.floor(use + 1e-9), (left[used] // filling[used]).min()))
        if n > 0:
            left[used] -= n * filling[used]
            out.append(({int(x): int(filling[x]) for x in used}, n))
    return out + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit in decreasing order over groups of equal containers: [(filling, number of containers)].

    Pieces of one length fill the container they fit best before they go to the next, so they are
    placed group by group. A length opens or splits at most one group, into three: there are no more than
    three groups a length, however many pieces.
    """
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms = np.zeros(capacity + 1, np.int64)

    def put(room: int, filling: dict[int, int], n: int) -> None:
        by_room.setdefault(room, []).append((filling, n))
        rooms[room] += 1

    for length in map(int, np.flatnonzero(left)[::-1]):
        pieces = int(left[length])
        while pieces:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = int(length + fits[0])
                filling, n = by_room[room].pop()
                rooms[room] -= 1
            else:
                room, filling, n = capacity, {}, -(-pieces // (capacity // length))
            each = room // length
            whole = min(n, pieces // each)
            rest = min(pieces - whole * each, each - 1) if whole < n else 0
            if whole:
                put(room - each * length, filling | {length: each}, whole)
            if rest:
                put(room - rest * length, filling | {length: rest}, 1)
            if n - whole - (rest > 0) > 0:
                put(room, filling, n - whole - (rest > 0))
            pieces -= whole * each + rest
    return [group for groups in by_room.values() for group in groups]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """A number of containers that no packing of the histogram is below, by feasible prices of the program's dual.

    Prices are feasible if no filling is worth more than one container. With ``length / capacity`` they give the
    volume bound. For each k up to half the capacity so are these: 1 for lengths above capacity - k, 0 for
    lengths below k, and ``length / capacity`` between them.
    """
    n = np.zeros(capacity + 2, np.int64)
    for length, count in counts.items():
        n[length] += count
    above = np.cumsum(n[::-1])[::-1]  # pieces of at least a length
    volume = np.cumsum((n * np.arange(capacity + 2))[::-1])[::-1]
    best = 0
    for k in range(capacity // 2 + 1):
        big = capacity - k + 1
        between = int(volume[min(k, big)] - volume[big])
        best = max(best, int(above[big]) + -(-between // capacity))
    return best


def split_items(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, part_no, length): items as pieces of at most ``capacity``; those of size null or 0 have none."""
    parts = F.ceil(F.col(size) / F.lit(capacity)).cast("int")
    return (
        sizes.filter(F.col(key).isNotNull() & (F.col(size) > 0))
        .select(key, F.col(size).cast("bigint").alias("__size"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part_no"))
        .select(key, F.col("part_no").cast("bigint").alias("part_no"), F.least(F.lit(capacity).cast("bigint"), F.col("__size") - F.col("part_no") * capacity).alias("length"))
    )


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = 3000) -> DataFrame:
    """(key, part_no, length, container): every piece of every item in a container of ``capacity``.

    Only the histogram (at most ``capacity`` rows), the fillings (at most a few per length) and the number of rows
    per salted part of a length reach the driver or a broadcast. The bounds of the first two do not depend on the number of items. An empty table gives an empty result.
    """
    spark = sizes.sparkSession
    pieces = split_items(sizes, key, size, capacity)
    parts = max(1, -(-pieces.count() // PART))
    salted = written(pieces.withColumn("salt", F.pmod(F.xxhash64(key, "part_no"), F.lit(parts)).cast("int")), "pieces")
    grouped = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in grouped.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # Per length: the ranks that go to each use of a filling, [first rank, per container, first container].
    taken: dict[int, int] = {}
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    container = 0
    for filling, n in pack_histogram(histogram, capacity):
        for length, k in filling.items():
            ranges.setdefault(length, []).append((taken.get(length, 0), k, container))
            taken[length] = taken.get(length, 0) + n * k
        container += n
    table = spark.createDataFrame(list(ranges.items()), "length bigint, ranges array<struct<first: bigint, each: bigint, container: bigint>>")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = grouped.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "salt", "offset")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy(key, "part_no")) - 1
    mine = F.element_at(F.filter("ranges", lambda r: r["first"] <= F.col("rank")), -1)
    return (
        salted.withColumn("local", rank)
        .join(offsets, ["length", "salt"])
        .withColumn("rank", F.col("local") + F.col("offset"))
        .join(table, "length")
        .withColumn("to", mine)
        .select(key, "part_no", "length", (F.col("to.container") + F.floor((F.col("rank") - F.col("to.first")) / F.col("to.each"))).alias("container"))
    )


def packing_report(packed: DataFrame, capacity: int = 3000) -> DataFrame:
    """One row: containers, pieces, tokens, the least number of containers by the dual, the gap to it and the share filled.

    The histogram of lengths, at most ``capacity`` rows, goes to the driver.
    """
    counts = {r["length"]: r["n"] for r in packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    per = packed.groupBy("container").agg(F.sum("length").alias("filled"), F.count(F.lit(1)).alias("pieces"))
    return (
        per.agg(
            F.count(F.lit(1)).alias("containers"),
            F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"),
            F.coalesce(F.sum("filled"), F.lit(0)).alias("tokens"),
            F.coalesce(F.max("filled"), F.lit(0)).alias("fullest"),
        )
        .withColumn("least_containers", F.lit(lower_bound(counts, capacity)).cast("bigint"))
        .withColumn("gap", F.round(F.coalesce(F.try_divide(F.col("containers") - F.col("least_containers"), "least_containers"), F.lit(0.0)), 6))
        .withColumn("filled", F.round(F.try_divide("tokens", F.col("containers") * capacity), 6))
    )
