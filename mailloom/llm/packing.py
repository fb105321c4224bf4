"""Filling containers of fixed capacity with texts, by linear grouping and best fit.

Sizes are whole tokens of at most the capacity, so everything the driver solves is a histogram with at
most ``capacity`` entries, however many texts there are:

1. a text larger than a container is cut into full containers and a rest; no other text is split;
2. large items (from capacity / 16) are put into groups of equal cardinality by size; in a group all
   count as its largest; which configurations of these few sizes to use, and how often, is optimised as
   a linear programme whose columns are generated by knapsack; rounded down, it leaves a few items a
   group, which are put together one fullest container after another;
3. actual texts take the places by their number within the group, which leaves a gap per container;
4. small items go into the gaps best-fit (largest item first, into the tightest gap), solved on the
   histograms of gaps and sizes; what finds no gap opens new containers, which later items fill too.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.plans.rank import numbered
from mailloom.plans.storage import written

GROUPS = 40
LARGE_PART = 16


def linear_groups(histogram: dict[int, int], groups: int = GROUPS) -> list[list[int]]:
    """Sizes, descending, in at most ``groups`` runs that hold about equally many items each."""
    total, out, have = sum(histogram.values()), [], 0
    per = max(1, -(-total // groups))
    for s in sorted(histogram, reverse=True):
        if not out or have >= per:
            out.append([])
            have = 0
        out[-1].append(s)
        have += histogram[s]
    return out


def best_configuration(sizes: list[int], demand: list[int], capacity: int) -> list[int]:
    """How often to take each size so that a container is as full as can be (bounded knapsack)."""
    reach = np.full(capacity + 1, -1, dtype=np.int64)  # the item that first reached a fill
    reach[0] = len(sizes)
    for i, (s, d) in enumerate(zip(sizes, demand)):
        most = min(d, capacity // s)
        if most <= 0:
            continue
        base = np.flatnonzero(reach >= 0)
        base = base[reach[base] != i]
        for _ in range(most):
            nxt = base + s
            nxt = nxt[nxt <= capacity]
            nxt = nxt[reach[nxt] < 0]
            if not len(nxt):
                break
            reach[nxt] = i
            base = nxt
    fill = int(np.flatnonzero(reach >= 0)[-1])
    take = [0] * len(sizes)
    while fill:
        i = int(reach[fill])
        take[i] += 1
        fill -= sizes[i]
    return take


def dearest_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The container of greatest worth that the sizes can fill, and how often it takes each."""
    value, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, (s, w) in enumerate(zip(sizes, worth)):
        for _ in range(capacity // s if w > 0 else 0):
            more = value[:-s] + w
            better = np.flatnonzero(more > value[s:] + 1e-12)
            if not len(better):
                break
            value[better + s], took[better + s] = more[better], i
    take, c = [0] * len(sizes), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
            continue
        take[took[c]] += 1
        c -= sizes[took[c]]
    return float(value[capacity]), take


def fractional_configurations(sizes: list[int], demand: list[int], capacity: int, most: int = 2000) -> tuple[list[tuple[float, list[int]]], float]:
    """([(how often, items of each size)], lower bound): the least number of containers if they could be divided.

    Simplex with generated columns: the basis has a configuration per size, the duals are what a size is
    worth, and a knapsack finds the configuration that is worth more than a container, if there is one.
    Every basis on the way meets the demand, so stopping after ``most`` steps costs containers only.
    """
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    need = np.array(demand, float)
    bound = 0.0
    for _ in range(most):
        worth = np.linalg.solve(basis.T, np.ones(k))
        value, take = dearest_configuration(sizes, np.maximum(worth, 0), capacity)
        bound = max(bound, float(np.maximum(worth, 0) @ need) / max(1.0, value))
        if value <= 1 + 1e-9:
            break
        amount, enter = np.linalg.solve(basis, need), np.linalg.solve(basis, np.array(take, float))
        ratio = np.where(enter > 1e-9, np.maximum(amount, 0) / np.where(enter > 1e-9, enter, 1), np.inf)
        basis[:, int(ratio.argmin())] = take
    amount = np.linalg.solve(basis, need)
    return [(float(x), [int(v) for v in basis[:, j]]) for j, x in enumerate(amount) if x > 1e-9], bound


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """[(times, items of each size)] that together hold the whole demand exactly."""
    out, left = [], list(demand)
    if any(left):
        some = [i for i, d in enumerate(demand) if d]
        for x, short in fractional_configurations([sizes[i] for i in some], [demand[i] for i in some], capacity)[0]:
            take = [0] * len(sizes)
            for i, t in zip(some, short):
                take[i] = t
            times = min([int(x + 1e-9), *[d // t for d, t in zip(left, take) if t]])
            if times > 0:
                out.append((times, take))
                left = [d - times * t for d, t in zip(left, take)]
    while any(left):
        take = best_configuration(sizes, left, capacity)
        times = min(d // t for d, t in zip(left, take) if t)
        out.append((times, take))
        left = [d - times * t for d, t in zip(left, take)]
    return out


def best_fit(gaps: dict[int, int], sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Places items of ``sizes`` (size -> count) into ``gaps`` (gap -> containers).

    Returns rows (size, first item, end item, items per container, gap class, first container of the
    class) and how many new containers were opened; those are class ``capacity + 1``.
    """
    fresh = capacity + 1
    free: dict[int, list[tuple[int, int, int]]] = {g: [(g, 0, n)] for g, n in gaps.items() if g > 0 and n > 0}  # gap now -> (class, first, end)
    order = sorted(free)
    opened, moves = 0, []

    def put(gap: int, part: tuple[int, int, int]) -> None:
        if gap <= 0 or part[1] >= part[2]:
            return
        if gap not in free:
            bisect.insort(order, gap)
            free[gap] = []
        free[gap].append(part)

    for s in sorted(sizes, reverse=True):
        at, n = 0, sizes[s]
        while at < n:
            i = bisect.bisect_left(order, s)
            if i == len(order):
                per = capacity // s
                need = -(-(n - at) // per)
                put(capacity, (fresh, opened, opened + need))
                opened += need
                continue
            gap = order[i]
            cls, a, b = free[gap].pop()
            if not free[gap]:
                del free[gap]
                order.pop(i)
            # as many per container as still leave this the tightest gap that is right for the item
            k = 1
            if gap >= 2 * s:
                lower = order[i - 1] if i else 0
                k = max(1, min(gap // s, (gap - max(s, lower + 1)) // s + 1))
            left = n - at
            if left < k:
                k = left
            m = min(b - a, left // k)
            moves.append((s, at, at + m * k, k, cls, a))
            at += m * k
            put(gap - k * s, (cls, a, a + m))
            put(gap, (cls, a + m, b))
    return moves, opened


def bounded(spark: SparkSession, rows: list, schema: str, most: int) -> DataFrame:
    """A small table for a broadcast; more rows than its proven bound are an error."""
    if len(rows) > most:
        raise ValueError(f"{len(rows)} rows where at most {most} can be")
    return F.broadcast(spark.createDataFrame(rows, schema))


def pack(items: DataFrame, key: str, size: str, capacity: int, groups: int = GROUPS) -> DataFrame:
    """(key, piece, n_pieces, n_tokens, container_id) for every item of positive size.

    Items of size 0 or null take no room and get no row. Ties are ordered by key. Rows are whole:
    each piece has exactly one container, no container holds more than ``capacity``.
    """
    spark: SparkSession = items.sparkSession
    s = F.col(size).cast("bigint")
    n_pieces = F.ceil(s / F.lit(capacity)).cast("int")
    cut = (items.filter(s > 0).select(F.col(key), s.alias("_all"), n_pieces.alias("n_pieces"))
        .select(key, "_all", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
        .select(key, "piece", "n_pieces", F.least(F.lit(capacity), F.col("_all") - F.col("piece") * capacity).cast("int").alias("n_tokens")))
    cut = written(cut, "pieces")
    counts = {r["n_tokens"]: r["n"] for r in cut.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    least = max(1, capacity // LARGE_PART)
    runs = linear_groups({k: n for k, n in counts.items() if k >= least}, groups)
    sizes, demand = [r[0] for r in runs], [sum(counts[x] for x in r) for r in runs]
    configs = configurations(sizes, demand, capacity)
    places, base, used = [], 0, [0] * len(sizes)
    for times, take in configs:
        for g, k in enumerate(take):
            if k:
                places.append((g, used[g], used[g] + times * k, k, base))
                used[g] += times * k
        base += times
    n_large = base
    group_of = bounded(spark, [(x, g) for g, r in enumerate(runs) for x in r], "n_tokens int, grp int", capacity)
    # a configuration of the programme or of the rest uses up one demand each, and takes LARGE_PART sizes at most
    where = bounded(spark, places, "g int, lo bigint, hi bigint, k int, base bigint", 4 * groups * LARGE_PART)
    ranked = numbered(cut.join(group_of, "n_tokens"), ["grp"], [key, "piece"], "_r")
    large = written(ranked.join(where, (F.col("grp") == F.col("g")) & (F.col("_r") >= F.col("lo")) & (F.col("_r") < F.col("hi")))
        .select(key, "piece", "n_pieces", "n_tokens", (F.col("base") + F.floor((F.col("_r") - F.col("lo")) / F.col("k"))).cast("bigint").alias("container_id")), "large")
    small_counts = {k: n for k, n in counts.items() if k < least}
    if not small_counts:
        return large
    filled = written(large.groupBy("container_id").agg((F.lit(capacity) - F.sum("n_tokens")).cast("int").alias("gap")), "gaps")
    gap_counts = {r["gap"]: r["n"] for r in filled.groupBy("gap").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    moves, _ = best_fit(gap_counts, small_counts, capacity)
    plan = bounded(spark, moves, "s int, lo bigint, hi bigint, k int, cls int, first bigint", 8 * capacity * LARGE_PART)
    small = numbered(cut.filter(F.col("n_tokens") < least), ["n_tokens"], [key, "piece"], "_r")
    seat = (F.col("first") + F.floor((F.col("_r") - F.col("lo")) / F.col("k"))).cast("bigint")
    seated = small.join(plan, (F.col("n_tokens") == F.col("s")) & (F.col("_r") >= F.col("lo")) & (F.col("_r") < F.col("hi"))).select(key, "piece", "n_pieces", "n_tokens", "cls", seat.alias("seat"))
    new = seated.filter(F.col("cls") == capacity + 1).select(key, "piece", "n_pieces", "n_tokens", (F.lit(n_large).cast("bigint") + F.col("seat")).alias("container_id"))
    seats = numbered(filled, ["gap"], ["container_id"], "seat").select(F.col("gap").alias("cls"), "seat", "container_id")
    old = seated.filter(F.col("cls") <= capacity).join(seats, ["cls", "seat"]).select(key, "piece", "n_pieces", "n_tokens", "container_id")
    return large.unionByName(new).unionByName(old)
