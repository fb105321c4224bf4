"""Clusterings that are relational: the entropy-split tree, the frequency-prefix tree, and transactions.

Inputs are (mail_id, one string column per attribute); nulls count as empty strings, a repeated
mail_id counts once. Every clusterer returns (mail_id, cluster_id).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.plans.rank import numbered
from mailloom.plans.storage import drop, written


def all_in_one(df: DataFrame, cluster_id: str = "all") -> DataFrame:
    return df.select("mail_id").distinct().withColumn("cluster_id", F.lit(cluster_id))


def distinct_rows(df: DataFrame, attributes: list[str]) -> DataFrame:
    return df.groupBy("mail_id").agg(*[F.coalesce(F.min(a), F.lit("")).alias(a) for a in attributes])


def long_form(df: DataFrame, attributes: list[str]) -> DataFrame:
    """(mail_id, attr_pos, attr, value)."""
    cells = F.array(*[F.struct(F.lit(i).alias("attr_pos"), F.lit(a).alias("attr"), F.coalesce(F.col(a), F.lit("")).alias("value")) for i, a in enumerate(attributes)])
    return df.select("mail_id", F.explode(cells).alias("c")).select("mail_id", "c.*")


def _rounded(c: Column) -> Column:
    """Near-ties must not depend on the order of summing; the queries' SQL rounds alike."""
    return F.round(c, 9)


def attribute_entropy(cells: DataFrame, node: list[str]) -> DataFrame:
    """(node..., attr, attr_pos, n_values, entropy in nats) over cells (node..., attr, attr_pos, value)."""
    counts = cells.groupBy(*node, "attr", "attr_pos", "value").agg(F.count("*").alias("n"))
    per = counts.groupBy(*node, "attr", "attr_pos").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s"), F.count("*").alias("n_values"))
    return per.select(*node, "attr", "attr_pos", "n_values", _rounded(F.ln("t") - F.col("s") / F.col("t")).alias("entropy"))


def node_split(entropy: DataFrame, node: list[str], threshold: float, stop_when_pure: bool = False) -> DataFrame:
    """(node..., impurity, split_attr, split_pos): the attribute of greatest entropy, the first of equal ones; null if the node stays.

    As observed, a node is split while its impurity is below the threshold; ``stop_when_pure`` splits
    while it is above.
    """
    best = F.max_by(F.when(F.col("entropy") > 0, F.struct("attr", "attr_pos")), F.struct("entropy", (-F.col("attr_pos")).alias("p")))
    per = entropy.groupBy(*node).agg(_rounded(F.sum("entropy")).alias("impurity"), best.alias("b"))
    go = F.col("impurity") > threshold if stop_when_pure else F.col("impurity") < threshold
    return per.select(*node, "impurity", F.when(go, F.col("b.attr")).alias("split_attr"), F.when(go, F.col("b.attr_pos")).alias("split_pos"))


def entropy_tree(df: DataFrame, attributes: list[str], threshold: float = 50.0, stop_when_pure: bool = False) -> DataFrame:
    """(mail_id, cluster_id): the leaves of the entropy-split tree; a leaf is named by the hash of its path.

    If no node can reach the threshold, which the numbers of distinct values tell, the leaves are the
    groups of equal rows and one aggregation finds them. Otherwise a round per level: at most as many
    as there are attributes. Every round's nodes are written to the shared folder.
    """
    rows = distinct_rows(df, attributes)
    limit = rows.agg(*[F.count_distinct(a).alias(a) for a in attributes]).first()
    if not stop_when_pure and sum(math.log(max(1, limit[a])) for a in attributes) < threshold:
        key = F.md5(F.array_join(F.array(*[F.md5(F.col(a).cast("binary")) for a in attributes]), ",").cast("binary"))
        return rows.select("mail_id", key.alias("cluster_id"))
    state = rows.select("mail_id", F.lit("").alias("node"), F.array().cast("array<int>").alias("used"), F.lit(True).alias("open"), *attributes)
    before = None
    for _ in range(len(attributes)):
        state = written(state, "tree")
        for old in before or ():
            drop(old)
        cells = long_form_of(state, attributes)
        split = node_split(attribute_entropy(cells, ["node"]), ["node"], threshold, stop_when_pure).filter(F.col("split_pos").isNotNull()).select("node", "split_pos")
        split = written(split, "splits")
        if split.isEmpty():
            break
        before = state, split
        joined = state.join(split, "node", "left")
        value = F.element_at(F.array(*attributes), F.col("split_pos") + 1)
        go = F.col("split_pos").isNotNull()
        state = joined.select("mail_id", F.when(go, F.md5(F.concat_ws("|", "node", F.col("split_pos").cast("string"), F.md5(value.cast("binary"))).cast("binary"))).otherwise(F.col("node")).alias("node"), F.when(go, F.array_append("used", F.col("split_pos"))).otherwise(F.col("used")).alias("used"), go.alias("open"), *attributes)
    return state.select("mail_id", F.col("node").alias("cluster_id"))


def long_form_of(state: DataFrame, attributes: list[str]) -> DataFrame:
    """Cells of the open nodes, without the attributes they have used."""
    cells = F.array(*[F.struct(F.lit(i).alias("attr_pos"), F.lit(a).alias("attr"), F.col(a).alias("value")) for i, a in enumerate(attributes)])
    return state.filter("open").select("node", F.explode(F.filter(cells, lambda c: ~F.array_contains("used", c.attr_pos))).alias("c")).select("node", "c.*")


def value_paths(df: DataFrame, attributes: list[str]) -> DataFrame:
    """(mail_id, path): each mail's values by falling count over all mails and attributes, equal ones in attribute order."""
    cells = long_form(df.select("mail_id", *attributes).dropDuplicates(["mail_id"]), attributes)
    counts = cells.groupBy("value").agg(F.count("*").alias("n"))
    ranked = cells.join(counts, "value").groupBy("mail_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "attr_pos", "value"))).alias("v"))
    return ranked.select("mail_id", F.col("v.value").alias("path"))


def prefix_tree(df: DataFrame, attributes: list[str], min_size: int = 0) -> DataFrame:
    """(mail_id, cluster_id): mails whose paths agree but for the last, rarest value. One attribute gives no clusters.

    ``min_size`` above 0 leaves out smaller clusters.
    """
    k = len(attributes)
    if k < 2:
        return df.select("mail_id", F.lit(None).cast("string").alias("cluster_id")).limit(0)
    paths = value_paths(df, attributes).select("mail_id", F.md5(F.array_join(F.transform(F.slice("path", 1, k - 1), lambda v: F.md5(v.cast("binary"))), ",").cast("binary")).alias("cluster_id"))
    if min_size > 0:
        big = paths.groupBy("cluster_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size).select("cluster_id")
        paths = paths.join(big, "cluster_id", "left_semi").select("mail_id", "cluster_id")
    return paths


def chunk_size(k: int, r: float) -> int:
    """How many mails the observed transaction clustering puts into a cluster of k attributes at repulsion r > 0."""
    n = 1
    while k * ((n + 1) ** 2 / 2 ** r - n ** 2) >= 1:
        n += 1
    return n


def transactions_observed(df: DataFrame, k: int, r: float = 2.0, order: str = "mail_id") -> DataFrame:
    """(mail_id, cluster_id) as observed: chunks in order, single mails for r of 2 and more."""
    ranked = numbered(df.select(*dict.fromkeys(["mail_id", order])).distinct().withColumn("_all", F.lit(0)), ["_all"], [order] if order == "mail_id" else [order, "mail_id"], "rank", ordered=True)
    return ranked.select("mail_id", F.floor(F.col("rank") / chunk_size(k, r)).cast("bigint").alias("cluster_id"))


def items(df: DataFrame, attributes: list[str]) -> Column:
    """The items (attribute, value) of a mail, as hashes."""
    return F.array(*[F.xxhash64(F.lit(a), F.coalesce(F.col(a), F.lit(""))) for a in attributes])


def settled(sets: list[tuple[tuple, int, int]], r: float, most: int, few: int = 64, broad: int = 512) -> list[int]:
    """The cluster of each (distinct items, number of items, number of mails), in order, when no set moves any more.

    Gains depend on a cluster's size, width and mails and on the number of shared items only. Sets with the same
    common items and numbers are one class. A cluster that changes tells its gain to the classes that it is good
    for, each with a heap of the gains it was told; clusters with a set's rare items are looked up. A cluster that is
    good for more than ``broad`` classes is tried with every set instead, and all clusters at once if there are
    more than ``few`` such. A set is passed over while its class is told nothing and its cluster stays as it is.
    """
    often: dict[int, int] = {}
    for its, _, _ in sets:
        for x in its:
            often[x] = often.get(x, 0) + 1
    have: dict[int, dict[int, int]] = {x: {} for x in often}  # item -> cluster -> how often
    bit = {x: j for j, x in enumerate(x for x, n in often.items() if n > len(sets) / 512 or r < 0)}  # the common items
    # Items of more than one in 32 sets have a row of marks over all clusters: at most 32 rows an attribute
    row = {x: j for j, x in enumerate(x for x, n in often.items() if n > len(sets) / 32)}
    overlap = np.arange(1, max((len(its) for its, _, _ in sets), default=0) + 1)
    with np.errstate(all="ignore"):
        power = np.arange(len(often) + len(overlap) + 1, dtype=np.float64) ** r
    powers = power.tolist()

    number: dict[tuple, int] = {}  # (common items as bits, form) -> class
    forms: dict[tuple, int] = {}  # (number of items, of mails, of distinct items) -> number
    of = [number.setdefault((sum(1 << bit[x] for x in its if x in bit), (length, n, len(its))), len(number)) for its, length, n in sets]
    form = [forms.setdefault(f, len(forms)) for _, f in number]
    common = [own for own, _ in number]
    rare = [[x for x in its if x not in bit and often[x] > 1] for its, _, _ in sets]
    with_bit: list = [[] for _ in bit]  # common item -> its classes
    for q, own in enumerate(common):
        while own:
            with_bit[(own & -own).bit_length() - 1].append(q)
            own &= own - 1
    with_bit = [np.array(x, np.int64) for x in with_bit]
    least = [length * n * n / distinct ** r + 1e-12 for length, n, distinct in forms]  # what a set gains on its own
    told: list[list] = [[] for _ in number]  # heaps of (-gain, cluster, when)
    most_told, last_told = [256] * len(number), [0] * len(number)

    room = 256
    marks, table = np.zeros((len(row), room), np.uint8), np.zeros((3, room), np.int64)
    state: list[tuple] = []  # size, width, mails of a cluster
    mask: list[int] = []  # its common items
    changed: list[int] = []
    wide: set[int] = set()  # clusters that are good for many classes
    now = wide_changed = 0
    where, stayed = [-1] * len(sets), [-1] * len(sets)
    shares: dict[int, tuple] = {}  # common items -> (how many each class shares, {number shared: {form: classes}})
    good: dict[tuple, list] = {}  # state -> [(number shared, form, gain)]
    kept_shares = kept_good = 0

    def good_for(s: tuple) -> list[tuple]:
        """The numbers of shared items and the forms for which a cluster gains more than a set on its own."""
        nonlocal kept_good
        if s not in good:
            length, n, distinct = np.array(list(forms), np.int64).T[:, :, None]
            size, width, mails = s
            with np.errstate(all="ignore"):
                gain = (size + n * length) * (mails + n) / power[np.maximum(width + distinct - overlap, 0)] - size * mails / power[width]
            f, o = np.nonzero((gain > np.array(least)[:, None]) & (overlap <= np.minimum(distinct, width)))
            if kept_good > 1_000_000:
                good.clear()
                kept_good = 0
            good[s] = list(zip((o + 1).tolist(), f.tolist(), gain[f, o].tolist()))
            kept_good += 1 + len(f)
        return good[s]

    def sharing(own: int, o: int, f: int) -> list[int]:
        """The classes of a form that share o of these common items."""
        nonlocal kept_shares
        if own not in shares:
            if kept_shares > 200_000_000:
                shares.clear()
                kept_shares = 0
            classes = np.concatenate([with_bit[j] for j in range(own.bit_length()) if own >> j & 1])
            shares[own] = np.bincount(classes, minlength=len(told)).astype(np.int16), {}
            kept_shares += 2 * len(told)
        count, groups = shares[own]
        if o not in groups:
            groups[o] = {}
            for q in np.flatnonzero(count == o).tolist():
                groups[o].setdefault(form[q], []).append(q)
            kept_shares += 100 * sum(map(len, groups[o].values()))
        return groups[o].get(f, [])

    def tell(k: int) -> None:
        nonlocal now, wide_changed
        now += 1
        changed[k] = now
        gains = [(g, qs) for o, f, g in good_for(state[k]) if (qs := sharing(mask[k], o, f))] if mask[k] else []
        if sum(len(qs) for _, qs in gains) > broad:
            wide.add(k)
            wide_changed = now
            return
        wide.discard(k)
        for g, qs in gains:
            entry = -g, k, now
            for q in qs:
                heapq.heappush(told[q], entry)
                last_told[q] = now

    def move(k: int, its: tuple, length: int, n: int) -> None:
        size, width, mails = state[k]
        for x in its:
            c = have[x]
            left = c.get(k, 0) + n
            if bool(left) != (k in c):  # the item comes or goes
                width += 1 if left else -1
                if x in row:
                    marks[row[x], k] ^= 1
                if x in bit:
                    mask[k] ^= 1 << bit[x]
            if left:
                c[k] = left
            else:
                del c[k]
        state[k] = table[:, k] = size + n * length, width, mails + n
        tell(k)

    def best(q: int, old: int, gain: float, at: int) -> tuple[float, int]:
        """The greatest gain a class was told and its cluster, if better than the one given; the first of equal ones."""
        heap, own = told[q], None
        while heap:
            g, k, when = heap[0]
            if changed[k] != when or k in wide:
                heapq.heappop(heap)
            elif k == old:
                own = heapq.heappop(heap)
            else:
                gain, at = (-g, k) if (g, k) < (-gain, at) else (gain, at)
                break
        if own:
            heapq.heappush(heap, own)
        if len(heap) > most_told[q]:
            heap[:] = {e for e in heap if changed[e[1]] == e[2] and e[1] not in wide}
            heapq.heapify(heap)
            most_told[q] = 2 * len(heap) + 256
        return gain, at

    def best_of_all(its: tuple, length: int, n: int, old: int, gain: float, at: int) -> tuple[float, int]:
        shared = np.zeros(len(state), np.uint16)
        for x in its:
            if x in row:
                shared += marks[row[x], : len(state)]
            elif c := have[x]:
                shared[np.fromiter(c, np.int64, len(c))] += 1
        if old >= 0:
            shared[old] = 0
        ks = np.flatnonzero(shared)
        if len(ks):
            s, w, m = table[:, ks]
            got = (s + n * length) * (m + n) / power[w + len(its) - shared[ks]] - s * m / power[w]
            j = int(got.argmax())
            if (-got[j], ks[j]) < (-gain, at):
                return float(got[j]), int(ks[j])
        return gain, at

    for _ in range(most):
        moved = False
        for i, (its, length, n) in enumerate(sets):
            old, q, since = where[i], of[i], stayed[i]
            if since >= last_told[q] and since >= wide_changed and not rare[i] and since >= changed[old]:
                continue
            gain, at = -math.inf, -1
            if old >= 0 and state[old][2] > n:  # to stay: the gain over its cluster without it
                size, width, mails = state[old]
                o = sum(have[x][old] > n for x in its)
                if o:
                    gain, at = size * mails / powers[width] - (size - n * length) * (mails - n) / powers[width - len(its) + o], old
            gain, at = best(q, old, gain, at)
            if len(wide) > few:
                gain, at = best_of_all(its, length, n, old, gain, at)
            else:
                for k in {*wide, *(k for x in rare[i] for k in have[x])} if wide or rare[i] else ():
                    o = (common[q] & mask[k]).bit_count() + sum(k in have[x] for x in rare[i])
                    if k != old and o:
                        size, width, mails = state[k]
                        g = (size + n * length) * (mails + n) / powers[width + len(its) - o] - size * mails / powers[width]
                        if (-g, k) < (-gain, at):
                            gain, at = g, k
            if not gain > least[form[q]]:  # a cluster of its own: the old place if that is empty without it
                at = old if old >= 0 and state[old][2] == n else len(state)
            if at == old:
                stayed[i] = now
                continue
            if old >= 0:
                move(old, its, length, -n)
            if at == len(state):
                if at == room:
                    room *= 2
                    marks, table = (np.concatenate([v, np.zeros_like(v)], axis=-1) for v in (marks, table))
                state.append((0, 0, 0))
                mask.append(0)
                changed.append(0)
            move(at, its, length, n)
            where[i], stayed[i], moved = at, -1, True
        if not moved:
            return where
    raise RuntimeError(f"transactions did not settle in {most} passes")


def transactions(df: DataFrame, attributes: list[str], r: float = 2.0, most: int = 1000) -> DataFrame:
    """(mail_id, cluster_id) by profit: sum of S(C) |C| / W(C)^r over clusters, in order of mail_id, with passes until nothing moves.

    Every move raises the profit or settles a tie, so passes come to an end; ``most`` of them without one is an error.
    The algorithm is sequential, so one task clusters at every size. Mails with equal items always move
    together, so only distinct item sets are clustered, with their numbers of mails: the task holds these.
    """
    rows = distinct_rows(df, attributes).select("mail_id", F.array_sort(items(df, attributes)).alias("items"))
    sets = written(rows.groupBy("items").agg(F.min("mail_id").alias("first"), F.count("*").alias("n")), "sets")

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            yield cluster(pd.concat(parts, ignore_index=True))

    def cluster(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("first", ignore_index=True)
        where = settled([(tuple(dict.fromkeys(i.tolist())), len(i), int(n)) for i, n in zip(b["items"], b["n"])], r, most)
        least: dict[int, str] = {}
        for name, k in zip(b["first"], where):
            least[k] = min(least.get(k, name), name)
        return pd.DataFrame({"items": b["items"], "cluster_id": [least[k] for k in where]})

    named = sets.coalesce(1).mapInPandas(block, "items array<bigint>, cluster_id string")
    return rows.join(named, "items").select("mail_id", "cluster_id")


def profit(clusters: DataFrame, df: DataFrame, attributes: list[str], r: float) -> DataFrame:
    """(n_clusters, profit) of a clustering of the mails of df."""
    rows = distinct_rows(df, attributes).select("mail_id", F.explode(items(df, attributes)).alias("item")).join(clusters, "mail_id")
    per = rows.groupBy("cluster_id", "item").agg(F.count("*").alias("n")).groupBy("cluster_id").agg(F.sum("n").alias("s"), F.count("*").alias("w"))
    members = clusters.groupBy("cluster_id").agg(F.count("*").alias("m"))
    return per.join(members, "cluster_id").agg(F.count("*").alias("n_clusters"), F.try_divide(F.sum(F.col("s") * F.col("m") / F.pow("w", F.lit(r))), F.sum("m")).alias("profit"))


def cluster_statistics(clusters: DataFrame, df: DataFrame, attributes: list[str]) -> DataFrame:
    """(cluster_id, n_members, size, width): members, items and distinct items."""
    rows = long_form(df, attributes).select("mail_id", "attr", "value").join(clusters, "mail_id")
    return rows.groupBy("cluster_id", "attr", "value").agg(F.count("*").alias("n")).groupBy("cluster_id").agg(F.sum("n").alias("size"), F.count("*").alias("width")).join(clusters.groupBy("cluster_id").agg(F.count_distinct("mail_id").alias("n_members")), "cluster_id").select("cluster_id", "n_members", "size", "width")


def renamed_by_member(clusters: DataFrame) -> DataFrame:
    """Clusters named by their least member, so that names don't depend on the run."""
    least = clusters.groupBy("cluster_id").agg(F.min("mail_id").alias("name"))
    return clusters.join(least, "cluster_id").select("mail_id", F.col("name").alias("cluster_id"))


