"""Context-triggered piecewise hashes of mails, and clusters of best matches.

The hash follows Kornblum, "Identifying almost identical files using context triggered piecewise
hashing" (2006): a rolling hash over 7 bytes cuts the text, each piece gives one of 64 letters, at
block sizes b and 2b. Scores are weighted edit distances of signatures. Published implementations
differ in their edit costs, so scores agree with none of them number by number.

Signatures without a common run of 7 letters score 0; so pairs meet in an equi-join on such runs, and
nothing is lost. Mails with equal signatures are one class, compared once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.plans.rank import numbered
from mailloom.plans.storage import drop, spread, written

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LEAST_BLOCK, LENGTH, WINDOW = 3, 64, 7
# of a hash only the low 6 bits reach the signature
PRIME = 0x01000193
_START = 0x28021967 & 63


def _triggers(data: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte."""
    n = len(data)
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)])
    plain = weighted = shifted = np.zeros(n, np.uint32)
    for k in range(WINDOW):
        c = padded[WINDOW - 1 - k:WINDOW - 1 - k + n]
        plain = plain + c
        weighted = weighted + np.uint32(WINDOW - k) * c
        shifted = shifted ^ (c << np.uint32(5 * k) if 5 * k < 32 else np.uint32(0))
    return plain + weighted + shifted


def _hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The low six bits of the pieces' hashes after every byte, for pieces that begin at ``starts``.

    A step multiplies by the prime and adds the byte without carry. Bit k of a product depends on bits up to k only and
    on bit k itself without carry, so each bit is a running exclusive or, once the lower bits are known.
    """
    n = len(data)
    at = np.zeros(n, np.int64)
    at[starts] = 1
    at = starts[np.cumsum(at) - 1]  # where each byte's piece begins
    low = np.zeros(n, np.uint8)
    before = np.zeros(n, np.uint8)  # lower bits of the hash before each byte
    for k in range(6):
        x = ((before.astype(np.uint16) * (PRIME & 63)) >> k & 1).astype(np.uint8) ^ (data >> k & 1)
        run = np.bitwise_xor.accumulate(x)
        bit = run ^ np.where(at > 0, run[at - 1], 0) ^ (_START >> k & 1)
        low |= bit << k
        before = np.empty(n, np.uint8)
        before[1:] = low[:-1]
        before[starts] = _START & ((2 << k) - 1)
    return low


def _signature(data: np.ndarray, rolled: np.ndarray, block: int, most: int) -> str:
    if not len(data):
        return ""
    cuts = np.flatnonzero(rolled % np.uint32(block) == block - 1)[:most - 1] + 1
    starts = np.concatenate([[0], cuts])
    starts = starts[starts < len(data)]
    ends = np.concatenate([starts[1:], [len(data)]]) - 1
    return "".join(LETTERS[h] for h in _hashes(data, starts)[ends])


def signature(text: str | None) -> str | None:
    """``block:signature:signature at twice the block``; null for null."""
    if text is None:
        return None
    data = np.frombuffer(text.encode("utf-8", "surrogateescape"), np.uint8)
    block = LEAST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    rolled = _triggers(data) if len(data) else np.zeros(0, np.uint32)
    while True:
        first = _signature(data, rolled, block, LENGTH)
        if block == LEAST_BLOCK or len(first) >= LENGTH // 2:
            return f"{block}:{first}:{_signature(data, rolled, block * 2, LENGTH // 2)}"
        block //= 2


def without_runs(s: str) -> str:
    """No letter more than three times in a row."""
    return "".join(c for i, c in enumerate(s) if i < 3 or not c == s[i - 1] == s[i - 2] == s[i - 3])


def _letters(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters as numbers, one row a string, 255 behind its end; lengths). No string is longer than LENGTH."""
    size = np.array([len(x) for x in strings], np.int64)
    out = np.full((len(strings), LENGTH), 255, np.uint8)
    for i, x in enumerate(strings):
        out[i, :len(x)] = np.frombuffer(x.encode(), np.uint8)
    return out, size


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of rows: a bit for each place of a, a step for each letter of b."""
    n = len(a)
    places = np.zeros((n, 128), np.uint64)
    rows = np.arange(n)
    for k in range(a.shape[1]):
        real = a[:, k] < 128
        places[rows[real], a[real, k]] |= np.uint64(1) << np.uint64(k)
    v = np.full(n, ~np.uint64(0))
    for k in range(b.shape[1]):
        real = b[:, k] < 128
        u = np.where(real, v & places[rows, np.where(real, b[:, k], 0)], np.uint64(0))
        v = (v + u) | (v - u)
    return 64 - np.array([int(x).bit_count() for x in v], np.int64)


def _strings_score(a: list[str], b: list[str], block: np.ndarray) -> np.ndarray:
    """Scores of pairs of signatures at block sizes; edits cost 1 to insert or delete and 2 to substitute."""
    out = np.zeros(len(a), np.int64)
    meet = np.array([len(x) >= WINDOW and len(y) >= WINDOW and not {x[i:i + WINDOW] for i in range(len(x) - WINDOW + 1)}.isdisjoint(y[i:i + WINDOW] for i in range(len(y) - WINDOW + 1)) for x, y in zip(a, b)], bool)
    if not meet.any():
        return out
    (p, na), (q, nb), block = _letters([x for x, m in zip(a, meet) if m]), _letters([x for x, m in zip(b, meet) if m]), block[meet]
    distance = na + nb - 2 * _common(p, q)
    got = np.maximum(0, 100 - 100 * (distance * LENGTH // (na + nb)) // LENGTH)
    out[meet] = np.where(block >= (99 + WINDOW) // WINDOW * LEAST_BLOCK, got, np.minimum(got, block // LEAST_BLOCK * np.minimum(na, nb)))
    return out


def scores(a: list[str], b: list[str]) -> np.ndarray:
    """0 to 100 for each pair; equal signatures score 100, block sizes more than one step apart 0."""
    one, two = [x.split(":") for x in a], [x.split(":") for x in b]
    x, y = np.array([int(p[0]) for p in one], np.int64), np.array([int(p[0]) for p in two], np.int64)
    a1, a2, b1, b2 = ([without_runs(p[k]) for p in part] for part in (one, two) for k in (1, 2))
    out = np.zeros(len(a), np.int64)
    for where, pairs in ((x == y, ((a1, b1, x), (a2, b2, 2 * x))), (x == 2 * y, ((a1, b2, x),)), (y == 2 * x, ((a2, b1, y),))):
        at = np.flatnonzero(where)
        for p, q, block in pairs:
            if len(at):
                out[at] = np.maximum(out[at], _strings_score([p[i] for i in at], [q[i] for i in at], block[at]))
    same = np.array([p[0] == q[0] and r == t and s == u for p, q, r, t, s, u in zip(one, two, a1, b1, a2, b2)], bool)
    return np.where(same, 100, out)


def score(a: str, b: str) -> int:
    return int(scores([a], [b])[0])


def joined_features(columns: list[str]) -> Column:
    """All features in their order, without separator."""
    return F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in columns])


def signatures(df: DataFrame, text: Column) -> DataFrame:
    """(mail_id, signature); a repeated mail_id counts once."""
    @F.pandas_udf("string")
    def sign(values: pd.Series) -> pd.Series:
        return values.map(signature)

    rows = df.groupBy("mail_id").agg(F.min(text).alias("text"))
    return spread(rows).select("mail_id", sign("text").alias("signature"))


def runs_of(sig: Column) -> Column:
    """[(block, run of 7 letters)] of both halves of a signature; without any, the squeezed halves, as equal ones score 100."""
    part = F.split(sig, ":")
    none = F.array().cast("array<struct<block:bigint,run:string>>")
    half = lambda k: F.struct((part[0].cast("bigint") * k).alias("block"), F.regexp_replace(part[k], r"(.)\1{3,}", "$1$1$1").alias("s"))
    cut = lambda p: F.transform(F.sequence(F.lit(1), F.length(p.s) - (WINDOW - 1)), lambda i: F.struct(p.block.alias("block"), F.substr(p.s, i, F.lit(WINDOW)).alias("run")))
    # halves are elements of an array, so that each is squeezed once and not for every run
    runs = lambda both: F.flatten(F.transform(both, lambda p: F.when(F.length(p.s) >= WINDOW, cut(p)).otherwise(none)))
    short = lambda both: F.when(F.forall(both, lambda p: F.length(p.s) < WINDOW), F.array(F.struct(both[0].block.alias("block"), F.concat_ws(":", both[0].s, both[1].s).alias("run")))).otherwise(none)
    return F.transform(F.array(F.array(half(1), half(2))), lambda both: F.array_distinct(F.concat(runs(both), short(both))))[0]


def scored_classes(classes: DataFrame) -> DataFrame:
    """(a, b, score), a < b, score > 0, of classes (id, signature)."""
    grams = classes.select("id", "signature", F.explode(runs_of(F.col("signature"))).alias("g")).select("id", "g.block", "g.run")
    left, right = grams.select(F.col("id").alias("a"), "block", "run"), grams.select(F.col("id").alias("b"), "block", "run")
    pairs = left.join(right, ["block", "run"]).filter("a < b").select("a", "b").distinct()
    s = lambda x: classes.select(F.col("id").alias(x), F.col("signature").alias(f"s{x}"))

    @F.pandas_udf("int")
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(scores(list(x), list(y)), dtype="int32")

    return pairs.join(s("a"), "a").join(s("b"), "b").select("a", "b", compare("sa", "sb").alias("score")).filter("score > 0")


def best_match_forest(best: DataFrame) -> DataFrame:
    """(node, root) for (node, ord, best_ord): a node joins the tree of its best match if that comes earlier, else it opens one.

    best_ord is null without a match. Nodes are their ord; roots by pointer jumping.
    """
    links = written(best.select("ord", F.when(F.col("best_ord") < F.col("ord"), F.col("best_ord")).otherwise(F.col("ord")).alias("up")), "forest")
    for _ in range(64):
        above = links.select(F.col("ord").alias("_o"), F.col("up").alias("_u"))
        nxt = written(links.join(above, F.col("up") == F.col("_o")).select("ord", F.col("_u").alias("up"), (F.col("up") != F.col("_u")).alias("moved")), "forest")
        drop(links)
        links = nxt.select("ord", "up")
        if nxt.filter("moved").isEmpty():
            break
    return links.withColumnRenamed("up", "root")


def piecewise_runs(df: DataFrame, text: Column, thresholds: list[int]) -> DataFrame:
    """(mail_id, threshold, cluster_id): trees of best matches above each threshold; the order is that of mail_id, which also breaks ties.

    A cluster is named by its root's mail. Empty texts have equal signatures and so are one class. Mails are
    signed and pairs scored once for all thresholds, whose forests grow together.
    """
    signed = written(signatures(df, text), "signatures")
    ordered = written(numbered(signed.withColumn("_all", F.lit(0)), ["_all"], ["mail_id"], "ord", ordered=True).drop("_all"), "ordered")
    classes = written(ordered.groupBy("signature").agg(F.min("ord").alias("id"), F.count("*").alias("n")), "classes")
    levels = F.array(*[F.lit(t) for t in sorted(set(thresholds))])
    every = F.explode(levels)
    pairs = written(scored_classes(classes).filter(F.col("score") > min(thresholds)), "pairs").withColumn("threshold", every).filter(F.col("score") > F.col("threshold"))
    both = pairs.select("threshold", F.col("a").alias("id"), F.col("b").alias("other"), "score").unionByName(pairs.select("threshold", F.col("b").alias("id"), F.col("a").alias("other"), "score"))
    best = both.groupBy("threshold", "id").agg(F.max(F.struct("score", (-F.col("other")).alias("o"))).alias("m")).select("threshold", "id", F.col("m.score").alias("score"), (-F.col("m.o")).alias("other"))
    twin = ordered.join(classes.select("signature", "id"), "signature")
    next_twin = twin.filter(F.col("ord") != F.col("id")).groupBy("signature").agg(F.min("ord").alias("second"))
    rows = twin.join(next_twin, "signature", "left").withColumn("threshold", every).join(best, ["threshold", "id"], "left")
    own = F.when(F.col("ord") != F.col("id"), F.col("id")).otherwise(F.col("second"))  # the first mail of equal signature
    pick = F.when(own.isNotNull() & (F.lit(100) > F.col("threshold")), F.when((F.col("score") == 100) & (F.col("other") < own), F.col("other")).otherwise(own)).otherwise(F.col("other"))
    # a node is a mail at a threshold: numbers of different thresholds don't meet
    node = lambda c: (F.array_position(levels, F.col("threshold")) - 1) * F.lit(1 << 48) + c
    forest = best_match_forest(rows.select(node(F.col("ord")).alias("ord"), node(pick).alias("best_ord")))
    trees = forest.select(levels[F.shiftright("ord", 48).cast("int")].alias("threshold"), *[(F.col(c) - F.shiftleft(F.shiftright(c, 48), 48)).alias(c) for c in ("ord", "root")])
    names = ordered.select(F.col("ord").alias("root"), F.col("mail_id").alias("cluster_id"))
    return ordered.join(trees, "ord").join(names, "root").select("mail_id", "threshold", "cluster_id")


def piecewise_clusters(df: DataFrame, text: Column, threshold: int = 80) -> DataFrame:
    """(mail_id, cluster_id) at one threshold."""
    return piecewise_runs(df, text, [threshold]).select("mail_id", "cluster_id")
