"""Mixing sources to target shares of all tokens.

The mix holds M tokens, as many as shares and repeats allow: M = min over sources of repeats x tokens / share.
Each source's documents are shuffled, anew for every repeat, and laid end to end; the line is cut where
the source has given its share of M; where a document stands across the cut, others that fit take its place.
The line falls into blocks of equal tokens, a document standing in the block it begins in.

The order is a low-discrepancy schedule: slot i belongs to the source whose interval of the cumulated shares
holds the golden-ratio point frac((i + 1/2) phi), and the k-th slot of a source takes the k-th block of its line.
So slots count tokens handed out, not documents: a source that gave a document of many blocks has no
block to begin in its next slots and is passed over there, until the others have caught up. Slots without a
document are left out and the others numbered through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailloom.plans.rank import numbered, slices_for
from mailloom.plans.storage import written

PHI = (5 ** 0.5 - 1) / 2
BLOCK = 2048
#: Bound of the table of targets, which is collected and broadcast.
MOST_SOURCES = 10_000


def source_form(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))


def mix(items: DataFrame, targets: DataFrame, key: str, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """(slot, source, key, repeat, n_tokens) of the mix.

    ``items``: key, source (normalised), n_tokens. ``targets``: source, target_share, max_repeats (one row
    a source; a bounded table). Items of sources without target, of null source or without tokens
    stay out. Sources without any token are left out and the other shares hold relative to each
    other. No item occurs more than max_repeats times, each time at another place of a new shuffle.
    A source falls short of its share by less tokens than the shortest document it has left holds.
    """
    spark = items.sparkSession
    found = targets.select("source", "target_share", "max_repeats").distinct().limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources have targets")
    goals = sorted(g for r in found if (g := (r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)))[1] > 0 and g[2] > 0)
    schema = f"slot bigint, source string, {key} {dict(items.dtypes)[key]}, repeat int, n_tokens int"
    if not goals:
        return spark.createDataFrame([], schema)
    wanted = spark.createDataFrame([(s,) for s, _, _ in goals], "source string")
    mine = written(items.filter(F.col("n_tokens") > 0).join(F.broadcast(wanted), "source").select("source", key, F.col("n_tokens").cast("int").alias("n_tokens")), "sized")
    totals = {r["source"]: r["t"] for r in mine.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # a row a source
    goals = [g for g in goals if totals.get(g[0], 0) > 0]
    if not goals:
        return spark.createDataFrame([], schema)
    whole = sum(w for _, w, _ in goals)
    size = min(r * totals[s] / (w / whole) for s, w, r in goals)
    # a source that gives all it has isn't cut by a rounding error
    plan = [(s, totals[s], (give := min(r * totals[s], round(size * w / whole))), min(r, -(-give // totals[s]))) for s, w, r in goals]
    sums = spark.createDataFrame(plan, "source string, total bigint, give bigint, times int")
    again = mine.join(F.broadcast(sums), "source").select("*", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("repeat")).withColumn("_h", F.xxhash64(F.lit(seed), "repeat", key))
    n_slices = slices_for(spark)
    slice_col = F.pmod(F.shiftrightunsigned("_h", 20), F.lit(n_slices)).cast("int")
    laid = numbered(again, ["source", "repeat"], ["_h", key], "_at", weight="n_tokens", slice_col=slice_col)
    laid = written(laid.withColumn("start", F.col("repeat") * F.col("total") + F.col("_at")).filter(F.col("start") < F.col("give") + F.col("total")).select("source", key, "repeat", "n_tokens", "start", "give", "_h"), "laid")
    inside = F.col("start") + F.col("n_tokens") <= F.col("give")
    # the gap before the cut is filled from the last repeat's other documents, largest first, by the histogram of their sizes
    ends = laid.groupBy("source").agg(F.coalesce(F.max(F.when(inside, F.col("start") + F.col("n_tokens"))), F.lit(0)).alias("full"), F.max(F.when(inside | (F.col("start") < F.col("give")), F.col("repeat"))).alias("last"))
    rest = laid.join(F.broadcast(ends), "source").filter(~inside & (F.col("repeat") == F.col("last")) & (F.col("full") + F.col("n_tokens") <= F.col("give")))
    room: dict[str, list[tuple[int, int, int, int]]] = {}
    for r in rest.groupBy("source", "n_tokens").agg(F.count("*").alias("n"), F.max("full").alias("full"), F.max("give").alias("give")).collect():  # sizes below a text's own
        room.setdefault(r["source"], []).append((r["n_tokens"], r["n"], r["full"], r["give"]))
    takes = []
    for name, sizes in room.items():
        place = sizes[0][2]
        for one, n, _, give in sorted(sizes, reverse=True):
            if k := min(n, (give - place) // one):
                takes.append((name, one, k, place))
                place += k * one
    fills = numbered(rest.join(F.broadcast(spark.createDataFrame(takes, "source string, n_tokens int, k bigint, place bigint")), ["source", "n_tokens"]), ["source", "n_tokens"], ["_h", key], "_r", slice_col=slice_col).filter(F.col("_r") < F.col("k"))
    columns = ["source", key, "repeat", "n_tokens", "start", "give"]
    chosen = laid.filter(inside).select(*columns).unionByName(fills.withColumn("start", F.col("place") + F.col("_r") * F.col("n_tokens")).select(*columns))
    blocks = chosen.withColumn("block_no", F.floor(F.col("start") / F.lit(block)).cast("bigint")).select("source", "block_no", key, "repeat", "n_tokens")
    # every block finds a slot: the points' discrepancy grows with the logarithm of their number
    n = sum(g for _, _, g, _ in plan) / block
    n_slots = int(n + (8 + 4 * math.log2(n + 2)) / min(w / whole for _, w, _ in goals)) + 1
    at, cuts = 0.0, []
    for s, w, _ in goals:
        at += w / whole
        cuts.append((s, at))
    point = F.pmod((F.col("id").cast("double") + 0.5) * F.lit(PHI), F.lit(1.0))
    owner = F.lit(cuts[-1][0])
    for s, upto in reversed(cuts[:-1]):
        owner = F.when(point < upto, s).otherwise(owner)
    by_slot = lambda c: F.floor(F.col(c) * F.lit(n_slices) / F.lit(n_slots)).cast("int")
    slots = numbered(spark.range(n_slots).select(F.col("id").alias("place"), owner.alias("source")), ["source"], ["place"], "block_no", slice_col=by_slot("place"))
    used = written(slots.join(blocks.select("source", "block_no").distinct(), ["source", "block_no"]).withColumn("_all", F.lit(0)), "slots")
    used = numbered(used, ["_all"], ["place"], "slot", slice_col=by_slot("place")).select("source", "block_no", "slot")
    return used.join(blocks, ["source", "block_no"]).select("slot", "source", key, "repeat", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_rows, most_repeats): what the mix reached."""
    per = mixed.groupBy("source", key).agg(F.count("*").alias("times"), F.sum("n_tokens").alias("t")).groupBy("source").agg(F.sum("t").alias("n_tokens"), F.sum("times").alias("n_rows"), F.max("times").alias("most_repeats"))
    n = F.coalesce("n_tokens", F.lit(0))
    total = F.sum(n).over(Window.partitionBy())  # over the few rows of targets
    return targets.select("source", "target_share").distinct().join(per, "source", "left").select("source", "target_share", F.try_divide(n, total).alias("actual_share"), n.alias("n_tokens"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
