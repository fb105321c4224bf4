"""Clusters as sets, two clusterings against each other, and the profile of one.

A clustering is (cluster_id, member) rows; comparisons run for any number of runs at once:
gold(member, gold_id) against runs(run_id, cluster_id, member). Members match by base name.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.operators.copies import base_name
from mailloom.plans.rank import numbered
from mailloom.plans.storage import written


def members(clusters: DataFrame, *more: str) -> DataFrame:
    """(more..., cluster_id, member): members by base name, each once in a cluster."""
    return clusters.select(*more, "cluster_id", base_name(F.col("member")).alias("member")).distinct()


def removed(clusters: DataFrame, gone: DataFrame) -> DataFrame:
    """clusters without the members of ``gone`` (member: a path or a base name)."""
    names = gone.select(base_name(F.col("member")).alias("_name")).distinct()
    return clusters.withColumn("_name", base_name(F.col("member"))).join(names, "_name", "left_anti").drop("_name")


def inverted(clusters: DataFrame) -> DataFrame:
    """(member, clusters): the sorted clusters of every member."""
    return members(clusters).groupBy("member").agg(F.array_sort(F.collect_set("cluster_id")).alias("clusters"))


def pair_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(member, status) of two sets (member): true_positive in both, false_positive in b only, false_negative in a only."""
    left, right = a.select(base_name(F.col("member")).alias("member")).distinct().withColumn("_l", F.lit(True)), b.select(base_name(F.col("member")).alias("member")).distinct().withColumn("_r", F.lit(True))
    status = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "true_positive").when(F.col("_r").isNotNull(), "false_positive").otherwise("false_negative")
    return left.join(right, "member", "full_outer").select("member", status.alias("status"))


def overlap(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, gold_id, cluster_id, tp, n_gold, n_other, jaccard) of all pairs with common members."""
    both = gold.join(runs, "member").groupBy("run_id", "gold_id", "cluster_id").agg(F.count("*").alias("tp"))
    ng, no = gold.groupBy("gold_id").agg(F.count("*").alias("n_gold")), runs.groupBy("run_id", "cluster_id").agg(F.count("*").alias("n_other"))
    return both.join(ng, "gold_id").join(no, ["run_id", "cluster_id"]).select("run_id", "gold_id", "cluster_id", "tp", "n_gold", "n_other", F.round(F.col("tp") / (F.col("n_gold") + F.col("n_other") - F.col("tp")), 9).alias("jaccard"))


def mutual_match(pairs: DataFrame) -> DataFrame:
    """Pairs of overlap that are each other's best; the smallest id wins ties."""
    best = lambda of, to: pairs.groupBy("run_id", of).agg(F.min(F.struct((-F.col("jaccard")).alias("j"), to)).alias("m")).select("run_id", of, F.col(f"m.{to}").alias(to))
    keys = ["run_id", "gold_id", "cluster_id"]
    return pairs.join(best("gold_id", "cluster_id"), keys, "left_semi").join(best("cluster_id", "gold_id"), keys, "left_semi")


#: Most runs compared at once; their names are collected.
MOST_RUNS = 10_000


def match_status(gold: DataFrame, runs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(run_id, gold_id, cluster_id, status): matched pairs, missing gold clusters, additional clusters. ``pairs``: their overlap, if known."""
    matched = written(mutual_match(written(overlap(gold, runs), "overlap") if pairs is None else pairs).select("run_id", "gold_id", "cluster_id", F.lit("matched").alias("status")), "matched")
    names = sorted(r["run_id"] for r in runs.select("run_id").distinct().limit(MOST_RUNS + 1).collect())
    if len(names) > MOST_RUNS:
        raise ValueError(f"more than {MOST_RUNS} runs at once")
    golds = gold.select("gold_id").distinct().withColumn("run_id", F.explode(F.array(*[F.lit(x) for x in names]).cast("array<string>")))
    missing = golds.join(matched, ["run_id", "gold_id"], "left_anti").select("run_id", "gold_id", F.lit(None).cast("string").alias("cluster_id"), F.lit("missing").alias("status"))
    additional = runs.select("run_id", "cluster_id").distinct().join(matched, ["run_id", "cluster_id"], "left_anti").select("run_id", F.lit(None).cast("string").alias("gold_id"), "cluster_id", F.lit("additional").alias("status"))
    return matched.unionByName(missing).unionByName(additional)


def diff_counts(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, tp, tn, fp, fn, n, n_gold_clusters, n_clusters) summed over matched, missing and additional clusters."""
    pairs = written(overlap(gold, runs), "overlap")
    status = match_status(gold, runs, pairs)
    ng, no = gold.groupBy("gold_id").agg(F.count("*").alias("ng")), runs.groupBy("run_id", "cluster_id").agg(F.count("*").alias("no"))
    tp = pairs.select("run_id", "gold_id", "cluster_id", "tp")
    # members of gold that a run's cluster holds: only those lower the true negatives
    inside = runs.join(gold.select("member").distinct(), "member", "left_semi").groupBy("run_id", "cluster_id").agg(F.count("*").alias("ni"))
    x = status.join(ng, "gold_id", "left").join(no, ["run_id", "cluster_id"], "left").join(tp, ["run_id", "gold_id", "cluster_id"], "left").join(inside, ["run_id", "cluster_id"], "left")
    n_gold = gold.agg(F.count_distinct("member").alias("n"), F.count_distinct("gold_id").alias("g")).first()
    n, g = F.lit(n_gold["n"]), F.lit(n_gold["g"])
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    on = F.col("status") == "matched"
    return x.groupBy("run_id").agg(
        F.sum(F.when(on, F.col("tp")).otherwise(0)).alias("tp"),
        F.sum(F.when(on, n - F.col("ng") - z("ni") + F.col("tp")).otherwise(0)).alias("tn"),
        F.sum(F.when(on, F.col("no") - F.col("tp")).when(F.col("status") == "additional", F.col("no")).otherwise(0)).alias("fp"),
        F.sum(F.when(on, F.col("ng") - F.col("tp")).when(F.col("status") == "missing", F.col("ng")).otherwise(0)).alias("fn"),
        F.sum(F.when(F.col("status") != "missing", 1).otherwise(0)).alias("n_clusters"),
    ).select("run_id", "tp", "tn", "fp", "fn", n.alias("n"), g.alias("n_gold_clusters"), "n_clusters")


def contingency(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, gold_id, cluster_id, n) over the members that both sides know; of several clusters of a member the least counts."""
    g = gold.groupBy("member").agg(F.min("gold_id").alias("gold_id"))
    r = runs.groupBy("run_id", "member").agg(F.min("cluster_id").alias("cluster_id"))
    return r.join(g, "member").groupBy("run_id", "gold_id", "cluster_id").agg(F.count("*").alias("n"))


def unmatched_members(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, n_unmatched): members of a run that gold lacks, and that no label metric can count."""
    return runs.join(gold, "member", "left_anti").groupBy("run_id").agg(F.count_distinct("member").alias("n_unmatched"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting small arguments up."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift - np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5)


def expected_information(a: list[tuple[int, int]], b: list[tuple[int, int]], n: int) -> float:
    """Expected mutual information of two random labelings with the given (size, how many clusters) histograms."""
    total = 0.0
    base = _log_gamma(np.array([n + 1.0]))[0]
    for x, cx in a:
        for y, cy in b:
            k = np.arange(max(1, x + y - n), min(x, y) + 1, dtype=np.float64)
            g = _log_gamma(np.array([x + 1.0, y + 1.0, n - x + 1.0, n - y + 1.0])).sum() - base
            logs = g - _log_gamma(k + 1) - _log_gamma(x - k + 1) - _log_gamma(y - k + 1) - _log_gamma(n - x - y + k + 1)
            total += cx * cy * float((k / n * np.log(n * k / (x * y)) * np.exp(logs)).sum())
    return total


def pair_metrics(table: DataFrame) -> DataFrame:
    """(run_id, ri, ari, nmi, ami) of contingency tables, rounded to 6 places; 1.0 where a formula has no range."""
    side_sum = lambda k, name: table.groupBy("run_id", k).agg(F.sum("n").alias(name))
    x = table.join(side_sum("gold_id", "a"), ["run_id", "gold_id"]).join(side_sum("cluster_id", "b"), ["run_id", "cluster_id"])
    two = lambda c: c * (c - 1) / 2
    n = F.col("n").cast("double")
    totals = table.groupBy("run_id").agg(F.sum("n").alias("total"))
    rows = table.groupBy("run_id", "gold_id").agg(F.sum("n").alias("s")).groupBy("run_id", "s").agg(F.count("*").alias("c")).withColumn("side", F.lit(0))
    cols = table.groupBy("run_id", "cluster_id").agg(F.sum("n").alias("s")).groupBy("run_id", "s").agg(F.count("*").alias("c")).withColumn("side", F.lit(1))
    sizes = rows.unionByName(cols)
    marg = sizes.groupBy("run_id").agg(*[F.sum(F.when(F.col("side") == k, F.col("c") * two(F.col("s").cast("double")))).alias(f"p{k}") for k in (0, 1)], *[F.sum(F.when(F.col("side") == k, F.col("c") * F.col("s") * F.ln("s"))).alias(f"h{k}") for k in (0, 1)])
    inner = x.join(totals, "run_id").groupBy("run_id").agg(F.sum(two(n)).alias("pij"), F.sum(n / F.col("total") * F.ln(n * F.col("total") / (F.col("a") * F.col("b")))).alias("mi"))

    def expect(g: pd.DataFrame) -> pd.DataFrame:
        a = [(int(s), int(c)) for s, c, k in zip(g.s, g.c, g.side) if k == 0]
        b = [(int(s), int(c)) for s, c, k in zip(g.s, g.c, g.side) if k == 1]
        return pd.DataFrame({"run_id": [g.run_id.iloc[0]], "emi": [expected_information(a, b, sum(s * c for s, c in a))]})

    # a run's group is its histogram of cluster sizes: at most sqrt(2 n) rows a side
    emi = sizes.groupBy("run_id").applyInPandas(expect, f"run_id {dict(table.dtypes)['run_id']}, emi double")
    m = totals.join(marg, "run_id").join(inner, "run_id").join(emi, "run_id")
    nn = F.col("total").cast("double")
    pairs = two(nn)
    hg, ho = F.ln(nn) - F.col("h0") / nn, F.ln(nn) - F.col("h1") / nn
    mean = (hg + ho) / 2
    expected = F.try_divide(F.col("p0") * F.col("p1"), pairs)
    top = (F.col("p0") + F.col("p1")) / 2 - expected
    one = F.lit(1.0)
    r = lambda c: F.round(c, 6)
    return m.select(
        "run_id",
        r(F.when(nn < 2, one).otherwise((pairs + 2 * F.col("pij") - F.col("p0") - F.col("p1")) / pairs)).alias("ri"),
        r(F.when((nn < 2) | (F.abs(top) < 1e-12), one).otherwise(F.try_divide(F.col("pij") - expected, top))).alias("ari"),
        r(F.when(mean < 1e-12, one).otherwise(F.try_divide(F.col("mi"), mean))).alias("nmi"),
        r(F.when(F.abs(mean - F.col("emi")) < 1e-12, one).otherwise(F.try_divide(F.col("mi") - F.col("emi"), mean - F.col("emi")))).alias("ami"),
    )


def label_metrics(gold: DataFrame, runs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(run_id, accuracy, precision, recall, f1_macro, f1_micro), rounded to 6 places. ``table``: their contingency, if known.

    A matched pair shares a label, every other cluster has its own; macro means run over the labels
    that occur on either side of the aligned members, and an empty denominator counts as 0.
    """
    matched = mutual_match(written(overlap(gold, runs), "overlap")).select("run_id", F.col("gold_id").alias("_g"), F.col("cluster_id").alias("_c"))
    table = contingency(gold, runs) if table is None else table
    name = matched.select("run_id", F.col("_c").alias("cluster_id"), F.col("_g").alias("label"))
    t = table.join(name, ["run_id", "cluster_id"], "left").select("run_id", F.concat(F.lit("g"), "gold_id").alias("truth"), F.coalesce(F.concat(F.lit("g"), "label"), F.concat(F.lit("c"), "cluster_id")).alias("guess"), "n")
    cells = t.select("run_id", F.col("truth").alias("label"), F.col("n").alias("gold_n"), F.lit(0).alias("test_n"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("hit")).unionByName(t.select("run_id", F.col("guess").alias("label"), F.lit(0).alias("gold_n"), F.col("n").alias("test_n"), F.lit(0).alias("hit")))
    per = cells.groupBy("run_id", "label").agg(F.sum("gold_n").alias("g"), F.sum("test_n").alias("t"), F.sum("hit").alias("h"))
    p, rc = F.coalesce(F.try_divide(F.col("h"), F.col("t")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("h"), F.col("g")), F.lit(0.0))
    f = F.coalesce(F.try_divide(2.0 * F.col("h"), F.col("g") + F.col("t")), F.lit(0.0))
    acc = F.try_divide(F.sum("h"), F.sum("g"))
    return per.groupBy("run_id").agg(F.round(acc, 6).alias("accuracy"), F.round(F.avg(p), 6).alias("precision"), F.round(F.avg(rc), 6).alias("recall"), F.round(F.avg(f), 6).alias("f1_macro"), F.round(acc, 6).alias("f1_micro"))


def metrics(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """All nine metrics per run, in one plan for all runs."""
    table = written(contingency(gold, runs), "contingency")
    return pair_metrics(table).join(label_metrics(gold, runs, table), "run_id", "left")


def profile(runs: DataFrame) -> DataFrame:
    """(run_id, n_members, n_clusters, avg_cluster_size, n_duplicates) of runs (run_id, cluster_id, member)."""
    per = runs.groupBy("run_id", "member").agg(F.count_distinct("cluster_id").alias("k")).groupBy("run_id").agg(F.count("*").alias("n_members"), F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).alias("n_duplicates"))
    return per.join(runs.groupBy("run_id").agg(F.count_distinct("cluster_id").alias("n_clusters")), "run_id").select("run_id", "n_members", "n_clusters", F.round(F.try_divide(F.col("n_members"), F.col("n_clusters")), 6).alias("avg_cluster_size"), "n_duplicates")


def duplicate_members(runs: DataFrame) -> DataFrame:
    """(run_id, member, clusters): members of more than one cluster of a run."""
    return runs.groupBy("run_id", "member").agg(F.array_sort(F.collect_set("cluster_id")).alias("clusters")).filter(F.size("clusters") > 1)


def f1_baselines(runs: DataFrame) -> DataFrame:
    """F1 of 'all in one' and 'one for each' against the clusters, over (cluster, member) rows, rounded to 6 places.

    Clusters are numbered from 0 by id, and rows by (cluster, member). All in one guesses label 1 for
    every row; one for each guesses the row's own number.
    """
    sizes = runs.groupBy("run_id", "cluster_id").agg(F.count("*").alias("s"))
    x = numbered(numbered(sizes, ["run_id"], ["cluster_id"], "label", ordered=True), ["run_id"], ["cluster_id"], "first", weight="s", ordered=True)
    x = x.join(sizes.groupBy("run_id").agg(F.sum("s").alias("n"), F.count("*").alias("k")), "run_id")
    # row numbers of cluster `label` run from first to first + s - 1; its own number is hit if it is among them
    hit = (F.col("label") >= F.col("first")) & (F.col("label") < F.col("first") + F.col("s"))
    each = F.when(hit, 2.0 / (F.col("s") + 1)).otherwise(0.0)
    one = F.when(F.col("label") == 1, 2.0 * F.col("s") / (F.col("s") + F.col("n"))).otherwise(0.0)
    labels_one = F.max(F.greatest("k", F.lit(2)))
    return x.groupBy("run_id").agg(
        F.round(F.sum(one) / labels_one, 6).alias("f1_macro_all_in_one"), F.round(F.sum(F.when(F.col("label") == 1, F.col("s")).otherwise(0)) / F.max("n"), 6).alias("f1_micro_all_in_one"),
        F.round(F.sum(each) / F.max("n"), 6).alias("f1_macro_one_for_each"), F.round(F.sum(F.when(hit, 1).otherwise(0)) / F.max("n"), 6).alias("f1_micro_one_for_each"))


def report(runs: DataFrame) -> DataFrame:
    """(run_id, line): the profile as text."""
    p = profile(runs).join(f1_baselines(runs), "run_id")
    return p.select("run_id", F.format_string("%d members in %d clusters (%.3f each), %d in several; F1 all in one %.3f, one for each %.3f", "n_members", "n_clusters", "avg_cluster_size", "n_duplicates", "f1_macro_all_in_one", "f1_macro_one_for_each").alias("line"))


def diff_report(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, line): the totals, the Rand index over aligned members, and how every cluster fares, as text."""
    status = match_status(gold, runs)
    pairs = overlap(gold, runs).select("run_id", "gold_id", "cluster_id", "jaccard")
    text = F.when(F.col("status") == "matched", F.format_string("%s matches %s (Jaccard %.3f)", "gold_id", "cluster_id", "jaccard")).when(F.col("status") == "missing", F.format_string("no match for %s", "gold_id")).otherwise(F.format_string("new cluster %s", "cluster_id"))
    lines = status.join(pairs, ["run_id", "gold_id", "cluster_id"], "left").select("run_id", text.alias("line"))
    c = diff_counts(gold, runs)
    totals = c.select("run_id", F.format_string("tn=%d, fn=%d, tp=%d, fp=%d, n=%d; %d gold clusters, %d clusters", "tn", "fn", "tp", "fp", "n", "n_gold_clusters", "n_clusters").alias("line"))
    rand = pair_metrics(contingency(gold, runs)).select("run_id", F.format_string("Rand index %.6f", "ri").alias("line"))
    return totals.unionByName(rand).unionByName(lines)
