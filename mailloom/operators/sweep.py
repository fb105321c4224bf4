"""Many clusterings of one feature matrix, scored together against gold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.operators import grouping
from mailloom.operators.compare import metrics
from mailloom.operators.features import CATEGORICAL, FEATURES
from mailloom.operators.piecewise import joined_features, piecewise_clusters, piecewise_runs
from mailloom.plans.storage import drop, written


def _named(df: DataFrame) -> DataFrame:
    return df.select("mail_id", F.col("cluster_id").cast("string").alias("cluster_id"))


ALGORITHMS = {
    "cctree": lambda f, threshold=50.0: _named(grouping.entropy_tree(f, CATEGORICAL, threshold)),
    "fptree": lambda f, min_size=0: _named(grouping.prefix_tree(f, CATEGORICAL, min_size)),
    "clope_observed": lambda f, r=2.0: _named(grouping.transactions_observed(f, len(CATEGORICAL), r)),
    "clope": lambda f, r=2.0: _named(grouping.transactions(f, CATEGORICAL, r)),
    "ctph": lambda f, threshold=80: _named(piecewise_clusters(f, joined_features(FEATURES), threshold)),
    "all_in_one": lambda f: _named(grouping.all_in_one(f)),
    # all twelve features
    "cctree_all": lambda f, threshold=50.0: _named(grouping.entropy_tree(f, FEATURES, threshold)),
    "fptree_all": lambda f, min_size=0: _named(grouping.prefix_tree(f, FEATURES, min_size)),
    "clope_all": lambda f, r=10.0: _named(grouping.transactions_observed(f, len(FEATURES), r)),
}


#: The jobs of the sweep, the enabled ones and the others.
SWEEP = {
    **{f"cctree_t{t}": ("cctree", float(t)) for t in (50, 40, 30, 60)}, "fptree": ("fptree",),
    **{f"clope_r{r}": ("clope_observed", float(r)) for r in (5, 3, 7.5, 10, 15, 20)},
    **{f"ctph_t{t}": ("ctph", t) for t in (80, 70, 60, 90)}, "clope": ("clope",), "all_in_one": ("all_in_one",),
}


def clusterings(features: DataFrame, jobs: dict[str, tuple]) -> DataFrame:
    """(run_id, cluster_id, member) of jobs {run_id: (algorithm, parameters...)}.

    Piecewise jobs share their scores.
    """
    at = {name: job[1] if len(job) > 1 else 80 for name, job in jobs.items() if job[0] == "ctph"}
    trees = written(piecewise_runs(features, joined_features(FEATURES), list(at.values())), "trees") if at else None
    found = {name: _named(trees.filter(F.col("threshold") == at[name])) if name in at else ALGORITHMS[job[0]](features, *job[1:]) for name, job in jobs.items()}
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("run_id"), "cluster_id", F.col("mail_id").alias("member")) for name, df in found.items()])


def sweep(features: DataFrame, gold: DataFrame, jobs: dict[str, tuple]) -> DataFrame:
    """Nine metrics per job against gold(member, gold_id); the clusterings are written once.

    The features are written first and kept until then, so that jobs read their columns only.
    """
    features = written(features, "features")
    runs = written(clusterings(features, jobs), "runs")
    drop(features)
    return metrics(gold, runs)
