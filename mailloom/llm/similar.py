"""Near-duplicate texts: a set-similarity join on word shingles with rare-first prefix filtering.

Texts with equal shingle sets are one class; only classes are compared. Shingles are ordered rare
first (document frequency over all classes, then hash). For Jaccard similarity t, a class of n
shingles has a prefix of n - ceil(t n) + 1 shingles, and two classes reach t only if their prefixes
meet. Shingles of one class only can't meet, so they count for positions but aren't kept.
Candidates meet in an equi-join on prefix shingles under the length filter; grouped by pair, the number of
common prefix shingles and their last positions bound the overlap (positional filter); histograms
of the suffixes over hash buckets bound it again (suffix filter); what is left is verified once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.operators.components import connected_components
from mailloom.plans.storage import spread, written

BUCKETS = 16
#: Texts of a shingle, or copies of a text, per part of a join.
HOT = 1000


def word_list(text: Column) -> Column:
    """Maximal runs of letters and digits of the lower-cased text."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, n: int) -> Column:
    """Distinct n-word runs, as 64-bit hashes; words must be n at least."""
    runs = F.arrays_zip(*[F.slice(words, k + 1, F.size(words) - (n - 1)).alias(f"w{k}") for k in range(n)])
    return F.array_distinct(F.transform(runs, lambda r: F.xxhash64(*[r[f"w{k}"] for k in range(n)])))


def shingle_classes(df: DataFrame, key: str, text: str, n: int, least_words: int) -> tuple[DataFrame, DataFrame]:
    """(classes: id, grams, n), (members: id, key). Rows with fewer words, null texts and null keys take no part."""
    # small inputs come as one split: then a shuffle of the texts alone
    texts = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & F.col("text").isNotNull()))
    words = texts.select("key", word_list(F.col("text")).alias("w")).filter(F.size("w") >= max(n, least_words))
    sets = words.select("key", F.sort_array(shingles(F.col("w"), n)).alias("grams"))
    sets = written(sets.withColumn("sig", F.sha2(F.array_join(F.col("grams").cast("array<string>"), ","), 256)), "sets")
    one = written(sets.groupBy("sig").agg(F.first("grams").alias("grams")).withColumn("id", F.monotonically_increasing_id()), "classes")
    members = sets.select("sig", "key").join(one.select("sig", "id"), "sig").select("id", "key").distinct()
    return one.select("id", "grams", F.size("grams").alias("n")), members


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b: pairs of classes whose Jaccard similarity reaches the threshold."""
    t, e = F.lit(threshold), F.lit(1e-9)
    grams = classes.select("id", "n", F.explode("grams").alias("g"))
    shared = grams.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1")
    kept = grams.join(shared, "g").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("o"))
    # positions count over all shingles: those of one class only come first
    docs = kept.select("id", "n", F.col("o.g").alias("toks"), F.col("o.df").alias("dfs"), (F.col("n") - F.size("o")).alias("alone"), (F.col("n") - F.ceil(t * F.col("n") - e) + 1).cast("int").alias("plen")).filter("plen > alone")
    suffix = F.slice("toks", F.col("plen") - F.col("alone") + 1, F.greatest(F.col("n") - F.col("plen"), F.lit(0)))
    marks = F.transform(suffix, lambda g: F.pmod(g, F.lit(BUCKETS)).cast("int"))
    docs = written(docs.withColumn("_m", marks).withColumn("hist", F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.size(F.filter("_m", lambda x: x == k)).cast("smallint"))).drop("_m"), "prefixes")
    # a shingle of many texts is joined in parts: one side is cut by a hash of its id, the other repeated for each part
    first = F.slice(F.arrays_zip("toks", "dfs"), 1, F.col("plen") - F.col("alone"))
    p = docs.select("id", "n", "alone", F.posexplode(first).alias("pos", "x")).select("id", "n", (F.col("pos") + F.col("alone")).alias("pos"), F.col("x.toks").alias("g"), F.ceil(F.col("x.dfs") / F.lit(HOT)).cast("int").alias("parts"))
    left = p.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), "g", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    right = p.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    need = F.ceil(t / (1 + t) * (F.col("na") + F.col("nb")) - e)
    met = left.join(right, ["g", "part"]).filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= t * F.greatest("na", "nb") - e) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + F.least("pa", "pb") >= need))
    pairs = (met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
        .filter(F.col("c") + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1) >= need))
    both = pairs
    for x in "ab":
        both = both.join(docs.select(F.col("id").alias(x), F.col("toks").alias(f"t{x}"), F.col("hist").alias(f"h{x}"), F.col("plen").alias(f"e{x}")), x)
    # common shingles beyond those met so far lie in both suffixes, or in the rest of one prefix
    rest = F.aggregate(F.zip_with("ha", "hb", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda s, x: s + x)
    beyond = F.greatest(F.col("ea") - F.col("pa") - 1, F.col("eb") - F.col("pb") - 1, F.lit(0))
    both = both.filter(F.col("c") + rest + beyond >= need).withColumn("o", F.size(F.array_intersect("ta", "tb")))
    return both.filter(F.col("o") >= need).select("a", "b", (F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))).alias("similarity"))


def similar_rows(df: DataFrame, key: str, text: str, n: int = 5, threshold: float = 0.8, least_words: int = 0) -> DataFrame:
    """(key_a, key_b), key_a < key_b: all pairs of different keys whose texts reach the similarity.

    Repeated rows of a key count once; texts with equal shingles are similar by 1. Short, empty and
    null texts take no part. Very long texts are compared whole.
    """
    classes, members = shingle_classes(df, key, text, n, least_words)
    pairs = similar_classes(classes, threshold)
    m = lambda i, k: members.select(F.col("id").alias(i), F.col("key").alias(k))
    across = pairs.join(m("a", "x"), "a").join(m("b", "y"), "b").select("x", "y")
    # pairs of equal texts, in parts: n copies make n (n - 1) / 2 rows, which the result's form asks for
    sized = members.join(members.groupBy("id").agg(F.ceil(F.count("*") / F.lit(HOT)).cast("int").alias("parts"), F.count("*").alias("n")).filter("n > 1"), "id")
    ones = sized.select("id", F.col("key").alias("x"), F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    within = ones.join(sized.select("id", F.col("key").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), ["id", "part"]).select("x", "y")
    return across.unionByName(within).filter(F.col("x") != F.col("y")).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def similar_groups(df: DataFrame, key: str, text: str, n: int = 5, threshold: float = 0.8, least_words: int = 0) -> DataFrame:
    """(key, class_id, group_id, n_links): one row per text that takes part.

    class_id: texts with equal shingles; group_id: classes connected by similar pairs; both are named by
    their least key. n_links: similar classes besides its own. No pairs of equal texts are made.
    """
    classes, members = shingle_classes(df, key, text, n, least_words)
    members = written(members, "members")
    pairs = written(similar_classes(classes, threshold), "pairs")
    links = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    groups = connected_components(pairs, "a", "b").select(F.col("node").alias("id"), "component")
    named = written(members.groupBy("id").agg(F.min("key").alias("class_id")).join(groups, "id", "left").join(links, "id", "left"), "named")
    tops = named.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("class_id").alias("top"))
    named = named.join(tops, "component", "left").select("id", "class_id", F.coalesce("top", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(named, "id").select("key", "class_id", "group_id", "n_links")
