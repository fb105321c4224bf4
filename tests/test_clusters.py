"""Clusterings and their comparison against brute force and known values."""

import math
import random
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailloom.operators import compare, grouping, piecewise
from mailloom.operators.components import connected_components
from mailloom.operators.features import FEATURES
from mailloom.operators.sweep import clusterings, sweep
from mailloom.plans.rank import numbered

ATTRS = ["a", "b", "c"]


def table(spark, rows, attrs=ATTRS):
    return spark.createDataFrame([(f"m{i:03}", *r) for i, r in enumerate(rows)], "mail_id string, " + ", ".join(f"{x} string" for x in attrs))


def sets(df):
    out = defaultdict(set)
    for r in df.select("mail_id", "cluster_id").collect():
        out[r.cluster_id].add(r.mail_id)
    return {frozenset(x) for x in out.values()}


def brute_tree(rows, threshold):
    """Leaves of the tree, grown node by node."""
    def entropy(v):
        return -sum(n / len(v) * math.log(n / len(v)) for n in Counter(v).values())

    out = []

    def grow(ids, attrs):
        h = {k: round(entropy([rows[i][k] for i in ids]), 9) for k in attrs}
        best = max(attrs, key=lambda k: (h[k], -k)) if attrs else None
        if best is None or not round(sum(h.values()), 9) < threshold or h[best] <= 0:
            out.append(frozenset(f"m{i:03}" for i in ids))
            return
        parts = defaultdict(list)
        for i in ids:
            parts[rows[i][best]].append(i)
        for p in parts.values():
            grow(p, [k for k in attrs if k != best])

    grow(list(range(len(rows))), list(range(len(rows[0]))))
    return set(out)


def test_entropy_tree(spark):
    r = random.Random(1)
    for threshold in (50.0, 2.2, 1.2, 0.5):
        rows = [(r.choice("xy"), r.choice("xyz"), r.choice("pqrst")) for _ in range(40)]
        df = table(spark, rows)
        assert sets(grouping.entropy_tree(df.unionByName(df), ATTRS, threshold)) == brute_tree(rows, threshold)
    assert grouping.entropy_tree(table(spark, [("x", None, "")]).limit(0), ATTRS).count() == 0
    assert sets(grouping.entropy_tree(table(spark, [("x", None, "l" * 100_000)] * 2), ATTRS)) == {frozenset({"m000", "m001"})}


def test_prefix_tree(spark):
    r = random.Random(2)
    rows = [(r.choice("xy"), r.choice("xyz"), r.choice("pqrs")) for _ in range(40)]
    n = Counter(v for row in rows for v in row)
    want = defaultdict(set)
    for i, row in enumerate(rows):
        order = sorted(range(3), key=lambda k: -n[row[k]])
        want[tuple(row[k] for k in order[:2])].add(f"m{i:03}")
    assert sets(grouping.prefix_tree(table(spark, rows), ATTRS)) == {frozenset(x) for x in want.values()}
    big = {frozenset(x) for x in want.values() if len(x) >= 5}
    assert sets(grouping.prefix_tree(table(spark, rows), ATTRS, 5)) == big
    assert grouping.prefix_tree(table(spark, rows), ["a"]).count() == 0
    assert grouping.prefix_tree(table(spark, [(None, None, None)] * 3), ATTRS).count() == 3


def simulate_observed(n_mails, k, r):
    sizes, out = [], []
    for _ in range(n_mails):
        best, at = k ** (-r), None
        for i, n in enumerate(sizes):
            gain = k ** (1 - r) * ((n + 1) ** 2 / 2 ** r - n ** 2)
            if gain >= best and (at is None or gain > best):
                best, at = gain, i
        if at is None:
            sizes.append(0)
            at = len(sizes) - 1
        sizes[at] += 1
        out.append(at)
    return out


def test_observed_transactions(spark):
    assert grouping.chunk_size(6, 1.0) == 3 and all(grouping.chunk_size(k, r) == 1 for k in (1, 6, 12) for r in (2, 3, 5, 7.5, 10, 15, 20))
    df = table(spark, [("x", "y", "z")] * 7)
    assert sorted(len(x) for x in sets(grouping.transactions_observed(df, 6, 1.0))) == [1, 3, 3]
    for k, r in ((6, 1.0), (12, 1.0), (6, 0.5), (2, 2.0)):
        got = [x.cluster_id for x in grouping.transactions_observed(df, k, r).orderBy("mail_id").collect()]
        assert got == simulate_observed(7, k, r), (k, r)


def test_transactions(spark):
    rows = [("x", "y", "z")] * 4 + [("p", "q", "r")] * 3 + [("x", "y", "w")]
    df = table(spark, rows)
    got = sets(grouping.transactions(df, ATTRS, 1.5))
    assert frozenset({"m004", "m005", "m006"}) in got
    merged = grouping.transactions(df, ATTRS, 1.5)
    one = grouping.all_in_one(df)
    p = lambda c: grouping.profit(c, df, ATTRS, 1.5).first().profit
    assert p(merged) >= p(one)
    assert grouping.transactions(df.limit(0), ATTRS).count() == 0


def naive_transactions(rows, r, passes=5):
    """The published algorithm, every gain worked out from the members."""
    sets = {}
    for i, row in enumerate(rows):
        sets.setdefault(tuple(enumerate(row)), []).append(i)
    order = sorted(sets, key=lambda x: sets[x][0])
    cluster = {}

    def profit(members):
        size = sum(len(s) * len(sets[s]) for s in members)
        return size * sum(len(sets[s]) for s in members) / len({x for s in members for x in s}) ** r if members else 0.0

    for _ in range(passes):
        moved = False
        for s in order:
            old = cluster.pop(s, None)
            groups = defaultdict(list)
            for k, v in cluster.items():
                groups[v].append(k)
            best, at = profit([s]), None
            for k in sorted(groups):
                g = profit([*groups[k], s]) - profit(groups[k])
                if any(set(s) & set(m) for m in groups[k]) and g > best + 1e-9:
                    best, at = g, k
            if at is None:
                at = old if old is not None and old not in groups else max([-1, *cluster.values(), -1 if old is None else old]) + 1
            cluster[s] = at
            moved |= at != old
        if not moved:
            break
    out = defaultdict(set)
    for s, k in cluster.items():
        out[k] |= {f"m{i:03}" for i in sets[s]}
    return {frozenset(x) for x in out.values()}


def test_transactions_naive(spark):
    r = random.Random(8)
    for rep in (1.2, 1.7, 2.5):
        rows = [(r.choice("xy"), r.choice("pqrs"), r.choice("abcdef")) for _ in range(40)]
        f = lambda c, rows=rows, rep=rep: grouping.profit(c, table(spark, rows), ATTRS, rep).first().profit
        got, want = sets(grouping.transactions(table(spark, rows), ATTRS, rep)), naive_transactions(rows, rep)
        assert got == want or abs(f(grouping.transactions(table(spark, rows), ATTRS, rep)) - _profit(rows, want, rep)) < 1e-9


def _profit(rows, clusters, rep):
    total = sum(len(c) * 3 * len(c) / len({(k, rows[int(m[1:])][k]) for m in c for k in range(3)}) ** rep for c in clusters)
    return total / len(rows)


def test_transactions_settle(spark):
    r = random.Random(27)
    rows = [(r.choice("pqrst"), r.choice("uvwxyz"), r.choice("abcdefghij")) for _ in range(120)]
    want = naive_transactions(rows, 1.5, 10**6)
    assert want != naive_transactions(rows, 1.5, 5)
    assert sets(grouping.transactions(table(spark, rows), ATTRS, 1.5)) == want
    with pytest.raises(Exception, match="did not settle in 5 passes"):
        grouping.transactions(table(spark, rows), ATTRS, 1.5, most=5).collect()


def plain_settled(sets, r):
    """As grouping.settled: in every pass, every set is tried with every cluster that shares an item."""
    have, state, where = defaultdict(Counter), [], [-1] * len(sets)

    def put(k, its, length, n):
        for x in its:
            before = k in have[x]
            have[x][k] += n
            if not have[x][k]:
                del have[x][k]
            state[k][1] += (k in have[x]) - before
        state[k][0] += n * length
        state[k][2] += n

    while True:
        moved = False
        for i, (its, length, n) in enumerate(sets):
            old = where[i]
            if old >= 0:
                put(old, its, length, -n)
            gains = {k: (s + n * length) * (m + n) / float(w + len(its) - o) ** r - s * m / float(w) ** r for k, o in Counter(k for x in its for k in have[x]).items() for s, w, m in [state[k]]}
            at = min(gains, key=lambda k: (-gains[k], k), default=-1)
            if at < 0 or not gains[at] > length * n * n / len(its) ** r + 1e-12:
                at = old if old >= 0 and not state[old][2] else len(state)
            if at == len(state):
                state.append([0, 0, 0])
            put(at, its, length, n)
            where[i], moved = at, moved or at != old
        if not moved:
            return where


def mail_like_sets(n, seed):
    """Sets of six items, most with a rare one, in random order."""
    r = random.Random(seed)
    often = Counter(tuple([("t", r.choice("aaaabbbccd")), ("u", int(r.expovariate(0.5))), ("s", r.choice("pppqqr")), ("z", int(r.paretovariate(1.5))), ("e", r.choice([""] * 9 + list("xyz"))), ("h", r.choice(["", r.randrange(n // 2), r.randrange(10 ** 9)]))]) for _ in range(n))
    return [(its, 6, k) for its, k in often.items()]


def test_transactions_settle_as_plainly_but_sooner(spark):
    for r in (1.2, 2.0, 2.6):
        sets = mail_like_sets(700, 3)
        want = plain_settled(sets, r)
        assert grouping.settled(sets, r, 1000) == want
        for few, broad in ((0, 0), (10 ** 9, 0), (2, 3)):  # all clusters at once, wide ones by name, both
            assert grouping.settled(sets, r, 1000, few, broad) == want
    sets = mail_like_sets(4000, 4)
    began = time.process_time()
    want = plain_settled(sets, 2.0)
    plain = time.process_time() - began
    assert grouping.settled(sets, 2.0, 1000) == want
    assert time.process_time() - began - plain < plain / 20


def test_transactions_are_one_block_at_any_size(spark):
    df = spark.range(20_001).select(F.format_string("m%05d", "id").alias("mail_id"), F.lit("x").alias("a"), F.lit("y").alias("b"), F.col("id").cast("string").alias("c"))
    assert len(sets(grouping.transactions(df, ATTRS, 1.0))) == 1


def test_piecewise():
    r = random.Random(4)
    text = "".join(r.choice("abcdefghij \n") for _ in range(4000))
    edited = text[:1500] + "inserted words" + text[1520:]
    other = "".join(r.choice("abcdefghij \n") for _ in range(4000))
    s = [piecewise.signature(x) for x in (text, edited, other)]
    assert piecewise.score(s[0], s[0]) == 100 and 60 < piecewise.score(s[0], s[1]) < 100 and piecewise.score(s[0], s[2]) == 0
    assert piecewise.signature("") == "3::" and piecewise.signature(None) is None
    assert all(piecewise.score(a, b) == piecewise.score(b, a) for a, b in combinations(s, 2))
    assert piecewise.without_runs("aaaaabaaaa") == "aaabaaa"


def test_scores_of_many_pairs():
    """The bit-parallel scores against edit distances worked out cell by cell, and hashes against the byte loop."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (0 if x == y else 2))
        return row[-1]

    r = random.Random(12)
    pairs = [("".join(r.choice("ABCab+/9") for _ in range(r.randint(0, 64))), "".join(r.choice("ABCab+/9") for _ in range(r.randint(0, 64)))) for _ in range(300)]
    (a, na), (b, nb) = piecewise._letters([x for x, _ in pairs]), piecewise._letters([y for _, y in pairs])
    assert (na + nb - 2 * piecewise._common(a, b)).tolist() == [distance(x, y) for x, y in pairs]
    data = bytes(r.randrange(256) for _ in range(500))
    starts = sorted({0, *r.sample(range(500), 12)})
    want, h = [], 0
    for i, c in enumerate(data):
        h = piecewise._START if i in starts else h
        h = ((h * piecewise.PRIME) ^ c) & 63
        want.append(h)
    assert piecewise._hashes(np.frombuffer(data, np.uint8), np.array(starts)).tolist() == want


def test_numbers_follow_the_order_of_names_with_a_common_prefix(spark):
    df = spark.range(3000).select(F.format_string("2024-01-04-%05d.eml", F.pmod(F.col("id") * 7, F.lit(3000))).alias("name"), F.lit(0).alias("g"))
    sliced = numbered(df, ["g"], ["name"], "n", ordered=True)
    assert [r.n for r in sliced.orderBy("name").collect()] == list(range(3000))
    spread_over = df.repartitionByRange(8, "g", "name").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread_over == 8


def test_fixture_of_two_folders(spark):
    """One gold cluster of two members against two single ones: one match, one additional, Jaccard 0.5 on both sides."""
    gold = spark.createDataFrame([("soy", "s0"), ("soy", "s1")], "gold_id string, member string")
    runs = spark.createDataFrame([("r", "soy", "s0"), ("r", "soy1", "s1")], "run_id string, cluster_id string, member string")
    c = compare.diff_counts(gold, runs).first()
    assert (c.tp, c.fp, c.fn, c.tn, c.n) == (1, 1, 1, 0, 2)
    assert sorted(x.jaccard for x in compare.overlap(gold, runs).collect()) == [0.5, 0.5] and compare.metrics(gold, runs).first().ri == 0.0
    assert sorted(x.status for x in compare.match_status(gold, runs).collect()) == ["additional", "matched"]


def brute_piecewise(texts, threshold):
    ids = sorted(texts)
    sig = {i: piecewise.signature(texts[i]) for i in ids}
    cluster = {}
    root = {}
    for i in ids:
        best, at = threshold, None
        for j in ids:
            if i != j and (s := piecewise.score(sig[i], sig[j])) > best:
                best, at = s, j
        cluster[i] = at
    for i in ids:
        root[i] = root[cluster[i]] if cluster[i] is not None and cluster[i] < i else i
    return root


def test_piecewise_clusters(spark):
    r = random.Random(6)
    base = ["".join(r.choice("abcdefghij \n") for _ in range(1500)) for _ in range(4)]
    texts = {}
    for i in range(36):
        t = base[i % 4]
        k = r.randrange(1000)
        texts[f"m{i:03}"] = t if i % 5 == 0 else t[:k] + r.choice(["edit", "x" * 30, ""]) + t[k + r.randrange(40):]
    texts["m900"] = texts["m901"] = ""
    df = spark.createDataFrame([(k, v, None) for k, v in texts.items()], "mail_id string, t string, signature string")
    for threshold in (40, 80):
        got = {x.mail_id: x.cluster_id for x in piecewise.piecewise_clusters(df.unionByName(df), F.col("t"), threshold).collect()}
        assert got == brute_piecewise(texts, threshold)
    assert piecewise.piecewise_clusters(df.limit(0), F.col("t")).count() == 0


def test_short_signatures_meet_when_squeezed(spark):
    signs = ["3:AAAA:AA", "3:AAAAA:AA", "3:AAAAA:AB", "6:AAAAA:AA", "3::", "3:AAAAAAAA:AAAA", "3:AAAAAA:AAAAA"]
    classes = spark.createDataFrame(list(enumerate(signs)), "id bigint, signature string")
    want = {(a, b, s) for a, b in combinations(range(len(signs)), 2) if (s := piecewise.score(signs[a], signs[b]))}
    assert want == {(0, 1, 100), (5, 6, 100)}
    assert {tuple(x) for x in piecewise.scored_classes(classes).collect()} == want


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 1), (5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in parent}
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {x.node: x.component for x in connected_components(df, "a", "b").collect()} == want
    assert connected_components(df.limit(0), "a", "b").count() == 0


GOLD = {"g0": "abcde", "g1": "fgh", "g2": "i"}
RUN = {"c0": "abc", "c1": "de", "c2": "fghi", "c3": "z"}


def long(spark, clusters, run=None):
    rows = [(k, f"/p/{m}") for k, v in clusters.items() for m in v]
    return spark.createDataFrame(rows, "cluster_id string, member string") if run is None else spark.createDataFrame([(run, *x) for x in rows], "run_id string, cluster_id string, member string")


def sides(spark):
    gold = compare.members(long(spark, GOLD)).withColumnRenamed("cluster_id", "gold_id")
    return gold, compare.members(long(spark, RUN, "r"), "run_id").unionByName(compare.members(long(spark, GOLD, "same"), "run_id"))


def test_matching(spark):
    gold, runs = sides(spark)
    got = {(r.run_id, r.gold_id, r.cluster_id, r.status) for r in compare.match_status(gold, runs).collect()}
    assert {x for x in got if x[0] == "r"} == {("r", "g0", "c0", "matched"), ("r", "g1", "c2", "matched"), ("r", "g2", None, "missing"), ("r", None, "c1", "additional"), ("r", None, "c3", "additional")}
    c = {r.run_id: r.asDict() for r in compare.diff_counts(gold, runs).collect()}
    assert (c["r"]["tp"], c["r"]["fp"], c["r"]["fn"], c["r"]["tn"], c["r"]["n"]) == (6, 1 + 2 + 1, 2 + 1, 4 + 5, 9)
    assert (c["same"]["tp"], c["same"]["fp"], c["same"]["fn"]) == (9, 0, 0)


def test_metrics(spark):
    gold, runs = sides(spark)
    m = {r.run_id: r.asDict() for r in compare.metrics(gold, runs).collect()}
    assert all(abs(m["same"][k] - 1) < 1e-6 for k in ("ri", "ari", "nmi", "ami", "accuracy", "precision", "recall", "f1_macro", "f1_micro"))
    g = {x: k for k, v in GOLD.items() for x in v}
    c = {x: k for k, v in RUN.items() for x in v if x in g}
    pairs = list(combinations(sorted(c), 2))
    ri = sum((g[a] == g[b]) == (c[a] == c[b]) for a, b in pairs) / len(pairs)
    assert abs(m["r"]["ri"] - ri) < 1e-6 and abs(m["r"]["accuracy"] - 6 / 9) < 1e-6 and m["r"]["f1_micro"] == m["r"]["accuracy"]
    assert {r.run_id: r.n_unmatched for r in compare.unmatched_members(gold, runs).collect()} == {"r": 1}


def test_expected_information():
    """Against the mean over all relabelings of a small case."""
    from itertools import permutations

    a = [0, 0, 0, 1, 1]
    b = [0, 0, 1, 1, 2]

    def mi(x, y):
        n = len(x)
        cx, cy, cxy = Counter(x), Counter(y), Counter(zip(x, y))
        return sum(v / n * math.log(n * v / (cx[i] * cy[j])) for (i, j), v in cxy.items())

    mean = sum(mi(a, p) for p in permutations(b)) / math.factorial(5)
    assert abs(compare.expected_information([(3, 1), (2, 1)], [(2, 2), (1, 1)], 5) - mean) < 1e-9


def test_sets_and_profile(spark):
    runs = long(spark, {"c0": "ab", "c1": "bc", "c2": "d"}, "r")
    named = compare.members(runs, "run_id")
    assert compare.removed(runs, spark.createDataFrame([("/else/b",), ("d",)], "member string")).count() == 2
    assert {r.member: r.clusters for r in compare.inverted(runs).collect()}["b"] == ["c0", "c1"]
    d = {r.member: r.status for r in compare.pair_difference(runs.filter("cluster_id = 'c0'"), runs.filter("cluster_id = 'c1'")).collect()}
    assert d == {"a": "false_negative", "b": "true_positive", "c": "false_positive"}
    p = compare.profile(named).first()
    assert (p.n_members, p.n_clusters, p.n_duplicates) == (4, 3, 1) and compare.duplicate_members(named).count() == 1
    gold, guess_one, guess_each = [0, 0, 1, 1, 2], [1] * 5, list(range(5))

    def macro(x, y):
        labels = set(x) | set(y)
        f = lambda k: 2 * sum(a == b == k for a, b in zip(x, y)) / (x.count(k) + y.count(k))
        return sum(f(k) for k in labels) / len(labels)

    f = compare.f1_baselines(named).first()
    assert abs(f.f1_macro_all_in_one - macro(gold, guess_one)) < 1e-6 and abs(f.f1_macro_one_for_each - macro(gold, guess_each)) < 1e-6
    assert abs(f.f1_micro_all_in_one - 0.4) < 1e-6 and "4 members" in compare.report(named).first().line
    assert compare.metrics(named.select(F.col("cluster_id").alias("gold_id"), "member").limit(0), named.limit(0)).count() == 0


def test_sweep(spark):
    rows = [("text", "1", "http", "a", "65536", ".x"), ("text", "1", "http", "a", "65536", ".x"), ("html", "2", "", "b", "65536", "")]
    from mailloom.operators.features import CATEGORICAL

    df = table(spark, rows, CATEGORICAL)
    gold = spark.createDataFrame([("g0", "m000"), ("g0", "m001"), ("g1", "m002")], "gold_id string, member string")
    got = {r.run_id: r.ari for r in sweep(df, gold, {"tree": ("cctree", 50.0), "prefix": ("fptree",), "one": ("all_in_one",), "single": ("clope_observed", 5.0)}).collect()}
    assert got == {"tree": 1.0, "prefix": 1.0, "one": 0.0, "single": 0.0}


def test_sweep_scores_pairs_once(spark, monkeypatch):
    r = random.Random(6)
    words = [f"word{k}" for k in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(80)) for _ in range(6)]
    rows = [(f"m{i:03}", *[""] * 11, " ".join(w if r.random() > i / 400 else r.choice(words) for w in r.choice(texts).split())) for i in range(40)] + [("m900", *[""] * 12), ("m901", *[""] * 12)]
    df = spark.createDataFrame(rows, "mail_id string, " + ", ".join(f"{x} string" for x in FEATURES))
    alone = {t: sets(piecewise.piecewise_clusters(df, piecewise.joined_features(FEATURES), t)) for t in (90, 40.5, 0, 100)}
    assert len({frozenset(x) for x in alone.values()}) > 2
    calls = []
    one = piecewise.scored_classes
    monkeypatch.setattr(piecewise, "scored_classes", lambda classes: calls.append(1) or one(classes))
    runs = clusterings(df, {"a": ("ctph", 90), "b": ("ctph", 40.5), "c": ("ctph", 0), "d": ("ctph", 100), "e": ("ctph", 90), "one": ("all_in_one",)})
    for name, t in (("a", 90), ("b", 40.5), ("c", 0), ("d", 100), ("e", 90)):
        assert sets(runs.filter(F.col("run_id") == name).select(F.col("member").alias("mail_id"), "cluster_id")) == alone[t]
    assert len(calls) == 1
