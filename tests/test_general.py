"""Copies, deliveries and instants against small cases and brute force."""

import random
from datetime import datetime, timezone
from itertools import product

from pyspark.sql import functions as F

from mailloom.operators.addresses import address_set, message_key
from mailloom.operators.copies import copy_differences, uuid_form
from mailloom.operators.instants import BACK, BACK_AFTER, SWITCH, UNIT, forward, interpretations, joined_parts, decoded, normalised_instants, states_of, viterbi
from mailloom.streaming.dedup import SeenStore, delivery_stream, surplus_rows

T = "2024-01-%02d 00:00:00"


def micros(*a):
    return int((datetime(*a, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1e6)


def test_copy_differences(spark):
    schema = "run_id string, member_name string, cluster_id string, score double, diffs string"
    left = [("a", "m1", "c", 1.0, "x"), ("a", "m1", "c", 1.0, "x"), ("a", "m2", None, None, None), ("a", "m3", "c", float("nan"), ""), (None, None, "c", 1.0, ""), ("a", "m5", "c", 2.0, "")]
    right = [("a", "m1", "c", 1.0 + 5e-7, "y"), ("a", "m2", "c", None, None), ("a", "m3", "c", float("nan"), ""), (None, None, "d", 1.1, ""), ("a", "m6", "c", 2.0, "")]
    got = copy_differences(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["run_id", "member_name"], {"cluster_id": None, "score": 1e-6}).collect()
    found = {(r.run_id, r.member_name): (r.side, tuple(d.field for d in r.diffs)) for r in got}
    assert found == {("a", "m2"): ("both", ("cluster_id",)), (None, None): ("both", ("cluster_id", "score")), ("a", "m5"): ("only_left", ()), ("a", "m6"): ("only_right", ())}
    none = spark.createDataFrame([], schema)
    assert copy_differences(none, none, ["run_id", "member_name"], {"cluster_id": None}).count() == 0
    assert copy_differences(spark.createDataFrame(left, schema), none, ["run_id", "member_name"], {"cluster_id": None}).count() == 5


def test_uuid_forms(spark):
    u = "f44280fc-7974-4934-ae51-b77f73835283"
    rows = [(u,), (u.upper(),), ("{" + u + "}",), ("urn:uuid:" + u,), (u.replace("-", ""),), (" " + u + " ",)]
    assert spark.createDataFrame(rows, "c string").select(uuid_form(F.col("c"))).distinct().count() == 1


def test_addresses(spark):
    cases = {
        '"Von, A" <A@X.test>, b@y.test': ["a@x.test", "b@y.test"], 'B <b@y.test>,\r\n "c@z.test" <a@x.test>': ["a@x.test", "b@y.test"],
        "undisclosed-recipients:;": [], "": [], None: [], "a@x.test, A@X.TEST": ["a@x.test"], "a@x.test (a comment, b@c.test)": ["a@x.test"], "list: a@x.test;": ["a@x.test"],
    }
    got = spark.createDataFrame([(k, v) for k, v in cases.items()], "c string, want array<string>").select("want", address_set(F.col("c")).alias("got")).collect()
    assert all(list(r.want) == list(r.got) for r in got), got
    ids = spark.createDataFrame([("<a@b>",), (" a@b ",), ("\r\n <a@b>",), ("A@b",), ("",), (None,), ("<>",)], "c string").select(message_key(F.col("c")).alias("k")).collect()
    assert [r.k for r in ids] == ["a@b", "a@b", "a@b", "A@b", None, None, None]


def brute_surplus(rows):
    best = {}
    for key, i, at in rows:
        if key is not None:
            best[key] = min(best.get(key, ((at is None, at or "", i))), (at is None, at or "", i))
    return {i for key, i, at in rows if key is not None and best[key] != (at is None, at or "", i)}


def test_store_in_any_order(spark, tmp_path):
    """Batches in any order, with expiry, late rows, ties, nulls, a hot key and a batch that runs twice."""
    r = random.Random(3)
    rows = [(r.choice(["a", "b", "c", None, "hot", "hot", "hot"]) if i % 3 else f"k{i % 20}", i, r.choice([None, T % r.randint(1, 28)])) for i in range(240)]
    r.shuffle(rows)
    store = SeenStore(spark, f"file://{tmp_path}/seen", "3 days")
    for n in range(4):
        df = spark.createDataFrame(rows[n * 60:(n + 1) * 60], "key string, id bigint, at string").withColumn("at", F.col("at").cast("timestamp"))
        store.fold(df, n)
        if n == 2:
            store.fold(df, n)  # a batch again after a failure
    got = [x.id for x in store.surplus().collect()]
    assert len(got) == len(set(got)) and set(got) == brute_surplus(rows)


def test_store_log_and_crash(spark, tmp_path, monkeypatch):
    """Logs are compacted, buckets that a batch leaves alone aren't read, and a crash between state and commit changes nothing."""
    store = SeenStore(spark, f"file://{tmp_path}/seen", "2 days", buckets=4)
    rows = [(f"k{i % 30}", i, T % (1 + i // 20)) for i in range(300)]
    made = lambda part: spark.createDataFrame(part, "key string, id bigint, at string").withColumn("at", F.col("at").cast("timestamp"))
    for n in range(6):
        part = made(rows[n * 50:(n + 1) * 50])
        if n == 3:
            with monkeypatch.context() as m:
                m.setattr(SeenStore, "_put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
                try:
                    store.fold(part, n)
                except OSError:
                    pass
        store.fold(part, n)
    got = [x.id for x in store.surplus().collect()]
    assert len(got) == len(set(got)) and set(got) == brute_surplus(rows)
    last = store.manifest(5)
    assert set(last["live"]) == {"0", "1", "2", "3"} and all(len(v) <= 3 for v in last["live"].values())
    read = []
    monkeypatch.setattr(SeenStore, "_read", lambda self, lists, f=SeenStore._read: read.extend(p for one in lists for p, _ in one) or f(self, lists))
    monkeypatch.setattr(SeenStore, "_compact", lambda *a: None)
    store.fold(made([("k0", 900, T % 20)]), 6)
    assert len({p.rsplit("=", 1)[1] for p in read}) == 1
    assert set(x.id for x in store.surplus().collect()) == brute_surplus([*rows, ("k0", 900, T % 20)])


def test_delivery_stream(spark, tmp_path):
    schema = "delivery_id bigint, received_at string, hdr_message_id string, hdr_to string, key string"
    rows = [(1, T % 2, "<m@x>", "A <a@x.test>", "k"), (2, T % 1, "m@x", "a@X.test", "k"), (3, T % 1, " <m@x>", "a@x.test", None), (4, T % 1, None, "a@x.test", ""), (5, T % 1, None, "a@x.test", ""), (6, T % 1, "<M@x>", "a@x.test", ""), (3, T % 1, " <m@x>", "a@x.test", None)]
    df = spark.createDataFrame(rows, schema).withColumn("received_at", F.col("received_at").cast("timestamp"))
    df.repartition(3).write.parquet(f"{tmp_path}/messages.parquet")
    got = surplus_rows(delivery_stream(spark, f"{tmp_path}/messages.parquet", 3), f"file://{tmp_path}/root")
    assert sorted(r.id for r in got.collect()) == [1, 3]
    # the stream goes on where it ended
    df.limit(0).union(spark.createDataFrame([(9, T % 9, "m@x", "a@x.test", "")], schema).withColumn("received_at", F.col("received_at").cast("timestamp"))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/messages.parquet")
    again = surplus_rows(delivery_stream(spark, f"{tmp_path}/messages.parquet", 3), f"file://{tmp_path}/root")
    assert sorted(r.id for r in again.collect()) == [1, 3, 9]


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], "delivery_id bigint, received_at timestamp, hdr_message_id string, hdr_to string").write.parquet(f"{tmp_path}/m.parquet")
    assert surplus_rows(delivery_stream(spark, f"{tmp_path}/m.parquet"), f"file://{tmp_path}/r").count() == 0


def first(value, zone=None):
    r = interpretations(value, zone)
    return r[0][0] if r else None


def test_readings():
    noon = micros(2024, 1, 7, 12, 0, 5)
    for v in ("Sun, 07 Jan 2024 13:00:05 +0100", "Mon, 7 Jan 24 13:00:05 +0100 (CET)", "2024-01-07T12:00:05Z", "2024-01-07T13:00:05+01:00[Europe/Berlin]", "20240107T120005", "Jan 7, 2024 12:00:05 PM",
              "Sun Jan  7 12:00:05 2024", "Sun Jan  7 13:00:05 2024 +0100", "1704628805", "1704628805000", "So, 07 Jan 2024 12:00:05", "07 Jan 2024 07:00:05 EST", "07 Jan 2024 12:00:05 -0000", "Sun,\r\n 07 Jan 2024\r\n 12:00:05 UT"):
        assert first(v) == noon, v
    assert first("Samstag, 18. Mai 2024 07:52 Uhr", "Europe/Berlin") == micros(2024, 5, 18, 5, 52)
    assert first("Mi, 25 Dez 2024 08:00:00", "Europe/Warsaw") == micros(2024, 12, 25, 7)
    assert first("2024-03-31 02:30:00", "Europe/Berlin") == micros(2024, 3, 31, 1, 30)  # skipped: 03:30 summer time
    assert first("2024-10-27 02:30:00", "Europe/Berlin") == micros(2024, 10, 27, 0, 30)  # twice: the first
    for v in (None, "", "  ", "unknown", "Tue, 12 Mar", "31 Feb 2025 10:00:00 +0000", "0000-00-00 00:00:00", "2024-01-01 25:00:00", "%DATE%", "x" * 100_000, "(" * 5000, "1" * 400):
        assert first(v) is None, v
    assert [x[1] for x in interpretations("07.01.2024 11:24", None)] == ["dmy.", "mdy."]


def random_order(r, n):
    rows = [[(r.randint(0, 5) * BACK_AFTER, r.choice("ab"), r.choice([0.0, 1.0, 0.25])) for _ in range(r.choice([1, 2, 3]))] for _ in range(n)]
    return [states_of(i, x, lambda f: 0.0) for i, x in enumerate(rows)]


def test_viterbi_is_optimal():
    r = random.Random(5)
    for _ in range(60):
        rows = random_order(r, r.randint(1, 6))

        def cost(p, rows=rows):
            seq = [row[k] for row, k in zip(rows, p)]
            return sum(x[2] / UNIT / 1e6 for x in seq) + sum(SWITCH * (a[1] != b[1]) + BACK * (a[0] - b[0] > BACK_AFTER) for a, b in zip(seq, seq[1:]))

        best = min(cost(p) for p in product(*[range(len(x)) for x in rows]))
        assert abs(cost(viterbi(rows)) - best) < 1e-4


def test_parts_decode_as_the_whole():
    """An order cut anywhere, also through runs of ambiguous records, gives what one pass gives."""
    r = random.Random(6)
    for _ in range(80):
        rows = random_order(r, r.randint(2, 14))
        cuts = sorted(r.sample(range(1, len(rows)), r.randint(1, min(4, len(rows) - 1))))
        pieces = [rows[a:z] for a, z in zip([0, *cuts], [*cuts, len(rows)])]
        parts = [{"first": p[0], "last": p[-1], "matrix": [forward(p, [0 if i == e else 1 << 200 for i in range(len(p[0]))])[0] for e in range(len(p[0]))]} for p in pieces]
        got = [k for p, (start, last) in zip(pieces, joined_parts(parts)) for k in decoded(p, start, last)]
        assert got == viterbi(rows)


def dated(spark, rows):
    return spark.createDataFrame(rows, "id bigint, value string, home string, source string, at bigint")


def test_forms_and_order_decide(spark):
    """The same ambiguous text is read as its source writes dates; without certain records the order of instants decides."""
    rows = [(i, f"12/{13 + i}/2024 10:00:00", None, "us", i) for i in range(10)] + [(20 + i, f"{13 + i}/12/2024 10:00:00", None, "uk", i) for i in range(10)]
    rows += [(50, "04/05/2024 10:00:00", None, "us", 20), (51, "04/05/2024 10:00:00", None, "uk", 20)]
    # between two certain days, in forms of other kinds: only one reading goes forward in time
    rows += [(60, "2024-02-01T10:00:00Z", None, "x", 1), (61, "03.02.2024 10:00", None, "x", 2), (62, "2024-02-05T10:00:00Z", None, "x", 3)]
    rows += [(70, "2024-02-27T10:00:00Z", None, "y", 1), (71, "01.03.2024 10:00", None, "y", 2), (72, "2024-03-02T10:00:00Z", None, "y", 3)]
    rows += [(73, "2024-01-02T10:00:00Z", None, "z", 1), (74, "01.03.2024 10:00", None, "z", 2), (75, "2024-01-04T10:00:00Z", None, "z", 3)]
    got = {r.id: r.utc_micros for r in normalised_instants(dated(spark, rows), "id", "value", "home", "source", "at").collect()}
    assert got[50] == micros(2024, 4, 5, 10) and got[51] == micros(2024, 5, 4, 10)
    assert got[61] == micros(2024, 2, 3, 10) and got[71] == micros(2024, 3, 1, 10)
    assert got[74] == micros(2024, 1, 3, 10)  # the other reading would make the next record jump back


def test_instants_for_any_partitioning(spark):
    r = random.Random(9)
    rows = []
    for i in range(400):
        d, m = r.randint(1, 28), r.randint(1, 12)
        rows.append((i, r.choice([f"{d:02}.{m:02}.2024 10:00", f"{m:02}/{d:02}/2024 10:00:00", f"{r.randint(1, 12):02}.{m:02}.2024 10:00", f"2024-{m:02}-{d:02}T10:00:00Z", "07 Jan 2024 12:00:00 IST"]), r.choice([None, "Europe/Berlin"]), r.choice(["hot", "hot", "hot", "a", None]), r.randint(0, 90)))
    rows += [(1000 + i, f"{1 + i % 12:02}.{1 + i % 7:02}.2024 10:00", None, "all ambiguous", i) for i in range(60)]
    df = dated(spark, rows)
    one = {tuple(x) for x in normalised_instants(df, "id", "value", "home", "source", "at", 1).collect()}
    assert any(x[3] > 1 for x in one)
    for n in (3, 40):
        assert {tuple(x) for x in normalised_instants(df, "id", "value", "home", "source", "at", n).collect()} == one


def test_instants(spark):
    schema = "id bigint, value string, home string, source string, at bigint, utc_micros string, key string"
    rows = [(1, "07.01.2024 11:24", None, "s", 1, "", ""), (1, "07.01.2024 11:24", None, "s", 1, "", ""), (2, None, None, None, None, "", ""), (3, "1704628805", "Nowhere/Else", None, None, "", ""), (4, "2024-01-07 10:00:00", "Asia/Tokyo", "s", 2, "", ""), (5, "a" * 50_000, None, "s", 3, "", "")]
    got = {r.id: (r.utc_micros, r.n_readings) for r in normalised_instants(spark.createDataFrame(rows, schema), "id", "value", "home", "source", "at").collect()}
    assert got == {1: (micros(2024, 1, 7, 11, 24), 2), 3: (micros(2024, 1, 7, 12, 0, 5), 1), 4: (micros(2024, 1, 7, 1), 1)}
    assert normalised_instants(spark.createDataFrame([], schema), "id", "value", "home", "source", "at").count() == 0
