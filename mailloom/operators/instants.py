"""One unambiguous instant for timestamps written in many forms.

Every value is read in all valid ways (an array of interpretations: instant, form, cost). What a form
costs is learnt: records with one interpretation only are certain, and how often each form occurs among
a source's certain records, smoothed by all sources', gives its cost as a negative logarithm. Along each
source's record order Viterbi then chooses one interpretation per record; a change of form within the
source and a jump back in time cost, too.

The order of a source is (order column, id). Rows are range-partitioned by (source, order, id): a source
that holds most rows is spread over many tasks. Costs are whole numbers and adding them up in parts is
exact: each part tells how dear its first and last states are together, the driver joins these few
numbers (a chain has a part per task at most), and each part then decodes with its true start and end.
So the result is that of one pass over the source, for any number of partitions.
"""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.plans.storage import partitions_for, written

# Month names by their beginnings (English, German, French, Spanish, Portuguese, Dutch, Polish).
MONTHS = {
    1: "jan jän janv ene sty янв", 2: "feb fév fev febr lut фев", 3: "mar mär mrz mrt maa мар", 4: "apr avr abr kwi апр",
    5: "may mai mei maj май мая", 6: "jun juin cze июн", 7: "jul juil lip июл", 8: "aug aoû aou ago sie авг",
    9: "sep set wrz сен", 10: "oct okt out paź paz окт", 11: "nov lis ноя", 12: "dec dez déc dic gru дек",
}
# Offsets in minutes of zone abbreviations; several where an abbreviation has several meanings.
ZONES = {
    "UT": [0], "UTC": [0], "GMT": [0], "Z": [0], "WET": [0], "WEST": [60], "BST": [60], "CET": [60], "MEZ": [60], "CEST": [120], "MESZ": [120],
    "EET": [120], "EEST": [180], "MSK": [180], "EST": [-300], "EDT": [-240], "CST": [-360, 480], "CDT": [-300], "MST": [-420], "MDT": [-360],
    "PST": [-480], "PDT": [-420], "IST": [330, 60, 120], "JST": [540], "AEST": [600], "AEDT": [660], "BRT": [-180],
}
START = {name: m for m, names in MONTHS.items() for name in names.split()}
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"
ZONE = r"(?:\s*(?P<off>[+-]\d{2}:?\d{2})|\s*(?P<abbr>[A-Za-z]{1,5}))?(?:\s*\[(?P<iana>[A-Za-z_/+-]+)\])?"
DAY = r"(?:[^\W\d_]+\.?,?\s+)?"
FORMS = [
    ("iso", re.compile(rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})(?:[Tt]|\s+){CLOCK}{ZONE}")),
    ("basic", re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})[Tt]?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?" + ZONE)),
    ("mail", re.compile(rf"{DAY}(?P<d>\d{{1,2}})\.?[\s-]+(?P<mon>[^\W\d_]+)\.?[\s-]+(?P<y>\d{{4}}|\d{{2}}),?\s+{CLOCK}(?:\s*Uhr)?{ZONE}")),
    ("ctime", re.compile(rf"{DAY}(?P<mon>[^\W\d_]+)\.?\s+(?P<d>\d{{1,2}})\s+{CLOCK}(?:\s+(?P<abbr1>[A-Z]{{2,5}}))?\s+(?P<y>\d{{4}}){ZONE}")),
    ("us", re.compile(rf"{DAY}(?P<mon>[^\W\d_]+)\.?\s+(?P<d>\d{{1,2}}),\s*(?P<y>\d{{4}}|\d{{2}}),?\s+{CLOCK}{ZONE}")),
    ("dmy", re.compile(rf"{DAY}(?P<d>\d{{1,2}})(?P<sep>[./-])(?P<m>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}}),?\s+{CLOCK}(?:\s*Uhr)?{ZONE}")),
    ("mdy", re.compile(rf"{DAY}(?P<m>\d{{1,2}})(?P<sep>[./-])(?P<d>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}}),?\s+{CLOCK}{ZONE}")),
    ("ymd", re.compile(rf"(?P<y>\d{{4}})(?P<sep>[./])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}}),?\s+{CLOCK}{ZONE}")),
]
DIGITS = re.compile(r"[+-]?\d{9,19}(?:\.\d+)?")
COMMENT = re.compile(r"\([^()]*\)")
SPACE = re.compile(r"\s+")


@lru_cache(maxsize=512)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _micros(t: datetime) -> int:
    return (t - EPOCH) // timedelta(microseconds=1)


def interpretations(value: str | None, home: str | None) -> list[tuple[int, str, float]]:
    """All valid readings of a value: (microseconds since 1970 UTC, form, cost).

    An explicit offset holds (``-0000`` is UTC); an abbreviation with several meanings gives several
    readings; without either the time is local in ``home``, or UTC. A local time that occurs twice
    means the first, one that is skipped moves forward by the gap. Missing seconds are 0. Weekday
    names are ignored. Nothing valid gives an empty list.
    """
    if not value:
        return []
    text = SPACE.sub(" ", COMMENT.sub(" ", value)).strip()
    if not text:
        return []
    out: list[tuple[int, str, float]] = []
    if DIGITS.fullmatch(text):
        whole = text.split(".")[0].lstrip("+")
        n = len(whole.lstrip("-"))
        if n != 14:
            per = 1_000_000 if n <= 11 else 1000 if n <= 14 else 1 if n <= 17 else 0
            out.append((int(whole) * per if per else int(whole) // 1000, f"epoch{n}", 0.0))
            return out
    for form, pattern in FORMS:
        m = pattern.fullmatch(text)
        if not m:
            continue
        g = m.groupdict()
        try:
            y = int(g["y"])
            y += 2000 if len(g["y"]) == 2 else 0
            month = int(g["m"]) if g.get("m") else START.get(g["mon"].lower()[:4]) or START.get(g["mon"].lower()[:3])
            if not month:
                continue
            h, mi, s = int(g["h"]), int(g["mi"]), int(g.get("s") or 0)
            if g.get("ap"):
                if not 1 <= h <= 12:
                    continue
                h = h % 12 + (12 if g["ap"] in "Pp" else 0)
            local = datetime(y, month, int(g["d"]), h, mi, s, int(((g.get("f") or "") + "000000")[:6]))
        except ValueError:
            continue
        cost = 0.0
        form = form + g["sep"] if g.get("sep") else form
        abbr = g.get("abbr") or g.get("abbr1")
        if g.get("off"):
            o = g["off"].replace(":", "")
            minutes = int(o[1:3]) * 60 + int(o[3:5])
            if int(o[3:5]) > 59 or minutes > 18 * 60:
                continue
            out.append((_micros(local.replace(tzinfo=timezone.utc) - timedelta(minutes=minutes * (-1 if o[0] == "-" else 1))), form, cost))
        elif abbr and abbr.upper() not in ZONES:
            continue
        elif abbr:
            for k, minutes in enumerate(ZONES[abbr.upper()]):
                more = 2.0 * k
                z = _zone(home) if home and len(ZONES[abbr.upper()]) > 1 else None
                if z is not None and k and local.replace(tzinfo=z).utcoffset() == timedelta(minutes=minutes) and local.replace(tzinfo=z).tzname() == abbr.upper():
                    more = -1.0
                out.append((_micros(local.replace(tzinfo=timezone.utc) - timedelta(minutes=minutes)), form, cost + more))
        else:
            z = _zone(g["iana"]) if g.get("iana") else _zone(home) if home else None
            out.append((_micros(local.replace(tzinfo=z or timezone.utc)), form, cost))
    return sorted(set(out), key=lambda x: (x[2], x[0]))


#: Costs of a change of form and of a jump back in time, and the jump from which on it counts, in microseconds.
SWITCH, BACK, BACK_AFTER = 0.5, 1.0, 36 * 3600 * 1_000_000
#: Costs are counted in units of a millionth; below them the place of a reading and a hash of its record part equal paths.
UNIT, RANK, JITTER = 1 << 60, 1 << 40, (1 << 24) - 1
#: How many records of all sources a source's own are added to, and what the rarest form counts as.
PULL, FLOOR = 5.0, 1e-4

State = tuple[int, str, int]  # instant, form, cost


def states_of(key: int, readings: list[tuple[int, str, float]], form_cost) -> list[State]:
    """A record's readings with their costs as whole numbers that no two paths share but by a chance of 2^-24."""
    out = []
    for i, (t, form, cost) in enumerate(readings):
        c = round((cost + form_cost(form)) * 1e6)
        out.append((t, form, c * UNIT + i * RANK + (xxhash.xxh64_intdigest(f"{key} {i}") & JITTER)))
    return out


def step_cost(a: State, b: State) -> int:
    return round((SWITCH * (a[1] != b[1]) + BACK * (a[0] - b[0] > BACK_AFTER)) * 1e6) * UNIT


def forward(states: list[list[State]], start: list[int]) -> tuple[list[int], list[list[int]]]:
    """Costs of the last record's states, and the links back; ``start``: the first record's costs."""
    costs, links = start, []
    for prev, cur in zip(states, states[1:]):
        best = [min(range(len(prev)), key=lambda i, s=s: (costs[i] + step_cost(prev[i], s), i)) for s in cur]
        costs = [costs[i] + step_cost(prev[i], s) + s[2] for i, s in zip(best, cur)]
        links.append(best)
    return costs, links


def decoded(states: list[list[State]], start: list[int], last: int | None = None) -> list[int]:
    """The cheapest choice of a state per record, given the first record's costs and, if known, the last choice."""
    costs, links = forward(states, start)
    k = min(range(len(costs)), key=lambda i: (costs[i], i)) if last is None else last
    picks = [k]
    for row in reversed(links):
        k = row[k]
        picks.append(k)
    return picks[::-1]


def viterbi(states: list[list[State]]) -> list[int]:
    """The cheapest choice over a whole order."""
    return decoded(states, [s[2] for s in states[0]]) if states else []


def joined_parts(parts: list[dict]) -> list[tuple[list[int], int]]:
    """(costs of the first record's states, choice for the last record) of each part of a chain, in order.

    A part: ``first`` and ``last``, the states of its end records; ``matrix[e][x]``, the cost of the cheapest way
    from state e of the first record (its own cost left out) to state x of the last.
    """
    starts, ends = [], []
    for k, p in enumerate(parts):
        own = [s[2] for s in p["first"]]
        if k:
            before = parts[k - 1]["last"]
            own = [min(ends[-1][i] + step_cost(b, s) for i, b in enumerate(before)) + s[2] for s in p["first"]]
        starts.append(own)
        ends.append([min(own[e] + row[x] for e, row in enumerate(p["matrix"])) for x in range(len(p["last"]))])
    choices = [0] * len(parts)
    k = min(range(len(ends[-1])), key=lambda i: (ends[-1][i], i))
    for j in range(len(parts) - 1, -1, -1):
        choices[j] = k
        if j:
            p = parts[j]
            e = min(range(len(p["first"])), key=lambda i: (starts[j][i] + p["matrix"][i][k], i))
            k = min(range(len(ends[j - 1])), key=lambda i: (ends[j - 1][i] + step_cost(parts[j - 1]["last"][i], p["first"][e]), i))
    return list(zip(starts, choices))


READINGS = "array<struct<t:bigint,form:string,cost:double>>"
OPEN = "part int, source string, place bigint, key bigint, readings array<struct<t:bigint,form:string,cost:double>>, costs map<string,double>"


def normalised_instants(df: DataFrame, key: str, value: str, home: str, source: str, order: str, partitions: int | None = None) -> DataFrame:
    """(key, utc_micros, form, n_readings) for every distinct row whose value names a valid instant.

    Null, empty, incomplete and impossible values give no row; repeated identical rows count once. A
    null source is a source of its own. Ties of the order are broken by key. Further columns of df are
    ignored. The result is the same for any number of ``partitions``.
    """
    spark = df.sparkSession
    slim = df.select(F.col(key).cast("bigint").alias("key"), F.col(value).cast("string").alias("value"), F.col(home).cast("string").alias("home"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(order).alias("at")).filter(F.length(F.trim("value")) > 0)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["key", "source", "at"]].copy()
            out["readings"] = [[{"t": t, "form": f, "cost": c} for t, f, c in interpretations(v, h)] for v, h in zip(b.value, b.home)]
            yield out

    kind = slim.schema["at"].dataType.simpleString()
    n = partitions or partitions_for(slim)
    rows = written(slim.distinct().mapInPandas(read, f"key bigint, source string, at {kind}, readings {READINGS}").filter(F.size("readings") > 0), "readings")
    certain = rows.filter(F.size("readings") == 1)
    done = certain.select("key", F.col("readings")[0].t.alias("utc_micros"), F.col("readings")[0].form.alias("form"), F.lit(1).alias("n_readings"))
    if rows.filter(F.size("readings") > 1).isEmpty():
        return done.withColumnRenamed("key", key)

    # costs of forms: per source where it has certain records
    counts = written(certain.groupBy("source", F.col("readings")[0].form.alias("form")).agg(F.count("*").alias("n")), "forms")
    everywhere = {r["form"]: r["n"] for r in counts.groupBy("form").agg(F.sum("n").alias("n")).collect()}  # a row a form: a fixed list
    total = sum(everywhere.values())
    share = {f: c / total for f, c in everywhere.items()}
    general = lambda f: share.get(f, 0.0)
    per = counts.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("form", F.col("n").cast("double")))).alias("costs"))
    # an ambiguous record carries its source's counts; a source may hold most of them, so both sides are salted
    salts = 16
    salted = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("source", "_source")
    unsure = rows.filter(F.size("readings") > 1).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    unsure = unsure.join(salted, (F.col("source") == F.col("_source")) & (unsure.salt == salted.salt), "left").select("key", "source", "at", "readings", "costs")
    placed = unsure.unionByName(certain.withColumn("costs", F.lit(None).cast("map<string,double>"))).repartitionByRange(n, "source", "at", "key").sortWithinPartitions("source", "at", "key")
    placed = placed.select(F.spark_partition_id().alias("part"), "source", F.monotonically_increasing_id().alias("place"), "key", "readings", "costs")

    def states(r) -> list[State]:
        costs = dict(r[2]) if r[2] is not None else {}
        mass = sum(costs.values()) + PULL

        def form_cost(f: str) -> float:
            return -math.log((costs.get(f, 0.0) + PULL * max(FLOOR, general(f))) / mass)

        # a certain record's own cost is the same on every path
        return states_of(r[0], [(x["t"], x["form"], x["cost"]) for x in r[1]], form_cost if len(r[1]) > 1 else lambda f: 0.0)

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Ambiguous records, the certain ones beside them, and the first and last record of a partition, where chains may go on."""
        held = None  # the record before, and whether it was given out
        for b in batches:
            out = []
            for r in zip(b.part, b.source, b.place, b.key, b.readings, b.costs):
                given = held is None
                if held is not None:
                    same = held[0][1] == r[1]
                    if not held[1] and (len(held[0][4]) > 1 or same and len(r[4]) > 1):
                        out.append(held[0])
                    given = same and len(held[0][4]) > 1 and len(r[4]) == 1
                if given:
                    out.append(r)
                held = (r, given)
            yield pd.DataFrame(out, columns=["part", "source", "place", "key", "readings", "costs"])
        if held is not None and not held[1]:
            yield pd.DataFrame([held[0]], columns=["part", "source", "place", "key", "readings", "costs"])

    kept = written(placed.mapInPandas(needed, OPEN), "chains")

    def chain(g: pd.DataFrame) -> list[list[State]]:
        g.sort_values("place", inplace=True, ignore_index=True)
        return [states(r) for r in zip(g.key, g.readings, g.costs)]

    def summary(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        s = chain(g)
        matrix = [forward(s, [0 if i == e else 1 << 200 for i in range(len(s[0]))])[0] for e in range(len(s[0]))]
        text = repr({"first": s[0], "last": s[-1], "matrix": matrix})
        return pd.DataFrame([(int(k[0]), k[1], text)], columns=["part", "source", "summary"])

    # only sources that span partitions need their parts joined: two a partition at most
    wide = kept.groupBy("source").agg(F.count_distinct("part").alias("n")).filter("n > 1").select("source")
    ends = kept.join(wide, "source", "left_semi").groupBy("part", "source").applyInPandas(summary, "part int, source string, summary string").collect()
    spans: dict[str, list[tuple[int, dict]]] = {}
    for r in ends:
        spans.setdefault(r["source"], []).append((r["part"], ast.literal_eval(r["summary"])))
    known = {}
    for name, parts in spans.items():
        parts.sort(key=lambda x: x[0])
        for (part, _), found in zip(parts, joined_parts([p for _, p in parts])):
            known[part, name] = found
    shared = spark.sparkContext.broadcast(known)  # two a partition at most

    def settle(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        s = chain(g)
        start, last = shared.value.get((int(k[0]), k[1]), ([x[2] for x in s[0]], None))
        picks = decoded(s, start, last)
        out = [(key, st[i][0], st[i][1], len(st)) for key, st, i in zip(g.key, s, picks) if len(st) > 1]
        return pd.DataFrame(out, columns=["key", "utc_micros", "form", "n_readings"])

    chosen = kept.groupBy("part", "source").applyInPandas(settle, "key bigint, utc_micros bigint, form string, n_readings int")
    return done.unionByName(chosen).withColumnRenamed("key", key)


def sender_domain(c):
    """The domain of a From header, in lower case."""
    return F.lower(F.regexp_extract(c, r"@([A-Za-z0-9.-]+)", 1))
