"""Text decoded with the wrong charset: which records are affected, and what they said.

A chain names how a text was spoilt: bytes of one charset read as another, once or twice. Undoing a
chain on a word is evidence for it if the result is likelier than the word under a character model
of the collection. Evidence per record can be weak, so expectation-maximization estimates how often
each chain occurs per source and field (smoothed towards the whole collection), and each record is
repaired by the posterior of its chains. U+FFFD and C1 controls prove damage that no chain undoes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.plans.storage import spread, written

SLOPPY = {i: bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(256)}
BACK = {c: i for i, c in SLOPPY.items()}

# Chains as (charset it was read as, charset it was written in); read from the last step back.
CHAINS: list[tuple[tuple[str, str], ...]] = [
    *[((wrong, "utf-8"),) for wrong in ("sloppy", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-2", "cp1254")],
    *[((a, "utf-8"), (b, "utf-8")) for a, b in (("sloppy", "sloppy"), ("latin-1", "latin-1"), ("sloppy", "latin-1"), ("latin-1", "sloppy"), ("cp1251", "cp1251"), ("mac_roman", "mac_roman"))],
    *[((a, b),) for a, b in (
        ("sloppy", "cp1251"), ("sloppy", "koi8-r"), ("sloppy", "cp1250"), ("latin-1", "iso8859-2"), ("sloppy", "mac_roman"), ("sloppy", "cp850"), ("sloppy", "cp437"), ("sloppy", "cp866"),
        ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "sloppy"), ("cp1250", "sloppy"), ("iso8859-2", "latin-1"),
        ("iso8859-2", "cp1250"), ("cp1250", "iso8859-2"), ("mac_roman", "sloppy"), ("mac_roman", "cp1251"), ("cp850", "sloppy"), ("cp437", "sloppy"), ("iso8859-5", "cp1251"), ("cp1251", "iso8859-5"), ("koi8-r", "sloppy"))],
]
LOST = re.compile("[�\x80-\x9f]")
TOKENS = re.compile(r"[^ \t\r\n]+")
RUNS = re.compile(r"[^\x00-\x7f]+")


def _bytes(s: str, charset: str) -> bytes | None:
    try:
        return bytes(BACK[c] for c in s) if charset == "sloppy" else s.encode(charset)
    except (KeyError, UnicodeEncodeError):
        return None


def _text(b: bytes, charset: str) -> str | None:
    if charset == "sloppy":
        return "".join(SLOPPY[x] for x in b)
    try:
        return b.decode(charset)
    except UnicodeDecodeError:
        return None


def undone(word: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The word before the chain spoilt it; only its runs of non-ASCII characters change. None if it can't be."""
    for wrong, right in chain:
        out, at, changed = [], 0, False
        for m in RUNS.finditer(word):
            b = _bytes(m.group(), wrong)
            t = _text(b, right) if b is not None else None
            if t is None or t == m.group():
                continue
            out += [word[at:m.start()], t]
            at, changed = m.end(), True
        if not changed:
            return None
        word = "".join(out) + word[at:]
    return None if LOST.search(word) else word


def folded(c: str) -> str:
    """Characters of rare blocks stand for their block, so the model stays small."""
    o = ord(c)
    return c if o < 0x530 or 0x2000 <= o < 0x2600 or o == 0xfffd else chr(o & ~0xff)


class CharacterModel:
    """Smoothed bigrams of characters within words, from counts over all texts."""

    def __init__(self, counts: dict[str, int]):
        first: Counter = Counter()
        for pair, n in counts.items():
            first[pair[0]] += n
        v = max(2, len({c for p in counts for c in p}))
        k = 0.02
        self.seen = {p: math.log((n + k) / (first[p[0]] + k * v)) for p, n in counts.items()}
        self.rare = {c: math.log(k / (n + k * v)) for c, n in first.items()}
        self.new = math.log(1 / (v * 50))

    def score(self, word: str) -> float:
        w = " " + "".join(map(folded, word)) + " "
        return sum(self.seen.get(w[i:i + 2]) or self.rare.get(w[i], self.new) for i in range(len(w) - 1))


def character_counts(texts: DataFrame, column: str) -> dict[str, int]:
    """Bigram counts of all texts; the result is bounded by the square of the alphabet."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for t in b[column]:
                s = " " + " ".join(t.split()) + " "
                if not s.isascii():
                    s = "".join(map(folded, s))
                c.update(map("".join, zip(s, s[1:])))
        if c:
            yield pd.DataFrame({"pair": list(c), "n": list(c.values())})

    rows = texts.select(column).mapInPandas(count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return {r["pair"]: r["n"] for r in rows}


#: What a repair must gain; and what each run of characters adds that happens to be valid UTF-8, which few bytes are by chance.
MARGIN, VALID_RUN = 2.5, 3.0
#: Rounds end when the chains' shares of the collection move by less than this altogether.
SETTLED, ROUNDS = 1e-3, 50


class Evidence:
    """Gains of words under each chain; kept by word, as words repeat."""

    def __init__(self, model: CharacterModel):
        self.model, self.known = model, {}

    def gains(self, word: str) -> tuple[tuple[int, float], ...]:
        got = self.known.get(word)
        if got is None:
            base, out, tried = None, [], {}
            for i, chain in enumerate(CHAINS):
                t = undone(word, chain)
                if t is None:
                    continue
                if t not in tried:
                    base = self.model.score(word) if base is None else base
                    tried[t] = self.model.score(t) - base - MARGIN
                gain = tried[t] + (VALID_RUN * min(3, len(RUNS.findall(word))) if chain[-1][1] == "utf-8" else 0)
                if tried[t] > -MARGIN and gain > 0:
                    out.append((i, gain))
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[word] = tuple(out)
        return got

    def scores(self, text: str) -> list[float] | None:
        """The gain of each chain over the text, or None if no word speaks for any."""
        total = [0.0] * len(CHAINS)
        some = False
        for m in TOKENS.finditer(text):
            w = m.group()
            if w.isascii():
                continue
            if w[-1] == "\u00c3" and m.end() < len(text):
                w += "\u00a0"  # the model weighs it with the space as it was
            for i, g in self.gains(w):
                total[i] += g
                some = True
        return total if some else None


def repaired(text: str, weights: dict[int, float], evidence: Evidence) -> str:
    """Each word as the likeliest of its chains has it, weighing gain and posterior; other words stay."""
    def one(m: re.Match) -> str:
        w = m.group()
        if w.isascii():
            return w
        if w[-1] == "\u00c3" and m.end() < len(m.string):
            w += "\u00a0"
        best = max(((g + math.log(max(weights.get(i, 0.0), 1e-9)), i) for i, g in evidence.gains(w) if weights.get(i, 0.0) > 1e-4), default=None)
        return undone(w, CHAINS[best[1]]) or w if best else w

    return TOKENS.sub(one, TOKENS.sub(one, text))  # twice: words may be spoilt more often than the rest


def garbled_fields(fields: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(key, field_name, chain, posterior, lost, repaired) of affected fields; fields: key, source, field_name, text.

    chain is the likeliest one, null if only lost characters prove the damage; lost is how many there are.
    Null and empty texts are never affected. A null source is a source of its own. Repeated identical
    rows count once. Whole texts are read. Rounds of expectation and maximization go on until the chains' shares
    settle; more than ``rounds`` of them are an error.
    """
    spark = fields.sparkSession
    rows = written(spread(fields.select(F.col("key").cast("string").alias("key"), F.coalesce("source", F.lit("")).alias("source"), "field_name", "text").filter(F.length("text") > 0)).dropDuplicates(), "texts")
    model = spark.sparkContext.broadcast(CharacterModel(character_counts(rows, "text")))  # bounded by the alphabet

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evidence = Evidence(model.value)
        for b in batches:
            out = []
            for k, s, f, t in zip(b.key, b.source, b.field_name, b.text):
                if t.isascii():
                    continue
                scores, lost = evidence.scores(t), len(LOST.findall(t))
                if scores or lost:
                    out.append((k, s, f, t, scores or [0.0] * len(CHAINS), lost))
            yield pd.DataFrame(out, columns=["key", "source", "field_name", "text", "scores", "lost"])

    marked = written(rows.mapInPandas(score, "key string, source string, field_name string, text string, scores array<double>, lost int"), "evidence")
    sizes = written(rows.groupBy("source", "field_name").agg(F.count("*").alias("size")), "sizes")
    n_all = max(1, sizes.agg(F.sum("size")).first()[0] or 0)
    k = len(CHAINS)
    prior = F.array(*[F.lit(0.002)] * k)  # of each chain; the rest is clean
    shared = [0.002] * k
    local = None
    # records of one source and field with the same scores are one, counted
    patterns = written(marked.groupBy("source", "field_name", "scores").agg(F.count("*").alias("n")), "patterns")
    for _ in range(rounds):
        with_prior = patterns.withColumn("prior", prior) if local is None else patterns.join(local, ["source", "field_name"], "left").withColumn("prior", F.coalesce("prior", F.array(*[F.lit(x) for x in shared])))
        posterior = _posterior(with_prior)
        sums = written(posterior.select("source", "field_name", "n", F.posexplode("posterior").alias("c", "p")).filter("p > 1e-12").groupBy("source", "field_name", "c").agg(F.sum(F.col("p") * F.col("n")).alias("p")), "em")
        totals = {r["c"]: r["p"] for r in sums.groupBy("c").agg(F.sum("p").alias("p")).collect()}  # a row a chain
        before, shared = shared, [max(1e-6, totals.get(c, 0.0) / n_all) for c in range(k)]
        pull = 20.0  # records of the whole collection that a source's own are added to
        lists = sums.groupBy("source", "field_name").agg(F.map_from_entries(F.collect_list(F.struct("c", "p"))).alias("m")).join(sizes, ["source", "field_name"])
        local = lists.select("source", "field_name", F.array(*[(F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0.0)) + F.lit(pull * shared[c])) / (F.col("size") + F.lit(pull)) for c in range(k)]).alias("prior"))  # read from this round's written sums
        if sum(abs(x - y) for x, y in zip(before, shared)) <= SETTLED:  # and no source moves far without them
            break
    else:
        raise RuntimeError(f"shares of chains did not settle in {rounds} rounds")
    last = _posterior(marked.join(local, ["source", "field_name"], "left").withColumn("prior", F.coalesce("prior", F.array(*[F.lit(x) for x in shared]))))
    found = last.filter((F.col("clean") < 0.5) | (F.col("lost") > 0)).select("key", "field_name", "text", "posterior", "clean", "lost")

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evidence = Evidence(model.value)
        for b in batches:
            out = []
            for key, f, t, p, clean, lost in zip(b.key, b.field_name, b.text, b.posterior, b.clean, b.lost):
                best = max(range(k), key=lambda i: (p[i], -i))
                chain = " > ".join(f"{r} read as {w}" for w, r in reversed(CHAINS[best])) if clean < 0.5 else None
                out.append((key, f, chain, float(p[best]) if chain else None, lost, repaired(t, dict(enumerate(p)), evidence) if chain else t))
            yield pd.DataFrame(out, columns=["key", "field_name", "chain", "posterior", "lost", "repaired"])

    return found.mapInPandas(repair, "key string, field_name string, chain string, posterior double, lost int, repaired string")


def _posterior(df: DataFrame) -> DataFrame:
    """Adds clean and posterior: of no chain, and of each, from their priors and the scores."""
    clean = F.greatest(F.lit(1e-6), F.lit(1.0) - F.aggregate("prior", F.lit(0.0), lambda s, x: s + x))
    logs = F.zip_with("prior", "scores", lambda p, s: F.when(s > 0, F.log(F.greatest(p, F.lit(1e-9))) + F.least(s, F.lit(200.0))))
    top = F.greatest(F.log(clean), F.coalesce(F.array_max("logs"), F.lit(-1e9)))
    df = df.withColumn("logs", logs).withColumn("top", top)
    df = df.withColumn("own", F.exp(F.log(clean) - F.col("top"))).withColumn("parts", F.transform("logs", lambda x: F.coalesce(F.exp(x - F.col("top")), F.lit(0.0))))
    df = df.withColumn("mass", F.col("own") + F.aggregate("parts", F.lit(0.0), lambda s, x: s + x))
    return df.withColumn("clean", F.col("own") / F.col("mass")).withColumn("posterior", F.transform("parts", lambda x: x / F.col("mass"))).drop("logs", "top", "own", "parts", "mass")
