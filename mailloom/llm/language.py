"""Languages of documents and of their segments, by a byte convolutional network.

Filters of several widths slide over fixed-length windows of UTF-8 bytes; their maxima feed a softmax.
The network is trained in numpy on a bounded sample of labelled documents (``sample`` rows, by hash
order). Every label is a class at first. As some labels are wrong, two networks are fitted on a half each
and judge the other half: a document whose label its judge doubts is left out of the last fit, and with it
a label that has no document left. So a language is learnt from few documents if they tell it, and a
wrong label isn't, however often it occurs. The network is applied to every sentence of every document in
batches; long sentences give several windows, whose log-probabilities are averaged; sentences met before in a
task are looked up.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.plans.storage import spread

WINDOW = 96
WIDTHS = (2, 3, 4)
FILTERS = 64
SAMPLE = 4000
PER_DOCUMENT = 8
#: A label is doubted if its judge, who never saw the document, gives it less than this on average.
DOUBT = 0.5
#: Sentences a task remembers before it forgets all.
MEMORY = 200_000

# Customary forms of language labels besides two-letter codes (ISO 639-2/3 and names).
LABELS = {
    "en": "eng english englisch anglais inglés ingles", "de": "deu ger german deutsch allemand", "fr": "fra fre french français francais französisch",
    "es": "spa spanish español espanol spanisch castilian", "pt": "por portuguese português portugues portugiesisch", "nl": "nld dut dutch nederlands niederländisch flemish",
    "pl": "pol polish polski polnisch", "ru": "rus russian русский russisch", "it": "ita italian italiano italienisch", "da": "dan danish dansk", "uk": "ukr ukrainian",
    "sk": "slk slo slovak", "cs": "ces cze czech", "af": "afr afrikaans", "bg": "bul bulgarian", "gl": "glg galician", "sv": "swe swedish", "no": "nor norwegian", "ca": "cat catalan",
}
# Labels that say nothing.
NOTHING = "und mul mis zxx unknown unk none null n/a na xx ? ?? ??? -"
FORMS = {form: code for code, forms in LABELS.items() for form in forms.split()}
SILENT = set(NOTHING.split()) | {""}

LINK = re.compile(r"\b(?:https?|ftp|mailto):\S+|\bwww\.\S+|(?<!\S)[^\s@]{1,200}@\S+", re.I)
CODED = re.compile(r"(?<!\S)\S*\d\S*")
MARKS = re.compile(r"[^\w’' -]+|_+")
SPACES = re.compile(r"\s+")
BREAK = re.compile(r"(?<=[.!?…])[”\"'»)]*\s+|\r?\n\s*")
LETTERS = re.compile(r"[^\W\d_]+")


def label_code(label: str | None) -> str | None:
    """The two-letter code a label names, or None if it says nothing."""
    s = (label or "").strip().lower()
    if s in SILENT:
        return None
    s = FORMS.get(s, s)
    head = re.split(r"[-_.@ ]", s)[0]
    head = FORMS.get(head, head)
    return None if head in SILENT else head


def cleaned(sentence: str) -> str:
    """A sentence in lower case without links, addresses, codes and marks."""
    return SPACES.sub(" ", MARKS.sub(" ", CODED.sub(" ", LINK.sub(" ", sentence)))).strip().lower()


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences and lines of a text; together they hold all of it but white space."""
    out, start = [], 0
    for m in BREAK.finditer(text):
        if text[start:m.start()].strip():
            out.append((start, m.start()))
        start = m.end()
    if text[start:].strip():
        out.append((start, len(text)))
    return out


def windows(clean: str) -> list[bytes]:
    """Fixed-length windows over the bytes; the last one ends with the text."""
    b = f" {clean} ".encode()
    if len(b) <= WINDOW:
        return [b.ljust(WINDOW, b"\0")]
    return [b[i:i + WINDOW] for i in range(0, len(b) - WINDOW, WINDOW)] + [b[-WINDOW:]]


class ByteNet:
    """Byte embeddings folded into the filters: a filter of width w is a table (w, 256)."""

    def __init__(self, classes: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.conv = [rng.normal(0, 0.5 / w, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        for t in self.conv:
            t[:, 0] = 0
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.05, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.shift = np.zeros(len(classes), np.float32)

    def features(self, x: np.ndarray, where: bool = False):
        pools, places = [], []
        for t, b in zip(self.conv, self.bias):
            w = len(t)
            z = t[0][x[:, :x.shape[1] - w + 1]]
            for k in range(1, w):
                z += t[k][x[:, k:x.shape[1] - w + 1 + k]]
            if where:
                at = z.argmax(1)
                places.append(at)
                top = np.take_along_axis(z, at[:, None], 1)[:, 0]
            else:
                top = z.max(1)
            pools.append(np.maximum(top + b, 0))
        return np.concatenate(pools, 1), places

    def log_probabilities(self, x: np.ndarray, batch: int = 128) -> np.ndarray:
        out = []
        for i in range(0, len(x), batch):
            s = self.features(x[i:i + batch])[0] @ self.out + self.shift
            s -= s.max(1, keepdims=True)
            out.append(s - np.log(np.exp(s).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.classes)), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, rate: float, seed: int, batch: int = 128) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.conv, *self.bias, self.out, self.shift]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        n = len(WIDTHS)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i:i + batch]
                xb, yb, wb = x[rows], y[rows], weight[rows]
                h, places = self.features(xb, True)
                s = h @ self.out + self.shift
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), yb] -= 1
                d = (p * wb[:, None] / len(rows)).astype(np.float32)
                grads_out, grads_shift = h.T @ d, d.sum(0)
                dh = (d @ self.out.T) * (h > 0)
                grads_conv, grads_bias = [], []
                for j, (t, at) in enumerate(zip(self.conv, places)):
                    g = dh[:, j * FILTERS:(j + 1) * FILTERS]
                    gt = np.zeros_like(t)
                    f = np.broadcast_to(np.arange(FILTERS), at.shape)
                    for k in range(len(t)):
                        seen = np.take_along_axis(xb, at + k, 1).astype(np.int64)
                        gt[k] = np.bincount((seen * FILTERS + f).ravel(), g.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                    gt[:, 0] = 0
                    grads_conv.append(gt)
                    grads_bias.append(g.sum(0))
                step += 1
                for q, (par, g) in enumerate(zip(params, [*grads_conv, *grads_bias, grads_out, grads_shift])):
                    m[q] += 0.1 * (g - m[q])
                    v[q] += 0.01 * (g * g - v[q])
                    par -= (rate * (m[q] / (1 - 0.9 ** step)) / (np.sqrt(v[q] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
        assert n == len(self.conv)


def bare(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def _arrays(wins: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(wins), np.uint8).reshape(-1, WINDOW)


class Sample(NamedTuple):
    """A labelled document's sentences, cleaned; at most PER_DOCUMENT of them, each of at most LONGEST letters."""

    name: int
    label: str
    parts: list[str]


LONGEST = 4 * WINDOW


def sampled(name: int, text: str, label: str) -> Sample:
    spans = sentences(text)
    order = np.random.default_rng(name & 0xffffffff).permutation(len(spans))[:PER_DOCUMENT]
    parts = [c for k in order if len(LETTERS.findall(c := cleaned(text[slice(*spans[k])]))) >= 3]
    return Sample(name, label, [c[:LONGEST] for c in parts])


def _windows_of(docs: list[Sample], classes: list[str], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, class of each, document of each); some sentences also without accents or in part."""
    rng = np.random.default_rng(seed)
    wins: list[bytes] = []
    ys, owner = [], []
    for d, doc in enumerate(docs):
        for c in doc.parts:
            mine: list[bytes] = []
            for form in [c] + ([bare(c)] if rng.random() < 0.25 else []):
                mine += windows(form)
                if rng.random() < 0.3:  # a part of a sentence
                    words = form.split()
                    a = int(rng.integers(0, max(1, len(words) - 3)))
                    mine.append(windows(" ".join(words[a:a + 4]))[0])
            wins += mine
            ys += [classes.index(doc.label)] * len(mine)
            owner += [d] * len(mine)
    return _arrays(wins) if wins else np.zeros((0, WINDOW), np.uint8), np.array(ys, np.int64), np.array(owner, np.int64)


def _net(classes: list[str], x: np.ndarray, y: np.ndarray, steps: int, seed: int, even: bool) -> ByteNet:
    """``even``: rare classes weigh more than their share."""
    weight = np.ones(len(y))
    if even:
        share = np.bincount(y, minlength=len(classes)) / len(y)
        weight = (1 / np.sqrt(np.maximum(share, 1e-3)))[y]
        weight /= weight.mean()
    net = ByteNet(classes, seed)
    net.train(x, y, weight, max(2, min(40, steps // max(1, len(x)))), 0.004, seed)
    return net


def fit(docs: list[Sample], seed: int = 5, doubt: float = DOUBT) -> ByteNet | None:
    """A network for labelled documents; None without any. Labels that the judges doubt are left out."""
    docs = sorted((d for d in docs if d.parts), key=lambda d: d.name)
    if not docs:
        return None
    classes = sorted({d.label for d in docs})
    x, y, owner = _windows_of(docs, classes, seed)
    half = np.array([int(hashlib.md5(str(d.name).encode()).hexdigest(), 16) % 2 for d in docs])
    trust = np.ones(len(docs), bool)
    if len(classes) > 1 and 0 < half.sum() < len(docs):
        for k in (0, 1):
            own, other = half[owner] != k, half[owner] == k
            judge = _net(classes, x[own], y[own], 40_000, seed + k, even=False)
            p = np.exp(judge.log_probabilities(x[other])[np.arange(int(other.sum())), y[other]])
            n = np.bincount(owner[other], minlength=len(docs))
            mean = np.bincount(owner[other], p, minlength=len(docs)) / np.maximum(n, 1)
            trust &= (n == 0) | (mean >= doubt)
    good = [d for d, t in zip(docs, trust) if t] or docs
    classes = sorted({d.label for d in good})
    x, y, _ = _windows_of(good, classes, seed + 2)
    return _net(classes, x, y, 60_000, seed + 3, even=True)


_FITTED: dict[tuple, ByteNet | None] = {}


def trained(documents: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> ByteNet | None:
    """Fits the network on about ``sample`` labelled documents: a bounded sample, those whose hash of the key is below a bound.

    Executors choose the sentences, so the driver gets at most sample x PER_DOCUMENT of them, of bounded length. Within
    an application, queries over the same documents share the fitted network.
    """
    spark = documents.sparkSession
    slim = documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.col(label).alias("label"))
    mark = (spark.sparkContext.applicationId, slim.semanticHash(), tuple(sorted(slim.inputFiles())), sample)
    if mark in _FITTED:
        return _FITTED[mark]
    known = slim.filter(F.length(F.trim("text")) > 40).filter(~F.lower(F.trim(F.coalesce(F.col("label"), F.lit("")))).isin(*sorted(SILENT)))
    h = F.xxhash64(F.lit("sample"), F.col("key"))
    total = known.count()
    if total > sample:
        known = known.filter(h < F.lit(int(sample / total * 2 ** 64) - 2 ** 63))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [sampled(n, t, code) for n, t, lab in zip(b.h, b.text, b.label) if (code := label_code(lab))]
            yield pd.DataFrame([(r.name, r.label, r.parts) for r in rows if r.parts], columns=["name", "label", "parts"])

    rows = known.select(h.alias("h"), "text", "label").mapInPandas(choose, "name bigint, label string, parts array<string>").limit(sample + sample // 4).collect()
    net = fit([Sample(r["name"], r["label"], list(r["parts"])) for r in rows])
    if len(_FITTED) >= 8:
        _FITTED.clear()
    _FITTED[mark] = net
    return net


def classify(net: ByteNet, texts: list[str], known: dict[str, tuple[str, float]] | None = None) -> list[list[tuple[int, int, str, float, int]]]:
    """For each text its sentences: (start, end, language, confidence, words); sentences without letters are ``und``.

    ``known`` remembers cleaned sentences; it is filled here.
    """
    known = {} if known is None else known
    if len(known) > MEMORY:
        known.clear()
    spans = [sentences(t) for t in texts]
    clean = [[cleaned(t[a:b]) for a, b in sp] for t, sp in zip(texts, spans)]
    n_words = {c: len(LETTERS.findall(c)) for cs in clean for c in cs}
    new = [c for c, n in n_words.items() if n and c not in known]
    wins: list[bytes] = []
    owner: list[int] = []
    for i, c in enumerate(new):
        ww = windows(c)
        wins += ww
        owner += [i] * len(ww)
    if wins:
        scores = np.zeros((len(new), len(net.classes)))
        np.add.at(scores, owner, net.log_probabilities(_arrays(wins)))
        scores /= np.bincount(owner, minlength=len(new))[:, None]
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for c, k, top in zip(new, p.argmax(1), p.max(1)):
            known[c] = net.classes[int(k)], float(top)
    return [[(a, b, *(known[c] if n_words[c] else ("und", 1.0)), n_words[c]) for (a, b), c in zip(sp, cs)] for sp, cs in zip(spans, clean)]


LEAST_WORDS, LEAST_CONFIDENCE = 4, 0.8


def resolved(found: list[tuple[int, int, str, float, int]], coded: bool = False) -> tuple[str, float, list[tuple[int, int, str, float, bool]]]:
    """(language, confidence, segments (start, end, language, confidence, whole)) of a document.

    Short or doubtful sentences take the language of the sentence before them, or the next. ``whole``:
    the segment holds a whole sentence that is sure by itself. ``coded``: the text holds links or codes; with
    one or two words besides it is ``und``.
    """
    if not any(w for *_, w in found):
        return "und", 1.0, [(a, b, "und", 1.0, False) for a, b, *_ in found]
    sure = [w >= LEAST_WORDS and p >= LEAST_CONFIDENCE for _, _, _, p, w in found]
    if not any(sure):
        votes: dict[str, float] = {}
        for _, _, lang, p, w in found:
            if w:
                votes[lang] = votes.get(lang, 0) + p * w
        if coded and sum(w for *_, w in found) < 3:
            return "und", 1.0, [(found[0][0], found[-1][1], "und", 1.0, False)]
        best = max(sorted(votes), key=lambda k: votes[k])
        conf = votes[best] / sum(w for *_, w in found)
        return best, conf, [(found[0][0], found[-1][1], best, conf, False)]
    langs: list[str | None] = [f[2] if s else None for f, s in zip(found, sure)]
    for i, x in enumerate(langs):
        if x is None and i:
            langs[i] = langs[i - 1]
    for i in range(len(langs) - 2, -1, -1):
        if langs[i] is None:
            langs[i] = langs[i + 1]
    segments: list[list] = []
    weight: dict[str, float] = {}
    for (a, b, lang, p, w), mine, s in zip(found, langs, sure):
        own = p if lang == mine else 1 - p
        weight[mine] = weight.get(mine, 0) + (b - a)
        if segments and segments[-1][2] == mine:
            segments[-1][1] = b
            segments[-1][3].append((own, w))
            segments[-1][4] |= s
        else:
            segments.append([a, b, mine, [(own, w)], s])
    done = [(a, b, lang, sum(p * w for p, w in ps) / max(1, sum(w for _, w in ps)), s) for a, b, lang, ps, s in segments]
    best = max(sorted(weight), key=lambda k: weight[k])
    mine = [(p, b - a) for a, b, lang, p, _ in done if lang == best]
    return best, sum(p * n for p, n in mine) / sum(n for _, n in mine), done


SCHEMA = "key bigint, label string, doc_lang string, doc_confidence double, segment int, seg_start int, seg_end int, seg_lang string, seg_confidence double, whole boolean"


def segments(documents: DataFrame, key: str, text: str, label: str, net: ByteNet | None = None, batch: int = 64, once: bool = True) -> DataFrame:
    """One row per segment of every document with text: the label's code (null if it says nothing), the language of
    the document and of the segment, each with a confidence.

    Null, empty and blank texts give no row; a text of links and codes only is ``und``. Repeated
    identical rows count once, unless ``once`` is off, which saves the shuffle of all texts where the caller does so. Offsets count characters of the text.
    """
    net = net or trained(documents, key, text, label)
    spark = documents.sparkSession
    if net is None:
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(net)  # bounded: tables of fixed size per language
    rows = spread(documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.col(label).alias("label")).filter(F.col("text").rlike(r"\S")))
    rows = rows.dropDuplicates() if once else rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        known: dict[str, tuple[str, float]] = {}
        for big in batches:
            for i in range(0, len(big), batch):
                b = big.iloc[i:i + batch]
                out = []
                for k, lab, t, found in zip(b.key, b.label, b.text, classify(model, list(b.text), known)):
                    lang, conf, segs = resolved(found, bool(LINK.search(t) or re.search(r"\d", t)))
                    code = label_code(lab)
                    out += [(k, code, lang, conf, n, s, e, sl, sc, w) for n, (s, e, sl, sc, w) in enumerate(segs)]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInPandas(run, SCHEMA)


def label_findings(segs: DataFrame) -> DataFrame:
    """(key, found_lang): documents whose label is missing or wrong, or which mix languages; a row per language."""
    per = segs.groupBy("key").agg(F.min("label").alias("label"), F.min_by("doc_lang", F.struct("label", "doc_lang")).alias("main"), F.collect_set(F.when(F.col("whole"), F.col("seg_lang"))).alias("langs"))
    per = per.withColumn("langs", F.when(F.size("langs") == 0, F.array("main")).otherwise(F.col("langs")))
    case = F.col("label").isNull() | ~F.array_contains("langs", F.col("label")) | (F.size("langs") > 1)
    return per.filter(F.coalesce(case, F.lit(True))).select("key", F.explode("langs").alias("found_lang"))
