"""Language posteriors from character n-grams, and an end-of-text model.

The language model is a classifier: it is fitted on a bounded sample of labelled rows
(``sample_rows`` rows of at most ``sample_chars`` characters), those with the smallest hash
of their key, so the choice does not depend on row order. The end-of-text model counts all
texts, where they lie; only counts move. Both have a bounded size and travel with the
function that scores. Scoring reads whole texts.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.session import cut_lineage

BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
_NOISE = re.compile(
    r"```.*?(?:```|\Z)|^>.*$|\S*[@/\\_=(){}\[\]]\S*|\b\w*\d\w*\b|\b[A-Z]{2,}\b|\b[A-Za-z]*[a-z][A-Z]\w*\b|https?://\S+",
    re.S | re.M,
)
_NOT_WORD = re.compile(r"[^\w']+|_+")


def clean_prose(text: str) -> str:
    """Lower-case words of a text without code, paths, names of classes, keys and quotes."""
    return " " + _NOT_WORD.sub(" ", _NOISE.sub(" ", text)).strip().lower() + " "


def strip_marks(text: str) -> str:
    folded = unicodedata.normalize("NFD", text.replace("ł", "l").replace("ß", "ss"))
    return "".join(c for c in folded if not unicodedata.combining(c))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, and to which text each belongs (texts are blank-framed)."""
    joined = "".join(texts)
    cps = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), size)
    out, own = [], []
    h = np.zeros(len(cps), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        # h[i] covers cps[i : i + n]
        h = h[: len(cps) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + cps[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            inside = owner[: len(h)] == owner[n - 1 :]
            mixed = (h[inside] ^ (h[inside] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((mixed >> np.uint64(64 - 17)).astype(np.int64))
            own.append(owner[: len(h)][inside])
    return np.concatenate(out), np.concatenate(own)


@dataclass
class LanguageModel:
    """Naive Bayes over hashed character n-grams with a uniform prior."""

    labels: list[str]
    weights: np.ndarray  # [BUCKETS, labels] log likelihoods

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], smooth: float = 0.3) -> LanguageModel:
        names = sorted(set(labels))
        counts = np.zeros((BUCKETS, len(names)))
        for k, name in enumerate(names):
            own = [clean_prose(t) for t, x in zip(texts, labels, strict=True) if x == name]
            own += [strip_marks(t) for t in own if strip_marks(t) != t]
            if own:
                counts[:, k] = np.bincount(_grams(own)[0], minlength=BUCKETS)
        logs = np.log((counts + smooth) / (counts.sum(0) + smooth * BUCKETS))
        return cls(names, (logs - logs.mean(1, keepdims=True)).astype(np.float32))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log likelihood of each cleaned text per label, up to a constant per text."""
        if not texts:
            return np.zeros((0, len(self.labels)))
        g, own = _grams(texts)
        out = np.zeros((len(texts), len(self.labels)))
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(own, weights=self.weights[g, k], minlength=len(texts))
        return out

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Most likely label of each cleaned text and its lead over the next, in nats."""
        s = self.scores(texts)
        if s.shape[1] < 2:
            return np.zeros(len(texts), dtype=int), np.zeros(len(texts))
        order = np.argsort(s, axis=1)
        lead = np.take_along_axis(s, order[:, -1:], 1) - np.take_along_axis(s, order[:, -2:-1], 1)
        return order[:, -1], lead[:, 0]


def bounded_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``rows`` rows with the smallest hash of ``keys``: at most that many, whatever the table.

    A threshold on the hash, set from the row count, lets about twice as many rows through
    before the final cut, so what reaches the driver does not grow with the table.
    """
    h = F.xxhash64(*keys)
    n = df.count()
    if n > 2 * rows:
        df = df.where(h < int(-(2**63) + min(1.0, (2 * rows + 1000) / n) * 2**64))
    return df.orderBy(h, *keys).limit(rows)


def fit_language_model(labelled: DataFrame, key: str, text: str, label: str, sample_rows: int = 6000, sample_chars: int = 20_000) -> LanguageModel:
    """Fits on a bounded sample of labelled rows; unlabelled and ``und`` rows and texts of more
    than ``sample_chars`` characters are left out of the sample."""
    name = F.lower(F.trim(label))
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), name.alias("l")).where("l is not null and l not in ('', 'und')")
    rows = rows.where(F.char_length("t").between(1, sample_chars))
    got = bounded_sample(rows, ["k"], sample_rows).collect()
    return LanguageModel.fit([r.t for r in got], [r.l for r in got])


ORDER = 8
#: An end is kept in the model if at least this share of all texts ends so (at least one text):
#: no more than ``ORDER / LEAST_SHARE`` ends can be, whatever the corpus.
LEAST_SHARE = 1e-6
_START = "\x02"


@functools.cache
def _classes() -> np.ndarray:
    """Letters 1, decimal digits 2, other signs of words 3, blanks 4, line feeds and signs 0."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for cp in (*range(0xD800), *range(0xE000, 0x20000)):
        c = chr(cp)
        out[cp] = (1 if c.isalpha() else 2 if c.isdecimal() else 3) if c.isalnum() else 4 if c.isspace() and c != "\n" else 0
    out[0x20000:0x32000] = 1
    return out


def shapes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shapes of texts without trailing blanks, one after the other, and where each begins.

    A start sign, then ``w`` for a word of letters, ``0`` for a number, ``x`` for a mixed word,
    one blank for a run of them, and other signs as they are.
    """
    framed = [_START + t.rstrip() for t in texts]
    cps = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begins = np.cumsum([0, *map(len, framed)])[:-1]
    kind = _classes()[cps]
    word = (kind >= 1) & (kind <= 3)
    run = np.where(word, 1, np.where(kind == 4, 2, 0))
    new = np.ones(len(cps), dtype=bool)
    new[1:] = (run[1:] != run[:-1]) | (run[1:] == 0)
    new[begins] = True
    at = np.flatnonzero(new)
    if not len(at):
        return np.zeros(0, np.uint64), begins
    low, high = np.minimum.reduceat(kind, at), np.maximum.reduceat(kind, at)
    words = np.where((low == 1) & (high == 1), ord("w"), np.where((low == 2) & (high == 2), ord("0"), ord("x")))
    symbol = np.where(run[at] == 1, words, np.where(run[at] == 2, 32, cps[at]))
    return symbol.astype(np.uint64), np.searchsorted(at, begins)


def _windows(symbols: np.ndarray, begins: np.ndarray):
    """For each order: hashes of the windows that end at each symbol, and which lie inside a text."""
    if not len(symbols):
        return
    back = np.arange(len(symbols)) - np.repeat(begins, np.diff([*begins, len(symbols)]))
    h = np.zeros(len(symbols), dtype=np.uint64)
    for n in range(1, ORDER + 1):
        h = np.r_[np.uint64(0), h[:-1]] * np.uint64(0x9E3779B97F4A7C15) + symbols * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
        yield n, (h ^ (h >> np.uint64(29))).view(np.int64), back >= n - 1


#: Characters of a tail that hold the last ``ORDER`` symbols of nearly all texts.
_TAIL = 160


def _ends(texts: list[str]) -> list[np.ndarray]:
    """Per order the hash of each text's last window; 0 where the text is shorter.

    Read from the tail, and from the whole text where the tail is less than ``ORDER`` symbols.
    """
    tails = [t[-_TAIL:] if len(t) > _TAIL else t for t in (t.rstrip() for t in texts)]
    symbols, begins = shapes(tails)
    size = np.diff([*begins, len(symbols)])
    short = [i for i, t in enumerate(texts) if size[i] <= ORDER + 1 and len(t.rstrip()) > _TAIL]
    if short:
        for i in short:
            tails[i] = texts[i]
        symbols, begins = shapes(tails)
        size = np.diff([*begins, len(symbols)])
    last = begins + size - 1
    return [np.where(inside[last], code[last], 0) for _, code, inside in _windows(symbols, begins)]


@dataclass
class EndingModel:
    """How likely a text ends after its last shapes: back-off n-grams over ``shapes``.

    Per order the sorted hashes of ends, how often each window occurs, and how often at an end.
    """

    orders: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    weight: float = 2.0

    @classmethod
    def fit(cls, texts: list[str]) -> EndingModel:
        ends = [np.unique(c[c != 0], return_counts=True) for c in _ends(texts)] if texts else []
        totals = _totals(texts, [c for c, _ in ends])
        return cls([(c, t, n) for (c, n), t in zip(ends, totals, strict=True)])

    def probability(self, text: str) -> float:
        return float(self.probabilities([text])[0])

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Probability of an end where each text ends."""
        p, live = np.full(len(texts), 0.01), np.ones(len(texts), dtype=bool)
        for mine, (codes, total, ends) in zip(_ends(texts) if texts else [], self.orders, strict=False):
            if not len(codes):
                break
            i = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
            live &= (codes[i] == mine) & (mine != 0) & (total[i] > 1)
            p = np.where(live, (ends[i] + self.weight * p) / (total[i] + self.weight), p)
        return p


def _totals(texts: list[str], codes: list[np.ndarray]) -> list[np.ndarray]:
    """How often the windows ``codes`` (sorted, per order) occur anywhere in the texts."""
    out = [np.zeros(len(c), dtype=np.int64) for c in codes]
    for n, code, inside in _windows(*shapes(texts)):
        if n <= len(codes) and len(codes[n - 1]):
            own = code[inside]
            i = np.minimum(np.searchsorted(codes[n - 1], own), len(codes[n - 1]) - 1)
            out[n - 1] += np.bincount(i[codes[n - 1][i] == own], minlength=len(codes[n - 1]))
    return out


def fit_ending_model(df: DataFrame, text: str) -> EndingModel:
    """Counts all texts of a table: every text shows its own end.

    First the ends (tails only), then how often these windows occur anywhere. Both passes
    send counts, summed where the texts lie.
    """
    rows = df.select(F.col(text).alias("t")).where("length(trim(t)) > 0")

    def count_ends(frames):
        for f in frames:
            for n, c in enumerate(_ends(f["t"].tolist()), 1):
                code, k = np.unique(c[c != 0], return_counts=True)
                yield pd.DataFrame({"n": n, "code": code, "k": k})

    ends = rows.mapInPandas(count_ends, "n int, code long, k long").groupBy("n", "code").agg(F.sum("k").alias("k"))
    ends = cut_lineage(ends)
    least = max(1.0, LEAST_SHARE * (ends.where("n = 1").agg(F.sum("k")).first()[0] or 0))
    kept = ends.where(F.col("k") >= least).toPandas().sort_values(["n", "code"])
    table = [kept[kept["n"] == n] for n in range(1, ORDER + 1)]
    codes = [t["code"].to_numpy(np.int64) for t in table]

    def count_all(frames):
        sums = [np.zeros(len(c), dtype=np.int64) for c in codes]
        for f in frames:
            sums = [a + b for a, b in zip(sums, _totals(f["t"].tolist(), codes), strict=True)]
        for n, (c, k) in enumerate(zip(codes, sums, strict=True), 1):
            yield pd.DataFrame({"n": n, "code": c[k > 0], "k": k[k > 0]})

    totals = rows.mapInPandas(count_all, "n int, code long, k long").groupBy("n", "code").agg(F.sum("k").alias("total")).toPandas()
    merged = kept.merge(totals, on=["n", "code"], how="left").fillna({"total": 0}).sort_values(["n", "code"])
    return EndingModel([(g["code"].to_numpy(np.int64), g["total"].to_numpy(np.int64), g["k"].to_numpy(np.int64)) for n in range(1, ORDER + 1) for g in [merged[merged["n"] == n]]])
