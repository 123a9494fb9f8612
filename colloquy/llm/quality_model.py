"""Quality classifier: overlapping heuristic labellers, a weak-label model of their accuracies, and a linear scorer.

1. Each labeller votes good, bad or nothing on a document. Documents are counted by vote pattern, a grouped
   aggregation with at most 3 ** len(LABELLERS) rows, however large the corpus.
2. Expectation-maximisation over those counts estimates how each labeller votes on good and on bad documents, and so
   the posterior of each pattern. No labels are needed.
3. The posteriors are the targets of a logistic scorer over hashed features (words, word shapes, repeats). It is fitted
   on at most SAMPLE documents, those with the least hash, and then scores every document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh

#: Documents that the scorer is fitted on, at most, and bytes of their texts, at most: those with the least hash.
SAMPLE, SAMPLE_BYTES = 6000, 64_000_000
BUCKETS = 2**18
#: Words whose features a worker remembers (about 60 MB).
KEEP_WORDS = 300_000
GOOD, NONE, BAD = 1, 0, -1

# Function words of the languages that the corpus declares.
STOPWORDS = frozenset(
    "the of and to in a is that for it was on with be as by der die und den von zu das mit sich des auf für ist im dem de la le et les en un du une que est pour qui dans par el y los del se las por para con no".split()
)
SYMBOL_BYTES = b"#*$%&|<>"
UPPER_BYTES = bytes(range(ord("A"), ord("Z") + 1))
LETTER_BYTES = UPPER_BYTES + UPPER_BYTES.lower() + bytes(range(128, 256))
SHAPE = [(re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[0-9]+"), "0")]
ENDS = (".", "!", "?", ":")


@dataclass(frozen=True)
class Facts:
    """What the labellers see of a text."""

    n_words: int
    kinds: int
    top: int
    mean_length: float
    stop: float
    symbols: float
    upper: float
    ends: float
    doubled: float
    repeated_lines: float
    stutter: float

    @classmethod
    def of(cls, text: str, freq: Counter, words: list[str]) -> Facts:
        raw = text.encode("utf-8", "replace")
        n = len(words)
        letters = len(raw) - len(raw.translate(None, LETTER_BYTES))
        upper = len(raw) - len(raw.translate(None, UPPER_BYTES))
        symbols = len(raw) - len(raw.translate(None, SYMBOL_BYTES))
        lines = [x for x in text.split("\n") if x.strip()]
        chars = sum(map(len, words))
        return cls(
            n, len(freq), max(freq.values(), default=0), chars / max(n, 1), sum(freq[w] for w in STOPWORDS if w in freq) / max(n, 1), symbols / max(chars, 1), upper / max(letters, 1),
            (text.count(".") + text.count("?") + text.count(":")) / max(n, 1), (text.count("!!") + text.count("??")) / max(n, 1), 1 - len(set(lines)) / max(len(lines), 1), sum(map(eq, words, words[1:])) / max(n, 1),
        )


def _between(x: float, good: bool, bad: bool) -> int:
    return GOOD if good else BAD if bad else NONE


#: name -> vote. Short texts make most of them abstain: too little is known.
LABELLERS = {
    "symbols": lambda f: _between(f.symbols, f.symbols < 0.005, f.symbols > 0.03),
    "capitals": lambda f: _between(f.upper, f.upper < 0.12, f.upper > 0.4) if f.n_words >= 5 else NONE,
    "top_word": lambda f: _between(f.top, f.top < 0.15 * f.n_words, f.top > 0.3 * f.n_words) if f.n_words >= 30 else NONE,
    "variety": lambda f: _between(f.kinds, f.kinds > 0.35 * f.n_words, f.kinds < 0.1 * f.n_words) if f.n_words >= 60 else NONE,
    "function_words": lambda f: _between(f.stop, f.stop > 0.12, f.stop < 0.03) if f.n_words >= 30 else NONE,
    "word_length": lambda f: _between(f.mean_length, 3 <= f.mean_length <= 9, f.mean_length < 2 or f.mean_length > 14) if f.n_words >= 10 else NONE,
    "sentences": lambda f: _between(f.ends, 0.04 < f.ends < 0.4, f.ends < 0.01) if f.n_words >= 60 else NONE,
    "doubled_marks": lambda f: _between(f.doubled, f.doubled < 0.01, f.doubled > 0.1),
    "stutter": lambda f: _between(f.stutter, f.stutter < 0.05, f.stutter > 0.2) if f.n_words >= 10 else NONE,
    "repeated_lines": lambda f: _between(f.repeated_lines, f.repeated_lines < 0.05, f.repeated_lines > 0.3) if f.n_words >= 30 else NONE,
}


def votes(text: str, words: list[str], freq: Counter) -> str:
    """One character for each labeller: + good, - bad, 0 nothing."""
    f = Facts.of(text, freq, words)
    return "".join("0+-"[vote(f)] for vote in LABELLERS.values())


@dataclass
class LabelModel:
    """P(vote | class, the labeller votes) for each labeller and the share of good documents. No vote is no evidence."""

    good_share: float
    given_good: np.ndarray
    given_bad: np.ndarray

    def posterior(self, pattern: str) -> float:
        """The probability that a document with these votes is good."""
        at = ["0+-".index(c) for c in pattern]
        j = range(len(at))
        log = np.log(self.good_share) - np.log(1 - self.good_share) + float((np.log(self.given_good[j, at]) - np.log(self.given_bad[j, at])).sum())
        return float(1 / (1 + np.exp(-np.clip(log, -50, 50))))


def fit_labels(counts: dict[str, int], rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns. Starts from the majority of the votes; the good class stays the one
    that starts as such. With no documents the model says one half to everything."""
    n = len(LABELLERS)
    patterns = sorted(counts)
    at = np.array([["0+-".index(c) for c in p] for p in patterns], dtype=int).reshape(len(patterns), n)
    weight = np.array([counts[p] for p in patterns], dtype=float)
    sign = np.array([0, 1, -1])[at].sum(axis=1)
    # A single bad vote is stronger than a good one: labellers say bad only far from what is usual.
    good = np.where((at == 2).any(axis=1), 0.1, np.where(sign > 0, 0.95, 0.5))
    hot = np.stack([(at == v) & (v > 0) for v in range(3)], axis=2).astype(float) if len(patterns) else np.zeros((0, n, 3))
    share, a, b = 0.5, np.full((n, 3), 0.5), np.full((n, 3), 0.5)
    shares = lambda x: np.concatenate([np.ones((n, 1)), (x[:, 1:] + 0.5) / (x[:, 1:].sum(axis=1, keepdims=True) + 1)], axis=1)
    for _ in range(rounds if len(patterns) else 0):
        g, h = weight * good, weight * (1 - good)
        share = (g.sum() + 1) / (weight.sum() + 2)
        a, b = shares(np.einsum("p,pnv->nv", g, hot)), shares(np.einsum("p,pnv->nv", h, hot))
        log = np.log(share / (1 - share)) + np.einsum("pnv,nv->p", hot, np.log(a) - np.log(b))
        new = 1 / (1 + np.exp(-np.clip(log, -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return LabelModel(float(share), a, b)


def shape(word: str) -> str:
    for pattern, to in SHAPE:
        word = pattern.sub(to, word)
    return word[:6]


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % BUCKETS


def word_buckets(word: str) -> tuple[int, int]:
    return bucket(f"w {word}"), bucket(f"s {shape(word)}")


def text_buckets(words: list[str], freq: Counter) -> list[int]:
    """Features of the whole text: how often words repeat, in steps."""
    n = max(len(words), 1)
    twice = sum(map(eq, words, words[1:]))
    return [bucket(f"kinds {10 * len(freq) // n} {min(len(words) // 100, 10)}"), bucket(f"top {10 * max(freq.values(), default=0) // n}"), bucket(f"twice {min(10 * twice // n, 9)}")]


def row(words: list[str], freq: Counter) -> tuple[list[int], list[float]]:
    """Buckets and values: word and shape features share 1, each whole-text feature has 1."""
    n = max(len(words), 1)
    got: Counter = Counter()
    for w, c in freq.items():
        for k in word_buckets(w):
            got[k] += c / n
    for k in text_buckets(words, freq):
        got[k] += 1.0
    return list(got), list(got.values())


def fit_scorer(rows: list[tuple[list[int], list[float], float]], rounds: int = 120, rate: float = 0.3, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets (Adam over the whole sample, no randomness)."""
    if not rows:
        return np.zeros(BUCKETS, np.float32), 0.0
    sizes = np.array([len(r[0]) for r in rows])
    doc = np.repeat(np.arange(len(rows)), sizes)
    cols = np.concatenate([np.asarray(r[0], dtype=np.int64) for r in rows])
    vals = np.concatenate([np.asarray(r[1]) for r in rows])
    used, cols = np.unique(cols, return_inverse=True)
    y = np.array([r[2] for r in rows])
    # Both classes weigh the same, or the few bad documents would hardly count.
    scale = np.where(y > 0.5, 0.5 / max((y > 0.5).mean(), 0.02), 0.5 / max((y <= 0.5).mean(), 0.02)) / len(rows)
    w, bias = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(doc, vals * w[cols], len(rows)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * scale
        g, gb = np.bincount(cols, vals * err[doc], len(used)) + ridge * w, err.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        bias -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    out = np.zeros(BUCKETS, np.float32)
    out[used] = w
    return out, float(bias)


def vote_counts(docs: DataFrame) -> dict[str, int]:
    """Documents by vote pattern, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter = Counter()
        for batch in batches:
            for i in range(0, batch.num_rows, 250):
                for t in batch.column(0).slice(i, 250).to_pylist():
                    words = (t or "").split()
                    got[votes(t or "", words, Counter(words))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], ["pattern", "n"])

    found = docs.select("text").mapInArrow(run, "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r["pattern"]: r["n"] for r in found.collect()}


def sample_rows(docs: DataFrame, labels: LabelModel, size: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[list[int], list[float], float]]:
    """Features and posterior of the ``size`` documents with the least hash of id and text, in its order, as many as
    have ``most_bytes`` together (one at least). Rows that repeat an id and a text count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = [], [], []
            for t in batch.column(1).to_pylist():
                words = (t or "").split()
                freq = Counter(words)
                k, v = row(words, freq)
                a.append(np.asarray(k, np.int32)), b.append(np.asarray(v, np.float32)), c.append(labels.posterior(votes(t or "", words, freq)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in a], pa.binary()), pa.array([x.tobytes() for x in b], pa.binary()), pa.array(c, pa.float64())], ["h", "k", "v", "y"])

    hashed = docs.select(F.xxhash64(F.col("doc_id"), F.col("text")).alias("h"), "text")
    # The bound is found on hashes and sizes alone, so texts are neither sorted nor sent.
    first = hashed.select("h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).distinct().orderBy("h").limit(size).collect()
    if not first:
        return []
    upto = np.cumsum([r["n"] for r in first])
    last = first[max(0, int(np.searchsorted(upto, most_bytes, side="right")) - 1)]["h"]
    got = hashed.where(F.col("h") <= last).dropDuplicates(["h"]).mapInArrow(run, "h bigint, k binary, v binary, y double").collect()
    return [(np.frombuffer(r["k"], np.int32), np.frombuffer(r["v"], np.float32), r["y"]) for r in sorted(got, key=lambda r: r["h"])]


def classify(docs: DataFrame, keep: list[str] | None = None, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) and votes, weak_label (the posterior), score, kept (score >= threshold).

    Needs doc_id and text. Null text counts as empty. All rows are voted on and scored, the same text always alike; the
    scorer is fitted on at most ``sample`` rows. An empty table gives an empty result. Made names that ``keep`` has get
    leading underscores.
    """
    keep = docs.columns if keep is None else keep
    labels = fit_labels(vote_counts(docs))
    weights, bias = fit_scorer(sample_rows(docs, labels, sample))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # BUCKETS floats: 1 MB
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = shared.value, {}
        for whole in batches:
            for i in range(0, whole.num_rows, 250):
                batch = whole.slice(i, 250)
                pattern, weak, score = [], [], []
                for t in batch.column(n).to_pylist():
                    words = (t or "").split()
                    freq = Counter(words)
                    if len(known) > KEEP_WORDS:
                        known.clear()
                    for x in freq:
                        if x in known:
                            continue
                        a, b = word_buckets(x)
                        known[x] = float(w[a] + w[b])
                    z = sum(map(float.__mul__, map(known.__getitem__, freq), map(float, freq.values()))) / max(len(words), 1) + bias + sum(float(w[k]) for k in text_buckets(words, freq))
                    pattern.append(votes(t or "", words, freq))
                    weak.append(labels.posterior(pattern[-1]))
                    score.append(float(1 / (1 + np.exp(-np.clip(z, -50, 50)))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(pattern, pa.string()), pa.array(weak, pa.float64()), pa.array(score, pa.float64())], [*(f"c{j}" for j in range(n)), "votes", "weak_label", "score"])

    few = docs.select(*[F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(keep)], F.col("text").alias("t"))
    kinds = "".join(f"c{j} {few.schema[j].dataType.simpleString()}, " for j in range(n))
    out = few.mapInArrow(run, f"{kinds}votes string, weak_label double, score double")
    return out.withColumn("kept", F.col("score") >= threshold).toDF(*keep, *[fresh(keep, x) for x in ("votes", "weak_label", "score", "kept")])
