"""Operator 7, quality rules: counted rules and a trained, calibrated text classifier.

Counts and classifier read every text once, where it lies. The classifier is a
logistic regression over hashed word 1-grams and 2-grams and hashed character
n-grams; each kind enters with its mean weight, so length does not matter. It
is fitted on a bounded sample of labelled rows, its probability is calibrated
on rows kept apart, and fixed thresholds decide.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.registry import register
from cohortspark.llm.tables import table
from cohortspark.llm.words import Words, chunks, mixed, per_text, span_hashes, split

BITS = 18                # of the hashed feature space
CHAR_GRAMS = (3, 5)      # bytes
WORD_GRAMS = (1, 2)
SAMPLE_ROWS = 3_000      # labelled rows that the classifier is fitted on, at most
KEEP_FROM = 0.5          # calibrated probability of good quality
LEAST_WORDS = 10
MOST_REPEATED = 20       # percent of the words
REPEAT_WINDOW = 5
SEED = 7

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

DECISIONS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
             "n_repeat_words long, base_failed boolean, kept boolean, p_good double")


def repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def base_counts(w: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The counted columns of each text; equality inside a text is by 64-bit hashes of whole content."""
    n = len(w.bounds) - 1
    in_word = np.zeros(len(w.data) + 1, np.int64)
    in_word[w.starts] += 1
    in_word[w.ends] -= 1  # a word may begin where another text's word ended
    in_word = np.cumsum(in_word[:-1]) > 0
    heads = (w.data & 0xC0) != 0x80

    feeds = np.flatnonzero(w.data == 0x0A)
    feed_doc = np.searchsorted(w.bounds, feeds, side="right") - 1
    line_doc = np.concatenate([np.arange(n), feed_doc])
    order = np.argsort(line_doc, kind="stable")       # a text's first line, then those behind its feeds
    line_doc = line_doc[order]
    starts = np.concatenate([w.bounds[:-1], feeds + 1])[order]
    order = np.argsort(np.concatenate([feed_doc, np.arange(n)]), kind="stable")
    ends = np.concatenate([feeds, w.bounds[1:]])[order]
    worded = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(in_word, out=worded[1:])
    filled = worded[ends] > worded[starts]
    starts, ends, line_doc = starts[filled], ends[filled], line_doc[filled]
    line = span_hashes(w.data.astype(np.uint64) + np.uint64(1), starts, ends, 0xD6E8FEB86659FD93)
    line = mixed(line + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.zeros(n, np.int64)
    if len(line):
        order = np.lexsort((line, line_doc))
        new = np.ones(len(line), bool)
        new[1:] = (line[order][1:] != line[order][:-1]) | (line_doc[order][1:] != line_doc[order][:-1])
        distinct = np.bincount(line_doc[order][new], minlength=n)

    at, window = w.windows(REPEAT_WINDOW, hashes)
    twice = at[repeats(mixed(window + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))]
    cover = np.zeros(len(w.starts) + REPEAT_WINDOW + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + REPEAT_WINDOW, -1)
    covered = np.cumsum(cover)[:len(w.starts)] > 0
    return {
        "n_words": np.diff(w.first), "word_chars": per_text(in_word & heads, w.bounds),
        "n_symbols": per_text(SYMBOL[w.data], w.bounds),
        "n_dup_lines": np.bincount(line_doc, minlength=n) - distinct,
        "n_repeat_words": per_text(covered, w.first),
    }


def grams(w: Words, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: bucket of every gram, and where each text's grams begin."""
    shift = np.uint64(64 - BITS)
    for k in WORD_GRAMS:
        at, window = w.windows(k, hashes)
        yield (mixed(window + np.uint64(k)) >> shift).astype(np.int32), np.searchsorted(at, w.first)
    wide = w.data.astype(np.uint64)
    for k in CHAR_GRAMS:
        gram = np.zeros(max(0, len(wide) - k + 1), np.uint64)
        for j in range(k):
            gram |= wide[j:j + len(gram)] << np.uint64(8 * j)
        bucket = (((gram + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int32)
        inner = np.ones(len(bucket), bool)   # grams that end in their own text
        for j in range(1, k):
            cut = w.bounds[1:-1] - j
            inner[cut[(cut >= 0) & (cut < len(inner))]] = False
        yield bucket[inner], np.searchsorted(np.flatnonzero(inner), w.bounds)


@dataclass
class Model:
    weights: np.ndarray          # float32, one per bucket
    bias: float
    slope: float = 1.0           # calibration: p = sigmoid(slope * raw + shift)
    shift: float = 0.0

    def raw(self, w: Words, hashes: np.ndarray) -> np.ndarray:
        total = np.full(len(w.bounds) - 1, self.bias)
        for bucket, first in grams(w, hashes):
            n = np.diff(first)
            total += per_text(self.weights[bucket], first) / np.maximum(n, 1)
        return total

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -40, 40)))


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares, all kinds together."""
    out = []
    for k in range(len(texts)):
        w = split(texts.slice(k, 1))
        hashes = w.hashes()
        kinds = [(b, np.full(len(b), 1 / max(1, len(b)))) for b, _ in grams(w, hashes)]
        buckets, inverse = np.unique(np.concatenate([b for b, _ in kinds]), return_inverse=True)
        share = np.bincount(inverse, np.concatenate([s for _, s in kinds]), len(buckets))
        out.append((buckets, share.astype(np.float32)))  # the whole sample lies in memory
    return out


def platt_goals(positive: int, negative: int) -> tuple[float, float]:
    """Platt's smoothed targets of both labels."""
    return (positive + 1) / (positive + 2), 1 / (negative + 2)


def platt_sums(raw: np.ndarray, goal: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Information matrix and gradient."""
    x = np.stack([raw, np.ones_like(raw)], axis=1)
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
    return x.T @ (x * (p * (1 - p))[:, None]), x.T @ (goal - p)


def platt_steps(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[float, float]:
    """Slope and shift by Newton steps; ``sums`` gives information matrix and gradient over all scores."""
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        curve, gradient = sums(beta)
        step = np.linalg.solve(curve + 1e-4 * np.eye(2), gradient - 1e-4 * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def platt(raw: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrated probability, with Platt's smoothed targets."""
    high, low = platt_goals(good.sum(), (~good).sum())
    goal = np.where(good, high, low)
    return platt_steps(lambda beta: platt_sums(raw, goal, beta))


def fit(texts: pa.Array, good: np.ndarray, epochs: int = 6, rate: float = 0.5, seed: int = SEED) -> Model | None:
    """Adaptive-gradient logistic regression; a fifth of the rows calibrates it. None without both classes."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(good))
    apart = order[:len(order) // 5]
    train = order[len(order) // 5:]
    if len(np.unique(good[train])) < 2 or len(np.unique(good[apart])) < 2:
        return None
    rows = features(texts)
    balance = {True: 0.5 / good[train].mean(), False: 0.5 / (~good[train]).mean()}
    weights, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-12)
    bias, seen_bias = 0.0, 1e-12
    for _ in range(epochs):
        for i in rng.permutation(train):
            buckets, share = rows[i]
            p = 1 / (1 + np.exp(-np.clip(weights[buckets] @ share + bias, -40, 40)))
            slope = (p - good[i]) * balance[bool(good[i])]
            gradient = slope * share
            seen[buckets] += gradient ** 2
            weights[buckets] -= rate * gradient / np.sqrt(seen[buckets])
            seen_bias += slope ** 2
            bias -= rate * slope / np.sqrt(seen_bias)
    model = Model(weights.astype(np.float32), float(bias))
    raw = np.array([model.weights[rows[i][0]] @ rows[i][1] + bias for i in apart])
    model.slope, model.shift = platt(raw, good[apart])
    return model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> Model | None:
    """Fit on at most ``sample_rows`` labelled documents, the first by a seeded hash.

    A document labelled more than once is good only if every label says so;
    NULL labels and ids count as no label. The sampled ids are a bounded table,
    so they are broadcast to the documents. The sample is fitted in one task
    and the model (1 MB) reaches the driver.
    """
    mark = F.xxhash64(F.lit(seed), F.col("doc_id"))
    labelled = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
                .groupBy("doc_id").agg(F.min("quality").alias("good"))
                .orderBy(mark, "doc_id").limit(sample_rows))
    rows = (docs.select("doc_id", "text").where("text IS NOT NULL")
            .join(F.broadcast(labelled), "doc_id")
            .orderBy(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), "doc_id").limit(sample_rows)
            .select("text", (F.col("good") > 0).alias("good")).coalesce(1))

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        sample = pa.Table.from_batches(held).combine_chunks()
        model = fit(sample.column("text").combine_chunks(), sample.column("good").to_numpy(), seed=seed)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = rows.mapInArrow(fitting, "model binary").first()
    return None if found is None else pickle.loads(found.model)


def decide(texts: pa.Array, model: Model | None, keep_from: float = KEEP_FROM) -> dict[str, np.ndarray]:
    w = split(texts)
    hashes = w.hashes()
    out = base_counts(w, hashes)
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
    p = np.ones(len(texts)) if model is None else model.probability(model.raw(w, hashes))
    return out | {"p_good": p, "kept": ~out["base_failed"] & (p >= keep_from)}


def judge(docs: DataFrame, model: Model | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per document: doc_id, the counted rules, base_failed, kept and the calibrated probability.

    A NULL or empty text has no words and fails the base rules. Without a model
    (no labelled rows, or one class only) the base rules alone decide. Repeated
    rows and documents without id are judged like any other; an empty table
    gives no row; other columns are not read. Nothing is shuffled.
    """
    def judging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in chunks(batch, "text"):
                found = decide(rows.column("text"), model, keep_from)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": rows.column("doc_id"), **{k: pa.array(found[k]) for k in (
                        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        "kept", "p_good")}})

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(judging, DECISIONS)


def keep_good(docs: DataFrame, model: Model | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that pass, with all their columns."""
    def keeping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in chunks(batch, "text"):
                yield rows.filter(pa.array(decide(rows.column("text"), model, keep_from)["kept"]))

    return docs.mapInArrow(keeping, docs.schema)


@register("op7_quality_rules")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return judge(docs, train(docs, table(spark, folder, "labels")))
