"""Quality rules against a loop, the classifier by its held-out accuracy."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cohortspark.llm import quality
from cohortspark.llm.words import split

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PARTS = ["a", "b", "of the", " ", "  ", "\n", "\n", "\t", "é", "漢", "#", "$|", "<", "\x0b", "　"]


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if count[window] > 1:
            covered.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": dup, "n_repeat_words": len(covered)}


def random_texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randrange(40))) for _ in range(n)]


def test_counts_against_a_loop():
    texts = [None, "", " ", "\n", "a", "a\n", "a\na", " a\na ", "x y z v w " * 3, *random_texts(400)]
    w = split(pa.array(texts))
    found = quality.base_counts(w, w.hashes())
    for k, text in enumerate(texts):
        assert {c: int(found[c][k]) for c in found} == by_hand(text), repr(text)


def test_op7_counts_whole_texts_and_keeps_clean_ones(spark):
    rows = {r.doc_id: r for r in quality.op7(spark, FOLDER).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert set(rows) == set(docs)
    for i, r in rows.items():
        hand = by_hand(docs[i])
        assert {c: r[c] for c in hand} == hand
        failed = hand["n_words"] < 10 or 100 * hand["n_repeat_words"] > 20 * hand["n_words"]
        assert r.base_failed == failed and (not r.kept if failed else r.kept == (r.p_good >= quality.KEEP_FROM))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    judged = [(x.quality, rows[x.doc_id].kept) for x in labels if not rows[x.doc_id].base_failed]
    good = [kept for q, kept in judged if q == 1]
    poor = [kept for q, kept in judged if q == 0]
    assert np.mean(good) > 0.98 and np.mean(poor) < 0.1


def test_held_out_accuracy_and_calibration():
    rng = random.Random(2)
    texts, good = [], []
    for i in range(600):
        words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(rng.randrange(15, 60))]
        good.append(i % 3 > 0)
        texts.append(" ".join(words if good[-1] else [x + rng.choice(["##", "$$", "!!"]) for x in words]))
    good = np.array(good)
    model = quality.fit(pa.array(texts[:400]), good[:400])
    found = quality.decide(pa.array(texts[400:]), model)
    assert ((found["p_good"] >= 0.5) == good[400:]).mean() > 0.97
    assert np.mean((found["p_good"] - good[400:]) ** 2) < 0.05
    assert quality.fit(pa.array(texts[:9]), np.ones(9, bool)) is None


def test_edges(spark, docs_of):
    texts = [None, "", "one two three four five six seven eight nine ten", "x " * 40]
    docs = docs_of(texts, ids=[None, 1, 2, 2]).selectExpr("*", "'k' AS kept", "1 AS n_words")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert model is None
    rows = {(r.doc_id, r.n_words): r for r in quality.judge(docs, model).collect()}
    assert rows[(None, 0)].base_failed and rows[(1, 0)].base_failed
    assert rows[(2, 10)].kept and rows[(2, 40)].base_failed
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and [r.text for r in kept.collect()] == [texts[2]]
    assert quality.judge(docs_of([]), None).collect() == []


@pytest.mark.parametrize("rows", [[(1, None, 0), (None, 1, 0)], [(0, 1, 0), (1, 1, 0)]])
def test_labels_without_two_classes_give_no_model(spark, docs_of, rows):
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert quality.train(docs_of(["a b c", "d e f"]), labels) is None


def test_texts_of_every_short_length():
    short = ["é漢ab"[:k] for k in range(5)] + ["abcdefgh"[:k] for k in range(9)]
    good = np.arange(len(short)) % 2 == 0
    model = quality.fit(pa.array(short * 20), np.tile(good, 20))
    whole = quality.decide(pa.array([None, *short, *reversed(short)]), model)
    for k, text in enumerate([None, *short, *reversed(short)]):
        alone = quality.decide(pa.array([text], pa.string()), model)
        assert alone["p_good"][0] == pytest.approx(whole["p_good"][k])
        buckets = [b for b, _ in quality.features(pa.array([text or ""]))]
        w = split(pa.array([text or ""]))
        data = (text or "").encode()
        wanted = sum(max(0, len(data) - n + 1) for n in quality.CHAR_GRAMS)
        assert sum(len(b) for b, _ in list(quality.grams(w, w.hashes()))[2:]) == wanted and len(buckets) == 1
