"""BagMinHash against exact similarities, classes against all pairs of a small table."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cohortspark.llm import near_copies as nc
from cohortspark.llm.tables import components
from cohortspark.llm.words import split

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"


def bag(text):
    w = WORD.findall(text or "")
    return Counter([tuple(w[i:i + 5]) for i in range(len(w) - 4)] or ([("all", *w)] if w else []))


def similarity(x, y):
    a, b = bag(x), bag(y)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes_by_hand(docs):
    ids = sorted(docs)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            if similarity(docs[i], docs[j]) >= 0.8 - 1e-12:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def sign(texts):
    w = split(pa.array(texts))
    return nc.signatures(*nc.weighted(*nc.shingles(w, w.hashes())), len(texts))


def test_overlap_is_exact():
    rng = random.Random(1)
    texts = [" ".join(rng.choices("ab", k=rng.randrange(30))) for _ in range(400)] + ["", None]
    left, right = [rng.choice(texts) for _ in range(800)], [rng.choice(texts) for _ in range(800)]
    found = nc.overlap(pa.array(left), pa.array(right))
    assert np.allclose(found, [similarity(x, y) for x, y in zip(left, right)])


def test_signatures_estimate_the_weighted_similarity():
    """Agreement of components over many pairs with heavy multiplicities is unbiased."""
    rng = random.Random(2)
    errors = []
    for _ in range(150):
        common = ["u%d" % rng.randrange(40) for _ in range(60)] * rng.randrange(1, 9)
        x = " ".join(common + ["v%d" % rng.randrange(10) for _ in range(rng.randrange(80))] * rng.randrange(1, 5))
        y = " ".join(common + ["w%d" % rng.randrange(10) for _ in range(rng.randrange(80))] * rng.randrange(1, 5))
        a, b = sign([x, y])
        errors.append((a == b).mean() - similarity(x, y))
    assert abs(np.mean(errors)) < 0.012
    assert np.std(errors) < 0.06


def test_signature_does_not_depend_on_the_batch():
    texts = ["a b c d e f g a b c d e", "x y", "one two three four five six"]
    alone = np.concatenate([sign([t]) for t in texts])
    assert (alone == sign(texts)).all()
    assert np.isinf(sign(["", "a"])[0]).all()


def near_texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(25):
        base = ["w%d" % rng.randrange(400) for _ in range(rng.randrange(3, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "z%d" % rng.randrange(50)
            out.append(rng.choice([" ", "\n"]).join(copy))
    return out


def test_classes_against_all_pairs(docs_of):
    texts = [None, "", " ", *near_texts(6), "a b c", "a  b c", "a b", "same text again and again and once more"] * 1
    texts += texts[5:12]
    docs = dict(enumerate(texts))
    rows = nc.judge(docs_of(texts).selectExpr("*", "1 AS rep", "2 AS class_id")).collect()
    expected = classes_by_hand(docs)
    assert {r.doc_id: r.class_id for r in rows} == expected
    assert all(r.kept == (r.doc_id == expected[r.doc_id]) for r in rows)


@pytest.mark.parametrize("tile", [2, 1024])
def test_dense_group_without_a_hub(docs_of, monkeypatch, tile):
    """Many texts around the threshold: no hub reaches all, classes must still be those of all pairs."""
    monkeypatch.setattr(nc, "TILE", tile)
    rng = random.Random(12)
    base = ["w%d" % i for i in range(60)]
    texts = [" ".join(base[:-k] + ["x%d" % rng.randrange(9) for _ in range(k)]) + " again and" * rng.randrange(3, 30)
             for k in (rng.randrange(1, 8) for _ in range(70))]
    rows = nc.judge(docs_of(texts)).collect()
    assert {r.doc_id: r.class_id for r in rows} == classes_by_hand(dict(enumerate(texts)))


def test_op5_on_the_given_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = nc.op5(spark, FOLDER).collect()
    assert {r.doc_id: r.class_id for r in rows} == classes_by_hand(docs) and len(rows) == len(docs)


def test_repeated_ids_and_rows_without_id(docs_of):
    x, y = " ".join(map(str, range(20))), " ".join(map(str, range(50, 80)))
    docs = docs_of([x, x, y, y, x, None, None, "k l m"], ids=[4, 4, 4, 2, None, None, 9, 9])
    assert sorted((str(r.doc_id), str(r.class_id), r.kept) for r in nc.judge(docs).collect()) == [
        ("2", "2", True), ("4", "2", False), ("4", "2", False), ("4", "2", False), ("9", "9", True), ("9", "9", True),
        ("None", "None", True), ("None", "None", True)]
    kept = nc.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "9", "None", "None"]
    assert nc.judge(docs_of([])).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_chains_and_random_links(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(45)]
    links += [(7, 7), (None, 3), (5, 6), (6, 5)]
    root = {i: i for pair in links if None not in pair for i in pair}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    linked = {i for a, b in links if a is not None and a != b for i in (a, b)}
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == sorted((i, find(i)) for i in linked)
