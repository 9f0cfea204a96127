"""Results stay the same when every key of the spread joins counts as hot."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import conversations, mixing, tables, vectors, wrappers
from cohortspark.operators.skew import SkewPolicy
from test_conversations import SCHEMA as MESSAGES, sample
from test_vectors import EDGES, SCHEMA as VECTORS, by_hand, clustered
from test_wrappers import SCHEMA as PAGES, site

HOT = SkewPolicy(task_rows=4, broadcast_rows=0)


@pytest.fixture(autouse=True)
def hot(monkeypatch):
    for module in (conversations, mixing, tables, vectors, wrappers):
        monkeypatch.setattr(module, "POLICY", HOT)


def test_components_of_a_star_and_a_chain(spark):
    pairs = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 3), (7, 7)]
    found = dict(map(tuple, tables.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(60)} | {100 + i: 100 for i in range(41)}


def test_vectors(spark):
    rows = clustered(8) + EDGES + [(77, [1.0] * 16, 2)] * 12 + [(500 + i, [0.5] * 16, 2) for i in range(12)] + [(None, None, None)] * 9
    frame = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    assert sorted(map(tuple, vectors.judge(frame).collect()), key=repr) == by_hand(rows)


def test_conversations(spark, monkeypatch):
    frame = spark.createDataFrame(sample(9, 60) * 2, MESSAGES)
    found = sorted(map(repr, conversations.report(frame, frame.fillna(" ", ["role", "text"])).collect()))
    monkeypatch.setattr(conversations, "POLICY", SkewPolicy())
    assert found == sorted(map(repr, conversations.report(frame, frame.fillna(" ", ["role", "text"])).collect()))


def test_pages(spark):
    rows = [(i, f"http://Plain.example/{i}", site(i, 1 + i % 4)) for i in range(9)]
    found = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(9):
        assert found[i] == "\n".join([f"Story {i}"] + [f"Story {i} says thing {k} at some length." for k in range(1 + i % 4)])


def test_mix_takes_its_targets(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, i]), rng.choice(["a", "a", "a", "b", None]), "w " * rng.randrange(9)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(frame, group_rows=10).groupBy(F.col("rec.source").alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"))
    for r in out.collect():
        assert r.n == sum(x[1] == r.s for x in rows) and abs(r.taken - r.target) <= 16
