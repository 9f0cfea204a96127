"""Substring dedup against a loop over all windows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cohortspark.llm import substrings
from cohortspark.llm.words import joined, split

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(docs, k):
    first: dict = {}
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in words:
        for s in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[s:s + k])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - k + 1):
            if i is not None and first[tuple(w[s:s + k])] < i:
                gone.update(range(s, s + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def texts_of(seed, n, passages):
    rng = random.Random(seed)
    words = ["a", "b", "the", "longword", "é", "漢字", "x" * 70]
    shared = [rng.choices(words, k=rng.randrange(5, 40)) for _ in range(passages)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += rng.choice(shared) if rng.random() < .5 else rng.choices(words, k=rng.randrange(20))
        out.append(rng.choice([" ", "  ", "\n", "\t "]).join(parts))
    return out


@pytest.mark.parametrize("k", [3, 13])
def test_against_a_loop(docs_of, k):
    texts = [None, "", " \n", *texts_of(1, 150, 6), "same " * 500, "same " * 40]
    ids = list(range(len(texts)))
    ids[5], ids[6], ids[9] = None, None, 8     # without id, and one id twice
    rng = random.Random(9)
    rng.shuffle(ids)
    rows = substrings.dedup(docs_of(texts, ids=ids).selectExpr("*", "1 AS bucket", "2 AS place"), k).collect()
    assert sorted(map(tuple, rows), key=repr) == by_hand(list(zip(ids, texts)), k)


def test_stream_state_across_batches():
    """Batches of a few rows give the runs of one large batch."""
    texts = texts_of(3, 60, 3)
    table = substrings.super_kmers(pa.RecordBatch.from_pydict({
        "doc_id": pa.array(range(60)), "tag": pa.array([0] * 60), "text": pa.array(texts)}), 4)
    rows = pa.Table.from_batches([table]).sort_by([("bucket", "ascending"), ("doc_id", "ascending")]).combine_chunks()

    def runs(size):
        seen, out = substrings.Seen(), set()
        for batch in rows.to_batches(max_chunksize=size):
            for r in substrings.repeated(batch, 4, seen).to_pylist():
                out |= {(r["doc_id"], r["place"] + i) for i in range(r["n"])}
        return out

    assert runs(1) == runs(7) == runs(100_000) != set()


def test_joined_words():
    w = split(pa.array(["a  b\n", None, "ccc", " "]))
    text, offsets = joined(w, np.array([True, False, True]))
    assert bytes(text) == b"a ccc " and offsets.tolist() == [0, 2, 6]


def test_empty_table(docs_of):
    assert substrings.dedup(docs_of([])).collect() == []
