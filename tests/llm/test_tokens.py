"""Token counts and packing against the tokenizers library and plain Python."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortspark.llm.packing import Capacity, best_fit, op8, pack
from cohortspark.llm.token_counts import op4, token_counts
from cohortspark.llm.tokens import vocabulary

FOLDER = "/root/testdata/sf0.001"
PARTS = ["a", "The", " of", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "ß", "12", "'s", "!", "<|endoftext|>", "　",
         "​", "漢", "🙂", "́", "\x00", "_", "\u0085"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_tokenizers_file(plain):
    rng = random.Random(7)
    for _ in range(2000):
        text = "".join(rng.choices(PARTS, k=rng.randrange(15)))
        assert plain.encode(text, add_special_tokens=False).ids == vocabulary().ids(text).tolist()


def sections_by_hand(plain, values, names, rule):
    used = [(n, v) for n, v in zip(names, values) if v is not None]
    text = "\n".join(v for _, v in used)
    spans, at = [], 0
    for name, value in used or [(names[0], "")]:
        body = value + ("" if (name, value) == (used or [(name, value)])[-1] else "\n")
        pieces = [p + "\n" for p in body.split("\n")]
        pieces[-1] = pieces[-1][:-1]
        if not pieces[-1] and len(pieces) > 1:
            pieces.pop()
        for k, piece in enumerate(pieces):
            spans.append([name, k, at, at + len(piece), 0, 0])
            at += len(piece)
    raw_at = np.cumsum([0] + [len(c.encode()) for c in text])
    lengths = vocabulary().lengths[plain.encode(text, add_special_tokens=False).ids]
    place = 0
    for n in lengths:
        shares = [max(0, min(place + n, raw_at[s[3]]) - max(place, raw_at[s[2]])) for s in spans]
        held = [i for i, share in enumerate(shares) if share]
        owner = {"first": held[0], "last": held[-1], "majority": int(np.argmax(shares))}[rule]
        spans[owner][4] += 1
        spans[owner][5] += len(held) > 1
        place += n
    return [tuple(s) for s in spans]


@pytest.mark.parametrize("rule", ["first", "last", "majority"])
def test_sections_against_a_loop(spark, plain, rule):
    rng = random.Random(3)
    rows = [(i, *[None if rng.random() < .2 else "".join(rng.choices(PARTS, k=rng.randrange(12))) for _ in range(2)], "x")
            for i in range(120)] + [(None, None, None, "x"), (5, "", "", "x"), (5, "a\n", "\n", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, title string, section string")
    found = sorted(map(repr, map(tuple, token_counts(df, ["title", "text"], rule=rule).collect())))
    expected = sorted(repr((r[0], *s)) for r in rows
                      for s in sections_by_hand(plain, [r[2], r[1]], ["title", "text"], rule))
    assert found == expected


def test_op4_adds_up_to_whole_documents(spark, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found: dict = {}
    for r in op4(spark, FOLDER).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == set(docs)
    for i, rows in found.items():
        assert sum(r.n_tokens for r in rows) == len(plain.encode(docs[i], add_special_tokens=False).ids)
        rows.sort(key=lambda r: r.section)
        assert [r.start for r in rows] == [0, *[r.stop for r in rows[:-1]]]
        assert rows[-1].stop == len(docs[i])


def test_empty_tables(docs_of):
    assert token_counts(docs_of([]), ["text"]).collect() == []
    assert pack(docs_of([])).collect() == []
    with pytest.raises(ValueError):
        token_counts(docs_of([]), ["text"], rule="none")


def check_packing(rows, docs, plain, capacity):
    by_doc: dict = {}
    by_sequence: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for i, text in docs.items():
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        held = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in held] == list(range(len(held)))
        assert all(r.length == capacity.longest for r in held[1:])
        assert [r.start for r in held] == list(np.cumsum([0] + [r.length for r in held])[:-1])
        assert sum(r.length for r in held) == len(ids)
        for r in held:
            part = np.array(ids[r.start:r.start + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
    for held in by_sequence.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == list(np.cumsum([0] + [r.length for r in held])[:-1])
        assert sum(r.length for r in held) <= capacity.tokens
        assert len(held) <= capacity.documents
        assert sum(r.length ** 2 for r in held) <= capacity.attention
    return len(by_sequence)


def test_op8_packs_every_id_once_and_tightly(spark, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = op8(spark, FOLDER).collect()
    n = check_packing(rows, docs, plain, Capacity())
    total = sum(r.length for r in rows)
    assert n <= -(-total // 2048) + 2


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_holds(docs_of, plain, score):
    rng = random.Random(1)
    texts = [None, "", "a " * 5000, "a " * 63, "b " * 64] + ["w " * rng.randrange(60) for _ in range(150)]
    capacity = Capacity(tokens=64, documents=3, attention=2500, score=score)
    check_packing(pack(docs_of(texts), capacity=capacity).collect(), dict(enumerate(texts)), plain, capacity)


def test_repeated_rows_and_rows_without_id_are_packed(docs_of):
    rows = pack(docs_of(["x y", "x y", None], ids=[3, 3, None])).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["3", "3", "None"]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3


def test_best_fit_takes_the_tightest_sequence():
    sequence, offset = best_fit(np.array([60, 50, 40, 14, 4]), Capacity(tokens=64))
    assert sequence.tolist() == [0, 1, 2, 1, 0]
    assert offset.tolist() == [0, 0, 0, 50, 60]
