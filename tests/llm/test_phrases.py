"""Collocations against a loop over all phrases, tries against a dictionary."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def by_hand(rows, least, top=2_000):
    totals, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                f.update((lang, tuple(words[i:i + m])) for i in range(len(words) - m + 1))
    f = Counter({p: n for p, n in f.items() if n >= least})
    found = {}
    for (lang, p), a in f.items():
        if len(p) == 1:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(q != p and lang == other and 100 * b >= 80 * a and any(
            q[i:i + len(p)] == p for i in range(len(q) - len(p))) or lang == other and len(q) > len(p) and q[-len(p):] == p
            and 100 * b >= 80 * a for (other, q), b in f.items())
        if not inside:
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1): (p.decode(), -a, le, ri, totals[lang], -s) for lang, rows in found.items()
            for i, (s, a, p, le, ri) in enumerate(sorted(rows)[:top])}


def told(frame):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect()}


def sample(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "A", "b", "bb", "é", "the", "of", "of", "漢", "x-y", "ab"]
    gaps = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "; "]
    return [(i, rng.choice([None, "", " ", *["".join(rng.choice(words) + rng.choice(gaps) for _ in range(
        rng.randrange(60))) for _ in range(9)]]), rng.choice([None, "en", "en", "en", "e", "a\nb", ""])) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_against_a_loop(spark, seed):
    rows = sample(seed)
    frame = spark.createDataFrame(rows, SCHEMA)
    for least, trie_bytes in ((5, 4_000_000), (3, 200)):
        assert told(phrases.collocations(frame, least=least, trie_bytes=trie_bytes, top=40)) == by_hand(rows, least, 40)


def test_same_as_sql_with_nulls(spark):
    rows = sample(7, 300)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    found = con.execute(phrases.SQL).fetchall()
    mine = {(r[0], r[1]): r[2:] for r in found}
    assert told(phrases.collocations(spark.createDataFrame(rows, SCHEMA))) == mine


def test_trie_against_a_dictionary():
    rng = random.Random(3)
    keys = list({bytes(rng.choices(b"ab\xff\x01 \n", k=rng.randrange(9))) for _ in range(400)} | {bytes(range(256)), b"\x00"})
    trie = phrases.Trie.of(keys)
    known = {k: i for i, k in enumerate(keys)}
    tried = keys + [bytes(rng.choices(b"ab\xff\x01 \n\x00", k=rng.randrange(9))) for _ in range(2000)]
    data = np.frombuffer(b"".join(tried), np.uint8)
    ends = np.cumsum([len(k) for k in tried])
    begins = ends - [len(k) for k in tried]
    got = trie.accepted(data, begins, ends, np.full(len(tried), trie.root, np.int32))
    assert got.tolist() == [known.get(k, -1) for k in tried]
    assert all(trie.phrase[trie.reach(trie.root, k)] == i for k, i in known.items())


def test_no_key_and_no_text():
    trie = phrases.Trie.of([])
    none = np.zeros(0, np.int64)
    assert trie.reach(trie.root, b"x") == -1 and len(trie.accepted(np.zeros(0, np.uint8), none, none, none)) == 0


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choices(["to", "be", "or", "not", "w" * 500], k=20_000)) + ". " + "a b c d " * 3_000
    data = np.frombuffer(text.encode(), np.uint8)
    chunks = list(phrases.segments(data, np.array([0, len(data)]), size=50_000))
    assert len(chunks) > 10 and chunks[-1][-1][3] == len(data)
    assert [c[0][1] for c in chunks[1:]] == [c[0][2] for c in chunks[:-1]]
    rows = [(1, text, "en"), (2, "to be or not", "en"), (3, text * 3, None)]
    assert told(phrases.collocations(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows, 30)


def test_empty_table_and_extra_columns(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    frame = spark.createDataFrame(sample(5), SCHEMA)
    wide = frame.withColumns({c: F.lit("x") for c in ("id", "phrase", "n", "a", "l", "r", "rank", "words", "next", "k")})
    assert told(phrases.collocations(wide, least=5)) == told(phrases.collocations(frame, least=5))


def test_scores_stay_exact_beyond_64_bits(spark):
    a = spark.range(1).selectExpr("9000000000000000000L AS a", "array(9100000000000000000L) AS heads",
                                  "array(9100000000000000000L) AS tails")
    (row,) = a.select(phrases.cut_of(F.lit(1), 2, phrases.FACTOR).alias("cut")).collect()
    assert row.cut.score == 2_000_000 * 9 * 10**18 // (2 * 91 * 10**17)
