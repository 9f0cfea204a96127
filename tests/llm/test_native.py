"""URL rules, source mixing and shards against plain Python; their plans hold no Python."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import mixing, sharding, url_rules
from cohortspark.llm.tables import numbered

FOLDER = "/root/testdata/sf0.001"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x", "block"), ("b.net", "", "allow"),
         ("B.net", "/q/r", "block"), ("", "/", "block"), (None, "/", "block"), ("c.net", None, "allow"), ("net", "/", "block")]


def url_by_hand(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls_against_a_loop(spark):
    rng = random.Random(5)
    hosts = ["net", "example.net", "a.example.net", "x.A.Example.NET", "bexample.net", "b.net", "c.net", "d.c.net", "", ".net", "a..net",
             "net:80", "é.net"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/en/xy/z", "/q/r", "/q/rs", "//", "/en//x", "/a" * 400]
    urls = [None, "", "no scheme", "://", "http://", "x://y://net/", "http://net\n/en/"] + [
        rng.choice(["http", "", "HTTPS"]) + "://" + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "?a=/b", "#/en/"])
        for _ in range(300)]
    pages = spark.createDataFrame([(i % 250, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    clean = [(h.lower(), p or "", v) for h, p, v in RULES if h]
    rows = url_rules.judge(pages, rules).collect()
    found = Counter((r.rec.url, r.host, r.path, r.rule, r.verdict) for r in rows)
    assert found == Counter((u, *url_by_hand(u, clean)) for u in urls)
    assert url_rules.judge(pages, rules.where("false")).where("verdict <> 'allow'").count() == 0
    assert url_rules.judge(pages.where("false"), rules).count() == 0
    assert url_rules.allowed(pages, rules).columns == pages.columns


def water_fill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, held = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in held]
        rest = total - sum(2 * sizes[s] for s in held)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        new = {s for s in free if share[s] >= 2 * sizes[s]}
        if not new:
            return {s: 2 * sizes[s] if s in held else share[s] for s in order}
        held |= new
        if len(held) == len(order):
            return {s: 2.0 * sizes[s] for s in order}


@pytest.mark.parametrize("group_rows", [3, 100_000])
def test_mix_against_a_loop(docs_of, group_rows):
    rng = random.Random(8)
    sources = [rng.choice(["a", "b", "ä", "", None, "z", "z", "z"]) for _ in range(400)] + ["empty", "empty"]
    texts = [rng.choice([None, ""]) if rng.random() < .05 else "w " * rng.randrange(1, 90) for _ in range(400)] + ["", None]
    docs = docs_of(texts, sources=sources).selectExpr("*", "1 AS size", "2 AS target", "3 AS `from`")
    rows = mixing.mix(docs, group_rows=group_rows).collect()
    assert len(rows) == len(texts)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        n = len((r.rec.text or "").split())
        assert r.size == n and 0 <= r.copies <= 2
        sizes[r.rec.source] += n
        taken[r.rec.source] += n * r.copies
    expected = water_fill(sizes)
    for r in rows:
        assert r.source_size == sizes[r.rec.source] and abs(r.target - expected[r.rec.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 2.5 * 90
    again = {r.rec.doc_id: r.copies for r in mixing.mix(docs.repartition(5), group_rows=group_rows).collect()}
    assert again == {r.rec.doc_id: r.copies for r in rows}
    out = mixing.repeated(mixing.mix(docs))
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in mixing.mix(docs).collect())


def test_mix_edges(docs_of):
    assert mixing.mix(docs_of([])).collect() == []
    assert [(r.target, r.copies) for r in mixing.mix(docs_of([None, ""])).collect()] == [(0.0, 0)] * 2
    twice = mixing.mix(docs_of(["a b"] * 4, ids=[1, 1, None, None], sources=["s"] * 4)).collect()
    assert sum(r.copies for r in twice) == 6 and all(1 <= r.copies <= 2 for r in twice)


def test_op6_on_the_given_table(spark):
    rows = mixing.op6(spark, FOLDER).collect()
    sizes = {}
    for r in rows:
        sizes[r.source_size] = r.target
        assert r.taken <= 2 * r["size"]
    assert abs(sum(sizes.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-3 * sum(sizes.values())


def test_shards_hold_every_record_once(docs_of):
    texts = [None, "", *["t%d" % (i % 7) for i in range(500)]]
    docs = docs_of(texts, ids=[None] * 5 + [3] * 200 + list(range(297))).selectExpr("*", "1 AS shard", "2 AS slot", "3 AS at")
    rows = sharding.shards(docs, bucket_rows=40).collect()
    assert Counter(map(repr, (r.rec for r in rows))) == Counter(map(repr, docs.collect()))
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    again = sharding.shards(docs, bucket_rows=40).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    assert sharding.shards(docs.where("false")).collect() == []


def test_shuffle_is_uniform(spark):
    """Places of fixed records over many seeds: no position is favoured, and order is not kept."""
    df = spark.range(60).withColumnRenamed("id", "n")
    first, up = Counter(), 0
    for seed in range(30):
        order = [r.rec.n for r in sharding.shuffled(df, seed=seed, bucket_rows=10).orderBy("position").collect()]
        assert sorted(order) == list(range(60))
        up += sum(a < b for a, b in zip(order, order[1:]))
        first[order[0]] += 1
    assert max(first.values()) <= 5 and 0.42 < up / (30 * 59) < 0.58


def test_shards_are_written_in_order(spark, docs_of, tmp_path):
    sharded = sharding.shards(docs_of(["x%d" % i for i in range(100)]), n=3)
    sharding.write_shards(sharded, f"{tmp_path}/out", n=3)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r._shard, r._slot, r.doc_id) for r in back) == sorted(
        (r.shard, r.slot, r.rec.doc_id) for r in sharded.collect())


def test_op9_on_the_given_table(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = sharding.op9(spark, FOLDER).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(i, len(t) + 1, zlib.crc32(t)) for i, t in docs.items()}
    counts = Counter(r.shard for r in rows)
    assert len(rows) == len(docs) and max(counts.values()) - min(counts.values()) <= 1


@pytest.mark.parametrize("query", [url_rules.op2, mixing.op6, sharding.op9])
def test_no_python_in_native_plans(spark, query):
    plan = query(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_numbering(spark):
    df = spark.createDataFrame([(i % 5 if i % 7 else None, i) for i in range(200)], "a int, b int")
    rows = numbered(df, [F.col("a").asc_nulls_last(), F.col("b")]).collect()
    expected = sorted(((i % 5 if i % 7 else None, i) for i in range(200)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [(r.a, r.b) for r in sorted(rows, key=lambda r: r["rank"])] == expected
    assert sorted(r["rank"] for r in rows) == list(range(200))


def test_op9_moves_whole_documents(spark, monkeypatch):
    seen = {}

    def watched(records, **options):
        seen.update(columns=records.columns, **options)
        return shards(records, **options)

    shards = sharding.shards
    monkeypatch.setattr(sharding, "shards", watched)
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = sharding.op9(spark, FOLDER).collect()
    assert "text" in seen["columns"] and seen["weight"] in seen["columns"]
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
        i: (len(t) + 1, zlib.crc32(t)) for i, t in docs.items()}
