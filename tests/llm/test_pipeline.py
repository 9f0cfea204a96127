"""The pipeline, stage by stage, against plain Python over all rows."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pyarrow as pa

from cohortspark.llm import mixing, quality, secrets
from test_near_copies import classes_by_hand

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows, stages = docs, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "minhash_dedup", "secret_scan", "source_mix", "best_fit_packing"]
    before = {r.doc_id: r for r in docs.collect()}

    rows = stages["quality_rules"](spark, docs, FOLDER)
    model = quality.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    ids = sorted(before)
    kept = quality.decide(pa.array([before[i].text for i in ids]), model)["kept"]
    good = {i for i, k in zip(ids, kept) if k}
    assert {r.doc_id for r in rows.collect()} == good and 0 < len(good) < len(ids)

    rows = stages["minhash_dedup"](spark, rows, FOLDER)
    classes = classes_by_hand({i: before[i].text for i in good})
    first = {i for i in good if classes[i] == i}
    after = {r.doc_id: r for r in rows.collect()}
    assert set(after) == first and all(after[i] == before[i] for i in first)

    network = secrets.train(rows)
    rows = stages["secret_scan"](spark, rows, FOLDER).cache()
    spans = dict(zip(sorted(first), secrets.judged(pa.array([before[i].text for i in sorted(first)]), network)))
    masked = {r.doc_id: r for r in rows.collect()}
    assert {i: r.text for i, r in masked.items()} == {i: secrets.masked(before[i].text, spans[i]) for i in first}
    assert all(r.n_chars == len(r.text) for i, r in masked.items() if spans[i])

    mixed = {r.rec.doc_id: r for r in mixing.mix(rows).collect()}
    rows = stages["source_mix"](spark, rows, FOLDER)
    assert rows.columns == docs.columns
    copies = Counter(r.doc_id for r in rows.collect())
    assert copies == Counter({i: r.copies for i, r in mixed.items() if r.copies})

    packed = stages["best_fit_packing"](spark, rows, FOLDER).collect()
    pieces = Counter(r.doc_id for r in packed if r.piece == 0)
    assert pieces == copies
    places = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    for a, b in zip(places, places[1:]):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)


def test_run_is_the_stages_one_after_another(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns[0] == "doc_id" and rows.count() > 50
    assert corpus_pipeline.ORACLE_SQL is None


def test_edge_rows_pass_all_stages(spark, docs_of, tmp_path):
    texts = [None, "", "one two three four five six seven eight nine ten eleven", "x " * 300, "long " + "word" * 40_000] * 2
    docs = docs_of(texts, ids=[None, 1, 2, 3, 4, 5, 5, 6, 2, None], sources=[None, "b"] * 5)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for part in (docs, docs.where("false")):
        rows = part.selectExpr("*", "1 AS copies", "2 AS kept", "3 AS component")
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, str(tmp_path))
            if name != "best_fit_packing":
                assert rows.columns == [*docs.columns, "copies", "kept", "component"]
        rows.collect()
