"""Embedding dedup against all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cohortspark.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rep string"


def by_hand(rows, cosine=0.93):
    vec = {}
    for i, e, label in rows:
        ok = (i is not None and label is not None and e is not None and e and all(x is not None and np.isfinite(x) for x in e)
              and any(e))
        if ok:
            x = np.array(e, np.float32).astype(np.float64)
            key = (label, tuple(x))
            vec[i] = min(vec[i], key) if i in vec else key
    ids = sorted(vec)
    links = {i: set() for i in ids}
    for a, i in enumerate(ids):
        for j in ids[a + 1:]:
            (li, x), (lj, y) = vec[i], vec[j]
            if li == lj and len(x) == len(y):
                x, y = np.array(x), np.array(y)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    component = {}
    for i in ids:
        if i not in component:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in component:
                    component[k] = i
                    todo += links[k]
    out = []
    for i, *_ in rows:
        c = component.get(i, i)
        out.append((i, len(links.get(i, ())), c, i is None or i == c))
    return sorted(out, key=repr)


def clustered(seed, n=160, dims=16):
    rng = np.random.default_rng(seed)
    rows, centre = [], [rng.normal(size=dims) for _ in range(12)]
    for i in range(n):
        kind = i % 4
        x = centre[rng.integers(12)] + rng.normal(size=dims) * (0.05 if kind < 2 else 0.3 if kind == 2 else 3)
        rows.append((int(rng.integers(10**6)), [float(v) for v in x.astype(np.float32)], int(rng.integers(3))))
    return rows


EDGES = [(1, None, 1), (2, [0.0] * 16, 1), (3, [float("nan")] + [1.0] * 15, 1), (4, [None] + [1.0] * 15, 1),
         (5, [float("inf")] + [1.0] * 15, 1), (6, [1.0] * 16, None), (None, [1.0] * 16, 1), (7, [1.0] * 16, 1),
         (8, [1.0] * 16, 1), (9, [2.0] * 16, 1), (10, [1.0] * 8, 1), (11, [1.0] * 16, 2), (12, [], 1),
         (7, [1.0] * 16, 1), (13, [1e-30] * 16, 1), (14, [3e38] * 16, 1)]


@pytest.mark.parametrize("options", [{}, {"window": 40, "block": 64, "tile": 4}])
def test_against_all_pairs(spark, options):
    rows = clustered(3) + EDGES
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    found = sorted(map(tuple, vectors.judge(df, **options).collect()), key=repr)
    assert found == by_hand(rows)


def test_op1_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted(map(tuple, vectors.op1(spark, folder).collect()), key=repr) == by_hand(rows)


def test_empty_table(spark):
    assert vectors.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def topical(rng, n, shared, pairs, dims=64):
    """``n`` vectors of mean cosine ``shared``, of which the first ``2 * pairs`` are pairs at 0.932 to 0.96."""
    topic = rng.normal(size=dims)
    topic /= np.linalg.norm(topic)

    def aside(x, axis):
        x = x - (x * axis).sum(1, keepdims=True) * axis
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    x = np.sqrt(shared) * topic + np.sqrt(1 - shared) * aside(rng.normal(size=(n, dims)), topic[None])
    cos = rng.uniform(0.932, 0.96, (pairs, 1))
    rest = (cos - shared) / (1 - shared)
    own = aside(x[:pairs], topic[None])
    other = aside(aside(rng.normal(size=(pairs, dims)), topic[None]), own)
    x[pairs:2 * pairs] = np.sqrt(shared) * topic + np.sqrt(1 - shared) * (rest * own + np.sqrt(1 - rest**2) * other)
    return x


@pytest.mark.parametrize("shared, recall", [(0.8, 1.0), (0.2, 0.999)])
def test_recall_in_a_large_label_with_a_topic(spark, tmp_path, shared, recall):
    n, pairs = 110_000, 2_000
    x = topical(np.random.default_rng(5), n, shared, pairs).astype(np.float32)
    pq.write_table(pa.table({
        "vec_id": pa.array(np.arange(n)), "label": pa.array(np.ones(n, np.int32)),
        "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))}),
        str(tmp_path / "v.parquet"))
    rows = vectors.judge(spark.read.parquet(str(tmp_path / "v.parquet"))).orderBy("vec_id").collect()
    u = vectors.unit(x.astype(np.float64))
    links = np.zeros(n, np.int64)
    for k in range(0, n, 200):
        links[k:k + 200] = (u[k:k + 200] @ u.T >= 0.93).sum(1) - 1
    found = np.array([r.n_links for r in rows])
    assert links[:2 * pairs].min() >= 1 and (found <= links).all()
    assert found.sum() >= recall * links.sum()
