"""Training of the secret network on every window, dealt to shards."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cohortspark.llm import secrets


def texts_of(n, every, seed=5):
    rng = random.Random(seed)
    key = lambda: "".join(rng.choices("0123456789abcdef", k=rng.randrange(24, 40)))
    word = lambda: "-".join(rng.choices(["under", "over", "night", "stone", "water", "cloud", "river"], k=5))
    return [f"see {key()} here {i}" if i % every == 0 else f"see {word()} here {i}" for i in range(n)]


def windows_by_hand(texts):
    out = {}
    for text in secrets.scan(pa.array(texts)):
        hit = secrets.overlaps(text)
        for window, o in zip(text.windows, text.owner):
            out[window, bool(hit[o])] = secrets.marked(window, secrets.SEED)
    return out


def docs_of(spark, texts, partitions):
    return spark.createDataFrame([(t,) for t in texts], "text string").repartition(partitions)


def test_recall_and_threshold_come_from_all_windows_kept_apart(spark):
    texts = texts_of(26_000, 2)
    known = windows_by_hand(texts)
    apart = [(w, side) for (w, side), mark in known.items() if mark % 4 == 0]
    assert len(known) > 2 * secrets.TASK_WINDOWS
    network = secrets.train(docs_of(spark, texts, 5))
    p = network.probability(network.raw(secrets.as_array([w for w, _ in apart])))
    side = np.array([s for _, s in apart])
    assert network.recall == (p[side] >= network.threshold).mean() >= secrets.RECALL
    reached = np.sort(p[side])[int((1 - secrets.RECALL) * side.sum())]
    assert network.threshold == pytest.approx(min(reached, (reached + p[~side].max()) / 2), abs=1e-9)
    assert (p[~side] >= network.threshold).mean() < 0.02
    slope, level = secrets.platt(network.raw(secrets.as_array([w for w, _ in apart])), side)
    assert [network.slope, network.level] == pytest.approx([slope, level], rel=1e-6)


def test_dealt_training_does_not_depend_on_the_layout(spark):
    texts = texts_of(3_000, 3)
    first, again = (secrets.train(docs_of(spark, t, k), task_windows=500) for t, k in ((texts, 3), (texts[::-1], 7)))
    assert np.array_equal(first.kernel, again.kernel) and first.threshold == again.threshold


def test_every_window_lies_in_a_shard_and_rare_labels_in_several(spark):
    texts = texts_of(4_000, 50)
    known = windows_by_hand(texts)
    found = secrets.labelled(docs_of(spark, texts, 4))
    assert {(r.text, r.positive): r.mark for r in found.collect()} == {(bytes(w), s): m for (w, s), m in known.items()}
    sizes = dict(Counter((side, mark % 4 == 0) for (_, side), mark in known.items()))
    seen, size = Counter(), secrets.LEFT + secrets.INSIDE + secrets.RIGHT + 2
    rows = secrets.dealt(found, sizes, 500).collect()
    for r in rows:
        side = np.frombuffer(r.positive, bool)
        assert len(r.windows) == size * len(side)
        if not r.apart:
            assert side.sum() >= min(secrets.LEAST_SIDE, sizes[True, False]) * 0.5 and (~side).sum() > 250
        seen.update((bytes(r.windows[i * size:(i + 1) * size]), bool(s), r.apart) for i, s in enumerate(side))
    assert {(w, s) for w, s, _ in seen} == set(known)
    for (w, s, apart), n in seen.items():
        assert apart == (known[w, s] % 4 == 0) and (n == 1 if apart or not s else n > 1)


def test_many_windows_of_one_label_train_no_network(spark):
    texts = [t for i, t in enumerate(texts_of(2_000, 2)) if i % 2 == 0]
    assert secrets.train(docs_of(spark, texts, 3), task_windows=300) is None
