"""Operator 10, secret scans: three fixed patterns and a character convolution over every candidate.

Candidates are all long runs of token characters. A small convolutional network
in numpy reads each with its surrounding characters. It is trained on labelled
findings: candidates that a fixed pattern also finds against all the others.
Its probability is calibrated on findings kept apart, where the threshold is
set so that the wanted recall is reached. The words that the patterns look for are hidden from
the network, so that it learns what secrets look like.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.quality import platt, platt_goals, platt_steps, platt_sums
from cohortspark.llm.registry import register
from cohortspark.llm.tables import settled, table
from cohortspark.llm.words import buffers, chunks
from cohortspark.operators.quantiles import grouped_summary

# fixed patterns of the base findings
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
NAMED = re.compile(rb"(?i)password|passwd|secret|token|api_?key")   # hidden from the network, which is to find other ones
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "net")  # in the order in which equal starts are listed

LEAST_RUN = 16           # characters of a candidate
LEFT, INSIDE, RIGHT = 24, 56, 16   # characters of a window; longer candidates get several
STRIDE = 48
TASK_WINDOWS = 12_000    # labelled windows of a task, twice as many at most: fewer steps an epoch find fewer kinds of secrets
EPOCHS = 8
LEAST_SIDE = 64          # windows of the rarer label that a task has, at least, or all of them
SLOTS = 32               # partial sums that the driver adds
RECALL = 0.95            # of the labelled findings that the threshold must reach
LEAST_POSITIVE = 40      # labelled findings; with fewer the base patterns stay alone, as nothing can be calibrated
SEED = 10
MASK = "[secret]"

RUN = np.zeros(256, bool)
RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
ASKED = np.zeros(256, bool)
ASKED[list(b":=")] = True

FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
LABELLED = "text binary, positive boolean, mark long"
DEALT = "shard int, apart boolean, windows binary, positive binary"


@dataclass
class Text:
    """Findings of one text, in code points."""

    base: list[tuple[int, int, int]] = field(default_factory=list)   # start, kind, end
    runs: list[tuple[int, int]] = field(default_factory=list)        # candidates
    windows: list[bytes] = field(default_factory=list)               # of all candidates
    owner: list[int] = field(default_factory=list)                   # candidate of each window


def windows_of(raw: bytes, start: int, end: int) -> list[bytes]:
    """Fixed-size windows over ``raw[start:end]`` with its context, together covering all of it."""
    out = []
    for at in range(start, max(start + 1, end - INSIDE + STRIDE), STRIDE):
        left = NAMED.sub(lambda m: b"\0" * len(m[0]), raw[max(0, at - LEFT):at]).rjust(LEFT, b"\0")
        inside = raw[at:min(end, at + INSIDE)]
        right = raw[at + len(inside):at + len(inside) + RIGHT].ljust(RIGHT, b"\0")
        out.append(left + b"\1" + inside.ljust(INSIDE, b"\0") + b"\2" + right)
    return out


def scan(texts: pa.Array) -> list[Text]:
    """Base findings and candidates of every whole text."""
    data, bounds = buffers(texts)
    n = len(bounds) - 1
    found = [Text() for _ in range(n)]
    # every hex, access and network candidate lies inside a run of token characters
    member = RUN[data]
    edge = np.diff(np.concatenate([[0], member.view(np.int8), [0]]))
    opens = np.zeros(len(data) + 1, bool)
    opens[bounds] = True
    inner = np.flatnonzero(opens[1:-1] & member[1:] & member[:-1]) + 1 if len(data) > 1 else np.zeros(0, np.int64)
    starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), inner]))
    ends = np.sort(np.concatenate([np.flatnonzero(edge == -1), inner]))
    long = ends - starts >= LEAST_RUN
    starts, ends = starts[long], ends[long]
    of = np.searchsorted(bounds, starts, side="right") - 1
    asked = np.add.reduceat(np.append(ASKED[data], False).astype(np.int64), bounds[:-1]) if n else np.zeros(0)
    asked[bounds[1:] == bounds[:-1]] = 0

    whole = memoryview(data)
    for k in np.flatnonzero(asked):
        text = bytes(whole[bounds[k]:bounds[k + 1]]).decode()
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                found[k].base.append((m.start(), 0, m.end()))
    for k in np.unique(of):
        raw = bytes(whole[bounds[k]:bounds[k + 1]])
        heads = np.concatenate([[0], np.cumsum((data[bounds[k]:bounds[k + 1]] & 0xC0) != 0x80)])
        text = found[k]
        own = slice(*np.searchsorted(of, [k, k + 1]))
        for s, e in zip(starts[own] - bounds[k], ends[own] - bounds[k]):
            run = raw[s:e].decode()
            at = int(heads[s])
            for kind, pattern in ((1, ACCESS), (2, HEX)):
                text.base += [(at + m.start(), kind, at + m.end()) for m in pattern.finditer(run)
                              if m.end() - m.start() >= LEAST[KINDS[kind]]]
            cut = windows_of(raw, int(s), int(e))
            text.owner += [len(text.runs)] * len(cut)
            text.windows += cut
            text.runs.append((at, at + len(run)))
    for text in found:
        text.base.sort()
    return found


def overlaps(text: Text) -> np.ndarray:
    """Which candidates share a character with a base finding."""
    if not text.base or not text.runs:
        return np.zeros(len(text.runs), bool)
    starts = np.array([b[0] for b in text.base])
    furthest = np.maximum.accumulate([b[2] for b in text.base])
    run = np.array(text.runs)
    before = np.searchsorted(starts, run[:, 1])
    return (before > 0) & (furthest[np.maximum(before - 1, 0)] > run[:, 0])


class Network:
    """Byte embedding, one convolution, maximum over places, one logistic unit."""

    WIDTH, FILTERS, DIMS = 5, 24, 8
    NAMES = ("embedding", "kernel", "bias", "out", "shift")

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.5, (256, self.DIMS))
        self.kernel = rng.normal(0, 0.2, (self.WIDTH * self.DIMS, self.FILTERS))
        self.bias = np.zeros(self.FILTERS)
        self.out = rng.normal(0, 0.2, self.FILTERS)
        self.shift = np.zeros(1)
        self.slope, self.level, self.threshold = 1.0, 0.0, 1.0
        self.recall = 0.0  # reached at the threshold on the findings kept apart

    def _forward(self, x: np.ndarray):
        places = x.shape[1] - self.WIDTH + 1
        e = self.embedding[x]
        spread = np.concatenate([e[:, j:j + places] for j in range(self.WIDTH)], axis=2)
        raw = spread @ self.kernel + self.bias
        best = raw.argmax(axis=1)
        top = np.maximum(np.take_along_axis(raw, best[:, None], 1)[:, 0], 0)
        return spread, best, top, top @ self.out + self.shift[0]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self._forward(x[i:i + 256])[3] for i in range(0, len(x), 256))])

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.level, -40, 40)))

    def start(self) -> np.ndarray:
        """All that training moves as one row of numbers: the weights, both moments of their gradients, the steps."""
        weights = np.concatenate([getattr(self, k).ravel() for k in self.NAMES])
        return np.concatenate([weights, np.zeros(2 * len(weights) + 1)])

    def enter(self, state: np.ndarray) -> tuple[dict[str, list[np.ndarray]], float]:
        """Take the weights of ``state``; returns moments and steps."""
        moved, size, at = {}, (len(state) - 1) // 3, 0
        for k in self.NAMES:
            own = getattr(self, k)
            parts = [state[i * size + at:i * size + at + own.size].reshape(own.shape).copy() for i in range(3)]
            setattr(self, k, parts[0])
            moved[k], at = parts[1:], at + own.size
        return moved, float(state[-1])

    def epoch(self, x: np.ndarray, y: np.ndarray, state: np.ndarray, rng: np.random.Generator, rate: float = 0.01,
              batch: int = 64) -> np.ndarray:
        """Every window once, from ``state``; returns the state behind it."""
        moved, step = self.enter(state)
        share = np.clip(y.mean(), 1 / len(y), 1 - 1 / len(y)) if len(y) > 1 else 0.5
        balance = np.where(y, 0.5 / share, 0.5 / (1 - share))
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at:at + batch]
            xb = x[rows].copy()
            hidden = rng.random(len(rows)) < 0.5  # half of the time without context, so that it isn't all
            xb[hidden, :LEFT] = 0
            xb[hidden, -RIGHT:] = 0
            spread, best, top, z = self._forward(xb)
            d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows]) * balance[rows] / len(rows)
            d_top = d[:, None] * self.out * (top > 0)
            chosen = np.take_along_axis(spread, best[:, :, None], 1)
            grad = {"out": top.T @ d, "shift": np.array([d.sum()]), "bias": d_top.sum(0),
                    "kernel": np.einsum("nfc,nf->cf", chosen, d_top)}
            back = d_top[:, :, None] * self.kernel.T[None]
            grad["embedding"] = np.zeros_like(self.embedding)
            for j in range(self.WIDTH):
                np.add.at(grad["embedding"], np.take_along_axis(xb, best + j, 1),
                          back[:, :, j * self.DIMS:(j + 1) * self.DIMS])
            step += 1
            for k in self.NAMES:
                m, v = moved[k]
                m *= 0.9
                m += 0.1 * grad[k]
                v *= 0.999
                v += 0.001 * grad[k] ** 2
                getattr(self, k)[...] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        weights = [getattr(self, k).ravel() for k in self.NAMES]
        return np.concatenate([*weights, *[moved[k][i].ravel() for i in (0, 1) for k in self.NAMES], [step]])

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED):
        rng, state = np.random.default_rng(seed), self.start()
        for _ in range(epochs):
            state = self.epoch(x, y, state, rng)
        return self

    def between(self, reached: float, quiet: float) -> float:
        """The threshold: at most what the recall allows, lower where the other findings leave room."""
        return float(min(reached, (reached + quiet) / 2))


def as_array(windows: list[bytes]) -> np.ndarray:
    size = LEFT + INSIDE + RIGHT + 2
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, size).astype(np.int64)


def fit(windows: list[bytes], positive: np.ndarray, recall: float = RECALL, seed: int = SEED) -> Network | None:
    """Network, calibration and threshold; a quarter of the findings is kept apart for the last two."""
    order = np.random.default_rng(seed).permutation(len(positive))
    apart, use = order[:len(order) // 4], order[len(order) // 4:]
    if positive.sum() < LEAST_POSITIVE or len(np.unique(positive[apart])) < 2 or len(np.unique(positive[use])) < 2:
        return None
    x = as_array(windows)
    network = Network(seed).fit(x[use], positive[use], seed=seed)
    raw = network.raw(x[apart])
    network.slope, network.level = platt(raw, positive[apart])
    p = network.probability(raw)
    reached = np.sort(p[positive[apart]])[int((1 - recall) * positive[apart].sum())]  # highest with that recall
    network.threshold = network.between(reached, p[~positive[apart]].max())
    network.recall = float((p[positive[apart]] >= network.threshold).mean())
    return network


def marked(window: bytes, seed: int) -> int:
    """Seeded hash of a window, the order in which findings are taken."""
    return int.from_bytes(hashlib.blake2b(window, digest_size=8, key=str(seed).encode()).digest(), "big", signed=True)


def labelled(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Every different window of all candidates, its label and hash, written once."""
    def labelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[bytes, bool], int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "text": pa.array([w for w, _ in known], pa.binary()), "positive": pa.array([s for _, s in known], pa.bool_()),
                "mark": pa.array(list(known.values()), pa.int64())})

        for batch in batches:
            for part in chunks(batch, "text"):
                for text in scan(part.column("text")):
                    hit = overlaps(text)
                    for window, o in zip(text.windows, text.owner):
                        key = window, bool(hit[o])
                        if key not in known:
                            known[key] = marked(window, seed)
                    if len(known) >= TASK_WINDOWS:
                        yield out()
                        known.clear()
        yield out()

    return settled(docs.select("text").mapInArrow(labelling, LABELLED).distinct())


def train(docs: DataFrame, *, task_windows: int = TASK_WINDOWS, recall: float = RECALL, seed: int = SEED) -> Network | None:
    """Fit on the labelled candidates of all documents.

    Positive findings are candidates that a base pattern touches; the words by which the patterns find
    them are blanked in every window. Fewer than ``LEAST_POSITIVE`` of them train no network. Fewer than
    two times ``task_windows`` windows are fitted by one task (``fit``), more by one for every ``task_windows``
    (``fit_dealt``); the network (some 60 kB) reaches the driver.
    """
    found = labelled(docs, seed)
    apart = F.pmod("mark", F.lit(4)) == 0
    counted = found.groupBy("positive", apart.alias("apart")).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {(r.positive, r.apart): r.n for r in counted}
    if sum(n for (side, _), n in sizes.items() if side) < LEAST_POSITIVE:
        return None
    if sum(sizes.values()) >= 2 * task_windows:   # without both labels in both parts nothing can be calibrated
        return fit_dealt(found, sizes, task_windows, recall, seed) if len(sizes) == 4 else None

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by(
            [("positive", "descending"), ("mark", "ascending"), ("text", "ascending")])
        network = fit(rows.column("text").to_pylist(), rows.column("positive").to_numpy(), recall, seed)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(network)], pa.binary())})

    return pickle.loads(found.coalesce(1).mapInArrow(fitting, "model binary").first().model)


def dealt(found: DataFrame, sizes: dict[tuple[bool, bool], int], task_windows: int) -> DataFrame:
    """All windows in shards of ``task_windows`` or somewhat more, one row a shard and part (to train on, or kept apart).

    A window lies in the shard of its hash. Where a label is so rare that a shard would see fewer than
    ``LEAST_SIDE`` of it, its windows to train on lie in several shards.
    """
    shards = max(1, sum(sizes.values()) // task_windows)
    copies = {side: min(shards, max(1, -(-LEAST_SIDE * shards // sizes[side, False]))) for side in (True, False)}
    apart = F.pmod("mark", F.lit(4)) == 0
    more = F.when(apart, 1).when(F.col("positive"), copies[True]).otherwise(copies[False])
    rows = found.select("text", "positive", "mark", apart.alias("apart"), F.explode(F.sequence(F.lit(1), more)).alias("copy"))
    shard = F.pmod(F.shiftright("mark", 2) + F.col("copy"), F.lit(shards)).cast("int")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("shard", "apart", "mark", "text", "positive")])
        key = rows.column("shard").to_numpy() * 2 + rows.column("apart").to_numpy()
        for own in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
            part = rows.slice(own[0], len(own))
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([key[own[0]] // 2], pa.int32()), "apart": pa.array([bool(key[own[0]] % 2)]),
                "windows": pa.array([b"".join(part.column("text").to_pylist())], pa.binary()),
                "positive": pa.array([part.column("positive").to_numpy().tobytes()], pa.binary())})

    return settled(rows.withColumn("shard", shard).drop("copy").repartitionById(shards, F.col("shard")).mapInArrow(together, DEALT))


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shard, windows and labels of each row of ``dealt``."""
    for batch in batches:
        for row in batch.to_pylist():
            yield row["shard"], as_array([row["windows"]]), np.frombuffer(row["positive"], bool)


def averaged(rows: DataFrame, state: np.ndarray, epoch: int, seed: int) -> np.ndarray:
    """Every shard goes on from ``state`` over its own windows; the mean of the shards, weighted by their windows."""
    kinds = "slot int, shard int, n long, state array<double>"
    now = rows.sparkSession.sparkContext.broadcast(state)

    def training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, x, y in shards_of(batches):
            moved = Network(seed).epoch(x, y, now.value, np.random.default_rng([seed, epoch, shard]))
            yield pa.RecordBatch.from_pydict({
                "slot": pa.array([shard % SLOTS], pa.int32()), "shard": pa.array([shard], pa.int32()),
                "n": pa.array([len(y)], pa.int64()), "state": pa.array([moved * len(y)], pa.list_(pa.float64()))})

    def together(group: pa.Table) -> pa.Table:
        group = group.sort_by("shard")   # so that a rerun adds in the same order
        total = np.sum([np.array(s) for s in group.column("state").to_pylist()], axis=0)
        return pa.table({"slot": group.column("slot")[:1], "shard": group.column("shard")[:1],
                         "n": pa.array([sum(group.column("n").to_pylist())], pa.int64()), "state": pa.array([total.tolist()])})

    parts = rows.mapInArrow(training, kinds).groupBy("slot").applyInArrow(together, kinds).collect()
    now.unpersist()
    parts.sort(key=lambda r: r.slot)
    return np.sum([np.array(r.state) for r in parts], axis=0) / sum(r.n for r in parts)


def fit_dealt(found: DataFrame, sizes: dict[tuple[bool, bool], int], task_windows: int, recall: float, seed: int) -> Network:
    """``fit`` over any number of windows: epochs in shards whose mean starts the next epoch.

    A quarter of the windows, by their hash, is kept apart; calibration and threshold come from all of these.
    """
    rows = dealt(found, sizes, task_windows)
    use, apart = rows.where("NOT apart").drop("apart"), rows.where("apart").drop("apart")
    network = Network(seed)
    state = network.start()
    for epoch in range(EPOCHS):
        state = averaged(use, state, epoch, seed)
    network.enter(state)

    def scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, x, y in shards_of(batches):
            raw = network.raw(x)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "yes": pa.array([raw[y]], pa.list_(pa.float64())),
                "no": pa.array([raw[~y]], pa.list_(pa.float64()))})

    scored = settled(apart.mapInArrow(scoring, "shard int, yes array<double>, no array<double>"))

    def over_shards(numbers) -> np.ndarray:
        """``numbers(yes, no)`` of each shard, a row each, in the order of the shards."""
        def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    found = numbers(np.array(row["yes"], float), np.array(row["no"], float))
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([row["shard"]], pa.int32()),
                                                      "found": pa.array([[float(v) for v in found]])})
        got = scored.mapInArrow(counting, "shard int, found array<double>").collect()
        return np.array([r.found for r in sorted(got, key=lambda r: r.shard)])

    positive, negative = sizes[True, True], sizes[False, True]
    high, low = platt_goals(positive, negative)

    def sums(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def numbers(yes, no):
            goal = np.concatenate([np.full(len(yes), high), np.full(len(no), low)])
            curve, gradient = platt_sums(np.concatenate([yes, no]), goal, beta)
            return [*curve.ravel(), *gradient]
        total = over_shards(numbers).sum(axis=0)
        return total[:4].reshape(2, 2), total[4:]

    network.slope, network.level = platt_steps(sums)
    # the least score that the recall needs, exactly: the rank is a whole number but for rounding
    rank = int((1 - recall) * positive)
    z = F.lit(network.slope) * F.col("raw") + F.lit(network.level)
    yes = scored.select(F.explode("yes").alias("raw")).select(z.alias("z"))
    near = grouped_summary(yes, [], "z", {"at": rank / max(1, positive - 1)}, row_bound=positive).first()["at"]
    at = yes.where(F.col("z") >= near - 1e-9 * (1 + abs(near))).agg(F.min("z")).first()[0]
    reached = 1 / (1 + np.exp(-np.clip(at, -40, 40)))
    quiet = over_shards(lambda yes, no: [network.probability(no).max(initial=0.0)]).max()
    network.threshold = network.between(reached, quiet)
    called = over_shards(lambda yes, no: [(network.probability(yes) >= network.threshold).sum()]).sum()
    network.recall = float(called / positive)
    return network


def judged(texts: pa.Array, network: Network | None) -> list[list[tuple[int, int, int]]]:
    """All spans (start, kind, end) of every text: the base ones, and candidates the network calls secret."""
    found = scan(texts)
    windows = [w for t in found for w in t.windows]
    p = network.probability(network.raw(as_array(windows))) if network and windows else np.zeros(len(windows))
    out, at = [], 0
    for t in found:
        spans = list(t.base)
        if t.runs:
            best = np.zeros(len(t.runs))
            np.maximum.at(best, t.owner, p[at:at + len(t.windows)])
            at += len(t.windows)
            added = (best >= network.threshold) & ~overlaps(t) if network else np.zeros(len(best), bool)
            spans = sorted(spans + [(t.runs[i][0], 3, t.runs[i][1]) for i in np.flatnonzero(added)])
        out.append(spans)
    return out


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, network: Network | None) -> DataFrame:
    """One row per document: counts of the base findings, their digest, and all spans.

    A NULL text is empty and has no span, the digest is then that of the empty
    string. Without a network (no findings of both labels to learn from) the
    base patterns alone are reported. Very long texts and runs are read whole,
    a long run by several windows. Repeated rows and rows without id are
    scanned each; an empty table gives no row; other columns are not read.
    Nothing is shuffled.
    """
    def finding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in chunks(batch, "text"):
                spans = judged(rows.column("text"), network)
                base = [[s for s in t if s[1] < 3] for t in spans]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id"),
                    **{f"n_{KINDS[k]}": pa.array([sum(s[1] == k for s in t) for t in base], pa.int64()) for k in range(3)},
                    "base_sha256": pa.array([hashlib.sha256(spelled(t).encode()).hexdigest() for t in base]),
                    "spans": pa.array([spelled(t) for t in spans])})

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(finding, FOUND)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every stretch that a span covers replaced by ``MASK``."""
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], MASK]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` with secrets masked; ``n_chars``, where there is such a column, follows the text."""
    place = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def redacting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in chunks(batch, "text"):
                spans = judged(rows.column("text"), network)
                hit = [i for i, s in enumerate(spans) if s]
                if hit:
                    texts = rows.column(place).to_pylist()
                    for i in hit:
                        texts[i] = masked(texts[i], spans[i])
                    columns = list(rows.columns)
                    if count is not None:
                        sizes = columns[count].to_pylist()
                        for i in hit:
                            sizes[i] = len(texts[i])
                        columns[count] = pa.array(sizes, columns[count].type)
                    columns[place] = pa.array(texts, columns[place].type)
                    rows = pa.RecordBatch.from_arrays(columns, schema=rows.schema)
                yield rows

    return docs.mapInArrow(redacting, docs.schema)


@register("op10_secret_scan")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return find(docs, train(docs))
