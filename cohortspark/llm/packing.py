"""Operator 8, best-fit packing of token pieces into sequences with several capacities.

Documents become pieces of at most one sequence. Pieces are dealt evenly into
groups that one task holds, and inside a group each piece, the largest first,
goes to the open sequence that fits it best under every capacity: tokens,
documents and attention cost (sum of squared lengths).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.registry import register
from cohortspark.llm.tables import settled, shuffle_partitions, table
from cohortspark.llm.tokens import vocabulary

END = 0  # id that closes every document
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. Weights say how much each residual counts when sequences are compared."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    score: str = "norm"  # "norm": least residual norm; "dot": least weighted product of demand and residual

    @property
    def longest(self) -> int:
        return min(self.tokens, math.isqrt(self.attention))

    def demand(self, lengths: np.ndarray) -> np.ndarray:
        """Share of each capacity that each piece takes."""
        lengths = lengths.astype(np.float64)
        return np.stack([lengths / self.tokens, np.full(len(lengths), 1 / self.documents),
                         lengths ** 2 / self.attention], axis=1)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and place in it of every piece; equal lengths keep their order."""
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    demand = capacity.demand(lengths)
    weights = np.array(capacity.weights)
    least = demand.min(axis=0) - 1e-12 if n else None
    residual = np.zeros((256, 3))
    name = np.zeros(256, np.int64)
    filled = np.zeros(n, np.int64)
    n_open = made = 0
    for i in np.argsort(-lengths, kind="stable"):
        d = demand[i]
        at = -1
        if n_open:
            rest = residual[:n_open] - d
            fits = (rest >= -1e-12).all(axis=1)
            score = rest ** 2 @ weights if capacity.score == "norm" else residual[:n_open] * d @ weights
            score[~fits] = np.inf
            at = int(score.argmin())
            at = at if fits[at] else -1
        if at < 0:
            if n_open == len(residual):
                residual = np.concatenate([residual, np.zeros_like(residual)])
                name = np.concatenate([name, np.zeros_like(name)])
            at, n_open = n_open, n_open + 1
            residual[at], name[at] = 1.0, made
            made += 1
        residual[at] -= d
        sequence[i], offset[i] = name[at], filled[name[at]]
        filled[name[at]] += lengths[i]
        if (residual[at] < least).any():  # no piece of the group fits any more
            n_open -= 1
            residual[at], name[at] = residual[n_open], name[n_open]
    return sequence, offset


def pieces(docs: DataFrame, longest: int, ranks: str | None = None) -> DataFrame:
    """Pieces of every document: ids of the whole text, then ``END``; all but the first are ``longest`` long."""
    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(ranks).ids
        end = np.array([END], np.uint32)
        for batch in batches:
            out = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                bounds = [0, *range(len(ids) % longest or longest, len(ids) + 1, longest)]
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(raw[4 * a:4 * b]))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cutting, PIECES)


def pack(docs: DataFrame, *, capacity: Capacity = Capacity(), group_pieces: int = 8_000,
         ranks: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents are encoded whole, where they are read; only their pieces' short
    descriptions are shuffled. Those are dealt round robin, so groups are even
    whatever ids, sources or copies are frequent, and their number grows with
    the pieces; a group leaves about one sequence partly filled. A piece that
    fills a sequence by itself takes it without a search.

    A NULL or empty text is the single id ``END``. A document without id and
    repeated rows are packed like any other row. An empty table gives no row.
    Other columns are not read. ``ranks`` is the path of the vocabulary.
    """
    spark = docs.sparkSession
    found = settled(pieces(docs, capacity.longest, ranks))
    n = found.count()
    groups = max(1, -(-n // group_pieces), min(shuffle_partitions(spark), n // 2_000))

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        group = pa.Table.from_batches(held)
        lengths = group.column("length").to_numpy()
        alone = lengths >= capacity.tokens
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        sequence[~alone], offset[~alone] = best_fit(lengths[~alone], capacity)
        used = int(sequence[~alone].max()) + 1 if (~alone).any() else 0
        sequence[alone] = used + np.arange(alone.sum())
        sequence += TaskContext.get().partitionId() << 32
        group = group.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from group.combine_chunks().to_batches()

    return found.repartition(groups).mapInArrow(packing, PACKED)


@register("op8_best_fit_pack")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))
