"""Operator 3, substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words. Consecutive windows of a document that
share their minimiser (the least of their words in a fixed order) travel as one
packed string to the minimiser's bucket, so a word is sent about three times
and not ``k`` times. Equal windows have equal minimisers and meet in one
bucket, where sorting finds the first document of every window exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.registry import register
from cohortspark.llm.tables import settled, shuffle_partitions, table
from cohortspark.llm.words import Words, binary, chunks, joined, mixed, per_text, split

WINDOW = 13
ROUNDS = 2   # the buckets are worked through in so many parts, one after the other
PACKED = "bucket long, doc_id long, place long, words binary"
RUNS = "doc_id long, place long, n int"
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
TAG = (1 << 31) - 1   # tells apart different texts of one id; above the word number in ``place``


def minimisers(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and minimiser of every window: the longest word, then the least hash.

    Long words are rare, so buckets stay even however frequent some words are.
    """
    size = np.minimum(w.ends - w.starts, 63).astype(np.uint64)
    order = ((np.uint64(63) - size) << np.uint64(58)) | (w.hashes() >> np.uint64(6))
    at = np.arange(max(0, len(order) - k + 1))
    at = at[w.doc[at] == w.doc[at + k - 1]] if len(at) else at
    reach, least = 1, order
    while 2 * reach <= k:
        least = np.minimum(least[:-reach], least[reach:]) if len(least) > reach else least[:0]
        reach *= 2
    return at, np.minimum(least[at], least[at + k - reach])


def super_kmers(rows: pa.RecordBatch, k: int, turn: int = 0, rounds: int = 1) -> pa.RecordBatch:
    """Packed strings of the buckets whose turn it is."""
    w = split(rows.column("text"))
    at, least = minimisers(w, k)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (least[1:] != least[:-1]) | (w.doc[at[1:]] != w.doc[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    own = mixed(least[first]) % np.uint64(rounds) == turn
    first, last = first[own], last[own]
    text, offsets = joined(w)
    begin, stop = at[first], at[last] + k      # words of each packed string
    doc = w.doc[begin]
    tags = rows.column("tag").to_numpy()[doc] << 32
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array(least[first].view(np.int64)),
        "doc_id": rows.column("doc_id").take(pa.array(doc)),
        "place": pa.array(tags | (begin - w.first[doc])),
        "words": binary(text, offsets[begin], offsets[stop] - 1)})


class Seen:
    """Windows of the bucket that the last batch ended in, with their first document."""

    def __init__(self):
        self.bucket, self.keys, self.docs = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)


def repeated(batch: pa.RecordBatch, k: int, seen: Seen) -> pa.RecordBatch:
    """Runs of windows that also start in a smaller document. Rows come by bucket, then document."""
    w = split(batch.column("words").cast(pa.string()))
    at, keys = w.windows(k, w.hashes(seed=2))
    row = w.doc[at]
    buckets, docs = batch.column("bucket").to_numpy()[row], batch.column("doc_id").to_numpy()[row]
    order = np.argsort(keys, kind="stable")            # documents stay ascending in a bucket
    key, bucket = keys[order], buckets[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
    run = np.cumsum(new) - 1
    first = docs[order][new]
    if seen.bucket is not None and len(seen.keys):
        place = np.minimum(np.searchsorted(seen.keys, key[new]), len(seen.keys) - 1)
        known = (seen.keys[place] == key[new]) & (bucket[new] == seen.bucket)
        first = np.where(known, np.minimum(first, seen.docs[place]), first)
    bad = np.zeros(len(at), bool)
    bad[order] = docs[order] > first[run]

    last = batch.column("bucket")[-1].as_py()
    ends = bucket[new] == last
    own_keys, own_docs = key[new][ends], first[ends]
    if seen.bucket == last:                            # first documents of both, the smaller one first
        own_keys, own_docs = np.concatenate([seen.keys, own_keys]), np.concatenate([seen.docs, own_docs])
        order = np.lexsort((own_docs, own_keys))
        own_keys, own_docs = own_keys[order], own_docs[order]
        new = np.ones(len(own_keys), bool)
        new[1:] = own_keys[1:] != own_keys[:-1]
        own_keys, own_docs = own_keys[new], own_docs[new]
    seen.bucket, seen.keys, seen.docs = last, own_keys, own_docs

    hit = np.flatnonzero(bad)
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]])
    first = hit[new]
    n = np.diff(np.append(np.flatnonzero(new), len(hit)))
    place = batch.column("place").to_numpy()[row[first]] + (at[first] - w.first[row[first]])
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(docs[first]), "place": pa.array(place), "n": pa.array(n, pa.int32())})


def kept_words(w: Words, places: pa.Array, sizes: pa.Array, k: int) -> np.ndarray:
    """Which words no repeated window covers; one list of runs per text."""
    cover = np.zeros(len(w.starts) + 1, np.int64)
    of = np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy()))
    begin = w.first[of] + (places.flatten().to_numpy(zero_copy_only=False) & 0xFFFFFFFF)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + sizes.flatten().to_numpy(zero_copy_only=False) + (k - 1), -1)
    return np.cumsum(cover[:-1]) == 0


def repeated_runs(docs: DataFrame, k: int, turn: int, rounds: int) -> DataFrame:
    """(doc_id, place, n): runs of repeated windows, of the buckets whose turn it is."""
    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in chunks(batch, "text"):
                yield super_kmers(rows, k, turn, rounds)

    def sorting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            if batch.num_rows:
                yield repeated(batch, k, seen)

    packed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(packing, PACKED)
    dealt = packed.repartition(shuffle_partitions(docs.sparkSession), "bucket")
    return dealt.sortWithinPartitions("bucket", "doc_id").mapInArrow(sorting, RUNS)


def tagged(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text"),
                       F.xxhash64("text").bitwiseAND(F.lit(TAG)).alias("tag"))


def dedup(docs: DataFrame, k: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    A word goes when a window covering it also starts in a document with a
    smaller id; windows are judged on the input. Words are unchanged runs of
    characters other than space and 0x09-0x0D.

    A NULL text has no word. A document without id is kept whole and takes
    nothing from others; rows with one id never take from each other. Texts
    shorter than ``k`` words have no window. Empty tables give no row; other
    columns are not read. Windows are equal when their 64-bit hashes and their
    minimisers' 58-bit hashes and lengths agree.

    A hot passage or group of copies has one packed string per document in a
    bucket, a small part of a document; a bucket is read as a sorted stream
    whose memory holds its distinct windows, not its rows. Sorting may spill.
    The packed strings are some three times the texts, so buckets are worked
    through in ``rounds`` parts, each read from the input anew, and only one part lies on
    the disks at a time. The runs found are written before the texts are
    shuffled once, to meet them.
    """
    texts = tagged(docs)
    runs = reduce(DataFrame.union, [settled(repeated_runs(texts, k, turn, rounds)) for turn in range(rounds)])
    runs = settled(runs.groupBy(F.col("doc_id").alias("d"), F.shiftright("place", 32).alias("t")).agg(
        F.collect_list("place").alias("places"), F.collect_list("n").alias("sizes")))
    met = texts.join(runs, (F.col("doc_id") == F.col("d")) & (F.col("tag") == F.col("t")), "left").select(
        "doc_id", "text", F.coalesce("places", F.array().cast("array<long>")).alias("places"),
        F.coalesce("sizes", F.array().cast("array<int>")).alias("sizes"))

    def keeping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in chunks(batch, "text"):
                w = split(rows.column("text"))
                kept = kept_words(w, rows.column("places"), rows.column("sizes"), k)
                text, offsets = joined(w, kept)
                n_kept = per_text(kept, w.first)
                first = np.concatenate([[0], np.cumsum(n_kept)])
                bounds = offsets[first]
                view = memoryview(text)
                digests = [hashlib.sha256(view[a:max(a, b - 1)]).hexdigest() for a, b in zip(bounds, bounds[1:])]
                n = np.diff(w.first)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id"), "n_words": pa.array(n), "n_removed": pa.array(n - n_kept),
                    "kept_sha256": pa.array(digests, pa.string())})

    return met.mapInArrow(keeping, KEPT)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS k FROM starts),
judged AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS least FROM windows),
removed AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM judged WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN removed USING (doc_id, i) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM removed GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone.n, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""


@register("op3_substring_dedup", SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return dedup(table(spark, folder, "documents"))
