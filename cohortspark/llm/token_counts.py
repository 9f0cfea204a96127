"""Operator 4, token counts of sections by offset-mapped attribution.

A document is encoded once as a whole. The tokens' spans in the text are joined
with the spans of its sections, and a token that crosses a section's border is
given to one of them by an explicit rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.registry import register
from cohortspark.llm.tables import table
from cohortspark.llm.tokens import Vocabulary, vocabulary
from cohortspark.llm.words import buffers

RUN = 500  # documents handled at once
COUNTS = ("doc_id long, field string, section int, start long, stop long, "
          "n_tokens long, n_crossing long")


def attributed(starts: np.ndarray, stops: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of every token and whether it crosses into a later one.

    ``starts``/``stops`` are the tokens' spans, ``sections`` the sections'
    first positions, which begin at 0 and leave no gap.
    """
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, np.maximum(stops - 1, starts), side="right") - 1
    crossing = last > first
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    # majority: the section that holds most of the token's bytes, the first of equals
    owner = first.copy()
    for t in np.flatnonzero(crossing):
        edges = np.concatenate([[starts[t]], sections[first[t] + 1:last[t] + 1], [stops[t]]])
        owner[t] = first[t] + np.diff(edges).argmax()
    return owner, crossing


def count_tokens(columns: list[list[str | None]], words: Vocabulary, rule: str) -> dict[str, np.ndarray]:
    """Sections of a run of documents: doc, field, section, start, stop, n_tokens, n_crossing.

    ``columns`` holds one list of texts per field. The documents lie one after
    another in one byte array; token lengths add up to exactly those bytes.
    """
    used = [[(f, v) for f, v in enumerate(row) if v is not None] for row in zip(*columns)]
    texts = ["\n".join(v for _, v in row) for row in used]
    data, bounds = buffers(pa.array(texts, pa.string()))
    spans = [words.lengths[words.ids(t)] for t in texts]
    stops = np.cumsum(np.concatenate([np.zeros(0, np.int64), *spans]))
    starts = np.concatenate([np.zeros(1, np.int64), stops])[:-1]

    heads = [(bounds[d] + off, d, f) for d, row in enumerate(used)
             for off, f in zip(np.cumsum([0] + [len(v.encode()) + 1 for _, v in row[:-1]]), [f for f, _ in row] or [0])]
    head_at, head_doc, head_field = (np.array(c, np.int64) for c in zip(*heads))
    feeds = np.flatnonzero(data == 0x0A)
    feed_doc = np.searchsorted(bounds, feeds, side="right") - 1
    inner = feeds + 1 < bounds[feed_doc + 1]       # a line keeps its line feed; the last one opens no line
    at = np.concatenate([head_at, feeds[inner] + 1])
    doc = np.concatenate([head_doc, feed_doc[inner]])
    field = np.concatenate([head_field, np.full(inner.sum(), -1)])
    order = np.lexsort((-field, at, doc))
    at, doc, field = at[order], doc[order], field[order]
    keep = np.ones(len(at), bool)
    keep[1:] = (field[1:] >= 0) | (at[1:] != at[:-1])  # the line feed between two fields opens the field alone
    at, doc, field = at[keep], doc[keep], field[keep]
    opened = np.maximum.accumulate(np.where(field >= 0, np.arange(len(at)), 0))

    owner, crossing = attributed(starts, stops, at, rule)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    end = np.where(np.append(doc[1:], -1) == doc, np.append(at[1:], 0), bounds[doc + 1])
    return {"doc": doc, "field": field[opened], "section": np.arange(len(at)) - opened,
            "start": chars[at] - chars[bounds[doc]], "stop": chars[end] - chars[bounds[doc]],
            "n_tokens": np.bincount(owner, minlength=len(at)),
            "n_crossing": np.bincount(owner[crossing], minlength=len(at))}


def token_counts(docs: DataFrame, fields: list[str], *, rule: str = "first", ranks: str | None = None) -> DataFrame:
    """One row per section: doc_id, field, section, start, stop, n_tokens, n_crossing.

    A document is its fields joined by one line feed, encoded once; the
    sections are the lines of each field, numbered from 0 per field, a line
    feed belonging to the line that it ends. ``start`` and ``stop`` are code
    points of the joined text. A token that crosses sections goes to the one
    with its ``first`` byte, its ``last`` byte or the ``majority`` of its bytes
    (the first of equals); ``n_crossing`` counts those a section was given.
    Tokens of all sections add up to the document's tokens.

    A NULL field is absent; a document without any field or with an empty text
    is one empty section of 0 tokens. Repeated rows are counted each, documents
    without id too. An empty table gives no row. Other columns are not read.
    Every row is counted where it is read: no shuffle, no group to become hot.
    """
    if rule not in ("first", "last", "majority"):
        raise ValueError(f"rule {rule!r} is not first, last or majority")

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names = vocabulary(ranks), np.array(fields, object)
        for batch in batches:
            for rows in (batch.slice(i, RUN) for i in range(0, batch.num_rows, RUN)):
                found = count_tokens([rows.column(j + 1).to_pylist() for j in range(len(fields))], words, rule)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column(0).take(pa.array(found["doc"])), "field": pa.array(names[found["field"]], pa.string()),
                    "section": pa.array(found["section"], pa.int32()),
                    **{c: pa.array(found[c], pa.int64()) for c in ("start", "stop", "n_tokens", "n_crossing")}})

    return docs.select(F.col("doc_id"), *[F.col(f).cast("string") for f in fields]).mapInArrow(counting, COUNTS)


@register("op4_token_counts")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), ["text"])
