"""A blocked Bloom filter of keys that drops other rows before they are shuffled.

A key sets a few bits of one 64-bit word; the words are an ordinary table, built by one
aggregate and broadcast only below a checked number of rows. Facts whose word lacks a bit
belong to no wanted key and are dropped where they are read; the few that pass by chance are
dropped by the join that follows, so results never change.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.session import cut

BITS_PER_KEY = 16     # some 2 % of other keys pass
BITS = 4              # set by a key
MOST_WORDS = 4_000_000


def _places(key: Column, words: int) -> tuple[Column, Column]:
    """Word and bit mask of a key; a NULL key has none."""
    h = F.xxhash64(F.lit(97), key)
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    word = F.shiftrightunsigned(h, 24).bitwiseAND(F.lit(words - 1))
    known = key.isNotNull()
    return F.when(known, word), F.when(known, mask)


def key_words(keys: DataFrame, key: str, *, most_words: int = MOST_WORDS) -> tuple[DataFrame, int] | None:
    """(word, bits) of all keys and the number of words; None if the table would be too large to broadcast."""
    n = keys.agg(F.approx_count_distinct(key)).first()[0]
    words = 1 << max(0, math.ceil(math.log2(max(1, n) * BITS_PER_KEY / 64)))
    if words > most_words:
        return None
    word, mask = _places(F.col(key), words)
    table = keys.select(word.alias("__word"), mask.alias("__mask")).where("__word IS NOT NULL").groupBy("__word").agg(
        F.bit_or("__mask").alias("__bits"))
    return cut(table), words


def sieve(facts: DataFrame, key: str, filter_of: tuple[DataFrame, int] | None) -> DataFrame:
    """The facts whose key may be one of the filter's; all of them without a filter."""
    if filter_of is None:
        return facts
    table, words = filter_of
    word, mask = _places(F.col(key), words)
    marked = facts.withColumns({"__at": word, "__need": mask})
    bits, need = table["__bits"], marked["__need"]
    kept = marked.join(F.broadcast(table), (marked["__at"] == table["__word"]) & (bits.bitwiseAND(need) == need),
                       "left_semi")   # at most MOST_WORDS rows
    return kept.drop("__at", "__need")
