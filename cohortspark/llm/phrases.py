"""Operator 12, phrase collocations counted by broadcast double-array tries.

Level by level (phrases of one word, two, ...) the candidates of a level are
held as double-array tries over bytes. Every task walks the tries from all of its
word positions at once: step t moves the states of all positions over their
t-th byte, positions without a transition drop out, and the positions left at the
end of their phrase are counted by accepting state. The same walk reports
which accepted phrases follow each other one word apart; their summed number bounds
the longer phrase from above, so what it leaves out cannot be frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.registry import register
from cohortspark.llm.tables import numbered, settled, table
from cohortspark.llm.words import CHUNK_BYTES, binary, buffers, gathered

LEAST = 30               # occurrences of a candidate
LONGEST = 4              # words
FACTOR = 2_000_000
COVERED = 80             # percent of a phrase's occurrences inside a longer one that make it redundant
TOP = 2_000              # phrases reported for each language
TRIE_BYTES = 4_000_000   # of the phrases of one trie, which bounds each broadcast
HELD = 1_000_000         # distinct neighbours that a task holds before it reports them
SEED_BLOCK = 1_000       # phrases of which the driver knows one size
MOST_LANGS = 10_000      # of a broadcast table of languages

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True


@dataclass
class Stream:
    """Words of a chunk, each followed by a space, or by a line feed where its piece ends."""

    data: np.ndarray      # uint8
    starts: np.ndarray    # of the words, and behind the last one
    ends: np.ndarray
    last: np.ndarray      # number of the last word of each word's piece
    lang: np.ndarray      # index of each word's language
    own: np.ndarray       # whether a phrase may start here; the others belong to the next segment


def segments(data: np.ndarray, bounds: np.ndarray, size: int = CHUNK_BYTES,
             overlap: int = LONGEST) -> Iterator[list[tuple[int, int, int, int]]]:
    """Chunks of (row, start, end of the own words, end) of about ``size`` bytes.

    A longer text is cut between words; a segment reads on over ``overlap``
    words of the next one, so every phrase lies whole in the segment where it starts.
    """
    chunk, held = [], 0
    for row in range(len(bounds) - 1):
        at, stop = int(bounds[row]), int(bounds[row + 1])
        while stop - at > size:
            cut = next_gap(data, at + size, stop)
            if cut >= stop:
                break
            end = cut
            for _ in range(overlap):
                end = next_gap(data, next_word(data, end, stop), stop)
            yield [(row, at, cut, end)]
            at = cut
        if stop > at:
            chunk.append((row, at, stop, stop))
            held += stop - at
        if held >= size:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def next_gap(data, at, stop, wanted=True):
    """First byte from ``at`` on that separates words (or does not); ``stop`` if there is none."""
    step = 4_096
    while at < stop:
        found = np.flatnonzero(GAP[data[at:min(stop, at + step)]] == wanted)
        if len(found):
            return at + int(found[0])
        at, step = at + step, step * 2
    return stop


def next_word(data, at, stop):
    return next_gap(data, at, stop, wanted=False)


def streamed(data: np.ndarray, chunk: list[tuple[int, int, int, int]], lang: np.ndarray) -> Stream:
    """The chunk's lower-cased words; ``lang`` gives each row's language index."""
    raw = LOWER[np.concatenate([data[a:e] for _, a, _, e in chunk])]
    sizes = np.array([e - a for _, a, _, e in chunk])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    word = ~GAP[raw]
    opens = np.zeros(len(raw) + 1, bool)
    opens[bounds] = True
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | opens[1:len(raw)]
    stop[:-1] &= ~word[1:] | opens[1:len(raw)]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    of = np.searchsorted(bounds, starts, side="right") - 1
    breaks = np.concatenate([[0], np.cumsum(BREAK[raw])])
    n = len(starts)
    final = np.ones(n, bool)     # the piece ends behind the word
    if n > 1:
        final[:-1] = (breaks[starts[1:]] > breaks[ends[:-1]]) | (of[1:] != of[:-1])
    own_end = np.array([o - a for _, a, o, _ in chunk]) + bounds[:-1]
    out, offsets = gathered(np.append(raw, np.uint8(0)), starts, ends + 1)
    out[offsets[1:] - 1] = np.where(final, 0x0A, 0x20)
    stops = np.flatnonzero(final)
    last = stops[np.searchsorted(stops, np.arange(n))] if n else stops
    rows = np.array([r for r, _, _, _ in chunk])
    return Stream(out, offsets[:-1], offsets[1:] - 1, last, lang[rows[of]] if n else of, starts < own_end[of])


@dataclass
class Trie:
    """Double array over bytes: state s goes to ``base[s] + byte`` if ``check`` there is s.

    ``phrase`` is the number of the key that ends in a state, else -1.
    """

    base: np.ndarray
    check: np.ndarray
    phrase: np.ndarray
    root: int

    @staticmethod
    def of(keys: list[bytes]) -> Trie:
        """Built level by level. Nodes with several children get a stretch of their own, from the
        least child to the greatest; children without siblings fill the free places."""
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = np.array([len(keys[i]) for i in order], np.int64)
        flat = np.frombuffer(b"".join(keys[i] for i in order), np.uint8)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        node, parents, bytes_, nodes, ends, depth = np.zeros(len(keys), np.int64), [], [], 1, [], 0
        live = np.arange(len(keys))
        done = live[size == 0]
        while True:
            ends.append((node[done], np.array(order, np.int64)[done]))
            live = live[size[live] > depth]
            if not len(live):
                break
            byte = flat[begin[live] + depth].astype(np.int64)
            new = np.ones(len(live), bool)
            new[1:] = (node[live][1:] != node[live][:-1]) | (byte[1:] != byte[:-1])
            parents.append(node[live][new])
            bytes_.append(byte[new])
            node[live] = nodes + np.cumsum(new) - 1
            nodes += int(new.sum())
            depth += 1
            done = live[size[live] == depth]
        parent = np.concatenate([np.zeros(0, np.int64), *parents])
        byte = np.concatenate([np.zeros(0, np.int64), *bytes_])   # of node i + 1
        return Trie._placed(nodes, parent, byte, np.concatenate([e for e, _ in ends]), np.concatenate([k for _, k in ends]))

    @staticmethod
    def _placed(nodes, parent, byte, ends, keys):
        least, most = np.full(nodes, 256), np.full(nodes, -1)
        np.minimum.at(least, parent, byte)
        np.maximum.at(most, parent, byte)
        wide = most > least
        span = np.where(wide, most - least + 1, 0)
        margin = 256                            # no transition leaves the arrays
        base = margin + np.cumsum(span) - span - least
        top = margin + int(span.sum())
        slot = np.zeros(nodes, np.int64)
        many = wide[parent]
        slot[1:][many] = (base[parent] + byte)[many]
        used = np.zeros(top + nodes + 1, bool)
        used[:margin] = True
        used[slot[1:][many]] = True
        single = np.concatenate([[True], ~many])  # the root is a child without siblings
        slot[single] = np.flatnonzero(~used)[:single.sum()]
        base[parent[~many]] = (slot[1:] - byte)[~many]
        length = int(slot.max()) + 2 * margin
        bases, check = np.zeros(length, np.int32), np.full(length, -1, np.int32)
        bases[slot] = np.where(most >= 0, base, margin)   # a leaf's transitions fail the check
        check[slot[1:]] = slot[parent]
        phrase = np.full(length, -1, np.int32)
        phrase[slot[ends]] = keys
        return Trie(bases, check, phrase, int(slot[0]))

    def reach(self, state: int, key: bytes) -> int:
        """State behind ``key``, -1 without one."""
        for byte in key:
            to = int(self.base[state]) + byte
            if state < 0 or self.check[to] != state:
                return -1
            state = to
        return state

    def accepted(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Key number accepted by ``data[begin:end]`` from each state, -1 where there is none."""
        out = np.full(len(begin), -1, np.int32)
        live = np.flatnonzero(state >= 0)
        at, stop, state = begin[live], end[live], state[live]
        while len(live):
            done = at == stop
            if done.any():
                out[live[done]] = self.phrase[state[done]]
                live, at, stop, state = live[~done], at[~done], stop[~done], state[~done]
            to = self.base[state] + data[at]
            good = self.check[to] == state
            live, at, stop, state = live[good], at[good] + 1, stop[good], to[good]
        return out


def phrase_key(lang: str, phrase: str) -> bytes:
    return lang.encode() + b"\n" + phrase.encode()   # a phrase has no line feed


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Stream, list[str]]]:
    for batch in batches:
        coded = pa.array(batch.column("lang")).dictionary_encode()
        langs, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        data, bounds = buffers(batch.column("text"))
        for chunk in segments(data, bounds):
            yield streamed(data, chunk, lang), langs


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, n): occurrences of every word and, as phrase ``''``, of all words; summed in each chunk first."""
    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, langs in streams(batches):
            for i in np.unique(s.lang):
                mine = s.own & (s.lang == i)
                coded = binary(s.data, s.starts[mine], s.ends[mine]).dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([langs[i]] * (len(n) + 1), pa.string()),
                    "phrase": pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([""])]),
                    "n": pa.array(np.append(n, mine.sum()).astype(np.int64))})

    return texts(docs).mapInArrow(counting, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(
        F.sum("n").alias("n"))


def tries(known: DataFrame, size: int = TRIE_BYTES) -> Iterator[tuple[int, int, Trie]]:
    """(first id, ids, trie) over ``known(id, lang, phrase)``, one after another, of ``size`` bytes or one block."""
    block = F.floor(F.col("id") / SEED_BLOCK)
    sizes = known.groupBy(block.alias("block")).agg(
        F.sum(F.octet_length("lang") + F.octet_length("phrase") + 1).alias("bytes")).orderBy("block").collect()
    first, held = 0, 0
    stops = []
    for r in sizes:
        if held and held + r.bytes > size:
            stops.append((first, r.block * SEED_BLOCK))
            first, held = r.block * SEED_BLOCK, 0
        held += r.bytes
    if sizes:
        stops.append((first, (sizes[-1].block + 1) * SEED_BLOCK))
    for a, b in stops:
        rows = known.where((F.col("id") >= a) & (F.col("id") < b)).toArrow()
        ids = rows.column("id").to_numpy()
        keys = [phrase_key(*k) for k in zip(rows.column("lang").to_pylist(), rows.column("phrase").to_pylist())]
        trie = Trie.of(keys)
        trie.phrase[trie.phrase >= 0] = (ids - a)[trie.phrase[trie.phrase >= 0]]
        yield a, b - a, trie


def walk(docs: DataFrame, known: DataFrame, words: int, size: int = TRIE_BYTES) -> DataFrame:
    """(id, next, n): how often each phrase of ``words`` words occurs (``next`` NULL) and how often the
    phrase ``next`` begins at its second word, for ids of ``known``; read through its tries."""
    spark = docs.sparkSession
    sent = [(first, n, spark.sparkContext.broadcast(trie)) for first, n, trie in tries(known, size)]

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(n, np.int64) for _, n, _ in sent]
        held, size = [], 0

        def reported():
            pair, n = summed(held)
            return pa.RecordBatch.from_pydict({
                "id": pa.array(pair[:, 0]), "next": pa.array(pair[:, 1]), "n": pa.array(n)})

        for s, langs in streams(batches):
            n = len(s.starts)
            final = np.minimum(np.arange(n) + words - 1, n - 1)
            whole = np.flatnonzero(s.last >= np.arange(n) + words - 1)   # the phrase lies in one piece
            found = np.full(n, -1, np.int64)
            for i, (first, _, shared) in enumerate(sent):
                trie = shared.value
                roots = np.array([trie.reach(trie.root, phrase_key(lang, "")) for lang in langs], np.int32)
                hit = trie.accepted(s.data, s.starts[whole], s.ends[final[whole]], roots[s.lang[whole]])
                mine = hit >= 0
                found[whole[mine]] = hit[mine].astype(np.int64) + first
                sums[i] += np.bincount(hit[mine & s.own[whole]], minlength=len(sums[i]))
            at = np.flatnonzero((found[:-1] >= 0) & (found[1:] >= 0) & (s.last[:-1] == s.last[1:]) & s.own[:-1])
            if len(at):
                held.append(summed([(np.stack([found[at], found[at + 1]], axis=1), np.ones(len(at), np.int64))]))
                size += len(held[-1][1])
            if size > HELD:
                held = [summed(held)]
                size = len(held[0][1])
                if size > HELD // 2:
                    yield reported()
                    held, size = [], 0
        if held:
            yield reported()
        for (first, _, _), total in zip(sent, sums):
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(ids + first), "next": pa.nulls(len(ids), pa.int64()), "n": pa.array(total[ids])})

    return texts(docs).mapInArrow(counting, "id long, next long, n long").groupBy("id", "next").agg(
        F.sum("n").alias("n"))


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, n = np.concatenate([p for p, _ in parts]), np.concatenate([k for _, k in parts])
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs, n = pairs[order], n[order]
    new = np.ones(len(n), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return pairs[at], np.add.reduceat(n, at) if len(n) else n


def identified(phrases: DataFrame) -> DataFrame:
    """The phrases with ids by language and phrase, written once."""
    return settled(numbered(phrases, [F.col("lang"), F.col("phrase")], "id"))


def frequent(docs: DataFrame, counted: DataFrame, *, least: int = LEAST, longest: int = LONGEST,
             trie_bytes: int = TRIE_BYTES) -> list[DataFrame]:
    """For each number of words, the phrases that occur ``least`` times or more.

    (id, lang, phrase, a, heads, tails, first, rest): a are all occurrences; heads and tails the
    occurrences of the first 1, 2, ... and of the last 1, 2, ... words; first and rest the ids,
    one level down, of the phrase without its last and without its first word.

    Counts cover all texts. A level's candidates are the phrases whose two
    parts are frequent and follow each other ``least`` times or more; no frequent phrase
    is left out. ``counted`` are the words that may be frequent.
    """
    none, nobody = F.array().cast("array<long>"), F.lit(None).cast("long")
    known = identified(counted.where((F.col("n") >= least) & (F.col("phrase") != "")).select(
        "lang", "phrase", none.alias("heads"), none.alias("tails"), nobody.alias("first"), nobody.alias("rest")))
    levels = []
    for words in range(1, longest + 1):
        counts = settled(walk(docs, known, words, trie_bytes))
        a = counts.where("next IS NULL AND n >= " + str(least)).select("id", F.col("n").alias("a"))
        levels.append(settled(known.join(a, "id")))
        if words == longest:
            break
        left, right = (levels[-1].select(*[F.col(c).alias(side + c) for c in ("id", "lang", "phrase", "a", "heads", "tails")])
                       for side in ("l_", "r_"))
        pairs = counts.where(F.col("next").isNotNull() & (F.col("n") >= least)).select("id", "next")
        known = identified(pairs.join(left, F.col("id") == F.col("l_id")).join(right, F.col("next") == F.col("r_id")).select(
            F.col("l_lang").alias("lang"), F.concat_ws(" ", "l_phrase", F.substring_index("r_phrase", " ", -1)).alias("phrase"),
            F.array_append("l_heads", F.col("l_a")).alias("heads"), F.array_append("r_tails", F.col("r_a")).alias("tails"),
            F.col("l_id").alias("first"), F.col("r_id").alias("rest")))
    return levels


def score_of(factor: int, a: Column, parts: Column) -> Column:
    """floor(factor * a / parts) over 38-digit integers."""
    return F.call_function("div", a.cast("decimal(20,0)") * F.lit(factor).cast("decimal(17,0)"), parts)


def cut_of(k: Column, words: int, factor: int) -> Column:
    """Score and parts of a phrase cut behind its first ``k`` words."""
    left, right = F.get("heads", (k - 1).cast("int")), F.get("tails", (F.lit(words - 1) - k).cast("int"))
    both = left.cast("decimal(20,0)") + right.cast("decimal(20,0)")
    return F.struct(score_of(factor, F.col("a"), both).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))


def collocations(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, factor: int = FACTOR,
                 covered: int = COVERED, top: int = TOP, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has text and lang. Texts are lower-cased in A-Z and cut at ``.,;:!?`` and
    line ends into pieces, pieces at spaces and tabs into words; phrases of two
    to ``longest`` words count with overlaps inside a piece. The score is
    floor(factor * a / (l + r)) at the cut into two parts where it is least, in 38-digit
    integers. A phrase with ``covered`` percent of its occurrences
    inside one longer candidate is dropped. Ties go by a, then bytes of the phrase.

    A NULL text is empty, a NULL language ``und``; repeated rows count each; an
    empty table gives no row; other columns are not read. A text above 1 MB is
    cut between words into segments that overlap by a phrase, so memory does not
    grow with a text, unless one word is as long. Tries hold at most
    ``trie_bytes`` of phrases each; more phrases make more tries, all walked in
    the same scan.
    """
    singles = settled(word_counts(docs).where((F.col("n") >= least) | (F.col("phrase") == "")))
    n = singles.where("phrase = ''").select("lang", "n")
    levels = frequent(docs, singles, least=least, longest=longest, trie_bytes=trie_bytes)
    out = None
    for words, level in enumerate(levels[1:], 2):
        cuts = F.transform(F.sequence(F.lit(1), F.lit(words - 1)), lambda k: cut_of(k, words, factor))
        scored = level.select("id", "lang", "phrase", "a", F.array_min(cuts).alias("cut"))
        if words < longest:   # of all longer phrases around it, one a word longer occurs most often
            longer = levels[words]
            over = longer.select(F.col("first").alias("id"), "a").union(longer.select("rest", "a")).groupBy("id").agg(
                F.max("a").alias("longer"))
            inside = F.col("longer").cast("decimal(38,0)") * 100 >= F.col("a").cast("decimal(38,0)") * covered
            scored = scored.join(over, "id", "left").where(F.coalesce(~inside, F.lit(True))).drop("longer")
        out = scored if out is None else out.union(scored)
    place = F.expr("row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, phrase)")
    ranked = out.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(n) if n.count() <= MOST_LANGS else n, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))


ALPHABET = "abcdefghijklmnopqrstuvwxyz"
SQL = f"""WITH pieces AS (SELECT COALESCE(lang, 'und') AS lang, UNNEST(string_split_regex(
    translate(text, '{ALPHABET.upper()}', '{ALPHABET}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, SUM(len(w)) AS n FROM words GROUP BY lang),
grams AS ({" UNION ALL ".join(
    f"SELECT lang, {k} AS m, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM "
    f"(SELECT lang, w, UNNEST(range(1, len(w) + {2 - k})) AS i FROM words WHERE len(w) >= {k})" for k in range(1, 5))}),
f AS (SELECT lang, m, phrase, COUNT(*) AS a FROM grams GROUP BY ALL HAVING COUNT(*) >= {LEAST}),
cuts AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, {FACTOR}::HUGEINT * c.a // (x.a + y.a) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, UNNEST(range(1, m)) AS k FROM f WHERE m > 1) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')),
best AS (SELECT * FROM cuts QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i:j], ' ') AS phrase, MAX(a) AS longer FROM (
    SELECT lang, a, string_split(phrase, ' ') AS w, m, UNNEST(range(1, m)) AS i FROM f WHERE m > 2) p,
  range(2, 5) r(j) WHERE j > i AND j <= m AND NOT (i = 1 AND j = m) GROUP BY ALL),
ranked AS (SELECT b.*, ROW_NUMBER() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inside s ON s.lang = b.lang AND s.phrase = b.phrase
  WHERE longer IS NULL OR 100 * longer::HUGEINT < {COVERED} * a::HUGEINT)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
  score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}"""


@register("op12_phrase_collocations", SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
