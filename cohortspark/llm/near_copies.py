"""Operator 5, MinHash near-dedup of weighted shingles with BagMinHash signatures.

A document is a multiset of shingles (five consecutive words). Every shingle
owns Poisson processes over its discretised weight; a signature component is
the earliest point that falls to it, so two signatures agree in a component with
the probability of their weighted Jaccard similarity. Bands of components
propose pairs, the multiset overlap of the whole texts decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.registry import register
from cohortspark.llm.tables import components, settled, table
from cohortspark.llm.words import Words, chunks, mixed, span_hashes, split

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5      # a pair at 0.8 is missed by every band once in 20,000
SIZE = BANDS * ROWS
SLACK = 4                # standard errors below SIMILARITY at which signatures rule a pair out
TILE = 1024              # rows of a bucket's class that meet others in one task

CARD = "doc_id long, k1 long, k2 long, sig binary"
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(w: Words, hashes: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every shingle; a text of fewer than ``k`` words is one shingle of all of them."""
    at, keys = w.windows(k, hashes)
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < k))
    whole = span_hashes(hashes, w.first[short], w.first[short + 1], 0xC2B2AE3D27D4EB4F)
    return np.concatenate([w.doc[at], short]), np.concatenate([keys, whole])


def weighted(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text and their multiplicities, by text."""
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    return doc[at], keys[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """Earliest points (n x size) of the texts; infinite where a text has no shingle.

    The weight axis is cut into the blocks [0, 1), [1, 2), [2, 4), [4, 8), ...
    Every shingle has one Poisson process per block it reaches, of a rate equal
    to the block's length; each point has a time, a component and a place in
    the block, and counts when its place lies below the shingle's weight. So a
    weight costs its logarithm in processes, and equal stretches of weight give equal points in
    every text. Points are drawn in order of time, all processes side by side,
    and a process ends beyond the latest component of its text.
    """
    best = np.full(n * size, np.inf)
    blocks = 1 + np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)
    source = np.repeat(np.arange(len(keys)), blocks)
    level = np.arange(len(source)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    length = np.where(level == 0, 1, low)
    owner, weight = doc[source], weights[source]
    state = mixed(keys[source] + (level + 1).astype(np.uint64) * GOLD)
    time = np.zeros(len(source))
    step = np.ones(1, np.uint64)  # an array: its products wrap silently
    while len(owner):
        draw = mixed(state + step * GOLD)
        time = time - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0 ** -53) / length
        late = best.reshape(n, size).max(axis=1)
        live = time <= late[owner]
        owner, weight, state, time, low, length = (a[live] for a in (owner, weight, state, time, low, length))
        pick = mixed(draw[live] ^ GOLD)
        component = (pick >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)
        place = low + (((pick & np.uint64(0xFFFFFFFF)) * length.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        hit = place < weight
        np.minimum.at(best, owner[hit] * size + component[hit].astype(np.int64), time[hit])
        step = step + np.uint64(1)
    return best.reshape(n, size)


def cards(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, sig) per row: 128 bits of the word sequence, and one byte per component.

    Texts without words have neither.
    """
    def signing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in chunks(batch, "text"):
                w = split(rows.column("text"))
                hashes = w.hashes()
                n = rows.num_rows
                best = signatures(*weighted(*shingles(w, hashes)), n)
                small = (mixed(best.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)
                empty = pa.array(np.diff(w.first) == 0)
                none = pa.scalar(None, pa.int64())
                keys = [pa.compute.if_else(empty, none, pa.array(span_hashes(h, w.first[:-1], w.first[1:], b).view(np.int64)))
                        for h, b in ((hashes, 0x9FB21C651E98DF25), (w.hashes(seed=2), 0xD6E8FEB86659FD93))]
                sig = pa.array([None if e else s.tobytes() for e, s in zip(np.diff(w.first) == 0, small)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *keys, sig], ["doc_id", "k1", "k2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(signing, CARD)


def overlap(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of each pair of texts."""
    n = len(left)
    sides = []
    for texts in (left, right):
        w = split(texts)
        doc, keys, weights = weighted(*shingles(w, w.hashes()))
        key = mixed(keys + doc.astype(np.uint64) * GOLD)
        order = np.argsort(key)
        sides.append((key[order], doc[order], weights[order]))
    (ka, da, wa), (kb, _, wb) = sides
    total = sum(np.bincount(d, x, minlength=n) for _, d, x in sides)
    if not len(ka) or not len(kb):
        return np.zeros(n)
    place = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    both = kb[place] == ka
    common = np.bincount(da[both], np.minimum(wa[both], wb[place[both]]), minlength=n)
    return common / np.maximum(total - common, 1)


def likely(pairs: DataFrame, sigs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose signatures do not rule the similarity out."""
    least = least_equal(similarity)

    def comparing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIZE)
                        for c in ("x", "y"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    rows = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("x")), "a").join(
        sigs.select(F.col("rep").alias("b"), F.col("sig").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(comparing, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose whole texts reach the similarity."""
    def comparing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in chunks(batch, "x"):
                good = overlap(rows.column("x"), rows.column("y")) >= similarity - 1e-12
                yield rows.select(["a", "b"]).filter(pa.array(good))

    rows = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("x")), "a").join(
        texts.select(F.col("rep").alias("b"), F.col("text").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(comparing, "a long, b long")


def least_equal(similarity: float) -> float:
    """Equal components below which a pair of signatures rules the similarity out."""
    return SIZE * (similarity - SLACK * np.sqrt(similarity * (1 - similarity) / SIZE))


def meeting(members: DataFrame) -> DataFrame:
    """Rows of buckets that hold several classes, dealt so that every two classes meet.

    A bucket's largest class and the others are cut into tiles of ``TILE`` rows.
    Tiles of the others meet each other and those of the largest class, so a
    class never meets itself and the rows sent follow the bucket's rows times
    the tiles of the others. Buckets of one tile each are binned.
    """
    shape = members.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("band", "key").agg(
        F.max_by("component", F.struct("n", "component")).alias("major"), F.max("n").alias("most"),
        F.sum("n").alias("total")).where("most < total")
    mixed_up = settled(members.join(shape, ["band", "key"]))
    bins = max(1, mixed_up.count() // TILE)
    p = F.ceil(F.col("most") / TILE).cast("int")
    q = F.ceil((F.col("total") - F.col("most")) / TILE).cast("int")
    major = F.col("component") == F.col("major")
    tile = F.pmod(F.xxhash64("rep"), F.when(major, p).otherwise(q)).cast("int")
    mixed_up = mixed_up.withColumns({"p": p, "q": q, "major": major, "tile": tile, "lone": (p == 1) & (q == 1)})

    def place(kind, x, y):
        return F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))

    t, zero = F.col("tile"), F.lit(0)
    with_major = F.transform(F.sequence(zero, F.col("p") - 1), lambda x: place(1, x, t))
    with_others = F.transform(F.sequence(zero, F.col("q") - 1), lambda z: place(2, F.least(t, z), F.greatest(t, z)))
    places = (F.when(F.col("lone"), F.array(place(0, zero, zero)))
              .when(F.col("major"), F.transform(F.sequence(zero, F.col("q") - 1), lambda y: place(1, t, y)))
              .otherwise(F.concat(with_major, with_others)))
    rows = mixed_up.select("band", "key", "rep", "component", "major", "tile", "lone", F.inline(places))
    group = F.xxhash64("band", "key", "kind", "x", "y")
    return rows.select("band", "rep", "component", "major", "tile", "kind", (F.col("x") != F.col("y")).alias("across"),
                       group.alias("gid"), F.when(F.col("lone"), F.pmod(group, F.lit(bins))).otherwise(group).alias("place"))


def buckets(group: pa.Table) -> Iterator[pa.Table]:
    group = group.sort_by("gid").combine_chunks()
    gid = group.column("gid").to_numpy()
    edges = np.append(np.flatnonzero(np.append(True, gid[1:] != gid[:-1])), len(gid))
    for a, b in zip(edges, edges[1:]):
        yield group.slice(a, b - a)


def likely_pairs(rows: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a bucket's rows in different classes that their signatures do not rule out: i, j, equal components.

    A pair that shares several bands counts in the first of them.
    """
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, SIZE)
    component, major, tile = (rows.column(c).to_numpy() for c in ("component", "major", "tile"))
    kind, across, band = (rows.column(c)[0].as_py() for c in ("kind", "across", "band"))
    out = [(np.zeros(0, np.int64),) * 3]
    for at in range(0, len(sig), 128):
        to = min(at + 128, len(sig))
        equal = (sig[at:to, None] == sig[None, at:]).sum(axis=2)
        good = (equal >= least) & (component[at:to, None] != component[None, at:])
        if kind == 1:
            good &= major[at:to, None] != major[None, at:]
        elif kind == 2 and across:
            good &= tile[at:to, None] != tile[None, at:]
        i, j = np.nonzero(np.triu(good, 1))
        first = (sig[i + at] == sig[j + at]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        i, j = i[first], j[first]
        out.append((i + at, j + at, equal[i, j]))
    return tuple(np.concatenate(c) for c in zip(*out))


def linked(rows: pa.Table, least: float, similarity: float) -> Iterator[tuple[int, int]]:
    """Links between the classes of a bucket, found with whole texts; the likeliest pairs first."""
    i, j, equal = likely_pairs(rows, least)
    w = split(rows.column("text").combine_chunks())
    doc, keys, weights = weighted(*shingles(w, w.hashes()))
    first = np.searchsorted(doc, np.arange(rows.num_rows + 1))
    total = np.diff(np.concatenate([[0], np.cumsum(weights)])[first])
    component, rep = rows.column("component").to_pylist(), rows.column("rep").to_pylist()
    root = {c: c for c in component}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for k in np.argsort(-equal, kind="stable"):
        a, b = i[k], j[k]
        x, y = find(component[a]), find(component[b])
        if x == y or not total[a] or not total[b]:
            continue
        ka, kb = keys[first[a]:first[a + 1]], keys[first[b]:first[b + 1]]
        place = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
        both = kb[place] == ka
        common = np.minimum(weights[first[a]:first[a + 1]][both], weights[first[b]:first[b + 1]][place[both]]).sum()
        if common >= (similarity - 1e-12) * (total[a] + total[b] - common):
            root[max(x, y)] = min(x, y)
            yield rep[a], rep[b]


def across_classes(members: DataFrame, sigs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between classes of ``members(band, key, rep, component)`` that share a bucket.

    Signatures first pick the rows with a likely partner in another class;
    only those meet again with their whole texts. Pairs never leave a task, only
    rows and links that join classes do.
    """
    least = least_equal(similarity)

    def picking(group: pa.Table) -> pa.Table:
        parts = [group.slice(0, 0)]
        for rows in buckets(group):
            i, j, _ = likely_pairs(rows, least)
            parts.append(rows.take(pa.array(np.unique(np.concatenate([i, j])))))
        return pa.concat_tables(parts)

    def linking(group: pa.Table) -> pa.Table:
        links = [x for rows in buckets(group) for x in linked(rows, least, similarity)]
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = meeting(members).join(sigs, "rep")
    picked = settled(rows.groupBy("place").applyInArrow(picking, rows.schema))
    return picked.join(texts, "rep").groupBy("place").applyInArrow(linking, "a long, b long")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id), one row per id that has words; class_id is the smallest id linked to it.

    Documents are linked when their weighted shingle similarity is at least
    ``similarity`` or they are rows of one id. Texts of fewer than five words
    are one shingle, so they are linked only to equal ones. Texts without words
    and rows without id link with nothing and do not appear.

    Copies (equal words) are one node, brought together by an aggregate before
    any pair is made. In a band's bucket members are paired with two hubs, its
    smallest and its largest id, so the pairs follow the members. What still lies in
    different classes is then compared across classes inside tasks, so no proposed
    pair is left out and none is made inside a class. Signatures rule most pairs out before the
    whole texts of the others meet. Every step is a written table.
    """
    known = settled(cards(docs).where("doc_id IS NOT NULL AND k1 IS NOT NULL"))
    nodes = settled(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")))
    owner = settled(known.join(nodes.drop("sig"), ["k1", "k2"]).select("doc_id", "rep").distinct())
    sigs = nodes.select("rep", "sig")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(
        b.alias("band"), F.substring("sig", b * ROWS + 1, F.lit(ROWS)).alias("key")))
    filed = sigs.select("rep", F.inline(bands))
    shared = filed.groupBy("band", "key").agg(
        F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most")
    filed = settled(filed.join(shared, ["band", "key"]))
    asked = filed.select(F.col("rep").alias("r")).distinct()
    texts = settled(docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
                .join(asked, F.col("rep") == F.col("r"), "left_semi")
                .withColumn("h", F.xxhash64("text")).dropDuplicates(["rep", "h"]).select("rep", "text"))

    # an id with several texts holds their classes together
    many = owner.groupBy("doc_id").agg(F.min("rep").alias("p"), F.max("rep").alias("q")).where("p <> q")
    edges = settled(owner.join(many, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    hubs = F.explode(F.array("least", "most"))
    pairs = filed.select("rep", hubs.alias("hub")).where("rep <> hub").select(
        F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    edges = edges.union(settled(verified(likely(pairs, sigs, similarity), texts, similarity)))
    found = settled(components(edges))
    members = filed.select("band", "key", "rep").join(
        found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    new = settled(across_classes(members, sigs, texts, similarity))
    if not new.isEmpty():
        found = settled(components(edges.union(new)))
    of = F.coalesce("component", "rep")
    return owner.join(found.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(
        F.min(of).alias("class_id"))


def judge(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id and kept, true for the class's smallest id.

    Rows without id or words are classes of their own and kept; an empty table
    gives no row; other columns are not read.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    return ids.join(classes(docs, similarity), F.col("id") == F.col("doc_id"), "left").select(
        F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of every class, with all columns of ``docs``; of rows with one id the first by text."""
    found = classes(docs, similarity).select(F.col("doc_id").alias("_id"), "class_id")
    rows = docs.select(F.struct("*").alias("rec"), F.col("doc_id").alias("_doc"))
    kept = rows.join(found, F.col("_doc") == F.col("_id"), "left").where(
        F.col("class_id").isNull() | (F.col("_doc") == F.col("class_id")))
    line = Window.partitionBy("_doc").orderBy(F.xxhash64("rec.text"), F.xxhash64("rec"))
    return kept.withColumn("_n", F.row_number().over(line)).where("_n = 1 OR _doc IS NULL").select("rec.*")


@register("op5_bag_minhash_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"))
