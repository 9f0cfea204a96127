"""Operator 1, embedding near-dedup by sorted projection passes.

In every pass each vector gets 64 random projection signs, read as one number.
Vectors are ordered by label and that number, each is compared with a bounded
window of its neighbours, and pairs that reach the cosine are joined across
passes into components. A label no larger than the window is whole in one pass; the number
of passes of the others follows from their size and from what their vectors share,
and rounds go on until one adds no link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.registry import register
from cohortspark.llm.tables import components, numbered, settled, table
from cohortspark.operators.skew import SkewPolicy, attach, balanced_join

COSINE = 0.93
PASSES = 12              # in a round; a label's rounds go on until one adds no link
WINDOW = 512             # neighbours that follow a vector in a pass
RECALL = 0.999           # of the pairs at the cosine that a label's passes find before a round may be the last
BLOCK = 2_048            # positions that one task compares
TILE = 2_048             # vectors of one component that meet in one task
SEED = 11
POLICY = SkewPolicy(task_rows=100_000, broadcast_rows=0)


def usable(embedding: Column) -> Column:
    """Neither NULL nor zero, all entries known and finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and double-precision vectors, for each dimension that occurs."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = column.offsets.to_numpy()[:-1] - column.offsets.to_numpy()[0]
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[starts[at][:, None] + np.arange(d)]


def signs(x: np.ndarray, number: int, seed: int) -> np.ndarray:
    """64 projection signs of each vector as a number in the order of the signs."""
    planes = np.random.default_rng([seed, number, x.shape[1]]).normal(size=(x.shape[1], 64))
    bits = np.packbits(x @ planes > 0, axis=1)
    return (bits.view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)   # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position that each of ``n`` positions reaches over the links a-b."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def window_links(labels: np.ndarray, x: np.ndarray, own: np.ndarray, window: int, cosine: float):
    """Pairs of positions at most ``window`` apart with equal labels and the cosine, the first one in ``own``."""
    x = unit(x)
    for at in range(0, len(x), 512):
        to = min(at + 512, len(x))
        end = min(to + window, len(x))
        good = x[at:to] @ x[at:end].T >= cosine
        good &= labels[at:to, None] == labels[None, at:end]
        gap = np.arange(end - at)[None] - np.arange(to - at)[:, None]
        i, j = np.nonzero(good & (gap > 0) & (gap <= window) & own[at:to, None])
        yield i + at, j + at


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], held: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what ``pairs`` of ``n`` positions connect, with some ``held`` pairs in memory."""
    a, b, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def reduced():
        root = roots(n, np.concatenate(a), np.concatenate(b))
        moved = np.flatnonzero(root != np.arange(n))
        return moved, root[moved]

    for i, j in pairs:
        a.append(i)
        b.append(j)
        size += len(i)
        if size > held:
            i, j = reduced()
            a, b, size = [i], [j], 0
    return reduced()


def passes_for(n: Column, shared: Column, *, cosine: float, window: int, recall: float = RECALL) -> Column:
    """Passes that find ``recall`` of the pairs at the cosine among ``n`` vectors of mean cosine ``shared``.

    Without their mean, two vectors at the cosine have the cosine ``rest`` and
    agree in a sign with the chance ``same``. They lie within the window when
    they agree in the signs that cut ``n`` vectors down to it.
    """
    rest = F.greatest((cosine - shared) / F.greatest(1 - shared, F.lit(1e-9)), F.lit(0.0))
    same = 1 - F.acos(F.least(rest, F.lit(1.0))) / math.pi
    found = F.pow(same, F.log2(n / F.lit(float(window))))
    return F.when((n <= window + 1) | (found >= recall), F.lit(1)).otherwise(
        F.ceil(F.lit(math.log(1 - recall)) / F.log(1 - found))).cast("long")


def centres(nodes: DataFrame) -> DataFrame:
    """(label, dims, size, centre, shared): mean of the unit vectors of each label and its square, the mean cosine."""
    def adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for at, x in matrices(batch.column("embedding")):
                names, of = np.unique(labels[at], return_inverse=True)
                sums = np.zeros((len(names), x.shape[1]))
                np.add.at(sums, of, unit(x))
                yield pa.RecordBatch.from_pydict({
                    "label": pa.array(np.repeat(names, x.shape[1])),
                    "dims": pa.array(np.full(sums.size, x.shape[1], np.int32)),
                    "i": pa.array(np.tile(np.arange(x.shape[1], dtype=np.int32), len(names))),
                    "s": pa.array(sums.ravel())})

    size = nodes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("size"))
    sums = nodes.select("label", "embedding").mapInArrow(adding, "label long, dims int, i int, s double").groupBy(
        "label", "dims", "i").agg(F.sum("s").alias("s")).join(size, ["label", "dims"])
    return sums.groupBy("label", "dims", "size").agg(
        F.sort_array(F.collect_list(F.struct("i", (F.col("s") / F.col("size")).alias("m")))).alias("means")).select(
        "label", "dims", "size", F.col("means.m").alias("centre"),
        F.aggregate("means", F.lit(0.0), lambda t, e: t + e["m"] * e["m"]).alias("shared"))


def pass_links(nodes: DataFrame, *, cosine: float, first: int, passes: int, window: int, block: int, seed: int) -> DataFrame:
    """Links (label, dims, a, b) that span what the windows of the passes from ``first`` on link.

    A node takes part in the passes up to its ``until``; a NULL ``centre`` stands for the origin.
    """
    def projecting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column("embedding")):
                rows = batch.select(["label", "rep", "until", "centre"]).take(pa.array(at))
                centred = np.flatnonzero(rows.column("centre").is_valid().to_numpy(zero_copy_only=False))
                x = unit(x)
                if len(centred):
                    (_, centre), = matrices(rows.column("centre").take(pa.array(centred)))  # as many dimensions as the vectors
                    x[centred] -= centre
                until = rows.column("until").to_numpy()
                for p in range(first, min(first + passes, int(until.max()))):
                    own = np.flatnonzero(until > p)
                    mine = rows.take(pa.array(own))
                    yield pa.RecordBatch.from_pydict({
                        "pass": pa.array(np.full(len(own), p, np.int32)), "dims": pa.array(np.full(len(own), x.shape[1], np.int32)),
                        "label": mine.column("label"), "key": pa.array(signs(x[own], p, seed)), "rep": mine.column("rep")})

    def comparing(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank").combine_chunks()
        labels, reps = group.column("label").to_numpy(), group.column("rep").to_numpy()
        rank, turn = group.column("rank").to_numpy(), group.column("pass").to_numpy()
        dims = group.column("dims").to_numpy()
        own = rank // block == rank[0] // block
        place = np.cumsum(np.append(True, (labels[1:] != labels[:-1]) | (turn[1:] != turn[:-1])))  # label and pass

        def pairs():
            for at, x in matrices(group.column("embedding").combine_chunks()):
                for i, j in window_links(place[at], x, own[at], window, cosine):
                    yield at[i], at[j]

        a, b = spanning(len(reps), pairs())
        return pa.table({"label": pa.array(labels[a]), "dims": pa.array(dims[a]), "a": pa.array(reps[a]), "b": pa.array(reps[b])})

    keys = nodes.select("label", "rep", "embedding", "until", "centre").mapInArrow(
        projecting, "pass int, dims int, label long, key long, rep long")
    placed = numbered(keys, [F.col(c) for c in ("pass", "dims", "label", "key", "rep")])
    own = F.floor(F.col("rank") / block).cast("long")
    # the first rows of a block are also the last neighbours of the block before
    both = F.when((F.col("rank") % block < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    rows = placed.select("pass", "dims", "rep", "rank", F.explode(both).alias("block")).join(
        nodes.select("rep", "label", "embedding"), "rep")
    return rows.groupBy("block").applyInArrow(comparing, "label long, dims int, a long, b long")


def linked(nodes: DataFrame, *, cosine: float, passes: int, window: int, block: int, seed: int) -> DataFrame:
    """(node, component) of all nodes with a link, all found by passes.

    A label of at most ``window`` + 1 vectors lies whole in every window of its one pass, so nothing is
    missed there. The others get their passes (``passes_for``) around their own centre and further
    rounds until a round adds no link between two components.
    """
    nodes = nodes.withColumn("dims", F.size("embedding"))
    group = ["label", "dims"]
    sizes = settled(nodes.groupBy(*group).agg(F.count(F.lit(1)).alias("size")))
    small = sizes.where(F.col("size") <= window + 1).select(
        *group, F.lit(1).cast("long").alias("need"), F.lit(None).cast("array<double>").alias("centre"))
    large = sizes.where(F.col("size") > window + 1)
    active = small
    if not large.isEmpty():
        need = passes_for(F.col("size"), F.col("shared"), cosine=cosine, window=window)
        active = small.union(centres(nodes.join(large.select(*group), group, "left_semi")).select(
            *group, F.greatest(need, F.lit(2)).alias("need"), "centre"))
    active = settled(active)
    found, done = None, 0
    while not active.isEmpty():
        # a label that needs one pass has it in the first round, the others take part in all passes of a round
        until = F.when(F.col("need") == 1, 1).otherwise(done + passes).cast("long")
        rows = nodes.join(active.select(*group, "centre", until.alias("until")), group)
        links = settled(pass_links(rows, cosine=cosine, first=done, passes=passes, window=window, block=block, seed=seed))
        done += passes
        if found is None:
            new, found = links, components(links.select("a", "b"))
        else:
            ends = [found.select(F.col("node").alias(e), F.col("component").alias("of_" + e)) for e in ("a", "b")]
            new = settled(links.join(ends[0], "a", "left").join(ends[1], "b", "left").where(
                F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select(*group, "a", "b"))
            if not new.isEmpty():
                found = components(found.toDF("a", "b").union(new.select("a", "b")))
        grown = new.select(*group, F.lit(True).alias("grown")).distinct()
        active = settled(active.where("need > 1").join(grown, group, "left").where(
            (F.col("need") > done) | F.col("grown")).drop("grown"))
    return nodes.sparkSession.createDataFrame([], "node long, component long") if found is None else found


def count_links(nodes: DataFrame, found: DataFrame, cosine: float, tile: int) -> DataFrame:
    """(rep, links): vectors of the same component that reach the cosine with each node, copies counted.

    Components of up to ``tile`` nodes are dealt into even groups; a larger one
    is cut into tiles and every two tiles meet in a task of their own. Only
    counts leave a task.
    """
    members = settled(nodes.join(found.select(F.col("node").alias("rep"), "component"), "rep"))
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size")).select(
        F.col("component").alias("of"), F.ceil(F.col("size") / tile).cast("int").alias("tiles"))
    total = members.count()
    bins = max(1, -(-total // tile))
    rows = members.join(sizes, F.col("component") == F.col("of"))
    own = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    rows = rows.withColumn("tile", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumns({
        "place": F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")),
        "x": F.least("tile", "other"), "y": F.greatest("tile", "other")})

    def counting(group: pa.Table) -> pa.Table:
        group = group.sort_by("component").combine_chunks()
        component, tile_of = group.column("component").to_numpy(), group.column("tile").to_numpy()
        n, label = group.column("n").to_numpy(), group.column("label").to_numpy()
        links = np.zeros(len(n), np.int64)
        crossing = group.column("x")[0].as_py() != group.column("y")[0].as_py()
        for at, x in matrices(group.column("embedding").combine_chunks()):
            x = unit(x)
            edges = np.append(np.flatnonzero(np.append(True, np.diff(component[at]) != 0)), len(at))
            for s, e in zip(edges, edges[1:]):
                for p in range(s, e, 512):
                    q = min(p + 512, e)
                    good = (x[p:q] @ x[s:e].T >= cosine) & (label[at[p:q], None] == label[None, at[s:e]])
                    if crossing:
                        good &= tile_of[at[p:q], None] != tile_of[None, at[s:e]]
                    good[np.arange(q - p), np.arange(p - s, q - s)] = False
                    links[at[p:q]] += good @ n[at[s:e]]
        return pa.table({"rep": group.column("rep"), "links": pa.array(links)})

    return rows.select("rep", "label", "embedding", "n", "component", "tile", "place", "tiles", "x", "y").groupBy(
        "place", "tiles", "x", "y").applyInArrow(counting, "rep long, links long").groupBy("rep").agg(
        F.sum("links").alias("links"))


def judge(vectors: DataFrame, *, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW,
          block: int = BLOCK, tile: int = TILE, seed: int = SEED) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Two vectors link when their labels are equal, their dimensions too, and
    their cosine in double precision reaches ``cosine``. The passes find the
    components; inside a component every pair is then compared once, so
    ``n_links`` misses no link of a component however many neighbours a
    vector has, and no link below the cosine counts. A label of at most ``window`` + 1
    vectors is whole in one pass; in a larger one a pass finds a pair unless its signs part the two
    further than the window, passes are independent and go on until they add nothing.

    Vectors that are NULL, zero, hold a NULL or non-finite entry, or have a
    NULL label or id link with nothing: 0 links, a component of their own,
    kept. Rows of one id are one vector, the least by label and content, and
    get equal results. Copies of a vector are one node with a count, brought
    together by an aggregate, so a hot vector is one row everywhere. Blocks
    are cut by position and not by label, so a hot label makes more blocks. An empty
    table gives no row; other columns are not read.
    """
    good = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    good = good.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.*")
    good = settled(good)
    nodes = settled(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    found = linked(nodes, cosine=cosine, passes=passes, window=window, block=block, seed=seed)
    counts = count_links(nodes, found, cosine, tile).withColumnRenamed("rep", "r")
    nodes_known = nodes.join(found, F.col("rep") == F.col("node"), "left").join(
        counts, F.col("rep") == F.col("r"), "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
        F.coalesce("component", "rep").alias("component"))
    owned = balanced_join(nodes_known, good, ["label", "embedding"], F.lit(True), ["vec_id"], policy=POLICY).select(
        "vec_id", "links", "component")
    rows = vectors.select(F.col("vec_id").cast("long"), F.monotonically_increasing_id().alias("at"))  # spreads a hot id
    return attach(rows, owned, ["vec_id"], policy=POLICY).select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"))


@register("op1_embedding_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "embeddings"))
