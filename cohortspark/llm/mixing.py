"""Operator 6, mixing sources to target weights by systematic sampling.

Inside a source every document expects the same number of copies. Expected
copies are prefix-summed along the source, one random offset is added, and a
document is emitted once for each whole number its sum crosses. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from cohortspark.llm.registry import register
from cohortspark.llm.tables import WORD, numbered, settled, table
from cohortspark.operators.skew import SkewPolicy, attach

UNIT_BITS = 30          # expected copies are whole multiples of 2**-30, so that sums are exact
WEIGHTS = (5, 2, 1)     # of the sources in order, repeating
SHARE = 1.5             # of all sizes
MOST = 2.0              # times its source's size
SEED = 20
POLICY = SkewPolicy()


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weighted shares under a ceiling.

    What a source would get above ``most`` times its size is shared again among
    the others by weight until none is above. One number, the words per unit of
    weight, describes every step, so a step is one aggregate over the sources
    and only two sums reach the driver. Sources are numbered by code point with
    NULL last; numbering has no global window.
    """
    order = [F.col("source").isNull().asc(), F.col("source").asc()]
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = settled(numbered(sizes, order).select(
        "source", "source_size",
        F.element_at(cycle, (F.col("rank") % len(weights)).cast("int") + 1).alias("weight"),
        (F.col("source_size") * F.lit(float(most))).alias("ceiling")))
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    per_weight, held = 0.0, -1
    while True:
        above = F.col("ceiling") <= F.col("weight") * F.lit(per_weight)
        full, weight, n = rows.agg(
            F.sum(F.when(above, F.col("ceiling"))), F.sum(F.when(~above, F.col("weight"))),
            F.count_if(above)).first()
        if n == held or not weight:
            break
        per_weight, held = (total - (full or 0.0)) / weight, n
    ended = F.col("ceiling") if held >= 0 and not weight else F.least(
        "ceiling", F.col("weight") * F.lit(per_weight))
    return rows.select("source", "source_size", ended.alias("target"))


def mix(docs: DataFrame, *, size: Column | None = None, seed: int = SEED, group_rows: int = 2_000,
        weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``rec`` (the whole row), size, source_size, target and copies, one row per row of ``docs``.

    Documents of one source are ordered by size class, then by a seeded hash
    into groups of about ``group_rows`` rows (the classes are counted first), then by size: a systematic sample
    along sizes keeps the source's words near its target, and no window holds
    more than one group, however large a source or class is. Groups' sums are
    prefix-summed on their own small table. Sums are whole numbers of
    ``2**-UNIT_BITS`` copies and only their remainder is carried, so nothing
    is rounded and nothing overflows: no document exceeds ``most`` copies
    rounded up. Reruns agree: the order and the offset depend on the rows alone.

    A NULL text has size 0, a NULL source is a source of its own (the last);
    a source without words has target 0 and expects no copy. Repeated rows
    are rows of their own; equal order keys belong to equal rows. An empty table
    gives no row. Other columns stay inside ``rec``.
    """
    measured = docs.select(
        F.struct("*").alias("rec"), F.col("source").alias("k"), F.col("doc_id").alias("d"),
        (word_count(F.col("text")) if size is None else size).alias("size"))
    sized = measured.withColumns({  # the whole row marks it, so rows without id spread, too
        "mark": F.xxhash64(F.lit(seed), F.col("d"), F.col("size"), F.col("rec")),
        "band": F.floor(F.log2(F.col("size") + 1) * 8).cast("int")})
    narrow = settled(sized.select("k", "size", "mark", "band"))
    totals = narrow.groupBy("k").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    classes = narrow.groupBy("k", "band").agg(F.ceil(F.count(F.lit(1)) / group_rows).alias("spread"))
    unit = 1 << UNIT_BITS
    sources = targets(totals.select(F.col("k").alias("source"), "source_size"), weights, share, most)
    sources = sources.select(
        F.col("source").alias("s"), "source_size", "target",
        F.coalesce(F.round(F.try_divide("target", "source_size") * unit), F.lit(0)).cast("long").alias("step"),
        F.pmod(F.xxhash64(F.lit(seed), F.col("source")), F.lit(unit)).alias("start"))

    def slotted(rows):
        return attach(rows, classes, ["k", "band"], policy=POLICY).withColumn(
            "slot", F.pmod("mark", F.col("spread")).cast("int")).drop("spread")

    groups = slotted(narrow).groupBy("k", "band", "slot").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.join(sources, F.col("k").eqNullSafe(F.col("s")))
    before = Window.partitionBy("k").orderBy("band", "slot").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.pmod(F.col("n") * F.col("step"), F.lit(unit))
    groups = groups.select(
        "k", "band", "slot", "source_size", "target", "step",
        (F.col("start") + F.coalesce(F.sum(rest).over(before), F.lit(0))).alias("from"))

    placed = attach(slotted(sized), groups, ["k", "band", "slot"], policy=POLICY)
    line = Window.partitionBy("k", "band", "slot").orderBy("size", "mark", "d")
    upto = F.pmod(F.col("from"), F.lit(unit)) + F.col("step") * F.row_number().over(line)
    return placed.withColumn("upto", upto).select(
        "rec", "size", "source_size", "target",
        (F.shiftright("upto", UNIT_BITS) - F.shiftright(F.col("upto") - F.col("step"), UNIT_BITS)).alias("copies"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken."""
    return mixed.where("copies > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("rec.*")


@register("op6_source_mix")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    # the texts are read once, for their word counts; the mix reads narrow rows
    narrow = settled(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("mark")))
    return mix(narrow, size=F.col("words")).select(
        F.col("rec.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"))
