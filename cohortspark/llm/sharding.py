"""Operator 9, sharding by a two-pass external shuffle.

First pass: a seeded hash scatters the records uniformly into buckets that fit
in memory. Second pass: each bucket is Fisher-Yates shuffled (``shuffle`` of
its array, seeded by bucket) and written. Read bucket after bucket, the records
lie in a random order; shards deal that order out. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.registry import register
from cohortspark.llm.tables import settled, shuffle_partitions, table

SHARDS = 8
SEED = 9


def shuffled(records: DataFrame, *, seed: int = SEED, bucket_rows: int = 50_000,
             bucket_bytes: int = 64 << 20, weight: str | None = None) -> DataFrame:
    """``rec`` (the whole row) and ``position``, a random place from 0 without gaps.

    Buckets hold about ``bucket_rows`` records and, when ``weight`` names a
    column of bytes, about ``bucket_bytes``; there are at least as many as
    shuffle partitions. The hash covers the whole record and its place in the
    input, so copies and a hot source spread over all buckets. A bucket is put
    in order before it is shuffled and is shuffled in the partition of its own
    number, so a rerun of a lost task repeats it; the written buckets fix it.
    Empty input gives no row; NULLs, repeated rows and clashing names are
    ordinary content of ``rec``.
    """
    spark = records.sparkSession
    rows, total = records.agg(
        F.count(F.lit(1)), F.sum(weight) if weight else F.lit(0)).first()
    buckets = max(shuffle_partitions(spark), -(-rows // bucket_rows), -(-int(total or 0) // bucket_bytes))
    held = records.select(
        F.struct(*records.columns).alias("rec"), F.monotonically_increasing_id().alias("at"))
    mark = F.xxhash64(F.lit(seed), F.col("rec"), F.col("at"))
    scattered = held.select("rec", "at", F.pmod(mark, F.lit(buckets)).cast("int").alias("bucket")).repartitionById(
        buckets, F.col("bucket"))  # the aggregate finds its bucket whole, so the records move once
    filled = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("at", "rec"))).alias("records"))
    written = settled(filled.select(
        "bucket", F.size("records").alias("n"), F.shuffle("records", F.lit(seed)).alias("records")))
    return written.join(F.broadcast(offsets(written.select("bucket", "n"))), F.col("bucket") == F.col("of")).select(
        "offset", F.posexplode("records").alias("i", "r")).select(
        F.col("r.rec").alias("rec"), (F.col("offset") + F.col("i")).alias("position"))


def offsets(sizes: DataFrame, run: int = 1_024) -> DataFrame:
    """(of, offset): records before each bucket, summed by runs of buckets first; two short numbers a bucket."""
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.col("bucket") / run)
    runs = sizes.groupBy(part.alias("run")).agg(F.sum("n").alias("n")).select(
        F.col("run").alias("of_run"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy(part).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("bucket", part.alias("run"), F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("inside")).join(
        runs, F.col("run") == F.col("of_run")).select(
        F.col("bucket").alias("of"), (F.col("start") + F.col("inside")).alias("offset"))


def shards(records: DataFrame, n: int = SHARDS, **options) -> DataFrame:
    """``rec``, ``shard`` and ``slot``: record ``p`` of the random order goes to shard ``p mod n``.

    The law is ``rows``: counts differ by one at most and slots have no gaps.
    """
    at = F.col("position")
    return shuffled(records, **options).select(
        "rec", F.pmod(at, F.lit(n)).cast("int").alias("shard"), F.floor(at / n).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, n: int = SHARDS, file_rows: int = 1_000_000) -> None:
    """Write the records below ``path/shard=<k>``, in the order of their slots within and between files."""
    part = F.floor(F.col("slot") / file_rows)
    (sharded.repartition(shuffle_partitions(sharded.sparkSession), "shard", part)
     .sortWithinPartitions("shard", "slot")
     .select("rec.*", F.col("slot").alias("_slot"), F.col("shard").alias("_shard"))
     .write.partitionBy("_shard").parquet(path))


@register("op9_shuffle_shards")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    text = F.coalesce("text", F.lit(""))
    records = docs.select("doc_id", "text", (F.octet_length(text) + 1).cast("long").alias("size"))
    moved = F.coalesce("rec.text", F.lit(""))
    return shards(records, weight="size").select(
        F.col("rec.doc_id").alias("doc_id"), (F.octet_length(moved) + 1).cast("long").alias("size"),
        F.crc32(moved).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
