"""Two-pass external shuffle into shards. DataFrame operations only.

Pass 1 scatters records into buckets of about bucket_bytes by a seeded hash of id and text, a partition per bucket (beyond MOST_PARTITIONS, per few buckets). Pass 2 gathers each bucket (its size is bounded by
construction), puts its records in order of id and text, Fisher-Yates shuffles it (Spark's seeded `shuffle` of an array is one) and writes it in the shared folder. A record's
place in the whole order is the number of records in earlier buckets plus its place in its own; shard s holds a contiguous run of places.

Law `rows`: shard sizes differ by one row at most. The order follows from the seed and the records, not from how files are split, how many tasks read them or what
spark.sql.shuffle.partitions says (but for null ids, which are told apart by where they are read).
Defined results: null texts are empty; null or repeated ids and repeated rows are ordinary records (each row is placed once; rows that repeat both id and text share a bucket up to half its size, more of them are told apart by where they are read and dealt over several); an empty table gives
no rows; a record larger than bucket_bytes has its bucket to itself but for what the hash sends there. Other columns travel with the record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of

#: Bytes of text that a bucket holds on average; a task has about three times that in memory.
BUCKET_BYTES = 8 << 20
#: What a record costs besides its text.
ROW_BYTES = 16
#: Partitions of the scatter at most; more buckets share them.
MOST_PARTITIONS = 1 << 17


def shuffled(docs: DataFrame, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs in a nested column `record`, with `bucket` and `place` (from 0, within the bucket), written in the shared folder."""
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")
    total = docs.agg(F.sum(F.octet_length(text_of()) + ROW_BYTES)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    scattered = docs.select(record).withColumn("uid", F.monotonically_increasing_id())
    own = F.coalesce(F.col("record.doc_id").cast("string"), F.concat(F.lit("row "), F.col("uid")))  # null ids spread as any others do
    scattered = scattered.withColumns({"own": own, "h": F.xxhash64(text_of("record.text"))})
    # rows that repeat id and text and would fill a bucket are dealt over as many as they need
    size = F.sum(F.octet_length(text_of("record.text")) + ROW_BYTES)
    often = materialize(scattered.groupBy("own", "h").agg(size.alias("size")).where(F.col("size") > bucket_bytes // 2).select("own", "h", F.expr(f"size div {max(1, bucket_bytes // 4)} + 1").alias("parts")), "repeated")
    scattered = scattered.join(often, ["own", "h"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("uid"), "parts"), F.lit(0)))
    scattered = scattered.withColumn("bucket", F.pmod(F.pmod(F.xxhash64(F.lit(seed), "own", "h"), F.lit(buckets)) + F.col("part"), F.lit(buckets)))
    dealt = scattered.repartition(min(buckets, MOST_PARTITIONS), "bucket")
    gathered = dealt.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("record.doc_id", "h", "uid", "record"))).alias("all")).sortWithinPartitions("bucket")
    mixed = gathered.select("bucket", F.posexplode(F.shuffle("all", F.lit(seed))).alias("place", "one"))
    return materialize(mixed.select("bucket", F.col("place").cast("long").alias("place"), F.col("one.record").alias("record")), "shuffled")


def before(counts: DataFrame, run: int = 4096) -> DataFrame:
    """bucket and `before`: records (n) in earlier buckets. Sums go over runs of buckets, then within each run."""
    runs = counts.withColumn("run", F.expr(f"bucket div {run}"))
    tops = runs.groupBy("run").agg(F.sum("n").alias("of_run")).withColumn("earlier", F.sum("of_run").over(Window.orderBy("run")) - F.col("of_run"))
    own = F.sum("n").over(Window.partitionBy("run").orderBy("bucket")) - F.col("n")
    return runs.join(tops, "run").select("bucket", (F.col("earlier") + own).alias("before"))


def shard(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """`record` with shard and slot (gapless from 0 in each shard)."""
    mixed = shuffled(docs, seed, bucket_bytes)
    counts = materialize(mixed.groupBy("bucket").agg(F.count("*").alias("n")), "buckets")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    placed = mixed.join(before(counts), "bucket").withColumn("at", F.col("before") + F.col("place"))
    placed = placed.withColumn("shard", F.expr(f"(at * {shards}L) div {max(rows, 1)}L"))
    first = F.expr(f"(shard * {rows}L + {shards - 1}L) div {shards}L")  # the first place of that shard
    return placed.select("record", F.col("shard").cast("int").alias("shard"), (F.col("at") - first).alias("slot"))


def write(docs: DataFrame, path: str, **options) -> None:
    """Records under path/shard=N, each file in slot order."""
    shard(docs, **options).select("record.*", F.col("shard").alias("__shard"), F.col("slot").alias("__slot")).sortWithinPartitions("__shard", "__slot").write.partitionBy("__shard").parquet(path)
