"""Exact dedup by an extendible-hash index kept in shared files. DataFrame operations only.

Keys are 64-bit hashes of whole texts. From the distinct keys the directory grows: it starts with one bucket, doubles (one more leading key bit) while a bucket holds more keys than its
capacity, and only overfull buckets split. The directory then routes every row to its bucket, a range of keys, and a bucket's rows to the
task that owns it. Owners group equal keys and compare the texts' bytes; texts that share a key are chained. Their entries are the index, written in the shared folder in order of
bucket and key. Documents are answered from it: directory to bucket, bucket to key, and along the chain by the texts' bytes where a key has several.

Rows of a hot key (more than one in HOT_SHARE of all rows) are added up by key and text before they are dealt, so no owner gets a hot text's rows. The directory has at most a few times MOST_BUCKETS entries, because buckets
grow beyond CAPACITY keys where there would be more; it is broadcast up to BROADCAST entries and joined by shuffle beyond.

Defined results: null texts count as empty; of equal texts the row with the largest doc_id stays (null ids are smallest); rows that repeat a
doc_id and its text get the same answer each; very long texts are rows like others; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_hot, materialize, text_of

#: Keys that a bucket of the index may hold (more where that would make over MOST_BUCKETS buckets), and directory entries up to which it is broadcast.
CAPACITY, MOST_BUCKETS, BROADCAST = 512, 1 << 17, 1 << 19
#: Leading key bits the directory may use.
MAX_DEPTH = 40
#: A key with more than one in so many rows is hot; bytes of text that an owner task gets on average.
HOT_SHARE, OWNER_BYTES = 1000, 16 << 20


def _prefix(depth: int, key: str = "h") -> Column:
    return F.shiftrightunsigned(F.col(key), 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(depth, prefix, n) of each bucket for distinct keys in a long column h. A pass counts the keys of many depths at once; only buckets still overfull at its deepest level take another."""
    total = keys.count()
    capacity = max(capacity, -(-total // MOST_BUCKETS))
    depth, step, over, leaves = 0, max(1, (4 * total // capacity).bit_length()), None, None
    while True:
        deep = min(MAX_DEPTH, depth + step)
        rows = keys if over is None else keys.join(over, _prefix(depth) == F.col("up"), "left_semi")
        fine = rows.groupBy(_prefix(deep).alias("fine")).agg(F.count("*").alias("n"))
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(deep)))).withColumn("prefix", F.expr(f"shiftrightunsigned(fine, {deep} - depth)"))
        nodes = materialize(levels.groupBy("depth", "prefix").agg(F.sum("n").alias("n")), "directory")
        fits = (F.col("n") <= capacity) | ((F.col("depth") == deep) & F.lit(deep == MAX_DEPTH))
        split = nodes.where((F.col("n") > capacity) & (F.col("depth") < deep))
        parents = split.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(2 * F.col("prefix"), 2 * F.col("prefix") + 1)).alias("prefix"))
        found = nodes.where(fits).join(parents, ["depth", "prefix"], "left_semi")
        if depth == 0:
            found = found.unionByName(nodes.where(fits & (F.col("depth") == 0)))
        leaves = found if leaves is None else leaves.unionByName(found)
        over = nodes.where((F.col("depth") == deep) & (F.col("n") > capacity)).select(F.col("prefix").alias("up"))
        if deep == MAX_DEPTH or over.isEmpty():
            return materialize(leaves.select("depth", "prefix", "n"), "directory")
        depth, step = deep, 4


@dataclass
class Index:
    #: One row per distinct text: h, bucket, chain (place among texts of that key), chained, text_sha256, n_bytes, keep_id, group_size.
    entries: DataFrame
    directory: DataFrame
    #: doc_id, text, h and bucket of every document.
    routed: DataFrame
    #: h and count of rows.
    keys: DataFrame


def route(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """Adds each row's bucket: its prefix after a leading 1, which tells depths apart."""
    depths = sorted(r[0] for r in tree.select("depth").distinct().collect())  # at most MAX_DEPTH + 1 numbers
    small = tree.count() <= BROADCAST
    for d in depths:
        level = tree.where(F.col("depth") == d).select(F.col("prefix").alias(f"p{d}"))
        rows = rows.join(F.broadcast(level) if small else level, _prefix(d) == F.col(f"p{d}"), "left")
    found = F.coalesce(*[F.col(f"p{d}") + F.lit(1 << d) for d in depths], F.lit(0).cast("long"))
    return rows.withColumn("bucket", found).drop(*[f"p{d}" for d in depths])


def build(docs: DataFrame, capacity: int = CAPACITY, key: Callable[[Column], Column] = F.xxhash64, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """key: the hash of a text, to be replaced in tests only."""
    hashed = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("h", key(F.col("text")).cast("long"))
    size = F.octet_length("text").cast("long")
    keys = materialize(hashed.groupBy("h").agg(F.count("*").alias("count"), F.sum(size).alias("bytes")), "keys")
    tree = directory(keys.select("h"), capacity)
    total, total_bytes = keys.agg(F.sum("count"), F.sum("bytes")).first()
    routed = route(hashed, tree)
    hot = materialize(keys.where(F.col("count") > (total or 0) / HOT_SHARE).select("h"), "hot")  # fewer than HOT_SHARE
    one = ["bucket", "h", "text"]
    few = routed.join(F.broadcast(hot), "h").groupBy(*one).agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n"))
    rest = routed.join(F.broadcast(hot), "h", "left_anti").select(*one, "doc_id", F.lit(1).cast("long").alias("n"))
    owners = max((total_bytes or 0) // OWNER_BYTES, docs.sparkSession.sparkContext.defaultParallelism)
    owned = few.unionByName(rest).repartition(owners, "bucket").groupBy(*one).agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    owned = owned.select("bucket", "h", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").alias("n_bytes"), "keep_id", "group_size")
    chain = Window.partitionBy("bucket", "h")
    owned = owned.withColumn("chain", F.row_number().over(chain.orderBy("n_bytes", "text_sha256"))).withColumn("chained", F.count("*").over(chain) > 1)
    return Index(materialize(owned.sortWithinPartitions("bucket", "h"), "index"), tree, routed, keys)


def lookup(index: Index) -> DataFrame:
    """A row per document: doc_id, h, keep_id, group_size, kept, text_sha256."""
    light = index.entries.select("bucket", "h", "chained", "keep_id", "group_size", "text_sha256")
    place = F.struct("bucket", "h")
    chained = light.where("chained").select("bucket", "h").distinct()
    alone = light.where(~F.col("chained")).select(place.alias("place"), "keep_id", "group_size", "text_sha256")
    rows = index.routed.select("doc_id", "h", place.alias("place"))
    counts = alone.select("place", F.col("group_size").alias("count"))
    found = join_hot(rows, alone, "place", counts, HOT_SHARE).where(F.col("keep_id").isNotNull() | F.col("group_size").isNotNull())
    out = found.select("doc_id", "h", "keep_id", "group_size", "text_sha256")
    if not chained.isEmpty():  # keys that several texts share: bytes decide
        some = index.routed.join(chained, ["bucket", "h"], "left_semi")
        groups = some.groupBy("bucket", "h", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        theirs = some.join(groups, ["bucket", "h", "text"]).withColumn("text_sha256", F.sha2("text", 256))
        out = out.unionByName(theirs.select("doc_id", "h", "keep_id", "group_size", "text_sha256"))
    return out.select("doc_id", "h", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def decide(docs: DataFrame, **options) -> DataFrame:
    return lookup(build(docs, **options)).drop("h")


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat id and text, one."""
    own_id, own_h, n, key = fresh(docs, "id", "h", "n", "key")
    kept = lookup(build(docs, **options)).where("kept").groupBy(F.col("doc_id").alias(own_id), F.col("h").alias(own_h)).agg(F.count("*").alias(n))
    rows = docs.withColumn(key, F.xxhash64(text_of()))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept[own_id]) & (rows[key] == kept[own_h]))
    plain, again = rows.where(F.col(n) == 1), rows.where(F.col(n) > 1)
    return plain.unionByName(again.dropDuplicates([own_id, own_h])).select(*[rows[f"`{c}`"] for c in docs.columns])
