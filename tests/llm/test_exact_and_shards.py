import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from mapweave.llm import exact_dedup, sharding


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((r["doc_id"], keep[r["text"] or ""], len(groups[r["text"] or ""])) for r in rows), key=repr)


def decided(docs, **options):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.decide(docs, **options).collect()), key=repr)


def test_exact_copies(docs):
    assert decided(docs) == brute(docs.collect())


def test_colliding_keys_are_told_apart(docs):
    assert decided(docs, key=lambda t: F.length(t) % 2) == brute(docs.collect())


def test_overfull_buckets_split(docs):
    index = exact_dedup.build(docs, capacity=2)
    tree = index.directory.collect()
    assert len(tree) > 1 and all(r["n"] <= 2 for r in tree) and sum(r["n"] for r in tree) == index.entries.count()
    assert decided(docs, capacity=2) == brute(docs.collect())
    assert decided(docs, capacity=2, key=lambda t: F.length(t) % 5) == brute(docs.collect())


def test_stage_keeps_all_columns_and_one_of_repeated_rows(docs):
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter({2: 1, 3: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, None: 1, 11: 1, 12: 1})


def test_no_documents(empty):
    assert exact_dedup.decide(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_shards_hold_each_row_once_and_differ_by_one(docs):
    got = sharding.shard(docs, shards=4, bucket_bytes=4000).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    n = docs.count()
    assert Counter(r["record"]["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {len(s) for s in slots.values()} <= {n // 4, -(-n // 4)} and set(slots) == {0, 1, 2, 3}
    assert {zlib.crc32((r["record"]["text"] or "").encode()) for r in got} == {zlib.crc32((r["text"] or "").encode()) for r in docs.collect()}


def test_seed_decides_the_order(spark):
    d = spark.range(300, numPartitions=3).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    order = lambda seed: [r["record"]["doc_id"] for r in sharding.shard(d, 1, seed, 500).orderBy("slot").collect()]
    a, b, c = order(1), order(1), order(2)
    assert a == b != c and sorted(a) == sorted(c) == list(range(300)) and a != sorted(a)


def test_more_shards_than_rows_and_none(docs, empty):
    assert sharding.shard(docs.limit(3), shards=40).count() == 3
    assert sharding.shard(empty).count() == 0


def test_written_shards(docs, tmp_path, spark):
    sharding.write(docs, str(tmp_path / "out"), shards=3)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("__shard").count().count() == 3


def test_the_index_answers_by_bucket(docs):
    """Every document's bucket is the directory's, its key lies in the bucket's range, and the index has each text once."""
    index = exact_dedup.build(docs, capacity=2)
    buckets = {(1 << r["depth"]) + r["prefix"]: r["depth"] for r in index.directory.collect()}
    for rows in (index.routed.collect(), index.entries.collect()):
        for r in rows:
            d = buckets[r["bucket"]]
            assert (r["h"] % (1 << 64)) >> (64 - d) == r["bucket"] - (1 << d)
    assert index.entries.count() == len({r["text"] or "" for r in docs.collect()})


def test_directory_of_keys_that_share_many_bits(spark):
    keys = [5 << 40 | i for i in range(7)] + [-(1 << 62)]
    tree = {(r["depth"], r["prefix"]): r["n"] for r in exact_dedup.directory(spark.createDataFrame([(k,) for k in keys], "h long"), 3).collect()}
    assert sum(tree.values()) == 8 and max(d for d, _ in tree) == exact_dedup.MAX_DEPTH
    leaves = sorted(tree)
    assert all(p >> (d - e) != q for d, p in leaves for e, q in leaves if e < d)


def test_the_order_does_not_depend_on_how_rows_are_read(spark):
    d = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("t"), (F.col("id") % 40).cast("int")).alias("text"))
    got = []
    for parts, shuffles in ((1, "4"), (7, "4"), (3, "13")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        got.append(sorted((r["record"]["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(d.repartition(parts), 5, 3, 2000).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == got[2]


def test_counts_before_a_bucket(spark):
    counts = spark.createDataFrame([(b, b % 5 + 1) for b in range(60) if b % 7], "bucket long, n long")
    want, total = {}, 0
    for b in range(60):
        if b % 7:
            want[b], total = total, total + b % 5 + 1
    assert {r["bucket"]: r["before"] for r in sharding.before(counts, 8).collect()} == want


def test_a_record_larger_than_a_bucket(docs):
    got = sharding.shard(docs, shards=2, bucket_bytes=100)
    assert got.count() == docs.count()


def test_rows_that_repeat_id_and_text_are_spread(spark):
    d = spark.range(60_000).selectExpr("7 as doc_id", "'the same text of some forty characters' as text").repartition(6)
    got = sharding.shuffled(d, bucket_bytes=200_000)
    sizes = [r["count"] for r in got.groupBy("bucket").count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) * 55 < 2 * 200_000
    placed = sharding.shard(d, shards=7, bucket_bytes=200_000).groupBy("shard").agg({"*": "count", "slot": "max"}).collect()
    assert {r["count(1)"] for r in placed} <= {8571, 8572} and all(r["max(slot)"] == r["count(1)"] - 1 for r in placed)
