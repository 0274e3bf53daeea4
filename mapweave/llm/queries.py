"""The queries opN_<name> and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe_chunks, chat, collocations, exact_dedup, id_files, jpeg, near_dedup, packing, quality, sharding, token_counts, warc
from .common import materialize, table, text_of, work_dir

#: Entries of byte_bpe_50k.json.
VOCABULARY = 50_257


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.decide(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.features(jpeg.store(table(spark, sf_dir, "documents")))


def op4_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)
"""


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    d = chat.read_back(chat.format_paths(chat.chains(rows.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_length(c: str) -> str:
    """DuckDB: code points of c when escaped."""
    return f"(length({c}) + 4 * (length({c}) - length(replace({c}, '&', ''))) + 3 * (length({c}) - length(replace(replace({c}, '<', ''), '>', ''))) + 4 * (length({c}) - length(replace(replace({c}, '[', ''), ']', ''))))"


OP8_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    7 + sum(21 + {_escaped_length('role')} + {_escaped_length('text')}) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts every document with a provisional count (a token per four bytes), revises all counts to exact ones, deletes the documents whose id and size are both even, inserts those again, and replays all batches, which changes nothing."""
    exact = materialize(token_counts.counted(table(spark, sf_dir, "documents")), "counted")
    guess, none = F.expr("n_bytes div 4"), F.lit(None).cast("long")
    some = exact.where("doc_id % 2 = 0 and n_bytes % 2 = 0").withColumn("old_tokens", none)
    batches = {
        "insert-1": exact.withColumns({"kind": F.lit("insert"), "n_tokens": guess, "old_tokens": none}),
        "revise-1": exact.withColumns({"kind": F.lit("revise"), "old_tokens": guess}),
        "delete-1": some.withColumn("kind", F.lit("delete")),
        "insert-2": some.withColumn("kind", F.lit("insert")),
    }
    rollup = token_counts.Rollup(spark, work_dir(spark, "rollup"))
    for batch, changes in [*batches.items(), *batches.items()]:
        rollup.commit(batch, changes)
    return rollup.totals()


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(warc.decide(table(spark, sf_dir, "pages"))))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT t, max(page_id) AS keep FROM p WHERE n >= {warc.REVISIT_BYTES} GROUP BY t)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.t) AS payload_digest,
  CASE WHEN g.keep IS NULL OR g.keep = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.keep <> p.page_id THEN g.keep END AS refers_to
FROM p LEFT JOIN g ON p.n >= {warc.REVISIT_BYTES} AND p.t = g.t
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    text = text_of("record.text")
    return d.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(text) + sharding.ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.score(table(spark, sf_dir, "documents"))


def op12_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = id_files.read(id_files.write(table(spark, sf_dir, "documents"), VOCABULARY))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH d AS (
  SELECT coalesce(lang, '{collocations.UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])))) AS words FROM w),
f AS (SELECT lang, words, len(words) AS k, count(*) AS n FROM g GROUP BY lang, words),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, words, k, n AS a FROM f WHERE k > 1 AND n >= {collocations.LEAST}),
cuts AS (SELECT *, unnest(range(1, k)) AS j FROM c),
s AS (
  SELECT u.lang, u.words, u.a, u.j, x.n AS l, y.n AS r, CAST(2000000::HUGEINT * u.a // (x.n + y.n) AS BIGINT) AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.words = u.words[1:u.j] JOIN f y ON y.lang = u.lang AND y.words = u.words[u.j + 1:u.k]),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, j) = 1),
inside AS (
  SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: words[i:i + m - 1])))) AS words FROM c WHERE k > 2),
around AS (SELECT lang, words, max(a) AS most FROM inside GROUP BY lang, words),
kept AS (
  SELECT b.lang, array_to_string(b.words, ' ') AS phrase, b.a, b.l, b.r, b.score
  FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.words = b.words WHERE o.most IS NULL OR 100 * o.most < {collocations.COVERED} * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score
FROM kept k JOIN total t ON t.lang = k.lang QUALIFY rank <= {collocations.TOP}
"""


def queries() -> dict:
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op8_chat_format": OP8_SQL, "op9_warc": OP9_SQL, "op13_collocations": OP13_SQL}
