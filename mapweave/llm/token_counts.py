"""Token totals by source, language and tokenizer version, kept up by deltas.

A batch of changes (insert, delete, revise) becomes signed totals: an insert adds a document and its tokens, a delete takes them away, a revision adds the
difference of the counts. A batch is written as a small Parquet table under its writer's own name and committed by a file of the batch's id, which names that table and gets its name by a rename that fails where
it is taken; a batch that is already committed is left alone, and what a writer that died or came second has left is never read, so replays, retries and races change nothing. Totals are sums over committed deltas; `compact` folds them into one.

Defined results: null sources, languages or versions are keys of their own; null counts are 0; an unknown kind of change is an error; an empty
batch commits nothing but its id; groups whose totals are all zero are left out; repeated change rows count each; very long texts are counted whole; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import text_of

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
#: The commit file of a compaction; no batch id has its first letter.
COMPACTED = "_compacted"
VERSIONS = {tokens.BYTE_BPE.removesuffix(".json"): tokens.ByteBpe, tokens.WORD_BPE.removesuffix(".json"): tokens.WordBpe}
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_bytes long"


def counted(docs: DataFrame, versions: tuple[str, ...] = tuple(VERSIONS)) -> DataFrame:
    """doc_id, source, lang, n_bytes, tokenizer_version and the exact n_tokens of each whole text, a row per version."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [tokens.shared(VERSIONS[v]) for v in versions]
        for b in batches:
            texts = b.column("text").to_pylist()
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            for v, bpe in zip(versions, made, strict=True):
                n = pa.array([len(bpe.encode(t)) // 2 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("lang"), size, pa.array([v] * len(texts), pa.string()), n], ["doc_id", "source", "lang", "n_bytes", "tokenizer_version", "n_tokens"])

    d = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), text_of().alias("text"))
    return d.mapInArrow(run, "doc_id long, source string, lang string, n_bytes long, tokenizer_version string, n_tokens long")


def delta(changes: DataFrame) -> DataFrame:
    """Signed totals of changes: kind, the keys, n_tokens, n_bytes, and old_tokens (what a revision replaces)."""
    sign = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).when(F.col("kind") == "revise", 0)
    sign = F.when(sign.isNull(), F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("kind", F.lit("null"))))).otherwise(sign)
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    signed = changes.select(
        *KEYS,
        sign.cast("long").alias("n_docs"),
        F.when(F.col("kind") == "revise", n("n_tokens") - n("old_tokens")).otherwise(sign * n("n_tokens")).alias("n_tokens"),
        F.when(F.col("kind") == "revise", F.lit(0)).otherwise(sign * n("n_bytes")).cast("long").alias("n_bytes"),
    )
    return signed.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


class Rollup:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _text(self, path: str) -> str:
        """What a file holds; empty where there is none."""
        fs, p = self._fs(path)
        if not fs.exists(p):
            return ""
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _compacted(self) -> tuple[str, list[str]]:
        """The table that `compact` wrote, and the ids that it holds."""
        name, *ids = self._text(f"{self.root}/commits/{COMPACTED}").split("\n")
        return name, ids

    def _writer(self, batch: str) -> str:
        """The name of the table that was committed as this batch; empty if none."""
        own = self._text(f"{self.root}/commits/{batch}")
        if own:
            return own
        name, ids = self._compacted()
        return name if batch in ids else ""

    def committed(self, batch: str) -> bool:
        return bool(self._writer(batch))

    def _claim(self, name: str, text: str) -> bool:
        """Gives the text to a commit file of that name in one step: it is written elsewhere and renamed, which fails where the file is there already. An empty one is of a writer that died under an earlier version of this code."""
        fs, p = self._fs(f"{self.root}/commits/{name}")
        if fs.exists(p) and not self._text(f"{self.root}/commits/{name}"):
            fs.delete(p, False)
        _, own = self._fs(f"{self.root}/commits/.{name}-{uuid.uuid4().hex}")
        stream = fs.create(own, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(own), fs.makeQualified(p), options)
        except Py4JJavaError:
            fs.delete(own, False)
            if self._text(f"{self.root}/commits/{name}"):
                return False
            raise
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """False if that batch was committed before."""
        if not batch or any(c in batch for c in "/_. "):
            raise ValueError("a batch id has letters, digits and - only")
        if self.committed(batch):
            return False
        name = f"{batch}-{uuid.uuid4().hex}"
        delta(changes).write.parquet(f"{self.root}/deltas/{name}")
        return self._claim(batch, name)

    def _tables(self) -> dict[str, str]:
        """Committed batches and their tables, as of now."""
        fs, p = self._fs(f"{self.root}/commits")
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        name, ids = self._compacted()
        out = dict.fromkeys(ids, name)
        out.update((b, own) for b in found if not b.startswith((".", "_")) and (own := self._text(f"{self.root}/commits/{b}")))
        return out

    def batches(self) -> list[str]:
        return sorted(self._tables())

    def _sums(self, tables: dict[str, str]) -> DataFrame:
        paths = sorted({f"{self.root}/deltas/{name}" for name in tables.values()})
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.where(" or ".join(f"{c} <> 0" for c in SUMS))

    def totals(self) -> DataFrame:
        return self._sums(self._tables())

    def compact(self, root: str) -> Rollup:
        """The totals of the batches committed by now, as one delta in a new folder, where their ids stay committed: one file names the delta and all ids, so either all of them are there or none. A batch that is committed here
        later is neither in the sums nor among the ids, and can be committed there."""
        new, tables = Rollup(self.spark, root), self._tables()
        if new.batches():
            raise ValueError("a rollup is compacted into a folder of its own")
        if tables:
            name = f"compact-{uuid.uuid4().hex}"
            self._sums(tables).write.parquet(f"{new.root}/deltas/{name}")
            if not new._claim(COMPACTED, "\n".join([name, *sorted(tables)])):
                raise ValueError("a rollup is compacted into a folder of its own")
        return new
