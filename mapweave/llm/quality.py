"""Quality classifier: histogram gradient-boosted trees over document statistics, in numpy.

Statistics are computed per whole text and do not see labels, language, source or ids. Training takes at most TRAIN_ROWS labelled documents (the smallest
hashes of their ids, so any labelled document may be among them); that bound is what makes the ids safe to broadcast and the rows safe to collect. Values are binned by quantiles; trees grow level by level
from per-bin gradient sums and are complete binary trees in flat arrays, so scoring is a fixed number of numpy gathers for a batch.

Defined results: null and empty texts have all-zero statistics and a score like any other text; null labels are not learned from; ids that repeat in labels are each a row; where documents repeat a labelled id, each different text is learned from once, within the bound; very long texts are counted whole;
without labels of both kinds every score is the share of good labels (1 without any); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

#: Labelled documents that are learned from, at most.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 120, 5, 64, 0.12, 20, 1.0
THRESHOLD = 0.3
#: Frequent function words of English, French, German and Spanish.
COMMON = frozenset("the of and to in a is that it for was on be as with by at or an are this from der die und das den von zu mit sich des auf ist ein nicht le la les et des un une du que dans est pour el los las y que en un por con se su para".split())
#: Signs counted one by one.
SIGNS = b".,!?|#$%&*@/\\<>{}[]()=_+-:;\"'~^"
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True
UPPER, DIGIT = np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91], DIGIT[48:58] = True, True
NAMES = ["log_chars", "log_words", "letters", "upper", "digits", "signs", "non_ascii", "spaces", "lines_per_word", "byte_entropy", "word_chars", "longest_word", "distinct_words", "top_word", "pair_repeats", "common", "line_repeats", "line_chars", "one_letter", "title", "short_line", "capitals_words"] + [f"sign_{c}" for c in SIGNS] + ["top_sign"]


def statistics(text: str) -> list[float]:
    data = text.encode()
    if not text.strip():
        return [0.0] * len(NAMES)
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, words, lines = len(data), text.split(), text.split("\n")
    m = len(words)
    p = h[h > 0] / n
    counts = Counter(words)
    pairs = set(zip(words, words[1:], strict=False))
    sizes = [*map(len, words)]
    signs = h[[*SIGNS]]
    full = [x for x in lines if x.strip()]
    own = Counter(full)
    again = sum((c - 1) * len(x) for x, c in own.items() if c > 1)
    return [
        math.log1p(len(text)), math.log1p(m), h[LETTERS].sum() / n, h[UPPER].sum() / max(1, h[LETTERS].sum()), h[DIGIT].sum() / n, signs.sum() / n, h[128:].sum() / n, h[32] / n,
        len(lines) / m, float(-(p * np.log2(p)).sum()), sum(sizes) / m, max(sizes), len(counts) / m, max(counts.values()) / m, 1 - len(pairs) / max(1, m - 1), sum(counts[w] for w in COMMON if w in counts) / m,
        again / n, n / max(1, len(full)), sizes.count(1) / m, sum(map(str.istitle, words)) / m, sum(len(x) < 40 for x in full) / max(1, len(full)), sum(map(str.isupper, words)) / m,
        *(signs / m), signs.max() / max(1, signs.sum()),
    ]


@dataclass
class Model:
    """Flat arrays, a row per tree: at node i of a complete binary tree go to 2 i + 1, or to 2 i + 2 where the feature exceeds the threshold."""

    feature: np.ndarray  # (trees, 2 ** DEPTH - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2 ** DEPTH)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows, depth = np.full(len(x), self.base), np.arange(len(x)), int(math.log2(self.leaf.shape[1]))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - (leaf.size - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Boosted by the logistic loss's gradients and curvatures."""
    good = y.mean() if len(y) else 1.0
    nodes = (1 << depth) - 1
    if not 0 < good < 1:
        return Model(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)), 30.0 if good else -30.0)
    edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])  # bin <= b means value <= edges[b]
    width = x.shape[1]
    score = np.full(len(y), base := math.log(good / (1 - good)))
    out = Model(np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes + 1)), base)
    flat = binned + (np.arange(width) * BINS)[:, None]
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, c = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            key = (flat + (at - first) * (width * BINS)).ravel()
            size = many * width * BINS
            shape = (many, width, BINS)
            gs = np.bincount(key, np.tile(g, width), size).reshape(shape).cumsum(2)
            cs = np.bincount(key, np.tile(c, width), size).reshape(shape).cumsum(2)
            ns = np.bincount(key, minlength=size).reshape(shape).cumsum(2)
            gt, ct, nt = gs[..., -1:], cs[..., -1:], ns[..., -1:]
            gain = gs**2 / (cs + RIDGE) + (gt - gs) ** 2 / (ct - cs + RIDGE) - gt**2 / (ct + RIDGE)
            gain[(ns < LEAST) | (nt - ns < LEAST)] = 0
            gain = gain.reshape(many, -1)
            best = gain.argmax(1)
            for k in range(many):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, best[k]] > 1e-6 and b < len(edges[f]):
                    out.feature[t, first + k], out.threshold[t, first + k] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), out.feature[t, at]] > out.threshold[t, at])
        leaf = at - nodes
        gl, cl = np.bincount(leaf, g, nodes + 1), np.bincount(leaf, c, nodes + 1)
        out.leaf[t] = RATE * gl / (cl + RIDGE)
        score += out.leaf[t][leaf]
    return out


def held_out(id_col: str | Column = "doc_id") -> Column:
    return (F.crc32(F.coalesce(F.col(id_col) if isinstance(id_col, str) else id_col, F.lit(-1)).cast("string").cast("binary")) % 5) == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from labels.quality of documents that are not held out: of at most `rows` labels, and at most `rows` different texts of theirs, chosen by hash where there are more."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = docs.sparkSession.createDataFrame(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows).collect(), known.schema)  # at most `rows` pairs of numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [statistics(t) for t in b["text"]], "quality": b["quality"]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    pairs = texts.select("doc_id", "h").join(F.broadcast(known), "doc_id").distinct().orderBy(F.xxhash64("doc_id", "h"), "doc_id", "h", "quality").limit(rows)
    chosen = docs.sparkSession.createDataFrame(pairs.collect(), "doc_id long, h long, quality int")  # at most `rows` triples of numbers
    some = texts.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id", "h", "quality").agg(F.first("text").alias("text"))
    got = some.mapInPandas(run, "x array<double>, quality int").toPandas()
    if not len(got):
        return train(np.zeros((0, len(NAMES))), np.zeros(0))
    x, y = np.array(got["x"].tolist(), float), got["quality"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the same trees however the rows arrived
    return train(x[order], y[order])


def scorer(model: Model):
    """A function of the text column: its score."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(model.score(np.array([statistics(x) for x in t], float).reshape(len(t), len(NAMES))))

    return score


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model predicts to be good, with all their columns."""
    return docs.where(scorer(model)(text_of()) >= THRESHOLD)


def decide(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    d = docs.select(F.col("doc_id"), held_out().alias("held_out"), scorer(model)(text_of()).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
