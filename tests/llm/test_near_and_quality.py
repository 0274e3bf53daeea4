import random
from collections import defaultdict

import numpy as np
import pytest

from mapweave.llm import near_dedup, quality


def brute_classes(rows):
    """Components over all pairs of rows."""
    h = [near_dedup.words(r["text"] or "") for r in rows]
    up = [*range(len(rows))]

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.similar(h[i], h[j]):
                up[top(i)] = top(j)
    out = defaultdict(list)
    for i, r in enumerate(rows):
        out[top(i)].append(r["doc_id"])
    return sorted((sorted(v, key=str) for v in out.values()), key=str)


def got_classes(docs):
    out = defaultdict(list)
    rows = near_dedup.classes(docs).collect()
    for r in rows:
        out[r["class_id"], r["class_size"]].append(r["doc_id"])
    assert all(len(v) == n for (_, n), v in out.items())
    return sorted((sorted(v, key=str) for v in out.values()), key=str)


def naive_lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_alignment_is_the_longest_common_subsequence():
    r = random.Random(5)
    for _ in range(60):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 40))] for _ in range(2))
        assert near_dedup.aligned(np.array(a), np.array(b), 100) == naive_lcs(a, b)
        assert near_dedup.aligned(np.array(a), np.array(b), 2) <= naive_lcs(a, b)


def test_order_matters():
    w = [f"w{i}" for i in range(200)]
    a = near_dedup.words(" ".join(w))
    assert near_dedup.similar(a, near_dedup.words(" ".join([*w[:50], "new", *w[51:]])))
    assert not near_dedup.similar(a, near_dedup.words(" ".join(w[100:] + w[:100])))
    assert not near_dedup.similar(a, near_dedup.words(" ".join(w[:120])))


def test_repeated_words_count_by_occurrence():
    a, b = near_dedup.words("spam " * 100), near_dedup.words("spam " * 40)
    assert not near_dedup.similar(a, b)
    assert len(set(near_dedup.labelled(near_dedup.kmers(a)).tolist())) == 96


def test_documents_with_odd_rows(docs, empty):
    rows = docs.collect()
    assert got_classes(docs) == brute_classes(rows)
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 4, 6, 7, 8, 9, 10, None, 12], key=str)
    assert near_dedup.classes(empty).count() == 0


def test_ids_that_are_null_or_repeat_with_other_texts(spark):
    t = [" ".join(f"t{k}w{i}" for i in range(80)) for k in range(6)]
    near = lambda k: t[k].replace(f"t{k}w40", "other")
    # three null ids with texts of their own (one twice, one with a near copy), id 7 with two texts, and a near copy of 5's text under an id that stays elsewhere
    rows = [(None, t[0]), (None, t[1]), (None, t[1]), (None, t[2]), (None, near(2)), (7, t[3]), (7, t[4]), (5, t[5]), (7, near(5))]
    got = near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    kinds = sorted((str(r["doc_id"]), r["text"].split("w")[0]) for r in got)
    assert kinds == [("5", "t5"), ("7", "t3"), ("7", "t4"), ("None", "t0"), ("None", "t1"), ("None", "t2")]
    assert (5, t[5]) in [tuple(r) for r in got]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_with_chains_of_edits(spark, seed):
    """Originals, copies with ever more edits, and passages that clean documents share."""
    r = random.Random(seed)
    word = lambda: f"{r.choice('bcdfg')}{r.randrange(4000)}"
    passage, rows, n = [word() for _ in range(60)], [], 0
    for _ in range(12):
        base = [word() for _ in range(r.randrange(60, 300))]
        for _ in range(r.randrange(1, 7)):
            rows.append((n, " ".join(base)))
            n += 1
            base = list(base)
            for _ in range(r.randrange(4)):
                base[r.randrange(len(base))] = word()
    for _ in range(20):
        rows.append((n, " ".join([word() for _ in range(70)] + passage + [word() for _ in range(20)])))
        n += 1
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_classes(d) == brute_classes(d.collect())


def family(seed, pairs):
    """Variants of one text of 100 words with two choices at 20 places, each with a copy that differs at two places: all k-mers are common, so a pair's buckets hold many others."""
    r, rows = random.Random(seed), []
    for n in range(pairs):
        pick = [r.randrange(2) for _ in range(20)]
        for k in (0, 1):
            rows.append((2 * n + k, " ".join(f"site{i // 5}is{pick[i // 5]}" if i % 5 == 2 else f"w{i}" for i in range(100))))
            for at in r.sample(range(20), 2):
                pick[at] ^= 1
    return rows


def test_pairs_inside_a_large_family_of_edits(spark):
    rows = family(7, 600)
    h = [near_dedup.words(t) for _, t in rows]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(d).collect()}
    assert all(near_dedup.similar(h[n], h[n + 1]) for n in range(0, len(rows), 2))
    assert [n for n in range(0, len(rows), 2) if got[n] != got[n + 1]] == []


def test_short_texts_with_one_word_more(spark):
    """Pairs of 5 to 60 words and one more at the start or the end, among them 8 and 9 words."""
    r, rows = random.Random(1), []
    for n in range(160):
        t = [f"k{n}w{i}" for i in range(8 if n < 50 else 5 + n % 56)]
        rows += [(2 * n, " ".join(t)), (2 * n + 1, " ".join([*t, "end"] if n % 2 else ["start", *t]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_classes(d) == brute_classes(d.collect())


def test_similar_short_texts_share_a_key():
    r = random.Random(2)
    for _ in range(4000):
        a = [f"{r.randrange(30)}" for _ in range(r.randrange(1, 58))]
        b = list(a)
        for _ in range(r.randrange(1, 3)):
            at = r.choice([0, len(b), r.randrange(len(b) + 1)])
            b[at : at + r.randrange(2)] = ["new"] * r.randrange(2)
        s, t = near_dedup.words(" ".join(a)), near_dedup.words(" ".join(b))
        x, y = near_dedup.kmers(s), near_dedup.kmers(t)
        if len(x) and len(y) and min(len(x), len(y)) <= near_dedup.SHORT and near_dedup.similar(s, t):
            assert set(near_dedup.keys_of(x).tolist()) & set(near_dedup.keys_of(y).tolist())


def test_shared_kmers_are_counted_exactly(monkeypatch):
    r = np.random.Generator(np.random.PCG64(3))
    texts = [np.unique(r.integers(0, 300, int(r.integers(0, 120))).astype(np.uint64)) for _ in range(70)]
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in texts[20:]] for x in texts[:20]]
    for dense, columns, pairs in ((0, 16, 100), (40, 64, 7), (10**9, 1, 50), (10**9, 1, 10**6)):
        for name, v in (("DENSE", dense), ("COLUMNS", columns), ("PAIRS", pairs)):
            monkeypatch.setattr(near_dedup, name, v)
        assert near_dedup.shared(texts[:20], texts[20:]).tolist() == want
    assert near_dedup.shared([], texts).shape == (0, 70)


def template(seed, pairs):
    """Of one text of 400 words: `pairs` bases with five words of their own, and a copy of each with eight more."""
    r = random.Random(seed)
    text, rows, ids = [f"t{r.randrange(10**6)}" for _ in range(400)], [], [*range(2 * pairs)]
    r.shuffle(ids)

    def edited(words, n):
        out = [*words]
        for at in r.sample(range(400), n):
            out[at] = f"e{r.randrange(10**9)}"
        return out

    for k in range(pairs):
        base = edited(text, 5)
        rows += [(ids[2 * k], " ".join(base)), (ids[2 * k + 1], " ".join(edited(base, 8)))]
    return rows


def test_pairs_of_a_dense_template(spark):
    rows = template(5, 1000)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k in range(0, 2000, 2) if got[rows[k][0]] != got[rows[k + 1][0]]] == []


def test_blocks_of_a_bucket_meet_in_all_pairs(spark, monkeypatch):
    """Thirty texts of one bucket in pairs; only texts of one pair are similar, and blocks hold few."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    import zstandard

    h = [near_dedup.words(" ".join(f"w{k}" if k % 5 else f"w{k}x{i // 2}" for k in range(40)) + f" y{i}") for i in range(30)]
    texts = spark.createDataFrame([(i, bytearray(zstandard.ZstdCompressor().compress(x.astype("<u4").tobytes()))) for i, x in enumerate(h)], "node long, words binary")
    live = spark.createDataFrame([(k, i, i) for k in (1, 2) for i in range(30)], "key long, node long, label long")
    got = {tuple(r) for r in near_dedup.finish(live, texts).collect()}
    assert got == {(i + 1, i) for i in range(0, 30, 2)}


def test_components_of_chains_and_random_links(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)]
    links = [(max(x), min(x)) for x in links if x[0] != x[1]]
    up = {}
    for a, b in links:
        old = {up.get(a, a), up.get(b, b)}
        up |= {a: up.get(a, a), b: up.get(b, b)}
        up = {k: min(old) if v in old else v for k, v in up.items()}
    got = dict(map(tuple, near_dedup.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()))
    assert got == up and got[40] == 0


def test_hot_keys_join_as_others(spark):
    from mapweave.llm.common import join_hot

    rows = spark.createDataFrame([(k, k % 7 if k % 2 else 100) for k in range(400)] + [(400, None)], "n long, key long")
    keyed = spark.createDataFrame([(k, f"v{k}") for k in (1, 3, 100, 999)], "key long, v string")
    got = sorted(((r["n"], r["v"]) for r in join_hot(rows, keyed, "key", rows.groupBy("key").count(), share=4).collect()))
    known = {1: "v1", 3: "v3", 100: "v100"}
    assert got == [(k, known.get(k % 7 if k % 2 else 100) if k < 400 else None) for k in range(401)]


def test_statistics_have_no_surprises():
    for t in ("", " \n", "a", "\x00", "é" * 10, "x" * 10_000, "| # $ %", "a b\n\na b"):
        x = quality.statistics(t)
        assert len(x) == len(quality.NAMES) and np.isfinite(x).all()


def test_trees_learn_and_ties_are_stable():
    r = np.random.Generator(np.random.PCG64(1))
    x = r.random((3000, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    m = quality.train(x[:2000], y[:2000], trees=40)
    p = m.score(x[2000:])
    assert ((p >= 0.5) == y[2000:]).mean() > 0.97 and ((p >= 0) & (p <= 1)).all()
    assert (quality.train(x[:2000], y[:2000], trees=40).score(x[2000:]) == p).all()
    assert quality.train(x, np.ones(len(x))).score(x).min() > 0.99


def test_decisions(spark, docs):
    import zlib

    good = [(i, "The quick brown fox of the north went to the river and was happy. " * (3 + i % 5), 1) for i in range(100, 260)]
    bad = [(i, "BUY!! $$$ NOW!! ### " * (5 + i % 4), 0) for i in range(300, 420)]
    d = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(1, None), (None, "x"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, None) for i, _, q in good + bad] + [(None, 1, 0), (5, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.decide(spark, d, labels).collect()}
    for i, _, q in good + bad:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == q, i
    assert 0 <= got[None]["score"] <= 1 and 0 <= got[1]["score"] <= 1 and got[1]["score"] == got[2]["score"]
    few = quality.decide(spark, d, labels.limit(0)).collect()
    assert len(few) == len(got) and all(r["predicted"] == 1 for r in few)
    kept = quality.accepted(docs, quality.fit(d, labels))
    assert kept.columns == docs.columns


def test_repeated_ids_do_not_grow_the_sample(spark, monkeypatch):
    docs = spark.range(600).selectExpr("id % 3 as doc_id", "concat('text number ', id) as text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, y: seen.append((len(x), len(y))))
    quality.fit(docs, labels, rows=10)
    monkeypatch.setattr(quality, "held_out", lambda *a: quality.F.lit(False))
    quality.fit(docs, labels, rows=10)
    quality.fit(docs.unionByName(docs), labels, rows=1000)
    assert seen[0][0] <= 10 and seen[1:] == [(10, 10), (600, 600)]


def by_hand(x, y, trees, depth):
    """Boosted trees by plain loops: every threshold between bins is tried at every node, gains are summed row by row."""
    good = y.mean()
    base, ends = np.log(good / (1 - good)), [sorted({float(q) for q in np.quantile(c, np.arange(1, quality.BINS) / quality.BINS)}) for c in x.T]
    score, out = [base] * len(y), []

    def grow(rows, level, g, c):
        if level == depth:
            return quality.RATE * sum(g[i] for i in rows) / (sum(c[i] for i in rows) + quality.RIDGE) if rows else 0.0
        term = lambda rs: sum(g[i] for i in rs) ** 2 / (sum(c[i] for i in rs) + quality.RIDGE)
        best = (1e-6, None)
        for f, edges in enumerate(ends):
            for e in edges:
                left, right = [i for i in rows if x[i, f] <= e], [i for i in rows if x[i, f] > e]
                if len(left) >= quality.LEAST and len(right) >= quality.LEAST and (gain := term(left) + term(right) - term(rows)) > best[0] + 1e-12:
                    best = gain, (f, e)
        if best[1] is None:
            return (0, np.inf, grow(rows, level + 1, g, c), 0.0)
        f, e = best[1]
        return (f, e, grow([i for i in rows if x[i, f] <= e], level + 1, g, c), grow([i for i in rows if x[i, f] > e], level + 1, g, c))

    def walk(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    for _ in range(trees):
        p = [1 / (1 + np.exp(-s)) for s in score]
        tree = grow([*range(len(y))], 0, [v - q for v, q in zip(y, p, strict=True)], [q * (1 - q) for q in p])
        out.append(tree)
        score = [s + walk(tree, r) for s, r in zip(score, x, strict=True)]
    return lambda rows: [1 / (1 + np.exp(-(base + sum(walk(t, r) for t in out)))) for r in rows]


def test_trees_equal_those_by_hand():
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(150, 4)), 2)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=150) * 0.5) > 0).astype(float)
    model, plain = quality.train(x, y, 4, 3), by_hand(x, y, 4, 3)
    new = rng.normal(size=(60, 4))
    assert np.allclose(model.score(np.r_[x, new]), plain(np.r_[x, new]))
