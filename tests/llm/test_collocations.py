import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mapweave.llm import collocations
from mapweave.llm.perfect_hash import PerfectHash, shard_of

SCHEMA = "doc_id long, text string, lang string, n long, phrase string, shard int"


def plain(rows, least, top=2000):
    """By hand: all phrases, all cuts, all longer candidates around each."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\\x0a-\\x0d]", text):
            words = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in candidates.items():
        around = [b for (other, q), b in candidates.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 80 * a for b in around):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.append((lang, score, a, " ".join(p), left, right, n[lang]))
    best = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[1], -r[2], r[3].encode()))[:top]
        best += [(lang, k, r[3], r[2], r[4], r[5], r[6], r[1]) for k, r in enumerate(mine, 1)]
    return sorted(best)


def found(d, **kw):
    return sorted(tuple(r) for r in collocations.collocations(d, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), unique=True, max_size=200), st.lists(st.integers(-(1 << 63), (1 << 63) - 1), max_size=50))
def test_perfect_hash(keys, others):
    for mine, ask in ((np.array(keys, np.int64), np.array(others, np.int64)), ([str(k).encode() for k in keys], [str(k).encode() for k in others])):
        made = PerfectHash.of(mine)
        slots = made.find(mine)
        assert sorted(slots.tolist()) == list(range(len(keys)))
        again = PerfectHash.load(made.dump(), made.keys)
        assert again.find(mine).tolist() == slots.tolist()
        assert [s >= 0 for s in again.find(ask).tolist()] == [o in set(keys) for o in others]
        assert not len(mine) or shard_of(mine, 3).max() < 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", " ", ".", "\n", "\t", "é", "x\x1fy", "; "]), max_size=60).map("".join), st.integers(1, 9))
def test_words_are_the_patterns(text, step):
    old, collocations.SPLIT_BYTES = collocations.SPLIT_BYTES, step
    try:
        got = [w.decode() for words in collocations.split([text]) for w in words]
    finally:
        collocations.SPLIT_BYTES = old
    want = [w for piece in re.split("([.,;:!?\\x0a-\\x0d])", text) for w in (["."] if re.fullmatch("[.,;:!?\\x0a-\\x0d]", piece) else re.findall("[^\\x20\\x09]+", re.sub("[A-Z]", lambda m: m.group().lower(), piece)))]
    assert got == want


@pytest.mark.parametrize("shard_keys", [collocations.SHARD_KEYS, 20])
def test_equals_brute_force(spark, docs, shard_keys):
    rng = np.random.default_rng(5)
    words = ["The", "quick", "red", "fox", "New", "York", "city", "x y", "don't", "ÄB"]
    text = lambda: "".join(words[k] + str(rng.choice([" ", " ", " ", "\t", ". ", "\n", ","])) for k in rng.zipf(1.4, 80) % len(words))
    rows = [(k, text(), [None, "en", "und", "de"][k % 4], 1, "p", 2) for k in range(60)] + [(None, None, "en", 1, "p", 2), (1, "", None, 1, "p", 2)]
    rows += [(7, "New York city hall " * 40, "fr", 1, "p", 2)] * 2
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(d, least=6, shard_keys=shard_keys) == plain([(r[2], r[1]) for r in rows], 6)
    assert found(d, least=6, top=3) == plain([(r[2], r[1]) for r in rows], 6, 3)
    assert found(docs, least=30) == plain([(r.lang, r.text) for r in docs.collect()], 30)


def test_tables_beyond_memory_are_read_again(spark, monkeypatch):
    keys = np.arange(500) * 7
    rows = [(int(s), 0, collocations._pack_keys(np.array([k for k in keys if collocations.shard_of(np.array([k]), 13)[0] == s]))) for s in range(13)]
    rows += [(rows[3][0], 40, rows[3][2])]  # what another task found of it too
    table = collocations.candidate_table(spark.createDataFrame(rows, collocations.SUMS), 41, 13)
    whole = collocations.Table(table[0], "", *table[1:], False, 1)
    small = collocations.Table(table[0], "", *table[1:], False, 1)
    ask = np.arange(0, 4000, 5)
    monkeypatch.setattr(collocations, "TABLE_BYTES", 1)
    got = small.find(ask)
    assert len(small.held) == 1
    monkeypatch.undo()
    assert (got == whole.find(ask)).all() and len(whole.held) > 10
    assert [g != collocations.NONE for g in got] == [a % 7 == 0 and a < 3500 for a in ask]
    known = got[got != collocations.NONE]
    assert len(set(known.tolist())) == len(known)


def test_large_counts_are_exact(spark):
    a = 9_000_000_000_000_000_000
    d = spark.createDataFrame([(a, [a + 5, a], [a + 7, a], 2)], "a long, heads array<long>, tails array<long>, size int")
    assert d.select(collocations.scored().score).first()[0] == 2_000_000 * a // (a + 5 + a + 7)


def test_no_documents(spark, empty):
    assert collocations.collocations(empty).count() == 0
