import hashlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from mapweave.llm import alignment, tokens

A = Tokenizer.from_file(public_tokenizers.path(tokens.BYTE_BPE))
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=public_tokenizers.path(alignment.PIECES))
ALIGNER = alignment.Aligner()
#: The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
_plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {chr(b): b for b in _plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in _plain)}
TEXT = st.lists(st.sampled_from(list("ab Z9.,'é漢\n\t\r   \x1c\x85<|▁ﬁ😀") + ["<|endoftext|>", "<s>", "<0x41>", "  ", " the", ";\r", "naïve "]), max_size=40).map("".join)


def plain(text):
    """Groups by walking both token lists; None without tokens."""
    if not text:
        return None
    data = (" " + text).encode()
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    a_bytes = [bytes(BYTES[c] for c in A.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(a_bytes) != data or b"".join(b_bytes) != data:
        return None
    out, x, y, end_a, end_b, i, j = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if end_a <= end_b:
            end_a, i = end_a + len(a_bytes[i]), i + 1
            x.append(a[i - 1])
        else:
            end_b, j = end_b + len(b_bytes[j]), j + 1
            y.append(b[j - 1])
        if end_a == end_b and x and y:
            out.append((end_a, x, y))
            x, y = [], []
    return out


def written(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for _, a, b in groups)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_parts_equal_the_walk_over_the_whole(text):
    want, (got,) = plain(text), ALIGNER.documents([text])
    assert (got is None) == (want is None)
    if want:
        assert ";".join(p[0] for p in got) == written(want)
        links = Counter((a << 16 | b) for _, x, y in want for a in x for b in y)
        found = Counter()
        for p in got:
            codes, often = (memoryview(v).cast("q").tolist() for v in p[1:3])
            for c, n in zip(codes, often, strict=True):
                found[c] += n
        assert found == links and [sum(p[k] for p in got) for k in (3, 4, 5)] == [sum(len(x) for _, x, _ in want), sum(len(y) for _, _, y in want), len(want)]


def test_large_groups_are_counted_by_ids():
    codes, often = alignment.links([1, 2, 1] * 10, [7, 7, 8] * 10)
    assert dict(zip(codes, often, strict=True)) == {1 << 16 | 7: 400, 1 << 16 | 8: 200, 2 << 16 | 7: 200, 2 << 16 | 8: 100}


@pytest.mark.parametrize("links", [alignment.BLOCK_LINKS, 30])
def test_scores_equal_brute_force(spark, docs, links):
    rows = docs.union(docs.limit(0)).collect()
    all_groups = [plain(r.text) for r in rows]
    each = [Counter((a, b) for _, x, y in g or [] for a in x for b in y) for g in all_groups]
    count = Counter(p for c in each for p in c)
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    want = Counter()
    for r, g, c in zip(rows, all_groups, each, strict=True):
        digest = hashlib.sha256(written(g).encode()).hexdigest() if g else ""
        want[r.doc_id, sum(len(x) for _, x, _ in g or []), sum(len(y) for _, _, y in g or []), len(g or []), sum(c.values()), sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()), digest] += 1
    got = alignment.score(docs, block_links=links).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert Counter(tuple(r) for r in got) == want


def test_groups_have_ends_and_ids(spark, docs):
    got = {(r.doc_id, written([(g.end, g.a, g.b) for g in r.groups])): [g.end for g in r.groups] for r in alignment.groups(docs).collect()}
    for r in docs.collect():
        g = plain(r.text) or []
        assert got[r.doc_id, written(g)] == [e for e, _, _ in g]


def test_no_documents(spark, empty):
    assert alignment.score(empty).count() == 0 and alignment.groups(empty).count() == 0
