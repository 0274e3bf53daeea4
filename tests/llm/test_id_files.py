import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mapweave.llm import id_files, tokens

BYTE = Tokenizer.from_file(public_tokenizers.path(tokens.BYTE_BPE))
VOCABULARY = 50_257


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 32).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(0, (1 << w) - 1), max_size=70))), st.data())
def test_bits_come_back(case, data):
    width, ids = case
    packed = id_files.pack_bits(np.array(ids, np.uint32), width)
    assert len(packed) == -(-len(ids) // 8) * width
    bits = "".join(f"{v:0{width}b}"[::-1] for v in ids)
    assert all(packed[i // 8] >> i % 8 & 1 == int(b) for i, b in enumerate(bits))
    first = data.draw(st.integers(0, len(ids)))
    n = data.draw(st.integers(0, len(ids) - first))
    assert id_files.unpack_bits(packed, width, first, n).tolist() == ids[first : first + n]


def test_widths():
    assert [id_files.width_of(v) for v in (1, 2, 3, 256, 257, 32_000, 50_257, 65_537)] == [1, 1, 2, 8, 9, 15, 16, 17]
    with pytest.raises(ValueError, match="bits"):
        id_files.pack_bits(np.array([8], np.uint32), 3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 31_999), max_size=60), max_size=12), st.sampled_from([8, 16, 64]), st.data())
def test_any_run_is_read_alone(rows, block, data):
    f = io.BytesIO()
    w = id_files.Writer(f, id_files.width_of(32_000), block)
    for k, r in enumerate(rows):
        w.add(None if k == 1 else -k, np.array(r, np.uint32))
    size = w.close()
    assert size == len(f.getvalue())
    got, flat = id_files.Reader(f, size), [x for r in rows for x in r]
    first = data.draw(st.integers(0, len(flat)))
    n = data.draw(st.integers(0, len(flat) - first))
    assert got.ids(first, n).tolist() == flat[first : first + n]
    assert [got.document(k).tolist() for k in range(len(rows))] == rows
    assert got.null.tolist() == [k == 1 for k in range(len(rows))] and got.n_ids == len(flat)


def test_damage_is_seen():
    f = io.BytesIO()
    w = id_files.Writer(f, 16, 8)
    w.add(1, np.arange(20, dtype=np.uint32))
    size = w.close()
    for at, good in ((id_files.HEADER.size + 16, 0), (size - id_files.FOOTER.size - 3, None)):
        raw = bytearray(f.getvalue())
        raw[at] ^= 1
        if good is None:
            with pytest.raises(ValueError, match="whole file"):
                id_files.Reader(io.BytesIO(bytes(raw)), size)
        else:
            got = id_files.Reader(io.BytesIO(bytes(raw)), size)
            assert got.ids(0, 8).tolist() == list(range(8))
            with pytest.raises(ValueError, match="checksum"):
                got.ids(8, 1)
    with pytest.raises((ValueError, OSError)):
        id_files.Reader(io.BytesIO(f.getvalue()[:-9]), size)


@pytest.mark.parametrize("file_ids", [id_files.FILE_IDS, 3000])
def test_files_equal_the_library(spark, docs, file_ids):
    rows = docs.collect()
    made = id_files.write(docs, VOCABULARY, file_ids=file_ids, task_bytes=id_files.TASK_BYTES if file_ids > 3000 else 100_000)
    files = made.orderBy("part", "nth").collect()
    assert [f.start for f in files] == [sum(x.n_ids for x in files[:k]) for k in range(len(files))] and (len(files) > 2) == (file_ids == 3000)
    got = sorted(id_files.read(made).collect(), key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)
    start = 0
    for r in got:
        assert r.start == start and len(r.ids) == 4 * r.n_tokens
        start += r.n_tokens
    want = sorted((r.doc_id or 0, zlib.crc32(np.array([*BYTE.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for r in rows)
    assert sorted((r.doc_id or 0, zlib.crc32(r.ids)) for r in got) == want


def test_no_documents(spark, empty):
    made = id_files.write(empty, VOCABULARY)
    assert made.count() == 0 and id_files.read(made).count() == 0


def test_equal_rows_are_spread(spark):
    d = spark.range(3000).selectExpr("7 as doc_id", "'the same text again' as text").repartition(4)
    made = id_files.write(d, VOCABULARY, task_bytes=6000)
    parts = [f.n_docs for f in made.collect()]
    assert sum(parts) == 3000 and max(parts) < 1500
    assert sorted(r.start for r in id_files.read(made).collect()) == list(range(0, 15_000, 5))
