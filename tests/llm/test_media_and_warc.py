import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mapweave.llm import jpeg, warc


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=900), min_size=1, max_size=5))
def test_payloads_come_back(texts):
    p = [jpeg.pad(t) for t in texts]
    got = jpeg.read(jpeg.write(p))
    assert [b"".join(x.thumbnail().tobytes() for x in f) for f in got] == p


def test_long_payloads_are_several_pictures():
    p = jpeg.pad(b"z" * (192 * jpeg.MOST_ROWS + 1))
    (f,) = jpeg.read(jpeg.write([p]))
    assert [x.height for x in f] == [8 * jpeg.MOST_ROWS, 8] and b"".join(x.thumbnail().tobytes() for x in f) == p


def test_blocks_of_rows_do_not_show(monkeypatch):
    r = np.random.Generator(np.random.PCG64(8))
    p = [jpeg.pad(r.integers(0, 256, n).astype(np.uint8).tobytes()) for n in (100, 192 * 30, 5, 192 * 7, 192 * 100 + 3, 0)]
    whole = jpeg.write(p)
    for at_once, rows in ((192 * 4, 13), (192 * 9, 8191), (1, 5)):
        monkeypatch.setattr(jpeg, "AT_ONCE", at_once)
        monkeypatch.setattr(jpeg, "MOST_ROWS", rows)
        got = jpeg.write(p)
        assert rows < 8191 or got == whole
        assert [b"".join(x.thumbnail().tobytes() for x in f) for f in jpeg.read(got)] == p


def test_a_very_long_text_takes_bounded_memory():
    import tracemalloc

    text = jpeg.pad(b"some words of a long text, " * 600_000)
    tracemalloc.start()
    (stored,) = jpeg.write([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20
    (found,) = jpeg.read([stored])
    assert b"".join(x.thumbnail().tobytes() for x in found) == text


def test_hashes_equal_a_plain_version():
    """Cell means by loops over the thumbnail."""
    r = np.random.Generator(np.random.PCG64(2))
    for rows in (1, 3, 8, 50):
        t = r.integers(0, 256, (rows, 192)).astype(np.uint8)

        def mean(y, x, ny, nx, t=t, rows=rows):
            y0, x0 = y * rows // ny, x * 192 // nx
            return t[y0 : max((y + 1) * rows // ny, y0 + 1), x0 : (x + 1) * 192 // nx].sum() / (max((y + 1) * rows // ny - y0, 1) * ((x + 1) * 192 // nx - x0))

        a = np.array([[mean(y, x, 8, 8) for x in range(8)] for y in range(8)])
        d = np.array([[mean(y, x, 8, 9) for x in range(9)] for y in range(8)])
        want = ":".join(np.packbits(b).tobytes().hex() for b in (a > a.mean(), d[:, 1:] > d[:, :-1]))
        assert jpeg.hashes(t) == want


def colour_file(luma, chroma, restart):
    """A 4:2:0 picture with AC coefficients, written symbol by symbol: 16 x 16 MCUs of four luminance and two chroma blocks."""
    dc = [(s, c, n) for s, c, n in jpeg.canonical([0, 0, 0, 12] + [0] * 12, [*range(12)])]
    ac = jpeg.canonical([0, 0, 0, 3] + [0] * 12, [0x00, 0xF0, 0x12])
    dcode, acode = {s: (c, n) for s, c, n in dc}, {s: (c, n) for s, c, n in ac}
    out, bits, pred, count = b"", "", [0, 0, 0], 0

    def put(code, n):
        nonlocal bits
        bits += format(code, f"0{n}b") if n else ""

    def block(part, value):
        d = value - pred[part]
        pred[part] = value
        k = abs(d).bit_length()
        put(*dcode[k])
        put(d if d >= 0 else d + (1 << k) - 1, k)
        put(*acode[0xF0])
        put(*acode[0x12])
        put(2, 2)
        put(*acode[0x00])

    def pad():
        nonlocal bits, out
        bits += "1" * (-len(bits) % 8)
        out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits = ""

    rows, cols = luma.shape[0] // 2, luma.shape[1] // 2
    for y in range(rows):
        for x in range(cols):
            if restart and count and count % restart == 0:
                pad()
                out += bytes([0xFF, 0xD0 + (count // restart - 1) % 8])
                pred[:] = [0, 0, 0]
            for v in (0, 1):
                for h in (0, 1):
                    block(0, int(luma[2 * y + v, 2 * x + h]) - 128)
            block(1, chroma)
            block(2, -chroma)
            count += 1
    pad()
    tables = bytes([0x00, 0, 0, 0, 12] + [0] * 12 + [*range(12)]) + bytes([0x10, 0, 0, 0, 3] + [0] * 12 + [0x00, 0xF0, 0x12])
    frame = bytes([8]) + (rows * 16).to_bytes(2, "big") + (cols * 16).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    seg = jpeg._segment
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + seg(0xDB, b"\0" + b"\x08" * 64) + seg(0xC0, frame) + seg(0xC4, tables)
    return head + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + out + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2, 5])
def test_other_baseline_files(restart):
    luma = np.random.Generator(np.random.PCG64(restart)).integers(0, 256, (6, 8)).astype(np.uint8)
    ((p,),) = jpeg.read([colour_file(luma, 9, restart)])
    assert (p.width, p.height) == (64, 48) and (p.thumbnail() == luma).all()


def test_damaged_files_are_refused():
    (f,) = jpeg.write([jpeg.pad(b"some text")])
    for bad in (f[:-40], b"GIF89a", f.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            jpeg.read([bad])


def test_media_columns(docs, empty):
    got = jpeg.features(jpeg.store(docs)).collect()
    want = sorted(((r["text"] or "").encode() for r in docs.collect()))
    assert sorted(r["payload_sha256"] for r in got) == sorted(hashlib.sha256(jpeg.pad(t)).hexdigest() for t in want)
    assert sorted(r["tail_crc32"] for r in got) == sorted(zlib.crc32(jpeg.pad(t)[-16:]) for t in want)
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] in (1, 2)}) == 1
    assert jpeg.features(jpeg.store(empty)).count() == 0


PAGES = "page_id long, url string, html string, digest string, n int, keep string"


def test_archives_come_back(spark):
    big = "<p>same</p>" * 200
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "http://c", big + "x"), (4, "d\r\nX: 1", None), (5, "e", "small"), (6, "f", "small"), (None, "g", big), (7, "h", "é" * 1000), (7, "h", "é" * 1000), (8, "i", "y" * 300_000)]
    d = spark.createDataFrame([(*r, "x", 1, "k") for r in rows], PAGES).repartition(2)
    got = {(r["page_id"], r["url"]): r for r in warc.read(warc.write(warc.decide(d))).collect()}
    assert len(got) == 9
    by = {k[0]: v for k, v in got.items()}
    assert (by[2]["record_type"], by[1]["record_type"], by[1]["refers_to"], by[None]["refers_to"]) == ("response", "revisit", 2, 2)
    assert [by[i]["record_type"] for i in (3, 4, 5, 6, 7, 8)] == ["response"] * 6
    for i, _, html in rows:
        p = (html or "").encode()
        assert (by[i]["payload_bytes"], by[i]["payload_digest"]) == (len(p), hashlib.sha1(p).hexdigest())
        assert by[i]["payload"] == (p if by[i]["record_type"] == "response" else None)


def test_no_pages(spark):
    assert warc.read(warc.write(warc.decide(spark.createDataFrame([], PAGES)))).count() == 0


def test_an_archive_is_members_after_a_dictionary():
    import struct

    import zstandard

    records = [warc.record(i, f"http://x/{i}", b"<html>%d</html>" % i * 50, None) for i in range(200)]
    trained = warc.dictionary(records)
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained)).compress
    data = struct.pack("<II", warc.SKIPPABLE, len(trained)) + trained + b"".join(map(pack, records))
    assert [*warc.members(data)] == records
    assert sum(len(pack(r)) for r in records) < 0.5 * sum(len(zstandard.compress(r)) for r in records)
    with pytest.raises(ValueError):
        [*warc.members(data[:-3])]
    assert io.BytesIO(data).read(4) == b"\x5d\x2a\x4d\x18"
