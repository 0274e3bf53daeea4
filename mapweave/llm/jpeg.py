"""Baseline JPEG media columns: a lossless DC-only writer, and a reader of any baseline file's luminance thumbnail.

Writer: each payload byte becomes one 8 x 8 block whose DC coefficient is the byte less 128, quantized by 8, so the block's samples all equal the
byte exactly. Rows of 192 blocks are restart intervals. A picture has at most MOST_ROWS rows; longer payloads are several pictures, one after another.

Reader: parses the markers, takes the scan's restart intervals as lanes, and Huffman-decodes all lanes of all pictures with the same tables in step with
numpy (a block a step; AC coefficients are decoded and skipped). The DC plane of the first component is the thumbnail. Files without restart
intervals are one lane each; sampling factors and interleaved components are handled. Progressive, lossless and arithmetic files are refused.

Defined results: null texts are empty (one row of spaces); very long texts are encoded and decoded by blocks of about AT_ONCE bytes, so beside its text and stored form a
text takes a bounded amount of memory; repeated ids and rows are answered each; an empty table gives no rows; other columns are ignored by `store`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

ROW, MOST_ROWS = 192, 8191
#: Payload bytes that are encoded or decoded at once (encoding takes about 100 times that in memory), and rows and payload bytes that a batch is cut to.
AT_ONCE, ROWS, BATCH_BYTES = 1 << 20, 500, 8 << 20
#: Code lengths (1 to 16) and symbols of our Huffman tables. DC categories by how often text has them; AC has the end of block only.
DC_BITS, DC_SYMBOLS = [0, 0, 7, 1, 1] + [0] * 11, [3, 4, 5, 2, 7, 6, 0, 1, 8]
AC_BITS, AC_SYMBOLS = [1] + [0] * 15, [0]


def canonical(bits: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a DHT segment."""
    out, code, at = [], 0, 0
    for n, count in enumerate(bits, 1):
        for s in symbols[at : at + count]:
            out.append((s, code, n))
            code += 1
        at += count
        code <<= 1
    return out


def lut(bits: list[int], symbols: list[int]) -> np.ndarray:
    """By the next 16 bits: length * 256 + symbol; 0 where there is no such code."""
    t = np.zeros(1 << 16, np.int32)
    for s, code, n in canonical(bits, symbols):
        t[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
    return t


def pad(text: bytes) -> bytes:
    """With bytes 32 up to a positive multiple of 192."""
    return text.ljust(max(ROW, -(-len(text) // ROW) * ROW), b" ")


_CODE, _LEN = np.zeros(16, np.int64), np.zeros(16, np.int64)
for _s, _c, _n in canonical(DC_BITS, DC_SYMBOLS):
    _CODE[_s], _LEN[_s] = _c, _n
_CATEGORY = np.array([v.bit_length() for v in range(256)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    tables = b"".join(bytes([kind, *bits, *symbols]) for kind, bits, symbols in ((0x00, DC_BITS, DC_SYMBOLS), (0x10, AC_BITS, AC_SYMBOLS)))
    frame = struct.pack(">BHHB3B", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0)
    return b"\xff\xd8" + _segment(0xDB, b"\0" + b"\x08" * 64) + _segment(0xC0, frame) + _segment(0xC4, tables) + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def write(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload (each a positive multiple of 192 bytes long). Short payloads are encoded together, long ones by blocks of rows."""
    out: list[bytes] = []
    group: list[bytes] = []
    held = 0
    for i, p in enumerate(payloads):
        group.append(p)
        held += len(p)
        if held >= AT_ONCE or i == len(payloads) - 1:
            out += _write(group)
            group, held = [], 0
    return out


def _scan(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of samples less 128 as entropy-coded intervals, each followed by two bytes for its marker, and where those two bytes stand."""
    d = np.diff(v, axis=1, prepend=np.int16(0)).astype(np.int64)
    cat = _CATEGORY[np.abs(d)]
    size = np.empty((len(v), ROW + 1), np.int64)
    code = np.empty((len(v), ROW + 1), np.int64)
    size[:, :ROW] = _LEN[cat] + cat + 1
    code[:, :ROW] = (_CODE[cat] << cat | np.where(d < 0, d + (1 << cat) - 1, d)) << 1  # the end of block is a 0 bit
    size[:, ROW] = -size[:, :ROW].sum(1) % 8
    code[:, ROW] = (1 << size[:, ROW]) - 1
    row_bytes = size.sum(1) // 8
    bits = np.unpackbits((code << (16 - size)).astype(">u2").view(np.uint8)).reshape(-1, 16)
    data = np.packbits(bits[np.arange(16) < size.reshape(-1, 1)])
    ff = np.flatnonzero(data == 0xFF)
    row = np.repeat(np.arange(len(v)), row_bytes)
    at = np.arange(len(data)) + 2 * row
    at += np.searchsorted(ff, np.arange(len(data)))  # a stuffed byte follows each 0xFF
    made = np.zeros(len(data) + len(ff) + 2 * len(v), np.uint8)
    made[at] = data
    ends = np.append(at, 0)[np.cumsum(row_bytes) - 1] + 1
    ends += data[np.cumsum(row_bytes) - 1] == 0xFF
    made[ends], made[ends + 1] = 0xFF, 0xD9
    return made, ends


def _write(payloads: list[bytes]) -> list[bytes]:
    v = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    out, r, step = [], 0, max(1, AT_ONCE // ROW)
    made, ends, lo = np.zeros(0, np.uint8), np.zeros(0, np.int64), 0  # of the block of rows from lo on
    for p in payloads:
        files, n = [], len(p) // ROW
        for k in range(0, n, MOST_ROWS):
            rows, done = min(MOST_ROWS, n - k), 0
            files.append(_header(rows))
            while done < rows:  # a picture may reach over blocks, a block over pictures
                if r == lo + len(ends):
                    lo = r
                    made, ends = _scan(v[r : r + step].astype(np.int16) - 128)
                here = min(rows - done, lo + len(ends) - r)
                mark = ends[r - lo : r - lo + here] + 1
                made[mark] = 0xD0 + np.arange(done, done + here) % 8
                done, begin = done + here, int(ends[r - lo - 1]) + 2 if r > lo else 0
                if done == rows:
                    made[mark[-1]] = 0xD9  # the last row has the end of image
                files.append(made[begin : int(mark[-1]) + 1].tobytes())
                r += here
        out.append(b"".join(files))
    return out


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    parts: list = field(default_factory=list)  # (id, h, v, quantization table)
    quant: dict = field(default_factory=dict)
    huff: dict = field(default_factory=dict)
    restart: int = 0
    scan: list = field(default_factory=list)  # (index of the component, DC table, AC table)
    lanes: list = field(default_factory=list)
    dc: np.ndarray | None = None  # of the first component
    bytes: int = 0

    def shape(self) -> tuple[int, int, int]:
        """MCUs across and down, and blocks in an MCU."""
        hs, vs = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.scan) == 1:
            _, h, v, _ = self.parts[self.scan[0][0]]
            return -(-self.width * h // (8 * hs)), -(-self.height * v // (8 * vs)), 1
        return -(-self.width // (8 * hs)), -(-self.height // (8 * vs)), sum(self.parts[s[0]][1] * self.parts[s[0]][2] for s in self.scan)

    def thumbnail(self) -> np.ndarray:
        return np.clip(np.rint(self.dc * (self.quant[self.parts[0][3]][0] / 8)) + 128, 0, 255).astype(np.uint8)


def parse(data: bytes, at: int = 0) -> Picture:
    """One picture that starts at `at`; `bytes` tells how long it is. Scans after the first luminance scan are skipped."""
    p, i, done = Picture(), at + 2, False
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    while True:
        while data[i : i + 1] == b"\xff" and data[i + 1 : i + 2] == b"\xff":
            i += 1
        if i + 2 > len(data) or data[i] != 0xFF:
            raise ValueError("a marker is missing")
        m = data[i + 1]
        if m == 0xD9:
            p.bytes = i + 2 - at
            if p.scan == [] or not p.parts:
                raise ValueError("no scan")
            return p
        (n,) = struct.unpack_from(">H", data, i + 2)
        body, i = data[i + 4 : i + 2 + n], i + 2 + n
        if m == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                p.quant[k] = struct.unpack(">64H" if wide else ">64B", body[1 : 129 if wide else 65])
                body = body[129 if wide else 65 :]
        elif m in (0xC0, 0xC1):
            bits, p.height, p.width, count = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("samples are not 8 bits")
            p.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
        elif 0xC2 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline file")
        elif m == 0xC4:
            while body:
                total = sum(body[1:17])
                p.huff[body[0]] = body[1 : 17 + total]
                body = body[17 + total :]
        elif m == 0xDD:
            (p.restart,) = struct.unpack(">H", body)
        elif m == 0xDA:
            ids = [x[0] for x in p.parts]
            scan = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            end = data.find(b"\xff", i)
            while end >= 0 and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                end = data.find(b"\xff", end + 2)
            if end < 0:
                raise ValueError("the scan does not end")
            if not done and any(s[0] == 0 for s in scan):
                p.scan, p.lanes, done = scan, _lanes(data[i:end]), True
            i = end


def _lanes(scan: bytes) -> list[np.ndarray]:
    """The restart intervals without stuffed bytes."""
    a = np.frombuffer(scan, np.uint8)
    ff = np.flatnonzero(a[:-1] == 0xFF)
    after = a[ff + 1]
    keep = np.ones(len(a), bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[after != 0]
    keep[marks] = keep[marks + 1] = False
    sizes = np.diff(np.concatenate([[0], np.cumsum(keep)[marks] if len(marks) else [], [keep.sum()]]).astype(np.int64))
    return np.split(a[keep], np.cumsum(sizes)[:-1])


def _decode(pictures: list[Picture]) -> None:
    """Fills dc for pictures whose tables, components and MCU structure agree."""
    first = pictures[0]
    luts = np.concatenate([lut(list(first.huff[k][:16]), list(first.huff[k][16:])) for s in first.scan for k in (s[1], 0x10 | s[2])])
    order = []  # of an MCU's blocks: place of the component in the scan
    for j, s in enumerate(first.scan):
        order += [j] * (1 if len(first.scan) == 1 else first.parts[s[0]][1] * first.parts[s[0]][2])
    want, lanes = [], []
    for p in pictures:
        across, down, _ = p.shape()
        total = across * down
        step = p.restart or total
        want += [min(step, total - k) for k in range(0, total, step)]
        lanes += p.lanes
        if len(want) != len(lanes):
            raise ValueError("restart intervals are missing")
    want = np.array(want, np.int64)
    sizes = np.array([len(x) for x in lanes], np.int64)
    buf = np.concatenate([*lanes, np.zeros(16, np.uint8)]).astype(np.uint32)
    w = buf[:-3] << np.uint32(24) | buf[1:-2] << np.uint32(16) | buf[2:-1] << np.uint32(8) | buf[3:]
    pos = (np.cumsum(sizes) - sizes) * 8
    limit = np.cumsum(sizes) * 8
    last = (len(w) - 1) * 8
    pred = np.zeros((len(first.scan), len(lanes)), np.int64)
    luma = [k for k, j in enumerate(order) if first.scan[j][0] == 0]
    out = np.zeros((len(lanes), int(want.max()) * len(luma)), np.int32)

    def window(at: np.ndarray) -> np.ndarray:
        at = np.minimum(at, last)
        return (w[at >> 3] >> (16 - (at & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF

    all_lanes, col = np.arange(len(lanes)), 0
    for mcu in range(int(want.max())):
        on = all_lanes if mcu < int(want.min()) else np.flatnonzero(want > mcu)
        for k, j in enumerate(order):
            here = pos[on]
            x = luts[(2 * j << 16) + window(here)]
            if not x.all():
                raise ValueError("no such code")
            here, cat = here + (x >> 8), (x & 255).astype(np.int64)
            v = window(here) >> (16 - cat)
            v = np.where(v < (1 << cat >> 1), v - (1 << cat) + 1, v)
            here += cat
            pred[j, on] += v
            if k in luma:
                out[on, col + luma.index(k)] = pred[j, on]
            at, live = np.ones(len(on), np.int64), np.arange(len(on))
            while len(live):
                x = luts[(2 * j + 1 << 16) + window(here[live])]
                if not x.all():
                    raise ValueError("no such code")
                run, size = x >> 4 & 15, x & 15
                here[live] += (x >> 8) + size
                at[live] = np.where(size > 0, at[live] + run + 1, np.where(run == 15, at[live] + 16, 64))
                live = live[at[live] < 64]
            pos[on] = here
        col += len(luma)
    if (pos > limit).any():
        raise ValueError("a scan is cut short")
    lane = 0
    for p in pictures:
        across, down, _ = p.shape()
        n = len(p.lanes)
        dc = np.concatenate([out[lane + k, : want[lane + k] * len(luma)] for k in range(n)]) if want[lane : lane + n].min() != want[lane] else out[lane : lane + n, : want[lane] * len(luma)].reshape(-1)
        lane += n
        p.lanes = []
        h, v = (1, 1) if len(p.scan) == 1 else p.parts[0][1:3]
        p.dc = dc.reshape(down, across, v, h).swapaxes(1, 2).reshape(down * v, across * h).astype(np.int16)  # eight-bit samples have DC values of eleven bits and a sign


def read(files: list[bytes]) -> list[list[Picture]]:
    """The pictures of each file, with their DC planes."""
    out: list[list[Picture]] = []
    groups: dict = {}
    size: dict = {}

    def flush(key) -> None:
        _decode(groups.pop(key))
        size.pop(key)

    for data in files:
        found, at = [], 0
        while at < len(data):
            found.append(p := parse(data, at))
            at += p.bytes
            key = (tuple((x[1], x[2]) for x in p.parts), tuple(p.scan), tuple(sorted(p.huff.items())), p.restart)
            groups.setdefault(key, []).append(p)
            size[key] = size.get(key, 0) + p.bytes
            if size[key] > AT_ONCE:
                flush(key)
        out.append(found)
    for key in [*groups]:
        flush(key)
    return out


def hashes(thumb: np.ndarray) -> str:
    """Average and difference hashes over 8 x 8 and 8 x 9 cells, in hex."""

    def cells(rows: int, cols: int) -> np.ndarray:
        y, x = np.arange(rows + 1) * thumb.shape[0] // rows, np.arange(cols + 1) * thumb.shape[1] // cols
        total = np.zeros((thumb.shape[0] + 1, cols + 1), np.int64)
        total[1:] = np.pad(np.cumsum(thumb, 1, dtype=np.int64), ((0, 0), (1, 0)))[:, x].cumsum(0)
        s = total[np.maximum(y[1:], y[:-1] + 1)] - total[y[:-1]]
        s = np.diff(s, axis=1)
        return s / (np.maximum(y[1:] - y[:-1], 1)[:, None] * np.maximum(x[1:] - x[:-1], 1))

    a, d = cells(8, 8), cells(8, 9)
    bits = [a > a.mean(), d[:, 1:] > d[:, :-1]]
    return ":".join(np.packbits(b).tobytes().hex() for b in bits)


def _slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of at most ROWS rows and, unless a row is larger, BATCH_BYTES bytes of that column."""
    sizes = pc.binary_length(b.column(column)).to_pylist()
    lo = held = 0
    for i, n in enumerate(sizes):
        if i > lo and (i - lo >= ROWS or held + n > BATCH_BYTES):
            yield b.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield b.slice(lo)


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and the stored form of each text: `media`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, 1):
                texts = b.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(write([pad(t) for t in texts]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), text_of(text).cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Decodes `media`: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height."""
    names = [*media.columns]
    keep = [c for c in names if c != "media"]

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
    made = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, names.index("media")):
                files = b.column("media").to_pylist()
                rows = []
                for data, found in zip(files, read(files), strict=True):
                    digest, total, tail, marks = hashlib.sha256(), 0, b"", []
                    for p in found:
                        t = p.thumbnail()
                        raw, p.dc = t.tobytes(), None
                        digest.update(raw)
                        total, tail = total + len(raw), (tail + raw[-16:])[-16:]
                        marks.append(f"{p.width}x{p.height}:{hashes(t)}")
                    rows.append((total, digest.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), ";".join(marks), found[0].width, sum(p.height for p in found)))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], keep + made)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in media.schema if f.name != "media")
    return media.mapInArrow(run, schema + "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height long")
