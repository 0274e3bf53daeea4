"""MCAP files, from the public format description: an index of chunks, reading by chunk, and a writer.

The index comes from the summary section; a file without one (cut short) is walked record by record until bytes stop making sense.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import zstandard

#: Fixed values of the format.
MAGIC = b"\x89MCAP0\r\n"
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX, STATISTICS, DATA_END = 1, 2, 3, 4, 5, 6, 7, 8, 11, 15
#: The private record that stands over bytes no longer used; readers skip it.
FILLER = 0x80
#: A chunk is closed at so many bytes, or when its messages span so many nanoseconds.
CHUNK_BYTES, CHUNK_SPAN = 4 << 20, 5_000_000_000


@dataclass
class Channel:
    id: int
    topic: str
    encoding: str
    type: str
    metadata: dict[str, str]


@dataclass
class Index:
    channels: dict[int, Channel] = field(default_factory=dict)
    #: (offset of the chunk record, its length, the channels in it or None where unknown)
    chunks: list[tuple[int, int, frozenset[int] | None]] = field(default_factory=list)
    counts: dict[int, int] = field(default_factory=dict)
    complete: bool = False


def _text(b: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<I", b, at)
    return b[at + 4 : at + 4 + n].decode(), at + 4 + n


def _pairs(b: bytes, at: int) -> dict[str, str]:
    (n,) = struct.unpack_from("<I", b, at)
    end, at, out = at + 4 + n, at + 4, {}
    while at < end:
        k, at = _text(b, at)
        out[k], at = _text(b, at)
    return out


def records(b: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(op, offset, content) until the bytes end or make no sense."""
    while at + 9 <= len(b):
        op, n = struct.unpack_from("<BQ", b, at)
        if op == 0 or op > 0x80 or at + 9 + n > len(b):
            return
        yield op, at, b[at + 9 : at + 9 + n]
        at += 9 + n


#: In place of a chunk's channels: a run of messages outside chunks.
LOOSE = frozenset({-1})


class Unreadable(ValueError):
    """A chunk whose bytes are damaged or cut short."""


def _learn(index: Index, schemas: dict[int, str], op: int, c: bytes) -> None:
    if op == SCHEMA:
        schemas[struct.unpack_from("<H", c)[0]] = _text(c, 2)[0]
    elif op == CHANNEL:
        ident, schema = struct.unpack_from("<HH", c)
        topic, at = _text(c, 4)
        encoding, at = _text(c, at)
        index.channels[ident] = Channel(ident, topic, encoding, schemas.get(schema, ""), _pairs(c, at))


def unpacked(chunk: bytes) -> bytes:
    """The records inside a chunk record's content."""
    size, _, = struct.unpack_from("<QI", chunk, 16)
    how, at = _text(chunk, 28)
    (n,) = struct.unpack_from("<Q", chunk, at)
    data = chunk[at + 8 : at + 8 + n]
    if how == "zstd":
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    if how == "":
        return data
    raise ValueError(f"chunks compressed by {how} cannot be read here")


def index(f, size: int) -> Index:
    """Of an open file."""
    found, schemas = Index(), {}
    f.seek(0)
    if f.read(8) != MAGIC:
        raise ValueError("not an MCAP file")
    f.seek(max(0, size - 37))
    tail = f.read(37)
    if len(tail) == 37 and tail[-8:] == MAGIC and tail[0] == FOOTER:
        (summary,) = struct.unpack_from("<Q", tail, 9)
        if summary:
            f.seek(summary)
            for op, _, c in records(f.read(size - summary)):
                _learn(found, schemas, op, c)
                if op == CHUNK_INDEX:
                    _, _, start, length, n = struct.unpack_from("<QQQQI", c)
                    inside = frozenset(struct.unpack_from("<HQ", c, 36 + i)[0] for i in range(0, n, 10))
                    found.chunks.append((start, length, inside or None))  # without message index offsets anything may be inside
                elif op == STATISTICS:
                    total, of_chunks, n = *struct.unpack_from("<Q", c), *struct.unpack_from("<I", c, 22), *struct.unpack_from("<I", c, 42)
                    found.counts = {k: v for k, v in (struct.unpack_from("<HQ", c, 46 + i) for i in range(0, n, 10))}
                    found.complete = True
            # a summary counts if it lists every chunk, and if messages outside chunks cannot be missing from it
            if found.complete and len(found.chunks) == of_chunks and (found.chunks or not total):
                return found
    found, schemas, at = Index(), {}, 8
    while at + 9 <= size:
        f.seek(at)
        op, n = struct.unpack("<BQ", f.read(9))
        if op == 0 or op > 0x80 or at + 9 + n > size:
            break
        if op == MESSAGE:
            if found.chunks and found.chunks[-1][2] == LOOSE and sum(found.chunks[-1][:2]) == at:
                start, length, _ = found.chunks.pop()
                found.chunks.append((start, length + 9 + n, LOOSE))
            else:
                found.chunks.append((at, 9 + n, LOOSE))
        if op in (SCHEMA, CHANNEL, CHUNK):
            c = f.read(n)
            _learn(found, schemas, op, c)
            if op == CHUNK:
                try:
                    inside = unpacked(c)
                except (ValueError, zstandard.ZstdError, struct.error):
                    break
                for o, _, x in records(inside):
                    _learn(found, schemas, o, x)
                found.chunks.append((at, 9 + n, None))
        at += 9 + n
    return found


def _inside(f, start: int, length: int) -> bytes:
    """The records of a chunk, or of a run of messages outside chunks."""
    f.seek(start)
    data = f.read(length)
    if len(data) < length:
        raise Unreadable("cut short")
    if data[0] != CHUNK:
        return data
    try:
        return unpacked(data[9:])
    except (zstandard.ZstdError, struct.error) as e:
        raise Unreadable(str(e)) from e


def readable(f, start: int, length: int) -> bool:
    try:
        _inside(f, start, length)
    except Unreadable:
        return False
    return True


def messages(f, start: int, length: int, want: frozenset[int] | None) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(channel, sequence, log time, publish time, data) of one chunk, or of a run of messages outside chunks. A chunk that cannot be read ends the read there."""
    for op, _, c in records(_inside(f, start, length)):
        if op == MESSAGE:
            channel, seq, log, published = struct.unpack_from("<HIQQ", c)
            if want is None or channel in want:
                yield channel, seq, log, published, c[22:]


def text(t: str) -> bytes:
    return struct.pack("<I", len(t.encode())) + t.encode()


def pairs(d: dict[str, str]) -> bytes:
    raw = b"".join(text(k) + text(v) for k, v in d.items())
    return struct.pack("<I", len(raw)) + raw


def record(op: int, content: bytes) -> bytes:
    return struct.pack("<BQ", op, len(content)) + content


@dataclass
class Packed:
    """A chunk that may stand anywhere: its record, the message index records by channel, its times, sizes and messages by channel."""

    chunk: bytes
    marks: list[tuple[int, bytes]]
    low: int
    high: int
    packed: int
    raw: int
    counts: dict[int, int]

    def index(self, start: int) -> bytes:
        """The content of its chunk index record when it starts there."""
        at, offsets = start + len(self.chunk), b""
        for channel, mark in self.marks:
            offsets += struct.pack("<HQ", channel, at)
            at += len(mark)
        return struct.pack("<QQQQI", self.low, self.high, start, len(self.chunk), len(offsets)) + offsets + struct.pack("<Q", at - start - len(self.chunk)) + text("zstd") + struct.pack("<QQ", self.packed, self.raw)


def pack_chunk(messages_: list[tuple[int, bytes, int]], declared: dict[int, tuple[bytes, bytes]]) -> Packed:
    """messages_: (log time, content of the message record, channel), in order. declared: content of the schema record (empty: none) and of the channel record, by channel; those used are put into the chunk."""
    used = sorted({m[2] for m in messages_})
    body = bytearray(b"".join(record(op, x) for c in used for op, x in zip((SCHEMA, CHANNEL), declared[c], strict=True) if x))
    marks: dict[int, list[bytes]] = {c: [] for c in used}
    for log, content, channel in messages_:
        marks[channel].append(struct.pack("<QQ", log, len(body)))
        body += record(MESSAGE, content)
    packed = zstandard.ZstdCompressor().compress(bytes(body))
    low, high = min(m[0] for m in messages_), max(m[0] for m in messages_)
    chunk = record(CHUNK, struct.pack("<QQQI", low, high, len(body), zlib.crc32(body)) + text("zstd") + struct.pack("<Q", len(packed)) + packed)
    entries = [(c, b"".join(marks[c])) for c in used]
    return Packed(chunk, [(c, record(MESSAGE_INDEX, struct.pack("<HI", c, len(e)) + e)) for c, e in entries], low, high, len(packed), len(body), {c: len(e) for c, e in marks.items()})


class Writer:
    """Writes chunks of zstd-compressed messages in time order, with index, statistics and summary."""

    def __init__(self, f) -> None:
        self.f, self.at = f, 0
        self.channels: dict[str, tuple[int, bytes, bytes]] = {}
        self.counts: dict[int, int] = {}
        self.chunks: list[bytes] = []
        self.open: list[tuple[int, bytes, int]] = []
        self.size = 0
        self.span: tuple[int, int] | None = None
        self._raw(MAGIC)
        self._record(HEADER, self._s("") + self._s("mapweave"))

    @staticmethod
    def _s(t: str) -> bytes:
        return struct.pack("<I", len(t.encode())) + t.encode()

    def _raw(self, b: bytes) -> None:
        self.f.write(b)
        self.at += len(b)

    def _record(self, op: int, content: bytes) -> None:
        self._raw(struct.pack("<BQ", op, len(content)) + content)

    def channel(self, key: str, encoding: str, kind: str, metadata: dict[str, str] | None = None, topic: str | None = None) -> int:
        """The id of the channel known by key; its topic is the key unless another is given (generations share a topic)."""
        if key not in self.channels:
            n = len(self.channels) + 1
            schema = struct.pack("<H", n) + self._s(kind) + self._s(encoding) + struct.pack("<I", 0)
            pairs = b"".join(self._s(k) + self._s(v) for k, v in (metadata or {}).items())
            self.channels[key] = n, schema, struct.pack("<HH", n, n) + self._s(topic or key) + self._s(encoding) + struct.pack("<I", len(pairs)) + pairs
        return self.channels[key][0]

    def write(self, channel: int, seq: int, log: int, data: bytes) -> None:
        low, high = min(log, (self.span or (log, log))[0]), max(log, (self.span or (log, log))[1])
        if self.open and (self.size + len(data) > CHUNK_BYTES or high - low > CHUNK_SPAN):
            self.flush()
            low = high = log
        self.span = low, high
        self.open.append((log, struct.pack("<HIQQ", channel, seq, log, log) + data, channel))
        self.size += len(data)
        self.counts[channel] = self.counts.get(channel, 0) + 1

    def flush(self) -> None:
        if not self.open:
            return
        self.open.sort(key=lambda x: x[0])
        made = pack_chunk(self.open, {c[0]: c[1:] for c in self.channels.values()})
        self.chunks.append(made.index(self.at))
        self._raw(made.chunk)
        for _, mark in made.marks:
            self._raw(mark)
        self.open, self.size, self.span = [], 0, None

    def close(self) -> None:
        self.flush()
        self._record(DATA_END, struct.pack("<I", 0))
        summary = self.at
        for _, schema, channel in self.channels.values():
            self._record(SCHEMA, schema)
            self._record(CHANNEL, channel)
        for c in self.chunks:
            self._record(CHUNK_INDEX, c)
        counts = b"".join(struct.pack("<HQ", k, v) for k, v in self.counts.items())
        ends = [struct.unpack_from("<QQ", c) for c in self.chunks]
        self._record(STATISTICS, struct.pack("<QHIIIIQQI", sum(self.counts.values()), len(self.channels), len(self.channels), 0, 0, len(self.chunks), min((e[0] for e in ends), default=0), max((e[1] for e in ends), default=0), len(counts)) + counts)
        self._record(FOOTER, struct.pack("<QQI", summary, 0, 0))
        self._raw(MAGIC)
