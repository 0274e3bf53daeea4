"""Dictionary-compressed WARC archives: a writer and a reader.

Payloads of at least REVISIT_BYTES that are equal (same SHA-256 and length) get one response record, the one with the largest page id; the others
become revisit records. Groups are found from digests alone; small pages never meet, and digests with a large share of all pages are joined by broadcast. Each task then writes archives of bounded size in the shared folder: it buffers the first records, trains a
Zstandard dictionary on them, embeds it in a leading skippable frame and compresses every record as a frame of its own. Archives are written under an attempt's own name and renamed when complete;
only archives that the manifest of the successful attempts names are ever read, each by a task of its own.

Defined results: null html is an empty payload; null urls are empty; rows that repeat id and payload are all responses; null ids are read back as null; very long pages have an archive as long as they need; an
empty table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize, text_of, work_dir

REVISIT_BYTES = 1000
#: Uncompressed bytes of an archive, and of the records that its dictionary is built from; the dictionary's size.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 64 << 20, 2 << 20, 64 << 10
#: The skippable frame of a dictionary, and the profile of revisit records.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to (null: a response)."""
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), text_of("html").cast("binary").alias("payload"))
    size = F.octet_length("payload")
    digest = F.when(size >= REVISIT_BYTES, F.concat(F.sha2("payload", 256), F.lit(":"), size))
    groups = rows.select("page_id", digest.alias("digest")).where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("count"))
    groups = materialize(groups.where("count > 1"), "revisits")
    rows = rows.withColumn("digest", F.coalesce(digest, F.concat(F.lit("page "), F.monotonically_increasing_id())))
    d = join_hot(rows, groups.select("digest", "keep"), "digest", groups.select("digest", "count"))
    return d.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to"))


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url))]
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """Trained on the records; where they are too few for that, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICTIONARY_BYTES:]


def members(data: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]))
    at = 8 + n
    while at < len(data):
        one, out = unpack.decompressobj(), []
        while not one.eof:
            piece = data[at : at + 65536]
            if not piece:
                raise ValueError("a frame is cut short")
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record and of its HTTP message, and the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def write(decided: DataFrame, root: str | None = None) -> DataFrame:
    """Writes archives under root and returns their manifest: path, records, bytes."""
    root = root or work_dir(decided.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(root)
        store.create_dir(top, recursive=True)
        task, done, out, held, raw = TaskContext.get(), [], None, [], 0

        def begin() -> dict:
            trained = dictionary(held)
            name = f"{top}/part-{task.partitionId():05d}-{len(done):04d}-{uuid.uuid4().hex}.warc.zst"
            stream = store.open_output_stream(name + ".part", compression=None)
            stream.write(struct.pack("<II", SKIPPABLE, len(trained)) + trained)
            return {"name": name, "stream": stream, "pack": zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True).compress, "n": 0}

        def flush() -> None:
            for r in held:
                out["stream"].write(out["pack"](r))
            out["n"] += len(held)
            held.clear()

        def close() -> None:
            size = out["stream"].tell()
            out["stream"].close()
            store.move(out["name"] + ".part", out["name"])
            done.append((out["name"], out["n"], size))

        for b in batches:
            for page_id, url, payload, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                held.append(record(page_id, url, payload, refers_to))
                raw += len(held[-1])
                if out is None and raw >= SAMPLE_BYTES:
                    out = begin()
                if out is not None:
                    flush()
                    if raw >= ARCHIVE_BYTES:
                        close()
                        out, raw = None, 0
        if held and out is None:
            out = begin()
        if out is not None:
            flush()
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return materialize(decided.mapInArrow(run, "path string, records long, bytes long"), "manifest").withColumn("root", F.lit(root))


def read(manifest: DataFrame) -> DataFrame:
    """A row per record: page_id, url, payload_bytes, payload_digest (hex), record_type, refers_to, payload (null in revisits). Digests are checked."""

    def page(urn: str) -> int | None:
        n = urn.removeprefix("<urn:page:").removesuffix(">")
        return None if n == "none" else int(n)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, root in zip(b.column("path").to_pylist(), b.column("root").to_pylist(), strict=True):
                store, _ = pafs.FileSystem.from_uri(root)
                with store.open_input_stream(path, compression=None) as f:
                    data = f.read()
                rows: list[list] = [[] for _ in names]
                for member in members(data):
                    fields, http, payload = parse(member)
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind = fields["WARC-Type"]
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
                        raise ValueError(f"{path}: a payload differs from its digest")
                    refers = page(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    for to, v in zip(rows, (page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], int(http["Content-Length"]), digest, kind, refers, payload if kind == "response" else None), strict=True):
                        to.append(v)
                    if len(rows[0]) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], names)
                        rows = [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], names)

    spread = manifest.select("path", "root").repartitionByRange(max(1, manifest.count()), "path")
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
