"""Media columns: Ogg physical streams in a binary column.

`mux` writes packets of one or more logical streams as Ogg pages: lacing values, page
checksums, granule positions, page flags. `demux` reads pages back: it verifies each
checksum and page number, reassembles packets from lacing values (also over pages),
separates the logical streams by serial number and derives timestamps from granule positions.

`encode` stores a text as two logical streams: the samples (576 bytes a packet, one granule
a byte) and a stream of one packet with the true length. Equal texts give equal bytes.

Defined cases: null text is empty; damaged bytes raise ValueError that names the page's place;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FRAME = 576
RATE = 48_000
SAMPLES, LENGTHS = 0x504C4154, 0x504C4155  # serial numbers of the two logical streams
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIII B".replace(" ", ""))

_reversed = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """Ogg's CRC (polynomial 0x04C11DB7, most significant bit first, from 0). It is the mirror image of zlib's over mirrored bytes."""
    mirrored = crc32(data.translate(_reversed), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_reversed), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """The pages of one logical stream; packets: (bytes, granule position at its end). Full pages of 255 lacing values; the first packet has a page of its own."""
    number, lacing, body, granule, flags, left = 0, bytearray(), [], -1, FIRST, len(packets)
    if not packets:
        raise ValueError("a logical stream has at least one packet")
    for k, (data, position) in enumerate(packets):
        left -= 1
        values = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        at, used = 0, 0
        while at < len(values):
            if len(lacing) == 255:
                yield _page(flags, granule, serial, number, bytes(lacing), b"".join(body))
                number, lacing, body, granule, flags = number + 1, bytearray(), [], -1, CONTINUED if at else 0
            take = values[at : at + 255 - len(lacing)]
            size = sum(take) if take[-1] < 255 else 255 * len(take)
            lacing += take
            body.append(data[used : used + size])
            at, used = at + len(take), used + size
        granule = position
        if k == 0 and left:
            yield _page(flags, granule, serial, number, bytes(lacing), b"".join(body))
            number, lacing, body, granule, flags = number + 1, bytearray(), [], -1, 0
    yield _page(flags | LAST, granule, serial, number, bytes(lacing), b"".join(body))


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """One physical stream: all first pages, then the other pages of the streams in turn."""
    made = [list(stream_pages(serial, packets)) for serial, packets in streams.items()]
    out = [p[0] for p in made]
    for k in range(1, max(map(len, made), default=0)):
        out += [p[k] for p in made if k < len(p)]
    return b"".join(out)


def demux(data: bytes) -> dict[int, dict]:
    """serial -> packets (bytes), granules (of the page on which each packet ends; the last of a page has the page's own), pages, ended."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27 or data[at : at + 4] != b"OggS" or data[at + 4]:
            raise ValueError(f"no page at byte {at}")
        _, _, flags, granule, serial, number, crc, count = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + count]
        body = at + 27 + count
        end = body + sum(lacing)
        if len(lacing) < count or end > len(data):
            raise ValueError(f"page at byte {at} is cut off")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at byte {at}")
        if bool(flags & FIRST) == (serial in streams):
            raise ValueError(f"stream {serial} begins twice or never, at byte {at}")
        s = streams.setdefault(serial, {"packets": [], "granules": [], "pages": 0, "ended": False, "open": []})
        if number != s["pages"] or s["ended"] or bool(flags & CONTINUED) != bool(s["open"]):
            raise ValueError(f"page at byte {at} doesn't follow in stream {serial}")
        s["pages"] += 1
        s["ended"] = bool(flags & LAST)
        size, before = 0, len(s["packets"])
        for v in lacing:
            size += v
            if v < 255:
                s["open"].append(data[body : body + size])
                s["packets"].append(b"".join(s["open"]))
                s["granules"].append(granule)
                s["open"], body, size = [], body + size, 0
        if size:
            s["open"].append(data[body : body + size])
        # The page's position is that of its last packet's end; a packet of 8-bit samples lasts as long as it has bytes, so earlier ones end so much sooner.
        for k in range(len(s["packets"]) - 2, before - 1, -1):
            s["granules"][k] = max(0, s["granules"][k + 1] - len(s["packets"][k + 1]))
        at = end
    for serial, s in streams.items():
        if s.pop("open") or not s["ended"]:
            raise ValueError(f"stream {serial} isn't complete")
    return streams


def encode(text: bytes) -> bytes:
    payload = padded(text)
    samples = [(payload[i : i + FRAME], i + FRAME) for i in range(0, len(payload), FRAME)]
    return mux({SAMPLES: samples, LENGTHS: [(len(text).to_bytes(8, "little"), 0)]})


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def decode(stored: bytes) -> tuple[int, bytes, dict[int, dict]]:
    """Length of the text, payload, and the logical streams."""
    streams = demux(stored)
    if streams.keys() != {SAMPLES, LENGTHS}:
        raise ValueError("not a stored text")
    return int.from_bytes(streams[LENGTHS]["packets"][0], "little"), b"".join(streams[SAMPLES]["packets"]), streams


def feature(payload: bytes, streams: dict[int, dict]) -> str:
    """Of the samples read back: seconds, packets, pages, mean, root mean square around it and zero crossings, as unsigned 8-bit samples."""
    x = np.frombuffer(payload, np.uint8)
    total, squares = int(x.sum(dtype=np.int64)), int(np.einsum("i,i", x, x, dtype=np.int64))
    mean = total / len(x)
    above = x >= 128
    s = streams[SAMPLES]
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    return f"seconds={s['granules'][-1] / RATE:.6f};packets={len(s['packets'])};pages={s['pages']};mean={mean:.4f};rms={max(0.0, squares / len(x) - mean * mean) ** 0.5:.4f};crossings={crossings}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, media binary: each text as a stored Ogg stream."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), pa.array([encode(text.as_py())], pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", common.whole_text().cast("binary").alias("text")).mapInArrow(run, "doc_id long, media binary")


def features(docs: DataFrame) -> DataFrame:
    """Store each text, read the stored bytes back, and describe what was read. In one pass, so the media aren't moved between tasks."""
    common.tune(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                stored = encode(text)
                n, payload, streams = decode(stored)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload, streams)))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith(("sha256", "feature")) else pa.int64()) for n, c in zip(names, cols, strict=True)], names=names)

    return docs.select("doc_id", common.whole_text().cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(common.documents(spark, sf_dir))
