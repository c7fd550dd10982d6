"""Ogg: payloads stored as 8-bit samples in pages of two logical streams, and read back.

Writing deals frames of 576 samples in turn to the streams; each frame is a packet, packets are cut into
lacing values of at most 255, and the streams' pages are interleaved. Reading goes the other way: it finds
pages by their capture pattern, checks each page's checksum and number, puts packets together from the
lacing values (also over page ends), separates the streams by serial number, and takes each packet's time
from the granule positions, which count samples of a stream.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

FRAME = 576
RATE = 8000
STREAMS = 2
PAGE_SEGMENTS = 255

_PAGE = struct.Struct("<4sBBqIIIB")  # pattern, version, flags, granule, serial, number, checksum, segments
_HEAD = struct.Struct("<6sBBBHQ")  # magic, version, stream, streams, frame, samples of all streams
CONTINUED, FIRST, LAST = 1, 2, 4

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, not reflected, from 0, as Ogg has it: the reflected CRC of the bit-reversed bytes, reversed."""
    c = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + checksum(head + body).to_bytes(4, "little") + head[26:] + body


def stream_pages(packets: list[bytes], granules: list[int], serial: int, segments: int = PAGE_SEGMENTS) -> list[bytes]:
    """A logical stream's pages: the first packet alone on the first page, the others as they fit; a page on which no packet ends has granule -1."""
    pages: list[tuple[int, int, bytes, bytes]] = []
    lacing, body, granule, begun = bytearray(), [], -1, False
    for k, (packet, g) in enumerate(zip(packets, granules)):
        values = bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255])
        at, cut = 0, 0
        while at < len(values):
            if len(lacing) == segments:
                pages.append((CONTINUED * begun, granule, bytes(lacing), b"".join(body)))
                lacing, body, granule, begun = bytearray(), [], -1, at > 0
            take = values[at : at + segments - len(lacing)]
            lacing += take
            size = sum(take)
            body.append(packet[cut : cut + size])
            at, cut = at + len(take), cut + size
        granule = g
        if k == 0:
            pages.append((0, granule, bytes(lacing), b"".join(body)))
            lacing, body, granule, begun = bytearray(), [], -1, False
    if lacing:
        pages.append((CONTINUED * begun, granule, bytes(lacing), b"".join(body)))
    last = len(pages) - 1
    return [_page(f | FIRST * (n == 0) | LAST * (n == last), g, serial, n, lac, b) for n, (f, g, lac, b) in enumerate(pages)]


def mux(payload: bytes, streams: int = STREAMS, frame: int = FRAME) -> bytes:
    """The payload as a chain of interleaved pages; serials follow from the payload, so equal payloads are stored alike."""
    base = zlib.crc32(payload)
    frames = [payload[k : k + frame] for k in range(0, len(payload), frame)]
    lists = []
    for s in range(streams):
        own = frames[s::streams]
        sizes = np.cumsum([0, *map(len, own)]).tolist()
        head = _HEAD.pack(b"TMPCM8", 1, s, streams, frame, len(payload))
        lists.append(stream_pages([head, *own], sizes, (base + s) & 0xFFFFFFFF))
    out = [pages[0] for pages in lists]  # all first pages come before any other
    for k in range(1, max(map(len, lists))):
        out += [pages[k] for pages in lists if k < len(pages)]
    return b"".join(out)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    times: list[float] = field(default_factory=list)  # seconds at each packet's end; of a page's last packet, the granule's
    number: int = -1
    open: bytearray | None = None
    ended: bool = False
    since: list[int] = field(default_factory=list)
    granule: int = 0


def demux(data: bytes, rate: int = RATE) -> dict[int, Stream]:
    """Streams by serial number. A broken pattern, checksum, page order or packet raises ValueError."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + 27 > len(data):
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n = _PAGE.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(data):
            raise ValueError(f"a page cut short at byte {at}")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"a wrong checksum at byte {at}")
        s = streams.setdefault(serial, Stream())
        if number != s.number + 1 or bool(flags & FIRST) != (number == 0) or s.ended or bool(flags & CONTINUED) != (s.open is not None):
            raise ValueError(f"a page out of order at byte {at}")
        s.number, s.ended = number, bool(flags & LAST)
        where, done = at + 27 + n, []
        for v in lacing:
            s.open = (bytearray() if s.open is None else s.open) + data[where : where + v]
            where += v
            if v < 255:
                done.append(bytes(s.open))
                s.open = None
        if done:
            # samples are bytes, so packets before the page's last end as much earlier as they are shorter
            back = np.cumsum([0, *map(len, done[:0:-1])])[::-1].tolist()
            s.times += [max(0, granule - b) / rate for b in back]
            s.packets += done
        elif granule != -1:
            raise ValueError(f"a granule without a packet's end at byte {at}")
        at = end
    if any(s.open is not None or not s.ended for s in streams.values()):
        raise ValueError("a stream without its last page")
    return streams


def unmux(data: bytes) -> tuple[bytes, list[float]]:
    """The payload and, in order, each frame's end time within its stream."""
    own = []
    for s in demux(data).values():
        magic, version, k, streams, frame, samples = _HEAD.unpack(s.packets[0])
        if magic != b"TMPCM8" or version != 1:
            raise ValueError("not a stream of samples")
        own.append((k, streams, samples, s.packets[1:], s.times[1:]))
    own.sort(key=lambda x: x[0])
    if not own or [x[0] for x in own] != list(range(own[0][1])):
        raise ValueError("a stream is missing")
    n = sum(len(x[3]) for x in own)
    frames = [own[k % len(own)][3][k // len(own)] for k in range(n)]
    payload = b"".join(frames)
    if len(payload) != own[0][2]:
        raise ValueError("another number of samples than the header says")
    return payload, [own[k % len(own)][4][k // len(own)] for k in range(n)]


def features(payload: bytes, times: list[float]) -> str:
    """Duration, frames, mean level, root mean square, crossings of the middle and the loudest frame's time, of unsigned samples around 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    frames = x.reshape(-1, FRAME)
    power = (frames * frames).sum(axis=1)
    crossings = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    return f"duration={max(times):.3f};frames={len(frames)};mean={x.mean():.3f};rms={np.sqrt((x * x).mean()):.3f};crossings={crossings};loudest={times[int(power.argmax())]:.3f}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text's UTF-8, filled with bytes 255 to a positive multiple of FRAME, as an Ogg file.

    Null and empty texts give one frame of filling. Null ids and repeated rows stay; other columns are ignored."""

    def run(batches):
        for b in sliced(batches):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            media = [mux(r + b"\xff" * (max(FRAME, -(-len(r) // FRAME) * FRAME) - len(r))) for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(media: DataFrame, with_payload: bool = True) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error (and payload, times) of (doc_id, n_bytes, media).

    A file that fails a check has its error and nulls; a null file is an empty one, which has no page."""
    n = 11 if with_payload else 9

    def run(batches):
        for b in sliced(batches):
            out = []
            for m in b.column(2).to_pylist():
                try:
                    payload, times = unmux(m or b"")
                    out.append((payload, times, features(payload, times), None))
                except ValueError as e:
                    out.append((None, None, None, str(e)))
            files = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1),
                    pa.array([len(o[0]) if o[0] is not None else None for o in out], pa.int64()),
                    pa.array([hashlib.sha256(o[0]).hexdigest() if o[0] is not None else None for o in out], pa.string()),
                    pa.array([zlib.crc32(o[0][-32:]) if o[0] is not None else None for o in out], pa.int64()),
                    pa.array([len(f) if f is not None else None for f in files], pa.int64()),
                    pa.array([hashlib.sha256(f).hexdigest() if f is not None else None for f in files], pa.string()),
                    pa.array([o[2] for o in out], pa.string()), pa.array([o[3] for o in out], pa.string()),
                    pa.array([o[0] if with_payload else None for o in out], pa.binary()), pa.array([o[1] if with_payload else None for o in out], pa.list_(pa.float64())),
                ][:n],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error", "payload", "times"][:n],
            )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string" + ", payload binary, times array<double>" * with_payload
    return media.mapInArrow(run, schema)
