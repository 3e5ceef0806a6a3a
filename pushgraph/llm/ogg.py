"""Ogg media columns: pages with checksums, packets by lacing values, logical streams, granule times.

The writer stores 8-bit samples. Frames of ``FRAME`` samples go in packets of ``PACKET`` frames, dealt in
turn to two logical streams, whose pages are interleaved. The reader takes any Ogg bytes: it verifies each
page's checksum, joins packets across pages, keeps streams apart by serial number and derives each
packet's end from the granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pushgraph.session import small_batches, table

# Fixed values of the format: capture pattern, header flags, header layout without lacing values.
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
#: Above every serial number, which has 32 bits.
CHAIN = 1 << 32
HEADER = struct.Struct("<4sBBqIIIB")
NO_GRANULE = -1

FRAME, PACKET, RATE = 192, 24, 8000
SERIALS = (1, 2)
SEGMENTS = 48
HEAD = struct.Struct("<8sBBHIQ")
MAGIC = b"PCM8data"

_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(data: bytes) -> int:
    """CRC-32 with polynomial 04C11DB7, not reflected, start 0, no final inversion.

    It is zlib's reflected CRC over bit-reversed bytes, bit-reversed, without its inversions.
    """
    crc = zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_FLIP), "big")


def _page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


class StreamWriter:
    """Pages of one logical stream; a packet may run over several."""

    def __init__(self, serial: int, segments: int = SEGMENTS) -> None:
        self.serial, self.segments, self.sequence = serial, segments, 0
        self.lacing, self.body, self.granule, self.open = bytearray(), bytearray(), NO_GRANULE, False

    def _flush(self, last: bool) -> bytes:
        flags = CONTINUED * self.open | FIRST * (self.sequence == 0) | LAST * last
        out = _page(self.serial, self.sequence, flags, self.granule, bytes(self.lacing), bytes(self.body))
        self.sequence += 1
        self.open = bool(self.lacing) and self.lacing[-1] == 255
        self.lacing, self.body, self.granule = bytearray(), bytearray(), NO_GRANULE
        return out

    def packet(self, data: bytes, granule: int, flush: bool = False, last: bool = False) -> bytes:
        """The pages that this packet fills."""
        out, at = bytearray(), 0
        lacing = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        for i, n in enumerate(lacing):
            if len(self.lacing) == self.segments:
                out += self._flush(False)
            self.lacing.append(n)
            self.body += data[at : at + n]
            at += n
            if i == len(lacing) - 1:
                self.granule = granule
        if flush or last:
            out += self._flush(last)
        return bytes(out)


def encode(payload: bytes) -> bytes:
    """payload (a positive multiple of FRAME bytes) as two interleaved streams of 8-bit samples.

    Packets alternate between the streams. A granule position is the number of samples of the whole
    recording up to the packet's end, so the two streams' packets merge by time.
    """
    if not payload or len(payload) % FRAME:
        raise ValueError(f"a positive multiple of {FRAME} bytes is needed, not {len(payload)}")
    writers = [StreamWriter(s) for s in SERIALS]
    out = bytearray()
    for w in writers:
        out += w.packet(HEAD.pack(MAGIC, 1, 8, FRAME, RATE, len(payload)), 0, flush=True)
    size = FRAME * PACKET
    count = -(-len(payload) // size)
    for k in range(count):
        out += writers[k % 2].packet(payload[k * size : (k + 1) * size], min(len(payload), (k + 1) * size), last=k >= count - 2)
    if count == 1:
        out += writers[1].packet(b"", 0, last=True)
    return bytes(out)


@dataclass
class Packet:
    data: bytes
    granule: int | None = None  # of the page on which it is the last to end


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    lost: int = 0  # gaps in the sequence numbers, and pages whose checksum failed
    ended: bool = False
    part: bytearray | None = None
    next: int | None = None


def demultiplex(media: bytes) -> tuple[dict[int, Stream], int, int]:
    """(streams by serial number, pages with a wrong checksum, bytes outside pages).

    A page with a wrong checksum is dropped and reading goes on at the next capture pattern. A packet that lost a part is dropped,
    and counted as lost; so is one whose next page does not continue it. Streams may be chained: one that begins anew under a serial that
    has been used is a stream of its own, with CHAIN added to its number for each before it.
    """
    streams: dict[int, Stream] = {}
    links: dict[int, int] = {}
    at, bad, stray = 0, 0, 0
    while at < len(media):
        start = media.find(CAPTURE, at)
        if start < 0:
            stray += len(media) - at
            break
        stray += start - at
        if len(media) - start < HEADER.size:
            stray += len(media) - start
            break
        _, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(media, start)
        body = start + HEADER.size + n
        lacing = media[start + HEADER.size : body]
        end = body + sum(lacing)
        if version or end > len(media) or len(lacing) < n or page_checksum(media[start : start + 22] + bytes(4) + media[start + 26 : end]) != crc:
            bad += 1
            at = start + len(CAPTURE)
            continue
        if flags & FIRST and serial + CHAIN * links.get(serial, 0) in streams:
            links[serial] = links.get(serial, 0) + 1
        s = streams.setdefault(serial + CHAIN * links.get(serial, 0), Stream(serial))
        if s.next is not None and sequence != s.next:
            s.lost += 1
            s.part = None
        s.pages += 1
        s.next = sequence + 1
        s.ended |= bool(flags & LAST)
        part, done = s.part, None
        skip = bool(flags & CONTINUED) and part is None  # its start was lost
        if not flags & CONTINUED and part is not None:
            s.lost += 1
            part = None
        pos = body
        for v in lacing:
            part = bytearray() if part is None else part
            part += media[pos : pos + v]
            pos += v
            if v < 255:
                if not skip:
                    done = Packet(bytes(part))
                    s.packets.append(done)
                part, skip = None, False
        s.part = None if skip else part
        if done is not None and granule != NO_GRANULE:
            done.granule = granule
        at = end
    return streams, bad, stray


def packet_ends(stream: Stream, step: int) -> list[int | None]:
    """End of each data packet, in samples: its page's granule position where it is the page's last
    packet, else the next one's end less the samples between (step, for the packets of the other streams too)."""
    ends: list[int | None] = [p.granule for p in stream.packets]
    for i in range(len(ends) - 2, -1, -1):
        if ends[i] is None and ends[i + 1] is not None:
            ends[i] = ends[i + 1] - len(stream.packets[i + 1].data) - step
    return ends


def decode(media: bytes) -> tuple[bytes | None, dict[str, int]]:
    """(payload, facts): the streams' packets merged by time; None where a page or packet is missing."""
    streams, bad, stray = demultiplex(media)
    facts = {"streams": len(streams), "pages": sum(s.pages for s in streams.values()), "bad": bad, "stray": stray, "lost": sum(s.lost for s in streams.values())}
    timed, total, rate = [], None, RATE
    for s in streams.values():
        if not s.packets or len(s.packets[0].data) != HEAD.size or not s.packets[0].data.startswith(MAGIC):
            continue
        _, _, _, _, rate, total = HEAD.unpack(s.packets[0].data)
        body = Stream(s.serial, [p for p in s.packets[1:] if p.data])
        timed += [(end, p.data) for end, p in zip(packet_ends(body, FRAME * PACKET), body.packets, strict=True) if end is not None]
    timed.sort()
    facts |= {"packets": len(timed), "samples": timed[-1][0] if timed else 0, "duration_us": timed[-1][0] * 1_000_000 // rate if timed else 0}
    at = 0
    for end, data in timed:
        at += len(data)
        if at != end:
            return None, facts
    return (b"".join(d for _, d in timed) if at == total else None), facts


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the text in UTF-8 with spaces up to a positive multiple of FRAME)."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(FRAME, -(-len(raw) // FRAME) * FRAME), b" ")


def to_ogg(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) for each input row; null and empty texts are FRAME spaces."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media, held, start = [], [], 0, 0
            for i, x in enumerate(batch.column("text")):
                n, payload = padded(x.as_py())
                sizes.append(n)
                media.append(encode(payload))
                held += len(media[-1])
                if held > 8 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(sizes)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                    start, sizes, media, held = i + 1, [], [], 0

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(store, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def media_columns(media: DataFrame, *, keep: tuple[str, ...] = ("doc_id", "n_bytes"), media_col: str = "media") -> DataFrame:
    """For each row of Ogg bytes: the kept columns, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature.

    Null or damaged media give null payload columns; the feature then tells what was found. Rows are
    independent: repeated rows and equal media give equal values, no rows give none.
    """
    names = [*keep, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = {f.name: f.dataType.simpleString() for f in media.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for x in batch.column("_media"):
                stored = x.as_py()
                if stored is None:
                    row = (None, None, None, None, None, "streams=0")
                else:
                    payload, facts = decode(stored)
                    feature = ";".join(f"{k}={v}" for k, v in facts.items())
                    told = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
                    row = (*told, len(stored), hashlib.sha256(stored).hexdigest(), feature)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return media.select(*keep, F.col(media_col).alias("_media")).mapInArrow(read, schema)


def op1_ogg_columns(spark, sf_dir):
    """All documents, stored as Ogg and read back."""
    return media_columns(to_ogg(table(small_batches(spark), sf_dir, "documents")))
