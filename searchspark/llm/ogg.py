"""Ogg containers as media columns: pages, lacing, logical streams, granule positions.

Written from the published container format (RFC 3533). A payload of 8-bit samples is cut into
packets of PACKET samples that go alternately to two logical streams, whose pages are interleaved;
a page ends after PAGE_SEGMENTS lacing values, so long packets continue on the next page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchspark.plans.staging import stage

RATE = 8000
PACKET = 1000
PAGE_SEGMENTS = 60
STREAMS = 2
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET_ENDS = -1
_HEADER = struct.Struct("<4sBBqIIIB")
_ID = struct.Struct("<8sIQ")
_MAGIC = b"samples8"
#: Each byte with its bits in reverse order.
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """The stored bytes are not a sound Ogg file."""


def page_checksum(page: bytes) -> int:
    """The container's CRC: polynomial 04c11db7, most significant bit first, start and end 0.

    It is the mirror image of the CRC in zlib, so bytes and result are mirrored.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = lambda crc: _HEADER.pack(b"OggS", 0, flags, granule, serial, number, crc, len(lacing))
    return head(page_checksum(head(0) + lacing + body)) + lacing + body


def _stream(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one stream; packets come with the granule position at their end."""
    pages, lacing, body, granule, flags = [], bytearray(), bytearray(), NO_PACKET_ENDS, FIRST
    for i, (data, at) in enumerate(packets):
        values = [255] * (len(data) // 255) + [len(data) % 255]
        for k, value in enumerate(values):
            if len(lacing) == PAGE_SEGMENTS:
                pages.append(_page(serial, len(pages), flags, granule, bytes(lacing), bytes(body)))
                flags = CONTINUED if k else 0
                lacing.clear(), body.clear()
                granule = NO_PACKET_ENDS
            lacing.append(value)
            body += data[255 * k : 255 * k + value]
        granule = at
        if i == 0 or i == len(packets) - 1:
            last = LAST if i == len(packets) - 1 else 0
            pages.append(_page(serial, len(pages), flags | last, granule, bytes(lacing), bytes(body)))
            flags = 0
            lacing.clear(), body.clear()
            granule = NO_PACKET_ENDS
    return pages


def encode(payload: bytes) -> bytes:
    """The payload as an Ogg file; the same payload always gives the same bytes."""
    parts = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    streams = []
    for s in range(STREAMS):
        at, packets = 0, [(_ID.pack(_MAGIC, RATE, len(payload)), 0)]
        for part in parts[s::STREAMS]:
            at += len(part)
            packets.append((part, at))
        streams.append(_stream(s + 1, packets))
    first = [pages[0] for pages in streams]
    rest = [pages[i] for i in range(1, max(map(len, streams))) for pages in streams if i < len(pages)]
    return b"".join(first + rest)


@dataclass
class Demuxed:
    """What a reader finds: packets by stream with the time of their last sample in seconds, pages,
    seconds by stream. A page's granule position belongs to the last packet that ends on it; those
    before it on the page end earlier by the samples that follow."""

    packets: dict[int, list[bytes]]
    times: dict[int, list[float]]
    pages: int
    continued: int
    seconds: dict[int, float]


def demux(media: bytes) -> Demuxed:
    """Verify every page's checksum and sequence, put packets together, derive timestamps."""
    out = Demuxed({}, {}, 0, 0, {})
    pending: dict[int, bytearray] = {}
    rate: dict[int, int] = {}
    numbers: dict[int, int] = {}
    ended: set[int] = set()
    at = 0
    while at < len(media):
        if len(media) - at < _HEADER.size:
            raise OggError("the last page has no whole header")
        magic, version, flags, granule, serial, number, crc, n = _HEADER.unpack_from(media, at)
        lacing = media[at + _HEADER.size : at + _HEADER.size + n]
        end = at + _HEADER.size + n + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < n or end > len(media):
            raise OggError(f"no page at byte {at}")
        page = media[at:end]
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        if serial in ended or numbers.get(serial, -1) + 1 != number or (number == 0) != bool(flags & FIRST):
            raise OggError(f"page {number} of stream {serial} is out of sequence")
        if bool(flags & CONTINUED) != (serial in pending):
            raise OggError(f"a packet of stream {serial} is broken off")
        numbers[serial] = number
        packets, times = out.packets.setdefault(serial, []), out.times.setdefault(serial, [])
        body, closed = at + _HEADER.size + n, 0
        current = pending.pop(serial, bytearray())
        for value in lacing:
            current += media[body : body + value]
            body += value
            if value < 255:
                if not packets:
                    name, hertz, _ = _ID.unpack(bytes(current))
                    if name != _MAGIC:
                        raise OggError(f"stream {serial} is of another kind")
                    rate[serial] = hertz
                packets.append(bytes(current))
                closed += 1
                current = bytearray()
        if n and lacing[-1] == 255:
            pending[serial] = current
        if closed:
            at_end = np.full(closed, granule)
            at_end[:-1] -= np.cumsum([len(p) for p in packets[len(packets) - closed + 1 :]][::-1], dtype=np.int64)[::-1]
            times += (at_end / rate[serial]).tolist()
            out.seconds[serial] = times[-1]
        elif granule != NO_PACKET_ENDS:
            raise OggError(f"page {number} of stream {serial} ends no packet but has a position")
        out.pages += 1
        out.continued += bool(flags & CONTINUED)
        if flags & LAST:
            ended.add(serial)
        at = end
    if pending or ended != set(numbers):
        raise OggError("a stream has no last page")
    return out


def decode(media: bytes) -> tuple[bytes, Demuxed]:
    """The payload and what the demultiplexer found."""
    found = demux(media)
    lanes = [found.packets[s][1:] for s in sorted(found.packets)]
    size = _ID.unpack(found.packets[min(found.packets)][0])[2]
    longest = max(map(len, lanes))
    payload = b"".join(lane[i] for i in range(longest) for lane in lanes if i < len(lane))
    if len(payload) != size:
        raise OggError(f"{len(payload)} of {size} samples")
    return payload, found


def padded(data: bytes, unit: int = 64) -> bytes:
    """Zero bytes appended up to a positive multiple of unit."""
    return data + bytes(-len(data) % unit if data else unit)


def to_media(text: pd.Series) -> pd.Series:
    """UTF-8 of the text, padded, as an Ogg file; null counts as empty."""
    return text.map(lambda t: encode(padded((t or "").encode())))


FEATURES = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
)


def media_features(media: pd.Series) -> pd.DataFrame:
    """What the stored bytes hold, read back through the demultiplexer."""
    rows = []
    for stored in media:
        stored = bytes(stored)
        payload, found = decode(stored)
        seconds = ";".join(f"{s}:{found.seconds[s]:.6f}" for s in sorted(found.seconds))
        times = zlib.crc32(np.array([t for s in sorted(found.times) for t in found.times[s]], dtype="<f8").tobytes())
        feature = f"pages={found.pages},packets={sum(map(len, found.packets.values()))},continued={found.continued},seconds={seconds},times={times}"
        rows.append(
            (
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                len(stored), hashlib.sha256(stored).hexdigest(), feature,
            )
        )
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])


def with_media(docs: DataFrame) -> DataFrame:
    """docs with the column media: each text stored as an Ogg file. Null texts are empty ones.

    A row is worked on by itself, so repeated rows, ties and further columns are as they were; a
    column named media is replaced.
    """
    return docs.withColumn("media", F.pandas_udf(to_media, "binary")("text"))


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the features of the media column, one row per document.

    The column is written to the shared folder, and the features come from what is read back. Null
    and empty texts are 64 zero bytes; repeated rows each have theirs; an empty table gives no rows;
    other columns are ignored.
    """
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    stored = stage(with_media(docs.select("doc_id", "text")).select("doc_id", n, "media"), "ogg-media")
    features = F.pandas_udf(media_features, FEATURES)
    return stored.select("doc_id", "n_bytes", features("media").alias("f")).select("doc_id", "n_bytes", "f.*")
