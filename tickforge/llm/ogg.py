"""Ogg containers: 8-bit samples written as multiplexed logical streams, and any such file read back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: The page's capture pattern, header layout and flags.
CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
#: This module's stream headers: magic, rate, samples (or bytes) in the stream.
IDENT = struct.Struct("<8sIq")
PCM, NOTE = b"\x80pcm-u8\0", b"\x80note\0\0\0"

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, zero start and no final change.

    That is zlib's CRC over mirrored bytes, its start and end values undone, mirrored as a whole.
    """
    return int(f"{zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def make_page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", page_checksum(head + body)) + head[26:] + body


def mux_stream(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages of one logical stream; each packet comes with the granule position at its end.

    The first packet stands on a page of its own. A page's position is that of the last packet which
    ends on it, -1 if none does.
    """
    lacing, body, granule, number, flags = bytearray(), bytearray(), -1, 0, FIRST
    for k, (data, position) in enumerate(packets):
        values = [255] * (len(data) // 255) + [len(data) % 255]
        for i, v in enumerate(values):
            if len(lacing) == 255:
                yield make_page(serial, number, flags, granule, bytes(lacing), bytes(body))
                number, flags, granule = number + 1, CONTINUED if i else 0, -1
                lacing.clear()
                body.clear()
            lacing.append(v)
            body += data[255 * i : 255 * i + v]
        granule = position
        if k in (0, len(packets) - 1):
            yield make_page(serial, number, flags | (LAST if k == len(packets) - 1 else 0), granule, bytes(lacing), bytes(body))
            number, flags, granule = number + 1, 0, -1
            lacing.clear()
            body.clear()


def encode_ogg(payload: bytes, note: bytes, rate: int = 8000, packet: int = 4000) -> bytes:
    """One file with two logical streams: the payload as unsigned 8-bit mono samples, and a note."""
    serial = zlib.crc32(payload)
    samples = [(IDENT.pack(PCM, rate, len(payload)), 0)] + [(payload[i : i + packet], min(i + packet, len(payload))) for i in range(0, len(payload), packet)]
    notes = [(IDENT.pack(NOTE, 0, len(note)), 0), (note, 1)]
    a, b = list(mux_stream(serial, samples)), list(mux_stream(serial ^ 0xFFFFFFFF, notes))
    return b"".join([a[0], b[0], *a[1:2], *b[1:], *a[2:]])  # first pages lead, then data pages in turn


class Damaged(ValueError):
    pass


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(serial, number, flags, granule, lacing, body) of each page, its checksum verified."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != CAPTURE or at + 27 > len(data):
            raise Damaged(f"no page at byte {at}")
        _, version, flags, granule, serial, number, check, n = HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(data):
            raise Damaged(f"page cut off or of an unknown version at byte {at}")
        page = data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]
        if page_checksum(page) != check:
            raise Damaged(f"wrong checksum at byte {at}")
        yield serial, number, flags, granule, lacing, data[at + 27 + n : end]
        at = end


def demux(data: bytes) -> dict[int, dict]:
    """Logical streams by serial number: packets, the page count, and (packets so far, granule) of each page that ends one."""
    streams: dict[int, dict] = {}
    for serial, number, flags, granule, lacing, body in read_pages(data):
        own = streams.get(serial)
        if flags & FIRST:
            if own:
                raise Damaged("a stream begins twice")
            own = streams[serial] = {"packets": [], "pages": 0, "marks": [], "open": [], "ended": False}
        if own is None or own["ended"] or number != own["pages"] or bool(flags & CONTINUED) != bool(own["open"]):
            raise Damaged("pages are missing or out of order")
        own["pages"] += 1
        at, start = 0, 0
        for v in lacing:
            at += v
            if v < 255:
                own["packets"].append(b"".join([*own["open"], body[start:at]]))
                own["open"], start = [], at
        if lacing and lacing[-1] == 255:
            own["open"].append(body[start:at])
        if granule >= 0:
            own["marks"].append((len(own["packets"]), granule))
        own["ended"] = bool(flags & LAST)
    for own in streams.values():
        if own["open"] or not own["ended"] or not own["packets"] or not own["marks"]:
            raise Damaged("a stream does not end, or holds no packet")
    return streams


def decode_ogg(data: bytes) -> dict:
    """payload, note and facts of a file by encode_ogg(); raises Damaged if anything does not fit."""
    streams, out = demux(data), {"streams": 0, "pages": 0, "packets": 0, "payload": None, "note": b"", "rate": 0, "seconds": 0.0}
    for own in streams.values():
        out["streams"] += 1
        out["pages"] += own["pages"]
        out["packets"] += len(own["packets"])
        magic, rate, size = IDENT.unpack(own["packets"][0]) if len(own["packets"][0]) == IDENT.size else (b"", 0, 0)
        body = b"".join(own["packets"][1:])
        if magic in (PCM, NOTE) and len(body) != size:
            raise Damaged("a stream is shorter or longer than its header says")
        if magic == PCM:
            done, last = own["marks"][-1]
            if last != size or done != len(own["packets"]):
                raise Damaged("granule positions do not fit the samples")
            out |= {"payload": body, "rate": rate, "seconds": last / rate, "times": [g / rate for _, g in own["marks"]]}  # of each page
        elif magic == NOTE:
            out["note"] = body
    if out["payload"] is None:
        raise Damaged("no sample stream")
    return out


def describe(out: dict) -> str:
    """Facts of the streams, the time at which each page of samples ends, then of the samples: mean, mean square and crossings of the middle value."""
    times = ",".join(f"{t:.6f}" for t in out["times"])
    x = np.frombuffer(out["payload"], np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"streams={out['streams']};pages={out['pages']};packets={out['packets']};seconds={out['seconds']:.6f};times={times};mean={x.mean():.6f};square={(x * x).mean():.6f};crossings={crossings}"


def write_ogg(docs: DataFrame, *, rate: int = 8000, packet: int = 4000) -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8 bytes (null: none), zero-filled to a positive multiple of 64, as Ogg.

    Each row stands for itself: repeated rows and null ids stay, equal texts make equal files, an
    empty table gives no rows, other columns, whatever their names, are ignored. Rows are taken a few
    at a time, fewer the longer they are, so memory is that of a few MB of text or one longer text.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b["text"]]
            media = [encode_ogg(x + bytes(-len(x) % 64 if x else 64), str(len(x)).encode(), rate, packet) for x in raw]
            yield {"doc_id": b["doc_id"], "n_bytes": [len(x) for x in raw], "media": media}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_bytes long, media binary")


def read_ogg(media: DataFrame) -> DataFrame:
    """doc_id, media, payload, note, seconds, feature and error; of a damaged or null file only error is set."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            rows = []
            for data in b["media"]:
                try:
                    got = decode_ogg(data or b"")
                    rows.append((got["payload"], got["note"].decode(), got["seconds"], describe(got), None))
                except (Damaged, struct.error) as e:
                    rows.append((None, None, None, None, str(e)))
            yield {"doc_id": b["doc_id"], "media": b["media"], **dict(zip(("payload", "note", "seconds", "feature", "error"), map(list, zip(*rows, strict=True)) if rows else [[]] * 5, strict=True))}

    return map_rows(media.select("doc_id", "media"), run, "doc_id long, media binary, payload binary, note string, seconds double, feature string, error string")
