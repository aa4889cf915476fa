"""MPEG transport streams in a binary column: write, parse, check and describe.

A stream has one program (table and map packets first) with one private data stream. Each access unit
is one elementary packet with a presentation time; every GOP-th is a random-access point and carries the
program's clock.

Cases: a null text is stored as an empty one; empty texts give one block of zeros; any length works, a
unit at a time; a null or damaged stream is described as far as it can be read, with its errors
counted; where bytes are lost, reading goes on at the next run of packets; repeated rows give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import texts

# Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC = 188, 0x47
TABLE_PID, NULL_PID = 0x0000, 0x1FFF
PRIVATE_DATA, PRIVATE_STREAM_1 = 0x06, 0xBD
CLOCK = 90_000

# Choices of this writer.
MAP_PID, DATA_PID = 0x1000, 0x0100
UNIT_BYTES, UNIT_TICKS, GOP = 8192, CLOCK // 25, 8
BLOCK = 64


def section_crc(data: bytes) -> int:
    """CRC-32 of program sections: polynomial 0x04C11DB7, not reflected, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _whole(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


def _tables() -> bytes:
    table = _section(0x00, 1, bytes([0, 1, 0xE0 | MAP_PID >> 8, MAP_PID & 0xFF]))
    mapped = _section(0x02, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0, PRIVATE_DATA, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0]))
    return _whole(TABLE_PID, table) + _whole(MAP_PID, mapped)


TABLES = _tables()


def _stamp(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, 0x01 | (t >> 14) & 0xFE, (t >> 7) & 0xFF, 0x01 | (t << 1) & 0xFE])


def _clock(t: int) -> bytes:
    """A clock reference: 33 bits of 90 kHz, and no finer part."""
    return bytes([t >> 25, t >> 17 & 0xFF, t >> 9 & 0xFF, t >> 1 & 0xFF, (t & 1) << 7 | 0x7E, 0])


def mux(payload: bytes) -> bytes:
    """A transport stream that holds payload."""
    out, counter = [TABLES], 0
    high, low = DATA_PID >> 8, DATA_PID & 0xFF
    for unit, start in enumerate(range(0, len(payload), UNIT_BYTES)):
        data = payload[start : start + UNIT_BYTES]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(unit * UNIT_TICKS % 2**33) + data
        flags = b"\x50" + _clock(unit * UNIT_TICKS % 2**33) if unit % GOP == 0 else b"\x00"
        field = max(len(flags), 183 - len(pes))
        at = 183 - field
        out.append(bytes([SYNC, 0x40 | high, low, 0x30 | counter, field]) + flags.ljust(field, b"\xff") + pes[:at])
        counter = (counter + 1) & 15
        while at < len(pes):
            left = len(pes) - at
            if left >= 184:
                out.append(bytes([SYNC, high, low, 0x10 | counter]) + pes[at : at + 184])
            else:
                field = 183 - left
                out.append(bytes([SYNC, high, low, 0x30 | counter, field]) + (b"\x00" + b"\xff" * (field - 1) if field else b"") + pes[at:])
            at += 184
            counter = (counter + 1) & 15
    return b"".join(out)


def resynchronise(stream: bytes, at: int) -> int:
    """Where packets begin again at or after `at`: a sync byte that has others a packet and two packets on, as far as the stream goes."""
    while (at := stream.find(SYNC, at)) >= 0:
        if all(k >= len(stream) or stream[k] == SYNC for k in (at + PACKET, at + 2 * PACKET)):
            return at
        at += 1
    return len(stream)


def sections(held: bytearray) -> Iterator[bytes]:
    """Take whole sections off the front of what a stream of tables has brought; stuffing ends them."""
    while len(held) >= 3 and held[0] != 0xFF:
        size = 3 + ((held[1] & 0x0F) << 8 | held[2])
        if len(held) < size:
            return
        yield bytes(held[:size])
        del held[:size]
    if held and held[0] == 0xFF:
        held.clear()


def demux(stream: bytes | None) -> dict:
    """Parse a stream: tables, counters, elementary packets, times, clocks and random-access points.

    Packets of streams that the program tables don't name are skipped. `errors` counts losses of
    synchronisation, bad table checksums, jumps of a continuity counter and unreadable elementary
    packets. Tables may go over several packets.
    """
    stream = stream or b""
    maps: set[int] = set()
    kinds: dict[int, int] = {}
    last: dict[int, int] = {}
    tables: dict[int, bytearray] = {}
    parts: dict[int, list[bytes]] = {}
    entry: dict[int, bool] = {}
    units: list[tuple[int, int | None, bool, bytes]] = []
    clocks: list[tuple[int, int]] = []
    packets = errors = at = 0
    # a stream may begin with other bytes; one damaged packet after the first is no reason to skip that
    if not any(k >= len(stream) or stream[k] == SYNC for k in (PACKET, 2 * PACKET)):
        at = resynchronise(stream, 0)
        errors += 1

    def close(pid: int) -> None:
        nonlocal errors
        if not (got := parts.pop(pid, None)):
            return
        pes = b"".join(got)
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            errors += 1
            return
        size, skip = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
        time = None
        if pes[7] & 0x80 and len(pes) >= 14:
            s = pes[9:14]
            time = (s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1
        if size and size + 6 != len(pes):
            errors += 1
        units.append((pid, time, entry.get(pid, False), pes[skip : 6 + size if size else None]))

    def read(pid: int, section: bytes) -> None:
        """A program table names maps, a map names streams."""
        nonlocal errors
        size = len(section)
        if size < 12 or not section_crc_ok(section):
            errors += 1
        elif pid == TABLE_PID and section[0] == 0x00:
            for k in range(8, size - 4, 4):
                if section[k] << 8 | section[k + 1]:
                    maps.add((section[k + 2] & 0x1F) << 8 | section[k + 3])
        elif section[0] == 0x02 and size >= 16:
            k = 12 + ((section[10] & 0x0F) << 8 | section[11])
            while k + 5 <= size - 4:
                kinds[(section[k + 1] & 0x1F) << 8 | section[k + 2]] = section[k]
                k += 5 + ((section[k + 3] & 0x0F) << 8 | section[k + 4])

    while at + PACKET <= len(stream):
        if stream[at] != SYNC:
            errors += 1
            at = resynchronise(stream, at)
            continue
        packet, at = at, at + PACKET
        packets += 1
        pid = (stream[packet + 1] & 0x1F) << 8 | stream[packet + 2]
        if pid == NULL_PID:
            continue
        starts, control = stream[packet + 1] & 0x40, stream[packet + 3] >> 4 & 3
        body, access = packet + 4, False
        if control & 2:
            field = stream[body]
            access = field > 0 and bool(stream[body + 1] & 0x40)
            if field >= 7 and stream[body + 1] & 0x10:
                c = stream[body + 2 : body + 8]
                clocks.append((pid, c[0] << 25 | c[1] << 17 | c[2] << 9 | c[3] << 1 | c[4] >> 7))
            body += 1 + field
        if not control & 1:
            continue
        counter = stream[packet + 3] & 15
        if pid in last and counter != (last[pid] + 1) & 15 and pid in kinds:
            errors += 1
            if counter == last[pid]:
                continue  # a repeated packet
        last[pid] = counter
        data = stream[body:at]
        if pid == TABLE_PID or pid in maps:
            if starts and data:
                begun = tables.pop(pid, None)
                if begun is not None and data[0]:
                    begun += data[1 : 1 + data[0]]
                    for section in sections(begun):
                        read(pid, section)
                tables[pid] = bytearray(data[1 + data[0] :])
            elif pid in tables:
                tables[pid] += data
            for section in sections(tables.get(pid, bytearray())):
                read(pid, section)
        elif pid in kinds:
            if starts:
                close(pid)
                parts[pid], entry[pid] = [data], access
            elif pid in parts:
                parts[pid].append(data)
    errors += at < len(stream)
    for pid in list(parts):
        close(pid)
    return {"packets": packets, "programs": len(maps), "streams": kinds, "errors": errors, "units": units, "clocks": clocks}


_SEEN: dict[bytes, bool] = {TABLES[5:21]: True}


def section_crc_ok(section: bytes) -> bool:
    """Sections repeat in every stream, so verdicts are remembered (bounded)."""
    if section not in _SEEN:
        if len(_SEEN) > 1000:
            _SEEN.clear()
        _SEEN[section] = section_crc(section[:-4]) == int.from_bytes(section[-4:], "big")
    return _SEEN[section]


def feature(parsed: dict, payload: bytes) -> str:
    times = [t for _, t, _, _ in parsed["units"] if t is not None]
    points = [t for _, t, entry, _ in parsed["units"] if entry]
    values = np.frombuffer(payload, np.uint8)
    mean = int(values.sum(dtype=np.int64)) / len(values) if len(values) else 0.0
    kinds = ",".join(f"{p}:{k}" for p, k in sorted(parsed["streams"].items()))
    return (
        f"programs={parsed['programs']};streams={kinds};packets={parsed['packets']};units={len(parsed['units'])};"
        f"first={min(times, default=-1)};last={max(times, default=-1)};entry_points={len(points)};last_entry={max(points, default=-1)};"
        f"clocks={len(parsed['clocks'])};errors={parsed['errors']};mean={mean:.6f};levels={len(np.unique(values))}"
    )


STREAMS = "doc_id long, errors int, programs int, units array<struct<pid:int,pts:long,random_access:boolean,bytes:binary>>"


def encode_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a transport stream, padded with zeros to whole blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def parse_streams(media: DataFrame) -> DataFrame:
    """Access units with times and random-access points of the streams in column media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("random_access", pa.bool_()), ("bytes", pa.binary())]))
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                parsed = [demux(x) for x in part.column("media").to_pylist()]
                units = [[{"pid": p, "pts": t, "random_access": e, "bytes": b} for p, t, e, b in x["units"]] for x in parsed]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x["errors"] for x in parsed], pa.int32()), pa.array([x["programs"] for x in parsed], pa.int32()), pa.array(units, kind)], ["doc_id", "errors", "programs", "units"])

    return media.select("doc_id", "media").mapInArrow(run, STREAMS)


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, first_pts long, last_pts long, entry_pts array<long>"


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each text as a stream, read it back and describe what was read; text and stream stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}[x.split()[1]] for x in DIGESTS.split(", ")]
        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                stored = mux(padded(raw))
                parsed = demux(stored)
                payload = b"".join(b for _, _, _, b in parsed["units"])
                times = [t for _, t, _, _ in parsed["units"] if t is not None]
                rows.append((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(parsed, payload), times[0], times[-1], [t for _, t, entry, _ in parsed["units"] if entry]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)
