"""Media columns: MPEG transport streams.

``store`` puts a payload into a transport stream: program tables, packetised
elementary packets with timestamps and random-access points, in packets of 188
bytes with continuity counters. ``read_back`` parses transport streams, these
and others: it finds the packets, follows the tables from PID 0 to all programs
and their components, checks counters, reassembles the elementary packets and
gives the payload, timestamps and random-access points. What ``store`` writes
has one program with one private-data component, so bytes are kept as they are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresift.llm.textbytes import texts_of

PACKET = 188
#: The payload is padded with bytes 0 to a multiple of it.
UNIT = 64
#: Payload bytes of an elementary packet; each begins an access unit.
UNIT_BYTES = 16 * 1024
#: Fixed values of the format: sync byte, PIDs, table ids, stream id and type, clock rate.
SYNC, PAT_PID, PMT_PID, DATA_PID = 0x47, 0x0000, 0x1000, 0x0100
PAT_TABLE, PMT_TABLE, PRIVATE_STREAM, PRIVATE_TYPE = 0x00, 0x02, 0xBD, 0x06
CLOCK = 90_000
#: Sync bytes in a row, a packet apart, that tell where packets begin.
LOCK = 2
#: Ticks between elementary packets: 25 a second.
TICKS = CLOCK // 25
#: Every so many elementary packets one is marked as a random-access point.
ACCESS_EVERY = 4


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
        out.append(crc & 0xFFFFFFFF)
    return out


CRC_TABLE = _crc_table()


def section_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ CRC_TABLE[(crc >> 24) ^ byte]
    return crc


def section(table_id: int, number: int, body: bytes) -> bytes:
    size = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | size >> 8, size & 255]) + number.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


def table_packet(pid: int, counter: int, held: bytes) -> bytes:
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0]) + held
    return packet + b"\xff" * (PACKET - len(packet))


def stamp(mark: int, ticks: int) -> bytes:
    """33 bits of a timestamp in five bytes."""
    return bytes([mark << 4 | (ticks >> 30 & 7) << 1 | 1, ticks >> 22 & 255, (ticks >> 15 & 127) << 1 | 1, ticks >> 7 & 255, (ticks & 127) << 1 | 1])


def ticks_of(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def clock(ticks: int) -> bytes:
    base = ticks & (1 << 33) - 1
    return (base << 15 | 0x7E00).to_bytes(6, "big")


TABLES = (
    section(PAT_TABLE, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")),
    section(PMT_TABLE, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"),
)


def padded(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def mux(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``; tables stand before each random-access point."""
    out, counter, tables = [], 0, 0
    for number, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        access = number % ACCESS_EVERY == 0
        if access:
            out += [table_packet(PAT_PID, tables, TABLES[0]), table_packet(PMT_PID, tables, TABLES[1])]
            tables += 1
        ticks = TICKS * (number + 1)
        part = payload[at : at + UNIT_BYTES]
        pes = bytes([0, 0, 1, PRIVATE_STREAM]) + (8 + len(part)).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(2, ticks) + part
        field_ = (bytes([7, 0x50 if access else 0x10]) + clock(ticks)) if access else b""
        first = PACKET - 4 - len(field_)
        if len(pes) < first:  # one packet, stuffed
            room = PACKET - 4 - len(pes)
            field_ = stuffing(room, field_)
            out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, 0x30 | counter & 15]) + field_ + pes)
            counter += 1
            continue
        out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, (0x30 if field_ else 0x10) | counter & 15]) + field_ + pes[:first])
        counter += 1
        whole, rest = divmod(len(pes) - first, PACKET - 4)
        if whole:
            block = np.empty((whole, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
            block[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            block[:, 4:] = np.frombuffer(pes, np.uint8, whole * (PACKET - 4), first).reshape(whole, PACKET - 4)
            out.append(block.tobytes())
            counter += whole
        if rest:
            out.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x30 | counter & 15]) + stuffing(PACKET - 4 - rest, b"") + pes[len(pes) - rest :])
            counter += 1
    return b"".join(out)


def stuffing(room: int, field_: bytes) -> bytes:
    """An adaptation field of ``room`` bytes that begins as ``field_``."""
    if not room:
        return b""
    if room == 1:
        return b"\0"
    flags = field_[1:] or b"\0"
    return bytes([room - 1]) + flags + b"\xff" * (room - 1 - len(flags))


@dataclass
class Component:
    """An elementary stream of a program."""

    program: int
    pid: int
    stream_type: int
    payload: bytes = b""
    cut: int = 0  # elementary packets that do not begin as such or are shorter than they say
    stamps: list[int] = field(default_factory=list)  # of each elementary packet; -1: none
    access: list[int] = field(default_factory=list)  # timestamps of random-access points
    clocks: int = 0


@dataclass
class Stream:
    """What a parse of a transport stream finds."""

    programs: dict[int, int] = field(default_factory=dict)  # number -> PID of its table
    components: dict[int, Component] = field(default_factory=dict)  # by PID, in the order of programs and tables
    packets: int = 0
    skipped: int = 0  # bytes outside packets
    lost: int = 0  # continuity counters that do not follow
    repeated: int = 0  # packets sent twice
    bad_tables: int = 0

    @property
    def first(self) -> Component:
        """The first component of the first program."""
        return next(iter(self.components.values()), Component(-1, -1, -1))

    @property
    def payload(self) -> bytes:
        return self.first.payload

    @property
    def stamps(self) -> list[int]:
        return self.first.stamps

    @property
    def access(self) -> list[int]:
        return self.first.access

    @property
    def clocks(self) -> int:
        return self.first.clocks

    @property
    def data_pid(self) -> int:
        return self.first.pid

    @property
    def pmt_pid(self) -> int:
        return self.programs.get(self.first.program, -1)

    @property
    def cut(self) -> int:
        return sum(c.cut for c in self.components.values())

    def feature(self) -> str:
        c = self.first
        ends = (c.stamps[0], c.stamps[-1]) if c.stamps else (-1, -1)
        others = "".join(f";also={o.pid:#x}:{o.stream_type:#x}" for o in self.components.values() if o is not c)
        return f"pmt={self.pmt_pid:#x};pid={c.pid:#x};type={c.stream_type:#x};packets={self.packets};lost={self.lost};repeated={self.repeated};skipped={self.skipped};bad_tables={self.bad_tables};cut={self.cut};pes={len(c.stamps)};pts={ends[0]}..{ends[1]};access={','.join(map(str, c.access))};pcr={c.clocks}{others}"


def _body(packet: bytes) -> tuple[bytes, bytes]:
    """(adaptation field without its length, payload) of a packet."""
    kind = packet[3] >> 4 & 3
    if kind == 1:
        return b"", packet[4:]
    if kind == 3:
        n = packet[4]
        return packet[5 : 5 + n], packet[5 + n :]
    return (packet[5 : 5 + packet[4]], b"") if kind == 2 else (b"", b"")


def packets_of(data: bytes) -> np.ndarray:
    """A row of PACKET bytes for each packet. Where a sync byte is missing, packets go on at the next one that LOCK - 1 others follow, or as many as the data has room for."""
    held = np.frombuffer(data, np.uint8)
    n = len(held) // PACKET
    whole = held[: n * PACKET].reshape(n, PACKET)
    if (whole[:, 0] == SYNC).all():
        return whole
    begins = (held == SYNC)[: max(len(held) - PACKET + 1, 0)]  # a packet has room there
    sure = begins.copy()
    for k in range(1, LOCK):
        sure[: -k * PACKET] &= begins[k * PACKET :]
    starts = np.flatnonzero(sure)
    runs, at = [], 0
    while at + PACKET <= len(held):
        if not sure[at]:
            k = int(np.searchsorted(starts, at))
            if k == len(starts):
                break
            at = int(starts[k])
        missing = np.flatnonzero(~begins[at::PACKET])
        count = int(missing[0]) if len(missing) else len(begins[at::PACKET])
        runs.append(held[at : at + count * PACKET].reshape(count, PACKET))
        at += count * PACKET
    return np.concatenate(runs) if runs else whole[:0]


def sections_of(own: np.ndarray, table_id: int) -> tuple[list[bytes], int]:
    """(what sound sections of ``table_id`` hold between header and checksum, how many others are not sound); ``own``: packets of one PID. A section may run over packets."""
    found, bad = [], 0
    held: bytes | None = None  # of a section that has begun

    def take(rest: bytes) -> bytes | None:
        nonlocal bad
        while rest and rest[0] != 0xFF:
            size = 3 + ((rest[1] & 15) << 8 | rest[2]) if len(rest) >= 3 else 1 << 12
            if size > len(rest):
                return rest
            if rest[0] == table_id and size >= 12 and not section_crc(rest[:size]):
                found.append(rest[8 : size - 4])
            else:
                bad += rest[0] == table_id
            rest = rest[size:]
        return None

    for packet in own:
        body = _body(packet.tobytes())[1]
        if not body:
            continue
        if packet[1] & 0x40:
            if held is not None:
                bad += take(held + body[1 : 1 + body[0]]) is not None
            held = take(body[1 + body[0] :])
        elif held is not None:
            held = take(held + body)
    return found, bad + (held is not None)


def reassemble(own: np.ndarray, out: Component) -> None:
    """Elementary packets of one PID's packets; what stands before the first that begins is passed over."""
    begins = np.flatnonzero(own[:, 1] & 0x40)
    parts = []
    for k, i in enumerate(begins):
        after = begins[k + 1] if k + 1 < len(begins) else len(own)
        adaptation, held = _body(own[i].tobytes())
        chunks, j = [held], i + 1
        if adaptation and adaptation[0] & 0x10:
            out.clocks += 1
        while j < after:
            plain = own[j:after, 3] & 0x30 == 0x10
            m = int(np.argmin(plain)) if not plain.all() else after - j
            if m:
                chunks.append(own[j : j + m, 4:].tobytes())
                j += m
            if j < after:
                chunks.append(_body(own[j].tobytes())[1])
                j += 1
        pes = b"".join(chunks)
        if len(pes) < 9 or pes[:3] != b"\0\0\1":
            out.cut += 1
            continue
        size = pes[4] << 8 | pes[5]
        ticks = ticks_of(pes[9:14]) if pes[7] & 0x80 and len(pes) >= 14 else -1
        out.cut += len(pes) < 6 + size
        out.stamps.append(ticks)
        if adaptation and adaptation[0] & 0x40:
            out.access.append(ticks)
        parts.append(pes[9 + pes[8] : 6 + size if size else None])
    out.payload = b"".join(parts)


def demux(data: bytes) -> Stream:
    """Parse ``data``: all programs and components.

    Bytes outside packets, packets marked as faulty and packets sent twice are
    passed over; a counter that does not follow is a loss, unless the packet
    says that its counter begins anew.
    """
    out = Stream()
    grid = packets_of(data)
    out.packets, out.skipped = len(grid), len(data) - PACKET * len(grid)
    if (faulty := grid[:, 1] & 0x80).any():
        grid = grid[faulty == 0]
    pids = (grid[:, 1].astype(np.int32) & 31) << 8 | grid[:, 2]
    by_pid: dict[int, np.ndarray] = {}
    for pid in np.unique(pids).tolist():
        own = grid[pids == pid]
        loaded = np.flatnonzero(own[:, 3] & 0x10)
        step = np.diff((own[loaded, 3] & 15).astype(np.int16)) % 16
        odd = np.flatnonzero(step != 1) + 1
        twice = [int(k) for k in odd if step[k - 1] == 0 and _body(own[loaded[k]].tobytes())[1] == _body(own[loaded[k - 1]].tobytes())[1]]
        anew = [int(k) for k in odd if own[loaded[k], 3] & 0x20 and own[loaded[k], 4] and own[loaded[k], 5] & 0x80]
        out.lost += len(odd) - len(twice) - len(set(anew) - set(twice))
        out.repeated += len(twice)
        by_pid[pid] = np.delete(own, loaded[twice], 0) if twice else own

    nothing = grid[:0]
    tables, out.bad_tables = sections_of(by_pid.get(PAT_PID, nothing), PAT_TABLE)
    for programs in tables:
        for j in range(0, len(programs) - 3, 4):
            if number := programs[j] << 8 | programs[j + 1]:  # 0 is the network's own
                out.programs[number] = (programs[j + 2] & 31) << 8 | programs[j + 3]
    for number in sorted(out.programs):
        tables, bad = sections_of(by_pid.get(out.programs[number], nothing), PMT_TABLE)
        out.bad_tables += bad
        for program in tables:
            j = 4 + ((program[2] & 15) << 8 | program[3]) if len(program) >= 4 else len(program)
            while j + 5 <= len(program):
                pid = (program[j + 1] & 31) << 8 | program[j + 2]
                out.components.setdefault(pid, Component(number, pid, program[j]))
                j += 5 + ((program[j + 3] & 15) << 8 | program[j + 4])
    for pid, component in out.components.items():
        reassemble(by_pid.get(pid, nothing), component)
    return out


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes (null: none), padded, as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            sizes = np.diff(texts.starts)
            for first, after in groups(sizes):
                media = [mux(padded(texts.row(i))) for i in range(first, after)]
                yield pa.record_batch([batch.column("doc_id").slice(first, after - first), pa.array(sizes[first:after], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def groups(sizes: np.ndarray, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Spans of neighbours that sum to ``most`` or have one member."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    first = 0
    while first < len(sizes):
        after = max(first + 1, int(np.searchsorted(total, total[first] + most, side="right")) - 1)
        yield first, after
        first = after


DIGEST = "doc_id {id}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, access_points array<long>"


def read_back(media: DataFrame) -> DataFrame:
    """What store() wrote, parsed: digests of the payload that was read, features, timestamps and random-access points.

    Bytes that are no transport stream give an empty payload; null media too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "access_points"]
        for batch in batches:
            streams = texts_of(batch.column("media"))
            rows = []
            for i in range(streams.n):
                data = streams.row(i)
                s = demux(data)
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), s.feature(), s.stamps, s.access))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=names)

    media = media.select("doc_id", "n_bytes", "media")
    return media.mapInArrow(run, DIGEST.format(id=media.schema["doc_id"].dataType.simpleString()))
