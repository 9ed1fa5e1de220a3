"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

`mux` wraps a payload in elementary packets (PES) with presentation timestamps and cuts them into 188-byte transport
packets behind a program association table and a program map table; `demux` parses the tables, checks the continuity
counters, reassembles the elementary packets and lists timestamps and random-access points.

Defined cases: an empty payload gives the two tables only. Nothing is raised on damage: `damaged` counts lost sync bytes
(found again at the next two that stand a packet apart), packets with an error flag, scrambling or a wrong adaptation
field, broken sections, and elementary packets that are broken or shorter than they say, whose bytes stay as far as they
came. A packet sent twice counts once; sections may go on over packets. For the column operator null text is empty, very
long texts become many elementary packets, repeated rows each get a row, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_text

PACKET, SYNC = 188, 0x47
PMT_PID, MEDIA_PID, PROGRAM, PRIVATE_STREAM = 0x1000, 0x0100, 1, 0xBD
UNIT = 162 + 184 * 63  # payload bytes of a full elementary packet: its transport packets need no stuffing
TICKS = 3003  # 90 kHz ticks between two elementary packets
RANDOM_ACCESS_EVERY = 8
_POLY = 0x04C11DB7


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ _POLY if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 4).to_bytes(2, "big") + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


def tables() -> bytes:
    pat = _section(0, (1).to_bytes(2, "big") + b"\xc1\x00\x00" + PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    stream = b"\x06" + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(2, PROGRAM.to_bytes(2, "big") + b"\xc1\x00\x00" + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)
    return _table_packet(0, pat) + _table_packet(PMT_PID, pmt)


def _pts_bytes(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, 1 | (t >> 14) & 0xFE, (t >> 7) & 0xFF, 1 | (t << 1) & 0xFE])


def _pts_value(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    out, counter, pid = [tables()], 0, MEDIA_PID
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit, pts = payload[at : at + UNIT], (k * TICKS) & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _pts_bytes(pts) + unit
        flags = 0x10 | (0x40 if k % RANDOM_ACCESS_EVERY == 0 else 0)
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")
        first = min(len(pes), 176)
        adaptation = bytes([183 - first, flags]) + clock + b"\xff" * (176 - first)
        out.append(bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x30 | counter & 15]) + adaptation + pes[:first])
        counter += 1
        full, rest = divmod(len(pes) - first, 184)
        if full:
            packets = np.empty((full, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, pid >> 8, pid & 0xFF
            packets[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            packets[:, 4:] = np.frombuffer(pes, np.uint8, full * 184, first).reshape(full, 184)
            out.append(packets.tobytes())
            counter += full
        if rest:
            length = 183 - rest
            adaptation = bytes([length]) + (b"\x00" + b"\xff" * (length - 1) if length else b"")
            out.append(bytes([SYNC, pid >> 8, pid & 0xFF, 0x30 | counter & 15]) + adaptation + pes[-rest:])
            counter += 1
    return b"".join(out)


@dataclass
class Stream:
    packets: int = 0
    damaged: int = 0
    continuity_errors: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    pids: list[int] = field(default_factory=list)
    pts: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # timestamps of the packets that allow it
    payload: bytes = b""


def _packets(media: bytes) -> tuple[np.ndarray, int]:
    """The packets as rows of bytes, and how often the sync byte was not where it should be. Lost sync is found again where
    two sync bytes stand a packet apart."""
    n = len(media) // PACKET
    grid = np.frombuffer(media, np.uint8, n * PACKET).reshape(n, PACKET)
    if len(media) == n * PACKET and (grid[:, 0] == SYNC).all():
        return grid, 0
    at, starts, lost = 0, [], 0
    while at + PACKET <= len(media):
        if media[at] == SYNC:
            starts.append(at)
            at += PACKET
            continue
        lost += 1
        at = media.find(SYNC, at + 1)
        while at >= 0 and at + PACKET < len(media) and media[at + PACKET] != SYNC:
            at = media.find(SYNC, at + 1)
        if at < 0:
            break
    if 0 <= at < len(media) or not starts:
        lost += bool(len(media))  # what is left is no packet
    whole = np.frombuffer(media, np.uint8)
    return whole[np.array(starts, np.int64)[:, None] + np.arange(PACKET)], lost


def _sections(packets: np.ndarray, begin: np.ndarray) -> tuple[list[bytes], int]:
    """The table sections of one PID's packets, which may go on over packets, and the number of broken ones."""
    found, broken, held = [], 0, b""

    def take(data: bytes) -> bytes:
        """Takes whole sections off the data; gives back a begun one."""
        nonlocal broken
        while len(data) >= 3 and data[0] != 0xFF:
            end = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
            if end > len(data):
                return data
            if end >= 12 and crc32_mpeg(data[:end]) == 0:
                found.append(data[:end])
            else:
                broken += 1
            data = data[end:]
        return b"" if data[:1] == b"\xff" else data

    for p, at in zip(packets, begin):
        data = p[at:].tobytes()
        if not data:
            continue
        if p[1] & 0x40:
            skip = data[0]
            rest = take(held + data[1 : 1 + skip]) if held else b""
            broken += bool(rest)  # a section that a new one cuts short
            held = take(data[1 + skip :])
        elif held:
            held = take(held + data)
    return found, broken + bool(held)


def _elementary(own: np.ndarray, begin: np.ndarray, heads: np.ndarray) -> list[bytes]:
    """The elementary packets that begin at the packets `heads`."""
    out = []
    for h, end in zip(heads, [*heads[1:], len(own)]):
        block = [own[h, begin[h] :].tobytes()]
        plain = end - h - 1
        while plain and begin[h + plain] != 4:  # stuffed packets stand at the end
            plain -= 1
        tail = h + 1
        if plain and (begin[h + 1 : h + 1 + plain] == 4).all():
            block.append(own[h + 1 : h + 1 + plain, 4:].tobytes())
            tail += plain
        out.append(b"".join([*block, *(own[i, begin[i] :].tobytes() for i in range(tail, end))]))
    return out


def demux(media: bytes) -> Stream:
    grid, lost = _packets(media)
    s = Stream(packets=len(grid), damaged=lost)
    control, length = grid[:, 3], grid[:, 4]
    adapted, has = (control & 0x20) > 0, (control & 0x10) > 0
    # an error flag, scrambling, neither field, or an adaptation field longer than its packet
    bad = ((grid[:, 1] & 0x80) > 0) | ((control & 0xC0) > 0) | ~(adapted | has) | adapted & (length > np.where(has, 182, 183))
    s.damaged += int(bad.sum())
    grid, adapted, has = grid[~bad], adapted[~bad], has[~bad]
    flags = np.where(adapted & (grid[:, 4] > 0), grid[:, 5], 0)
    begin = np.where(has, np.where(adapted, 5 + grid[:, 4].astype(np.int32), 4), PACKET)
    pid = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]

    def sections(of: int, table: int) -> list[bytes]:
        found, broken = _sections(grid[pid == of], begin[pid == of])
        s.damaged += broken
        return [x for x in found if x[0] == table]

    for body in sections(0, 0):
        for j in range(8, len(body) - 7, 4):
            if program := int.from_bytes(body[j : j + 2], "big"):  # 0 is the network's own table
                s.programs[program] = int.from_bytes(body[j + 2 : j + 4], "big") & 0x1FFF
    for of in dict.fromkeys(s.programs.values()):
        for body in sections(of, 2):
            j = 12 + (int.from_bytes(body[10:12], "big") & 0xFFF)
            while j + 5 <= len(body) - 4:
                p = int.from_bytes(body[j + 1 : j + 3], "big") & 0x1FFF
                if p not in s.pids:
                    s.pids.append(p)
                j += 5 + (int.from_bytes(body[j + 3 : j + 5], "big") & 0xFFF)
    parts: list[bytes] = []
    for p in s.pids:
        mine = np.flatnonzero(pid == p)
        counters = (grid[mine, 3] & 15).astype(np.int16)
        # a packet may be sent twice in a row
        again = np.r_[False, (counters[1:] == counters[:-1]) & has[mine[1:]] & (grid[mine[1:]] == grid[mine[:-1]]).all(1)] if len(mine) else np.zeros(0, bool)
        mine, counters = mine[~again], counters[~again]
        own, start, flag = grid[mine], begin[mine], flags[mine]
        follows = ((counters[1:] - counters[:-1]) % 16 == has[mine[1:]]) | ((flag[1:] & 0x80) > 0)
        s.continuity_errors += int((~follows).sum())
        heads = np.flatnonzero((own[:, 1] & 0x40) > 0)
        for h, pes in zip(heads, _elementary(own, start, heads)):
            skip = 9 + pes[8] if len(pes) >= 9 else 9
            if len(pes) < skip or pes[:3] != b"\x00\x00\x01":
                s.damaged += 1
                continue
            size, timed = int.from_bytes(pes[4:6], "big"), pes[7] & 0x80
            # one that is shorter than it says has lost packets; what came of it stays
            s.damaged += bool(size and len(pes) < 6 + size) or bool(timed and pes[8] < 5)
            if timed and pes[8] >= 5:
                s.pts.append(_pts_value(pes[9:14]))
                if flag[h] & 0x40:
                    s.random_access.append(s.pts[-1])
            parts.append(pes[skip : 6 + size if size else None])
    s.payload = b"".join(parts)
    return s


def padded(data: bytes, multiple: int = 192) -> bytes:
    """data and spaces up to a positive multiple."""
    return data.ljust(max(1, -(-len(data) // multiple)) * multiple, b" ")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text as a transport stream (column `media` if keep_media), read back and described."""

    def start():
        def one(data: bytes) -> tuple:
            media = mux(padded(data))
            s = demux(media)
            feature = (
                f"packets={s.packets};pes={len(s.pts)};continuity_errors={s.continuity_errors};damaged={s.damaged};"
                f"programs={len(s.programs)};pts={s.pts[0] if s.pts else ''}-{s.pts[-1] if s.pts else ''};"
                f"random_access={','.join(map(str, s.random_access))}"
            )
            row = (
                len(data), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]),
                len(media), hashlib.sha256(media).hexdigest(), feature, s.pts, s.random_access,
            )
            return (*row, media) if keep_media else row

        return one

    i, t, many = pa.int64(), pa.string(), pa.list_(pa.int64())
    out = [("n_bytes", i), ("payload_bytes", i), ("payload_sha256", t), ("tail_crc32", i), ("media_bytes", i), ("media_sha256", t), ("feature", t), ("pts", many), ("random_access", many)]
    return per_text(docs, [id_col], out + [("media", pa.binary())] * keep_media, start, text)
