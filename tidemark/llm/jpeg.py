"""Baseline JPEG in numpy: a flat-block encoder and a decoder of DC-only luminance thumbnails.

The decoder reads any baseline, Huffman-coded file of 8-bit samples: it parses the markers, splits the
scan at its restart markers and decodes all restart segments of many files in step, one table look-up
for each block and segment. Only the DC term of a block is kept, so the result is the picture at an
eighth of its size; AC terms are decoded to be skipped.

The encoder writes one block of 8 by 8 equal pixels for each sample. A DC quantiser of 8 makes such a
block's only coefficient the sample less 128, so the DC-only thumbnail returns every sample unchanged.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

#: Samples in a row of blocks, which is also the restart interval; rows in one picture, whose height has 16 bits.
ROW, MAX_ROWS = 64, 8191

# Code counts by length of the usual luminance DC table; its symbols are 0 to 11.
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]

SOI, EOI = b"\xff\xd8", b"\xff\xd9"
_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _codes(counts: list[int]) -> list[tuple[int, int]]:
    """(code, length) of each symbol in the order of the table."""
    out, code = [], 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length))
            code += 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    """All that precedes the entropy-coded rows of a picture of `rows` rows of blocks."""
    return (
        SOI
        + _segment(0xDB, bytes([0, 8] + [1] * 63))
        + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, bytes([0x00, *DC_COUNTS, *range(12)]))
        + _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0]))  # one AC symbol, end of block, of one bit
        + _segment(0xDD, struct.pack(">H", ROW))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and length for each DC difference from -255 to 255, end of block included."""
    dc = _codes(DC_COUNTS)
    code, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        bits = d if d >= 0 else d + (1 << size) - 1
        code[d + 255] = (dc[size][0] << size | bits) << 1
        length[d + 255] = dc[size][1] + size + 1
    return code, length


_CODE, _LENGTH = _difference_codes()


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of 64 bytes, as one JPEG or, beyond the largest height, several in a row."""
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    n = len(rows)
    steps = np.diff(rows.astype(np.int16), axis=1, prepend=np.int16(128)) + 255
    code, length = np.zeros((n, ROW + 1), np.int64), np.zeros((n, ROW + 1), np.int64)
    code[:, :ROW], length[:, :ROW] = _CODE[steps], _LENGTH[steps]
    pad = -length.sum(axis=1) % 8
    code[:, ROW], length[:, ROW] = (1 << pad) - 1, pad
    ends = length.ravel().cumsum()
    at = ends - length.ravel()
    size = np.diff(ends[ROW :: ROW + 1], prepend=0) // 8
    window = (code.ravel() << (32 - length.ravel())) << (32 - (at & 31))  # 64 bits that start at the word
    word, total = at >> 5, int(ends[-1] + 31 >> 5) + 1
    packed = np.bincount(word, (window >> 32 & 0xFFFFFFFF).astype(np.float64), total)
    packed += np.bincount(word + 1, (window & 0xFFFFFFFF).astype(np.float64), total + 1)[:total]
    plain = packed.astype(">u4").view(np.uint8)[: int(ends[-1]) // 8]

    row = np.repeat(np.arange(n), size)
    stuffed = plain == 0xFF
    place = np.arange(len(plain)) + np.concatenate(([0], np.cumsum(stuffed)[:-1])) + 2 * row
    out = np.zeros(len(plain) + int(stuffed.sum()) + 2 * n, np.uint8)
    out[place] = plain
    stop = np.concatenate(([0], place[np.cumsum(size) - 1] + stuffed[np.cumsum(size) - 1] + 3))  # after each row's marker

    made, first = [], 0
    for p in payloads:
        whole, last = [], first + len(p) // ROW
        while first < last:
            end = min(last, first + MAX_ROWS)
            marks = stop[first + 1 : end + 1]
            out[marks - 2] = 0xFF
            out[marks - 1] = 0xD0 + np.arange(end - first) % 8
            out[marks[-1] - 1] = EOI[1]
            whole += [_header(end - first), out[stop[first] : stop[end]].tobytes()]
            first = end
        made.append(b"".join(whole))
    return made


@dataclass
class Picture:
    """What the markers of one file say, and its scan."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser table
    quantiser: dict[int, int] = field(default_factory=dict)  # DC step by table
    huffman: dict[int, bytes] = field(default_factory=dict)  # counts and symbols by class and table
    interval: int = 0
    scan: list[tuple[int, int]] = field(default_factory=list)  # part, DC and AC tables as a byte
    data: bytes = b""

    def key(self) -> tuple:
        """Pictures with equal keys can be decoded in step."""
        return (tuple(self.parts), tuple(sorted(self.huffman.items())), tuple(self.scan), self.interval or self.mcus())

    def sampling(self) -> tuple[int, int]:
        return max(h for _, h, _, _ in self.parts), max(v for _, _, v, _ in self.parts)

    def grid(self) -> tuple[int, int]:
        """MCUs across and down."""
        if len(self.parts) == 1:
            return -(-self.width // 8), -(-self.height // 8)
        h, v = self.sampling()
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def mcus(self) -> int:
        x, y = self.grid()
        return x * y

    def blocks(self) -> list[tuple[int, int, int]]:
        """(part, DC and AC tables, blocks in an MCU) in the order of the scan."""
        out = []
        for part, tables in self.scan:
            i = next(i for i, p in enumerate(self.parts) if p[0] == part)
            out.append((i, tables, 1 if len(self.parts) == 1 else self.parts[i][1] * self.parts[i][2]))
        return out


def parse(data: bytes, at: int = 0) -> tuple[Picture, int]:
    """The picture that starts at `at`, and where it ends. ValueError: not a baseline JPEG."""
    if data[at : at + 2] != SOI:
        raise ValueError("no start of image")
    at, pic = at + 2, Picture()
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        end = at + 2 + struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : end], end
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                pic.quantiser[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                pic.huffman[body[0]] = bytes(body[1:n])
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            depth, pic.height, pic.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("samples of 8 bits are asked for")
            pic.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDD:
            pic.interval = struct.unpack_from(">H", body)[0]
        elif marker == 0xDA:
            pic.scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            stop = _SCAN_END.search(data, at)
            if not stop or not pic.parts or len(pic.scan) != len(pic.parts):
                raise ValueError("the scan is cut short or split")
            pic.data, at = data[at : stop.start()], stop.start()
            if data[at : at + 2] != EOI:
                raise ValueError("one scan is asked for")
            return pic, at + 2
        elif marker == 0xD9:
            raise ValueError("no scan")


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each 16-bit window; length 0 where no code fits."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for (code, n), s in zip(_codes(list(table[:16])), table[16:], strict=True):
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbol, length


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value that `size` bits stand for."""
    return np.where((size > 0) & (bits >> np.maximum(size - 1, 0) == 0), bits - (1 << size) + 1, bits)


class _Bits:
    """Segments side by side, each with its own bit position."""

    def __init__(self, segments: list[bytes]):
        flat = np.frombuffer(b"".join(segments) + b"\xff\xff\xff", np.uint8).astype(np.int32)
        self.window = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
        self.at = np.concatenate(([0], np.cumsum([len(s) for s in segments])[:-1])).astype(np.int64) * 8
        self.last = (len(self.window) - 1) * 8

    def peek(self, at: np.ndarray) -> np.ndarray:
        at = np.minimum(at, self.last)
        return self.window[at >> 3] >> (8 - (at & 7)) & 0xFFFF


def _joint(dc: tuple, ac: tuple) -> np.ndarray:
    """For each 16-bit window that holds a DC term and an end of block: the difference times 32 plus the bits used; else 0."""
    x = np.arange(1 << 16)
    size, n = dc
    total = n + size
    ok = (n > 0) & (total <= 16)
    diff = _extend((x << np.minimum(n, 16) & 0xFFFF) >> (16 - np.minimum(size, 16)), np.minimum(size, 16))
    symbol, m = ac[0][x << np.minimum(total, 16) & 0xFFFF], ac[1][x << np.minimum(total, 16) & 0xFFFF]
    ok &= (symbol == 0) & (m > 0) & (total + m <= 16)
    return np.where(ok, diff * 32 + total + m, 0)


def _block(bits: _Bits, who: np.ndarray, dc: tuple, ac: tuple) -> np.ndarray:
    """DC differences of the segments `who`, whose positions move past the block."""
    at = bits.at[who]
    x = bits.peek(at)
    size, n = dc[0][x], dc[1][x]
    if (n == 0).any():
        raise ValueError("a code is not in the table")
    at = at + n
    diff = _extend(bits.peek(at) >> (16 - size), size)
    at = at + size
    left, active = np.full(len(who), 63), np.arange(len(who))
    while len(active):
        x = bits.peek(at[active])
        symbol, n = ac[0][x], ac[1][x]
        if (n == 0).any():
            raise ValueError("a code is not in the table")
        at[active] += n + (symbol & 15)
        left[active] = np.where(symbol == 0, 0, left[active] - (symbol >> 4) - 1)
        active = active[left[active] > 0]
    bits.at[who] = at
    return diff


def _decode_group(pictures: list[Picture]) -> list[np.ndarray]:
    """DC-only luminance thumbnails of pictures with one key."""
    one = pictures[0]
    tables = {k: _lookup(v) for k, v in one.huffman.items()}
    segments, counts, per = [], [], one.interval or one.mcus()
    for p in pictures:
        own = _RESTART.split(p.data) if p.interval else [p.data]
        segments += own
        counts.append(len(own))
        if len(own) != -(-p.mcus() // per):
            raise ValueError("restart segments are missing")
    bits = _Bits([s.replace(b"\xff\x00", b"\xff") for s in segments])
    due = np.concatenate([[min(per, p.mcus() - per * i) for i in range(n)] for p, n in zip(pictures, counts, strict=True)])
    plan = [(i, tables[t >> 4], tables[0x10 | t & 15], n) for i, t, n in one.blocks()]
    plan = [(i, dc, ac, _joint(dc, ac), n) for i, dc, ac, n in plan]
    luma = [n for i, *_, n in plan if i == 0][0]
    found = np.zeros((per, luma, len(segments)), np.int32)
    before = np.zeros((len(one.parts), len(segments)), np.int64)
    everyone = np.arange(len(segments))
    for m in range(per):
        who = everyone if due.min() > m else np.flatnonzero(due > m)
        for i, dc, ac, joint, n in plan:
            for k in range(n):
                got = joint[bits.peek(bits.at[who])]
                step, used = got >> 5, got & 31
                bits.at[who] += used
                if not used.all():
                    odd = np.flatnonzero(used == 0)
                    step[odd] = _block(bits, who[odd], dc, ac)
                before[i, who] += step
                if i == 0:
                    found[m, k, who] = before[0, who]
    out, first = [], 0
    for p, n in zip(pictures, counts, strict=True):
        across, down = p.grid()
        h, v = (1, 1) if len(p.parts) == 1 else p.parts[0][1:3]
        cells = found[:, :, first : first + n].transpose(2, 0, 1).reshape(-1, v, h)[: across * down]
        image = cells.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        level = np.clip(np.round(image * (p.quantiser[p.parts[0][3]] / 8)) + 128, 0, 255).astype(np.uint8)
        hmax, vmax = p.sampling() if len(p.parts) > 1 else (1, 1)
        out.append(level[: -(-p.height * v // (8 * vmax)), : -(-p.width * h // (8 * hmax))])
        first += n
    return out


def thumbnails(files: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each file the pictures in it, as width, height and DC-only luminance thumbnail."""
    pictures: list[tuple[int, Picture]] = []
    for i, data in enumerate(files):
        at = 0
        while at < len(data):
            pic, at = parse(data, at)
            pictures.append((i, pic))
    groups: dict[tuple, list[int]] = {}
    for k, (_, pic) in enumerate(pictures):
        groups.setdefault(pic.key(), []).append(k)
    levels: dict[int, np.ndarray] = {}
    for members in groups.values():
        levels.update(zip(members, _decode_group([pictures[k][1] for k in members]), strict=True))
    out: list[list] = [[] for _ in files]
    for k, (i, pic) in enumerate(pictures):
        out[i].append((pic.width, pic.height, levels[k]))
    return out
