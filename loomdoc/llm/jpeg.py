"""JPEG frames: the sequential (baseline) process and the lossless one, for 8-bit samples.

A frame is read from its own markers: geometry, components and their sampling, quantisation
and Huffman tables, restart intervals, one or several scans.  Frames of motion JPEG may
leave out their Huffman tables and then use the standard ones.  Progressive and arithmetic-coded frames
are refused (ValueError), like damaged ones.

Frames whose Huffman codes and extra bits have the same length for every difference are decoded by numpy,
many at a time; all others bit by bit.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

_PAIRS = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]


def _with_rest(start: str) -> bytes:
    """The listed values, then the other pairs of run and size in ascending order."""
    first = bytes.fromhex(start)
    return first + bytes(sorted(set(_PAIRS) - set(first)))


# The standard Huffman tables, as counts of codes of 1 to 16 bits and their values: (class, number) -> table.
STANDARD = {
    (0, 0): (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))),
    (0, 1): (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))),
    (1, 0): (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), _with_rest("01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82")),
    (1, 1): (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]), _with_rest("00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1")),
}

#: Places of the coefficients in zigzag order: along the anti-diagonals, turning at each end.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


@dataclass
class Component:
    across: int
    down: int
    quantiser: int


@dataclass
class Scan:
    components: list[tuple[int, int, int]]  # component, DC table, AC table
    predictor: int
    shift: int
    tables: dict
    restart: int
    begin: int
    end: int


@dataclass
class Header:
    """What the markers of a frame say; `constant` is the code length of the fast way, 0 without."""

    process: int = -1
    height: int = 0
    width: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    constant: int = 0
    back: np.ndarray | None = None


def parse(data: bytes) -> Header:
    """Reads the markers of a frame."""
    out, tables, restart, at = Header(), dict(STANDARD), 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    try:
        while True:
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                break
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            if len(body) != size - 2:
                raise ValueError("a marker segment is cut off")
            at += 2 + size
            if marker == 0xC4:
                while body:
                    counts, n = body[1:17], sum(body[1:17])
                    tables[body[0] >> 4, body[0] & 15] = (counts, body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    out.quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.float64)
                    body = body[65 + 64 * wide :]
            elif marker in (0xC0, 0xC1, 0xC3):
                precision, out.height, out.width, n = struct.unpack_from(">BHHB", body)
                if precision != 8 or not out.height or not out.width:
                    raise ValueError("not a frame of 8-bit samples")
                out.process = marker
                for name, sampling, quantiser in struct.iter_unpack("3B", body[6 : 6 + 3 * n]):
                    out.components[name] = Component(sampling >> 4, sampling & 15, quantiser)
            elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("not a sequential or lossless frame with Huffman codes")
            elif marker == 0xDD:
                (restart,) = struct.unpack(">H", body)
            elif marker == 0xDA:
                n = body[0]
                own = [(name, t >> 4, t & 15) for name, t in struct.iter_unpack("2B", body[1 : 1 + 2 * n])]
                end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
                if end is None or not out.components or any(name not in out.components for name, _, _ in own):
                    raise ValueError("the frame has no end" if end is None else "a scan of unknown components")
                out.scans.append(Scan(own, body[1 + 2 * n], body[3 + 2 * n] & 15, dict(tables), restart, at, end.start()))
                at = end.start()
    except (IndexError, struct.error) as error:
        raise ValueError("the frame is cut off") from error
    if not out.scans:
        raise ValueError("the frame has no scan")
    if out.process == 0xC3 and len(out.scans) == 1 and len(out.components) == 1 and out.scans[0].predictor == 1 and not out.scans[0].restart and not out.scans[0].shift and out.height * out.width % 8 == 0:
        _constant(out)
    return out


def _codes(table: tuple[bytes, bytes]) -> list[tuple[int, int, int]]:
    """(bits, code, value) of a canonical table."""
    out, code, k = [], 0, 0
    for bits, count in enumerate(table[0], 1):
        for _ in range(count):
            if k >= len(table[1]):
                raise ValueError("a Huffman table is cut off")
            out.append((bits, code, table[1][k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _constant(header: Header) -> None:
    """Notes the one length of all codes with their extra bits, if there is one, and the difference of each."""
    codes = _codes(header.scans[0].tables[0, header.scans[0].components[0][1]])
    lengths = {bits + value for bits, _, value in codes}
    if len(lengths) == 1 and (length := lengths.pop()) == 9:
        header.constant, header.back = length, np.zeros(1 << length, dtype=np.int16)
        for _, code, value in codes:
            extra = np.arange(1 << value)
            header.back[(code << value) + extra] = np.where(extra >= (1 << value) >> 1, extra, extra - (1 << value) + 1) if value else 0


def decode_many(header: Header, coded: list[bytes]) -> np.ndarray:
    """Samples (frames, height, width) of frames with one header and codes of constant length; coded are their scans without stuffing."""
    size = header.height * header.width
    if any(len(x) != size * 9 // 8 for x in coded):
        raise ValueError("the frame has a wrong length")
    b = np.frombuffer(b"".join(coded), dtype=np.uint8).reshape(len(coded), size // 8, 9).astype(np.uint16)
    c = np.empty((*b.shape[:2], 8), dtype=np.uint16)
    for k in range(8):
        c[:, :, k] = ((b[:, :, k] << (k + 1)) | (b[:, :, k + 1] >> (7 - k))) & 511
    diff = header.back[c].reshape(-1, header.height, header.width)
    diff[:, 0, 0] += 128
    diff[:, :, 0] = np.cumsum(diff[:, :, 0], axis=1, dtype=np.int16)
    return np.cumsum(diff, axis=2, dtype=np.int16).astype(np.uint8)


class _Bits:
    """Bits of an entropy-coded segment, from the most significant one."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def _fill(self, n: int) -> None:
        while self.n < n:
            # Beyond the end there are ones, as encoders pad.
            byte = self.data[self.at] if self.at < len(self.data) else 0xFF
            if self.at > len(self.data) + 8:
                raise ValueError("the scan is cut off")
            self.held, self.n, self.at = (self.held << 8 | byte) & 0xFFFFFFFFFF, self.n + 8, self.at + 1

    def take(self, n: int) -> int:
        self._fill(n)
        self.n -= n
        return self.held >> self.n & ((1 << n) - 1)

    def symbol(self, table: list[int]) -> int:
        self._fill(16)
        found = table[self.held >> (self.n - 16) & 0xFFFF]
        if found < 0:
            raise ValueError("a code that no table has")
        self.n -= found >> 8
        return found & 255

    def difference(self, bits: int) -> int:
        """A value of so many bits; those that start with 0 are negative."""
        if not bits:
            return 0
        value = self.take(bits)
        return value if value >> (bits - 1) else value - (1 << bits) + 1


def _lookup(table: tuple[bytes, bytes]) -> list[int]:
    """For each 16 bits the length of the code that they start with, times 256, and its value; -1 for none."""
    out = np.full(1 << 16, -1, dtype=np.int32)
    for bits, code, value in _codes(table):
        if code >> bits:
            raise ValueError("a Huffman table with too many codes")
        out[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | value
    return out.tolist()


def decode(data: bytes, header: Header | None = None) -> np.ndarray:
    """Samples (height, width, components) of a frame; components of lower resolution are repeated."""
    header = header or parse(data)
    most_across, most_down = max(c.across for c in header.components.values()), max(c.down for c in header.components.values())
    read = _lossless if header.process == 0xC3 else _sequential
    planes = read(data, header, most_across, most_down)
    out = []
    for name, c in header.components.items():
        rows = np.arange(header.height) * c.down // most_down
        columns = np.arange(header.width) * c.across // most_across
        out.append(planes[name][rows[:, None], columns[None, :]])
    return np.stack(out, axis=2)


def _segments(data: bytes, scan: Scan) -> list[_Bits]:
    return [_Bits(x.replace(b"\xff\x00", b"\xff")) for x in re.split(rb"\xff+[\xd0-\xd7]", data[scan.begin : scan.end])]


def _sequential(data: bytes, header: Header, most_across: int, most_down: int) -> dict[int, np.ndarray]:
    mcus_across, mcus_down = -(-header.width // (8 * most_across)), -(-header.height // (8 * most_down))
    blocks = {name: np.zeros((mcus_down * c.down, mcus_across * c.across, 64)) for name, c in header.components.items()}
    for scan in header.scans:
        tables = {(k, n): _lookup(scan.tables[k, n]) for _, dc, ac in scan.components for k, n in ((0, dc), (1, ac)) if (k, n) in scan.tables}
        if len(scan.components) == 1:
            # One component alone goes block by block over its own size.
            [(name, dc, ac)] = scan.components
            c = header.components[name]
            across, down = -(-(-(-header.width * c.across // most_across)) // 8), -(-(-(-header.height * c.down // most_down)) // 8)
            units = [[(name, dc, ac, y, x)] for y in range(down) for x in range(across)]
        else:
            units = [
                [(name, dc, ac, my * c.down + y, mx * c.across + x) for name, dc, ac in scan.components for c in [header.components[name]] for y in range(c.down) for x in range(c.across)]
                for my in range(mcus_down) for mx in range(mcus_across)
            ]
        segments, before = _segments(data, scan), {}
        for i, unit in enumerate(units):
            part = i // scan.restart if scan.restart else 0
            if part >= len(segments):
                raise ValueError("a restart interval is missing")
            if scan.restart and i % scan.restart == 0:
                before = {}
            bits = segments[part]
            for name, dc, ac, y, x in unit:
                block, k = blocks[name][y, x], 1
                before[name] = before.get(name, 0) + bits.difference(bits.symbol(tables[0, dc]))
                block[0] = before[name]
                while k < 64:
                    symbol = bits.symbol(tables[1, ac])
                    if symbol == 0:
                        break
                    k += symbol >> 4
                    if symbol == 0xF0:
                        k += 1
                        continue
                    if k > 63:
                        raise ValueError("a block with too many coefficients")
                    block[k] = bits.difference(symbol & 15)
                    k += 1
    planes = {}
    for name, c in header.components.items():
        if c.quantiser not in header.quantisers:
            raise ValueError("a quantisation table is missing")
        natural = np.zeros_like(blocks[name])
        natural[:, :, ZIGZAG] = blocks[name] * header.quantisers[c.quantiser]
        square = natural.reshape(*natural.shape[:2], 8, 8)
        samples = np.einsum("ux,abuv,vw->abxw", _COSINES, square, _COSINES) + 128
        planes[name] = np.clip(np.rint(samples), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(natural.shape[0] * 8, natural.shape[1] * 8)
    return planes


def _lossless(data: bytes, header: Header, most_across: int, most_down: int) -> dict[int, np.ndarray]:
    if any((c.across, c.down) != (1, 1) for c in header.components.values()):
        raise ValueError("a lossless frame with components of several resolutions")
    planes = {name: np.zeros((header.height, header.width), dtype=np.int64) for name in header.components}
    for scan in header.scans:
        tables = {dc: _lookup(scan.tables[0, dc]) for _, dc, _ in scan.components}
        if not 1 <= scan.predictor <= 7:
            raise ValueError("an unknown predictor")
        segments, first_row = _segments(data, scan), 0
        for i in range(header.height * header.width):
            y, x = divmod(i, header.width)
            part = i // scan.restart if scan.restart else 0
            if part >= len(segments):
                raise ValueError("a restart interval is missing")
            if scan.restart and i % scan.restart == 0:
                first_row = y
            bits = segments[part]
            for name, dc, _ in scan.components:
                p = planes[name]
                if x == 0:
                    guess = 1 << (7 - scan.shift) if y == first_row else p[y - 1, 0]
                elif y == first_row:
                    guess = p[y, x - 1]
                else:
                    a, b, c = int(p[y, x - 1]), int(p[y - 1, x]), int(p[y - 1, x - 1])
                    guess = (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[scan.predictor - 1]
                size = bits.symbol(tables[dc])
                p[y, x] = (guess + (32768 if size == 16 else bits.difference(size))) & 0xFFFF
    return {name: (p << header.scans[0].shift & 255).astype(np.uint8) for name, p in planes.items()}
