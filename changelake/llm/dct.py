"""Baseline DCT JPEG frames, as motion-JPEG files hold them.

Huffman-coded sequential frames of 8 bits (SOF0, SOF1), of one component or three,
with any sampling factors, restart intervals and scans.  Where a frame has no
Huffman tables of its own, as is usual in motion-JPEG, the standard's apply.
"""

from __future__ import annotations

import struct

import numpy as np

#: Place of each coefficient in a block, in the order of the data: along the diagonals, up and down in turn.
ZIGZAG = np.array([8 * r + c for d in range(15) for r, c in sorted(((r, d - r) for r in range(8) if 0 <= d - r < 8), key=lambda x: x[0] if d % 2 else -x[0])])
# The cosine transform's matrix.
COSINES = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])


def _standard(head: str) -> bytes:
    """All symbols of a standard AC table: the given first ones, and the rest in ascending order."""
    first = bytes.fromhex(head)
    every = [0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]
    return first + bytes(sorted(set(every) - set(first)))


# The standard's Huffman tables, as counts of codes by length and symbols; by class (DC 0, AC 1) and number.
STANDARD = {
    (0, 0): (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))),
    (0, 1): (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))),
    (1, 0): (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), _standard("01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a")),
    (1, 1): (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]), _standard("00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1")),
}


def codes(lengths: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Symbol to (code, bits)."""
    out, code, k = {}, 0, 0
    for size, count in enumerate(lengths, 1):
        for _ in range(count):
            out[symbols[k]] = code, size
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _lookup(lengths: bytes, symbols: bytes) -> list[int]:
    """By the next 16 bits: symbol and bits of its code, as symbol << 8 | bits; 0 where no code fits."""
    out = [0] * (1 << 16)
    for symbol, (code, size) in codes(lengths, symbols).items():
        low = code << (16 - size)
        if low >= 1 << 16:
            raise ValueError("broken Huffman table")
        out[low : low + (1 << (16 - size))] = [symbol << 8 | size] * (1 << (16 - size))
    return out


class _Bits:
    """The entropy-coded bits between two markers."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.bits = data, 0, 0, 0

    def _fill(self) -> None:
        part = self.data[self.at : self.at + 8]
        if self.bits < -64:
            raise ValueError("JPEG data end early")
        # Behind the end come ones, as padding has them.
        self.held = (self.held << 64) | int.from_bytes(part + b"\xff" * (8 - len(part)))
        self.at += 8
        self.bits += 64
        if self.at > len(self.data) + 64:
            raise ValueError("JPEG data end early")

    def symbol(self, table: list[int]) -> int:
        if self.bits < 32:
            self._fill()
        found = table[(self.held >> (self.bits - 16)) & 0xFFFF]
        if not found:
            raise ValueError("no such Huffman code")
        self.bits -= found & 0xFF
        self.held &= (1 << self.bits) - 1
        return found >> 8

    def value(self, size: int) -> int:
        """A number of ``size`` bits in the code's signed form."""
        if not size:
            return 0
        if self.bits < size:
            self._fill()
        self.bits -= size
        v = self.held >> self.bits
        self.held &= (1 << self.bits) - 1
        return v if v >> (size - 1) else v - (1 << size) + 1


def _block(bits: _Bits, out: np.ndarray, before: int, dc: list[int], ac: list[int]) -> int:
    """Read a block's coefficients in the order of the data; returns its first one."""
    out[0] = before = before + bits.value(bits.symbol(dc))
    k = 1
    while k < 64:
        s = bits.symbol(ac)
        run, size = s >> 4, s & 15
        if not size:
            if run < 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("too many coefficients")
        out[k] = bits.value(size)
        k += 1
    return before


def _segments(jpeg: bytes, at: int) -> tuple[list[bytes], int]:
    """The coded data from ``at`` on, parted at restart markers and without stuffing; and where the next marker is."""
    parts, begin = [], at
    while True:
        at = jpeg.find(b"\xff", at)
        if at < 0 or at + 1 >= len(jpeg):
            at = len(jpeg)
            break
        mark = jpeg[at + 1]
        if mark == 0 or mark == 0xFF:
            at += 2 if mark == 0 else 1
        elif 0xD0 <= mark <= 0xD7:
            parts.append(jpeg[begin:at])
            begin = at = at + 2
        else:
            break
    parts.append(jpeg[begin:at])
    return [p.replace(b"\xff\x00", b"\xff") for p in parts], at


def _planes(coefficients: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """Samples of a component's blocks, which lie in rows and columns."""
    high, wide, _ = coefficients.shape
    square = np.zeros((high * wide, 64))
    square[:, ZIGZAG] = coefficients.reshape(-1, 64) * quantiser
    samples = COSINES.T @ square.reshape(-1, 8, 8) @ COSINES + 128
    return np.clip(np.rint(samples), 0, 255).astype(np.uint8).reshape(high, wide, 8, 8).swapaxes(1, 2).reshape(8 * high, 8 * wide)


def decode(jpeg: bytes) -> np.ndarray:
    """Samples (height, width) of a grey frame, (height, width, 3) in red, green and blue of one in colour."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    tables = {k: _lookup(*v) for k, v in STANDARD.items()}
    quantisers: dict[int, np.ndarray] = {}
    parts: dict[int, list] = {}  # by component: sampling across and down, quantiser, coefficients
    high = wide = restart = scanned = 0
    at = 2
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF or jpeg[at + 1] == 0xFF:
            at += 1
            continue
        mark = jpeg[at + 1]
        if mark == 0xD9:
            break
        size = int.from_bytes(jpeg[at + 2 : at + 4])
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xDB:
            while body:
                kind, n = ">u2" if body[0] >> 4 else "u1", 128 if body[0] >> 4 else 64
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + n], kind).astype(np.float64)
                body = body[1 + n :]
        elif mark == 0xDD:
            restart = int.from_bytes(body[:2])
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            if mark > 0xC1:
                raise ValueError(f"JPEG process SOF{mark - 0xC0} is not read")
            precision, high, wide, n = struct.unpack(">BHHB", body[:6])
            if precision != 8 or n not in (1, 3) or not high or not wide:
                raise ValueError("only 8-bit frames of one component or three are read")
            given = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
            if any(not 1 <= x <= 4 for _, h, v, _ in given for x in (h, v)):
                raise ValueError("sampling factors are from 1 to 4")
            given = given if n == 3 else [(given[0][0], 1, 1, given[0][3])]
            across, down = max(g[1] for g in given), max(g[2] for g in given)
            columns, rows = -(-wide // (8 * across)), -(-high // (8 * down))
            if sum(g[1] * g[2] for g in given) * columns * rows > 4 * len(jpeg):  # a block takes two bits at least
                raise ValueError("JPEG data end early")
            for name, h, v, q in given:
                parts[name] = [h, v, q, np.zeros((rows * v, columns * h, 64), np.int32)]
        elif mark == 0xDA:
            chosen = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            segments, at = _segments(jpeg, at)
            if len(chosen) == 1:  # a scan of one component: its own blocks only, row by row
                h, v, _, _ = parts[chosen[0][0]]
                m = -(-(-(-wide * h // across)) // 8), -(-(-(-high * v // down)) // 8)
                order = [[(chosen[0], y, x)] for y in range(m[1]) for x in range(m[0])]
            else:
                order = [[(c, y * parts[c[0]][1] + j, x * parts[c[0]][0] + i) for c in chosen for j in range(parts[c[0]][1]) for i in range(parts[c[0]][0])] for y in range(rows) for x in range(columns)]
            step = restart or len(order)
            for k, first in enumerate(range(0, len(order), step)):
                bits, before = _Bits(segments[k]), dict.fromkeys((c[0] for c in chosen), 0)
                for unit in order[first : first + step]:
                    for (name, dc, ac), y, x in unit:
                        before[name] = _block(bits, parts[name][3][y, x], before[name], tables[0, dc], tables[1, ac])
            scanned += 1
    if not scanned:
        raise ValueError("no image data")
    planes = [np.repeat(np.repeat(_planes(c, quantisers[q]), down // v, axis=0), across // h, axis=1)[:high, :wide] for h, v, q, c in parts.values()]
    if len(planes) == 1:
        return planes[0]
    y, cb, cr = (p.astype(np.float64) for p in planes)
    cb, cr = cb - 128, cr - 128
    return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)), 0, 255).astype(np.uint8)


def luminance(frame: np.ndarray) -> np.ndarray:
    """A frame in grey."""
    return frame if frame.ndim == 2 else np.rint(frame @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
