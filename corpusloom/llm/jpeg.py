"""Grey JPEG frames: a lossless coder, and a decoder for lossless and baseline frames.

The lossless coder writes process 14 (SOF3, predictor 1). Its Huffman table
gives a difference of s magnitude bits a code of 9 - s bits, so every sample
takes 9 bits and whole frames are coded and decoded without a loop over
samples. The codes fill 511 of 512 places, which leaves the all-ones code
free as the standard asks.
"""

from __future__ import annotations

import struct

import numpy as np

#: Zigzag order of an 8 x 8 block, built by walking its anti-diagonals.
ZIGZAG = [r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))]

#: The luminance tables that motion-JPEG frames may leave out (counts by code length, then symbols).
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = list(range(12))
AC_COUNTS = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]
AC_SYMBOLS = bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
    "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7"
    "c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)


def _lossless_codes() -> tuple[np.ndarray, np.ndarray]:
    """9-bit code of each difference -255..255, and the difference of each code."""
    of, back, code = np.zeros(511, np.uint16), np.zeros(512, np.int16), 0
    for length in range(1, 10):  # canonical codes: one symbol for each length, 8 first and 0 last
        s = 9 - length
        for v in ([0] if s == 0 else [*range(-(1 << s) + 1, -(1 << (s - 1)) + 1), *range(1 << (s - 1), 1 << s)]):
            extra = v if v >= 0 else v + (1 << s) - 1
            word = (code << s) | extra
            of[v + 255], back[word] = word, v
        code = (code + 1) << 1
    return of, back


_CODE, _VALUE = _lossless_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _lossless_head(width: int, height: int) -> bytes:
    table = bytes([0, *([1] * 9), *([0] * 7), *range(8, -1, -1)])
    return (
        b"\xff\xd8"
        + _segment(0xC3, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0))
        + _segment(0xC4, table)
        + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
    )


def encode_lossless(samples: np.ndarray) -> list[bytes]:
    """Frames of a (frames, height, width) array of bytes, width a multiple of 8, each as a lossless frame."""
    count, height, width = samples.shape
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    d += 255
    codes = np.ascontiguousarray(_CODE[d.reshape(-1, 8)].T)
    packed = np.zeros((9, codes.shape[1]), np.uint16)
    for i in range(8):  # the i-th code of 9 bits starts i bits into byte i
        packed[i] |= codes[i] >> (1 + i)
        packed[i + 1] |= codes[i] << (7 - i)
    head = _lossless_head(width, height)
    return [
        head + f.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
        for f in np.ascontiguousarray(packed.T.astype(np.uint8)).reshape(count, -1)
    ]


def _decode_lossless(scans: list[bytes], width: int, height: int) -> np.ndarray:
    need = width * height // 8 * 9
    if not need or width % 8:
        raise ValueError("a lossless frame's width must be a multiple of 8")
    raw = [s.replace(b"\xff\x00", b"\xff") for s in scans]
    if any(len(r) < need for r in raw):
        raise ValueError("the frame ends early")
    b = np.frombuffer(b"".join(r[:need] for r in raw), np.uint8).reshape(-1, 9).T.astype(np.uint16)
    codes = np.empty((8, b.shape[1]), np.uint16)
    for i in range(8):
        codes[i] = (b[i] << (1 + i)) | (b[i + 1] >> (7 - i))
    d = _VALUE[(codes & 511).T].reshape(len(scans), height, width).astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2, out=d).astype(np.uint8)


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            if self.at >= len(self.data):
                raise ValueError("the frame ends early")
            self.acc = (self.acc << 8) | self.data[self.at]
            self.at += 1
            self.n += 8
        self.n -= n
        out = self.acc >> self.n
        self.acc &= (1 << self.n) - 1
        return out

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = (code << 1) | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def signed(self, s: int) -> int:
        v = self.take(s) if s else 0
        return v if not s or v >> (s - 1) else v - (1 << s) + 1


def _table(counts: list[int], symbols) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


_STANDARD = _table(DC_COUNTS, DC_SYMBOLS), _table(AC_COUNTS, AC_SYMBOLS)
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def _decode_baseline(parts: list[bytes], comps, quant, dc, ac, width: int, height: int, restart: int) -> np.ndarray:
    """The luminance (first component) of a baseline scan; chrominance is read over."""
    hmax, vmax = max(c["h"] for c in comps), max(c["v"] for c in comps)
    if not all(1 <= c["h"] <= 4 and 1 <= c["v"] <= 4 for c in comps):
        raise ValueError("sampling factors must be 1 to 4")
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    if across * down * sum(c["h"] * c["v"] for c in comps) * 2 > 8 * sum(map(len, parts)):
        raise ValueError("the frame ends early")  # a block takes a bit for each of its two tables at least
    y = comps[0]
    plane = np.zeros((down * y["v"] * 8, across * y["h"] * 8))
    reader, part, last = _Bits(parts[0]), 0, [0] * len(comps)
    for mcu in range(across * down):
        if restart and mcu and mcu % restart == 0:
            part += 1
            reader, last = _Bits(parts[part]), [0] * len(comps)
        for k, c in enumerate(comps):
            for b in range(c["h"] * c["v"]):
                block = np.zeros(64)
                last[k] += reader.signed(reader.symbol(dc[c["dc"]]))
                block[0] = last[k]
                i = 1
                while i < 64:
                    run, s = divmod(reader.symbol(ac[c["ac"]]), 16)
                    if s == 0 and run != 15:
                        break
                    i += run
                    if s and i < 64:
                        block[ZIGZAG[i]] = reader.signed(s)
                    i += 1
                if k == 0:
                    r = (mcu // across * y["v"] + b // y["h"]) * 8
                    col = (mcu % across * y["h"] + b % y["h"]) * 8
                    table = np.zeros(64)
                    table[ZIGZAG] = quant[c["q"]]
                    plane[r : r + 8, col : col + 8] = _COS @ (block * table).reshape(8, 8) @ _COS.T
    return np.clip(np.round(plane[:height, :width] + 128), 0, 255).astype(np.uint8)


def decode(frame: bytes) -> np.ndarray:
    """The luminance samples of one intra frame, as a (height, width) array of bytes.

    Lossless frames must be of the form that :func:`encode_lossless` writes;
    baseline frames may have any sampling and restart interval, and use the
    standard tables where they bring none. Anything else, such as a frame
    that names tables it doesn't bring, raises ValueError.
    """
    try:
        return _decode(frame)
    except (KeyError, IndexError, TypeError, struct.error) as e:
        raise ValueError(f"a broken frame: {type(e).__name__} {e}") from e


def _decode(frame: bytes) -> np.ndarray:
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, comps, quant, kind, restart = 2, [], {}, None, 0
    dc, ac = {0: _STANDARD[0], 1: _STANDARD[0]}, {0: _STANDARD[1], 1: _STANDARD[1]}
    width = height = 0
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker in (0xC0, 0xC1, 0xC3):
            kind = marker
            height, width, n = struct.unpack_from(">HHB", body, 1)
            comps = [
                {"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(n)
            ]
        elif 0xC0 < marker < 0xD0 and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline and lossless frames are decoded")
        elif marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                size = 128 if wide else 64
                quant[k] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(float)
                body = body[1 + size :]
        elif marker == 0xC4 and kind != 0xC3:
            while body:
                counts = list(body[1:17])
                (dc if body[0] >> 4 == 0 else ac)[body[0] & 15] = _table(counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = frame[at : frame.rindex(b"\xff\xd9")]
            if kind is None or not comps or not width or not height:
                raise ValueError("a scan without samples")
            if kind == 0xC3:
                return _decode_lossless([scan], width, height)[0]
            for c, i in zip(comps, range(body[0]), strict=True):
                c["dc"], c["ac"] = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            parts, start = [], 0
            for i in range(len(scan) - 1):
                if scan[i] == 0xFF and 0xD0 <= scan[i + 1] <= 0xD7:
                    parts.append(scan[start:i])
                    start = i + 2
            parts = [p.replace(b"\xff\x00", b"\xff") for p in [*parts, scan[start:]]]
            return _decode_baseline(parts, comps, quant, dc, ac, width, height, restart)
    raise ValueError("a frame without a scan")


def decode_all(frames: list[bytes]) -> list[np.ndarray]:
    """:func:`decode` of each frame; lossless frames with one header are decoded together."""
    head = frames[0][: frames[0].find(b"\xff\xda") + 10] if frames else b""
    if head[2:4] == b"\xff\xc3" and head[20:] == _lossless_head(8, 8)[20:] and all(f.startswith(head) for f in frames):
        height, width = struct.unpack_from(">HH", head, 7)
        return list(_decode_lossless([f[len(head) : -2] for f in frames], width, height))
    return [decode(f) for f in frames]
