"""AVI motion-JPEG as columns: write, parse by the RIFF index, decode, and cut into shots."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import pieces
from corpusloom.llm import jpeg


@dataclass(frozen=True)
class MediaConfig:
    """Frames are ``width`` samples wide and at most ``rows`` high; shots by adaptive histogram differences.

    A shot starts where the difference of two frames' ``bins``-cell histograms
    (0 to 1) exceeds ``floor`` and the mean of the last ``window`` differences
    of its shot plus ``sigmas`` standard deviations.
    """

    width: int = 64
    rows: int = 32
    micros: int = 40_000
    bins: int = 16
    window: int = 12
    sigmas: float = 3.0
    floor: float = 0.08


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, micros: int, note: bytes = b"") -> bytes:
    """An AVI file of one MJPG stream with its idx1 index; ``note`` goes to the INFO list."""
    longest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", micros, 0, 0, 0x10, len(frames), 0, 1, longest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, micros, 1_000_000, 0, len(frames), longest, 0, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", note)) if note else b""
    movi, index, at = [], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    body = b"AVI " + head + info + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > end:
            raise ValueError(f"chunk {kind!r} runs past its parent")
        yield kind, at + 8, size
        at += 8 + size + size % 2


def parse_avi(data: bytes) -> dict:
    """Dimensions, frame time, note and the frames' (offset, size), from the index where there is one.

    Offsets of idx1 may count from the file's start or from the movi list; the
    chunk header that they point at tells which. Without an index the movi list
    is walked. Raises ValueError on a file that isn't a RIFF AVI, or whose
    headers or index are cut short or point outside it.
    """
    try:
        info = _parsed(data)
    except struct.error as e:
        raise ValueError(f"a broken AVI file: {e}") from e
    if any(at < 0 or at + n > len(data) for at, n in info["frames"]):
        raise ValueError("the index points outside the file")
    return info


def _parsed(data: bytes) -> dict:
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out = {"width": 0, "height": 0, "micros": 0, "note": b"", "frames": []}
    movi, index = None, []
    stack = list(_walk(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])))
    while stack:
        kind, at, size = stack.pop(0)
        if kind == b"LIST" and data[at : at + 4] == b"movi":
            movi = (at, size)
        elif kind == b"LIST":
            stack = [*_walk(data, at + 4, at + size), *stack]
        elif kind == b"avih":
            v = struct.unpack_from("<10I", data, at)
            out |= {"micros": v[0], "width": v[8], "height": v[9]}
        elif kind == b"ICMT":
            out["note"] = data[at : at + size]
        elif kind == b"idx1":
            index = [struct.unpack_from("<4sIII", data, at + i) for i in range(0, size - 15, 16)]
    if movi is None:
        raise ValueError("an AVI file without a movi list")
    video = [(o, n) for k, _, o, n in index if k[2:] in (b"dc", b"db")]
    if video:
        base = movi[0] if data[movi[0] + video[0][0] :][2:4] in (b"dc", b"db") else 0
        out["frames"] = [(base + o + 8, n) for o, n in video]
    else:
        out["frames"] = [(at, n) for k, at, n in _walk(data, movi[0] + 4, movi[0] + movi[1]) if k[2:] in (b"dc", b"db")]
    return out


def payload_to_avi(payload: bytes, cfg: MediaConfig = MediaConfig()) -> bytes:
    """Lossless frames that hold ``payload``, whose length is a positive multiple of ``cfg.width``.

    All frames have one height; what the last one has beyond the payload is 0,
    and the note in the INFO list keeps the payload's length.
    """
    rows = len(payload) // cfg.width
    height = min(rows, cfg.rows)
    count = -(-rows // height)
    x = np.zeros((count, height, cfg.width), np.uint8)
    x.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    return write_avi(jpeg.encode_lossless(x), cfg.width, height, cfg.micros, str(len(payload)).encode())


def decode_frames(data: bytes, info: dict) -> list[np.ndarray]:
    return jpeg.decode_all([data[at : at + n] for at, n in info["frames"]])


def avi_to_payload(data: bytes, info: dict, frames: list[np.ndarray]) -> bytes:
    return b"".join(f.tobytes() for f in frames)[: int(info["note"] or 0)]


def histogram_differences(frames: list[np.ndarray], bins: int) -> np.ndarray:
    """Half the L1 distance of the histograms of each two neighbours, 0 to 1."""
    h = np.stack([np.bincount(f.ravel() >> np.uint8(8 - (bins - 1).bit_length()), minlength=bins) / f.size for f in frames])
    return np.abs(np.diff(h, axis=0)).sum(1) / 2


def shot_starts(differences: np.ndarray, cfg: MediaConfig) -> list[int]:
    """The frames that start a shot, 0 first."""
    starts, recent = [0], []
    for i, d in enumerate(differences.tolist(), 1):
        near = recent[-cfg.window :]
        mean = sum(near) / len(near) if near else 0.0
        spread = (sum((v - mean) ** 2 for v in near) / len(near)) ** 0.5 if near else 0.0
        if d > cfg.floor and d > mean + cfg.sigmas * spread and (near or d > 4 * cfg.floor):
            starts.append(i)
            recent = []
        else:
            recent.append(d)
    return starts


def clips(data: bytes, cfg: MediaConfig = MediaConfig()) -> list[tuple]:
    """(clip, first_frame, frames, start_s, end_s, mean_luma) of each shot of an AVI file."""
    info = parse_avi(data)
    frames = decode_frames(data, info)
    return _clips(info, frames, cfg)


def _clips(info: dict, frames: list[np.ndarray], cfg: MediaConfig) -> list[tuple]:
    if not frames:
        return []
    starts = shot_starts(histogram_differences(frames, cfg.bins), cfg)
    sec = info["micros"] / 1e6
    return [
        (k, a, b - a, a * sec, b * sec, float(np.mean([f.mean() for f in frames[a:b]])))
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(frames)], strict=True))
    ]


def clip_rows(files: DataFrame, cfg: MediaConfig = MediaConfig(), id_col: str = "id", data_col: str = "content") -> DataFrame:
    """One row per shot of each AVI file of ``files`` (id, content), timed in seconds.

    A null or broken file gives no clip rows but one with a null clip and the
    reason in ``error``; a file without frames gives none. Repeated rows give
    repeated clips. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += [(k, *c, None) for c in clips(data or b"", cfg)]
                except ValueError as e:
                    out.append((k, *[None] * 6, str(e)))
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
            names = ["id", "clip", "first_frame", "frames", "start_s", "end_s", "mean_luma", "error"]
            columns = zip(*out, strict=True) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    rows = files.select(F.col(id_col).alias("id"), F.col(data_col).cast("binary").alias("content"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, clip int, first_frame int, frames int, start_s double, end_s double, mean_luma double, error string"
    )


def _stored(text: bytes, cfg: MediaConfig) -> tuple:
    n = len(text)
    payload = text + b"\0" * (max(cfg.width, -(-n // cfg.width) * cfg.width) - n)
    data = payload_to_avi(payload, cfg)
    info = parse_avi(data)
    frames = decode_frames(data, info)
    back = avi_to_payload(data, info, frames)
    shots = _clips(info, frames, cfg)
    feature = f"frames={len(frames)};seconds={len(frames) * info['micros'] / 1e6:.2f};" + ",".join(
        f"{a}+{k}:{luma:.3f}" for _, a, k, _, _, luma in shots
    )
    return (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature)


def store_texts(docs: DataFrame, cfg: MediaConfig = MediaConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a lossless AVI file, read back: sizes, digests and its shots.

    A null or empty text becomes one row of zeros. Equal texts give equal
    files, and repeated rows equal rows. An Arrow batch of texts is held, and
    the file of one; other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in pieces(batches, 1):
            got = [_stored(t or b"", cfg) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = zip(*got, strict=True) if got else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", *names]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
