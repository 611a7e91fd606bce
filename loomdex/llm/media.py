"""AVI motion-JPEG media columns.

Each text becomes a RIFF AVI whose frames are 24 x 24 grey lossless JPEG images
(ITU T.81 process 14, SOF3, predictor 1), so the 8-bit samples survive exactly.
The reader walks the RIFF tree, takes the frames from `idx1`, entropy-decodes all
frames of a group in lock step, and finds shots where the histogram difference of
consecutive frames exceeds a threshold that adapts to the frames before it.

Defined results: null and empty texts give one frame of 255s; equal texts give
equal bytes; a text whose AVI would pass the 4 GB of a RIFF size field raises.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import groups, utf8

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
GROUP = 2 << 20

#: Code length of each difference category 0..8; the all-ones code stays unused.
LENGTHS = {1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 0: 4, 8: 5}
SYMBOLS = sorted(LENGTHS, key=lambda s: (LENGTHS[s], s))


def _canonical(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    codes, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return codes


COUNTS = [sum(v == n for v in LENGTHS.values()) for n in range(1, 17)]
_DHT = struct.pack(">HHB16B9B", 0xFFC4, 2 + 17 + 9, 0, *COUNTS, *SYMBOLS)
_SOF = struct.pack(">HHBHHBBBB", 0xFFC3, 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
_SOS = struct.pack(">HHBBBBBB", 0xFFDA, 8, 1, 1, 0, 1, 0, 0)
HEAD = b"\xff\xd8" + _DHT + _SOF + _SOS
TAIL = b"\xff\xd9"


def _difference_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference -255..255."""
    codes = _canonical(COUNTS, SYMBOLS)
    bits, size = np.zeros(511, np.uint32), np.zeros(511, np.uint8)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, n = codes[s]
        bits[d + 255] = (code << s) | (d if d >= 0 else d + (1 << s) - 1)
        size[d + 255] = n + s
    return bits, size


BITS, SIZES = _difference_tables()


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded scans of (n, 24, 24) samples: bytes, and n + 1 offsets."""
    n = len(samples)
    x = samples.reshape(n, SIDE, SIDE).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    d = d.reshape(n, FRAME) + 255
    size = SIZES[d].astype(np.int64)
    after = np.cumsum(size, axis=1)
    n_bytes = (after[:, -1] + 7) >> 3
    base = np.concatenate([[0], np.cumsum(n_bytes)])
    start = (after - size + (base[:-1] << 3)[:, None]).ravel()
    word = BITS[d].ravel() << (24 - size.ravel() - (start & 7)).astype(np.uint32)
    at = start >> 3
    total = int(base[-1])
    out = np.zeros(total + 2, np.int64)
    for k, shift in enumerate((16, 8, 0)):
        out[k:] += np.bincount(at, (word >> shift) & 255, total + 2 - k).astype(np.int64)
    raw = out[:total].astype(np.uint8)
    raw[base[1:] - 1] |= ((1 << ((n_bytes << 3) - after[:, -1])) - 1).astype(np.uint8)
    full = np.flatnonzero(raw == 255)
    stuffed = np.insert(raw, full + 1, 0) if len(full) else raw
    return stuffed, base + np.searchsorted(full, base, side="left")


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(images: list[bytes]) -> bytes:
    """A RIFF AVI of JPEG images, with header lists, `movi` and `idx1`."""
    n = len(images)
    largest = max(map(len, images))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    size = np.fromiter(map(len, images), np.int64, n)
    at = 4 + np.concatenate([[0], np.cumsum(8 + size + (size & 1))])[:-1]
    if at[-1] + size[-1] > 0xF0000000:
        raise ValueError("a text of this length does not fit one RIFF file")
    index = np.empty(n, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    index["id"], index["flags"], index["at"], index["size"] = b"00dc", 0x10, at, size
    parts = [b"movi"]
    for image in images:
        parts += (b"00dc", struct.pack("<I", len(image)), image, b"\0" * (len(image) & 1))
    movi = _chunk(b"LIST", b"".join(parts))
    return _chunk(b"RIFF", b"AVI " + hdrl + movi + _chunk(b"idx1", index.tobytes()))


def index_of(avi: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Absolute start and size of each video frame, by `idx1`; and the frame rate."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI")
    at, end, movi, rows, fps = 12, 8 + struct.unpack_from("<I", avi, 4)[0], None, None, FPS
    while at + 8 <= end:
        tag, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if tag == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif tag == b"LIST" and avi[at + 8 : at + 12] == b"hdrl":
            fps = round(1_000_000 / struct.unpack_from("<I", avi, at + 20)[0])
        elif tag == b"idx1":
            kind = np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
            rows = np.frombuffer(avi, kind, size // 16, at + 8)
        at += 8 + size + (size & 1)
    if movi is None or rows is None:
        raise ValueError("the AVI has no movi list or no index")
    rows = rows[rows["id"] == b"00dc"]
    return rows["at"].astype(np.int64) + movi + 8, rows["size"].astype(np.int64), fps


def parse_head(image: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Length of the markers before the scan; difference and bits taken by 13-bit prefix."""
    at, codes = 2, None
    while True:
        marker, size = struct.unpack_from(">HH", image, at)
        if marker == 0xFFC4:
            counts = list(image[at + 5 : at + 21])
            codes = _canonical(counts, list(image[at + 21 : at + 21 + sum(counts)]))
        elif marker == 0xFFC3:
            precision, height, width, parts = struct.unpack_from(">BHHB", image, at + 4)
            if (precision, height, width, parts) != (8, SIDE, SIDE, 1):
                raise ValueError("frames of another shape")
        at += 2 + size
        if marker == 0xFFDA:
            break
    value, taken = np.zeros(1 << 13, np.int16), np.zeros(1 << 13, np.int64)
    for s, (code, n) in codes.items():
        if n + s > 13:
            continue
        rest = 13 - n - s
        for extra in range(1 << s):
            diff = extra if not s or extra >> (s - 1) else extra - (1 << s) + 1
            low = ((code << s) | extra) << rest
            value[low : low + (1 << rest)] = diff
            taken[low : low + (1 << rest)] = n + s
    return at, value, taken


def decode_frames(scans: np.ndarray, offsets: np.ndarray, value: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """(n, 576) samples of the entropy-coded scans, all frames in lock step."""
    n = len(offsets) - 1
    zero = np.flatnonzero((scans[1:] == 0) & (scans[:-1] == 255)) + 1
    raw = np.delete(scans, zero) if len(zero) else scans
    base = offsets - np.searchsorted(zero, offsets, side="left")
    padded = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.uint32)
    window = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
    pos = base[:-1] << 3
    d = np.empty((FRAME, n), np.int16)
    for t in range(FRAME):
        peek = (window[pos >> 3] >> (11 - (pos & 7)).astype(np.uint32)) & 0x1FFF
        d[t] = value[peek]
        pos += taken[peek]
    d = np.ascontiguousarray(d.T).reshape(n, SIDE, SIDE).astype(np.int32)
    d[:, :, 0] = 128 + np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 255).astype(np.uint8).reshape(n, FRAME)


def shots(frames: np.ndarray, span: int = 12, k: float = 3.0, least: float = 0.08) -> np.ndarray:
    """First frames of the shots of (n, 576) samples.

    A cut lies where the halved L1 distance of 16-bin histograms is over `least`
    and over mean + k deviations of the `span` distances before it.
    """
    n = len(frames)
    if n < 2:
        return np.zeros(1, np.int64)
    bins = (np.arange(n) << 4)[:, None] + (frames >> 4)
    hist = np.bincount(bins.ravel(), minlength=n << 4).reshape(n, 16)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * FRAME)
    one = np.concatenate([[0.0], np.cumsum(diff)])
    two = np.concatenate([[0.0], np.cumsum(diff * diff)])
    hi = np.arange(n - 1)
    lo = np.maximum(hi - span, 0)
    seen = np.maximum(hi - lo, 1)
    mean = (one[hi] - one[lo]) / seen
    spread = np.sqrt(np.maximum((two[hi] - two[lo]) / seen - mean * mean, 0))
    cut = (diff > least) & (diff > np.round(mean + k * spread, 9)) & (hi > 0)
    return np.concatenate([[0], np.flatnonzero(cut) + 1])


def payloads(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of all rows, padded by 255, and the rows' n + 1 frame offsets."""
    size = np.diff(ends)
    frames = np.maximum((size + FRAME - 1) // FRAME, 1)
    first = np.concatenate([[0], np.cumsum(frames)])
    out = np.full(int(first[-1]) * FRAME, 255, np.uint8)
    for i, n in enumerate(size):
        out[first[i] * FRAME : first[i] * FRAME + n] = raw[ends[i] : ends[i] + n]
    return out.reshape(-1, FRAME), first


def encode_rows(raw: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """One AVI for each row of a group of texts."""
    frames, first = payloads(raw, ends)
    images: list[bytes] = []
    step = GROUP // FRAME
    for lo in range(0, len(frames), step):
        scans, at = encode_frames(frames[lo : lo + step])
        whole = scans.tobytes()
        bounds = at.tolist()
        images += [HEAD + whole[a:b] + TAIL for a, b in zip(bounds, bounds[1:])]
    return [write_avi(images[a:b]) for a, b in zip(first.tolist(), first[1:].tolist())]


def decode_rows(files: list[bytes]) -> list[np.ndarray]:
    """(n, 576) samples of each AVI of a group."""
    scans, counts, heads = [], [], {}
    table = None
    for avi in files:
        start, size, _ = index_of(avi)
        counts.append(len(start))
        for a, n in zip(start.tolist(), size.tolist()):
            known = avi[a : a + len(HEAD)]
            if known not in heads:
                heads[known] = parse_head(avi[a : a + n])
            skip, *table = heads[known]
            scans.append(avi[a + skip : a + n - 2])
    if len(heads) > 1:
        raise ValueError("frames of one group differ in their tables")
    out = []
    step = GROUP // FRAME
    for lo in range(0, len(scans), step):
        part = scans[lo : lo + step]
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))])
        out.append(decode_frames(np.frombuffer(b"".join(part), np.uint8), offsets, *table))
    frames = np.concatenate(out)
    return np.split(frames, np.cumsum(counts)[:-1])


def _batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        raw, ends = utf8(batch.column(column))
        for i, j in groups(ends, GROUP):
            yield batch.slice(i, j - i), raw, ends[i : j + 1]


def with_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): the AVI file of each row's text."""

    def run(batches):
        for part, raw, ends in _batches(batches, "t"):
            yield pa.record_batch([part.column(0), pa.array(encode_rows(raw, ends), pa.binary())], ["id", "media"])

    src = df.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) t")
    return src.mapInArrow(run, "id long, media binary").withColumnRenamed("id", id_col)


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Timed clip rows of a media column: id, clip, first_frame, last_frame, start_s, end_s, mean.

    A null file gives no rows.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for key, avi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if avi is None:
                    continue
                frames = decode_rows([avi])[0]
                fps = index_of(avi)[2]
                cuts = [*shots(frames).tolist(), len(frames)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((key, k, a, b - 1, a / fps, b / fps, float(frames[a:b].mean())))
            names = ["id", "clip", "first_frame", "last_frame", "start_s", "end_s", "mean"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    schema = "id long, clip long, first_frame long, last_frame long, start_s double, end_s double, mean double"
    return media.select(id_col, media_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as an AVI, read the stored bytes back, and return their digests."""

    def run(batches):
        for part, raw, ends in _batches(batches, "t"):
            files = encode_rows(raw, ends)
            cols: list[list] = [[] for _ in range(7)]
            for n, avi, frames in zip(np.diff(ends).tolist(), files, decode_rows(files)):
                back = frames.tobytes()
                cuts = shots(frames).tolist()
                feature = f"frames={len(frames)};clips={len(cuts)};cuts={'|'.join(map(str, cuts))};mean={frames.mean():.4f}"
                row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(avi), hashlib.sha256(avi).hexdigest(), feature)
                for col, v in zip(cols, row):
                    col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    src = df.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) t")
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
