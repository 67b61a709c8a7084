"""Motion-JPEG in AVI files: storing bytes as frames, reading frames, finding shots.

An AVI file is a RIFF tree; its idx1 chunk lists the frames, each one a JPEG picture
of its own. Lossless JPEG (SOF3) stores each sample as the difference to its left
neighbour, Huffman-coded by size. The frames written here use a code in which size s
takes 9 - s bits, so that code and value always fill 9 bits; that is an ordinary
JPEG table, but numpy can pack and unpack it without a bit loop. Frames with any other
table, and baseline DCT frames (grey or the luma of YCbCr), go through a bit reader.

A shot ends where the distance of neighbouring grey histograms stands out from its own
surroundings: over their mean plus three deviations, and over a fixed least distance.

Null text counts as empty. Null media have no clips and null features; unreadable media
have none either and carry the reason in `error`. Repeated rows are kept row by row, and
equal texts give equal files. Very long texts become as many frames as they need. A jump
that only equals its threshold is no shot. An empty table gives no rows; only id and text
(or media) are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, map_batches

SIDE = 24
#: Samples, and so payload bytes, of a frame.
FRAME = SIDE * SIDE
PAD = 255
MICROS = 40_000
BINS = 16
WINDOW, DEVIATIONS, LEAST = 12, 3.0, 0.25


def _nine_bit_codes() -> tuple[np.ndarray, np.ndarray]:
    """9-bit code of each difference -255..255, and the difference of each code."""
    write, read = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = ((1 << (8 - s)) - 1) << 1
        code = (prefix << s) | (d if d >= 0 else d + (1 << s) - 1)
        write[d + 255], read[code] = code, d
    return write, read


WRITE9, READ9 = _nine_bit_codes()
_SIZES = bytes(range(8, -1, -1))
HEAD = (
    b"\xff\xd8"
    + b"\xff\xc4" + struct.pack(">HB", 28, 0) + bytes([1] * 9 + [0] * 7) + _SIZES
    + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
)
TAIL = b"\xff\xd9"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and these with padding up to a positive multiple of a frame."""
    raw = (text or "").encode()
    return len(raw), raw + bytes([PAD]) * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def _pictures(payload: bytes) -> list[bytes]:
    x = np.frombuffer(payload, np.uint8).reshape(-1, SIDE, SIDE).astype(np.int16)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    c = WRITE9[d + 255].reshape(-1, 8)
    out = np.empty((len(c), 9), np.uint8)
    out[:, 0] = c[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = ((c[:, k - 1] & ((1 << k) - 1)) << (8 - k)) | (c[:, k] >> (k + 1))
    out[:, 8] = c[:, 7] & 255
    flat = out.reshape(-1)
    full = flat == 255  # each such byte is followed by a zero
    place = np.arange(len(flat)) + np.cumsum(full) - full
    stuffed = np.zeros(len(flat) + int(full.sum()), np.uint8)
    stuffed[place] = flat
    raw, step = stuffed.tobytes(), FRAME * 9 // 8
    edges = [*place[::step].tolist(), len(raw)]
    return [HEAD + raw[a:b] + TAIL for a, b in zip(edges, edges[1:])]


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def write_avi(pictures: list[bytes], width: int = SIDE, height: int = SIDE, micros: int = MICROS) -> bytes:
    size = np.fromiter(map(len, pictures), np.int64, len(pictures))
    avih = struct.pack("<14I", micros, int(size.sum() * 1_000_000 // max(1, micros * len(size))), 0, 0x10, len(size), 0, 1, int(size.max(initial=0)), width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, micros, 1_000_000, 0, len(size), int(size.max(initial=0)), 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", p) for p in pictures))
    index = np.zeros(len(size), np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    index["name"], index["flags"], index["size"] = b"00dc", 0x10, size
    index["at"] = 4 + np.cumsum(8 + size + (size & 1)) - (8 + size + (size & 1))
    return _chunk(b"RIFF", b"AVI " + head + movi + _chunk(b"idx1", index.tobytes()))


def read_avi(data: bytes) -> tuple[int, list[bytes]]:
    """Microseconds of a frame, and the frames of the first video stream, by the index
    where there is one and else in the order of the movi list. An empty chunk repeats the
    frame before (at the start, the first one). Without a frame there is an error."""
    micros, movi, index, frames, streams = MICROS, None, None, [], {}
    stack = [(0, len(data))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body, last = at + 8, min(at + 8 + size, end)
            if name in (b"RIFF", b"LIST"):
                kind = data[body : body + 4]
                if kind == b"movi" and movi is None:
                    movi = (body, last)
                if kind in (b"AVI ", b"hdrl", b"strl"):
                    stack.append((body + 4, last))
            elif name == b"avih":
                micros = struct.unpack_from("<I", data, body)[0] or MICROS
            elif name == b"strh":
                streams[at] = data[body : body + 4]
            elif name == b"idx1":
                index = data[body:last]
            at = body + size + (size & 1)
    if movi is None:
        raise ValueError("no movi list")
    kinds = [streams[i] for i in sorted(streams)] or [b"vids"]
    if b"vids" not in kinds:
        raise ValueError("no video stream")
    names = [b"%02d%s" % (kinds.index(b"vids"), x) for x in (b"dc", b"db")]
    if index is not None:
        rows = np.frombuffer(index[: len(index) // 16 * 16], np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
        rows = rows[np.isin(rows["name"], names)]
        # offsets count from the list's name, or in some files from the file's start
        base = movi[0] if not len(rows) or data[movi[0] + int(rows["at"][0]) :][:4] == rows["name"][0] else 0
        frames = [data[base + a + 8 : base + a + 8 + n] for a, n in zip(rows["at"].tolist(), rows["size"].tolist())]
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at : at + 4] in names:
                frames.append(data[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
    held = next((f for f in frames if f), None)
    if held is None:
        raise ValueError("no video frame")
    out = []
    for f in frames:
        held = f or held
        out.append(held)
    return micros, out


class Picture:
    """The parsed markers of one JPEG picture up to its entropy-coded data."""

    def __init__(self, data: bytes) -> None:
        self.tables: dict[int, dict[tuple[int, int], int]] = {}
        self.quant: dict[int, np.ndarray] = {}
        self.restart, self.kind, at = 0, 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG picture")
        while True:
            mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if mark == 0xC4:
                self._huffman(body)
            elif mark == 0xDB:
                while body:
                    wide, n = body[0] >> 4, body[0] & 15
                    self.quant[n] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif mark in (0xC0, 0xC1, 0xC3):
                self.kind = mark
                self.bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif mark == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif mark == 0xDA:
                self.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                self.predictor = body[1 + 2 * body[0]]
                self.start = at + 2 + size
                break
            at += 2 + size
        if not self.kind:
            raise ValueError("only baseline and lossless pictures are read")

    def _huffman(self, body: bytes) -> None:
        while body:
            counts, symbols = body[1:17], body[17:]
            table, code, k = {}, 0, 0
            for length in range(1, 17):
                for _ in range(counts[length - 1]):
                    table[length, code] = symbols[k]
                    code, k = code + 1, k + 1
                code <<= 1
            self.tables[body[0]] = table
            body = body[17 + k :]

    def even(self) -> bool:
        """Whether each sample takes the 9 bits of WRITE9."""
        want = {(9 - s, ((1 << (8 - s)) - 1) << 1): s for s in range(9)}
        return (
            self.kind == 0xC3 and self.bits == 8 and len(self.parts) == 1 and self.predictor == 1 and not self.restart
            and self.tables.get(self.scan[0][1]) == want and self.width * self.height % 8 == 0
        )


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.have = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.have < n:
            byte = 0
            if self.at < len(self.data):
                byte = self.data[self.at]
                if byte == 255 and self.data[self.at + 1 : self.at + 2] not in (b"\0", b""):
                    byte = 0  # a marker: the segment has ended
                else:
                    self.at += 1 + (byte == 255)
            self.held, self.have = (self.held << 8 | byte) & 0xFFFFFFFFFF, self.have + 8
        self.have -= n
        return self.held >> self.have & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("bad Huffman code")

    def value(self, size: int) -> int:
        if size == 16:
            return 32768
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    def next_segment(self) -> None:
        self.have = 0
        while self.at + 1 < len(self.data) and not (self.data[self.at] == 255 and 0xD0 <= self.data[self.at + 1] <= 0xD7):
            self.at += 1
        self.at += 2


def _lossless(p: Picture, bits: _Bits) -> np.ndarray:
    if len(p.parts) != 1:
        raise ValueError("lossless pictures of one component only")
    table, half = p.tables[p.scan[0][1]], 1 << (p.bits - 1)
    x = [[0] * p.width for _ in range(p.height)]
    fresh, done = True, 0
    for r in range(p.height):
        for c in range(p.width):
            if p.restart and done and done % p.restart == 0:
                bits.next_segment()
                fresh = True
            if fresh:
                guess, fresh = half, False
            elif r == 0:
                guess = x[r][c - 1]
            elif c == 0:
                guess = x[r - 1][0]
            else:
                a, b, d = x[r][c - 1], x[r - 1][c], x[r - 1][c - 1]
                guess = (0, a, b, d, a + b - d, a + ((b - d) >> 1), b + ((a - d) >> 1), (a + b) >> 1)[p.predictor]
            x[r][c] = (guess + bits.value(bits.symbol(table))) & 0xFFFF
            done += 1
    return np.array(x)


def _zigzag() -> list[int]:
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return [8 * r + c for r, c in cells]


ZIGZAG = _zigzag()
_k = np.arange(8)
COSINES = np.where(_k[:, None] == 0, np.sqrt(0.125), 0.5 * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16))


def _baseline(p: Picture, bits: _Bits) -> np.ndarray:
    """The first component's samples; the others are read over."""
    scan = {c: (dc, ac) for c, dc, ac in p.scan}
    most_h, most_v = max(x[1] for x in p.parts), max(x[2] for x in p.parts)
    if len(p.parts) == 1:
        most_h = most_v = 1
    across, down = -(-p.width // (8 * most_h)), -(-p.height // (8 * most_v))
    last = dict.fromkeys(scan, 0)
    first, h0, v0, q0 = p.parts[0]
    if len(p.parts) == 1:
        h0 = v0 = 1
    plane = np.zeros((down * v0 * 8, across * h0 * 8))
    for n in range(across * down):
        if p.restart and n and n % p.restart == 0:
            bits.next_segment()
            last = dict.fromkeys(scan, 0)
        for part, h, v, q in p.parts:
            for block in range(1 if len(p.parts) == 1 else h * v):
                dc, ac = scan[part]
                z = np.zeros(64)
                last[part] += bits.value(bits.symbol(p.tables[dc]))
                z[0], k = last[part] * p.quant[q][0], 1
                while k < 64:
                    run, size = divmod(bits.symbol(p.tables[16 + ac]), 16)
                    if not size:
                        if run != 15:
                            break
                        k += 16
                        continue
                    k += run
                    z[ZIGZAG[k]] = bits.value(size) * p.quant[q][k]
                    k += 1
                if part == first:
                    y, x = (n // across * v0 + block // h0) * 8, (n % across * h0 + block % h0) * 8
                    plane[y : y + 8, x : x + 8] = COSINES.T @ z.reshape(8, 8) @ COSINES
    return np.clip(np.rint(plane + 128), 0, 255)[: p.height, : p.width]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Grey samples of all frames (frame, row, column); all must have one size."""
    if not frames:
        return np.zeros((0, 0, 0), np.uint8)
    p = Picture(frames[0])
    head = frames[0][: p.start]
    if p.even() and all(f.startswith(head) and f.endswith(TAIL) for f in frames):
        flat = np.frombuffer(b"".join(f[p.start : -2] for f in frames), np.uint8)
        keep = np.ones(len(flat), bool)
        keep[np.flatnonzero(flat[:-1] == 255) + 1] = False
        flat = flat[keep]
        if len(flat) == len(frames) * p.width * p.height * 9 // 8:
            b = flat.reshape(-1, 9).astype(np.uint16)
            c = np.empty((len(b), 8), np.uint16)
            for i in range(8):
                c[:, i] = ((b[:, i] & ((1 << (8 - i)) - 1)) << (i + 1)) | (b[:, i + 1] >> (7 - i))
            d = READ9[c].reshape(-1, p.height, p.width)
            d[:, 0, 0] += 128
            d[:, :, 0] = np.cumsum(d[:, :, 0], 1)
            return np.cumsum(d, 2, dtype=np.int16).astype(np.uint8)
    out = []
    for f in frames:
        p = Picture(f)
        bits = _Bits(f[p.start :])
        out.append(_lossless(p, bits) >> max(0, p.bits - 8) if p.kind == 0xC3 else _baseline(p, bits))
    return np.stack(out).astype(np.uint8)


def histograms(x: np.ndarray) -> np.ndarray:
    n = len(x)
    levels = (x.reshape(n, -1) >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
    return np.bincount(levels.reshape(-1), minlength=n * BINS).reshape(n, BINS)


def shot_starts(hist: np.ndarray) -> np.ndarray:
    """First frames of the shots."""
    n = len(hist)
    if n < 2:
        return np.arange(n)
    jump = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * np.maximum(1, hist[0].sum()))
    a, b = np.maximum(0, np.arange(n - 1) - WINDOW), np.minimum(n - 1, np.arange(n - 1) + WINDOW + 1)
    sums, squares = np.concatenate(([0.0], np.cumsum(jump))), np.concatenate(([0.0], np.cumsum(jump * jump)))
    mean = (sums[b] - sums[a]) / (b - a)
    spread = np.sqrt(np.maximum(0, (squares[b] - squares[a]) / (b - a) - mean * mean))
    cut = jump > np.maximum(LEAST, mean + DEVIATIONS * spread)
    return np.concatenate(([0], np.flatnonzero(cut) + 1))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, n_bytes and media: the text as a lossless Motion-JPEG file."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        made = [payload_of(t) for t in rows["t"]]
        return {id_col: rows["k"], "n_bytes": [n for n, _ in made], "media": [write_avi(_pictures(p)) for _, p in made]}

    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    return map_batches(rows, f"`{id_col}` {dict(df.dtypes)[id_col]}, n_bytes long, media binary", work, "t")


def clips(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each shot of each file: clip, first and last frame, start_ms, end_ms,
    mean_level; a file that can't be read gives one row with clip null and an error."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: list[tuple] = []
        for key, media in zip(rows["k"], rows["m"]):
            if media is None:
                continue
            try:
                micros, frames = read_avi(media)
                x = decode_frames(frames)
            except (ValueError, KeyError, IndexError, struct.error) as e:
                out.append((key, None, None, None, None, None, None, str(e)))
                continue
            starts = shot_starts(histograms(x)) if len(x) else np.arange(0)
            for i, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(x)])):
                out.append((key, i, a, b - 1, a * micros / 1000, b * micros / 1000, float(x[a:b].mean()), None))
        return dict(zip((id_col, "clip", "first_frame", "last_frame", "start_ms", "end_ms", "mean_level", "error"), zip(*out) if out else [()] * 8))

    rows = df.select(F.col(id_col).alias("k"), F.col(media_col).alias("m"))
    shape = "clip int, first_frame int, last_frame int, start_ms double, end_ms double, mean_level double, error string"
    return map_batches(rows, f"`{id_col}` {dict(df.dtypes)[id_col]}, {shape}", work)


def feature_of(x: np.ndarray) -> str:
    """Frames, shots, and a digest of the histograms, of the decoded samples."""
    hist = histograms(x)
    starts = shot_starts(hist)
    digest = hashlib.blake2b(hist.astype("<i4").tobytes() + starts.astype("<i4").tobytes(), digest_size=8).hexdigest()
    return f"frames={len(x)};shots={len(starts)};level={x.mean():.4f};digest={digest}"


def stored_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as media, reads the stored bytes back, and returns digests of
    both with the features; the media themselves stay in the task."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in names}
        for key, text in zip(rows["k"], rows["t"]):
            n, payload = payload_of(text)
            media = write_avi(_pictures(payload))
            x = decode_frames(read_avi(media)[1])
            back = x.tobytes()
            sha = lambda raw: hashlib.sha256(raw).hexdigest()
            row = (key, n, len(back), sha(back), zlib.crc32(back[-32:]), len(media), sha(media), feature_of(x))
            for name, value in zip(names, row):
                out[name].append(value)
        return out

    names = (id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kinds = (dict(df.dtypes)[id_col], "long", "long", "string", "long", "long", "string", "string")
    return map_batches(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)), work, "t")


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    return stored_digests(load(spark, sf_dir, "documents"))
