"""FLAC media columns: write and read mono streams with whole batches of frames in step.

Format (public specification, RFC 9639): marker, STREAMINFO with the MD5 of the
samples, a SEEKTABLE with one point for each frame, then frames of 576 samples.
A subframe is constant, verbatim, a fixed predictor of order 0 to 2, or a linear
predictor of order 2 with quantised coefficients; residuals are Rice coded.

The reader takes all frames of a batch at once: step i decodes residual i of
every frame. Frames of other shapes (partitions, escapes, higher orders, wasted
bits, 16-bit samples) go to a bit-by-bit reader. CRC-8 of headers, CRC-16 of
frames and the stream's MD5 are verified; damage raises ValueError.

Work is done inside the row, in blocks of at most FRAMES frames, so memory is
bounded by the largest text in a batch and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from volumetra.llm.common import batches, ship

BLOCK = 576
FRAMES = 8192
SHIFT = 9
PRECISION = 12


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    out = []
    for b in range(256):
        r = b << (width - 8)
        for _ in range(8):
            r = ((r << 1) ^ poly if r & top else r << 1) & mask
        out.append(r)
    return np.array(out, np.uint16 if width == 16 else np.uint8)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC of data[start:end] for each pair. The register starts at 0, so zeros put before a frame change nothing."""
    n = int((end - start).max(initial=0))
    r = np.zeros(len(start), table.dtype)
    for back in range(n, 0, -1):
        at = end - back
        b = np.where(at >= start, data[np.maximum(at, 0)], 0)
        r = table[(r >> 8) ^ b] ^ (r << np.uint16(8)) if table is CRC16 else table[r ^ b]
    return r


def coded_number(n: int) -> bytes:
    """Frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 5
    while True:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        if n < (1 << room):
            return bytes([(0xFF << (room + 1)) & 0xFF | n, *reversed(tail)])
        room -= 1


_HEADERS: dict[int, bytes] = {}


def frame_header(number: int) -> bytes:
    if number not in _HEADERS:
        h = b"\xff\xf8\x20\x02" + coded_number(number)
        r = 0
        for b in h:
            r = int(CRC8[r ^ b])
        h += bytes([r])
        if len(_HEADERS) > 100_000:
            _HEADERS.clear()
        _HEADERS[number] = h
    return _HEADERS[number]


# --- writing ----------------------------------------------------------------


def _residuals(s: np.ndarray):
    """For frames s (n x 576 int32): kind per frame (0-2 fixed order, 3 linear), residuals, coefficients."""
    n = len(s)
    d1 = np.diff(s, axis=1, prepend=0)
    d2 = np.diff(d1, axis=1, prepend=0)
    f = s.astype(np.float32)
    r0 = np.einsum("ij,ij->i", f, f)
    r1 = np.einsum("ij,ij->i", f[:, 1:], f[:, :-1])
    r2 = np.einsum("ij,ij->i", f[:, 2:], f[:, :-2])
    den = np.maximum(r0 * r0 - r1 * r1, 1)
    lim = 2 ** (PRECISION - 1) - 1
    a1 = np.clip(np.rint((r1 * (r0 - r2) / den) * 2**SHIFT), -lim, lim).astype(np.int32)
    a2 = np.clip(np.rint(((r0 * r2 - r1 * r1) / den) * 2**SHIFT), -lim, lim).astype(np.int32)
    lin = s.copy()
    lin[:, 2:] -= (a1[:, None] * s[:, 1:-1] + a2[:, None] * s[:, :-2]) >> SHIFT
    options = (s, d1, d2, lin)
    order = np.array([0, 1, 2, 2])
    cost = np.stack([np.abs(x[:, o:]).sum(axis=1) + 100 * (k == 3) for k, (x, o) in enumerate(zip(options, order))])
    kind = cost.argmin(axis=0)
    res = np.empty_like(s)
    for k, x in enumerate(options):
        res[kind == k] = x[kind == k]
    return kind, res, np.stack([a1, a2], axis=1) if n else np.zeros((0, 2), np.int32)


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    return ((values.reshape(-1, 1) >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8)


def subframes(samples: np.ndarray) -> list[bytes]:
    """The subframe bytes of each frame (n x 576 int32 in -128..127)."""
    n = len(samples)
    out: list[bytes] = [b""] * n
    constant = (samples == samples[:, :1]).all(axis=1)
    for i in np.flatnonzero(constant):
        out[i] = bytes([0, int(samples[i, 0]) & 0xFF])
    rest = np.flatnonzero(~constant)
    if not len(rest):
        return out
    s = samples[rest]
    kind, res, coef = _residuals(s)
    order = np.array([0, 1, 2, 2])[kind]
    z = np.where(res >= 0, 2 * res, -2 * res - 1)
    z[np.arange(BLOCK)[None, :] < order[:, None]] = 0
    least = np.maximum(0, np.ceil(np.log2(np.maximum(z.max(axis=1), 1) / 24 + 1e-9))).astype(np.int64)  # short unary parts
    small = z.astype(np.uint16)
    cost = np.stack([(small >> np.uint16(k)).sum(axis=1, dtype=np.int64) + (BLOCK - order) * (1 + k) + np.where(k < least, 1 << 30, 0) for k in range(1, 10)])
    rice = cost.argmin(axis=0) + 1
    verbatim = cost.min(axis=0) + 8 * order + np.where(kind == 3, 9 + 2 * PRECISION, 0) + 10 >= 8 * BLOCK
    for i in np.flatnonzero(verbatim):
        out[rest[i]] = b"\x02" + (s[i] & 0xFF).astype(np.uint8).tobytes()
    for k in range(4):
        for r in np.unique(rice[(kind == k) & ~verbatim]):
            own = np.flatnonzero((kind == k) & (rice == r) & ~verbatim)
            o, m = (0, 1, 2, 2)[k], len(own)
            head = [_bits(np.full(m, (0x08 | o if k < 3 else 0x21) << 1), 8)]
            head += [_bits(s[own, j] & 0xFF, 8) for j in range(o)]
            if k == 3:
                head += [_bits(np.full(m, PRECISION - 1), 4), _bits(np.full(m, SHIFT), 5)]
                head += [_bits(coef[own, j] & (2**PRECISION - 1), PRECISION) for j in range(2)]
            head += [_bits(np.full(m, r), 10)]
            head = np.concatenate(head, axis=1)
            zz = z[own, o:]
            q = zz >> r
            length = q + 1 + r
            total = head.shape[1] + length.sum(axis=1)
            size = (total + 7) // 8
            start = np.concatenate([[0], np.cumsum(size)])
            bits = np.zeros(int(start[-1]) * 8, np.uint8)
            bits[(start[:-1] * 8)[:, None] + np.arange(head.shape[1])] = head
            at = np.cumsum(length, axis=1) - length + (start[:-1] * 8 + head.shape[1])[:, None] + q
            bits[at] = 1
            for j in range(int(r)):
                bits[at + 1 + j] = (zz >> (int(r) - 1 - j)) & 1
            packed = np.packbits(bits).tobytes()
            for i, a, b in zip(own, start[:-1], start[1:]):
                out[rest[i]] = packed[a:b]
    return out


def write_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of 576 bytes."""
    counts = [len(p) // BLOCK for p in payloads]
    body: list[bytes] = []
    number = [i for c in counts for i in range(c)]
    whole = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    for a in range(0, len(whole), FRAMES):
        body += subframes(whole[a : a + FRAMES].astype(np.int32) - 128)
    frames = [frame_header(i) + b for i, b in zip(number, body)]
    crc: list[int] = []
    for a in range(0, len(frames), FRAMES):
        part = frames[a : a + FRAMES]
        ends = np.cumsum([len(x) for x in part])
        starts = np.concatenate([[0], ends[:-1]])
        crc += crc_of(np.frombuffer(b"".join(part), np.uint8), starts, ends, CRC16).tolist()
    frames = [f + c.to_bytes(2, "big") for f, c in zip(frames, crc)]
    out, at = [], 0
    for p, c in zip(payloads, counts):
        own = frames[at : at + c]
        at += c
        sizes = [len(x) for x in own]
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += ((8000 << 44) | (0 << 41) | (7 << 36) | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points, place = [], 0
        for i, z in enumerate(sizes):
            points.append((i * BLOCK).to_bytes(8, "big") + place.to_bytes(8, "big") + BLOCK.to_bytes(2, "big"))
            place += z
        table = b"".join(points)
        if len(table) < 1 << 24:
            meta = b"\x00\x00\x00\x22" + info + b"\x83" + len(table).to_bytes(3, "big") + table
        else:  # a block holds less than 16 MB: a longer stream is read by its frame headers
            meta = b"\x80\x00\x00\x22" + info
        out.append(b"fLaC" + meta + b"".join(own))
    return out


# --- reading ----------------------------------------------------------------


class _Reader:
    """Bits of one frame, most significant first."""

    def __init__(self, data: bytes):
        self.v, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("the frame ends too early")
        return (self.v >> self.left) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        rest = self.v & ((1 << self.left) - 1)
        if not rest:
            raise ValueError("the frame ends too early")
        q = self.left - rest.bit_length()
        self.left -= q + 1
        return q


def read_subframe(data: bytes, size: int, depth: int) -> list[int]:
    """Samples of one subframe, in any form that the format allows."""
    r = _Reader(data)
    if r.take(1):
        raise ValueError("not a subframe")
    kind = r.take(6)
    wasted = r.unary() + 1 if r.take(1) else 0
    depth -= wasted
    if kind == 0:
        s = [r.signed(depth)] * size
    elif kind == 1:
        s = [r.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        s = [r.signed(depth) for _ in range(order)]
        if kind < 32:
            coef, shift = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))[order], 0
        else:
            precision, shift = r.take(4) + 1, r.signed(5)
            coef = [r.signed(precision) for _ in range(order)]
        wide = r.take(2)
        if wide > 1:
            raise ValueError("reserved residual coding")
        parts = 1 << r.take(4)
        for p in range(parts):
            k = r.take(4 + wide)
            n = size // parts - (order if p == 0 else 0)
            escape = k == (31 if wide else 15)
            raw = r.take(5) if escape else 0
            for _ in range(n):
                if escape:
                    e = r.signed(raw)
                else:
                    q = r.unary()
                    z = (q << k) | r.take(k)
                    e = (z >> 1) ^ -(z & 1)
                s.append(e + (sum(c * s[-1 - j] for j, c in enumerate(coef)) >> shift))
    else:
        raise ValueError("reserved subframe")
    return [x << wasted for x in s]


def frame_bounds(data: bytes, first: int) -> list[int]:
    """Starts of the frames from `first`, by headers whose CRC-8 is right and frames whose CRC-16 is."""
    found, at = [], first
    while (at := data.find(b"\xff\xf8", at)) >= 0:
        n = 1 if data[at + 4 : at + 5] < b"\x80" else max(2, 8 - (data[at + 4] ^ 0xFF).bit_length())
        r = 0
        for b in data[at : at + 5 + n]:
            r = int(CRC8[r ^ b])
        if r == 0:
            found.append(at)
        at += 1
    if not found or found[0] != first:
        raise ValueError("no frame where one must start")
    bytes_, starts = np.frombuffer(data, np.uint8), [first]
    for b in [*found[1:], len(data)]:
        if crc_of(bytes_, np.array([starts[-1]]), np.array([b]), CRC16)[0] == 0:
            starts.append(b)
    if starts[-1] != len(data):
        raise ValueError("a frame's CRC-16 is wrong")
    return starts


def parse(data: bytes) -> dict:
    """STREAMINFO and the frames' places."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, points = 4, b"", []
    while True:
        kind, n = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + n]
        if kind & 0x7F == 0:
            info = block
        elif kind & 0x7F == 3:
            points = np.frombuffer(block, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        at += 4 + n
        if kind & 0x80:
            break
    packed = int.from_bytes(info[10:18], "big")
    samples, channels, depth = packed & ((1 << 36) - 1), (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1
    size = int.from_bytes(info[0:2], "big")
    if channels != 1:
        raise ValueError("only mono streams are read")
    frames = -(-samples // size)
    if len(points) == frames:
        starts = [*(points["offset"].astype(np.int64) + at).tolist(), len(data)]
    else:
        starts = frame_bounds(data, at)
    return {"samples": samples, "depth": depth, "block": size, "md5": info[18:34], "starts": starts}


def _lanes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Samples (n x 576 int32) of frames of 576 8-bit samples at buf[start:end], subframes only."""
    n = len(start)
    out = np.zeros((n, BLOCK), np.int32)
    kind = buf[start].astype(np.int64)
    done = np.zeros(n, bool)
    for i in np.flatnonzero(kind == 0):
        out[i] = np.int8(buf[start[i] + 1])
        done[i] = True
    own = np.flatnonzero(kind == 2)
    if len(own):
        out[own] = buf[start[own][:, None] + 1 + np.arange(BLOCK)].view(np.int8)
        done[own] = True
    windows = np.ndarray((len(buf) - 7,), ">u8", buf, 0, (1,))
    last = len(buf) - 8

    def peek(p: np.ndarray) -> np.ndarray:
        return windows[np.minimum(p >> 3, last)].astype(np.uint64) << (p & 7).astype(np.uint64)

    def field(p: np.ndarray, width: int, signed: bool = False) -> np.ndarray:
        x = (peek(p) >> np.uint64(64 - width)).astype(np.int64)
        return np.where(x >> (width - 1) > 0, x - (1 << width), x) if signed else x

    for tag, order, linear in ((0x10, 0, False), (0x12, 1, False), (0x14, 2, False), (0x42, 2, True)):
        own = np.flatnonzero(kind == tag)
        if not len(own):
            continue
        p = start[own] * 8 + 8
        warm = [field(p + 8 * j, 8, True) for j in range(order)]
        p = p + 8 * order
        coef, shift = [], 0
        if linear:
            same = (field(p, 4) == PRECISION - 1) & (field(p + 4, 5) == SHIFT)
            coef = [field(p + 9 + PRECISION * j, PRECISION, True).astype(np.int32) for j in range(2)]
            p = p + 9 + 2 * PRECISION
        else:
            same = np.ones(len(own), bool)
        same &= field(p, 6) == 0
        k = field(p + 6, 4)
        same &= k < 15
        p = p + 10
        low_shift, low_mask = np.minimum(64 - k, 63).astype(np.uint64), (1 << k) - 1
        res = np.empty((BLOCK - order, len(own)), np.int32)
        for i in range(BLOCK - order):
            w = peek(p)
            q = 32 - np.frexp((w >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
            low = ((w << (q + 1).astype(np.uint64)) >> low_shift).astype(np.int64) & low_mask
            z = (q << k) | low
            res[i] = (z >> 1) ^ -(z & 1)
            same &= q < 32
            p = p + q + 1 + k
        same &= (p + 7) // 8 == end[own]
        s = np.empty((BLOCK, len(own)), np.int32)
        for j in range(order):
            s[j] = warm[j]
        if linear:
            for i in range(2, BLOCK):
                s[i] = res[i - 2] + ((coef[0] * s[i - 1] + coef[1] * s[i - 2]) >> SHIFT)
        elif order == 0:
            s = res
        elif order == 1:
            s[1:] = np.cumsum(res, axis=0) + s[0]
        else:
            s[2:] = np.cumsum(np.cumsum(res, axis=0) + (s[1] - s[0]), axis=0) + s[1]
        out[own[same]] = s.T[same]
        done[own[same]] = True
    for i in np.flatnonzero(~done):
        out[i] = read_subframe(buf[start[i] : end[i]].tobytes(), BLOCK, 8)
    return out


def read_streams(streams: list[bytes]) -> list[bytes]:
    """The 8-bit payload of each stream, all checksums verified."""
    heads = [parse(x) for x in streams]
    if any(h["depth"] != 8 for h in heads):
        raise ValueError("payloads are 8-bit")
    base = np.cumsum([0, *(len(x) for x in streams[:-1])])
    buf = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    starts = np.concatenate([np.array(h["starts"][:-1]) + b for h, b in zip(heads, base)]).astype(np.int64)
    ends = np.concatenate([np.array(h["starts"][1:]) + b for h, b in zip(heads, base)]).astype(np.int64)
    if any(h["block"] != BLOCK or h["samples"] % BLOCK for h in heads):
        raise ValueError("payloads have frames of 576 samples")
    parts = []
    for a in range(0, len(starts), FRAMES):
        s, e = starts[a : a + FRAMES], ends[a : a + FRAMES]
        lead = buf[s + 4].astype(np.int64)
        extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [0, 1, 2, 3, 4], 5)
        if not ((buf[s] == 0xFF) & (buf[s + 1] == 0xF8) & (buf[s + 2] == 0x20) & (buf[s + 3] == 0x02)).all():
            raise ValueError("not a frame of 576 mono 8-bit samples")
        if crc_of(buf, s, s + 6 + extra, CRC8).any():
            raise ValueError("a frame header's CRC-8 is wrong")
        if crc_of(buf, s, e, CRC16).any():
            raise ValueError("a frame's CRC-16 is wrong")
        parts.append((_lanes(buf, s + 6 + extra, e - 2) + 128).astype(np.uint8))
    whole = np.concatenate(parts).tobytes()
    out, at = [], 0
    for h in heads:
        p = whole[at : at + h["samples"]]
        at += h["samples"]
        if hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest() != h["md5"]:
            raise ValueError("the stream's MD5 is wrong")
        out.append(p)
    return out


# --- tables -----------------------------------------------------------------


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * ((-len(raw)) % BLOCK or (0 if raw else BLOCK))


def encode_column(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (other columns unchanged, text replaced) with n_bytes long and media binary."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, "n_bytes", "media")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest] + ["n_bytes long", "media binary"])

    def run(frames):
        for batch in batches(frames, 4.0, text):
            made = [payload(t) for t in batch.column(text).to_pylist()]
            media = write_streams([p for _, p in made])
            columns = [batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())], [*rest, "n_bytes", "media"])

    return docs.mapInArrow(run, schema)


def pcm_blocks(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """PCM blocks with seekable offsets: key, block, sample_offset, n_samples, pcm."""
    ship(media.sparkSession)
    kind = media.schema[key].dataType.simpleString()

    def run(frames):
        for batch in batches((b.select([key, column]) for b in frames), 4.0, column):
            ids = batch.column(key).to_pylist()
            rows = [(k, i, i * BLOCK, BLOCK, p[i * BLOCK : (i + 1) * BLOCK]) for k, p in zip(ids, read_streams(batch.column(column).to_pylist())) for i in range(len(p) // BLOCK)]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(key).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())], [key, "block", "sample_offset", "n_samples", "pcm"])

    return media.mapInArrow(run, f"`{key}` {kind}, block long, sample_offset long, n_samples long, pcm binary")


def features(p: bytes) -> str:
    """Integer statistics of the samples: mean square, sign changes, peak."""
    s = np.frombuffer(p, np.uint8).astype(np.int32) - 128
    changes = int(((s[1:] < 0) != (s[:-1] < 0)).sum())
    return f"power={int((s * s).sum()) // len(s)};changes={changes};peak={int(np.abs(s).max())};frames={len(s) // BLOCK}"


def describe(media: DataFrame, column: str = "media") -> DataFrame:
    """Reads every stream back: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    ship(media.sparkSession)
    made = ["payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string"]
    names = [x.split()[0] for x in made]
    rest = [c for c in media.columns if c not in (column, *names)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name in rest] + made)

    def run(frames):
        for batch in batches(frames, 4.0, column):
            streams = batch.column(column).to_pylist()
            back = read_streams(streams)
            values = [
                pa.array([len(p) for p in back], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in back]),
                pa.array([zlib.crc32(p[-32:]) for p in back], pa.int64()),
                pc.cast(pc.binary_length(batch.column(column)), pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in streams]),
                pa.array([features(p) for p in back]),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *values], [*rest, *names])

    return media.mapInArrow(run, schema)
