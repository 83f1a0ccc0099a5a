"""FLAC for media columns: 8-bit mono streams, many frames at a time.

Bytes become samples (byte - 128) in frames of at most BLOCK samples. Frames of many rows
are coded side by side: predictors and Rice codes are computed on arrays of frames, bits are
placed by their offsets, and what must go sample after sample in decoding (the unary chain of
Rice codes, linear prediction, checksums) goes in step over all frames of a chunk.

The writer chooses per frame among constant, verbatim, fixed predictors of order 0 to 4 and a
linear predictor of order LPC_ORDER. The reader takes those with any partition order, verifies each
header's CRC-8, each frame's CRC-16 and the stream's MD5, and seeks by the seek table, which
has a point for every frame; where another encoder wrote fewer, frames are found by their headers and
checksums. Streams of other widths or of several channels, wasted bits and unencoded partitions are not read.

Defined results: a null or empty payload is taken as no samples and gives a stream without
frames; equal payloads give equal streams; payloads of any length go in frames; a damaged stream, or a
stream that is null, raises ValueError. Columns that are made replace others of the same names; an
empty table gives an empty result; other columns are carried, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from gneiss.llm.common import arrow

BLOCK = 4096
LPC_ORDER, LPC_PRECISION = 4, 9
RATE = 8000
_CHUNK = 1 << 20  # samples coded side by side
_MOST_K = 14
_PLACEHOLDER = (1 << 64) - 1  # the first sample of a point that stands for none


def _crc_table(polynomial: int, width: int) -> np.ndarray:
    table = []
    for value in range(256):
        value <<= width - 8
        for _ in range(8):
            value = value << 1 ^ (polynomial if value >> (width - 1) & 1 else 0)
        table.append(value & ((1 << width) - 1))
    return np.array(table, np.uint16)


_CRC8 = _crc_table(0x07, 8).tolist()
_CRC16 = _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    value = 0
    for byte in data:
        value = _CRC8[value ^ byte]
    return value


def crc16(frames: list[bytes]) -> np.ndarray:
    """CRC-16 of each frame, byte by byte over all of them."""
    sizes = np.array([len(f) for f in frames], np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(frames) + b"\0", np.uint8)
    at = (np.cumsum(sizes) - sizes)[order]
    left = sizes[order]
    value = np.zeros(len(frames), np.uint16)
    running = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
    for i, n in enumerate(running.tolist()):
        head = value[:n]
        value[:n] = (head << np.uint16(8)) ^ _CRC16[(head >> np.uint16(8)) ^ data[at[:n] + i]]
    out = np.empty_like(value)
    out[order] = value
    return out


def _frame_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    lead = (0xFF << (7 - len(tail))) & 0xFF
    return bytes([lead | n, *reversed(tail)])


def _header(number: int, size: int) -> bytes:
    """Sync and fixed blocking; block size, rate 8 kHz; mono, 8 bits; frame number; CRC-8."""
    full = size == BLOCK
    head = bytes([0xFF, 0xF8, (0xC0 if full else 0x70) | 4, 0x02]) + _frame_number(number)
    head += b"" if full else struct.pack(">H", size - 1)
    return head + bytes([crc8(head)])


# -- writing -------------------------------------------------------------------------------


def _fold(e: np.ndarray) -> np.ndarray:
    return (e << 1) ^ (e >> 31)


def _rice_bits(total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best parameter for folded residuals of this sum and count, and about how many bits it takes."""
    k = np.arange(_MOST_K + 1)
    bits = n[:, None] * (k + 1) + (total[:, None] >> k)
    best = bits.argmin(1)
    return best, bits[np.arange(len(n)), best]


def _linear(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames x order) and shifts by Levinson-Durbin, all frames at once."""
    f = x.astype(np.float32)
    lags = np.stack([np.einsum("ij,ij->i", f[:, j:], f[:, : f.shape[1] - j]) for j in range(LPC_ORDER + 1)], 1).astype(np.float64)
    error = lags[:, 0] + 1e-9
    a = np.zeros((len(x), LPC_ORDER))
    for i in range(LPC_ORDER):
        k = (lags[:, i + 1] - (a[:, :i] * lags[:, i:0:-1]).sum(1)) / error
        new = a.copy()
        new[:, i] = k
        new[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a = new
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = np.abs(a).max(1)
    limit = (1 << (LPC_PRECISION - 1)) - 1
    shift = np.clip(np.floor(np.log2(limit / np.maximum(most, 1e-6))), 0, 15).astype(np.int64)
    q = np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int32)
    return q, shift.astype(np.int32)


class _Bits:
    """Codes of up to 32 bits at bit offsets, gathered into bytes."""

    def __init__(self):
        self.at: list[np.ndarray] = []
        self.value: list[np.ndarray] = []
        self.width: list[np.ndarray] = []

    def put(self, at, value, width) -> None:
        at, value, width = np.broadcast_arrays(np.asarray(at, np.int64), np.asarray(value, np.int64), np.asarray(width, np.int64))
        self.at.append(at.ravel())
        self.value.append(value.ravel())
        self.width.append(width.ravel())

    def bytes(self, size: int) -> np.ndarray:
        at, value, width = (np.concatenate(x) for x in (self.at, self.value, self.width))
        order = np.argsort(at, kind="stable")
        at, value, width = at[order], value[order], width[order]
        first = at >> 3
        word = value << (40 - (at & 7) - width)
        starts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        word, first = np.add.reduceat(word, starts), first[starts]  # the bits of codes never meet
        out = np.zeros(size + 5, np.uint8)
        for i in range(5):
            out[first + i] |= ((word >> (32 - 8 * i)) & 0xFF).astype(np.uint8)
        return out[:size]


def _encode_chunk(blocks: list[np.ndarray], numbers: list[int]) -> list[bytes]:
    """Frames for blocks of samples; numbers are their places in their streams."""
    n = np.array([len(b) for b in blocks], np.int64)
    f, width = len(blocks), int(n.max())
    x = np.zeros((f, width), np.int32)
    inside = np.arange(width) < n[:, None]
    x[inside] = np.concatenate(blocks)
    best_bits, kind, k = 8 * n, np.full(f, -1), np.zeros(f, np.int64)  # kind -1: verbatim
    diff = x
    for order in range(5):
        count = n - order
        ok = count > 0
        total = np.where(inside[:, order:], np.abs(diff[:, : width - order] if order else diff), 0).sum(1, dtype=np.int64) * 2
        rice, bits = _rice_bits(total, np.maximum(count, 1))
        better = ok & (bits + 8 * order + 10 < best_bits)
        best_bits, kind, k = np.where(better, bits + 8 * order + 10, best_bits), np.where(better, order, kind), np.where(better, rice, k)
        if width - order <= 1:
            break
        diff = np.diff(diff, axis=1)
    if width > LPC_ORDER:
        coefficients, shift = _linear(x, n)
        predicted = np.zeros((f, width - LPC_ORDER), np.int32)
        for j in range(LPC_ORDER):
            predicted += coefficients[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : width - 1 - j]
        linear = x[:, LPC_ORDER:] - (predicted >> shift[:, None])
        total = np.where(inside[:, LPC_ORDER:], np.abs(linear), 0).sum(1, dtype=np.int64) * 2
        rice, bits = _rice_bits(total, np.maximum(n - LPC_ORDER, 1))
        bits = bits + 8 * LPC_ORDER + 19 + LPC_ORDER * LPC_PRECISION
        better = (n > LPC_ORDER) & (bits < best_bits)
        kind, k = np.where(better, 32, kind), np.where(better, rice, k)
    kind = np.where(((x == x[:, :1]) | ~inside).all(1), -2, kind)  # -2: constant

    heads = [_header(number, int(size)) for number, size in zip(numbers, n, strict=True)]
    # Bits of each frame after its header, as (offset, value, width) within the frame's body.
    e = np.zeros((f, width), np.int32)
    warm = np.zeros(f, np.int64)
    for order in range(5):
        rows = np.flatnonzero(kind == order)
        if len(rows):
            e[rows, order:] = np.diff(x[rows], n=order, axis=1) if order else x[rows]
            warm[rows] = order
    rows = np.flatnonzero(kind == 32)
    if len(rows):
        e[rows, LPC_ORDER:] = linear[rows]
        warm[rows] = LPC_ORDER
    coded = np.flatnonzero(kind >= 0)
    has = (np.arange(width) >= warm[:, None]) & inside
    has[kind < 0] = False
    u = _fold(e)
    kk = k[:, None]
    lengths = np.where(has, (u >> kk) + 1 + kk, 0).astype(np.int64)
    side = np.where(kind == 32, 9 + LPC_ORDER * LPC_PRECISION, 0)
    prelude = np.where(kind >= 0, 8 + 8 * warm + side + 10, 8)
    raw = np.where(kind == -1, 8 * n, np.where(kind == -2, 8, 0))
    body = (prelude + raw + lengths.sum(1) + 7) >> 3
    starts = (np.cumsum(body) - body) * 8
    out = _Bits()
    out.put(starts, np.where(kind == 32, (0x20 | LPC_ORDER - 1) << 1, np.where(kind >= 0, (8 | kind) << 1, np.where(kind == -1, 2, 0))), 8)
    for rows, many in ((np.flatnonzero(kind == -2), 1), (np.flatnonzero(kind == -1), width)):
        if len(rows):
            columns = np.arange(many)
            keep = columns < n[rows, None]
            out.put((starts[rows, None] + 8 + 8 * columns)[keep], (x[rows, :many] & 0xFF)[keep], 8)
    if len(coded):
        for j in range(int(warm[coded].max())):
            rows = coded[warm[coded] > j]
            out.put(starts[rows] + 8 + 8 * j, x[rows, j] & 0xFF, 8)
        rows = np.flatnonzero(kind == 32)
        if len(rows):
            at = starts[rows] + 8 + 8 * LPC_ORDER
            out.put(at, (LPC_PRECISION - 1) << 5 | shift[rows], 9)
            for j in range(LPC_ORDER):
                out.put(at + 9 + j * LPC_PRECISION, coefficients[rows, j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
        out.put(starts[coded] + prelude[coded] - 10, k[coded], 10)  # method 0, one partition, its parameter
        ends = (starts + prelude)[:, None] + np.cumsum(lengths, 1)
        kb = np.broadcast_to(kk, u.shape)[has]
        out.put(ends[has] - kb - 1, (1 << kb) | (u[has] & ((1 << kb) - 1)), kb + 1)
    data = out.bytes(int(body.sum())).tobytes()
    cuts = np.concatenate(([0], np.cumsum(body))).tolist()
    frames = [head + data[a:b] for head, a, b in zip(heads, cuts, cuts[1:], strict=False)]
    return [frame + struct.pack(">H", c) for frame, c in zip(frames, crc16(frames).tolist(), strict=True)]


def _chunks(sizes: list[int]) -> Iterator[list[int]]:
    """Indices from the longest to the shortest, in groups of bounded padded area."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    while order:
        most = max(1, _CHUNK // max(1, sizes[order[0]]))
        yield order[:most]
        order = order[most:]


def encode(payloads: list[bytes]) -> list[bytes]:
    """One stream for each payload."""
    blocks, owner, number = [], [], []
    for i, payload in enumerate(payloads):
        samples = (np.frombuffer(payload, np.uint8).astype(np.int16) - 128).astype(np.int8)
        for j, at in enumerate(range(0, len(samples), BLOCK)):
            blocks.append(samples[at : at + BLOCK])
            owner.append(i)
            number.append(j)
    frames: list[bytes] = [b""] * len(blocks)
    for chunk in _chunks([len(b) for b in blocks]):
        for i, frame in zip(chunk, _encode_chunk([blocks[i] for i in chunk], [number[i] for i in chunk]), strict=True):
            frames[i] = frame
    parts: list[list[int]] = [[] for _ in payloads]
    for i, o in enumerate(owner):
        parts[o].append(i)
    out = []
    for payload, own in zip(payloads, parts, strict=True):
        pcm = bytes(payload).translate(_FLIP)
        sizes = [len(frames[i]) for i in own]
        points, offset = [], 0
        for i, size in zip(own, sizes, strict=True):
            points.append(struct.pack(">QQH", number[i] * BLOCK, offset, len(blocks[i])))
            offset += size
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(pcm)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
        table = b"".join(points)
        meta = b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table
        out.append(b"".join([b"fLaC", meta, *(frames[i] for i in own)]))
    return out


#: Unsigned bytes to the two's complement of byte - 128, and back.
_FLIP = bytes(b ^ 0x80 for b in range(256))


# -- reading -------------------------------------------------------------------------------


class Stream(NamedTuple):
    samples: int
    md5: bytes
    points: list[tuple[int, int, int]]  # first sample, byte offset in the stream, samples


def parse(stream: bytes) -> Stream:
    """Metadata of a stream; points hold every frame."""
    if stream is None or stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, samples, md5, points = 4, False, 0, b"", []
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
                raise ValueError("not 8-bit mono")
            samples, md5 = packed & ((1 << 36) - 1), block[18:34]
        elif kind == 3:
            points = list(struct.iter_unpack(">QQH", block))
    found = [(first, at + offset, count) for first, offset, count in points if first != _PLACEHOLDER]
    if sum(count for *_, count in found) != samples:
        found = _search(stream, at)
    return Stream(samples, md5, found)


def _search(stream: bytes, at: int) -> list[tuple[int, int, int]]:
    """Frames of a stream without a whole seek table: each ends where its CRC-16 holds and another begins, or the stream ends."""
    heads = [m.start() for m in re.finditer(rb"\xff[\xf8\xf9]", stream) if m.start() >= at]
    points, first = [], 0
    while at < len(stream):
        size = _body(stream[at : at + 32])[1]
        ends = (end for end in (*heads, len(stream)) if end > at + 8 and int.from_bytes(stream[end - 2 : end], "big") == crc16([stream[at : end - 2]])[0])
        end = next(ends, None)
        if end is None:
            raise ValueError("a frame without an end")
        points.append((first, at, size))
        first, at = first + size, end
    return points


def _body(frame: bytes) -> tuple[int, int]:
    """Where the subframe begins, and the block size; checks the header's CRC-8."""
    if frame[0] != 0xFF or frame[1] & 0xFE != 0xF8:
        raise ValueError("no frame here")
    at = 5
    if frame[4] & 0x80:
        at += 8 - (frame[4] ^ 0xFF).bit_length() - 1
    code = frame[2] >> 4
    if code == 6:
        size, at = frame[at] + 1, at + 1
    elif code == 7:
        size, at = int.from_bytes(frame[at : at + 2], "big") + 1, at + 2
    elif code >= 8:
        size = 256 << (code - 8)
    else:
        size = 192 if code == 1 else 576 << (code - 2)
    if crc8(frame[:at]) != frame[at]:
        raise ValueError("damaged frame header")
    return at + 1, size


def _peek(data: bytes, bit: int, width: int) -> int:
    """An unsigned number of ``width`` bits at bit offset ``bit``."""
    end = bit + width
    word = int.from_bytes(data[bit >> 3 : (end + 7) >> 3], "big")
    return word >> (-end % 8) & ((1 << width) - 1)


def _signed(value: int, width: int) -> int:
    return value - (1 << width) if value >> (width - 1) else value


def _decode_chunk(frames: list[bytes]) -> list[np.ndarray]:
    """Samples (int8) of each frame."""
    for frame, stored in zip(frames, crc16([f[:-2] for f in frames]).tolist(), strict=True):
        if int.from_bytes(frame[-2:], "big") != stored:
            raise ValueError("damaged frame")
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(frames)
    coded = []  # frame, size, order, linear coefficients and shift, first sample's bit, partitions
    for i, frame in enumerate(frames):
        at, size = _body(frame)
        kind = frame[at] >> 1 & 0x3F
        if frame[at] & 0x81:
            raise ValueError("wasted bits are not used in 8-bit streams here")
        at += 1
        if kind == 0:
            out[i] = np.full(size, frame[at], np.uint8).view(np.int8)
        elif kind == 1:
            out[i] = np.frombuffer(frame, np.int8, size, at)
        else:
            order = kind & 7 if kind < 32 else (kind & 31) + 1
            warm = [_signed(b, 8) for b in frame[at : at + order]]
            bit, filters, shift = 8 * (at + order), None, 0
            if kind >= 32:
                precision = _peek(frame, bit, 4) + 1
                shift = _peek(frame, bit + 4, 5)
                filters = [_signed(_peek(frame, bit + 9 + j * precision, precision), precision) for j in range(order)]
                bit += 9 + order * precision
            method, partition = _peek(frame, bit, 2), _peek(frame, bit + 2, 4)
            coded.append((i, size, order, warm, filters, shift, bit + 6, 4 + method, size >> partition))
    if not coded:
        return out
    coded.sort(key=lambda c: c[2] - c[1])  # most residuals first
    sizes = np.array([len(frames[c[0]]) for c in coded], np.int64)
    base = (np.cumsum(sizes) - sizes) * 8
    data = np.frombuffer(b"".join(frames[c[0]] for c in coded) + bytes(8), np.uint8)
    bits = np.unpackbits(data)
    ones = np.flatnonzero(bits)
    before = np.cumsum(bits, dtype=np.int32)  # ones up to and with a bit; the next one after it has this rank
    counts = np.array([c[1] - c[2] for c in coded], np.int64)
    f, most = len(coded), int(counts[0])
    unary = np.zeros((most, f), np.int32)  # length of the zeros before the stop bit
    stop = np.zeros((most, f), np.int64)
    rice = np.zeros((most, f), np.uint8)
    at = base + np.array([c[6] for c in coded])
    fields = np.array([c[7] for c in coded], np.int64)
    part = np.array([c[8] for c in coded], np.int64)
    orders = np.array([c[2] for c in coded], np.int64)
    word = data[:-3].astype(np.uint32) << np.uint32(24)
    word |= data[1:-2].astype(np.uint32) << np.uint32(16)
    word |= data[2:-1].astype(np.uint32) << np.uint32(8)
    word |= data[3:]
    k = np.zeros(f, np.int64)
    single = bool((part == counts + orders).all())
    running = np.searchsorted(-counts, -np.arange(1, most + 1), side="right").tolist()
    for i, a in enumerate(running):
        if i == 0 or not single:
            # A partition opens with its parameter; the first is shorter by the predictor's order.
            new = np.flatnonzero((i + orders[:a]) % part[:a] == 0) if i else np.arange(a)
            if len(new):
                k[new] = _read(word, at[new], fields[new])
                if (k[new] == (1 << fields[new]) - 1).any():
                    raise ValueError("unencoded partitions are not written here")
                at[new] += fields[new]
        here = at[:a]
        end = ones[before[here - 1]]
        unary[i, :a] = end - here
        stop[i, :a] = end
        rice[i, :a] = k[:a]
        at[:a] = end + k[:a] + 1
    width = rice.astype(np.int64)
    rest = np.where(width > 0, _read(word, stop + 1, np.maximum(width, 1)), 0)
    u = (unary.astype(np.int64) << width) | rest
    e = ((u >> 1) ^ -(u & 1)).astype(np.int32)
    ends = base + sizes * 8
    if (at > ends).any():
        raise ValueError("residuals run past their frame")
    linear = [j for j, c in enumerate(coded) if c[4]]
    for order in range(5):
        rows = [j for j, c in enumerate(coded) if not c[4] and c[2] == order]
        if rows:
            top = int(counts[rows].max())
            seq = e[:top, rows]
            warm = np.array([coded[j][3] for j in rows], np.int32).reshape(len(rows), order)
            for level in range(order, 0, -1):
                first = np.diff(warm, n=level - 1, axis=1)[:, 0]
                seq = np.cumsum(np.vstack((first[None], seq)), axis=0, dtype=np.int32)
            for column, j in enumerate(rows):  # the first of each level stood one sample earlier, at last at 0
                out[coded[j][0]] = seq[: counts[j] + order, column].astype(np.int8)
    for order in {coded[j][2] for j in linear}:
        rows = [j for j in linear if coded[j][2] == order]
        filters = np.array([coded[j][4] for j in rows], np.int32).T
        shift = np.array([coded[j][5] for j in rows], np.int32)
        top = int(counts[rows].max())
        x = np.zeros((top + order, len(rows)), np.int32)
        x[:order] = np.array([coded[j][3] for j in rows], np.int32).T
        own = e[:top, rows]
        alive = np.searchsorted(-counts[rows], -np.arange(1, top + 1), side="right").tolist()
        for i, a in enumerate(alive):
            predicted = filters[0, :a] * x[i + order - 1, :a]
            for j in range(1, order):
                predicted += filters[j, :a] * x[i + order - 1 - j, :a]
            x[i + order, :a] = own[i, :a] + (predicted >> shift[:a])
        for column, j in enumerate(rows):
            out[coded[j][0]] = x[: counts[j] + order, column].astype(np.int8)
    return out


def _read(word: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Numbers of up to 24 bits at bit offsets; ``word`` has 32 bits from each byte on."""
    return ((word[at >> 3] << (at & 7).astype(np.uint32)) >> (32 - width).astype(np.uint32)).astype(np.int64)


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(frames)
    # The block size is unknown before the header is read; compressed size stands in for it.
    for chunk in _chunks([len(f) for f in frames]):
        for i, samples in zip(chunk, _decode_chunk([frames[i] for i in chunk]), strict=True):
            out[i] = samples
    return out


def _frames(stream: bytes, info: Stream) -> list[bytes]:
    cuts = [offset for _, offset, _ in info.points] + [len(stream)]
    return [stream[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream, with every checksum verified."""
    infos = [parse(s) for s in streams]
    frames = [_frames(s, i) for s, i in zip(streams, infos, strict=True)]
    samples = iter(decode_frames([f for own in frames for f in own]))
    out = []
    for info, own in zip(infos, frames, strict=True):
        pcm = b"".join(next(samples).tobytes() for _ in own)
        if len(pcm) != info.samples or hashlib.md5(pcm).digest() != info.md5:
            raise ValueError("the stream's samples don't match its digest")
        out.append(pcm.translate(_FLIP))
    return out


def read_samples(stream: bytes, start: int, count: int) -> bytes:
    """Bytes ``start`` to ``start + count`` of the payload, from the frames that hold them."""
    info = parse(stream)
    frames = _frames(stream, info)
    held = [i for i, (first, _, n) in enumerate(info.points) if first < start + count and start < first + n]
    if not held:
        return b""
    pcm = b"".join(s.tobytes() for s in decode_frames([frames[i] for i in held]))
    skip = start - info.points[held[0]][0]
    return pcm.translate(_FLIP)[skip : skip + count]


# -- tables --------------------------------------------------------------------------------


def padded(text: str | None, unit: int = 64) -> bytes:
    """UTF-8 bytes of a text, filled with zero bytes to a positive multiple of ``unit``."""
    data = (text or "").encode()
    return data + bytes(-len(data) % unit or (0 if data else unit))


def _groups(items: list[bytes], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, item in enumerate(items):
        if size and size + len(item) > most:
            yield begin, i
            begin, size = i, 0
        size += len(item)
    if begin < len(items):
        yield begin, len(items)


def encode_column(df: DataFrame, payload_col: str, flac_col: str = "flac") -> DataFrame:
    """``df`` with ``payload_col`` replaced by the stream of its bytes; a null payload has no samples."""
    names = [n for n in df.columns if n not in (payload_col, flac_col)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [x or b"" for x in batch.column(payload_col).to_pylist()]
            for a, b in _groups(payloads):
                streams = pa.array(encode(payloads[a:b]), pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(a, b - a) for n in names), streams], [*names, flac_col])

    schema = StructType([*(df.schema[n] for n in names), StructField(flac_col, BinaryType())])
    return arrow(df, run, schema)


def decoded_column(df: DataFrame, flac_col: str, columns: str, describe: Callable[[bytes, bytes], tuple]) -> DataFrame:
    """``df`` with ``flac_col`` replaced by ``columns``, what ``describe`` tells of (stream, payload read back)."""
    own = StructType.fromDDL(columns)
    names = [n for n in df.columns if n not in (flac_col, *own.names)]
    kinds = to_arrow_schema(own)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = batch.column(flac_col).to_pylist()
            for a, b in _groups(streams):
                rows = [describe(s, p) for s, p in zip(streams[a:b], decode(streams[a:b]), strict=True)]
                made = [pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(a, b - a) for n in names), *made], [*names, *own.names])

    return arrow(df, run, StructType([*(df.schema[n] for n in names), *own.fields]))


def pcm_blocks(df: DataFrame, flac_col: str, id_col: str, block: int = BLOCK) -> DataFrame:
    """(id, block, sample_offset, n_samples, pcm): decoded samples in blocks that can be sought.

    The id's column may not have the name of another of these.
    """
    if id_col in ("block", "sample_offset", "n_samples", "pcm"):
        raise ValueError(f"the ids cannot be in a column {id_col}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams, ids = batch.column(flac_col).to_pylist(), batch.column(id_col)
            for a, b in _groups(streams):
                rows = []
                for i, payload in zip(range(a, b), decode(streams[a:b]), strict=True):
                    pcm = payload.translate(_FLIP)
                    rows += [(i, n, at, pcm[at : at + block]) for n, at in enumerate(range(0, len(pcm), block))]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([len(r[3]) for r in rows], pa.int64()),
                        pa.array([r[3] for r in rows], pa.binary()),
                    ],
                    [id_col, "block", "sample_offset", "n_samples", "pcm"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, block long, sample_offset long, n_samples long, pcm binary"
    return arrow(df.select(id_col, flac_col), run, schema)


def features(payload: bytes) -> str:
    """Mean, root mean square and share of sign changes of the samples, to four places."""
    if not payload:
        return "mean=0.0000;rms=0.0000;zcr=0.0000"
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    signs = x < 0
    crossings = float((signs[1:] != signs[:-1]).mean()) if len(x) > 1 else 0.0
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};zcr={crossings:.4f}"
