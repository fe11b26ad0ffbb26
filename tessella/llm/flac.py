"""FLAC as a media column: 8-bit mono streams, encoded and decoded in numpy.

Both directions work on many frames at once, in lock step: a step handles one Rice code, one predicted sample or one
checksum byte of every frame.  Streams carry STREAMINFO with the MD5 of the samples and a SEEKTABLE with one point for
each frame, so a reader finds the byte of any sample offset.  Decoding checks every frame's CRC-8 and CRC-16, its
number and the stream's MD5, and raises ``ValueError`` where one is wrong.

Texts become payloads as UTF-8, null being empty, with bytes 0 appended up to a positive multiple of 64; sample =
byte - 128.  Equal payloads give equal streams.  Repeated rows are stored for themselves; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, steps

BLOCK, RATE = 1024, 8000
#: Frames that one pass holds, which bounds memory however long a text is.
LANES, ENCODED_LANES = 2048, 512
#: Order and coefficient precision of the encoder's own predictor, besides the fixed ones.
LPC_ORDER, LPC_BITS = 4, 8
#: Coefficients of the format's fixed predictors.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint32)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_LEADING = np.array([16 - int(i).bit_length() for i in range(65536)], np.uint8)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16(buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges of one buffer, a byte of each at a time."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    left = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
    c = np.zeros(len(size), np.uint32)
    for i in range(len(left)):
        n = left[i]
        head = c[:n]
        c[:n] = ((head << 8) & 0xFFFF) ^ _CRC16[(head >> 8) ^ buffer[start[:n] + i]]
    out = np.empty_like(c)
    out[order] = c
    return out


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes((-len(raw)) % 64 or (0 if raw else 64)), len(raw)


def _number(n: int) -> bytes:
    """A frame number in the format's UTF-8-like code."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    lead = (0xFF << (8 - size)) & 0xFF
    tail = []
    for _ in range(size - 1):
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
    return bytes([lead | n, *tail[::-1]])


def _frame_header(number: int, samples: int) -> bytes:
    code, extra = (10, b"") if samples == BLOCK else ((6, bytes([samples - 1])) if samples <= 256 else (7, (samples - 1).to_bytes(2, "big")))
    head = bytes([0xFF, 0xF8, code << 4 | 4, 1 << 1]) + _number(number) + extra
    return head + bytes([crc8(head)])


def _predictors(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors of each row by Levinson's recursion: coefficients and shifts."""
    f = x.astype(np.float64)
    auto = np.stack([(f[:, lag:] * f[:, : f.shape[1] - lag]).sum(axis=1) for lag in range(LPC_ORDER + 1)], axis=1)
    error = auto[:, 0] * (1 + 1e-6) + 1e-6
    a = np.zeros((len(x), LPC_ORDER))
    for m in range(LPC_ORDER):
        reflect = (auto[:, m + 1] - (a[:, :m] * auto[:, m:0:-1]).sum(axis=1)) / error
        a[:, :m], a[:, m] = a[:, :m] - reflect[:, None] * a[:, :m][:, ::-1], reflect
        error = np.maximum(error * (1 - reflect**2), 1e-6)
    most = np.abs(a).max(axis=1)
    shift = np.clip(LPC_BITS - 2 - np.floor(np.log2(np.maximum(most, 1e-9))).astype(np.int64), 0, 15)
    limit = 1 << (LPC_BITS - 1)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int32), shift.astype(np.int32)


def _residual(x: np.ndarray, coefficients: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x minus its prediction; the first ``order`` columns are x itself."""
    order = coefficients.shape[1]
    out = x.copy()
    if order:
        guess = np.zeros((len(x), x.shape[1] - order), x.dtype)
        for j in range(order):
            guess += coefficients[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j]
        out[:, order:] -= guess >> shift[:, None]
    return out


def _encode_lanes(x: np.ndarray, size: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of the rows of x (samples from -128 to 127, row i is size[i] long and 0 beyond)."""
    lanes, place = len(x), np.arange(x.shape[1])
    inside = place < size[:, None]
    lpc, lpc_shift = _predictors(x, size)
    none = np.zeros(lanes, np.int32)
    options = [(8 | o, np.tile(np.array(FIXED[o], np.int32), (lanes, 1)), none) for o in range(3)] + [(32 | (LPC_ORDER - 1), lpc, lpc_shift)]
    best_bits = np.full(lanes, np.iinfo(np.int64).max)
    kind, rice = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    best = np.zeros(x.shape, np.int32)
    for code, coefficients, shift in options:
        order = coefficients.shape[1]
        e = _residual(x, coefficients, shift)
        u = np.where(inside & (place >= order), (e << 1) ^ (e >> 31), 0)
        n = size - order
        guess = np.maximum(0, np.floor(np.log2(np.maximum(u.sum(axis=1) / n, 1))).astype(np.int64))
        for k in (np.maximum(guess - 1, 0), guess):
            bits = n * (k + 1) + (u >> k[:, None].astype(np.int32)).sum(axis=1) + 8 * order + (9 + LPC_BITS * order if code & 32 else 0)
            better = bits < best_bits
            best_bits, kind, rice = np.where(better, bits, best_bits), np.where(better, code, kind), np.where(better, k, rice)
            best[better] = u[better]
    flat = (x == x[:, :1]) | ~inside
    kind = np.where(flat.all(axis=1), 0, np.where(best_bits >= 8 * size, 1, kind))
    order = np.where(kind & 32, (kind & 31) + 1, np.where(kind & 8, kind & 7, 0))

    heads = [_frame_header(n, int(s)) for n, s in zip(numbers, size)]
    head = np.array([len(h) for h in heads])
    at = np.zeros(lanes, np.int64)  # bits after the header
    fields: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def put(rows: np.ndarray, value: np.ndarray | int, width: int) -> None:
        fields.append((rows, at[rows].copy(), np.broadcast_to(value, rows.shape) & ((1 << width) - 1), np.full(len(rows), width)))
        at[rows] += width

    every = np.arange(lanes)
    put(every, kind << 1, 8)
    put(np.flatnonzero(kind == 0), x[kind == 0, 0], 8)
    predicted = np.flatnonzero(kind >= 8)
    for i in range(LPC_ORDER):
        rows = predicted[order[predicted] > i]
        put(rows, x[rows, i], 8)
    rows = np.flatnonzero(kind & 32)
    put(rows, LPC_BITS - 1, 4)
    put(rows, lpc_shift[rows], 5)
    for i in range(LPC_ORDER):
        put(rows, lpc[rows, i], LPC_BITS)
    put(predicted, 0, 6)  # four-bit parameters, one partition
    put(predicted, rice[predicted], 4)
    for which in (np.flatnonzero(kind == 1), predicted):
        if not len(which):
            continue
        coded = inside[which] & (place >= order[which, None])
        if which is predicted:
            k = rice[which, None].astype(np.int32)
            value, zeros = (1 << k) | (best[which] & ((1 << k) - 1)), best[which] >> k
            width = np.where(coded, zeros + 1 + k, 0)
            own = k + 1
        else:
            value, width, own = x[which] & 0xFF, np.where(coded, 8, 0), np.full((len(which), 1), 8)
        ends = np.cumsum(width, axis=1)
        lane = np.broadcast_to(which[:, None], coded.shape)[coded]
        fields.append((lane, (at[which][:, None] + ends - own)[coded], value[coded], np.broadcast_to(own, coded.shape)[coded]))
        at[which] += ends[:, -1]
    body = head + (at + 7) // 8
    start = np.concatenate([[0], np.cumsum(body + 2)])
    buffer = np.zeros(int(start[-1]) + 8, np.float64)
    lane, bit, value, width = (np.concatenate([f[i] for f in fields]) for i in range(4))
    bit = bit + 8 * (start[:-1] + head)[lane]
    wide = value.astype(np.uint32) << (32 - width - (bit & 7)).astype(np.uint32)
    byte = bit >> 3
    for b in range(4):
        buffer += np.bincount(byte + b, (wide >> np.uint32(24 - 8 * b)) & np.uint32(0xFF), len(buffer))
    raw = buffer.astype(np.uint8)
    for h, s in zip(heads, start):
        raw[s : s + len(h)] = np.frombuffer(h, np.uint8)
    check = crc16(raw, start[:-1], body)
    raw[start[:-1] + body], raw[start[:-1] + body + 1] = check >> 8, check & 0xFF
    return [raw[a:b].tobytes() for a, b in zip(start[:-1], start[1:])]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length must be at least 16."""
    lanes = [(i, k, at) for i, p in enumerate(payloads) for k, at in enumerate(range(0, len(p), BLOCK))]
    frames: list[list[bytes]] = [[] for _ in payloads]
    for lo in range(0, len(lanes), ENCODED_LANES):
        part = lanes[lo : lo + ENCODED_LANES]
        size = np.array([min(BLOCK, len(payloads[i]) - at) for i, _, at in part])
        x = np.zeros((len(part), BLOCK), np.int32)
        for row, (i, _, at) in enumerate(part):
            x[row, : size[row]] = np.frombuffer(payloads[i], np.uint8, int(size[row]), at).astype(np.int32) - 128
        for (i, _, _), frame in zip(part, _encode_lanes(x, size, [k for _, k, _ in part])):
            frames[i].append(frame)
    out = []
    for p, own in zip(payloads, frames):
        sizes = [len(f) for f in own]
        samples = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + md5(samples).digest()
        seek, offset = [], 0
        for k, n in enumerate(sizes):
            seek.append((k * BLOCK).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(BLOCK, len(p) - k * BLOCK).to_bytes(2, "big"))
            offset += n
        table = b"".join(seek)
        # A metadata block holds at most 2**24 - 1 bytes; beyond that the table goes on in every second, fourth, ... frame.
        while len(table) >= 1 << 24:
            seek = seek[::2]
            table = b"".join(seek)
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


@dataclass
class Frame:
    sample: int
    byte: int
    size: int
    samples: int


def _header(stream: bytes, at: int) -> tuple[int, int, int]:
    """Frame number, samples and header size of the frame at a byte; checks the CRC-8."""
    if stream[at] != 0xFF or stream[at + 1] != 0xF8:
        raise ValueError(f"no frame at byte {at}")
    code, lead, pos = stream[at + 2] >> 4, stream[at + 4], at + 5
    number = lead
    if lead & 0x80:
        size = 8 - (lead ^ 0xFF).bit_length()
        number = lead & ((1 << (7 - size)) - 1)
        for _ in range(size - 1):
            number = number << 6 | stream[pos] & 0x3F
            pos += 1
    if code == 6:
        samples, pos = stream[pos] + 1, pos + 1
    elif code == 7:
        samples, pos = int.from_bytes(stream[pos : pos + 2], "big") + 1, pos + 2
    elif code >= 8:
        samples = 256 << (code - 8)
    else:
        samples = 192 if code == 1 else 576 << (code - 2)
    if stream[at + 3] != 2 or stream[at + 2] & 15 != 4:
        raise ValueError("only 8-bit mono streams at the fixed rate are read")
    if crc8(stream[at:pos]) != stream[pos]:
        raise ValueError(f"header checksum of the frame at byte {at}")
    return number, samples, pos + 1 - at


def index(stream: bytes) -> tuple[list[Frame], int, bytes]:
    """Frames of a stream from its seek table, the number of samples, and their MD5."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, points, total, digest = 4, [], 0, b""
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            total, digest = int.from_bytes(body[10:18], "big") & (1 << 36) - 1, body[18:34]
        elif kind & 0x7F == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
        at += 4 + size
        if kind & 0x80:
            break
    starts = [at + p[1] for p in points] + [len(stream)]
    return [Frame(p[0], a, b - a, p[2]) for p, a, b in zip(points, starts, starts[1:])], total, digest


def _decode_lanes(streams: list[bytes], lanes: list[tuple[int, Frame]]) -> list[np.ndarray]:
    start = np.concatenate([[0], np.cumsum([f.size for _, f in lanes])])
    buffer = np.frombuffer(b"".join(streams[i][f.byte : f.byte + f.size] for i, f in lanes) + bytes(8), np.uint8)
    body = np.diff(start) - 2
    check = crc16(buffer, start[:-1], body)
    if (check != buffer[start[:-1] + body].astype(np.uint32) * 256 + buffer[start[:-1] + body + 1]).any():
        raise ValueError("frame checksum")
    heads = [_header(streams[i], f.byte) for i, f in lanes]
    size = np.array([h[1] for h in heads])
    first = start[:-1] + np.array([h[2] for h in heads])
    order_ = np.lexsort((-size, buffer[first] < 16))  # frames with a predictor first, long ones before short ones
    size, pos = size[order_], 8 * first[order_]
    wide = buffer.astype(np.uint32)
    window = (wide[:-4] << 24) | (wide[1:-3] << 16) | (wide[2:-2] << 8) | wide[3:-1]

    def read(rows: np.ndarray | slice, bits: np.ndarray | int, signed: bool = False) -> np.ndarray:
        """Up to 24 bits of each row."""
        p = pos[rows]
        w = window[p >> 3] << (p & 7).astype(np.uint32)
        n = np.broadcast_to(np.asarray(bits, np.int64), p.shape)
        value = ((w >> np.uint32(1)) >> (31 - n).astype(np.uint32)).astype(np.int64)
        pos[rows] += n
        return np.where(value >> np.maximum(n - 1, 0) & 1, value - (1 << n), value) if signed else value

    every = np.arange(len(lanes))
    kind = read(every, 8) >> 1
    order = np.where(kind & 32, (kind & 31) + 1, np.where(kind & 8, kind & 7, 0))
    width = int(size.max())
    x = np.zeros((width, len(lanes)), np.int32)
    most = int(order.max(initial=0))
    coefficients, shift = np.zeros((max(most, 1), len(lanes)), np.int32), np.zeros(len(lanes), np.int32)
    rows = np.flatnonzero(kind == 0)
    x[:, rows] = read(rows, 8, True)
    for i in range(most):
        rows = np.flatnonzero(order > i)
        x[i, rows] = read(rows, 8, True)
    for o in range(1, 5):
        rows = np.flatnonzero((kind & 40) == 8)
        rows = rows[order[rows] == o]
        if rows.size:
            coefficients[:o, rows] = np.array(FIXED[o])[:, None]
    rows = np.flatnonzero(kind & 32)
    if len(rows):
        precision = read(rows, 4) + 1
        shift[rows] = read(rows, 5)
        for i in range(most):
            own = order[rows] > i
            coefficients[i, rows[own]] = read(rows[own], precision[own], True)
    coded = int(np.count_nonzero(kind >= 8))
    for i in range(width):  # frames without a predictor
        rows = coded + np.flatnonzero((kind[coded:] == 1) & (size[coded:] > i))
        if not rows.size:
            break
        x[i, rows] = read(rows, 8, True)
    method, parts = read(np.arange(coded), 2), read(np.arange(coded), 4)
    share = size[:coded] >> parts
    k, raw, boundary = np.zeros(coded, np.uint32), np.zeros(coded, bool), np.zeros(coded, np.int64)
    left = np.searchsorted(-size[:coded], -np.arange(width), side="left")
    some_raw, due_at = False, 0
    for i in range(int(size[:coded].max(initial=0))):
        n = left[i]
        if i >= due_at or i <= most:
            due = np.flatnonzero((boundary[:n] <= i) & (order[:n] <= i))
            if due.size:
                bits = 4 + method[due]
                k[due] = read(due, bits)
                raw[due] = k[due] == (1 << bits) - 1
                if raw[due].any():
                    own = due[raw[due]]
                    k[own] = read(own, 5)
                some_raw = bool(raw.any())
                boundary[due] = (i // share[due] + 1) * share[due]
            due_at = int(boundary[:n].min()) if n else width
        if i >= most and not some_raw:
            rows = slice(0, n)
        else:
            rows = np.flatnonzero((order[:n] <= i) & ~raw[:n])
            own = np.flatnonzero((order[:n] <= i) & raw[:n])
            if own.size:
                x[i, own] = read(own, k[own], True)
        p, kk = pos[rows], k[rows]
        w = window[p >> 3] << (p & 7).astype(np.uint32)
        run = _LEADING[w >> np.uint32(16)]
        more = np.flatnonzero(run == 16)
        if more.size:
            run, p = run.astype(np.int64), p.copy()
            while more.size:
                p[more] += 16
                w[more] = window[p[more] >> 3] << (p[more] & 7).astype(np.uint32)
                further = _LEADING[w[more] >> np.uint32(16)]
                run[more] += further
                more = more[further == 16]
            zeros = run % 16
        else:
            zeros = run
        low = ((w << (zeros.astype(np.uint32) + np.uint32(1))) >> np.uint32(1)) >> (np.uint32(31) - kk)
        pos[rows] += run + (kk + np.uint32(1))
        u = ((run.astype(np.uint32) << kk) | low).view(np.int32)
        x[i, rows] = (u >> 1) ^ -(u & 1)
    if (((pos + 7) >> 3) != (start[:-1] + body)[order_]).any():
        raise ValueError("a frame does not end where its residuals end")
    lead = np.flatnonzero(order > 0)
    if lead.size:
        y, c, s, first = np.ascontiguousarray(x[:, lead]), coefficients[:, lead], shift[lead], order[lead]
        for i in range(1, width):
            guess = c[0] * y[i - 1]
            for j in range(1, min(most, i)):
                guess += c[j] * y[i - 1 - j]
            y[i] += np.where(first <= i, guess >> s, 0)
        x[:, lead] = y
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(lanes)
    pcm = (x.T + 128).astype(np.uint8)
    for row, lane in enumerate(order_):
        out[lane] = pcm[row, : size[row]]
    for (_, f), (number, samples, _) in zip(lanes, heads):
        if number * BLOCK != f.sample or samples != f.samples:
            raise ValueError("the seek table and a frame differ")
    return out


def decode(streams: list[bytes]) -> list[list[tuple[Frame, bytes]]]:
    """PCM blocks of each stream, as unsigned bytes, with the frames that they come from."""
    plans = [index(s) for s in streams]
    lanes = [(i, f) for i, (frames, _, _) in enumerate(plans) for f in frames]
    out: list[list[tuple[Frame, bytes]]] = [[] for _ in streams]
    for lo in range(0, len(lanes), LANES):
        part = lanes[lo : lo + LANES]
        for (i, f), pcm in zip(part, _decode_lanes(streams, part)):
            out[i].append((f, pcm.tobytes()))
    for blocks, (_, total, digest) in zip(out, plans):
        pcm = np.frombuffer(b"".join(b for _, b in blocks), np.uint8)
        if len(pcm) != total or md5((pcm ^ 128).tobytes()).digest() != digest:
            raise ValueError("the samples differ from the stream's MD5")
    return out


def read_samples(stream: bytes, start: int, stop: int) -> bytes:
    """Samples ``start`` to ``stop`` of a stream, as unsigned bytes, from the frames alone that hold them.

    The seek table finds the frames, whose own checksums are checked; the stream's MD5 needs all of it and is not.
    Bounds beyond the stream's ends are drawn to them.
    """
    frames, total, _ = index(stream)
    start, stop = max(0, start), min(stop, total)
    wanted = [f for f in frames if f.sample < stop and f.sample + f.samples > start]
    out = []
    for lo in range(0, len(wanted), LANES):
        part = [(0, f) for f in wanted[lo : lo + LANES]]
        out += [pcm.tobytes() for pcm in _decode_lanes([stream], part)]
    if not wanted:
        return b""
    return b"".join(out)[start - wanted[0].sample : stop - wanted[0].sample]


def feature(pcm: bytes) -> str:
    """Level, loudness, zero crossings and peak of 8-bit samples, as text."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max(initial=0))}"


def _encoded(batches):
    for batch in batches:
        for part, texts in steps(batch, "text"):
            pairs = [payload(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")), pa.array([n for _, n in pairs], pa.int64()), pa.array(encode([p for p, _ in pairs]), pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )


def flac_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the unpadded text) and media, the FLAC stream, of every row of (doc_id, text)."""
    return map_arrow(docs.select("doc_id", "text"), _encoded, "doc_id long, n_bytes long, media binary")


def _some(batch: pa.RecordBatch, most: int = 2_000_000):
    streams = batch.column(batch.schema.get_field_index("media")).to_pylist()
    first, size = 0, 0
    for i, s in enumerate(streams):
        if i > first and size + len(s) > most:
            yield batch.slice(first, i - first), streams[first:i]
            first, size = i, 0
        size += len(s)
    if first < len(streams):
        yield batch.slice(first), streams[first:]


def _blocks(batches):
    names = ["doc_id", "block", "sample_offset", "byte_offset", "n_samples", "pcm"]
    for batch in batches:
        for part, streams in _some(batch):
            ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
            rows = [(i, k, f.sample, f.byte, f.samples, pcm) for i, blocks in zip(ids, decode(streams)) for k, (f, pcm) in enumerate(blocks)]
            types = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """Decoded blocks of (doc_id, media): block number, offset in samples and in the stream's bytes, samples, PCM."""
    return map_arrow(media.select("doc_id", "media"), _blocks, "doc_id long, block long, sample_offset long, byte_offset long, n_samples long, pcm binary")


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long"


def _digests(batches):
    for batch in batches:
        for part, streams in _some(batch):
            rows = []
            for s, blocks in zip(streams, decode(streams)):
                pcm = b"".join(b for _, b in blocks)
                rows.append((len(pcm), sha256(pcm).hexdigest(), zlib.crc32(pcm[-64:]), len(s), sha256(s).hexdigest(), feature(pcm), len(blocks)))
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("n_bytes")), *(pa.array(c) for c in zip(*rows))],
                names=[x.split()[0] for x in _DIGEST.split(", ")],
            )


def media_digests(media: DataFrame) -> DataFrame:
    """Digests of every row of (doc_id, n_bytes, media), all taken from the decoded blocks of the stored stream."""
    return map_arrow(media.select("doc_id", "n_bytes", "media"), _digests, _DIGEST)
