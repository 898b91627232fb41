"""FLAC as a media column: decoding to PCM blocks with sample offsets, and a plain encoder.

Frames are decoded side by side: one numpy step reads the next Rice code of every frame at hand.
Every frame's header is held against its CRC-8 and the frame against its CRC-16, the whole stream
against the MD5 of its samples. Frame bounds come from the frames themselves, so a stream needs no
seek table; the blocks found carry their sample and byte offsets and so are one.

Defined results: a null stream gives no blocks; what isn't FLAC, or fails a checksum, raises
FlacError that names the fault; an empty stream (no samples) gives no blocks; equal bytes give
equal results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import arrow_map, column, runs, utf8

#: Samples of an encoded frame; bytes of frames decoded side by side; predictor order and coefficient bits of the encoder.
BLOCK, GROUP_BYTES, ORDER, PRECISION = 4096, 5_000_000, 4, 12
PAD = 64


class FlacError(ValueError):
    pass


def crc_table(poly: int, bits: int, step: int) -> np.ndarray:
    """For every value of the register's upper step bits, what step shifts make of it."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    reg = (np.arange(1 << step, dtype=np.int64) << (bits - step)) & mask
    for _ in range(step):
        reg = ((reg << 1) ^ np.where(reg & top, poly, 0)) & mask
    return reg


_CRC8 = crc_table(0x07, 8, 8).astype(np.uint8).tolist()
_CRC16 = crc_table(0x8005, 16, 16).astype(np.uint16)
#: Leading zeros of 16 bits.
_ZEROS = (16 - np.frexp(np.arange(1 << 16).astype(float))[1]).astype(np.int64)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(frames: list[bytes]) -> np.ndarray:
    """CRC-16 of each frame, two bytes a step for all frames. Zeros before a frame change nothing."""
    if not frames:
        return np.zeros(0, np.uint16)
    longest = max(map(len, frames)) + 1 & ~1
    grid = np.frombuffer(b"".join([f.rjust(longest, b"\0") for f in frames]), ">u2").reshape(len(frames), -1).T.astype(np.uint16)
    c = np.zeros(len(frames), np.uint16)
    for words in grid:
        c = _CRC16[c ^ words]
    return c


def coded_number(n: int) -> bytes:
    """A frame or sample number in the variable-length code that extends UTF-8 to 36 bits."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >= 1 << (6 * more + (6 - more if more < 6 else 0)):
        more += 1
    lead = (0xFF << (7 - more)) & 0xFF
    return bytes([lead | (n >> (6 * more)), *(0x80 | (n >> (6 * k)) & 0x3F for k in range(more - 1, -1, -1))])


# ---------------------------------------------------------------- encoding


def put_bits(total_bytes: int, at: np.ndarray, value: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """A byte array with value's lowest bits (16 at most) at each bit place; places don't overlap."""
    shift = 24 - (at & 7) - bits
    v = (value & ((1 << bits) - 1)) << shift
    first = at >> 3
    out = np.zeros(total_bytes + 3)
    for k, part in enumerate((v >> 16, (v >> 8) & 0xFF, v & 0xFF)):
        out += np.bincount(first + k, part, total_bytes + 3)[: total_bytes + 3]
    return out[:total_bytes].astype(np.uint8)


def linear_predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor coefficients and shifts of each row, from its autocorrelation."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, : f.shape[1] - k] * f[:, k:]).sum(1) for k in range(ORDER + 1)], 1)
    error = r[:, 0] + 1e-9
    a = np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    size = np.abs(a).max(1)
    shift = np.clip(PRECISION - 2 - np.ceil(np.log2(np.maximum(size, 1e-6))), 0, 14).astype(np.int64)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int64), shift


def encode_frames(blocks: list[np.ndarray], numbers: list[int]) -> list[bytes]:
    """Frames of 8-bit mono samples, each with the cheapest of constant, verbatim, fixed (0 to 2) and linear prediction."""
    n = np.array([len(b) for b in blocks], np.int64)
    width = int(n.max())
    x = np.zeros((len(blocks), width), np.int32)
    for row, b in zip(x, blocks):
        row[: len(b)] = b
    valid = np.arange(width) < n[:, None]
    coefs, shift = linear_predictors(x)
    zigzag, cost, rice = [], [], []
    for order in (0, 1, 2, ORDER):
        if order < 3:
            res = np.zeros_like(x)
            res[:, order:] = np.diff(x, order, axis=1) if order else x
        else:
            guess = np.zeros(x.shape, np.int64)
            for j in range(ORDER):
                guess[:, ORDER:] += coefs[:, j : j + 1] * x[:, ORDER - 1 - j : width - 1 - j]
            res = (x - (guess >> shift[:, None])).astype(np.int32)
        u = ((res << 1) ^ (res >> 31)) * (valid & (np.arange(width) >= order))
        count = np.maximum(n - order, 1)
        k = np.clip(np.floor(np.log2(np.maximum(u.sum(1) / count * 0.6931, 1))), 0, 14).astype(np.int64)
        bits = (u >> k[:, None].astype(np.int32)).sum(1) + count * (k + 1) + 8 * order + 18 + (9 + ORDER * PRECISION if order == ORDER else 0)
        zigzag.append(u)
        cost.append(np.where(n > order + 1, bits, 1 << 60))
        rice.append(k)
    best = np.argmin(cost, 0)
    smooth = (np.where(valid, x, x[:, :1]) == x[:, :1]).all(1)

    values: list[int] = []
    widths: list[int] = []
    heads, kinds = [], []
    for i, number in enumerate(numbers):
        head = b"\xff\xf8\x74\x02" + coded_number(number) + struct.pack(">H", int(n[i]) - 1)
        heads.append(head + bytes([crc8(head)]))
        o = int(best[i])
        order = (0, 1, 2, ORDER)[o]
        kind = "constant" if smooth[i] else "verbatim" if cost[o][i] >= 8 * n[i] + 8 else "coded"
        kinds.append(kind)
        if kind == "constant":
            values += [0, int(x[i, 0])]
            widths += [8, 8]
        elif kind == "verbatim":
            values.append(2)
            widths.append(8)
        else:
            values += [(0x20 | ORDER - 1 if o == 3 else 0x08 | order) << 1, *x[i, :order].tolist()]
            widths += [8] * (order + 1)
            if o == 3:
                values += [PRECISION - 1, int(shift[i]), *coefs[i].tolist()]
                widths += [4, 5] + [PRECISION] * ORDER
            values += [0, int(rice[o][i])]
            widths += [6, 4]
        heads[-1] = (heads[-1], len(values))
    values_, widths_ = np.array(values, np.int64), np.array(widths, np.int64)
    frames, first = [], 0
    ends = np.cumsum(widths_)
    bodies: list[bytes] = []
    for i, (head, last) in enumerate(heads):
        base = int(ends[first] - widths_[first])
        at = ends[first:last] - widths_[first:last] - base
        val, wid = values_[first:last], widths_[first:last]
        if kinds[i] == "verbatim":
            bodies.append(b"\x02" + x[i, : n[i]].astype(np.int8).tobytes())
        else:
            used = int(at[-1] + wid[-1])
            if kinds[i] == "coded":
                o = int(best[i])
                order, k = (0, 1, 2, ORDER)[o], int(rice[o][i])
                u = zigzag[o][i, order : n[i]].astype(np.int64)
                q = u >> k
                stop = np.cumsum(q + k + 1) + used
                at = np.concatenate([at, stop - k - 1])
                val = np.concatenate([val, (1 << k) | (u & ((1 << k) - 1))])
                wid = np.concatenate([wid, np.full(len(u), k + 1)])
                used = int(stop[-1])
            bodies.append(put_bits(-(-used // 8), at, val, wid).tobytes())
        first = last
    frames = [h + b for (h, _), b in zip(heads, bodies)]
    return [f + struct.pack(">H", int(c)) for f, c in zip(frames, crc16(frames))]


def stream_head(samples: bytes, block: int) -> bytes:
    """The marker and STREAMINFO of 8-bit mono samples at 8 kHz."""
    size = min(block, max(len(samples), 16))
    packed = (8000 << 44) | (0 << 41) | (7 << 36) | len(samples)
    info = struct.pack(">HH", size, size) + bytes(6) + struct.pack(">Q", packed) + hashlib.md5(samples).digest()
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream of each payload's bytes as signed 8-bit samples, offset by 128."""
    samples = [np.frombuffer(p, np.uint8) ^ 0x80 for p in payloads]
    pieces = [(i, k, s[at : at + block].view(np.int8)) for i, s in enumerate(samples) for k, at in enumerate(range(0, len(s), block))]
    order = sorted(range(len(pieces)), key=lambda p: len(pieces[p][2]))  # so that rows of a group are about as long
    frames: list[bytes] = [b""] * len(pieces)
    for group in runs(order, lambda p: len(pieces[p][2]), 400_000):
        for p, frame in zip(group, encode_frames([pieces[p][2] for p in group], [pieces[p][1] for p in group])):
            frames[p] = frame
    out = [[stream_head(s.tobytes(), block)] for s in samples]
    for (i, _, _), frame in zip(pieces, frames):
        out[i].append(frame)
    return [b"".join(parts) for parts in out]


# ---------------------------------------------------------------- decoding


@dataclass
class Info:
    rate: int
    channels: int
    bits: int
    total: int
    md5: bytes
    start: int  # of the first frame


def stream_info(data: bytes) -> Info:
    if data[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, info, last = 4, None, False
    while not last:
        if at + 4 > len(data):
            raise FlacError("metadata ends early")
        last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            packed = int.from_bytes(data[at + 14 : at + 22], "big")
            info = Info(packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, data[at + 22 : at + 38], 0)
        at += 4 + size
    if info is None:
        raise FlacError("no STREAMINFO")
    info.start = at
    return info


@dataclass
class Frame:
    start: int
    head: int  # bytes of the header
    end: int
    samples: int
    assignment: int
    bits: int
    number: int


# Sample sizes by their code, and block sizes.
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
_SIZES = {1: 192} | {k: 576 << (k - 2) for k in range(2, 6)} | {k: 256 << (k - 8) for k in range(8, 16)}


def frame_head(data: bytes, at: int, info: Info) -> Frame | None:
    """The header at a place, or None if there is none with a right checksum."""
    head = data[at : at + 16]
    if len(head) < 6:
        return None
    size, rate, assignment, bits = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    if not size or rate == 15 or assignment > 10 or bits == 3 or head[3] & 1:
        return None
    lead = head[4]
    more = 0 if lead < 0x80 else 8 - (~lead & 0xFF).bit_length() - 1
    if more == 0 and lead >= 0x80 or more > 6:
        return None
    number = lead & (0x7F >> more + (more > 0))
    for b in head[5 : 5 + more]:
        number = number << 6 | b & 0x3F
    used = 5 + more
    extra = {6: 1, 7: 2}.get(size, 0)
    samples = int.from_bytes(head[used : used + extra], "big") + 1 if extra else _SIZES[size]
    used += extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if used >= len(head) or crc8(head[:used]) != head[used]:
        return None
    return Frame(at, used + 1, 0, samples, assignment, _BITS.get(bits, info.bits), number)


def frames_of(data: bytes, info: Info, careful: bool = False) -> list[Frame]:
    """All frames of a stream: a frame ends where a header with the number due next begins.

    careful: and where the frame's CRC-16 is right. It tells what merely looks like a header.
    """
    b = np.frombuffer(data, np.uint8)
    sync = np.flatnonzero((b[:-1] == 0xFF) & (b[1:] & 0xFE == 0xF8))
    found = [f for at in sync[sync >= info.start].tolist() if (f := frame_head(data, at, info))]
    if (not found and len(data) > info.start) or (found and found[0].start != info.start):
        raise FlacError("no frame where the first one should be")
    out: list[Frame] = []
    k = 0
    while k < len(found):
        f = found[k]
        due = f.number + (f.samples if data[f.start + 1] & 1 else 1)
        for m in range(k + 1, len(found) + 1):
            f.end = found[m].start if m < len(found) else len(data)
            if m == len(found) or (found[m].number == due and not (careful and crc16([data[f.start : f.end]])[0])):
                break
        out.append(f)
        k = m
    return out


def split(streams: list[bytes | None], infos: list[Info | None]) -> list[tuple[int, Frame]]:
    """(stream, frame) of all frames; streams with a wrong checksum are split again with care."""
    quick = {i: frames_of(s, info) for i, (s, info) in enumerate(zip(streams, infos)) if info}
    pairs = [(i, f) for i, frames in quick.items() for f in frames]
    wrong: set[int] = set()
    order = sorted(range(len(pairs)), key=lambda k: pairs[k][1].end - pairs[k][1].start)
    for group in runs(order, lambda k: pairs[k][1].end - pairs[k][1].start, GROUP_BYTES):
        sums = crc16([streams[pairs[k][0]][pairs[k][1].start : pairs[k][1].end] for k in group])
        wrong |= {pairs[k][0] for k, c in zip(group, sums.tolist()) if c}
    for i in wrong:
        quick[i] = frames_of(streams[i], infos[i], True)
        if crc16([streams[i][f.start : f.end] for f in quick[i]]).any():
            raise FlacError("a frame's CRC-16 is wrong")
    return [(i, f) for i, frames in quick.items() for f in frames]


def bit_windows(data: bytes) -> np.ndarray:
    """The 64 bits from every byte on."""
    b = np.frombuffer(data + bytes(16), np.uint8).astype(np.uint64)
    n = len(b) - 8
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out |= b[k : k + n] << np.uint64(56 - 8 * k)
    return out


class Bits:
    """Reads single fields at a bit place."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        self.at += n
        return int.from_bytes(self.data[first:last], "big") >> (-self.at & 7) & (1 << n) - 1 if n else 0

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v


def residuals(windows: np.ndarray, at: np.ndarray, counts: np.ndarray, coded: np.ndarray, raw: np.ndarray, method: np.ndarray, parts: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of subframes in lanes, longest first, as rows of samples; and where each lane ends.

    coded lanes are in partitions (size samples each, the first without the warm-up), each with its
    Rice parameter; lanes that aren't are raw numbers of raw bits.
    """
    lanes = len(at)
    out = np.zeros((int(counts[0]) if lanes else 0, lanes), np.int32)
    at = at.copy()
    k = np.zeros(lanes, np.int64)
    raw = raw.copy()
    is_raw = ~coded
    turn = np.where(coded, 0, np.int64(1) << 40)  # the sample at which a lane's next partition begins
    next_turn = int(turn.min()) if lanes else 0
    active_at = np.searchsorted(-counts, -np.arange(1, len(out) + 1), side="right")
    any_raw = bool(is_raw.any())
    one, top = np.uint64(1), np.uint64(63)
    k64 = k.astype(np.uint64)
    for t in range(len(out)):
        n = int(active_at[t])
        while next_turn == t:
            lane = np.flatnonzero(turn[:n] == t)
            w = windows[at[lane] >> 3] << (at[lane] & 7).astype(np.uint64)
            wide = method[lane]  # 4 or 5 bits
            got = (w >> (np.uint64(64) - wide.astype(np.uint64))).astype(np.int64)
            escape = got == (1 << wide) - 1
            at[lane] += wide
            if escape.any():
                e = lane[escape]
                w = windows[at[e] >> 3] << (at[e] & 7).astype(np.uint64)
                raw[e] = (w >> np.uint64(59)).astype(np.int64)
                at[e] += 5
            is_raw[lane] = escape
            k[lane] = np.where(escape, 0, got)
            k64 = k.astype(np.uint64)
            span = np.where(turn[lane] == 0, first[lane], size[lane])
            turn[lane] = t + span
            parts[lane] -= 1
            turn[lane[parts[lane] == 0]] = np.int64(1) << 40
            any_raw = bool(is_raw.any())
            live = turn[:n]
            # An empty first partition ends where it begins.
            next_turn = int(live.min()) if len(live) else -1
        p = at[:n]
        w = windows[p >> 3] << (p & 7).astype(np.uint64)
        q = _ZEROS[(w >> np.uint64(48)).astype(np.int64)]
        if any_raw:
            q = np.where(is_raw[:n], 0, q)
        if (q == 16).any():
            for lane in np.flatnonzero(q == 16).tolist():
                place, zeros = int(p[lane]), 0
                while True:
                    some = int(windows[place >> 3] << np.uint64(place & 7)) >> 48
                    run = int(_ZEROS[some])
                    zeros, place = zeros + run, place + run
                    if run < 16:
                        break
                    if place >> 3 >= len(windows) - 8:
                        raise FlacError("a code runs past the end")
                q[lane] = zeros
                at[lane] += zeros
                w[lane] = windows[place >> 3] << np.uint64(place & 7)
            short = np.where(q >= 16, 0, q)
        else:
            short = q
        low = (w << (short.astype(np.uint64) + one)) >> one >> (top - k64[:n])
        u = (q << k[:n]) | low.astype(np.int64)
        step = short + 1 + k[:n]
        r = (u >> 1) ^ -(u & 1)
        if any_raw:
            m = is_raw[:n]
            b = raw[:n][m]
            v = w[m].astype(np.int64) >> np.maximum(64 - b, 0).clip(0, 63)
            r[m] = np.where(b > 0, v, 0)
            step[m] = b
        out[t, :n] = r
        at[:n] += step
    return out, at


def subframes(data: bytes, windows: np.ndarray, at: list[int], samples: list[int], bits: list[int]) -> tuple[list[np.ndarray], list[int]]:
    """One subframe of each frame, from its bit place: samples, and where it ends."""
    heads = []
    for place, n, size in zip(at, samples, bits):
        r = Bits(data, place)
        code = r.take(8)
        if code & 0x80:
            raise FlacError("a subframe's first bit is set")
        wasted = 0
        if code & 1:
            wasted = 1
            while not r.take(1):
                wasted += 1
        kind, depth = code >> 1 & 0x3F, size - wasted
        order = kind & 7 if 8 <= kind <= 12 else (kind & 31) + 1 if kind & 32 else 0
        if kind > 1 and not (8 <= kind <= 12 or kind & 32) or order > n:
            raise FlacError("a reserved subframe")
        constant = r.signed(depth) if kind == 0 else None
        warm = [r.signed(depth) for _ in range(order)]
        coefs, shift = [], 0
        if kind & 32:
            precision = r.take(4) + 1
            shift = r.signed(5)
            coefs = [r.signed(precision) for _ in range(order)]
        method, parts = 4, 1
        if kind > 1:
            method = 4 + r.take(2)
            parts = 1 << r.take(4)
        heads.append((kind, wasted, depth, order, constant, warm, coefs, shift, method, parts, r.at))
    n = np.array(samples, np.int64)
    order_of = np.array([h[3] for h in heads], np.int64)
    counts = np.array([0 if h[0] == 0 else m - h[3] for h, m in zip(heads, samples)], np.int64)
    lanes = np.argsort(-counts, kind="stable")
    col = lambda i: np.array([h[i] for h in heads], np.int64)[lanes]
    parts = col(9)
    size = n[lanes] // parts
    res, ends = residuals(
        windows, col(10), counts[lanes], np.array([h[0] > 1 for h in heads])[lanes], np.array([h[2] for h in heads], np.int64)[lanes], col(8), parts, size - order_of[lanes], size
    )
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(heads)
    end = [0] * len(heads)
    predicted = []
    for j, i in enumerate(lanes.tolist()):
        kind, wasted, _, order, constant, warm, coefs, _, _, _, start = heads[i]
        end[i] = int(ends[j]) if counts[i] else start
        r = res[: counts[i], j].astype(np.int64)
        if kind == 0:
            out[i] = np.full(samples[i], constant, np.int64)
        elif kind & 32:
            predicted.append((i, j))
            continue
        else:
            x = np.concatenate([np.array(warm, np.int64), r])
            # A fixed predictor of order p leaves p-th differences: they are summed p times, from the warm-up's differences.
            for p in range(order, 0, -1):
                x[p - 1 :] = np.cumsum(np.concatenate([np.diff(np.array(warm, np.int64), p - 1)[:1], x[p:]]))
            out[i] = x
        out[i] = out[i] << wasted
    for deep in sorted({heads[i][3] for i, _ in predicted}):
        group = [(i, j) for i, j in predicted if heads[i][3] == deep]
        total = np.array([counts[i] for i, _ in group])
        x = np.zeros((deep + int(total[0]), len(group)), np.int64)
        x[:deep] = np.array([heads[i][5] for i, _ in group]).T
        c = np.array([heads[i][6] for i, _ in group], np.int64).T[::-1].copy()
        shift = np.array([heads[i][7] for i, _ in group], np.int64)
        r = res[: int(total[0]), [j for _, j in group]].astype(np.int64)
        live = np.searchsorted(-total, -np.arange(1, len(r) + 1), side="right")
        for t in range(len(r)):
            m = int(live[t])
            x[deep + t, :m] = r[t, :m] + ((c[:, :m] * x[t : t + deep, :m]).sum(0) >> shift[:m])
        for g, (i, _) in enumerate(group):
            out[i] = x[: deep + counts[i], g] << heads[i][1]
    return out, end


def decode_group(datas: list[bytes], frames: list[Frame]) -> list[np.ndarray]:
    """Samples (rows) by channel of frames, given with their bytes; split() has held their checksums."""
    joined = b"".join(datas)
    windows = bit_windows(joined)
    base = np.cumsum([0] + [len(d) for d in datas]).tolist()
    at = [8 * (b + f.head) for b, f in zip(base, frames)]
    channels = [f.assignment + 1 if f.assignment < 8 else 2 for f in frames]
    got: list[list[np.ndarray]] = [[] for _ in frames]
    for c in range(max(channels)):
        some = [i for i, n in enumerate(channels) if n > c]
        # The side channel has a bit more.
        bits = [frames[i].bits + (frames[i].assignment in ((8, 10) if c else (9,))) for i in some]
        samples, ends = subframes(joined, windows, [at[i] for i in some], [frames[i].samples for i in some], bits)
        for i, x, e in zip(some, samples, ends):
            got[i].append(x)
            at[i] = e
    out = []
    for f, x, b, e, d in zip(frames, got, base, at, datas):
        if -(-e // 8) + 2 != b + len(d):
            raise FlacError("a frame doesn't end where its checksum is")
        if f.assignment == 8:
            x[1] = x[0] - x[1]
        elif f.assignment == 9:
            x[0] = x[0] + x[1]
        elif f.assignment == 10:
            mid = x[0] << 1 | x[1] & 1
            x = [mid + x[1] >> 1, mid - x[1] >> 1]
        out.append(np.stack(x, 1))
    return out


def pcm_bytes(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian PCM, in whole bytes."""
    width = -(-bits // 8)
    flat = np.ascontiguousarray(samples.astype("<i8")).reshape(-1, 1).view(np.uint8)
    return flat.reshape(-1, 8)[:, :width].tobytes()


def decode(streams: list[bytes | None]) -> list[list[tuple[int, int, int, bytes]]]:
    """(byte offset, sample offset, samples, PCM) of every block of each stream, all checksums held."""
    infos = [stream_info(s) if s is not None else None for s in streams]
    work = split(streams, infos)
    # Frames of about one length are decoded together.
    order = sorted(range(len(work)), key=lambda k: work[k][1].samples)
    pcm: list[tuple[int, bytes]] = [(0, b"")] * len(work)
    for group in runs(order, lambda k: work[k][1].end - work[k][1].start, GROUP_BYTES):
        some = [work[k] for k in group]
        for k, (_, f), x in zip(group, some, decode_group([streams[i][f.start : f.end] for i, f in some], [f for _, f in some])):
            pcm[k] = (len(x), pcm_bytes(x, f.bits))
    blocks: list[list[tuple[int, int, int, bytes]]] = [[] for _ in streams]
    place = [0] * len(streams)
    for (i, f), (n, data) in zip(work, pcm):
        blocks[i].append((f.start, place[i], n, data))
        place[i] += n
    for info, found, n in zip(infos, blocks, place):
        if info:
            if info.total and n != info.total:
                raise FlacError("the stream has another number of samples than it says")
            if any(info.md5) and hashlib.md5(b"".join([b[3] for b in found])).digest() != info.md5:
                raise FlacError("the samples' MD5 is wrong")
    return blocks


BLOCKS = "block int, byte_offset long, sample_offset long, n_samples long, pcm binary"


def decode_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for every PCM block of every stream, with its offsets; no shuffle."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in runs(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), lambda r: len(r[1] or b""), 8_000_000):
                out = [(i, k, *block) for (i, _), found in zip(rows, decode([s for _, s in rows])) for k, block in enumerate(found)]
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[id_col, "block", "byte_offset", "sample_offset", "n_samples", "pcm"])

    return arrow_map(media.select(id_col, media_col), run, f"{id_col} {kind}, {BLOCKS}")


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of every text: UTF-8, zeros to a positive multiple of PAD, as FLAC."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in runs(list(zip(column(batch, "doc_id"), column(batch, "text"))), lambda r: len(r[1] or ""), 4_000_000):
                data = [utf8(t) for _, t in rows]
                payloads = [d.ljust(max(PAD, -(-len(d) // PAD) * PAD), b"\0") for d in data]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in rows], batch.schema.field(0).type), pa.array([len(d) for d in data], pa.int64()), pa.array(encode(payloads), pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_bytes, media_sha256 and blocks (byte_offset, sample_offset, n_samples, pcm) of every stored stream, decoded with all checksums held: the offsets let a reader take single blocks. No shuffle."""
    kind = media.schema["doc_id"].dataType.simpleString()
    block = pa.struct([("byte_offset", pa.int64()), ("sample_offset", pa.int64()), ("n_samples", pa.int64()), ("pcm", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in runs(list(zip(*(column(batch, c) for c in ("doc_id", "n_bytes", "media")))), lambda r: len(r[2] or b""), 2_000_000):
                found = decode([s for _, _, s in rows])
                out = [
                    (i, n, len(s), hashlib.sha256(s).hexdigest(), [dict(zip(("byte_offset", "sample_offset", "n_samples", "pcm"), b)) for b in blocks])
                    for (i, n, s), blocks in zip(rows, found)
                ]
                kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.list_(block)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"])

    fields = "blocks array<struct<byte_offset:long,sample_offset:long,n_samples:long,pcm:binary>>"
    return arrow_map(media.select("doc_id", "n_bytes", "media"), run, f"doc_id {kind}, n_bytes long, media_bytes long, media_sha256 string, {fields}")


def digest(pcm: DataFrame) -> DataFrame:
    """What the stored PCM blocks (as of pcm_blocks()) hold: digests of the payload, and a feature of the blocks."""
    import zlib

    kind = pcm.schema["doc_id"].dataType.simpleString()
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(4)
            # Samples of all blocks of a row, without a Python object a block.
            data, ends = blocks.flatten().field("pcm"), np.cumsum([n or 0 for n in pc.list_value_length(blocks).to_pylist()])
            out, first = [], 0
            for doc_id, n_bytes, media_bytes, media_sha256, last in zip(*(batch.column(c).to_pylist() for c in range(4)), ends.tolist()):
                payload = (np.frombuffer(b"".join(data.slice(first, last - first).to_pylist()), np.uint8) ^ 0x80).tobytes()
                x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
                crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
                feature = f"blocks={last - first};energy={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max())}"
                out.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), media_bytes, media_sha256, feature))
                first = last
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            columns = list(zip(*out)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return arrow_map(pcm.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"), run, f"doc_id {kind}, n_bytes long, {fields}")
