import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewright.llm import flac

from .fixtures import clashing, docs, empty


def payload_of(blocks):
    return (np.frombuffer(b"".join(b[3] for b in blocks), np.uint8) ^ 0x80).tobytes()


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.integers(1, 60))
def test_round_trip(part, times):
    data = (part * times).ljust(-(-len(part) * times // 64) * 64, b"\0")
    (stream,) = flac.encode([data], 512)
    (blocks,) = flac.decode([stream])
    assert payload_of(blocks) == data
    assert [b[1] for b in blocks] == list(range(0, len(data), 512))


def test_kinds_together():
    rng = np.random.default_rng(0)
    wave = (128 + 100 * np.sin(np.arange(20_000) / 20)).astype(np.uint8).tobytes()
    data = [bytes(64), bytes(range(256)) * 20, rng.integers(0, 256, 9000, np.uint8).tobytes(), wave, (bytes(63) + b"\xff") * 100]
    streams = flac.encode(data)
    assert [payload_of(b) for b in flac.decode(streams)] == data
    assert len(streams[3]) < len(wave) / 3 and len(streams[0]) < 64


def test_blocks_are_seekable():
    data = bytes(range(250)) * 200
    (stream,) = flac.encode([data])
    info = flac.stream_info(stream)
    (blocks,) = flac.decode([stream])
    for at, sample, n, pcm in blocks:
        frame = flac.frame_head(stream, at, info)
        assert frame.samples == n and frame.number * flac.BLOCK == sample
        assert (np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes() == data[sample : sample + n]


def test_faults_are_found():
    (stream,) = flac.encode([bytes(range(256)) * 40])
    for at in (0, 60, len(stream) - 3):
        with pytest.raises(flac.FlacError):
            flac.decode([stream[:at] + bytes([stream[at] ^ 0x10]) + stream[at + 1 :]])
    with pytest.raises(flac.FlacError):
        flac.decode([stream[: len(stream) // 2]])


class Put:
    """A bit writer for streams that the encoder doesn't make."""

    def __init__(self):
        self.bits = ""

    def put(self, value: int, n: int):
        self.bits += format(value & ((1 << n) - 1), f"0{n}b") if n else ""

    def rice(self, r: int, k: int):
        u = 2 * r if r >= 0 else -2 * r - 1
        self.bits += "0" * (u >> k) + "1"
        self.put(u, k)

    def done(self) -> bytes:
        self.bits += "0" * (-len(self.bits) % 8)
        return int(self.bits, 2).to_bytes(len(self.bits) // 8, "big") if self.bits else b""


def test_stereo_partitions_escapes_and_wasted_bits():
    """A hand-made 16-bit mid-side frame: fixed order 2 in four partitions, one of them raw; side verbatim with wasted bits."""
    n = 64
    left = np.array([int(900 * np.sin(k / 5)) * 2 for k in range(n)])
    right = left - np.array([4 * (k % 7) for k in range(n)])
    mid, side = (left + right) >> 1, left - right
    p = Put()
    p.put(0b00010100, 8)  # fixed, order 2
    for k in range(2):
        p.put(int(mid[k]), 16)
    res = np.diff(mid, 2)
    p.put(1, 2)  # five-bit parameters
    p.put(2, 4)
    at = 0
    for part, size in enumerate((14, 16, 16, 16)):
        if part == 2:
            p.put(31, 5)
            p.put(12, 5)
            for r in res[at : at + size]:
                p.put(int(r), 12)
        else:
            k = 0 if part == 1 else 4  # long unary runs where the parameter is 0
            p.put(k, 5)
            for r in res[at : at + size]:
                p.rice(int(r), k)
        at += size
    p.put(0b00000011, 8)  # verbatim with wasted bits
    p.put(0b01, 2)  # two of them
    for s in side:
        p.put(int(s) >> 2, 15)
    head = b"\xff\xf8" + bytes([0x69, 0xA8]) + flac.coded_number(0) + bytes([n - 1])
    frame = head + bytes([flac.crc8(head)]) + p.done()
    frame += struct.pack(">H", int(flac.crc16([frame])[0]))
    pcm = np.stack([left, right], 1).astype("<i2").tobytes()
    packed = (44100 << 44) | (1 << 41) | (15 << 36) | n
    info = struct.pack(">HH", n, n) + bytes(6) + struct.pack(">Q", packed) + hashlib.md5(pcm).digest()
    stream = b"fLaC\x01" + bytes([0, 0, 4]) + b"pad!" + b"\x80" + len(info).to_bytes(3, "big") + info + frame
    ((found,),) = flac.decode([stream])
    assert found[1:3] == (0, n) and found[3] == pcm


def test_digest(spark):
    df = docs(spark)
    rows = flac.digest(flac.pcm_blocks(flac.encode_texts(clashing(df)))).collect()
    wanted = []
    for r in df.collect():
        data = (r["text"] or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        wanted.append((r["doc_id"], len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted([tuple(r)[:5] for r in rows], key=repr) == sorted(wanted, key=repr)
    media = {}
    for r in rows:
        assert media.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert flac.digest(flac.pcm_blocks(flac.encode_texts(empty(spark)))).count() == 0
    for r, text in zip(rows, [{q["doc_id"]: q["text"] for q in df.collect()}[r["doc_id"]] for r in rows]):
        data = (text or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        stream = flac.encode([padded])[0]
        x = [b - 128 for b in padded]
        blocks = flac.decode([stream])[0]
        assert b"".join(b[3] for b in blocks) == bytes(b ^ 0x80 for b in padded) and [b[1] for b in blocks] == [sum(c[2] for c in blocks[:k]) for k in range(len(blocks))]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest())
        assert r["feature"] == f"blocks={len(blocks)};energy={sum(v * v for v in x)};crossings={crossings};peak={max(map(abs, x))}"


def test_decoded_blocks(spark):
    streams = flac.encode([bytes(range(256)) * 30, bytes(64)])
    df = spark.createDataFrame([(1, streams[0]), (2, None), (3, streams[1])], "doc_id long, media binary")
    rows = flac.decode_blocks(df).orderBy("doc_id", "block").collect()
    assert [(r["doc_id"], r["block"], r["sample_offset"], r["n_samples"]) for r in rows] == [(1, 0, 0, 4096), (1, 1, 4096, 3584), (3, 0, 0, 64)]
