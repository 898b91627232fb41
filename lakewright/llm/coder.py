"""Token ids as compact files: an adaptive context-mixing range coder over independently reset blocks.

In a block the id that last followed the same two ids (order 2) is predicted, with a confidence from
its run of hits and an adaptive estimate of how far that is to be trusted. What it leaves goes to the
distribution of order 1, whose escape leads to that of order 0. These two start from counts of the
whole file, which its head holds, so that a reset block need not learn the vocabulary anew. Order 2
and order 1 are mixed into one interval of a range coder with 48 bits of state and 16-bit output.
All numbers are integers, so files decode alike everywhere.

Blocks share nothing but the head: each is coded from fresh tables and estimates and has its length
and the CRC-32 of its ids, so any of them can be decoded alone. The blocks of a file are coded side
by side, one numpy step for an id of every block.

Defined results: null and empty texts are the end id alone; ids of documents are integers or null;
rows with one doc_id are written in the order of their texts; an empty table gives no files and no
rows; further columns are ignored. A file with a wrong checksum raises CodedError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_map, column, encoder, runs, written

#: Ids of a block at most and at least, blocks of a file that has ids for them (lanes are cheap, steps are not), ids of a file (a longer document has one alone), bits of the places of order 2.
BLOCK, SHORT, LANES, FILE_IDS, PLACES = 2048, 512, 1536, 4_000_000, 11
#: Order 1: bits of a distribution; contexts that have one, the most frequent; pairs of one at most, and how often a pair occurs at least. All other pairs escape to order 0.
BITS, CONTEXTS, PAIRS, TIMES = 10, 4096, 512, 2
#: Bits of order 0, at least, and of the interval that all share.
BITS0, MIXED = 16, 16
#: An interval of order 1 in one number: its start, its size, and whether it is an escape.
START, SIZE, ESCAPE = (1 << BITS) - 1, (1 << BITS + 1) - 1, 1 << 2 * BITS + 1
MAGIC, VERSION = b"LWTK", 2
_NULL = -(2**63)
_LOW32 = 2**32 - 1


class CodedError(ValueError):
    pass


def planes(a: np.ndarray) -> bytes:
    """Numbers under 2**32, packed: all lowest bytes, then all next ones."""
    data = zlib.compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 6)
    return struct.pack("<II", len(a), len(data)) + data


def unplanes(image: bytes, at: int) -> tuple[np.ndarray, int]:
    """(numbers, place behind them)."""
    n, size = struct.unpack_from("<II", image, at)
    data = np.frombuffer(zlib.decompress(image[at + 8 : at + 8 + size]), np.uint8)
    return np.ascontiguousarray(data.reshape(4, n).T).view("<u4").ravel().astype(np.int64), at + 8 + size


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, the place of each value among them, how often each occurs): by a table where that is small beside the values, else by sorting."""
    top = int(values.max()) + 1 if len(values) else 0
    if top > 4 * len(values) + (1 << 16):
        keys, of, times = np.unique(values, return_inverse=True, return_counts=True)
        return keys.astype(np.int64), of.ravel(), times
    times = np.bincount(values, minlength=top)
    keys = np.flatnonzero(times)
    place = np.zeros(top, np.int32)
    place[keys] = np.arange(len(keys))
    return keys, place.take(values).astype(np.int64), times[keys]


class Prior:
    """What every block of a file starts from: distributions of order 1 with an escape, and of order 0 for what escapes.

    Ids are numbered from 1 in their order; number 0 is the place before a block, and the escape.
    """

    def __init__(self, vocabulary: np.ndarray, times: np.ndarray, of_context: np.ndarray, pair: np.ndarray, pair_times: np.ndarray):
        """The distinct ids and how often each occurs; how many pairs of each id the head has, their second numbers, and how often they occur."""
        self.parts = vocabulary, times, of_context, pair, pair_times
        self.vocabulary = np.concatenate([[0], vocabulary])
        v = len(vocabulary)
        # Order 0: each id by how often no pair covers it.
        rest = np.maximum(times - np.bincount(pair, pair_times, v + 1)[1:].astype(np.int64), 0)
        self.bits0 = max(BITS0, v.bit_length() + 2)
        size0 = 1 + rest * ((1 << self.bits0) - v) // max(int(rest.sum()), 1)
        if v:
            size0[size0.argmax()] += (1 << self.bits0) - int(size0.sum())
        self.size0 = np.concatenate([[0], size0])
        self.start0 = np.cumsum(self.size0) - self.size0
        # Order 1: entry 0 is the escape of all contexts without pairs; each other context has its pairs, then its escape.
        some = np.flatnonzero(of_context)
        n = of_context[some]
        row = np.repeat(np.arange(len(some)), n)
        seen = np.bincount(row, pair_times, len(some)).astype(np.int64)
        total = np.maximum(times[some] - seen, 1) + seen
        size = 1 + pair_times * ((1 << BITS) - n - 1)[row] // total[row]
        self.row = np.zeros(v + 1, np.int32)
        self.row[some + 1] = np.arange(1, len(some) + 1)
        self.escape = np.zeros(v + 1, np.int64)
        self.escape[some + 1] = np.cumsum(n + 1)
        self.symbol, sizes = np.zeros(len(pair) + len(some) + 1, np.uint32), np.zeros(len(pair) + len(some) + 1, np.int32)
        self.pairs_at = np.arange(len(pair)) + row + 1
        self.symbol[self.pairs_at], sizes[self.pairs_at] = pair, size
        sizes[self.escape[some + 1]] = (1 << BITS) - np.bincount(row, size, len(some)).astype(np.int64)
        sizes[0] = 1 << BITS
        start = (np.cumsum(sizes, dtype=np.int64) - sizes).astype(np.int32) & np.int32(START)
        self.sizes, self.span = sizes, start | sizes << np.int32(BITS) | (self.symbol == 0) * np.int32(ESCAPE)

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Prior, np.ndarray, np.ndarray]:
        """(the prior of a file, the number of each id, the interval of order 1 of each id after the one before it)."""
        vocabulary, number, times = counted(ids)
        number += 1
        v = len(vocabulary)
        kind = np.int32 if (v + 1) ** 2 < 1 << 31 else np.int64
        number = number.astype(kind)
        pairs = np.zeros(len(number), kind)
        np.multiply(number[:-1], kind(v + 1), out=pairs[1:])
        pairs += number
        table = (v + 1) ** 2 <= 4 * len(ids) + (1 << 16)
        if table:
            counts = np.bincount(pairs, minlength=(v + 1) ** 2)
            keys = np.flatnonzero(counts >= TIMES)
            counts = counts[keys]
        else:
            keys, counts = np.unique(pairs, return_counts=True)
            keys, counts = keys[counts >= TIMES].astype(np.int64), counts[counts >= TIMES]
        context = keys // (v + 1)
        order = np.lexsort((-counts, context))
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys)) - np.searchsorted(context, context[order])
        frequent = np.zeros(v + 1, bool)
        frequent[1 + np.argsort(-times, kind="stable")[:CONTEXTS]] = True
        kept = frequent[context] & (rank < PAIRS) & (counts << BITS >= np.concatenate([[0], times])[context])
        keys, context = keys[kept], context[kept]
        prior = cls(vocabulary, times, np.bincount(context, minlength=v + 1)[1:], keys % (v + 1), counts[kept])
        if table:
            spans = np.repeat(prior.span.take(prior.escape), v + 1)
            spans[keys] = prior.span.take(prior.pairs_at)
            return prior, number, spans.take(pairs)
        entry = prior.escape.take(pairs // (v + 1))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
            entry = np.where(keys[at] == pairs, prior.pairs_at[at], entry)
        return prior, number, prior.span.take(entry)

    def packed(self) -> bytes:
        vocabulary, times, of_context, pair, pair_times = self.parts
        first = np.cumsum(of_context) - of_context
        steps = np.diff(pair, prepend=0)
        steps[first[of_context > 0]] = pair[first[of_context > 0]]
        return b"".join(map(planes, (np.diff(vocabulary, prepend=0), times, of_context, steps, pair_times)))

    @classmethod
    def unpacked(cls, image: bytes, at: int) -> tuple[Prior, int]:
        parts = []
        for _ in range(5):
            part, at = unplanes(image, at)
            parts.append(part)
        steps, times, of_context, pair, pair_times = parts
        ends = np.cumsum(of_context)
        total = np.cumsum(pair)
        base = np.concatenate([[0], total])[ends - of_context]
        return cls(np.cumsum(steps), times, of_context, total - np.repeat(base, of_context), pair_times), at

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """(the entry that each of the 2**BITS values of each row stands for, the number that each of the 2**bits0 values of order 0 does)."""
        return np.repeat(np.arange(len(self.sizes), dtype=np.uint32), self.sizes), np.repeat(np.arange(len(self.size0), dtype=np.uint32), self.size0)


class Model:
    """What order 2 predicts for every lane, and what it learns."""

    def __init__(self, lanes: int):
        # An entry is a number and, in two bits, its run of hits; 0 is none.
        self.next = np.zeros(lanes << PLACES, np.uint32)
        # Estimates in 1/65536 of a hit, by confidence; the upper half is for no prediction.
        self.trust = np.full(lanes << 3, 16384, np.int32)
        self.last, self.last2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        lane = np.arange(lanes, dtype=np.int64)
        self.row, self.row8 = lane << PLACES, lane << 3

    def predict(self, n: int) -> np.ndarray:
        """Shares of 2**MIXED for a hit, of the first n lanes."""
        self.at = self.row[:n] + ((self.last[:n] * np.uint32(0x85EBCA6B) + self.last2[:n] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - PLACES))
        v = self.next.take(self.at)
        self.number, self.run = v >> np.uint32(2), v & np.uint32(3)
        some = v > 0
        self.of = self.row8[:n] + self.run + (~some << np.uint32(2))
        self.share = self.trust.take(self.of)
        return self.share * some

    def learn(self, n: int, now: np.ndarray, hit: np.ndarray) -> None:
        """now: the numbers. Trust stays below 63/64, so that every other id keeps a share."""
        self.trust[self.of] = self.share + ((hit * np.int32(64512 - 256) + np.int32(256) - self.share) >> np.int32(4))
        self.next[self.at] = now << np.uint32(2) | np.minimum(self.run + np.uint32(1), np.uint32(3)) * hit
        self.last2[:n] = self.last[:n]
        self.last[:n] = now


class Writer:
    """Range coders of all lanes. Words are kept with room for a carry, which is settled at the end."""

    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, 1 << 48, np.int64)
        self.words = np.zeros((lanes, 4 * steps + 4), np.uint32)
        self.flat, self.row = self.words.reshape(-1), np.arange(lanes, dtype=np.int64) * self.words.shape[1]
        self.next = self.row.copy()

    def put(self, lanes, start: np.ndarray, size: np.ndarray, bits: int) -> None:
        """Narrow the lanes' intervals to [start, start + size) of 2**bits. lanes: a slice or places."""
        whole = isinstance(lanes, slice)
        span = (self.range[lanes] if whole else self.range.take(lanes)) >> bits
        low = (self.low[lanes] if whole else self.low.take(lanes)) + span * start
        span *= size
        short = np.flatnonzero(span <= _LOW32)
        while len(short):
            who = short if whole else lanes.take(short)
            some, at, left = low.take(short), self.next.take(who), span.take(short) << 16
            self.flat[at] = some >> 32
            self.next[who] = at + 1
            low[short] = (some & _LOW32) << 16
            span[short] = left
            short = short[left <= _LOW32]
        self.low[lanes], self.range[lanes] = low, span

    def finish(self) -> list[bytes]:
        for _ in range(3):
            self.flat[self.next] = self.low >> 32
            self.next += 1
            self.low = (self.low & _LOW32) << 16
        used = self.next - self.row
        words = np.ascontiguousarray(self.words[:, : int(used.max())].T)
        carry = np.zeros(len(used), np.uint32)
        for k in range(len(words) - 1, -1, -1):
            w = words[k] + carry * (used > k)
            carry = w >> np.uint32(16)
            words[k] = w & np.uint32(0xFFFF)
        lanes = np.ascontiguousarray(words.astype(">u2").T)
        return [lanes[i, :n].tobytes() for i, n in enumerate(used.tolist())]


class Reader:
    """The decoding side: how far each lane's code lies in its interval."""

    def __init__(self, blocks: list[bytes]):
        longest = max(map(len, blocks)) // 2 + 5
        words = np.zeros((len(blocks), longest), np.int64)
        for row, b in zip(words, blocks):
            row[: len(b) // 2] = np.frombuffer(b, ">u2")
        self.flat = words.reshape(-1)
        self.at = np.arange(len(blocks), dtype=np.int64) * longest + 3
        self.code = words[:, 0] << 32 | words[:, 1] << 16 | words[:, 2]
        self.range = np.full(len(blocks), 1 << 48, np.int64)

    def values(self, lanes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, size of a step of 2**bits, the step that the code is in)."""
        whole = isinstance(lanes, slice)
        code, r = (self.code[lanes], self.range[lanes] >> bits) if whole else (self.code.take(lanes), self.range.take(lanes) >> bits)
        return code, r, np.minimum(code // r, (1 << bits) - 1)

    def take(self, lanes, code: np.ndarray, r: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        code = code - r * start
        span = r * size
        short = np.flatnonzero(span <= _LOW32)
        while len(short):
            who = short if isinstance(lanes, slice) else lanes.take(short)
            at, left = self.at.take(who), span.take(short) << 16
            # A damaged block may ask for more words than there are; its checksum tells.
            code[short] = code.take(short) << 16 | self.flat.take(at, mode="clip")
            self.at[who] = at + 1
            span[short] = left
            short = short[left <= _LOW32]
        self.code[lanes], self.range[lanes] = code, span


def block_of(n: int) -> int:
    """The length of the blocks of a file of n ids."""
    return max(SHORT, min(BLOCK, -(-n // LANES)))


def cut(ids: np.ndarray) -> list[np.ndarray]:
    block = block_of(len(ids))
    return [ids[at : at + block] for at in range(0, len(ids), block)]


def by_steps(values: np.ndarray) -> np.ndarray:
    """values of all blocks in a row as (step, lane); the last lane may be shorter."""
    block = block_of(len(values))
    lanes, steps = -(-len(values) // block), min(block, len(values))
    grid = np.zeros(lanes * steps, values.dtype)
    grid[: len(values)] = values
    return np.ascontiguousarray(grid.reshape(lanes, steps).T)


def mixed(hit: np.ndarray, two: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of 2**MIXED: first a hit of order 2, then the interval of order 1 in what that leaves."""
    start, size = span & np.int32(START), span >> np.int32(BITS) & np.int32(SIZE)
    left = np.int32(1 << MIXED) - two
    low = left * start >> np.int32(BITS)
    high = left * (start + size) >> np.int32(BITS)
    return np.where(hit, 0, two + low), np.where(hit, two, high - low)


def encode_blocks(ids: np.ndarray) -> tuple[Prior, list[bytes]]:
    """(what all blocks start from, coded bytes of each block of ids)."""
    prior, number, span = Prior.of(ids)
    if not len(ids):
        return prior, []
    numbers, spans = by_steps(number.astype(np.uint32)), by_steps(span)
    lanes, last = numbers.shape[1], (len(ids) - 1) % block_of(len(ids)) + 1
    model, out = Model(lanes), Writer(lanes, len(numbers))
    for t in range(len(numbers)):
        n = lanes - (t >= last)
        # A block knows nothing of what came before it.
        now, one = numbers[t, :n], spans[t, :n] if t else np.full(n, prior.span[0])
        two = model.predict(n)
        hit = now == model.number
        out.put(slice(0, n), *mixed(hit, two, one), MIXED)
        escaped = np.flatnonzero((one >= ESCAPE) & ~hit)
        if len(escaped):
            rest = now.take(escaped)
            out.put(escaped, prior.start0.take(rest), prior.size0.take(rest), prior.bits0)
        model.learn(n, now, hit)
    return prior, out.finish()


def decode_blocks(prior: Prior, coded: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """Ids of blocks, all or some; none may be shorter than one after it."""
    if not coded:
        return []
    steps, lanes = lengths[0], len(coded)
    ends = np.searchsorted(-np.array(lengths), -np.arange(steps))
    model, source, (slots, slots0) = Model(lanes), Reader(coded), prior.slots()
    grid = np.zeros((steps, lanes), np.uint32)
    for t in range(steps):
        n = int(ends[t])
        two = model.predict(n)
        every = slice(0, n)
        code, r, value = source.values(every, MIXED)
        value = value.astype(np.int32)
        hit = value < two
        # The largest start whose place in what a hit leaves isn't beyond the value.
        inner = (((value - two + np.int32(1)) << np.int32(BITS)) - np.int32(1)) // (np.int32(1 << MIXED) - two)
        at = slots.take((prior.row.take(model.last[:n]) << np.int32(BITS)) + np.maximum(inner, 0))
        source.take(every, code, r, *mixed(hit, two, prior.span.take(at)))
        now = np.where(hit, model.number, prior.symbol.take(at))
        escaped = np.flatnonzero(now == 0)
        if len(escaped):
            code, r, value = source.values(escaped, prior.bits0)
            rest = slots0.take(value)
            source.take(escaped, code, r, prior.start0.take(rest), prior.size0.take(rest))
            now[escaped] = rest
        grid[t, :n] = now
        model.learn(n, now, hit)
    columns = prior.vocabulary.astype(np.uint32).take(np.ascontiguousarray(grid.T))
    return [columns[k, :m] for k, m in enumerate(lengths)]


def to_file(doc_ids: list[int | None], texts: list[np.ndarray]) -> bytes:
    """A file image: head (documents' ids and lengths, blocks' ids, bytes and CRC-32 of the ids, counts that all blocks start from), its CRC-32, coded bytes."""
    ids = np.concatenate(texts).astype("<u4") if texts else np.zeros(0, "<u4")
    prior, coded = encode_blocks(ids)
    table = np.array([[len(b), len(c), zlib.crc32(b.tobytes())] for b, c in zip(cut(ids), coded)], "<u4").tobytes()
    docs = np.array([_NULL if i is None else i for i in doc_ids], "<i8").tobytes() + np.array([len(t) for t in texts], "<u8").tobytes()
    packed = prior.packed()
    head = MAGIC + struct.pack("<BQIII", VERSION, len(ids), len(texts), len(coded), len(packed)) + docs + table + packed
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(coded)


def from_file(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, number of ids of each, all ids), every checksum held."""
    if image[:4] != MAGIC:
        raise CodedError("not a file of token ids")
    version, total, n_docs, n_blocks, n_packed = struct.unpack_from("<BQIII", image, 4)
    at = 4 + struct.calcsize("<BQIII")
    tables = at + 16 * n_docs + 12 * n_blocks
    end = tables + n_packed
    if version != VERSION or len(image) < end + 4 or struct.unpack_from("<I", image, end)[0] != zlib.crc32(image[:end]):
        raise CodedError("the head's checksum is wrong")
    doc_ids = [None if i == _NULL else i for i in np.frombuffer(image, "<i8", n_docs, at).tolist()]
    lengths = np.frombuffer(image, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    table = np.frombuffer(image, "<u4", 3 * n_blocks, at + 16 * n_docs).reshape(-1, 3)
    prior, _ = Prior.unpacked(image, tables)
    ends = end + 4 + np.cumsum(table[:, 1].astype(np.int64))
    coded = [image[e - n : e] for e, n in zip(ends.tolist(), table[:, 1].tolist())]
    blocks = decode_blocks(prior, coded, table[:, 0].tolist())
    for b, crc in zip(blocks, table[:, 2].tolist()):
        if zlib.crc32(b.astype("<u4").tobytes()) != crc:
            raise CodedError("a block's checksum is wrong")
    ids = np.concatenate(blocks).astype("<u4") if blocks else np.zeros(0, "<u4")
    if len(ids) != total or int(lengths.sum()) != total:
        raise CodedError("a file has another number of ids than it says")
    return doc_ids, lengths, ids


def write_files(docs: DataFrame, path: str, end_id: int = 1, spaced: bool = False, partitions: int | None = None) -> DataFrame:
    """Files of all documents in ascending order of doc_id, stored as rows (part, file, n_docs, n_ids, image). One shuffle, of the texts."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(path, spaced).encode, np.array([end_id], np.uint32)
        part, made = TaskContext.get().partitionId(), 0
        names, kinds = ["part", "file", "n_docs", "n_ids", "image"], [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

        def file(ids: list, texts: list) -> pa.RecordBatch:
            row = [part, made, len(ids), sum(map(len, texts)), to_file(ids, texts)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        ids: list = []
        texts: list[np.ndarray] = []
        total = 0
        for batch in batches:
            for rows in runs(list(zip(column(batch, "doc_id"), column(batch, "text"))), lambda r: len(r[1] or ""), 4_000_000):
                for (doc_id, _), found in zip(rows, encode([t for _, t in rows])):
                    if ids and total + len(found) + 1 > FILE_IDS:
                        yield file(ids, texts)
                        ids, texts, total, made = [], [], 0, made + 1
                    ids.append(doc_id)
                    texts.append(np.concatenate([found, end]))
                    total += len(found) + 1
        if ids:
            yield file(ids, texts)

    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(arrow_map(ordered, run, "part int, file int, n_docs long, n_ids long, image binary"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, by decoding them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, made, image = (batch.column(c)[k].as_py() for c in range(3))
                doc_ids, lengths, ids = from_file(image)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist())]
                m = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * m, pa.int32()), pa.array([made] * m, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())],
                    names=["part", "file", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    # What lies before a file: first by parts, then in its part.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("part", "file", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("ahead")).join(parts, "part")
    found = files.select("part", "file", "image").mapInArrow(run, "part int, file int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return found.join(bases, ["part", "file"]).select("doc_id", (F.col("base") + F.col("ahead") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
