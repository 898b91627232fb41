"""Best-fit packing with swap-based local search: documents as token sequences of a fixed length.

A document is its ids and a closing one. Only documents longer than a sequence are cut, so that
every piece but the first is full. Pieces are dealt to bounded shards; in a shard best-fit
decreasing gives a first packing, then moves and exchanges between underfull bins (one for one,
two for one), each raising the sum of squared fills, empty bins.

Defined results: null and empty texts are the closing id alone; repeated rows are packed one by
one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, column, encoder, runs, written

#: A shard's tokens and pieces, at most in the mean; both bound a task's memory.
SHARD_TOKENS, SHARD_PIECES = 6_000_000, 60_000


def cut(length: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: the first may be shorter, all others are full."""
    first = length if length <= room else length % room or room
    return [(0, first), *((at, room) for at in range(first, length, room))]


def pieces(docs: DataFrame, path: str, end_id: int = 0, room: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, by one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, True).encode
        end = np.array([end_id], np.uint32)
        for batch in batches:
            kind = batch.schema.field(0).type
            for rows in runs(list(zip(column(batch, "doc_id"), column(batch, "text"))), lambda r: len(r[1] or ""), 4_000_000):
                out = []
                for (doc_id, _), ids in zip(rows, encode([t for _, t in rows])):
                    ids = np.concatenate([ids, end])
                    for k, (start, length) in enumerate(cut(len(ids), room)):
                        out.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes())))
                columns = list(zip(*out))
                kinds = [kind, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Bins of indices: each piece, longest first, goes where the least room stays."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    rooms = 0  # bit r: a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms ^= 1 << r
        else:
            r, b = room, len(bins)
            bins.append([])
        bins[b].append(i)
        left = r - n
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(b)
    return bins


def sums(lengths: list[int]) -> tuple[int, int]:
    """Bit sets of the lengths of single pieces, and of the sums of two."""
    ones = twos = 0
    for n in lengths:
        twos |= ones << n
        ones |= 1 << n
    return ones, twos


def above(found: int, most: int) -> int:
    """Bit set of the numbers that are 1 to most above one of those found."""
    out, span = found << 1, 1
    while span < most:
        step = min(span, most - span)
        out |= out << step
        span += step
    return out


def bits(found: int) -> list[int]:
    out = []
    while found:
        out.append((found & -found).bit_length() - 1)
        found &= found - 1
    return out


def local_search(bins: list[list[int]], lengths: np.ndarray, room: int) -> list[list[int]]:
    """Bins after moves and exchanges between underfull ones until none helps or no bin can go.

    The emptier bin gives: a piece moves into room elsewhere, or takes the place of one or two
    shorter pieces, or two of its pieces take the place of one. What it gets back is shorter by
    what the other bin gains, and the other bin is at least as full, so squares grow and the search
    ends: with a pass over all underfull bins, each against all others, that changes nothing.

    What an underfull bin would accept is kept as bit sets over sizes, one column a bin: from one
    piece or from two, and to be full or just fuller.
    """
    bins = [list(b) for b in bins]
    size = lengths.tolist()
    fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
    least = -(-int(fill.sum()) // room)
    used = len(bins)
    parts = [(0, 0)] * len(bins)
    width = room // 64 + 1
    accepts = np.zeros((4, width, len(bins)), np.uint64)

    def refresh(b: int) -> None:
        left = room - int(fill[b])
        if not 0 < left < room:
            accepts[:, :, b] = 0
            return
        ones, twos = parts[b] = sums([size[i] for i in bins[b]])
        for k, (taken, fits) in enumerate(((1 | ones | twos, lambda t: t << left), (ones, lambda t: t << left), (1 | ones | twos, lambda t: above(t, left)), (ones, lambda t: above(t, left)))):
            accepts[k, :, b] = np.frombuffer((fits(taken) & ((1 << room + 1) - 1)).to_bytes(8 * width, "little"), np.uint64)

    def partners(a: int) -> list[int]:
        """The bins that bin a can give to: one that gets full if there is any, or else all, the fullest first."""
        given = [np.frombuffer(g.to_bytes(8 * width, "little"), np.uint64) for g in parts[a]]
        allowed = fill >= fill[a]
        allowed[a] = False
        found = np.zeros(0, np.int64)
        for first in (0, 2):
            hits = np.zeros(len(bins), np.uint64)
            for k in (0, 1):
                for w in np.flatnonzero(given[k]).tolist():
                    hits |= accepts[first + k, w] & given[k][w]
            found = np.flatnonzero((hits != 0) & allowed)
            if len(found):
                found = found[np.argsort(-fill[found], kind="stable")]
                return found[:1].tolist() if first == 0 else found.tolist()
        return []

    def pieces_of(b: int, total: int) -> list[int]:
        """One piece of a bin, or else two, of a total length."""
        seen: dict[int, int] = {}
        for i in bins[b]:
            if size[i] == total:
                return [i]
        for i in bins[b]:
            if total - size[i] in seen:
                return [seen[total - size[i]], i]
            seen[size[i]] = i
        return []

    def improve(a: int) -> bool:
        """One change that takes from bin a and brings another bin as near to full as can be."""
        best = None  # (room left after it, other bin, given, taken)
        for b in partners(a):
            left = room - int(fill[b])
            ones, twos = parts[b]
            for given, taken in ((parts[a][0], 1 | ones | twos), (parts[a][1], ones)):
                for n in bits(given):
                    low = max(n - left, 0)
                    rest = taken >> low
                    t = low + (rest & -rest).bit_length() - 1
                    if rest and t < n and (best is None or left - n + t < best[0]):
                        best = (left - n + t, b, n, t)
        if best is None:
            return False
        _, b, n, t = best
        given, taken = pieces_of(a, n), pieces_of(b, t)
        bins[a] = [i for i in bins[a] if i not in given] + taken
        bins[b] = [i for i in bins[b] if i not in taken] + given
        fill[a] -= n - t
        fill[b] += n - t
        refresh(a)
        refresh(b)
        return True

    if used > least:
        for b in range(len(bins)):
            refresh(b)
    changed = True
    while changed and used > least:
        changed = False
        under = np.flatnonzero((fill > 0) & (fill < room))
        for a in under[np.argsort(fill[under], kind="stable")].tolist():
            while 0 < fill[a] < room and used > least and improve(a):
                changed = True
                used -= int(fill[a] == 0)
    return [b for b in bins if b]


def pack_lengths(lengths, room: int = 2048) -> list[list[int]]:
    lengths = np.asarray(lengths, np.int64)
    return local_search(best_fit(lengths, room), lengths, room) if len(lengths) else []


def pack(found: DataFrame, room: int = 2048) -> DataFrame:
    """found (as of pieces()) with sequence_id and offset. One shuffle, of the pieces' small rows."""
    found = written(found, "pieces")
    total, count = found.agg(F.sum("length"), F.count("*")).first()
    shards = max(1, -(-(total or 0) // SHARD_TOKENS), -(-count // SHARD_PIECES))
    # Copies of a row differ in their place in the table, so that no group of them fills a shard.
    place = F.monotonically_increasing_id()
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", place), F.lit(shards)).cast("int"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], kind="stable", ignore_index=True)
        lengths = group["length"].to_numpy(np.int64)
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for k, members in enumerate(pack_lengths(lengths, room)):
            n = lengths[members]
            sequence[members] = k
            offset[members] = np.cumsum(n) - n
        group["sequence_id"] = sequence + (group["shard"].to_numpy(np.int64) << 32)
        group["offset"] = offset
        return group.drop(columns="shard")

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)
    return dealt.groupBy("shard").applyInPandas(run, f"{columns}, sequence_id long, offset long")
