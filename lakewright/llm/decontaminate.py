"""Benchmark decontamination with suffix arrays of the training texts.

Documents are taken shard by shard. A shard's suffix array lists all places of its words in the
order of the words that follow them, and binary search finds test words in it: mark() looks up
every window of the test items and follows each occurrence to the end of its verbatim match;
longest_matches() looks up every test suffix and gives its longest match of any length, and where.

Defined results: null and empty texts have no words and are clean; an item without words matches
nothing; an item without item_id has an empty one; repeated items count once by item_id; repeated
documents are judged one by one; of equally long matches that first in the document counts, then
the smallest item_id (as text) and place in it; empty tables give no rows or only clean ones;
further columns of docs, of any name, pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_map, runs, unused, utf8, written
from .words import ALPHANUMERIC, hashed

#: Words of a window; words by which the array is ordered.
WINDOW, DEPTH = 10, 12
#: Characters of text in a shard; bytes of test text that are broadcast at once. More test text goes slice by slice.
SHARD_BYTES, SLICE_BYTES = 2_000_000, 16_000_000


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges one after the other: (which range, number in it counted from first)."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


@dataclass
class Tests:
    """Test items: their words in a row, all suffixes, and distinct windows with every place where they stand."""

    ids: list[str]  # of the items, in their order as text
    words: np.ndarray
    stop: np.ndarray  # for every word where its item ends
    item: np.ndarray  # for every word its item's number
    start: np.ndarray  # for every word its number in the item
    windows: np.ndarray  # a place of each distinct window
    lengths: np.ndarray  # words of each window
    of_window: np.ndarray  # places of the first window, the second, ...
    ends: np.ndarray  # where each window's places end

    @classmethod
    def of(cls, rows: list[tuple]) -> Tests:
        named = sorted({("" if i is None else str(i), utf8(t)) for i, t in rows})
        words, counts = hashed([t for _, t in named], ALPHANUMERIC)
        counts = counts.astype(np.int64)
        first = np.cumsum(counts) - counts
        ids = sorted({i for i, _ in named})
        number = {i: k for k, i in enumerate(ids)}
        spread_out = lambda a: np.repeat(np.asarray(a, np.int64), counts)
        stop, start = spread_out(first + counts), np.arange(len(words)) - spread_out(first)
        # A window begins wherever WINDOW words are left, or where a shorter item does.
        begins = np.flatnonzero((stop - np.arange(len(words)) >= WINDOW) | (start == 0))
        at = np.minimum(begins[:, None] + np.arange(WINDOW), np.maximum(stop[begins] - 1, 0)[:, None])
        rows_ = np.where(begins[:, None] + np.arange(WINDOW) < stop[begins][:, None], words[at], 0) if len(begins) else np.zeros((0, WINDOW), np.uint64)
        _, one, inverse = np.unique(rows_, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        lengths = np.minimum(stop - np.arange(len(words)), WINDOW)[begins[one]]
        return cls(ids, words, stop, spread_out([number[i] for i, _ in named]), start, begins[one], lengths, begins[order], np.cumsum(np.bincount(inverse.ravel(), minlength=len(one))))


class SuffixArray:
    """All places of a shard's words in the order of the DEPTH words from there on.

    Words are numbered in their order in the shard, and as many numbers as fit go into one integer,
    so that a place has a few keys. Between texts stands a 0, below all words.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.words = words
        counts = counts.astype(np.int64)
        self.first = np.cumsum(counts) - counts
        self.end = np.repeat(self.first + counts, counts)
        self.distinct, number = np.unique(words, return_inverse=True)
        bits = max(1, (2 * len(self.distinct) + 1).bit_length())
        self.bits, self.each = np.uint64(bits), min(64 // bits, DEPTH)
        codes = np.zeros(len(words) + len(counts) + DEPTH + self.each, np.uint64)
        gap = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(words)) + gap
        codes[place] = 2 * number.ravel().astype(np.uint64) + np.uint64(2)
        packed = self.packed(codes, len(words) + len(counts) + DEPTH)
        keys = [packed[place + k] for k in range(0, DEPTH, self.each)]
        self.place = np.lexsort(keys[::-1]) if len(words) else np.zeros(0, np.int64)
        self.keys = [k[self.place] for k in keys]

    def packed(self, codes: np.ndarray, n: int) -> np.ndarray:
        """From each of n places on, as many numbers as one key holds."""
        found = np.zeros(n, np.uint64)
        for k in range(self.each):
            found = found << self.bits | codes[k : k + n]
        return found

    def coded(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words; one that the shard doesn't have stands between its neighbours."""
        at = np.searchsorted(self.distinct, words)
        has = self.distinct[np.minimum(at, len(self.distinct) - 1)] == words
        return (2 * at + 1 + has).astype(np.uint64)

    def search(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search: where the places from key rows low up to high (equal up to one column, then all there is) begin and end."""
        n = len(self.place)
        lo, hi = np.searchsorted(self.keys[0], low[:, 0]), np.searchsorted(self.keys[0], high[:, 0], "right")
        for c in range(1, len(self.keys)):
            column = self.keys[c]
            bounds = []
            for value, right in ((low[:, c], False), (high[:, c], True)):
                a, b = lo.copy(), hi.copy()
                some = np.flatnonzero(a < b)
                while len(some):
                    mid = (a[some] + b[some]) >> 1
                    found = column[np.minimum(mid, n - 1)]
                    before = found <= value[some] if right else found < value[some]
                    a[some] = np.where(before, mid + 1, a[some])
                    b[some] = np.where(before, b[some], mid)
                    some = some[a[some] < b[some]]
                bounds.append(a)
            lo, hi = bounds
        return lo, hi

    def key_rows(self, words: np.ndarray, at: np.ndarray, length: np.ndarray, filler: bool) -> np.ndarray:
        """Key rows of up to DEPTH words from each place; beyond length (or the end of words) 0 or, as filler, the largest number."""
        codes = np.concatenate([self.coded(words), np.zeros(DEPTH, np.uint64)])
        found = codes[at[:, None] + np.arange(DEPTH)]
        found[np.arange(DEPTH) >= length[:, None]] = (np.uint64(1) << self.bits) - np.uint64(1) if filler else 0
        width = -(-DEPTH // self.each)
        rows = np.full((len(at), width * self.each), found.dtype.type((1 << int(self.bits)) - 1) if filler else 0, np.uint64)
        rows[:, :DEPTH] = found
        out = np.zeros((len(at), width), np.uint64)
        for k in range(self.each):
            out = out << self.bits | rows[:, k :: self.each]
        return out

    def follow(self, tests: Tests, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the verbatim matches of the test words from a on and the shard's from b on."""
        room = np.minimum(tests.stop[a] - a, self.end[b] - b)
        length = np.zeros(len(a), np.int64)
        going = np.flatnonzero(room > 0)
        while len(going):
            going = going[tests.words[a[going] + length[going]] == self.words[b[going] + length[going]]]
            length[going] += 1
            going = going[length[going] < room[going]]
        return length

    def windows(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """(window number, place) of every occurrence of a window."""
        if not len(self.place) or not len(tests.windows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = lambda filler: self.key_rows(tests.words, tests.windows, tests.lengths, filler)
        lo, hi = self.search(rows(False), rows(True))
        window, row = spread(lo, np.maximum(hi - lo, 0))
        return window, self.place[row]

    def longest(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """(length, place) of the longest verbatim match of every test suffix: beside where it would stand."""
        start = np.arange(len(tests.words))
        best, where = np.zeros(len(start), np.int64), np.full(len(start), -1, np.int64)
        if not len(self.place) or not len(start):
            return best, where
        rows = self.key_rows(tests.words, start, tests.stop - start, False)
        lo, hi = self.search(rows, rows)
        # Rows equal in all keys are not ordered further, so all of them are tried.
        first, last = np.maximum(lo - 1, 0), np.minimum(hi + 1, len(self.place))
        suffix, row = spread(first, last - first)
        b = self.place[row]
        length = self.follow(tests, start[suffix], b)
        order = np.lexsort((b, -length, suffix))
        pick = order[np.concatenate([[True], suffix[order][1:] != suffix[order][:-1]])]
        best[suffix[pick]] = length[pick]
        where[suffix[pick]] = np.where(length[pick] > 0, b[pick], -1)
        return best, where


def spans(flags: np.ndarray) -> list[dict]:
    """Runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())]


HITS = "n_words long, n_hit long, items array<string>, longest long, place long, item string, start long"
SPANS = ", spans array<struct<start:long,end:long>>"


def judged(texts: list[bytes], tests: Tests, with_spans: bool) -> list[dict]:
    """What a shard's texts share with the tests: the fields of HITS for each."""
    words, counts = hashed(texts, ALPHANUMERIC)
    out = [{"n_words": n, "n_hit": 0, "items": [], "longest": 0} for n in counts.tolist()]
    shard = SuffixArray(words, counts)
    window, place = shard.windows(tests)
    if not len(place):
        return out
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + tests.lengths[window], -1)
    hit = np.cumsum(change)[:-1] > 0
    # Every place of the window in the tests, and how far the match goes from there.
    which, row = spread(np.concatenate([[0], tests.ends[:-1]])[window], np.diff(tests.ends, prepend=0)[window])
    a, b = tests.of_window[row], place[which]
    length = shard.follow(tests, a, b)
    # Texts without words share their first place with the next text; the last of them owns it.
    doc = np.searchsorted(shard.first, b, side="right") - 1
    order = np.lexsort((tests.start[a], tests.item[a], b, -length, doc))
    head = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
    for k in head.tolist():
        d = int(doc[k])
        out[d] |= {"longest": int(length[k]), "place": int(b[k] - shard.first[d]), "item": tests.ids[tests.item[a[k]]], "start": int(tests.start[a[k]])}
    for d, i in np.unique(np.column_stack([doc, tests.item[a]]), axis=0).tolist():
        out[d]["items"].append(tests.ids[i])
    for d in np.unique(doc).tolist():
        flags = hit[shard.first[d] : shard.first[d] + counts[d]]
        out[d]["n_hit"] = int(flags.sum())
        if with_spans:
            out[d]["spans"] = spans(flags)
    return out


def slices(benchmark: DataFrame) -> list[DataFrame]:
    """The test items in slices of about SLICE_BYTES."""
    size = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = -(-size // SLICE_BYTES) or 1
    rows = benchmark.select("item_id", "text")
    return [rows] if count == 1 else [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) for k in range(count)]


_tests: dict[str, Tests] = {}


def broadcast_tests(part: DataFrame):
    """A slice of the tests (SLICE_BYTES or so) for all tasks; a worker builds it once."""
    rows, key = part.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part.collect()]), uuid.uuid4().hex

    def get() -> Tests:
        if key not in _tests:
            _tests.clear()
            _tests[key] = Tests.of(rows.value)
        return _tests[key]

    return get


def _scan(docs: DataFrame, part: DataFrame, name: str, with_spans: bool) -> DataFrame:
    """docs with a column of their hits on a slice of the tests; no shuffle."""
    get, at = broadcast_tests(part), docs.columns.index("text")
    fields = T._parse_datatype_string(HITS + SPANS * with_spans)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, fields)])
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "bigint": pa.int64()}
    kind = pa.struct([(f.name, kinds.get(f.dataType.simpleString(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))) for f in fields.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = get()
        for batch in batches:
            found = []
            for some in runs(batch.column(at).to_pylist(), lambda t: len(t or ""), SHARD_BYTES):
                found += judged([utf8(t) for t in some], tests, with_spans)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, name])

    return arrow_map(docs, run, schema)


def mark(docs: DataFrame, benchmark: DataFrame, name: str = "hits") -> DataFrame:
    """docs with one more column, a struct of HITS: numbers of words and of hit ones, ids of the items found (sorted as text), and the longest verbatim match of WINDOW words or of a whole shorter item: its length, place in the document, item and start there."""
    parts = slices(benchmark)
    if len(parts) == 1:
        return _scan(docs, parts[0], name, False)
    row = unused(docs, "row")
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "docs")
    keyed = docs.select(F.col(row).alias("row"), "text")
    found = None
    for part in parts:
        one = written(_scan(keyed, part, "hits", True).select("row", "hits.*"), "hits")
        found = one if found is None else found.unionByName(one)

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(int(group["n_words"].iloc[0]), bool)
        for some in group["spans"]:
            for s in some:
                flags[s["start"] : s["end"]] = True
        best = min(group.itertuples(), key=lambda r: (-r.longest, r.place, r.item, r.start))
        items = sorted({i for some in group["items"] for i in some})
        return pd.DataFrame([{"row": best.row, "n_words": len(flags), "n_hit": int(flags.sum()), "items": items, "longest": best.longest, "place": best.place, "item": best.item, "start": best.start}])

    hit = found.where("n_hit > 0").groupBy("row").applyInPandas(joined, f"row long, {HITS}")
    clean = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.max("n_hit").alias("n_hit")).where("n_hit = 0")
    clean = clean.selectExpr("row", "n_words", "n_hit", "cast(array() as array<string>) AS items", "0L AS longest", "cast(null as long) AS place", "cast(null as string) AS item", "cast(null as long) AS start")
    fields = [f.name for f in T._parse_datatype_string(HITS).fields]
    both = hit.unionByName(clean).select(F.col("row").alias(row), F.struct(*fields).alias(name))
    return docs.join(both, row).drop(row)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: counts of its words and hits, a digest of the items found in it, and its longest verbatim match and where that is."""
    return mark(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
        F.col("hits.longest").alias("longest_match"),
        F.col("hits.place").alias("match_place"),
        F.col("hits.item").alias("match_item"),
        F.col("hits.start").alias("match_start"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a window of a test item."""
    name = unused(docs, "hits")
    return mark(docs, benchmark, name).where(F.col(f"{name}.n_hit") == 0).drop(name)


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For every test suffix whose first word is in a document: item_id, start, the longest match's length, and the document and word where it is."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = None
    for part in slices(benchmark):

        def run(batches: Iterator[pa.RecordBatch], get=broadcast_tests(part)) -> Iterator[pa.RecordBatch]:
            tests = get()
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for some in runs(list(zip(ids, batch.column(1).to_pylist())), lambda r: len(r[1] or ""), SHARD_BYTES):
                    words, counts = hashed([utf8(t) for _, t in some], ALPHANUMERIC)
                    shard = SuffixArray(words, counts)
                    length, place = shard.longest(tests)
                    suffix = np.flatnonzero(length > 0)
                    doc = np.searchsorted(shard.first, place[suffix], side="right") - 1
                    columns = [
                        pa.array([tests.ids[i] for i in tests.item[suffix].tolist()], pa.string()),
                        pa.array(tests.start[suffix], pa.int64()),
                        pa.array(length[suffix], pa.int64()),
                        pa.array([some[d][0] for d in doc.tolist()], batch.schema.field(0).type),
                        pa.array(place[suffix] - shard.first[doc], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["item_id", "start", "length", "doc_id", "place"])

        one = arrow_map(docs.select("doc_id", "text"), run, f"item_id string, start long, length long, doc_id {kind}, place long")
        found = one if found is None else found.unionByName(one)
    best = F.max_by(F.struct("length", "doc_id", "place"), F.struct("length", -F.col("doc_id"), -F.col("place"))).alias("m")
    return found.groupBy("item_id", "start").agg(best).select("item_id", "start", "m.*")
