"""Katz backoff language model of any order, its counts in partitioned tables, and whole texts scored by it.

Tokens are words (A-Z lowered, split at ASCII white space) and one end for each text. A seen n-gram,
word w after context v, has probability d(c) c / c(v); an unseen one alpha(v) times the probability
of w after v without its first word, and so on down to p(w), a discounted share of all tokens; what
that leaves belongs to one unknown word. alpha(v) is exactly what v's n-grams leave over what their
last words leave one order below, so that every context sums to one. An unseen context backs off
with weight one. A text has one place before its first token, so that its first words have shorter
contexts.

Discounts are Good-Turing's, in Katz's form up to SMALL and by a log-linear fit of the counts of
counts beyond (and where the raw ones give none between 0 and 1), so that no context is left
without mass for the unseen.

Work goes by blocks of documents and buckets of keys. A block's text becomes one row of word keys
and places; it asks for each distinct word and n-gram once, with its training count, at the bucket
of the key's hash, which adds up the counts of all blocks and answers in the block's order. So a
frequent word costs one entry a block, tables are partitioned by key, and no group grows with a
word. Keys are 64-bit hashes.

Defined results: null and empty texts are the end alone; rows are scored one by one, with repeated
ids too; a null id counts as empty text for the held-out rule; without training texts every score
and base is 0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, crc_of_id, utf8, written
from .words import WHITE, hashed, mix

#: Tokens of a block, and keys that a bucket is asked for in the mean. Both bound a task's memory; on large executors both should be larger.
BLOCK_TOKENS, BUCKET_KEYS = 2_000_000, 2_000_000
#: Counts up to SMALL have Katz's discounts; the fit is over counts up to FIT.
SMALL, FIT = 5, 32
#: Keys of the end of a text and of the place before its first token.
END, START = np.uint64(1), np.uint64(2)


def packed(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences in as few bytes as the largest one takes."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    first, rest = steps[:1], steps[1:]
    width = max(1, (int(rest.max()).bit_length() + 7) // 8) if len(rest) else 1
    return bytes([width]) + first.tobytes() + rest.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    width = data[0]
    rest = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(rest) + 1, 8), np.uint8)
    steps[1:, :width] = rest
    steps = steps.view("<u8").ravel()
    steps[0] = np.frombuffer(data, "<u8", 1, 1)[0]
    return np.cumsum(steps, dtype=np.uint64)


def bucket_ends(keys: np.ndarray, buckets: int) -> np.ndarray:
    """For sorted keys, where each bucket's part begins and ends: buckets are equal ranges of the key's upper half."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))


def blocks(docs: DataFrame, held_mod: int = 7, held_rest: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each block: its documents, sorted distinct word keys, and the place of every token's key among them."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids: list = []
        words: list[np.ndarray] = []
        total, id_kind = 0, None

        def block() -> pa.RecordBatch:
            tokens = np.concatenate(words)
            keys, at = np.unique(tokens, return_inverse=True)
            held = np.array([crc_of_id(i) % held_mod == held_rest for i in ids], np.uint8)
            lengths = np.array([len(w) for w in words], np.uint32)
            row = [(part << 24) + made, len(tokens), int((held == 0).sum()), ids, packed(lengths), held.tobytes(), pack_keys(keys), packed(at.astype(np.uint32))]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(id_kind), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["block", "n_tokens", "n_learnt", "doc_ids", "lengths", "held", "keys", "places"])

        for batch in batches:
            id_kind = batch.schema.field(0).type
            doc_ids, texts = column(batch, "doc_id"), column(batch, "text")
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < 4_000_000):
                    size += len(texts[stop] or "")
                    stop += 1
                found, counts = hashed([utf8(t) for t in texts[at:stop]], WHITE)
                for i, doc in zip(range(at, stop), np.split(found, np.cumsum(counts)[:-1])):
                    ids.append(doc_ids[i])
                    words.append(np.append(doc, END))
                    total += len(doc) + 1
                    if total >= block_tokens:
                        yield block()
                        ids, words, total, made = [], [], 0, made + 1
                at = stop
        if ids:
            yield block()

    schema = f"block long, n_tokens long, n_learnt long, doc_ids array<{kind}>, lengths binary, held binary, keys binary, places binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Level:
    """A block's n-grams of one order: each token that has a whole context, and the distinct n-grams in key order."""

    def __init__(self, tokens: slice | np.ndarray, context: np.ndarray, context_keys: np.ndarray, word_keys: np.ndarray):
        # Places of the tokens in the block; all else is by these tokens, contexts as places among their keys.
        self.tokens, self.context, self.context_keys = tokens, context, context_keys
        gram = mix(context_keys[context] * np.uint64(0x9E3779B97F4A7C15) + word_keys)
        order = np.argsort(gram, kind="stable").astype(np.int32)
        gram = gram[order]
        head = np.ones(len(gram), bool)
        np.not_equal(gram[1:], gram[:-1], out=head[1:])
        self.keys = gram[head]
        self.gram = np.empty(len(gram), np.int32)
        self.gram[order] = np.cumsum(head, dtype=np.int32) - np.int32(1)
        self.example = order[head]  # a token with each n-gram

    def counts(self, learnt: np.ndarray) -> np.ndarray:
        """How often each n-gram occurs among the learnt of the block's tokens."""
        return np.bincount(self.gram[learnt[self.tokens]], minlength=len(self.keys))


class Block:
    """A block's tokens, its distinct words, and the n-grams of orders 2 and more."""

    def __init__(self, lengths: bytes, held: bytes, keys: bytes, places: bytes, order: int):
        self.lengths = unpacked(lengths, np.uint32).astype(np.int64)
        self.held = np.frombuffer(held, np.uint8).astype(bool)
        self.keys = unpack_keys(keys)
        self.word = unpacked(places, np.uint32).astype(np.int32)
        self.learnt = np.repeat(~self.held, self.lengths)
        first = np.cumsum(self.lengths) - self.lengths
        self.levels: dict[int, Level] = {}
        if order > 1:
            # The word before each token; after the last word's place comes that of the start.
            before = np.empty(len(self.word), np.int32)
            before[1:] = self.word[:-1]
            before[first] = len(self.keys)
            self.levels[2] = Level(slice(None), before, np.append(self.keys, START), self.keys[self.word])
        for n in range(3, order + 1):
            # A context is the shorter n-gram that ends at the token before.
            lower, whole = self.levels[n - 1], np.zeros(len(self.word), np.int32)
            whole[lower.tokens] = lower.gram
            tokens = np.flatnonzero(np.arange(len(self.word)) - np.repeat(first, self.lengths) >= n - 2)
            self.levels[n] = Level(tokens, whole[tokens - 1], lower.keys, self.keys[self.word[tokens]])

    def asked(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(order, keys, training counts)."""
        yield 1, self.keys, np.bincount(self.word[self.learnt], minlength=len(self.keys))
        for n, level in self.levels.items():
            yield n, level.keys, level.counts(self.learnt)


def answers(stored: DataFrame, buckets: int, order: int = 2) -> DataFrame:
    """(n, block, bucket, answer): for each key a block asks for, 2 * count + whether the block speaks for it. Block -1 has the bucket's counts of counts. One shuffle."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, *parts = (batch.column(c)[k].as_py() for c in range(5))
                rows = []
                for n, keys, counts in Block(*parts, order).asked():
                    ends = bucket_ends(keys, buckets)
                    for b, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                        if hi > lo:
                            rows.append((n, b, block, pack_keys(keys[lo:hi]), packed(counts[lo:hi].astype(np.uint32))))
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["n", "bucket", "block", "keys", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block", ignore_index=True)
        keys = [unpack_keys(k) for k in group["keys"]]
        ends = np.cumsum([len(k) for k in keys])
        counts = np.concatenate([unpacked(c, np.uint32) for c in group["counts"]])
        distinct, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(at, counts, len(distinct)).astype(np.int64)
        speaks = np.zeros(len(at), np.int64)
        speaks[first[total > 0]] = 1
        answer = total[at] << 1 | speaks
        values, times = np.unique(total[total > 0], return_counts=True)
        parts = [packed(a) for a in np.split(answer.astype(np.uint64), ends[:-1])]
        n, bucket = group["n"].iloc[0], group["bucket"].iloc[0]
        rows = [(n, b, bucket, a) for b, a in zip(group["block"].tolist(), parts)]
        rows.append((n, -1, bucket, packed(np.array([values, times], np.int64))))
        return pd.DataFrame(rows, columns=["n", "block", "bucket", "answer"])

    asked = stored.select("block", "lengths", "held", "keys", "places").mapInArrow(ask, "n int, bucket int, block long, keys binary, counts binary")
    return asked.groupBy("n", "bucket").applyInPandas(add, "n int, block long, bucket int, answer binary")


class Discounts:
    """Good-Turing discounts from the counts of counts 1 to FIT + 1."""

    def __init__(self, times: dict[int, int]):
        r = np.array([k for k in range(1, FIT + 1) if times.get(k)], float)
        slope = -2.0
        if len(r) > 1:
            z = np.array([times[int(k)] for k in r]) / np.gradient(r)
            slope = float(np.polyfit(np.log(r), np.log(z), 1)[0])
        self.slope = min(slope, -1.05)
        n = lambda k: times.get(k, 0)
        over = (SMALL + 1) * n(SMALL + 1) / n(1) if n(1) else 1.0
        self.small = self.fit(np.arange(1, SMALL + 1))
        for k in range(1, SMALL + 1):
            if over < 1 and n(k) and n(k + 1):
                d = ((k + 1) * n(k + 1) / (k * n(k)) - over) / (1 - over)
                if 0 < d < 1:
                    self.small[k - 1] = d

    def fit(self, counts: np.ndarray) -> np.ndarray:
        return (1 + 1 / np.maximum(counts, 1)) ** (self.slope + 1)

    def of(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts * np.where(counts <= SMALL, self.small[np.clip(counts, 1, SMALL) - 1], self.fit(counts))


def statistics(found: DataFrame) -> dict[tuple[int, str], float]:
    """Sums over all buckets: ("tokens", "types" and counts of counts) by order. About 2 * FIT numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values, times = unpacked(answer, np.int64).reshape(2, -1)
                rows += [(n, "tokens", int((values * times).sum())), (n, "types", int(times.sum()))]
                rows += [(n, str(v), t) for v, t in zip(values.tolist(), times.tolist()) if v <= FIT + 1]
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.string(), pa.int64()])], names=["n", "what", "value"])

    each = found.where("block = -1").select("n", "answer").mapInArrow(run, "n int, what string, value long")
    return {(r["n"], r["what"]): r["total"] for r in each.groupBy("n", "what").agg(F.sum("value").alias("total")).collect()}


def known_share(found: DataFrame, discounts: Discounts, tokens: int) -> float:
    """The sum of p(w) over all known words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for answer in batch.column(0).to_pylist():
                values, times = unpacked(answer, np.int64).reshape(2, -1)
                sums.append(float((discounts.of(values) * times).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.float64())], names=["s"])

    total = found.where("block = -1 and n = 1").select("answer").mapInArrow(run, "s double").agg(F.sum("s")).first()[0]
    return (total or 0.0) / tokens


def in_order(answers: pd.DataFrame, n: int) -> np.ndarray:
    rows = answers[answers["n"] == n].sort_values("bucket")
    return np.concatenate([np.zeros(0, np.uint64), *[unpacked(a, np.uint64) for a in rows["answer"]]]).astype(np.int64)


def score(docs: DataFrame, held_mod: int = 7, held_rest: int = 2, order: int = 2, block_tokens: int = BLOCK_TOKENS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text; the model of the given order learns from the texts that aren't held out."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    stored = written(blocks(docs, held_mod, held_rest, block_tokens), "blocks")
    total, texts = (n or 0 for n in stored.agg(F.sum("n_tokens"), F.sum("n_learnt")).first())  # texts: those learnt from
    buckets = max(1, -(-total // bucket_keys))
    found = written(answers(stored, buckets, order), "answers")
    sums = statistics(found)
    discounts = {n: Discounts({r: sums.get((n, str(r)), 0) for r in range(1, FIT + 2)}) for n in range(1, order + 1)}
    tokens, types = sums.get((1, "tokens"), 0), sums.get((1, "types"), 0)
    unknown = max(1 - known_share(found, discounts[1], tokens), 1e-12) if tokens else 1.0

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """What a block can say of its texts, and its part of the contexts' sums."""
        if not len(left):
            return pd.DataFrame([], columns=names)
        row = left.iloc[0]
        b = Block(row["lengths"], row["held"], row["keys"], row["places"], order)
        count = in_order(right, 1) >> 1
        p = np.where(count > 0, discounts[1].of(count) / max(tokens, 1), unknown)
        doc = np.repeat(np.arange(len(b.lengths), dtype=np.int32), b.lengths)
        counts, context_counts, speaks = {}, {2: np.append(count, texts)}, {}
        for n in b.levels:
            answer = in_order(right, n)
            counts[n], speaks[n] = answer >> 1, (answer & 1).astype(bool)
            context_counts[n + 1] = counts[n]
        out = []
        # From the highest order down: a token whose n-gram was seen is done, any other takes alpha of a seen context along.
        log_score, done = np.zeros(len(b.word)), np.zeros(len(b.word), bool)
        for n in sorted(b.levels, reverse=True):
            level, c = b.levels[n], counts[n]
            c_v = context_counts[n][level.context]
            seen_count = c[level.gram]
            open_ = ~done[level.tokens]
            seen = open_ & (seen_count > 0)
            log_score[level.tokens] += np.where(seen, np.log10(np.maximum(discounts[n].of(seen_count), 1e-300)) - np.log10(np.maximum(c_v, 1)), 0.0)
            done[level.tokens] |= seen
            # Texts ask for alpha of a context once for each open token after it.
            ask = np.flatnonzero(open_ & ~seen & (c_v > 0))
            size = len(level.context_keys)
            wanted, times = np.unique(doc[level.tokens][ask].astype(np.int64) * size + level.context[ask], return_counts=True)
            # Contexts whose sums this block has a part of, or asks for, in the order of their keys.
            own = level.example[speaks[n]]
            v, c = level.context[own], c[speaks[n]]
            if n == 2:
                below = p[b.word[level.tokens][own]]
            else:
                lower = b.levels[n - 1]
                place = np.zeros(len(b.word), np.int64)
                place[lower.tokens] = np.arange(len(lower.gram))
                at = place[level.tokens[own]]
                below = discounts[n - 1].of(counts[n - 1][lower.gram[at]]) / context_counts[n - 1][lower.context[at]]
            s1 = np.bincount(v, discounts[n].of(c), size)
            s2 = np.bincount(v, below, size)
            used = np.zeros(size, bool)
            used[v] = True
            used[level.context[ask]] = True
            some = np.flatnonzero(used)
            ranked = some[np.argsort(level.context_keys[some], kind="stable")]
            place = np.zeros(size, np.int64)
            place[ranked] = np.arange(len(ranked))
            entry = packed(np.array([wanted // max(size, 1), place[wanted % max(size, 1)], times], np.int64))
            out.append((int(key[0]), n, -1, None, None, None, entry))
            keys = level.context_keys[ranked]
            ends = bucket_ends(keys, buckets)
            s = np.array([s1[ranked] / np.maximum(context_counts[n][ranked], 1), s2[ranked]])
            for k, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                if hi > lo:
                    out.append((int(key[0]), n, k, None, pack_keys(keys[lo:hi]), None, packed(s[:, lo:hi])))
        log_score[~done] += np.log10(p)[b.word[~done]]
        base = np.log10(count + 1.0) - np.log10(tokens + types + 1.0)
        per_doc = [np.bincount(doc, x, len(b.lengths)) for x in (count[b.word] > 0, base[b.word], log_score)]
        out.append((int(key[0]), 1, -1, row["doc_ids"], row["lengths"], row["held"], packed(np.array(per_doc))))
        return pd.DataFrame(out, columns=names)

    names = ["block", "n", "bucket", "doc_ids", "a", "b", "c"]
    left = stored.drop("n_tokens", "n_learnt").groupBy("block")
    halves = left.cogroup(found.where("block >= 0").groupBy("block")).applyInPandas(meet, f"block long, n int, bucket int, doc_ids array<{kind}>, a binary, b binary, c binary")
    halves = written(halves, "halves")

    def weigh(group: pd.DataFrame) -> pd.DataFrame:
        """log10 alpha of the contexts of a bucket, for each block in its order."""
        group = group.sort_values("block", ignore_index=True)
        keys = [unpack_keys(k) for k in group["a"]]
        ends = np.cumsum([len(k) for k in keys])
        s = np.concatenate([unpacked(c, np.float64).reshape(2, -1) for c in group["c"]], axis=1)
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        left1, left2 = (1 - np.bincount(at, x, len(distinct)) for x in s)
        alpha = np.log10(np.maximum(left1, 1e-15)) - np.log10(np.maximum(left2, 1e-15))
        return pd.DataFrame({"block": group["block"], "n": group["n"], "bucket": group["bucket"], "alpha": [packed(a) for a in np.split(alpha[at], ends[:-1])]})

    parts = halves.where("bucket >= 0").select("block", "n", "bucket", "a", "c").groupBy("n", "bucket")
    alphas = written(parts.applyInPandas(weigh, "block long, n int, bucket int, alpha binary"), "alphas")

    def close(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame([], columns=out_names)
        row = left[left["n"] == 1].iloc[0]
        lengths, held = unpacked(row["a"], np.uint32).astype(np.int64), np.frombuffer(row["b"], np.uint8).astype(bool)
        known, base, total = unpacked(row["c"], np.float64).reshape(3, -1)
        right = right.sort_values("bucket")
        for n, entry in zip(left["n"], left["c"]):
            if n > 1:
                doc, at, times = unpacked(entry, np.int64).reshape(3, -1)
                alpha = np.concatenate([np.zeros(0), *[unpacked(a, np.float64) for a in right.loc[right["n"] == n, "alpha"]]])
                total = total + np.bincount(doc, alpha[at] * times, len(lengths))
        return pd.DataFrame(
            {"doc_id": pd.Series(list(row["doc_ids"]), dtype=object), "held_out": held, "n_tokens": lengths, "n_known": np.rint(known).astype(np.int64), "train_tokens": np.int64(tokens), "base_score": base, "score": total},
            columns=out_names,
        )

    out_names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    of_blocks = halves.where("bucket = -1").drop("bucket").groupBy("block")
    return of_blocks.cogroup(alphas.groupBy("block")).applyInPandas(
        close, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
