"""Edit-aware token counts: a segment tree over each document's pre-tokens.

A tree's leaves are blocks of pre-tokens with their characters and token counts; inner nodes hold
sums. An edit re-splits text from the pre-token that the characters before the edit could change,
up to where the new split meets an old boundary behind the edit; only the pre-tokens between are
encoded again, and only the sums above them change. Counts equal those of encoding the new text.

Defined results: null texts are empty and have no tokens; an edit's place and length are cut to
the text it meets, null edits, inserts and removals are empty; a document without edits keeps its
count; repeated rows are counted one by one; empty tables give no rows; further columns of the
documents are ignored. Edits without a document have no result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LETTERS, NUMBERS, column, runs

#: Pre-tokens of a leaf when built, and at most.
LEAF, FULL = 64, 192
#: Characters before an edit that a pre-token ending there may have looked at.
CONTEXT = 3
#: Pre-tokens whose counts a worker keeps.
KEPT = 300_000
#: Fixed value: white space of Latin-1 by Unicode's property.
WHITE = r"\t-\r \x85\xa0"
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{WHITE}{LETTERS}{NUMBERS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


@functools.lru_cache(maxsize=2)
class Counter:
    """Token counts of pre-tokens by the ranks of a vocabulary, each distinct one encoded once."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.general = regex.compile(public_tokenizers.PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.known: dict[str, int] = {}
        self.encoded = 0

    def pattern(self, text: str):
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.general
        return LATIN

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > KEPT:
            known.clear()
        out = []
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = known[p] = len(self.encode(p))
            out.append(n)
        return out


class CountTree:
    """Sums of characters and tokens over leaves of pre-tokens."""

    def __init__(self, lengths: list[int], counts: list[int]):
        self.leaves = [(lengths[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, len(lengths), LEAF)] or [([], [])]
        self._sum_all()

    def _sum_all(self) -> None:
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, (lengths, counts) in enumerate(self.leaves):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(lengths), sum(counts)
        for k in range(self.width - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _sum_above(self, leaf: int) -> None:
        k = self.width + leaf
        self.chars[k], self.tokens[k] = sum(self.leaves[leaf][0]), sum(self.leaves[leaf][1])
        k >>= 1
        while k:
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
            k >>= 1

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, place: int) -> tuple[int, int, int]:
        """(leaf, pre-token in it, its first character) of the pre-token over a character, the last one beyond the end."""
        k, at = 1, 0
        place = max(0, min(place, self.chars[1] - 1))
        while k < self.width:
            k *= 2
            if place >= at + self.chars[k]:
                at += self.chars[k]
                k += 1
        leaf = k - self.width
        j = 0
        for j, n in enumerate(self.leaves[leaf][0]):
            if place < at + n:
                break
            at += n
        return leaf, j, at

    def replace(self, first: tuple[int, int], last: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        """Put pre-tokens in place of those from first up to, not with, last."""
        (a, i), (b, j) = first, last
        lengths = self.leaves[a][0][:i] + lengths + self.leaves[b][0][j:]
        counts = self.leaves[a][1][:i] + counts + self.leaves[b][1][j:]
        if a == b and len(lengths) <= FULL:
            self.leaves[a] = (lengths, counts)
            self._sum_above(a)
        else:
            self.leaves[a : b + 1] = [(lengths[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, len(lengths), LEAF)]
            self.leaves = self.leaves or [([], [])]
            self._sum_all()

    def packed(self) -> bytes:
        """Lengths and counts of all pre-tokens."""
        pairs = [(n, c) for lengths, counts in self.leaves for n, c in zip(lengths, counts)]
        return np.array(pairs, "<u4").reshape(-1, 2).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> CountTree:
        pairs = np.frombuffer(data, "<u4").reshape(-1, 2)
        return cls(pairs[:, 0].tolist(), pairs[:, 1].tolist())


def planted(text: str, counter: Counter) -> CountTree:
    pieces = counter.pattern(text).findall(text)
    return CountTree(list(map(len, pieces)), counter.counts(pieces))


def edited(text: str, tree: CountTree, place: int, removed: int, inserted: str, counter: Counter) -> tuple[str, int]:
    """(the new text, pre-tokens encoded again); the tree follows."""
    place = max(0, min(place, len(text)))
    stop = min(len(text), place + max(0, removed))
    new = text[:place] + inserted + text[stop:]
    shift = len(new) - len(text)
    split = counter.pattern(new)
    if not text or split is not counter.pattern(text):
        # The other pattern splits alike; a text that was empty has no boundary to start from.
        fresh = planted(new, counter)
        tree.leaves, tree.width, tree.chars, tree.tokens = fresh.leaves, fresh.width, fresh.chars, fresh.tokens
        return new, sum(len(l) for l, _ in tree.leaves)
    leaf, j, at = tree.find(place - CONTEXT)
    first, scan = (leaf, j), at
    # Old boundaries from the end of the removed text on, one after the other.
    old = at
    pieces: list[str] = []
    while True:
        if scan >= place + len(inserted):
            target = scan - shift  # this boundary in the old text
            while old < target and leaf < len(tree.leaves):
                if j < len(tree.leaves[leaf][0]):
                    old += tree.leaves[leaf][0][j]
                    j += 1
                else:
                    leaf, j = leaf + 1, 0
            if old == target and old >= stop:
                break
        m = split.match(new, scan)
        if m is None:
            break
        pieces.append(m[0])
        scan = m.end()
    if leaf == len(tree.leaves):
        leaf, j = leaf - 1, len(tree.leaves[-1][0])
    tree.replace(first, (leaf, j), list(map(len, pieces)), counter.counts(pieces))
    return new, len(pieces)


def plant(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, tree, n_tokens and the columns of keep: the state that edits are applied to. No shuffle."""
    fields = [docs.schema["doc_id"], *(docs.schema[c] for c in keep)]
    schema = ", ".join([f"doc_id {fields[0].dataType.simpleString()}, text string, tree binary, n_tokens long", *(f"{f.name} {f.dataType.simpleString()}" for f in fields[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            at = 0
            for texts in runs(column(batch, "text"), lambda t: len(t or ""), 2_000_000):
                trees = [planted(t or "", counter) for t in texts]
                own = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array([t or "" for t in texts], pa.string()), pa.array([t.packed() for t in trees], pa.binary()), pa.array([t.total for t in trees], pa.int64()), *own.columns[2:]],
                    names=["doc_id", "text", "tree", "n_tokens", *keep],
                )

    return docs.select("doc_id", "text", *keep).mapInArrow(run, schema)


def apply_lists(state: DataFrame, path: str, edits: str = "edits") -> DataFrame:
    """The state after each row's edits, an array of (place, removed, inserted) applied in order; also n_before and n_encoded, the pre-tokens encoded again."""
    kind = state.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            at = 0
            for size in map(len, runs(batch.column(1).to_pylist(), lambda t: len(t or ""), 2_000_000)):
                part, out = batch.slice(at, size), []
                at += size
                for doc_id, text, packed, before, todo in zip(*(column(part, c) for c in ("doc_id", "text", "tree", "n_tokens", edits))):
                    tree, again = CountTree.unpacked(packed), 0
                    for e in todo or []:
                        if e is not None:
                            text, n = edited(text, tree, e["place"] or 0, e["removed"] or 0, e["inserted"] or "", counter)
                            again += n
                    out.append((doc_id, text, tree.packed(), before, tree.total, again))
                kinds = [batch.schema.field(0).type, pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "text", "tree", "n_before", "n_tokens", "n_encoded"])

    return state.select("doc_id", "text", "tree", "n_tokens", edits).mapInArrow(run, f"doc_id {kind}, text string, tree binary, n_before long, n_tokens long, n_encoded long")


def apply_edits(state: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """The state after edits (doc_id, seq, place, removed, inserted), each document's in the order of seq. One join on doc_id."""
    of_doc = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "place", "removed", "inserted"))).alias("edits"))
    return apply_lists(state.join(of_doc, "doc_id", "left"), path)


def drawn_edits(doc_id, text):
    """Three edits of a document, drawn from its id: an insert, a removal, a replacement."""
    size = F.length(F.coalesce(text, F.lit("")))
    place = lambda k: F.pmod(F.xxhash64(doc_id, F.lit(k)), size + 1).cast("long")
    edit = lambda p, n, s: F.struct(p.alias("place"), F.lit(n).cast("long").alias("removed"), F.lit(s).alias("inserted"))
    return F.array(edit(place(1), 0, " they're 42"), edit(place(2), 37, ""), edit(place(3), 5, "\n\n  l'été's"))


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_before, n_tokens, n_encoded of every document after its drawn edits."""
    docs = docs.withColumn("edits", drawn_edits(F.col("doc_id"), F.col("text")))
    return apply_lists(plant(docs, path, ("edits",)), path).select("doc_id", "n_before", "n_tokens", "n_encoded")
