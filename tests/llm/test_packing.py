import collections
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewright.llm import packing
from lakewright.llm.queries import vocabulary

from .fixtures import clashing, docs, empty


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_bins(lengths):
    bins = packing.pack_lengths(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= len(packing.best_fit(np.array(lengths, np.int64), 64))


def test_search_empties_bins():
    rng = np.random.default_rng(1)
    lengths = rng.integers(300, 1200, 1500)
    first = packing.best_fit(lengths, 2048)
    found = packing.local_search(first, lengths, 2048)
    assert len(found) < len(first)
    assert sorted(i for b in found for i in b) == list(range(len(lengths)))


def helpful(bins, lengths, room):
    """Whether a move, or an exchange of one for one or two or of two for one, fills a bin that is at least as full as the giving one."""
    fills = [sum(lengths[i] for i in b) for b in bins]
    ones = [{lengths[i] for i in b} for b in bins]
    twos = [{lengths[i] + lengths[j] for k, i in enumerate(b) for j in b[:k]} for b in bins]
    for a in range(len(bins)):
        for b in range(len(bins)):
            left = room - fills[b]
            if a == b or not fills[a] <= fills[b] < room:
                continue
            if any(0 < n - t <= left for n in ones[a] for t in {0} | ones[b] | twos[b]) or any(0 < n - t <= left for n in twos[a] for t in ones[b]):
                return True
    return False


def test_search_ends_where_nothing_helps():
    rng = np.random.default_rng(5)
    ended = 0
    for low, high, count, room in [(300, 1200, 1500, 2048), (600, 1100, 1000, 2048), (22, 29, 900, 64), (14, 31, 900, 80)]:
        lengths = rng.integers(low, high, count)
        found = packing.local_search(packing.best_fit(lengths, room), lengths, room)
        if len(found) > -(-int(lengths.sum()) // room):
            ended += 1
            assert not helpful(found, lengths.tolist(), room)
    assert ended >= 2


def test_cut():
    assert packing.cut(2048, 2048) == [(0, 2048)]
    assert packing.cut(2049, 2048) == [(0, 1), (1, 2048)]
    assert packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]


def test_pack(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    df = docs(spark)
    wanted = collections.Counter()
    for r in df.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (start, n) in enumerate(packing.cut(len(ids), 2048)):
            wanted[r["doc_id"], k, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    rows = packing.pack(packing.pieces(clashing(df), path)).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.pack(packing.pieces(empty(spark), path)).count() == 0
