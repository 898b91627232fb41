import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewright.llm import coder
from lakewright.llm.queries import vocabulary

from .fixtures import clashing, docs, empty


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(1, 2**32), st.integers(0, 40))
def test_round_trip(ids, bound, repeats):
    ids = np.array(ids * (repeats + 1), np.uint64) % np.uint64(bound)
    ids = ids.astype(np.uint32)
    half = len(ids) // 2
    found_ids, lengths, found = coder.from_file(coder.to_file([7, None], [ids[:half], ids[half:]]))
    assert found_ids == [7, None] and lengths.tolist() == [half, len(ids) - half] and (found == ids).all()


#: Contractions, numbers, white space of all kinds, characters that change by normalization or lower case.
PARTS = ["'s", "'T", "'re", "'LL", "''", "don't", "'sun", "'real", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "1", "²3¼", "ÀÉÞ×÷ß", "ªµº", "…", "€", "e\u0301", "\u0301", "İ", "ẛ̣", "한각", "中文", "👍🏽", "Word", ",", ".'s"]


def test_faults_are_found():
    rng = np.random.default_rng(0)
    image = bytearray(coder.to_file([1], [rng.integers(0, 40_000, 5000).astype(np.uint32)]))
    for at in (5, 30, len(image) - 1500):
        broken = bytes(image[:at]) + bytes([image[at] ^ 0x55]) + bytes(image[at + 1 :])
        with pytest.raises(coder.CodedError):
            coder.from_file(broken)


def test_predictable_ids_are_short():
    assert len(coder.to_file([1], [np.array([1, 2, 3, 4] * 4096, np.uint32)])) < 1500


def test_blocks_decode_alone():
    ids = np.random.default_rng(2).zipf(1.3, 9000).astype(np.uint32) % 3000
    prior, coded = coder.encode_blocks(ids)
    blocks = coder.cut(ids)
    for k in (0, 2, len(blocks) - 1):
        assert (coder.decode_blocks(prior, [coded[k]], [len(blocks[k])])[0] == blocks[k]).all()


def test_shorter_than_order_0_and_zlib():
    """On real ids: under the entropy of single ids, and under what zlib makes of them."""
    import pyarrow.parquet as pq

    from lakewright.llm.shared import ChunkEncoder

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    ids = [np.append(i, 1).astype("<u4") for i in ChunkEncoder(vocabulary("word_bpe_49k.json"), False).encode(texts)]
    whole = np.concatenate(ids)
    share = np.unique(whole, return_counts=True)[1] / len(whole)
    order_0 = -(share * np.log2(share)).sum() * len(whole) / 8
    coded = len(coder.to_file(list(range(len(ids))), ids))
    assert coded < 0.9 * order_0 and coded < 0.9 * len(zlib.compress(whole.astype("<u2").tobytes(), 9))


def test_special_tokens_in_texts():
    from tokenizers import Tokenizer

    from lakewright.llm.shared import ChunkEncoder

    texts = ["a<|endoftext|>b", "plain words <|startoftext|> here", "an <|EndOfText|> of its own", "<|endoftext|>"]
    for name, spaced in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        t = Tokenizer.from_file(vocabulary(name))
        found = ChunkEncoder(vocabulary(name), spaced).encode(texts)
        assert [f.tolist() for f in found] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PARTS), st.characters(max_codepoint=0xFF), st.characters(exclude_categories=["Cs"])), max_size=12).map("".join), max_size=8))
def test_pieces_as_the_library_has_them(texts):
    from tokenizers import Tokenizer

    from lakewright.llm.shared import encoder

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    assert [f.tolist() for f in encoder(path, False).encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_only_new_pieces_are_merged():
    """Texts are split at once: whatever their white space, only what leaves Latin-1 goes through the library whole, and a piece that is known in any case or context isn't merged again."""
    from tokenizers import Tokenizer

    from lakewright.llm.shared import ChunkEncoder

    path = vocabulary("word_bpe_49k.json")
    t, found = Tokenizer.from_file(path), ChunkEncoder(path, False)
    whole, merged = [], []
    found._whole = lambda texts, f=found._whole: whole.extend(texts) or f(texts)
    first = ["plain words,\tDON'T  stop\x85here\xa0\r\nÀ l'été 12 “quoted” words", " ", None, "\x1c"]
    wanted = [t.encode(x or "", add_special_tokens=False).ids for x in first]
    assert [f.tolist() for f in found.encode(first)] == wanted and whole == ["“quoted”"]
    found._merge = lambda joined, f=found._merge: merged.append(joined) or f(joined)
    again = ["(Été) here, WORDS l'12 “quoted”", "Stop, plain"]
    assert [f.tolist() for f in found.encode(again)] == [t.encode(x, add_special_tokens=False).ids for x in again]
    assert whole == ["“quoted”"] and merged == [b"(\r)"]


def test_files(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    df = docs(spark)
    order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "")
    wanted, start = [], 0
    for r in sorted(df.collect(), key=order):
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        wanted.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = coder.read_files(coder.write_files(clashing(df), path, partitions=3))
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == wanted
    assert coder.read_files(coder.write_files(empty(spark), path)).count() == 0
