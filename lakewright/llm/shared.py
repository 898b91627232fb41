"""What several operators of this subpackage use: written intermediate tables, text batches, cached tokenization."""

from __future__ import annotations

import functools
import itertools
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir() or "file://" + tempfile.gettempdir() + "/checkpoints/lakewright"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df stored as a table in the shared folder and read from it: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakewright/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, or what it takes to differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return (text or "").encode()


def crc_of_id(doc_id) -> int:
    """Unsigned crc32 of an id as decimal text; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def runs(items: list, weight: Callable, limit: int) -> Iterator[list]:
    """Consecutive runs of items whose weights stay under limit; a heavier item runs alone."""
    run, total = [], 0
    for item in items:
        w = weight(item)
        if run and total + w > limit:
            yield run
            run, total = [], 0
        run.append(item)
        total += w
    if run:
        yield run


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


#: Letters, digits and other numbers of Latin-1, by Unicode's categories.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
#: How the vocabulary that keeps white space splits what has none but a first space or line end, for Latin-1.
SPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|[\n\r]")
#: What stands between chunks, and between pieces, while many go together: white space that neither has.
BETWEEN = "\r"
#: What the other vocabulary tells apart: white space, runs of letters, single numbers, runs of all else. The kinds of Latin-1's characters, and of bytes; bytes in lower case.
SPACE, LETTER, NUMBER, OTHER = range(4)
KINDS = np.array([SPACE if chr(k) in "\t\n\v\f\r \x85\xa0" else LETTER if re.match(f"[{LETTERS}]", chr(k)) else NUMBER if re.match(f"[{NUMBERS}]", chr(k)) else OTHER for k in range(256)], np.uint8)
KIND_BYTES, LOWER_BYTES = KINDS[:128].tobytes() + bytes([OTHER]) * 128, bytes(range(256)).lower()
#: The first byte in UTF-8 of characters beyond Latin-1, at least.
WIDE = 0xC4


def byte_letters() -> dict[int, int]:
    """The character that byte-level vocabularies write for each byte: printable bytes stand for themselves, the rest follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(rest)}


class Ragged:
    """Rows of ids in one array."""

    def __init__(self):
        self.lengths, self.starts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])

    def add_lists(self, rows: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        self.add(np.fromiter(itertools.chain.from_iterable(rows), np.uint32, int(lengths.sum())), lengths)

    def take(self, at: np.ndarray) -> np.ndarray:
        """The ids of rows one after the other."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - lengths), lengths)]


def dense_pieces(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray, bool]:
    """(the pieces of texts in a row as UTF-8, how many come before the end of each text, whether any text leaves Latin-1), as the vocabulary without white space splits them.

    Pieces of Latin-1 are in lower case. Between two white spaces, what holds a character beyond Latin-1 is one piece, as it was written.
    """
    coded = [t.encode() for t in texts]
    # Each text has a space behind it, and the last one has enough for the longest contraction.
    joined = b" ".join(coded) + b"    "
    data, kind = (np.frombuffer(bytearray(joined.translate(table)), np.uint8) for table in (LOWER_BYTES, KIND_BYTES))
    lead = np.flatnonzero(data & 0xFE == 0xC2)
    code = (data[lead] & 1) << 6 | data[lead + 1]
    kind[lead] = kind[lead + 1] = KINDS[code]
    data[lead + 1] += ((code >= 0xC0) & (code <= 0xDE) & (code != 0xD7)).astype(np.uint8) << 5
    start = np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == NUMBER)
    start[lead + 1] = False
    solid = kind != SPACE
    start &= solid
    # Contractions: an apostrophe that no run holds takes some letters along.
    at = np.flatnonzero(data == ord("'"))
    at = at[(at == 0) | (kind[at - 1] != OTHER)]
    one, two = data[at + 1], data[at + 2]
    more = np.isin(one, list(b"stmd")) + 2 * (np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    at, more = at[more > 0], more[more > 0]
    start[at + 1] = False
    start[at + more + 1] |= kind[at + more + 1] == LETTER
    wide = bool(data.max() >= WIDE)
    if wide:
        first = solid & np.concatenate([[True], ~solid[:-1]])
        chunk = np.cumsum(first, dtype=np.int32)
        inside = np.zeros(int(chunk[-1]) + 1, bool)
        inside[chunk[data >= WIDE]] = True
        inside = inside.take(chunk) & solid
        start = np.where(inside, first, start)
        data = np.where(inside, np.frombuffer(joined, np.uint8), data)
    ends = np.searchsorted(np.flatnonzero(start), np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) + 1))
    data = data[solid]
    offsets = np.append(np.flatnonzero(start[solid]), len(data))
    pieces = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pieces.dictionary_encode(), ends, wide


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, each distinct chunk or piece encoded once.

    Both vocabularies split a text at white space before any merge. Where it is kept, the ids of a
    text whose white space is only single spaces and line ends are those of its white-space-delimited
    chunks in a row; texts with other white space go through the library whole. Where it is not, any
    text is split into its pieces at once. Pieces of Latin-1 are merged by the library's model; other
    chunks, and texts with a special token of the vocabulary, go through the library whole.
    """

    #: Chunks and pieces kept (without white space: pieces alone, as many as chunks), and characters of either; a full cache of pieces starts anew, one of chunks only where it misses more than so large a share.
    LIMIT, PIECES, CHARS, MISSES = 800_000, 400_000, 16_000_000, 0.2

    def __init__(self, path: str, spaced: bool):
        """spaced: the vocabulary keeps white space (a chunk then takes the space or line end before it along)."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = spaced
        self.letters = byte_letters()
        self._reset()
        self._reset_pieces()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.chars, self.ids = 0, Ragged()
        self.ids.add_lists([[]])

    def _reset_pieces(self) -> None:
        self.pieces: dict[str | bytes, int] = {}
        self.piece_chars, self.piece_ids = 0, Ragged()

    def _whole(self, texts: list[str]) -> list[list[int]]:
        found = []
        for run in runs(texts, len, 2_000_000):
            found += [e.ids for e in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)]
        return found

    def _merge(self, joined: bytes) -> None:
        """Add the ids of new pieces, given with BETWEEN between them."""
        tokenize, ids, lengths = self.tokenizer.model.tokenize, [], []
        for p in joined.decode("latin-1").translate(self.letters).split(chr(self.letters[ord(BETWEEN)])):
            found = tokenize(p)
            lengths.append(len(found))
            ids += [t.id for t in found]
        self.piece_ids.add(np.array(ids, np.uint32), np.array(lengths, np.int64))

    def _latin(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of Latin-1 chunks in a row, and how many each has: all are split at once, and each piece that isn't known is merged once."""
        found = SPACED.findall(BETWEEN.join(chunks))
        if len(self.pieces) > self.PIECES or self.piece_chars > self.CHARS:
            self._reset_pieces()
        new = [p for p in dict.fromkeys(found) if p not in self.pieces and p != BETWEEN]
        if new:
            joined = BETWEEN.join(new)
            self._merge(joined.encode())
            self.pieces.update(zip(new, range(len(self.pieces), len(self.pieces) + len(new))))
            self.piece_chars += len(joined)
        at = np.fromiter(map(self.pieces.get, found, itertools.repeat(-1)), np.int64, len(found))
        chunk = np.cumsum(at < 0)[at >= 0]
        at = at[at >= 0]
        return self.piece_ids.take(at), np.bincount(chunk, self.piece_ids.lengths[at], len(chunks)).astype(np.int64)

    def _encoded(self, chunks: list[str], ids: Ragged) -> tuple[list[str], range]:
        """Add the ids of chunks to ids: (chunks in their new order, their places there)."""
        latin = [c for c in chunks if c.isascii() or max(c) <= "\xff"]
        other = [c for c in chunks if not c.isascii() and max(c) > "\xff"]
        first = len(ids.lengths)
        # A chunk that follows a space is encoded with it.
        given = lambda some: [c if c[0] == "\n" else " " + c for c in some]
        if latin:
            ids.add(*self._latin(given(latin)))
        if other:
            ids.add_lists(self._whole(given(other)))
        return latin + other, range(first, first + len(chunks))

    def _odd(self, chunks: list[str]) -> list[str]:
        """Those chunks that are empty or hold white space of another kind."""
        cores = [c.removeprefix("\n") for c in chunks]
        return [] if " ".join(cores).split() == cores else [c for c, core in zip(chunks, cores) if core.split() != [core]]

    def _places(self, chunks: list[str], times: np.ndarray) -> tuple[Ragged, np.ndarray]:
        """(ids, the place in them of each of some distinct chunks that occur so many times); place 0 is that of odd chunks."""
        at = np.fromiter(map(self.index.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(at < 0)
        full = len(self.index) + len(missing) > self.LIMIT or self.chars > self.CHARS
        if full and times[missing].sum() > self.MISSES * times.sum():
            self._reset()
            missing, full = np.arange(len(chunks)), False
        if not len(missing):
            return self.ids, at
        new = [chunks[k] for k in missing.tolist()]
        odd = self._odd(new)
        found, ids = dict.fromkeys(odd, 0), self.ids
        if full:
            # Kept for this run only.
            ids = Ragged()
            ids.add(self.ids.flat, self.ids.lengths)
        found.update(zip(*self._encoded([c for c in new if c not in found] if odd else new, ids)))
        at[missing] = np.fromiter(map(found.__getitem__, new), np.int64, len(new))
        if not full:
            self.index.update(found)
            self.chars += sum(map(len, new))
        return ids, at

    def _run(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of texts that aren't empty, by their chunks; None where a text has white space of another kind."""
        # A chunk that starts a text or follows a line end has a line end before it.
        shown = [("\n" + t).replace("\n", " \n")[1:] for t in texts]
        rows = pc.split_pattern(pa.array(shown, pa.large_string()), " ")
        chunks = rows.flatten().dictionary_encode()
        which = chunks.indices.to_numpy()
        ids, at = self._places(chunks.dictionary.to_pylist(), np.bincount(which))
        at = at.take(which)
        first = rows.offsets.to_numpy().astype(np.int64)
        whole = np.minimum.reduceat(at, first[:-1]) > 0
        ends = np.concatenate([[0], np.cumsum(ids.lengths.take(at))]).take(first)
        found = ids.take(at)
        return [found[lo + 1 : hi] if ok else None for lo, hi, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), whole.tolist())]

    def _dense(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts by their pieces, where white space is not kept."""
        pieces, ends, wide = dense_pieces(texts)
        keys = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.pieces) > self.LIMIT or self.piece_chars > self.CHARS:
            self._reset_pieces()
        at = np.fromiter(map(self.pieces.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            n = len(missing)
            if wide:
                beyond = np.array([max(keys[k]) >= WIDE for k in missing.tolist()])
                n -= int(beyond.sum())
                missing = missing[np.argsort(beyond, kind="stable")]
            new = [keys[k] for k in missing.tolist()]
            if n:
                self._merge(BETWEEN.encode().join(new[:n]))
            self.piece_ids.add_lists(self._whole([p.decode() for p in new[n:]]))
            at[missing] = np.arange(len(self.pieces), len(self.pieces) + len(new))
            self.pieces.update(zip(new, at[missing].tolist()))
            self.piece_chars += sum(map(len, new))
        at = at.take(pieces.indices.to_numpy())
        found = self.piece_ids.take(at)
        ends = np.concatenate([[0], np.cumsum(self.piece_ids.lengths.take(at))]).take(ends).tolist()
        return [found[lo:hi] for lo, hi in zip([0, *ends], ends)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as uint32."""
        out: list[np.ndarray | None] = [None if t else np.zeros(0, np.uint32) for t in texts]
        for run in runs([i for i, t in enumerate(texts) if t and not any(s in t for s in self.special)], lambda i: len(texts[i]), 4_000_000):
            for i, ids in zip(run, (self._run if self.spaced else self._dense)([texts[i] for i in run])):
                out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._whole([texts[i] for i in rest])):
            out[i] = np.array(ids, np.uint32)
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, spaced: bool) -> ChunkEncoder:
    """One encoder a Python worker, kept between tasks."""
    return ChunkEncoder(path, spaced)


#: Rows and bytes of a batch between the JVM and Python, so that neither side holds more than a few copies of that.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow with bounded batches; a worker gives its buffers back when a partition ends. The session's own settings hold where they are smaller."""
    conf = df.sparkSession.conf
    for what, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.max{what}PerBatch"
        now = re.fullmatch(r"(\d+)b?", conf.get(name), re.I)
        if not now or not 0 < int(now[1]) <= most:
            conf.set(name, str(most))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)


def pieces_of(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further or clashing ones don't matter."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
