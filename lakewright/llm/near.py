"""N-gram Jaccard join by MinHash banding.

Texts are lower-cased (A-Z) and split at ASCII white space; a text's n-grams are its runs of five
words, or all its words if there are fewer. Copies of one word sequence are one node. Nodes meet
in buckets of equal bands; whole buckets, not pairs, are linked into candidate groups, and within
these all pairs of nodes are verified on their full n-gram sets, in blocks of bounded size.

Defined results: texts without words (null, empty, white space) are copies of each other; repeated
rows are copies; null ids never name a class unless a class has no other; empty tables give no
rows; further columns are ignored by join() and kept by dedupe().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import arrow_map, runs, unused, utf8, written
from .words import WHITE, hashed, mix, ngrams

N, THRESHOLD, RECALL, MAX_BANDS = 5, 0.8, 0.9999, 32
#: Nodes and n-grams of a block of a candidate group; n-grams of a bundle of small groups; candidate nodes, and ids, that are broadcast at most (about 50 MB); characters hashed at once.
BLOCK_NODES, BLOCK_GRAMS, BUNDLE_GRAMS, BROADCAST_NODES, BROADCAST_IDS, PART = 256, 1_000_000, 1_000_000, 500_000, 2_000_000, 1_000_000


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest chance meetings, with which a pair at the threshold meets at the given recall."""
    for rows in range(16, 1, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands <= most:
            return bands, rows
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1


def sequence_keys(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each text's word sequence."""
    first = np.cumsum(counts) - counts
    place = np.arange(len(words)) - np.repeat(first, counts)
    keys = np.zeros((len(counts), 2), np.uint64)
    some = counts > 0
    for k, base in enumerate((0xD1342543DE82EF95, 0xA24BAED4963EE407)):
        if len(words):
            value = mix(words ^ mix((place.astype(np.uint64) + np.uint64(1)) * np.uint64(base)))
            keys[some, k] = np.add.reduceat(value, first[some])
    return keys


def signatures(grams: np.ndarray, made: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of each text that has n-grams."""
    some = np.flatnonzero(made > 0)
    first = (np.cumsum(made) - made)[some]
    short = (grams >> np.uint64(32)).astype(np.uint32)
    rng = np.random.Generator(np.random.PCG64(7))
    factors = rng.integers(0, 2**31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 2**32, bands * rows, np.uint32)
    out = np.zeros((len(some), bands), np.uint64)
    value = np.empty_like(short)
    for band in range(bands):
        total = np.full(len(some), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            np.multiply(short, factors[k], out=value)
            np.bitwise_xor(value, shifts[k], out=value)
            np.multiply(value, np.uint32(0x9E3779B1), out=value)
            total = mix(total ^ np.minimum.reduceat(value, first).astype(np.uint64)) if len(first) else total
        out[:, band] = total
    return out


def sketched(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """doc_id, k1, k2 (of the word sequence) and bands of every row; no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            at = 0
            for part in runs(batch.column(1).to_pylist(), lambda t: len(t or ""), PART):
                words, counts = hashed([utf8(t) for t in part], WHITE)
                keys = sequence_keys(words, counts).view(np.int64)
                grams, made = ngrams(words, counts, n)
                found = signatures(grams, made, bands, rows).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.where(made > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(made.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))],
                    names=["doc_id", "k1", "k2", "n_grams", "bands"],
                )
                at += len(part)

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, k1 long, k2 long, n_grams long, bands array<long>")


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """docs (doc_id, text, then any columns) with k1, k2 and the sorted distinct n-grams in place of the text."""
    rest = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    kind = ", ".join(["k1 long, k2 long, grams binary", *(f"{f.name} {f.dataType.simpleString()}" for f in rest)])
    docs = docs.select("text", *[f.name for f in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in runs(batch.column(0).to_pylist(), lambda t: len(t or ""), PART):
                words, counts = hashed([utf8(t) for t in part], WHITE)
                keys = sequence_keys(words, counts).view(np.int64)
                grams, made = ngrams(words, counts, n)
                ends = np.cumsum(made)
                sets = [np.unique(grams[e - m : e]).tobytes() for e, m in zip(ends.tolist(), made.tolist())]
                others = [c.slice(at, len(part)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sets, pa.binary()), *others], names=["k1", "k2", "grams", *batch.schema.names[1:]])
                at += len(part)

    return arrow_map(docs, run, kind)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: products of their incidence with the n-grams that two or more share."""
    sizes = [len(s) for s in sets]
    grams, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    width = int((times > 1).sum())
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep = times[inverse] > 1
    owner, col = owner[keep], shared[inverse[keep]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    found = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, width, 8192):
        a, b = np.searchsorted(col, [lo, lo + 8192])
        block = np.zeros((len(sets), min(8192, width - lo)), np.float32)
        block[owner[a:b], col[a:b] - lo] = 1
        found += block @ block.T
    return found


def verified(group: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the rows of one unit that are similar enough; rows of two blocks are compared across the blocks only."""
    sets = [np.frombuffer(g, np.uint64) for g in group["grams"]]
    size = np.array([len(s) for s in sets], float)
    common = overlaps(sets)
    near = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    side = group["side"].to_numpy()
    # Of two blocks one may be empty; the other's own pairs belong to another unit even then.
    within = group["low"].iloc[0] == group["high"].iloc[0]
    allowed = np.ones_like(near) if within else side[:, None] != side[None, :]
    return np.nonzero(np.triu(near & allowed, 1))


def find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, k1, k2 of every row; nodes: k1, k2, node, copies, links, class_id of every distinct word sequence)."""
    bands, per_band = banding(threshold, recall)
    # Several jobs use the row numbers, so they are stored: another job may split the files in another way.
    rows = written(sketched(docs, bands, per_band, n).withColumn("row", F.monotonically_increasing_id()), "sketches")
    nodes = rows.groupBy("k1", "k2").agg(
        F.min("row").alias("node"), F.count("*").alias("copies"), F.min("doc_id").alias("low_id"), F.max("n_grams").alias("n_grams")
    )
    nodes = written(nodes, "nodes")

    # Buckets: whoever shares a band is linked to the smallest node there.
    each = rows.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), F.explode("bands").alias("band"))
    each = written(each, "bands")
    leaders = each.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = each.join(leaders, "band").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    groups = written(components(links), "groups")

    # Blocks: a large group in several, compared two by two; small groups share a unit of work.
    inside = groups.join(nodes, groups["a"] == nodes["node"]).select("node", "root", "k1", "k2", "low_id", "n_grams", "copies")
    totals = inside.groupBy("root").agg(F.count("*").alias("m"), F.sum("n_grams").alias("g"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_NODES), F.ceil(F.col("g") / BLOCK_GRAMS)).cast("int")
    inside = inside.join(totals.select("root", blocks.alias("blocks")), "root")
    inside = written(inside.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "inside")
    count, grams = inside.agg(F.count("*"), F.coalesce(F.sum("n_grams"), F.lit(0))).first()
    bundles = max(1, -(-grams // BUNDLE_GRAMS))
    wanted = inside.select(F.col("low_id").alias("_low"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "node", "root", "blocks", "block", "copies")
    wanted = F.broadcast(wanted) if count <= BROADCAST_NODES else wanted
    met = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_low")))
    sets = sets_of(met, n).where("k1 = _k1 and k2 = _k2").drop("k1", "k2", "_low", "_k1", "_k2")
    unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bundles))).otherwise(F.col("root"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = sets.withColumn("unit", unit).withColumn("other", other)
    dealt = dealt.select(
        "unit", "node", "root", "grams", "copies", (F.col("blocks") == 1).alias("small"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.least("block", "other")).alias("low"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.greatest("block", "other")).alias("high"),
        F.when(F.col("blocks") == 1, 0).otherwise(F.col("block")).alias("side"),
    )

    def verify(unit_rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        # A row read twice (rows with one id and one text) is one node.
        for _, group in unit_rows.drop_duplicates(["root", "node"]).groupby("root", sort=True):
            group = group.sort_values("node", ignore_index=True)
            i, j = verified(group, threshold)
            copies = group["copies"].to_numpy(np.int64)
            links = np.zeros(len(group), np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            parent = list(range(len(group)))
            for a, b in zip(i.tolist(), j.tolist()):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
            node = group["node"].to_numpy()
            near = np.flatnonzero(links)
            out += [(int(node[k]), int(node[find(parent, k)]), int(links[k]), bool(group["small"].iloc[0])) for k in near.tolist()]
        return pd.DataFrame(out, columns=["node", "root", "links", "small"])

    found = written(dealt.groupBy("unit", "low", "high").applyInPandas(verify, "node long, root long, links long, small boolean"), "found")
    whole = found.where("small").select("node", "root")
    if found.where("not small").limit(1).count():
        parts = components(found.where("not small").select(F.col("node").alias("a"), F.col("root").alias("b")))
        whole = whole.unionByName(parts.select(F.col("a").alias("node"), "root"))
    linked = whole.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node")
    nodes = nodes.join(linked, "node", "left").select(
        "k1", "k2", "node", "copies", "low_id", F.coalesce("root", "node").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
    )
    lowest = nodes.groupBy("root").agg(F.min("low_id").alias("class_id"))
    return rows.select("doc_id", "row", "k1", "k2"), nodes.join(lowest, "root")


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL) -> DataFrame:
    """One row for each document: class_id (the smallest doc_id that chains of similar documents lead to) and n_links, the number of other documents at the threshold or nearer."""
    rows, nodes = classes(docs, threshold, n, recall)
    return rows.join(nodes, ["k1", "k2"]).select("doc_id", "class_id", F.col("links").alias("n_links"))


def dedupe(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL) -> DataFrame:
    """The rows of docs that stand for their class: those with its smallest doc_id. Of rows that repeat an id and its text one stays; of a repeated id all other texts stay where one of them does."""
    stays = F.col("doc_id").eqNullSafe(F.col("class_id"))
    ids = join(docs, threshold, n, recall).groupBy("doc_id").agg(F.bool_or(stays).alias("stays"), (F.count("*") > 1).alias("repeats"))
    ids = written(ids, "ids")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    count, unnamed, repeated = ids.agg(F.count_if(~F.col("stays")), some(~F.col("stays") & F.col("doc_id").isNull()), some(F.col("stays") & F.col("repeats"))).first()
    # Rows that go are far fewer than those that stay; so long as their ids can be broadcast no text is shuffled.
    name = unused(docs, "gone")
    gone = ids.where("NOT stays AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name))
    gone = F.broadcast(gone) if count <= BROADCAST_IDS else gone
    kept = docs.where(F.col("doc_id").isNotNull()) if unnamed else docs
    kept = kept.join(gone, F.col("doc_id") == F.col(name), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept
