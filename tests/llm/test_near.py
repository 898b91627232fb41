import collections
import random

import numpy as np

from lakewright.llm import near
from lakewright.llm.components import components

from .fixtures import clashing, docs, empty


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= threshold * len(sets[a] | sets[b]) - 1e-9 and both:
                links[a] += 1
                links[b] += 1
                x, y = near.find(parent, a), near.find(parent, b)
                parent[max(x, y)] = min(x, y)
    low = {}
    for k, (i, _) in enumerate(rows):
        r = near.find(parent, k)
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [(i, low.get(near.find(parent, k)), links[k]) for k, (i, _) in enumerate(rows)]


def test_awkward_rows(spark):
    df = docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted(map(tuple, near.join(clashing(df)).collect()), key=repr) == sorted(brute(rows), key=repr)
    assert near.join(empty(spark)).count() == 0


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_NODES", 16)
    monkeypatch.setattr(near, "BROADCAST_NODES", 10)
    rnd = random.Random(2)
    base = [f"w{rnd.randint(0, 999)}" for _ in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(120)] = f"c{rnd.randint(0, 50)}"
        rows.append((k, " ".join(w)))
    rows += [(150 + k, " ".join(f"o{rnd.randint(0, 999)}" for _ in range(60))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(map(tuple, near.join(df).collect()))
    assert found == sorted(brute(rows))


def test_empty_blocks_add_no_links(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_GRAMS", 100)
    rnd = random.Random(4)
    rows = []
    for k in range(16):
        w = [f"w{rnd.randint(0, 9999)}" for _ in range(80)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w, "more"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, near.join(df).collect())) == sorted(brute(rows))


def test_row_numbers_survive_other_splits(spark, monkeypatch):
    rnd = random.Random(3)
    rows = []
    for k in range(40):
        w = [f"w{rnd.randint(0, 9999)}" for _ in range(60)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w, "more"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    plain, name = near.written, "spark.sql.files.maxPartitionBytes"

    def split_anew(df, what, *a):
        out = plain(df, what, *a)
        if what == "nodes":
            spark.conf.set(name, "900")
        return out

    monkeypatch.setattr(near, "written", split_anew)
    before = spark.conf.get(name)
    try:
        found = sorted(map(tuple, near.join(df).collect()))
    finally:
        spark.conf.set(name, before)
    assert found == sorted(brute(rows))


def test_dedupe_keeps_one_of_each(spark):
    df = docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    kept = near.dedupe(df)
    assert kept.columns == df.columns
    wanted = {c for _, c, _ in brute(rows) if c is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert collections.Counter(i for i in ids if i is not None) == collections.Counter(wanted)
    assert near.dedupe(empty(spark)).count() == 0
    wide = clashing(df)
    assert sorted(r["doc_id"] or -1 for r in near.dedupe(wide).collect()) == sorted(i or -1 for i in ids) and near.dedupe(wide).columns == wide.columns


def test_dedupe_joins_alike_beyond_the_broadcast(spark, monkeypatch):
    df = docs(spark)
    key = lambda r: (r["doc_id"] or -1, r["text"] or "")
    one = sorted(near.dedupe(df).collect(), key=key)
    monkeypatch.setattr(near, "BROADCAST_IDS", 0)
    assert sorted(near.dedupe(df).collect(), key=key) == one


def test_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 300), (300, 400), (7, 7), (600, 600)] + [(1000, 1000 + k) for k in range(1, 300)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {k: 0 for k in range(201)} | {k: 300 for k in (300, 400, 500)} | {1000 + k: 1000 for k in range(300)}


def test_banding_reaches_recall():
    bands, rows = near.banding(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands <= near.MAX_BANDS


def test_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50), dtype=np.uint64)) for _ in range(30)]
    wanted = [[len(np.intersect1d(a, b)) if a is not b else None for b in sets] for a in sets]
    found = near.overlaps(sets)
    assert all(wanted[i][j] is None or wanted[i][j] == found[i][j] for i in range(30) for j in range(30))
