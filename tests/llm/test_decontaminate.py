import collections
import hashlib
import random
import re

from lakewright.llm import decontaminate

from .fixtures import clashing, docs, empty, texts

ITEMS = "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows[tuple(w[k : k + 10])].add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, found = words(t), set()
        hit, longest = [False] * len(w), (0, None, None, None)
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
                    found |= windows[tuple(w[k : k + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        if found:
            for j, u in sorted(("" if j is None else str(j), u) for j, u in items):
                v = words(u)
                for a in range(len(v)):
                    for b in range(len(w)):
                        n = 0
                        while a + n < len(v) and b + n < len(w) and v[a + n] == w[b + n]:
                            n += 1
                        if n >= min(10, len(v)) and (-n, b, j, a) < ((-longest[0], *longest[1:]) if longest[0] else (0,)):
                            longest = (n, b, j, a)
        out.append((i, len(w), sum(hit), len(found), digest, any(hit), *longest))
    return out


def items():
    t = [x for x in texts() if x]
    long = t[9].split()
    return [
        (1, " ".join(t[4].split()[3:30])), (2, " ".join(t[4].split()[10:25]).upper()), (11, "one"), (20, None), (21, ""), (22, "..."), (None, "x918 no"), (None, "id here"),
        (3, " ".join(long[500:560])), (3, " ".join(long[900:903])), (30, " ".join(long[100:107]) + " unheard"), (31, "never said before in any of these documents that we have"),
    ]


def test_report(spark):
    df, rows = docs(spark), items()
    tests = spark.createDataFrame(rows, ITEMS)
    wanted = sorted(brute([(r["doc_id"], r["text"]) for r in df.collect()], rows), key=repr)
    assert sum(r[5] for r in wanted) >= 4
    assert sorted(map(tuple, decontaminate.report(clashing(df), clashing(tests)).collect()), key=repr) == wanted


def test_slices_agree(spark, monkeypatch):
    df, tests = docs(spark), spark.createDataFrame(items(), ITEMS)
    wanted = sorted(map(tuple, decontaminate.report(df, tests).collect()), key=repr)
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 120)
    assert len(decontaminate.slices(tests)) > 2
    assert sorted(map(tuple, decontaminate.report(df, tests).collect()), key=repr) == wanted


def test_clean_and_empty(spark):
    df, tests = docs(spark), spark.createDataFrame(items(), ITEMS)
    bad = {r[0] for r in brute([(r["doc_id"], r["text"]) for r in df.collect()], items()) if r[5]}
    kept = decontaminate.clean(df, tests)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in df.collect()} - bad
    assert decontaminate.report(empty(spark), tests).count() == 0
    none = decontaminate.report(df, empty(spark, ITEMS)).collect()
    assert len(none) == df.count() and not any(r["contaminated"] for r in none)


def test_longest_matches(spark):
    rnd = random.Random(4)
    vocab = [f"v{k}" for k in range(6)]
    rows = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 120)))) for k in range(20)]
    tests = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 60)))) for k in range(6)]
    tests.append((9, " ".join(rows[3][1].split()[2:60])))
    found = {(r["item_id"], r["start"]): r for r in decontaminate.longest_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(tests, ITEMS)).collect()}
    docs_ = {i: words(t) for i, t in rows}
    for i, t in tests:
        w = words(t)
        for s in range(len(w)):
            best = 0
            for d in docs_.values():
                for p in range(len(d)):
                    n = 0
                    while s + n < len(w) and p + n < len(d) and w[s + n] == d[p + n]:
                        n += 1
                    best = max(best, n)
            if best:
                r = found[str(i), s]
                assert r["length"] == best and docs_[r["doc_id"]][r["place"] : r["place"] + best] == w[s : s + best]


def test_longest_matches_of_every_suffix(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 300)
    rnd = random.Random(6)
    vocab = [f"v{k}" for k in range(40)]
    rows = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 40)))) for k in range(12)]
    item = [f"i{k}" for k in range(11)] + [f"shared{k}" for k in range(9)]
    rows.append((50, "before " + " ".join(item[11:]) + " after"))
    tests = [(1, " ".join(item)), (2, "v1 v2 v3"), (3, "v7"), (4, "unheard " + rows[5][1] + " v3 v4"), (5, "never said")]
    found = decontaminate.longest_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(tests, ITEMS)).collect()
    found = {(r["item_id"], r["start"]): r for r in found}
    assert found["1", 11]["length"] == 9 and found["1", 11]["doc_id"] == 50 and found["1", 11]["place"] == 1
    docs_, wanted = {i: words(t) for i, t in rows}, {}
    for i, t in tests:
        w = words(t)
        for s in range(len(w)):
            n = 0
            while s + n < len(w) and any(w[s : s + n + 1] == d[p : p + n + 1] for d in docs_.values() for p in range(len(d))):
                n += 1
            if n:
                wanted[str(i), s] = n
    assert {k: r["length"] for k, r in found.items()} == wanted
    for (i, s), r in found.items():
        assert docs_[r["doc_id"]][r["place"] : r["place"] + r["length"]] == words(dict(tests)[int(i)])[s : s + r["length"]]
