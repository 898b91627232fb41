import collections
import math

import numpy as np
import pytest

from lakewright.llm import katz
from lakewright.llm.shared import crc_of_id

from .fixtures import clashing, docs, empty


def discounted(times):
    """count -> discounted count, from how often each count occurs: Katz's discounts up to 5, a line through the logarithms beyond."""
    r = [k for k in range(1, 33) if times.get(k)]
    slope = -2.0
    if len(r) > 1:
        width = [(r[min(i + 1, len(r) - 1)] - r[max(i - 1, 0)]) / (1 if i in (0, len(r) - 1) else 2) for i in range(len(r))]
        x, y = [math.log(k) for k in r], [math.log(times[k] / d) for k, d in zip(r, width)]
        mx, my = sum(x) / len(x), sum(y) / len(y)
        slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
    slope = min(slope, -1.05)
    over = 6 * times.get(6, 0) / times[1] if times.get(1) else 1.0

    def of(c):
        if c <= 5 and over < 1 and times.get(c) and times.get(c + 1):
            d = ((c + 1) * times[c + 1] / (c * times[c]) - over) / (1 - over)
            if 0 < d < 1:
                return d * c
        return c * (1 + 1 / c) ** (slope + 1)

    return of


def brute(rows, order=2):
    """(n_tokens, n_known, train tokens, base, score) of each (id, text), by dictionaries."""
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    learnt = [w for i, w in tokens if crc_of_id(i) % 7 != 2]
    context = lambda w, k, n: tuple(["<s>", *w][k + 2 - n : k + 1]) if k + 2 >= n else None
    counts = {n: collections.Counter((context(w, k, n), x) for w in learnt for k, x in enumerate(w) if context(w, k, n) is not None) for n in range(1, order + 1)}
    of = {n: discounted(collections.Counter(c.values())) for n, c in counts.items()}
    total = {n: collections.Counter() for n in counts}
    for n, c in counts.items():
        for (v, _), k in c.items():
            total[n][v] += k
    size = total[1][()]
    unknown = 1 - sum(of[1](c) for c in counts[1].values()) / size
    after = {n: collections.defaultdict(list) for n in counts}
    for n, c in counts.items():
        for v, w in c:
            after[n][v].append(w)
    alpha = {}

    def p(n, v, w):
        if (v, w) in counts[n]:
            return of[n](counts[n][v, w]) / total[n][v]
        return unknown if n == 1 else (alpha[v] if v in after[n] else 1) * p(n - 1, v[1:], w)

    known = [w for (_, w) in counts[1]]
    assert abs(sum(p(1, (), w) for w in known) + unknown - 1) < 1e-9
    for n in range(2, order + 1):
        for k, (v, words) in enumerate(after[n].items()):
            alpha[v] = (1 - sum(p(n, v, w) for w in words)) / (1 - sum(p(n - 1, v[1:], w) for w in words))
            if k < 5:  # contexts sum to one, with the unknown word
                assert abs(sum(p(n, v, w) for w in [*known, "?"]) - 1) < 1e-9
    out = []
    for i, w in tokens:
        base = sum(math.log10((counts[1][(), x] + 1) / (size + len(known) + 1)) for x in w)
        score = sum(math.log10(p(m, context(w, k, m), x)) for k, x in enumerate(w) for m in [min(order, k + 2)])
        out.append((i, crc_of_id(i) % 7 == 2, len(w), sum(((), x) in counts[1] for x in w), size, base, score))
    return out


def same(found, wanted):
    key = lambda r: (repr(r[:5]), round(r[5], 6), round(r[6], 6))
    found, wanted = sorted(map(tuple, found), key=key), sorted(wanted, key=key)
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-7)


def test_scores(spark):
    df = docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    same(katz.score(df).collect(), brute(rows))
    # Many blocks and buckets give the same.
    same(katz.score(clashing(df), block_tokens=500, bucket_keys=3000).collect(), brute(rows))


@pytest.mark.parametrize("order", [1, 3, 4])
def test_orders(spark, order):
    df = docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    same(katz.score(df, order=order, block_tokens=500, bucket_keys=3000).collect(), brute(rows, order))


def test_empty_and_untaught(spark):
    assert katz.score(empty(spark)).count() == 0
    held = next(i for i in range(1000) if crc_of_id(i) % 7 == 2)
    row = katz.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (True, 3, 0, 0, 0.0, 0.0)


def test_keys():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (katz.unpack_keys(katz.pack_keys(keys)) == keys).all()
        ends = katz.bucket_ends(keys, 7)
        assert ends[0] == 0 and ends[-1] == len(keys)
