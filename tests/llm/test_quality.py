import zlib

import numpy as np
import pytest

from lakewright.llm import quality
from lakewright.session import table

from .fixtures import clashing, docs, empty

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    rows = quality.classify(table(spark, sf, "documents"), labels).join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    good = [r for r in rows if r["quality"] == 1]
    assert sum(r["predicted"] for r in good) / len(good) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_awkward_rows(spark):
    df = docs(spark)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(14)] + [(3, None, None), (None, 1, 0), (3, 0, 1), (999, 1, 0)], LABELS)
    rows = quality.classify(clashing(df), labels).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    for r, t in zip(sorted(quality.score(df, quality.fit(df, labels), score_col="s").collect(), key=repr), range(10**6)):
        assert by_text.setdefault(r["text"], r["s"]) == r["s"]


def test_without_classes(spark):
    df = docs(spark)
    for labels in (empty(spark, LABELS), spark.createDataFrame([(1, 1, 0)], LABELS)):
        scores = {r["score"] for r in quality.classify(df, labels).collect()}
        assert len(scores) == 1
    assert quality.classify(empty(spark), empty(spark, LABELS)).count() == 0
    assert quality.Model(prior=0.25).scores([[0, 0, 0]]) == pytest.approx([0.25])


def test_calibration_settles():
    """Classes that hardly meet, and far outliers: full Newton steps swing away on such data."""
    rng = np.random.default_rng(0)
    good = (rng.random(3000) < 0.5).astype(float)
    d = np.where(good == 1, rng.normal(0.08, 0.03, 3000), rng.normal(-0.01, 0.04, 3000))
    d[:20] = rng.choice([-0.9, 0.9], 20)
    ratio = np.where(good == 1, rng.normal(0.42, 0.05, 3000), rng.uniform(0, 0.7, 3000))
    features = np.column_stack([d, ratio, ratio + d])
    weight = np.where(good == 1, 1.72, 0.28)
    w = np.array(quality.calibrate(features, good, weight))
    p = quality.Model(weights=w.tolist()).scores(features)
    slope = quality.design(features).T @ (weight * (good - p)) - 1e-2 * np.array([0, 1, 1, 1]) * w
    assert np.abs(slope).max() < 1e-4
    # In shares of the weighted classes: the fit is to those, so 0.5 is not the best threshold for plain rows.
    assert np.average((p >= 0.5) == good, weights=weight) > 0.9
    assert abs(np.average(p, weights=weight) - np.average(good, weights=weight)) < 0.01
