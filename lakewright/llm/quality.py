"""Quality classifier by compression: which of two zstandard dictionaries, of good or of bad text, shortens a text more.

fit() learns from a bounded sample of labelled rows; score() reads every text whole, in segments.

Defined results: null and empty texts have no segments and score what the calibration gives for a
difference of nothing; repeated rows score alike and each keeps its row; without two classes among
the labels every score is the smoothed share of good labels; empty tables give no rows; further
columns of docs pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_map, runs, utf8

#: Labelled rows of a class that give the dictionary its text, and further ones for the calibration.
DICTIONARY_DOCS, CALIBRATION_DOCS = 2000, 1500
#: Bytes of a sampled segment, segments in a dictionary, bytes compressed at once, zstandard's level.
SAMPLE_BYTES, SAMPLES, SEGMENT_BYTES, LEVEL = 1024, 1024, 4096, 5
THRESHOLD = 0.3


@dataclass
class Model:
    prior: float = 0.5
    good: bytes = b""
    bad: bytes = b""
    weights: list[float] = field(default_factory=list)

    def features(self):
        """A function from UTF-8 to its features: the normalised difference of compressed sizes, and both ratios."""
        import zstandard

        def compressor(content: bytes):
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False).compress

        good, bad = compressor(self.good), compressor(self.bad)

        def of(data: bytes) -> tuple[float, float, float]:
            if not data:
                return 0.0, 0.0, 0.0
            g = b = 0
            for at in range(0, len(data), SEGMENT_BYTES):
                part = data[at : at + SEGMENT_BYTES]
                g += len(good(part))
                b += len(bad(part))
            return (b - g) / (b + g), g / len(data), b / len(data)

        return of

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), self.prior)
        return 1 / (1 + np.exp(-np.clip(design(features) @ np.array(self.weights), -40, 40)))


def design(features: np.ndarray) -> np.ndarray:
    """Columns of the calibration: constant, scaled difference, both ratios."""
    features = np.asarray(features, float).reshape(-1, 3)
    return np.column_stack([np.ones(len(features)), 50 * features[:, 0], features[:, 1], features[:, 2]])


def calibrate(features: np.ndarray, good: np.ndarray, weight: np.ndarray) -> list[float]:
    """Weighted logistic regression by Newton's method with a slight ridge. A step is halved until the loss falls, so it cannot swing away."""
    x = design(features)
    ridge = 1e-2 * np.diag([0.0, 1, 1, 1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - good * z)).sum() + w @ ridge @ w / 2)

    w, now = np.zeros(4), loss(np.zeros(4))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(4)
        step = np.linalg.solve(curve, x.T @ (weight * (good - p)) - ridge @ w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) >= now:
            size /= 2
        if size <= 1e-6:
            break
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, before):
            break
    return w.tolist()


def held_out(doc_id, parts: int = 5):
    """Rows kept from fitting: crc32 of the id as text has no remainder."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from labelled rows that aren't held out: at most DICTIONARY_DOCS + CALIBRATION_DOCS of each class, picked by a hash of their ids."""
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).cast("int").alias("_good"))
    )
    total = {r["_good"]: r["n"] for r in known.groupBy("_good").agg(F.count("*").alias("n")).collect()}
    n_good, n_bad = total.get(1, 0), total.get(0, 0)
    model = Model(prior=(n_good + 1) / (n_good + n_bad + 2))
    if not (n_good and n_bad):
        return model
    per_class = DICTIONARY_DOCS + CALIBRATION_DOCS
    order = F.xxhash64("_id", F.lit("sample"))
    picked = [known.where(F.col("_good") == c).orderBy(order, "_id").limit(per_class) for c in (0, 1)]
    ids = picked[0].unionByName(picked[1])  # 2 * per_class rows at most
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), "_id")
    # A row's share decides whether it gives dictionary text or calibrates, so that no row does both.
    share = F.pmod(F.xxhash64("_id", F.lit("use")), F.lit(per_class))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (good, data[at : at + SAMPLE_BYTES])
                for good, data in zip(batch["_good"], map(utf8, batch["_text"]))
                for at in range(0, len(data), SAMPLE_BYTES)
            ]
            yield pd.DataFrame(rows, columns=["good", "part"])

    parts = sample.where(share < DICTIONARY_DOCS).mapInPandas(cut, "good int, part binary")
    for c in (0, 1):
        rows = parts.where(F.col("good") == c).orderBy(F.xxhash64("part"), "part").limit(SAMPLES).collect()  # SAMPLES * SAMPLE_BYTES at most
        setattr(model, "good" if c else "bad", b"".join(bytes(r["part"]) for r in rows))
    if not (model.good and model.bad):
        return model

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = model.features()
        for batch in batches:
            found = [of(utf8(t)) for t in batch["_text"]]
            yield pd.DataFrame([(g, *f) for g, f in zip(batch["_good"], found)], columns=["good", "d", "g", "b"])

    rows = np.array(sample.where(share >= DICTIONARY_DOCS).mapInPandas(measure, "good int, d double, g double, b double").collect(), float)  # numbers of 2 * per_class rows at most
    if len(rows) and 0 < rows[:, 0].sum() < len(rows):
        good = rows[:, 0]
        weight = np.where(good == 1, n_good / good.sum(), n_bad / (len(good) - good.sum()))
        model.weights = calibrate(rows[:, 1:], good, weight / weight.mean())
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with one more column, the probability that a whole text is good. No shuffle."""
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.features() if model.weights else None
        for batch in batches:
            found = []
            if of:
                for texts in runs(batch.column(at).to_pylist(), lambda t: len(t or ""), 2_000_000):
                    found += [of(utf8(t)) for t in texts]
            scores = model.scores(np.array(found if of else np.zeros((batch.num_rows, 3)), float).reshape(-1, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, score_col])

    return arrow_map(docs, run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= THRESHOLD) of every row of docs."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
