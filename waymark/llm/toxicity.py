"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct byte n-grams of the lower-cased text, hashed into a fixed table. Each is
weighted by its log-count ratio between toxic and other training texts, and a logistic regression is
fitted on these scaled features (Wang and Manning, 2012). Only n-grams whose ratio stands out against its own
standard error take part, so that long clean texts don't gather noise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import ASCII_LOWER, map_batches, texts_of, tidy, with_fields

ORDERS = (3, 4, 5, 6)
BITS = 20
#: An n-gram takes part if its log-count ratio is so many standard errors from 0: of 2^20 buckets, chance lets about one pass.
MIN_Z = 5.0
RIDGE = 2.0
#: Steps and step size of the fit, and how many features of texts a step looks at together.
STEPS, RATE, CHUNK = 120, 0.05, 1 << 20


@dataclass(frozen=True)
class Model:
    """Weights by hash bucket, the intercept, and what the fit saw."""

    weights: np.ndarray
    intercept: float
    texts: int
    features: int

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


class Grams:
    """Finds the distinct hash buckets of a text's n-grams; keeps one scratch table for all texts."""

    def __init__(self) -> None:
        self.last = np.zeros(1 << BITS, np.int32)

    def buckets(self, text: str) -> np.ndarray:
        data = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER)
        raw = np.frombuffer(b" " + b" ".join(data.split()) + b" ", np.uint8).astype(np.uint64)
        found = []
        rolled, order = raw, 1
        for order in range(2, ORDERS[-1] + 1):
            if len(raw) < order:
                break
            rolled = rolled[: len(raw) - order + 1] * np.uint64(0x100000001B3) + raw[order - 1 :]
            if order in ORDERS:
                found.append(((rolled ^ np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
        if not found:
            return np.zeros(0, np.int64)
        every = np.concatenate(found).astype(np.int64)
        # of equal buckets, the last one written stays
        place = np.arange(len(every), dtype=np.int32)
        self.last[every] = place
        return every[self.last[every] == place]


def fit(texts: list[str], toxic: np.ndarray, prior: float) -> Model:
    """Fits on texts and their labels (0/1); ``prior`` is the share of toxic texts that scores should reflect.

    Without both classes there is nothing to tell apart: the model then gives the prior to every text.
    """
    toxic = np.asarray(toxic, bool)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    weights, base = np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior)))
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return Model(weights, base, n1 + n0, 0)
    grams = Grams()
    count = np.zeros((2, 1 << BITS), np.float64)
    for text, label in zip(texts, toxic, strict=True):
        count[int(label), grams.buckets(text)] += 1
    ratio = np.log((count[1] + 1) / (n1 + 2)) - np.log((count[0] + 1) / (n0 + 2))
    z = ratio / np.sqrt(1 / (count[1] + 1) + 1 / (count[0] + 1))
    chosen = np.flatnonzero((np.abs(z) >= MIN_Z) & (count.sum(0) >= 3))
    at = np.full(1 << BITS, -1, np.int32)
    at[chosen] = np.arange(len(chosen))
    scale = ratio[chosen]
    columns = []
    for text in texts:
        own = at[grams.buckets(text)]
        columns.append(own[own >= 0])
    sizes = np.asarray([len(c) for c in columns], np.int64)
    columns = np.concatenate(columns)
    del count, at, ratio, z
    ends = np.cumsum(sizes)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(CHUNK, ends[-1], CHUNK)), [len(texts)]]))
    parts = [(low, high, columns[ends[low] - sizes[low] : ends[high - 1]], np.repeat(np.arange(high - low), sizes[low:high])) for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
    y = toxic.astype(np.float64)
    w, b = np.zeros(len(chosen)), float(np.log(n1 / n0))
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, STEPS + 1):
        scaled, gradient = w * scale, np.append(RIDGE * w / len(y), 0.0)
        for low, high, col, row in parts:
            logit = np.bincount(row, scaled[col], high - low) + b
            slope = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[low:high]) / len(y)
            gradient[:-1] += scale * np.bincount(col, slope[row], len(chosen))
            gradient[-1] += slope.sum()
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w -= move[:-1]
        b -= move[-1]
    weights[chosen] = w * scale
    return Model(weights, b + base - float(np.log(n1 / n0)), n1 + n0, len(chosen))


def held_out(id_col: str = "doc_id"):
    """Whether a row's id is left out of every fit: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_texts: int = 4000, max_bytes: int = 16 << 20) -> Model:
    """Fits on a bounded sample of labelled texts whose ids are not held out; labels of held-out ids are never looked at.

    The bounds are for each class: ``max_texts`` labelled ids, those with the smallest hashes, and of their texts the shortest
    whose UTF-8 bytes add up to ``max_bytes`` at most. Every n-gram that stands out in the sample takes part. Rows without a
    label or id don't count, an id labelled twice counts as toxic if it once is, and of rows that share an id the text
    that sorts first is fitted on. Null texts are left out. The share of toxic ids among all labelled ones that aren't held
    out is the prior. No documents or no labels give a model without n-grams. The sample's ids are broadcast to the scan.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_label")).where("_label in (0, 1)")
    totals = {int(r["_label"]): int(r["n"]) for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    sample = None
    for label in (0, 1):
        part = known.where(F.col("_label") == label).orderBy(F.xxhash64(id_col), id_col).limit(max_texts)
        sample = part if sample is None else sample.unionByName(part)
    texts = tidy(docs, [id_col, text_col]).select(id_col, F.col(text_col).alias("_text")).where("_text is not null")
    # at most 2 * max_texts rows from here on
    found = texts.join(F.broadcast(sample), id_col).groupBy(id_col, "_label").agg(F.min("_text").alias("_text"))
    running = Window.partitionBy("_label").orderBy(F.octet_length("_text"), id_col)
    rows = found.withColumn("_bytes", F.sum(F.octet_length("_text").cast("bigint")).over(running)).where(F.col("_bytes") <= max_bytes).select("_text", "_label").toArrow()
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    # one order whatever the partitions, so that sums and so the model are the same each time
    pairs = sorted(zip(rows.column("_text").to_pylist(), rows.column("_label").to_pylist(), strict=True))
    return fit([t for t, _ in pairs], np.asarray([y for _, y in pairs], bool), prior)


def score(df: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """Adds ``name`` double, 0 to 1: how likely each whole text is toxic.

    Null and empty texts get the score of a text without n-grams. Only the text is looked at. A column of
    that name in ``df`` is replaced. The model, a table of 2^20 weights, is broadcast.
    """
    df = tidy(df, [text_col], [name])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own, grams = shared.value, Grams()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            logit = np.asarray([float(own.weights[grams.buckets(t)].sum(dtype=np.float64)) if t else 0.0 for t in texts_of(batch.column(text_col))]) + own.intercept
            return batch.append_column(name, pa.array(own.score(logit)))

        return step

    return map_batches(df, make, with_fields(df, f"{name} double"))
