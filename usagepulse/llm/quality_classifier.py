"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from every whole text on the executors. The trees are fitted on a
bounded sample of labelled statistics, at most ``SAMPLE`` rows whatever the input's size,
and flattened into arrays: a batch of documents walks all trees level by level in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagepulse.llm.common import at_most, bounded_sample, held_out, materialise
from usagepulse.llm.textstats import RATIOS, statistics

SAMPLE = 20_000  # labelled rows the trees are fitted on, those of the smallest id hashes
TREES = 60
DEPTH = 4
BINS = 64
RATE = 0.15
SHRINK = 1.0
MIN_WEIGHT = 1.0
THRESHOLD = 0.3


@dataclass
class Forest:
    """Complete trees of one depth: ``feature`` and ``cut`` by tree and inner node, in
    breadth-first order, ``leaf`` by tree and leaf, and the log-odds to begin with."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def raw(self, values: np.ndarray) -> np.ndarray:
        total = np.full(len(values), self.start)
        if not len(self.leaf):
            return total
        trees = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(values))[:, None]
        node = np.zeros((len(values), len(self.feature)), np.int64)
        inner = self.feature.shape[1]
        for _ in range(inner.bit_length()):
            right = values[rows, self.feature[trees, node]] > self.cut[trees, node]
            node = 2 * node + 1 + right
        return total + self.leaf[trees, node - inner].sum(axis=1)

    def probability(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(values), -50, 50)))


def fit(values: np.ndarray, labels: np.ndarray) -> Forest:
    """Boosted trees for binary ``labels``; without rows, even odds for everything.

    Each feature is cut into at most BINS bins at quantiles. A tree grows level by level:
    histograms of gradients and weights by node, feature and bin give every node its best
    cut. A node that gains nothing sends all its rows left.
    """
    rows, width = values.shape
    inner = 2**DEPTH - 1
    start = float(np.log((labels.sum() + 1) / (rows - labels.sum() + 1)))
    feature = np.zeros((TREES, inner), np.int64)
    cut = np.full((TREES, inner), np.inf)
    leaf = np.zeros((TREES, inner + 1))
    if not rows or labels.min() == labels.max():
        return Forest(feature[:0], cut[:0], leaf[:0], start)
    edges = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], values[:, f], side="left") for f in range(width)], axis=1)
    raw = np.full(rows, start)
    offsets = np.arange(width) * BINS
    for tree in range(TREES):
        chance = 1 / (1 + np.exp(-raw))
        gradient, weight = labels - chance, np.maximum(chance * (1 - chance), 1e-6)
        node = np.zeros(rows, np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            keys = ((node - first)[:, None] * (width * BINS) + offsets + binned).ravel()
            shape = (nodes, width, BINS)
            size = nodes * width * BINS
            g = np.bincount(keys, np.repeat(gradient, width), size).reshape(shape).cumsum(axis=2)
            w = np.bincount(keys, np.repeat(weight, width), size).reshape(shape).cumsum(axis=2)
            all_g, all_w = g[:, :, -1:], w[:, :, -1:]
            gain = (
                g**2 / (w + SHRINK)
                + (all_g - g) ** 2 / (all_w - w + SHRINK)
                - all_g**2 / (all_w + SHRINK)
            )
            gain[(w < MIN_WEIGHT) | (all_w - w < MIN_WEIGHT)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            chosen, place = best // BINS, best % BINS
            useful = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            for k in np.flatnonzero(useful):
                feature[tree, first + k] = chosen[k]
                cut[tree, first + k] = edges[chosen[k]][place[k]] if place[k] < len(edges[chosen[k]]) else np.inf
            at = node
            right = values[np.arange(rows), feature[tree, at]] > cut[tree, at]
            node = 2 * at + 1 + right
        ends = node - inner
        sums = np.bincount(ends, gradient, inner + 1)
        weights = np.bincount(ends, weight, inner + 1)
        leaf[tree] = RATE * sums / (weights + SHRINK)
        raw += leaf[tree][ends]
    return Forest(feature, cut, leaf, start)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(t.as_py())[1] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "values"]
        )


def _score(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("values").flatten().to_numpy(zero_copy_only=False)
            values = values.reshape(batch.num_rows, len(RATIOS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(forest.probability(values))], ["doc_id", "score"]
            )

    return run


def train(measured: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Forest:
    """Trees fitted on labelled rows of ``measured(doc_id, values)`` that are not held out.

    Labels other than 0 and 1, and null ids, teach nothing. Beyond ``sample`` rows those
    with the smallest hash of their id are used.
    """
    known = labels.where(
        F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    ).select("doc_id", F.col(label).cast("double").alias("label"))
    taught = measured.join(bounded_sample(known, "doc_id", sample), "doc_id").select("doc_id", "values", "label")
    rows = at_most(taught, "doc_id", sample).select("values", "label").toArrow()
    values = np.array(rows.column("values").to_pylist(), float).reshape(len(rows), len(RATIOS))
    return fit(values, rows.column("label").to_numpy())


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Only statistics of the text are inputs. A null or empty text has statistics of zero
    and a score like any other. Repeated rows and null ids (held out) keep their rows;
    other columns are ignored; without labels every score is one half. An empty table
    gives an empty result.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    measured = materialise(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
            _measure, f"doc_id {kind}, values array<double>"
        ),
        "statistics",
    )
    forest = train(measured, labels)
    return measured.mapInArrow(_score(forest), f"doc_id {kind}, score double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
