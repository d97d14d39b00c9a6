"""Cross-entropy difference under matched character n-gram models.

A target model and a background model have the same order, smoothing and vocabulary. Both
are counted exactly over whole texts: the background over all documents, the target over
those chosen. A document's score is the mean over its tokens of target loss minus
background loss: the lower, the more it resembles the target.

A token's loss depends on the n-gram of full order that ends there, so the models become
a table of losses by n-gram, which grows with the corpus and stays a table. Documents are
dealt into blocks by hash; a block adds up its n-grams before they are moved, and gets the
losses of its own distinct n-grams back by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagepulse.llm.common import materialise

ORDER = 4
PSEUDO = 5.0  # weight of the next lower order
STEP = 1 << 20  # code points handled at once, or one text if it is longer
BLOCK = 1 << 22  # code points of a block, about
POINT = 21  # bits of a code point; an n-gram is two pairs of them
LOW = (1 << POINT) - 1


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, each after ORDER - 1 zeros, and which of them are tokens."""
    pad = "\0" * (ORDER - 1)
    points = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), "<u4")
    token = np.ones(len(points), bool)
    starts = np.cumsum([0, *[len(t) + ORDER - 1 for t in texts[:-1]]])
    for k in range(ORDER - 1):
        token[starts + k] = False
    return points.astype(np.uint64), token


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    at, size, held = 0, 0, []
    for i, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= STEP:
            yield at, held
            at, size, held = i + 1, 0, []
    if held:
        yield at, held


def _pairs(points: np.ndarray) -> np.ndarray:
    """Each code point with the one before it."""
    points = points.astype(np.int64)
    return (np.r_[0, points[:-1]] << POINT) | points


def _tally(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of texts, as first and last pair, and their counts."""
    points, token = _joined(texts)
    pairs = _pairs(points)
    known = np.unique(pairs)
    ids = np.searchsorted(known, pairs)
    at = np.flatnonzero(token)
    keys, counts = np.unique((ids[at - 2] << 32) | ids[at], return_counts=True)
    return known[keys >> 32], known[keys & 0xFFFFFFFF], counts


def _merged(block: int, parts: list) -> pa.RecordBatch:
    """One row for each distinct n-gram of a block."""
    first, last, counts = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    good = np.concatenate([np.full(len(p[1]), p[0]) for p in parts])
    known = np.unique(np.r_[first, last])
    keys = (np.searchsorted(known, first) << 32) | np.searchsorted(known, last)
    keys, owner = np.unique(keys, return_inverse=True)
    target = np.bincount(owner, counts * good, len(keys)).astype(np.int64)
    background = np.bincount(owner, counts, len(keys)).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(keys), block, np.int32)),
            pa.array(known[keys >> 32]),
            pa.array(known[keys & 0xFFFFFFFF]),
            pa.array(target),
            pa.array(background),
        ],
        ["block", "first", "last", "target", "background"],
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Rows of one block and kind side by side."""
    blocks = batch.column("block").to_numpy(zero_copy_only=False)
    texts = batch.column("is_text").to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (texts[1:] != texts[:-1])) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
        if end > start:
            yield int(blocks[start]), bool(texts[start]), batch.slice(start, end - start)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a block's n-grams; the ids of its targets come before its texts."""
    place, chosen, parts = None, set(), []
    for batch in batches:
        for block, is_text, run in _runs(batch):
            if block != place:
                if parts:
                    yield _merged(place, parts)
                place, chosen, parts = block, set(), []
            ids = run.column("doc_id").to_pylist()
            if not is_text:
                chosen.update(ids)
                continue
            texts = run.column("text").to_pylist()
            for wanted in (False, True):
                part = [t for t, i in zip(texts, ids) if t and (i in chosen) == wanted]
                parts += [(wanted, *_tally(chunk)) for _, chunk in _chunks(part)]
    if parts:
        yield _merged(place, parts)


def ngram_losses(tallies: DataFrame) -> DataFrame:
    """``first, last, target_loss, background_loss`` of every distinct n-gram in bits.

    ``tallies`` has counts by n-gram, in any number of parts. An n-gram of lower order
    counts where it ends an n-gram of full order.
    """
    models = ("target", "background")
    added = [F.sum(m).alias(m) for m in models]
    four = materialise(tallies.groupBy("first", "last").agg(*added), "ngrams")
    three = four.groupBy(F.col("first").bitwiseAND(LOW).alias("before"), "last").agg(*added)
    three = materialise(three, "trigrams")
    two = materialise(three.groupBy("last").agg(*added), "bigrams")
    one = materialise(two.groupBy(F.col("last").bitwiseAND(LOW).alias("last")).agg(*added), "points")
    # Both models give an n-gram the same chance before any count: one vocabulary.
    size, *totals = one.agg(F.count("*"), *[F.coalesce(F.sum(m), F.lit(0)) for m in models]).first()

    def chances(known: Column | float, lower, model: str) -> Column:
        return ((F.col(model) + PSEUDO * lower) / (known + PSEUDO)).alias(f"{model}_chance")

    def step(grams: DataFrame, keys: list[str], suffix: dict[str, Column], lower: DataFrame, context: dict[str, Column], shorter: DataFrame) -> DataFrame:
        """Chances of one order from those of the suffixes and the counts of the contexts."""
        keyed = grams.select(
            "*", *[v.alias(f"s_{k}") for k, v in suffix.items()], *[v.alias(f"c_{k}") for k, v in context.items()]
        )
        below = lower.select(*[F.col(k).alias(f"s_{k}") for k in suffix], *[F.col(f"{m}_chance").alias(f"{m}_low") for m in models])
        held = shorter.select(*[F.col(k).alias(f"c_{k}") for k in context], *[F.col(m).alias(f"{m}_held") for m in models])
        return (
            keyed.join(below, [f"s_{k}" for k in suffix])
            .join(held, [f"c_{k}" for k in context], "left")
            .select(
                *keys,
                *[chances(F.coalesce(F.col(f"{m}_held"), F.lit(0)), F.col(f"{m}_low"), m) for m in models],
            )
        )

    def context(pair: Column, point: Column) -> Column:
        return F.shiftleft(pair.bitwiseAND(LOW), POINT).bitwiseOR(F.shiftright(point, POINT))

    last, first = F.col("last"), F.col("first")
    p1 = one.select("last", *[chances(float(t), 1.0 / max(size, 1), m) for m, t in zip(models, totals)])
    p2 = step(two, ["last"], {"last": last.bitwiseAND(LOW)}, p1, {"last": F.shiftright(last, POINT)}, one)
    p3 = step(three, ["before", "last"], {"last": last}, p2, {"last": context(F.col("before"), last)}, two)
    p4 = step(
        four,
        ["first", "last"],
        {"before": first.bitwiseAND(LOW), "last": last},
        p3,
        {"before": F.shiftright(first, POINT), "last": context(first, last)},
        three,
    )
    # A pad never counts as a context, so the chance after one can pass one.
    return p4.select(
        "first", "last", *[(-F.log2(F.least(F.col(f"{m}_chance"), F.lit(1.0)))).alias(f"{m}_loss") for m in models]
    )


class _Losses:
    """The losses of a block's n-grams."""

    def __init__(self, parts: list[pa.RecordBatch]):
        first, last, *bits = (
            np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts])
            for c in ("first", "last", "target_loss", "background_loss")
        )
        first, last = first.astype(np.int64), last.astype(np.int64)
        self.pairs = np.unique(np.r_[first, last])
        keys = (np.searchsorted(self.pairs, first) << 32) | np.searchsorted(self.pairs, last)
        order = np.argsort(keys)
        self.keys, self.bits = keys[order], [b[order] for b in bits]

    def means(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Tokens of each text, and its mean loss under each model (0 without tokens)."""
        tokens = np.array([len(t or "") for t in texts], np.int64)
        sums = np.zeros((2, len(texts)))
        for start, chunk in _chunks(texts):
            points, token = _joined(chunk)
            ids = np.searchsorted(self.pairs, _pairs(points))
            at = np.flatnonzero(token)
            found = np.searchsorted(self.keys, (ids[at - 2] << 32) | ids[at])
            owner = np.repeat(np.arange(len(chunk)), tokens[start : start + len(chunk)])
            for i, bits in enumerate(self.bits):
                sums[i, start : start + len(chunk)] = np.bincount(owner, bits[found], len(chunk))
        return tokens, list(sums / np.maximum(tokens, 1))


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores a block's texts; the losses of its n-grams come before them."""
    place, parts, table = None, [], None
    for batch in batches:
        for block, is_text, run in _runs(batch):
            if block != place:
                place, parts, table = block, [], None
            if not is_text:
                parts.append(run)
                continue
            texts = run.column("text").to_pylist()
            if table is None and parts:
                table, parts = _Losses(parts), []
            if table is None:  # no text of the block has a token
                tokens, mean = np.zeros(len(texts), np.int64), [np.zeros(len(texts))] * 2
            else:
                tokens, mean = table.means(texts)
            yield pa.RecordBatch.from_arrays(
                [run.column("doc_id"), pa.array(tokens), pa.array(mean[0]), pa.array(mean[1]), pa.array(mean[0] - mean[1])],
                ["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
            )


def score(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Losses of every row of ``docs``; ``target`` holds the ids of the target documents.

    Columns: doc_id, n_tokens (code points), target_loss, background_loss (mean bits a
    token), score. A null or empty text has no token and losses of zero. Without target
    documents the target model is uniform. Repeated rows and null ids keep their rows and
    count; repeated target ids count once; other columns are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BLOCK))
    # A target is found by its id, so rows of one id share a block; those without are spread.
    place = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text")))
    block = F.pmod(place, F.lit(blocks)).cast("int").alias("block")
    texts = docs.select(block, F.lit(True).alias("is_text"), "doc_id", "text")

    def dealt(others: DataFrame) -> DataFrame:
        return (
            others.unionByName(texts, allowMissingColumns=True)
            .repartition(blocks, "block")
            .sortWithinPartitions("block", "is_text")
        )

    chosen = target.select(F.col("doc_id").cast(kind).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    chosen = chosen.withColumn("text", F.lit(None).cast("string"))
    marks = chosen.select(block, F.lit(False).alias("is_text"), "doc_id", "text")
    tallies = materialise(
        dealt(marks).mapInArrow(_count, "block int, first long, last long, target long, background long"), "tallies"
    )
    bits = tallies.select("block", "first", "last").join(ngram_losses(tallies), ["first", "last"])
    return dealt(bits.withColumn("is_text", F.lit(False))).mapInArrow(
        _score,
        f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double",
    )
