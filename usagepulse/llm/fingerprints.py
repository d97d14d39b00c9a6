"""Order MinHash fingerprints, sensitive to edit distance.

Each of SLOTS hash functions picks the TUPLE smallest k-mers of a text, where a k-mer is
numbered by its occurrences so far; the picked k-mers are put back into text order and
hashed as a tuple. Two texts agree in a slot when the same k-mers come in the same order.

Comparing each document with the next needs neighbours of a global order. Documents are
cut into ranges of their id; the first document of each range is also sent to the range
before it, so every range is read through once by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 6
SLOTS = 64  # a text with half of it new agrees in a ninth of them; none agree once in 2,000
TUPLE = 2
RANKS = 1 << 18  # numbers ranked at once, or one slot of a longer text
RANGE_ROWS = 1024
MAX_RANGES = 65_536
TASK_ROWS = 16 * RANGE_ROWS  # documents of a task, until there are MAX_RANGES tasks

_BASE = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(8)
_XOR = _random.integers(0, 2**32, SLOTS, dtype=np.uint32)[:, None]
_ODD = _random.integers(0, 2**32, SLOTS, dtype=np.uint32)[:, None] | np.uint32(1)


def _mix(values: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the word."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(33))


def signature(text: str | None) -> np.ndarray:
    """SLOTS 32-bit values. A text shorter than K counts as one k-mer; null as empty."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = max(1, len(points) - K + 1)
    hashes = np.zeros(n, np.uint64)
    for i in range(min(K, len(points))):
        hashes = hashes * _BASE + points[i : i + n] + np.uint64(1)
    hashes = _mix(hashes)
    short = hashes >> np.uint64(32)
    # Equal k-mers side by side, in text order; their rank in the run is the occurrence.
    keyed = np.sort((short << np.uint64(32)) | np.arange(n, dtype=np.uint64))
    places = (keyed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    groups = keyed >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    occurrence = np.empty(n, np.uint64)
    occurrence[places] = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
    numbered = (_mix(hashes + occurrence * _BASE) >> np.uint64(32)).astype(np.uint32)
    picked = np.empty((SLOTS, min(TUPLE, n)), np.int64)
    block = max(1, RANKS // n)
    for at in range(0, SLOTS, block):
        ranks = (numbered ^ _XOR[at : at + block]) * _ODD[at : at + block]
        rows = np.arange(len(ranks))
        for t in range(picked.shape[1]):
            found = picked[at : at + block, t] = ranks.argmin(axis=1)
            ranks[rows, found] = np.uint32(0xFFFFFFFF)
    picked.sort(axis=1)
    out = np.zeros(SLOTS, np.uint64)
    for t in range(picked.shape[1]):
        out = _mix(out * _BASE + hashes[picked[:, t]] + np.uint64(t + 1))
    return (out >> np.uint64(32)).astype(np.uint32)


def text_of(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Range of each id, larger ids first; nulls in a range of their own at the end."""
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    found = len(bounds) - np.searchsorted(bounds, values, side="left")
    found[ids.is_null().to_numpy(zero_copy_only=False)] = len(bounds) + 1
    return found


def _heads(bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_ranges(ids, bounds)), ids], ["range", "doc_id"]
            )

    return run


def _deal(bounds: np.ndarray, before: dict[tuple[int, int | None], int]):
    """Adds its range to each document and repeats the heads in the range before theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            places = _ranges(ids, bounds)
            keys = list(zip(places.tolist(), ids.to_pylist()))
            heads = [i for i, key in enumerate(keys) if key in before]
            rows = pa.array([*range(len(ids)), *heads], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[places, [before[keys[i]] for i in heads]].astype(np.int64)),
                    pa.array(np.r_[np.zeros(len(ids), bool), np.ones(len(heads), bool)].astype(bool)),
                    ids.take(rows),
                    batch.column("text").take(rows),
                ],
                ["range", "tail", "doc_id", "text"],
            )

    return run


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each document of a range with the one after it."""
    last = None
    for batch in batches:
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("range", "tail", "doc_id", "text")]
        for place, tail, doc_id, text in zip(*columns):
            if last is not None and last[0] != place:
                last = None
            if tail and last is None:
                continue
            text = text or ""
            own = signature(text)
            if last is not None:
                _, before_id, before, before_own = last
                changed = edited(before, text)
                changed_own = signature(changed)
                rows.append(
                    (
                        before_id,
                        len(before),
                        hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                        text_of(before_own),
                        text_of(changed_own),
                        likeness(before_own, changed_own),
                        likeness(before_own, own),
                    )
                )
            last = None if tail else (place, doc_id, text, own)
        columns = list(zip(*rows)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document, of its edited text, and how near the next one is.

    The order is descending integer ``doc_id``, nulls last, then text; after the last
    comes the first, so a lone document follows itself. Columns: doc_id, n_chars (code
    points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null
    text is empty. Repeated rows are documents of their own; other columns are ignored; an
    empty table gives an empty result.
    """
    docs = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    ids = docs.select("doc_id")
    count = ids.count()
    parts = min(MAX_RANGES, count // RANGE_ROWS)
    bounds = np.zeros(0, np.int64)
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        bounds = np.unique(
            np.array(ids.agg(F.percentile_approx("doc_id", shares, 100_000)).first()[0], np.int64)
        )
    # One row per range: at most MAX_RANGES + 1 in number.
    heads = sorted(
        (r["range"], r["doc_id"])
        for r in ids.mapInArrow(_heads(bounds), "range long, doc_id long")
        .groupBy("range")
        .agg(F.max("doc_id").alias("doc_id"))
        .collect()
    )
    before = {head: heads[i - 1][0] for i, head in enumerate(heads)}
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, min(MAX_RANGES, -(-count // TASK_ROWS)))
    return (
        docs.mapInArrow(_deal(bounds, before), "range long, tail boolean, doc_id long, text string")
        .repartition(tasks, "range")
        .sortWithinPartitions("range", "tail", F.desc_nulls_last("doc_id"), "text")
        .mapInArrow(
            _follow,
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
            "edited_fingerprint string, near_edited double, near_next double",
        )
    )
