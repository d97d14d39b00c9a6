"""Best-fit packing of token sequences with certified bounds.

Documents become token pieces of at most one sequence. Pieces that fill a sequence stand
alone. The others are dealt over partitions and packed by best-fit decreasing; dual-feasible
functions give a lower bound on each partition's bins. Partitions whose bins exceed the
bound, or whose roundings add up to more than the bound of all pieces together, give the
documents of their unfilled bins to the next round, where fewer partitions pack them again.
Rounds end when the bound is met or a round saves next to nothing. Bins with hardly a gap wait
for the last rounds, which open fuller and fuller bins while the bound is still exceeded.

Documents with a position, such as the copies of a curriculum, are packed by ranges of it:
a partition holds neighbours, and so do the partitions that exchange documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagepulse.llm.common import materialise

CAPACITY = 2048
ITEMS = 20_000  # pieces that one task packs together
LOOSE = 16  # a bin with more free tokens than this is given to the next round
GAIN = 0.001  # share of the opened bins that a round saves if another is worth it
VOCABULARY = "byte_bpe_50k.json"
LONG_BLANK = 100_000  # characters
BLANK = re.compile(rf"\s{{{LONG_BLANK}}}")


class Encoder:
    """Token ids as ``tokenizers`` gives them for a byte-level BPE file.

    The merges run in ``tiktoken``, which gives the same ids faster; a text that holds the
    string of a special token or LONG_BLANK whitespace in a row goes through ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self._whole.get_added_tokens_decoder().items()}
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        others = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
        ranks = {
            bytes(byte_of[c] for c in token): i
            for token, i in self._whole.get_vocab(with_added_tokens=True).items()
            if token not in special
        }
        self._special = list(special)
        self._fast = tiktoken.Encoding(
            "byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def ids(self, text: str) -> list[int]:
        # The fast encoder's pattern runs out of stack in very long runs of whitespace.
        blank = len(text) >= LONG_BLANK and BLANK.search(text)
        if blank or any(s in text for s in self._special):
            return self._whole.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    """One encoder per worker process; by default the public 50k byte-level vocabulary."""
    import public_tokenizers

    return Encoder(path or public_tokenizers.path(VOCABULARY))


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document; only the first may be shorter."""
    first = length % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def _pieces(path: str | None, end_id: int, capacity: int, with_ids: bool, ordered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        for batch in batches:
            which, rows, kept = [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    which.append(i)
                    part = ids[start : start + length]
                    rows.append((piece, start, length, zlib.crc32(part)))
                    if with_ids:
                        kept.append(part.astype(np.int32))
            columns = list(zip(*rows)) or [()] * 4
            arrays = [
                batch.column("doc_id").take(pa.array(which, pa.int64())),
                pa.array(columns[0], pa.int32()),
                *[pa.array(c, pa.int64()) for c in columns[1:]],
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ordered:
                arrays.append(batch.column("position").take(pa.array(which, pa.int64())))
                names.append("position")
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length by best-fit decreasing.

    Open bins wait in a stack per free size; the bits of one number tell which stacks hold
    a bin, so the tightest fit is the lowest bit at or above the length.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, made = 0, 0
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = open_ >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                open_ ^= 1 << room
        else:
            room, at, made = capacity, made, made + 1
        bins[i], offsets[i] = at, capacity - room
        if room > length:
            free[room - length].append(at)
            open_ |= 1 << (room - length)
    return bins, offsets


def thresholds(capacity: int = CAPACITY) -> list[int]:
    """Small sizes at which the dual-feasible functions drop pieces."""
    return sorted({0, *(capacity * k // 64 for k in range(1, 33))})


def feasible_sums(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Sums of the dual-feasible functions over a histogram of lengths, in capacities.

    The function at threshold ``e`` counts a piece longer than ``capacity - e`` as a whole
    bin, drops one shorter than ``e`` and takes any other at its length. Pieces that share
    a bin sum to one at most, so a sum bounds the bins from below. Further functions count
    a piece as ``floor((k + 1) * x)`` of k parts where ``(k + 1) * x`` is not whole.
    Sums over parts of the data add up.
    """
    sizes = np.arange(capacity + 1, dtype=np.int64)
    sums = []
    for e in thresholds(capacity):
        value = np.where(sizes > capacity - e, capacity, np.where(sizes < e, 0, sizes))
        sums.append((counts * value).sum() / capacity)
    for k in (1, 2, 3, 4, 5, 7, 9):
        whole = (k + 1) * sizes % capacity == 0
        value = np.where(whole, sizes / capacity, ((k + 1) * sizes // capacity) / k)
        sums.append(float((counts * value).sum()))
    return np.array(sums)


def bound(sums: np.ndarray) -> int:
    return math.ceil(sums.max() - 1e-6) if len(sums) else 0


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that no packing of ``lengths`` can do without."""
    return bound(feasible_sums(np.bincount(lengths, minlength=capacity + 1), capacity))


def _pack(capacity: int, ordered: bool):
    def run(part: pa.Table) -> pa.Table:
        lengths = part.column("length").to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        used = np.bincount(bins, weights=lengths).astype(np.int64)
        least = np.full(len(bins), lower_bound(lengths, capacity))
        added = [("bin", bins), ("offset", offsets), ("free", (capacity - used)[bins])]
        added += [("part_bins", np.full(len(bins), len(used))), ("part_bound", least)]
        if ordered:
            positions = part.column("position").to_numpy()
            first = np.full(len(used), np.iinfo(np.int64).max)
            np.minimum.at(first, bins, positions)
            added.append(("sequence_position", first[bins]))
        for name, values in added:
            part = part.append_column(name, pa.array(values, pa.int64()))
        return part

    return run


def _dealt(items: DataFrame, parts: int) -> DataFrame:
    """``items`` with the partition that packs each: by rank of position, else at random."""
    if "position" not in items.columns:
        return items.withColumn(
            "part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))
        )
    blocks = materialise(
        items.repartitionByRange(parts, "position").withColumn("block", F.spark_partition_id()),
        "blocks",
    )
    # One row per block of about ITEMS pieces.
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        blocks.groupBy("block")
        .agg(F.count("*").alias("n"))
        .select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    )
    within = F.row_number().over(Window.partitionBy("block").orderBy("position"))
    return (
        blocks.withColumn("within", within)
        .join(bases, "block")
        .select(*items.columns, F.floor((F.col("base") + F.col("within") - 1) / ITEMS).alias("part"))
    )


def _packed(items: DataFrame, count: int, capacity: int) -> DataFrame:
    """``items`` with part, bin, offset, the bin's free tokens, and the part's bins and bound."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    ordered = "position" in items.columns
    added = "part long, bin long, offset long, free long, part_bins long, part_bound long"
    return materialise(
        _dealt(items, -(-count // ITEMS))
        .groupBy("part")
        .applyInArrow(
            _pack(capacity, ordered), f"{fields}, {added}" + ", sequence_position long" * ordered
        ),
        "packed",
    )


def _open(loose: int) -> Column:
    """Bins given to the next round: all with a gap where the part has a bin too many."""
    limit = F.when(F.col("part_bins") > F.col("part_bound"), 0).otherwise(loose)
    return F.col("free") > limit


def _bins(packed: DataFrame, is_open: Column) -> tuple[int, int, int]:
    """Bins, open bins and pieces in open bins; a bin has one piece at offset 0."""
    first = F.col("offset") == 0
    row = packed.agg(
        F.count(F.when(first, 1)), F.count(F.when(first & is_open, 1)), F.count(F.when(is_open, 1))
    ).first()
    return tuple(row)


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    end_id: int = 0,
    capacity: int = CAPACITY,
    with_ids: bool = False,
    position: str | Column | None = None,
    loose: int = LOOSE,
    gain: float = GAIN,
) -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` tokens as it can.

    A document is its tokens and ``end_id``. Returns a row per piece: doc_id, piece,
    start, length, ids_crc32 (of the little-endian unsigned 32-bit ids), sequence_id,
    offset, and with ``with_ids`` the ids themselves. The certificates follow: ``part_bins``
    and ``part_bound`` of the partition that packed the piece, and over everything
    ``bins`` and ``bound``, which no packing can go below. Bins with up to ``loose`` free
    tokens are opened by the last round only.

    With ``position``, a whole number per row (null: before all others), partitions are
    ranges of it. The result then has ``position``, which tells copies of a document apart,
    and ``sequence_position``, the smallest position in the sequence: sequences sorted by it
    follow the order of the documents. Equal positions stand in any order.

    A null or empty text is the single token ``end_id``. Repeated rows and null ids are
    documents of their own; other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    wanted = [F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")]
    ordered = position is not None
    if ordered:
        place = F.col(position) if isinstance(position, str) else position
        wanted.append(F.coalesce(place.cast("long"), F.lit(-1).cast("long")).alias("position"))
    pieces = materialise(
        docs.select(*wanted).mapInArrow(
            _pieces(vocabulary, end_id, capacity, with_ids, ordered),
            f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
            + ", position long" * ordered
            + ", ids array<int>" * with_ids,
        ),
        "pieces",
    )
    columns = pieces.columns
    alone = pieces.where(F.col("length") == capacity).select(
        "*",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(1).cast("long").alias("part_bins"),
        F.lit(1).cast("long").alias("part_bound"),
        *([F.col("position").alias("sequence_position")] if ordered else []),
    )
    items = pieces.where(F.col("length") < capacity)
    # At most ``capacity`` rows: one per length.
    histogram = np.zeros(capacity + 1, np.int64)
    whole = 0
    for length, n in pieces.groupBy("length").count().toLocalIterator():
        if length == capacity:
            whole = n
        else:
            histogram[length] = n
    least = bound(feasible_sums(histogram, capacity))
    count = int(histogram.sum())
    if not count:
        return alone.withColumns(
            {"bins": F.lit(whole).cast("long"), "bound": F.lit(whole).cast("long")}
        )

    # Packed tables, each with the condition of the rows that stay as they are.
    done: list[tuple[DataFrame, Column]] = []
    pool, settled, limit = _packed(items, count, capacity), 0, loose
    bins, open_bins, open_items = _bins(pool, _open(limit))
    while settled + bins > least:
        if open_items:
            again = _packed(pool.where(_open(limit)).select(*columns), open_items, capacity)
            found = _bins(again, _open(limit))
            if open_bins - found[0] >= max(1, gain * open_bins):
                done.append((pool, ~_open(limit)))
                settled += bins - open_bins
                pool, (bins, open_bins, open_items) = again, found
                continue
        if not limit:
            break
        # Later rounds open ever fuller bins, those settled before included, at last all with a gap.
        limit //= 4
        gap = F.col("free") > limit
        kept = [*done, (pool, F.lit(True))]
        everything = _union([packed.where(stays) for packed, stays in kept])
        total, gapped, gap_items = _bins(everything, gap)
        open_items = 0
        if gap_items:
            again = _packed(everything.where(gap).select(*columns), gap_items, capacity)
            found = _bins(again, _open(limit))
            if found[0] < gapped:
                done = [(packed, stays & ~gap) for packed, stays in kept]
                settled = total - gapped
                pool, (bins, open_bins, open_items) = again, found
    done.append((pool, F.lit(True)))
    extra = ["sequence_id", "offset", "part_bins", "part_bound"] + ["sequence_position"] * ordered
    for n, (packed, stays) in enumerate(done):
        number = F.lit(n << 56) + F.col("part") * (1 << 20) + F.col("bin")
        kept = packed.where(stays).withColumn("sequence_id", number)
        alone = alone.union(kept.select(*columns, *extra))
    return alone.withColumns(
        {
            "bins": F.lit(whole + settled + bins).cast("long"),
            "bound": F.lit(whole + least).cast("long"),
        }
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole
