"""SimHash fingerprints and near-duplicate groups by tiled exact comparison.

Fingerprints are grouped by each of four 16-bit bands: two fingerprints that differ in at
most three bits agree in one band at least, so comparing within bands is exact. A band
value shared by more fingerprints than a tile holds is cut into tiles of one population
count each, and only pairs of tiles whose counts differ by at most the radius are
compared. A tile pair yields a spanning forest, not its pairs. Forests are joined into
components by rounds of contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagepulse.llm.common import materialise

RADIUS = 3
BANDS = 4
# A tile holds at least MIN_TILE fingerprints, and the share 1 / TILES of all: at most
# BANDS * TILES band values can then need tiles, which bounds what is broadcast.
MIN_TILE = 256
TILES = 2048
_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        spans = zip(starts[at : at + _BLOCK][: n - at].tolist(), last[at : at + _BLOCK].tolist())
        hashes = np.array([digest(joined[a:b]) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        values = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        names = [n for n in batch.schema.names if n != "text"]
        columns = {n: batch.column(n) for n in names} | {"fp": pa.array(values.view(np.int64))}
        order = ["doc_id", "fp", *[n for n in names if n != "doc_id"]]
        yield pa.RecordBatch.from_arrays([columns[n] for n in order], order)


def forest(left: np.ndarray, right: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within ``left``, or between ``left`` and ``right``.

    Returns two arrays: members and the member that leads each one's tree, leaders left
    out. Members wait in order of population count, so a member is only compared with
    the slice whose counts are within the radius, and only with those not yet reached.
    """
    both = left if right is None else np.concatenate([left, right])
    both = both.view(np.uint64)
    if right is None and len(both) == 2:
        near = int(both[0] ^ both[1]).bit_count() <= radius
        return (both[1:], both[:1]) if near else (both[:0], both[:0])
    side = np.zeros(len(both), bool) if right is None else np.arange(len(both)) >= len(left)
    counts = np.bitwise_count(both)
    order = np.argsort(counts, kind="stable")
    both, side, counts = both[order], side[order], counts[order].astype(np.int64)
    low = np.searchsorted(counts, counts - radius)
    high = np.searchsorted(counts, counts + radius, side="right")
    waiting = np.ones(len(both), bool)
    lead = np.arange(len(both))
    for first in range(len(both)):
        if not waiting[first]:
            continue
        waiting[first] = False
        frontier = [first]
        while frontier:
            at = frontier.pop()
            part = slice(low[at], high[at])
            open_ = waiting[part] if right is None else waiting[part] & (side[part] != side[at])
            found = np.flatnonzero(open_)
            if len(found):
                found = found[np.bitwise_count(both[part][found] ^ both[at]) <= radius] + low[at]
                waiting[found] = False
                lead[found] = first
                frontier.extend(found.tolist())
    joined = lead != np.arange(len(both))
    return both[joined], both[lead[joined]]


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        members, leads = [], []
        for own, other, paired in zip(batch["own"], batch["other"], batch["paired"]):
            found = forest(np.asarray(own), np.asarray(other, dtype=np.int64) if paired else None)
            members.append(found[0])
            leads.append(found[1])
        if members:
            yield pd.DataFrame(
                {"a": np.concatenate(members).view(np.int64), "b": np.concatenate(leads).view(np.int64)}
            )


def links(fps: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints ``fp`` that hold every group together."""
    total = fps.count()
    tile = max(MIN_TILE, -(-total // TILES))
    bands = fps.select(
        "fp",
        F.bit_count("fp").alias("pop"),
        F.explode(
            F.array(
                *[
                    F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) + F.lit(i * 65536)
                    for i in range(BANDS)
                ]
            )
        ).alias("band"),
    )
    sizes = bands.groupBy("band", "pop").agg(F.count("*").alias("n"))
    sizes = materialise(sizes, "simhash-sizes")
    # At most BANDS * TILES rows: each stands for more than 1 / TILES of all.
    large = (
        sizes.groupBy("band")
        .agg(
            F.sum("n").alias("n"),
            F.collect_list(
                F.struct("pop", F.ceil(F.col("n") / tile).cast("int").alias("slots"))
            ).alias("pops"),
        )
        .where(F.col("n") > tile)
        .select("band", "pops")
    )
    placed = bands.join(F.broadcast(large), "band", "left")
    own = F.col("pop") * F.lit(1 << 20) + F.pmod(
        F.xxhash64("fp"),
        F.element_at(F.filter("pops", lambda p: p["pop"] == F.col("pop")), 1)["slots"],
    ).cast("int")
    near = F.flatten(
        F.transform(
            F.filter("pops", lambda p: F.abs(p["pop"] - F.col("pop")) <= RADIUS),
            lambda p: F.transform(
                F.sequence(F.lit(0), p["slots"] - 1), lambda s: p["pop"] * F.lit(1 << 20) + s
            ),
        )
    )
    small = placed.where("pops IS NULL").select(
        "band", F.lit(-1).alias("ta"), F.lit(-1).alias("tb"), F.lit(0).alias("side"), "fp"
    )
    tiled = (
        placed.where("pops IS NOT NULL")
        .select("band", "fp", own.alias("tile"), near.alias("near"))
        .select("band", "fp", "tile", F.explode("near").alias("with"))
        .select(
            "band",
            F.least("tile", "with").alias("ta"),
            F.greatest("tile", "with").alias("tb"),
            (F.col("tile") > F.col("with")).cast("int").alias("side"),
            "fp",
        )
    )
    groups = (
        small.union(tiled)
        .groupBy("band", "ta", "tb")
        .agg(
            F.collect_list(F.when(F.col("side") == 0, F.col("fp"))).alias("own"),
            F.collect_list(F.when(F.col("side") == 1, F.col("fp"))).alias("other"),
        )
        .select("own", "other", (F.col("ta") != F.col("tb")).alias("paired"))
        .where(
            F.when(F.col("paired"), (F.size("own") > 0) & (F.size("other") > 0)).otherwise(
                F.size("own") > 1
            )
        )
    )
    return groups.mapInPandas(_compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Members ``node`` of the graph of ``edges(a, b)`` and the ``root`` of their component.

    Each round shuffles the nodes anew by a hash seeded with its number; every node follows
    the first of itself and its neighbours in that order, edges are carried over to those
    leaders and repeats dropped. As the order owes nothing to the graph, a constant share of
    the nodes is expected to go each round whatever its shape (half of them on a path), so
    rounds grow with the logarithm of the largest component. The leaders of the rounds are
    then followed from node to root.
    """
    edges = materialise(edges.where("a != b").distinct(), "links")
    rounds = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seed = F.lit(len(rounds))
        place = F.struct(F.xxhash64("b", seed).alias("order"), F.col("b").alias("node"))
        own = F.struct(F.xxhash64("node", seed).alias("order"), "node")
        leads = materialise(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min(place).alias("first"))
            .select("node", F.least(own, "first")["node"].alias("lead")),
            "leads",
        )
        rounds.append(leads)
        on_a = leads.select(F.col("node").alias("a"), F.col("lead").alias("la"))
        on_b = leads.select(F.col("node").alias("b"), F.col("lead").alias("lb"))
        edges = materialise(
            edges.join(on_a, "a")
            .join(on_b, "b")
            .where("la != lb")
            .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
            .distinct(),
            "links",
        )
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds.pop()
    while rounds:
        later = roots.select(F.col("node").alias("lead"), F.col("lead").alias("root"))
        roots = (
            rounds.pop()
            .join(later, "lead", "left")
            .select("node", F.coalesce("root", "lead").alias("lead"))
        )
    return roots.withColumnRenamed("lead", "root")


def _groups(docs: DataFrame, doc_id: str, text: str, key: str | None) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the rows, and ``fp, root, component_id`` of each fingerprint."""
    columns = [F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")]
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fp long"
    if key:
        columns.append(F.col(key).alias("key"))
        schema += f", key {docs.schema[key].dataType.simpleString()}"
    prints = materialise(docs.select(*columns).mapInArrow(_fingerprints, schema), "fingerprints")
    fps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    roots = materialise(components(links(fps)), "roots")
    firsts = fps.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "first")
    smallest = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    grouped = firsts.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id")
    ids = fps.join(grouped, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.coalesce("component_id", "first").alias("component_id"),
    )
    return prints, materialise(ids, "components")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    Fingerprints link at three or fewer differing bits; ``component_id`` is the smallest
    ``doc_id`` reachable. A null or empty text has no word and fingerprint zero, which
    links like any other. A null ``doc_id`` keeps its row and gives no id to its group (a
    group of null ids only has a null id). Repeated rows give repeated rows; other
    columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    prints, ids = _groups(docs, doc_id, text, None)
    return prints.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their near-duplicate group, all columns kept.

    That is the row with the smallest ``doc_id`` (nulls last); of several with that id, one
    of those with the smallest hash of their text, and of those the one whose columns hash
    lowest. Nulls, empty texts and repeated rows are grouped as in ``near_duplicates``; an
    empty table gives an empty result.
    """
    place = F.concat_ws(
        ":",
        F.coalesce(F.col(doc_id).cast("string"), F.lit("null")),
        F.hex(F.xxhash64(F.col(text).cast("string"))),
    )
    # The row travels as one column, so its names meet none of those in use here.
    marked = docs.select(
        F.struct(*docs.columns).alias("whole"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), place.alias("place")
    )
    prints, ids = _groups(marked, "doc_id", "text", "place")
    # Merged on the map side: a group of any size leaves each task as one row.
    chosen = (
        prints.join(ids, "fp")
        .groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("least"))
        .select(F.col("least.key").alias("place"))
        .distinct()
    )
    # Rows equal in id and text merge on the map side, however many there are.
    return (
        marked.join(chosen, "place", "left_semi")
        .groupBy("place")
        .agg(F.min_by("whole", F.xxhash64("whole")).alias("whole"))
        .select("whole.*")
    )
