"""Source divergence audit: how the word shares of sources differ, within a language.

Sources of a language are compared by a chi-square-like sum over all kept terms, and each
source's terms against those of its language. Word shares are smoothed, so every term counts
for every pair of sources, also one that neither uses. Pairs are summed by rows, after
Gustavson: the index lists for each term the sources that use it; a source walks its own
terms and scatters what each adds into one dense accumulator over its peers, so no pair of
postings is ever made a row. What a term adds is counted against the share of a peer without
it (the zero baseline), which depends on a source's counts alone, and corrected where the
peer has the term:

    sum = V * f(g0, h0) + own(g, h0) + own(h, g0) + both(g, h)

with f(p, q) the contract's term, g0 and h0 the shares of an absent term, own(g, h0) the sum
of f(p, h0) - f(g0, h0) over the terms of g, and both(g, h) that of
f(p, q) - f(p, h0) - f(g0, q) + f(g0, h0) over the terms that both have. All numbers are
integers; shares stay under 2 ** 31, so squares fit 64 bits, and sums are taken in decimals.

The index is dealt in blocks of terms. A block adds one row per pair of sources that meet in
it, not per posting pair, and holds about BLOCK postings whatever the input's size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagepulse.llm.common import materialise

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
BLOCK = 200_000  # postings, or rows of counts, of one task's block, about
HELD = 500_000  # terms counted before a task passes on what it has
PIECE = 1 << 20  # bytes of a text looked at together
# Runs of letters A-Z, a-z and of everything beyond ASCII, as bytes of UTF-8.
TERM = re.compile(rb"[a-z\x80-\xff]+")
COUNTED = "lang string, source string, term binary, n long, docs long"


def pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in parts that no term crosses."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and (text[end] >= 0x80 or chr(text[end]).isalpha()):
            end += 1
        yield text[at:end]
        at = end


def terms_of(text: bytes) -> Counter:
    """How often each term occurs in a text, A-Z in lower case."""
    found: Counter = Counter()
    for piece in pieces(text):
        found.update(TERM.findall(piece.lower()))
    return found


def _batch(counts: dict[tuple, list[int]]) -> pa.RecordBatch:
    langs, sources, terms = zip(*counts) if counts else ((), (), ())
    n, docs = zip(*counts.values()) if counts else ((), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()),
         pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
        ["lang", "source", "term", "n", "docs"],
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, summed within the task."""
    held: dict[tuple, list[int]] = {}
    for batch in batches:
        for lang, source, text in zip(*[c.to_pylist() for c in batch.columns]):
            for term, n in terms_of(text).items():
                known = held.setdefault((lang, source, term), [0, 0])
                known[0] += n
                known[1] += 1
            if len(held) > HELD:
                yield _batch(held)
                held = {}
    yield _batch(held)


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def share(count: Column, total: str = "total", kept: str = "kept") -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), in decimals on the way."""
    above = F.lit(SCALE).cast("decimal(20,0)") * (count + 2).cast("decimal(18,0)")
    below = _exact(total) + 2 * _exact(kept)
    return 1 + F.call_function("div", above, below.cast("decimal(20,0)"))


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / (p + q)) of 64-bit integers."""
    away = p - q
    return away * away // (p + q)


def _ordered(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _rows(lang: str | None, g: list, h: list, value: list) -> pa.Table:
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (g, h, value)]
    return pa.table([pa.array([lang] * len(joined[0]), pa.string()), *joined], ["lang", "g", "h", "value"])


def _own(key: tuple, spectra: pa.Table, peers: pa.Table) -> pa.Table:
    """own(g, h0) for the sources of a slice against every peer of the language.

    ``spectra`` has how many terms of a source have which share: few rows, as n different
    shares need n * n / 2 words. A dense accumulator over the peers is filled for one source
    at a time.
    """
    ids, zero = _ordered(peers, "g", "zero")
    order = np.argsort(ids)
    ids, zero = ids[order], zero[order]
    made: tuple[list, list, list] = ([], [], [])
    g, p, m, own_zero = _ordered(spectra, "g", "p", "m", "zero")
    order = np.argsort(g, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(g[order])) + 1) if len(g) else []:
        total = np.zeros(len(ids), np.int64)
        base = gap(own_zero[rows[0]], zero)
        for row in rows:
            total += m[row] * (gap(p[row], zero) - base)
        made[0].append(np.full(len(ids), g[rows[0]]))
        made[1].append(ids)
        made[2].append(total)
    return _rows(key[0].as_py(), *made)


def _both(key: tuple, postings: pa.Table) -> pa.Table:
    """both(g, h) of a block of terms, for every peer h after g that shares a term with it.

    The postings sorted by term are the term-major index, sorted by source the rows. Each
    row gathers the index entries of its terms and scatters them into its accumulator.
    """
    g, p, zero = _ordered(postings, "g", "p", "zero")
    terms = postings.column("term").combine_chunks().dictionary_encode()
    terms = (terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms).indices.to_numpy()
    ids, local = np.unique(g, return_inverse=True)
    index = np.lexsort((local, terms))
    term, peer, ps, zeros = terms[index], local[index], p[index], zero[index]
    ends = np.searchsorted(term, term, side="right")
    made: tuple[list, list, list] = ([], [], [])
    by_row = np.argsort(peer, kind="stable")
    for rows in np.split(by_row, np.flatnonzero(np.diff(peer[by_row])) + 1) if len(g) else []:
        total = np.zeros(len(ids), np.int64)
        met = np.zeros(len(ids), bool)
        own_zero = zeros[rows[0]]
        # In parts, so that the entries gathered at once stay few.
        upto = np.cumsum(ends[rows] - rows)
        for part in np.split(rows, np.searchsorted(upto, np.arange(PIECE, upto[-1], PIECE))):
            if not len(part):
                continue
            lengths = ends[part] - part - 1  # the entries of the same term after the row's own
            first = np.repeat(part + 1 - np.r_[0, np.cumsum(lengths)[:-1]], lengths)
            entries = first + np.arange(len(first))
            mine, theirs, absent = np.repeat(ps[part], lengths), ps[entries], zeros[entries]
            added = gap(mine, theirs) - gap(mine, absent) - gap(own_zero, theirs) + gap(own_zero, absent)
            np.add.at(total, peer[entries], added)
            met[peer[entries]] = True
        found = np.flatnonzero(met)
        made[0].append(np.full(len(found), ids[peer[rows[0]]]))
        made[1].append(ids[found])
        made[2].append(total[found])
    return _rows(key[0].as_py(), *made)


PAIRED = "lang string, g long, h long, value long"


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, g, h, value for every ordered pair of sources of a language."""
    n_blocks = F.greatest(F.ceil(F.col("postings") / BLOCK), F.lit(1))
    langs = groups.groupBy("lang").agg(F.sum("used").alias("postings")).select("lang", n_blocks.alias("blocks"))
    posted = counts.select("lang", "g", "term", "p", "zero")
    both = (
        posted.join(langs, "lang")
        .withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
        .groupBy("lang", "block")
        .applyInArrow(_both, PAIRED)
    )
    spectra = posted.groupBy("lang", "g", "p", "zero").agg(F.count("*").alias("m"))
    slices = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    peers = groups.join(langs, "lang").select(*[F.col(c).alias(c) for c in ("lang", "g", "zero")], slices.alias("block"))
    own = (
        spectra.join(langs, "lang")
        .withColumn("block", F.pmod(F.xxhash64("g"), "blocks"))
        .groupBy("lang", "block")
        .cogroup(peers.groupBy("lang", "block"))
        .applyInArrow(_own, PAIRED)
    )
    halves = own.unionByName(both).where("g != h")
    # Every part counts for the pair and for the pair turned round.
    both_ways = halves.withColumn("turned", F.explode(F.array(F.lit(False), F.lit(True)))).select(
        "lang",
        F.when(F.col("turned"), F.col("h")).otherwise(F.col("g")).alias("g"),
        F.when(F.col("turned"), F.col("g")).otherwise(F.col("h")).alias("h"),
        "value",
    )
    return both_ways.groupBy("lang", "g", "h").agg(F.sum(_exact("value")).alias("value"))


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS
) -> DataFrame:
    """Divergence of the sources of each language: lang, source, part, item, value, rank.

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` terms
    that a source uses more than its language does; ranks go by value, then item in UTF-8.
    Terms are runs of A-Z, a-z and characters beyond ASCII, A-Z in lower case, of whole
    texts; a language keeps those of at least ``min_docs`` documents. Null text, language
    and source are empty; a source without kept terms is a source like any other; repeated
    rows are documents of their own; ties go by item. Other columns are ignored, whatever
    their names, and an empty table gives an empty result.
    """
    named = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    # An empty term stands for the document itself: it lists the groups, terms or no terms.
    counts = materialise(
        named.mapInArrow(_count, COUNTED)
        .unionByName(
            named.groupBy("lang", "source").agg(F.count("*").alias("docs")).select(
                "lang", "source", F.lit(b"").alias("term"), F.lit(0).cast("long").alias("n"), "docs"
            )
        )
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        "divergence-counts",
    )
    used = counts.where(F.octet_length("term") > 0)
    kept = used.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(
        F.col("docs") >= min_docs
    )
    counted = materialise(used.select("lang", "source", "term", "n").join(kept.drop("docs"), ["lang", "term"]), "divergence-kept")
    # One row per source, and one per language.
    sources = counts.where(F.octet_length("term") == 0).select("lang", "source").join(
        counted.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("used")),
        ["lang", "source"],
        "left",
    ).fillna(0, ["total", "used"])
    terms = counted.groupBy("lang", "term").agg(F.first("lang_n").alias("n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    groups = materialise(
        sources.join(langs, "lang", "left")
        .fillna(0, ["kept", "lang_total"])
        .withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long"))
        .withColumn("zero", F.when(F.col("kept") > 0, share(F.lit(0).cast("long")))),
        "divergence-groups",
    )
    shares = counted.join(groups.drop("used"), ["lang", "source"]).select(
        "lang",
        "source",
        "g",
        "term",
        "zero",
        share(F.col("n")).alias("p"),
        share(F.col("lang_n"), "lang_total").alias("q"),
    )
    sums = _pairs(shares, groups)
    value = F.coalesce(F.col("value"), F.lit(0)) + F.when(
        F.col("kept") > 0, _exact("kept") * _gap("zero", "other_zero")
    ).otherwise(0)
    others = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("zero").alias("other_zero"))
    pairs = (
        groups.select("lang", "source", "g", "zero", "kept")
        .join(others, "lang")
        .where("g != h")
        .join(sums, ["lang", "g", "h"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    )
    above = shares.where("p > q").select(
        "lang",
        "source",
        F.lit("term").alias("part"),
        F.col("term").cast("string").alias("item"),
        _gap("p", "q").cast("long").alias("value"),
    )
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", place).unionByName(above.withColumn("rank", place).where(F.col("rank") <= top))
    return ranked


def _gap(p: str, q: str) -> Column:
    """floor((p - q) ** 2 / (p + q)) of long columns under 2 ** 31."""
    away = F.col(p) - F.col(q)
    return F.call_function("div", away * away, F.col(p) + F.col(q))
