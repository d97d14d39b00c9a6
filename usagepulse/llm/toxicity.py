"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel compares two words by the four-character subsequences they share, each weighted
down by the gaps it spans, so an insult with letters pulled apart or characters put between
them stays close to itself. A sentence is as toxic as its worst word, a document as its
worst sentence.

Training takes labelled sentences. Every sentence of a clean document is clean, and so are
its words. A sentence of a toxic document is toxic if one of its words is found in toxic
documents more often than chance explains (at a false discovery rate over all words).
Words are mapped by their kernel values to a few landmark words (Nyström)
and a linear machine is trained on that. Because the kernel is a dot product over
subsequences, the trained machine folds into one weight per subsequence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagepulse.llm.common import at_most, bounded_sample, held_out, materialise

SAMPLE = 20_000  # labelled documents the machine is trained on, those of the smallest id hashes
HARD = 6_000  # clean words that a first machine takes for toxic
SUSPECTS = 5_000  # most telling words of toxic sentences
CLEAN = 12_000  # words of clean sentences: the most frequent, and as many by hash
LANDMARKS = 320
DECAY = 0.6  # weight of a subsequence for every position it spans beyond four
SPAN = 6
LONG = 24  # a longer word is read in windows of this many characters
FALSE_SHARE = 0.05  # of the suspects that chance may have put there
COST = 8.0
OFFSET = -1.0
THRESHOLD = 0.5
NOTHING = -4.0  # decision for a text without words
CACHE = 1_000_000  # words whose decision a worker remembers

_STRIP = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)|\n+")
_PATTERNS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def units(text: str) -> set[str]:
    """Distinct words of a text in lower case: bare of outer punctuation; also bare of
    inner punctuation; runs of single characters also joined; long words in overlapping
    windows."""
    words = text.lower().split()
    found = set(words)
    run: list[str] = []
    for word in words:
        if len(word) < 4:
            bare = word if word.isalnum() else _STRIP.sub("", word)
            if len(bare) == 1:
                run.append(bare)
                continue
            if not bare:
                continue
        if len(run) > 2:
            found.add("".join(run))
        if run:
            run = []
    if len(run) > 2:
        found.add("".join(run))
    out = set()
    for word in found:
        if not word.isalnum():
            word = _STRIP.sub("", word)
            bare = _INNER.sub("", word)
            if 1 < len(bare) <= LONG:
                out.add(bare)
        if len(word) > LONG:
            out.update(word[i : i + LONG] for i in range(0, len(word) - LONG // 2, LONG // 2))
        elif word:
            out.add(word)
    return out


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, weights and word numbers of all subsequences, word boundaries included.

    A key packs four code points, each folded to 16 bits. Weights are scaled to unit length
    by word; a word shorter than two characters has none.
    """
    text = "".join(f"^{w}$" for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    points = (points ^ (points >> np.uint64(16))) & np.uint64(0xFFFF)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    keys, weights, owners = [], [], []
    for a, b, c in _PATTERNS:
        at = np.flatnonzero(owner[:-c] == owner[c:]) if len(owner) > c else np.zeros(0, np.int64)
        left = (points[at] << np.uint64(16)) | points[at + a]
        keys.append((left << np.uint64(32)) | (points[at + b] << np.uint64(16)) | points[at + c])
        weights.append(np.full(len(at), DECAY ** (c - 3)))
        owners.append(owner[at])
    key, weight, own = map(np.concatenate, (keys, weights, owners))
    # Repeats within a word add up before its length is taken.
    mixed = (key ^ (own.astype(np.uint64) * _ODD)) * _ODD
    mixed ^= mixed >> np.uint64(29)
    mixed = mixed * _ODD + own.astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    first = np.flatnonzero(np.r_[True, mixed[order][1:] != mixed[order][:-1]]) if len(order) else order
    sums = np.add.reduceat(weight[order], first) if len(order) else weight
    key, own = key[order[first]], own[order[first]]
    lengths = np.sqrt(np.bincount(own, sums**2, len(words)))
    return key, sums / lengths[own], own


@dataclass
class Machine:
    """A weight per subsequence key (sorted), the offset, and the slope and place of the
    logistic curve that turns a document's decision into a probability."""

    keys: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float = 1.0
    place: float = 0.0

    def decide(self, words: list[str]) -> np.ndarray:
        if not words or not len(self.keys):
            return np.full(len(words), self.offset)
        key, weight, own = subsequences(words)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        value = np.where(self.keys[at] == key, self.weights[at], 0.0)
        return np.bincount(own, value * weight, len(words)) + self.offset

    def probability(self, decisions: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-(self.slope * decisions + self.place), -50, 50)))


_cache: dict[str, float] = {}
_cached_for: list[bytes] = []


def decisions(machine: Machine, texts: list[str | None], step: int = 256) -> np.ndarray:
    """Decision of each whole text: that of its worst word."""
    mark = machine.weights.tobytes() + np.float64(machine.offset).tobytes()
    if _cached_for != [mark]:
        _cache.clear()
        _cached_for[:] = [mark]
    out = np.full(len(texts), NOTHING)
    for at in range(0, len(texts), step):
        found = [units(t or "") for t in texts[at : at + step]]
        if len(_cache) > CACHE:
            _cache.clear()
        new = list(set().union(*found) - _cache.keys())
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            _cache.update(zip(part, machine.decide(part).tolist()))
        for k, own in enumerate(found):
            if own:
                out[at + k] = max(map(_cache.__getitem__, own))
    return out


def support_vectors(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps.

    The offset is fixed: a word like none of the landmarks is clean, at the margin.
    """
    ridge = np.ones(x.shape[1])
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        slack = np.maximum(0, 1 - y * (x @ w + OFFSET))
        return float(w @ w / 2 + COST * (weight * slack**2).sum() / 2)

    now = loss(w)
    for _ in range(rounds):
        slack = 1 - y * (x @ w + OFFSET)
        on = slack > 0
        gradient = w - COST * x[on].T @ (weight[on] * y[on] * slack[on])
        hessian = np.diag(ridge) + COST * (x[on].T * weight[on]) @ x[on]
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-7 * max(1.0, before):
            break
    return w


def spoilt(word: str, place: int) -> list[str]:
    """Ways to write a word apart: characters put between all letters, or one put in."""
    at = 1 + place % max(1, len(word) - 1)
    return [".".join(word), word[:at] + "*" + word[at:], word[:at] + word[at - 1] + word[at:]]


def fit(suspects: list[tuple[str, int]], clean: list[tuple[str, int]]) -> Machine:
    """A machine from words of toxic and of clean sentences, each with its documents' number.

    Suspects are joined by spoilt spellings of themselves, at less weight. Landmarks are
    the first of both lists.
    """
    if not suspects or not clean:
        return Machine(np.zeros(0, np.uint64), np.zeros(0), OFFSET)
    marks = [w for w, _ in suspects[: LANDMARKS // 2]]
    marks = list(dict.fromkeys(marks + [w for w, _ in clean[: LANDMARKS - len(marks)]]))
    key, weight, own = subsequences(marks)
    vocabulary, column = np.unique(key, return_inverse=True)
    basis = np.zeros((len(vocabulary), len(marks)))
    np.add.at(basis, (column, own), weight)
    values, vectors = np.linalg.eigh(basis.T @ basis)
    root = vectors / np.sqrt(np.maximum(values, 1e-3))

    def mapped(words: list[str]) -> np.ndarray:
        rows = np.zeros((len(words), len(marks)))
        for i in range(0, len(words), 256):
            key, weight, own = subsequences(words[i : i + 256])
            at = np.minimum(np.searchsorted(vocabulary, key), len(vocabulary) - 1)
            hit = np.flatnonzero(vocabulary[at] == key)
            hit = hit[np.argsort(own[hit], kind="stable")]
            if len(hit):
                owners, first = np.unique(own[hit], return_index=True)
                rows[i + owners] = np.add.reduceat(basis[at[hit]] * weight[hit, None], first)
        return rows @ root

    known = {w for w, _ in suspects}
    clean = [(w, n) for w, n in clean if w not in known]
    words = [w for w, _ in suspects]
    extra = [(s, n) for i, (w, n) in enumerate(suspects) if len(w) > 3 for s in spoilt(w, i)]
    x = np.vstack([mapped(words), mapped([w for w, _ in extra]), mapped([w for w, _ in clean])])
    y = np.r_[np.ones(len(words) + len(extra)), -np.ones(len(clean))]
    weight = np.sqrt([n for _, n in [*suspects, *extra, *clean]])
    weight[len(words) : len(words) + len(extra)] *= 0.3
    weight[y > 0] *= (weight[y < 0].sum() / weight[y > 0].sum()) ** 0.5
    w = support_vectors(x, y, weight / weight.mean())
    return Machine(vocabulary, basis @ (root @ w), OFFSET)


def telling(toxic: np.ndarray, clean: np.ndarray, words: np.ndarray, base: float) -> np.ndarray:
    """Which counts of documents stand out, of pairs that ``words`` words share.

    ``base`` is the share of toxic documents. The chance that so many of a word's documents
    are toxic is bounded by Chernoff and taken at the false discovery rate FALSE_SHARE.
    """
    total = toxic + clean
    share = np.clip(toxic / total, 1e-12, 1 - 1e-12)
    bits = share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base))
    chance = np.where(share > base, np.exp(-total * bits), 1.0)
    order = np.argsort(chance)
    rank = np.cumsum(words[order])
    passed = np.flatnonzero(chance[order] * words.sum() <= FALSE_SHARE * rank)
    keep = np.zeros(len(total), bool)
    keep[order[: passed[-1] + 1 if len(passed) else 0]] = True
    return keep & (toxic > 1)


def calibrate(machine: Machine, found: np.ndarray, labels: np.ndarray) -> Machine:
    """Fits the logistic curve to documents' decisions, with targets kept off 0 and 1."""
    ones, zeros = labels.sum(), len(labels) - labels.sum()
    if not ones or not zeros:
        return machine
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([found, np.ones(len(found))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        hessian = (x.T * (p * (1 - p))) @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        w = w - step * min(1.0, 5.0 / np.abs(step).max()) if np.abs(step).max() else w
        if np.abs(step).max() < 1e-9:
            break
    return Machine(machine.keys, machine.weights, machine.offset, float(max(w[0], 1e-3)), float(w[1]))


def _words_of_sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean documents of a batch with each word in one of their sentences."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            for word in set().union(*map(units, sentences(text or ""))):
                counts.setdefault(word, [0, 0])[label] += 1
        pairs = list(counts.values())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(counts.keys(), pa.string()),
                pa.array([p[1] for p in pairs], pa.int64()),
                pa.array([p[0] for p in pairs], pa.int64()),
            ],
            ["unit", "toxic", "clean"],
        )


def _decide(machine: Machine, other: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = decisions(machine, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(other), pa.array(found)], [other, "decision"]
            )

    return run


def _score_words(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("unit").to_pylist()
            found = [machine.decide(words[i : i + 4096]) for i in range(0, len(words), 4096)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate([np.zeros(0), *found]))],
                [*batch.schema.names, "decision"],
            )

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """A calibrated machine from labelled rows of ``docs(doc_id, text)`` that are not held out.

    Labels other than 0 and 1, and null ids, teach nothing. What reaches the driver is
    bounded: SUSPECTS and CLEAN words, and ``sample`` decisions.
    """
    known = labels.where(
        F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    ).select("doc_id", F.col(label).cast("int").alias("label"))
    lessons = materialise(
        docs.join(bounded_sample(known, "doc_id", sample), "doc_id").select("doc_id", "text", "label"),
        "lessons",
    )
    lessons = at_most(lessons, "doc_id", sample)
    # A copied text teaches once; it is toxic if at least half of its labels say so.
    distinct = lessons.groupBy("text").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    counted = materialise(
        distinct.mapInArrow(_words_of_sentences, "unit string, toxic long, clean long")
        .groupBy("unit")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
        "units",
    )
    ones, rows = distinct.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    base = (ones + 1) / (rows + 2)
    # Pairs of counts of at most ``sample`` documents, however many words share them.
    pairs = counted.groupBy("toxic", "clean").count().toPandas()
    keep = telling(*(pairs[c].to_numpy(float) for c in ("toxic", "clean", "count")), base)
    wanted = docs.sparkSession.createDataFrame(
        [(int(t), int(c)) for t, c in pairs.loc[keep, ["toxic", "clean"]].to_numpy()],
        "toxic long, clean long",
    )
    suspects = (
        counted.join(F.broadcast(wanted), ["toxic", "clean"])
        .orderBy((F.col("toxic") * F.col("toxic") / (F.col("toxic") + F.col("clean"))).desc(), "unit")
        .limit(SUSPECTS)
        .select("unit", "toxic")
        .collect()
    )
    usual = counted.where("clean > 0").select("unit", "clean")
    frequent = usual.orderBy(F.desc("clean"), "unit").limit(CLEAN // 2).collect()
    others = bounded_sample(usual, "unit", CLEAN // 2).collect()
    suspects = [tuple(r) for r in suspects]
    usually = list(dict.fromkeys(tuple(r) for r in frequent + others))
    first = fit(suspects, usually)
    known = docs.sparkSession.createDataFrame(suspects, "unit string, toxic long")
    hard = (
        usual.join(F.broadcast(known), "unit", "left_anti")
        .mapInArrow(_score_words(first), "unit string, clean long, decision double")
        .where("decision > -1")
        .orderBy((F.log1p("clean") * (F.col("decision") + 1)).desc(), "unit")
        .limit(HARD)
        .select("unit", "clean")
        .collect()
    )
    machine = fit(suspects, list(dict.fromkeys([tuple(r) for r in hard] + usually)))
    rows = lessons.mapInArrow(_decide(machine, "label"), "label int, decision double").toArrow()
    return calibrate(machine, rows.column("decision").to_numpy(), rows.column("label").to_numpy())


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    A null or empty text has no word and the lowest score. Repeated rows and null ids (held
    out) keep their rows; other columns are ignored; without labels of both kinds no word
    counts as toxic. An empty table gives an empty result.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    machine = train(docs, labels)
    p = F.lit(machine.slope) * F.col("decision") + F.lit(machine.place)
    return docs.mapInArrow(_decide(machine, "doc_id"), f"doc_id {kind}, decision double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        (1 / (1 + F.exp(-p))).alias("score"),
        (p >= 0.0).cast("int").alias("predicted"),
    )
