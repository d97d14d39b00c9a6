"""Quality rules and quality classifier, and the statistics both read."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import TESTDATA

from usagepulse.llm import quality_classifier, quality_rules
from usagepulse.llm.common import at_most
from usagepulse.llm.textstats import RATIOS, repeated_words, statistics

from .conftest import LONG

WORD = r"[^\x20\x09-\x0D]+"


def slow_base(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(inside)


@pytest.mark.parametrize(
    "text",
    [None, "", " \n", "a", "a b " * 9, "one two three four five six seven eight " * 2, "x\nx\n\n x\nx\r\nx", "é#|é\x1c *\x85y"],
)
def test_base_counts_of_awkward_texts(text):
    assert statistics(text)[0] == slow_base(text)


def test_windows_that_overlap_count_each_word_once():
    assert repeated_words(np.array([1] * 12)) == 12
    assert repeated_words(np.array([*range(8), 99, *range(8)])) == 16
    assert repeated_words(np.arange(40)) == 0


def test_rules_on_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality_rules.judge(docs, keep=["doc_id"]).select("doc_id", "_rules.*").collect()
    assert len(got) == len(texts)
    for r in got:
        base = slow_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_rules_keep_good_documents_and_drop_bad_ones(spark, size):
    docs = spark.read.parquet(f"{TESTDATA}/{size}/documents.parquet")
    labels = spark.read.parquet(f"{TESTDATA}/{size}/labels.parquet")
    judged = quality_rules.judge(docs, keep=["doc_id"]).select("doc_id", "_rules.*").join(labels, "doc_id")
    rows = judged.where("NOT base_failed").groupBy("quality", "kept").count().collect()
    counts = {(r.quality, r.kept): r["count"] for r in rows}
    assert counts.get((1, False), 0) <= 0.01 * counts[1, True]
    assert counts.get((0, True), 0) <= 0.1 * (counts.get((0, False), 0) + 1)


def test_em_finds_what_rules_are_worth():
    """Two reliable rules and one that votes at random: the posterior follows the two."""
    rnd = np.random.default_rng(1)
    good = rnd.random(4000) < 0.8
    votes = np.stack(
        [
            np.where(good, 2, np.where(rnd.random(4000) < 0.9, 0, 2)),
            np.where(good, np.where(rnd.random(4000) < 0.02, 0, 2), np.where(rnd.random(4000) < 0.8, 0, 2)),
            np.full(4000, 1),
        ],
        axis=1,
    )
    codes = votes @ 3 ** np.arange(3)
    patterns, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    found = quality_rules.posteriors(patterns, counts.astype(float), rules=3)[inverse] >= 0.5
    assert (found == good).mean() > 0.95


def test_awkward_rows(awkward, no_rows):
    judged = quality_rules.judge(awkward)
    assert judged.columns == [*awkward.columns, "_rules"]
    rows = judged.select("text", "_rules.*").collect()
    assert len(rows) == awkward.count()
    assert all(not r.kept for r in rows if not (r.text or "").strip())
    assert next(r.n_words for r in rows if r.text == LONG) == 40_000
    assert quality_rules.judge(no_rows).count() == 0


def test_flat_trees_walk_like_nested_ones():
    rnd = np.random.default_rng(2)
    values = rnd.normal(size=(500, 5))
    labels = (values[:, 1] + values[:, 3] ** 2 > 0.5).astype(float)
    forest = quality_classifier.fit(values, labels)
    for row, raw in zip(values[:40], forest.raw(values[:40])):
        total = forest.start
        for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        assert abs(total - raw) < 1e-9
    assert ((forest.probability(values) > 0.5) == labels).mean() > 0.95
    assert len(forest.probability(values[:0])) == 0


def test_classifier_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{TESTDATA}/sf0.1/labels.parquet")
    got = quality_classifier.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in unseen) >= 0.98 * len(unseen)


def test_classifier_on_awkward_rows(spark, awkward, no_rows):
    labels = spark.createDataFrame(
        [(1, 1), (2, 0), (2, 0), (6, None), (None, 1), (8, 7)], "doc_id long, quality int"
    )
    got = quality_classifier.classify(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)
    assert quality_classifier.classify(no_rows, labels).count() == 0
    unlabelled = quality_classifier.classify(awkward, labels.where("doc_id > 99")).collect()
    assert {r.score for r in unlabelled} == {0.5}
    assert len(RATIOS) == len(statistics("a word")[1])


@pytest.mark.parametrize("share", [0.01, 0.05, 0.1])
@pytest.mark.parametrize("rule", range(len(quality_rules.RULES)))
def test_junk_that_fails_one_rule_goes(rule, share):
    """Accuracies come from the documents: one bad vote is enough where good ones draw few."""
    good = sum(quality_rules.GOOD * 3**i for i in range(len(quality_rules.RULES)))
    unsure, junk = good - (1 if rule else 3), good - quality_rules.GOOD * 3**rule
    counts = np.array([0.9 * (1 - share), 0.1 * (1 - share), share]) * 100_000
    found = quality_rules.posteriors(np.array([good, unsure, junk]), counts)
    assert found[0] > 0.9 and found[1] > 0.8 and found[2] < quality_rules.KEEP_AT


def test_a_repeated_id_does_not_widen_the_sample(spark):
    rows = [(i % 3, f"Text {i} of some words.", i % 2) for i in range(90)]
    measured = spark.createDataFrame([(i, [float(n)] * len(RATIOS)) for n, (i, _, _) in enumerate(rows)], "doc_id long, values array<double>")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, quality long")
    taught = at_most(measured.join(labels, "doc_id"), "doc_id", 10)
    assert taught.count() == 10 and sorted(map(str, taught.collect())) == sorted(map(str, taught.collect()))
    assert at_most(measured, "doc_id", 90).count() == 90
