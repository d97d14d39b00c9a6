"""Quality rules as weak supervision: votes, accuracies by EM, posterior of being good.

Every rule votes good, votes bad or abstains on each document. The votes of all documents
are counted by pattern in Spark; a pattern is one of three outcomes per rule, so at most
3 ** len(RULES) counts reach the driver whatever the input's size. Expectation
maximisation over the counts estimates, for good and for bad documents, how often each
rule votes which way, and gives each pattern its posterior.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from usagepulse.llm.common import materialise
from usagepulse.llm.textstats import BASE, RATIOS, statistics

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP_AT = 0.5
BAD, ABSTAIN, GOOD = 0, 1, 2
# How often a rule is expected to vote bad, abstain and vote good on a bad and on a good
# document, given as so many documents of each class; a larger corpus outgrows them.
EXPECTED = ((0.3, 0.2, 0.5), (0.001, 0.1, 0.899))
EXPECTED_DOCS = 20.0
# What makes the classes differ: a rule dislikes at most this share of the good documents.
# Without it one kind of junk becomes the bad class and the documents of other kinds pass
# as good ones that some rule happens to dislike.
MAX_GOOD_DISLIKED = 0.001


@dataclass(frozen=True)
class Test:
    """A statistic's range on good documents, and the wider one outside which it is bad."""

    statistic: str
    good: tuple[float, float]
    fair: tuple[float, float]


@dataclass(frozen=True)
class Rule:
    """Votes bad if any test is bad, good if all are good, and abstains otherwise.

    Tests that tend to fail together belong to one rule: EM takes rules to be independent.
    """

    name: str
    tests: tuple[Test, ...]

    def votes(self, ratios: np.ndarray) -> np.ndarray:
        votes = np.full(len(ratios), GOOD, np.int64)
        for test in self.tests:
            values = ratios[:, RATIOS.index(test.statistic)]
            votes[(votes == GOOD) & ((values < test.good[0]) | (values > test.good[1]))] = ABSTAIN
            votes[(values < test.fair[0]) | (values > test.fair[1])] = BAD
        return votes


INF = float("inf")
RULES = (
    Rule("length", (Test("log_words", (np.log1p(50), INF), (np.log1p(MIN_WORDS), INF)),)),
    Rule("word shape", (Test("mean_word", (3.5, 9.0), (2.5, 15.0)), Test("control_share", (0, 0), (0, 0.01)))),
    Rule("symbols", (Test("symbols_a_word", (0.0, 0.02), (0.0, 0.2)), Test("punct_share", (0.0, 0.1), (0.0, 0.4)))),
    Rule("shouting", (Test("bangs_a_word", (0.0, 0.1), (0.0, 0.5)), Test("upper_share", (0.0, 0.2), (0.0, 0.5)))),
    Rule(
        "repetition",
        (
            Test("echo_share", (0.0, 0.05), (0.0, 0.2)),
            Test("dup_line_share", (0.0, 0.2), (0.0, 0.5)),
            Test("repeat_share", (0.0, 0.15), (0.0, 0.3)),
            Test("top_word_share", (0.0, 0.15), (0.0, 0.35)),
            Test("word_entropy", (0.7, 1.0), (0.5, 1.0)),
        ),
    ),
)


def vote_patterns(ratios: np.ndarray, rules: tuple[Rule, ...] = RULES) -> np.ndarray:
    """One number per document: its votes as base-three digits, first rule lowest."""
    code = np.zeros(len(ratios), np.int64)
    for i, rule in enumerate(rules):
        code += 3**i * rule.votes(ratios)
    return code


def posteriors(patterns: np.ndarray, counts: np.ndarray, rules: int = len(RULES), rounds: int = 100) -> np.ndarray:
    """Probability that a document with each pattern is good.

    The first guess takes a document with a bad vote for bad. How every rule votes on each
    class is estimated from the documents and EXPECTED_DOCS expected ones, under the
    one constraint of MAX_GOOD_DISLIKED.
    """
    if not len(patterns):
        return np.zeros(0)
    votes = patterns[:, None] // 3 ** np.arange(rules) % 3
    outcome = np.eye(3)[votes]
    good = np.where((votes == BAD).any(axis=1), 0.1, 0.95)
    for _ in range(rounds):
        mass = np.stack([counts * (1 - good), counts * good])
        prior = (mass.sum(axis=1) + 1) / (counts.sum() + 2)
        chance = np.einsum("cp,prv->crv", mass, outcome)
        chance += EXPECTED_DOCS * np.array(EXPECTED)[:, None, :]
        chance /= chance.sum(axis=2, keepdims=True)
        over = chance[1, :, BAD] > MAX_GOOD_DISLIKED
        rest = chance[1, over, BAD + 1 :]
        chance[1, over, BAD + 1 :] = rest * ((1 - MAX_GOOD_DISLIKED) / rest.sum(axis=1))[:, None]
        chance[1, over, BAD] = MAX_GOOD_DISLIKED
        logs = np.einsum("prv,crv->pc", outcome, np.log(chance)) + np.log(prior)
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        if np.abs(new - good).max() < 1e-9:
            return new
        good = new
    return good


_COUNTS = [*BASE, "pattern"]


def _measured(texts: pa.Array) -> pa.Array:
    """Base counts and vote pattern of each text."""
    found = [statistics(t.as_py()) for t in texts]
    base = np.array([b for b, _ in found], np.int64).reshape(len(found), len(BASE))
    ratios = np.array([r for _, r in found]).reshape(len(found), len(RATIOS))
    columns = [pa.array(c) for c in base.T] + [pa.array(vote_patterns(ratios))]
    return pa.StructArray.from_arrays(columns, _COUNTS)


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with a struct column ``_rules``: base counts, ``posterior``, ``kept``.

    Also holds ``base_failed``: fewer than MIN_WORDS words, or more than
    MAX_REPEAT_PERCENT of the words in repeated windows. A null or empty text has no word
    and fails. Rows are judged one by one, so repeated rows, null ids and any other
    columns pass through; an input column ``_rules`` is replaced. An empty table gives an
    empty result.
    """
    docs = docs.drop("_rules")
    keep = docs.columns if keep is None else keep
    # Only texts go to Python and only counts come back; the other columns stay behind.
    measure = F.arrow_udf(_measured, StructType([StructField(n, LongType()) for n in _COUNTS]))
    # The row travels as one column, so its names meet none of those in use here.
    measured = materialise(
        docs.select(F.struct(*keep).alias("row"), measure(F.col(text).cast("string")).alias("found")), "rules"
    )
    counted = measured.groupBy(F.col("found.pattern").alias("pattern")).count().toPandas()
    patterns = counted["pattern"].to_numpy(np.int64)
    good = posteriors(patterns, counted["count"].to_numpy(float))
    known = docs.sparkSession.createDataFrame(
        list(zip(patterns.tolist(), good.tolist())), "pattern long, posterior double"
    )
    failed = (F.col("found.n_words") < MIN_WORDS) | (
        100 * F.col("found.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("found.n_words")
    )
    judged = measured.join(F.broadcast(known), F.col("found.pattern") == F.col("pattern"), "left")
    return judged.select(
        "row",
        F.struct(
            *[F.col(f"found.{n}") for n in BASE],
            failed.alias("base_failed"),
            (~failed & (F.col("posterior") >= KEEP_AT)).alias("kept"),
            "posterior",
        ).alias("_rules"),
    ).select("row.*", "_rules")
