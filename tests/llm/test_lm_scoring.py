import math
from collections import Counter

import numpy as np
import pytest
from conftest import TESTDATA

from usagepulse.llm import lm_scoring


def slow_losses(texts, target, scored):
    """Interpolated n-gram models from plain dictionaries."""
    pad = "\0" * (lm_scoring.ORDER - 1)
    all_counts = [Counter() for _ in range(2)]
    for text, good in zip(texts, target):
        padded = pad + (text or "")
        for end in range(len(pad), len(padded)):
            for n in range(1, lm_scoring.ORDER + 1):
                gram = padded[end - n + 1 : end + 1]
                all_counts[1][gram] += 1
                if good:
                    all_counts[0][gram] += 1
    size = len({g for c in all_counts for g in c if len(g) == 1})
    out = []
    for counts in all_counts:
        # A context counts as an n-gram of its own, which pads never are.
        total = sum(v for g, v in counts.items() if len(g) == 1)
        loss = 0.0
        padded = pad + scored
        for end in range(len(pad), len(padded)):
            chance = 1 / size
            for n in range(1, lm_scoring.ORDER + 1):
                context = padded[end - n + 1 : end]
                known = total if n == 1 else counts[context]
                chance = (counts[padded[end - n + 1 : end + 1]] + lm_scoring.PSEUDO * chance) / (known + lm_scoring.PSEUDO)
            loss -= math.log2(min(chance, 1))
        out.append(loss / max(1, len(scored)))
    return out


TEXTS = ["the cat sat on the mat", "the dog sat", "### $$$ ###", None, "", "é\U0001f600 the", "the cat sat on the mat"]
GOOD = [True, True, False, True, False, False, False]


def test_losses_match_plain_dictionaries(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(i,) for i, g in enumerate(GOOD) if g] * 2, "doc_id long")
    rows = {r.doc_id: r for r in lm_scoring.score(docs, target).collect()}
    for i, text in enumerate(TEXTS):
        wanted = slow_losses(TEXTS, GOOD, text or "")
        assert rows[i].n_tokens == len(text or "")
        assert (rows[i].target_loss, rows[i].background_loss) == pytest.approx(wanted, rel=1e-4, abs=1e-6)
        assert rows[i].score == pytest.approx(wanted[0] - wanted[1], rel=1e-3, abs=1e-4)


def test_chunks_and_blocks_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(["abc" * 50, None, "x", "", "long text " * 99])), "doc_id long, text string")
    target = docs.where("doc_id = 4").select("doc_id")
    whole = {r.doc_id: r for r in lm_scoring.score(docs, target).collect()}
    monkeypatch.setattr(lm_scoring, "BLOCK", 10)
    cut = {r.doc_id: r for r in lm_scoring.score(docs, target).collect()}
    assert whole.keys() == cut.keys()
    for i, row in whole.items():
        assert cut[i].n_tokens == row.n_tokens
        assert cut[i].score == pytest.approx(row.score)


def test_good_documents_score_lower(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{TESTDATA}/sf0.01/labels.parquet")
    rows = lm_scoring.score(docs, labels.where("quality = 1")).join(labels, "doc_id").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.median(bad) > np.quantile(good, 0.99)


def test_awkward_rows(awkward, no_rows):
    target = awkward.where("doc_id < 3").select("doc_id")
    rows = lm_scoring.score(awkward, target).collect()
    assert len(rows) == awkward.count()
    assert all(math.isfinite(r.score) for r in rows)
    assert lm_scoring.score(no_rows, target).count() == 0
    assert lm_scoring.score(awkward, target.where("doc_id > 9")).count() == awkward.count()


def test_many_distinct_ngrams_keep_their_own_counts(spark):
    rnd = np.random.default_rng(5)
    texts = ["".join(chr(97 + c) for c in rnd.integers(0, 60, 8000)) for _ in range(100)]
    good = [i % 3 == 0 for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    target = docs.where("doc_id % 3 = 0").select("doc_id")
    rows = {r.doc_id: r for r in lm_scoring.score(docs, target).collect()}
    for i in (0, 1):
        wanted = slow_losses(texts, good, texts[i])
        assert (rows[i].target_loss, rows[i].background_loss) == pytest.approx(wanted, rel=1e-6)
