import hashlib

import numpy as np
import pytest
from conftest import TESTDATA

from usagepulse.llm import fingerprints


def check(rows, got):
    """Ids and edited texts by hand; fingerprints by the operator's own signature."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    wanted = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        own, other, following = map(fingerprints.signature, (text, changed, after))
        wanted.append(
            (
                doc_id,
                len(text),
                hashlib.sha256(changed.encode()).hexdigest(),
                fingerprints.text_of(own),
                fingerprints.text_of(other),
                float((own == other).mean()),
                float((own == following).mean()),
            )
        )
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("rows", [1024, 7])
def test_documents_match_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", rows)
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").repartition(5)
    check([(r.doc_id, r.text) for r in docs.collect()], fingerprints.compare_with_next(docs).collect())


@pytest.mark.parametrize("rows", [1024, 2])
def test_awkward_rows(awkward, no_rows, monkeypatch, rows):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", rows)
    known = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    check(known, fingerprints.compare_with_next(awkward).collect())
    assert fingerprints.compare_with_next(no_rows).count() == 0
    alone = awkward.where("doc_id = 6")
    check([(6, alone.first().text)], fingerprints.compare_with_next(alone).collect())


def slow_signature(text, seed_free=fingerprints):
    """Occurrence-numbered k-mers picked one hash function at a time."""
    k = seed_free.K
    grams = [text[i : i + k] for i in range(max(1, len(text) - k + 1))]
    return [(g, grams[:i].count(g)) for i, g in enumerate(grams)]


def test_order_and_repeats_count():
    """Same k-mers in another order, or more often, make another fingerprint."""
    sig = fingerprints.signature
    a, b = "the quick brown fox jumps ", "over lazy dogs and cats at night "
    same = fingerprints.likeness(sig(a * 3 + b * 3), sig(a * 3 + b * 3))
    swapped = fingerprints.likeness(sig(a * 3 + b * 3), sig(b * 3 + a * 3))
    assert same == 1.0 and swapped < 0.9
    assert fingerprints.likeness(sig("ab" * 50), sig("ab" * 80)) < 1.0
    assert len({n for n in slow_signature("aaaaaaaa")}) == 3


def test_fewer_edits_are_nearer():
    rnd = np.random.default_rng(4)
    text = "".join(chr(97 + c) for c in rnd.integers(0, 26, 3000))

    def changed(n):
        chars = list(text)
        for i in rnd.integers(0, len(chars), n):
            chars[i] = "_"
        return "".join(chars)

    near = [
        np.mean([fingerprints.likeness(fingerprints.signature(text), fingerprints.signature(changed(n))) for _ in range(10)])
        for n in (3, 40, 400)
    ]
    assert near[0] > near[1] > near[2] and near[0] > 0.8


@pytest.mark.parametrize("text", [None, "", "a", "ab" * 2, "é\U0001f600" * 9, "a" * 100])
def test_short_texts(text):
    assert fingerprints.signature(text).shape == (fingerprints.SLOTS,)
    assert fingerprints.likeness(fingerprints.signature(text), fingerprints.signature(text or "")) == 1.0


def test_half_edited_texts_are_nearer_than_unrelated_ones(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, "".join(chr(97 + c) for c in rnd.integers(0, 26, 800))) for i in range(400)]
    got = fingerprints.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 400
    assert sum(r.near_edited > r.near_next for r in got) >= 0.99 * len(got)


def test_blocks_of_slots_change_nothing(monkeypatch):
    text = "the quick brown fox jumps over lazy dogs " * 9
    whole = fingerprints.signature(text)
    monkeypatch.setattr(fingerprints, "RANKS", 1000)
    assert (fingerprints.signature(text) == whole).all()
