import zlib
from itertools import combinations

import numpy as np
import pytest
from conftest import TESTDATA

from usagepulse.llm import toxicity


def slow_map(word):
    """Weighted four-character subsequences of a word with its boundaries, at unit length."""
    text = f"^{word}$"
    found = {}
    for at in combinations(range(len(text)), 4):
        if at[3] - at[0] < toxicity.SPAN:
            key = "".join(text[i] for i in at)
            found[key] = found.get(key, 0) + toxicity.DECAY ** (at[3] - at[0] - 3)
    length = sum(v * v for v in found.values()) ** 0.5
    return {k: v / length for k, v in found.items()}


def kernel(a, b):
    a, b = slow_map(a), slow_map(b)
    return sum(v * b.get(k, 0) for k, v in a.items())


def test_subsequences_give_the_kernel():
    words = ["worthless", "worth.less", "aaaaaa", "x", "é\U0001f600é", "lesswort"]
    keys, weights, owners = toxicity.subsequences(words)
    maps = [dict(zip(keys[owners == i].tolist(), weights[owners == i])) for i in range(len(words))]
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            dot = sum(v * maps[j].get(k, 0) for k, v in maps[i].items())
            assert dot == pytest.approx(kernel(a, b) if min(len(a), len(b)) > 1 else 0, abs=1e-9)
    assert kernel("worthless", "worthleess") > kernel("worthless", "wordless") > kernel("worthless", "garden")


def test_units():
    assert toxicity.units("You, s c u m! Sc.um id10t -- ") == {"you", "s", "c", "u", "m", "scum", "sc.um", "id10t"}
    assert toxicity.units("") == toxicity.units(" \n .") == set()
    assert max(map(len, toxicity.units("x" * 1000))) == toxicity.LONG


def test_counts_that_stand_out():
    toxic, clean = np.array([1.0, 2, 30, 3]), np.array([0.0, 0, 1, 300])
    words = np.array([5000.0, 300, 2, 10])
    assert toxicity.telling(toxic, clean, words, 0.1).tolist() == [False, False, True, False]
    assert not toxicity.telling(toxic[:0], clean[:0], words[:0], 0.1).size


def test_folded_machine_tolerates_spoilt_words():
    clean = [(f"{a}{b}{c}", 5) for a in ("gar", "wan", "blo") for b in ("den", "der", "mel") for c in ("ing", "ly", "", "ous")]
    machine = toxicity.fit([("worthless", 50), ("pathetic", 40)], clean)
    bad = ["worthless", "worthlless", "wor-thless", "pathetic", "pathetiic"]
    assert machine.decide(bad).min() > machine.decide([w for w, _ in clean]).max()
    texts = ["A garden, p.a.t.h.e.t.i.c!", "You are w o r t h l e s s .", "A garden in bloom.", None, ""]
    found = toxicity.decisions(machine, texts)
    assert found[:2].min() > 0 > found[2:].max() and found[3] == found[4] == toxicity.NOTHING


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{TESTDATA}/sf0.1/labels.parquet")
    got = toxicity.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    unseen = [r for r in got if r.held_out]
    toxic = [r for r in unseen if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.88 * len(toxic)
    clean = [r for r in unseen if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_awkward_rows(spark, awkward, no_rows):
    labels = spark.createDataFrame(
        [(1, 1), (2, 1), (2, 0), (6, None), (None, 1), (8, 0), (9, 0)], "doc_id long, toxic int"
    )
    got = toxicity.classify(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)
    assert toxicity.classify(no_rows, labels).count() == 0
    assert toxicity.classify(awkward, labels.where("doc_id > 99")).count() == awkward.count()


def test_copies_do_not_raise_the_share_of_toxic_texts(spark, monkeypatch):
    texts = [f"a garden number n{'abcdefghij'[i % 10] * (i + 2)}" for i in range(90)]
    texts += ["you are worthless"] * 90
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 90)) for i in range(180)] + [(90, 0)], "doc_id long, toxic int")
    seen, telling = [], toxicity.telling
    monkeypatch.setattr(toxicity, "telling", lambda t, c, w, base: seen.append(base) or telling(t, c, w, base))
    toxicity.train(docs, labels)
    assert 0 < seen[0] < 0.05
