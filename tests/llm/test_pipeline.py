"""The pipeline's stages, each on what its predecessor kept."""

from collections import Counter

import public_tokenizers
import pytest
from conftest import TESTDATA
from .test_pii import slow_base
from .test_quality import slow_base as quality_base
from .test_simhash import slow_fingerprint, slow_groups
from tokenizers import Tokenizer

import corpus_pipeline
from pyspark.sql import functions as F
from usagepulse.llm import mixing
from usagepulse.llm.common import file_position, materialise

ROOT = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], ROOT), name))
    return out


def test_columns(steps):
    for kept in steps[:-1]:
        assert kept.dtypes == steps[0].dtypes


def test_rules_drop_what_fails_and_keep_clean_documents(spark, steps):
    before = {r.doc_id: r.text for r in steps[0].collect()}
    after = {r.doc_id: r.text for r in steps[1].collect()}
    assert after.items() <= before.items()
    passed = {}
    for i, text in before.items():
        words, _, _, _, repeats = quality_base(text)
        passed[i] = words >= 20 and 100 * repeats <= 30 * words
    assert all(passed[i] for i in after)
    labels = spark.read.parquet(f"{ROOT}/labels.parquet").where("quality = 1").collect()
    assert all(r.doc_id in after for r in labels if passed[r.doc_id])


def test_one_document_of_each_group_stays(steps):
    rows = sorted((r.doc_id, r.text) for r in steps[1].collect())
    tops = slow_groups([slow_fingerprint(t) for _, t in rows])
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted({rows[t][0] for t in tops})


def test_personal_data_goes_and_the_rest_stays(steps):
    before = {r.doc_id: r.text for r in steps[2].collect()}
    after = {r.doc_id: r for r in steps[3].collect()}
    assert before.keys() == after.keys()
    touched = 0
    for i, text in before.items():
        spans = slow_base(text)
        touched += bool(spans)
        assert not slow_base(after[i].text)
        assert after[i].n_chars == len(after[i].text)
        if not spans:
            assert after[i].text == text
    assert touched


def test_mix_takes_whole_copies_near_its_targets(steps):
    sizes = {r.doc_id: (r.source, len(r.text.split()), r.text) for r in steps[3].collect()}
    copies = Counter(r.doc_id for r in steps[4].collect())
    assert max(copies.values()) <= 2
    assert all(r.text == sizes[r.doc_id][2] for r in steps[4].collect())
    total = sum(n for _, n, _ in sizes.values())
    assert abs(sum(sizes[i][1] * n for i, n in copies.items()) - 1.5 * total) < 0.1 * total


def test_everything_is_packed(steps):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in steps[4].collect())
    rows = steps[5].collect()
    assert sum(r.length for r in rows) == tokens
    assert len({r.sequence_id for r in rows}) <= -(-tokens // 2048) + 1


def test_the_order_of_the_mix_reaches_the_sequences(spark, steps):
    """Positions number the copies in the order in which the mix wrote them."""
    copies = steps[4].select("doc_id", file_position(steps[4]).alias("position")).collect()
    assert len({r.position for r in copies}) == len(copies)
    rows = steps[5].collect()
    assert {(r.doc_id, r.position) for r in rows} == {(r.doc_id, r.position) for r in copies}
    again = mixing.mix(steps[3], size=mixing.word_count(F.col("text")))
    times = {r.doc_id: sorted(r.times) for r in again.select("doc_id", "_mix.times").collect()}
    passed, last = Counter(), 0.0
    for r in sorted(copies, key=lambda r: r.position):
        time = times[r.doc_id][passed[r.doc_id]]
        passed[r.doc_id] += 1
        assert time >= last
        last = time


def test_run_is_the_chain_of_its_stages(spark, steps):
    def summary(df):
        return sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())

    assert summary(corpus_pipeline.run(spark, ROOT)) == summary(steps[-1])


def test_awkward_rows_and_no_rows(spark, steps, awkward, no_rows):
    names = steps[0].columns
    for docs in (awkward.select(*names), no_rows.select(*names)):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, ROOT), "stage")
