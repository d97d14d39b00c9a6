from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from usagepulse.llm import mixing
from usagepulse.llm.common import file_position
from usagepulse.llm.queries import llm_queries


def targets(sizes, weights, budget=1.5, limit=2.0):
    """Targets by resharing the excess until no share is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = budget * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        level = (total - sum(stopped.values())) / sum(weight[s] for s in rest) if rest else 0
        over = {s: limit * sizes[s] for s in rest if level * weight[s] > limit * sizes[s]}
        if not over:
            return stopped | {s: level * weight[s] for s in rest}
        stopped |= over


SIZES = [
    {"a": 10, "b": 1000, "c": 1000, None: 50},
    {"a": 5000, "b": 10, "c": 10, "d": 10},
    {"only": 77},
    {"a": 100, "b": 100, "c": 100},
    {"a": 0, "b": 100, None: 3},
]


@pytest.mark.parametrize("sizes", SIZES)
def test_targets_and_words_taken(spark, sizes):
    rows = [(s, n, 1 if i % 10 else 0) for s, total in sizes.items() for i, n in enumerate(_parts(total))]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, size long, x int")
    wanted = targets(sizes, mixing.WEIGHTS)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs).select("*", "_mix.*").collect():
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(wanted[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        assert len(r.times) == r.copies and all(0 <= t <= 1 for t in r.times)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s, n in taken.items():
        assert abs(n - wanted[s]) <= largest[s] / 2 + 1e-6


def _parts(total):
    parts = [7, 13, 1, 29, 0]
    out, i = [], 0
    while total > 0:
        out.append(min(total, parts[i % 5]))
        total -= out[-1]
        i += 1
    return out or [0]


def test_weights_change_over_time(spark):
    """Of two equal sources the one whose weight falls comes earlier, and times follow the
    integral of the weight."""
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, "falls").otherwise("rises").alias("source"),
        F.lit(10).alias("size"),
    )
    mixed = mixing.mix(docs, weights=(1.0, 1.0), slopes=(-0.5, 0.5), budget=1.0)
    times = mixed.select("source", F.explode("_mix.times").alias("t"))
    early = {r.source: r["count"] for r in times.where("t < 0.5").groupBy("source").count().collect()}
    # Integral of 1 -/+ 0.5 * (2t - 1) up to one half: 0.625 and 0.375.
    assert early["falls"] / 2000 == pytest.approx(0.625, abs=0.01)
    assert early["rises"] / 2000 == pytest.approx(0.375, abs=0.01)


@pytest.mark.parametrize("slope", [-0.9, 0.0, 0.7])
def test_time_inverts_the_integral(spark, slope):
    row = spark.range(11).select((F.col("id") / 10).alias("t"))
    demand = F.col("t") + F.lit(slope) * (F.col("t") * F.col("t") - F.col("t"))
    for r in row.select("t", mixing.time_of(demand, F.lit(slope)).alias("back")).collect():
        assert r.back == pytest.approx(r.t, abs=1e-9)


def test_awkward_rows_and_reruns(awkward, no_rows):
    sized = awkward.withColumn("size", mixing.word_count(F.col("text")))
    once = sorted(map(repr, mixing.mix(sized).collect()))
    assert once == sorted(map(repr, mixing.mix(sized.repartition(5)).collect()))
    assert len(once) == awkward.count()
    ordered = mixing.training_order(mixing.mix(sized))
    assert ordered.columns == sized.columns
    assert mixing.mix(no_rows.withColumn("size", F.lit(1))).count() == 0


def test_a_hot_source_is_spread(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit(3).alias("size"))
    keyed = mixing.mix(docs).groupBy(F.substring(F.md5(F.col("doc_id").cast("string")), 1, mixing.HEX)).count()
    assert keyed.agg(F.max("count")).first()[0] < 20


def _documents(spark, root):
    """Documents of three sources, one null, with null ids and texts and with repeated rows."""
    rows = [
        (None if i % 17 == 0 else i // 2 if i % 19 == 0 else i, None if i % 23 == 0 else "w " * (i % 7), [None, "a", "b"][i % 3])
        for i in range(600)
    ]
    docs = spark.createDataFrame(rows + rows[:40], "doc_id long, text string, source string")
    docs.write.parquet(f"{root}/documents.parquet")
    return docs


@pytest.fixture
def written(monkeypatch):
    """What the operator wrote, by name."""
    frames, keep = {}, mixing.materialise

    def materialise(df, name):
        frames[name] = keep(df, name)
        return frames[name]

    monkeypatch.setattr(mixing, "materialise", materialise)
    return frames


def test_the_query_writes_the_mix_in_training_order(spark, tmp_path, written):
    _documents(spark, tmp_path)
    rows = llm_queries()["op4_source_mixing"](spark, str(tmp_path)).collect()
    copies = written["ordered"].select("row.*", "time", file_position(written["ordered"]).alias("place")).collect()
    copies.sort(key=lambda r: r.place)
    assert [r.time for r in copies] == sorted(r.time for r in copies)
    assert len(copies) == len({r.place for r in copies}) == sum(r.copies for r in rows)
    assert sum(r.size for r in copies) == sum(r.taken for r in rows)
    first = [r.source for r in copies[:60]]
    assert set(first) == {None, "a", "b"}
    # The first source's weight falls, the last one's rises.
    half = len(copies) // 2
    assert sum(r.source == "a" for r in copies[:half]) > sum(r.source == "a" for r in copies[half:])
    assert sum(r.source is None for r in copies[:half]) < sum(r.source is None for r in copies[half:])


def test_the_query_reads_the_written_mix_back(spark, tmp_path, monkeypatch):
    """Copies that the ordered mix lacks are not in the result."""
    _documents(spark, tmp_path)
    query, order = llm_queries()["op4_source_mixing"], mixing.training_order
    before = {r.doc_id: r for r in query(spark, str(tmp_path)).collect()}
    lost = F.col("row.doc_id") == 103
    monkeypatch.setattr(mixing, "training_order", lambda *a, **k: order(*a, **k).where(~F.coalesce(lost, F.lit(False))))
    after = {r.doc_id: r for r in query(spark, str(tmp_path)).collect()}
    assert before[103].copies > 0 and before[103].size > 0
    assert (after[103].copies, after[103].taken, after[103].first_time) == (0, 0, None)
    assert after[104] == before[104]


def test_what_is_read_back_is_what_was_planned(spark, tmp_path, awkward, no_rows):
    size = mixing.word_count(F.col("text"))
    for docs in (_documents(spark, tmp_path), awkward.withColumn("number", F.lit("kept")), no_rows):
        planned = mixing.mix(docs, size=size)
        back = mixing.read_back(planned, size)
        assert back.columns == planned.columns
        assert sorted(map(repr, back.collect())) == sorted(map(repr, planned.collect()))


def test_ties_and_times_of_the_training_order(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).alias("size"))
    # All copies at two times.
    planned = mixing.mix(docs).withColumn("_mix", F.col("_mix").withField("times", F.array(F.lit(0.5), F.lit(0.25))))
    ordered = mixing.training_order(planned.repartition(4), time="when", ties=["doc_id"])
    assert ordered.columns == ["doc_id", "source", "size", "when"]
    assert [(r.when, r.doc_id) for r in ordered.collect()] == [(t, i) for t in (0.25, 0.5) for i in range(40)]
