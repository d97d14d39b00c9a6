"""The divergence audit against a plain computation of every pair and term."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from usagepulse.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def plain(rows, min_docs=10, top=10):
    made = []
    for lang in {r[2] or "" for r in rows}:
        own = [r for r in rows if (r[2] or "") == lang]
        docs = Counter(w for r in own for w in set(words(r[1])))
        kept = sorted(w for w in docs if docs[w] >= min_docs)
        counts = {s: Counter() for s in {r[3] or "" for r in own}}
        for r in own:
            counts[r[3] or ""].update(w for w in words(r[1]) if docs[w] >= min_docs)
        counts = {s: {w: c.get(w, 0) for w in kept} for s, c in counts.items()}

        def shares(c):
            below = sum(c.values()) + 2 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 2) // below for w in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        share = {s: shares(c) for s, c in counts.items()}
        whole = shares({w: sum(c[w] for c in counts.values()) for w in kept})
        for s in counts:
            pairs = [(o, sum(f(share[s][w], share[o][w]) for w in kept)) for o in counts if o != s]
            terms = [(w, f(share[s][w], whole[w])) for w in kept if counts[s][w] and share[s][w] > whole[w]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                made += [(lang, s, part, item, value, n + 1) for n, (item, value) in enumerate(items)]
    return sorted(made)


def check(spark, rows, **options):
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA), **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == plain(rows, **options)


def generated(n, sources, seed, vocabulary=60):
    dice = random.Random(seed)
    stems = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é"[dice.randrange(1):] for i in range(vocabulary)]
    rows = []
    for i in range(n):
        source = dice.choice(sources)
        own = dice.sample(stems, 8) if source is None else stems[len(source) :: 2]
        text = dice.choice([" ", "-", "\n", "1"]).join(dice.choice(own).title() for _ in range(dice.randrange(25)))
        rows.append((i, text, dice.choice(["en", "de", None]), source))
    return rows


def test_many_sources_hot_one_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 40)
    check(spark, generated(900, ["a"] * 8 + ["bb", "ccc", "Z", "é", None, *[f"s{i}" for i in range(12)]], 1))


def test_other_bounds(spark):
    check(spark, generated(200, ["a", "bb", "ccc"], 2), min_docs=3, top=2)


def test_nothing_is_kept(spark):
    check(spark, generated(30, ["a", "bb"], 3), min_docs=1000)


def test_nulls_empty_texts_repeats_and_ties(spark):
    rows = [(None, None, None, None), (1, "", "en", "a"), (2, "12 34 [] {}", "en", "b")]
    rows += [(3, "same words here", "en", "c")] * 12 + [(4, "tie eit", "en", "a")] * 11 + [(5, "x", "", "")]
    check(spark, rows)


def test_long_texts_and_terms_across_pieces(spark, monkeypatch):
    long = "word é WORD\U0001f600x " * 60_000 + "q" * 1_500_000 + " end"
    check(spark, [(n, long, "en", f"s{n % 2}") for n in range(4)] + [(9, "word end", "en", "s0")] * 10, min_docs=2)


def test_pieces_cut_no_term(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 3)
    text = "Abé\U0001f600cd, [x] Zz9y \x7fe\x80 ab"
    assert divergence.terms_of(text.encode()) == Counter(w.encode() for w in words(text))


def test_tasks_pass_on_what_they_hold(spark, monkeypatch):
    batches = [divergence.pa.RecordBatch.from_pylist([{"l": "en", "s": "a", "t": b"one two"}] * 3)] * 4
    monkeypatch.setattr(divergence, "HELD", 1)
    rows = [r for b in divergence._count(iter(batches)) for r in b.to_pylist()]
    assert len(rows) == 24 and sum(r["docs"] for r in rows if r["term"] == b"one") == 12


def test_large_counts_stay_exact(spark):
    one = spark.createDataFrame([(10**13, 3 * 10**13, 10**8)], "n long, total long, kept long")
    found = one.select(divergence.share(F.col("n")).alias("p")).first().p
    assert found == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 2 * 10**8)


def test_empty_table_and_clashing_names(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(none).count() == 0
    rows = generated(150, ["a", "bb"], 5)
    names = ["term", "g", "h", "p", "q", "zero", "kept", "total", "block", "blocks", "value", "rank", "n", "docs", "item", "part"]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(n) for n in names])
    assert sorted(map(tuple, divergence.audit(docs).collect())) == plain(rows)


@pytest.mark.parametrize("most", [5, 1 << 20])
def test_rows_of_the_index_in_parts(most, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", most)
    dice = random.Random(6)
    rows = [(g, f"t{t}".encode(), dice.randrange(1, 10**9), 7 * g) for g in range(1, 9) for t in range(30) if dice.random() < 0.6]
    dice.shuffle(rows)
    table = divergence.pa.table(list(zip(*rows)), ["g", "term", "p", "zero"])
    found = divergence._both((divergence.pa.scalar("en"), divergence.pa.scalar(0)), table).to_pylist()

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    share = {(g, t): (p, z) for g, t, p, z in rows}
    want = Counter()
    for (g, t), (p, gz) in share.items():
        for h in range(g + 1, 9):
            if (h, t) in share:
                q, hz = share[h, t]
                want[g, h] += f(p, q) - f(p, hz) - f(gz, q) + f(gz, hz)
    assert {(r["g"], r["h"]): r["value"] for r in found} == dict(want)
