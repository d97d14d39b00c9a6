import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from usagepulse.llm import packing


def fewest(lengths, capacity):
    """Fewest bins by trying all subsets that hold the first piece left."""
    lengths = tuple(sorted(lengths, reverse=True))
    if not lengths:
        return 0
    first, rest = lengths[0], lengths[1:]
    best = len(lengths)
    for n in range(len(rest) + 1):
        for with_it in combinations(range(len(rest)), n):
            if first + sum(rest[i] for i in with_it) <= capacity:
                left = [v for i, v in enumerate(rest) if i not in with_it]
                best = min(best, 1 + fewest(left, capacity))
    return best


@pytest.mark.parametrize("length", [1, 5, 8, 9, 15, 16, 17, 24])
def test_only_the_first_piece_is_shorter(length):
    pieces = packing.cut(length, 8)
    assert [s for s, _ in pieces] == np.cumsum([0, *[n for _, n in pieces]])[:-1].tolist()
    assert sum(n for _, n in pieces) == length
    assert all(n == 8 for _, n in pieces[1:]) and 0 < pieces[0][1] <= 8


@pytest.mark.parametrize("seed", range(20))
def test_bounds_and_packing_against_all_packings(seed):
    rnd = random.Random(seed)
    lengths = np.array([rnd.randint(1, 63) for _ in range(rnd.randint(1, 7))])
    bins, offsets = packing.best_fit(lengths, 64)
    for b in set(bins.tolist()):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offsets[at])]
        assert offsets[at].tolist() == np.cumsum([0, *lengths[at]])[:-1].tolist()
        assert lengths[at].sum() <= 64
    best = fewest(lengths.tolist(), 64)
    assert packing.lower_bound(lengths, 64) <= best <= len(set(bins.tolist()))


def test_bound_beats_the_sum_for_large_pieces():
    assert packing.lower_bound(np.full(10, 1100)) == 10
    assert packing.lower_bound(np.full(9, 700)) == 5


@pytest.mark.parametrize("text", ["", "a  b\n\n c", "é😀 don't 123", "x<|endoftext|>y", "q" * 5000, " \t\n " * 9])
def test_ids_are_those_of_the_tokenizer(text):
    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    assert packing.encoder(None).ids(text) == whole.encode(text, add_special_tokens=False).ids


def check(packed, rows, capacity=2048):
    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    wanted = []
    for doc_id, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, (start, length) in enumerate(packing.cut(len(ids), capacity)):
            crc = zlib.crc32(ids[start : start + length].tobytes())
            wanted.append((doc_id, piece, start, length, crc))
    got = packed.collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(wanted, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *[n for _, n in pieces]])[:-1].tolist()
        assert sum(n for _, n in pieces) <= capacity
    return len(bins), sum(n for *_, n, _ in wanted)


def test_awkward_rows(awkward, no_rows):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    bins, tokens = check(packing.pack(awkward), rows)
    assert bins <= -(-tokens // 2048) + 1
    assert packing.pack(no_rows).count() == 0


def test_gaps_of_many_partitions_close(spark, monkeypatch):
    """Each of many partitions leaves a bin open; the rounds pack their documents again."""
    monkeypatch.setattr(packing, "ITEMS", 25)
    rnd = random.Random(5)
    rows = [(i, " the" * rnd.randint(1, 900)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bins, tokens = check(packing.pack(docs), rows)
    assert bins <= -(-tokens // 2048) + 2


@pytest.mark.parametrize("items", [25, packing.ITEMS])
def test_certificates(spark, monkeypatch, items):
    """The total is that of the result and the bound is no more; one part packs as best-fit does."""
    monkeypatch.setattr(packing, "ITEMS", items)
    rnd = random.Random(6)
    rows = [(i, " the" * rnd.randint(1, 3000)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs).collect()
    used = len({r.sequence_id for r in got})
    lengths = np.array([r.length for r in got])
    (pair,) = {(r.bins, r.bound) for r in got}
    assert pair == (used, packing.lower_bound(lengths[lengths < 2048]) + int((lengths == 2048).sum()))
    assert pair[1] <= used
    if items > len(rows):
        assert used == packing.best_fit(lengths[lengths < 2048])[0].max() + 1 + (lengths == 2048).sum()
    assert all(r.part_bound <= r.part_bins for r in got)


@pytest.mark.parametrize("loose", [0, 16, 2047])
def test_last_rounds_open_bins_with_any_gap(spark, monkeypatch, loose):
    """Even where the first rounds may open few bins or none, the last ones close the gaps."""
    monkeypatch.setattr(packing, "ITEMS", 25)
    rnd = random.Random(5)
    rows = [(i, " the" * rnd.randint(1, 900)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.pack(docs, loose=loose)
    bins, tokens = check(packed, rows)
    assert packed.first().bound <= bins
    if loose:  # without it all bins are opened at once, and small partitions stay uneven
        assert bins <= -(-tokens // 2048) + 2


def test_sequences_follow_positions(spark, monkeypatch):
    """Most sequences hold neighbours only, and copies are told apart."""
    monkeypatch.setattr(packing, "ITEMS", 50)
    rnd = random.Random(8)
    rows = [(i % 500, " the" * rnd.randint(1, 2500), i << 20) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at long").repartition(7)
    packed = packing.pack(docs, position="at")
    bins, tokens = check(packed, [r[:2] for r in rows])
    got = packed.collect()
    assert bins <= 1.02 * got[0].bound  # partitions of 50 neighbours
    assert {(r.doc_id, r.position >> 20) for r in got} == {(i % 500, i) for i in range(1000)}
    assert len({(r.position, r.piece) for r in got}) == len(got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    near = 0
    for pieces in sequences.values():
        places = [r.position for r in pieces]
        assert {r.sequence_position for r in pieces} == {min(places)}
        near += max(places) - min(places) <= 150 << 20
    assert near >= 0.9 * len(sequences)


def test_positions_may_be_missing_or_equal(spark):
    rows = [(1, "a b", None), (1, "a b", None), (2, "c", 5), (3, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at long")
    check(packing.pack(docs, position="at"), [r[:2] for r in rows])
    assert packing.pack(docs.where("false"), position="at").count() == 0


def test_ids_can_be_kept(spark):
    docs = spark.createDataFrame([(1, " the" * 3000)], "doc_id long, text string")
    pieces = packing.pack(docs, with_ids=True).orderBy("piece").collect()
    assert [len(p.ids) for p in pieces] == [953, 2048]
    assert all(zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in pieces)


@pytest.mark.parametrize("blank", [" ", "\n", "\t ", "\u3000"])
@pytest.mark.parametrize("size", [100_000, 1_000_000])
def test_long_runs_of_whitespace_are_encoded(blank, size):
    """The fast encoder runs out of stack in them; beyond a length they go the other way."""
    encode = packing.encoder(None)
    text = "before " + blank * (size // len(blank)) + "after"
    ids = encode.ids(text)
    assert encode._whole.decode(ids, skip_special_tokens=False) == text


def test_a_long_unbroken_word_is_encoded():
    encode = packing.encoder(None)
    assert encode._whole.decode(encode.ids("a" * 1_000_000), skip_special_tokens=False) == "a" * 1_000_000
