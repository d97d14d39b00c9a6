import hashlib
import random
import re

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from usagepulse.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n // 10 + n % 10
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def slow_base(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text or "")
        if valid(kind, m[0])
    ]


def check(docs):
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    wanted = []
    for doc_id, text in texts:
        base = slow_base(text)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        counts = [sum(k == kind for k, *_ in base) for kind in PATTERNS]
        wanted.append((doc_id, *counts, digest))
    got = [tuple(r)[:6] for r in pii.report(docs).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_documents_match_brute_force(spark):
    check(spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet"))


def test_random_strings_match_brute_force(spark):
    rnd = random.Random(1)
    pieces = ["4111 1111 1111 1111", "1.2.3.4", "a@b.c", "+1 (988) 555-2485", "300.1.1.1", "0001.02.3.255",
              "a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "x@y", "+12345678901234567890", "\U0001f600", "é", "", " ", ".", "-", "@"]
    alphabet = "0123456789.@-+% ab_()é\U0001f600"
    rows = [(i, "".join(rnd.choices(alphabet, k=rnd.randint(0, 60)))) for i in range(1500)]
    rows += [(5000 + i, "".join(rnd.choices(pieces, k=rnd.randint(0, 8)))) for i in range(1500)]
    rows += [(9000, "1" * 3000), (9001, "a" * 3000), (9002, "1." * 2000), (9003, "a." * 2000 + "@")]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_awkward_rows(awkward, no_rows):
    check(awkward)
    assert pii.report(no_rows).count() == 0
    assert pii.sanitise(awkward).columns == awkward.columns
    assert sorted(map(repr, pii.sanitise(awkward).collect())) == sorted(map(repr, awkward.collect()))


def people(copies=1):
    """One name stands by one address in many contexts; common words stand by all."""
    rows = []
    for i in range(400):
        rows.append(f"some plain words number n{'abcdefghij'[i % 10] * (i + 2)} about the garden and the house")
    for i in range(6):
        rows += [f"the {'abcdef'[i] * 7} letter of Zanthippe went to z.pippe@mail.example today {'abcdef'[i] * 9}"] * copies
        for other in ("one", "body"):
            rows += [f"the other {'abcdef'[i] * 5} letter went to some{other}{i}@mail.example"] * copies
    rows.append("Later zanthippe wrote without any address.")
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("copies", [1, 5])
def test_a_term_that_reveals_an_address_is_found_everywhere(spark, copies):
    docs = spark.createDataFrame(people(copies), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.report(docs).collect()}
    for doc_id, text in people(copies):
        terms = {m.span() for m in re.finditer("(?i)zanthippe", text)}
        spans = [s.split(":") for s in rows[doc_id].spans.split(",") if s]
        found = {(int(a), int(b)) for k, a, b in spans if k == "term"}
        assert terms <= found
        assert "letter" not in {text[a:b] for a, b in found}
        if "anthippe" not in text:
            assert not found
    clean = [r.text for r in pii.sanitise(docs).collect()]
    assert not any("anthippe" in t.lower() or "@" in t for t in clean)
    assert sum("[EMAIL]" in t for t in clean) == 18 * copies


def test_copies_of_one_text_reveal_nothing(spark):
    rows = [(i, "the wanderer Xarquon has x@mail.example as address") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.spans for r in pii.report(docs).collect()} == {"email:25:39"}


def test_overlapping_spans_are_replaced_as_one(spark):
    docs = spark.createDataFrame([(1, "call +4111111111111111 é x@y.z 1.2.3.4 end")], "doc_id long, text string")
    assert pii.sanitise(docs).first().text == "call +[CARD] é [EMAIL] [IP] end"


def test_terms_far_from_an_address_and_with_digits_are_found(spark):
    words = [f"{a}{b}" for a in ("gar", "wan", "blo", "tre") for b in ("den", "der", "mel", "ish", "ow")]
    rnd = random.Random(3)
    rows = []
    for i in range(200):
        rows.append(" ".join(rnd.choices(words, k=60)))
        if i % 25 == 0:
            far = " ".join(rnd.choices(words, k=60))
            near = " ".join(rnd.choices(words, k=30))
            rows.append(f"Quillon or jdoe42 {far} {near} at q@mail.example {near}")
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    clean = [r.text for r in pii.sanitise(docs).collect()]
    assert sum("[EMAIL]" in t for t in clean) == 8
    assert not any("Quillon" in t or "jdoe42" in t for t in clean)
    assert any("garden" in t for t in clean)


def test_copies_of_a_text_without_the_entity_count_once(spark):
    rows = [f"plain words number n{'abcdefghij'[i % 10] * (i + 2)} about gardens" for i in range(200)]
    rows += [f"{c * 5} Quillon {c * 7} at q@mail.example {c * 9}" for c in "abcdefghij"]
    rows += ["Quillon wrote without any address"] * 100
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert not any("Quillon" in r.text for r in pii.sanitise(docs).collect())


@pytest.mark.parametrize("count", [0, 1, pii.MATCH_BLOCK, pii.MATCH_BLOCK + 1, 100_000])
def test_many_matches_in_one_text(spark, count):
    """Placing them takes time in proportion: a log file of 100,000 addresses is one text."""
    text = "é " + " - ".join(f"10.{n % 250}.0.{n % 7}" for n in range(count))
    docs = spark.createDataFrame([(text,)], "text string")
    found = docs.select(pii._base(F.col("text"), "ip").alias("found")).first().found
    assert [("ip", m.start, m.end) for m in found] == [s for s in slow_base(text) if s[0] == "ip"]
    assert [m.value for m in found] == [text[m.start : m.end] for m in found]
