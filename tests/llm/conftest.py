import pytest

from usagepulse.llm.common import prepare

# Names that operators use, or have used, for columns of their own.
WORKING = (
    "_row _number _none _source _bucket _order _words _at _first _passes _copies _middle _slope _size _time "
    "_pattern _posterior pattern posterior found _text _key _terms _base _generalised _removed body pii row whole place"
).split()
WORKING = [name for name in WORKING if name != "row"]
AWKWARD = (
    "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id long, "
    "root string, key string, band int, size string, target int, row string, term string, unit string, "
    "piece string, ids string, values string, "
    + ", ".join(f"{name} string" for name in WORKING)
)
LONG = " ".join(f"word{i % 977} and" for i in range(20_000)) + "."


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package(spark):
    prepare(spark)


@pytest.fixture
def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""
    texts = [
        (1, "The same words stand here, again and again, in a row of many words to read."),
        (2, "The same words stand here, again and again, in a row of many words to read."),
        (2, "The same words stand here, again and again, in a row of many words to read."),
        (3, None),
        (None, "A text whose id is missing."),
        (None, None),
        (4, ""),
        (5, " \n\t "),
        (6, LONG),
        (7, "é\U0001f600 one\x1cword \x0b x"),
        (8, "x" * 30_000),
        (9, "word"),
    ]
    rows = [
        (i, t, None if n % 3 else "en", None if n % 4 == 0 else f"s{n % 2}", None, 1, 2, *["z"] * 2, 3, "4", 5, *["q"] * 6, *(f"{name} kept" for name in WORKING))
        for n, (i, t) in enumerate(texts)
    ]
    return spark.createDataFrame(rows, AWKWARD)


@pytest.fixture
def no_rows(spark):
    return spark.createDataFrame([], AWKWARD)
