"""The Merkle manifest against a plain recursive build, and tampering of any field."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from usagepulse.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_leaf(doc_id, text, lang, source, n_chars):
    return h("".join(map(framed, (doc_id, source, lang, n_chars, text))))


def levels(hashes):
    """All levels of a tree, the lowest first."""
    found = [hashes]
    while len(found[-1]) > 1:
        below = found[-1]
        found.append([h("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return found


def climb(tree, place, own):
    """Siblings on the way up, and the hash that ``own`` folds to."""
    siblings = []
    for level in tree[:-1]:
        first = place // 8 * 8
        run = level[first : first + 8]
        siblings += run[: place - first] + run[place - first + 1 :]
        run[place - first] = own
        own, place = h("".join(run)), place // 8
    return siblings, own


def tamper(doc_id, text):
    if doc_id is None or text is None or zlib.crc32(str(doc_id).encode()) % 3:
        return text
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [
        sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        for lang in langs
    ]
    trees = [levels([plain_leaf(*r) for r in group]) for group in groups]
    top = levels([t[-1][0] for t in trees])
    root, made = top[-1][0], []
    for n, (group, tree) in enumerate(zip(groups, trees)):
        for place, row in enumerate(group):
            below, folded = climb(tree, place, plain_leaf(row[0], tamper(row[0], row[1]), *row[2:]))
            above, folded = climb(top, n, folded)
            made.append((row[0], tree[0][place], tree[-1][0], root, h("".join(below + above)), folded, folded == root))
    return made


def key(row):
    return repr(tuple(row))


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = merkle.verify(merkle.build(docs, tampered=merkle.tampered_text())).collect()
    assert sorted(map(tuple, found), key=key) == sorted(plain(rows), key=key)


def generated(n, langs, seed):
    dice = random.Random(seed)
    return [
        (i * 3, dice.choice(["Upper Case", "lower", "É only", "", None]), dice.choice(langs), dice.choice(["a", None]), dice.choice([1, None]))
        for i in range(n)
    ]


@pytest.mark.parametrize("n", [1, 9, 64, 600])
def test_one_tree_of_every_shape(spark, n):
    check(spark, generated(n, ["en"], n))


def test_many_trees_of_different_heights_and_hot_group(spark):
    langs = ["en"] * 300 + [None, "", "zz", "Zz", "é"] + [f"l{i}" for i in range(70)]
    check(spark, generated(5_000, langs, 1))


def test_nulls_ties_and_repeated_rows(spark):
    rows = generated(40, ["en", None], 2)
    rows = rows + rows[:20] * 3 + [(None, "A", "en", None, None)] * 30 + [(6, f"Text {i}", "en", "s", 1) for i in range(30)]
    check(spark, rows)


def test_long_text(spark):
    check(spark, [(n, "Long words " * 200_000, "en", "s", 1) for n in range(3)])


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    built = merkle.build(empty)
    assert built.root is None and merkle.verify(built).count() == 0
    rows = generated(100, ["en", "de"], 3)
    names = ["leaf", "tree", "place", "group", "other", "size", "hash", "node", "f0", "f4", "changed", "spread", "run"]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(n) for n in names])
    found = merkle.verify(merkle.build(docs, tampered=merkle.tampered_text()))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain(rows), key=key)


def test_any_changed_field_is_found(spark):
    rows = generated(200, ["en", "de"], 4)
    docs = spark.createDataFrame(rows, SCHEMA)
    same = merkle.verify(merkle.build(docs))
    assert same.where("verified").count() == 200
    changed = F.when(F.col("doc_id") == 3, F.lit("other")).otherwise(F.col("text"))
    assert [r.doc_id for r in merkle.verify(merkle.build(docs, tampered=changed)).where("NOT verified").collect()] == [3]


def test_nodes_are_linked_to_parents_up_to_the_root(spark):
    built = merkle.build(spark.createDataFrame(generated(700, ["en", "de"], 5), SCHEMA))
    nodes = built.nodes
    assert nodes.where("parent != shiftright(node, 3)").count() == 0
    inner = nodes.where("tree >= 0").alias("a").join(
        nodes.alias("b"), F.expr("a.tree = b.tree AND a.height + 1 = b.height AND a.parent = b.node"), "left"
    )
    lost = inner.where("b.run IS NULL OR instr(hex(b.run), hex(a.hash)) = 0").select("a.tree", "a.height").collect()
    levels_of = {r.tree: r.levels for r in built.trees.collect()}
    assert sorted(map(tuple, lost)) == sorted(levels_of.items())


def test_the_row_limit_of_the_session_is_put_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    merkle.verify(merkle.build(spark.createDataFrame(generated(20, ["en"], 6), SCHEMA))).count()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
