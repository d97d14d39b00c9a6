"""Personal data: pattern matches, and terms that reveal them.

Four kinds of values are found by pattern and checked. Each is then a protected entity, and
the corpus tells which terms give it away: a term whose texts hold an entity in several
distinct contexts, and mostly hold that entity, carries nearly the whole
information about it. Terms beyond the disclosure thresholds are spans too; the strongest
are removed, the others generalised.

Built-in functions only. Matches are placed by the lengths of the pieces between them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagepulse.llm.common import digest_spans, materialise

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# The kinds' patterns with possessive loops, which cannot backtrack, and a start only where
# a run starts or the last match ended: both keep the matches and make the search linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without these holds no match of the kind; they are cheap to look for.
HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
TERM_PATTERN = r"[\p{L}\p{N}]+"

# Contexts only tell near copies apart; terms are taken from whole texts.
CONTEXT_CHARS = 160  # on each side of a match
CONTEXT_TERMS = 10
MIN_CONTEXTS = 3  # distinct contexts of an entity in the texts with a term
MIN_SHARE = 0.5  # of a term's texts that hold the entity
MIN_BITS = 3.0  # gained about the entity by seeing the term
REMOVE_SHARE = 0.9
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalised": "[TERM]", "removed": ""}

# Matches placed together: a long list of them is folded block by block.
MATCH_BLOCK = 128

_NO_SPANS = "array<struct<kind:string,start:long,end:long>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _valid_ip(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(value, r"\."), small)


def _valid_card(value: Column) -> Column:
    digits = _digits(value)
    count = F.length(digits)

    def luhn(total: Column, place: Column) -> Column:
        digit = F.substring(digits, (count - place).cast("int"), F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(place % 2 == 1, twice).otherwise(digit)

    return F.when(
        count.between(13, 19),
        F.aggregate(F.sequence(F.lit(0), count - 1), F.lit(0), luhn) % 10 == 0,
    ).otherwise(False)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": _valid_ip,
    "card": _valid_card,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _placed(text: Column, pattern: Column) -> Column:
    """Matches of a pattern as structs of value, start and end, in text order."""
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))

    pairs = F.filter(
        F.arrays_zip(values.alias("value"), gaps.alias("gap")), lambda p: p["value"].isNotNull()
    )
    return _let(pairs, lambda known: _let(_blocks(known), _running))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(pairs: Column) -> Column:
    """An array in parts of MATCH_BLOCK elements."""
    count = F.ceil(F.size(pairs) / MATCH_BLOCK).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
        lambda n: F.slice(pairs, n * MATCH_BLOCK + 1, F.lit(MATCH_BLOCK)),
    )


def _running(blocks: Column) -> Column:
    """Places matches by the lengths before them: of whole blocks first, then within each.

    A fold that grows one array copies it at every step; here none grows beyond a block, or
    beyond one entry per block.
    """

    def extent(pair: Column) -> Column:
        return pair["gap"] + F.length(pair["value"])

    def total(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda done, pair: done + extent(pair))

    def onward(done: Column, length: Column) -> Column:
        return F.struct(
            (done["at"] + length).alias("at"), F.concat(done["starts"], F.array(done["at"])).alias("starts")
        )

    def add(done: Column, pair: Column) -> Column:
        end = done["at"] + extent(pair)
        match = F.struct(
            pair["value"].alias("value"), (done["at"] + pair["gap"]).alias("start"), end.alias("end")
        )
        return F.struct(end.alias("at"), F.concat(done["found"], F.array(match)).alias("found"))

    none = F.array().cast("array<struct<value:string,start:int,end:int>>")
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(F.transform(blocks, total), first, onward)["starts"]
    return F.flatten(
        F.transform(
            F.arrays_zip(blocks.alias("block"), starts.alias("start")),
            lambda b: F.aggregate(b["block"], F.struct(b["start"].alias("at"), none.alias("found")), add)["found"],
        )
    )


def _spans(found: Column, kind: str) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(
            F.lit(kind).alias("kind"),
            m["start"].cast("long").alias("start"),
            m["end"].cast("long").alias("end"),
        ),
    )


def _base(text: Column, kind: str) -> Column:
    """Valid matches of one kind, with their values."""
    return F.when(
        HINTS[kind](text),
        F.filter(_placed(text, F.lit(PATTERNS[kind])), lambda m: VALID[kind](m["value"])),
    ).otherwise(F.array().cast("array<struct<value:string,start:int,end:int>>"))


def _terms(text: Column) -> Column:
    return F.filter(
        F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0)),
        lambda t: F.length(t) > 1,
    )


def _outside(text: Column, found: Column) -> Column:
    """``text`` with a space in place of each match."""

    def step(done: Column, m: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, F.greatest(m["start"] - done["at"], F.lit(0)))
        return F.struct(
            F.greatest(done["at"], m["end"]).alias("at"), F.concat(done["out"], F.array(gap)).alias("out")
        )

    ordered = F.array_sort(F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
    zero = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        ordered,
        zero,
        step,
        lambda done: F.concat_ws(" ", done["out"], F.substring(text, done["at"] + 1, F.length(text))),
    )


def mentions(texts: DataFrame) -> DataFrame:
    """Rows ``(key, terms, found)`` of the distinct texts that hold an entity.

    ``terms`` are those outside matches, ``found`` has the entity and a hash of the context
    terms of each match.
    """
    text = F.col("text")

    def near(kind: str):
        def one(m: Column) -> Column:
            first = F.greatest(m["start"] - CONTEXT_CHARS, F.lit(0))
            left = F.substring(text, first + 1, m["start"] - first)
            right = F.substring(text, m["end"] + 1, F.lit(CONTEXT_CHARS))
            before, after = _terms(left), _terms(right)
            value = F.lower(m["value"]) if kind == "email" else _digits(m["value"]) if kind != "ip" else m["value"]
            return F.struct(
                F.concat(F.lit(kind + ":"), value).alias("entity"),
                F.xxhash64(
                    F.concat(
                        F.slice(before, F.greatest(F.size(before) - CONTEXT_TERMS + 1, F.lit(1)), CONTEXT_TERMS),
                        F.slice(after, 1, CONTEXT_TERMS),
                    )
                ).alias("context"),
            )

        return one

    bases = [_base(text, kind) for kind in KINDS]
    found = F.array_distinct(F.concat(*[F.transform(b, near(k)) for b, k in zip(bases, KINDS)]))
    terms = F.array_distinct(_terms(_outside(text, F.concat(*bases))))
    return (
        texts.select("key", found.alias("found"), terms.alias("terms"))
        .where(F.size("found") > 0)
        .dropDuplicates(["key"])
    )


def revealing_terms(texts: DataFrame) -> DataFrame:
    """Terms beyond the disclosure thresholds: ``term, share``, over the column ``text``.

    Counts are of distinct whole texts, however many copies there are; a term's texts need MIN_CONTEXTS distinct contexts of the
    entity besides. ``share`` is the largest share of a term's texts that hold one entity;
    the gain in bits is log2 of that share over the entity's own share of all texts.
    The texts with a term and any entity bound its texts from below, which rules out
    common words before they are counted.
    """
    found = materialise(mentions(texts), "mentions")
    total = texts.select("key").distinct().count()
    matches = found.select("key", F.explode("found").alias("m")).select("key", "m.*")
    # An entity of too few contexts has no term of enough.
    entities = materialise(
        matches.groupBy("entity")
        .agg(F.count_distinct("key").alias("n_e"), F.count_distinct("context").alias("contexts"))
        .where(F.col("contexts") >= MIN_CONTEXTS)
        .select("entity", "n_e"),
        "entities",
    )
    pairs = (
        matches.join(entities.select("entity"), "entity", "left_semi")
        .join(found.select("key", "terms"), "key")
        .select("entity", F.xxhash64("key").alias("row"), "context", F.explode("terms").alias("term"))
    )
    near = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    candidates = materialise(
        pairs.groupBy("entity", "term")
        .agg(F.count_distinct("context").alias("contexts"), F.count_distinct("row").alias("n_te"))
        .where(F.col("contexts") >= MIN_CONTEXTS)
        .join(near, "term")
        .where(F.col("n_te") >= MIN_SHARE * F.col("n_near"))
        .select("entity", "term", "n_te"),
        "candidates",
    )
    if candidates.isEmpty():
        return candidates.select("term", F.lit(0.0).alias("share"))
    wanted = candidates.select("term").distinct()
    holding = (
        texts.select("key", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
        .join(wanted, "term", "left_semi")
        .distinct()
        .groupBy("term")
        .agg(F.count("*").alias("n_t"))
    )
    share = F.least(F.lit(1.0), F.col("n_te") / F.col("n_t"))
    bits = F.log2(share / (F.col("n_e") / F.lit(float(max(total, 1)))))
    return materialise(
        candidates.join(entities, "entity")
        .join(holding, "term")
        .select("term", share.alias("share"), bits.alias("bits"))
        .where((F.col("share") >= MIN_SHARE) & (F.col("bits") >= MIN_BITS))
        .groupBy("term")
        .agg(F.max("share").alias("share")),
        "revealing",
    )


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_pii``: ``base`` and ``spans``, ``generalised`` and ``removed``.

    Each is an array of spans ``kind, start, end`` in code points, end exclusive, by kind
    (email, ip, card, phone, then term) and start. Terms lie outside base spans. A null
    text is empty and has none. Rows are searched one by one: repeated rows, null ids and
    other columns pass through; ``_pii`` is replaced. An empty table gives an empty result.
    """
    return _found(docs.drop("_pii"), text).select("row", F.col("pii").alias("_pii")).select("row.*", "_pii")


def _found(docs: DataFrame, text: str) -> DataFrame:
    """``row``, the columns of ``docs`` as one, so that no name meets those in use here; and ``pii``."""
    whole = F.coalesce(F.col("body"), F.lit(""))
    docs = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("string").alias("body"))
    keyed = docs.withColumn("_key", F.md5(whole.cast("binary")))
    texts = keyed.select(F.col("_key").alias("key"), whole.alias("text"))
    revealing = revealing_terms(texts)
    if revealing.isEmpty():
        marked = docs.withColumn("_terms", F.lit(None).cast("array<struct<term:string,share:double>>"))
    else:
        hits = materialise(
            texts.select("key", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
            .join(revealing, "term")
            .groupBy(F.col("key").alias("_key"))
            .agg(F.collect_set(F.struct("term", "share")).alias("_terms")),
            "hits",
        )
        marked = keyed.join(hits, "_key", "left").drop("_key")
    base = F.concat(*[_spans(_base(whole, kind), kind) for kind in KINDS])
    marked = marked.withColumn("_base", base)

    def places(strong: bool) -> Column:
        terms = F.filter("_terms", lambda t: (t["share"] >= REMOVE_SHARE) == F.lit(strong))
        pattern = F.concat(
            F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"),
            F.array_join(F.transform(terms, lambda t: t["term"]), "|"),
            F.lit(r")(?![\p{L}\p{N}])"),
        )
        found = F.when(F.size(terms) > 0, _spans(_placed(whole, pattern), TERM))
        return F.filter(
            F.coalesce(found, F.array().cast(_NO_SPANS)),
            lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        )

    marked = marked.withColumn("_generalised", places(False)).withColumn("_removed", places(True))
    terms = F.array_sort(
        F.concat("_generalised", "_removed"),
        lambda a, b: (a["start"] - b["start"]).cast("int"),
    )
    return marked.select(
        "row",
        F.struct(
            F.col("_base").alias("base"),
            F.concat("_base", terms).alias("spans"),
            F.col("_generalised").alias("generalised"),
            F.col("_removed").alias("removed"),
        ).alias("pii"),
    )


def _labelled(spans: Column, label: Column | None = None) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), (s["kind"] if label is None else label).alias("label")
        ),
    )


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; texts without any stay as they are.

    Spans that overlap are replaced as one, by the placeholder of the first. Nulls stay null,
    empty texts empty; repeated rows and other columns pass through, whatever their names; an
    empty table gives an empty result.
    """
    found = _found(docs, text)
    spans = F.array_sort(
        F.concat(
            _labelled(F.col("pii.base")),
            _labelled(F.col("pii.generalised"), F.lit("generalised")),
            _labelled(F.col("pii.removed"), F.lit("removed")),
        )
    )
    holder = F.create_map(*[F.lit(x) for pair in PLACEHOLDERS.items() for x in pair])
    body = F.col(f"row.`{text}`").cast("string")

    def step(done: Column, span: Column) -> Column:
        fresh = span["start"] >= done["at"]
        gap = F.substring(body, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        return F.struct(
            F.greatest(done["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(done["out"], F.array(gap, holder[span["label"]])))
            .otherwise(done["out"])
            .alias("out"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    built = F.aggregate(
        spans,
        zero,
        step,
        lambda done: F.concat(
            F.array_join(done["out"], ""), F.substring(body, (done["at"] + 1).cast("int"), F.length(body))
        ),
    )
    clean = F.when(F.size("pii.spans") > 0, built).otherwise(body)
    return found.select(*[clean.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digests of the spans found: one row per document.

    A null or empty text has none; null ids and repeated rows keep their rows; other columns,
    whatever their names, are ignored; an empty table gives an empty result.
    """
    found = find(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    base = F.col("_pii.base")
    return found.select(
        "doc_id",
        *[
            _count(base, kind).alias(f"n_{kind}")
            for kind in KINDS
        ],
        F.sha2(digest_spans(base), 256).alias("base_sha256"),
        digest_spans(F.col("_pii.spans")).alias("spans"),
    )
