"""Registered queries of the training-data operators and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagepulse.llm import chat, divergence, fingerprints, lm_scoring, merkle, mixing, packing, pii, quality_classifier, quality_rules, simhash, toxicity, warc
from usagepulse.llm.common import materialise, table

Query = Callable[[SparkSession, str], DataFrame]


def op3_simhash_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, root, "documents"))


def op1_best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"))


def op2_quality_classifier(spark: SparkSession, root: str) -> DataFrame:
    return quality_classifier.classify(
        table(spark, root, "documents"), table(spark, root, "labels")
    )


def op4_source_mixing(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    sized = materialise(sized, "sizes")
    return mixing.read_back(mixing.mix(sized)).select(
        "doc_id",
        "size",
        "_mix.source_size",
        "_mix.target",
        "_mix.taken",
        "_mix.copies",
        F.get("_mix.times", F.lit(0)).alias("first_time"),
    )


SOURCE_MIXING_SQL = r"""
WITH sized AS (
    SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS src,
        md5(coalesce(doc_id::VARCHAR, '')) AS pos,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents
), sources AS (
    SELECT none, src, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (ORDER BY none, src) AS place FROM sources
), weighed AS (
    SELECT *, [3.0::DOUBLE, 1.0, 2.0][((place - 1) % 3 + 1)::INT] AS weight,
        [-0.5::DOUBLE, 0.0, 0.5][((place - 1) % 3 + 1)::INT] AS slope
    FROM ranked
), shares AS (
    SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::DOUBLE
        - coalesce(sum(2.0::DOUBLE * source_size) OVER (
            ORDER BY 2.0::DOUBLE * source_size / weight, place
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (
            ORDER BY 2.0::DOUBLE * source_size / weight, place
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
    FROM weighed
), targets AS (
    SELECT none, src, source_size, slope, least(2.0::DOUBLE * source_size,
        (SELECT max(share) FROM shares WHERE share <= 2.0::DOUBLE * source_size / weight)
        * weight) AS target
    FROM shares
), placed AS (
    SELECT doc_id, size, source_size, target, slope,
        CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes,
        coalesce(sum(size) OVER (
            PARTITION BY none, src ORDER BY pos, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + size / 2.0::DOUBLE AS middle
    FROM sized JOIN targets USING (none, src)
), counted AS (
    SELECT *, passes + (middle < target - passes * source_size)::BIGINT AS copies FROM placed
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies,
    CASE WHEN copies > 0 THEN
        2.0::DOUBLE * least(1.0::DOUBLE, middle / target) / (1 - slope
        + sqrt((1 - slope) * (1 - slope) + 4 * slope * least(1.0::DOUBLE, middle / target)))
    END AS first_time
FROM counted
"""


def op5_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, keep=["doc_id"]).select("doc_id", "_rules.*")


def op6_lm_scoring(spark: SparkSession, root: str) -> DataFrame:
    """The target is what ``labels`` calls good."""
    good = table(spark, root, "labels").where("quality = 1 AND doc_id IS NOT NULL")
    return lm_scoring.score(table(spark, root, "documents"), good)


def op7_toxicity(spark: SparkSession, root: str) -> DataFrame:
    return toxicity.classify(table(spark, root, "documents"), table(spark, root, "labels"))


def op8_document_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, root, "documents"))


def op9_pii(spark: SparkSession, root: str) -> DataFrame:
    return pii.report(table(spark, root, "documents"))


def op10_warc(spark: SparkSession, root: str) -> DataFrame:
    return warc.round_trip(table(spark, root, "pages"))


WARC_SQL = """
WITH keyed AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
        sha1(coalesce(html, '')) AS payload_digest
    FROM pages
), led AS (
    SELECT *, CASE WHEN payload_bytes >= 1000
        THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS lead
    FROM keyed
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN lead = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN lead <> page_id THEN lead END AS refers_to
FROM led
"""


def op11_chat_formatting(spark: SparkSession, root: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts are made of control strings."""
    tricky = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), "
        "(-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    rows = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    return chat.summary(chat.format_examples(rows.unionByName(tricky)))


CHAT_FORMATTING_SQL = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
    SELECT *, [length(x) + len(regexp_extract_all(x,
            '<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|endoftext\|>|\\'))
        FOR x IN [role, text]] AS chars
    FROM said
), placed AS (
    SELECT *, row_number() OVER turns AS place, count(*) OVER (PARTITION BY conv_id) AS n,
        sum(chars[1] + chars[2] + 12 + 10 + 10) OVER (turns ROWS UNBOUNDED PRECEDING) AS upto
    FROM escaped WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (sum(upto) FILTER (role = 'assistant' OR place = n))::BIGINT AS formatted_chars,
    count(*) FILTER (role = 'assistant' OR place = n) AS n_examples
FROM placed GROUP BY conv_id
"""


def op12_merkle_manifest(spark: SparkSession, root: str) -> DataFrame:
    """A manifest of all documents, and a climb from every leaf, some of them tampered with."""
    docs = table(spark, root, "documents")
    return merkle.verify(merkle.build(docs, tampered=merkle.tampered_text()))


MERKLE_MANIFEST_SQL = """
WITH RECURSIVE framed AS (
    SELECT doc_id, lang, text,
        list_reduce(string_split(doc_id::VARCHAR, ''), lambda crc, digit: list_reduce(
            range(8), lambda c, _: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, ascii(digit)::BIGINT)
        ), 4294967295::BIGINT) AS crc,
        array_to_string([coalesce(strlen(f)::VARCHAR || ':' || f, '-')
            FOR f IN [doc_id::VARCHAR, source, lang, n_chars::VARCHAR]], '') AS frame
    FROM documents
), hashed AS (
    SELECT doc_id, lang, sha256(frame || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
        sha256(frame || coalesce(strlen(text)::VARCHAR || ':' || CASE WHEN xor(crc, 4294967295) % 3 = 0
            THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS changed
    FROM framed
), leaves AS (
    SELECT doc_id, leaf, changed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
        count(*) OVER (PARTITION BY lang) AS size, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
    FROM hashed
), nodes AS (
    SELECT tree, 0 AS height, place AS node, size, leaf AS hash FROM leaves
    UNION ALL
    SELECT tree, height + 1, node // 8, size, sha256(string_agg(hash, '' ORDER BY node))
    FROM nodes WHERE size > 8 ** height GROUP BY tree, height, node // 8, size
), subroots AS (
    SELECT tree, arg_max(hash, height) AS subroot, max(height) AS levels, count(*) OVER () AS size
    FROM nodes GROUP BY tree
), tops AS (
    SELECT 0 AS height, tree AS node, size, subroot AS hash FROM subroots
    UNION ALL
    SELECT height + 1, node // 8, size, sha256(string_agg(hash, '' ORDER BY node))
    FROM tops WHERE size > 8 ** height GROUP BY height, node // 8, size
), met AS (
    SELECT l.tree, l.place, n.height + 1 AS step, n.node, n.hash, l.place // (8 ** n.height)::BIGINT AS own
    FROM leaves l JOIN subroots s USING (tree) JOIN nodes n
        ON n.tree = l.tree AND n.height < s.levels AND n.node // 8 = l.place // (8 ** (n.height + 1))::BIGINT
    UNION ALL
    SELECT l.tree, l.place, s.levels + t.height + 1, t.node, t.hash, l.tree // (8 ** t.height)::BIGINT
    FROM leaves l JOIN subroots s USING (tree) JOIN tops t
        ON t.size > 8 ** t.height AND t.node // 8 = l.tree // (8 ** (t.height + 1))::BIGINT
), steps AS (
    SELECT tree, place, step, coalesce(string_agg(hash, '' ORDER BY node) FILTER (node < own), '') AS l,
        coalesce(string_agg(hash, '' ORDER BY node) FILTER (node > own), '') AS r
    FROM met GROUP BY ALL
), climb AS (
    SELECT tree, place, 0 AS step, changed AS folded FROM leaves
    UNION ALL
    SELECT c.tree, c.place, s.step, sha256(s.l || c.folded || s.r)
    FROM climb c JOIN steps s ON s.tree = c.tree AND s.place = c.place AND s.step = c.step + 1
), folds AS (
    SELECT tree, place, arg_max(folded, step) AS folded_root FROM climb GROUP BY ALL
), proofs AS (
    SELECT tree, place, string_agg(l || r, '' ORDER BY step) AS proof FROM steps GROUP BY ALL
), tip AS (
    SELECT arg_max(hash, height) AS root FROM tops
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN folds USING (tree, place) JOIN subroots USING (tree) CROSS JOIN tip LEFT JOIN proofs USING (tree, place)
"""


def op13_source_divergence(spark: SparkSession, root: str) -> DataFrame:
    return divergence.audit(table(spark, root, "documents"))


SOURCE_DIVERGENCE_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), named AS (
    SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), kept AS (
    SELECT lang, term, count(*)::HUGEINT AS n FROM docs GROUP BY ALL HAVING count(DISTINCT id) >= 10
), used AS (
    SELECT lang, source, term, count(*)::HUGEINT AS n FROM docs SEMI JOIN kept USING (lang, term) GROUP BY ALL
), dense AS (
    SELECT lang, source, term, coalesce(u.n, 0) AS n,
        1 + 1000000000 * (coalesce(u.n, 0) + 2) // (sum(coalesce(u.n, 0)) OVER (PARTITION BY lang, source)
            + 2 * count(*) OVER (PARTITION BY lang, source)) AS p,
        1 + 1000000000 * (k.n + 2) // (sum(k.n) OVER (PARTITION BY lang, source)
            + 2 * count(*) OVER (PARTITION BY lang, source)) AS q
    FROM named JOIN kept k USING (lang) LEFT JOIN used u USING (lang, source, term)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM named a JOIN named b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM dense WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""


def llm_queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_quality_classifier": op2_quality_classifier,
        "op4_source_mixing": op4_source_mixing,
        "op5_quality_rules": op5_quality_rules,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_toxicity": op7_toxicity,
        "op8_document_fingerprints": op8_document_fingerprints,
        "op9_pii": op9_pii,
        "op10_warc": op10_warc,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op11_chat_formatting": op11_chat_formatting,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_source_divergence": op13_source_divergence,
    }


def llm_oracles() -> dict[str, str]:
    return {
        "op4_source_mixing": SOURCE_MIXING_SQL,
        "op10_warc": WARC_SQL,
        "op11_chat_formatting": CHAT_FORMATTING_SQL,
        "op12_merkle_manifest": MERKLE_MANIFEST_SQL,
        "op13_source_divergence": SOURCE_DIVERGENCE_SQL,
    }
