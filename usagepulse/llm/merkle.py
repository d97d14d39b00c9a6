"""Merkle manifest of a table: eight-ary hash trees by group under one root, and a recursive climb.

Each row is a leaf. The leaves of a group stand in order of their id; eight consecutive
nodes have their hashes hashed to their parent, level by level, until one is left, the
group's subroot. The subroots are the leaves of one more such tree, whose top is the root.

The manifest is written as leaves and as nodes linked to their parents, each with the run of
its children's hashes. A recursive query climbs from every leaf by the parent links: each
step appends a row with the siblings met there and folds the hash at hand with them. Nothing
gathered is carried upwards, so a level moves a key and a hash for each leaf. Above a block of
64 leaves, all of them meet the same siblings: their run is repeated for each block, so that
no task of the climb gets many leaves of one node, and the climb appends no copies of it.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagepulse.llm.common import fresh_path, materialise

BITS = 3  # eight children a node
BLOCK_HEIGHT = 2  # runs above this height are stored by block of 8 ** BLOCK_HEIGHT leaves
TOP = -1  # the tree over the subroots
PIECE_ROWS = 1_000_000  # rows of a range of the sort that numbers the leaves, about
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 3  # the check tampers with ids whose crc32 this divides
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = "tree long, node long, parent long, hash binary, run binary"


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 in hex of each field: ``-`` for null, else its UTF-8 length, a colon, its text."""

    def framed(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


def _digest(hashes: Column) -> Column:
    """The hash of hashes given as bytes; they are hashed as their hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(hashes)), 256))


def _joined(hashes: Column) -> Column:
    """An array of hashes as one run of bytes."""
    return F.unhex(F.array_join(F.transform(hashes, F.hex), ""))


@dataclass(frozen=True)
class Manifest:
    """The written tables of a manifest.

    ``leaves``: doc_id, leaf, changed, tree, place (the number of the leaf's group and its
    place in it). ``trees``: tree, group, size, subroot, levels. ``nodes``: tree, height,
    node, parent, hash, run (the hashes of its children) for every node above the leaves;
    tree TOP stands over the subroots and has ``top_levels``. ``root`` is hex.
    """

    leaves: DataFrame
    trees: DataFrame
    nodes: DataFrame
    top_levels: int
    root: str | None


def _numbered(leaves: DataFrame, pieces: int) -> DataFrame:
    """Adds ``place``, a leaf's number in its tree in order of ``doc_id``, nulls first.

    Ranges of the whole order are sorted apart; the leaves of a tree in earlier ranges are
    counted by range and tree, which are few rows. Leaves of equal id stand in order of
    their hash, and ``spread`` divides equal ones among ranges; they are interchangeable.
    """
    order = ["tree", F.col("doc_id").asc_nulls_first(), "leaf", "spread"]
    ranges = materialise(
        leaves.repartitionByRange(pieces, *order)
        .sortWithinPartitions(*order)
        .withColumn("piece", F.spark_partition_id())
        .withColumn("line", F.monotonically_increasing_id()),
        "merkle-sorted",
    )
    earlier = Window.partitionBy("tree").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        ranges.groupBy("tree", "piece")
        .agg(F.count("*").alias("n"), F.min("line").alias("first"))
        .select("tree", "piece", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("base"))
    )
    return (
        ranges.join(bases, ["tree", "piece"])
        .withColumn("place", F.col("base") + F.col("line"))
        .drop("piece", "line", "base", "spread")
    )


def _height(size: int) -> int:
    height = 0
    while size > 1 << BITS * height:
        height += 1
    return height


def _grow(level: DataFrame, sizes: DataFrame, tallest: int) -> DataFrame:
    """Writes every node above ``level`` (tree, node, hash) and returns them with their height.

    A tree stops where one node is left, so height h is built for trees of over 8 ** (h - 1)
    leaves. Every height is written before the next one reads it.
    """
    spark = level.sparkSession
    path = fresh_path(spark, "merkle-nodes")
    spark.createDataFrame([], NODE).write.parquet(f"{path}/height=0")
    for height in range(1, tallest + 1):
        growing = sizes.where(F.col("size") > F.lit(1 << BITS * (height - 1))).select("tree")
        runs = (
            level.join(growing, "tree", "left_semi")
            .groupBy("tree", F.shiftright("node", BITS).alias("above"))
            .agg(F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("children"))
            .select("tree", F.col("above").alias("node"), _joined(F.col("children.hash")).alias("run"))
        )
        nodes = runs.select(
            "tree", "node", F.shiftright("node", BITS).alias("parent"), _digest(F.col("run")).alias("hash"), "run"
        )
        nodes.write.parquet(f"{path}/height={height}")
        level = spark.read.schema(NODE).parquet(f"{path}/height={height}").select("tree", "node", "hash")
    return spark.read.schema(f"{NODE}, height int").parquet(path)


def build(
    docs: DataFrame, group: str = "lang", fields: tuple[str, ...] = FIELDS, tampered: Column | None = None
) -> Manifest:
    """The manifest of ``docs``: one leaf per row, one tree per value of ``group``.

    ``fields`` are what a leaf covers; the first is the id that orders leaves. ``tampered``
    is the text to put for the last field in a second hash of each leaf, kept beside the
    first as ``changed``; none leaves them equal. Nulls are framed apart from empty texts; a
    null id comes first, a null group is a group and comes first; rows of equal id stand
    in order of their hash, and repeated rows are leaves of their own. Other columns are
    ignored, whatever their names. An empty table gives empty tables and no root.
    """
    own = [F.col(f"f{i}") for i in range(len(fields))]
    hashed = materialise(
        docs.select(
            *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)],
            F.col(group).cast("string").alias("group"),
            (F.col(fields[-1]) if tampered is None else tampered).alias("other"),
        ).select(
            F.col("f0").alias("doc_id"),
            "group",
            F.unhex(leaf_hash(own)).alias("leaf"),
            F.unhex(leaf_hash([*own[:-1], F.col("other")])).alias("changed"),
            F.monotonically_increasing_id().alias("spread"),
        ),
        "merkle-leaves",
    )
    # One row per group, so this window has few rows.
    groups = materialise(
        hashed.groupBy("group")
        .agg(F.count("*").alias("size"))
        .withColumn("tree", F.row_number().over(Window.orderBy(F.col("group").asc_nulls_first())).cast("long") - 1),
        "merkle-groups",
    )
    all_groups = groups.agg(F.count("*").alias("n"), F.sum("size").alias("rows"), F.max("size").alias("most")).first()
    numbers = groups.select("tree", F.col("group").alias("named"))
    dealt = hashed.join(numbers, F.col("group").eqNullSafe(F.col("named"))).drop("group", "named")
    leaves = materialise(_numbered(dealt, 8 + (all_groups["rows"] or 0) // PIECE_ROWS), "merkle-places")

    bottom = leaves.select("tree", F.col("place").alias("node"), F.col("leaf").alias("hash"))
    nodes = _grow(bottom, groups, _height(all_groups["most"] or 0))
    lone = bottom.join(groups.where("size = 1").select("tree"), "tree").select("tree", F.lit(0).alias("height"), "hash")
    last = (
        nodes.where("node = 0").select("tree", "height", "hash").unionByName(lone)
        .groupBy("tree").agg(F.max_by("hash", "height").alias("subroot"), F.max("height").alias("levels"))
    )
    trees = materialise(groups.join(last, "tree"), "merkle-trees")

    top_levels = _height(all_groups["n"])
    over = trees.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("node"), F.col("subroot").alias("hash"))
    top = _grow(over, over.groupBy("tree").agg(F.count("*").alias("size")), top_levels)
    ends = top.where(F.col("height") == top_levels) if top_levels else over
    root = ends.select(F.lower(F.hex("hash"))).first()
    return Manifest(leaves, trees, nodes.unionByName(top), top_levels, root[0] if root else None)


def rungs(manifest: Manifest) -> DataFrame:
    """What a climb meets at each step: tree, step, spot, run, and ``at`` above the blocks.

    A leaf at ``place`` meets at ``step`` the row whose ``spot`` is its place shifted by
    BITS * min(step, BLOCK_HEIGHT). ``at`` is its position in the run where all leaves of
    the spot share it. The steps after a tree's last are those of the tree over the subroots.
    """
    nodes = manifest.nodes.withColumnRenamed("height", "step").select("tree", "step", "node", "run")
    below = nodes.where(F.col("tree") != TOP)
    low = below.where(F.col("step") <= BLOCK_HEIGHT).select(
        "tree", "step", F.col("node").alias("spot"), "run", F.lit(None).cast("long").alias("at")
    )
    blocks = F.shiftright(F.col("size") - 1, BITS * BLOCK_HEIGHT)
    spots = manifest.trees.select("tree", "levels", F.explode(F.sequence(F.lit(0).cast("long"), blocks)).alias("spot"))
    child = (1 << BITS) - 1
    high = (
        spots.where(F.col("levels") > BLOCK_HEIGHT)
        .select("tree", "spot", F.explode(F.sequence(F.lit(BLOCK_HEIGHT + 1), F.col("levels"))).alias("step"))
        .withColumn("under", F.expr(f"shiftright(spot, {BITS} * (step - {BLOCK_HEIGHT + 1}))"))
        .withColumn("node", F.shiftright("under", BITS))
        .join(below, ["tree", "step", "node"])
        .select("tree", "step", "spot", "run", F.col("under").bitwiseAND(child).alias("at"))
    )
    if not manifest.top_levels:
        return low.unionByName(high)
    top = nodes.where(F.col("tree") == TOP).select(F.col("step").alias("height"), "node", "run")
    upper = (
        spots.withColumn("height", F.explode(F.sequence(F.lit(1), F.lit(manifest.top_levels))))
        .withColumn("under", F.expr(f"shiftright(tree, {BITS} * (height - 1))"))
        .withColumn("node", F.shiftright("under", BITS))
        .join(top, ["height", "node"])
        .select(
            "tree",
            (F.col("levels") + F.col("height")).alias("step"),
            "spot",
            "run",
            F.col("under").bitwiseAND(child).alias("at"),
        )
    )
    return low.unionByName(high).unionByName(upper)


@contextmanager
def _any_number_of_rows(spark: SparkSession):
    """Within it a recursive query may make more than a million rows."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


CLIMB = f"""
WITH RECURSIVE climb AS (
    SELECT tree, place, last, 0 AS step, changed AS folded, CAST(X'' AS BINARY) AS siblings FROM {{leaves}}
    UNION ALL
    SELECT tree, place, last, step,
        unhex(sha2(lower(hex(concat(substring(run, 1, 32 * at), folded, substring(run, 32 * at + 33)))), 256)),
        CASE WHEN shared THEN X'' ELSE concat(substring(run, 1, 32 * at), substring(run, 32 * at + 33)) END
    FROM (
        SELECT c.tree, c.place, c.last, r.step, c.folded, r.run, r.at IS NOT NULL AS shared,
            CAST(coalesce(r.at, shiftright(c.place, {BITS} * (r.step - 1)) & {(1 << BITS) - 1}) AS INT) AS at
        FROM climb c JOIN {{rungs}} r
        ON r.tree = c.tree AND r.step = c.step + 1
            AND r.spot = shiftright(c.place, {BITS} * least(c.step + 1, {BLOCK_HEIGHT}))
    )
)
SELECT tree, place, step, siblings, CASE WHEN step = last THEN folded END AS folded
FROM climb WHERE step = last OR siblings <> X''
"""


def climb(manifest: Manifest, met: DataFrame) -> DataFrame:
    """What every leaf appends on its way over the rungs ``met``: tree, place, step, siblings, folded.

    ``siblings`` are the other hashes of the run met, left to right, up to BLOCK_HEIGHT.
    ``folded`` is in a leaf's last step: the root folded from the hash that ``changed`` has.
    """
    spark = manifest.leaves.sparkSession
    levels = manifest.trees.select("tree", (F.col("levels") + manifest.top_levels).alias("last"))
    leaves = manifest.leaves.select("tree", "place", "changed").join(levels, "tree")
    with _any_number_of_rows(spark):
        return materialise(spark.sql(CLIMB, leaves=leaves, rungs=met), "merkle-climb")


def _text(steps: str) -> Column:
    """The siblings of an array of structs step, siblings as hex, lowest step first."""
    return F.array_join(F.transform(F.sort_array(steps), lambda s: F.lower(F.hex(s["siblings"]))), "")


def proofs(manifest: Manifest) -> DataFrame:
    """Per leaf: tree, place, proof (hex of all siblings, the lowest step first), folded."""
    met = materialise(rungs(manifest), "merkle-rungs")
    run, at = F.col("run"), F.col("at").cast("int")
    others = F.concat(run.substr(F.lit(1), 32 * at), run.substr(32 * at + 33, F.octet_length(run)))
    above = (
        met.where("at IS NOT NULL")
        .groupBy("tree", F.col("spot").alias("block"))
        .agg(F.collect_list(F.struct("step", others.alias("siblings"))).alias("steps"))
        .select("tree", "block", _text("steps").alias("above"))
    )
    # Dealt by block once, which serves the grouping by leaf and the join.
    below = (
        climb(manifest, met)
        .withColumn("block", F.shiftright("place", BITS * BLOCK_HEIGHT))
        .repartition("tree", "block")
        .groupBy("tree", "block", "place")
        .agg(F.collect_list(F.struct("step", "siblings")).alias("steps"), F.max("folded").alias("folded"))
        .select("tree", "block", "place", _text("steps").alias("below"), "folded")
    )
    return below.join(above, ["tree", "block"], "left").select(
        "tree", "place", F.concat("below", F.coalesce("above", F.lit(""))).alias("proof"), "folded"
    )


def verify(manifest: Manifest) -> DataFrame:
    """Per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``folded_root`` is what the proof and ``changed`` give, ``verified`` whether that is
    the root.
    """
    root = F.lit(manifest.root).cast("string")
    climbed = proofs(manifest).select("tree", "place", F.sha2("proof", 256).alias("proof_sha256"), "folded")
    return (
        manifest.leaves.join(climbed, ["tree", "place"])
        .join(manifest.trees.select("tree", "subroot"), "tree")
        .select(
            "doc_id",
            F.lower(F.hex("leaf")).alias("leaf"),
            F.lower(F.hex("subroot")).alias("subroot"),
            root.alias("root"),
            "proof_sha256",
            F.lower(F.hex("folded")).alias("folded_root"),
            (F.lower(F.hex("folded")) == root).alias("verified"),
        )
    )


def tampered_text(doc_id: str = "doc_id", text: str = "text") -> Column:
    """``text`` in lower case (A-Z only) for every third id by crc32; a null id keeps its text."""
    chosen = F.crc32(F.col(doc_id).cast("string").cast("binary")) % TAMPERED == 0
    return F.when(chosen, F.translate(text, UPPER, LOWER)).otherwise(F.col(text))
