"""Merkle tree over a dataset: per level, lag and lead columns supply siblings, and first-child rows hash parents.

Rows of a group (``lang``) are leaves in ascending order.  A tree is climbed in tiers: rows
are dealt by (group, block of ``fan ** LEVELS`` nodes), so that a group of any size is many
tasks, and all levels of a block are windows over the same shuffled rows.  At level ``l`` a
node is represented by the row of its first leaf; its siblings are rows at fixed offsets of
multiples of ``fan ** l``, masked by the node's slot and by the length of its run.  Blocks'
own nodes are the leaves of the next tier, and paths come back down by joins on (group,
block), never on a group alone.

Defined results: a null field is hashed as ``-``; null languages are a group of their own and
the first; null ids come first; rows of one id are in order of their leaf hash, and equal
rows are interchangeable; an empty table gives an empty result; other columns are ignored;
texts of any length are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep

FAN = 2
#: Levels of a block: 1024 leaves for pairs.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A document is tampered with where this divides the checksum of its id.
TAMPER = 7


def digest(*parts: Column) -> Column:
    """H: lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A leaf's field: ``-`` if null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``grp`` (never null, in order of languages), ``leaf``, and ``altered``: the tampered leaf, null where nothing is changed."""
    def leaf(n_chars: Column) -> Column:
        return digest(*[field(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS])

    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0) & F.col("n_chars").isNotNull()
    group = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    return docs.select("doc_id", group.alias("grp"), leaf(F.col("n_chars")).alias("leaf"), F.when(hit, leaf(F.col("n_chars").cast("decimal(20,0)") + 1)).alias("altered"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place in their group, and ``m``, the group's size, without sorting a group in one task.

    Rows are ranged over partitions by group, order and their place in the input (so equal
    rows split as well) and stored with their place in the sorted partition; counts of
    partitions, and of groups in partitions, do the rest.
    """
    keys = [F.col(c) for c in (group, *order)]
    placed = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, F.col("_tie")).sortWithinPartitions(*keys, F.col("_tie")).drop("_tie")
    stored = keep(placed.withColumn("_at", F.monotonically_increasing_id()), "merkle-order").withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    pieces = stored.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_in").alias("_first"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    of_group = W.partitionBy(group)
    # a group has at most one piece a partition
    offsets = pieces.select("_part", group, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"), F.sum("_n").over(of_group).alias("m"))
    return stored.join(offsets, ["_part", group]).withColumn("pos", F.col("_in") + F.col("_offset")).drop("_part", "_in", "_at", "_offset")


def climbed(nodes: DataFrame, group: str, fan: int, levels: int) -> DataFrame:
    """All levels of a tier: ``nodes`` (group, pos, m, h) with ``block``, ``top`` (the block's own node, on its first row) and ``path``.

    ``path`` has for each level that the group still has a struct of the node's left and
    right siblings, concatenated in order.
    """
    rows = nodes.withColumn("block", F.floor(F.col("pos") / F.lit(fan**levels)).cast("bigint"))
    ordered = W.partitionBy(group, "block").orderBy("pos")
    so_far = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("top", F.col("h"))
    for level in range(levels):
        stride = fan**level
        nodes_here = F.ceil(F.col("m") / F.lit(stride))
        index = F.floor(F.col("pos") / F.lit(stride))
        slot, active, first = index % fan, nodes_here > 1, F.col("pos") % stride == 0
        run = F.least(F.lit(fan), nodes_here - (index - slot))
        rows = rows.withColumns({f"_lag{j}": F.lag("top", j * stride).over(ordered) for j in range(1, fan)} | {f"_lead{j}": F.lead("top", j * stride).over(ordered) for j in range(1, fan)})
        left = F.concat(*[F.when(slot >= j, F.col(f"_lag{j}")).otherwise("") for j in range(fan - 1, 0, -1)])
        right = F.concat(*[F.when(slot + j < run, F.col(f"_lead{j}")).otherwise("") for j in range(1, fan)])
        own = F.when(active & first, F.struct(left.alias("left"), right.alias("right")))
        rows = rows.withColumn(f"_s{level}", own).drop(*[f"_{side}{j}" for side in ("lag", "lead") for j in range(1, fan)])
        parent = F.when(active, digest(F.col("top"), F.col(f"_s{level}")["right"])).otherwise(F.col("top"))
        rows = rows.withColumn("top", F.when(F.col("pos") % (stride * fan) == 0, parent))
        if level:  # the others of the node have their first row before them in the block
            rows = rows.withColumn(f"_s{level}", F.last(f"_s{level}", ignorenulls=True).over(so_far))
    steps = F.filter(F.array(*[F.col(f"_s{level}") for level in range(levels)]), lambda s: s.isNotNull())
    return rows.withColumn("path", steps).drop(*[f"_s{level}" for level in range(levels)])


def paths(nodes: DataFrame, group: str, largest: int, fan: int, levels: int, above) -> DataFrame:
    """``nodes`` with the whole ``path`` to the root, and ``subroot`` and ``root``.

    ``largest``: nodes of the largest group; ``above``: takes one node a group (group, h) and
    returns it with its path, ``subroot`` and ``root``.
    """
    here = 1
    while here < levels and fan**here < largest:
        here += 1
    tier, size = climbed(nodes, group, fan, here), fan**here
    heads = tier.filter(F.col("pos") % size == 0).select(group, F.col("block").alias("pos"), F.ceil(F.col("m") / F.lit(size)).cast("bigint").alias("m"), F.col("top").alias("h"))
    if largest > size:
        upper = paths(heads, group, -(-largest // size), fan, levels, above).drop("m", "h").withColumnRenamed("pos", "block")
    else:
        upper = above(heads.select(group, "h")).drop("h").withColumn("block", F.lit(0).cast("bigint"))
    upper = upper.withColumnRenamed("path", "_upper")
    return tier.drop("top").join(upper, [group, "block"]).withColumn("path", F.concat("path", "_upper")).drop("_upper", "block")


def manifest(docs: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Per document: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``path`` (steps of left and right siblings up to the root) and ``altered`` (tampered leaf or null)."""
    if fan < 2 or levels < 1:
        raise ValueError("fan is at least 2, levels at least 1")
    rows = numbered(leaves(docs), "grp", ["doc_id", "leaf"]).withColumnRenamed("leaf", "h")
    largest = rows.agg(F.max("m")).first()[0] or 1

    def to_root(subroots: DataFrame) -> DataFrame:
        ranked = numbered(subroots.withColumn("_all", F.lit(0)), "_all", ["grp"])
        groups = ranked.agg(F.max("m")).first()[0] or 1
        ends = paths(ranked, "_all", groups, fan, levels, lambda top: top.withColumns({"path": F.array().cast("array<struct<left:string,right:string>>"), "root": F.col("h")}))
        return ends.select("grp", "h", F.col("h").alias("subroot"), "root", "path")

    return paths(rows, "grp", largest, fan, levels, to_root).select("doc_id", F.col("h").alias("leaf"), "subroot", "root", "path", "altered")


def proof_digest(path: Column) -> Column:
    """H of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def verified(manifested: DataFrame) -> DataFrame:
    """The manifest with ``proof_sha256``, ``folded_root`` of the tampered (else the original) leaf, and whether it is the root."""
    root = folded(F.coalesce("altered", "leaf"), F.col("path"))
    out = manifested.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
