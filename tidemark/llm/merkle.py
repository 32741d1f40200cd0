"""Merkle manifest of a table with proofs by parent preimages.

Every row is a leaf. The leaves of a tree (one a language) stand in order, every ``FANOUT`` consecutive nodes
are hashed to their parent, and the roots of all trees are hashed the same way to one root. What is stored is
not hashes but preimages: for each parent the hashes of its children, one after another. A leaf joins the
preimages of its ancestors; a preimage without the node's own 64 characters is what a proof has to hold at that
level, and a preimage with those characters replaced is what a claimed leaf makes of it.

Scale: ranks come from a range partitioning (a hot language or a repeated row is many partitions). Levels are
built in tiers of ``DEPTH`` levels: a block of ``FANOUT ** DEPTH`` nodes of one tree is a row that holds the
preimages of all its inner nodes, so each tier is one shuffle, a proof needs one join a tier on (tree, block), and
no row, task or group grows with the table. Texts are hashed where they are read and never shuffled.

Defined results: rows are ordered by id (null first), rows with the same id by their leaves; equal rows are
leaves of their own with the same digest. A null language is a tree of its own, before all others. Ids, numbers
and texts that are null are written ``-``. A row without an id is never tampered with by :func:`audit`. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

FANOUT, DEPTH = 2, 8
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Manifest:
    """What is stored of one table.

    tiers, from the leaves up: tree, block, left (levels above this block), kids (the block's nodes with ``at`` and, in the first tier,
    what the leaves carry) and preimages (by level, then by parent). top: the same for the tree over the subroots.
    """

    tiers: list[DataFrame]
    top: list[DataFrame]
    fanout: int
    depth: int


def field(value: Column) -> Column:
    """``-`` if null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(**changed: Column) -> Column:
    """Digest of a row's fields, some of them replaced."""
    return F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in COLUMNS)), 256)


def tree_of(lang: Column) -> Column:
    """A key that is never null and sorts as languages do, null first."""
    return F.when(lang.isNull(), "0").otherwise(F.concat(F.lit("1"), lang.cast("string")))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, ...) with ``at``, the place in the tree from 0, and ``n``, the size of the tree."""
    rows = materialize(rows.withColumn("_copy", F.monotonically_increasing_id()), "merkle-leaves")
    keys = ["tree", *order, "_copy"]  # the last one spreads rows that are the same in all else
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_copy")
    rows = materialize(dealt.withColumn("_row", F.monotonically_increasing_id()), "merkle-ranked").withColumn("_part", F.shiftright("_row", 33))
    parts = rows.groupBy("tree", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    parts = parts.withColumn("_before", F.sum("_n").over(tree.orderBy("_part")) - F.col("_n")).withColumn("n", F.sum("_n").over(tree)).drop("_n")
    return rows.join(parts, ["tree", "_part"]).withColumn("at", F.col("_row") - F.col("_first") + F.col("_before")).drop("_row", "_part", "_first", "_before")


def _levels(n: Column, fanout: int) -> Column:
    """Levels above ``n`` nodes: digits of n - 1 in base ``fanout``, none for a lone node."""
    return F.when(n <= 1, 0).otherwise(F.length(F.conv((n - 1).cast("string"), 10, fanout)))


def _climbed(rows: DataFrame, fanout: int, depth: int) -> DataFrame:
    """Block rows (tree, block, height, kids in order, ...) with preimages of all inner nodes and ``node``, what remains of the block."""

    def parents(nodes: Column) -> Column:
        last = F.ceil(F.size(nodes) / fanout).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(nodes, i * fanout + 1, fanout), ""))

    def climb(a: Column, _: Column) -> Column:
        made = parents(a.nodes)
        return F.struct(F.transform(made, lambda p: F.sha2(p, 256)).alias("nodes"), F.concat(a.preimages, F.array(made)).alias("preimages"))

    start = F.struct(F.transform("kids", lambda k: k.node).alias("nodes"), F.array().cast("array<array<string>>").alias("preimages"))
    steps = F.slice(F.array(*map(F.lit, range(depth))), F.lit(1), F.col("height"))
    rows = rows.withColumn("_c", F.aggregate(steps, start, climb))
    return rows.select("tree", "block", "left", "kids", F.col("_c.preimages").alias("preimages"), F.col("_c.nodes")[0].alias("node"))


def _tiers(nodes: DataFrame, fanout: int, depth: int, name: str) -> list[DataFrame]:
    """Tiers over nodes (tree, n, at, node, ...), all of whose other columns the first one's kids carry."""
    nodes = nodes.withColumn("height", _levels(F.col("n"), fanout)).drop("n")
    size, tiers = fanout**depth, []
    carried = [c for c in nodes.columns if c not in ("tree", "height")]
    while True:
        block = F.floor(F.col("at") / size) if not tiers else F.expr(f"at div {size}")
        rows = nodes.groupBy("tree", block.alias("block"), "height").agg(F.sort_array(F.collect_list(F.struct("at", *(c for c in carried if c != "at")))).alias("kids"))
        left = F.greatest(F.col("height") - depth, F.lit(0))
        rows = rows.withColumn("left", left).withColumn("height", F.least("height", F.lit(depth)))
        tiers.append(materialize(_climbed(rows, fanout, depth), f"merkle-{name}"))
        if not tiers[-1].where("left > 0").limit(1).count():
            return tiers
        nodes = tiers[-1].where("left > 0").select("tree", F.col("left").alias("height"), F.col("block").alias("at"), "node")
        carried = ["at", "node"]


def _finished(tiers: list[DataFrame]) -> DataFrame:
    """tree and its root."""
    out = None
    for tier in tiers:
        rows = tier.where("left = 0").select("tree", F.col("node").alias("root"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _descended(tiers: list[DataFrame], above: DataFrame, fanout: int, depth: int) -> DataFrame:
    """The kids of the first tier, each with its ``path`` (preimage and own slot by level, up to the end of the tree's own path).

    above: tree, path (beyond the tree's root) and further columns, a row for each tree.
    """
    powers = F.array(*(F.lit(fanout**k) for k in range(depth + 1)))
    constant = [c for c in above.columns if c not in ("tree", "path")]
    given = None
    for tier in reversed(tiers):
        rows = tier.where("left = 0").select("tree", F.col("block")).join(above, "tree")  # a row for each tree that ends here
        given = rows if given is None else given.unionByName(rows)
        rows = tier.join(given, ["tree", "block"])

        def path(kid: Column) -> Column:
            place = kid.at - F.col("block") * fanout**depth
            own = F.transform(
                "preimages",
                lambda p, k: F.struct(
                    F.get(p, (F.floor(place / F.element_at(powers, k + 2))).cast("int")).alias("preimage"), (F.floor(place / F.element_at(powers, k + 1)) % fanout).cast("int").alias("slot")
                ),
            )
            return F.struct(kid.alias("kid"), F.concat(own, F.col("path")).alias("path"))

        rows = rows.select("tree", *constant, F.inline(F.transform("kids", path)))
        given = rows.select("tree", *constant, F.col("kid.at").alias("block"), "path")
    return rows.select("tree", "kid.*", "path", *constant)


def build(leaves: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> Manifest:
    """leaves: tree (never null), doc_id, node (the digest) and columns that are only carried to :func:`proofs`."""
    tiers = _tiers(_ranked(leaves, ["doc_id", "node"]), fanout, depth, "tier")
    subroots = _finished(tiers).select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("node"))
    return Manifest(tiers, _tiers(_ranked(subroots, ["of"]), fanout, depth, "top"), fanout, depth)


def preimages(manifest: Manifest) -> DataFrame:
    """The stored manifest by parent: tree (null for the tree over the subroots), level from 1, parent (its place) and preimage."""
    out = None
    for stored, top in ((manifest.tiers, False), (manifest.top, True)):
        for k, tier in enumerate(stored):
            rows = tier.select("tree", "block", F.posexplode("preimages").alias("level", "made")).select("tree", "block", "level", F.posexplode("made").alias("place", "preimage"))
            wide = F.lit(manifest.fanout**manifest.depth) / F.pow(F.lit(float(manifest.fanout)), F.col("level") + 1)  # parents of that level in a block
            rows = rows.select(
                (F.lit(None).cast("string") if top else F.col("tree")).alias("tree"), (F.col("level") + 1 + k * manifest.depth).alias("level"), (F.col("block") * wide.cast("bigint") + F.col("place")).alias("parent"), "preimage"
            )
            out = rows if out is None else out.unionByName(rows)
    return out


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf's columns with subroot, root and path: by level the parent's preimage and the node's slot in it."""
    root = _finished(manifest.top).select("tree", "root")
    start = root.withColumn("path", F.array().cast("array<struct<preimage:string,slot:int>>"))
    top = _descended(manifest.top, start, manifest.fanout, manifest.depth)
    above = top.select(F.col("of").alias("tree"), F.col("node").alias("subroot"), "root", "path")
    return _descended(manifest.tiers, above, manifest.fanout, manifest.depth)


def siblings(step: Column) -> Column:
    """The preimage without the node's own characters."""
    return F.concat(step.preimage.substr(F.lit(1), step.slot * HEX), step.preimage.substr(step.slot * HEX + HEX + 1, F.length(step.preimage)))


def folded(path: Column, node: Column) -> Column:
    """The root that ``node`` leads to: on every level its digest takes the place of the old one in the preimage."""

    def splice(a: Column, step: Column) -> Column:
        return F.sha2(F.concat(step.preimage.substr(F.lit(1), step.slot * HEX), a, step.preimage.substr(step.slot * HEX + HEX + 1, F.length(step.preimage))), 256)

    return F.aggregate(path, node, splice)


def audit(docs: DataFrame, tampered: Column, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """Manifest of ``docs`` and a check of every row's proof, where rows that are ``tampered`` claim one character more.

    doc_id, leaf, subroot, root, proof_sha256 (of the original), folded_root (from the claimed leaf), verified.
    """
    more = leaf_hash(n_chars=F.col("n_chars").cast("decimal(38,0)") + 1)
    claimed = F.when(F.coalesce(tampered, F.lit(False)) & F.col("n_chars").isNotNull(), more)  # null: the leaf itself
    leaves = docs.select(tree_of(F.col("lang")).alias("tree"), "doc_id", leaf_hash().alias("node"), claimed.alias("claimed"))
    rows = proofs(build(leaves, fanout, depth))
    proof = F.sha2(F.array_join(F.transform("path", siblings), ""), 256)
    rows = rows.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded(F.col("path"), F.coalesce("claimed", "node")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def every_seventh() -> Column:
    """True where 7 divides the crc32 of the decimal id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
