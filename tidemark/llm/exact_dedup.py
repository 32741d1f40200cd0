"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Rows with the same digest are combined in three steps: inside each input partition (the map side of the
first aggregation), then per digest and salt, then over the salts of a digest. The whole text is a
grouping key in every step, so two texts that share a digest are never merged. A group of copies of any
size reaches the second step as at most one row per partition and salt, and the third as one per salt.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays; a
null doc_id is smaller than any other; rows repeated with the same doc_id count in ``group_size`` and
share their verdict in :func:`copy_groups`, while :func:`drop_copies` returns one row of each group
(among rows with equal doc_id the one with the largest hash of all its columns). Other columns are ignored by
:func:`copy_groups`, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, whole_text

SALTS = 16


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _combined(rows: DataFrame, keep: Column, salts: int) -> DataFrame:
    """(digest, text, keep, group_size) of rows (digest, text, salt source columns)."""
    salted = rows.groupBy("digest", "salt", "text").agg(keep.alias("keep"), F.count(F.lit(1)).alias("n"))
    # one partitioning by digest serves the last merge and whatever looks at all texts of a digest
    return salted.repartition("digest").groupBy("digest", "text").agg(F.max("keep").alias("keep"), F.sum("n").alias("group_size"))


def copy_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("digest", digest(F.col("text")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    texts = F.count(F.lit(1)).over(Window.partitionBy("digest"))
    winners = materialize(
        _combined(salted, F.max("doc_id"), salts).select(
            "digest", F.when(texts > 1, F.col("text")).alias("text"), F.col("keep").alias("keep_id"), "group_size"
        ),
        "copy-winners",
    )
    out = rows.drop("text").withColumn("text_sha256", F.lower(F.hex("digest"))) if digest is sha256_digest else rows.select("doc_id", "digest", F.sha2("text", 256).alias("text_sha256"))
    alone = winners.where(F.col("text").isNull()).drop("text")
    found = out.join(alone, "digest")
    shared = winners.where(F.col("text").isNotNull())
    if not shared.isEmpty():  # different texts under one digest: those rows are matched by their text as well
        found = found.unionByName(rows.withColumn("text_sha256", F.sha2("text", 256)).join(shared, ["digest", "text"]).drop("text"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row of each group of equal texts, with all columns of ``docs``, whatever their names and types.

    Only ids are compared, and a hash of the other columns among rows with the same id: the same row stays at every run.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    whole = F.struct(F.col("doc_id"), F.col("text"), *(F.col(f"`{c}`") for c in rest))
    rows = docs.select(
        sha256_digest(whole_text()).alias("digest"),
        whole_text().alias("text"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"),
        F.struct(F.col("doc_id").alias("id"), F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256).alias("hash")).alias("place"),
        F.col("text").isNotNull().alias("held"),
        F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest))).alias("row"),
    )
    kept = F.max_by(F.struct("place", "held", "row"), F.col("place"))
    salted = rows.groupBy("digest", "salt", "text").agg(kept.alias("keep"))
    won = salted.repartition("digest").groupBy("digest", "text").agg(F.max_by("keep", F.col("keep.place")).alias("keep"))
    columns = {c: F.col("keep.row")[f"c{k}"].alias(c) for k, c in enumerate(rest)}
    columns["doc_id"] = F.col("keep.place.id").alias("doc_id")
    columns["text"] = F.when(F.col("keep.held"), F.col("text")).alias("text")
    return won.select(*(columns[c] for c in docs.columns))
