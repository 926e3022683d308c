"""Exact deduplication by progressive refinement, with DataFrame functions only.

Length and prefix hash are one composite key, so both levels cost a single partially aggregated shuffle of two
numbers. The keys that occur more than once go into a bitmap sized from their number (32 MB at most), which is broadcast:
only rows that hit it are hashed in full, and no text is ever shuffled. A false hit costs one hash and changes nothing,
since the last level groups by the SHA-256 of the whole normalised text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import bitmap_bits, bitmap_of, col, cut, drop_rows, keyed_rows, meet, remove, with_hit

PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """Return ``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per input row.

    Texts are equal when identical after each run of ASCII white space becomes one space. Of equal texts the smallest
    id stays. Null text counts as empty. Rows that repeat an id share its decision; a null id is chosen only when the
    group has no other, and is reported as it is. ``text_sha256`` is null where no full hash was needed, unless
    ``digest_all``. Texts of any length are compared whole. Other columns of the input are not read, so they may have
    any names; an empty table gives an empty result.
    """
    base = docs.select(col(id_col).alias("doc_id"), normalised(col(text_col)).alias("norm"))
    key = F.xxhash64(F.length("norm"), F.substring("norm", 1, PREFIX_CHARS))
    levels = base.select(F.length("norm").alias("n"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("ph"), key.alias("key"))
    alive = levels.groupBy("n", "ph").agg(F.count("*").alias("c"), F.first("key").alias("key")).filter("c > 1").select("key")
    scratch: list[str] = []
    alive = cut(alive, "alive", scratch)
    bits = bitmap_bits(alive.count())
    flagged = with_hit(base.withColumn("key", key), bitmap_of(alive, F.col("key"), bits), F.col("key"), "alive", bits)
    full = F.sha2(F.col("norm"), 256)
    hashed = cut(flagged.select("doc_id", "alive", (full if digest_all else F.when(F.col("alive"), full)).alias("text_sha256")), "exact")
    remove(docs.sparkSession, scratch)
    seen = hashed.filter("alive")
    groups = seen.groupBy(F.col("text_sha256").alias("of")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    cols = [
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
        "text_sha256",
    ]
    lone = hashed.filter("not alive").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1)})
    return meet(seen, "text_sha256", groups, "of", "group_size", seen.count(), "left").select(*cols).unionByName(lone.select(*cols))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each group of equal texts.

    It is the one with the smallest id, null last, and of rows that share both id and text the first one. Null text
    counts as empty, so of all null and empty texts one row stays. Columns may have any names; an empty table stays empty.
    """
    rows, key = keyed_rows(docs)
    own = F.struct(col(id_col).isNull().alias("none"), col(id_col).alias("id"), col(key).alias("row"))
    told = exact_dedup(rows.select(own.alias("id"), col(text_col).alias("text")), "id", "text")
    return drop_rows(rows, key, told.filter("not kept").select("doc_id.row"))
