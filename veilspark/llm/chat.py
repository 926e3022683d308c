"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Logs often hold a conversation again each time it grows. Each conversation's turns get rolling hashes: the hash of turns
1..k is made from the one of 1..k-1 and turn k. A conversation whose last rolling hash is an inner one of another is a
snapshot of it; an anti-join on (length, hash) leaves the maximal ones, and of equal ones the smallest id. Only hashes
are grouped before that; the texts of the conversations that stay are shuffled once, to be rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import col, cut


def _turn(role_col: str, text_col: str) -> tuple[Column, Column]:
    return F.coalesce(col(role_col).cast("string"), F.lit("unknown")), F.coalesce(col(text_col).cast("string"), F.lit(""))


def snapshots(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Return ``(conv_id, n_turns, last, rolling)``: rolling hashes of each conversation's turns in order."""
    role, text = _turn(role_col, text_col)
    hashed = turns.select(col(conv_col).alias("conv_id"), F.struct(col(turn_col).alias("turn"), F.md5(F.concat(F.md5(role), F.md5(text))).alias("h")).alias("t"))
    # an identical row given twice is one turn; collect_set does that before the shuffle as well
    each = hashed.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    empty = F.array().cast("array<string>")
    rolling = F.aggregate("ts", empty, lambda acc, t: F.concat(acc, F.array(F.md5(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), t["h"])))))
    return each.select("conv_id", F.size("ts").alias("n_turns"), rolling.alias("rolling")).select("conv_id", "n_turns", F.try_element_at("rolling", F.lit(-1)).alias("last"), "rolling")


def maximal(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Return ``(conv_id, n_turns, copies)`` of the conversations that are no prefix of a longer one; of equal ones the
    smallest id stands for all ``copies``."""
    logged = cut(snapshots(turns, conv_col, turn_col, role_col, text_col), "snapshots")
    inner = logged.select(F.posexplode(F.slice("rolling", F.lit(1), F.col("n_turns") - 1)).alias("k", "last")).select((F.col("k") + 1).alias("n_turns"), "last").distinct()
    alike = logged.groupBy("n_turns", "last").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    return alike.join(inner, ["n_turns", "last"], "left_anti").select("conv_id", "n_turns", "copies")


def render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Return ``(conv_id, n_turns, copies, rendered)`` for each maximal conversation.

    A turn is ``<|role|>``, its text and ``<|end|>``, each but the text on its own line. A null role is ``unknown``, a
    null text empty; a null turn number comes first, and turns that share a number follow by role, then text hash. Rows
    that repeat a turn exactly count once. Rows with a null conversation form one. Texts of any length are rendered whole.
    Other columns are not read, so they may have any names; an empty table gives an empty result.
    """
    role, text = _turn(role_col, text_col)
    stay = cut(maximal(turns, conv_col, turn_col, role_col, text_col), "maximal")
    rows = turns.select(col(conv_col).alias("turn_conv"), F.struct(col(turn_col).alias("turn"), F.md5(F.concat(F.md5(role), F.md5(text))).alias("h"), role.alias("role"), text.alias("text")).alias("t"))
    kept = rows.join(stay, F.col("turn_conv").eqNullSafe(F.col("conv_id")))
    parts = F.transform(F.array_sort(F.collect_set("t")), lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n<|end|>\n")))
    return kept.groupBy("conv_id").agg(F.first("n_turns").cast("long").alias("n_turns"), F.first("copies").alias("copies"), F.array_join(parts, "").alias("rendered"))
