"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Documents are dealt by a hash of their id into blocks of their source. The number of blocks is bounded (BLOCKS over all
sources), so the table of block sizes is small at any input size: it is collected, planned and broadcast, and documents
are never shuffled to be chosen. A source's blocks stand in a permuted order, once for each time that it may be read
whole; its quota is how many of them, from the first on, stay within its target. The tree partitions the quotas among
the output shards: each node halves its shards and draws, for every source, how many blocks go left from the multivariate
hypergeometric distribution. Each shard then draws its quota, disjoint runs of the permuted blocks, and what shards have
drawn is what is taken. Last, the block at which a target falls is filled document by document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import col, fresh

#: At most so many blocks (and one more a source), of about so many documents where there are fewer.
BLOCKS, BLOCK_DOCS = 262_144, 256
#: Sources are categories: with more than this, ``assign`` raises an error, as each takes some numbers on the driver.
MOST_SOURCES = 100_000
#: Shards that ``mixed`` makes at least, and words of a shard where that gives more of them.
LEAST_SHARDS, SHARD_WORDS = 64, 16_000_000
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words to take of each source: weights repeat over the sources by code point, null last; what exceeds ``most``
    times a source's size is shared again by weight among the others until no target is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, got = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return got | {s: left * weight[s] / total for s in open_}
        for s in full:
            got[s] = float(most * sizes[s])
        left -= sum(got[s] for s in full)
        open_ = [s for s in open_ if s not in got]
    return got


def split(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Deal ``counts[source]`` blocks to shards: a matrix of shard by source with equal row sums (to one) and exact
    column sums. A node's generator is seeded by its place, so any part of the tree can be drawn anew alone."""
    out = np.zeros((shards, len(counts)), np.int64)

    def node(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid, total = (lo + hi) // 2, int(have.sum())
        left = total * (mid - lo) // (hi - lo)
        took = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, left, method="marginals") if total else have
        node(lo, mid, took)
        node(mid, hi, have - took)

    node(0, shards, np.asarray(counts, np.int64))
    return out


def quota(words: np.ndarray, order: np.ndarray, goal: float, most: int = MOST) -> tuple[np.ndarray, int]:
    """The sequence in which a source's blocks can be drawn, ``order`` ``most`` times, and how many of its first stay within ``goal`` words."""
    sequence = np.tile(order, most)
    return sequence, int(np.searchsorted(np.cumsum(words[sequence]), goal + 1e-6, side="right"))


def _plan(blocks: pd.DataFrame, shards: int | None, seed: int) -> tuple[pd.DataFrame, int]:
    """The shards that draw each block, and what is left to fill in the block at which a target falls; how many shards there are."""
    sizes = {None if pd.isna(s) else s: int(n) for s, n in blocks.groupby("source", dropna=False)["words"].sum().items()}
    goals = targets(sizes)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [s for s in sizes if s is None]
    of = {None if pd.isna(s) else s: own.sort_values("block") for s, own in blocks.groupby("source", dropna=False, sort=False)}
    drawn, quotas = [], []
    for k, source in enumerate(order):
        words = of[source]["words"].to_numpy(np.int64)
        sequence, n = quota(words, np.random.default_rng([seed, k]).permutation(len(words)), goals[source])
        drawn.append((sequence, words))
        quotas.append(n if sizes[source] else 0)
    if shards is None:
        shards = max(LEAST_SHARDS, min(sum(quotas), int(sum(goals.values()) // SHARD_WORDS)))
    dealt = split(np.array(quotas, np.int64), shards, seed)
    rows = []
    for k, source in enumerate(order):
        sequence, words = drawn[k]
        n, shard_of = quotas[k], np.repeat(np.arange(shards), dealt[:, k])  # shard j draws the j-th run of the sequence
        own: list[list[int]] = [[] for _ in words]
        for at in range(n):
            own[sequence[at]].append(int(shard_of[at]))
        fill = np.full(len(words), -1.0)
        if n < len(sequence):
            last = int(sequence[n])
            fill[last] = goals[source] - float(words[sequence[:n]].sum())
            own[last].append(int(np.random.default_rng([seed, k, 1]).integers(shards)))
        rows += [(source, int(b), int(sizes[source]), float(goals[source]), len(s) - (f >= 0), float(f), s) for b, f, s in zip(of[source]["block"], fill, own, strict=True)]
    return pd.DataFrame(rows, columns=["source", "block", "source_size", "target", "copies", "fill", "shards"]), shards


_PLAN = T.StructType([T.StructField("source", T.StringType()), T.StructField("block", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("copies", T.IntegerType()), T.StructField("fill", T.DoubleType()), T.StructField("shards", T.ArrayType(T.IntegerType()))])


ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_shards")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, seed: int = 17) -> DataFrame:
    """All columns of ``docs`` plus ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_taken`` (words taken, repeats
    counted) and ``mix_shards`` (the shard of each copy taken).

    A document is taken 0, 1 or 2 times, whole, however long. Sources are categories: some numbers of each reach the
    driver, as do the bounded block sizes, and more than MOST_SOURCES are an error. Null text has size 0; null is a source
    of its own; rows that repeat an id fall in one block and count each. Reruns agree. An empty table gives an empty
    result. Columns may have any names: an added one whose name is taken gets underscores behind it. ``shards``: how many
    shards there are, else as many as the mix's words ask for.
    """
    return _assigned(docs, id_col, text_col, source_col, shards, seed)[0]


def _assigned(docs: DataFrame, id_col: str, text_col: str, source_col: str, shards: int | None, seed: int) -> tuple[DataFrame, int]:
    spark, added = docs.sparkSession, fresh(docs.columns, *ADDED)
    key = F.xxhash64(F.lit(seed), col(id_col).cast("string"))
    sized = docs.select(F.struct(*map(col, docs.columns)).alias("row"), col(source_col).cast("string").alias("source"), n_words(col(text_col)).alias("size"), key.alias("key"))
    cells = sized.groupBy("source").agg(F.count("*").alias("docs"))
    coarse = cells.limit(MOST_SOURCES + 1).toPandas()
    if len(coarse) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    each = max(BLOCK_DOCS, -(-max(1, int(coarse["docs"].sum())) // BLOCKS))
    n_blocks = [(None if pd.isna(s) else s, max(1, int(d) // each)) for s, d in zip(coarse["source"], coarse["docs"], strict=True)]
    count_rows = spark.createDataFrame(n_blocks, "of string, blocks long")
    blocked = sized.join(F.broadcast(count_rows), F.col("source").eqNullSafe(F.col("of"))).select("row", "source", "size", "key", F.pmod("key", "blocks").alias("block"))
    blocks = blocked.groupBy("source", "block").agg(F.sum("size").alias("words")).toPandas()
    planned, n_shards = _plan(blocks, shards, seed) if len(blocks) else (pd.DataFrame(), 1)
    planned = planned.astype(object).where(lambda x: x.notna(), None).values.tolist()
    plan = spark.createDataFrame(planned, _PLAN).withColumnsRenamed({"source": "of", "block": "of_block"})
    met = blocked.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block"))).drop("of", "of_block", "block")

    # at most one block of each source is filled document by document: they are few, and only they meet this join
    filled = met.filter("fill >= 0").select("source", "key", "size", "fill").groupBy("source").applyInPandas(_fill, "fill_source string, fill_key long")
    taken = lambda copies: ["row", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), F.slice("shards", F.lit(1), copies.cast("int")).alias("shards")]
    whole = met.filter("fill < 0").select(*taken(F.col("copies")))
    some = met.filter("fill >= 0").join(filled, F.col("source").eqNullSafe(F.col("fill_source")) & (F.col("key") == F.col("fill_key")), "left")
    some = some.select(*taken(F.col("copies") + F.col("fill_key").isNotNull().cast("int")))
    names = zip(("size", "source_size", "target", "taken", "shards"), added, strict=True)
    return whole.unionByName(some).select("row.*", *[F.col(c).alias(a) for c, a in names]), n_shards


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """The documents of a source's last block that are taken once more: in hash order, each that still fits."""
    left, rows = float(pdf["fill"].iloc[0]) if len(pdf) else 0.0, []
    for key, own in pdf.sort_values("key").groupby("key", sort=False):
        size = int(own["size"].sum())
        if 0 < size <= left:
            left -= size
            rows.append((pdf["source"].iloc[0], key))
    return pd.DataFrame(rows, columns=["fill_source", "fill_key"]).astype({"fill_key": "int64"})


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, seed: int = 17) -> DataFrame:
    """The mix itself: rows of ``docs``, repeated as often as they are taken, a partition a shard and shuffled within it.

    Parameters and the cases of nulls, repeated rows, empty tables and column names are those of ``assign``.
    """
    of, spot = fresh(docs.columns, *ADDED, "mix_shard")[-2:]
    taken, n = _assigned(docs, id_col, text_col, source_col, shards, seed)
    each = taken.withColumn(spot, F.explode(col(of)))
    order = F.xxhash64(F.lit(seed + 1), col(id_col).cast("string"))
    return each.repartitionById(n, col(spot)).sortWithinPartitions(col(spot), order).select(*map(col, docs.columns))
