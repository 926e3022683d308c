"""What the corpus operators share: shared-folder tables, bounded bitmaps, row filters, graph components and tidy workers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a broadcast bitmap: sized from its keys between these, so it has half a megabyte to 32 MB at any input size.
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 28
_ROW_BITS = 32768
#: Keys with more rows than this, and than a share of all rows, are joined by broadcast: HUBS of them at most.
HUB_ROWS, HUBS = 256, 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("veilspark.shared.dir", None)
    if not path:
        if not conf.get("spark.master", "").startswith("local") or conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("veilspark.shared.dir", path)
    return path


def cut(df: DataFrame, tag: str, scratch: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that reads it: lineage ends here and survives lost executors.

    ``scratch`` gets the path of a table that is no longer needed once what is made of it has been written as well.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilspark/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, scratch: list[str]) -> None:
    """Delete the tables at these paths, and forget the paths."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while scratch:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch.pop())
        path.getFileSystem(conf).delete(path, True)


def quoted(name: str) -> str:
    """A column's name as it must be written in an expression, also where it holds dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Each of ``names`` with as many underscores behind it as set it apart from the columns ``taken``."""
    used, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def bitmap_bits(keys: int) -> int:
    """Bits for a bitmap of so many keys: eight each, so one in eight other rows hits it, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, 8 * keys - 1).bit_length()))


def bitmap_of(keys: DataFrame, key: Column, bits: int = LEAST_BITS) -> DataFrame:
    """One row per 32768 slots: the set of slots hit by ``key`` hashes. At most bits / 32768 rows of 4 KB."""
    slot = F.pmod(key, F.lit(bits))
    return (
        keys.select(slot.alias("slot"))
        .groupBy((F.col("slot") / _ROW_BITS).cast("int").alias("bm_row"))
        .agg(F.bitmap_construct_agg((F.col("slot") % _ROW_BITS).cast("long")).alias("bm_bits"))
    )


def with_hit(df: DataFrame, bitmap: DataFrame, key: Column, name: str, bits: int = LEAST_BITS) -> DataFrame:
    """Add boolean ``name``: False when ``key`` is surely not in the bitmap. The broadcast side has a fixed size bound."""
    row, data = fresh([*df.columns, name], "bm_row", "bm_bits")
    slot = F.pmod(key, F.lit(bits))
    pos = F.pmod(slot, F.lit(_ROW_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(data), (pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.shiftright(byte, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), pos % 8 + 1)) != 0
    return (
        df.withColumn(row, (slot / _ROW_BITS).cast("int"))
        .join(F.broadcast(bitmap.toDF(row, data)), row, "left")
        .select(*map(col, df.columns), F.coalesce(bit, F.lit(False)).alias(name))
    )


def keyed_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a long key of each row, written so that it stays the same, and that column's name."""
    (key,) = fresh(docs.columns, "veil_row")
    return cut(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def drop_rows(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` of ``keyed_rows`` without those whose keys are in the only column of ``gone``, and without the key.

    Only rows that the bitmap suspects are shuffled: those that go, and an eighth of the others at most up to 33 million keys.
    """
    own = [c for c in rows.columns if c != key]
    maybe, key_gone = fresh(rows.columns, "maybe_gone", "key_gone")
    out = cut(gone.toDF(key_gone), "gone")
    bits = bitmap_bits(out.count())
    flagged = with_hit(rows, bitmap_of(out, F.xxhash64(col(key_gone)), bits), F.xxhash64(col(key)), maybe, bits)
    suspects = flagged.filter(col(maybe)).join(out, col(key) == col(key_gone), "left_anti")
    return flagged.filter(~col(maybe)).select(*map(col, own)).unionByName(suspects.select(*map(col, own)))


def meet(rows: DataFrame, key: str, table: DataFrame, of: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to the one row of ``table`` whose ``of`` is their ``key``; ``n`` tells how many rows that is, of ``total`` in all.

    Keys of many rows, HUBS of them at most, are met by broadcast; in the join of the others their rows have no key, but
    each a number of its own, so that no task gets all rows of one.
    """
    least = max(HUB_ROWS, total // HUBS)
    if total <= least:
        return rows.join(table, col(key) == col(of), how)
    other, hot_of = table.columns, f"hot_{of}"
    dealt, zero = fresh([*rows.columns, *other], "dealt", "zero")
    hot = table.filter(col(n) > least).toDF(*[f"hot_{c}" for c in other])
    flagged = rows.join(F.broadcast(hot), col(key) == col(hot_of), "left")
    spread = F.when(col(hot_of).isNull(), 0).otherwise(F.pmod(F.xxhash64(*map(col, rows.columns)), F.lit(1 << 20)) + 1)
    met = flagged.withColumn(dealt, spread).join(table.withColumn(zero, F.pmod(col(n), F.lit(1)).cast("long")), (F.when(col(hot_of).isNull(), col(key)) == col(of)) & (col(dealt) == col(zero)), "left")
    told = met.select(*map(col, rows.columns), *[F.coalesce(col(f"hot_{c}"), col(c)).alias(c) for c in other])
    return told if how == "left" else told.filter(col(of).isNotNull())


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: returns ``(node, comp)``, comp the smallest node of each component.

    Alternating large-star and small-star rounds until nothing moves. Neighbours are combined before each shuffle, and
    the edges of hubs meet their minimum by broadcast.
    """
    spark, scratch, old = edges.sparkSession, [], []
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag, scratch)

    def lowest(own: DataFrame, both: DataFrame, total: int) -> DataFrame:
        """``own(u, v)`` with ``m``, the smallest neighbour of ``u`` in ``both`` or itself."""
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"), "n")
        return meet(own, "u", low, "w", "n", total).select("u", "v", "m")

    now, before = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head(), None
    while now != before:
        before, old, scratch = now, scratch, []
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = lowest(both.filter("v > u"), both, 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = lowest(large, large, 2 * now[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        e = cut(small.select("p.u", "p.v").filter("u <> v").distinct(), tag, scratch)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        remove(spark, old)
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")))
    return ends.groupBy("node").agg(F.min("comp").alias("comp"))


def release() -> None:
    """Give memory that is free back to the system, as workers are reused by what runs next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Batches, *forget: Callable[[], None]) -> Batches:
    """``run``, after which a worker calls ``forget`` and holds no more memory than before it."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in run(batches):
                yield batch
                del batch
        finally:
            for f in forget:
                f()
            release()

    return tidied
