"""Small tables over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tables of fewer bytes than this, as the optimizer sees them, are dealt out anew.
SMALL = 64 << 20


def spread(df: DataFrame, small: int = SMALL) -> DataFrame:
    """``df`` dealt out over all cores if it is small: a small file often has one row group, so one task would do all the
    row-wise work, which costs far more than moving such a table once. Larger tables have row groups enough and stay."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < small else df
