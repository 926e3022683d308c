"""Spans on a stream: detection is stateless; counts by event time carry a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.scan import exploded
from veilspark.plans.engine import Analyzer


def entity_counts(stream: DataFrame, analyzer: Analyzer, text_col: str, ts_col: str, window: str = "1 day", late: str = "1 hour", **options) -> DataFrame:
    """``(window_start, entity_type, n)`` of a batch or streaming frame with an event time."""
    spans = stream.withWatermark(ts_col, late) if stream.isStreaming else stream
    found = exploded(analyzer.analyze(spans, text_col, **options), "spans", F.col(ts_col).alias("ts"))
    return found.groupBy(F.window("ts", window).alias("w"), F.col("s.entity_type").alias("entity_type")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "entity_type", "n")
