"""Long texts in overlapping pieces, and spans found in the pieces back at their place in the text.

All of it stays in the row: pieces are an array, so a chunked text is analyzed by the same expressions as a whole one,
or exploded to spread a very long document over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.scan import NO_SPANS, let, matches

CHUNKS = "array<struct<text:string,start:int,end:int>>"


def _checked(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a chunk has a positive size and a smaller overlap that isn't negative")


def _piece(text: Column, start: Column, end: Column) -> Column:
    return F.struct(F.substr(text, start + 1, end - start).alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def by_characters(text: Column, size: int = 250, overlap: int = 50, boundaries: str = " \n") -> Column:
    """Pieces of ``size`` code points, each stretched to the next boundary character (or the end of the text). The next
    one begins at the first boundary from ``overlap`` before that end on. Null and empty texts have no pieces."""
    _checked(size, overlap)
    if not boundaries:
        raise ValueError("at least one boundary character is needed")
    text, mark = F.coalesce(text, F.lit("")), F.lit(boundaries[0])

    def pieces(marked: Column) -> Column:
        n = F.length(marked)
        # the offset of the first boundary at or after ``at``, else the length
        edge = lambda at: F.coalesce(F.nullif(F.call_function("locate", mark, marked, at + 1), F.lit(0)) - 1, n)

        def step(acc: Column, _: Column) -> Column:
            end = F.when(acc["at"] + size >= n, n).otherwise(edge(acc["at"] + size))
            more = let(end, lambda e: F.struct(F.when(e < n, F.least(edge(e - overlap), e)).otherwise(n).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), e.alias("end")))).alias("out")))
            return F.when(acc["at"] < n, more).otherwise(acc)

        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        # each piece moves the start by size - overlap at least
        turns = F.sequence(F.lit(0), F.ceil(n / (size - overlap)).cast("int"))
        return F.aggregate(turns, first, step, lambda acc: acc["out"])

    found = let(F.translate(text, boundaries, boundaries[0] * len(boundaries)), pieces)
    return F.when(F.length(text) > 0, F.transform(found, lambda p: _piece(text, p["start"], p["end"]))).otherwise(F.array().cast(CHUNKS))


def by_tokens(text: Column, size: int = 256, overlap: int = 32, token: str = r"\S+") -> Column:
    """Pieces of ``size`` tokens, each beginning ``overlap`` tokens before the last one's end, from the first token's
    start to the last one's end. ``token`` is a pattern that doesn't match nothing; texts without a token have no pieces."""
    _checked(size, overlap)
    text = F.coalesce(text, F.lit(""))

    def pieces(found: Column) -> Column:
        n = F.size(found)

        def piece(i: Column) -> Column:
            first, last = F.element_at(found, i + 1)["start"], F.element_at(found, F.least(i + size, n))["end"]
            return _piece(text, first, last)

        starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
        return F.when(n > 0, F.transform(starts, piece)).otherwise(F.array().cast(CHUNKS))

    return let(matches(text, token), pieces)


CHUNKERS: dict[str, Callable[..., Column]] = {"character": by_characters, "token": by_tokens}


def chunks(text: Column, kind: str = "character", **options) -> Column:
    if kind not in CHUNKERS:
        raise ValueError(f"unknown chunker {kind!r}")
    return CHUNKERS[kind](text, **options)


def without_repeats(spans: Column, share: float = 0.5) -> Column:
    """Of spans of one type that share more than ``share`` of the shorter one's length, the one with the best score
    (then the earlier given) stays. In order of start."""

    def step(kept: Column, p: Column) -> Column:
        s = p["s"]

        def same(k: Column) -> Column:
            both = F.least(s["end"], k["end"]) - F.greatest(s["start"], k["start"])
            short = F.least(s["end"] - s["start"], k["end"] - k["start"])
            return (s["entity_type"] == k["entity_type"]) & (both > 0) & (short > 0) & (both > short * share)

        return F.when(F.exists(kept, same), kept).otherwise(F.concat(kept, F.array(s)))

    ranked = F.array_sort(F.transform(spans, lambda s, i: F.struct((-s["score"]).alias("r"), i.alias("i"), s.alias("s"))))
    kept = F.aggregate(ranked, F.array().cast(NO_SPANS), step)
    return F.transform(F.array_sort(F.transform(kept, lambda s, i: F.struct(s["start"].alias("a"), i.alias("i"), s.alias("s")))), lambda p: p["s"])


def predict(pieces: Column, found: Callable[[Column], Column], share: float = 0.5) -> Column:
    """Spans that ``found`` (text to ``array<span>``) sees in each piece, at their place in the whole text, once each."""

    def moved(c: Column) -> Column:
        return F.transform(found(c["text"]), lambda s: F.struct(s["entity_type"].alias("entity_type"), (s["start"] + c["start"]).alias("start"), (s["end"] + c["start"]).alias("end"), s["score"].alias("score"), s["recognizer"].alias("recognizer")))

    return without_repeats(F.flatten(F.transform(pieces, moved)), share)


def explode_chunks(df: DataFrame, text_col: str = "text", kind: str = "character", **options) -> DataFrame:
    """One row a piece: the columns of ``df`` but the text, and ``chunk``, ``chunk_text``, ``chunk_start``, ``chunk_end``."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    found = df.select(*rest, F.posexplode(chunks(F.col(text_col), kind, **options)).alias("chunk", "c"))
    return found.select(*rest, "chunk", F.col("c.text").alias("chunk_text"), F.col("c.start").alias("chunk_start"), F.col("c.end").alias("chunk_end"))
