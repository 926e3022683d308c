"""Near-duplicate documents: fast similarity sketching, banding and exact verification.

Sketch: round ``i`` throws every shingle into one of ``t`` bins with value ``i + hash``; bins keep their minimum. Rounds
``t .. 2t-1`` throw everything into bin ``i - t``, so every coordinate fills. A document leaves once all bins are full,
so a set of n shingles costs about ``n + t log t`` hashes, and the share of equal coordinates concentrates around the
Jaccard similarity as for independent MinHash.

Banding: ``bands`` keys of ``rows`` coordinates. At similarity 0.75 a pair misses all 40 bands of 5 with probability
2e-5. Equal sets become one class before banding, so exact copies cost one row each. Within a bucket pairs are not
enumerated: members are first verified against two anchors and verified links are contracted to components. Members
of buckets that still hold several components then go through prefix filtering: with shingles ordered by rising
frequency, linked sets of n shingles must share one of their first ``n - ceil(0.75 n) + 1``, and what follows the first
shared one must suffice, so passages that many documents share bring no pair together. The anchors of a bucket are
its first node and its member with the most company over all buckets, as an original among its copies has. No candidate is dropped: each pair that shares a bucket is in one component,
was verified to be no link, or is ruled out by that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from veilspark.llm import words
from veilspark.llm.common import bitmap_bits, bitmap_of, col, components, cut, drop_rows, keyed_rows, meet, remove, tidy, with_hit

SHINGLE, BANDS, ROWS = 5, 40, 5
#: A pair is verified when its sketches agree in at least this share of coordinates: six standard deviations
#: (0.031 at 200 coordinates) below 0.75.
LEAST_AGREEMENT = 0.56
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and the text of each. A short text is one shingle."""
    h, at = words.word_hashes(texts)
    count = np.diff(at)
    doc = np.repeat(np.arange(len(count)), count)
    if not len(h):
        return h, doc
    shingle = np.zeros(len(h), np.uint64)
    for k in range(width):
        part = np.zeros(len(h), np.uint64)
        part[: len(h) - k] = h[k:]
        part[np.arange(len(h)) + k >= at[doc + 1]] = 0  # words beyond the text's end count as nothing
        shingle = words.mix(shingle * np.uint64(0xD6E8FEB86659FD93) + part + np.uint64(k + 1))
    place = np.arange(len(h)) - at[doc]
    whole = (place + width <= count[doc]) | ((place == 0) & (count[doc] < width))
    shingle, doc = shingle[whole], doc[whole]
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    first = np.ones(len(doc), bool)
    first[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    return shingle[first], doc[first]


def sketch(x: np.ndarray, doc: np.ndarray, n_docs: int, t: int) -> np.ndarray:
    """The ``t`` coordinates of each document's set. Rows of empty sets hold the largest value."""
    bins = np.full(n_docs * t, _FULL)
    for i in range(2 * t):
        if not len(x):
            break
        h = words.mix(x + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        spot = ((h >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64) if i < t else i - t
        np.minimum.at(bins, doc * t + spot, (h & np.uint64((1 << 40) - 1)) | np.uint64(i << 40))
        if i < 4 or i % 8 == 0 or i >= t:
            open_ = (bins.reshape(n_docs, t) == _FULL).any(axis=1)
            left = open_[doc]
            if not left.all():
                x, doc = x[left], doc[left]
    return bins.reshape(n_docs, t)


def _set_key(x: np.ndarray, doc: np.ndarray, n_docs: int, count: np.ndarray) -> list[bytes]:
    """16 bytes that equal sets share: two independent sums over the set."""
    out = np.zeros((n_docs, 2), np.uint64)
    at = np.concatenate([[0], np.cumsum(count)])
    for k, seed in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(words.mix(x ^ np.uint64(seed)), out=sums[1:])
        out[:, k] = words.mix(sums[at[1:]] - sums[at[:-1]] + count.astype(np.uint64))
    return [row.tobytes() for row in out]


def _sketches(bands: int, rows: int, width: int):
    t = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in words.chunks(texts):
                x, doc = shingle_sets(texts.slice(lo, hi - lo), width)
                count = np.bincount(doc, minlength=hi - lo)
                coords = sketch(x, doc, hi - lo, t)
                key = np.zeros((hi - lo, bands), np.uint64)
                for r in range(rows):
                    key = words.mix(key * np.uint64(0xD6E8FEB86659FD93) + coords[:, r::rows] + np.uint64(r))
                key = words.mix(key + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
                flat = pa.array(key.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), flat)
                sig = [row.tobytes() for row in (words.mix(coords) & np.uint64(0xFFFF)).astype("<u2")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(count.astype(np.int64)), pa.array(_set_key(x, doc, hi - lo, count), pa.binary()), lists, pa.array(sig, pa.binary())],
                    ["doc_id", "n_shingles", "set_key", "band_keys", "sig"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in words.chunks(texts):
                x, doc = shingle_sets(texts.slice(lo, hi - lo), width)
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                sets = [x[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(_set_key(x, doc, hi - lo, np.diff(at)), pa.binary()), pa.array(sets, pa.binary())], ["set_key", "shingles"])

    return run


def _agree(least: float):
    """Keep pairs whose sketches agree enough to be worth an exact look."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a == b).mean(axis=1) >= least))

    return run


def _linked(percent: int):
    """The exact test on full sets: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.intersect1d(a, b, assume_unique=True).size
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp, shingles) to one row per shingle."""
    for batch in batches:
        for i in range(batch.num_rows):
            x = np.frombuffer(batch.column(2)[i].as_buffer(), np.int64)
            node, comp = (np.full(len(x), batch.column(k)[i].as_py(), np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (node, comp, np.full(len(x), len(x), np.int64), x)], ["node", "comp", "n", "shingle"])


def _prefix_pairs(mixed: DataFrame, sets: DataFrame, percent: int, scratch: list[str]) -> DataFrame:
    """Pairs of ``mixed(node, comp)`` in different components that share a shingle of their prefixes."""
    rows = cut(sets.join(mixed, "node").select("node", "comp", "shingles").mapInArrow(tidy(_exploded), "node long, comp long, n long, shingle long"), "shingles", scratch)
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"))
    order = Window.partitionBy("node").orderBy("often", "shingle")
    prefix = rows.join(often, "shingle").withColumn("place", F.row_number().over(order))
    prefix = prefix.filter(f"often > 1 and place <= n - ceil(n * {percent} / 100) + 1").select("shingle", "node", "comp", "n", (F.col("n") - F.col("place") + 1).alias("rest"))
    prefix = cut(prefix, "prefix", scratch)
    right = prefix.select("shingle", F.col("node").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"))
    left = prefix.select("shingle", F.col("node").alias("a"), F.col("comp").alias("comp_a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"))
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    # at a pair's first shared shingle no more than what is left of the smaller remainder can be shared
    enough = F.least("rest_a", "rest_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    return left.join(right, "shingle").filter((F.col("comp_a") < F.col("comp_b")) & sizes & enough).select("a", "b")


def _verified(pairs: DataFrame, cand: DataFrame, sets: DataFrame, percent: int, tag: str, scratch: list[str]) -> DataFrame:
    """The links among ``pairs(a, b)``: sizes and sketch agreement first, then the sets of what is left."""
    side_a = cand.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    side_b = cand.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    close = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    likely = once.join(side_a, "a").join(side_b, "b").filter(close).select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(_agree(LEAST_AGREEMENT)), "a long, b long")
    set_a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    set_b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    both = likely.join(set_b, "b").join(set_a, "a").select("a", "b", "set_a", "set_b")
    return cut(both.mapInArrow(tidy(_linked(percent)), "a long, b long"), tag, scratch)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Return ``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    Two documents are linked when 100 * intersection >= percent * union of their sets of ``width``-word shingles (a
    text of fewer words is one shingle; one without words is an empty set, linked with nothing). ``component_id`` is the
    smallest id reachable by links. Null text is empty; texts of any length are read whole. Rows that repeat an id are
    reported each, by their own text. A null id links with nothing and is its own, null, component, kept. Other columns
    are not read, so they may have any names; an empty table gives an empty result.
    """
    source = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    sketched = source.mapInArrow(tidy(_sketches(bands, rows, width)), "doc_id long, n_shingles long, set_key binary, band_keys array<long>, sig binary")
    table = cut(sketched.withColumn("row", F.monotonically_increasing_id()), "sketch")
    real = table.filter("n_shingles > 0 and doc_id is not null")
    # equal sets are one node, known by a number of its own and represented by the row with the smallest id
    first = real.groupBy("set_key").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("copies"))
    classes = cut(first.select("set_key", "copies", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("row"), F.monotonically_increasing_id().alias("node")), "classes")
    reps = real.select("row", "n_shingles", "band_keys", "sig").join(classes.select("row", "node"), "row")
    scratch: list[str] = []
    by_band = reps.select("node", F.explode("band_keys").alias("bucket"))
    crowded = by_band.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size")).filter("lo < hi").select("bucket", "size")
    members = cut(by_band.join(crowded, "bucket").distinct(), "buckets", scratch)

    company = cut(members.groupBy("node").agg(F.sum("size").alias("company")), "company", scratch)
    members = cut(members.select("bucket", "node").join(company, "node"), "members", scratch)
    wanted = cut(classes.join(company.select("node"), "node", "left_semi").select("node", "set_key", "rep"), "wanted")
    cand = cut(reps.join(wanted.select("node"), "node", "left_semi").select("node", F.col("n_shingles").alias("n"), "sig"), "sigs", scratch)
    bits = bitmap_bits(wanted.count())
    again = with_hit(source, bitmap_of(wanted, F.xxhash64("rep"), bits), F.xxhash64("doc_id"), "hit", bits).filter("hit").select("text")
    sets = cut(again.mapInArrow(tidy(_sets(width)), "set_key binary, shingles binary").join(wanted.select("node", "set_key"), "set_key").select("node", "shingles").dropDuplicates(["node"]), "sets", scratch)

    def labelled(links: DataFrame, step: str, made: list[str] | None = None) -> DataFrame:
        return cut(wanted.select("node").join(components(links, f"comp-{step}"), "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), f"labels-{step}", made)

    central = F.max_by("node", F.struct("company", "node")).alias("central")
    anchors = members.groupBy("bucket").agg(F.min("node").alias("low"), central)
    pairs = members.join(anchors, "bucket").select(F.col("node").alias("b"), F.explode(F.array("low", "central")).alias("a")).filter("a <> b")
    links = _verified(pairs, cand, sets, percent, "links-anchors", scratch)
    known = members.join(labelled(links, "anchors", scratch), "node").select("bucket", "node", "comp")
    split = known.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("bucket")
    mixed = cut(known.join(split, "bucket", "left_semi").select("node", "comp").distinct(), "mixed", scratch)
    links = links.unionByName(_verified(_prefix_pairs(mixed, sets, percent, scratch), cand, sets, percent, "links-rest", scratch))
    labels = labelled(links, "rest").join(wanted, "node")
    remove(docs.sparkSession, scratch)

    lowest = labels.groupBy("comp").agg(F.min("rep").alias("component"), F.count("*").alias("n")).filter("n > 1").select("comp", "component")
    # a class that stands for itself only, and is no copy, needs no look-up
    linked = labels.join(lowest, "comp").select(F.col("set_key").alias("moved_key"), "component")
    moved = classes.join(linked, F.col("set_key") == F.col("moved_key"), "left").filter("copies > 1 or component is not null").select(F.col("set_key").alias("of"), "copies", F.coalesce("component", "rep").alias("comp"))
    own: Column = F.col("doc_id")
    told = lambda comp: ["doc_id", "n_shingles", comp.alias("component_id"), own.eqNullSafe(comp).alias("kept")]
    met = meet(real.select("doc_id", "n_shingles", "set_key"), "set_key", moved, "of", "copies", table.count(), "left").select(*told(F.coalesce("comp", own)))
    return met.unionByName(table.filter("n_shingles = 0 or doc_id is null").select(*told(own)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that represent their component, with all their columns.

    Each row is a document of its own here, also where rows share an id or have none. Of a component the row with the
    smallest id stays, null last, and of those the first one; texts without words are linked with nothing and stay.
    Null text is empty. Columns may have any names; an empty table stays empty.
    """
    rows, key = keyed_rows(docs)
    told = cut(near_duplicates(rows, key, text_col).select("doc_id", "component_id", "kept"), "told")
    groups = told.filter("not kept").select("component_id").distinct()
    ids = rows.select(col(key).alias("doc_id"), F.struct(col(id_col).isNull().alias("none"), col(id_col).alias("id"), col(key).alias("row")).alias("rank"))
    ranked = cut(told.join(groups, "component_id", "left_semi").join(ids, "doc_id").select("component_id", "rank"), "ranked")
    first = ranked.groupBy("component_id").agg(F.min("rank").alias("stays"))
    gone = ranked.select("rank.row").join(first.select("stays.row"), "row", "left_anti")
    return drop_rows(rows, key, gone)
