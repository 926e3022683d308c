"""Near-duplicate vectors by NN-descent.

A first neighbour graph comes from groups of vectors that share a sign hash. A group of more than GROUP is split by a
hash of the id, so no task meets an unbounded one; then every member whose list is not yet full of links is compared
with the whole group, block by block. Rounds of neighbours-of-neighbours joins refine the graph: at each vector meet
its neighbours and those that hold it as one, in bounded groups. Pairs at the threshold make components.

Equal vectors become one class before anything is compared: a class is its smallest id and a weight, so copies cost one
row and can't fill the lists of their neighbours. Links are counted by weight.

A list that is full of links is saturated. What it can't hold is found without listing pairs: all saturated members are
hashed by sign again, and where groups hold several components, members of different ones are compared in blocks (a link
with a vector that isn't saturated stands in that one's list). Components with a link between them are put together, and then all members of what belongs together are compared in blocks of BLOCK in double precision. Blocks emit counts and
linked components, never pairs. An audit compares a bounded number of vectors with all rows; when fewer than LEAST_RECALL
of their links were found, or of the vectors of any size of group all of whose links were found, the graph is refined from
twice as many further hash tables, with lists of twice the length where any is saturated, and audited again. If the graph of
MOST times the tables still falls short, all vectors are compared with each other in blocks, which leaves nothing out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import col, components, cut, remove, tidy

K, GROUP, BLOCK, AUDITED, LEAST_RECALL, ROUNDS, MOST = 8, 256, 1024, 64, 0.99, 2, 8


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision; null where a vector can't be compared."""
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            x = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(0)
            top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
            out.append((y / np.linalg.norm(y)).tobytes() if top > 0 and (y := x / top) is not None else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "x"])


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), float).reshape(len(values), -1)


def _codes(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1).to_pylist())
            d = x.shape[1]
            if d not in planes:
                planes[d] = np.random.default_rng([seed, d]).standard_normal((d, bits * tables))
            sign = (x @ planes[d] > 0).reshape(len(x), tables, bits)
            code = sign @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(tables, dtype=np.int64) << 32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), tables)), pa.array(code.ravel())], ["vec_id", "bucket"])

    return run


def _best(k: int, least: float):
    """(ids, xs) of a group to each member's ``k`` nearest in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, near, sims = [], [], []
            for row in batch.to_pylist():
                seen = {s["vec_id"]: s["x"] for s in row["members"]}
                ids = np.array(list(seen), np.int64)
                if len(ids) < 2:
                    continue
                x = _matrix(list(seen.values())).astype(np.float32)
                s = x @ x.T
                np.fill_diagonal(s, -2)
                top = np.argpartition(-s, min(k, len(ids) - 1) - 1, axis=1)[:, :k]
                val = np.take_along_axis(s, top, axis=1)
                for i in range(len(ids)):
                    good = val[i] >= least
                    if good.any():
                        own.append(int(ids[i]))
                        near.append(ids[top[i][good]].tolist())
                        sims.append(val[i][good].astype(float).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(near, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64()))], ["vec_id", "near", "sims"])

    return run


def _best_of(k: int, least: float):
    """(members of a block, own or met) to each own member's ``k`` nearest among those met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, near, sims = [], [], []
            for row in batch.to_pylist():
                own, met = ([m for m in row["members"] if m["own"] == side] for side in (True, False))
                if not own or not met:
                    continue
                ids, others = (np.array([m["vec_id"] for m in side], np.int64) for side in (own, met))
                s = _matrix([m["x"] for m in own]).astype(np.float32) @ _matrix([m["x"] for m in met]).astype(np.float32).T
                s[ids[:, None] == others[None, :]] = -2
                top = np.argpartition(-s, min(k, len(others)) - 1, axis=1)[:, :k]
                val = np.take_along_axis(s, top, axis=1)
                for i in range(len(ids)):
                    good = val[i] >= least
                    if good.any():
                        out.append(int(ids[i]))
                        near.append(others[top[i][good]].tolist())
                        sims.append(val[i][good].astype(float).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(near, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64()))], ["vec_id", "near", "sims"])

    return run


def _merge(k: int):
    """Lists of lists to one list of the ``k`` nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, sims = [], []
            for row in batch.to_pylist():
                best = dict(sorted((p for part in row["parts"] for p in zip(part["near"], part["sims"], strict=True)), key=lambda p: p[1]))
                top = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
                near.append([a for a, _ in top])
                sims.append([b for _, b in top])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64()))], ["vec_id", "near", "sims"])

    return run


_LIST = "vec_id long, near array<long>, sims array<double>"


def _met(pairs: DataFrame, vectors: DataFrame, k: int, least: float, limit: int) -> DataFrame:
    """Groups ``(place, vec_id)``, split by id where they are large, to the nearest of each member."""
    sizes = pairs.groupBy("place").agg(F.ceil(F.count("*") / limit).alias("parts"))
    split = pairs.join(sizes, "place").withColumn("part", F.pmod(F.xxhash64("vec_id", "place"), F.col("parts")))
    members = split.join(vectors, "vec_id").groupBy("place", "part").agg(F.collect_list(F.struct("vec_id", "x")).alias("members"))
    return members.select("members").mapInArrow(tidy(_best(k, least)), _LIST)


def _merged(lists: DataFrame, k: int, tag: str, scratch: list[str]) -> DataFrame:
    return cut(lists.groupBy("vec_id").agg(F.collect_list(F.struct("near", "sims")).alias("parts")).mapInArrow(tidy(_merge(k)), _LIST), tag, scratch)


def _full(graph: DataFrame, cosine: float, k: int) -> DataFrame:
    """``(vec_id)`` whose lists are full of links."""
    return graph.filter((F.size("sims") >= k) & (F.element_at("sims", F.lit(-1)) >= cosine - 1e-5)).select("vec_id")


def _rest(codes: DataFrame, vectors: DataFrame, graph: DataFrame, cosine: float, k: int, scratch: list[str]) -> DataFrame | None:
    """What ``_met`` leaves out of the groups it splits: members whose lists aren't full against the whole of their groups, in blocks."""
    large = codes.join(codes.groupBy("place").agg(F.count("*").alias("size")).filter(F.col("size") > GROUP), "place")
    flagged = cut(large.join(_full(graph, cosine, k).withColumn("full", F.lit(True)), "vec_id", "left").select("place", "vec_id", "size", F.col("full").isNull().alias("open")), "large", scratch)
    sizes = flagged.groupBy("place").agg(F.ceil(F.count_if("open") / BLOCK).cast("int").alias("lefts"), F.ceil(F.count("*") / BLOCK).cast("int").alias("rights")).filter("lefts > 0")
    if sizes.isEmpty():
        return None
    placed = flagged.join(sizes, "place").withColumn("h", F.xxhash64("vec_id", "place"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n: F.pmod("h", F.col(n)).cast("int")
    own = placed.filter("open").select("place", "vec_id", of("lefts").alias("i"), every("rights").alias("j"), F.lit(True).alias("own"))
    met = placed.select("place", "vec_id", every("lefts").alias("i"), of("rights").alias("j"), F.lit(False).alias("own"))
    members = own.unionByName(met).join(vectors, "vec_id").groupBy("place", "i", "j").agg(F.collect_list(F.struct("vec_id", "x", "own")).alias("members"))
    return members.select("members").mapInArrow(tidy(_best_of(k, cosine - 0.4)), _LIST)


def _tables(n: int, cosine: float, more: int) -> tuple[int, int]:
    """Bits of a sign hash, and how many tables of them ``5 * more`` meetings of a pair at ``cosine`` take."""
    bits = min(24, max(3, round(math.log2(max(n, 2) / 48))))
    return bits, more * math.ceil(5 / (1 - math.acos(cosine) / math.pi) ** bits)


def neighbour_graph(vectors: DataFrame, n: int, cosine: float, k: int = K, rounds: int = ROUNDS, more: int = 1, before: DataFrame | None = None) -> DataFrame:
    """``(vec_id, near, sims)``: about the ``k`` nearest of each of ``n`` unit vectors ``(vec_id, x)``. ``before``: a graph to start from besides."""
    bits, tables = _tables(n, cosine, more)
    spark, scratch, old = vectors.sparkSession, [], []
    codes = cut(vectors.mapInArrow(tidy(_codes(bits, tables, more)), "vec_id long, bucket long"), "codes", old).withColumnRenamed("bucket", "place")
    first = _met(codes, vectors, k, cosine - 0.4, GROUP)
    graph = _merged(first if before is None else first.unionByName(before), k, "graph", scratch)
    rest = _rest(codes, vectors, graph, cosine, k, old)
    if rest is not None:
        old += scratch
        scratch = []
        graph = _merged(graph.unionByName(rest), k, "graph", scratch)
    remove(spark, old)
    for _ in range(rounds):
        links = graph.select("vec_id", F.explode("near").alias("near"))
        pairs = links.select(F.col("vec_id").alias("place"), F.col("near").alias("vec_id")).union(links.select(F.col("near").alias("place"), "vec_id")).union(graph.select(F.col("vec_id").alias("place"), "vec_id")).distinct()
        old, scratch = scratch, []
        fresh = _merged(graph.select("vec_id", "near", "sims").unionByName(_met(pairs, vectors, k, cosine - 0.4, 64)), k, "graph", scratch)
        moved, total = graph.select(F.xxhash64("vec_id", F.array_sort("near")).alias("h")).join(fresh.select(F.xxhash64("vec_id", F.array_sort("near")).alias("h")), "h", "left_semi").count(), fresh.count()
        graph = fresh
        remove(spark, old)
        if moved >= 0.99 * total:
            break
    return graph


def _blocks(least: float):
    """(members of one or two blocks) to counts of links and linked components of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, comps = [], [], []
            for row in batch.to_pylist():
                left = [m for m in row["members"] if m["block"] == row["i"]]
                right = left if row["i"] == row["j"] else [m for m in row["members"] if m["block"] == row["j"]]
                if not left or not right:
                    continue
                link = _matrix([m["x"] for m in left]) @ _matrix([m["x"] for m in right]).T >= least
                for a, b, hit in ((left, right, link), (right, left, link.T)):
                    comp, weight = np.array([m["comp"] for m in b]), np.array([m["w"] for m in b], np.int64)
                    for m, h in zip(a, hit, strict=True):
                        ids.append(m["vec_id"])
                        counts.append(int(weight[h].sum()) - (m["w"] if a is b else 0))
                        comps.append(np.unique(comp[h]).tolist())
                    if left is right:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(comps, pa.list_(pa.int64()))], ["vec_id", "n", "comps"])

    return run


def _components(graph: DataFrame, cosine: float) -> DataFrame:
    edges = cut(graph.select(F.col("vec_id").alias("a"), F.explode(F.arrays_zip("near", "sims")).alias("e")).filter(F.col("e.sims") >= cosine - 1e-5).select("a", F.col("e.near").alias("b")), "edges")
    return cut(components(edges, "vec-comp"), "comp")


def _meet(least: float):
    """(members of one or two blocks) to the pairs of different components that a link joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met: set[tuple[int, int]] = set()
            for row in batch.to_pylist():
                left, right = ([m for m in row["members"] if m["block"] == row[side]] for side in ("i", "j"))
                if not left or not right:
                    continue
                a, b = (np.array([m["comp"] for m in side], np.int64) for side in (left, right))
                link = _matrix([m["x"] for m in left]) @ _matrix([m["x"] for m in right]).T >= least
                at = np.nonzero(link & (a[:, None] != b[None, :]))
                met |= set(map(tuple, np.unique(np.sort(np.stack([a[at[0]], b[at[1]]], axis=1), axis=1), axis=0).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([p[side] for p in met], pa.int64()) for side in (0, 1)], ["a", "b"])

    return run


def _across(full: DataFrame, vectors: DataFrame, n: int, cosine: float, more: int) -> DataFrame:
    """Pairs of components ``(a, b)`` of which two of the ``n`` members ``full(node, comp)`` share a sign hash and a link."""
    own = cut(vectors.join(full.select(F.col("node").alias("vec_id"), "comp"), "vec_id").select("vec_id", "x", "comp"), "full-vectors")
    bits, tables = _tables(n, cosine, more)
    codes = cut(own.select("vec_id", "x").mapInArrow(tidy(_codes(bits, tables, MOST + more)), "vec_id long, bucket long").withColumnRenamed("bucket", "place"), "full-codes")
    named = codes.join(own.select("vec_id", "comp"), "vec_id")
    mixed = named.groupBy("place").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("place", "blocks")
    placed = codes.join(mixed, "place").withColumn("block", F.pmod(F.xxhash64("vec_id", "place"), F.col("blocks")).cast("int")).join(own, "vec_id")
    sent = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("place", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), F.struct("comp", "block", "x").alias("m"))
    members = sent.groupBy("place", "i", "j").agg(F.collect_list("m").alias("members")).select("i", "j", "members")
    return members.mapInArrow(tidy(_meet(cosine)), "a long, b long").distinct()


def _settled(vectors: DataFrame, graph: DataFrame, cosine: float, k: int, more: int = 1) -> DataFrame:
    """``(vec_id, n_links, component_id)`` of the classes ``vectors(vec_id, x, w)`` that have links to others; ``n_links`` sums their weights."""
    comp = _components(graph, cosine)
    full = cut(_full(graph, cosine, k).withColumnRenamed("vec_id", "node").join(comp, "node"), "full")
    n, several = full.count(), full.select("comp").distinct().count() > 1
    if several:
        over = components(_across(full, vectors, n, cosine, more), "super")
        comp = cut(comp.join(over.select(F.col("node").alias("comp"), F.col("comp").alias("super")), "comp", "left").select("node", "comp", F.coalesce("super", "comp").alias("super")), "supers")
    else:
        comp = comp.withColumn("super", F.col("comp"))
    return _counted(vectors, comp, cosine)


def _exact(vectors: DataFrame, graph: DataFrame, cosine: float) -> DataFrame:
    """As ``_settled``, from all vectors compared with each other; the graph only tells which links can go unlisted."""
    comp = vectors.select(F.col("vec_id").alias("node")).join(_components(graph, cosine), "node", "left")
    return _counted(vectors, comp.select("node", F.coalesce("comp", "node").alias("comp"), F.lit(0).cast("long").alias("super")), cosine)


def _counted(vectors: DataFrame, comp: DataFrame, cosine: float) -> DataFrame:
    """Links and components from comparing all members ``comp(node, comp, super)`` of each super with each other."""
    sizes = comp.groupBy("super").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = comp.join(sizes, "super").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(vectors.withColumnRenamed("vec_id", "node"), "node")
    met = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("super", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), F.struct(F.col("node").alias("vec_id"), "comp", "block", "x", "w").alias("m"))
    counted = cut(met.groupBy("super", "i", "j").agg(F.collect_list("m").alias("members")).select("i", "j", "members").mapInArrow(tidy(_blocks(cosine)), "vec_id long, n long, comps array<long>"), "counts")
    links = counted.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    own = comp.select(F.col("node").alias("vec_id"), "comp")
    across = counted.join(own, "vec_id").select("comp", F.explode("comps").alias("other")).filter("comp <> other").select(F.col("comp").alias("a"), F.col("other").alias("b")).distinct()
    joined = components(across, "final")
    final = own.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("vec_id", F.coalesce("root", "comp").alias("component_id"))
    return cut(final.join(links, "vec_id").filter("n_links > 0"), "settled")


def _compare(sample: list[tuple[int, bytes]], least: float):
    ids, x = np.array([s[0] for s in sample]), _matrix([s[1] for s in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(len(ids), np.int64)
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                link = x @ _matrix(some.column(1).to_pylist()).T >= least
                link &= ids[:, None] != some.column(0).to_numpy()[None, :]
                n += link @ some.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0])], ["vec_id", "n"])

    return run


def audit(vectors: DataFrame, found: DataFrame, cosine: float, size: int = AUDITED) -> float:
    """The least of some shares that were found, measured on hash-chosen classes: of links, and of the vectors all of whose links were found.

    ``size`` classes are drawn from each size class of found links (none, 1, 2 to 3, 4 to 7, ...) and eight times as many
    from those with none, where lost ones hide. Each stands for its part of what it was drawn from. The share of vectors
    is taken over all that have links and over each size class of true links.
    """
    own = vectors.join(found.select("vec_id", "n_links"), "vec_id", "left").select("vec_id", "x", F.coalesce("n_links", F.lit(0)).alias("got"))
    drawn = cut(own.withColumn("level", F.length(F.bin("got")) - (F.col("got") == 0).cast("int")), "levels")
    some = []
    for r in drawn.groupBy("level").agg(F.count("*").alias("n")).collect():
        taken = drawn.filter(F.col("level") == r["level"]).orderBy(F.xxhash64(F.lit("audit"), F.col("vec_id"))).limit(size if r["level"] else 8 * size).collect()
        some += [(t["vec_id"], bytes(t["x"]), t["got"], r["n"] / len(taken)) for t in taken]
    if not some:
        return 1.0
    true = {r["vec_id"]: r["n"] for r in vectors.mapInArrow(tidy(_compare([s[:2] for s in some], cosine)), "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n")).collect()}
    whole: dict[int, list[float]] = {}
    links = [0.0, 0.0]
    for i, _, got, stands in some:
        if n := true.get(i, 0):
            for level in (0, n.bit_length()):
                sums = whole.setdefault(level, [0.0, 0.0])
                sums[0] += stands * (got >= n)
                sums[1] += stands
            links[0] += stands * min(got, n)
            links[1] += stands * n
    return min((a / b for a, b in [*whole.values(), links] if b), default=1.0)


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """Return ``(vec_id, n_links, component_id, kept)``, one row per input row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows with a null
    id, nor vectors of another length than the most frequent one (of equally frequent ones the shortest). Rows that
    repeat an id are one vector, the one whose unit vector has the smallest bytes, and share its result. Other columns
    are not read, so they may have any names; an empty table gives an empty result.
    """
    rows = table.select(col(id_col).cast("long").alias("vec_id"), col(vec_col).cast("array<double>").alias("v"))
    all_ = cut(rows.mapInArrow(tidy(_unit), "vec_id long, x binary").filter("x is not null and vec_id is not null"), "units")
    usual = all_.groupBy(F.length("x").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    units = cut(all_.filter(F.length("x") == (usual[0]["size"] if usual else 0)).groupBy("vec_id").agg(F.min("x").alias("x")), "units")
    keyed = units.select("vec_id", F.unhex(F.md5("x")).alias("key"))
    classes = cut(keyed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")), "classes")
    vectors = cut(units.join(classes.select(F.col("rep").alias("vec_id"), "w"), "vec_id"), "class-vectors")
    n, more = classes.count(), 1
    graph = neighbour_graph(vectors, n, cosine, k, rounds)
    found = _settled(vectors, graph, cosine, k)
    while audit(vectors, found, cosine) < LEAST_RECALL:
        if more >= MOST:
            found = _exact(vectors, graph, cosine)
            break
        more *= 2
        if not _full(graph, cosine, k).isEmpty():
            k *= 2
        graph = neighbour_graph(vectors, n, cosine, k, rounds, more, graph)
        found = _settled(vectors, graph, cosine, k, more)
    by_class = classes.join(found.withColumnRenamed("vec_id", "rep"), "rep", "left")
    by_class = by_class.select("key", (F.coalesce("n_links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    of_unit = keyed.join(by_class, "key").drop("key")
    own = F.col("vec_id")
    return rows.select("vec_id").join(of_unit, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", own).alias("component_id"), own.eqNullSafe(F.coalesce("component_id", own)).alias("kept"))
