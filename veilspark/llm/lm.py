"""Language-model scoring with an Elias-Fano n-gram trie.

1. Texts become chunks of token numbers (about CHUNK bytes of text each), written to the shared folder once.
2. Words are dealt to shards by their hash. Each chunk sends every shard its words of that shard and, below each, the
   words that follow it there, with their training counts: a small trie of its own, in Elias-Fano sequences, so a
   frequent pair is one entry a chunk. A shard adds the counts up, builds its trie and answers each chunk in the order of
   its words and pairs.
3. Each chunk puts the answers together and sums its documents' scores.

A shard's trie lies in one memory-mapped file while it answers. Level 1 has its words with their counts, the quantised
weight that each leaves to shorter contexts, and monotone pointers into level 2, which has the successors of each word
with quantised smoothed probabilities. A word is found between sampled ones, and a successor by binary search between
the two pointers of its context, in keys that are relative to the context's place.

Smoothing is interpolated absolute discounting: with c(v w) pairs counted in training, c(v) their sum and n(v) their number over w,
P(w | v) = max(c(v w) - D, 0) / c(v) + D n(v) / c(v) p1(w), or p1(w) where c(v) is 0; p1 is the base probability. The first
fraction and D n(v) / c(v) are stored in a byte each, six steps an octave down to 2**-42, so log10 P of a token is off by 0.0251 at most.

A word that is the context of more than a small share of the tokens is split: its successors are dealt by their own hash to as
many nodes as its share asks for, which lie in shards of their own; each tells its part of c(v) and n(v), and the chunk
adds these up. Words are told apart by 64 bits of a hash, the successors of one word by 38 bits.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm import elias_fano as ef
from veilspark.llm import words
from veilspark.llm.common import col, cut, release, tidy

CHUNK, CHUNKS_A_SHARD, DISCOUNT, NEXT = 8 << 20, 2, 0.75, 38
#: A context is split where it has more of all tokens than this, or than half a shard where shards are larger.
LEAST_SHARE = 1 / 2048
_BOS, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_MASK = np.uint64((1 << NEXT) - 1)
_TOKENS = "chunk long, ids array<long>, held array<boolean>, n_tokens binary, tokens binary, keys binary, often binary, size long"
_SAMPLED, _STEPS = 64, 6


def quantised(p: np.ndarray) -> np.ndarray:
    """A byte for each probability: 0 for none, else the place on a logarithmic scale from 1 down."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(1 + np.round(-_STEPS * np.log2(p)), 1, 255), 0).astype(np.uint8)


def probability(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 2.0 ** ((1 - code.astype(float)) / _STEPS), 0.0)


def _sized(values: np.ndarray, extra_bits: int = 0) -> bytes:
    """Rising values in an Elias-Fano sequence from the first on, which stands in front."""
    base = values[:1].astype("<u8") if len(values) else np.zeros(1, "<u8")
    rest = values - base[0]
    return base.tobytes() + ef.encode(rest, int(rest[-1]).bit_length() if len(rest) else 1)


def _values(data: bytes) -> np.ndarray:
    return ef.Sequence(data[8:]).values() + np.frombuffer(data[:8], "<u8")[0]


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, held out) to one row per chunk; ``often``: words with a share of its tokens, and their counts."""
    task, made, ids, held, parts, counts, size = TaskContext.get(), 0, [], [], [], [], 0
    part_id = task.partitionId() if task else 0

    def flush() -> pa.RecordBatch:
        keys, tokens = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(tokens)
        top = np.flatnonzero((n >= LEAST_SHARE / 2 * len(tokens)) & (n > 1) & (keys != _END))
        often = np.stack([keys[top], n[top].astype(np.uint64)], axis=1)
        often = np.concatenate([often, np.array([[_BOS, len(ids)]], np.uint64)])
        zipped = pa.compress(tokens.astype("<u4").tobytes(), "zstd", asbytes=True)
        row = [[part_id << 32 | made], [ids], [held], [np.concatenate(counts).astype("<u4").tobytes()], [len(tokens).to_bytes(8, "little") + zipped], [_sized(keys)], [often.astype("<u8").tobytes()], [len(tokens)]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["chunk", "ids", "held", "n_tokens", "tokens", "keys", "often", "size"])

    for batch in batches:
        for lo, hi in words.chunks(batch.column(1)):
            texts = batch.column(1).slice(lo, hi - lo)
            h, at = words.word_hashes(texts)
            ids += batch.column(0).slice(lo, hi - lo).to_pylist()
            held += batch.column(2).slice(lo, hi - lo).to_pylist()
            parts.append(np.insert(h, at[1:], _END))
            counts.append(np.diff(at) + 1)
            size += sum(x for x in pc.binary_length(texts).to_pylist() if x) + 16 * (hi - lo)
            if size >= CHUNK:
                yield flush()
                made, ids, held, parts, counts, size = made + 1, [], [], [], [], 0
    if ids:
        yield flush()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's frequent words, a row each."""
    for batch in batches:
        found = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8").reshape(-1, 2).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["word", "n"])


class _Chunk:
    """Tokens, trie nodes and pairs of a chunk, in the order in which it asks.

    A node is a word, the beginning of texts, or one part of a split context. ``node`` and ``pair`` give each token's
    context and pair. ``split`` maps contexts to their number of parts.
    """

    def __init__(self, row: dict, split: dict[int, int]):
        n = int.from_bytes(row["tokens"][:8], "little")
        self.tokens = np.frombuffer(pa.decompress(row["tokens"][8:], decompressed_size=4 * n, codec="zstd", asbytes=True), "<u4").astype(np.int64)
        keys = _values(row["keys"])
        self.n_tokens = np.frombuffer(row["n_tokens"], "<u4").astype(np.int64)
        held = np.array([bool(x) for x in row["held"]])
        self.train = ~np.repeat(held, self.n_tokens)
        self.doc = np.repeat(np.arange(len(held)), self.n_tokens)
        begin = len(keys)
        before = np.empty(n, np.int64)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.n_tokens) - self.n_tokens] = begin
        nodes, first, follows = [keys, np.array([_BOS])], {}, words.mix(keys ^ _BOS)
        at = begin + 1
        contexts = np.concatenate([keys, [_BOS]])
        for place in np.flatnonzero(np.isin(contexts, np.array(list(split), np.uint64))).tolist():
            key = int(contexts[place])
            nodes.append(words.mix(np.uint64(key) + np.arange(1, split[key] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            first[place] = at
            at += split[key]
        every = np.concatenate(nodes)
        order = np.argsort(every, kind="stable")
        rank = np.empty(len(every), np.int64)
        rank[order] = np.arange(len(every))
        self.nodes = every[order]
        self.own = rank[: len(keys)]  # of each word
        context = before.copy()
        #: The parts of each split context, by its place among words and the beginning of texts.
        self.parts = {place: rank[a : a + split[int(contexts[place])]] for place, a in first.items()}
        for place, a in first.items():
            here = np.flatnonzero(before == place)
            context[here] = a + (follows[self.tokens[here]] >> np.uint64(48)).astype(np.int64) % split[int(contexts[place])]
        self.before, self.node = before, rank[context]
        self.pairs, self.pair = np.unique(self.node.astype(np.uint64) << np.uint64(NEXT) | follows[self.tokens] & _MASK, return_inverse=True)
        self.asks_sums = np.zeros(len(every), bool)
        for own in self.parts.values():
            self.asks_sums[own] = True

    def slices(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each shard's nodes and pairs begin: both are in the order of the shards."""
        shard = ((self.nodes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        nodes = np.searchsorted(shard, np.arange(shards + 1))
        return nodes, np.searchsorted(self.pairs, nodes.astype(np.uint64) << np.uint64(NEXT))


def _ask(shards: int, split: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = _Chunk(row, split)
                n_own = np.zeros(len(c.nodes), "<u4")
                n_own[c.own] = np.bincount(c.tokens[c.train], minlength=len(c.own))
                n_pair = np.bincount(c.pair[c.train], minlength=len(c.pairs)).astype("<u4")
                nodes, pairs = c.slices(shards)
                out = []
                for s in range(shards):
                    a, b, p, q = nodes[s], nodes[s + 1], pairs[s], pairs[s + 1]
                    if a < b:
                        out.append((s, _sized(c.nodes[a:b]), n_own[a:b].tobytes(), np.packbits(c.asks_sums[a:b]).tobytes(), _sized(c.pairs[p:q] - (np.uint64(a) << np.uint64(NEXT))), n_pair[p:q].tobytes()))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array([row["chunk"]] * len(out)), *(pa.array(x, pa.binary()) for x in columns[1:])], ["shard", "chunk", "nodes", "counts", "sums", "pairs", "pair_counts"])

    return run


def write_trie(path: str, nodes: np.ndarray, counts: np.ndarray, of: np.ndarray, after: np.ndarray, pair_counts: np.ndarray, discount: float = DISCOUNT) -> None:
    """Both levels in one file: ``nodes`` with their own ``counts``, and pairs by the node's place ``of`` and successor ``after``, in that order."""
    size = np.bincount(of, minlength=len(nodes))
    total = np.bincount(of, weights=pair_counts, minlength=len(nodes))
    left = quantised(np.divide(discount * size, total, out=np.zeros(len(nodes)), where=total > 0))
    taken = quantised((pair_counts - discount) / total[of])
    pointers = np.concatenate([[0], np.cumsum(size)]).astype(np.uint64)
    keys = of.astype(np.uint64) << np.uint64(NEXT) | after
    levels = [ef.encode(nodes, 64), counts.astype("<u8").tobytes(), total.astype("<u8").tobytes(), left.tobytes(), ef.encode(pointers, max(1, int(pointers[-1]).bit_length())), ef.encode(keys, NEXT + max(1, len(nodes).bit_length())), taken.tobytes()]
    with open(path, "wb") as f:
        f.write(np.array([len(x) for x in levels], "<u8").tobytes() + b"".join(levels))


class Trie:
    """Reads a shard's memory-mapped trie."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        ends = 56 + np.cumsum(data[:56].view("<u8").astype(np.int64))
        parts = [data[a:b] for a, b in zip([56, *ends[:-1]], ends, strict=True)]
        self.nodes, self.pointers, self.successors = (ef.Sequence(parts[k]) for k in (0, 4, 5))
        self.counts, self.totals, self.left, self.taken = parts[1].view("<u8"), parts[2].view("<u8"), parts[3], parts[6]
        self.sampled = self.nodes.get(np.arange(0, self.nodes.n, _SAMPLED))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each node, or -1."""
        lo = np.maximum(np.searchsorted(self.sampled, keys, side="right") - 1, 0) * _SAMPLED
        return self.nodes.find(keys, lo, np.minimum(lo + _SAMPLED, self.nodes.n))

    def below(self, place: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The quantised probability of each successor ``after`` the node at ``place`` (-1: none), 0 where training has none."""
        out = np.zeros(len(place), np.uint8)
        known = np.flatnonzero(place >= 0)
        node = place[known]
        lo, hi = (self.pointers.get(node + k).astype(np.int64) for k in (0, 1))
        at = self.successors.find(node.astype(np.uint64) << np.uint64(NEXT) | after[known], lo, hi)
        out[known[at >= 0]] = self.taken[at[at >= 0]]
        return out

    def below_all(self, asked: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """``below`` for many requests, each in the order of nodes and successors: level 2 is read once, context by context
        as its pointers say and about STEP successors at a time, and each request is searched in the part read."""
        found = [np.zeros(len(place), np.uint8) for place, _ in asked]
        known = [np.flatnonzero(place >= 0) for place, _ in asked]
        keys = [place[k].astype(np.uint64) << np.uint64(NEXT) | after[k] for (place, after), k in zip(asked, known, strict=True)]
        pointers, done, lo = self.pointers.values().astype(np.int64), [0] * len(asked), 0
        while lo < len(pointers) - 1:
            hi = max(lo + 1, int(np.searchsorted(pointers, pointers[lo] + ef.STEP, side="right")) - 1)
            a, b = pointers[lo], pointers[hi]
            if a < b:
                block, codes, limit = self.successors.get(np.arange(a, b)), self.taken[a:b], np.uint64(hi) << np.uint64(NEXT)
                for r, own in enumerate(keys):
                    end = int(np.searchsorted(own, limit))
                    some = own[done[r] : end]
                    at = np.minimum(np.searchsorted(block, some), b - a - 1)
                    hit = block[at] == some
                    found[r][known[r][done[r] : end][hit]] = codes[at[hit]]
                    done[r] = end
            lo = hi
        return found


def _answer(discount: float):
    def run(table: pa.Table) -> pa.Table:
        """Of one shard: its trie, and what it tells each chunk; one row of totals besides."""
        rows = table.to_pylist()
        keys = [_values(r["nodes"]) for r in rows]
        pairs = [_values(r["pairs"]) for r in rows]
        nodes, where = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]), minlength=len(nodes))
        starts = np.cumsum([0, *map(len, keys)])
        n = np.concatenate([np.frombuffer(r["pair_counts"], "<u4") for r in rows])
        seen = n > 0
        full = np.concatenate([where[starts[k] + (p >> np.uint64(NEXT)).astype(np.int64)].astype(np.uint64) << np.uint64(NEXT) | p & _MASK for k, p in enumerate(pairs)])[seen]
        distinct, which = np.unique(full, return_inverse=True)
        pair_counts = np.bincount(which, weights=n[seen], minlength=len(distinct))
        of = (distinct >> np.uint64(NEXT)).astype(np.int64)
        trained = (counts > 0) | (np.bincount(of, minlength=len(nodes)) > 0)  # words that only held-out texts have are in no trie
        place = np.cumsum(trained) - 1
        out = {"shard": [], "chunk": [], "counts": [], "left": [], "taken": [], "sums": [], "n_distinct": [], "n_total": []}

        def put(*values) -> None:
            for k, x in zip(out, values, strict=True):
                out[k].append(x)

        put(rows[0]["shard"], None, None, None, None, None, int((counts > 0).sum()), int(counts.sum()))
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "trie")
            write_trie(path, nodes[trained], counts[trained], place[of], distinct & _MASK, pair_counts, discount)
            del nodes, counts, where, n, full, distinct, which, pair_counts, of, trained, place
            trie = Trie(path)
            places = [trie.find(k) for k in keys]
            found = trie.below_all([(at[(p >> np.uint64(NEXT)).astype(np.int64)], p & _MASK) for at, p in zip(places, pairs, strict=True)])
            for r, k, at, taken in zip(rows, keys, places, found, strict=True):
                told = at >= 0
                count, left = np.zeros(len(k), "<u8"), np.zeros(len(k), np.uint8)
                count[told], left[told] = trie.counts[at[told]], trie.left[at[told]]
                asks = np.flatnonzero(np.unpackbits(np.frombuffer(r["sums"], np.uint8), count=len(k)))
                sums = np.zeros(len(asks), "<u8")
                sums[at[asks] >= 0] = trie.totals[at[asks][at[asks] >= 0]]
                put(r["shard"], r["chunk"], count.tobytes(), left.tobytes(), taken.tobytes(), sums.tobytes(), 0, 0)
            del trie
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        told = pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})
        del out, rows, keys, pairs
        release()
        return told

    return run


def _settle(shards: int, split: dict[int, int], total: int, distinct: int):
    def run(key, tokens: pa.Table, answers: pa.Table) -> pa.Table:
        row = tokens.to_pylist()[0]
        c = _Chunk(row, split)
        nodes, pairs = c.slices(shards)
        count, left, taken, sums = np.zeros(len(c.nodes)), np.zeros(len(c.nodes), np.uint8), np.zeros(len(c.pairs), np.uint8), np.zeros(len(c.nodes))
        for a in answers.to_pylist():
            s = a["shard"]
            here = slice(nodes[s], nodes[s + 1])
            count[here], left[here] = np.frombuffer(a["counts"], "<u8"), np.frombuffer(a["left"], np.uint8)
            taken[pairs[s] : pairs[s + 1]] = np.frombuffer(a["taken"], np.uint8)
            sums[here][c.asks_sums[here]] = np.frombuffer(a["sums"], "<u8")
        n_word = count[c.own]
        p1 = (n_word + 0.5) / (total + 0.5 * (distinct + 1))
        share, rest = np.ones(len(c.nodes)), probability(left)
        for own in c.parts.values():  # of a split context each part has its share of the count
            share[own] = sums[own] / max(sums[own].sum(), 1)
            rest[own] = (rest[own] * share[own]).sum()
        rest[(rest == 0)] = 1.0  # no such context in training: all is left to the word alone
        p = probability(taken)[c.pair] * share[c.node] + rest[c.node] * p1[c.tokens]
        scores = [np.bincount(c.doc, weights=x, minlength=len(c.n_tokens)) for x in (np.log10(p1)[c.tokens], np.log10(p), n_word[c.tokens] > 0)]
        told = pa.table(
            {
                "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array([bool(x) for x in row["held"]]), "n_tokens": pa.array(c.n_tokens), "n_known": pa.array(scores[2].astype(np.int64)),
                "train_tokens": pa.array([total] * len(c.n_tokens), pa.int64()), "base_score": pa.array(scores[0]), "score": pa.array(scores[1]),
            }
        )
        del row, c, answers
        release()
        return told

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1, discount: float = DISCOUNT, least_share: float = LEAST_SHARE) -> DataFrame:
    """Return ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per input row.

    Training documents are those whose crc32 of the id as text leaves another remainder than ``fold``; a null id is a
    training document. Null text is empty: one end token. Texts of any length are read whole. Repeated rows count and are
    scored each. Other columns are not read, so they may have any names; an empty table gives an empty result.
    """
    own = col(id_col).cast("long")
    held = F.coalesce(F.crc32(own.cast("string").cast("binary")) % folds == fold, F.lit(False))
    rows = docs.select(own.alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"), held.alias("held"))
    tokens = cut(rows.mapInArrow(tidy(_chunked), _TOKENS), "tokens")
    n_chunks, n_tokens = (int(x or 0) for x in tokens.agg(F.count("*"), F.sum("size")).head())
    shards = max(8, n_chunks // CHUNKS_A_SHARD)
    share = max(least_share, 1 / (2 * shards))
    # no more than 1 / share words have such a share of all tokens
    often = tokens.select("often").mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") > share * n_tokens)
    split = {r["word"] % (1 << 64): math.ceil(r["n"] / (share * n_tokens)) for r in often.collect()}
    asked = tokens.mapInArrow(tidy(_ask(shards, split)), "shard long, chunk long, nodes binary, counts binary, sums binary, pairs binary, pair_counts binary")
    answers = cut(asked.groupBy("shard").applyInArrow(_answer(discount), "shard long, chunk long, counts binary, left binary, taken binary, sums binary, n_distinct long, n_total long"), "answers")
    distinct, total = (int(x or 0) for x in answers.agg(F.sum("n_distinct"), F.sum("n_total")).head())
    told = answers.filter("chunk is not null").select("chunk", "shard", "counts", "left", "taken", "sums")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return tokens.drop("often", "size").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_settle(shards, split, total, distinct), schema)
