"""Language-model scores against plain counting, and the trie by itself."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from veilspark.llm import elias_fano as ef
from veilspark.llm import lm

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _plain(rows: list[tuple[int | None, str | None]], discount: float) -> list[tuple]:
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    one, two = Counter(), Counter()
    for ws, h in zip(tokens, held, strict=True):
        if not h:
            one.update(ws)
            two.update(zip([False, *ws], ws, strict=False))
    ctx, after = Counter(), Counter()
    for (v, _), n in two.items():
        ctx[v] += n
        after[v] += 1
    total, distinct = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 0.5) / (total + 0.5 * (distinct + 1))

    def p2(v, w) -> float:
        return max(two[v, w] - discount, 0) / ctx[v] + discount * after[v] / ctx[v] * p1(w) if ctx[v] else p1(w)

    return [(h, len(ws), sum(one[w] > 0 for w in ws), total, sum(math.log10(p1(w)) for w in ws), sum(math.log10(p2(v, w)) for v, w in zip([False, *ws], ws, strict=False))) for ws, h in zip(tokens, held, strict=True)]


def _compared(spark, rows, **options):
    out = lm.score(spark.createDataFrame([(i, t, i, "x", 0) for i, t in rows], "doc_id long, text string, chunk long, `a.b` string, held int"), **options).collect()
    want = _plain(rows, options.get("discount", lm.DISCOUNT))
    key = lambda x: tuple(str(round(v, 5)) for v in x)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out), key=lambda r: (str(r[0]), key(r[1:6])))
    want = sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=lambda r: (str(r[0]), key(r[1:6])))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
        assert abs(g[6] - w[6]) <= 0.0252 * g[2], (g, w)


@pytest.mark.parametrize("chunk", [lm.CHUNK, 200])
def test_scores_like_plain_counting(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)] + ["the"] * 30
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for i in range(120)]
    rows += [(7, None), (None, "w1 The w2"), (None, None), (8, "\n"), (9, "only here now"), (9, "only here now"), (200, "x " * 3000), (201, "ÉCOLE école w1")]
    _compared(spark, rows)


def test_empty_and_untrained_tables(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    _compared(spark, [(held, "nothing to learn from")])


def test_split_contexts_change_nothing(spark):
    rows = [(i, f"a w{i % 13} a a w{i % 7}") for i in range(200)]
    _compared(spark, rows, least_share=0.5)
    _compared(spark, rows, least_share=0.001)
    data = {"tokens": (4).to_bytes(8, "little") + __import__("pyarrow").compress(np.array([0, 1, 0, 1], "<u4").tobytes(), "zstd", asbytes=True), "keys": lm._sized(np.array([5, 9], np.uint64)), "n_tokens": np.array([4], "<u4").tobytes(), "held": [False]}
    whole, cut = lm._Chunk(data, {}), lm._Chunk(data, {5: 4})
    assert len(cut.nodes) == len(whole.nodes) + 4 and cut.asks_sums.sum() == 4
    assert len({int(n) for n in cut.node[np.flatnonzero(cut.before == 0)]}) == 1 and cut.asks_sums[cut.node[1]]


def test_trie(tmp_path):
    rng = np.random.default_rng(2)
    nodes = np.unique(rng.integers(0, 1 << 64, 500, dtype=np.uint64))
    of = np.sort(rng.integers(0, len(nodes) - 1, 3000))
    after = rng.integers(0, 1 << lm.NEXT, 3000, dtype=np.uint64)
    order = np.lexsort((after, of))
    of, after = of[order], after[order]
    n = rng.integers(1, 50, 3000)
    lm.write_trie(str(tmp_path / "trie"), nodes, np.arange(len(nodes)), of, after, n)
    trie = lm.Trie(str(tmp_path / "trie"))
    assert (trie.find(nodes) == np.arange(len(nodes))).all() and (trie.find(nodes[:-1] + np.uint64(1)) == -1).all()
    total = np.bincount(of, weights=n, minlength=len(nodes))
    p = lm.probability(trie.below(of, after))
    assert np.abs(np.log2(p) - np.log2((n - lm.DISCOUNT) / total[of])).max() <= 1 / 12 + 1e-9
    wanted = np.arange(0, 3000, 7)
    asked = [(of, after), (of[wanted], after[wanted]), (np.where(of % 3 == 0, -1, of), after), (of[:0], after[:0]), (of[:-1], after[:-1] + np.uint64(1))]
    for (place, key), got in zip(asked, trie.below_all(asked), strict=True):
        assert (got == trie.below(place, key)).all()
    assert (trie.below((of + 1) % len(nodes), after) == 0).all() and (trie.below(np.full(3, -1), after[:3]) == 0).all()


def test_elias_fano():
    for x in (np.unique(np.random.default_rng(1).integers(0, 1 << 52, 5000, dtype=np.uint64)), np.array([3], np.uint64), np.array([5, 5, 5], np.uint64), np.array([0, 0, 1 << 51], np.uint64), np.zeros(0, np.uint64)):
        s = ef.Sequence(ef.encode(x, 52))
        assert (s.values() == x).all() and (s.get(np.arange(len(x))) == x).all()
    x = np.arange(0, 90_000, 3, dtype=np.uint64)
    s = ef.Sequence(ef.encode(x, 20))
    assert (s.find(x, np.zeros(len(x), int), np.full(len(x), len(x))) == np.arange(len(x))).all()
    assert (s.find(x + np.uint64(1), np.zeros(len(x), int), np.full(len(x), len(x))) == -1).all()
