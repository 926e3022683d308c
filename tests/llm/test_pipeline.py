"""Mixing and quality against plain computations, and the whole pipeline against a brute-force version of its stages."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from veilspark.llm import mixing, quality
from veilspark.llm.queries import op8_mixing, tokenizer_path

WORD = r"[^\x20\x09-\x0D]+"


def _targets(sizes: dict) -> dict:
    """Exact shares: what is above twice a source's size is shared again until none is."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full: dict = {}
    while True:
        left = Fraction(3, 2) * sum(sizes.values()) - sum(full.values())
        rest = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s: Fraction(2 * sizes[s]) for s in rest if share[s] > 2 * sizes[s]}
        if not over:
            return full | share
        full |= over


def _checked_mix(rows: list[tuple], told: list[tuple]) -> None:
    """``told``: (source, size, source_size, target, taken) of each of ``rows`` (source, text)."""
    sizes: Counter = Counter()
    for s, t in rows:
        sizes[s] += len(re.findall(WORD, t or ""))
    want, got, largest = _targets(sizes), Counter(), defaultdict(int)
    for s, size, source_size, target, taken in told:
        assert source_size == sizes[s] and math.isclose(target, want[s], rel_tol=1e-9, abs_tol=1e-9) and 0 <= taken <= 2 * size
        assert size == 0 or taken % size == 0
        got[s] += taken
        largest[s] = max(largest[s], size)
    assert all(want[s] - largest[s] <= got[s] <= want[s] + 1e-6 for s in sizes)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing_meets_its_targets(spark, seed):
    rng = random.Random(seed)
    names = ["b", "B", "ä", "zz", None, "a b"][: 3 + seed]
    hot = names[0]
    rows = [(hot if rng.random() < 0.5 else rng.choice(names), " ".join("w" for _ in range(rng.randrange(0, 60)))) for _ in range(2500)] + [("one", "w " * 5), ("none", None)]
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    out = {r.doc_id: r for r in mixing.assign(df).collect()}
    told = [(out[i].source, out[i].mix_size, out[i].mix_source_size, out[i].mix_target, out[i].mix_taken) for i in range(len(rows))]
    assert [t[1] for t in told] == [len(re.findall(WORD, t or "")) for _, t in rows]
    _checked_mix(rows, told)
    assert all(r.mix_taken == r.mix_size * len(r.mix_shards) for r in out.values())
    again = {r.doc_id: r.mix_shards for r in mixing.assign(df.repartition(7)).collect()}
    assert again == {i: r.mix_shards for i, r in out.items()}


def test_registered_mix(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").set_index("doc_id")
    out = op8_mixing(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in out) == sorted(docs.index)
    none = lambda s: None if pd.isna(s) else s
    _checked_mix([(none(docs.source[r.doc_id]), none(docs.text[r.doc_id])) for r in out], [(r.source, r["size"], r.source_size, r.target, r.taken) for r in out])


def test_tree_and_quotas():
    dealt = mixing.split(np.array([700, 0, 31]), 16, 3)
    assert dealt.sum(axis=0).tolist() == [700, 0, 31] and np.ptp(dealt.sum(axis=1)) <= 4 and (dealt >= 0).all()
    assert (mixing.split(np.array([700, 0, 31]), 16, 3) == dealt).all() and (mixing.split(np.array([700, 0, 31]), 16, 4) != dealt).any()
    sequence, n = mixing.quota(np.array([5, 7, 1]), np.array([2, 0, 1]), 19.0)
    assert sequence.tolist() == [2, 0, 1, 2, 0, 1] and n == 5
    plan, shards = mixing._plan(pd.DataFrame({"source": ["a"] * 40 + ["b"] * 3, "block": [*range(40), *range(3)], "words": [10] * 43}), 5, 9)
    drawn = plan.apply(lambda r: len(r["shards"]) - (r["fill"] >= 0), axis=1)
    assert shards == 5 and (drawn == plan["copies"]).all() and plan["copies"].max() <= 2
    for _, own in plan.groupby("source"):
        words = (own["copies"] * 10).sum() + own["fill"].clip(lower=0).sum()
        assert math.isclose(words, own["target"].iloc[0], abs_tol=1e-6)


def test_quality_agrees_with_held_out_labels(spark):
    """Labels are read by no one but this test."""
    path = "/root/testdata/sf0.01"
    labels = pd.read_parquet(f"{path}/labels.parquet").set_index("doc_id")["quality"]
    out = quality.classify(spark.read.parquet(f"{path}/documents.parquet")).toPandas().set_index("doc_id")
    agree = out["kept"].reindex(labels.index) == (labels == 1)
    assert agree.mean() >= 0.96 and out.loc[labels.index[labels == 1], "kept"].mean() >= 0.97


def _near(texts: list[str]) -> list[int]:
    """The first of each component of texts that share three quarters of their five-word shingles."""
    sets = []
    for t in texts:
        w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [i for i in range(len(texts)) if find(i) == i]


def test_pipeline_like_brute_force(spark, tmp_path):
    import corpus_pipeline

    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "the river land care many people sea long winter stone".split() for b in ("", "s", "ing")]
    prose = lambda n: " ".join(rng.choice(vocabulary) + ("." if rng.random() < 0.1 else "") for _ in range(n)).capitalize() + "."
    good = [prose(rng.randrange(30, 120)) for _ in range(160)]
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(1000 + i, good[i] if i % 2 else good[i].replace(" ", "  ", 3)) for i in range(0, 40)]
    rows += [(2000 + i, good[40 + i] + " end of it") for i in range(30) if len(good[40 + i].split()) > 60]
    rows += [(3000 + i, f"BUY{i}!! a*** b%%% c{i}$$$ NOW!! " * 25) for i in range(40)]
    rows += [(5, good[5]), (None, good[6] + " tail of it"), (None, "A lone line that nothing else has. It is kept as it is, in the care of many people by the sea."), (4000, None), (4001, "")]
    docs = [(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))

    kept, stages = spark.read.parquet(str(tmp_path / "documents.parquet")), dict(corpus_pipeline.STAGES)
    first = stages["quality_classifier"](spark, kept, str(tmp_path)).collect()
    assert {r.doc_id for r in first if r.doc_id and 3000 <= r.doc_id < 3040} == set() and {r.doc_id for r in first} >= set(range(160))
    left = sorted((r.doc_id is None, r.doc_id or 0, k, r.text or "", r.source) for k, r in enumerate(first))
    seen: dict[str, tuple] = {}
    for r in left:
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[3]), r)
    single = sorted(seen.values())
    stay = [single[i] for i in _near([r[3] for r in single])]

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lib = tokenizers.Tokenizer.from_file(tokenizer_path())
    digest = {}
    for r in stay:
        ids = lib.encode(r[3], add_special_tokens=False).ids
        digest[hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] = (r[3], r[4], ids)
    taken: Counter = Counter()
    for r in out:
        text, source, ids = digest[r.ids_sha256]
        assert r.ids == ids and r.n_tokens == len(ids) and r.source == source
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        taken[text] += 1
    words = {r[3]: len(re.findall(WORD, r[3])) for r in stay}
    sizes: Counter = Counter()
    for r in stay:
        sizes[r[4]] += words[r[3]]
    _checked_mix([(r[4], r[3]) for r in stay], [(r[4], words[r[3]], sizes[r[4]], float(_targets(sizes)[r[4]]), taken[r[3]] * words[r[3]]) for r in stay])
