"""Hostile rows and columns: repeated and null ids, empty tables, very long texts and names that clash with helpers."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.llm import bpe, chat, common, embed, exact_dedup, lm, minhash, mixing, pii, quality, secrets
from veilspark.llm.queries import tokenizer_path

NAMES = ["bm_row", "bm_bits", "mix_key", "mix_size", "mix_shards", "target", "shards", "fill", "copies", "source_size", "a.b", "veil_row", "maybe_gone", "junk", "key", "row", "node", "comp", "rank", "size", "block", "of", "found", "spans", "kept", "id", "lang`s"]
NEAR = " ".join(f"near{k}" for k in range(40))
GOOD = "The river of this land was and is in the care of many people. It runs to the sea, and it is long."
TEXTS = [
    (7, "unique text here"), (7, "a b"), (3, "a b"), (1, "x y z"), (1, "x y z"), (None, "x  y z"), (None, "null id"), (None, None), (4, None), (5, ""), (6, " \n "),
    (8, NEAR), (9, NEAR + " end"), (None, NEAR + " fin"), (10, "long word " * 30_000), (11, "q" * 200_000), (12, "日本語 テキスト"),
]


@pytest.fixture(scope="module")
def hostile(spark):
    schema = "doc_id long, text string, source string, " + ", ".join(f"{common.quoted(n)} long" for n in NAMES)
    return spark.createDataFrame([(i, t, f"s{k % 3}" if k % 4 else None, *[100 * k + j for j in range(len(NAMES))]) for k, (i, t) in enumerate(TEXTS)], schema)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _kept(hostile, df, want: list[int]):
    """``df`` has exactly the rows of ``hostile`` at ``want``, with all columns as they were."""
    assert df.columns == hostile.columns
    mark = NAMES.index("bm_row")
    assert sorted(r[3 + mark] // 100 for r in df.collect()) == want
    assert all(list(r[3:]) == [r[3] + j for j in range(len(NAMES))] for r in df.collect())


def test_exact_stage(hostile):
    # by smallest id, null last: (3, a b) over (7, a b); one of the two rows (1, x y z); the empty texts are one group, " \n " is one space
    _kept(hostile, exact_dedup.keep_first(hostile), [0, 2, 3, 6, 8, 10, 11, 12, 13, 14, 15, 16])


def test_minhash_stage(hostile):
    # the same texts by words; texts without words stay
    _kept(hostile, minhash.keep_one(hostile), [0, 2, 3, 6, 7, 8, 9, 10, 11, 14, 15, 16])


def test_quality_stage(hostile, spark):
    kept = quality.keep_good(hostile)
    assert kept.columns == hostile.columns and {tuple(r) for r in kept.collect()} <= {tuple(r) for r in hostile.collect()}
    rows = [(None if k % 2 else 5, GOOD, 1.5) for k in range(300)] + [(5, "SHOUT!! a*** b%%% " * 60, 2.5)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, junk double")
    assert sorted(r.junk for r in quality.keep_good(docs).collect()) == [1.5] * 300
    same = spark.createDataFrame([(1, GOOD)] * 500, "doc_id long, text string")
    assert quality.classify(same, sample=1).filter("kept").count() == 500


def test_mixing_stage(hostile):
    out = mixing.assign(hostile)
    assert out.columns == [*hostile.columns, "mix_size_", "mix_source_size", "mix_target", "mix_taken", "mix_shards_"]
    assert [r[: len(hostile.columns)] for r in _rows(out)] == _rows(hostile)
    sizes = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, (_, t) in enumerate(TEXTS)}
    told = {r[3] // 100: r for r in out.collect()}
    assert all(told[k]["mix_size_"] == n and told[k]["mix_taken"] == n * len(told[k]["mix_shards_"]) <= 2 * n for k, n in sizes.items())
    mixed = mixing.mixed(hostile)
    assert mixed.columns == hostile.columns
    assert sorted(r[3] // 100 for r in mixed.collect()) == sorted(k for k, r in told.items() for _ in r["mix_shards_"])


def test_reports_of_each_row(hostile):
    n = len(TEXTS)
    whole = exact_dedup.exact_dedup(hostile, digest_all=True).collect()
    assert len(whole) == n and sum(r.doc_id == 7 for r in whole) == 2 and {r.keep_id for r in whole if r.group_size == 2 and r.doc_id == 7} == {3}
    near = minhash.near_duplicates(hostile).collect()
    assert len(near) == n and sorted((r.doc_id, r.component_id, r.n_shingles) for r in near if r.doc_id in (7, 3, 8, 9)) == [(3, 3, 1), (7, 3, 1), (7, 7, 1), (8, 8, 36), (9, 8, 37)]
    assert all(r.component_id is None and r.kept for r in near if r.doc_id is None)
    assert quality.classify(hostile).count() == lm.score(hostile).count() == pii.find(hostile).count() == secrets.find(hostile).count() == n
    ids = bpe.encode(hostile, tokenizer_path(), keep=("doc_id", "a.b", "lang`s"), outputs=("ids", "decoded"))
    assert ids.count() == n and ids.columns == ["doc_id", "a.b", "lang`s", "ids", "decoded"]
    back = bpe.decode(ids, tokenizer_path(), keep=("doc_id", "a.b"))
    assert _rows(back) == _rows(ids.select("doc_id", F.col("`a.b`"), "decoded"))


def test_decode_leaves_out_what_is_no_id(spark):
    df = spark.createDataFrame([(1, [-1, 5, None, 10**9]), (2, None), (3, [])], "doc_id long, ids array<long>")
    out = {r.doc_id: r.decoded for r in bpe.decode(df, tokenizer_path()).collect()}
    assert out == {1: bpe.tokenizer(tokenizer_path()).names[5], 2: "", 3: ""}


def test_empty_tables(hostile):
    none = hostile.limit(0)
    for stage in (exact_dedup.keep_first, minhash.keep_one, quality.keep_good, mixing.mixed, pii.redact):
        assert stage(none).count() == 0
    assert stage(none).columns == ["doc_id", "text"]
    assert embed.near_duplicates(none.selectExpr("doc_id as vec_id", "array(cast(1 as float)) as embedding")).count() == 0
    assert chat.render(none.selectExpr("doc_id as conv_id", "doc_id as turn", "text as role", "text")).count() == 0
    assert bpe.decode(bpe.encode(none, tokenizer_path()), tokenizer_path()).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 0.1]), (None, [1.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [1.0, None]), (7, None), (8, [float("inf"), 1.0])]
    out = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    told = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert len(out) == len(rows) and told[2] == (1, 1, False) and told[1] == (1, 1, True) and told[3] == (0, 3, True)
    assert all(told[i] == (0, i, True) for i in (4, 5, 6, 7, 8)) and told[None] == (0, None, True)


def test_conversations(spark):
    rows = [(1, 0, "user", "a", "n"), (1, 0, "user", "a", "m"), (None, 0, "user", "a", "n"), (None, 1, None, None, "n"), (2, None, "user", "a", "n"), (3, 0, "user", "b" * 100_000, "n")]
    out = {r.conv_id: (r.n_turns, r.copies) for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, last string")).collect()}
    assert out == {None: (2, 1), 3: (1, 1)}


def test_redact(spark):
    rows = [(1, "mail a.b@example.com now"), (1, "nothing"), (None, "at 10.1.2.3 and 4111 1111 1111 1111"), (2, None)]
    out = sorted((r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert out == ["", "at <ip> and <card>", "mail <email> now", "nothing"]


def test_bitmaps_and_components(spark):
    assert common.bitmap_bits(0) == common.LEAST_BITS and common.bitmap_bits(1 << 40) == common.MOST_BITS and common.bitmap_bits(1_000_000) == 1 << 23
    rng = random.Random(1)
    edges = [(0, k) for k in range(1, 3000)] + [(rng.randrange(5000, 9000), rng.randrange(5000, 9000)) for _ in range(3000)] + [(k, k + 1) for k in range(20_000, 20_400)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {n: find(n) for n in {n for a, b in edges if a != b for n in (a, b)}}
