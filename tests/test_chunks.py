"""Chunkers against a plain loop, wallets with known addresses, JSON and nested ways back."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions import checksums as C
from veilspark.operators import chunk
from veilspark.operators.anonymize import ITEM, Operator
from veilspark.operators.rules import CATALOG
from veilspark.operators.scan import NO_SPANS, scan
from veilspark.plans.engine import restore_nested
from veilspark.sources import labelled


def _loop(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    edges = [i for i, c in enumerate(text) if c in " \n"]
    after = lambda at: next((e for e in edges if e >= at), len(text))
    out, at = [], 0
    while at < len(text):
        end = after(at + size) if at + size < len(text) else len(text)
        out.append((at, end))
        at = len(text) if end == len(text) else after(end - overlap)
    return out


TEXTS = [None, "", "a", "ab cd", "no_boundary_at_all" * 9, " " * 50, "日本 😀 " * 40, *["".join(random.Random(k).choice("abc de\nf") for _ in range(40 * k)) for k in range(1, 8)]]


@pytest.mark.parametrize(("size", "overlap"), [(10, 0), (10, 3), (25, 24), (250, 50)])
def test_chunks_by_characters(spark, size, overlap):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {r.doc_id: r.c for r in df.select("doc_id", chunk.by_characters(F.col("text"), size, overlap).alias("c")).collect()}
    for i, t in enumerate(TEXTS):
        assert [(c.start, c.end) for c in got[i]] == _loop(t or "", size, overlap), (i, t)
        assert all(c.text == t[c.start : c.end] for c in got[i])


def test_chunks_by_tokens(spark):
    df = spark.createDataFrame([(0, "a bb  ccc d e"), (1, None), (2, " \n"), (3, "one")], "doc_id int, text string")
    got = {r.doc_id: [c.text for c in r.c] for r in df.select("doc_id", chunk.by_tokens(F.col("text"), 3, 1).alias("c")).collect()}
    assert got == {0: ["a bb  ccc", "ccc d e"], 1: [], 2: [], 3: ["one"]}
    with pytest.raises(ValueError):
        chunk.by_tokens(F.lit("a"), 3, 3)
    with pytest.raises(ValueError):
        chunk.chunks(F.lit("a"), "other")


def test_spans_of_chunks_are_found_once(spark):
    text = "word " * 30 + "mail me at jo.doe@example.com today " + "word " * 60
    rule = next(r for r in CATALOG if r.entity == "EMAIL_ADDRESS")
    df = spark.createDataFrame([(text,)], "text string")
    found = chunk.predict(chunk.by_characters(F.col("text"), 40, 35), lambda t: scan(t, rule))
    spans = df.select(found.alias("s")).head().s
    assert [text[s.start : s.end] for s in spans] == ["jo.doe@example.com"]
    rows = chunk.explode_chunks(df.withColumn("doc_id", F.lit(1)), size=40, overlap=35).collect()
    assert [r.chunk for r in rows] == list(range(len(rows))) and all(text[r.chunk_start : r.chunk_end] == r.chunk_text for r in rows)


def _b58(data: bytes) -> str:
    data += hashlib.sha256(hashlib.sha256(data).digest()).digest()[:4]
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, k = divmod(n, 58)
        out = C.BASE58[k] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


def test_wallets(spark):
    rng = random.Random(3)
    good = ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0"]
    good += [_b58(bytes([v]) + rng.randbytes(20)) for v in (0, 5) for _ in range(10)] + [_b58(b"\0\0\0" + rng.randbytes(18))]
    bad = [a[:-1] + ("q" if a[-1] != "q" else "p") for a in good] + ["1" * 30, "BC1QAR0SRRR7XFKVY5L643LYDNW9RE59GTZZWF5MDQ"]
    rule = next(r for r in CATALOG if r.entity == "CRYPTO")
    df = spark.createDataFrame([(a, True) for a in good] + [(a, False) for a in bad], "a string, ok boolean")
    out = df.select("a", "ok", (F.size(F.filter(scan(F.concat(F.lit("pay "), "a", F.lit(" now")), rule), lambda s: s["score"] == 1)) == 1).alias("got")).collect()
    assert [r.a for r in out if r.ok != r.got] == []
    assert spark.range(1).select(C.bech32(F.lit("A12UEL5L")), C.bech32(F.lit("a12UEL5L")), C.bech32(F.lit("?1ezyfcl"))).head()[:] == (True, False, True)


def test_postcodes(spark):
    rule = next(r for r in CATALOG if r.entity == "UK_POSTCODE")
    df = spark.createDataFrame([("to SW1A 1AA, M1 1AE or GIR 0AA, not QQ1 1AA",)], "t string")
    assert [s.start for s in df.select(scan(F.col("t"), rule).alias("s")).head().s] == [3, 13, 23]


def test_json_and_nested_ways_back(spark):
    key = "0123456789abcdef"
    ops = labelled.operators_from_dict({"A": {"type": "decrypt", "key": key}})
    assert ops == {"A": Operator("decrypt", {"key": key})}
    with pytest.raises(ValueError):
        labelled.operators_from_dict({"A": {}})
    sealed = spark.range(1).select(F.translate(F.base64(F.aes_encrypt(F.encode(F.lit("secret"), "UTF-8"), F.encode(F.lit(key), "UTF-8"), F.lit("CBC"), F.lit("PKCS"))), "+/", "-_")).head()[0]
    items = [(3, 3 + len(sealed), "A", sealed, "encrypt", 1.0)]
    text = f"ab {sealed} ef"
    shape = f"note string, tags array<string>, who struct<name:string,age:int>, found struct<note:array<{ITEM}>,tags:array<array<{ITEM}>>,who:struct<name:array<{ITEM}>>>"
    df = spark.createDataFrame([(text, ["x", text, None], (text, 3), (items, [None, items], (items,))), (None, None, None, (None, None, None))], shape)
    one, two = restore_nested(df, "found", ops).collect()
    assert (one.note, one.tags, one.who.name, one.who.age) == ("ab secret ef", ["x", "ab secret ef", None], "ab secret ef", 3)
    assert (two.note, two.tags, two.who) == (None, None, None)
    span = {"entity_type": "A", "start": 1, "end": 2, "score": 0.5, "recognizer": "r"}
    back = spark.createDataFrame([(json.dumps([span]),)], "j string").select(labelled.spans_from_json(F.col("j")).alias("s")).head().s
    assert [r.asDict() for r in back] == [span] and "entity_type" in NO_SPANS
