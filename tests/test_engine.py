"""Texts of the regex-only profile rewritten, and the parts that settle spans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilspark.operators import scan as S
from veilspark.operators.anonymize import Operator, anonymize, deanonymize
from veilspark.operators.context import enhance, tokens
from veilspark.operators.rules import CATALOG
from veilspark.plans.engine import Analyzer, rewrite

GOLDEN = [
    ("Paid with 5500-0055-5555-5559 today", "Paid with ************55-5559 today"),
    ("write to mia+lab@uni.example.org, then wait", "write to <EMAIL_ADDRESS>, then wait"),
    ("fax: +49 30 9018 2000 (desk 4)", "fax:  (desk 4)"),
    ("transfer FR1420041010050500013M02606 by noon", "transfer <ACCOUNT> by noon"),
    ("seen from 77.88.55.242 twice", "seen from 77.88.###### twice"),
    ("adapter 3c:22:fb:90:1e:a7 is new", "adapter <MAC_ADDRESS> is new"),
    ("from 2019-11-05 until 7/31/2020 inclusive", "from <DAY> until <DAY> inclusive"),
    ("docs at http://wiki.example.net/start", "docs at <LINK>"),
    ("trace 3d6f0a8e-5b1c-4c77-9e21-0f4b7a6d2c15 ended", "trace <UUID> ended"),
    ("not 3d6f0a8e-5b1c-4c77-1e21-0f4b7a6d2c15, not 5500-0055-5555-5558, not ff:ff:ff:ff:ff:ff", "not 3d6f0a8e-5b1c-4c77-1e21-0f4b7a6d2c15, not 5500-0055-5555-5558, not ff:ff:ff:ff:ff:ff"),
    ("", ""),
    (None, ""),
]
OPERATORS = {
    "CREDIT_CARD": Operator("mask", {"chars_to_mask": 12}), "PHONE_NUMBER": Operator("redact"), "IBAN_CODE": Operator("replace", {"new_value": "<ACCOUNT>"}), "DATE_TIME": Operator("replace", {"new_value": "<DAY>"}),
    "URL": Operator("replace", {"new_value": "<LINK>"}), "IP_ADDRESS": Operator("mask", {"masking_char": "#", "chars_to_mask": 6, "from_end": True}),
}


def test_golden_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "doc_id int, text string")
    out = Analyzer.regex_only().analyze(df).select("doc_id", rewrite(F.col("text"), F.col("spans"), OPERATORS, "regex_only")["text"].alias("out"))
    got = {r.doc_id: r.out for r in out.collect()}
    assert [got[i] for i in range(len(GOLDEN))] == [w for _, w in GOLDEN]


def _spans(spark, *rows):
    return spark.createDataFrame([([(*r, "x") for r in rows],)], f"spans {S.NO_SPANS}")


def _run(df, f):
    return [(s.entity_type, s.start, s.end, s.score) for s in df.select(f(F.col("spans")).alias("s")).head().s]


def test_dedupe_drops_contained_of_one_type(spark):
    df = _spans(spark, ("A", 0, 10, 0.5), ("A", 2, 5, 0.9), ("A", 2, 5, 0.9), ("A", 3, 4, 0.4), ("B", 3, 4, 0.4), ("A", 1, 2, 0.0))
    assert _run(df, S.dedupe) == [("A", 2, 5, 0.9), ("A", 0, 10, 0.5), ("B", 3, 4, 0.4)]


def test_conflicts(spark):
    df = _spans(spark, ("A", 0, 10, 0.3), ("B", 2, 5, 0.9))
    assert _run(df, S.drop_contained) == [("A", 0, 10, 0.3)]
    assert _run(df, S.simple_conflicts) == [("B", 2, 5, 0.9)]
    assert _run(_spans(spark, ("A", 0, 5, 0.3), ("A", 4, 9, 0.8)), S.merge_same_type) == [("A", 0, 9, 0.8)]
    assert _run(_spans(spark, ("A", 0, 5, 0.8), ("B", 3, 9, 0.8)), S.trim_overlaps) == [("A", 0, 5, 0.8), ("B", 5, 9, 0.8)]


def test_context_raises_scores(spark):
    rules = [r for r in CATALOG if r.name == "UsSsn"]
    df = spark.createDataFrame([("my ssn is 523-45-6788",), ("ref 523-45-6788",)], "text string")
    scores = [r.s[0].score for r in df.select(enhance(S.scan(F.col("text"), rules[0]), tokens(F.col("text")), rules).alias("s")).collect()]
    assert scores == [0.85, 0.5]


def test_encrypt_and_back(spark):
    key = "0123456789abcdef"
    df = _spans(spark, ("A", 3, 5, 0.5)).withColumn("text", F.lit("ab cd ef"))
    out = df.select(anonymize(F.col("text"), F.col("spans"), {"A": Operator("encrypt", {"key": key})}).alias("r")).select("r", deanonymize(F.col("r.text"), F.col("r.items"), {"A": Operator("decrypt", {"key": key})})["text"].alias("back")).head()
    assert out.back == "ab cd ef" and out.r.text != "ab cd ef"


@pytest.mark.parametrize("bad", [lambda: Operator(""), lambda: S.language_of(CATALOG, "xx", None, None), lambda: S.thresholds({"A": 2})])
def test_bad_configuration(bad):
    with pytest.raises(ValueError):
        bad()
