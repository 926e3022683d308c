"""What made queries slow on larger tables or different from their SQL, and what the mending must not change."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilspark import catalog_queries, queries, span_queries
from veilspark.functions import checksums
from veilspark.operators import evaluate, scan
from veilspark.operators.anonymize import Operator, anonymize, deanonymize
from veilspark.operators.rules import CATALOG
from veilspark.plans.engine import Analyzer, rewrite
from veilspark.streaming import counts

SF = Path("/root/testdata/sf0.001")
RULES = {r.name: r for r in CATALOG}
tables = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@tables
@pytest.mark.parametrize("name", ["analyze_full", "explain_context", "configured_rules", "deanonymize_keep", "scan_date", "scan_catalog", "analyze_documents_full", "entity_counts_by_lang"])
def test_no_filter_repeats_the_scan(spark, name):
    """A filter inferred from explode was moved below the scan and computed it again."""
    filters = [line for line in plan(queries.QUERIES[name](spark, str(SF))).split("\n") if line.lstrip(" :+-").startswith("Filter")]
    assert not [line for line in filters if "regexp_extract_all" in line or "aggregate(" in line]


def test_no_filter_repeats_the_scan_of_a_stream(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts, concat('at 1.2.3.', id) AS text FROM range(3)")
    found = counts.entity_counts(df, span_queries.ADDRESSES, "text", "ts")
    assert "Filter (size(" not in plan(found)
    assert [r.n for r in found.collect()] == [3]


@tables
def test_made_texts_are_spread(spark):
    """A small file has one row group, so one task made and scanned all texts."""
    n = spark.sparkContext.defaultParallelism
    assert span_queries._made(spark, str(SF), span_queries.NOTES).rdd.getNumPartitions() == n
    assert queries._derived(spark, str(SF)).rdd.getNumPartitions() == n
    assert span_queries._events(spark, str(SF)).rdd.getNumPartitions() == n
    assert "Repartition" in plan(catalog_queries.scan_catalog(spark, str(SF)))


def test_values_are_written_once(spark):
    """Spans to rewrite, tokens, and the parts of a check stood several times in one expression, and were computed as often."""
    assert str(rewrite(F.col("text"), F.col("marker"))).count("marker") == 1
    assert str(scan.drop_contained(F.col("marker"))).count("marker") == 1
    assert str(deanonymize(F.col("text"), F.col("marker"), {})).count("marker") == 1
    assert str(Analyzer((RULES["UsSsn"],)).spans(F.col("text"), tokens=F.col("marker"))).count("marker") == 1
    assert str(checksums.weighted(F.col("marker"), [1, 2, 3])).count("marker") == 1


def test_random_text_and_item_agree(spark):
    spans = F.array(scan.span("A", F.lit(0), F.lit(3), F.lit(1.0), "x"))
    row = spark.range(1).select(anonymize(F.lit("abc def"), spans, {"A": Operator("encrypt", {"key": "0123456789abcdef"})}).alias("r")).first().r
    assert row.text[row["items"][0].start : row["items"][0].end] == row["items"][0].text


def test_offsets_with_the_mark_in_the_text(spark):
    texts = ["a1b22", "\x01a1\x01b22\x01", "", "1", "\x0122"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scan.matches(F.col("t"), r"\d+").alias("m"))
    for r in df.collect():
        assert [r.t[m.start : m.end] for m in r.m] == [m.text for m in r.m]
        assert len(r.m) == {"a1b22": 2, "": 0, "1": 1, "\x0122": 1}.get(r.t, 2)


def test_a_guard_for_each_pattern(spark):
    assert len(RULES["Ip"].guards) == 5 and None not in RULES["Ip"].guards and RULES["Ip"].guards[2] != RULES["Ip"].guards[0]
    texts = {"host 10.20.30.40 up": "10.20.30.40", "host fe80::1 up": "fe80::1", "none 3.4 here": None, "at ::ffff:1.2.3.4 now": "::ffff:1.2.3.4"}
    got = {r.t: r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", scan.text_of(F.col("t"), F.try_element_at(scan.scan(F.col("t"), RULES["Ip"]), F.lit(1))).alias("s")).collect()}
    assert got == texts


def _rows(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a = r.randrange(12)
        out.append((r.choice([1, 2, 3, None]), r.choice(["A", "B", None]), r.choice([a, a, None]), r.choice([a, a + 1, a + 3, a + 7, None])))
    return out


SPANS = "doc_id long, label string, start int, end int"


@pytest.mark.parametrize("accept", [None, {"A": ["A", "B", "B"], "B": []}])
def test_hits_like_pairs(spark, accept):
    truth, found = _rows(1, 60), _rows(2, 80)
    t, f = spark.createDataFrame(truth, SPANS), spark.createDataFrame(found, SPANS)
    labels = lambda x: (accept or {}).get(x, [x])
    meet = lambda a, b: None not in (*a, *b) and a[0] == b[0] and a[1] in labels(b[1]) and a[2] < b[3] and b[2] < a[3]
    known = lambda b: None not in (b[0], b[2], b[3])
    got, scored = evaluate.hits(t, f, accept)
    key = lambda rows: sorted(map(repr, rows))
    assert key(map(tuple, got.collect())) == key((*a, any(meet(a, b) for b in found if known(b))) for a in truth)
    assert key(map(tuple, scored.collect())) == key((*b, any(meet(a, b) for a in truth)) for b in found)
    assert got.columns[:4] == t.columns and "Join" not in plan(got) + plan(scored)


def test_greedy_like_one_by_one(spark):
    truth, found = _rows(3, 60), _rows(4, 80)
    want: dict = {}
    for doc in (1, 2, 3, None):
        for label in ("A", "B", None):
            order = lambda x: [(v is not None, v or 0) for v in x[2:]]
            free = sorted((x for x in truth if x[:2] == (doc, label)), key=order)
            guesses = sorted((x for x in found if x[:2] == (doc, label)), key=order)
            n, tp = len(free), 0
            for g in guesses:
                spot = next((x for x in free if None not in (*x[2:], *g[2:]) and x[2] < g[3] and g[2] < x[3]), None)
                if spot is not None:
                    free.remove(spot)
                    tp += 1
            old = want.get(label, (0, 0, 0))
            want[label] = (old[0] + tp, old[1] + len(guesses) - tp, old[2] + n - tp)
    got = evaluate.greedy_counts(spark.createDataFrame(truth, SPANS), spark.createDataFrame(found, SPANS))
    assert {r.label: (r.tp, r.fp, r.fn) for r in got.collect()} == want
    assert "Pandas" not in plan(got)


def test_postal_codes_of_large_keys(spark, tmp_path):
    keys = [0, 79_999, 80_000, 89_999, 90_000, 899_999, 5_400_000]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    got = span_queries.languages_and_countries(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(k, "DE_PLZ", 8, 13, 0.4) for k in keys]


@pytest.mark.parametrize("behind", [" 192.168.12.40", " 4111 1111 1111 1111", " 12", ".", ""])
def test_a_phone_number_ends_before_what_follows(spark, behind):
    text = "call +1 (826) 555-4081" + behind
    found = spark.createDataFrame([(text,)], "t string").select(F.explode(scan.scan(F.col("t"), RULES["Phone"])).alias("s")).select("s.start", "s.end").collect()
    assert (5, 22) in {tuple(r) for r in found}


def test_a_foreign_phone_number_ends_before_an_address(spark):
    text = "call +44 20 7946 0958 192.168.12.40 or +33 1.23.45.67.89"
    found = spark.createDataFrame([(text,)], "t string").select(scan.scan(F.col("t"), RULES["Phone"]).alias("s")).first().s
    assert {text[s.start : s.end] for s in found} >= {"+44 20 7946 0958", "+33 1.23.45.67.89"}
