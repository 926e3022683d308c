"""Registered queries of what happens to spans: profiles, lists, thresholds, conflicts, entities, rewriting, evaluation.

Their texts and spans are made from columns by SQL that both engines run word for word.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import anonymize as A
from veilspark.operators import evaluate, ner, scan
from veilspark.operators.anonymize import Operator
from veilspark.operators.rules import CATALOG
from veilspark.plans.engine import Analyzer, restore_nested, rewrite, scrub_nested
from veilspark.sources import labelled
from veilspark.sources.spread import spread
from veilspark.streaming import counts

RULES = {r.name: r for r in CATALOG}
Query = Callable[[SparkSession, str], DataFrame]

#: A number and an address in a sentence with words of context; the address holds no date.
NOTES = """
SELECT c_custkey AS doc_id, k, ip, 'Please note my social security number is ' || k || ' and the host ' || ip || ' is down' AS text FROM (
  SELECT c_custkey, substr(n, 1, 3) || '-' || substr(n, 4, 2) || '-' || substr(n, 6, 4) AS k, cast(50 + c_custkey % 40 AS string) || '.' || cast(50 + c_custkey % 7 AS string) || '.' || cast(60 + c_custkey % 190 AS string) || '.' || cast(50 + c_custkey % 11 AS string) AS ip
  FROM (SELECT c_custkey, lpad(cast((c_custkey * 7919 + 31) % 899999999 AS string), 9, '0') AS n FROM customer) x) y
"""
#: Up to three overlapping spans of two types for each customer.
SPANS = """
SELECT c_custkey AS doc_id, i, CASE WHEN (c_custkey + i * 7) % 5 < 3 THEN 'A' ELSE 'B' END AS t, cast(c_custkey * (7 + 4 * i) % 12 AS int) AS s, cast(c_custkey * (7 + 4 * i) % 12 + 1 + c_custkey * (3 + i) % 9 AS int) AS e, cast((c_custkey * 5 + i * 3) % 10 AS double) / 10 AS r
FROM customer CROSS JOIN (VALUES (0), (1), (2)) AS v(i)
"""
COLOURS = """
SELECT c_custkey AS doc_id, a, b, 'a ' || a || ', ' || b || ' end' AS text FROM (SELECT c_custkey,
  CASE c_custkey % 5 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' WHEN 2 THEN 'green' WHEN 3 THEN 'Red' ELSE 'reddish' END AS a,
  CASE c_custkey % 7 WHEN 0 THEN 'blue' WHEN 1 THEN 'red' WHEN 2 THEN 'Red' ELSE 'plain' END AS b FROM customer) x
"""


def _made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM customer", "FROM {customer}"), customer=spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")))


def _told(df: DataFrame, spans: Column) -> DataFrame:
    """One row a span, in columns that both engines have."""
    flat = scan.exploded(df, spans, "doc_id")
    return flat.select("doc_id", F.col("s.entity_type").alias("entity_type"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end_"), F.round("s.score", 3).alias("score"))


def _gathered(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """``(doc_id, spans)`` of SPANS, in the order of ``i``."""
    rows = _made(spark, sf_dir, SPANS).filter(F.col("i") < most)
    each = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "t", "s", "e", "r"))).alias("p"))
    return each.select("doc_id", F.transform("p", lambda p: scan.span(p["t"], p["s"], p["e"], p["r"], F.lit("x"))).alias("spans"))


def _of_spans(change: Callable[[Column], Column], most: int = 3) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _gathered(spark, sf_dir, most)
        return _told(df, change(F.col("spans")))

    return query


FULL = Analyzer(threshold=0.4)


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOTES with the spans of the full profile."""
    return FULL.analyze(_made(spark, sf_dir, NOTES))


def analyze_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full profile with all its enabled rules: scan, context, threshold, then dedupe."""
    return _told(_full(spark, sf_dir), F.col("spans"))


def analyze_documents_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full profile over whole documents: how many spans of certain kinds each has, and a score each."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kinds = ["EMAIL_ADDRESS", "CREDIT_CARD", "IP_ADDRESS"]
    spans = scan.exploded(Analyzer(threshold=0.6).analyze(docs, entities=kinds), "spans", "doc_id")
    return spans.groupBy("doc_id", F.col("s.entity_type").alias("entity_type")).agg(F.count("*").alias("n"), F.round(F.max("s.score"), 3).alias("score"))


def anonymize_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis and rewriting of the full profile: a mask from the start, a salted hash, the default for others."""
    df = _full(spark, sf_dir)
    operators = {"US_SSN": Operator("mask", {"masking_char": "#", "chars_to_mask": 7, "from_end": False}), "IP_ADDRESS": Operator("hash", {"salt": "0123456789abcdef"})}
    return df.select("doc_id", rewrite(F.col("text"), F.col("spans"), operators)["text"].alias("text"))


def anonymize_mask_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask from the end, an empty masking sign that deletes, and more signs than the text has."""
    df, spans = _full(spark, sf_dir), F.col("spans")
    masked = lambda char, n, end: rewrite(F.col("text"), spans, {"DEFAULT": Operator("mask", {"masking_char": char, "chars_to_mask": n, "from_end": end})})["text"]
    return df.select("doc_id", masked("*", 4, True).alias("tail"), masked("", 4, False).alias("shorter"), masked("x", 100, False).alias("whole"), masked("x", -1, False).alias("none"))


def anonymize_custom_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Column function as operator, an operator of one's own, and the default that an entity without one gets."""
    A.add_operator("spell", lambda op, text, entity: F.concat(F.lower(entity), F.lit("="), F.length(text).cast("string")))
    try:
        df, spans = _full(spark, sf_dir), F.col("spans")
        one = rewrite(F.col("text"), spans, {"US_SSN": Operator("custom", {"lambda": lambda c: F.reverse(c)}), "DEFAULT": Operator("keep")})
        two = rewrite(F.col("text"), spans, {"IP_ADDRESS": Operator("spell")})
        return df.select("doc_id", one["text"].alias("reversed"), two["text"].alias("spelled"), F.size(one["items"]).cast("long").alias("n_items"))
    finally:
        A.remove_operator("spell")


def deanonymize_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way back for one entity while another stays as it is."""
    key = "0123456789abcdef"
    sealed = _full(spark, sf_dir).select("doc_id", rewrite(F.col("text"), F.col("spans"), {"US_SSN": Operator("encrypt", {"key": key})}).alias("r"))
    back = A.deanonymize(F.col("r.text"), F.col("r.items"), {"US_SSN": Operator("decrypt", {"key": key}), "IP_ADDRESS": Operator("deanonymize_keep")})
    return sealed.select("doc_id", back["text"].alias("text"))


def explain_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision process: scores before and after context, and the word that raised them."""
    df = scan.exploded(FULL.explain(_made(spark, sf_dir, NOTES)), "explained", "doc_id")
    return df.select("doc_id", F.col("s.entity_type").alias("entity_type"), F.col("s.text").alias("matched"), F.round("s.original_score", 3).alias("original_score"), F.round("s.score", 3).alias("score"), F.coalesce("s.context_word", F.lit("-")).alias("context_word"))


def context_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a number under several enhancers, words given from outside, and none."""
    df = _made(spark, sf_dir, NOTES).withColumn("ref", F.concat(F.lit("ref "), F.col("k")))
    rule = (RULES["UsSsn"],)
    score = lambda text, **o: F.coalesce(F.round(F.try_element_at(Analyzer(rule, **{k: v for k, v in o.items() if k == "enhancer"}).spans(F.col(text), context=o.get("context", ())), F.lit(1))["score"], 3), F.lit(-1.0))
    strict = dataclasses.replace(FULL.enhancer, mode="whole_word", factor=0.1, floor=0.2)
    none = dataclasses.replace(FULL.enhancer, prefix=0)
    return df.select("doc_id", score("text").alias("usual"), score("text", enhancer=strict).alias("whole_word"), score("text", enhancer=none).alias("no_window"), score("ref").alias("without"), score("ref", context=("ssn",)).alias("given"))


def score_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which thresholds hold: the request's, an entity's, a recognizer's default, the engine's."""
    df = _gathered(spark, sf_dir)
    named = F.transform("spans", lambda s: scan.span(s["entity_type"], s["start"], s["end"], s["score"], F.when(s["entity_type"] == "A", "one").otherwise("two")))
    rules = [dataclasses.replace(RULES["Url"], name="one", thresholds=(("A", 0.5),)), dataclasses.replace(RULES["Url"], name="two", thresholds=(("C", 0.9), ("default", 0.3)))]
    n = lambda spans: F.size(spans).cast("long")
    return df.select("doc_id", n(scan.above(named, 0.2, rules)).alias("own"), n(scan.above(named, 0.2, rules, 0.7)).alias("request"), n(scan.above(named, 0.2)).alias("engine"))


def _colours(spark: SparkSession, sf_dir: str, change: Callable[[Column, Column], Column]) -> DataFrame:
    df = _made(spark, sf_dir, COLOURS)
    rule = scan.deny_rule("Colours", "COLOUR", ["red", "blue"])
    return _told(df, change(scan.scan(F.col("text"), rule), F.col("text")))


def deny_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _colours(spark, sf_dir, lambda spans, text: spans)


def allow_list_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _colours(spark, sf_dir, lambda spans, text: scan.without(spans, text, ["blue", "Red", ""]))


def allow_list_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _colours(spark, sf_dir, lambda spans, text: scan.without(spans, text, ["^BL", "zz"], "regex"))


def languages_and_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of another language and of named countries only, from rules that are off by default."""
    df = _made(spark, sf_dir, "SELECT c_custkey AS doc_id, 'Die PLZ ' || cast(10000 + c_custkey % 80000 AS string) || ' im Ort' AS text FROM customer")
    return _told(df, Analyzer(CATALOG).spans(F.col("text"), language="de", countries=["de"], entities=["DE_PLZ", "DE_TAX_ID"]))


def configured_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognizers from a configuration file: a pattern with context and thresholds, and a deny list."""
    text = """
supported_languages: [en]
default_score_threshold: 0.3
recognizers:
  - name: Host
    type: custom
    supported_entity: HOST
    patterns: [{name: host, regex: '\\bhost\\b', score: 0.35}]
  - name: Polite
    type: custom
    supported_entity: POLITE
    deny_list: [please, thanks]
    deny_list_score: 0.8
  - {name: Off, type: custom, supported_entity: OFF, enabled: false, patterns: [{name: x, regex: note, score: 0.9}]}
  - {name: Ip, type: predefined}
"""
    df = _made(spark, sf_dir, NOTES)
    return _told(df, labelled.analyzer_from(text).spans(F.col("text")))


def supplied_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's entities in a column: mapped, ignored, scaled and left out as its configuration says."""
    df = _made(spark, sf_dir, "SELECT c_custkey AS doc_id, CASE c_custkey % 6 WHEN 0 THEN 'PER' WHEN 1 THEN 'GPE' WHEN 2 THEN 'ORG' WHEN 3 THEN 'CARDINAL' WHEN 4 THEN 'NORP' ELSE 'DATE' END AS label, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE cast(c_custkey % 10 AS double) / 10 END AS p FROM customer")
    entities = F.array(F.struct("label", F.lit(2).alias("start"), F.lit(5).alias("end"), F.col("p").alias("score")))
    config = ner.NerConfig(ignore=("CARDINAL", "NRP"), low_score=("ORGANIZATION",))
    return _told(df, ner.ner_spans(entities, config, ["PERSON", "LOCATION", "ORGANIZATION", "NRP"]))


def dedupe_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_spans(scan.dedupe)(spark, sf_dir)


def conflict_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_spans(scan.drop_contained)(spark, sf_dir)


def merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of one type with only spaces between become one."""
    df = _made(spark, sf_dir, "SELECT c_custkey AS doc_id, cast(c_custkey % 4 AS int) AS g, 'abc' || repeat(CASE WHEN c_custkey % 3 = 0 THEN ',' ELSE ' ' END, cast(c_custkey % 4 AS int)) || 'def' AS text, CASE WHEN c_custkey % 5 = 0 THEN 'B' ELSE 'A' END AS t FROM customer")
    spans = F.array(scan.span(F.lit("A"), F.lit(0), F.lit(3), F.lit(0.9), F.lit("x")), scan.span(F.col("t"), F.col("g") + 3, F.col("g") + 6, F.lit(0.4), F.lit("x")))
    return _told(df, scan.merge_spaces(spans, F.col("text")))


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans to JSON and back."""
    df = _gathered(spark, sf_dir)
    return _told(df, labelled.spans_from_json(labelled.to_json(F.col("spans"))))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = lambda n: F.concat(F.lit("60.70.80."), (F.lit(50) + F.col("event_id") % n).cast("string"))
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id"))
    who = F.struct(F.concat(F.lit("seen at "), ip(90)).alias("note"), F.col("user_id").alias("n"))
    return events.select(F.col("event_id").alias("doc_id"), F.concat(F.lit("from "), ip(100)).alias("note"), F.array(ip(80), F.lit("none"), F.lit(None)).alias("tags"), who.alias("who"), F.create_map(F.lit("k"), ip(70)).alias("props"), ip(60).alias("raw"))


ADDRESSES = Analyzer((RULES["Ip"],), "regex_only")


def scrub_nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings in columns, structs, arrays and maps rewritten; one column left alone."""
    out = scrub_nested(_events(spark, sf_dir), ADDRESSES, {"IP_ADDRESS": Operator("replace", {"new_value": "X"})}, skip=["raw"])
    return out.select("doc_id", "note", F.array_join("tags", "|", "null").alias("tags"), F.col("who.note").alias("who_note"), F.col("who.n").alias("n"), F.element_at("props", "k").alias("prop"), "raw")


def restore_nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested way there and back: encrypted with items, then decrypted by them."""
    key = "0123456789abcdef"
    sealed = scrub_nested(_events(spark, sf_dir), ADDRESSES, {"IP_ADDRESS": Operator("encrypt", {"key": key})}, skip=["raw"], items_col="found")
    out = restore_nested(sealed, "found", {"IP_ADDRESS": Operator("decrypt", {"key": key})})
    return out.select("doc_id", "note", F.array_join("tags", "|", "null").alias("tags"), F.col("who.note").alias("who_note"), F.element_at("props", "k").alias("prop"))


def stream_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses by day in a stream that has come to its end (an addition: the windows are event time with a watermark)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    notes = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("from 60.70.80."), (F.lit(50) + F.col("event_id") % 100).cast("string"), F.when(F.col("event_id") % 3 == 0, " and 60.70.80.99").otherwise("")).alias("text"))
    name = f"veilspark_counts_{abs(hash((sf_dir, id(stream))))}"
    query = counts.entity_counts(notes, ADDRESSES, "text", "ts").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.floor(F.col("window_start").cast("long") / 86400).alias("day"), "entity_type", "n")


def _truth_and_found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _made(spark, sf_dir, SPANS).select("doc_id", F.col("t").alias("label"), F.col("s").alias("start"), F.col("e").alias("end"), "i")
    named = lambda df: df.select(*evaluate.SPAN_COLUMNS).distinct()
    extra = F.when(F.col("doc_id") % 11 == 0, "C").otherwise(F.col("label"))
    return named(rows.filter("i = 0").withColumn("label", F.when(F.col("doc_id") % 13 == 0, "D").otherwise(F.col("label")))), named(rows.filter("i > 0").withColumn("label", extra))


def evaluate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.totals(*evaluate.hits(*_truth_and_found(spark, sf_dir)))


def evaluate_accepted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by label where a prediction may stand for several labels of the truth."""
    truth, found = _truth_and_found(spark, sf_dir)
    return evaluate.recall_by_label(evaluate.hits(truth, found, {"A": ["A", "D"], "C": ["B"]})[0])


def evaluate_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches with their rates and the micro average."""
    counted = evaluate.with_rates(evaluate.greedy_counts(*_truth_and_found(spark, sf_dir)))
    shown = lambda c: F.round(F.when(F.isnan(c), -1.0).otherwise(F.col(c)), 6).alias(c)
    return counted.select("label", "tp", "fp", "fn", shown("precision"), shown("recall"))


def evaluate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.documents_cleaned(evaluate.hits(*_truth_and_found(spark, sf_dir))[0])


def evaluate_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.unmatched_labels(*_truth_and_found(spark, sf_dir))


def evaluate_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans are scored, and how many when labels that the truth never has count as spurious."""
    truth, found = _truth_and_found(spark, sf_dir)
    a, b = evaluate.split_reach(truth, found)
    _, c = evaluate.split_reach(truth, found, unmeasurable_is_spurious=True)
    names = ("reachable", "measurable", "predicted")
    each = [df.agg(F.count("*").alias("n")).select(*[F.when(F.lit(name == other), F.col("n")).alias(other) for other in names]) for name, df in zip(names, (a, b, c), strict=True)]
    return each[0].unionByName(each[1]).unionByName(each[2]).agg(*[F.sum(n).alias(n) for n in names])


def architecture_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two analyzers over the same notes against the same truth."""
    notes = _made(spark, sf_dir, NOTES)
    truth = notes.select("doc_id", F.explode(F.array(F.struct(F.lit("US_SSN").alias("label"), F.instr("text", F.col("k")).alias("a"), F.length("k").alias("n")), F.struct(F.lit("IP_ADDRESS").alias("label"), F.instr("text", F.col("ip")).alias("a"), F.length("ip").alias("n")))).alias("t"))
    truth = truth.select("doc_id", "t.label", (F.col("t.a") - 1).alias("start"), (F.col("t.a") - 1 + F.col("t.n")).alias("end"))

    def scored(analyzer: Analyzer) -> DataFrame:
        found = _told(analyzer.analyze(notes, entities=["US_SSN", "IP_ADDRESS"]), F.col("spans")).select("doc_id", F.col("entity_type").alias("label"), "start", F.col("end_").alias("end"))
        return evaluate.totals(*evaluate.hits(truth, found))

    return evaluate.compare(scored(Analyzer.regex_only(0.4)), scored(FULL))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        analyze_full, analyze_documents_full, anonymize_full, anonymize_mask_end, anonymize_custom_function, deanonymize_keep, explain_context, context_modes, score_thresholds, deny_list_scan, allow_list_exact, allow_list_regex,
        languages_and_countries, configured_rules, supplied_entities, dedupe_spans, conflict_drop, merge_adjacent, json_roundtrip, scrub_nested_events, restore_nested_events, stream_entity_counts, evaluate_totals,
        evaluate_accepted_labels, evaluate_greedy, evaluate_documents, evaluate_unmatched, evaluate_reach, architecture_comparison,
    )
} | {"simple_conflicts": _of_spans(scan.simple_conflicts, 2), "merge_same_type": _of_spans(scan.merge_same_type, 2), "trim_intersections": _of_spans(scan.trim_overlaps, 2)}

_BAD = "(substr(k, 5, 2) = '00' OR substr(k, 8, 4) = '0000' OR substr(k, 1, 3) IN ('000', '666') OR replace(k, '-', '') IN ('123456789', '987654320', '078051120'))"
_PLACES = f"SELECT *, NOT {_BAD} AS ok, length('Please note my social security number is ') AS a, length('Please note my social security number is ') + 11 + length(' and the host ') AS b FROM ({NOTES})"
_HEAD, _MID, _TAIL = "'Please note my social security number is '", "' and the host '", "' is down'"


def _notes(ssn: str, ip: str) -> str:
    return f"{_HEAD} || {ssn} || {_MID} || {ip} || {_TAIL}"


_TWO = f"""
WITH p AS (SELECT * FROM ({SPANS}) WHERE i < 2),
q AS (SELECT x.doc_id, x.t AS t1, x.s AS s1, x.e AS e1, x.r AS r1, y.t AS t2, y.s AS s2, y.e AS e2, y.r AS r2, x.s < y.e AND y.s < x.e AS hit FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.i = 0 AND y.i = 1)
"""
_SPAN_COLUMNS = "doc_id, t AS entity_type, cast(s AS bigint) AS start, cast(e AS bigint) AS end_, round(r, 3) AS score"
_EVAL = f"""
WITH r AS (SELECT doc_id, t, s, e, i FROM ({SPANS})),
truth AS (SELECT DISTINCT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'D' ELSE t END AS label, s, e FROM r WHERE i = 0),
pred AS (SELECT DISTINCT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'C' ELSE t END AS label, s, e FROM r WHERE i > 0),
got AS (SELECT *, EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = t.doc_id AND p.label = t.label AND t.s < p.e AND p.s < t.e) AS found FROM truth t),
scored AS (SELECT *, EXISTS (SELECT 1 FROM truth t WHERE p.doc_id = t.doc_id AND p.label = t.label AND t.s < p.e AND p.s < t.e) AS hit FROM pred p)
"""
_COLOUR_SQL = f"""
SELECT doc_id, 'COLOUR' AS entity_type, cast(start AS bigint) AS start, cast(start + length(w) AS bigint) AS end_, 1.0::DOUBLE AS score FROM (
  SELECT doc_id, a AS w, 2 AS start FROM ({COLOURS}) UNION ALL SELECT doc_id, b, 4 + length(a) FROM ({COLOURS})) WHERE <which>
"""
_EVENT_IP = "'60.70.80.' || cast(50 + event_id % {n} AS varchar)"

# The documents' own addresses and numbers, as far as the tables hold any.
_LUHN = "list_sum(list_transform(range(1, length(c) + 1), lambda j: (CASE WHEN j % 2 = 1 THEN cast(c[-j] AS int) WHEN cast(c[-j] AS int) > 4 THEN cast(c[-j] AS int) * 2 - 9 ELSE cast(c[-j] AS int) * 2 END))) % 10 = 0"
_CARD = r"\b(?:4\d{3}|5[0-5]\d{2}|6\d{3}|1\d{3}|3\d{3})[- ]?\d{3,4}[- ]?\d{3,4}[- ]?\d{3,5}\b"
_IN_DOCUMENTS = rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}_.+-]+@mail[0-9]+\.example\.com') AS emails,
  list_filter(list_filter(regexp_extract_all(text, '{_CARD}'), lambda c: regexp_matches(c, '^[0-9]+$') AND NOT regexp_matches(c, '^1[0-9]{{12}}$')), lambda c: {_LUHN}) AS cards,
  list_filter(regexp_extract_all(text, '\b(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(?:\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)){{3}}\b'), lambda a: NOT regexp_matches(a, '(^|\.)0[0-9]')) AS ips,
  regexp_extract_all(text, '\+1 \([0-9]{{3}}\) 555-[0-9]{{4}}') AS phones FROM documents)
"""
#: The documents' four kinds rewritten as ``mask_documents`` does.
MASKED_SQL = rf"""{_IN_DOCUMENTS}
SELECT doc_id, cast(len(emails) + len(cards) + len(ips) + len(phones) AS bigint) AS n_spans, regexp_replace(regexp_replace(
  list_reduce(list_concat([list_reduce(list_concat([coalesce(text, '')], cards), lambda t, c: replace(t, c, repeat('*', length(c))))], ips), lambda t, a: replace(t, a, '<IP_ADDRESS>')),
  '[\p{{L}}\p{{N}}_.+-]+@mail[0-9]+\.example\.com', '<EMAIL_ADDRESS>', 'g'), '\+1 \([0-9]{{3}}\) 555-[0-9]{{4}}', '<PHONE_NUMBER>', 'g') AS text FROM d
"""

ORACLES: dict[str, str] = {
    "analyze_documents_full": f"""{_IN_DOCUMENTS} SELECT * FROM (SELECT doc_id, 'EMAIL_ADDRESS' AS entity_type, cast(len(emails) AS bigint) AS n, 1.0::DOUBLE AS score FROM d UNION ALL SELECT doc_id, 'CREDIT_CARD', cast(len(cards) AS bigint), 1.0::DOUBLE FROM d
  UNION ALL SELECT doc_id, 'IP_ADDRESS', cast(len(ips) AS bigint), 0.6::DOUBLE FROM d) WHERE n > 0""",
    "analyze_full": f"SELECT doc_id, 'US_SSN' AS entity_type, cast(a AS bigint) AS start, cast(a + 11 AS bigint) AS end_, 0.85::DOUBLE AS score FROM ({_PLACES}) WHERE ok UNION ALL SELECT doc_id, 'IP_ADDRESS', cast(b AS bigint), cast(b + length(ip) AS bigint), 0.6::DOUBLE FROM ({_PLACES})",
    "anonymize_full": f"SELECT doc_id, {_notes(chr(40) + 'CASE WHEN ok THEN ' + repr('#######') + ' || substr(k, 8) ELSE k END' + chr(41), 'sha256(ip || ' + repr('0123456789abcdef') + ')')} AS text FROM ({_PLACES})",
    "anonymize_mask_end": f"""SELECT doc_id, {_notes("(CASE WHEN ok THEN substr(k, 1, 7) || '****' ELSE k END)", "substr(ip, 1, length(ip) - 4) || '****'")} AS tail, {_notes("(CASE WHEN ok THEN substr(k, 5) ELSE k END)", "substr(ip, 5)")} AS shorter,
  {_notes("(CASE WHEN ok THEN repeat('x', 11) ELSE k END)", "repeat('x', length(ip))")} AS whole, text AS "none" FROM ({_PLACES})""",
    "anonymize_custom_function": f"""SELECT doc_id, {_notes("(CASE WHEN ok THEN reverse(k) ELSE k END)", "ip")} AS reversed, {_notes("(CASE WHEN ok THEN '<US_SSN>' ELSE k END)", "'ip_address=' || cast(length(ip) AS varchar)")} AS spelled, cast(1 + cast(ok AS int) AS bigint) AS n_items FROM ({_PLACES})""",
    "deanonymize_keep": f"""SELECT doc_id, {_notes("k", "'<IP_ADDRESS>'")} AS text FROM ({_PLACES})""",
    "explain_context": f"SELECT doc_id, 'US_SSN' AS entity_type, k AS matched, 0.5::DOUBLE AS original_score, 0.85::DOUBLE AS score, 'social' AS context_word FROM ({_PLACES}) WHERE ok UNION ALL SELECT doc_id, 'IP_ADDRESS', ip, 0.6::DOUBLE, 0.6::DOUBLE, '-' FROM ({_PLACES})",
    "context_modes": f"SELECT doc_id, CASE WHEN ok THEN 0.85::DOUBLE ELSE -1.0::DOUBLE END AS usual, CASE WHEN ok THEN 0.6::DOUBLE ELSE -1.0::DOUBLE END AS whole_word, CASE WHEN ok THEN 0.5::DOUBLE ELSE -1.0::DOUBLE END AS no_window, CASE WHEN ok THEN 0.5::DOUBLE ELSE -1.0::DOUBLE END AS without, CASE WHEN ok THEN 0.85::DOUBLE ELSE -1.0::DOUBLE END AS given FROM ({_PLACES})",
    "score_thresholds": f"SELECT doc_id, count(*) FILTER (r >= CASE t WHEN 'A' THEN 0.5 ELSE 0.3 END) AS own, count(*) FILTER (r >= 0.7) AS request, count(*) FILTER (r >= 0.2) AS engine FROM ({SPANS}) GROUP BY doc_id",
    "deny_list_scan": _COLOUR_SQL.replace("<which>", "lower(w) IN ('red', 'blue')"),
    "allow_list_exact": _COLOUR_SQL.replace("<which>", "w = 'red'"),
    "allow_list_regex": _COLOUR_SQL.replace("<which>", "lower(w) = 'red'"),
    "languages_and_countries": "SELECT c_custkey AS doc_id, 'DE_PLZ' AS entity_type, 8::BIGINT AS start, 13::BIGINT AS end_, 0.4::DOUBLE AS score FROM customer",
    "configured_rules": f"""SELECT doc_id, 'POLITE' AS entity_type, 0::BIGINT AS start, 6::BIGINT AS end_, 0.8::DOUBLE AS score FROM ({_PLACES}) UNION ALL SELECT doc_id, 'HOST', cast(b - 5 AS bigint), cast(b - 1 AS bigint), 0.35::DOUBLE FROM ({_PLACES})
UNION ALL SELECT doc_id, 'IP_ADDRESS', cast(b AS bigint), cast(b + length(ip) AS bigint), 0.6::DOUBLE FROM ({_PLACES})""",
    "supplied_entities": """SELECT c_custkey AS doc_id, CASE c_custkey % 6 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'LOCATION' ELSE 'ORGANIZATION' END AS entity_type, 2::BIGINT AS start, 5::BIGINT AS end_,
  round((CASE WHEN c_custkey % 4 = 0 THEN 0.85::DOUBLE ELSE cast(c_custkey % 10 AS double) / 10 END) * CASE WHEN c_custkey % 6 = 2 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END, 3) AS score FROM customer WHERE c_custkey % 6 < 3""",
    "dedupe_spans": f"""WITH p AS (SELECT DISTINCT doc_id, t, s, e, r FROM ({SPANS}) WHERE r > 0)
SELECT {_SPAN_COLUMNS} FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.doc_id = x.doc_id AND y.t = x.t AND y.s <= x.s AND y.e >= x.e AND (-y.r, y.s, y.s - y.e) < (-x.r, x.s, x.s - x.e))""",
    "conflict_drop": f"""WITH p AS ({SPANS})
SELECT {_SPAN_COLUMNS} FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.doc_id = x.doc_id AND y.i <> x.i AND y.s <= x.s AND y.e >= x.e AND (y.s < x.s OR y.e > x.e OR y.r > x.r OR (y.r = x.r AND y.i < x.i)))""",
    "simple_conflicts": f"""{_TWO}, f AS (SELECT *, (-r1, s1 - e1, s1, t1) <= (-r2, s2 - e2, s2, t2) AS first FROM q)
SELECT {_SPAN_COLUMNS} FROM (SELECT doc_id, t1 AS t, s1 AS s, e1 AS e, r1 AS r FROM f WHERE NOT hit OR first UNION ALL SELECT doc_id, t2, s2, e2, r2 FROM f WHERE NOT hit OR NOT first)""",
    "merge_same_type": f"""{_TWO} SELECT {_SPAN_COLUMNS} FROM (SELECT doc_id, t1 AS t, least(s1, s2) AS s, greatest(e1, e2) AS e, greatest(r1, r2) AS r FROM q WHERE hit AND t1 = t2
  UNION ALL SELECT doc_id, t1, s1, e1, r1 FROM q WHERE NOT (hit AND t1 = t2) UNION ALL SELECT doc_id, t2, s2, e2, r2 FROM q WHERE NOT (hit AND t1 = t2))""",
    "trim_intersections": f"""{_TWO}, o AS (SELECT *, (s1, e1, -r1, t1) <= (s2, e2, -r2, t2) AS asc_ FROM q),
f AS (SELECT doc_id, hit, CASE WHEN asc_ THEN t1 ELSE t2 END AS ta, CASE WHEN asc_ THEN s1 ELSE s2 END AS sa, CASE WHEN asc_ THEN e1 ELSE e2 END AS ea, CASE WHEN asc_ THEN r1 ELSE r2 END AS ra,
  CASE WHEN asc_ THEN t2 ELSE t1 END AS tb, CASE WHEN asc_ THEN s2 ELSE s1 END AS sb, CASE WHEN asc_ THEN e2 ELSE e1 END AS eb, CASE WHEN asc_ THEN r2 ELSE r1 END AS rb FROM o)
SELECT {_SPAN_COLUMNS} FROM (SELECT doc_id, ta AS t, sa AS s, CASE WHEN hit AND ra < rb THEN sb ELSE ea END AS e, ra AS r FROM f UNION ALL SELECT doc_id, tb, CASE WHEN hit AND ra >= rb THEN ea ELSE sb END, eb, rb FROM f) WHERE s <= e""",
    "merge_adjacent": """WITH p AS (SELECT c_custkey AS doc_id, c_custkey % 4 AS g, c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 4 > 0 AS one, CASE WHEN c_custkey % 5 = 0 THEN 'B' ELSE 'A' END AS t FROM customer)
SELECT doc_id, 'A' AS entity_type, 0::BIGINT AS start, cast(CASE WHEN one THEN g + 6 ELSE 3 END AS bigint) AS end_, CASE WHEN one THEN 0.4::DOUBLE ELSE 0.9::DOUBLE END AS score FROM p UNION ALL SELECT doc_id, t, cast(g + 3 AS bigint), cast(g + 6 AS bigint), 0.4::DOUBLE FROM p WHERE NOT one""",
    "json_roundtrip": f"SELECT {_SPAN_COLUMNS} FROM ({SPANS})",
    "scrub_nested_events": f"SELECT event_id AS doc_id, 'from X' AS note, 'X|none|null' AS tags, 'seen at X' AS who_note, user_id AS n, 'X' AS prop, {_EVENT_IP.format(n=60)} AS raw FROM events",
    "restore_nested_events": f"SELECT event_id AS doc_id, 'from ' || {_EVENT_IP.format(n=100)} AS note, {_EVENT_IP.format(n=80)} || '|none|null' AS tags, 'seen at ' || {_EVENT_IP.format(n=90)} AS who_note, {_EVENT_IP.format(n=70)} AS prop FROM events",
    "stream_entity_counts": "SELECT cast(epoch(date_trunc('day', ts)) AS bigint) // 86400 AS day, 'IP_ADDRESS' AS entity_type, cast(sum(1 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) AS bigint) AS n FROM events GROUP BY 1",
    "evaluate_totals": f"""{_EVAL}, a AS (SELECT count(*) FILTER (found) AS found, count(*) AS total FROM got), b AS (SELECT count(*) FILTER (hit) AS hit, count(*) AS predicted FROM scored)
SELECT found, total, hit, predicted, round(found / total, 3) AS recall, round(hit / predicted, 3) AS "precision", round(2 * (found / total) * (hit / predicted) / (found / total + hit / predicted), 3) AS f1 FROM a, b""",
    "evaluate_accepted_labels": f"""{_EVAL}, g AS (SELECT t.label, EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = t.doc_id AND t.label IN (CASE p.label WHEN 'C' THEN 'B' ELSE p.label END, CASE p.label WHEN 'A' THEN 'D' ELSE p.label END) AND (p.label <> 'C' OR t.label = 'B') AND t.s < p.e AND p.s < t.e) AS found FROM truth t)
SELECT label, count(*) FILTER (found) AS found, count(*) FILTER (NOT found) AS missed, count(*) AS total, round(count(*) FILTER (found) / count(*), 3) AS recall FROM g GROUP BY label""",
    "evaluate_greedy": f"""{_EVAL}, c AS (SELECT coalesce(t.label, p.label) AS label, least(coalesce(t.n, 0), coalesce(p.hits, 0)) AS tp, coalesce(p.n, 0) - least(coalesce(t.n, 0), coalesce(p.hits, 0)) AS fp, coalesce(t.n, 0) - least(coalesce(t.n, 0), coalesce(p.hits, 0)) AS fn
  FROM (SELECT doc_id, label, count(*) AS n FROM truth GROUP BY ALL) t FULL JOIN (SELECT doc_id, label, count(*) AS n, count(*) FILTER (hit) AS hits FROM scored GROUP BY ALL) p ON t.doc_id = p.doc_id AND t.label = p.label),
d AS (SELECT label, cast(coalesce(sum(tp), 0) AS bigint) AS tp, cast(sum(fp) AS bigint) AS fp, cast(sum(fn) AS bigint) AS fn FROM c GROUP BY label), m AS (SELECT * FROM d UNION ALL SELECT 'MICRO-AVERAGE', cast(sum(tp) AS bigint), cast(sum(fp) AS bigint), cast(sum(fn) AS bigint) FROM d)
SELECT label, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE -1 END AS "precision", CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE -1 END AS recall FROM m""",
    "evaluate_documents": f"{_EVAL} SELECT CASE WHEN k = n THEN 'full' WHEN k > 0 THEN 'part' ELSE 'none' END AS outcome, count(*) AS documents FROM (SELECT doc_id, count(*) FILTER (found) AS k, count(*) AS n FROM got GROUP BY doc_id) GROUP BY 1",
    "evaluate_unmatched": f"""{_EVAL} SELECT label, 'unmeasurable' AS side, count(*) AS spans FROM pred WHERE label NOT IN (SELECT label FROM truth) GROUP BY label UNION ALL SELECT label, 'unreachable', count(*) FROM truth WHERE label NOT IN (SELECT label FROM pred) GROUP BY label""",
    "evaluate_reach": f"{_EVAL} SELECT (SELECT count(*) FROM truth WHERE label IN (SELECT label FROM pred)) AS reachable, (SELECT count(*) FROM pred WHERE label IN (SELECT label FROM truth)) AS measurable, (SELECT count(*) FROM pred) AS predicted",
    "architecture_comparison": f"""WITH n AS (SELECT count(*) AS docs, count(*) FILTER (ok) AS good FROM ({_PLACES})),
t AS (SELECT * FROM (SELECT docs AS found_a, docs + good AS found_b, 2 * docs AS total, docs / (2 * docs) AS recall_a, (docs + good) / (2 * docs) AS recall_b FROM n))
SELECT metric, round(a, 3) AS a, round(b, 3) AS b, round(round(b, 3) - round(a, 3), 3) AS change FROM (
  SELECT 'found' AS metric, found_a::DOUBLE AS a, found_b::DOUBLE AS b FROM t UNION ALL SELECT 'total', total, total FROM t UNION ALL SELECT 'hit', found_a, found_b FROM t UNION ALL SELECT 'predicted', found_a, found_b FROM t
  UNION ALL SELECT 'recall', recall_a, recall_b FROM t UNION ALL SELECT 'precision', 1, 1 FROM t UNION ALL SELECT 'f1', 2 * recall_a / (1 + recall_a), 2 * recall_b / (1 + recall_b) FROM t)""",
}
