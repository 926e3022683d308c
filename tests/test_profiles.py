"""Profiles, engines, configuration, nested columns and sinks, where a query with SQL doesn't show them."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import logging
import re

import pytest
from pyspark.sql import functions as F

from veilspark.operators import anonymize as A
from veilspark.operators import evaluate, ner
from veilspark.operators import scan as S
from veilspark.operators.anonymize import Operator
from veilspark.operators.context import Enhancer, tokens
from veilspark.operators.rules import CATALOG, Rule
from veilspark.plans.engine import Analyzer, rewrite, scrub_nested
from veilspark.sources import labelled

RULES = {r.name: r for r in CATALOG}


def _one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("out")).head().out


def test_engines(spark):
    assert ner.engine_from_dict()[0].name == "rules" and ner.engine_from_yaml("nlp_engine_name: no_op\nner_model_configuration: {ignore: [ORG]}")[1].ignore == ("ORG",)
    for bad in (lambda: ner.engine_of("none"), lambda: ner.engine_from_yaml("a: 1", {"b": 1}), lambda: ner.NerConfig.from_dict({"x": 1}), lambda: ner.NerConfig(default_score=2), lambda: Analyzer(nlp="no_op", ner=ner.NerConfig()), lambda: Analyzer(profile="x"), lambda: Enhancer(mode="x")):
        with pytest.raises(ValueError):
            bad()
    assert ner.NerConfig.from_dict(ner.NerConfig().to_dict()) == ner.NerConfig()
    assert _one(spark, "my ssn is 523-45-6788", Analyzer((RULES["UsSsn"],), nlp="no_op").spans(F.col("text")))[0].score == 0.5
    ner.add_engine(ner.NlpEngine("capitals", tokens, lambda t: F.transform(S.matches(t, r"\b[A-Z][a-z]+\b"), lambda m: F.struct(F.lit("PER").alias("label"), m["start"].alias("start"), m["end"].alias("end"), F.lit(None).cast("double").alias("score")))))
    try:
        found = _one(spark, "ask Maria about it", Analyzer((RULES["UsSsn"],), nlp="capitals").spans(F.col("text")))
        assert [(s.entity_type, s.start, s.end, s.score) for s in found] == [("PERSON", 4, 9, 0.85)]
    finally:
        del ner.ENGINES["capitals"]


def test_tokens_and_entities_can_be_handed_in(spark):
    toks = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("ssn").alias("text"), F.lit(True).alias("keyword")))
    found = _one(spark, "ref 523-45-6788", Analyzer((RULES["UsSsn"],)).spans(F.col("text"), tokens=toks))
    assert found[0].score == 0.85


def test_hooks_and_enhancers(spark):
    lower = dataclasses.replace(RULES["UsSsn"], hook=lambda spans, text: F.transform(spans, lambda s: S.span(s["entity_type"], s["start"], s["end"], s["score"] / 2, s["recognizer"])))
    assert _one(spark, "x 523-45-6788", Analyzer((lower,)).spans(F.col("text")))[0].score == 0.25

    class Loud(Enhancer):
        def enhance(self, spans, toks, rules, outer=()):
            return F.transform(spans, lambda s: S.span(s["entity_type"], s["start"], s["end"], F.lit(0.99), s["recognizer"]))

    assert _one(spark, "x 523-45-6788", Analyzer((RULES["UsSsn"],), enhancer=Loud()).spans(F.col("text")))[0].score == 0.99


def test_listings_and_warnings(caplog):
    one = Analyzer(tuple(r for r in CATALOG if r.name in ("Ip", "UsSsn", "DePlz")))
    assert one.supported_entities("en") == ["IP_ADDRESS", "US_SSN"] and one.supported_countries() == ["de", "us"]
    with caplog.at_level(logging.WARNING):
        found = S.language_of(one.rules, "en", ["IP_ADDRESS", "NONE"], ["us", "xx"])
    assert [r.name for r in found] == ["Ip"] and "NONE" in caplog.text and "xx" in caplog.text
    with pytest.raises(ValueError):
        S.language_of(CATALOG, "en", None, "us")
    assert {r.name for r in one.with_rules(RULES["Url"]).without_rule("Ip").rules} == {"Url", "UsSsn", "DePlz"}
    with pytest.raises(ValueError):
        one.without_rule("Url")


def test_ad_hoc_rules(spark):
    zip_ = Rule("Zip", "ZIP", ((r"\b\d{5}\b", 0.4),), ("code",))
    found = _one(spark, "the code 12345", Analyzer((RULES["Ip"],)).spans(F.col("text"), ad_hoc=[zip_]))
    assert [(s.entity_type, s.score) for s in found] == [("ZIP", 0.75)]


def test_configuration():
    custom = {"name": "Z", "supported_entity": "Z", "patterns": [{"name": "z", "regex": "z+", "score": 0.5}]}
    many = labelled.rules_from_dict(custom | {"supported_languages": [{"language": "en", "context": ["zed"]}, "de"]})
    assert [(r.language, r.context) for r in many] == [("en", ("zed",)), ("de", ())]
    assert labelled.rule_from_dict(labelled.rule_to_dict(many[0])) == dataclasses.replace(many[0], enabled=True)
    for bad in (
        custom | {"supported_languages": ["en"], "supported_language": "en"}, custom | {"supported_entities": ["A", "B"]}, custom | {"supported_entities": ["A"]}, custom | {"deny_list": ["a"]}, {"name": "Z", "supported_entity": "Z"},
        custom | {"supported_languages": ["en", "de"], "context": ["x"]}, custom | {"name": "Ip"}, custom | {"score_thresholds": {"Z": True}}, custom | {"score_thresholds": {" ": 0.1}},
    ):
        with pytest.raises(ValueError):
            labelled.rules_from_dict(bad)
    with pytest.raises(ValueError):
        labelled.rule_from_dict(custom | {"supported_languages": ["en", "de"]})
    assert labelled.configured("supported_languages: [de]")["default_score_threshold"] == 0.0
    with pytest.raises(ValueError):
        labelled.configured("a: 1", {"b": 1})
    with pytest.raises(ValueError):
        labelled.analyzer_from(spec={"recognizers": [{"name": "Nothing", "type": "predefined"}]})
    own = {"name": ner.RECOGNIZER, "type": "predefined"}
    assert labelled.reconciled([], True) == [own | {"enabled": True}] and labelled.reconciled([own], False) == [] and labelled.reconciled([own | {"enabled": False}], True) == []
    with pytest.raises(ValueError):
        labelled.reconciled([own, own], True)
    two = labelled.analyzer_from(spec={"supported_languages": ["en", "es"], "recognizers": [{"name": "Ip", "type": "predefined", "supported_languages": ["en", "es"], "context": ["red"]}]})
    assert [(r.language, r.context) for r in two.rules] == [("en", ("red",)), ("es", ("red",))]
    assert [r.name for r in labelled.rules_from_yaml("recognizers:\n- {name: Z, supported_entity: Z, patterns: [{regex: z, score: 0.1}]}\n- {name: Y, supported_entity: Y, enabled: false, deny_list: [y]}")] == ["Z"]


def test_spans_must_lie_in_the_text(spark):
    spans = F.array(S.span(F.lit("A"), F.lit(0), F.lit(9), F.lit(1.0), F.lit("x")))
    with pytest.raises(Exception, match="beyond its text"):
        _one(spark, "short", A.anonymize(F.col("text"), spans))


def test_operators_check_their_parameters(spark):
    text, entity = F.col("text"), F.lit("A")
    bad = [Operator("mask", {"masking_char": "**", "chars_to_mask": 1, "from_end": False}), Operator("mask", {"masking_char": "*", "chars_to_mask": True, "from_end": False}), Operator("mask"), Operator("replace", {"new_value": 3}), Operator("hash", {"hash_type": "md5"}), Operator("hash", {"salt": "short"}), Operator("encrypt", {"key": "short"}), Operator("custom", {"lambda": 1})]
    for op in bad:
        with pytest.raises(ValueError):
            A.FORWARD[op.name](op, text, entity)
    with pytest.raises(ValueError):
        A.remove_operator("none")
    with pytest.raises(ValueError):
        rewrite(text, F.array().cast(S.NO_SPANS), {"A": Operator("none")})
    long = _one(spark, "abc", A.hash_(Operator("hash", {"hash_type": "sha512", "salt": b"0123456789abcdef"}), text, entity))
    assert long == hashlib.sha512(b"abc0123456789abcdef").hexdigest()
    assert len({r.h for r in spark.createDataFrame([("abc",), ("abc",)], "text string").select(A.hash_(Operator("hash"), text, entity).alias("h")).collect()}) == 2


def test_nested_names_are_context_and_can_be_left_alone(spark):
    ssn, analyzer = "523-45-6788", Analyzer((RULES["UsSsn"],), threshold=0.6)
    shape = "ssn string, box struct<ssn:string,plain:string>, list struct<ssn:array<string>,deep:struct<plain:string>>, nums array<long>, keep string"
    df = spark.createDataFrame([(ssn, (ssn, ssn), ([ssn, None], (ssn,)), [523456788, None], ssn), (None, None, None, None, None)], shape)
    one, two = scrub_nested(df, analyzer, {"DEFAULT": Operator("replace", {"new_value": "X"})}, skip=["keep", "box.ssn"]).collect()
    assert one.ssn == "X" and one.box.ssn == ssn and one.box.plain == ssn  # skipped; and a single value has only its own name
    assert one.list.ssn == ["X", None] and one.list.deep.plain == ssn and one.nums == ["523456788", None] and one.keep == ssn
    assert two.ssn is None and two.box is None and two.list is None and two.nums is None


RECORDS = [{"full_text": "card 4111111111111112\tand 10.1.2.3", "masked": "", "spans": [{"entity_type": "CREDIT_CARD", "entity_value": "4111111111111112", "start_position": 5, "end_position": 21}, {"entity_type": "IP_ADDRESS", "entity_value": "10.1.2.3", "start_position": 26, "end_position": 34}], "template_id": k, "metadata": None} for k in (2, 1)]


def test_records_reports_and_cases(spark, tmp_path):
    (tmp_path / "records.json").write_text(json.dumps(RECORDS))
    records = labelled.read_records(spark, str(tmp_path / "records.json"))
    assert records.count() == 2 and labelled.read_records(spark, str(tmp_path / "records.json"), 1).head().template_id == 1
    df = records.select(F.col("template_id").alias("doc_id"), F.col("full_text").alias("text"), F.col("spans").alias("truth"))
    assert sorted(r[:] for r in labelled.truth_spans(records.withColumn("doc_id", F.col("template_id"))).collect())[0] == (1, "CREDIT_CARD", 5, 21)
    found = Analyzer.regex_only().analyze(df, entities=["CREDIT_CARD", "IP_ADDRESS"])
    labelled.write_text_report(found, str(tmp_path / "report"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert "missed CREDIT_CARD '4111111111111112': the number fails its check digit" in lines and "found  IP_ADDRESS '10.1.2.3'" in lines and "text   card 4111111111111112\\tand 10.1.2.3" in lines
    labelled.write_cases(found, str(tmp_path / "cases"), each=1)
    assert [r.asDict() for r in spark.read.json(str(tmp_path / "cases")).collect()] == [{"doc_id": 1, "end": 34, "entity_type": "IP_ADDRESS", "matched_text": "10.1.2.3", "score": 0.6, "start": 26}]
    labelled.write_metrics(found.groupBy("doc_id").count(), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 2
    assert {r.out for r in df.select(evaluate.desired(F.col("text"), F.col("truth")).alias("out")).collect()} == {"card <CREDIT_CARD>\tand <IP_ADDRESS>"}


def test_reasons_for_misses(spark):
    rows = [("DATE_TIME", "3 May", "a month in letters"), ("DATE_TIME", "soon", "no digit in it"), ("DATE_TIME", "1/2", "no date pattern matches"), ("IBAN_CODE", "GB83WEST12345698765432", "the number fails its check digits"), ("IBAN_CODE", "GB82WEST12345698765432", "the number isn't in its country's format"), ("PERSON", "x", "no pattern matches")]
    out = spark.createDataFrame(rows, "l string, v string, w string").select(evaluate.miss_reason(F.col("l"), F.col("v")).alias("g"), "w").collect()
    assert [r.g for r in out] == [r.w for r in out]


def test_surrogates_keep_the_shape(spark):
    out = spark.createDataFrame([("AB-12 é x9",), ("AB-12 é x9",), ("AB-12 é x8",)], "text string").select(A.surrogate(Operator("surrogate", {"key": "k"}), F.col("text"), F.lit("A")).alias("a"), A.surrogate(Operator("surrogate"), F.col("text"), F.lit("A")).alias("b")).collect()
    assert out[0] == out[1] and out[0].a != out[2].a and out[0].a != out[0].b
    assert all(re.fullmatch(r"[A-Z]{2}-\d{2} é [a-z]\d", r.a) for r in out)


def test_traces(spark):
    df = spark.createDataFrame([(1, "my ssn is 523-45-6788")], "doc_id long, text string")
    line = labelled.trace_lines(Analyzer((RULES["UsSsn"],)).explain(df), F.lit("r1")).head().value
    assert line.startswith("[r1][trace] [{") and json.loads(line[len("[r1][trace] ") :])[0]["context_word"] == "ssn"


def test_rates_without_a_denominator(spark):
    counts = spark.createDataFrame([("A", 1, 0, 0), ("B", 0, 0, 2)], "label string, tp long, fp long, fn long")
    got = {r.label: r for r in evaluate.with_rates(counts).collect()}
    assert got["A"].f1 == 1.0 and got["B"].precision != got["B"].precision and got["B"].recall == 0.0 and got["MICRO-AVERAGE"].recall == 1 / 3
