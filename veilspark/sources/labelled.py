"""Labelled records, recognizer configuration, and result sinks."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.operators.anonymize import ITEM, Operator
from veilspark.operators.evaluate import miss_reason
from veilspark.operators.ner import RECOGNIZER, engine_from_dict
from veilspark.operators.rules import CATALOG, Rule
from veilspark.operators.scan import NO_SPANS, deny_rule, text_of, thresholds
from veilspark.plans.engine import Analyzer

RECORD = "full_text string, masked string, spans array<struct<entity_type:string,entity_value:string,start_position:int,end_position:int>>, template_id long, metadata string"


def read_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A JSON array of labelled records; ``limit``: so many of them, those with the smallest templates and texts."""
    records = spark.read.schema(RECORD).json(path, multiLine=True)
    return records if limit is None else records.orderBy("template_id", "full_text").limit(limit)


def truth_spans(records: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return records.select(id_col, F.explode("spans").alias("s")).select(id_col, F.col("s.entity_type").alias("label"), F.col("s.start_position").alias("start"), F.col("s.end_position").alias("end"))


def _checked(spec: Mapping[str, object]) -> None:
    if spec.get("supported_language") and spec.get("supported_languages"):
        raise ValueError("supported_language or supported_languages, not both")
    if spec.get("supported_entity") and spec.get("supported_entities"):
        raise ValueError("supported_entity or supported_entities, not both")
    entities = spec.get("supported_entities") or [spec.get("supported_entity")]
    if not entities[0] or len(entities) != 1:
        raise ValueError("a recognizer of patterns has one supported entity")
    if bool(spec.get("patterns")) == bool(spec.get("deny_list")):
        raise ValueError("a recognizer needs either patterns or deny_list")
    languages = spec.get("supported_languages") or []
    if spec.get("context") and len(languages) > 1:
        raise ValueError("context of a recognizer of several languages stands with each language")
    if spec.get("name") in {r.name for r in CATALOG} and spec.get("type", "custom") == "custom":
        raise ValueError(f"{spec['name']} is the name of a predefined recognizer")


def rules_from_dict(spec: Mapping[str, object]) -> list[Rule]:
    """The rules of a recognizer of patterns or of a deny list, as configuration files give it: one for each language."""
    _checked(spec)
    entity = (spec.get("supported_entities") or [spec.get("supported_entity")])[0]
    name, out = spec.get("name", entity), []
    for one in spec.get("supported_languages") or [spec.get("supported_language", "en")]:
        language, context = (one["language"], one.get("context") or ()) if isinstance(one, Mapping) else (one, spec.get("context") or ())
        if spec.get("deny_list"):
            rule = deny_rule(name, entity, list(spec["deny_list"]), float(spec.get("deny_list_score", 1.0)), language)
        else:
            rule = Rule(name, entity, tuple((p["regex"], float(p["score"])) for p in spec["patterns"]), language=language, enabled=spec.get("enabled", True))
        out.append(dataclasses.replace(rule, context=tuple(context), country=spec.get("country_code"), thresholds=thresholds(spec.get("score_thresholds") or {})))
    return out


def rule_from_dict(spec: Mapping[str, object]) -> Rule:
    """The rule of a recognizer of one language."""
    found = rules_from_dict(spec)
    if len(found) != 1:
        raise ValueError(f"{spec.get('name')}: more than one language")
    return found[0]


def rule_to_dict(rule: Rule) -> dict[str, object]:
    """What ``rule_from_dict`` makes the rule of again; checks are code and don't go with it."""
    return {
        "name": rule.name, "type": "predefined" if rule.name in {r.name for r in CATALOG} else "custom", "supported_entity": rule.entity, "supported_language": rule.language, "enabled": rule.enabled, "country_code": rule.country,
        "patterns": [{"regex": p, "score": s} for p, s in rule.patterns], "context": list(rule.context), "score_thresholds": dict(rule.thresholds),
    }


DEFAULTS: dict[str, object] = {"supported_languages": ["en"], "recognizers": [], "profile": "full", "default_score_threshold": 0.0, "nlp_configuration": {}}


def configured(text: str | None = None, spec: Mapping[str, object] | None = None) -> dict[str, object]:
    """A configuration from YAML text or a dictionary, the defaults where it has nothing."""
    if text and spec:
        raise ValueError("a configuration comes from YAML or from a dictionary, not from both")
    if text:
        import yaml

        spec = yaml.safe_load(text) or {}
    return DEFAULTS | {k: v for k, v in (spec or {}).items() if v is not None}


def reconciled(recognizers: Iterable[Mapping[str, object]], finds_entities: bool) -> list[Mapping[str, object]]:
    """Recognizers of a configuration with one for the engine's entities exactly where the engine finds any: added where
    it is missing, left out where it is disabled or the engine finds none, an error where there are several."""
    rest, own = [r for r in recognizers if r.get("name") != RECOGNIZER], [r for r in recognizers if r.get("name") == RECOGNIZER]
    if len(own) > 1:
        raise ValueError(f"{RECOGNIZER} is configured {len(own)} times")
    if not finds_entities or (own and not own[0].get("enabled", True)):
        return rest
    return [*rest, own[0] if own else {"name": RECOGNIZER, "type": "predefined", "enabled": True}]


def analyzer_from(text: str | None = None, spec: Mapping[str, object] | None = None) -> Analyzer:
    """The analyzer that a configuration describes: predefined recognizers by name, custom ones, languages, threshold and engine."""
    conf = configured(text, spec)
    engine, ner = engine_from_dict(conf["nlp_configuration"])
    known, rules = {r.name: r for r in CATALOG}, []
    wanted = reconciled(conf["recognizers"], engine.finds_entities)
    for r in wanted:
        if not r.get("enabled", True) or r.get("name") == RECOGNIZER:
            continue
        if r.get("type", "custom") == "predefined":
            if r.get("name") not in known:
                raise ValueError(f"no predefined recognizer {r.get('name')!r}")
            rules += [dataclasses.replace(known[r["name"]], language=x, context=tuple(r.get("context") or known[r["name"]].context)) for x in r.get("supported_languages") or [known[r["name"]].language]]
        else:
            rules += rules_from_dict(r)
    rules = [r for r in rules or [r for r in CATALOG if r.enabled] if r.language in conf["supported_languages"]]
    return Analyzer(tuple(rules), str(conf["profile"]), float(conf["default_score_threshold"]), engine.name, ner if engine.finds_entities else None)


def rules_from_yaml(text: str) -> list[Rule]:
    import yaml

    return [rule for r in (yaml.safe_load(text) or {}).get("recognizers", []) if r.get("enabled", True) for rule in rules_from_dict(r)]


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def spans_from_json(text: Column) -> Column:
    """``array<span>`` of a JSON array of spans; null where it can't be read."""
    return F.from_json(text, NO_SPANS)


def items_from_json(text: Column) -> Column:
    """The items of an anonymized text from their JSON array, as deanonymizing takes them."""
    return F.from_json(text, f"array<{ITEM}>")


def to_json(value: Column) -> Column:
    """Spans, items or a whole result as JSON."""
    return F.to_json(value)


def operators_from_dict(spec: dict) -> dict[str, Operator]:
    """Operators by entity from their configuration: ``type`` names the operator, the other keys are its parameters."""
    for entity, one in spec.items():
        if not isinstance(one, dict) or not one.get("type"):
            raise ValueError(f"{entity}: an operator needs a type")
    return {entity: Operator(one["type"], {k: v for k, v in one.items() if k != "type"}) for entity, one in spec.items()}


def write_report(df: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """One JSON object a text, ``df`` having ``spans`` and perhaps ``result``: for reports over any number of texts."""
    df.select(*[c for c in (id_col, "text", "spans", "result") if c in df.columns]).write.mode("overwrite").json(path)


def report_lines(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, value)``: a text report of each record ``(doc_id, text, truth, spans)``, with its labelled spans, what was
    found of them, and why the others may have been missed. ``truth`` is an array of labelled spans as records have it."""
    overlaps = lambda t: F.exists("spans", lambda s: (s["start"] < t["end_position"]) & (t["start_position"] < s["end"]))
    value = lambda t: F.substr(F.col("text"), t["start_position"] + 1, t["end_position"] - t["start_position"])
    line = lambda t: F.concat(F.when(overlaps(t), "found  ").otherwise("missed "), t["entity_type"], F.lit(" '"), value(t), F.lit("'"), F.when(overlaps(t), "").otherwise(F.concat(F.lit(": "), miss_reason(t["entity_type"], value(t)))))
    lines = F.concat(F.array(F.concat(F.lit("record "), F.col(id_col).cast("string")), F.concat(F.lit("text   "), F.regexp_replace(F.regexp_replace("text", "\n", r"\\n"), "\t", r"\\t"))), F.transform(F.coalesce("truth", F.array().cast("array<struct<entity_type:string,entity_value:string,start_position:int,end_position:int>>")), line))
    return df.select(id_col, F.array_join(lines, "\n").alias("value"))


def write_text_report(df: DataFrame, path: str, id_col: str = "doc_id") -> None:
    report_lines(df, id_col).select("value").write.mode("overwrite").text(path)


def trace_lines(df: DataFrame, request: Column, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, value)``: a line of the decision process for each record of ``Analyzer.explain``, named by its request."""
    return df.select(id_col, F.concat(F.lit("["), request.cast("string"), F.lit("][trace] "), F.to_json("explained")).alias("value"))


def cases(df: DataFrame, each: int = 3, id_col: str = "doc_id") -> DataFrame:
    """``(entity_type, doc_id, start, end, score, matched_text)``: up to ``each`` examples of every entity, those of the smallest ids."""
    found = df.select(F.col(id_col).alias("doc_id"), F.explode(F.transform("spans", lambda s: F.struct(s.alias("s"), text_of(F.col("text"), s).alias("matched_text")))).alias("p"))
    flat = found.select("p.s.entity_type", "doc_id", "p.s.start", "p.s.end", F.round("p.s.score", 2).alias("score"), "p.matched_text")
    # a limit on row_number cuts each task to its first rows before the shuffle, so an entity may have any number of spans
    top = flat.withColumn("k", F.row_number().over(Window.partitionBy("entity_type").orderBy("doc_id", "start", "end"))).filter(F.col("k") <= each)
    return top.drop("k")


def write_cases(df: DataFrame, path: str, each: int = 3, id_col: str = "doc_id") -> None:
    cases(df, each, id_col).write.mode("overwrite").json(path)
