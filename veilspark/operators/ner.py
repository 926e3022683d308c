"""Entities that a model has found, and the engines that make tokens and entities of a text column.

No model is shipped. An engine is a pair of Column functions: text to tokens (as ``context.tokens`` makes them) and text to
entities (``ENTITIES``). ``rules`` tokenizes by rule and finds no entities, ``no_op`` makes neither; others are registered, a
pandas or Arrow UDF around a model being one such function. Entities can also be handed in as a column.
"""

from __future__ import annotations

import dataclasses
import logging
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.operators.context import tokens
from veilspark.operators.scan import NO_SPANS, span

log = logging.getLogger(__name__)
ENTITIES = "array<struct<label:string,start:int,end:int,score:double>>"
TOKENS = "array<struct<start:int,end:int,text:string,keyword:boolean>>"
#: The recognizer's name in spans that a model has found.
RECOGNIZER = "Ner"

# Entity by model label.
MAPPING = dict(
    PER="PERSON", PERSON="PERSON", LOC="LOCATION", LOCATION="LOCATION", GPE="LOCATION", ORG="ORGANIZATION", DATE="DATE_TIME", TIME="DATE_TIME", NORP="NRP", AGE="AGE", ID="ID", EMAIL="EMAIL", PATIENT="PERSON",
    STAFF="PERSON", HOSP="ORGANIZATION", PATORG="ORGANIZATION", PHONE="PHONE_NUMBER", HCW="PERSON", HOSPITAL="ORGANIZATION",
)
SUPPORTED = ("DATE_TIME", "NRP", "LOCATION", "PERSON", "ORGANIZATION")


@dataclasses.dataclass(frozen=True)
class NerConfig:
    """How a model's labels become entities."""

    mapping: Mapping[str, str] = dataclasses.field(default_factory=lambda: dict(MAPPING))
    ignore: tuple[str, ...] = ()
    default_score: float = 0.85
    low_score: tuple[str, ...] = ()
    multiplier: float = 0.4
    supported: tuple[str, ...] = SUPPORTED

    def __post_init__(self) -> None:
        if not 0 <= self.default_score <= 1 or self.multiplier < 0:
            raise ValueError("a default score lies between 0 and 1, and a multiplier isn't negative")

    @classmethod
    def from_dict(cls, spec: Mapping[str, object]) -> NerConfig:
        known = {f.name for f in dataclasses.fields(cls)}
        if set(spec) - known:
            raise ValueError(f"unknown keys {sorted(set(spec) - known)}")
        return cls(**{k: tuple(v) if isinstance(v, list | set) else v for k, v in spec.items()})

    def to_dict(self) -> dict[str, object]:
        return dataclasses.asdict(self)


def updated(entities: Column, config: NerConfig) -> Column:
    """Entities without those ignored under either name, under their entity's name (unmapped labels keep theirs), the
    default score where the model gives none, and scores of low-score names scaled."""
    table = F.create_map(*[F.lit(x) for pair in config.mapping.items() for x in pair]) if config.mapping else F.create_map().cast("map<string,string>")
    named = F.transform(
        F.filter(F.coalesce(entities, F.array().cast(ENTITIES)), lambda e: ~e["label"].isin(*config.ignore)),
        lambda e: F.struct(F.coalesce(F.try_element_at(table, e["label"]), e["label"]).alias("label"), e["start"].alias("start"), e["end"].alias("end"), F.coalesce(e["score"], F.lit(config.default_score)).alias("score")),
    )
    left = F.filter(named, lambda e: ~e["label"].isin(*config.ignore))
    return F.transform(left, lambda e: F.struct(e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end"), (e["score"] * F.when(e["label"].isin(*config.low_score), config.multiplier).otherwise(1.0)).alias("score")))


def ner_spans(entities: Column, config: NerConfig | None = None, wanted: Iterable[str] | None = None) -> Column:
    """``array<span>`` of a model's entities: those that are supported and, if any are named, asked for."""
    config = config or NerConfig()
    allowed = [e for e in config.supported if wanted is None or not list(wanted) or e in set(wanted)]
    if not allowed:
        return F.array().cast(NO_SPANS)
    return F.transform(F.filter(updated(entities, config), lambda e: e["label"].isin(*allowed)), lambda e: span(e["label"], e["start"], e["end"], e["score"], F.lit(RECOGNIZER)))


@dataclasses.dataclass(frozen=True)
class NlpEngine:
    name: str
    tokens: Callable[[Column], Column]
    entities: Callable[[Column], Column]
    finds_entities: bool = True


def _no_entities(text: Column) -> Column:
    return F.array().cast(ENTITIES)


ENGINES: dict[str, NlpEngine] = {
    "rules": NlpEngine("rules", tokens, _no_entities, False),
    "no_op": NlpEngine("no_op", lambda text: F.array().cast(TOKENS), _no_entities, False),
}


def add_engine(engine: NlpEngine) -> None:
    ENGINES[engine.name] = engine


def engine_of(name: str) -> NlpEngine:
    if name not in ENGINES:
        raise ValueError(f"no engine {name!r} among {sorted(ENGINES)}")
    return ENGINES[name]


def engine_from_dict(spec: Mapping[str, object] | None = None) -> tuple[NlpEngine, NerConfig]:
    """``nlp_engine_name`` and ``ner_model_configuration`` of a configuration; ``rules`` with the defaults where there is none."""
    spec = spec or {}
    return engine_of(str(spec.get("nlp_engine_name", "rules"))), NerConfig.from_dict(spec.get("ner_model_configuration") or {})


def engine_from_yaml(text: str | None = None, spec: Mapping[str, object] | None = None) -> tuple[NlpEngine, NerConfig]:
    """From YAML text or from a dictionary, not both."""
    if text and spec:
        raise ValueError("a configuration comes from YAML or from a dictionary, not from both")
    if text:
        import yaml

        spec = yaml.safe_load(text)
    return engine_from_dict(spec)
