"""The two profiles as plans: which rules, in which order their results are settled, and how text is rewritten."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.operators import anonymize as A
from veilspark.operators import scan as S
from veilspark.operators.context import Enhancer
from veilspark.operators.ner import NerConfig, engine_of, ner_spans
from veilspark.operators.rules import AS_OF, CATALOG, GENERIC, Rule


@dataclasses.dataclass(frozen=True)
class Analyzer:
    """Finds spans. ``profile`` is ``full`` (context, threshold, then dedupe) or ``regex_only`` (dedupe, then threshold).

    ``nlp`` names the engine that makes tokens and entities, ``ner`` says how its entities are read, ``enhancer`` how
    context raises scores, and ``as_of`` the day (yyyy-MM-dd) that rules against future dates go by.
    """

    rules: tuple[Rule, ...] = tuple(r for r in CATALOG if r.enabled)
    profile: str = "full"
    threshold: float = 0.0
    nlp: str = "rules"
    ner: NerConfig | None = None
    enhancer: Enhancer = dataclasses.field(default_factory=Enhancer)
    as_of: str | None = None

    def __post_init__(self) -> None:
        if self.profile not in ("full", "regex_only"):
            raise ValueError(f"unknown profile {self.profile!r}")
        if self.ner is not None and self.nlp == "no_op":
            raise ValueError("an engine without entities can't serve entity recognition")

    @classmethod
    def regex_only(cls, threshold: float = 0.0) -> Analyzer:
        plain = tuple(dataclasses.replace(r, flags="(?smU)") if r.name == "Iban" else r for r in GENERIC)
        return cls(plain, "regex_only", threshold)

    def supported_entities(self, language: str | None = None) -> list[str]:
        return sorted({r.entity for r in self.rules if language is None or r.language == language})

    def supported_countries(self) -> list[str]:
        return sorted({r.country for r in self.rules if r.country})

    def with_rules(self, *more: Rule) -> Analyzer:
        return dataclasses.replace(self, rules=(*self.rules, *more))

    def without_rule(self, name: str) -> Analyzer:
        if name not in {r.name for r in self.rules}:
            raise ValueError(f"no rule {name!r}")
        return dataclasses.replace(self, rules=tuple(r for r in self.rules if r.name != name))

    def spans(self, text: Column, language: str | None = "en", entities: Iterable[str] | None = None, countries: Iterable[str] | None = None, context: Iterable[str] = (), threshold: float | None = None, allow: list[str] | None = None, allow_mode: str = "exact", ad_hoc: Iterable[Rule] = (), ner: Column | None = None, tokens: Column | None = None) -> Column:
        """``array<span>`` of a text column. ``ner`` are entities that a model has found (``ner.ENTITIES``) and ``tokens`` the
        text's tokens, if they are known already."""
        options = dict(language=language, entities=entities, countries=countries, context=context, threshold=threshold, allow=allow, allow_mode=allow_mode, ad_hoc=ad_hoc, ner=ner)
        toks = engine_of(self.nlp).tokens(F.coalesce(text, F.lit(""))) if tokens is None else tokens
        return self._settled(text, self._found(text, **options), toks, **options)

    def _rules(self, language="en", entities=None, countries=None, ad_hoc=(), **_) -> list[Rule]:
        return S.language_of((*self.rules, *ad_hoc), language, entities, countries)

    def _found(self, text: Column, ner: Column | None = None, entities: Iterable[str] | None = None, **options) -> Column:
        """The spans as rules and a model find them."""
        day = AS_OF.set(self.as_of)
        try:
            with S.quiet():
                text, engine = F.coalesce(text, F.lit("")), engine_of(self.nlp)
                parts = [S.scan(text, r) for r in self._rules(entities=entities, **options)]
                if ner is not None or engine.finds_entities:
                    parts.append(ner_spans(engine.entities(text) if ner is None else ner, self.ner, entities))
                return F.concat(*parts)
        finally:
            AS_OF.reset(day)

    def _settled(self, text: Column, found: Column, toks: Column, context: Iterable[str] = (), threshold: float | None = None, allow: list[str] | None = None, allow_mode: str = "exact", **options) -> Column:
        """What becomes of the spans found."""
        with S.quiet():
            text, rules = F.coalesce(text, F.lit("")), self._rules(**options)
            if self.profile == "regex_only":
                return S.by_start(S.above(S.dedupe(found), self.threshold if threshold is None else threshold))
            for r in rules:
                if r.hook is not None:
                    found = r.hook(found, text)
            raised = self.enhancer.enhance(found, toks, rules, context)
            return S.without(S.dedupe(S.above(raised, self.threshold, rules, threshold)), text, allow or [], allow_mode)

    def explain(self, df: DataFrame, text_col: str = "text", **options) -> DataFrame:
        """``df`` with a column ``explained``: the spans with their text, their score before context (``original_score``) and
        the word of the context that raised it, if one did. This is the decision process that ``spans`` leaves out."""
        found, toks = _free(df, "veil_found", "veil_tokens")
        text = F.coalesce(F.col(text_col), F.lit(""))
        with S.deep(df):
            wide = df.withColumn(found, self._found(text, **options)).withColumn(toks, F.when(F.size(found) > 0, engine_of(self.nlp).tokens(text)))
            wide = wide.withColumn("explained", self._settled(text, F.col(found), F.col(toks), **options))
        rules = self._rules(**options)
        same = lambda f, s: (f["recognizer"] == s["recognizer"]) & (f["start"] == s["start"]) & (f["end"] == s["end"])
        with S.quiet():
            told = F.transform("explained", lambda s: F.struct(*[s[k].alias(k) for k in ("entity_type", "start", "end", "score", "recognizer")], S.text_of(text, s).alias("text"), F.array_max(F.transform(F.filter(found, lambda f: same(f, s)), lambda f: f["score"])).alias("original_score"), self.enhancer.word(s, F.col(toks), rules, options.get("context", ())).alias("context_word")))
        return wide.withColumn("explained", told).drop(found, toks)

    def analyze(self, df: DataFrame, text_col: str = "text", **options) -> DataFrame:
        """``df`` with a column ``spans``. In the full profile what rules find is a column of its own on the way, which keeps
        expressions small; no rows move."""
        with S.deep(df):
            return self._analyzed(df, text_col, **options)

    def _analyzed(self, df: DataFrame, text_col: str, **options) -> DataFrame:
        if self.profile == "regex_only":
            return df.withColumn("spans", self.spans(F.col(text_col), **options))
        (found,) = _free(df, "veil_found")
        text = F.col(text_col)
        toks = options.get("tokens") if options.get("tokens") is not None else engine_of(self.nlp).tokens(F.coalesce(text, F.lit("")))
        return df.withColumn(found, self._found(text, **options)).withColumn("spans", self._settled(text, F.col(found), toks, **options)).drop(found)


def _free(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores behind those that ``df`` has."""
    out = []
    for name in names:
        while name in df.columns:
            name += "_"
        out.append(name)
    return out


def rewrite(text: Column, spans: Column, operators: Mapping[str, A.Operator] | None = None, profile: str = "full", strategy: str = "merge_similar_or_contained") -> Column:
    """``struct<text, items>`` after conflicts between spans are settled the profile's way."""
    text = F.coalesce(text, F.lit(""))
    with S.quiet():
        if profile == "regex_only":
            return A.anonymize(text, S.simple_conflicts(spans), A.with_mask_defaults(operators))
        return A.anonymize(text, S.by_start(S.resolve(spans, text, strategy)), operators)


def explode_spans(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The span table of an analyzed frame."""
    return S.exploded(df, "spans", id_col).select(id_col, "s.*")


def _text(value: Column, kind: T.DataType) -> Column:
    """Values in lists as their text: numbers and truth values too."""
    if isinstance(kind, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    return value.cast("string")


@dataclasses.dataclass(frozen=True)
class _Part:
    """How a value is rewritten, and how its text or its items are taken from what that makes (None: it has none)."""

    make: Callable[[Column], Column]
    pick: Callable[[Column, str], Column | None]


def scrub_nested(df: DataFrame, analyzer: Analyzer, operators: Mapping[str, A.Operator] | None = None, skip: Iterable[str] = (), items_col: str | None = None, **options) -> DataFrame:
    """Rewrite every string in columns, structs, arrays and maps, and every number or truth value in arrays (as text).

    A field's name is context: alone for a single value, with the names above it for what stands in arrays, maps and
    structs. ``skip`` names columns or dotted paths to leave alone; below a field, those that begin with its name count,
    without that name and a dot. Other types pass unchanged. ``items_col``: a column to add, with the items of each rewritten string
    in a struct shaped like the columns, as ``restore_nested`` takes it.
    """

    untouched = _Part(lambda v: v, lambda v, part: v if part == "text" else None)

    def leaf(context: tuple[str, ...], kind: T.DataType) -> _Part:
        def make(value: Column) -> Column:
            text = _text(value, kind)
            return F.when(value.isNotNull(), rewrite(text, analyzer.spans(text, context=context, **options), operators, analyzer.profile))

        return _Part(make, lambda v, part: v[part])

    def named(kind: T.DataType, name: str, skip: frozenset[str], above: tuple[str, ...]) -> _Part:
        """A column or a field: a single value has its own name alone for context."""
        if name in skip:
            return untouched
        if isinstance(kind, T.StringType):
            return leaf((name,), kind)
        return within(kind, frozenset(s.replace(f"{name}.", "") for s in skip if s.startswith(name)), (*above, name))

    def within(kind: T.DataType, skip: frozenset[str], above: tuple[str, ...]) -> _Part:
        """What stands in an array, a map or a struct, or is one."""
        if isinstance(kind, T.StringType):
            return leaf(above, kind)
        if isinstance(kind, T.ArrayType):
            one = leaf(above, kind.elementType) if isinstance(kind.elementType, T.BooleanType | T.NumericType) else within(kind.elementType, skip, above)
            return untouched if one is untouched else _Part(lambda v: F.transform(v, one.make), lambda v, part: F.transform(v, lambda x: one.pick(x, part)))
        if isinstance(kind, T.MapType):
            one = within(kind.valueType, skip, above)
            return untouched if one is untouched else _Part(lambda v: F.transform_values(v, lambda k, x: one.make(x)), lambda v, part: F.transform_values(v, lambda k, x: one.pick(x, part)))
        if isinstance(kind, T.StructType):
            fields = {f.name: named(f.dataType, f.name, skip, above) for f in kind.fields}
            told = {n: p for n, p in fields.items() if p is not untouched}
            if not told:
                return untouched
            return _Part(
                lambda v: F.when(v.isNotNull(), F.struct(*[p.make(v[n]).alias(n) for n, p in fields.items()])),
                lambda v, part: F.when(v.isNotNull(), F.struct(*[p.pick(v[n], part).alias(n) for n, p in (fields if part == "text" else told).items()])),
            )
        return untouched

    parts = {f.name: named(f.dataType, f.name, frozenset(skip), ()) for f in df.schema.fields}
    # made once and then taken apart: text and items must agree on what a random vector or salt has given
    with S.deep(df):
        made = df.select(*[p.make(F.col(f"`{n}`")).alias(n) for n, p in parts.items()])
    texts = [p.pick(F.col(f"`{n}`"), "text").alias(n) for n, p in parts.items()]
    if items_col is None:
        return made.select(*texts)
    return made.select(*texts, F.struct(*[p.pick(F.col(f"`{n}`"), "items").alias(n) for n, p in parts.items() if p is not untouched]).alias(items_col))


def restore_nested(df: DataFrame, items_col: str, operators: Mapping[str, A.Operator]) -> DataFrame:
    """The way back for columns, structs, arrays and maps. ``items_col`` is a struct shaped like the columns it speaks of,
    with ``array<item>`` in the place of each string. Strings without items, and columns it doesn't name, stay."""
    kinds = df.schema[items_col].dataType
    if not isinstance(kinds, T.StructType):
        raise ValueError(f"{items_col}: items of nested columns are a struct")

    def walk(value: Column, kind: T.DataType, items: Column, shape: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            found = F.coalesce(items, F.array().cast(f"array<{A.ITEM}>"))
            return F.when(value.isNotNull(), A.deanonymize(value, found, operators)["text"])
        if isinstance(kind, T.ArrayType) and isinstance(shape, T.ArrayType):
            return F.transform(value, lambda v, i: walk(v, kind.elementType, F.try_element_at(items, i + 1), shape.elementType))
        if isinstance(kind, T.MapType) and isinstance(shape, T.MapType):
            return F.transform_values(value, lambda k, v: walk(v, kind.valueType, F.try_element_at(items, k), shape.valueType))
        if isinstance(kind, T.StructType) and isinstance(shape, T.StructType):
            known = {f.name: f.dataType for f in shape.fields}
            fields = [(walk(value[f.name], f.dataType, items[f.name], known[f.name]) if f.name in known else value[f.name]).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        return value

    known = {f.name: f.dataType for f in kinds.fields}
    own = [f for f in df.schema.fields if f.name != items_col]
    back = [walk(F.col(f"`{f.name}`"), f.dataType, F.col(f"`{items_col}`")[f.name], known[f.name]).alias(f.name) if f.name in known else F.col(f"`{f.name}`") for f in own]
    with S.quiet(), S.deep(df):
        return df.select(*back)
