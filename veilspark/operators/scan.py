"""Text to spans: the native pattern scan, deduplication, thresholds, lists and conflicts, all on arrays in the row."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.once import let
from veilspark.operators.rules import Rule

log = logging.getLogger(__name__)


@contextmanager
def quiet() -> Iterator[None]:
    """Build large expressions without PySpark's record of where each part was written, which costs most of the time."""
    try:
        from pyspark.errors import utils

        before, utils._enable_debugging_cache = utils._enable_debugging_cache, False
    except (ImportError, AttributeError):
        yield
        return
    try:
        yield
    finally:
        utils._enable_debugging_cache = before


@contextmanager
def deep(df: DataFrame, iterations: int = 1000) -> Iterator[None]:
    """Let the analyzer take as many rounds as long chains of functions on arrays need, one for each link."""
    conf, key = df.sparkSession.conf, "spark.sql.analyzer.maxIterations"
    before = conf.get(key)
    conf.set(key, str(max(iterations, int(before))))
    try:
        yield
    finally:
        conf.set(key, before)


SPAN = "struct<entity_type:string,start:int,end:int,score:double,recognizer:string>"
NO_SPANS = f"array<{SPAN}>"


def span(entity: Column | str, start: Column, end: Column, score: Column, recognizer: Column | str) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(text(entity).cast("string").alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"), score.cast("double").alias("score"), text(recognizer).cast("string").alias("recognizer"))


def exploded(df: DataFrame, values: Column | str, *keep: Column | str, name: str = "s") -> DataFrame:
    """One row for each element of an array without nulls. From a plain explode the optimizer infers a filter on the array's
    size, which it moves below the column that makes the array, so that the whole scan is computed twice and more."""
    return df.select(*keep, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


#: Stands for a match while gaps are taken. Texts that hold it are split by the pattern.
MARK = "\x01"
#: Matches placed by one fold: a fold copies what it has placed so far, so longer lists are placed block by block.
PLACED = 64


def matches(text: Column, pattern: str, guard: str | None = None) -> Column:
    """``array<struct<start,end,text>>`` of all non-overlapping matches, in code points; empty matches are left out.

    The gaps between matches are what is left when the same pattern's matches are taken out, so lengths add up to offsets.
    Splitting by one sign is cheap; splitting by a pattern compiles it for each text. Texts without a match are not split, and those that ``guard``, a cheap pattern, can't be found in are not searched.
    """
    place = "struct<start:int,end:int,text:string>"
    none = F.array().cast(f"array<{place}>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["g"])
        end = start + F.length(p["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["m"].alias("text")))).alias("out"))

    fold = lambda pairs: F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def moved(acc: Column, block: Column) -> Column:
        out = F.transform(block["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["text"].alias("text")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(out)).alias("out"))

    def blocks(pairs: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(pairs), F.lit(PLACED))
        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{place}>>").alias("out"))
        return F.flatten(F.aggregate(F.transform(firsts, lambda i: fold(F.slice(pairs, i, F.lit(PLACED)))), first, moved)["out"])

    def placed(found: Column) -> Column:
        cut = F.when(F.contains(text, F.lit(MARK)), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, MARK), MARK, -1))
        gaps = F.slice(cut, F.lit(1), F.size(found))
        pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        summed = let(pairs, lambda p: F.when(F.size(p) <= PLACED, fold(p)["out"]).otherwise(blocks(p)))
        return F.when(F.size(found) > 0, F.filter(summed, lambda s: s["end"] > s["start"])).otherwise(none)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found if guard is None else F.when(text.rlike(guard), found).otherwise(F.array().cast("array<string>")), placed)


def _score(rule: Rule, text: Column, base: Column) -> Column:
    score = base
    if rule.check is not None:
        score = let(rule.check(text), lambda valid: F.when(valid, 1.0).when(~valid, 0.0).otherwise(base))
    if rule.reject is not None:
        score = F.when(rule.reject(text), 0.0).otherwise(score)
    return score


def _grouped(rule: Rule, pattern: str, base: Column, text: Column) -> Column:
    """The longest of a match's group ends whose text has a score."""
    whole = rule.flags + pattern
    ends = F.array(*[F.concat(*[F.regexp_extract(text, whole, g) for g in range(1, k + 1)]) for k in range(rule.groups, 0, -1)])
    tried = F.transform(ends, lambda e: F.struct(F.length(e).alias("n"), _score(rule, e, base).alias("score")))
    return F.try_element_at(F.filter(tried, lambda t: t["score"] > 0), F.lit(1))


def scan(text: Column, rule: Rule) -> Column:
    """All spans of one rule with a score above 0, deduplicated as the rule's own results."""
    found = [F.transform(matches(text, rule.flags + p, guard), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.lit(float(base)).alias("base"))) for (p, base), guard in zip(rule.patterns, rule.guards, strict=True)]
    all_ = found[0] if len(found) == 1 else F.concat(*found)
    if rule.groups:
        pattern = rule.patterns[0][0]
        cut = F.transform(all_, lambda m: F.struct(m["start"].alias("start"), _grouped(rule, pattern, m["base"], m["text"]).alias("best")))
        spans = F.transform(F.filter(cut, lambda m: m["best"].isNotNull()), lambda m: span(rule.entity, m["start"], m["start"] + m["best"]["n"], m["best"]["score"], rule.name))
    else:
        spans = F.transform(all_, lambda m: span(rule.entity, m["start"], m["end"], _score(rule, m["text"], m["base"]), rule.name))
    spans = F.filter(spans, lambda s: s["score"] > 0)
    return spans if len(found) == 1 or rule.groups else dedupe(spans)


def by_rank(spans: Column) -> Column:
    """By score from the highest, then start, then length from the longest."""
    key = F.transform(spans, lambda s: F.struct((-s["score"]).alias("a"), s["start"].alias("b"), (s["start"] - s["end"]).alias("c"), s["entity_type"].alias("d"), s.alias("s")))
    return F.transform(F.sort_array(key), lambda k: k["s"])


def by_start(spans: Column) -> Column:
    key = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), (-s["score"]).alias("c"), s["entity_type"].alias("d"), s.alias("s")))
    return F.transform(F.sort_array(key), lambda k: k["s"])


def dedupe(spans: Column) -> Column:
    """Distinct spans by rank, without those that an earlier kept one of their type contains."""
    none = F.array().cast(NO_SPANS)
    step = lambda kept, s: F.when(
        (s["score"] <= 0) | F.exists(kept, lambda k: (k["entity_type"] == s["entity_type"]) & (k["start"] <= s["start"]) & (k["end"] >= s["end"])), kept
    ).otherwise(F.concat(kept, F.array(s)))
    return F.aggregate(by_rank(spans), none, step)


def above(spans: Column, threshold: float = 0.0, rules: Iterable[Rule] = (), request: float | None = None) -> Column:
    """Score threshold: the request's, else the recognizer's for the entity, else its default, else the engine's."""
    if request is not None:
        return F.filter(spans, lambda s: s["score"] >= request)
    own = {(r.name, e): t for r in rules for e, t in r.thresholds}
    if not own:
        return F.filter(spans, lambda s: s["score"] >= threshold)
    table = F.create_map(*[F.lit(x) for (n, e), t in own.items() for x in (f"{n}\0{e}", t)])
    return F.filter(spans, lambda s: s["score"] >= F.coalesce(F.try_element_at(table, F.concat_ws("\0", s["recognizer"], s["entity_type"])), F.try_element_at(table, F.concat_ws("\0", s["recognizer"], F.lit("default"))), F.lit(threshold)))


def text_of(text: Column, s: Column) -> Column:
    return F.substr(text, s["start"] + 1, s["end"] - s["start"])


def without(spans: Column, text: Column, allow: list[str], mode: str = "exact", flags: str = "(?ism)") -> Column:
    """Spans whose text the allow list doesn't hold: ``exact`` equality, or a ``regex`` found anywhere in it."""
    words = [w for w in allow if w]
    if mode not in ("exact", "regex"):
        raise ValueError(f"allow list mode must be 'exact' or 'regex', not {mode!r}")
    if not words:
        return spans
    if mode == "exact":
        return F.filter(spans, lambda s: ~text_of(text, s).isin(*words))
    return F.filter(spans, lambda s: ~text_of(text, s).rlike(flags + "|".join(words)))


def deny_rule(name: str, entity: str, words: list[str], score: float = 1.0, language: str = "en") -> Rule:
    """A rule for listed words, standing between non-word characters or the ends of a line."""
    escaped = "|".join("".join(c if c.isalnum() or c == " " else "\\" + c for c in w) for w in words)
    return Rule(name, entity, ((rf"(?:^|(?<=\W))({escaped})(?:(?=\W)|$)", score),), language=language, enabled=True)


def overlap(a: Column, b: Column) -> Column:
    """Characters two spans share, 0 if they are apart or touch."""
    return F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))


def simple_conflicts(spans: Column) -> Column:
    """Highest score wins, then the longer span; result by start."""
    key = F.transform(spans, lambda s: F.struct((-s["score"]).alias("a"), (s["start"] - s["end"]).alias("b"), s["start"].alias("c"), s["entity_type"].alias("d"), s.alias("s")))
    none = F.array().cast(NO_SPANS)
    kept = F.aggregate(F.transform(F.sort_array(key), lambda k: k["s"]), none, lambda acc, s: F.when(F.exists(acc, lambda k: overlap(k, s) > 0), acc).otherwise(F.concat(acc, F.array(s))))
    return by_start(kept)


def merge_same_type(spans: Column) -> Column:
    """Overlapping spans of one type become one: least start, greatest end and score."""
    none = F.array().cast(NO_SPANS)

    def step(acc: Column, s: Column) -> Column:
        hit = lambda k: (k["entity_type"] == s["entity_type"]) & (overlap(k, s) > 0)
        both = F.transform(acc, lambda k: F.when(hit(k), span(k["entity_type"], F.least(k["start"], s["start"]), F.greatest(k["end"], s["end"]), F.greatest(k["score"], s["score"]), k["recognizer"])).otherwise(k))
        return F.when(F.exists(acc, hit), both).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(by_start(spans), none, step)


def drop_contained(spans: Column) -> Column:
    """Without spans that another contains, whatever type or score; of equal places the higher score stays, then the first."""
    numbered = F.transform(spans, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    worse = lambda x, y: F.when(
        (x["s"]["start"] == y["s"]["start"]) & (x["s"]["end"] == y["s"]["end"]), (x["s"]["score"] < y["s"]["score"]) | ((x["s"]["score"] == y["s"]["score"]) & (x["i"] > y["i"]))
    ).otherwise((y["s"]["start"] <= x["s"]["start"]) & (y["s"]["end"] >= x["s"]["end"]))
    return let(numbered, lambda all_: F.transform(F.filter(all_, lambda x: ~F.exists(all_, lambda y: (x["i"] != y["i"]) & worse(x, y))), lambda x: x["s"]))


def merge_spaces(spans: Column, text: Column) -> Column:
    """Neighbours of one type with only spaces between become one with the later one's score."""
    none = F.array().cast(NO_SPANS)

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        gap = F.substr(text, last["end"] + 1, s["start"] - last["end"])
        joined = span(s["entity_type"], last["start"], s["end"], s["score"], s["recognizer"])
        meet = last.isNotNull() & (last["entity_type"] == s["entity_type"]) & gap.rlike("^( )+$")
        return F.when(meet, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(by_start(spans), none, step)


def trim_overlaps(spans: Column) -> Column:
    """Where neighbours overlap the lower score yields its part; of equal scores the later span yields."""
    none = F.array().cast(NO_SPANS)

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        clash = last.isNotNull() & (last["end"] > s["start"])
        moved = span(s["entity_type"], last["end"], s["end"], s["score"], s["recognizer"])
        cut = span(last["entity_type"], last["start"], s["start"], last["score"], last["recognizer"])
        first = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        gone = (last["score"] >= s["score"]) & (last["end"] > s["end"])  # nothing of it would be left
        return F.when(~clash, F.concat(acc, F.array(s))).when(gone, acc).when(last["score"] >= s["score"], F.concat(acc, F.array(moved))).otherwise(F.concat(first, F.array(cut), F.array(s)))

    return F.filter(F.aggregate(by_start(spans), none, step), lambda s: s["start"] <= s["end"])


def resolve(spans: Column, text: Column, strategy: str = "merge_similar_or_contained") -> Column:
    """Conflicts between spans before text is replaced."""
    if strategy not in ("merge_similar_or_contained", "remove_intersections"):
        raise ValueError(f"unknown conflict strategy {strategy!r}")
    out = drop_contained(merge_same_type(spans))
    if strategy == "remove_intersections":
        out = trim_overlaps(out)
    return merge_spaces(out, text)


def language_of(rules: Iterable[Rule], language: str | None, entities: Iterable[str] | None, countries: Iterable[str] | None) -> list[Rule]:
    """Rules of a language, of requested entities and countries; rules without a country always stay. Entities and
    countries that no rule has are logged."""
    if isinstance(countries, str) or (countries is not None and any(not str(c).strip() for c in countries)):
        raise ValueError("countries must be a list of country codes")
    rules, wanted = list(rules), None if entities is None else set(entities)
    codes = None if countries is None else {c.lower() for c in countries}
    if unknown := (wanted or set()) - {r.entity for r in rules}:
        log.warning("no rule finds %s", sorted(unknown))
    if unseen := (codes or set()) - {r.country for r in rules}:
        log.warning("no rule is of %s", sorted(unseen))
    found = [r for r in rules if (language is None or r.language == language) and (not wanted or r.entity in wanted) and (codes is None or r.country is None or r.country in codes)]
    if not found:
        raise ValueError("no rule matches the language and entities asked for")
    return found


def thresholds(table: Mapping[str, float]) -> tuple[tuple[str, float], ...]:
    for k, v in table.items():
        if not isinstance(k, str) or not k.strip() or isinstance(v, bool) or not isinstance(v, int | float) or not 0 <= v <= 1:
            raise ValueError(f"bad score threshold {k!r}: {v!r}")
    return tuple((k.strip(), float(v)) for k, v in table.items())
