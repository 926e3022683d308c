"""Context boost: keywords around a span that its rule lists raise its score."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.once import let
from veilspark.operators.rules import Rule
from veilspark.operators.scan import matches, span

FACTOR, FLOOR, PREFIX, SUFFIX = 0.35, 0.4, 5, 0
#: Words that are no keywords. A parameter.
STOPWORDS = tuple("a an and are as at be but by for from has have he i in is it its me my of on or our she that the their they this to was we were will with you your".split())


def tokens(text: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """``array<struct<start,end,text,keyword>>``: words and single other signs; a keyword is a lower-cased word that is no
    stopword. Plural endings are cut, in place of a lemmatizer."""
    found = matches(text, r"(?U)\w+(?:[@.:/'-]\w+)*|[^\w\s]")

    def token(m: Column, low: Column) -> Column:
        base = F.when(low.rlike("[^s]s$") & (F.length(m["text"]) > 3), F.substr(low, F.lit(1), F.length(m["text"]) - 1)).otherwise(low)
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), base.alias("text"), (m["text"].rlike(r"(?U)\w") & ~low.isin(*stopwords)).alias("keyword"))

    return F.transform(found, lambda m: let(F.lower(m["text"]), lambda low: token(m, low)))


@dataclass(frozen=True)
class Enhancer:
    """Raises scores by ``factor``, to ``floor`` at least and 1 at most, where a context word of the rule stands among the
    keywords of the window: the span's token and up to ``prefix`` before, ``suffix`` + 1 from it on, and words given from
    outside. ``mode``: a context word is part of a keyword (``substring``) or equals it (``whole_word``). Another strategy
    is a subclass with its own ``enhance``."""

    mode: str = "substring"
    factor: float = FACTOR
    floor: float = FLOOR
    prefix: int = PREFIX
    suffix: int = SUFFIX

    def __post_init__(self) -> None:
        if self.mode not in ("substring", "whole_word"):
            raise ValueError(f"unknown match mode {self.mode!r}")

    def word(self, s: Column, toks: Column, rules: Iterable[Rule], outer: Iterable[str] = ()) -> Column:
        """The first context word of the span's rule that stands in its window, or null."""
        table = {r.name: [w.lower() for w in r.context] for r in rules if r.context}
        if not table:
            return F.lit(None).cast("string")
        words = F.create_map(*[x for n, ws in table.items() for x in (F.lit(n), F.array(*[F.lit(w) for w in ws]))])
        more = F.array(*[F.lit(w.lower()) for w in outer]).cast("array<string>")
        back = F.filter(toks, lambda t: t["keyword"] & (t["start"] <= s["start"]))
        near = F.slice(back, F.greatest(F.size(back) - self.prefix, F.lit(1)), F.lit(self.prefix + 1))
        ahead = F.slice(F.filter(toks, lambda t: t["keyword"] & (t["end"] > s["start"])), F.lit(1), F.lit(self.suffix + 1))
        window = F.concat(F.transform(F.concat(near, ahead), lambda t: t["text"]), more)
        own = F.coalesce(F.try_element_at(words, s["recognizer"]), F.array().cast("array<string>"))
        same = (lambda k, w: k == w) if self.mode == "whole_word" else (lambda k, w: F.contains(k, w))
        return let(window, lambda near_: F.try_element_at(F.filter(own, lambda w: F.exists(near_, lambda k: same(k, w))), F.lit(1)))

    def enhance(self, spans: Column, toks: Column, rules: Iterable[Rule], outer: Iterable[str] = ()) -> Column:
        rules = list(rules)
        if not any(r.context for r in rules):
            return spans

        def boosted(s: Column, once: Column) -> Column:
            score = F.least(F.lit(1.0), F.greatest(s["score"] + self.factor, F.lit(self.floor)))
            return span(s["entity_type"], s["start"], s["end"], F.when(self.word(s, once, rules, outer).isNotNull(), score).otherwise(s["score"]), s["recognizer"])

        # tokens are made once, and only for texts with spans
        return let(spans, lambda found: F.when(F.size(found) > 0, let(toks, lambda once: F.transform(found, lambda s: boosted(s, once)))).otherwise(found))


def enhance(spans: Column, toks: Column, rules: Iterable[Rule], outer: Iterable[str] = (), **options) -> Column:
    """``spans`` with the scores of an ``Enhancer`` of these options."""
    return Enhancer(**options).enhance(spans, toks, rules, outer)
