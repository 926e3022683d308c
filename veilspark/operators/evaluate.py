"""Scoring found spans against labelled ones: overlaps, counters and rates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import checksums as C
from veilspark.functions.once import let
from veilspark.operators.anonymize import anonymize
from veilspark.operators.scan import NO_SPANS, by_start, span

SPAN_COLUMNS = ("doc_id", "label", "start", "end")


def _mapped(spans: DataFrame, accept: Mapping[str, Iterable[str]]) -> DataFrame:
    """Predicted spans, once for each truth label that their label may stand for."""
    table = F.create_map(*[x for p, ts in accept.items() for x in (F.lit(p), F.array(*[F.lit(t) for t in ts]))])
    return spans.withColumn("accepts", F.coalesce(F.try_element_at(table, F.col("label")), F.array(F.col("label"))))


def hits(truth: DataFrame, found: DataFrame, accept: Mapping[str, Iterable[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Truth spans with ``found`` and predicted spans with ``hit``: whether any span of an accepted label overlaps.

    One overlaps a span if, of those that start before its end, the one that reaches farthest ends after its start. So both
    sides are met in one shuffle by document and label and one sort each: they are computed once, and a document with very
    many spans makes no pairs.
    """
    if accept:
        named = _mapped(found, accept).select("doc_id", F.posexplode_outer("accepts").alias("veil_nth", "veil_label"), "label", "start", "end")
    else:
        named = found.select("doc_id", F.lit(0).alias("veil_nth"), F.col("label").alias("veil_label"), "label", "start", "end")
    both = truth.withColumns({"veil_truth": F.lit(True), "veil_label": F.col("label"), "veil_nth": F.lit(0)}).unionByName(named.withColumn("veil_truth", F.lit(False)), allowMissingColumns=True)
    by_key, real = Window.partitionBy("doc_id", "veil_label"), F.col("doc_id").isNotNull() & F.col("veil_label").isNotNull()

    def met(side: Column, first: Column) -> Column:
        """Whether a span of ``side`` overlaps one of the other side; of equal places those of ``side`` come first."""
        upto = by_key.orderBy(F.when(side, F.col("end")).otherwise(F.col("start")), first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return real & F.coalesce(F.max(F.when(~side & F.col("start").isNotNull(), F.col("end"))).over(upto) > F.col("start"), F.lit(False))

    is_truth = F.col("veil_truth")
    got = both.withColumn("found", met(is_truth, is_truth.desc())).filter(is_truth).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in truth.schema.fields], "found")
    scored = both.withColumn("hit", met(~is_truth, is_truth.asc())).filter(~is_truth)
    if accept:  # a prediction again for each time it stands there, whatever the number of labels it may stand for
        each = scored.groupBy(*SPAN_COLUMNS).agg(F.max("hit").alias("hit"), F.count_if(F.coalesce("veil_nth", F.lit(0)) == 0).cast("int").alias("veil_n"))
        scored = each.withColumn("veil_n", F.explode(F.sequence(F.lit(1), "veil_n")))
    return got, scored.select(*[F.col(c).cast(found.schema[c].dataType) for c in SPAN_COLUMNS], "hit")


def recall_by_label(got: DataFrame) -> DataFrame:
    n, k = F.count("*"), F.count_if("found")
    return got.groupBy("label").agg(k.alias("found"), (n - k).alias("missed"), n.alias("total"), F.round(k / n, 3).alias("recall"))


def precision_by_label(scored: DataFrame) -> DataFrame:
    n, k = F.count("*"), F.count_if("hit")
    return scored.groupBy("label").agg(k.alias("hit"), (n - k).alias("spurious"), n.alias("total"), F.round(k / n, 3).alias("precision"))


def totals(got: DataFrame, scored: DataFrame) -> DataFrame:
    """One row of micro sums and rates; a rate without a denominator is 0."""
    a = got.agg(F.count_if("found").alias("found"), F.count("*").alias("total"))
    b = scored.agg(F.count_if("hit").alias("hit"), F.count("*").alias("predicted"))
    recall, precision = F.coalesce(F.try_divide("found", "total"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "predicted"), F.lit(0.0))
    both = a.join(b).withColumns({"recall": recall, "precision": precision})
    return both.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")), F.lit(0.0))).withColumns({c: F.round(c, 3) for c in ("recall", "precision", "f1")}).withColumn("f1", F.round("f1", 3))


def unmatched_labels(truth: DataFrame, found: DataFrame) -> DataFrame:
    """``(label, side, spans)``: predicted labels that truth never has, and truth labels that nothing predicts."""
    t, p = truth.groupBy("label").count(), found.groupBy("label").count()
    return p.join(t, "label", "left_anti").select("label", F.lit("unmeasurable").alias("side"), F.col("count").alias("spans")).unionByName(t.join(p, "label", "left_anti").select("label", F.lit("unreachable").alias("side"), F.col("count").alias("spans")))


def documents_cleaned(got: DataFrame) -> DataFrame:
    """How many documents had all, some or none of their labelled spans found."""
    each = got.groupBy("doc_id").agg(F.count_if("found").alias("k"), F.count("*").alias("n"))
    return each.groupBy(F.when(F.col("k") == F.col("n"), "full").when(F.col("k") > 0, "part").otherwise("none").alias("outcome")).agg(F.count("*").alias("documents"))


def greedy_counts(truth: DataFrame, found: DataFrame) -> DataFrame:
    """``(label, tp, fp, fn)``: each prediction in order of start claims the first free overlapping truth of its label."""

    place = F.struct("start", "end")
    both = truth.select(*SPAN_COLUMNS, F.lit(True).alias("truth")).unionByName(found.select(*SPAN_COLUMNS, F.lit(False).alias("truth")))
    each = both.groupBy("doc_id", "label").agg(F.sort_array(F.collect_list(F.when(F.col("truth"), place))).alias("real"), F.sort_array(F.collect_list(F.when(~F.col("truth"), place))).alias("guesses"))
    numbered = F.transform("real", lambda t, i: F.struct(t["start"].alias("start"), t["end"].alias("end"), i.alias("i")))

    def claim(acc: Column, g: Column) -> Column:
        spot = F.try_element_at(F.filter(acc["free"], lambda t: (t["start"] < g["end"]) & (g["start"] < t["end"])), F.lit(1))["i"]
        return let(spot, lambda i: F.when(i.isNull(), acc).otherwise(F.struct(F.filter(acc["free"], lambda t: t["i"] != i).alias("free"), (acc["tp"] + 1).alias("tp"))))

    first = F.struct(numbered.alias("free"), F.lit(0).cast("long").alias("tp"))
    tp = F.aggregate("guesses", first, claim, lambda acc: acc["tp"])
    counts = each.select("label", F.size("real").alias("n"), F.size("guesses").alias("m"), tp.alias("tp"))
    return counts.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum(F.col("m") - F.col("tp")).alias("fp"), F.sum(F.col("n") - F.col("tp")).alias("fn"))


def with_rates(counts: DataFrame, micro: str | None = "MICRO-AVERAGE") -> DataFrame:
    """``counts(label, tp, fp, fn)`` with ``precision``, ``recall`` and ``f1``, and a row ``micro`` of all of them together.

    A rate without a denominator is NaN, as printed reports have it; ``nanvl`` or a null suits a sink of JSON.
    """
    if micro is not None:
        counts = counts.unionByName(counts.agg(F.lit(micro).alias("label"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]))
    nan = F.lit(float("nan"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(nan)
    p, r = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when(~F.isnan(p) & ~F.isnan(r) & (p + r > 0), 2 * p * r / (p + r)).otherwise(nan)
    return counts.withColumns({"precision": p, "recall": r, "f1": f1})


def split_reach(truth: DataFrame, found: DataFrame, accept: Mapping[str, Iterable[str]] | None = None, unmeasurable_is_spurious: bool = False) -> tuple[DataFrame, DataFrame]:
    """Truth spans whose label some prediction may stand for, and predicted spans whose label the truth has.

    ``unmeasurable_is_spurious``: predictions with labels that the truth never has stay, and count as spurious.
    """
    pred = _mapped(found, accept) if accept else found.withColumn("accepts", F.array("label"))
    reach = pred.select(F.explode("accepts").alias("label")).distinct()
    inside = truth.join(F.broadcast(reach), "label", "left_semi")
    if unmeasurable_is_spurious:
        return inside, found
    labels = truth.select("label").distinct()
    known = pred.withColumn("accept", F.explode("accepts")).join(F.broadcast(labels.withColumnRenamed("label", "accept")), "accept", "left_semi").select(*SPAN_COLUMNS).distinct()
    return inside, found.join(known, list(SPAN_COLUMNS), "left_semi")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(metric, a, b, change)`` of two one-row frames of ``totals``."""
    metrics = a.columns
    long = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("r")).select("r.*")
    return long(a, "a").join(F.broadcast(long(b, "b")), "metric").withColumn("change", F.round(F.col("b") - F.col("a"), 3))


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec")


def miss_reason(label: Column, value: Column) -> Column:
    """Why a labelled value was not found, as far as its text tells."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    plain = F.upper(F.regexp_replace(value, "[^0-9A-Za-z]", ""))
    card_ok = (F.length(digits) >= 12) & C.luhn(digits)
    iban_ok = (F.length(plain) >= 5) & F.coalesce(C.mod97(plain), F.lit(False))
    return (
        F.when((label == "CREDIT_CARD") & ~card_ok, "the number fails its check digit")
        .when(label == "CREDIT_CARD", "no card pattern matches")
        .when((label == "IBAN_CODE") & ~iban_ok, "the number fails its check digits")
        .when(label == "IBAN_CODE", "the number isn't in its country's format")
        .when((label == "DATE_TIME") & F.lower(value).rlike("(" + "|".join(MONTHS) + ")"), "a month in letters")
        .when((label == "DATE_TIME") & ~value.rlike("[0-9]"), "no digit in it")
        .when(label == "DATE_TIME", "no date pattern matches")
        .when(label == "PHONE_NUMBER", "no phone pattern matches")
        .when(label == "EMAIL_ADDRESS", "no known suffix, or malformed")
        .when(label == "IP_ADDRESS", "no valid address")
        .otherwise("no pattern matches")
    )


def desired(text: Column, truth: Column) -> Column:
    """``text`` with every labelled span (an array of ``entity_type``, ``start_position``, ``end_position``) replaced by its tag."""
    spans = F.transform(truth, lambda t: span(t["entity_type"], t["start_position"], t["end_position"], F.lit(1.0), F.lit("truth")))
    spans = F.coalesce(spans, F.array().cast(NO_SPANS))
    return anonymize(F.coalesce(text, F.lit("")), by_start(spans))["text"]
