"""Personal data by weak-supervision aggregation.

Every whole text is read once. Base rules give spans that always stay. Looser candidates that overlap no base span
(numbers with separators, long numbers, dotted numbers, account numbers, e-mail addresses written out, titled names) are
voted on by labelers of three kinds: patterns, a gazetteer of words, and the words before the span. Combinations of votes
are counted over the whole corpus (their number is bounded by the labelers), expectation-maximisation estimates each
labeler's reliability from the counts, and the posteriors train a logistic span classifier on each candidate's votes and
shape. Candidates that it accepts are added; of added ones that overlap, the one of the higher probability.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import col, cut, keyed_rows, tidy

BASE = ("email", "ip", "card", "phone")
EXTRA = ("email_like", "phone_like", "number_like", "name_like", "card_like", "ip_like", "account_like")
KINDS = BASE + EXTRA
LABELERS = ("shape", "grouped", "checksum", "context", "gazetteer", "placeholder", "inside_word", "repeated_digit")
SHAPES = ("length", "digits", "separators", "capitals", "line_start")

# The patterns of the base kinds, and word lists.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a run of digits can only match from its start
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EMAIL_LIKE = re.compile(r"(?<![A-Za-z0-9._])[A-Za-z0-9._]{2,64}(?: ?[(\[]at[)\]] ?[A-Za-z0-9-]{2,63} ?(?:[(\[]dot[)\]]|\.) ?| at [A-Za-z0-9-]{2,63} dot )[A-Za-z]{2,10}(?![A-Za-z])")
_PHONE_LIKE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-]{1,2}[0-9]{2,6}){2,4}(?![0-9A-Za-z])")
_NUMBER_LIKE = re.compile(r"(?<![0-9A-Za-z.])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_NAME_LIKE = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? [A-ZÀ-Þ][a-zß-ÿ]{1,30}(?: [A-ZÀ-Þ][a-zß-ÿ]{1,30})?")
_CARD_LIKE = re.compile(r"(?<![0-9A-Za-z.])[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9A-Za-z])")
_IP_LIKE = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z])")
_ACCOUNT_LIKE = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_CONTEXT = re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|cell|contact|mail|e-mail|email|write|ssn|social|name|signed|telefon|teléfono|téléphone|correo|courriel|dear|card|visa|account|iban|konto|compte|cuenta|host|server|login)\b")
_PLACEHOLDER = re.compile(r"(?i)example|test|sample|lorem|version|isbn|0000|1234567")
#: Words that speak for personal data where a span holds one: given names, mail hosts. A parameter of ``find``.
GAZETTEER = frozenset(
    "james mary john anna peter maria paul laura david sarah thomas julia michael emma robert linda william susan richard karen joseph lisa daniel nancy mark betty george helen kevin sandra brian donna "
    "jean pierre marie luc claire louis camille antoine sophie luis carlos ana jose juan carmen javier lucia hans klaus petra ursula jürgen monika wolfgang sabine stefan birgit "
    "smith jones brown miller davis wilson müller schmidt schneider fischer weber garcia martinez lopez sanchez perez martin bernard dubois durand moreau "
    "gmail yahoo outlook hotmail icloud proton gmx".split()
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Local part, @ and dotted domain, found from each @ so that long runs without one cost nothing."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else max(done, 0)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def _apart(found: list[tuple[str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Of ``found`` those that overlap none of ``taken``."""
    if not taken:
        return found
    taken = sorted(taken)
    starts, ends = np.array([a for a, _ in taken]), np.maximum.accumulate([b for _, b in taken])
    at = np.searchsorted(starts, [e for _, _, e in found])
    return [f for f, k in zip(found, at, strict=True) if k == 0 or ends[k - 1] <= f[1]]


def iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(text: str, base: list[tuple[str, int, int]], gazetteer: frozenset[str] = GAZETTEER) -> list[tuple[str, int, int, int, list[float]]]:
    """(kind, start, end, votes, shape) of looser spans apart from ``base``; votes in base 3: 0 nothing, 1 against, 2 for, by labeler."""
    found = [("phone_like", *m.span()) for m in _PHONE_LIKE.finditer(text)] + [("number_like", *m.span()) for m in _NUMBER_LIKE.finditer(text)]
    if " at " in text or "(at)" in text or "[at]" in text:
        found += [("email_like", *m.span()) for m in _EMAIL_LIKE.finditer(text)]
    found += [("name_like", *m.span()) for m in _NAME_LIKE.finditer(text)] + [("card_like", *m.span()) for m in _CARD_LIKE.finditer(text)]
    found += [("ip_like", *m.span()) for m in _IP_LIKE.finditer(text)] + [("account_like", *m.span()) for m in _ACCOUNT_LIKE.finditer(text)]
    found = _apart(found, [(a, b) for _, a, b in base])
    out = []
    for kind, start, end in found:
        span, before = text[start:end], text[max(0, start - 40) : start]
        digits, low = _digits(span), span.lower()
        numeric = kind in ("phone_like", "number_like")
        groups = re.split(r"[ ./()-]+", span.strip("()"))
        in_range = kind == "ip_like" and all(int(g) <= 255 for g in groups)
        shaped = {"ip_like": in_range, "name_like": True, "email_like": "dot" in low or "." in low, "card_like": len(digits) in (13, 14, 15, 16, 19) and digits[:1] in ("3", "4", "5", "6"), "account_like": 15 <= len(span.replace(" ", "")) <= 34}
        checked = {"card_like": luhn(digits), "ip_like": in_range, "account_like": kind == "account_like" and iban(span)}
        votes = (
            2 if (shaped.get(kind, 9 <= len(digits) <= 13)) else 1,
            0 if not numeric else 2 if len(groups) in (3, 4) and len(groups[-1]) in (3, 4) else 1,
            (2 if checked[kind] else 1) if kind in checked else 1 if numeric and len(digits) >= 12 and luhn(digits) else 0,
            2 if _CONTEXT.search(before) else 0,
            2 if any(w in gazetteer for w in re.split(r"[^a-zß-ÿ]+", low)) else 0,
            1 if _PLACEHOLDER.search(low) or _PLACEHOLDER.search(before[-12:]) else 0,
            1 if before[-1:].isalnum() or text[end : end + 1].isalnum() else 2 if before[-1:] in " \n(:" else 0,
            1 if digits and len(set(digits)) <= 2 else 0,
        )
        code = 0
        for v in votes:
            code = code * 3 + v
        shape = [min(len(span), 40) / 40, min(len(digits), 16) / 16, min(len(groups), 6) / 6, sum(c.isupper() for c in span) / len(span), float(before[-1:] in ("", "\n"))]
        out.append((kind, start, end, code, shape))
    return out


_SPAN = "array<struct<kind:string,start:long,end:long,base:boolean,votes:long,shape:array<double>>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.int64()), ("shape", pa.list_(pa.float64()))]))


def _find(gazetteer: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                text = x.as_py()
                base = base_spans(text)
                rows.append([(k, a, b, True, 0, None) for k, a, b in base] + [(k, a, b, False, v, s) for k, a, b, v, s in candidates(text, base, gazetteer)])
            rows = [[dict(zip(("kind", "start", "end", "base", "votes", "shape"), r, strict=True)) for r in own] for own in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPAN_ARROW)], ["doc_id", "found"])

    return run


def _votes(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**k % 3 for k in reversed(range(len(LABELERS)))], axis=1)


def reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior that a candidate with each combination of votes is personal data, and P(vote | class) by labeler."""
    votes = _votes(codes)
    post = 1 / (1 + np.exp(-1.5 * ((votes == 2).sum(axis=1) - 2 * (votes == 1).sum(axis=1) - 1.5)))
    table = np.full((len(LABELERS), 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        prior = (weight.sum(axis=1) + 2) / (counts.sum() + 4)
        for j in range(len(LABELERS)):
            for v in range(3):
                table[j, :, v] = weight[:, votes[:, j] == v].sum(axis=1) + 1
            table[j] /= table[j].sum(axis=1, keepdims=True)
            # a labeler is no worse than none: votes for are likelier on personal data, those against on the rest
            table[j, 1, 2], table[j, 0, 1] = max(table[j, 1, 2], table[j, 0, 2]), max(table[j, 0, 1], table[j, 1, 1])
        log = np.log(prior)[:, None] + sum(np.log(table[j][:, votes[:, j]]) for j in range(len(LABELERS)))
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -40, 40)))
    return post, table


def _matrix(codes: np.ndarray, shapes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    v = _votes(codes)
    return np.hstack([v == 2, v == 1, shapes, kinds[:, None] == np.array(EXTRA), np.ones((len(codes), 1))]).astype(float)


#: Candidates that train the span classifier at most, those with the smallest hashes.
SAMPLE = 20_000


def fit(found: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the span classifier, from votes counted over all candidates and a bounded sample of their shapes."""
    spans = found.select("doc_id", F.explode("found").alias("s")).filter("not s.base")
    counts = spans.groupBy("s.votes").count().orderBy("votes").toPandas()
    width = 2 * len(LABELERS) + len(SHAPES) + len(EXTRA) + 1
    if not len(counts):
        return np.zeros(width)
    codes = counts["votes"].to_numpy(np.int64)
    post, _ = reliabilities(codes, counts["count"].to_numpy(float))
    rows = spans.select("s.kind", "s.votes", "s.shape", F.xxhash64("doc_id", "s.start", "s.kind").alias("h")).orderBy("h", "votes").limit(sample).toPandas()
    x = _matrix(rows["votes"].to_numpy(np.int64), np.array(rows["shape"].tolist(), float), rows["kind"].to_numpy(str))
    y, w = post[np.searchsorted(codes, rows["votes"].to_numpy(np.int64))], np.zeros(width)
    for _ in range(25):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.5 * np.eye(width), x.T @ (y - p) - 0.5 * w)
    return w


def _decide(weights: np.ndarray, accept: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, out = batch.column(1).to_pylist(), []
            for own in kinds:
                spans = [(s["start"], KINDS.index(s["kind"]), s["end"], s["kind"]) for s in own if s["base"]]
                rest = [s for s in own if not s["base"]]
                if rest:
                    x = _matrix(np.array([s["votes"] for s in rest]), np.array([s["shape"] for s in rest], float), np.array([s["kind"] for s in rest]))
                    p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                    starts: list[int] = []  # of the spans added so far, which are apart from each other, with their ends
                    ends: list[int] = []
                    for k in sorted(np.flatnonzero(p >= accept).tolist(), key=lambda k: (-p[k], rest[k]["start"], rest[k]["end"], rest[k]["kind"])):
                        s = rest[k]
                        at = bisect.bisect_left(starts, s["end"])
                        if at == 0 or ends[at - 1] <= s["start"]:
                            starts.insert(at, s["start"])
                            ends.insert(at, s["end"])
                            spans.append((s["start"], KINDS.index(s["kind"]), s["end"], s["kind"]))
                out.append([{"kind": k, "start": a, "end": b, "base": i < len(BASE)} for a, i, b, k in sorted(spans)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.9, gazetteer: frozenset[str] = GAZETTEER) -> DataFrame:
    """Return ``(doc_id, spans)``, one row per input row: spans ``(kind, start, end, base)`` by start, then kind.

    Offsets count code points, end exclusive. Null text is empty and has no spans; texts of any length are read whole.
    Repeated rows, and rows that share an id or have none, get results of their own. Other columns are not read, so they
    may have any names; an empty table gives an empty result. Base spans of different kinds may overlap; an added span
    overlaps no other.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")))
    found = cut(rows.mapInArrow(tidy(_find(gazetteer)), f"doc_id {kind}, found {_SPAN}"), "pii")
    return found.mapInArrow(tidy(_decide(fit(found), accept)), f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with every span found replaced by its kind in angle brackets; overlaps are replaced once.

    One row per input row, each by its own spans, also where rows share an id or have none. Null text is empty.
    """
    rows, key = keyed_rows(docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")))
    found = find(rows, key, "text").withColumnRenamed("doc_id", "of")
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
        F.struct(F.concat(acc["out"], F.col("text").substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">")).alias("out"), s["end"].alias("at"))
    )
    done = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step)
    joined = rows.join(found, F.col(key) == F.col("of")).withColumn("done", done)
    return joined.select("doc_id", F.concat("done.out", F.col("text").substr((F.col("done.at") + 1).cast("int"), F.length("text"))).alias("text"))
