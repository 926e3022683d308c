"""Quality classification from weak labels.

Overlapping heuristics vote junk, clean or nothing on every document. How often each combination of votes occurs is
counted over all documents (at most 3**8 combinations, whatever the input), and expectation-maximisation estimates from
these counts how each heuristic votes on either class. The posterior of a document's combination is its label, and the
labels of a bounded, hash-chosen sample (SAMPLE rows) train a logistic scorer over hashed character-class trigrams and
words. The scorer then reads every whole text and decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm import words
from veilspark.llm.common import col, cut, fresh, release, remove, tidy

#: Documents whose features train the scorer at most, chosen by a hash of their id and text.
SAMPLE = 4096
#: Documents of the sample that training reads at a time.
STEP = 256
_TRI, _WORDS, _EXTRA = 4096, 4096, 16
_DIM = _TRI + _WORDS + _EXTRA
HEURISTICS = ("symbols", "marked_words", "capitals", "shouting", "stutter", "vocabulary", "separators", "sentences")

#: Classes of bytes: letters beyond ASCII count as lower case.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[0x0A] = 5
for _k, _c in enumerate(".,!?|*%$&#", 6):
    _CLASS[ord(_c)] = _k


class _Chunk:
    """Counts of a chunk of texts, one entry a document."""

    def __init__(self, texts: pa.Array):
        data, at = words.raw(texts)
        self.n, sizes = len(texts), np.diff(at)
        self.bytes = np.maximum(sizes, 1)
        self.doc = np.repeat(np.arange(self.n), sizes)
        self.cls = _CLASS[data].astype(np.int64)
        per = np.bincount(self.doc * 16 + self.cls, minlength=self.n * 16).reshape(self.n, 16).astype(float)
        self.solid = np.maximum(per.sum(axis=1) - per[:, 4] - per[:, 5], 1)
        self.letters, self.upper, self.symbols = np.maximum(per[:, 1] + per[:, 2], 1), per[:, 2], per[:, 0] + per[:, 8:16].sum(axis=1)
        self.stops = per[:, 6]
        h, starts = words.word_hashes(texts)
        self.hash, count = h, np.diff(starts)
        self.word_doc = np.repeat(np.arange(self.n), count)
        self.words = np.maximum(count, 1)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (self.word_doc[1:] == self.word_doc[:-1])
        self.stutter = self._sum(same) / self.words
        order = np.lexsort((h, self.word_doc))
        hs, ds = h[order], self.word_doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
        self.distinct = np.bincount(ds[new], minlength=self.n) / self.words
        nxt = np.concatenate([self.cls[1:], [4]])
        ends = (nxt == 4) | (nxt == 5)
        if len(at) > 2:
            ends[at[1:-1][(at[1:-1] > 0) & (at[1:-1] <= len(ends))] - 1] = True
        odd = (self.cls == 0) | (self.cls >= 8)
        self.marked = self._count(self.doc[ends & odd]) / self.words
        prev = np.concatenate([[4], self.cls[:-1]])
        self.lone = self._count(self.doc[ends & odd & ((prev == 4) | (prev == 5))]) / self.words
        self.shout = self._count(self.doc[ends & (self.cls == 8)]) / self.words

    def _count(self, where: np.ndarray) -> np.ndarray:
        return np.bincount(where, minlength=self.n)

    def _sum(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.word_doc[flags], minlength=self.n)

    def votes(self) -> np.ndarray:
        """Codes in base 3: 0 nothing, 1 clean, 2 junk, by heuristic. Texts of under eight words get few votes."""
        enough = self.words >= 8

        def vote(x: np.ndarray, clean: float, junk: float) -> np.ndarray:
            return np.where(~enough, 0, np.where(x >= junk, 2, np.where(x <= clean, 1, 0)))

        rare = np.where(self.words >= 60, 1 - self.distinct, 0.5)
        each = (
            vote(self.symbols / self.solid, 0.05, 0.12),
            vote(self.marked, 0.04, 0.2),
            vote(self.upper / self.letters, 0.1, 0.3),
            vote(self.shout, 0.02, 0.12),
            vote(self.stutter, 0.04, 0.2),
            vote(rare, 0.6, 0.85),
            vote(self.lone, 0.02, 0.12),
            vote(-self.stops / self.words, -0.02, -0.001),
        )
        code = np.zeros(self.n, np.int64)
        for v in each:
            code = code * 3 + v
        return code

    def features(self) -> np.ndarray:
        """Hashed features of each document, each block of unit length."""
        out = np.zeros((self.n, _DIM), np.float32)
        tri = self.cls[:-2] * 256 + self.cls[1:-1] * 16 + self.cls[2:]
        inside = self.doc[:-2] == self.doc[2:]
        counts = np.bincount(self.doc[:-2][inside] * _TRI + tri[inside], minlength=self.n * _TRI).reshape(self.n, _TRI)
        out[:, :_TRI] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
        spot = (self.hash >> np.uint64(40)).astype(np.int64) % _WORDS
        counts = np.bincount(self.word_doc * _WORDS + spot, minlength=self.n * _WORDS).reshape(self.n, _WORDS)
        out[:, _TRI : _TRI + _WORDS] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
        for k, x in enumerate((self.stutter, self.marked, self.lone, self.shout, self.symbols / self.solid, self.upper / self.letters, np.where(self.words >= 60, 1 - self.distinct, 0.5), np.minimum(self.stops / self.words, 0.3))):
            out[:, _TRI + _WORDS + k] = x
        out *= (self.words / (self.words + 10))[:, None]  # a few words are little evidence: what is left is the bias
        out[:, -1] = 1
        return out


def fit_labels(codes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of junk for each combination of votes, and P(vote | class) by heuristic, class and vote."""
    votes = np.stack([codes // 3**k % 3 for k in reversed(range(len(HEURISTICS)))], axis=1)
    n_junk, n_clean = (votes == 2).sum(axis=1), (votes == 1).sum(axis=1)
    post = np.where(n_junk == 0, 0.02, np.where(n_junk >= 2, 0.95, 0.6))
    post = np.where((n_junk == 0) & (n_clean == 0), 0.1, post)
    table = np.zeros((len(HEURISTICS), 2, 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        prior = np.clip(weight.sum(axis=1) / max(counts.sum(), 1), 0.01, 0.99)
        for j in range(len(HEURISTICS)):
            for v in range(3):
                table[j, :, v] = weight[:, votes[:, j] == v].sum(axis=1) + 1
            table[j] /= table[j].sum(axis=1, keepdims=True)
            # a heuristic is at least better than none: junk votes are likelier on junk, clean ones on clean
            table[j, 1, 2], table[j, 0, 1] = max(table[j, 1, 2], table[j, 0, 2]), max(table[j, 0, 1], table[j, 1, 1])
        log = np.log(prior)[:, None] + sum(np.log(table[j][:, votes[:, j]]) for j in range(len(HEURISTICS)))
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return post, table


def fit_scorer(spots: np.ndarray, values: np.ndarray, starts: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer for soft labels ``y``, by full-batch Adam.

    Document i's features that aren't zero are ``values[starts[i]:starts[i + 1]]`` at ``spots``; none has no feature, as
    each has the bias. They are read STEP documents at a time, so four bytes a feature are all that is held.
    """
    w, m, v = np.zeros(_DIM, np.float32), np.zeros(_DIM, np.float32), np.zeros(_DIM, np.float32)
    for t in range(1, rounds + 1):
        g = np.zeros(_DIM)
        for lo in range(0, len(y), STEP):
            hi = min(len(y), lo + STEP)
            own = slice(starts[lo], starts[hi])
            spot, value = spots[own].astype(np.intp), values[own].astype(np.float32)
            z = np.add.reduceat(value * w[spot], starts[lo:hi] - starts[lo])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g += np.bincount(spot, value * np.repeat(p - y[lo:hi], np.diff(starts[lo : hi + 1])), minlength=_DIM)
        g = (g / max(len(y), 1)).astype(np.float32) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _label(share: float):
    least = int(share * (1 << 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.chunks(batch.column(1), 1 << 20):
                for lo2 in range(lo, hi, 256):
                    n = min(hi, lo2 + 256) - lo2
                    chunk = _Chunk(batch.column(1).slice(lo2, n))
                    draw = np.asarray(batch.column(2).slice(lo2, n).to_numpy(zero_copy_only=False), np.int64)
                    rows = np.flatnonzero(draw < least)
                    spots: list[bytes | None] = [None] * n
                    values: list[bytes | None] = [None] * n
                    if len(rows):
                        x = chunk.features()[rows].astype("<f2")
                        for r, own in zip(rows.tolist(), x, strict=True):
                            some = np.flatnonzero(own)
                            spots[r], values[r] = some.astype("<u2").tobytes(), own[some].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array(chunk.votes()), pa.array(draw), pa.array(spots, pa.binary()), pa.array(values, pa.binary())], ["code", "draw", "spots", "values"])

    return run


def _junk(weights: np.ndarray):
    """Texts to the scorer's probability that they are junk, as an Arrow UDF: the other columns of a row stay in the JVM."""

    def scores(texts: pa.Array) -> pa.Array:
        out = []
        for lo, hi in words.chunks(texts, 1 << 20):
            for lo2 in range(lo, hi, 256):
                z = _Chunk(texts.slice(lo2, min(hi, lo2 + 256) - lo2)).features() @ weights
                out.append(np.round(1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30))), 6))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield scores(texts)
        finally:
            release()

    return F.arrow_udf(run, "double")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray | None, np.ndarray]:
    """The scorer's weights and P(vote | class), learnt from all of ``docs`` without any label.

    Votes are counted over all rows. The rows that train the scorer are drawn by a hash of id and text, ``sample`` at
    most, so neither repeated ids nor repeated rows bring more. Weights are None where no row was drawn: an empty table,
    or one so uniform that its few hashes all miss; then nothing can be told apart.
    """
    total = max(1, docs.count())
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    draw = F.pmod(F.xxhash64(F.lit("sample"), col(id_col).cast("string"), text), F.lit(1 << 32))
    table = cut(docs.select(F.lit(0), text, draw).mapInArrow(tidy(_label(min(1.0, 1.25 * sample / total))), "code long, draw long, spots binary, values binary"), "votes", scratch := [])
    counts = table.groupBy("code").count().orderBy("code").toPandas()
    codes, n = counts["code"].to_numpy(np.int64), counts["count"].to_numpy(float)
    if not len(codes):
        return None, np.zeros((len(HEURISTICS), 2, 3))
    post, votes = fit_labels(codes, n)
    rows = table.filter("spots is not null").orderBy("draw", "code").limit(sample).toArrow()
    remove(docs.sparkSession, scratch)
    if not rows.num_rows:
        return None, votes
    spots, values = (np.frombuffer(b"".join(rows[c].to_pylist()), kind) for c, kind in (("spots", "<u2"), ("values", "<f2")))
    starts = np.concatenate([[0], np.cumsum([len(x) // 2 for x in rows["spots"].to_pylist()])])
    y = post[np.searchsorted(codes, rows["code"].to_numpy())].astype(np.float32)
    return fit_scorer(spots, values, starts, y), votes


def _scored(docs: DataFrame, name: str, id_col: str, text_col: str, sample: int) -> DataFrame:
    weights, _ = fit(docs, id_col, text_col, sample)
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return docs.withColumn(name, F.lit(0.0) if weights is None else _junk(weights)(text))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, reject: float = 0.5) -> DataFrame:
    """Return ``(doc_id, junk, kept)``, one row per input row: ``junk`` is the scorer's probability, kept below ``reject``.

    Null and empty texts hold no features; the scorer's bias decides on them like on any other. Texts of any length are
    read whole. Repeated rows get equal results, and where no row could train a scorer (see ``fit``) ``junk`` is 0 and
    all are kept; an empty table gives an empty one. Other columns are not read, so they may have any names.
    """
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return _scored(rows, "junk", "doc_id", "text", sample).select("doc_id", "junk", (F.col("junk") < reject).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, reject: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns, whatever their names.

    Each row is decided on by its own text, so repeated and null ids change nothing; see ``classify`` for the rest.
    """
    (junk,) = fresh(docs.columns, "junk")
    return _scored(docs, junk, id_col, text_col, sample).filter(col(junk) < reject).select(*map(col, docs.columns))
