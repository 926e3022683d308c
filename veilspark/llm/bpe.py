"""Byte-pair encoding and decoding with numpy merge rounds.

Symbols of many distinct words lie in one flat array. Each round looks up every adjacent pair's rank by binary search
over sorted pair keys, takes each word's lowest rank and merges all its occurrences from left to right. In the
vocabularies read here every merge makes a new symbol, so pairs that hold it rank later and one round per rank is the
same as merging one occurrence at a time; that is verified when the file is read. Words finished are set aside, so a
batch costs as many rounds as its longest word needs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import col, quoted, tidy

#: White space as the tokenizer's patterns read it.
_WHITE = r"\x09-\x0D\x20\x85\xA0  -     　"
_NO_RANK = np.int64(1 << 40)
#: Distinct words whose ids a worker remembers; beyond that it starts anew. A matter of speed only.
REMEMBERED = 100_000
BATCH_CHARS = 1_000_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordBpe:
    """The tokenizer of a JSON file with word-end suffix, byte-level alphabet and NFC, white space and case folding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", _WHITE)).findall
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        names = dict.fromkeys(range(1 + max(*vocab.values(), *self.special.values())), "")
        names |= {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.names = [names[i] for i in range(len(names))]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        born = np.full(len(self.names), -1, np.int64)
        born[made] = np.arange(len(made))
        if len(np.unique(made)) != len(made) or (born[pairs].max(axis=1) >= np.arange(len(made))).any():
            raise ValueError("merge rounds need a vocabulary in which each merge makes a new symbol")
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order, made
        self.known: dict[str, np.ndarray] = {}

    def pieces(self, text: str) -> list[str | int]:
        """Words of the folded text, with the ids of special tokens that stand in it."""
        found: list[str | int] = []
        for part in self.split_special.split(text) if "<|" in text else (text,):
            if part in self.special:
                found.append(self.special[part])
            else:
                found += self.words(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return found

    def merge_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each of ``words``, by merge rounds over all of them at once."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym, word = self.inner[data], np.repeat(np.arange(len(raw)), sizes)
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.last[data[ends]]
        done_sym, done_word = [], []
        while len(sym):
            inside = word[1:] == word[:-1]
            key = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(inside & (self.keys[at] == key), self.ranks[at], _NO_RANK)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(np.concatenate([rank, [_NO_RANK]]), first)
            size = np.diff(np.concatenate([first, [len(sym)]]))
            best_at = np.repeat(best, size)
            over = best_at == _NO_RANK
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            hit = (rank == best_at[:-1]) & (rank < _NO_RANK)
            spots = np.flatnonzero(hit)
            if len(spots):  # of overlapping occurrences (a a a) every second one, from the left
                fresh = np.concatenate([[True], np.diff(spots) > 1])
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(spots)), 0))
                spots = spots[(np.arange(len(spots)) - run) % 2 == 0]
                sym = sym.copy()
                sym[spots] = self.made[rank[spots]]
            stay = ~over
            stay[spots + 1] = False
            sym, word = sym[stay], word[stay]
        sym, word = np.concatenate([*done_sym, []]).astype(np.int64), np.concatenate([*done_word, []]).astype(np.int64)
        order = np.argsort(word, kind="stable")
        return np.split(sym[order].astype("<u4"), np.searchsorted(word[order], np.arange(1, len(words))))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        fresh = list({p for pieces in split for p in pieces if p not in known and isinstance(p, str)})
        if fresh:
            known.update(zip(fresh, (ids.tobytes() for ids in self.merge_words(fresh)), strict=True))
        for i in self.special.values():
            known[i] = np.array([i], "<u4").tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, pieces)), "<u4") for pieces in split]

    def decode(self, ids: np.ndarray) -> str:
        """The names of the symbols, joined by spaces, as a tokenizer without a decoder gives them; ids that name none are left out."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.names)):
            ids = ids[(ids >= 0) & (ids < len(self.names))]
        return " ".join(map(self.names.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def forget() -> None:
    """Drop what this worker holds for encoding: what runs in it next may be something else."""
    tokenizer.cache_clear()


#: What encode() can add to a row.
OUTPUTS = {"n_tokens": "long", "ids": "array<long>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """``keep`` columns and ``outputs`` (see OUTPUTS) of every whole text; null text is empty and has no ids.

    ``path`` is a tokenizer file that every executor can read. Only ``keep`` and the text are read, so other columns
    may have any name; rows are independent, so repeated rows give repeated results and an empty table an empty one.
    """
    types = [f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in keep]
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        make = {
            "n_tokens": lambda ids, text: pa.array([len(x) for x in ids], pa.int64()),
            "ids": lambda ids, text: pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())),
            "decoded": lambda ids, text: pa.array(text, pa.string()),
            "ids_sha256": lambda ids, text: pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": lambda ids, text: pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in text], pa.string()),
        }
        for batch in batches:
            column = batch.column(n_keep)
            lengths = [x or 0 for x in pc.binary_length(column).to_pylist()]
            start = 0
            while start < len(lengths):
                end, total = start + 1, lengths[start]
                while end < len(lengths) and total + lengths[end] <= BATCH_CHARS:
                    total += lengths[end]
                    end += 1
                ids = tok.encode_batch([t or "" for t in column.slice(start, end - start).to_pylist()])
                text = [tok.decode(x) for x in ids] if {"decoded", "decoded_sha256"} & {*outputs} else []
                own = [batch.column(k).slice(start, end - start) for k in range(n_keep)]
                yield pa.RecordBatch.from_arrays([*own, *(make[o](ids, text) for o in outputs)], [*keep, *outputs])
                start = end

    rows = docs.select(*[col(c).alias(f"k{k}") for k, c in enumerate(keep)], col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run, forget), ", ".join([*types, *(f"{o} {OUTPUTS[o]}" for o in outputs)]))


def decode(df: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded``, the text of each row's ids; null ids decode to the empty text.

    Null entries and ids outside of the vocabulary are left out, as the tokenizer has no name for them. Rows are
    independent; an empty table gives an empty result.
    """
    types = [f"{quoted(c)} {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            text = [tok.decode(np.array([i for i in x or [] if i is not None], np.int64)) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(text, pa.string())], [*keep, "decoded"])

    return df.select(*[col(c).alias(f"k{k}") for k, c in enumerate(keep)], col(ids_col).alias("ids")).mapInArrow(tidy(run, forget), ", ".join([*types, "decoded string"]))
