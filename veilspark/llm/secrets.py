"""Secrets, with structural confirmation.

Base rules give spans that always stay. Other encoded runs (base64 or hex) are reported only when what they decode to
parses: DER with nested lengths that fill it exactly, length-prefixed key encodings, signed tokens whose header is a JSON
object with an algorithm, and armoured private keys whose body, after its header lines, is DER or an OpenSSH key (a body
that its header lines call encrypted holds whole cipher blocks instead). Long base64 (URL-safe or wrapped too) and hex
runs go through all of these.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import col, tidy

BASE = ("assign", "access", "hex")
EXTRA = ("token", "pem", "ssh_key", "der", "der_hex", "pem_coded", "ssh_key_hex", "pem_hex")
KINDS = BASE + EXTRA
MIN_GROUP, MAX_DEPTH = 6, 12

# The patterns of the base kinds. Where only long matches count, the length stands in the pattern.
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{16,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----\s*((?:[A-Za-z0-9-]{1,40}:[^\n]*\n(?:[\x20\t][^\n]*\n)*)*)([A-Za-z0-9+/=\s]+)-----END \1-----")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]{16,})*(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+(?==|(?![^\s])))?={0,2}")
_PLAIN = re.compile(r"[A-Za-z0-9+/]{32,}={0,2}")
_FIRST = ("M", "AAAA", "LS0t", "b3Bl")
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{40,}")
_OPENSSH = b"openssh-key-v1\0"
_KEY_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-", b"sk-ssh-", b"sk-ecdsa-")


def _unbase64(s: str) -> bytes | None:
    s = s.rstrip("=")
    try:
        return base64.urlsafe_b64decode(s.replace("+", "-").replace("/", "_") + "=" * (-len(s) % 4))
    except (binascii.Error, ValueError):
        return None


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """A DER length at ``at``: its value and where the content begins; None unless minimal and complete."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data) or data[at + 1] == 0:
        return None
    value = int.from_bytes(data[at + 1 : at + 1 + n], "big")
    return (value, at + 1 + n) if value >= 0x80 else None


def der_nested(data: bytes, depth: int = 0) -> int | None:
    """How many elements a DER sequence holds in all, if every nested length fills its parent exactly; else None."""
    at = count = 0
    while at < len(data):
        tag, got = data[at], _length(data, at + 1)
        if got is None or tag & 0x1F == 0x1F or tag == 0 or got[1] + got[0] > len(data):
            return None
        size, start = got
        count += 1
        if tag & 0x20:
            inner = der_nested(data[start : start + size], depth + 1) if depth < MAX_DEPTH else None
            if inner is None:
                return None
            count += inner
        at = start + size
    return count


def is_der(data: bytes | None) -> bool:
    return data is not None and len(data) >= 16 and data[0] == 0x30 and (der_nested(data) or 0) >= 3


def is_ssh_key(data: bytes | None) -> bool:
    """Length-prefixed fields that fill the whole, the first of them the name of a key type."""
    if data is None or len(data) < 20:
        return False
    at, fields = 0, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return len(fields) >= 2 and fields[0].startswith(_KEY_NAMES)


def is_token(s: str) -> bool:
    head, body, _ = s.split(".", 2)
    try:
        header, claims = json.loads(_unbase64(head) or b""), json.loads(_unbase64(body) or b"")
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def is_pem(m: re.Match[str]) -> bool:
    """An armoured key whose body is one: DER or OpenSSH's own format, or whole cipher blocks where header lines call it encrypted."""
    data = _unbase64(re.sub(r"\s+", "", m[3]))
    if re.search(r"(?m)^Proc-Type:.*ENCRYPTED", m[2]) and "DEK-Info:" in m[2]:
        return data is not None and len(data) >= 16 and len(data) % 8 == 0
    return is_der(data) or (data is not None and data.startswith(_OPENSSH))


def kind_of(data: bytes | None) -> str | None:
    """What decoded bytes are: a key encoding, DER or a whole armoured key."""
    if data is None:
        return None
    if is_ssh_key(data) or (data.startswith(_OPENSSH) and len(data) >= 64):
        return "ssh_key"
    if is_der(data):
        return "der"
    if b"-----BEGIN" in data and any(is_pem(m) for m in _PEM.finditer(data.decode("latin-1"))):
        return "pem"
    return None


_OF_BASE64 = {"ssh_key": "ssh_key", "der": "der", "pem": "pem_coded"}
_OF_HEX = {"ssh_key": "ssh_key_hex", "der": "der_hex", "pem": "pem_hex"}


def _coded(run: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what a run of base64 lines holds: values of several lines, or else of one or a part of one."""
    lines, found, at = list(re.finditer(r"[A-Za-z0-9+/_=-]+", run)), [], 0
    while at < len(lines):
        tries = [len(lines), len(lines) - 1] if at == 0 or lines[at][0].startswith(_FIRST) else []
        for stop in [n for n in tries if n > at + 1]:  # the last line may be a word of what follows
            if kind := kind_of(_unbase64("".join(x[0] for x in lines[at:stop]))):
                found.append((lines[at].start(), kind, lines[stop - 1].end()))
                at = stop
                break
        else:
            for m in (lines[at], *_PLAIN.finditer(run, lines[at].start(), lines[at].end())):
                if kind := kind_of(_unbase64(m[0])):
                    found.append((m.start(), kind, m.end()))
                    break
            at += 1
    return found


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end), sorted; added kinds never overlap an earlier added one."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= MIN_GROUP]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    more: list[tuple[int, int, int]] = []
    if "eyJ" in text:
        more += [(m.start(), 3, m.end()) for m in _TOKEN.finditer(text) if is_token(m[0])]
    if "-----BEGIN" in text:
        more += [(m.start(), 4, m.end()) for m in _PEM.finditer(text) if is_pem(m)]
    for m in _BASE64.finditer(text):
        more += [(m.start() + start, KINDS.index(_OF_BASE64[kind]), m.start() + end) for start, kind, end in _coded(m[0])]
    for m in _LONG_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := kind_of(bytes.fromhex(m[0]))):
            more.append((m.start(), KINDS.index(_OF_HEX[kind]), m.end()))
    last = -1
    for start, kind, end in sorted(more):
        if start >= last:
            found.append((start, kind, end))
            last = end
    return sorted(found)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    for batch in batches:
        rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": k < len(BASE)} for a, k, b in spans_of(x.as_py())] for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``(doc_id, spans)``, one row per input row: spans ``(kind, start, end, base)`` by start, then kind.

    Offsets count code points, end exclusive. Null text is empty and has no spans; texts of any length are read whole.
    Repeated rows, and rows that share an id or have none, get results of their own; other columns are not read, so they
    may have any names; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")))
    return rows.mapInArrow(tidy(_find), f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")
