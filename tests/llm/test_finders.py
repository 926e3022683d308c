"""Personal data and secrets: every registered column against plain regular expressions, and what the methods add."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import numpy as np
import pytest

from veilspark.llm import pii, secrets
from veilspark.llm.queries import _digest


def _luhn(s: str) -> bool:
    d = [int(c) for c in s if c.isdigit()]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def _digits(s: str) -> int:
    return sum(c in "0123456789" for c in s)


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= _digits(m[0]) <= 19 and _luhn(m[0])),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= _digits(m[0]) <= 15),
}
SECRETS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def _plain(text: str, kinds: dict) -> list[tuple[int, int, str, int]]:
    return sorted((m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text) if ok(m))


def _told(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def _made(seed: int, parts: list[str], n: int = 300) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]


PII_PARTS = ["a", "b.", "@", "-", ".", " ", "1", "22", "255", "256", "0", "+", "(", ")", "é", "日", "x@y.z", "10.1.2.3", "4111 1111 1111 1111", "4111111111111112", "+1 (323) 555-9830", "\n", "%", "_", "tel "]
SECRET_PARTS = ["password", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "a1b2c3", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "x", "é", "/", "+", ".", "-", "\n", "Secret"]


@pytest.mark.parametrize(("module", "kinds", "parts"), [(pii, PII, PII_PARTS), (secrets, SECRETS, SECRET_PARTS)])
def test_base_columns(spark, module, kinds, parts):
    texts = [*_made(7, parts), "", None, "9" * 5000, "a" * 3000 + "@b.c", "+1" + " 2" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in _digest(module.find(df), module.BASE).collect():
        want = _plain(texts[r.doc_id] or "", kinds)
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[2] == k for s in want) for k in kinds], texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(_told(want).encode()).hexdigest(), texts[r.doc_id]
        every = [s.split(":") for s in r.spans.split(",")] if r.spans else []
        assert ",".join(":".join(s) for s in every if s[0] in kinds) == _told(want)
        order = [(int(a), module.KINDS.index(k)) for k, a, _ in every]
        assert order == sorted(order)


def test_added_personal_data(spark):
    rng = random.Random(3)
    good = [f"please call ({rng.randrange(201, 989)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)} at noon" for _ in range(150)]
    bad = []
    while len(bad) < 150:
        n = str(rng.randrange(10**15, 10**16))
        if not _luhn(n):
            bad.append(f"lot{rng.randrange(9)} of {n} units")
    mail = [f"write to {a} (at) outlook (dot) com" for a in ("maria.lopez", "peter", "emma.brown")]
    base = ["card 4111 1111 1111 1111, host 10.1.2.3, +1 (323) 555-9830"]
    texts = good + bad + mail + base
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if not s.base] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(spans[i] == [("phone_like", 12, 26)] for i in range(150)) >= 145
    assert sum(bool(spans[i]) for i in range(150, 300)) <= 5
    assert all([s[0] for s in spans[i]] == ["email_like"] for i in range(300, 303))
    assert spans[303] == []


def test_reliabilities_of_two_classes():
    """Votes drawn for two classes with known reliabilities: posteriors tell the classes apart and accuracies come out."""
    rng = np.random.default_rng(1)
    n, width = 20_000, len(pii.LABELERS)
    truth = rng.random(n) < 0.3
    accuracy = np.linspace(0.6, 0.95, width)
    right = rng.random((n, width)) < accuracy
    votes = np.where(rng.random((n, width)) < 0.2, 0, np.where(right == truth[:, None], 2, 1))
    codes = (votes * 3 ** np.arange(width)[::-1]).sum(axis=1)
    distinct, counts = np.unique(codes, return_counts=True)
    post, table = pii.reliabilities(distinct, counts.astype(float))
    assert ((post[np.searchsorted(distinct, codes)] > 0.5) == truth).mean() > 0.95
    assert np.abs(table[:, 1, 2] / (1 - table[:, 1, 0]) - accuracy).max() < 0.05


def test_candidates_leave_base_spans_alone():
    text = "host 10.1.2.3 and 4111 1111 1111 1111 and 300.1.2.3"
    base = pii.base_spans(text)
    assert [(k, text[a:b]) for k, a, b, _, _ in pii.candidates(text, base)] == [("ip_like", "300.1.2.3")]


def test_keys_behind_an_equals_sign(spark):
    body = b"".join(b"\x02\x40\x5f" + bytes((i * n * 37 + 11) % 256 for i in range(63)) for n in range(1, 7))
    der = b"\x30\x82" + len(body).to_bytes(2, "big") + body
    value = base64.b64encode(der).decode()
    text = f"key={value} end"
    found = {(s.kind, s.start, s.end) for s in secrets.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).head().spans}
    assert ("der", 4, 4 + len(value)) in found
    head = base64.urlsafe_b64encode(b'{"alg":"HS256","typ":"JWT"}').decode().rstrip("=")
    claims = base64.urlsafe_b64encode(b'{"sub":"1234567890"}').decode().rstrip("=")
    token = f"{head}.{claims}.{'s' * 43}"
    assert ("token", 5, 5 + len(token)) in {(secrets.KINDS[k], a, b) for a, k, b in secrets.spans_of("got: " + token)}
    assert all(k < len(secrets.BASE) for _, k, _ in secrets.spans_of(f"got: {head[:-4]}AAAA.{claims}.{'s' * 43} and {'A' * 64}"))
