"""Rewriting text: one operator for each entity type, spliced into the text in one pass, and the way back."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.once import let
from veilspark.operators.scan import text_of

ITEM = "struct<start:int,end:int,entity_type:string,text:string,operator:string,score:double>"


@dataclass(frozen=True)
class Operator:
    """What is done to an entity's text, with its parameters."""

    name: str
    params: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("an operator needs a name")


def _need(op: Operator, key: str, kind: type | tuple[type, ...]) -> object:
    if key not in op.params:
        raise ValueError(f"{op.name}: expected parameter {key}")
    if not isinstance(op.params[key], kind) or (isinstance(op.params[key], bool) and kind is int):
        raise ValueError(f"{op.name}: invalid type of parameter {key}")
    return op.params[key]


def replace(op: Operator, text: Column, entity: Column) -> Column:
    new = op.params.get("new_value")
    if new and not isinstance(new, str):
        raise ValueError("replace: new_value must be text")
    return F.lit(new) if new else F.concat(F.lit("<"), entity, F.lit(">"))


def redact(op: Operator, text: Column, entity: Column) -> Column:
    return F.lit("")


def mask(op: Operator, text: Column, entity: Column) -> Column:
    char, count, from_end = _need(op, "masking_char", str), _need(op, "chars_to_mask", int), _need(op, "from_end", bool)
    if len(char) > 1:
        raise ValueError("mask: masking_char must be one character")
    n = F.least(F.length(text), F.lit(max(0, count)))
    masked = F.repeat(F.lit(char), n)
    return F.concat(F.substr(text, F.lit(1), F.length(text) - n), masked) if from_end else F.concat(masked, F.substr(text, n + 1))


def hash_(op: Operator, text: Column, entity: Column) -> Column:
    """SHA-256 or SHA-512 of text and salt. Without a salt every entity gets a random one: write such a result once."""
    kind = op.params.get("hash_type", "sha256")
    if kind not in ("sha256", "sha512"):
        raise ValueError("hash: hash_type is sha256 or sha512")
    salt = op.params.get("salt")
    if salt is not None:
        salt = salt.encode() if isinstance(salt, str) else bytes(salt)
        if len(salt) < 16:
            raise ValueError("hash: a salt has at least 16 bytes")
        tail = F.unhex(F.lit(salt.hex()))
    else:
        tail = F.unhex(F.sha2(F.concat(F.uuid(), F.uuid()), 256))
    return F.sha2(F.concat(F.encode(text, "UTF-8"), tail), int(kind[3:]))


def _key(op: Operator) -> Column:
    key = _need(op, "key", (str, bytes))
    key = key.encode() if isinstance(key, str) else key
    if len(key) not in (16, 24, 32):
        raise ValueError(f"{op.name}: a key has 128, 192 or 256 bits")
    return F.unhex(F.lit(key.hex()))


def encrypt(op: Operator, text: Column, entity: Column) -> Column:
    """AES-CBC with a random vector in front, in URL-safe base64."""
    sealed = F.aes_encrypt(F.encode(text, "UTF-8"), _key(op), F.lit("CBC"), F.lit("PKCS"))
    return F.translate(F.base64(sealed), "+/\r\n", "-_")


def decrypt(op: Operator, text: Column, entity: Column) -> Column:
    return F.decode(F.aes_decrypt(F.unbase64(F.translate(text, "-_", "+/")), _key(op), F.lit("CBC"), F.lit("PKCS")), "UTF-8")


def keep(op: Operator, text: Column, entity: Column) -> Column:
    return text


def custom(op: Operator, text: Column, entity: Column) -> Column:
    """``lambda`` takes and gives a Column; a pandas UDF is one such function."""
    call = op.params.get("lambda")
    if not callable(call):
        raise ValueError("custom: lambda must be callable")
    return call(text).cast("string")


def surrogate(op: Operator, text: Column, entity: Column) -> Column:
    """A value of the same shape, without a service: each letter and digit becomes another one, the same for the same text,
    entity type and ``key``. Other signs stay. An offline stand-in that knows nothing of what names or places look like."""
    key = F.lit(str(op.params.get("key", "")))
    seed = F.sha2(F.concat_ws("\0", key, entity, text), 512)

    def moved(c: Column, i: Column) -> Column:
        step = F.conv(F.substr(seed, i * 2 % 126 + 1, F.lit(2)), 16, 10).cast("int")
        turn = lambda first, n: F.char((F.ascii(c) - first + step) % n + first)
        return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), moved), "")


Builder = Callable[[Operator, Column, Column], Column]
FORWARD: dict[str, Builder] = {"replace": replace, "redact": redact, "mask": mask, "hash": hash_, "encrypt": encrypt, "keep": keep, "custom": custom, "surrogate": surrogate}
BACK: dict[str, Builder] = {"decrypt": decrypt, "deanonymize_keep": keep}


def add_operator(name: str, builder: Builder, back: bool = False) -> None:
    (BACK if back else FORWARD)[name] = builder


def remove_operator(name: str, back: bool = False) -> None:
    table = BACK if back else FORWARD
    if name not in table:
        raise ValueError(f"no operator {name!r}")
    del table[name]


def _new_text(text: Column, entity: Column, operators: Mapping[str, Operator], default: Operator | None, table: dict[str, Builder]) -> tuple[Column, Column]:
    out, name = None, None
    for e, op in operators.items():
        if e == "DEFAULT":
            continue
        if op.name not in table:
            raise ValueError(f"unknown operator {op.name!r}")
        value = table[op.name](op, text, entity)
        out = F.when(entity == e, value) if out is None else out.when(entity == e, value)
        name = F.when(entity == e, op.name) if name is None else name.when(entity == e, op.name)
    default = operators.get("DEFAULT", default)
    if default is None:
        return (text if out is None else out.otherwise(text)), (F.lit("keep") if name is None else name.otherwise("keep"))
    if default.name not in table:
        raise ValueError(f"unknown operator {default.name!r}")
    value = table[default.name](default, text, entity)
    return (value if out is None else out.otherwise(value)), (F.lit(default.name) if name is None else name.otherwise(default.name))


def _splice(text: Column, spans: Column, operators: Mapping[str, Operator], default: Operator | None, table: dict[str, Builder]) -> Column:
    """``struct<text, items>``: spans in order of start are replaced, each end cut where the next span begins. A span that
    reaches beyond the text is an error. The spans, and each new text, are computed once."""

    def within(given: Column) -> Column:
        beyond = F.exists(given, lambda s: (s["start"] > F.length(text)) | (s["end"] > F.length(text)) | (s["start"] < 0))
        return F.when(beyond, F.filter(given, lambda s: F.raise_error(F.concat(F.lit("a span reaches beyond its text of length "), F.length(text).cast("string"))).cast("boolean"))).otherwise(given)

    placed = let(let(spans, within), lambda all_: F.transform(all_, lambda s, i: F.struct(s.alias("s"), F.coalesce(F.try_element_at(all_, i + 2)["start"], F.length(text)).alias("next"))))

    def step(acc: Column, p: Column) -> Column:
        s = p["s"]
        new, name = _new_text(text_of(text, s), s["entity_type"], operators, default, table)
        before = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))

        def put(made: Column) -> Column:
            start = F.length(acc["text"]) + F.length(made["before"])
            item = F.struct(start.alias("start"), (start + F.length(made["new"])).alias("end"), s["entity_type"].alias("entity_type"), made["new"].alias("text"), name.alias("operator"), s["score"].alias("score"))
            return F.struct(F.concat(acc["text"], made["before"], made["new"]).alias("text"), F.least(s["end"], p["next"]).alias("at"), F.concat(acc["items"], F.array(item)).alias("items"))

        return let(F.struct(before.alias("before"), new.alias("new")), put)

    first = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), F.array().cast(f"array<{ITEM}>").alias("items"))
    return let(F.aggregate(placed, first, step), lambda done: F.struct(F.concat(done["text"], F.substr(text, done["at"] + 1)).alias("text"), F.reverse(done["items"]).alias("items")))


def anonymize(text: Column, spans: Column, operators: Mapping[str, Operator] | None = None) -> Column:
    """``struct<text, items>`` of a text and its resolved spans; items from the last to the first, with new offsets."""
    return _splice(text, spans, operators or {}, Operator("replace"), FORWARD)


def deanonymize(text: Column, items: Column, operators: Mapping[str, Operator]) -> Column:
    """The way back, at the offsets of the items of an anonymized text; entities without an operator stay."""
    ordered = F.sort_array(items)
    return _splice(text, ordered, operators, None, BACK)


def with_mask_defaults(operators: Mapping[str, Operator] | None) -> dict[str, Operator]:
    """The regex-only profile's defaults: mask everything with asterisks from the start."""
    return {e: Operator("mask", {"masking_char": "*", "chars_to_mask": 1 << 30, "from_end": False} | dict(op.params)) if op.name == "mask" else op for e, op in (operators or {}).items()}
