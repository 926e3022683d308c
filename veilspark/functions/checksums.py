"""Check-digit tests as Column expressions. Each takes a Column of text and gives a boolean Column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.once import let


def only(text: Column, keep: str = "0-9") -> Column:
    return F.regexp_replace(text, f"[^{keep}]", "")


def digit(text: Column, i: int) -> Column:
    return F.substring(text, i + 1, 1).try_cast("int")


def weighted(text: Column, weights: Sequence[int], start: int = 0) -> Column:
    """Sum of the digits from ``start`` times ``weights``."""
    return let(text, lambda t: reduce(lambda a, b: a + b, [digit(t, start + i) * w for i, w in enumerate(weights)]))


def luhn(text: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", text), F.lit(False))


def mod97(text: Column) -> Column:
    """ISO 13616: the first four characters move to the end, letters count 10 to 35, the remainder by 97 is 1."""
    turned = F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def iso7064_mod11_10(text: Column) -> Column:
    """Product-sum check over all digits but the last, which is the check digit."""
    digits = F.filter(F.split(text, ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        s = (acc + c.try_cast("int")) % 10
        return F.when(s == 0, 10).otherwise(s) * 2 % 11

    product = F.aggregate(F.slice(digits, F.lit(1), F.greatest(F.size(digits) - 1, F.lit(0))), F.lit(10), step)
    return (F.lit(11) - product) % 10 == F.element_at(digits, -1).try_cast("int")


def verhoeff(text: Column) -> Column:
    """The dihedral-group check over all digits; both tables follow from its rules."""

    def times(j: int, k: int) -> int:
        if j < 5:
            return (j + k) % 5 if k < 5 else 5 + (j + k) % 5
        return 5 + (j - k) % 5 if k < 5 else (j - k) % 5

    first = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    turns = [list(range(10))]
    for _ in range(7):
        turns.append([first[d] for d in turns[-1]])
    product = F.array(*[F.lit(times(j, k)) for j in range(10) for k in range(10)])
    turned = F.array(*[F.lit(d) for row in turns for d in row])
    digits = F.reverse(F.filter(F.split(text, ""), lambda c: c != ""))
    start = F.struct(F.lit(0).alias("c"), F.lit(0).alias("i"))

    def step(acc: Column, c: Column) -> Column:
        spot = F.element_at(turned, (acc["i"] % 8) * 10 + c.try_cast("int") + 1)
        return F.struct(F.element_at(product, acc["c"] * 10 + spot + 1).alias("c"), (acc["i"] + 1).alias("i"))

    return F.aggregate(digits, start, step)["c"] == 0


def letter_value(text: Column, i: int) -> Column:
    """0-9 for digits, 10-35 for letters."""
    c = F.upper(F.substring(text, i + 1, 1))
    return F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)


def digit_sum(x: Column) -> Column:
    """Of a number below 100."""
    return x % 10 + (x / 10).cast("int")


#: The alphabets of Base58 and Bech32, the latter's generator and its two constants.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
_BECH32_ENDS = (1, 0x2BC830A3)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def base58check(text: Column, most: int = 72) -> Column:
    """Whether the last four bytes are those of the double SHA-256 of the rest, for texts of at most ``most`` characters.

    The number is kept in limbs of 40 bits, lowest first, so each step of the base conversion fits a long."""
    limbs = F.array_repeat(F.lit(0).cast("long"), F.ceil(F.length(text) * 6 / 40).cast("int"))

    def add(limbs: Column, c: Column) -> Column:
        def carry(acc: Column, limb: Column) -> Column:
            total = limb * 58 + acc["over"]
            return F.struct(F.shiftright(total, 40).alias("over"), F.concat(acc["out"], F.array(total.bitwiseAND(F.lit((1 << 40) - 1)))).alias("out"))

        first = F.struct((F.instr(F.lit(BASE58), c) - 1).cast("long").alias("over"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(limbs, first, carry, lambda acc: acc["out"])

    number = F.aggregate(F.aggregate(_chars(text), limbs, add), F.lit(""), lambda s, limb: F.concat(F.lpad(F.hex(limb), 10, "0"), s))
    zeros = F.regexp_replace(F.regexp_extract(text, "^1*", 0), "1", "00")
    data = F.concat(zeros, F.regexp_replace(number, "^(00)+", ""))

    def sealed(data: Column) -> Column:
        body = F.unhex(F.substr(data, F.lit(1), F.length(data) - 8))
        return F.upper(F.substring(F.sha2(F.unhex(F.sha2(body, 256)), 256), 1, 8)) == F.right(data, F.lit(8))

    good = let(data, sealed)
    return F.when(text.rlike(f"^[{BASE58}]{{6,{most}}}$"), F.coalesce(good, F.lit(False))).otherwise(False)


def bech32(text: Column) -> Column:
    """The checksum of Bech32 or Bech32m over a text in lower or in upper case, of at most 90 characters."""
    low = F.lower(text)
    shape = f"^([\\x21-\\x7E]+)1([{BECH32}]{{6,}})$"
    human, data = _chars(F.regexp_extract(low, shape, 1)), _chars(F.regexp_extract(low, shape, 2))
    high = F.transform(human, lambda c: F.shiftright(F.ascii(c), 5))
    rest = F.transform(human, lambda c: F.ascii(c).bitwiseAND(31))
    values = F.concat(high, F.array(F.lit(0)), rest, F.transform(data, lambda c: F.instr(F.lit(BECH32), c) - 1))

    def step(acc: Column, v: Column) -> Column:
        out = F.shiftleft(acc.bitwiseAND(0x1FFFFFF), 5).bitwiseXOR(v)
        for i, g in enumerate(_BECH32_GENERATOR):
            out = out.bitwiseXOR(F.shiftright(acc, 25 + i).bitwiseAND(1) * g)
        return out

    one_case = (text == low) | (text == F.upper(text))
    return one_case & (F.length(text) <= 90) & low.rlike(shape) & F.aggregate(values, F.lit(1), step).isin(*_BECH32_ENDS)
