"""The detection rules: patterns, scores, context words and checks of each recognizer.

Patterns, scores, context words and check weights are fixed values. Flags are those of the engine (case-insensitive,
multi-line, dot matches all, Unicode classes). A check returns true (score 1), false (no result) or null (score kept); a
rejection is true where a match is no result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import checksums as C
from veilspark.functions.once import let

Check = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    name: str
    entity: str
    patterns: tuple[tuple[str, float], ...]
    context: tuple[str, ...] = ()
    check: Check | None = None
    reject: Check | None = None
    language: str = "en"
    country: str | None = None
    enabled: bool = False
    #: Group ends tried from last to first, for rules whose match may be too long.
    groups: int = 0
    flags: str = "(?ismU)"
    thresholds: tuple[tuple[str, float], ...] = ()
    #: A cheap pattern that every text with a match has a match of, or one for each pattern.
    guard: str | tuple[str | None, ...] | None = None
    #: Sees all spans found in a text, and the text, before context raises scores; gives the spans that go on.
    hook: Callable[[Column, Column], Column] | None = None

    def __post_init__(self) -> None:
        if not self.name or not self.entity or not self.patterns:
            raise ValueError("a rule needs a name, an entity and patterns")
        if any(not 0 <= s <= 1 for _, s in self.patterns):
            raise ValueError(f"{self.name}: scores lie between 0 and 1")
        if isinstance(self.guard, tuple) and len(self.guard) != len(self.patterns):
            raise ValueError(f"{self.name}: a guard for each pattern, or one for all")

    @property
    def guards(self) -> tuple[str | None, ...]:
        return self.guard if isinstance(self.guard, tuple) else (self.guard,) * len(self.patterns)


def _digits_ok(weights: list[int], mod: int, start: int = 0) -> Check:
    return lambda t: C.weighted(C.only(t), weights, start) % mod == 0


def _check_digit(weights: list[int], at: int, mod: int = 10) -> Check:
    def check(t: Column) -> Column:
        d = C.only(t)
        return (F.lit(mod) - C.weighted(d, weights) % mod) % mod == C.digit(d, at)

    return check


def _all_same(t: Column) -> Column:
    return C.only(t).rlike(r"^(\d)\1*$")


def _wallet(t: Column) -> Column:
    return F.when(t.rlike("^[13]"), C.base58check(t)).when(t.startswith("bc1"), C.bech32(t)).otherwise(False)


def _ssn_bad(t: Column) -> Column:
    kinds = F.size(F.array_distinct(F.filter(F.split(t, ""), lambda c: c.isin(".", "-", " "))))
    return (kinds > 1) | _all_same(t) | let(C.only(t), lambda d: (F.substring(d, 4, 2) == "00") | (F.substring(d, 6, 4) == "0000") | F.substring(d, 1, 3).isin("000", "666") | d.isin("123456789", "987654320", "078051120"))


def _aadhaar(t: Column) -> Column:
    d = C.only(t)
    return (F.length(d) == 12) & (C.digit(d, 0) >= 2) & C.verhoeff(d) & (F.reverse(d) != d)


def _abn(t: Column) -> Column:
    d = C.only(t)
    return (C.weighted(d, [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]) - 10) % 89 == 0


def _nif(t: Column) -> Column:
    d, c = C.only(t), F.upper(F.regexp_extract(t, r"([A-Za-z])$", 1))
    return F.substr(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (d.try_cast("long") % 23 + 1).cast("int"), F.lit(1)) == c


def _nie(t: Column) -> Column:
    first = F.upper(F.substring(t, 1, 1))
    number = F.concat(F.translate(first, "XYZ", "012"), C.only(F.substr(t, F.lit(2))))
    c = F.upper(F.regexp_extract(t, r"([A-Za-z])$", 1))
    return first.isin("X", "Y", "Z") & number.rlike("^[0-9]{8,9}$") & (F.substr(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (number.try_cast("long") % 23 + 1).cast("int"), F.lit(1)) == c)


def _npi(t: Column) -> Column:
    return C.luhn(F.concat(F.lit("80840"), C.only(t)))


def _dea(t: Column) -> Column:
    d = F.substr(t, F.lit(3))
    odd = C.digit(d, 0) + C.digit(d, 2) + C.digit(d, 4)
    return (odd + 2 * (C.digit(d, 1) + C.digit(d, 3) + C.digit(d, 5))) % 10 == C.digit(d, 6)


def _mrz(t: Column) -> Column:
    u = F.upper(t)
    return sum((C.letter_value(u, i) * w for i, w in enumerate([7, 3, 1, 7, 3, 1, 7, 3])), F.lit(0)) % 10 == C.digit(u, 8)


def _kvnr(t: Column) -> Column:
    u = F.upper(t)
    v = C.letter_value(u, 0) - 9
    parts = [(v / 10).cast("int"), v % 10, *(C.digit(u, i) for i in range(1, 9))]
    return sum((C.digit_sum(p * (1 + i % 2)) for i, p in enumerate(parts)), F.lit(0)) % 10 == C.digit(u, 9)


def _rvnr(t: Column) -> Column:
    u = F.upper(t)
    v, day, month = C.letter_value(u, 8) - 9, F.substring(u, 3, 2).try_cast("int"), F.substring(u, 5, 2).try_cast("int")
    parts = [*(C.digit(u, i) for i in range(8)), (v / 10).cast("int"), v % 10, C.digit(u, 9), C.digit(u, 10)]
    total = sum((C.digit_sum(p * w) for p, w in zip(parts, [2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1], strict=True)), F.lit(0))
    return (day.between(1, 31) | day.between(51, 81)) & month.between(1, 12) & (total % 10 == C.digit(u, 11))


def _lanr(t: Column) -> Column:
    return (F.lit(10) - C.weighted(t, [4, 9, 4, 9, 4, 9]) % 10) % 10 == C.digit(t, 6)


def _tax_id(t: Column) -> Column:
    ten = F.substring(t, 1, 10)
    often = F.greatest(*[F.length(ten) - F.length(F.translate(ten, str(k), "")) for k in range(10)])
    return (F.substring(t, 1, 1) != "0") & (often <= 3) & C.iso7064_mod11_10(t)


def _vat_de(t: Column) -> Column:
    return F.when(C.iso7064_mod11_10(C.only(t)), True)


def _vat_it(t: Column) -> Column:
    d = C.only(t)
    return (d != "00000000000") & C.luhn(d)


def _pan_bsnr(t: Column) -> Column:
    return F.when(C.only(t).rlike("^0*$") | (F.length(C.only(t)) != 9), False)


def _gstin(t: Column) -> Column:
    u = F.upper(t)
    return (F.length(u) == 15) & F.substring(u, 1, 2).try_cast("int").between(1, 37) & F.substring(u, 3, 10).rlike("^[A-Z]{5}[0-9]{4}[A-Z]$") & (F.substring(u, 14, 1) == "Z")


def _ph_tin_bad(t: Column) -> Column:
    d = C.only(t)
    return ~F.length(d).isin(9, 12) | (C.weighted(d, [9, 8, 7, 6, 5, 4, 3, 2]) % 11 != C.digit(d, 8))


def _brn(t: Column) -> Column:
    d = C.only(t)
    total = C.weighted(d, [1, 3, 7, 1, 3, 7, 1, 3, 5]) + (C.digit(d, 8) * 5 / 10).cast("int")
    return (F.lit(10) - total % 10) % 10 == C.digit(d, 9)


def _rrn(offset: int) -> Check:
    def check(t: Column) -> Column:
        d = C.only(t)
        good = (F.substring(d, 8, 2).try_cast("int") <= 95) & ((F.lit(offset) - C.weighted(d, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]) % 11) % 10 == C.digit(d, 12))
        return F.when(F.length(d) != 13, False).when(good, True)

    return check


def _nhs(t: Column) -> Column:
    return C.weighted(C.only(t), list(range(10, 0, -1))) % 11 == 0


def _thai(t: Column) -> Column:
    return (F.lit(11) - C.weighted(t, list(range(13, 1, -1))) % 11) % 10 == C.digit(t, 12)


def _tr_id(t: Column) -> Column:
    odd, even = sum((C.digit(t, i) for i in (0, 2, 4, 6, 8)), F.lit(0)), sum((C.digit(t, i) for i in (1, 3, 5, 7)), F.lit(0))
    ten = odd + even + C.digit(t, 9)
    return (C.digit(t, 0) != 0) & (F.pmod(odd * 7 - even, F.lit(10)) == C.digit(t, 9)) & (ten % 10 == C.digit(t, 10))


def _personnummer(t: Column) -> Column:
    d = F.substr(C.only(t), F.length(C.only(t)) - 9)
    month, day = F.substring(d, 3, 2).try_cast("int"), F.substring(d, 5, 2).try_cast("int")
    return month.between(1, 12) & (day.between(1, 31) | day.between(61, 91)) & C.luhn(d)


def _orgnr(t: Column) -> Column:
    d = C.only(t)
    return (F.length(d) == 10) & (C.digit(d, 2) >= 2) & C.luhn(d)


def _hetu(t: Column) -> Column:
    u = F.upper(t)
    sign = F.substring(u, 7, 1)
    century = F.when(sign == "+", "18").when(sign.isin("-", "Y", "X", "W", "V", "U"), "19").otherwise("20")
    real = F.try_to_timestamp(F.concat(century, F.substring(u, 5, 2), F.substring(u, 3, 2), F.substring(u, 1, 2)), F.lit("yyyyMMdd")).isNotNull()
    number = F.concat(F.substring(u, 1, 6), F.substring(u, 8, 3)).try_cast("long")
    return (F.length(u) == 11) & real & (F.substr(F.lit("0123456789ABCDEFHJKLMNPRSTUVWXY"), (number % 31 + 1).cast("int"), F.lit(1)) == F.substring(u, 11, 1))


def _fiscal_code(t: Column) -> Column:
    u = F.upper(t)
    odd = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]
    table = F.array(*[F.lit(v) for v in odd])
    place = lambda i: F.when(F.substring(u, i + 1, 1).between("0", "9"), F.ascii(F.substring(u, i + 1, 1)) - 48).otherwise(F.ascii(F.substring(u, i + 1, 1)) - 65)
    total = sum((F.element_at(table, place(i) + 1) if i % 2 == 0 else place(i) for i in range(15)), F.lit(0))
    return F.when(F.char(total % 26 + 65) == F.substring(u, 16, 1), True)


def _za_id(t: Column) -> Column:
    date = F.substring(t, 1, 6)
    real = F.try_to_timestamp(F.concat(F.lit("19"), date), F.lit("yyyyMMdd")).isNotNull() | F.try_to_timestamp(F.concat(F.lit("20"), date), F.lit("yyyyMMdd")).isNotNull()
    return (F.length(t) == 13) & real & F.substring(t, 11, 1).isin("0", "1", "2") & F.substring(t, 12, 1).isin("8", "9") & C.luhn(t)


def _card(t: Column) -> Column:
    return C.luhn(F.translate(t, "- ", ""))


def _mac_bad(t: Column) -> Column:
    d = F.upper(F.translate(t, ":-.", ""))
    return ~d.rlike("^[0-9A-F]{12}$") | d.isin("FFFFFFFFFFFF", "000000000000")


def _uuid_bad(t: Column) -> Column:
    u = F.lower(t)
    return (F.translate(u, "0-", "") == "") | ~F.substring(u, 15, 1).isin(*"12345678") | ~F.substring(u, 20, 1).isin(*"89ab")


def _ip_bad(t: Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(t, "/.*$", ""), "%.*$", "")
    v4 = F.regexp_extract(host, r"([0-9]+(?:\.[0-9]+){3})$", 1)
    zero = v4.rlike(r"(^|\.)0[0-9]")
    groups = F.size(F.filter(F.split(F.regexp_replace(host, r"[0-9]+(?:\.[0-9]+){3}$", "0:0"), ":"), lambda g: g != ""))
    short = host.contains("::")
    v6_bad = F.when(short, groups > 7).otherwise(groups != 8) | host.rlike("::.*::|:::")
    return zero | (host.contains(":") & v6_bad)


#: Public suffixes that the e-mail check accepts: any two-letter country code, and these. A parameter, not a registry.
SUFFIXES = "com org net edu gov mil int info biz name pro app dev io ai cloud online site shop store tech xyz blog email".split()


def _email_ok(t: Column) -> Column:
    last = F.lower(F.regexp_extract(t, r"\.([^.@]+)$", 1))
    return last.rlike("^[a-z]{2}$") | last.isin(*SUFFIXES)


# What follows country and check digits in an account number, by country: n digits, a capitals, c either.
IBAN_FORMATS = dict(
    AD="8n12c", AE="19n", AL="8n16c", AT="16n", AZ="4c20n", BA="16n", BE="12n", BG="4a6n8c", BH="4a14c", BR="23n1a1c", BY="4c4n16c", CH="5n12c", CR="1z17n", CY="8n16c", CZ="20n", DE="18n", DK="14n", DO="4a20n",
    EE="16n", EG="25n", ES="20n", FI="14n", FO="14n", FR="10n11c2n", GB="4a14n", GE="2c16n", GI="4a15c", GL="14n", GR="7n16c", GT="24c", HR="17n", HU="24n", IE="4c14n", IL="19n", IQ="4a15n", IS="22n", IT="1a10n12c",
    JO="4a22n", KW="4a22c", KZ="3n13c", LB="4n20c", LC="4a24c", LI="5n12c", LT="16n", LU="3n13c", LV="4a13c", LY="21n", MC="10n11c2n", MD="20c", ME="18n", MK="3n10c2n", MR="23n", MT="4a5n18c", MU="4a19n1a", NL="4a10n",
    NO="11n", PK="4c16n", PL="24n", PS="4c21n", PT="21n", QA="4a21c", RO="4a16c", RS="18n", SA="2n18c", SC="4a20n3a", SE="20n", SI="15n", SK="20n", SM="1a10n12c", TL="19n", TN="20n", TR="5n17c", UA="6n19c", VA="18n",
    VG="4c16n", XK="16n",
)
_KINDS = {"n": "[0-9]", "a": "[A-Z]", "c": "[a-zA-Z0-9]", "z": "0"}
_IBAN_WHOLE = "^(?:" + "|".join(k + "[0-9]{2}" + re.sub(r"([0-9]+)([nacz])", lambda m: f"{_KINDS[m[2]]}{{{m[1]}}}", f) for k, f in IBAN_FORMATS.items()) + ")$"


def _iban(t: Column) -> Column:
    """Check digits and the country's format; no verdict where only the upper-cased number has it."""
    plain = F.translate(t, "- ", "")
    up = F.upper(plain)
    good = C.mod97(up) & F.substring(up, 3, 2).between("02", "98")
    return F.when(~F.coalesce(good, F.lit(False)) | ~up.rlike(_IBAN_WHOLE), False).when(plain.rlike(_IBAN_WHOLE), True)


#: The day that rules against future dates go by, as yyyy-MM-dd; None: the day of the query.
AS_OF: ContextVar[str | None] = ContextVar("as_of", default=None)


def _this_year() -> Column:
    day = AS_OF.get()
    return F.year(F.current_date() if day is None else F.lit(day).cast("date"))


def _region_code(t: Column) -> Column:
    d = C.only(t)
    return (F.length(d) == 12) & (F.substring(d, 1, 2).isin(*[str(n) for n in range(11, 27)], "28"))


# Weights, alphabets and kinds of entity of the Singapore number.
_UEN_A, _UEN_A_LETTERS = (10, 4, 9, 3, 8, 2, 7, 1), "XMKECAWLJDB"
_UEN_B, _UEN_B_LETTERS = (10, 8, 6, 4, 9, 7, 5, 3, 1), "ZKCMDNERGWH"
_UEN_C, _UEN_C_LETTERS = (4, 3, 5, 3, 10, 2, 2, 5, 7), "ABCDEFGHJKLMNPQRSTUVWX0123456789"
_UEN_KINDS = "LP LL FC PF RF MQ MM NB CC CS MB FM GS DP CP NR CM CD MD HS VH CH MH CL XL CX HC RP TU TC FB FN PA PB SS MC SM GA GB".split()


def _uen(t: Column) -> Column:
    u = F.upper(t)
    last = F.substr(u, F.length(u), F.lit(1))
    letter = lambda letters, place: F.substr(F.lit(letters), (place % 11 + 1).cast("int"), F.lit(1))
    place = lambda i: F.instr(F.lit(_UEN_C_LETTERS), F.substring(u, i + 1, 1)) - 1
    total = sum((place(i) * w for i, w in enumerate(_UEN_C)), F.lit(0))
    known = F.substring(u, 1, 9).rlike(f"^[{_UEN_C_LETTERS}]*$")
    kind_c = F.substring(u, 1, 1).isin("T", "S", "R") & F.substring(u, 4, 2).isin(*_UEN_KINDS) & known & (letter(_UEN_C_LETTERS, F.pmod(total - 5, F.lit(11))) == last)
    kind_a = letter(_UEN_A_LETTERS, C.weighted(u, _UEN_A)) == last
    kind_b = (letter(_UEN_B_LETTERS, C.weighted(u, _UEN_B)) == last) & (F.substring(u, 1, 4).try_cast("int") <= _this_year())
    return F.coalesce(F.when(F.length(u) == 9, kind_a).when(F.substring(u, 1, 1).rlike("[A-Z]"), kind_c).otherwise(kind_b), F.lit(False))


def _za_company(t: Column) -> Column:
    year = F.regexp_extract(F.upper(t), r"^(?:CK|K|T|W|B|M|NR|N)?(\d{4})/", 1).try_cast("int")
    return F.coalesce(year.between(1800, _this_year()), F.lit(False))


def _za_plate(t: Column) -> Column:
    u = F.upper(F.translate(t, "- ", ""))
    return (F.length(u) >= 5) & F.substr(u, F.length(u) - 1, F.lit(2)).isin(*"GP ZN WP EC NC FS LP MP NW".split()) & F.substr(u, F.lit(1), F.length(u) - 2).rlike("[A-Z]")


# Districts of registration offices by state, as ranges.
_IN_DISTRICTS = dict(
    AN="1", AP="39-40", AR="1-17,19-20,22", AS="1-20,22-34", BR="1-11,19,21-22,24-34,37-39,43-46,50-53,55-56", CG="1-30", CH="1-4", DD="1-3", DN="9", DL="1-13", GA="1-12", GJ="1-39", HP="1-20,22-99", HR="1-20,22-99",
    JH="1-20,22-24", JK="1-20,22", KA="1-20,22-71", KL="1-20,22-99", LA="1-2", LD="1-9", MH="1-20,22-51", ML="1-10", MN="1-7", MP="1-20,22-71", MZ="1-8", NL="1-10", OD="1-20,22-35", OR="1-20,22-31", PB="1-20,22-99",
    PY="1-5", RJ="1-20,22-58", SK="1-8", TN="1-20,22-99", TR="1-8", TS="1-20,22-38", UK="1-20", UP="11-20,22-96", WB="1-20,22-98",
)


def _in_vehicle(t: Column) -> Column:
    """True for a known district; else no verdict. Only Delhi and Gujarat write districts with one digit."""
    u = F.upper(F.translate(t, "-: ", ""))
    state, code = F.substring(u, 1, 2), F.regexp_extract(u, r"^[A-Z]{2}(\d{1,2})", 1)
    number = code.try_cast("int")
    within = F.lit(False)
    for name, ranges in _IN_DISTRICTS.items():
        spans = [r.split("-") for r in ranges.split(",")]
        within = within | ((state == name) & reduce(lambda a, b: a | b, [number.between(int(r[0]), int(r[-1])) for r in spans]))
    good = (F.length(u) >= 8) & within & ((F.length(code) == 2) | state.isin("DL", "GJ")) & F.substr(u, F.length(u) - 3, F.lit(4)).rlike("^[0-9]{4}$") & (F.substr(u, F.length(u) - 3, F.lit(4)) != "0000")
    return F.when(F.coalesce(good, F.lit(False)), True)


_TLD = "(?:com|edu|gov|int|mil|net|org|pro|red|tel|xxx|academy|agency|app|art|asia|bank|best|bike|bio|biz|blog|build|business|cafe|care|careers|center|chat|city|clinic|cloud|club|codes|company|consulting|cool|design|dev|digital|direct|earth|education|email|energy|events|expert|finance|fit|fun|fund|gallery|global|group|guide|health|help|host|house|info|ink|institute|international|land|law|legal|life|link|live|ltd|market|marketing|media|mobi|money|name|network|news|online|page|partners|photo|photos|pics|plus|press|pub|rentals|report|rest|review|reviews|run|sale|school|science|services|shop|site|social|software|solutions|space|store|studio|style|support|systems|team|tech|technology|tips|today|tools|top|tours|town|trade|training|travel|university|video|vip|vote|website|wiki|win|work|works|world|xyz|zone|[a-z]{2})"
_URL = rf"((www\d{{0,3}}[.])?[a-z0-9.\-]{{1,253}}[.]{_TLD}(?:/[^\s()<>\"']*)?)"
_MONTHS = "(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)"
_D, _M = "([1-9]|0[1-9]|[1-2][0-9]|3[0-1])", "([1-9]|0[1-9]|1[0-2])"
_ISO = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T[0-2]\d:[0-5]\d"
_ZONE = r"([+-][0-2]\d:[0-5]\d|Z)"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_H, _P6 = "[0-9A-Fa-f]{1,4}", r"(?:/(?:12[0-8]|1[01]\d|[1-9]?\d))?"
_LABEL = r"(?:\s{0,4}(?:#|no\.?|number|id)\s{0,4}:?\s{0,4}|\s{0,4}:\s{0,4}|\s{1,4})"  # a lookbehind has a greatest length, so four blanks at most
_MBI_N, _MBI_A, _MBI_X = "[0-9]", "[ACDEFGHJKMNPQRTUVWXY]", "[0-9ACDEFGHJKMNPQRTUVWXY]"
_EIN = "(?:0[1-6]|1[0-6]|2[0-7]|3[0-9]|4[0-8]|5[0-9]|6[0-8]|7[1-7]|8[0-8]|9[0-5]|9[89])"


def _w(words: str) -> tuple[str, ...]:
    return tuple(words.split(","))


GENERIC = (
    Rule("CreditCard", "CREDIT_CARD", ((r"\b(?!1\d{12}(?!\d))((4\d{3})|(5[0-5]\d{2})|(6\d{3})|(1\d{3})|(3\d{3}))[- ]?(\d{3,4})[- ]?(\d{3,4})[- ]?(\d{3,5})\b", 0.3),), _w("credit,card,visa,mastercard,cc ,amex,discover,jcb,diners,maestro,instapayment"), check=_card, enabled=True, guard=r"(?U)\d"),
    Rule("Date", "DATE_TIME", (
        (rf"\b(?:({_ISO}:[0-5]\d\.\d+{_ZONE})|({_ISO}:[0-5]\d{_ZONE})|({_ISO}{_ZONE}))\b", 0.8),
        (rf"\b({_M}/{_D}/(\d{{4}}|\d{{2}}))\b", 0.6), (rf"\b({_D}/{_M}/(\d{{4}}|\d{{2}}))\b", 0.6), (rf"\b(\d{{4}}/{_M}/{_D})\b", 0.6), (rf"\b({_M}-{_D}-\d{{4}})\b", 0.6), (rf"\b({_D}-{_M}-\d{{4}})\b", 0.6), (rf"\b(\d{{4}}-{_M}-{_D})\b", 0.6),
        (rf"\b({_D}\.{_M}\.(\d{{4}}|\d{{2}}))\b", 0.6), (rf"\b({_D}-{_MONTHS}-(\d{{4}}|\d{{2}}))\b", 0.6), (rf"\b({_MONTHS}-(\d{{4}}|\d{{2}}))\b", 0.6), (rf"\b({_D}-{_MONTHS})\b", 0.6), (rf"\b({_M}/\d{{4}})\b", 0.2), (rf"\b({_M}/\d{{2}})\b", 0.1),
    ), _w("date,birthday"), enabled=True, guard=r"(?U)\d"),
    Rule("Email", "EMAIL_ADDRESS", ((r"\b((([!#$%&'*+\-/=?^_`{|}~\w])|([!#$%&'*+\-/=?^_`{|}~\w][!#$%&'*+\-/=?^_`{|}~\.\w]{0,}[!#$%&'*+\-/=?^_`{|}~\w]))[@]\w+(?:-+\w+)*(?:\.\w+(?:-+\w+)*)+)\b", 0.5),), _w("email"), check=_email_ok, enabled=True, guard="@"),
    Rule("Crypto", "CRYPTO", ((r"(bc1|[13])[a-zA-HJ-NP-Z0-9]{25,59}", 0.5),), _w("wallet,btc,bitcoin,crypto"), check=_wallet, enabled=True, guard="(?i)bc1|[13]"),
    Rule("Iban", "IBAN_CODE", ((r"(?<![A-Z0-9])([A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,6})((?:[ -]?[A-Z0-9]{4})?)((?:[ -]?[A-Z0-9]{1,3})?)(?![A-Z0-9])", 0.5),), _w("iban,bank,transaction"), check=_iban, groups=3, enabled=True, guard="[0-9]{2}"),
    Rule("Ip", "IP_ADDRESS", (
        (rf"(?<![\w:])::(?:ffff(?::0{{1,4}})?:)?(?:{_OCTET}\.){{3}}{_OCTET}{_P6}\b", 0.6),
        (rf"(?<![\w:])(?:(?:{_H}:){{1,5}}:(?:{_H}:){{0,4}}|(?:{_H}:){{6}})(?:{_OCTET}\.){{3}}{_OCTET}{_P6}\b", 0.6),
        (rf"\b{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?:/(?:[0-2]?\d|3[0-2]))?\b", 0.6),
        (rf"(?<![\w:])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,7}}:|:(?::{_H}){{1,7}}|(?:{_H}:){{1,6}}:{_H}|(?:{_H}:){{1,5}}(?::{_H}){{1,2}}|(?:{_H}:){{1,4}}(?::{_H}){{1,3}}|(?:{_H}:){{1,3}}(?::{_H}){{1,4}}|(?:{_H}:){{1,2}}(?::{_H}){{1,5}}|{_H}:(?::{_H}){{1,6}}|:(?::{_H}){{1,6}})(?:%[0-9a-zA-Z]+)?{_P6}(?![\w:]|\.\d)", 0.6),
        (rf"(?<![\w:])::{_P6.replace('))?', '))?')}(?![\w:])", 0.1),
    ), _w("ip,ipv4,ipv6"), reject=_ip_bad, enabled=True, guard=(":", ":", "[0-9]\\.[0-9]", ":", ":")),
    Rule("MacAddress", "MAC_ADDRESS", ((r"\b[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}\b", 0.6), (r"\b[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\b", 0.6)), _w("mac,mac address,hardware address,physical address,ethernet"), reject=_mac_bad, enabled=True, guard="[0-9A-Fa-f]{2}[:.-]"),
    Rule("Phone", "PHONE_NUMBER", tuple((p, 0.4) for p in (
        # any country code; that of North America has ten digits behind it, and no number runs on into an address
        rf"(?<![\w+])\+(?:1[ .-]?(?:\(\d{{3}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]?\d{{4}}|\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{1,4}}(?:(?: (?!(?:{_OCTET}\.){{3}}{_OCTET}\b)|[.-]?)\d{{2,4}}){{1,4}})(?!\w)",
        r"(?<![\w+.-])\(?[2-9]\d{2}\)?[ .-]\d{3}[ .-]\d{4}(?![\w-])",  # US, CA
        r"(?<![\w+.-])\(?0(?:20[ )]{0,2}[ -]?\d{4}[ -]?\d{4}|1\d{3}\)?[ -]?\d{6}|1\d{2}\)?[ -]\d{3}[ -]?\d{4}|7\d{3}[ -]?\d{6}|7\d{3}[ -]\d{3}[ -]\d{3})(?![\w-])",  # GB
        r"(?<![\w+.-])\(?0[1-9]\d{1,4}\)?[ ]?[/-][ ]?\d{4,8}(?![\w-])",  # DE
        r"(?<![\w+.-])0[1-9](?:[ .]\d{2}){4}(?![\w-])",  # FR
        r"(?<![\w+.-])0(?:[23489]|5\d|7\d)-\d{3}-?\d{4}(?![\w-])",  # IL
        r"(?<![\w+.-])[6-9]\d{4}[ -]\d{5}(?![\w-])",  # IN
        r"(?<![\w+.-])\([1-9]\d\)[ ]?9?\d{4}-\d{4}(?![\w-])",  # BR
    )), _w("phone,number,telephone,cell,cellphone,mobile,call"), enabled=True, guard=r"(?U)\d"),
    Rule("Url", "URL", ((rf"(?:https?://){_URL}", 0.6), (_URL, 0.5), (rf"[\"'](https?://{_URL})[\"']", 0.6), (rf"[\"']({_URL})[\"']", 0.5)), _w("url,website,link"), enabled=True, guard="\\."),
    Rule("Uuid", "UUID", ((r"\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\b", 0.5),), _w("uuid,guid,unique identifier"), reject=_uuid_bad, enabled=True, guard="[0-9A-Fa-f]{8}-"),
)

US = tuple(Rule(country="us", **r) for r in (
    dict(name="AbaRouting", entity="ABA_ROUTING_NUMBER", patterns=((r"\b[0123678]\d{8}\b", 0.05), (r"\b[0123678]\d{3}-\d{4}-\d\b", 0.3)), context=_w("aba,routing,abarouting,association,bankrouting"), check=_digits_ok([3, 7, 1] * 3, 10)),
    dict(name="MedicalLicense", entity="MEDICAL_LICENSE", patterns=((r"[abcdefghjklmprstuxABCDEFGHJKLMPRSTUX]{1}[a-zA-Z]{1}\d{7}|[abcdefghjklmprstuxABCDEFGHJKLMPRSTUX]{1}9\d{7}", 0.4),), context=_w("medical,certificate,DEA"), check=_dea, enabled=True),
    dict(name="UsBank", entity="US_BANK_NUMBER", patterns=((r"\b[0-9]{8,17}\b", 0.05),), context=_w("check,account,account#,acct,bank,save,debit"), enabled=True),
    dict(name="UsLicense", entity="US_DRIVER_LICENSE", patterns=((r"\b([A-Z][0-9]{3,6}|[A-Z][0-9]{5,9}|[A-Z][0-9]{6,8}|[A-Z][0-9]{4,8}|[A-Z][0-9]{9,11}|[A-Z]{1,2}[0-9]{5,6}|H[0-9]{8}|V[0-9]{6}|X[0-9]{8}|A-Z]{2}[0-9]{2,5}|[A-Z]{2}[0-9]{3,7}|[0-9]{2}[A-Z]{3}[0-9]{5,6}|[A-Z][0-9]{13,14}|[A-Z][0-9]{18}|[A-Z][0-9]{6}R|[A-Z][0-9]{9}|[A-Z][0-9]{1,12}|[0-9]{9}[A-Z]|[A-Z]{2}[0-9]{6}[A-Z]|[0-9]{8}[A-Z]{2}|[0-9]{3}[A-Z]{2}[0-9]{4}|[A-Z][0-9][A-Z][0-9][A-Z]|[0-9]{7,8}[A-Z])\b", 0.3), (r"\b([0-9]{6,14}|[0-9]{16})\b", 0.01)), context=_w("driver,license,permit,lic,identification,dls,cdls,lic#,driving"), enabled=True),
    dict(name="UsHealthInsuranceMemberId", entity="US_HEALTH_INSURANCE_MEMBER_ID", patterns=((r"\b(?=[A-Z0-9-]{6,20}\b)(?=[A-Z0-9-]*[A-Z])(?=[A-Z0-9-]*\d)[A-Z]{1,5}-?[A-Z0-9]{5,14}\b", 0.1),), context=_w("member,subscriber,insurance,policy")),
    dict(name="UsPriorAuthorizationNumber", entity="US_PRIOR_AUTHORIZATION_NUMBER", patterns=((rf"(?<=\b(?:prior\s{{1,4}}authorization|prior\s{{1,4}}auth|preauthorization|pre-auth|authorization){_LABEL})(?:PA-?)?\d{{6,12}}\b", 0.35), (r"\bPA-?\d{6,12}\b", 0.1)), context=_w("authorization,auth,preauthorization,approval")),
    dict(name="UsClaimNumber", entity="US_CLAIM_NUMBER", patterns=((rf"(?<=\b(?:claim|medical\s{{1,4}}claim|healthcare\s{{1,4}}claim){_LABEL})(?:CLM-?)?\d{{6,15}}\b", 0.35), (r"\bCLM-?\d{6,15}\b", 0.1)), context=_w("claim,billing")),
    dict(name="UsPrescriptionNumber", entity="US_PRESCRIPTION_NUMBER", patterns=((rf"(?<=\b(?:rx){_LABEL})(?:RX-?)?\d{{6,12}}\b", 0.6), (rf"(?<=\b(?:prescription){_LABEL})(?:RX-?)?\d{{6,12}}\b", 0.35), (r"\bRX-?\d{6,12}\b", 0.1)), context=_w("prescription,pharmacy,medication")),
    dict(name="UsReferralNumber", entity="US_REFERRAL_NUMBER", patterns=((rf"(?<=\b(?:referral|infusion\s{{1,4}}referral){_LABEL})(?:(?:REF|INF)-?)?\d{{6,12}}\b", 0.35), (r"\b(?:REF|INF)-?\d{6,12}\b", 0.1)), context=_w("referral,infusion,specialty,referring")),
    dict(name="UsProviderTaxId", entity="US_PROVIDER_TAX_ID", patterns=((rf"(?<=\b(?:(?:(?:billing|rendering|healthcare)\s{{1,4}}provider|provider\s{{1,4}}organization|provider)\s{{1,4}}(?:tax\s{{0,4}}(?:id|number|identification\s{{1,4}}number)|tin|ein)|billing\s{{1,4}}provider){_LABEL}){_EIN}-\d{{7}}\b", 0.35), (rf"\b{_EIN}-\d{{7}}\b", 0.1)), context=_w("tax,tin,ein,billing")),
    dict(name="UsItin", entity="US_ITIN", patterns=((r"\b9\d{2}[- ](5\d|6[0-5]|7\d|8[0-8]|9([0-2]|[4-9]))\d{4}\b|\b9\d{2}(5\d|6[0-5]|7\d|8[0-8]|9([0-2]|[4-9]))[- ]\d{4}\b", 0.05), (r"\b9\d{2}(5\d|6[0-5]|7\d|8[0-8]|9([0-2]|[4-9]))\d{4}\b", 0.3), (r"\b9\d{2}[- ](5\d|6[0-5]|7\d|8[0-8]|9([0-2]|[4-9]))[- ]\d{4}\b", 0.5)), context=_w("individual,taxpayer,itin,tax,payer,taxid,tin"), enabled=True),
    dict(name="UsMbi", entity="US_MBI", patterns=((rf"\b{_MBI_N}{_MBI_A}{_MBI_X}{_MBI_N}{_MBI_A}{_MBI_X}{_MBI_N}{_MBI_A}{_MBI_A}{_MBI_N}{_MBI_N}\b", 0.3), (rf"\b{_MBI_N}{_MBI_A}{_MBI_X}{_MBI_N}-{_MBI_A}{_MBI_X}{_MBI_N}-{_MBI_A}{_MBI_A}{_MBI_N}{_MBI_N}\b", 0.5)), context=_w("medicare,mbi,beneficiary,cms,medicaid,hic,hicn")),
    dict(name="UsNpi", entity="US_NPI", patterns=((r"\b[12]\d{9}\b", 0.1), (r"\b[12]\d{3}[ -]\d{3}[ -]\d{3}\b", 0.4)), context=_w("npi,national provider,provider,npi number,provider id,provider identifier,taxonomy"), check=_npi, reject=lambda t: F.substring(C.only(t), 1, 9).rlike(r"^(\d)\1*$")),
    dict(name="UsPassport", entity="US_PASSPORT", patterns=((r"(\b[0-9]{9}\b)", 0.05), (r"(\b[A-Z][0-9]{8}\b)", 0.1)), context=_w("us,united,states,passport,passport#,travel,document"), enabled=True),
    dict(name="UsSsn", entity="US_SSN", patterns=((r"\b([0-9]{5})-([0-9]{4})\b", 0.05), (r"\b([0-9]{3})-([0-9]{6})\b", 0.05), (r"\b(([0-9]{3})-([0-9]{2})-([0-9]{4}))\b", 0.05), (r"\b[0-9]{9}\b", 0.05), (r"\b([0-9]{3})[- .]([0-9]{2})[- .]([0-9]{4})\b", 0.5)), context=_w("social,security,ssn,ssns,ssid"), reject=_ssn_bad, enabled=True),
))


def _rule(country: str, language: str, name: str, entity: str, patterns, context: str, check=None, reject=None, enabled=False) -> Rule:
    return Rule(name, entity, tuple(patterns), _w(context), check, reject, language, country, enabled)


#: South African numbers by the first two digits after the country or trunk prefix, in place of a numbering-plan library.
_ZA_NUMBER = r"(?<![\w+])(?:(?:\+|00)27[ .-]?(?:\(0\)[ .-]?)?|\(?0)(?:{0})\)?[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}(?!\w)"
_ZA_PHONE_WORDS = "phone,number,telephone,cell,cellphone,mobile,call,cellular,handset,contact number,landline,tel,home number,work number,office number,sms,whatsapp"

WORLD = (
    _rule("uk", "en", "Nhs", "UK_NHS", [(r"\b([0-9]{3})[- ]?([0-9]{3})[- ]?([0-9]{4})\b", 0.5)], "national health service,nhs,health services authority,health authority", _nhs, enabled=True),
    _rule("uk", "en", "UkNino", "UK_NINO", [(r"\b(?!bg|gb|nk|kn|nt|tn|zz|BG|GB|NK|KN|NT|TN|ZZ)([a-ceghj-pr-tw-zA-CEGHJ-PR-TW-Z]{1}[a-ceghj-npr-tw-zA-CEGHJ-NPR-TW-Z]{1}) ?([0-9]{2}) ?([0-9]{2}) ?([0-9]{2}) ?([a-dA-D]{1})\b", 0.5)], "national insurance,ni number,nino"),
    _rule("uk", "en", "UkPostcode", "UK_POSTCODE", [(r"\b(GIR\s?0AA|[A-PR-UWYZ][0-9][ABCDEFGHJKPSTUW]?\s?[0-9][ABD-HJLNP-UW-Z]{2}|[A-PR-UWYZ][0-9]{2}\s?[0-9][ABD-HJLNP-UW-Z]{2}|[A-PR-UWYZ][A-HK-Y][0-9][ABEHMNPRVWXY]?\s?[0-9][ABD-HJLNP-UW-Z]{2}|[A-PR-UWYZ][A-HK-Y][0-9]{2}\s?[0-9][ABD-HJLNP-UW-Z]{2})\b", 0.1)], "postcode,post code,postal code,zip,address,delivery,mailing,shipping,correspondence"),
    _rule("uk", "en", "UkPassport", "UK_PASSPORT", [(r"\b[A-Z]{2}\d{7}\b", 0.1)], "passport,passport number,travel document,uk passport,british passport,her majesty,his majesty,hm passport,hmpo"),
    _rule("uk", "en", "UkDrivingLicence", "UK_DRIVING_LICENCE", [(r"\b[A-Z9]{5}[0-9](?:0[1-9]|1[0-2]|5[1-9]|6[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9][A-Z9]{2}[A-Z0-9][A-Z]{2}\b", 0.5)], "driving licence,driving license,driver's licence,driver's license,dvla,dl number,licence number,license number", lambda t: F.when(~F.upper(F.substring(t, 1, 5)).rlike("^[A-Z]+9*$"), False)),
    _rule("uk", "en", "UkVehicleRegistration", "UK_VEHICLE_REGISTRATION", [(r"\b[A-HJ-PR-Y][A-HJ-PR-Y](?:0[1-9]|[1-7][0-9])[- ]?[A-HJ-PR-Z]{3}\b", 0.3), (r"\b[A-HJ-NPR-TV-Y]\d{1,3}[- ]?[A-HJ-PR-Y][A-HJ-PR-Z]{2}\b", 0.2), (r"\b[A-HJ-PR-Z]{3}[- ]?\d{1,3}[- ]?[A-HJ-NPR-TV-Y]\b", 0.15)], "vehicle,registration,number plate,licence plate,license plate,reg,vrn,dvla,v5c,logbook,mot,car,insured vehicle", lambda t: F.when(F.translate(t, "- ", "").rlike("(?i)^[A-Z]{2}[0-9]{2}[A-Z]{3}$"), F.substring(t, 3, 2).try_cast("int").between(2, 29) | F.substring(t, 3, 2).try_cast("int").between(51, 79))),
    _rule("au", "en", "AuAbn", "AU_ABN", [(r"\b\d{2}\s\d{3}\s\d{3}\s\d{3}\b", 0.1), (r"\b\d{11}\b", 0.01)], "australian business number,abn", _abn),
    _rule("au", "en", "AuAcn", "AU_ACN", [(r"\b\d{3}\s\d{3}\s\d{3}\b", 0.1), (r"\b\d{9}\b", 0.01)], "australian company number,acn", _check_digit([8, 7, 6, 5, 4, 3, 2, 1], 8)),
    _rule("au", "en", "AuMedicare", "AU_MEDICARE", [(r"\b[2-6]\d{3}\s\d{5}\s\d\b", 0.1), (r"\b[2-6]\d{9}\b", 0.01)], "medicare", lambda t: C.weighted(C.only(t), [1, 3, 7, 9, 1, 3, 7, 9]) % 10 == C.digit(C.only(t), 8)),
    _rule("au", "en", "AuTfn", "AU_TFN", [(r"\b\d{3}\s\d{3}\s\d{3}\b", 0.1), (r"\b\d{9}\b", 0.01)], "tax file number,tfn", _digits_ok([1, 4, 3, 7, 5, 8, 6, 9, 10], 11)),
    _rule("ca", "en", "CaPostalCode", "CA_POSTAL_CODE", [(r"\b[ABCEGHJ-NPRSTVXY]\d[ABCEGHJ-NPRSTV-Z] \d[ABCEGHJ-NPRSTV-Z]\d\b", 0.3), (r"\b[ABCEGHJ-NPRSTVXY]\d[ABCEGHJ-NPRSTV-Z]\d[ABCEGHJ-NPRSTV-Z]\d\b", 0.1)], "postal code,postcode,zip,canada,ontario,quebec,alberta,british columbia,code postal"),
    _rule("ca", "en", "CaSin", "CA_SIN", [(r"\b[1-79]\d{8}\b", 0.05), (r"\b[1-79]\d{2}([- ])\d{3}\1\d{3}\b", 0.5)], "sin,sin number,social insurance,social insurance number,canada,nas,numéro nas,numéro d'assurance sociale,assurance sociale", reject=lambda t: ~C.luhn(C.only(t))),
    _rule("in", "en", "InAadhaar", "IN_AADHAAR", [(r"\b[0-9]{12}\b", 0.01), (r"\b[0-9]{4}[- :][0-9]{4}[- :][0-9]{4}\b", 0.01)], "aadhaar,uidai", _aadhaar),
    _rule("in", "en", "InGstin", "IN_GSTIN", [(r"\b((?:0[1-9]|[1-3][0-7])[A-Za-z0-9]{10}[A-Za-z0-9]{1}Z[A-Za-z0-9]{1})\b", 0.8), (r"\b((?:0[1-9]|[1-3][0-7])[A-Za-z0-9]{11}Z[A-Za-z0-9]{1})\b", 0.4), (r"\b([0-9]{2}[A-Za-z0-9]{11}Z[A-Za-z0-9]{1})\b", 0.1)], "gstin,gst,goods and services tax,tax identification,gst number,gst registration", _gstin),
    _rule("in", "en", "InPan", "IN_PAN", [(r"\b([A-Za-z]{3}[AaBbCcFfGgHhJjLlPpTt]{1}[A-Za-z]{1}[0-9]{4}[A-Za-z]{1})\b", 0.5), (r"\b([A-Za-z]{5}[0-9]{4}[A-Za-z]{1})\b", 0.1), (r"\b((?=.*?[a-zA-Z])(?=.*?[0-9]{4})[\w@#$%^?~-]{10})\b", 0.01)], "permanent account number,pan"),
    _rule("in", "en", "InPassport", "IN_PASSPORT", [(r"\b[A-Z][1-9]\d\s?\d{4}[1-9]\b", 0.1)], "passport,indian passport,passport number"),
    _rule("in", "en", "InVoter", "IN_VOTER", [(r"\b([A-Za-z]{1}[ABCDGHJKMNPRSYabcdghjkmnprsy]{1}[A-Za-z]{1}([0-9]){7})\b", 0.4), (r"\b([A-Za-z]){3}([0-9]){7}\b", 0.3)], "voter,epic,elector photo identity card"),
    _rule("ng", "en", "NgNin", "NG_NIN", [(r"\b\d{11}\b", 0.01)], "nin,national identification number,national identity number,nimc,national identity,nigeria id,nigerian identification", C.verhoeff),
    _rule("ng", "en", "NgVehicleRegistration", "NG_VEHICLE_REGISTRATION", [(r"\b[A-Z]{3}[- ]?\d{3}[A-Z]{2}\b", 0.5)], "plate number,vehicle registration,license plate,number plate,plate,vehicle,registration"),
    _rule("ph", "en", "PhPassport", "PH_PASSPORT", [(r"\b(?:[A-Z]\d{7}[A-Z]|[A-Z]{2}\d{7})\b", 0.1)], "passport,passport number,passport no,passport no.,passport#,passport id,travel document,philippine passport,philippines passport,pasaporte,pasaporte number,dfa"),
    _rule("ph", "en", "PhTin", "PH_TIN", [(r"\b(\d{3}-\d{3}-\d{3}(-\d{3})?)\b", 0.05), (r"\b(\d{9}|\d{12})\b", 0.01)], "tin,taxpayer identification number,bir,taxpayer id,tax id,rdo,revenue district office", reject=_ph_tin_bad),
    _rule("ph", "en", "PhUmid", "PH_UMID", [(r"\b\d{4}-\d{7}-\d\b", 0.5), (r"\b\d{12}\b", 0.3)], "umid,unified multi-purpose id,crn,common reference number,sss,gsis,philhealth,pag-ibig,umid number,umid card,unified multipurpose id"),
    _rule("sg", "en", "SgFin", "SG_NRIC_FIN", [(r"(\b[A-Z][0-9]{7}[A-Z]\b)", 0.3), (r"(\b[STFGM][0-9]{7}[A-Z]\b)", 0.5)], "fin,fin#,nric,nric#"),
    _rule("za", "en", "ZaIdNumber", "ZA_ID_NUMBER", [(r"\b\d{10}[0-2][89]\d\b", 0.2)], "id,identity,identity number,id number,south african id,rsa id,smart id,national id", _za_id),
    _rule("za", "en", "ZaIncomeTaxNumber", "ZA_INCOME_TAX_NUMBER", [(r"\b[01239]\d{9}\b", 0.05)], "sars,tax reference,income tax,tax number,itr,taxpayer,tax registration", lambda t: t.rlike(r"^[01239]\d{9}$")),
    _rule("za", "en", "ZaPassport", "ZA_PASSPORT", [(r"\b[ADMT]\d{8}\b", 0.2)], "passport,passport number,travel document,dha,south african passport,rsa passport", lambda t: F.upper(t).rlike(r"^[ADMT]\d{8}$")),
    _rule("za", "en", "ZaTrafficRegisterNumber", "ZA_TRAFFIC_REGISTER_NUMBER", [(r"\b\d{13}\b", 0.05)], "traffic register,traffic register number,trn,enatis,natis,vehicle register", lambda t: ~_za_id(t)),
    _rule("za", "en", "ZaVatNumber", "ZA_VAT_NUMBER", [(r"\b4\d{9}\b", 0.3)], "vat,vat number,vat registration,tax invoice,sars,value added tax", lambda t: t.rlike(r"^4\d{9}$")),
    _rule("in", "en", "InVehicleRegistration", "IN_VEHICLE_REGISTRATION", [
        (r"\b[A-Z]{1}(?!0000)[0-9]{4}\b", 0.01), (r"\b[A-Z]{2}(?!0000)\d{4}\b", 0.01), (r"\b(I)(?!00000)\d{5}\b", 0.01), (r"\b[A-Z]{3}(?!0000)\d{4}\b", 0.2), (r"\b\d{1,3}(CD|CC|UN)[1-9]{1}[0-9]{1,3}\b", 0.4),
        (r"\b[A-Z]{2}\d{1}[A-Z]{1,3}(?!0000)\d{4}\b", 0.5), (r"\b[A-Z]{2}\d{2}[A-Z]{1,2}(?!0000)\d{4}\b", 0.5), (r"\b[2-9]{1}[1-9]{1}(BH)(?!0000)\d{4}[A-HJ-NP-Z]{2}\b", 0.85), (r"\b(?!00)\d{2}(A|B|C|D|E|F|H|K|P|R|X)\d{6}[A-Z]{1}\b", 0.85),
    ], "RTO,vehicle,plate,registration", _in_vehicle),
    _rule("kr", "ko", "KrDriverLicense", "KR_DRIVER_LICENSE", [(r"(?<!\d)(\d{2})[- ]?(\d{2})[- ]?(\d{6})[- ]?(\d{2})(?!\d)", 0.05)], "운전면허,운전면허번호,면허번호,Korean driver license,Korean driver's license", _region_code),
    _rule("sg", "en", "SgUen", "SG_UEN", [(r"\b\d{8}[A-Z]\b|\b\d{9}[A-Z]\b|\b[TSR]\d{2}[A-Z]{2}\d{4}[A-Z]\b", 0.3)], "uen,unique entity number,business registration,ACRA", _uen),
    _rule("za", "en", "ZaCompanyRegistration", "ZA_COMPANY_REGISTRATION", [(r"\b(?:19|20)\d{2}/\d{6}/\d{2}\b", 0.4), (r"\b(?:CK|K|T|W|B|M|N|NR)\d{4}/\d{6}\b", 0.3)], "cipc,company registration,registration number,close corporation,company reg,enterprise number", _za_company),
    _rule("za", "en", "ZaDriverLicense", "ZA_DRIVER_LICENSE", [(r"\b\d{6,10}[A-Z0-9]{2,5}\b", 0.3)], "licence,license,driving licence,driving license,driver's licence,driver's license,drivers licence,drivers license,enatis,natis,licence number,license number", lambda t: F.length(t).between(10, 14) & F.upper(t).rlike(r"^\d{6,10}[A-Z0-9]{2,5}$") & F.upper(t).rlike("[A-Z]")),
    _rule("za", "en", "ZaLicensePlate", "ZA_LICENSE_PLATE", [
        (r"\b[A-Z]{2,4}\d{2,4}[A-Z]{0,4}(?:GP|ZN|WP|EC|NC|FS|LP|MP|NW)\b", 0.3), (r"\b[A-Z]{2}\s?\d{2}\s?[A-Z]{2}\s?(?:GP|ZN|WP|EC|NC|FS|LP|MP|NW)\b", 0.3), (r"\b[A-Z]{2,3}\s?\d{2,3}\s?(?:GP|ZN|WP|EC|NC|FS|LP|MP|NW)\b", 0.3), (r"\b\d{2,3}\s?[A-Z]{2,3}\s?EC\b", 0.3),
    ], "licence plate,license plate,number plate,registration,vehicle registration,natis,enatis,plate number", _za_plate),
    _rule("za", "en", "ZaMobileNumber", "ZA_MOBILE_NUMBER", [(_ZA_NUMBER.format("[67][0-9]|8[1-5]|8[89]"), 0.4)], _ZA_PHONE_WORDS),
    _rule("za", "en", "ZaTelephoneNumber", "ZA_TELEPHONE_NUMBER", [(_ZA_NUMBER.format("[1-5][0-9]|80|86|87|9[0-9]"), 0.4)], _ZA_PHONE_WORDS),
    _rule("de", "de", "DeTaxId", "DE_TAX_ID", [(r"\b[1-9]\d{10}\b", 0.5)], "steueridentifikationsnummer,steuer-id,steuerid,steuerliche identifikationsnummer,steuerliche identifikation,persönliche identifikationsnummer,steuer identifikation,idnr,steuer-idnr,steuernummer,bzst", _tax_id),
    _rule("de", "de", "DeTaxNumber", "DE_TAX_NUMBER", [(r"\b(0[1-9]|1[0-6])\d{11}\b", 0.5), (r"(?<!\w)\d{3}/\d{3}/\d{5}(?!\w)", 0.4), (r"(?<!\w)\d{2,3}/\d{3,4}/\d{4,5}(?!\w)", 0.2)], "steuernummer,steuer-nr,steuer nr,st.-nr,st-nr,finanzamt,umsatzsteuer,einkommensteuer,körperschaftsteuer,gewerbesteuer,steuerveranlagung,steuerbescheid"),
    _rule("de", "de", "DeVatId", "DE_VAT_ID", [(r"\bDE\d{9}\b", 0.5), (r"\bDE[\s.\-]?\d{3}[\s.\-]?\d{3}[\s.\-]?\d{3}\b", 0.4)], "umsatzsteuer-identifikationsnummer,umsatzsteueridentifikationsnummer,ust-idnr,ust-id,ustidnr,umsatzsteuer-id,mehrwertsteuer,vat,vat-id,vat id,steueridentifikation,bzst,bundeszentralamt für steuern,finanzamt,invoice,rechnung", _vat_de),
    _rule("de", "de", "DePassport", "DE_PASSPORT", [(r"\b[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{7}[0-9]\b", 0.4)], "reisepass,pass,passnummer,reisepassnummer,passport,passport number,pass-nr,dokumentennummer,bundesrepublik deutschland,ausweisdokument,mrz", lambda t: ~F.upper(t).rlike("[ABDEIOQSU]") & _mrz(t)),
    _rule("de", "de", "DeIdCard", "DE_ID_CARD", [(r"\b[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{7}[0-9]\b", 0.4), (r"\bT\d{8}\b", 0.5)], "personalausweis,ausweis,personalausweisnummer,ausweisnummer,ausweisdokument,dokumentennummer,seriennummer,npa,neuer personalausweis,personalausweisgesetz,pauwsg,bundespersonalausweis,identity card,national id", lambda t: F.when(~F.upper(t).rlike(r"^T\d{8}$"), _mrz(t))),
    _rule("de", "de", "DeHealthInsurance", "DE_HEALTH_INSURANCE", [(r"\b[A-Z]\d{9}\b", 0.3)], "krankenversicherungsnummer,krankenversichertennummer,versichertennummer,kvnr,krankenkasse,krankenversicherung,gesundheitskarte,egk,elektronische gesundheitskarte,gkv,gesetzliche krankenversicherung,krankenversicherungsausweis,versichertenausweis,versichertenkarte,aok,tkk,barmer,dak", _kvnr),
    _rule("de", "de", "DeSocialSecurity", "DE_SOCIAL_SECURITY", [(r"\b\d{2}(0[1-9]|[12]\d|3[01]|5[1-9]|[67]\d|8[01])(0[1-9]|1[0-2])\d{2}[A-Z]\d{2}[0-9]\b", 0.5), (r"\b\d{8}[A-Z]\d{3}\b", 0.3)], "rentenversicherungsnummer,sozialversicherungsnummer,versicherungsnummer,rvnr,svnr,sv-nummer,rente,rentenversicherung,deutsche rentenversicherung,drv,sozialversicherung,sozialversicherungsausweis,rentenausweis", _rvnr),
    _rule("de", "de", "DeLanr", "DE_LANR", [(r"\b\d{9}\b", 0.3)], "arztnummer,lanr,lebenslange arztnummer,arzt-nr,arzt nr,arzt-nummer,vertragsarzt,kassenarzt,niedergelassener arzt,kbv,kassenärztliche vereinigung,kv-nummer,rezept,verschreibung,behandelnder arzt,hausarzt,facharzt", _lanr),
    _rule("de", "de", "DeBsnr", "DE_BSNR", [(r"\b\d{9}\b", 0.2)], "betriebsstättennummer,betriebsstätten-nummer,bsnr,betriebsstätte,praxisnummer,arztpraxis,praxis,kassenärztliche vereinigung,kv-nummer,kv nummer,praxisadresse,praxisstandort,nebenbetriebsstätte,hauptbetriebsstätte,behandlungsort,vertragsarztpraxis", _pan_bsnr),
    _rule("de", "de", "DeHandelsregister", "DE_HANDELSREGISTER", [(r"\bHR[AB]\s*\d{1,6}\b", 0.5)], "handelsregister,handelsregisternummer,amtsgericht,registergericht,hra,hrb,hr-nummer,registerauszug,handelsregistereintrag,firma,gesellschaft,gmbh,ag,ug,kg,ohg,einzelkaufmann,einzelkauffrau,handelsregisterblattnummer"),
    _rule("de", "de", "DeFuehrerschein", "DE_FUEHRERSCHEIN", [(r"\b[A-Z]{2}\d{8}[A-Z0-9]\b", 0.35)], "führerscheinnummer,führerschein,fahrerlaubnis,fahrerlaubnisnummer,fahrerlaubnisklasse,führerscheininhaber,fev,kba,kraftfahrt-bundesamt,driving licence,driving license,driver's license,licence number,license number,dokument nr,dokument-nr,feld 5"),
    _rule("de", "de", "DePlz", "DE_PLZ", [(r"\b(?!01000\b|99999\b)(0[1-9]\d{3}|[1-9]\d{4})\b", 0.05)], "plz,postleitzahl,postanschrift,adresse,wohnort,ort,wohnanschrift,lieferadresse,rechnungsadresse,straße,strasse,hausnummer,postfach,bundesland,gemeinde,stadt,dorf"),
    _rule("de", "de", "DeKfz", "DE_KFZ", [(r"(?<![\w-])[A-ZÄÖÜ]{1,3}\s[A-Z]{1,2}\s\d{1,4}[EH]?(?!\w)", 0.3), (r"(?<![\w-])[A-ZÄÖÜ]{1,3}-[A-Z]{1,2}-\d{1,4}[EH]?(?!\w)", 0.3), (r"(?<![\w-])[A-ZÄÖÜ]{1,3}-[A-Z]{1,2}\s\d{1,4}[EH]?(?!\w)", 0.3), (r"(?<![\w-])[A-Z]{1,3}\s[A-Z]{1,2}\s\d{1,4}[EH]?(?!\w)", 0.2), (r"(?<![\w-])[A-Z]{1,3}-[A-Z]{1,2}\s\d{1,4}[EH]?(?!\w)", 0.2)], "kennzeichen,kfz-kennzeichen,kraftfahrzeugkennzeichen,nummernschild,fahrzeugkennzeichen,zulassung,kfz,fahrzeug,auto,pkw,lkw,fahrzeugschein,fahrzeugbrief,zulassungsbescheinigung,amtliches kennzeichen"),
    _rule("es", "es", "EsNif", "ES_NIF", [(r"\b[0-9]?[0-9]{7}[-]?[A-Z]\b", 0.5)], "documento nacional de identidad,DNI,NIF,identificación", _nif, enabled=True),
    _rule("es", "es", "EsNie", "ES_NIE", [(r"\b[X-Z]?[0-9]?[0-9]{7}[-]?[A-Z]\b", 0.5)], "número de identificación de extranjero,NIE", _nie, enabled=True),
    _rule("es", "es", "EsPassport", "ES_PASSPORT", [(r"\b[A-Z]{3}[0-9]{6}\b", 0.05)], "pasaporte,passport,número de pasaporte,passport number"),
    _rule("it", "it", "ItFiscalCode", "IT_FISCAL_CODE", [(r"((?:[A-Z][AEIOU][AEIOUX]|[AEIOU]X{2}|[B-DF-HJ-NP-TV-Z]{2}[A-Z]){2}(?:[\dLMNP-V]{2}(?:[A-EHLMPR-T](?:[04LQ][1-9MNP-V]|[15MR][\dLMNP-V]|[26NS][0-8LMNP-U])|[DHPS][37PT][0L]|[ACELMRT][37PT][01LM]|[AC-EHLMPR-T][26NS][9V])|(?:[02468LNQSU][048LQU]|[13579MPRTV][26NS])B[26NS][9V])(?:[A-MZ][1-9MNP-V][\dLMNP-V]{2}|[A-M][0L](?:[1-9MNP-V][\dLMNP-V]|[0L][1-9MNP-V]))[A-Z])", 0.3)], "codice fiscale,cf", _fiscal_code, enabled=True),
    _rule("it", "it", "ItVatCode", "IT_VAT_CODE", [(r"\b([0-9][ _]?){11}\b", 0.1)], "piva,partita iva,pi", _vat_it, enabled=True),
    _rule("it", "it", "ItPassport", "IT_PASSPORT", [(r"\b[A-Z]{2}\d{7}\b", 0.01)], "passaporto,elettronico,italiano,viaggio,viaggiare,estero,documento,dogana", enabled=True),
    _rule("it", "it", "ItIdentityCard", "IT_IDENTITY_CARD", [(r"\b[A-Z]{2}\s?\d{7}\b", 0.01), (r"\b\d{7}[A-Z]{2}\b", 0.01), (r"\b[A-Z]{2}\d{5}[A-Z]{2}\b", 0.01)], "carta,identità,elettronica,cie,documento,riconoscimento,espatrio", enabled=True),
    _rule("it", "it", "ItDriverLicense", "IT_DRIVER_LICENSE", [(r"\b(([A-Z]{2}\d{7}[A-Z])|(U1[BCDEFGHLJKMNPRSTUWYXZ0-9]{7}[A-Z]))\b", 0.2)], "patente,patente di guida,licenza,licenza di guida", enabled=True),
    _rule("pl", "pl", "PlPesel", "PL_PESEL", [(r"[0-9]{2}([02468][1-9]|[13579][012])(0[1-9]|1[0-9]|2[0-9]|3[01])[0-9]{5}", 0.4)], "PESEL", _check_digit([1, 3, 7, 9, 1, 3, 7, 9, 1, 3], 10), enabled=True),
    _rule("fi", "fi", "FiPersonalIdentityCode", "FI_PERSONAL_IDENTITY_CODE", [(r"\b(\d{6})([-+ABCDEFYXWVU])(\d{3})([0123456789ABCDEFHJKLMNPRSTUVWXY])\b", 0.5), (r"(\d{6})([-+ABCDEFYXWVU])(\d{3})([0123456789ABCDEFHJKLMNPRSTUVWXY])", 0.1)], "hetu,henkilötunnus,personbeteckningen,personal identity code", _hetu),
    _rule("kr", "ko", "KrBrn", "KR_BRN", [(r"(?<!\d)\d{3}-\d{2}-\d{5}(?!\d)", 0.1), (r"(?<!\d)\d{10}(?!\d)", 0.05)], "사업자등록번호,사업자번호,사업자,BRN,Business Registration Number,Korean BRN,business number,tax registration number", _brn),
    _rule("kr", "ko", "KrRrn", "KR_RRN", [(r"(?<!\d)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(-?)[1-4]\d{6}(?!\d)", 0.5)], "Korean RRN,Korean Resident Registration Number,Resident Registration Number,RRN,rrn,rrn#", _rrn(11)),
    _rule("kr", "ko", "KrFrn", "KR_FRN", [(r"(?<!\d)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(-?)[5-8]\d{6}(?!\d)", 0.5)], "외국인등록번호,Korean FRN,FRN,Foreigner Registration Number,Korean Foreigner Registration Number,외국인번호", _rrn(13)),
    _rule("kr", "ko", "KrPassport", "KR_PASSPORT", [(r"(?<![A-Z0-9a-z])[MmSsRrOoDd]\d{3}[A-Za-z]\d{4}(?![0-9])", 0.1), (r"(?<![A-Z0-9a-z])[MmSsRrOoDd]\d{8}(?![0-9])", 0.05)], "Korean passport,Korean passport number,대한민국 여권,여권,passport,passport number"),
    _rule("se", "sv", "SePersonnummer", "SE_PERSONNUMMER", [(r"\b(\d{6,8})([-+]?)\d{4}\b", 0.5), (r"(\d{6,8})([-+]?)\d{4}", 0.1)], "personnummer,svenskt personnummer,svensk id,ssn,personal identity number,samordningsnummer", _personnummer),
    _rule("se", "sv", "SeOrganisationsnummer", "SE_ORGANISATIONSNUMMER", [(r"\b\d{6}[-]?\d{4}\b", 0.6), (r"\d{6}[-]?\d{4}", 0.2)], "organisationsnummer,orgnr,org nr,företagsnummer", _orgnr),
    _rule("th", "th", "ThTnin", "TH_TNIN", [(r"\b[1-9](?:[134][0-9]|2[0-7]|5[0-8]|[67][01234567]|[89][0123456])\d{10}\b", 0.5)], "Thai National ID,Thai ID Number,TNIN,เลขประจำตัวประชาชน,เลขบัตรประชาชน,รหัสปชช", _thai),
    _rule("tr", "tr", "TrNationalId", "TR_NATIONAL_ID", [(r"\b[1-9][0-9]{10}\b", 0.3)], "tc kimlik,kimlik no,kimlik numarası,tckn,tc no,nüfus cüzdanı,national id,turkish id,türk kimlik", _tr_id),
    _rule("tr", "tr", "TrLicensePlate", "TR_LICENSE_PLATE", [(r"\b(0[1-9]|[1-7][0-9]|8[0-1])\s?[A-PR-VY-Z]{1,3}\s?\d{2,4}\b", 0.3), (r"\b(0[1-9]|[1-7][0-9]|8[0-1])-[A-PR-VY-Z]{1,3}-\d{2,4}\b", 0.3)], "plaka,araç plakası,plaka numarası,kayıt plakası,tr plaka,license plate,number plate,plate,taşıt plakası,kayıt", lambda t: F.substring(t, 1, 2).try_cast("int").between(1, 81)),
)

CATALOG = (*GENERIC, *US, *WORLD)
