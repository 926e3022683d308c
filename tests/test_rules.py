"""One true and one false number, or none, for every recognizer whose check or pattern has something of its own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilspark.functions import checksums as C
from veilspark.operators import scan as S
from veilspark.operators.rules import AS_OF, CATALOG

RULES = {r.name: r for r in CATALOG}
#: rule, text, the score of the longest span that begins at the text's start, None where there is none.
CASES = [
    ("UsClaimNumber", "7654321", None), ("InVehicleRegistration", "KA05MH4321", 1.0), ("InVehicleRegistration", "KA80MH4321", 0.5), ("InVehicleRegistration", "GJ5AB4321", 1.0), ("InVehicleRegistration", "KA5AB4321", 0.5),
    ("KrDriverLicense", "13-09-654321-22", 1.0), ("KrDriverLicense", "29-09-654321-22", None), ("SgUen", "199206031W", 1.0), ("SgUen", "199206031X", None), ("SgUen", "S16FC0121D", 1.0), ("SgUen", "S16ZZ0121D", None),
    ("ZaCompanyRegistration", "1998/004321/07", 1.0), ("ZaCompanyRegistration", "CK1987/654321", 1.0), ("ZaDriverLicense", "40320001QABC", 1.0), ("ZaDriverLicense", "403200011234", None), ("ZaLicensePlate", "BX 41 ZT GP", 1.0), ("ZaLicensePlate", "BX 41 ZT XX", None),
    ("ZaMobileNumber", "083 555 1234", 0.4), ("ZaMobileNumber", "+27 11 555 1234", None), ("ZaTelephoneNumber", "+27 11 555 1234", 0.4), ("ZaTelephoneNumber", "0860 555 123", None),
    ("Iban", "GB82WEST12345698765432", 1.0), ("Iban", "GB82 WEST 1234 5698 7654 32", 1.0), ("Iban", "GB83WEST12345698765432", None), ("Iban", "gb82west12345698765432", 0.5), ("Iban", "GB8212341234569876543", None),
    ("Phone", "0141 496 0123", 0.4), ("Phone", "0711/1234567", 0.4), ("Phone", "04 93 12 34 56", 0.4), ("Phone", "054-765-4321", 0.4), ("Phone", "91234 56780", 0.4), ("Phone", "(21) 98765-4321", 0.4), ("Phone", "415-555-0123", 0.4), ("Phone", "12 34", None),
    ("CreditCard", "3530111333300000", 1.0), ("CreditCard", "3530111333300001", None), ("Nhs", "943 476 5919", 1.0), ("Nhs", "943 476 5918", None), ("EsNif", "12345678Z", 1.0), ("EsNif", "12345678A", None), ("PlPesel", "44051401359", 1.0), ("PlPesel", "44051401358", None),
    ("AuAbn", "51 824 753 556", 1.0), ("AuTfn", "876 543 210", 1.0), ("UsNpi", "1234567893", 1.0), ("AbaRouting", "021000021", 1.0), ("AbaRouting", "021000022", None), ("DeTaxId", "86095742719", 1.0), ("DeTaxId", "86095742718", None),
    ("ItVatCode", "00743110157", 1.0), ("FiPersonalIdentityCode", "131052-308T", 1.0), ("FiPersonalIdentityCode", "131052-308U", None), ("SeOrganisationsnummer", "556703-7485", 1.0), ("ThTnin", "1101700230705", None), ("TrNationalId", "10000000146", 1.0),
    ("InAadhaar", "2341 2341 2346", 1.0), ("CaSin", "046 454 286", None), ("CaSin", "130 692 544", 0.5), ("UsSsn", "078-05-1120", None), ("MacAddress", "3c22.fb90.1ea7", 0.6), ("Ip", "2001:db8::8a2e:370:7334", 0.6), ("Ip", "256.1.1.1", None), ("Uuid", "3d6f0a8e-5b1c-4c77-9e21-0f4b7a6d2c15", 0.5),
]


def test_numbers_and_their_scores(spark):
    df = spark.createDataFrame([(i, n, t) for i, (n, t, _) in enumerate(CASES)], "i int, rule string, text string")
    got = {}
    for name in {n for n, _, _ in CASES}:
        some = df.filter(F.col("rule") == name).select("i", S.scan(F.concat(F.col("text"), F.lit(" .")), RULES[name]).alias("s"))
        for r in some.collect():
            own = [x for x in r.s if x.start == 0]
            got[r.i] = max((x.end, x.score) for x in own)[1] if own else None
    assert {(CASES[i], s) for i, s in got.items() if s != CASES[i][2]} == set()


LABELLED = [("UsClaimNumber", "claim no: 7654321", 0.35), ("UsPrescriptionNumber", "Rx # 7654321", 0.6), ("UsPrescriptionNumber", "prescription 7654321", 0.35), ("UsPriorAuthorizationNumber", "prior auth: PA-7654321", 0.35), ("UsReferralNumber", "referral number REF-7654321", 0.35), ("UsProviderTaxId", "billing provider tin: 12-7654321", 0.35), ("UsClaimNumber", "reclaim: 7654321", None)]


def test_labelled_numbers(spark):
    for name, text, score in LABELLED:
        spans = spark.createDataFrame([(text,)], "t string").select(S.scan(F.col("t"), RULES[name]).alias("s")).head().s
        assert [s.score for s in spans] == ([] if score is None else [score]), (name, text)


def test_rules_against_future_dates_go_by_a_day(spark):
    df = spark.createDataFrame([("2012/004321/07",)], "t string")
    for day, n in (("2011-12-31", 0), ("2012-01-01", 1)):
        token = AS_OF.set(day)
        try:
            assert len(df.select(S.scan(F.col("t"), RULES["ZaCompanyRegistration"]).alias("s")).head().s) == n
        finally:
            AS_OF.reset(token)


def test_every_rule_scans(spark):
    """Each pattern is one that the engine reads, and texts of no kind bring nothing but what their pattern says."""
    df = spark.createDataFrame([("",), (None,), ("plain words, nothing else",)], "t string")
    for rules in (CATALOG[i : i + 8] for i in range(0, len(CATALOG), 8)):
        out = df.select(*[F.size(S.scan(F.coalesce("t", F.lit("")), r)).alias(r.name) for r in rules]).collect()
        assert all(v == 0 for row in out for v in row), [c for row in out for c, v in row.asDict().items() if v]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 200])
def test_many_matches_are_placed_block_by_block(spark, n):
    text = "é x1 " * n
    found = spark.createDataFrame([(text,)], "t string").select(S.matches(F.col("t"), r"x\d").alias("m")).head().m
    assert [(m.start, m.end, m.text) for m in found] == [(5 * i + 2, 5 * i + 4, "x1") for i in range(n)]


def test_empty_matches_are_left_out(spark):
    found = spark.createDataFrame([("axxb",)], "t string").select(S.matches(F.col("t"), "x*").alias("m")).head().m
    assert [(m.start, m.end) for m in found] == [(1, 3)]


def test_check_digits(spark):
    df = spark.createDataFrame([("GB82WEST12345698765432", "2363", "794624", "4111111111111111")], "iban string, verhoeff string, iso string, luhn string")
    assert df.select(C.mod97(F.col("iban")), C.verhoeff(F.col("verhoeff")), C.iso7064_mod11_10(F.lit("86095742719")), C.luhn(F.col("luhn"))).head()[:] == (True, True, True, True)
