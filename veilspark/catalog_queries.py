"""One query that scans made-up numbers with many recognizers, each against what SQL says about the number.

A number stands between two plain words, so its span is known; SQL works the score out from the number's digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import scan
from veilspark.operators.rules import CATALOG
from veilspark.sources.spread import spread

RULES = {r.name: r for r in CATALOG}
_N = "SELECT c_custkey AS doc_id, c_custkey AS c, lpad(cast((c_custkey * 7919 + 31) % 1000000000 AS string), 9, '0') AS n FROM customer"


def _d(i: int) -> str:
    return f"cast(substr(n, {i}, 1) AS int)"


def _sum(*weights: int) -> str:
    return "(" + " + ".join(f"{w} * {_d(i)}" for i, w in enumerate(weights, 1)) + ")"


def _luhn(value: str, size: int) -> str:
    """Whether the ``size`` digits of ``value`` pass the check."""
    place = lambda i: f"cast(substr({value}, {size - i}, 1) AS int)"
    twice = lambda x: f"CASE WHEN {x} > 4 THEN 2 * {x} - 9 ELSE 2 * {x} END"
    return "((" + " + ".join(place(i) if i % 2 == 0 else f"({twice(place(i))})" for i in range(size)) + ") % 10 = 0)"


_if = lambda test, score="1.0": f"CASE WHEN {test} THEN {score} END"
_spoilt = "c % 3 = 0"
#: rule, the number as SQL of both engines, the score of its span as SQL (null: no span)
NUMBERS: tuple[tuple[str, str, str], ...] = (
    ("UsPassport", "'A' || substr(n, 1, 8)", "0.1"),
    ("UsBank", "n", "0.05"),
    ("AbaRouting", "n", _if(f"substr(n, 1, 1) IN ('0', '1', '2', '3', '6', '7', '8') AND {_sum(3, 7, 1, 3, 7, 1, 3, 7, 1)} % 10 = 0")),
    ("UsNpi", "'1' || n", _if(_luhn("('808401' || n)", 15))),
    ("UsClaimNumber", "'CLM-' || n", "0.1"),
    ("UsReferralNumber", "'INF-' || n", "0.1"),
    ("UsPriorAuthorizationNumber", "'PA-' || n", "0.1"),
    ("UsPrescriptionNumber", "'RX-' || n", "0.1"),
    ("UsProviderTaxId", "'12-' || substr(n, 1, 7)", "0.1"),
    ("UsHealthInsuranceMemberId", "'AB' || n", "0.1"),
    ("UsMbi", "'1AC2DE3FG' || substr(n, 1, 2)", "0.3"),
    ("MedicalLicense", "'AB' || substr(n, 1, 7)", _if(f"{_sum(1, 2, 1, 2, 1, 2)} % 10 = {_d(7)}")),
    ("UkPassport", "'AB' || substr(n, 1, 7)", "0.1"),
    ("UkNino", "'AB' || substr(n, 1, 6) || 'C'", "0.5"),
    ("Nhs", "substr(n, 1, 3) || ' ' || substr(n, 4, 3) || ' ' || substr(n, 7, 3) || substr(n, 1, 1)", _if(f"({_sum(10, 9, 8, 7, 6, 5, 4, 3, 2)} + {_d(1)}) % 11 = 0")),
    ("AuTfn", "substr(n, 1, 3) || ' ' || substr(n, 4, 3) || ' ' || substr(n, 7, 3)", _if(f"{_sum(1, 4, 3, 7, 5, 8, 6, 9, 10)} % 11 = 0")),
    ("AuAcn", "substr(n, 1, 3) || ' ' || substr(n, 4, 3) || ' ' || substr(n, 7, 3)", _if(f"(10 - {_sum(8, 7, 6, 5, 4, 3, 2, 1)} % 10) % 10 = {_d(9)}")),
    ("CaPostalCode", "'K' || substr(n, 1, 1) || 'A ' || substr(n, 2, 1) || 'B' || substr(n, 3, 1)", "0.3"),
    ("CaSin", "'1' || substr(n, 1, 2) || '-' || substr(n, 3, 3) || '-' || substr(n, 6, 3)", _if(_luhn("('1' || substr(n, 1, 8))", 9), "0.5")),
    ("InPassport", "'K' || cast(1 + c % 9 AS string) || substr(n, 1, 5) || cast(1 + c % 7 AS string)", "0.1"),
    ("InVoter", "'ABC' || substr(n, 1, 7)", "0.4"),
    ("InPan", "'ABCPK' || substr(n, 1, 4) || 'Z'", "0.5"),
    ("InVehicleRegistration", "'KA' || lpad(cast(1 + c % 98 AS string), 2, '0') || 'AB' || cast(1000 + c % 9000 AS string)", "CASE WHEN 1 + c % 98 BETWEEN 1 AND 20 OR 1 + c % 98 BETWEEN 22 AND 71 THEN 1.0 ELSE 0.5 END"),
    ("NgVehicleRegistration", "'ABC-' || substr(n, 1, 3) || 'XY'", "0.5"),
    ("PhPassport", "'P' || substr(n, 1, 7) || 'A'", "0.1"),
    ("PhUmid", "substr(n, 1, 4) || '-' || substr(n, 3, 7) || '-' || substr(n, 9, 1)", "0.5"),
    ("SgFin", "'S' || substr(n, 1, 7) || 'A'", "0.5"),
    ("SgUen", f"substr(n, 1, 8) || CASE WHEN {_spoilt} THEN 'Z' ELSE substr('XMKECAWLJDB', cast({_sum(10, 4, 9, 3, 8, 2, 7, 1)} % 11 AS int) + 1, 1) END", _if(f"NOT ({_spoilt})")),
    ("ZaPassport", "'A' || substr(n, 1, 8)", "1.0"),
    ("ZaVatNumber", "'4' || n", "1.0"),
    ("ZaCompanyRegistration", "cast(CASE WHEN c % 2 = 0 THEN 1950 + c % 60 ELSE 2090 + c % 10 END AS string) || '/' || substr(n, 1, 6) || '/07'", _if("c % 2 = 0")),
    ("ZaLicensePlate", "'CA ' || substr(n, 1, 3) || ' WP'", "1.0"),
    ("ZaMobileNumber", "'082 ' || substr(n, 1, 3) || ' ' || substr(n, 4, 4)", "0.4"),
    ("ZaTelephoneNumber", "'011 ' || substr(n, 1, 3) || ' ' || substr(n, 4, 4)", "0.4"),
    ("DePlz", "'1' || substr(n, 1, 4)", "0.05"),
    ("DeHandelsregister", "'HRB ' || substr(n, 1, 6)", "0.5"),
    ("DeFuehrerschein", "'AB' || substr(n, 1, 8) || 'C'", "0.35"),
    ("DeTaxNumber", "'123/456/' || substr(n, 1, 5)", "0.4"),
    ("EsNif", f"substr(n, 1, 8) || CASE WHEN {_spoilt} THEN 'U' ELSE substr('TRWAGMYFPDXBNJZSQVHLCKE', cast(cast(substr(n, 1, 8) AS int) % 23 AS int) + 1, 1) END", _if(f"NOT ({_spoilt})")),
    ("EsPassport", "'ABC' || substr(n, 1, 6)", "0.05"),
    ("ItPassport", "'AB' || substr(n, 1, 7)", "0.01"),
    ("ItIdentityCard", "'AB' || substr(n, 1, 7)", "0.01"),
    ("ItDriverLicense", "'AB' || substr(n, 1, 7) || 'C'", "0.2"),
    ("KrPassport", "'M' || substr(n, 1, 8)", "0.05"),
    ("KrDriverLicense", "cast(10 + c % 20 AS string) || '-' || substr(n, 1, 2) || '-' || substr(n, 2, 6) || '-' || substr(n, 8, 2)", _if("10 + c % 20 BETWEEN 11 AND 26 OR c % 20 = 18")),
    ("TrLicensePlate", "'34 ABC ' || substr(n, 1, 3)", "1.0"),
    ("Iban", f"'DE' || lpad(cast(CASE WHEN {_spoilt} THEN 1 ELSE 98 - cast(cast(n || n || '131400' AS decimal(38, 0)) % 97 AS int) END AS string), 2, '0') || n || n", _if(f"NOT ({_spoilt})")),
    ("Phone", "'030/' || substr(n, 1, 7)", "0.4"),
    ("Crypto", "'1' || repeat('x', 30)", "null"),
)


def scan_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of NUMBERS' rules, each in a text of its own."""
    columns = ", ".join(f"'ref ' || {value} || ' end' AS t{k}" for k, (_, value, _) in enumerate(NUMBERS))
    made = spark.sql(f"SELECT doc_id, {columns} FROM ({_N.replace('FROM customer', 'FROM {customer}')}) x", customer=spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")))

    def of(k: int, name: str) -> Column:
        told = lambda s: F.struct(F.lit(name).alias("rule"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end_"), s["score"].alias("score"))
        return F.transform(scan.scan(F.col(f"t{k}"), RULES[name]), told)

    with scan.quiet():
        found = F.concat(*[of(k, name) for k, (name, _, _) in enumerate(NUMBERS)])
        return scan.exploded(made, found, "doc_id").select("doc_id", "s.*")


QUERIES = {"scan_catalog": scan_catalog}
ORACLES = {"scan_catalog": " UNION ALL ".join(f"SELECT doc_id, '{name}' AS rule, 4::BIGINT AS start, cast(4 + length(v) AS bigint) AS end_, s::DOUBLE AS score FROM (SELECT doc_id, {value} AS v, {score} AS s FROM ({_N})) WHERE s IS NOT NULL" for name, value, score in NUMBERS)}
