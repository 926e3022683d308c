"""Registered queries over whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark import catalog_queries, span_queries
from veilspark.functions import checksums as C
from veilspark.operators import chunk, evaluate, scan
from veilspark.operators.anonymize import Operator, anonymize, deanonymize
from veilspark.operators.rules import CATALOG
from veilspark.plans.engine import Analyzer, explode_spans, rewrite
from veilspark.sources.spread import spread

RULES = {r.name: r for r in CATALOG}

#: Text made from columns, word for word the same in both engines.
DERIVED = """
SELECT c_custkey AS doc_id, 'SSN ' || substr(k, 1, 3) || '-' || substr(k, 4, 2) || '-' || substr(k, 6, 4) || ' seen ' || d || ' by ' || lower(substr(h, 1, 4)) || '.' || substr(h, 5, 3) || '@mail' || substr(h, 8, 2) || '.com from ' ||
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 13, 3) || '-' || substr(h, 16, 4) || '-' || substr(h, 20, 12) || ' at ' ||
  substr(h, 1, 2) || ':' || substr(h, 3, 2) || ':' || substr(h, 5, 2) || ':' || substr(h, 7, 2) || ':' || substr(h, 9, 2) || ':' || substr(h, 11, 2) || ' to account ' || k || '1.' AS text, k AS number
FROM (SELECT c_custkey, lpad(cast((c_custkey * 7919 + 31) % 1000000000 AS string), 9, '0') AS k, md5(c_name) AS h,
  '20' || lpad(cast(c_custkey % 40 AS string), 2, '0') || '-' || lpad(cast(c_custkey % 14 AS string), 2, '0') || '-' || lpad(cast(c_custkey % 33 AS string), 2, '0') AS d FROM customer) x
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DERIVED.replace("FROM customer", "FROM {customer}"), customer=spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")))


def _spans(df: DataFrame, name: str) -> DataFrame:
    found = df.select("doc_id", scan.scan(F.col("text"), RULES[name]).alias("spans"))
    return explode_spans(found).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_"), "score")


def _scan_sql(source: str, pattern: str, score: str, keep: str = "true") -> str:
    """Spans of one pattern by list arithmetic: gaps come from splitting by the pattern."""
    p = pattern.replace("'", "''")
    return f"""
WITH src AS ({source}), f AS (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g FROM src),
u AS (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS k FROM f),
s AS (SELECT doc_id, m[k] AS t, coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS start FROM u)
SELECT doc_id, cast(start AS bigint) AS start, cast(start + length(t) AS bigint) AS end_, cast({score} AS double) AS score FROM s WHERE {keep}
"""


_DOCS = "SELECT doc_id, text FROM documents"
_IP4 = r"\b(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(?:\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)){3}(?:/(?:[0-2]?\d|3[0-2]))?\b"


def scan_query(name: str, derived: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _spans((_derived if derived else _documents)(spark, sf_dir), name)


def checksum_query(check: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = F.lpad((F.col("o_orderkey") * 104729 + 7).cast("string"), 11, "3")
        return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.coalesce(check(n), F.lit(False)).alias("valid"))

    return query


_NUMBER = "SELECT o_orderkey, list_transform(string_split(lpad(cast(o_orderkey * 104729 + 7 AS varchar), 11, '3'), ''), lambda x: cast(x AS int)) AS d FROM orders"


def _weighted_sql(weights: list[int], test: str) -> str:
    total = " + ".join(f"d[{i + 1}] * {w}" for i, w in enumerate(weights))
    return f"SELECT o_orderkey, {test.format(s=f'({total})')} AS valid FROM ({_NUMBER})"


def anonymize_query(operator: Operator) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _documents(spark, sf_dir).withColumn("spans", scan.scan(F.col("text"), RULES["Ip"]))
        return docs.select("doc_id", anonymize(F.col("text"), scan.by_start(F.col("spans")), {"IP_ADDRESS": operator})["text"].alias("text"))

    return query


def encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = "0123456789abcdef"
    docs = _documents(spark, sf_dir).withColumn("spans", scan.scan(F.col("text"), RULES["Ip"]))
    sealed = docs.select("doc_id", anonymize(F.col("text"), scan.by_start(F.col("spans")), {"IP_ADDRESS": Operator("encrypt", {"key": key})}).alias("r"))
    return sealed.select("doc_id", deanonymize(F.col("r.text"), F.col("r.items"), {"IP_ADDRESS": Operator("decrypt", {"key": key})})["text"].alias("text"))


def entity_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses found in each language's documents."""
    found = scan.exploded(_documents(spark, sf_dir), scan.scan(F.col("text"), RULES["Ip"]), "lang")
    return found.groupBy("lang", F.col("s.entity_type").alias("entity_type")).agg(F.count("*").alias("n"))


def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the regex-only profile over whole documents, with e-mail, card, IP and phone rewritten."""
    docs = _documents(spark, sf_dir)
    names = ["EMAIL_ADDRESS", "CREDIT_CARD", "IP_ADDRESS", "PHONE_NUMBER"]
    spans = Analyzer.regex_only().analyze(docs, entities=names)
    return spans.select("doc_id", F.size("spans").cast("long").alias("n_spans"), rewrite(F.col("text"), F.col("spans"), {"CREDIT_CARD": Operator("mask")}, "regex_only")["text"].alias("text"))


def chunk_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces of 250 code points, stretched to white space."""
    found = chunk.explode_chunks(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.col("chunk_start").cast("long").alias("start"), F.col("chunk_end").cast("long").alias("end_"), F.md5("chunk_text").alias("chunk_md5"))


def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces of 64 tokens that share 16 with the piece before."""
    found = chunk.explode_chunks(_documents(spark, sf_dir).select("doc_id", "text"), kind="token", size=64, overlap=16)
    return found.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size(F.regexp_extract_all("chunk_text", F.lit(r"\S+"), F.lit(0))).cast("long").alias("n_tokens"), F.md5(F.regexp_replace("chunk_text", r"\s+", " ")).alias("chunk_md5"))


def chunked_scan_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses found piece by piece: the same as in whole documents, as pieces end at white space and overlap."""
    found = chunk.predict(chunk.by_characters(F.col("text")), lambda t: scan.scan(t, RULES["Ip"]))
    spans = explode_spans(_documents(spark, sf_dir).select("doc_id", found.alias("spans")))
    return spans.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_"), "score")


def _truth_and_found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Planted numbers as truth, and what the social security rule finds."""
    df = _derived(spark, sf_dir)
    truth = df.select("doc_id", F.lit("US_SSN").alias("label"), F.lit(4).alias("start"), F.lit(15).alias("end"))
    found = scan.exploded(df, scan.scan(F.col("text"), RULES["UsSsn"]), "doc_id").select("doc_id", F.col("s.entity_type").alias("label"), "s.start", "s.end")
    return truth, found


def recall_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall_by_label(evaluate.hits(*_truth_and_found(spark, sf_dir))[0])


def precision_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.precision_by_label(evaluate.hits(*_truth_and_found(spark, sf_dir))[1])


_BAD_SSN = "(substr(k, 4, 2) = '00' OR substr(k, 6, 4) = '0000' OR substr(k, 1, 3) IN ('000', '666') OR k IN ('123456789', '987654320', '078051120'))"
_SSN_SQL = f"SELECT doc_id, k, NOT {_BAD_SSN} AS ok FROM (SELECT doc_id, number AS k FROM ({DERIVED}))"
_HIDE = f"regexp_replace(text, '{_IP4}', %s, 'g')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_ip": scan_query("Ip", False),
    "scan_card": scan_query("CreditCard", False),
    "scan_email": scan_query("Email", True),
    "scan_uuid": scan_query("Uuid", True),
    "scan_mac": scan_query("MacAddress", True),
    "scan_date": scan_query("Date", True),
    "scan_bank": scan_query("UsBank", True),
    "scan_ssn": scan_query("UsSsn", True),
    "checksum_luhn": checksum_query(C.luhn),
    "checksum_pesel": checksum_query(RULES["PlPesel"].check),
    "checksum_tr_id": checksum_query(RULES["TrNationalId"].check),
    "checksum_abn": checksum_query(RULES["AuAbn"].check),
    "checksum_verhoeff": checksum_query(C.verhoeff),
    "checksum_iso7064": checksum_query(C.iso7064_mod11_10),
    "anonymize_replace": anonymize_query(Operator("replace")),
    "anonymize_redact": anonymize_query(Operator("redact")),
    "anonymize_custom_value": anonymize_query(Operator("replace", {"new_value": "[address]"})),
    "anonymize_keep": anonymize_query(Operator("keep")),
    "encrypt_roundtrip": encrypt_roundtrip,
    "entity_counts_by_lang": entity_counts_by_lang,
    "mask_documents": mask_documents,
    "chunk_characters": chunk_characters,
    "chunk_tokens": chunk_tokens,
    "chunked_scan_ip": chunked_scan_ip,
    "recall_by_label": recall_by_label,
    "precision_by_label": precision_by_label,
}

_EDGE = "coalesce(nullif(instr(substr(b, cast({at} AS bigint) + 1), ' '), 0) + {at} - 1, n)"
_CHUNK_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, replace(text, chr(10), ' ') AS b, length(text) AS n FROM documents WHERE text <> ''),
c AS (
    SELECT doc_id, 0::BIGINT AS start, (CASE WHEN n <= 250 THEN n ELSE {_EDGE.format(at='250')} END)::BIGINT AS end_ FROM d
    UNION ALL
    SELECT doc_id, s, (CASE WHEN s + 250 >= n THEN n ELSE {_EDGE.format(at='(s + 250)')} END)::BIGINT
    FROM (SELECT doc_id, b, n, least({_EDGE.format(at='(end_ - 50)')}, end_)::BIGINT AS s FROM c JOIN d USING (doc_id) WHERE end_ < n)
)
SELECT doc_id, start, end_, md5(substr(text, start + 1, end_ - start)) AS chunk_md5 FROM c JOIN documents USING (doc_id)
"""

ORACLES = {
    "chunk_characters": _CHUNK_SQL,
    "chunk_tokens": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS t FROM documents),
w AS (SELECT doc_id, t, unnest(range(0, greatest(len(t) - 16, 1), 48)) AS i FROM d WHERE len(t) > 0)
SELECT doc_id, i // 48 AS chunk, len(t[i + 1:i + 64]) AS n_tokens, md5(array_to_string(t[i + 1:i + 64], ' ')) AS chunk_md5 FROM w
""",
    "scan_ip": _scan_sql(_DOCS, _IP4, "0.6", r"NOT regexp_matches(t, '(^|\.)0[0-9]')"),
    "chunked_scan_ip": _scan_sql(_DOCS, _IP4, "0.6", r"NOT regexp_matches(t, '(^|\.)0[0-9]')"),
    "scan_uuid": _scan_sql(DERIVED, RULES["Uuid"].patterns[0][0], "0.5", "substr(t, 20, 1) IN ('8', '9', 'a', 'b')"),
    "scan_email": _scan_sql(DERIVED, r"[a-z0-9]+\.[a-z0-9]+@[a-z0-9]+\.com\b", "1.0"),
    "scan_bank": _scan_sql(DERIVED, RULES["UsBank"].patterns[0][0], "0.05"),
    "scan_mac": _scan_sql(DERIVED, r"\b[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}\b", "0.6"),
    "checksum_pesel": _weighted_sql([1, 3, 7, 9, 1, 3, 7, 9, 1, 3], "(10 - {s} % 10) % 10 = d[11]"),
    "checksum_abn": _weighted_sql([10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19], "({s} - 10) % 89 = 0"),
    "checksum_luhn": "SELECT o_orderkey, (list_sum(list_transform(range(1, 12), lambda i: CASE WHEN i % 2 = 1 THEN d[i] WHEN d[i] > 4 THEN d[i] * 2 - 9 ELSE d[i] * 2 END))) % 10 = 0 AS valid FROM (" + _NUMBER + ")",
    "checksum_tr_id": f"SELECT o_orderkey, d[1] <> 0 AND (((d[1]+d[3]+d[5]+d[7]+d[9]) * 7 - (d[2]+d[4]+d[6]+d[8])) % 10 + 10) % 10 = d[10] AND list_sum(d[1:10]) % 10 = d[11] AS valid FROM ({_NUMBER})",
    "anonymize_replace": f"SELECT doc_id, {_HIDE.replace('%s', repr('<IP_ADDRESS>'))} AS text FROM documents",
    "anonymize_redact": f"SELECT doc_id, {_HIDE.replace('%s', repr(''))} AS text FROM documents",
    "anonymize_custom_value": f"SELECT doc_id, {_HIDE.replace('%s', repr('[address]'))} AS text FROM documents",
    "anonymize_keep": "SELECT doc_id, text FROM documents",
    "encrypt_roundtrip": "SELECT doc_id, text FROM documents",
    "entity_counts_by_lang": f"SELECT lang, 'IP_ADDRESS' AS entity_type, cast(sum(len(regexp_extract_all(text, '{_IP4}'))) AS bigint) AS n FROM documents GROUP BY lang HAVING n > 0",
    "recall_by_label": f"SELECT 'US_SSN' AS label, count(*) FILTER (ok) AS found, count(*) FILTER (NOT ok) AS missed, count(*) AS total, round(count(*) FILTER (ok) / count(*), 3) AS recall FROM ({_SSN_SQL})",
}

QUERIES |= span_queries.QUERIES | catalog_queries.QUERIES
ORACLES |= span_queries.ORACLES | catalog_queries.ORACLES

_VERHOEFF = [[(j + k) % 5 if j < 5 and k < 5 else 5 + (j + k) % 5 if j < 5 else 5 + (j - k) % 5 if k < 5 else (j - k) % 5 for k in range(10)] for j in range(10)]
_TURN = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]


def _verhoeff_sql() -> str:
    """One digit a step, from the last; each turned as often as its place says."""
    turns = [list(range(10))]
    for _ in range(7):
        turns.append([_TURN[x] for x in turns[-1]])
    sql = f"SELECT o_orderkey, d, 0 AS c FROM ({_NUMBER})"
    for i in range(11):
        sql = f"SELECT o_orderkey, d, {[x for row in _VERHOEFF for x in row]}[c * 10 + {turns[i % 8]}[d[{11 - i}] + 1] + 1] AS c FROM ({sql})"
    return f"SELECT o_orderkey, c = 0 AS valid FROM ({sql})"


def _product_sql() -> str:
    sql = f"SELECT o_orderkey, d, 10 AS p FROM ({_NUMBER})"
    for i in range(10):
        sql = f"SELECT o_orderkey, d, (CASE WHEN (p + d[{i + 1}]) % 10 = 0 THEN 10 ELSE (p + d[{i + 1}]) % 10 END) * 2 % 11 AS p FROM ({sql})"
    return f"SELECT o_orderkey, (11 - p) % 10 = d[11] AS valid FROM ({sql})"


ORACLES |= {
    "scan_card": _scan_sql(_DOCS, span_queries._CARD, "1.0", f"NOT regexp_matches(t, '^1[0-9]{{12}}$') AND (SELECT {span_queries._LUHN} FROM (SELECT regexp_replace(t, '[- ]', '', 'g') AS c))"),
    "scan_date": _scan_sql(DERIVED, r"\b\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\b", "0.6"),
    "scan_ssn": f"SELECT doc_id, 4::BIGINT AS start, 15::BIGINT AS end_, 0.5::DOUBLE AS score FROM ({_SSN_SQL}) WHERE ok",
    "checksum_verhoeff": _verhoeff_sql(),
    "checksum_iso7064": _product_sql(),
    "mask_documents": span_queries.MASKED_SQL,
    "precision_by_label": f"SELECT 'US_SSN' AS label, count(*) AS hit, 0::BIGINT AS spurious, count(*) AS total, 1.0::DOUBLE AS \"precision\" FROM ({_SSN_SQL}) WHERE ok",
}
