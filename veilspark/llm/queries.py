"""The corpus operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import bpe, chat, embed, exact_dedup, lm, minhash, mixing, pii, quality, secrets


def tokenizer_path() -> str:
    """Where the public vocabulary lies, on the driver and on every executor alike."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_documents(spark, sf_dir), tokenizer_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def _digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans, of ``(doc_id, spans)``."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(told(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pii.find(_documents(spark, sf_dir)), pii.BASE)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(secrets.find(_documents(spark, sf_dir)), secrets.BASE)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir), digest_all=True)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assign(_documents(spark, sf_dir)).select(
        "doc_id", "source", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), F.col("mix_shards").alias("shards")
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_bpe, op3_pii, op4_secrets, op5_embedding_near_dedup, op6_exact_dedup, op7_chat, op8_mixing, op9_lm_score, op10_quality)}

ORACLES = {
    "op7_chat": """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
c AS (
    SELECT conv_id, count(*) AS n_turns, list('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) ORDER BY turn NULLS FIRST, md5(md5(role) || md5(text))) AS parts
    FROM t GROUP BY conv_id
),
u AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS copies, parts FROM c GROUP BY n_turns, parts)
SELECT conv_id, n_turns, copies, array_to_string(parts, '') AS rendered FROM u
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n_turns > u.n_turns AND c.parts[1] = u.parts[1] AND c.parts[1:u.n_turns] = u.parts)
""",
    "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""",
}

_LETTERS = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Smallest id that links reach, from ``links(a, b)`` in both directions.
_REACHED = "reached(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.other)"

ORACLES |= {
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LETTERS}, '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS h, md5(array_to_string(w[i:i + 4], ' ')) AS m FROM i),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.m = b.m AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
{_REACHED},
k AS (SELECT id, min(other) AS other FROM reached GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id, doc_id <= coalesce(other, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.id = documents.doc_id
""",
    "op5_embedding_near_dedup": f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda c: c IS NULL OR NOT isfinite(c)), true) AND list_max(list_transform(embedding, lambda c: abs(c))) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
{_REACHED},
k AS (SELECT id, min(other) AS other FROM reached GROUP BY id), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id, vec_id <= coalesce(other, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN k ON k.id = vec_id
""",
}
