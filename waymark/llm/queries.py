"""The queries of the operators, with production parameters, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bpe, chat, codes, lexical, licenses, mih, mixture, packing, passages, pii, pq, simhash, toxicity
from waymark.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """Documents packed into sequences of 2048 tokens of the 50k byte-level vocabulary."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2048)


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.9)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.format_turns(turns))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, bits=64, distance=2)
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", mih.sign_code("embedding").alias("code"))
    return mih.top_k(rows, rows.where("vec_id % 100 = 0"), 10, "vec_id", "code")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return pii.scan(docs).select(
        "doc_id",
        *[F.expr(f"cast(size(filter(pii, s -> s.kind = '{k}')) as bigint) as n_{k}") for k in pii.BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
    )


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated(_table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "start", "stop", F.col("words").alias("n_words"), "alike", F.col("source").alias("source_doc_id"), "source_start", "source_stop")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.pack_mixture(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2048, end_id=1)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 50)


OP1_SQL = """
WITH RECURSIVE
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
named AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT n.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, n.component_id, n.component_id = n.vec_id AS kept
FROM named n LEFT JOIN counts c ON c.vec_id = n.vec_id
"""

#: The template in SQL: the same escape as in ``chat``, and the digests of the texts themselves.
OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length('<s>[INST] ' || regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') || ' [/INST]' || regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') || '</s>')) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP7_SQL = """
WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id,
             CAST(list_sum(list_transform(list_zip(q.bits, r.bits), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
      FROM b q JOIN b r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d)
SELECT query_id, neighbor_id, distance, rank FROM k WHERE rank <= 10
"""


def _assigned(books: str) -> str:
    """Every part with its nearest entry of a table of codebooks; all numbers are whole and far below 2**53, so doubles are exact."""
    return f"""SELECT p.vec_id, p.label, p.j, p.c, min(CAST(list_dot_product(p.c, p.c) - 2 * list_dot_product(p.c, b.c) + list_dot_product(b.c, b.c) AS BIGINT) * 256 + b.k) AS best
  FROM p JOIN {books} b ON b.j = p.j GROUP BY p.vec_id, p.label, p.j, p.c"""


def _codes_sql(rounds: int = 4) -> str:
    steps = ""
    for r in range(rounds):
        steps += f"""
a{r} AS MATERIALIZED ({_assigned(f"b{r}")}),
u{r} AS (SELECT j, k, list(m ORDER BY i) AS c FROM (
  SELECT j, best % 256 AS k, i, floor(sum(x) / count(*)) AS m FROM (SELECT j, best, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM a{r}) GROUP BY j, best % 256, i) GROUP BY j, k),
b{r + 1} AS MATERIALIZED (SELECT b.j, b.k, coalesce(u.c, b.c) AS c FROM b{r} b LEFT JOIN u{r} u ON u.j = b.j AND u.k = b.k),"""
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, j, e[j * len(e) // 4 + 1 : (j + 1) * len(e) // 4] AS c FROM v, range(4) t(j)),
b0 AS MATERIALIZED (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS k, c FROM p QUALIFY k < 256),{steps}
z AS MATERIALIZED ({_assigned(f"b{rounds}")}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best % 256), '' ORDER BY j) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM z GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY j, k, i)) AS digest FROM (SELECT j, k, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM coded, books
"""


_LEXICAL_TERMS = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
OP13_SQL = f"""
WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_LEXICAL_TERMS} FROM documents) GROUP BY doc_id, term),
l AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
t AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM l),
d AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, t GROUP BY term),
m AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM l, t),
q AS (SELECT DISTINCT item_id, {_LEXICAL_TERMS} FROM benchmark),
s AS (SELECT q.item_id, p.doc_id, CAST(sum(d.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * m.m))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN d USING (term) JOIN m USING (doc_id) GROUP BY q.item_id, p.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""


def queries() -> dict[str, Query]:
    import corpus_pipeline  # at the top of the repository; it imports this module

    named = (op1_embeddings, op2_packing, op3_chat, op4_toxicity, op5_bpe, op6_simhash, op7_top_k, op8_licenses, op9_pii, op10_passages, op11_codes, op12_mixture, op13_lexical)
    return {q.__name__: q for q in named} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_embeddings": OP1_SQL, "op3_chat": OP3_SQL, "op7_top_k": OP7_SQL, "op11_codes": _codes_sql(), "op13_lexical": OP13_SQL}
