"""One registered query for each operator, over its whole table, and the DuckDB statements."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (dac, debruijn, dialogue, fertility, html_blocks, langid, mixing, periodic,
                          piece_codec, repeats, simhash, topk, url_rules)
from tickloom.llm.common import shared_dir, table, written

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed rules of the contract: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
FOLDS, QUERY_STEP, BEST = 5, 20, 20


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(mixing.measured(docs).select("doc_id", "source", "mix_size", "mix_key"),
                    "mix-documents")
    out = mixing.mixed(sized, mixing.balance(sized))
    return out.select("doc_id", F.col("mix_size").alias("size"),
                      F.col("mix_source_size").alias("source_size"),
                      F.col("mix_target").alias("target"),
                      (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
                      F.col("mix_copies").alias("copies"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.match(pages, RULES).drop("url")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"),
                        "component_id")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % QUERY_STEP == 0, BEST)


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    dac.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_BPE))
    return dac.document_tokens(dac.read_tokens(spark, path), digests_only=True)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold() != 0)
    held = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    return langid.predict(held, model, keep_text=False)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"),
                           [public_tokenizers.path(n) for n in (PIECE_BPE, BYTE_BPE)])


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(table(spark, sf_dir, "documents"),
                                        public_tokenizers.path(PIECE_BPE), with_ids=False)


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return debruijn.remove_passages(docs)


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Of a tenth of the documents, by a hash of the id, the words from some word on become copies
    of the first of them. A null id leaves the words as they are."""
    hashed = 1 if doc_id is None else zlib.crc32(b"%d" % doc_id)
    g, n = hashed // 10, len(words)
    if hashed % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    return words[:a] + (period * ((n - a) // p + 1))[:n - a]


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.periodic_runs(docs, repeated_tail)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults of the contract, drawn by a hash of conversation and turn; copies: how
    often the row stands in its place."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" "))
                             for c in ("conv_id", "turn")))
    draw = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", "turn",
        F.when(draw == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate(text, ".!?", "")).otherwise(text)
        .alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("copies"))


def op13_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_mix, op2_repeats, op3_url_rules, op4_simhash, op5_top_k, op6_token_file, op7_language,
        op8_main_text, op9_quality, op10_pieces, op11_passages, op12_runs, op13_dialogue)}


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return {
        "op3_url_rules": f"""
            WITH rules(verdict, h, p) AS (VALUES {rules}),
            parts AS (SELECT page_id, url, CASE WHEN contains(url, '://')
                THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
            split AS (SELECT page_id, url,
                translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''),
                    '{url_rules.UPPER}', '{url_rules.LOWER}') AS host,
                coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts)
            SELECT page_id, host, path,
                (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h))
                 AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1) AS rule,
                coalesce((SELECT verdict FROM rules WHERE (host = h OR ends_with(host, '.' || h))
                 AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1), 'allow') AS verdict
            FROM split""",
        "op5_top_k": f"""
            WITH v AS (SELECT vec_id, list_transform(embedding,
                    lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding,
                    lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(
                    list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id % {QUERY_STEP} = 0 AND c.vec_id <> q.vec_id),
            ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id
                ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
            SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {BEST}""",
    }
