"""Registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimforge.llm import conversations, divergence, katz, page_text, personal_data, quality, toxicity
from claimforge.llm.common import fold_bucket, read_table
from claimforge.llm.embedding_dups import near_vectors
from claimforge.llm.exact_dedup import copy_groups
from claimforge.llm.mixing import mix_report
from claimforge.llm.near_dups import near_groups
from claimforge.llm.pieces import digests, encode_decode
from claimforge.llm.token_counts import count_tokens


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return page_text.extract(read_table(spark, sf_dir, "pages"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of every embedding within its label: links, group, whether it stays."""
    return near_vectors(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: number of ids, digests of ids and of the decoded text."""
    return digests(encode_decode(read_table(spark, sf_dir, "documents")))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of every document: size of its shingle set, its group, whether it stays."""
    return near_groups(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; rows whose fold is 2 of 4 are held out of training."""
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_bucket("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; rows whose fold is 0 of 5 are held out of training."""
    docs = read_table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: target of each source, words taken of each document."""
    return mix_report(read_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of every document: which row stays, group size, digest."""
    return copy_groups(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document under the word vocabulary."""
    return count_tokens(read_table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans counted and digested, all spans listed."""
    return personal_data.report(personal_data.find(read_table(spark, sf_dir, "documents")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells each source of a language from the others and from the language: pairs of sources, terms."""
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a backoff model of the training documents, and under word counts."""
    return katz.score(read_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged and repaired: faults, cheapest edits, digest of the repaired rows."""
    return conversations.repair(conversations.damage(read_table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_page_text, op2_embedding_near_dedup, op3_sentencepiece, op4_minhash_near_dedup, op5_toxicity, op6_quality, op7_mix_sources, op8_exact_dedup, op9_token_counts, op10_personal_data, op11_source_divergence, op12_lm_scores, op13_conversation_repair, pipeline)}

ORACLE = {
    "op2_embedding_near_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), n AS (
          SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE len(e) > 0
        ), links AS (
          SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
          WHERE x.norm > 0 AND y.norm > 0 AND list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.93
        ), reach(a, b) AS (
          SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), c AS (SELECT a, min(b) AS low FROM reach GROUP BY a), k AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id,
               vec_id = least(vec_id, coalesce(c.low, vec_id)) AS kept
        FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id
    """,
    "op4_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x20\x09-\x0D]+') AS words FROM documents
        ), s AS (
          SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS sh FROM w
        ), u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s), links AS (
          SELECT p.doc_id AS a, q.doc_id AS b FROM u p JOIN u q ON p.x = q.x AND p.doc_id <> q.doc_id
          GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
        ), reach(a, b) AS (
          SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
        SELECT doc_id, len(sh) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
               doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
        FROM s LEFT JOIN c ON c.a = doc_id
    """,
    "op8_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        ), g AS (
          SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op11_source_divergence": r"""
        WITH d AS (
          SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), g AS (SELECT DISTINCT lang, source FROM d), t AS (
          SELECT k, lang, source, unnest(terms) AS term FROM d
        ), kept AS (
          SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 30
        ), own AS (
          SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
        ), l AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
        ), s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM own GROUP BY lang, source
        ), dense AS (
          SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS n,
                 1 + (1000000000::HUGEINT * (coalesce(own.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * l.v) AS p,
                 1 + (1000000000::HUGEINT * (kept.n + 5)) // (l.total + 5 * l.v) AS q
          FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN own USING (lang, source, term)
        ), pairs AS (
          SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (
            SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM dense x
            JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
          ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        ), ranked AS (
          SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
                 row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
          UNION ALL
          SELECT lang, source, 'term', term, (p - q)::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term)
          FROM dense WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
}
