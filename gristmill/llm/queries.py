"""Thin queries over the given tables, one per operator, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.bpe_chunks import encode_documents
from gristmill.llm.common import table
from gristmill.llm.kd_search import nearest_rows
from gristmill.llm.lattice import embedding_links
from gristmill.llm.line_dedup import line_dedup
from gristmill.llm.media_columns import media_columns
from gristmill.llm.merkle import merkle_proofs, without_line_breaks
from gristmill.llm.mixing import mix_sources
from gristmill.llm.quality import quality_scores
from gristmill.llm.secret_scan import secret_scan
from gristmill.llm.simhash import simhash_components
from gristmill.llm.token_counts import LongestMatch, byte_vocabulary, token_counts
from gristmill.llm.toxicity import toxicity_scores
from gristmill.llm.whitening import whiten


def tokenizer_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """Where a public tokenizer file lies; the folder is a parameter and the same on every machine."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents")).withColumn("shard", F.element_at(F.split("shard", "/"), -1))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    automaton = LongestMatch(byte_vocabulary(tokenizer_path()))
    return token_counts(table(spark, sf_dir, "documents"), automaton)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "text_score", "meta_score", "quality_score", "keep")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "epoch", "order_key", "n_tokens")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_markov")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op11_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rows(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle_proofs(docs, tampered=without_line_breaks(docs)).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_media_columns, op2_token_counts, op3_simhash, op4_quality, op5_toxicity, op6_bpe, op7_mixing, op8_secret_scan, op9_line_dedup, op10_lattice, op11_kd_search, op12_whitening, op13_merkle)
}

ORACLE_SQL: dict[str, str] = {
    "op9_line_dedup": """
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), windows AS (
  SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS win
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM lines WHERE len(ls) >= 3)
), shown AS (
  SELECT * FROM windows WHERE trim(translate(win, chr(9) || chr(13) || chr(10), '   ')) <> ''
), firsts AS (
  SELECT win, min(doc_id * 10000000 + pos) AS f, count(*) AS n FROM shown GROUP BY win HAVING count(*) > 1
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS i
  FROM shown JOIN firsts USING (win), (SELECT unnest([0, 1, 2]) AS k) WHERE doc_id * 10000000 + pos <> f
), each AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM lines
), kept AS (
  SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.i) AS text, count(*) AS n
  FROM each e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.i = c.i WHERE c.i IS NULL GROUP BY e.doc_id
)
SELECT l.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(k.n, 0) AS BIGINT) AS n_removed, coalesce(k.text, '') AS text
FROM lines l LEFT JOIN kept k USING (doc_id)
""",
    "op7_mixing": """
WITH RECURSIVE slim AS (
  SELECT doc_id, source, CAST(greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS n_tokens FROM documents
), src AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM slim GROUP BY source
), p AS (
  SELECT source, tokens, ln(tokens / (SELECT CAST(sum(tokens) AS DOUBLE) FROM src)) AS lp FROM src
), goal AS (
  SELECT h + 0.5 * (ln(n) - h) AS target FROM (SELECT sum(-exp(lp) * lp) AS h, count(*) AS n FROM p)
), bits AS (
  SELECT 32 AS b, CAST(0 AS BIGINT) AS low, CAST(0 AS BIGINT) AS rep
  UNION ALL
  SELECT b - 1,
    low + CASE WHEN (SELECT ln(sum(exp(a * lp))) - sum(exp(a * lp) * a * lp) / sum(exp(a * lp))
                     FROM (SELECT lp, (low + (1::BIGINT << (b - 1))) / 4294967296.0::DOUBLE AS a FROM p)) >= (SELECT target FROM goal)
               THEN (1::BIGINT << (b - 1)) ELSE 0 END,
    rep + CASE WHEN (SELECT max(exp((a - 1) * lp)) / sum(exp(a * lp))
                     FROM (SELECT lp, (rep + (1::BIGINT << (b - 1))) / 4294967296.0::DOUBLE AS a FROM p)) > 4.0
               THEN (1::BIGINT << (b - 1)) ELSE 0 END
  FROM bits WHERE b > 0
), expo AS (
  SELECT greatest(low, CASE WHEN rep > 0 THEN rep + 1 ELSE 0 END) / 4294967296.0::DOUBLE AS a FROM bits WHERE b = 0
), quota AS (
  SELECT source, tokens,
    CAST(round(exp((SELECT a FROM expo) * lp) / (SELECT sum(exp((SELECT a FROM expo) * lp)) FROM p)
      * (SELECT CAST(sum(tokens) AS DOUBLE) FROM src)) AS BIGINT) AS q
  FROM p
), plan AS (
  SELECT source, q // tokens AS blocks, q % tokens AS rest FROM quota
), dealt AS (
  SELECT doc_id, source, n_tokens, epoch, blocks, rest, md5('7:' || CAST(epoch AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS order_key
  FROM (SELECT s.*, blocks, rest, unnest(range(0, blocks + 1)) AS epoch FROM slim s JOIN plan USING (source))
), run AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY order_key, CAST(doc_id AS VARCHAR), n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM dealt
)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, order_key, n_tokens FROM run WHERE epoch < blocks OR upto <= rest
""",
    "op11_kd_search": """
WITH x AS (
  SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM x q JOIN x c ON q.vec_id % 100 = 0 AND q.own <> c.own
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op13_merkle": """
WITH RECURSIVE crc AS (
  SELECT *, list_reduce(
      list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) % 2 = 1 AS hit  -- the last step of CRC-32 turns all bits
  FROM documents
), heads AS (
  SELECT doc_id, source, text, CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS cut,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM crc
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS changed FROM heads
), ranked AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM leaves
), up AS (
  SELECT tree, 0 AS level, rank, leaf AS digest, (SELECT count(*) FROM ranked r WHERE r.tree = ranked.tree) AS size FROM ranked
  UNION ALL
  SELECT tree, level, rank, sha256(string_agg(digest, '' ORDER BY child)) AS digest, (size + 2) // 3
  FROM (SELECT tree, level + 1 AS level, rank // 3 AS rank, rank AS child, digest, size FROM up WHERE size > 1) GROUP BY tree, level, rank, size
), tops AS (
  SELECT 0 AS level, tree AS rank, digest, (SELECT count(DISTINCT tree) FROM ranked) AS size FROM up WHERE size = 1
  UNION ALL
  SELECT level, rank, sha256(string_agg(digest, '' ORDER BY child)) AS digest, (size + 2) // 3
  FROM (SELECT level + 1 AS level, rank // 3 AS rank, rank AS child, digest, size FROM tops WHERE size > 1) GROUP BY level, rank, size
), depth AS (SELECT tree, max(level) AS d FROM up GROUP BY tree
), nodes AS (
  SELECT tree, level, rank, digest FROM up WHERE size > 1
  UNION ALL
  SELECT NULL, level, rank, digest FROM tops WHERE size > 1
), steps AS (
  SELECT doc_id, r.tree, leaf, r.rank AS place, n.level AS level, n.rank AS other, (r.rank // CAST(power(3, n.level) AS BIGINT)) AS own, n.digest
  FROM ranked r JOIN up n ON n.tree = r.tree AND n.size > 1 AND n.rank // 3 = r.rank // CAST(power(3, n.level + 1) AS BIGINT)
  UNION ALL
  SELECT doc_id, r.tree, leaf, r.rank, d.d + n.level, n.rank, (r.tree // CAST(power(3, n.level) AS BIGINT)), n.digest
  FROM ranked r JOIN depth d ON d.tree = r.tree JOIN tops n ON n.size > 1 AND n.rank // 3 = r.tree // CAST(power(3, n.level + 1) AS BIGINT)
), each AS (
  SELECT tree, place, level, coalesce(string_agg(digest, '' ORDER BY other) FILTER (WHERE other < own), '') AS before, coalesce(string_agg(digest, '' ORDER BY other) FILTER (WHERE other > own), '') AS after
  FROM steps GROUP BY tree, place, level
), proofs AS (SELECT tree, place, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM each GROUP BY tree, place
), folds AS (
  SELECT tree, rank AS place, 0 AS level, changed AS digest FROM ranked
  UNION ALL
  SELECT f.tree, f.place, f.level + 1, sha256(e.before || f.digest || e.after) FROM folds f JOIN each e ON e.tree = f.tree AND e.place = f.place AND e.level = f.level
), ends AS (SELECT tree, place, max_by(digest, level) AS folded FROM folds GROUP BY tree, place
)
SELECT r.doc_id, r.leaf, s.digest AS subroot, t.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded AS folded_root, e.folded = t.digest AS verified
FROM ranked r JOIN up s ON s.tree = r.tree AND s.size = 1 CROSS JOIN (SELECT digest FROM tops WHERE size = 1) t
JOIN ends e ON e.tree = r.tree AND e.place = r.rank LEFT JOIN proofs p ON p.tree = r.tree AND p.place = r.rank
""",
}
