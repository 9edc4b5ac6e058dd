"""The registered queries of the operators, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .embedding_dedup import near_duplicates
from .exact_dedup import exact_duplicates
from .hard_negatives import hard_negatives
from .jaccard_join import jaccard_join
from .language_id import language_id
from .mixing import mix
from .passage_dedup import repeated_documents
from .piece_codec import round_trip
from .pseudonyms import found_documents
from .quality import MAX_REPEAT_PERCENT, MIN_WORDS, quality_rules, with_statistics
from .secret_scan import secret_scan
from .token_counts import token_counts


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; the package is installed on driver and executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"), dropout=0.1, seed=1)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_documents(documents(spark, sf_dir))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_documents(documents(spark, sf_dir), b"a key for these tables alone")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 7 have the next label, and every hundredth is an anchor, as the task asks."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label).withColumn("is_anchor", F.col("vec_id") % 100 == 0))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that op7's base rules go by, alone, since SQL can express them."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return with_statistics(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans op8's base patterns find, alone, since SQL can express them."""
    return secret_scan(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece_codec,
        op2_language_id,
        op3_source_mixing,
        op4_passage_dedup,
        op5_jaccard_join,
        op6_embedding_dedup,
        op7_quality_rules,
        op8_secret_scan,
        op9_pseudonyms,
        op10_token_counts,
        op11_exact_dedup,
        op12_hard_negatives,
        quality_base,
        secret_base,
    )
}

#: The whole mix in SQL; hash and rules as in mixing.py, with a window over each source, which suits one machine.
MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('5:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents
), by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER () * 1.0::DOUBLE AS t FROM by_source
), filled AS (
  SELECT *, sum(cap) OVER (ORDER BY cap / w RANGE UNBOUNDED PRECEDING) + cap / w * (sum(w) OVER () - sum(w) OVER (ORDER BY cap / w RANGE UNBOUNDED PRECEDING)) < t AS is_full FROM weighted
), rest AS (
  SELECT *, t - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS rest, sum(w) OVER () - sum(CASE WHEN is_full THEN w ELSE 0 END) OVER () AS rest_w FROM filled
), targets AS (
  SELECT source, source_size, CASE WHEN is_full OR rest_w <= 0 THEN cap ELSE least(cap, rest / rest_w * w) END AS target FROM rest
), planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets
), groups AS (
  SELECT source, h, sum(size) AS group_size FROM sizes GROUP BY source, h
), running AS (
  SELECT g.*, coalesce(sum(group_size) OVER (PARTITION BY g.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM groups g
), cuts AS (
  SELECT r.source, max(r.h) AS h_upto FROM running r JOIN planned p ON r.source IS NOT DISTINCT FROM p.source
  WHERE r.before + r.group_size / 2.0 <= p.target - p.whole * p.source_size GROUP BY r.source
)
SELECT s.doc_id, s.size, p.source_size, p.target, s.size * (p.whole + (s.h <= coalesce(c.h_upto, -1))::BIGINT) AS taken
FROM sizes s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
"""

#: All links by an index of shingles, then components. Every pair that shares a shingle is counted, which suits small tables.
JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(l.b, w.doc_id))::BIGINT AS component_id
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN least l ON l.a = w.doc_id
"""

#: All pairs of a label, then components.
VECTOR_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label::VARCHAR AS label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), found AS (SELECT a, min(b) AS least FROM reach GROUP BY a
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(f.least, v.vec_id))::BIGINT AS component_id, least(v.vec_id, coalesce(f.least, v.vec_id)) = v.vec_id AS kept
FROM embeddings v LEFT JOIN counts c ON c.a = v.vec_id LEFT JOIN found f ON f.a = v.vec_id
"""

QUALITY_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (SELECT doc_id, i, array_to_string(words[i:i + 2], ' ') AS three FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, three) >= 2
), repeated AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM again) GROUP BY doc_id
), counted AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN repeated r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
"""

SECRET_SQL = r"""
SELECT doc_id, len(list_filter(regexp_extract_all(x, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda v: length(v) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(x, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20))::BIGINT AS n_access, len(list_filter(regexp_extract_all(x, '[0-9a-f]+'), lambda v: length(v) >= 24))::BIGINT AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)
"""

COPIES_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x FROM documents
), placed AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY n DESC, doc_id NULLS LAST) AS place FROM t)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY x) AS group_size, place = 1 AS kept, sha256(x) AS text_sha256 FROM placed WINDOW w AS (PARTITION BY x ORDER BY place)
"""

#: All anchors against all rows.
NEGATIVES_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negatives AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS place
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE place <= 10
"""

ORACLE_SQL = {"op11_exact_dedup": COPIES_SQL, "op12_hard_negatives": NEGATIVES_SQL, "quality_base": QUALITY_SQL, "secret_base": SECRET_SQL, "op3_source_mixing": MIX_SQL, "op5_jaccard_join": JACCARD_SQL, "op6_embedding_dedup": VECTOR_SQL}
