"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import decontamination, exact_shards, hard_negatives, lexical_search, license_scan
from pulseframe.llm import llr_quality, mixing, personal_data, qda_quality, shingle_join, substring_dedup, token_counts, token_output
from pulseframe.llm.run import table, with_ids

END_ID = 2
SHARDS = 40
#: Shares of the expected tokens by label: clean prose first, little of what is marked toxic or poor.
TARGETS = {"quality1_toxic0": 0.90, "quality1_toxic1": 0.02, "quality0_toxic0": 0.06, "quality0_toxic1": 0.02}
#: For a corpus that is filtered for quality already: little of what is marked toxic.
TOXIC_TARGETS = {"toxic0": 0.98, "toxic1": 0.02}


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def domain():
    return F.concat(F.lit("quality"), F.col("quality").cast("string"), F.lit("_toxic"), F.col("toxic").cast("string"))


def toxic_domain():
    return F.concat(F.lit("toxic"), F.col("toxic").cast("string"))


def op1_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted texts are the documents labelled as good."""
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
    return llr_quality.llr_quality(docs, with_ids(docs.select("doc_id", "text"), good, "doc_id"))


def op2_qda_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op5_domain_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for the target shares of ``TARGETS``."""
    rates, _, _ = mixing.domain_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), domain(), TARGETS)
    return rates


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), END_ID)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards whose row counts are at most one apart."""
    text = F.coalesce("text", F.lit(""))
    return exact_shards.shard_documents(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; where it is divisible by 7, the label is the next one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding")
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


QUERIES = {f.__name__: f for f in (
    op1_llr_quality, op2_qda_quality, op3_license_scan, op4_substring_dedup, op5_domain_mixing, op6_shingle_join,
    op7_decontamination, op8_personal_data, op9_token_output, op10_token_counts, op11_lexical_search,
    op12_exact_shards, op13_hard_negatives)}

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "\
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

#: DuckDB SQL of the queries that SQL can express.
ORACLES = {
    "op11_lexical_search": f"""
WITH words AS (SELECT row_number() OVER () AS doc, doc_id, {_WORDS} AS terms FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT doc, doc_id, len(terms) AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
counts AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM words) GROUP BY doc, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM counts, totals GROUP BY term),
asked AS (SELECT DISTINCT item, item_id, term FROM
          (SELECT item, item_id, unnest(terms) AS term FROM
           (SELECT row_number() OVER () AS item, item_id, {_WORDS} AS terms FROM benchmark WHERE text IS NOT NULL))),
scores AS (SELECT item, any_value(item_id) AS item_id, doc, any_value(doc_id) AS doc_id,
           CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
           FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc), totals
           GROUP BY item, doc),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank, doc_id, score
           FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op13_hard_negatives": """
WITH vectors AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
                 WHERE label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same,
           CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
           FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.r <> b.r),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS place
              FROM scores WHERE same) WHERE place <= 5),
negatives AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score,
              n.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id) AS rank
              FROM positives p JOIN scores n ON p.a = n.a AND NOT n.same
              AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 5""",
}
