"""The registered queries of the numbered operators, with their contracts' columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occupipe.llm import (
    bradley_terry,
    counterfactual,
    cross_entropy,
    decontaminate,
    feistel,
    hard_negatives,
    mask_search,
    packing,
    pivot_index,
    simhash,
    templates,
    token_cache,
    url_rules,
)
from occupipe.llm.common import bucket_of
from occupipe.session import kept_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(job: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = job
        if sql is not None:
            ORACLE[name] = sql
        return job

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scored(rows: DataFrame, parts: int, held: int) -> DataFrame:
    held_out = F.coalesce(bucket_of(F.col("doc_id"), parts) == held, F.lit(False))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return rows.select("doc_id", held_out.alias("held_out"), "score", predicted)


@query("op1_bradley_terry_quality")
def bradley_terry_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return scored(bradley_terry.quality(documents, labels, parts=3, held=1), 3, 1)


@query("op2_mixture_packing")
def mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window_id")


TOP_PRODUCTS_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op3_pivot_top_products", TOP_PRODUCTS_SQL)
def pivot_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_index.top_products(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


@query("op4_cross_entropy_difference")
def cross_entropy_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Documents against the conversations as the target domain."""
    return cross_entropy.cross_entropy_difference(table(spark, folder, "documents"), table(spark, folder, "conversations"))


@query("op5_template_line_dedup")
def template_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    cut = templates.without_recurring(documents, dropped="dropped_records")
    text = F.coalesce("text", F.lit(""))
    return cut.select("doc_id", "dropped_records", F.octet_length(text).cast("long").alias("n_bytes"), "text")


@query("op6_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts are kept in the warehouse, in a folder per tokenizer version, for later runs."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    cache = f"{kept_dir(spark, 'token_counts')}/{token_cache.tokenizer_version(path)}"
    counted = token_cache.count_tokens(table(spark, folder, "documents"), path, cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query("op7_qgram_decontamination")
def qgram_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op8_feistel_shards")
def feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = feistel.shuffle_into_shards(table(spark, folder, "documents"), shards=24, seed=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op9_counterfactual_toxicity")
def counterfactual_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = counterfactual.learn(documents, labels, parts=5, held=0)
    return scored(counterfactual.score(documents, model), 5, 0)


@query("op10_simhash_components")
def simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * o.x[i])) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY rank <= 5
"""


@query("op11_coordinate_hard_negatives", HARD_NEGATIVES_SQL)
def coordinate_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").withColumn("label", label)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, scale=256)


MASK_SEARCH_SQL = """
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
), c AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL
), n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY ALL
), t AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n
), f AS (SELECT term, count(*) AS df FROM c GROUP BY ALL
), w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, t
), m AS (SELECT doc_id, 10 + (90 * n * big_n) // big_l AS m FROM n, t
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN c USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""


@query("op12_presence_mask_search", MASK_SEARCH_SQL)
def presence_mask_search(spark: SparkSession, folder: str) -> DataFrame:
    return mask_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


#: host, path and verdict of the rules that the query applies.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
URL_RULES_SQL = f"""
WITH rules(h, p, v) AS (VALUES {", ".join(map(str, URL_RULES))}
), r AS (SELECT page_id, row_number() OVER () AS row_no, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, row_no, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
)
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict
FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY length(h || p) DESC) = 1
"""


@query("op13_hashed_url_rules", URL_RULES_SQL)
def hashed_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that no rule fits are allowed."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, folder, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")
