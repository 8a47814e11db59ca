"""Queries over the text cleaning functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from occupipe.functions import arrays as A
from occupipe.functions import codes as K
from occupipe.functions import text as T
from occupipe.plans.registry import ADS_SQL, query

# The cleaning chain as SQL, step by step. RE2 has no lookaround, so the neighbour of a
# match is captured and put back; where matches can touch, the step is applied twice.
CHAIN_SQL = [
    ("break_to_period", "replace({t}, '<br>', '.')"),
    (
        "decode_entities",
        "regexp_replace(replace(replace({t}, '&amp;', '&'), '&nbsp;', ' '), '&[rl][sd]quo;', '''', 'g')",
    ),
    ("straighten_quotes", "regexp_replace({t}, '[’‘]', '''', 'g')"),
    ("bullet_after_tag", r"regexp_replace({t}, '>\s*(•|-|·|\d+\.)', '>.', 'g')"),
    ("non_ascii_to_period", r"regexp_replace({t}, '[^\x00-\x7F]+', '.', 'g')"),
    (
        "tags_to_text",
        r"regexp_replace(regexp_replace({t}, '</[^>\n]*>', '.', 'g'), '<[^>\n]*>', ' ', 'g')",
    ),
    ("semicolons_and_space", r"trim(regexp_replace(replace({t}, ';', '.'), '\s+', ' ', 'g'))"),
    ("leading_punctuation", r"regexp_replace({t}, '^\s*[?.,!]\s*', '')"),
    (
        "space_between_periods",
        r"regexp_replace(regexp_replace({t}, '\.\s+\.', '..', 'g'), '\.\s+\.', '..', 'g')",
    ),
    ("space_before_punctuation", r"regexp_replace({t}, '(\w)\s+([?.,!])', '\1\2', 'g')"),
    ("collapse_periods", r"regexp_replace({t}, '\.+', '.', 'g')"),
    ("period_after_symbol", r"regexp_replace({t}, '([^A-Za-z0-9\s])\.', '\1', 'g')"),
    ("period_before_lowercase", r"regexp_replace({t}, '\.\s*([a-z])', ' \1', 'g')"),
    (
        "drop_short_segments",
        r"trim(array_to_string(list_filter(string_split({t}, '.'), lambda s: regexp_matches(s, '\S\s+\S')), '.'))"
        " || '.'",
    ),
]


def chain_sql(column: str, steps: int = len(CHAIN_SQL)) -> str:
    return reduce(lambda text, step: step[1].replace("{t}", text), CHAIN_SQL[:steps], column)


def _through(count: int):
    def job(t):
        column = reduce(lambda text, step: step(text), T.FINAL_STEPS[:count], F.col("html"))
        return t.spread("pages").select("page_id", column.alias("text"))

    return job


for at, (name, _) in enumerate(CHAIN_SQL, start=1):
    query(f"clean_through_{name}", f"SELECT page_id, {chain_sql('html', at)} AS text FROM pages")(_through(at))


@query("clean_final_documents", f"SELECT doc_id, {chain_sql('text')} AS text FROM documents")
def clean_final_documents(t):
    return t.spread("documents").select("doc_id", T.clean_final(F.col("text")).alias("text"))


RAW_SQL = (
    r"replace(regexp_replace(regexp_replace({t}, '(>\d)\t', '\1. ', 'g'), '[\n\t\x{A0}]', '', 'g'), 'No.', 'Number')"
)


@query("clean_raw", "SELECT doc_id, " + RAW_SQL.replace("{t}", "text") + " AS text FROM documents")
def clean_raw(t):
    return t.documents.select("doc_id", T.clean_raw(F.col("text")).alias("text"))


@query(
    "clean_item",
    r"""
    SELECT doc_id, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(text, '<[^>\n]*>', '', 'g')),
        '^\d+\.{0,1}', '')), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), E' \n\t\r') AS text
    FROM documents
    """,
)
def clean_item(t):
    return t.documents.select("doc_id", T.clean_item(F.col("text")).alias("text"))


@query(
    "short_documents",
    rf"""
    SELECT page_id, len(regexp_extract_all({chain_sql('html')}, '\w+')) AS words,
           len(regexp_extract_all({chain_sql('html')}, '\w+')) < 100 AS short
    FROM pages
    """,
)
def short_documents(t):
    counted = t.spread("pages").select(
        "page_id", T.word_count(T.clean_final(F.col("html"))).cast("bigint").alias("words")
    )
    return counted.withColumn("short", F.col("words") < 100)


@query(
    "remove_first_prefix",
    """
    SELECT doc_id, CASE WHEN starts_with(text, 'The') THEN trim(text[4:]) WHEN starts_with(text, 'Th') THEN trim(text[3:])
        WHEN starts_with(text, 'De') THEN trim(text[3:]) ELSE text END AS text
    FROM documents
    """,
)
def remove_first_prefix(t):
    return t.documents.select("doc_id", T.remove_prefix(F.col("text"), ["The", "Th", "De"]).alias("text"))


@query(
    "clean_title",
    r"""
    WITH a AS (SELECT p_partkey, '[new] ' || p_name || ' (' || p_type || ') #sgunitedjobs ' || p_brand || ' - 123456 é' AS s FROM part),
    b AS (SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(s, '\[.*?\]', ' ', 'g')), '\(.*?\)', ' ', 'g')) AS s FROM a),
    c AS (SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(s, '#sgunitedjobs*', ' ', 'g')), '^\d{2,5}', ' ')) AS s FROM b),
    d AS (SELECT p_partkey, trim(regexp_replace(trim(replace(s, '-', ' ')), '#\w+', ' ', 'g')) AS s FROM c),
    e AS (SELECT p_partkey, trim(regexp_replace(s, '\d{4,}', ' ', 'g')) AS s FROM d)
    SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(s, '[^\x00-\x7F]+', ' ', 'g'),
        '[^a-zA-Z0-9\s]', ' ', 'g'), '\s\s+', ' ', 'g') AS title FROM e
    """,
)
def clean_title(t):
    raw = F.concat(
        F.lit("[new] "), "p_name", F.lit(" ("), "p_type", F.lit(") #sgunitedjobs "), "p_brand", F.lit(" - 123456 é")
    )
    return t.part.select("p_partkey", T.clean_title(raw).alias("title"))


@query(
    "clean_bag",
    r"""
    SELECT page_id, array_to_string(regexp_extract_all(lower(regexp_replace(html, '<[^>\n]*>', '', 'g')), '[a-z]+'), ' ') AS bag
    FROM pages
    """,
)
def clean_bag(t):
    return t.spread("pages").select("page_id", T.clean_bag(F.col("html")).alias("bag"))


LISTED = "'• ' || p_name || chr(10) || '• ' || p_type || ' (size ' || p_size || ')' || chr(10) || '<Blank>'"


def listed_text():
    return F.concat(
        F.lit("• "), "p_name", F.lit("\n• "), "p_type", F.lit(" (size "), "p_size", F.lit(")\n<Blank>")
    )


@query(
    "clean_title_list",
    f"""
    SELECT p_partkey, regexp_replace(replace(replace(replace({LISTED}, '•', ''), chr(10), '.'), '<Blank>', ''),
        '\\([A-Za-z0-9 /.,*&''-]+\\)', '', 'g') AS titles
    FROM part
    """,
)
def clean_title_list(t):
    return t.part.select("p_partkey", T.clean_title_list(listed_text()).alias("titles"))


@query(
    "elsewhere_entries",
    """
    SELECT p_partkey, CAST(10000 + p_size AS VARCHAR) AS code, lower(p_name) AS title FROM part
    UNION ALL SELECT p_partkey, p_brand, lower(p_type) FROM part
    """,
)
def elsewhere_entries(t):
    text = F.concat(
        "p_name", F.lit(", see "), (F.lit(10000) + F.col("p_size")).cast("string"), F.lit("."), "p_type",
        F.lit(", see "), "p_brand",
    )
    rows = t.part.select("p_partkey", F.explode(T.elsewhere_entries(text)).alias("e"))
    return rows.select("p_partkey", "e.code", "e.title")


@query("ascii_projection", r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', ' ', 'g') AS text FROM documents")
def ascii_projection(t):
    return t.documents.select("doc_id", T.to_ascii(F.col("text")).alias("text"))


@query(
    "url_id",
    """
    SELECT page_id, nullif(regexp_extract(url || '?', '-([a-z0-9]{32})\\?', 1), '') AS plain,
        nullif(regexp_extract(url || '-' || md5(CAST(page_id AS VARCHAR)) || '?', '-([a-z0-9]{32})\\?', 1), '') AS hashed
    FROM pages
    """,
)
def url_id(t):
    hashed = F.concat("url", F.lit("-"), F.md5(F.col("page_id").cast("string")))
    return t.pages.select("page_id", T.url_id(F.col("url")).alias("plain"), T.url_id(hashed).alias("hashed"))


@query("record_key", "SELECT c_custkey, md5(c_name) AS uuid FROM customer")
def record_key(t):
    return t.customer.select("c_custkey", T.record_key(F.col("c_name")).alias("uuid"))


@query(
    "code_levels",
    f"WITH {ADS_SQL} SELECT ad_id, code[1:1] AS d1, code[1:2] AS d2, code[1:3] AS d3, code[1:4] AS d4, code[2:] AS rest FROM ads",
)
def code_levels(t):
    c = F.col("code")
    return t.ads().select("ad_id", *[K.level(c, k).alias(f"d{k}") for k in range(1, 5)], K.remainder(c).alias("rest"))


@query(
    "percent_and_band",
    """
    SELECT event_id, printf('%.2f%%', value * 100) AS shown,
        CASE WHEN value < 33.33 THEN 'low' WHEN value < 66.66 THEN 'medium' ELSE 'high' END AS band
    FROM events
    """,
)
def percent_and_band(t):
    v = F.col("value")
    return t.events.select("event_id", T.percent(v).alias("shown"), T.confidence_band(v).alias("band"))


@query(
    "centre_trim",
    r"""
    WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS w FROM documents)
    SELECT doc_id, CASE WHEN len(w) > 50 THEN array_to_string(
        w[CAST(ceil((len(w) - 50) / 2.0) AS INT) + 1 : CAST(ceil((len(w) - 50) / 2.0) AS INT) + 50], ' ') ELSE text END AS text
    FROM w
    """,
)
def centre_trim(t):
    return t.documents.select("doc_id", T.centre_trim(F.col("text"), 50).alias("text"))


@query(
    "log2_or_zero",
    "SELECT p_partkey, round(CASE WHEN p_size - 10 > 0 THEN log2(p_size - 10) ELSE 0 END, 6) AS log2_size FROM part",
)
def log2_or_zero(t):
    return t.part.select("p_partkey", F.round(A.log2_or_zero(F.col("p_size") - 10), 6).alias("log2_size"))


@query(
    "array_text_forms",
    f"""
    WITH {ADS_SQL} SELECT ad_id, array_to_string(predicted, ',') AS joined, len(predicted) AS n,
        predicted[1] AS first_code FROM ads
    """,
)
def array_text_forms(t):
    literal = F.concat(F.lit("['"), F.array_join("predicted", "', '"), F.lit("']"))
    parsed = A.parse_list_literal(literal)
    return t.ads().select(
        "ad_id",
        F.array_join(F.split(F.array_join("predicted", ","), ","), ",").alias("joined"),
        F.size(parsed).cast("bigint").alias("n"),
        F.get(parsed, F.lit(0)).alias("first_code"),
    )


@query(
    "array_reductions",
    """
    WITH g AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT vec_id, round(list_avg(e), 6) AS mean, round(list_min(e), 6) AS lowest,
        round((e[1] + e[2]) / 2, 6) AS mean_of_two, round(1 - e[1], 6) AS inverse FROM g
    """,
)
def array_reductions(t):
    e = F.col("embedding").cast("array<double>")
    return t.embeddings.select(
        "vec_id",
        F.round(A.mean(e), 6).alias("mean"),
        F.round(F.array_min(e), 6).alias("lowest"),
        F.round(A.mean(A.first_n(e, 2)), 6).alias("mean_of_two"),
        F.round(1 - F.get(e, F.lit(0)), 6).alias("inverse"),
    )


@query(
    "membership_in_first",
    f"""
    WITH {ADS_SQL} SELECT ad_id, list_contains(predicted[1:5], code) AS in_5, list_contains(predicted, code) AS in_10 FROM ads
    """,
)
def membership_in_first(t):
    p, c = F.col("predicted"), F.col("code")
    return t.ads().select("ad_id", A.in_first_n(p, c, 5).alias("in_5"), A.in_first_n(p, c, 10).alias("in_10"))


@query(
    "vector_cosine",
    """
    WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    s AS (SELECT label, i, avg(e[i]) AS x FROM v, range(1, 65) r(i) GROUP BY label, i),
    m AS (SELECT label, list(x ORDER BY i) AS c FROM s GROUP BY label), j AS (SELECT vec_id, e, c FROM v JOIN m USING (label))
    SELECT vec_id, round(list_inner_product(e, c), 6) AS dot, round(sqrt(list_inner_product(e, e)), 6) AS norm,
        round(list_cosine_similarity(e, c), 6) AS cosine FROM j
    """,
)
def vector_cosine(t):
    data = t.embeddings.withColumn("e", F.col("embedding").cast("array<double>"))
    means = data.groupBy("label").agg(F.array(*[F.avg(F.get("e", F.lit(i))) for i in range(64)]).alias("c"))
    e, c = F.col("e"), F.col("c")
    return data.join(means, "label").select(
        "vec_id",
        F.round(A.dot(e, c), 6).alias("dot"),
        F.round(A.norm(e), 6).alias("norm"),
        F.round(A.cosine(e, c), 6).alias("cosine"),
    )
