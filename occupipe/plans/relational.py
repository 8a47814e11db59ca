"""Queries over projections, joins, set operations and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from occupipe.functions import codes as K
from occupipe.functions import text as T
from occupipe.operators import evaluate as E
from occupipe.operators import joins as J
from occupipe.operators.groups import keep_one, with_row_index
from occupipe.operators.projections import projected_neighbours
from occupipe.operators.search import similar_vectors, title_search
from occupipe.operators.taxonomy import parent_tasks
from occupipe.plans.registry import ADS_SQL, CODE_SQL, TAXONOMY_SQL, code_of, query
from occupipe.session import through_table
from occupipe.sources import readers

# --- projections, filters, checks ---------------------------------------------------


@query("select_renamed", "SELECT o_orderkey AS job_id, o_orderpriority AS title, o_orderstatus AS code FROM orders")
def select_renamed(t):
    return readers.select_renamed(
        t.orders, {"o_orderkey": "job_id", "o_orderpriority": "title", "o_orderstatus": "code"}
    )


@query(
    "null_audit",
    """
    WITH d AS (SELECT documents.doc_id, text, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
    SELECT count(*) FILTER (doc_id IS NULL) AS doc_id, count(*) FILTER (text IS NULL) AS text,
        count(*) FILTER (quality IS NULL) AS quality, count(*) FILTER (toxic IS NULL) AS toxic,
        CAST(sum((doc_id IS NULL)::INT + (text IS NULL)::INT + (quality IS NULL)::INT + (toxic IS NULL)::INT) AS BIGINT) AS total
    FROM d
    """,
)
def null_audit(t):
    joined = t.documents.select("doc_id", "text").join(t.labels, "doc_id", "left")
    return E.null_audit(joined.select("doc_id", "text", "quality", "toxic"))


@query("trimmed_string", "SELECT p_partkey, CAST(p_partkey * 37 AS VARCHAR) AS code FROM part")
def trimmed_string(t):
    padded = F.concat(F.lit(" \t"), (F.col("p_partkey") * 37).cast("string"), F.lit(" \n\x1f"))
    return t.part.select("p_partkey", T.as_trimmed_string(padded).alias("code"))


@query(
    "normalised_codes",
    """
    SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS code FROM part WHERE p_type <> 'PROMO' AND p_partkey % 5 <> 0
    """,
)
def normalised_codes(t):
    raw = (
        F.when(F.col("p_partkey") % 5 == 0, None)
        .when(F.col("p_type") == "PROMO", "X5000")
        .otherwise(F.col("p_partkey").cast("double").cast("string"))
    )
    return t.part.select("p_partkey", K.normalise(raw).alias("code")).filter(F.col("code").isNotNull())


@query(
    "code_filters",
    f"""
    WITH {TAXONOMY_SQL}, c AS (SELECT code, code[1:4] AS parent, title,
        CASE WHEN title LIKE 'red%' THEN 'X' || code[2:] WHEN title LIKE 'old%' THEN code[1:4] || 'X' ELSE code END AS marked
        FROM taxonomy)
    SELECT code, marked, title FROM c
    WHERE marked NOT LIKE '%X%' AND length(marked) = 5 AND title LIKE '%ring%' AND regexp_matches(marked, '\\d')
        AND code[1:1] IN ('1', '2', '3') AND marked <> 'Deleted' AND marked IS NOT NULL
    """,
)
def code_filters(t):
    tax = t.taxonomy()
    marked = (
        F.when(F.startswith("title", F.lit("red")), F.concat(F.lit("X"), K.remainder(F.col("code"))))
        .when(F.startswith("title", F.lit("old")), F.concat(K.level(F.col("code"), 4), F.lit("X")))
        .otherwise(F.col("code"))
    )
    m = F.col("marked")
    return (
        tax.withColumn("marked", marked)
        .filter(K.is_real(m) & K.has_length(m, 5) & F.contains("title", F.lit("ring")) & m.rlike(r"\d"))
        .filter(K.level(F.col("code"), 1).isin("1", "2", "3") & (m != "Deleted") & m.isNotNull())
        .select("code", "marked", "title")
    )


@query(
    "x_group_filter",
    f"""
    WITH {TAXONOMY_SQL}, c AS (SELECT code, CASE WHEN title LIKE 'red%' THEN 'X' || code[2:]
        WHEN title LIKE 'old%' THEN code[1:4] || 'X' ELSE code END AS marked FROM taxonomy)
    SELECT code, marked, 'definition' AS origin, CAST(NULL AS VARCHAR) AS ad_id FROM c WHERE NOT starts_with(marked, 'X')
    """,
)
def x_group_filter(t):
    marked = (
        F.when(F.startswith("title", F.lit("red")), F.concat(F.lit("X"), K.remainder(F.col("code"))))
        .when(F.startswith("title", F.lit("old")), F.concat(K.level(F.col("code"), 4), F.lit("X")))
        .otherwise(F.col("code"))
    )
    rows = t.taxonomy().withColumn("marked", marked).filter(K.not_x_group(F.col("marked")))
    return rows.drop("title", "definition").withColumns(
        {"origin": F.lit("definition"), "ad_id": F.lit(None).cast("string")}
    )


@query(
    "date_buckets",
    """
    SELECT o_orderkey, strftime(o_orderdate, '%Y') || '-' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS week,
        CAST(isoyear(o_orderdate) AS VARCHAR) || '-' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS iso_week,
        strftime(o_orderdate, '%Y-%m') AS month
    FROM orders
    """,
)
def date_buckets(t):
    day = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey",
        K.week_bucket(day).alias("week"),
        K.week_bucket(day, iso_year=True).alias("iso_week"),
        K.month_bucket(day).alias("month"),
    )


@query(
    "equality_flags",
    f"WITH {ADS_SQL} SELECT ad_id, code = employer_code AS same, code[1:1] = employer_code[1:1] AS same_group FROM ads",
)
def equality_flags(t):
    a, b = F.col("code"), F.col("employer_code")
    return t.ads().select("ad_id", (a == b).alias("same"), (K.level(a, 1) == K.level(b, 1)).alias("same_group"))


# --- joins ---------------------------------------------------------------------------


@query(
    "counts_for_all_codes",
    f"""
    WITH {TAXONOMY_SQL}, g AS (SELECT {CODE_SQL.format('o_custkey * 3')} AS code, count(*) AS n FROM orders GROUP BY 1)
    SELECT code, coalesce(n, 0) AS n FROM taxonomy LEFT JOIN g USING (code)
    """,
)
def counts_for_all_codes(t):
    counts = t.orders.groupBy(code_of(F.col("o_custkey") * 3).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return J.with_counts(t.taxonomy().select("code"), "code", counts)


@query(
    "availability",
    """
    SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)
        OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000) AS available
    FROM customer
    """,
)
def availability(t):
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    first = orders.filter("o_orderstatus = 'F' AND o_totalprice > 300000")
    second = orders.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 400000")
    return J.with_availability(t.customer.select("c_custkey"), "c_custkey", first, second)


@query(
    "join_by_record_key",
    """
    WITH r AS (SELECT md5('Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')) AS uuid, o_orderkey FROM orders)
    SELECT c_name, md5(c_name) AS uuid, o_orderkey FROM customer LEFT JOIN r ON md5(c_name) = r.uuid
    """,
)
def join_by_record_key(t):
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    records = t.orders.select(F.md5(name).alias("uuid"), "o_orderkey")
    return J.by_record_key(t.customer.select("c_name"), "c_name", records).select("c_name", "uuid", "o_orderkey")


PARENTS_SQL = f"""
    {TAXONOMY_SQL}, parents AS (SELECT code[1:4] AS parent,
        min(CASE WHEN definition LIKE 'S%' THEN title END) AS tasks FROM taxonomy GROUP BY 1)
"""


def with_parents(t):
    """Leaves and their four-digit parents; some parents have no tasks."""
    leaves = t.taxonomy().withColumn("tasks", F.lit(None).cast("string"))
    parents = leaves.groupBy(K.level(F.col("code"), 4).alias("code")).agg(
        F.min("title").alias("title"),
        F.lit("group").alias("definition"),
        F.min(F.when(F.startswith("definition", F.lit("S")), F.col("title"))).alias("tasks"),
    )
    return leaves.unionByName(parents)


@query(
    "parent_tasks",
    f"WITH {PARENTS_SQL} SELECT code, title, definition || ' ' || tasks AS description FROM taxonomy JOIN parents ON code[1:4] = parent",
)
def parent_tasks_query(t):
    return parent_tasks(with_parents(t))


@query(
    "two_title_lookups",
    f"""
    WITH {TAXONOMY_SQL}, {ADS_SQL} SELECT ad_id, a.code, employer_code, x.title AS code_title, y.title AS employer_code_title
    FROM ads a LEFT JOIN taxonomy x ON a.code = x.code LEFT JOIN taxonomy y ON a.employer_code = y.code
    """,
)
def two_title_lookups(t):
    return J.with_titles(t.ads().select("ad_id", "code", "employer_code"), ["code", "employer_code"], t.taxonomy())


CROSSWALK_SQL = f"""
    walk AS (SELECT {CODE_SQL.format('p_partkey')} AS old,
        CASE WHEN p_type = 'PROMO' THEN 'Deleted' ELSE {CODE_SQL.format('(p_partkey + 1)')} END AS new FROM part WHERE p_size <= 40
        UNION ALL SELECT {CODE_SQL.format('p_partkey')}, {CODE_SQL.format('(p_partkey + 2)')} FROM part WHERE p_size <= 5)
"""


def crosswalk_table(t):
    """Old to new codes: mostly one target, some two, some deleted, some none."""
    key = F.col("p_partkey")
    one = t.part.filter("p_size <= 40").select(
        code_of(key).alias("old"),
        F.when(F.col("p_type") == "PROMO", "Deleted").otherwise(code_of(key + 1)).alias("new"),
    )
    two = t.part.filter("p_size <= 5").select(code_of(key).alias("old"), code_of(key + 2).alias("new"))
    return one.unionByName(two)


@query("crosswalk_all", f"WITH {CROSSWALK_SQL}, {ADS_SQL} SELECT ad_id, code, new AS recoded FROM ads LEFT JOIN walk ON code = old")
def crosswalk_all(t):
    return J.crosswalk(t.ads().select("ad_id", "code"), "code", crosswalk_table(t), "old", "new", "recoded")


@query(
    "crosswalk_first",
    f"""
    WITH {CROSSWALK_SQL}, f AS (SELECT old, min(new) AS new FROM walk GROUP BY old), {ADS_SQL}
    SELECT ad_id, code, new AS recoded FROM ads LEFT JOIN f ON code = old
    """,
)
def crosswalk_first(t):
    return J.crosswalk_first(t.ads().select("ad_id", "code"), "code", crosswalk_table(t), "old", "new", "recoded")


@query(
    "recode_twice",
    f"""
    WITH {CROSSWALK_SQL}, {ADS_SQL}, alias AS (SELECT {CODE_SQL.format('p_partkey')} AS alias, {CODE_SQL.format('(p_partkey + 3)')} AS actual FROM part)
    SELECT ad_id, new AS code FROM ads LEFT JOIN alias ON code = alias LEFT JOIN walk ON actual = old
    WHERE new IS NOT NULL AND new <> 'Deleted'
    """,
)
def recode_twice(t):
    key = F.col("p_partkey")
    aliases = t.part.select(code_of(key).alias("alias"), code_of(key + 3).alias("actual"))
    return J.recode_twice(t.ads().select("ad_id", "code"), "code", aliases, crosswalk_table(t)).select("ad_id", "code")


@query(
    "codes_with_data",
    "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
)
def codes_with_data(t):
    used = t.lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return J.only_in(t.part.select("p_partkey", "p_name"), "p_partkey", used)


@query(
    "codes_without_data",
    "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
)
def codes_without_data(t):
    used = t.lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return J.not_in(t.part.select("p_partkey", "p_name"), "p_partkey", used)


@query(
    "tag_join",
    """
    SELECT o_orderpriority AS code, c_custkey, c_name FROM (SELECT DISTINCT o_orderpriority, o_custkey FROM orders)
    JOIN customer ON o_custkey = c_custkey
    """,
)
def tag_join(t):
    # One tag document per code and slice of ids, so no document grows with the table.
    pairs = t.orders.select("o_orderpriority", "o_custkey").distinct()
    sliced = pairs.groupBy("o_orderpriority", F.floor(F.col("o_custkey") / 1000)).agg(
        F.collect_list("o_custkey").alias("ids")
    )
    tags = sliced.select(F.to_json(F.create_map("o_orderpriority", "ids")).alias("tags"))
    return J.apply_tags(t.customer.select("c_custkey", "c_name"), "c_custkey", tags, "code").select(
        "code", "c_custkey", "c_name"
    )


@query(
    "title_search",
    r"""
    WITH w AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS code, regexp_extract_all(lower(text), '\w+') AS words FROM benchmark),
    a AS (SELECT doc_id, lower(text) AS title, lower(text) AS body FROM documents)
    SELECT DISTINCT code, doc_id FROM a, w
    WHERE list_bool_and(list_transform(words, lambda x: contains(title, x))) AND NOT contains(title, 'http')
        AND NOT contains(body, 'password')
    """,
)
def title_search_query(t):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), F.lit(0))
    wanted = t.benchmark.select(F.col("item_id").cast("string").alias("code"), F.array_join(words, " ").alias("title"))
    ads = t.spread("documents").select("doc_id", F.col("text").alias("title"), "text")
    return title_search(ads, "doc_id", "title", wanted, ["http"], "text", ["password"])


SIMILAR_SQL = """
    WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),


    s AS (SELECT label AS source, i, avg(e[i]) AS x FROM v, range(1, 65) r(i) GROUP BY label, i),
    k AS (SELECT source, list(x ORDER BY i) AS centre FROM s GROUP BY source),
    p AS (SELECT source, vec_id AS target, round(list_cosine_similarity(centre, e), 6) AS sim,
        list_cosine_similarity(centre, e) AS exact FROM k, v),
    r AS (SELECT source, target, sim, row_number() OVER (PARTITION BY source ORDER BY exact DESC, target) AS rank FROM p WHERE exact >= 0.3)
    SELECT source, target, sim, rank FROM r WHERE rank <= 15
"""


@query("similar_vectors", SIMILAR_SQL)
def similar_vectors_query(t):
    e = F.col("embedding").cast("array<double>")
    targets = t.embeddings.select(F.col("vec_id").alias("id"), e.alias("vector"))
    sources = t.embeddings.groupBy(F.col("label").alias("id")).agg(
        F.array(*[F.avg(F.get(e, F.lit(i))) for i in range(64)]).alias("vector")
    )
    found = similar_vectors(sources, targets, n=15, threshold=0.3)
    return found.select("source", "target", F.round("sim", 6).alias("sim"), F.col("rank").cast("bigint").alias("rank"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"
LETTERS_SQL = f"""
    v AS (SELECT doc_id, list_transform(string_split('{' '.join(LETTERS)}', ' '), lambda c: CAST(length(t) - length(replace(t, c, '')) AS DOUBLE)) AS v
        FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)),
    u AS (SELECT doc_id, v, sqrt(list_inner_product(v, v)) AS z FROM v)
"""


def letter_counts(t):
    """Documents as counts of 26 letters."""
    docs = t.spread("documents", "doc_id", "text").select(F.col("doc_id").alias("id"), F.lower("text").alias("t")).dropna()
    counts = [(F.length("t") - F.length(F.replace("t", F.lit(c), F.lit("")))).cast("double") for c in LETTERS]
    return docs.select("id", F.array(*counts).alias("vector"))


@query("projected_neighbours")
def projected_neighbours_query(t):
    vectors = through_table(letter_counts(t))
    return projected_neighbours(vectors, vectors, 10, 0.9)


@query(
    "projected_recall",
    f"""
    WITH {LETTERS_SQL}, p AS (SELECT a.doc_id AS source, b.doc_id AS target, round(list_inner_product(a.v, b.v) / (a.z * b.z), 9) AS sim
        FROM u a JOIN u b ON a.z > 0 AND b.z > 0),
    e AS (SELECT source, target FROM p WHERE sim >= 0.9 QUALIFY row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) <= 10)
    SELECT count(*) AS exact, CAST(0 AS BIGINT) AS wrong, true AS recall_of_nine_tenths FROM e
    """,
)
def projected_recall(t):
    """All documents as sources: exact rows, rows found of which an exact search says otherwise, and whether recall is 0.9 at least."""
    vectors = through_table(letter_counts(t))
    exact = similar_vectors(vectors, vectors, 10, 0.9).select("source", "target", F.col("sim").alias("own"))
    found = projected_neighbours(vectors, vectors, 10, 0.9)
    both = exact.join(found, ["source", "target"], "full")
    counted = both.agg(
        F.count("own").alias("exact"),
        F.count_if(F.abs(F.col("sim") - F.col("own")) > 1e-9).alias("wrong"),
        F.count_if(F.col("sim").isNotNull() & F.col("own").isNotNull()).alias("found"),
    )
    return counted.select("exact", "wrong", (F.col("found") >= 0.9 * F.col("exact")).alias("recall_of_nine_tenths"))


@query(
    "similarity_costs",
    f"""
    WITH {ADS_SQL}, m AS (SELECT {CODE_SQL.format('p_partkey')} AS a, {CODE_SQL.format('(p_partkey + 7 * j)')} AS b,
        1.0 - j / 10.0 AS sim FROM part, range(0, 5) r(j) WHERE p_size > 10),
    x AS (SELECT row, ad_id, code, unnest(predicted) AS p, unnest(range(10)) AS rank FROM (SELECT *, row_number() OVER () AS row FROM ads))
    SELECT ad_id, code, array_to_string(list(coalesce(CAST(CAST(round((1 - sim) * 10) AS INT) AS VARCHAR), '-') ORDER BY rank), ',') AS costs
    FROM x LEFT JOIN m ON code = a AND p = b GROUP BY row, ad_id, code
    """,
)
def similarity_costs(t):
    key = F.col("p_partkey")
    matrix = (
        t.part.filter("p_size > 10")
        .select(key, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
        .select(
            code_of(key).alias("code_a"), code_of(key + 7 * F.col("j")).alias("code_b"), (1.0 - F.col("j") / 10).alias("sim")
        )
    )
    costs = J.similarity_of(t.ads(), "ad_id", "code", "predicted", matrix)
    shown = F.transform("costs", lambda c: F.coalesce(F.round(c * 10).cast("int").cast("string"), F.lit("-")))
    return costs.select("ad_id", "code", F.array_join(shown, ",").alias("costs"))


@query(
    "side_by_side",
    """
    SELECT documents.doc_id, n_chars, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic
    FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def side_by_side(t):
    flags = t.labels.select("doc_id", F.col("quality").cast("string"), F.col("toxic").cast("string"))
    return J.by_row_id(t.documents.select("doc_id", "n_chars"), flags, "doc_id")


@query(
    "class_expansion",
    f"""
    WITH {TAXONOMY_SQL} SELECT code, CAST(c AS VARCHAR) AS class, CAST(code[1:1] = CAST(c AS VARCHAR) AS INT) AS label
    FROM taxonomy, range(1, 10) r(c)
    """,
)
def class_expansion(t):
    return J.expand_classes(t.taxonomy().select("code"), "code", [str(i) for i in range(1, 10)])


def listed_moves(t):
    """Taxonomy with titles listed under a code, and some listed under another code."""
    return t.taxonomy().select(
        "code",
        "title",
        F.concat(F.lit("• "), "definition", F.lit("\n<Blank>")).alias("under"),
        F.when(
            F.length("title") > 9, F.concat(F.lit("old "), "title", F.lit(", see "), code_of(F.lit(5)))
        ).alias("elsewhere"),
    )


# --- sets, sorts, dedupe ----------------------------------------------------------------


@query("stacked_same", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def stacked_same(t):
    return t.customer.select(F.col("c_name").alias("name")).unionByName(t.supplier.select(F.col("s_name").alias("name")))


@query(
    "stacked_differing",
    """
    SELECT c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
    UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier
    """,
)
def stacked_differing(t):
    a = t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("rows_not_in_test", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def rows_not_in_test(t):
    return J.not_in(t.documents.select("doc_id", "lang"), "doc_id", t.labels)


@query("distinct_texts", "SELECT DISTINCT lang, source FROM documents")
def distinct_texts(t):
    return t.documents.select("lang", "source").distinct()


@query(
    "sorted_with_row_id",
    f"""
    WITH {TAXONOMY_SQL} SELECT code, title, row_number() OVER (ORDER BY title DESC, code) - 1 AS row_index FROM taxonomy
    """,
)
def sorted_with_row_id(t):
    return with_row_index(t.taxonomy().select("code", "title"), [F.desc("title"), F.asc("code")])


@query(
    "most_frequent_codes",
    f"WITH {ADS_SQL} SELECT code, count(*) AS n FROM ads GROUP BY code ORDER BY n DESC, code LIMIT 10",
)
def most_frequent_codes(t):
    return E.counts_at_level(t.ads(), "code", 5).orderBy(F.desc("n"), "code").limit(10)


@query(
    "least_frequent_codes",
    f"WITH {ADS_SQL} SELECT code, count(*) AS n FROM ads GROUP BY code ORDER BY n, code DESC LIMIT 5",
)
def least_frequent_codes(t):
    return E.counts_at_level(t.ads(), "code", 5).orderBy("n", F.desc("code")).limit(5)


@query("head_of_order", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def head_of_order(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query(
    "keep_first",
    """
    SELECT doc_id, md5(text) AS text_key FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1
    """,
)
def keep_first(t):
    return keep_one(t.documents.select("doc_id", F.md5("text").alias("text_key")), ["text_key"], [F.asc("doc_id")])


@query(
    "keep_last",
    """
    SELECT doc_id, md5(text) AS text_key FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1
    """,
)
def keep_last(t):
    return keep_one(t.documents.select("doc_id", F.md5("text").alias("text_key")), ["text_key"], [F.desc("doc_id")])
