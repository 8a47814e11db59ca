"""Queries over samples and splits.

Rows drawn by an md5 coin are compared one by one. Rows drawn by Spark's own hash cannot be
repeated in SQL, so there the compared output is what the rules fix: sizes per group and side,
and that sides neither overlap nor lose rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from occupipe.operators import split as S
from occupipe.operators.search import dissimilar_sample
from occupipe.plans.registry import query


def sides(df, *keys):
    return df.groupBy(*keys, "split").agg(F.count(F.lit(1)).alias("n"))


COIN_SQL = "CAST('0x' || substr(md5({key} || '|{seed}'), 1, 15) AS BIGINT)"


@query("sample_share", f"SELECT doc_id, lang FROM documents WHERE {COIN_SQL.format(key='doc_id', seed=1)} % 1000000 < 100000")
def sample_share(t):
    return S.sample_share(t.documents.select("doc_id", "lang"), ["doc_id"], 0.1)


@query(
    "sample_per_group",
    "SELECT lang, CAST(round_even(count(*) * 0.04, 0) AS BIGINT) AS n FROM documents GROUP BY lang HAVING round_even(count(*) * 0.04, 0) > 0",
)
def sample_per_group(t):
    drawn = S.sample_share_per_group(t.documents.select("doc_id", "lang"), ["lang"], ["doc_id"], 0.04)
    return drawn.groupBy("lang").agg(F.count_distinct("doc_id").alias("n"))


STRATIFIED_SQL = """
    s AS (SELECT n_nationkey AS code, c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS title FROM customer JOIN nation ON c_nationkey = n_nationkey),
    g AS (SELECT code, count(title) AS titled, count(*) AS n FROM s GROUP BY code),
    z AS (SELECT code, CASE WHEN titled > 1 THEN greatest(1, CAST(floor(n * 0.8) AS BIGINT)) WHEN titled = 1 THEN n ELSE 0 END AS train,
        CASE WHEN titled > 1 THEN n - greatest(1, CAST(floor(n * 0.8) AS BIGINT)) ELSE 0 END AS test FROM g)
"""


def labelled_customers(t):
    """Customers as ads of their nation, plus one definition row per nation."""
    title = F.when(F.col("c_custkey") % 7 != 0, F.col("c_name"))
    ads = t.customer.select(F.col("c_nationkey").alias("code"), F.col("c_custkey").alias("id"), title.alias("title"))
    definitions = t.nation.select(
        F.col("n_nationkey").alias("code"), F.lit(None).cast("bigint").alias("id"), F.col("n_name").alias("title")
    )
    return ads.unionByName(definitions)


@query(
    "stratified_split",
    f"""
    WITH {STRATIFIED_SQL}, d AS (SELECT n_nationkey AS code, coalesce(train, 0) + 1 AS train, coalesce(test, 0) AS test
        FROM nation LEFT JOIN z ON n_nationkey = code)
    SELECT code, 'train' AS split, train AS n FROM d UNION ALL SELECT code, 'test', test FROM d WHERE test > 0
    """,
)
def stratified_split(t):
    return sides(S.stratified_split(labelled_customers(t), "id", "code", "title"), "code")


@query(
    "stratified_split_skewed",
    """
    WITH s AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN 'hot' ELSE l_returnflag || l_linestatus || l_linenumber END AS code FROM lineitem),
    g AS (SELECT code, count(*) AS n FROM s GROUP BY code)
    SELECT code, 'train' AS split, greatest(1, CAST(floor(n * 0.8) AS BIGINT)) AS n FROM g
    UNION ALL SELECT code, 'test', n - greatest(1, CAST(floor(n * 0.8) AS BIGINT)) FROM g WHERE n > 1
    """,
)
def stratified_split_skewed(t):
    code = F.when(F.col("l_partkey") % 3 == 0, "hot").otherwise(
        F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    )
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = t.lineitem.select(*ids, code.alias("code"), F.col("l_returnflag").alias("title"))
    return sides(S.stratified_split(rows, "l_orderkey", "code", "title", ids=ids), "code")


@query(
    "random_split",
    f"SELECT lang, CASE WHEN {COIN_SQL.format(key='doc_id', seed=2021)} % 1000000 < 800000 THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM documents GROUP BY ALL",
)
def random_split(t):
    return sides(S.random_split(t.documents.select("doc_id", "lang"), ["doc_id"]), "lang")


@query(
    "holdout_of_repeats",
    """
    SELECT 'test' AS split, least(200, count(*) - count(DISTINCT o_custkey)) AS n, CAST(0 AS BIGINT) AS firsts FROM orders
    UNION ALL SELECT 'train', count(*) - least(200, count(*) - count(DISTINCT o_custkey)), count(DISTINCT o_custkey) FROM orders
    """,
)
def holdout_of_repeats(t):
    orders = t.orders.select("o_orderkey", "o_custkey")
    split = S.holdout_of_repeats(orders, "o_custkey", "o_orderkey", 200)
    firsts = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("_first"))
    joined = split.join(firsts, "o_custkey")
    return joined.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey") == F.col("_first")).alias("firsts")
    )


@query(
    "split_audit",
    f"""
    WITH {STRATIFIED_SQL} SELECT (SELECT count(*) FROM nation) AS train_codes, count(*) FILTER (test > 0) AS test_codes, CAST(0 AS BIGINT) AS missing_from_train FROM z
    """,
)
def split_audit(t):
    return S.split_audit(S.stratified_split(labelled_customers(t), "id", "code", "title"), "code")


@query(
    "head_split",
    """
    SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= (SELECT count(*) * 5 // 100 FROM documents) THEN 'validation' ELSE 'train' END AS split FROM documents
    """,
)
def head_split(t):
    return S.head_split(t.documents.select("doc_id"), "doc_id", 5)


@query(
    "exact_split",
    "SELECT 'train' AS split, CAST(600 AS BIGINT) AS n FROM orders HAVING count(*) > 0 UNION ALL SELECT 'test', CAST(60 AS BIGINT) FROM orders HAVING count(*) > 0",
)
def exact_split(t):
    return sides(S.exact_split(t.orders.select("o_orderkey"), ["o_orderkey"], 600, 0.1))


@query(
    "dissimilar_sample",
    f"""
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    u AS (SELECT vec_id, list_transform(x, lambda c: c / sqrt(list_inner_product(x, x))) AS e FROM v),
    f AS (SELECT arg_min(struct_pack(vec_id := vec_id, e := e), struct_pack(a := {COIN_SQL.format(key="vec_id", seed=1)}, b := vec_id)) AS s FROM u),
    r AS (SELECT 0 AS round, s.vec_id AS vec_id, s.e AS total, [s.vec_id] AS taken FROM f
        UNION ALL SELECT b.round + 1, b.s.vec_id, list_transform(list_zip(b.total, b.s.e), lambda p: p[1] + p[2]), list_append(b.taken, b.s.vec_id) FROM (
            SELECT r.round AS round, any_value(r.total) AS total, any_value(r.taken) AS taken,
                arg_min(struct_pack(vec_id := u.vec_id, e := u.e), struct_pack(a := round(list_inner_product(u.e, r.total), 12), b := u.vec_id)) AS s
            FROM r JOIN u ON NOT list_contains(r.taken, u.vec_id) WHERE r.round < 49 GROUP BY r.round) b)
    SELECT CAST(round AS INT) AS round, vec_id FROM r
    """,
)
def dissimilar_sample_query(t):
    return dissimilar_sample(t.embeddings, "vec_id", "embedding", 50)


@query(
    "sample_with_replacement",
    f"""
    WITH c AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS place, count(*) OVER () AS n FROM customer),
    d AS (SELECT i AS draw, {COIN_SQL.format(key='i', seed=1)} AS coin FROM range(50) r(i))
    SELECT CAST(draw AS BIGINT) AS draw, c_custkey, c_name FROM d JOIN c ON place = coin % n
    """,
)
def sample_with_replacement(t):
    return S.sample_with_replacement(t.customer.select("c_custkey", "c_name"), "c_custkey", 50)
