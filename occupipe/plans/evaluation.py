"""Queries over evaluation and ranked predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from occupipe.functions import arrays as A
from occupipe.functions import codes as K
from occupipe.functions import fixed_values as fixed
from occupipe.operators import evaluate as E
from occupipe.operators import joins as J
from occupipe.plans.registry import ADS_SQL, CODE_SQL, TAXONOMY_SQL, code_of, query
from occupipe.plans.relational import listed_moves


@query("counts_at_level_1", f"WITH {ADS_SQL} SELECT code[1:1] AS code, count(*) AS n FROM ads GROUP BY 1")
def counts_at_level_1(t):
    return E.counts_at_level(t.ads(), "code", 1)


@query("counts_at_level_3", f"WITH {ADS_SQL} SELECT code[1:3] AS code, count(*) AS n FROM ads GROUP BY 1")
def counts_at_level_3(t):
    return E.counts_at_level(t.ads(), "code", 3)


@query(
    "count_of_column",
    "SELECT source, count(quality) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
)
def count_of_column(t):
    return E.count_of(t.documents.join(t.labels, "doc_id", "left"), "source", "quality")


@query(
    "coverage",
    f"""
    WITH {TAXONOMY_SQL}, g AS (SELECT {CODE_SQL.format('o_custkey * 3')} AS code, count(*) AS n FROM orders GROUP BY 1),
    c AS (SELECT code, coalesce(n, 0) AS n FROM taxonomy LEFT JOIN g USING (code))
    SELECT count(*) AS codes, count(*) FILTER (n = 0) AS without_rows, count(*) FILTER (n < 10) AS with_few_rows FROM c
    """,
)
def coverage(t):
    counts = t.orders.groupBy(code_of(F.col("o_custkey") * 3).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return E.coverage(J.with_counts(t.taxonomy().select("code"), "code", counts))


@query("distinct_codes", f"WITH {ADS_SQL} SELECT count(DISTINCT code) AS codes, count(DISTINCT employer_code) AS employer_codes FROM ads")
def distinct_codes(t):
    return t.ads().agg(
        F.count_distinct("code").alias("codes"), F.count_distinct("employer_code").alias("employer_codes")
    )


HITS_SQL = f"{ADS_SQL}, hits AS (SELECT code, title, list_contains(predicted, code) AS hit FROM ads)"
PER_CODE_SQL = f"""
    {HITS_SQL}, per_code AS (SELECT code, count(*) FILTER (hit) AS hits, min(title) AS title, min(code[1:1]) AS d1, count(hit) AS n,
        round_even(CAST(count(*) FILTER (hit) AS DOUBLE) / count(hit) * 100, 1) AS accuracy FROM hits GROUP BY code)
"""


def ad_hits(t):
    return t.ads().select("code", "title", F.array_contains("predicted", F.col("code")).alias("hit"))


@query("accuracy_by_code", f"WITH {PER_CODE_SQL} SELECT * FROM per_code")
def accuracy_by_code(t):
    return E.accuracy_by_code(ad_hits(t), "code", "hit", "title")


@query(
    "accuracy_by_group",
    f"""
    WITH {PER_CODE_SQL} SELECT code[1:1] AS prefix, round(avg(accuracy), 6) AS accuracy, CAST(sum(n) AS BIGINT) AS n,
        CASE WHEN avg(accuracy) >= 90 THEN 'good' ELSE 'poor' END AS band FROM per_code WHERE n >= 2 GROUP BY 1
    """,
)
def accuracy_by_group(t):
    per_code = E.accuracy_by_code(ad_hits(t), "code", "hit", "title")
    return E.accuracy_by_prefix(per_code, "code", 1, 2).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "accuracy_of_two_groups",
    f"""
    WITH {PER_CODE_SQL} SELECT code[1:2] AS prefix, round(avg(accuracy), 6) AS accuracy, CAST(sum(n) AS BIGINT) AS n
    FROM per_code WHERE n >= 3 AND d1 IN ('1', '2') GROUP BY 1
    """,
)
def accuracy_of_two_groups(t):
    per_code = E.accuracy_by_code(ad_hits(t), "code", "hit", "title").filter(F.col("d1").isin("1", "2"))
    return E.accuracy_by_prefix(per_code, "code", 2, 3).withColumn("accuracy", F.round("accuracy", 6)).drop("band")


@query(
    "hit_shares",
    f"WITH {HITS_SQL} SELECT hit, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM hits GROUP BY hit",
)
def hit_shares(t):
    return E.shares(ad_hits(t), "hit").withColumn("share", F.round("share", 6))


@query(
    "percent_of_group",
    f"WITH {HITS_SQL} SELECT code[1:1] AS d1, count(*) AS n, round(avg(hit::INT) * 100, 6) AS percent FROM hits GROUP BY 1",
)
def percent_of_group(t):
    rows = ad_hits(t).withColumn("d1", K.level(F.col("code"), 1))
    return E.group_percent(rows, "d1", "hit").withColumn("percent", F.round("percent", 6))


@query("accuracy", f"WITH {HITS_SQL} SELECT round(avg(hit::INT), 6) AS accuracy FROM hits")
def accuracy(t):
    return E.accuracy(ad_hits(t), "hit").withColumn("accuracy", F.round("accuracy", 6))


@query(
    "accuracy_per_level",
    f"""
    WITH {ADS_SQL} SELECT CAST(k AS INT) AS level, round(avg((code[1:k] = predicted[1][1:k])::INT), 6) AS accuracy
    FROM ads, range(1, 6) r(k) GROUP BY k
    """,
)
def accuracy_per_level(t):
    top = t.ads().select("code", F.get("predicted", F.lit(0)).alias("top"))
    return E.accuracy_per_level(top, "code", "top").withColumn("accuracy", F.round("accuracy", 6))


@query(
    "accuracy_rollup",
    f"""
    WITH {HITS_SQL} SELECT coalesce(code[1:1], 'all') AS d1, coalesce(code[1:2], 'all') AS d2, count(*) AS n,
        round(avg(hit::INT), 6) AS accuracy FROM hits GROUP BY ROLLUP (code[1:1], code[1:2])
    """,
)
def accuracy_rollup(t):
    rolled = E.accuracy_rollup(ad_hits(t), "code", "hit")
    return rolled.select(
        F.coalesce("d1", F.lit("all")).alias("d1"), F.coalesce("d2", F.lit("all")).alias("d2"), "n", F.round("accuracy", 6).alias("accuracy")
    )


@query("rows_per_bucket", "SELECT strftime(o_orderdate, '%Y-%m') AS bucket, count(*) AS n FROM orders GROUP BY 1")
def rows_per_bucket(t):
    return t.orders.groupBy(K.month_bucket(F.col("o_orderdate")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "titles_per_code",
    f"""
    WITH {TAXONOMY_SQL}, m AS (SELECT code, title, definition, CASE WHEN length(title) > 9 THEN {CODE_SQL.format('5')} END AS moved FROM taxonomy)
    SELECT code, lower(title) AS title FROM m UNION SELECT code, lower(definition) FROM m
    UNION SELECT moved, 'old ' || lower(title) FROM m WHERE moved IS NOT NULL
    """,
)
def titles_per_code(t):
    return E.titles_per_code(listed_moves(t), "title", "under", "elsewhere")


@query(
    "digit_heatmap",
    f"WITH {ADS_SQL}, c AS (SELECT code[1:1] AS d1, code[2:2] AS d2 FROM ads) SELECT d1, "
    + ", ".join(
        f"round(CASE WHEN count(*) FILTER (d2 = '{d}') > 0 THEN log2(count(*) FILTER (d2 = '{d}')) ELSE 0 END, 6) AS rest_{d}"
        for d in range(10)
    )
    + " FROM c GROUP BY d1",
)
def digit_heatmap(t):
    wide = E.digit_heatmap(t.ads(), "code", [str(d) for d in range(10)])
    return wide.select("d1", *[F.round(f"rest_{d}", 6).alias(f"rest_{d}") for d in range(10)])


@query(
    "heatmap_rows",
    f"WITH {ADS_SQL} SELECT code[1:1] AS d1, code[2:] AS rest, count(*) AS n, round(log2(count(*)), 6) AS log2_n FROM ads GROUP BY code",
)
def heatmap_rows(t):
    counts = E.counts_at_level(t.ads(), "code", 5)
    return E.heatmap_rows(counts, "code").withColumn("log2_n", F.round("log2_n", 6))


@query(
    "class_report",
    f"""
    WITH {ADS_SQL}, p AS (SELECT code[1:2] AS l, employer_code[1:2] AS p FROM ads), k AS (SELECT l AS class FROM p UNION SELECT p FROM p),
    s AS (SELECT class, (SELECT count(*) FROM p WHERE l = class) AS support, (SELECT count(*) FROM p WHERE p.p = class) AS picked,
        (SELECT count(*) FROM p WHERE l = class AND p.p = class) AS hit FROM k)
    SELECT class, round(CASE WHEN picked > 0 THEN hit / CAST(picked AS DOUBLE) ELSE 0 END, 6) AS precision,
        round(CASE WHEN support > 0 THEN hit / CAST(support AS DOUBLE) ELSE 0 END, 6) AS recall, support,
        round(CASE WHEN hit > 0 THEN 2.0 * hit / (picked + support) ELSE 0 END, 6) AS f1 FROM s
    """,
)
def class_report(t):
    pairs = t.ads().select(K.level(F.col("code"), 2).alias("l"), K.level(F.col("employer_code"), 2).alias("p"))
    report = E.class_report(pairs, "l", "p")
    return report.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "weighted_loss",
    "SELECT round("
    + " + ".join(f"{w} * avg(-ln(1.0 / (1 + l_quantity * {k})))" for k, w in fixed.LEVEL_LOSS_WEIGHTS.items())
    + ", 6) AS loss FROM lineitem",
)
def weighted_loss(t):
    scored = t.lineitem.select(*[(1.0 / (1 + F.col("l_quantity") * k)).alias(f"p{k}") for k in K.LEVELS])
    return E.weighted_loss(scored, {k: f"p{k}" for k in K.LEVELS}).withColumn("loss", F.round("loss", 6))


@query("perplexity", "SELECT round(exp(avg(l_discount * 10)), 6) AS perplexity FROM lineitem")
def perplexity(t):
    scored = t.lineitem.select((F.col("l_discount") * 10).alias("nll"))
    return E.perplexity(scored, "nll").withColumn("perplexity", F.round("perplexity", 6))


@query(
    "tag_conflicts",
    """
    SELECT o_custkey, count(DISTINCT o_orderpriority) AS codes, min(o_orderpriority) AS first_code, max(o_orderpriority) AS last_code
    FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1
    """,
)
def tag_conflicts(t):
    return E.tag_conflicts(t.orders, "o_custkey", "o_orderpriority")


@query(
    "resolved_conflicts",
    """
    SELECT o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderpriority) AS r FROM orders)
    WHERE r = 1
    """,
)
def resolved_conflicts(t):
    return E.resolve_conflicts(t.orders, "o_custkey", "o_orderpriority", "o_totalprice")


@query(
    "dataset_profile",
    f"WITH {ADS_SQL} SELECT count(*) AS n, count(DISTINCT code) AS classes, round(count(*) / CAST(count(DISTINCT code) AS DOUBLE), 6) AS rows_per_class FROM ads",
)
def dataset_profile(t):
    return E.profile(t.ads(), "code").withColumn("rows_per_class", F.round("rows_per_class", 6))


@query(
    "top_n_curve",
    f"""
    WITH {ADS_SQL} SELECT code[1:1] AS d1, CAST(k AS INT) AS n, round(avg(list_contains(predicted[1:k], code)::INT) * 100, 6) AS percent
    FROM ads, range(1, 11) r(k) GROUP BY 1, 2
    """,
)
def top_n_curve(t):
    rows = t.ads().withColumn("d1", K.level(F.col("code"), 1))
    return E.top_n_curve(rows, "d1", "code", "predicted").withColumn("percent", F.round("percent", 6))


@query(
    "rank_of_label",
    f"WITH {ADS_SQL} SELECT ad_id, CAST(coalesce(list_position(predicted, code) - 1, -1) AS BIGINT) AS rank FROM ads",
)
def rank_of_label(t):
    rank = E.predicted_rank(F.col("predicted"), F.col("code"))
    return t.ads().select("ad_id", F.coalesce(rank, F.lit(-1)).cast("bigint").alias("rank"))


@query(
    "top_n_classes",
    """
    WITH x AS (SELECT vec_id, unnest(range(64)) AS idx, unnest(CAST(embedding AS DOUBLE[])) AS p FROM embeddings),
    r AS (SELECT vec_id, idx, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, idx DESC) AS rank FROM x)
    SELECT vec_id, CAST(rank AS INT) AS rank, CAST(idx AS INT) AS idx, round(p, 6) AS p FROM r WHERE rank <= 5
    """,
)
def top_n_classes(t):
    best = A.top_n(F.col("embedding"), 5)
    rows = t.embeddings.select("vec_id", F.posexplode(best).alias("at", "e"))
    return rows.select("vec_id", (F.col("at") + 1).alias("rank"), F.col("e.idx").alias("idx"), F.round("e.p", 6).alias("p"))


@query(
    "argmax_class",
    """
    WITH x AS (SELECT vec_id, unnest(range(64)) AS idx, unnest(embedding) AS p FROM embeddings),
    r AS (SELECT vec_id, idx, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, idx) AS rank FROM x)
    SELECT vec_id, CAST(idx AS INT) AS idx FROM r WHERE rank = 1
    """,
)
def argmax_class(t):
    return t.embeddings.select("vec_id", A.argmax(F.col("embedding")).alias("idx"))


@query(
    "mean_costs",
    """
    WITH e AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT label, round(avg(list_avg(e)), 6) AS mean_cost, round(avg(list_min(e)), 6) AS lowest_cost,
        round(avg((e[1] + e[2]) / 2), 6) AS top_two_cost FROM e GROUP BY label
    """,
)
def mean_costs(t):
    costs = t.embeddings.select("label", F.col("embedding").cast("array<double>").alias("costs"))
    out = E.cost_summary(costs, "label")
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("mean_cost", "lowest_cost", "top_two_cost")])


@query(
    "compare_systems",
    f"""
    WITH {ADS_SQL}, s AS (SELECT 'model' AS system, code[1:1] AS d1, list_contains(predicted, code) AS hit FROM ads
        UNION ALL SELECT 'employer', code[1:1], employer_code = code FROM ads)
    SELECT system, d1, count(*) AS n, round(avg(hit::INT), 6) AS accuracy FROM s GROUP BY 1, 2
    """,
)
def compare_systems(t):
    ads = t.ads().withColumn("d1", K.level(F.col("code"), 1))
    model = ads.withColumn("hit", F.array_contains("predicted", F.col("code")))
    employer = ads.withColumn("hit", F.col("employer_code") == F.col("code"))
    out = E.compare_systems({"model": model, "employer": employer}, "d1", "hit")
    return out.withColumn("accuracy", F.round("accuracy", 6))
