"""Queries over vectors and MLlib models, on the embedding and document tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from occupipe.functions import arrays as A
from occupipe.operators import cascade as M
from occupipe.operators import joins as J
from occupipe.operators import split as S
from occupipe.operators import taxonomy as X
from occupipe.operators.groups import lookup, lookup_each
from occupipe.operators.word_vectors import fit_word_vectors
from occupipe.plans.registry import query
from occupipe.session import cut_lineage

LEVELS = {1: "idx_1", 2: "idx_2"}


def coded_vectors(t):
    """Embeddings with a two-digit code: the label, then the id modulo 3."""
    code = F.concat(F.col("label").cast("string"), F.pmod("vec_id", F.lit(3)).cast("string"))
    rows = t.embeddings.select("vec_id", code.alias("code"), F.col("embedding").cast("array<double>").alias("e"))
    coded = rows.withColumn("features", array_to_vector("e"))
    encoding = X.build_encoding(rows, "code").filter("level <= 2")
    for k in LEVELS:
        known = encoding.filter(F.col("level") == k).select(F.col("code").alias(f"_c{k}"), F.col("idx").alias(f"idx_{k}"))
        coded = coded.join(lookup(known), F.substring("code", 1, k) == F.col(f"_c{k}")).drop(f"_c{k}")
    names = {k: M.index_labels(encoding, k) for k in LEVELS}
    return S.random_split(coded, ["vec_id"]), names


def sides(rows):
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


HELD_SQL = "CAST('0x' || substr(md5({key} || '|2021'), 1, 15) AS BIGINT) % 1000000 >= 800000"


def beats_majority(hits, labels, *added):
    """Is the share of hits at least that of the most frequent label? Over (label, hit) rows; columns to add up may follow."""
    sums = [F.sum(c).alias(c) for c in added]
    counted = hits.groupBy(*labels, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), *sums)
    shown = [F.sum("n").alias("n"), F.max("n").alias("majority"), (F.sum("hits") >= F.max("n")).alias("beats_majority")]
    return counted.groupBy(*labels).agg(*shown, *sums)


def majority_sql(rows: str, keys: str = "") -> str:
    """Over (label) rows: how many there are and how many have the most frequent label."""
    by = f"{keys}, " if keys else ""
    own = f" GROUP BY {keys}" if keys else ""
    return f"SELECT {by}CAST(sum(c) AS BIGINT) AS n, max(c) AS majority FROM (SELECT {by}label, count(*) AS c FROM ({rows}) GROUP BY {by}label){own}"


@query(
    "five_level_cascade",
    f"""
    WITH v AS (SELECT vec_id, array_to_string(list_transform(range(1, 6), lambda i: CAST(embedding[i] > 0 AS INT)), '') AS code FROM embeddings)
    SELECT CAST(k AS INT) AS level, n, (SELECT count(DISTINCT code[1:k]) FROM v) AS classes, majority, true AS beats_majority
    FROM ({majority_sql(f"SELECT k, code[1:k] AS label FROM v, range(1, 6) r(k) WHERE {HELD_SQL.format(key='vec_id')}", "k")})
    """,
)
def five_level_cascade(t):
    """All five levels, of codes that spell the signs of five components."""
    e = F.col("embedding").cast("array<double>")
    code = F.concat(*[(F.get(e, F.lit(i)) > 0).cast("int").cast("string") for i in range(5)])
    rows = t.embeddings.select("vec_id", code.alias("code"), array_to_vector(e).alias("features"))
    encoding = X.build_encoding(rows, "code")
    coded = X.encode_labels(rows, "code", encoding)
    train, test = sides(S.random_split(coded, ["vec_id"]))
    levels = {k: f"idx_{k}" for k in range(1, 6)}
    scored = M.fit_cascade(train, "features", levels, max_iter=15).transform(test)
    each = [F.struct(F.lit(k).alias("level"), F.col(c).alias("label"), (F.col(f"pred_{k}") == F.col(c)).cast("int").alias("hit")) for k, c in levels.items()]
    judged = beats_majority(scored.select(F.explode(F.array(*each)).alias("x")).select("x.*"), ["level"])
    widths = encoding.groupBy(F.col("level").cast("int").alias("level")).agg(F.count(F.lit(1)).alias("classes"))
    return judged.join(widths, "level").select("level", "n", "classes", "majority", "beats_majority")


def nested_codes(t, levels=5):
    """Embeddings with five-digit codes that nest: level k has k + 1 codes; and which rows are held out."""
    e = F.col("embedding").cast("array<double>")
    code = F.concat(*[(F.col("label") >= 2 * k + 1).cast("int").cast("string") for k in range(levels)])
    rows = t.embeddings.select("vec_id", code.alias("code"), array_to_vector(e).alias("features"))
    coded = X.encode_labels(rows, "code", X.build_encoding(rows, "code"))
    return S.random_split(coded, ["vec_id"]).withColumn("held", F.col("split") == "test")


@query("boosted_curves")
def boosted_curves(t):
    """Five levels of three trees of depth two, of the 300 of depth ten that are the defaults."""
    labels = {k: f"idx_{k}" for k in range(1, 6)}
    return M.fit_boosted_cascade(nested_codes(t), "features", labels, "held", trees=3, depth=2)[1]


@query("cascade_scores")
def cascade_scores(t):
    rows, names = coded_vectors(t)
    train, test = sides(rows)
    model = M.fit_cascade(train, "features", LEVELS, max_iter=15)
    return M.score_levels(model, test, "vec_id", names, "code", {1: 2, 2: 5})


@query("cascade_of_trees")
def cascade_of_trees(t):
    rows, _ = coded_vectors(t)
    train, test = sides(rows)
    model = M.fit_cascade(train, "features", LEVELS, trees=True, forest=20, depth=6)
    return M.train_and_validation(model, train, test, LEVELS)


@query("training_losses")
def training_losses(t):
    rows, _ = coded_vectors(t)
    train, test = sides(rows)
    return M.train_and_validation(M.fit_cascade(train, "features", LEVELS, max_iter=15), train, test, LEVELS)


@query("flat_baseline")
def flat_baseline(t):
    rows, _ = coded_vectors(t)
    train, test = sides(rows)
    scored = M.fit_flat(train, "features", "idx_2", 15).transform(test)
    return scored.select("vec_id", F.col("idx_2"), F.col("prediction").cast("int").alias("predicted"))


CODED_SQL = "SELECT vec_id, label || CAST(vec_id % 3 AS VARCHAR) AS code, CAST(label AS VARCHAR) AS top FROM embeddings"


@query(
    "flat_baseline_classes",
    f"""
    WITH v AS ({CODED_SQL}) SELECT n, majority, n AS known
    FROM ({majority_sql(f"SELECT code AS label FROM v WHERE {HELD_SQL.format(key='vec_id')}")})
    """,
)
def flat_baseline_classes(t):
    """Held-out rows, how many share the most frequent class, and how many get a class that the taxonomy has.

    Accuracy is not compared: the code's second digit, the id modulo 3, cannot be learnt.
    """
    classes = len(coded_vectors(t)[1][2])
    known = F.count_if(F.col("predicted").between(0, classes - 1)).alias("known")
    by_class = flat_baseline(t).groupBy("idx_2").agg(F.count(F.lit(1)).alias("c"), known)
    return by_class.agg(F.sum("c").alias("n"), F.max("c").alias("majority"), F.sum("known").alias("known"))


@query("class_expanded_baseline")
def class_expanded_baseline(t):
    rows, names = coded_vectors(t)
    train, test = sides(rows)
    expand = lambda df: M.class_expanded(df, "features", len(names[1]), "idx_1")
    scored = M.fit_expanded(expand(train), max_iter=15).transform(expand(test))
    p = F.get(vector_to_array("probability"), F.lit(1))
    return scored.groupBy("vec_id").agg(F.max_by("class", F.struct(p, -F.col("class"))).alias("predicted"))


@query(
    "class_expanded_rows",
    f"""
    WITH v AS ({CODED_SQL}), k AS (SELECT top, row_number() OVER (ORDER BY top) - 1 AS class FROM (SELECT DISTINCT top FROM v))
    SELECT vec_id, CAST(k.class AS INT) AS class, CAST(k.top = v.top AS INT)::DOUBLE AS is_class, 64 + (SELECT count(*) FROM k) AS size,
        round(CAST(list_sum(CAST(embedding AS DOUBLE[])) AS DOUBLE), 6) AS features, CAST(1 AS DOUBLE) AS ones, 65 + k.class AS place
    FROM v JOIN embeddings USING (vec_id), k
    """,
)
def class_expanded_rows(t):
    """The rows that the class-expanded baseline learns from: features, then the row's class as one-hot."""
    rows, names = coded_vectors(t)
    x = vector_to_array("expanded")
    added = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)
    out = M.class_expanded(rows.select("vec_id", "features", "idx_1"), "features", len(names[1]), "idx_1").withColumn("x", x)
    tail = F.slice("x", 65, len(names[1]))
    return out.select(
        "vec_id", "class", "is_class", F.size("x").cast("bigint").alias("size"), F.round(added(F.slice("x", 1, 64)), 6).alias("features"),
        added(tail).alias("ones"), (F.array_position(tail, F.lit(1.0)) + 64).alias("place"),
    )


@query(
    "two_input_features",
    """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    b AS (SELECT vec_id, list_concat(list_transform(range(64, 0, -1), lambda i: 2 * e[i]), e) AS pair FROM v)
    SELECT vec_id, len(pair) AS size, round(list_inner_product(pair, list_transform(range(1, 129), lambda i: CAST(i AS DOUBLE))), 4) AS weighted FROM b
    """,
)
def two_input_features(t):
    e = F.col("embedding").cast("array<double>")
    rows = M.with_vector(t.embeddings.withColumn("t", F.transform(F.reverse(e), lambda x: 2 * x)), "embedding", "features")
    both = M.two_inputs(M.with_vector(rows, "t", "title"), "title", "features", "both").withColumn("both", vector_to_array("both"))
    places = F.transform("both", lambda x, i: x * (i + 1))
    total = F.aggregate(places, F.lit(0.0), lambda acc, x: acc + x)
    return both.select("vec_id", F.size("both").cast("bigint").alias("size"), F.round(total, 4).alias("weighted"))


@query(
    "mean_pooling",
    """
    WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    k AS (SELECT vec_id, e, j, (vec_id + j) % 3 <> 0 AND vec_id % 10 <> 0 AS kept FROM x, range(0, 8) r(j)),
    p AS (SELECT vec_id, d, sum(CASE WHEN kept THEN e[8 * j + d] ELSE 0 END) / greatest(sum(kept::INT), 1e-9) AS m FROM k, range(1, 9) r(d) GROUP BY vec_id, d)
    SELECT vec_id, CAST(d AS INT) AS dim, round(m, 6) AS mean FROM p
    """,
)
def mean_pooling(t):
    # A vector of 64 numbers stands for a sequence of eight tokens of eight numbers each.
    e = F.col("embedding").cast("array<double>")
    numbers = F.sequence(F.lit(0), F.lit(7))
    tokens = F.transform(numbers, lambda j: F.slice(e, j * 8 + 1, 8))
    kept = lambda j: ((F.col("vec_id") + j) % 3 != 0) & (F.col("vec_id") % 10 != 0)
    mask = F.transform(numbers, lambda j: F.when(kept(j), 1.0).otherwise(0.0))
    pooled = t.embeddings.select("vec_id", F.posexplode(M.mean_pooling(tokens, mask, 8)).alias("at", "mean"))
    return pooled.select("vec_id", (F.col("at") + 1).alias("dim"), F.round("mean", 6).alias("mean"))


HEAD_SQL = """
    WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    s AS (SELECT label, i, avg(e[i]) AS x FROM v, range(1, 65) r(i) GROUP BY label, i),
    w AS (SELECT label, list(x ORDER BY i) AS c FROM s GROUP BY label),
    z AS (SELECT vec_id, w.label AS class, list_inner_product(list_transform(e, lambda x: (x - 0.01) / 0.5), c) + 0.1 AS logit FROM v, w),
    p AS (SELECT vec_id, class, exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS p FROM z)
    SELECT vec_id, class, round(p, 6) AS p FROM p
"""


@query("linear_head", HEAD_SQL)
def linear_head(t):
    e = F.col("embedding").cast("array<double>")
    # One weight row per class: a head's size is fixed by the taxonomy, not by the data.
    heads = t.embeddings.groupBy("label").agg(F.array(*[F.avg(F.get(e, F.lit(i))) for i in range(64)]).alias("w"))
    rows = heads.orderBy("label").collect()
    scored = M.linear_head(
        t.embeddings.select("vec_id", e.alias("e")), "e", [r["w"] for r in rows], [0.1] * len(rows), [0.01] * 64, [0.5] * 64
    )
    names = F.array(*[F.lit(r["label"]) for r in rows])
    out = scored.select("vec_id", F.posexplode("probabilities").alias("i", "p"))
    return out.select("vec_id", F.get(names, F.col("i")).alias("class"), F.round("p", 6).alias("p"))


@query("document_vectors")
def document_vectors(t):
    docs = M.text_tokens(t.spread("documents").select("doc_id", "text"), "text").select("doc_id", "tokens")
    out = fit_word_vectors(docs, "tokens", size=16).transform(docs)
    return out.select("doc_id", F.size("tokens").alias("tokens"), F.col("doc_vector").alias("vector"))


@query(
    "document_vectors_from_table",
    r"""
    WITH v AS (SELECT DISTINCT word, CAST(length(word) AS DOUBLE) AS a, CAST(length(word) % 3 AS DOUBLE) AS b FROM
        (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM benchmark)),
    w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents),
    m AS (SELECT doc_id, avg(a) AS a, avg(b) AS b FROM w JOIN v USING (word) GROUP BY doc_id)
    SELECT doc_id, round(coalesce(a, 0), 6) AS a, round(coalesce(b, 0), 6) AS b FROM documents LEFT JOIN m USING (doc_id)
    """,
)
def document_vectors_from_table(t):
    all_words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))
    words = t.benchmark.select(F.explode(all_words("text")).alias("word")).distinct()
    size = F.length("word").cast("double")
    vectors = words.select("word", F.array(size, (F.length("word") % 3).cast("double")).alias("vector"))
    docs = t.documents.select("doc_id", all_words("text").alias("tokens"))
    out = M.mean_of_words(docs, "doc_id", "tokens", vectors, 2)
    return out.select("doc_id", *[F.round(F.get("doc_vector", F.lit(i)), 6).alias(n) for i, n in ((0, "a"), (1, "b"))])


# The leading direction of a symmetric matrix: squared and scaled over and over, it becomes the projection on it.
def leading_sql(matrix: str, name: str) -> str:
    squared = "list_transform(m, lambda r: list_transform(m, lambda s: list_inner_product(r, s)))"
    scaled = "list_transform(q, lambda r: list_transform(r, lambda x: x / list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i][i]))))"
    return f"""{name}_p AS (SELECT 0 AS step, {scaled.replace('q', 'c')} AS m FROM {matrix}
        UNION ALL SELECT step + 1, {scaled} FROM (SELECT step, {squared} AS q FROM {name}_p WHERE step < 18)),
    {name} AS (SELECT list_transform(m[i], lambda x: x / sqrt(m[i][i])) AS d FROM
        (SELECT m, list_position(list_transform(range(1, len(m) + 1), lambda j: m[j][j]), list_max(list_transform(range(1, len(m) + 1), lambda j: m[j][j]))) AS i
        FROM {name}_p WHERE step = 18))"""


@query(
    "vectors_in_plane",
    f"""
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    u AS (SELECT vec_id, i, e[i] - avg(e[i]) OVER (PARTITION BY i) AS x FROM v, range(1, 65) r(i)),
    f AS (SELECT i, list(x ORDER BY vec_id) AS f FROM u GROUP BY i),
    n AS (SELECT a.i, list(list_inner_product(a.f, b.f) / (len(a.f) - 1) ORDER BY b.i) AS r FROM f a, f b GROUP BY a.i),
    one AS (SELECT list(r ORDER BY i) AS c FROM n), {leading_sql('one', 'first')},
    two AS (SELECT list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: c[i][j] - l * d[i] * d[j])) AS c
        FROM (SELECT c, d, list_inner_product(list_transform(c, lambda r: list_inner_product(r, d)), d) AS l FROM one, first)), {leading_sql('two', 'second')}
    SELECT vec_id, round(abs(list_inner_product(e, first.d)), 5) AS x, round(abs(list_inner_product(e, second.d)), 5) AS y FROM v, first, second
    """,
)
def vectors_in_plane(t):
    """Without their signs, which no rule fixes."""
    rows = M.with_vector(t.embeddings, "embedding", "v")
    shown = lambda i: F.round(F.abs(F.get("plane", F.lit(i))), 5)
    return M.to_plane(rows, "v").select("vec_id", shown(0).alias("x"), shown(1).alias("y"))


@query(
    "text_baseline_quality",
    f"""
    WITH codes AS (SELECT lang, row_number() OVER (ORDER BY lang) + 100 AS code FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))
    SELECT n, majority, least(3, (SELECT count(*) FROM codes)) * n AS recoded, true AS beats_majority
    FROM ({majority_sql(f"SELECT CAST(code AS VARCHAR) AS label FROM documents JOIN codes USING (lang) WHERE {HELD_SQL.format(key='doc_id')}")})
    """,
)
def text_baseline_quality(t):
    known = F.size(F.filter("codes", lambda c: c.between("101", "199"))).alias("recoded")
    hits = text_baseline(t).select(F.col("code").alias("label"), F.col("hit").cast("int").alias("hit"), known)
    return beats_majority(hits, [], "recoded")


@query("text_baseline")
def text_baseline(t):
    """Bag model over documents with their language as the label; predictions are recoded by a crosswalk, then held against the new code."""
    docs = t.spread("documents").select("doc_id", "text", "lang").filter(F.col("lang").isNotNull())
    langs = cut_lineage(X.dense_ids(docs.select(F.lit(1).alias("level"), F.col("lang").alias("code")).distinct()))
    crosswalk = langs.select("code", (F.col("idx") + 101).cast("string").alias("new"))
    names = M.index_labels(langs, 1)
    rows = S.random_split(docs.join(lookup(langs.select(F.col("code").alias("lang"), "idx")), "lang"), ["doc_id"])
    train, test = sides(rows)
    scored = M.fit_text_baseline(train, "text", "idx").transform(test)
    best = M.ranked_predictions(scored, 1, names, 3)
    listed = scored.select("doc_id", "lang", F.transform(best, lambda p: p["code"]).alias("old"))
    recoded = lookup_each(listed, F.col("old"), crosswalk, "code", "new", "codes")
    own = J.crosswalk_first(recoded, "lang", crosswalk, "code", "new", "code")
    return own.select("doc_id", "lang", "code", "codes", A.in_first_n(F.col("codes"), F.col("code"), 1).alias("hit"))
