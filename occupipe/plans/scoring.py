"""Queries that score records end to end, and vectors with a model fed in batches."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from occupipe.functions import fixed_values as fixed
from occupipe.operators import cascade as M
from occupipe.operators import scoring as Z
from occupipe.operators import taxonomy as X
from occupipe.plans.extraction import EXTRACTED_SQL, lexicon
from occupipe.plans.registry import query
from occupipe.session import shared_dir, through_table
from occupipe.streaming import stream as ST

LEVELS = range(1, 6)
TOP_SQL = f"CASE k {' '.join(f'WHEN {k} THEN {n}' for k, n in fixed.TOP_N.items())} END"


@query(
    "level_predictions",
    f"""
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, array_to_string(list_transform(range(1, 6), lambda i: CAST(embedding[i] > 0 AS INT)), '') AS own FROM embeddings),
    s AS (SELECT k, own[1:k] AS code, i, avg(e[i]) AS x FROM v, range(1, 6) l(k), range(1, 65) r(i) GROUP BY ALL),
    w AS (SELECT k, code, list(x ORDER BY i) AS c FROM s GROUP BY ALL),
    z AS (SELECT vec_id, own, k, code, exp(list_inner_product(list_transform(e, lambda x: (x - 0.01) / 0.5), c) + 0.1) AS z FROM v, w),
    p AS (SELECT *, z / sum(z) OVER (PARTITION BY vec_id, k) AS p FROM z),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, k ORDER BY p DESC, code DESC) AS rank FROM p QUALIFY rank <= {TOP_SQL})
    SELECT vec_id, CAST(k AS INT) AS level, CAST(rank AS INT) AS rank, code, round(p, 6) AS proba,
        bool_or(code = own[1:k]) OVER (PARTITION BY vec_id, k) AS hit FROM r
    """,
)
def level_predictions(t):
    """Heads of five levels, opened once a worker and fed in batches; ranked, decoded and held against the label."""
    e = F.col("embedding").cast("array<double>")
    own = F.concat(*[(F.get("e", F.lit(i)) > 0).cast("int").cast("string") for i in range(5)])
    rows = t.embeddings.select("vec_id", e.alias("e")).withColumn("own", own)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.substring("own", 1, k).alias("code")) for k in LEVELS]))
    heads = rows.select("e", each.alias("c")).groupBy("c").agg(F.array(*[F.avg(F.get("e", F.lit(i))) for i in range(64)]).alias("w"))
    # One weight row per class: a head's size is fixed by the taxonomy, not by the data.
    known = heads.select("c.*", "w").orderBy("level", "code").collect()
    names = {k: [r["code"] for r in known if r["level"] == k] for k in LEVELS}
    weights = {k: np.array([r["w"] for r in known if r["level"] == k]) for k in LEVELS}
    shared = t.spark.sparkContext.broadcast(weights)

    def load():
        weights = shared.value
        return Z.softmax_heads(weights, {k: np.full(len(w), 0.1) for k, w in weights.items()}, np.full(64, 0.01), np.full(64, 0.5))

    scored = Z.probabilities_in_batches(rows, "e", 64, load, LEVELS)
    ranked = M.ranked_levels(scored, ["vec_id"], names, "own")
    shown = [F.struct(F.lit(k).alias("level"), F.col(f"hit_{k}").alias("hit"), F.col(f"level_{k}").alias("best")) for k in LEVELS]
    listed = ranked.select("vec_id", F.explode(F.array(*shown)).alias("x")).select("vec_id", "x.level", "x.hit", F.posexplode("x.best").alias("at", "p"))
    return listed.select("vec_id", "level", (F.col("at") + 1).alias("rank"), "p.code", F.round("p.proba", 6).alias("proba"), "hit")


#: A page's code tells which of these its markup holds, one digit each.
SIGNS = ["that", "elle", "blog", "with", "from"]
CODES_SQL = " || ".join(f"CAST(contains(lower(html), '{w}') AS INT)" for w in SIGNS)


@query(
    "scored_pages",
    f"""
    SELECT page_id, coalesce(cleaned, '') AS tasks, coalesce(cleaned, '') <> '' AS has_tasks, least(10, classes) AS predictions,
        least(10, classes) AS titled, {' + '.join(f'least({fixed.TOP_N[k]}, classes_{k})' for k in LEVELS)} AS codes, true AS streamed
    FROM ({EXTRACTED_SQL}), (SELECT count(DISTINCT code) AS classes, {', '.join(f'count(DISTINCT code[1:{k}]) AS classes_{k}' for k in LEVELS)}
        FROM (SELECT {CODES_SQL} AS code FROM pages))
    """,
)
def scored_pages(t):
    """Page to task text to five levels to titled predictions, by a saved pipeline; the stream's rows are held against the table's."""
    code = F.concat(*[F.contains(F.lower("html"), F.lit(w)).cast("int").cast("string") for w in SIGNS])
    pages = t.spread("pages", "page_id", "html")
    coded = through_table(pages.withColumn("code", code))
    encoding = X.build_encoding(coded, "code")
    names = {k: M.index_labels(encoding, k) for k in LEVELS}
    labelled = X.encode_labels(coded, "code", encoding)
    taxonomy = encoding.filter("level = 5").select(
        "code", F.concat(F.lit("class "), "code").alias("title"), F.concat(F.lit("pages of "), "code").alias("definition")
    )
    verbs = [r["word"] for r in lexicon(t).orderBy("word").collect()]
    saved, path = shared_dir(t.spark), shared_dir(t.spark)
    Z.fit_scoring(labelled, "html", {k: f"idx_{k}" for k in LEVELS}, verbs, features=1 << 10, max_iter=10).save(saved)
    model = PipelineModel.load(saved)
    score = lambda df: Z.score_records(model, df, "page_id", [], names, taxonomy)
    stream = score(t.stream("pages").select("page_id", "html"))
    ST.run_all(lambda: ST.append_final(stream, path, shared_dir(t.spark)))
    streamed = t.spark.read.schema(stream.schema).parquet(path)
    same = F.struct([F.col(f"b.{c}") for c in stream.columns]).eqNullSafe(F.struct([F.col(f"s.{c}") for c in stream.columns]))
    both = score(pages).alias("b").join(streamed.alias("s"), F.col("b.page_id") == F.col("s.page_id"), "full")
    all_shown = F.concat(F.array("b.top_prediction"), F.col("b.other_predictions"))
    right = lambda p: (p["title"] == F.concat(F.lit("class "), p["code"])) & (p["description"] == F.concat(F.lit("pages of "), p["code"]))
    return both.select(
        "b.page_id",
        "b.tasks",
        (F.col("b.tasks") != "").alias("has_tasks"),
        F.size(all_shown).cast("bigint").alias("predictions"),
        F.size(F.filter(all_shown, right)).cast("bigint").alias("titled"),
        sum((F.size(f"b.level_{k}") for k in LEVELS), F.lit(0)).cast("bigint").alias("codes"),
        same.alias("streamed"),
    )
