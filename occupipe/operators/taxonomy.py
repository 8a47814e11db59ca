"""The code taxonomy: level encodings, ancestors, hits and nested results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occupipe.functions import arrays as A
from occupipe.functions import codes as K
from occupipe.functions import text as T
from occupipe.operators.groups import LOOKUP_LIMIT, is_small, lookup, lookup_each
from occupipe.session import cut_lineage

CODES_EACH = 10_000


def level_codes(df: DataFrame, code: str) -> DataFrame:
    """Distinct prefixes per level: level, code."""
    per_level = F.explode(
        F.array(*[F.struct(F.lit(k).alias("level"), K.level(F.col(code), k).alias("code")) for k in K.LEVELS])
    )
    return df.select(per_level.alias("e")).select("e.level", "e.code").distinct()


def dense_ids(distinct_codes: DataFrame) -> DataFrame:
    """Sorted codes numbered from 0 within each level.

    One task numbers one level; a level has at most as many codes as the taxonomy.
    """
    w = Window.partitionBy("level").orderBy("code")
    return distinct_codes.withColumn("idx", F.row_number().over(w) - 1)


def build_encoding(taxonomy: DataFrame, code: str) -> DataFrame:
    """Long encoding table: level, code, idx."""
    return dense_ids(level_codes(taxonomy.filter(F.col(code).isNotNull()), code))


def encoding_to_json(encoding: DataFrame, codes_each: int = CODES_EACH) -> DataFrame:
    """The two nested maps of an encoding as JSON documents, one per level and range of ``codes_each`` indices."""
    by_code = F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "idx"))))
    by_idx = F.map_from_entries(F.array_sort(F.collect_list(F.struct("idx", "code"))))
    part = F.floor(F.col("idx") / codes_each).cast("int").alias("part")
    grouped = encoding.groupBy("level", part).agg(by_code.alias("code_idx"), by_idx.alias("idx_code"))
    return grouped.select("level", "part", F.to_json(F.struct("code_idx", "idx_code")).alias("encoding"))


def encoding_from_json(documents: DataFrame, column: str = "encoding") -> DataFrame:
    """Read encoding documents back; index keys become integers again."""
    parsed = F.from_json(column, "struct<code_idx:map<string,int>,idx_code:map<string,string>>")
    return documents.select("level", F.explode(parsed["idx_code"]).alias("idx", "code")).select(
        "level", "code", F.col("idx").cast("int").alias("idx")
    )


def encode_labels(df: DataFrame, code: str, encoding: DataFrame, limit: int = LOOKUP_LIMIT) -> DataFrame:
    """Add ``idx_1`` to ``idx_5``; an unknown prefix gives null. Null codes are dropped.

    The encoding is computed and counted once; a small one is looked up in the map tasks, level
    by level. A large one meets the distinct codes of the rows, and the rows are joined once.
    """
    out = df.filter(F.col(code).isNotNull())
    written = cut_lineage(encoding)
    if not is_small(written, limit):
        prefixes = F.array(*[F.struct(F.lit(k).alias("level"), K.level(F.col(code), k).alias("code")) for k in K.LEVELS])
        asked = out.select(F.col(code).alias("_label"), F.explode(prefixes).alias("_e")).distinct().select("_label", "_e.*")
        wide = asked.join(written, ["level", "code"]).groupBy("_label").agg(
            *[F.max(F.when(F.col("level") == k, F.col("idx"))).alias(f"idx_{k}") for k in K.LEVELS]
        )
        return out.join(wide, F.col(code) == F.col("_label"), "left").drop("_label")
    for k in K.LEVELS:
        known = written.filter(F.col("level") == k).select(
            F.col("code").alias(f"_c{k}"), F.col("idx").alias(f"idx_{k}")
        )
        out = out.join(F.broadcast(known), K.level(F.col(code), k) == F.col(f"_c{k}"), "left").drop(f"_c{k}")
    return out


def unknown_counts(encoded: DataFrame) -> DataFrame:
    """Rows without an index, per level."""
    return encoded.agg(*[F.count_if(F.col(f"idx_{k}").isNull()).alias(f"unknown_{k}") for k in K.LEVELS])


def decode(df: DataFrame, level: int, idx: str, encoding: DataFrame, code: str = "code") -> DataFrame:
    """Add the code of an index; an unknown index gives null."""
    known = encoding.filter(F.col("level") == level).select(
        F.col("idx").alias("_i"), F.col("code").alias(code)
    )
    return df.join(lookup(known), F.col(idx) == F.col("_i"), "left").drop("_i")


def prefix_hit(predicted: Column, label: Column) -> Column:
    """Is any predicted code the prefix of the label? Null without a label."""
    hit = F.exists(predicted, lambda c: c == F.substring(label, F.lit(1), F.length(c)))
    return F.when(label.isNotNull(), hit)


def apply_others(
    df: DataFrame, predictions: str, threshold: float, taxonomy: DataFrame, out: str = "converted"
) -> DataFrame:
    """Replace unsure predictions by the residual code, where the taxonomy has one.

    ``predictions`` is an array, of any length, of (code, proba) of one level; ``out`` holds
    the same with ``changed`` added. One-digit codes and codes that end in 9 stay.
    """
    residual = taxonomy.select("code").filter(F.endswith("code", F.lit("9"))).distinct()
    residual = residual.withColumn("_residual", F.col("code"))

    def candidate(p: Column) -> Column:
        unsure = (p["proba"] < threshold) & (F.right(p["code"], F.lit(1)) != "9") & (F.length(p["code"]) > 1)
        return F.when(unsure, K.others(p["code"]))

    wanted = F.transform(predictions, candidate)
    found = lookup_each(df, wanted, residual, "code", "_residual", "_found", apart=True)
    converted = F.zip_with(
        predictions,
        "_found",
        lambda p, r: F.struct(
            F.coalesce(r, p["code"]).alias("code"), p["proba"].alias("proba"), r.isNotNull().alias("changed")
        ),
    )
    return found.withColumn(out, converted).drop("_found")


def prefix_matrix(taxonomy: DataFrame, code: str) -> DataFrame:
    """Sparse ancestor table: each five-digit code with every taxonomy node above it.

    A code's possible ancestors are its own prefixes, so this is an equi-join.
    """
    leaves = taxonomy.filter(F.length(code) == 5).select(F.col(code).alias("leaf"))
    nodes = taxonomy.select(F.col(code).alias("node")).distinct()
    prefixes = leaves.select("leaf", F.explode(F.array(*[K.level(F.col("leaf"), k) for k in K.LEVELS])).alias("node"))
    return prefixes.join(lookup(nodes), "node").select("leaf", "node")


def parent_tasks(taxonomy: DataFrame, code: str = "code") -> DataFrame:
    """Five-digit rows with the tasks of their four-digit parent appended to the definition."""
    parents = taxonomy.filter(F.length(code) == 4).select(
        F.col(code).alias("_parent"), F.col("tasks").alias("parent_tasks")
    )
    leaves = taxonomy.filter((F.length(code) == 5) & K.is_real(F.col(code)))
    joined = leaves.join(lookup(parents), K.level(F.col(code), 4) == F.col("_parent"), "left")
    return joined.select(
        code, "title", F.concat("definition", F.lit(" "), "parent_tasks").alias("description")
    )


def definitions_as_rows(ads: DataFrame, taxonomy: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Ads plus one row per five-digit definition, whose id is null.

    ``columns`` names the id, code, title and text columns of the ads.
    """
    extra = taxonomy.filter((F.length("code") > 4) & K.not_x_group(F.col("code"))).select(
        F.lit(None).cast(ads.schema[columns["id"]].dataType).alias(columns["id"]),
        F.col("code").cast("string").alias(columns["code"]),
        F.col("title").alias(columns["title"]),
        F.col("definition").alias(columns["text"]),
    )
    return ads.select(*columns.values()).unionByName(extra.select(*columns.values()))


def prediction_table(df: DataFrame, key: str, label: str, codes4: str, codes5: str) -> DataFrame:
    """Top code per level and the hits at 1, 5 and 10."""
    return df.select(
        key,
        label,
        F.get(codes4, F.lit(0)).alias("top_4d"),
        F.get(codes5, F.lit(0)).alias("top_5d"),
        F.array_join(codes4, ",").alias("top_5_4d"),
        F.array_join(codes5, ",").alias("top_10_5d"),
        (K.level(F.col(label), 4) == F.get(codes4, F.lit(0))).alias("hit_4d_at_1"),
        prefix_hit(F.col(codes4), F.col(label)).alias("hit_4d_at_5"),
        (F.col(label) == F.get(codes5, F.lit(0))).alias("hit_5d_at_1"),
        A.in_first_n(F.col(codes5), F.col(label), 5).alias("hit_5d_at_5"),
        prefix_hit(F.col(codes5), F.col(label)).alias("hit_5d_at_10"),
    )


def nested_result(
    df: DataFrame,
    key: str,
    fields: Sequence[str],
    predictions: str,
    taxonomy: DataFrame,
    n: int = 10,
    require_titles: bool = False,
) -> DataFrame:
    """Record fields, the top prediction with title and confidence, and the next ones.

    ``predictions`` is an array of (code, proba), best first. A code without a title
    keeps a null title, or is an error with ``require_titles``.
    """
    titled = taxonomy.select("code", F.struct("title", "definition").alias("_title"))
    best = df.withColumn("_best", F.slice(predictions, 1, n))
    codes = F.transform("_best", lambda p: p["code"])
    found = lookup_each(best, codes, titled, "code", "_title", "_titles")

    def entry(p: Column, t: Column) -> Column:
        if require_titles:
            missing = F.raise_error(F.concat(F.lit("no title for code "), p["code"]))
            title = F.when(t.isNull(), missing.cast("string")).otherwise(t["title"])
        else:
            title = t["title"]
        return F.struct(
            p["code"].alias("code"),
            title.alias("title"),
            t["definition"].alias("description"),
            T.percent(p["proba"]).alias("confidence"),
        )

    listed = found.withColumn("_all", F.zip_with("_best", "_titles", entry))
    return listed.select(
        key,
        *fields,
        F.get("_all", F.lit(0)).alias("top_prediction"),
        F.slice("_all", 2, n).alias("other_predictions"),
    )


def with_min_proba(predictions: Column, level: int, floors: Mapping[int, float] | None = None) -> Column:
    """Optional probability floor per level; without floors nothing is dropped."""
    if not floors or level not in floors:
        return predictions
    return F.filter(predictions, lambda p: p["proba"] >= floors[level])

