"""Evaluation: counts, coverage, accuracy, curves and losses.

Each is a hash aggregate with partial aggregation in the map tasks, so a frequent code
costs one partial row per task. Windows run over aggregated rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occupipe.functions import arrays as A
from occupipe.functions import codes as K
from occupipe.functions import fixed_values as fixed
from occupipe.functions import text as T


def counts_at_level(df: DataFrame, code: str, k: int) -> DataFrame:
    return df.groupBy(K.level(F.col(code), k).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def count_of(df: DataFrame, code: str, column: str) -> DataFrame:
    """Non-null values of a column per code."""
    return df.groupBy(code).agg(F.count(column).alias("n"))


def coverage(counts: DataFrame, few: int = 10) -> DataFrame:
    """Codes with no rows and with fewer than ``few``."""
    return counts.agg(
        F.count(F.lit(1)).alias("codes"),
        F.count_if(F.col("n") == 0).alias("without_rows"),
        F.count_if(F.col("n") < few).alias("with_few_rows"),
    )


def rounded_percent(part: Column, whole: Column) -> Column:
    """Percentage to one place, ties to even."""
    return F.bround(part / whole * 100, 1)


def accuracy_by_code(df: DataFrame, code: str, hit: str, title: str) -> DataFrame:
    summed = df.groupBy(code).agg(
        F.count_if(hit).alias("hits"),
        F.min(title).alias("title"),
        F.min(K.level(F.col(code), 1)).alias("d1"),
        F.count(hit).alias("n"),
    )
    return summed.withColumn("accuracy", rounded_percent(F.col("hits"), F.col("n")))


def accuracy_by_prefix(per_code: DataFrame, code: str, k: int, at_least: int, good: float = 90.0) -> DataFrame:
    """Mean accuracy per prefix over codes with enough rows, and a band."""
    return (
        per_code.filter(F.col("n") >= at_least)
        .groupBy(K.level(F.col(code), k).alias("prefix"))
        .agg(F.avg("accuracy").alias("accuracy"), F.sum("n").alias("n"))
        .withColumn("band", F.when(F.col("accuracy") >= good, "good").otherwise("poor"))
    )


def shares(df: DataFrame, column: str) -> DataFrame:
    """Value counts divided by the total."""
    known = df.filter(F.col(column).isNotNull())
    counted = known.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    # Counted first, so that the distinct values are not gathered in one task for their sum.
    return counted.withColumn("share", F.col("n") / F.lit(known.count()))


def group_percent(df: DataFrame, group: str, flag: str) -> DataFrame:
    """Percent of a group's rows with the flag set; 0 for a group without any."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.col(flag).cast("int")) * 100).alias("percent")
    )


def accuracy(df: DataFrame, hit: str) -> DataFrame:
    return df.agg(F.avg(F.col(hit).cast("int")).alias("accuracy"))


def accuracy_per_level(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy of the top code at levels 1 to 5, in one pass."""
    hits = [
        F.avg((K.level(F.col(label), k) == K.level(F.col(predicted), k)).cast("int")).alias(f"l{k}")
        for k in K.LEVELS
    ]
    wide = df.agg(*hits)
    pairs = F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"l{k}").alias("accuracy")) for k in K.LEVELS])
    return wide.select(F.inline(pairs))


def accuracy_rollup(df: DataFrame, label: str, hit: str, depth: int = 2) -> DataFrame:
    """Accuracy per prefix with subtotals up to the whole."""
    prefixes = [K.level(F.col(label), k).alias(f"d{k}") for k in range(1, depth + 1)]
    keyed = df.select(*prefixes, hit)
    return keyed.rollup(*[f"d{k}" for k in range(1, depth + 1)]).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(hit).cast("int")).alias("accuracy")
    )


def digit_heatmap(df: DataFrame, code: str, digits: Sequence[str]) -> DataFrame:
    """First digit by second digit: log2 of the count, 0 where there is none."""
    split = df.select(K.level(F.col(code), 1).alias("d1"), F.substring(code, 2, 1).alias("d2"))
    wide = split.groupBy("d1").pivot("d2", list(digits)).agg(F.count(F.lit(1)))
    return wide.select("d1", *[A.log2_or_zero(F.coalesce(F.col(d), F.lit(0))).alias(f"rest_{d}") for d in digits])


def heatmap_rows(counts: DataFrame, code: str) -> DataFrame:
    """The same matrix over all remaining digits, one row per cell."""
    return counts.select(
        K.level(F.col(code), 1).alias("d1"),
        K.remainder(F.col(code)).alias("rest"),
        F.col("n"),
        A.log2_or_zero(F.col("n")).alias("log2_n"),
    )


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    cells = df.groupBy(F.col(label).alias("_l"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("_l").alias("class"), F.col("_n").alias("support"), F.lit(0).cast("long").alias("picked")),
                F.struct(F.col("_p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("_n").alias("picked")),
            )
        ).alias("e"),
        F.when(F.col("_l") == F.col("_p"), F.col("_n")).otherwise(0).alias("_hit"),
    )
    # A diagonal cell appears on both sides, so its hits are counted twice and halved.
    sums = sides.groupBy("e.class").agg(
        F.sum("e.support").alias("support"),
        F.sum("e.picked").alias("_picked"),
        (F.sum("_hit") / 2).alias("_hit"),
    )
    rate = lambda whole: F.coalesce(F.col("_hit") / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))
    out = sums.select("class", rate("_picked").alias("precision"), rate("support").alias("recall"), "support")
    both = F.col("precision") + F.col("recall")
    return out.withColumn(
        "f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0)), F.lit(0.0))
    )


def weighted_loss(df: DataFrame, p_true: dict[int, str], weights: dict[int, float] = fixed.LEVEL_LOSS_WEIGHTS) -> DataFrame:
    """Sum over levels of weight times mean negative log probability of the true class.

    A probability of 0 counts as ``fixed.PROBABILITY_FLOOR``; its logarithm would be null and
    the worst rows would drop out of the mean.
    """
    floor = F.lit(fixed.PROBABILITY_FLOOR)
    terms = [F.avg(-F.ln(F.greatest(F.when(F.col(c).isNotNull(), floor), F.col(c)))) * weights[k] for k, c in p_true.items()]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return df.agg(total.alias("loss"))


def perplexity(df: DataFrame, nll: str) -> DataFrame:
    return df.agg(F.exp(F.avg(nll)).alias("perplexity"))


def tag_conflicts(tags: DataFrame, row_id: str, code: str) -> DataFrame:
    """Row ids tagged with more than one code."""
    return (
        tags.groupBy(row_id)
        .agg(F.count_distinct(code).alias("codes"), F.min(code).alias("first_code"), F.max(code).alias("last_code"))
        .filter(F.col("codes") > 1)
    )


def resolve_conflicts(tags: DataFrame, row_id: str, code: str, priority: str) -> DataFrame:
    """One code per row id: the highest priority, then the lowest code."""
    best = F.max_by(F.struct(code), F.struct(F.col(priority)))
    ordered = tags.groupBy(row_id, priority).agg(F.min(code).alias(code))
    return ordered.groupBy(row_id).agg(best[code].alias(code))


def extraction_coverage(df: DataFrame, text: str) -> DataFrame:
    """Percent of documents with a non-empty result."""
    found = F.coalesce(F.length(text) > 0, F.lit(False))
    return df.agg((F.avg(found.cast("int")) * 100).alias("percent"))


def profile(df: DataFrame, code: str) -> DataFrame:
    rows = F.count(F.lit(1))
    classes = F.count_distinct(code)
    return df.agg(rows.alias("n"), classes.alias("classes"), (rows / classes).alias("rows_per_class"))


def top_n_curve(df: DataFrame, group: str, label: str, predicted: str, n: int = 10) -> DataFrame:
    """Percent of rows whose label is among the first 1, 2, .. n predictions, per group.

    All points come from one aggregate; the long form is made from its few rows.
    """
    at = F.array_position(predicted, F.col(label))
    points = [(F.avg(at.between(1, i).cast("int")) * 100).alias(f"at_{i}") for i in range(1, n + 1)]
    wide = df.groupBy(group).agg(*points)
    long = F.array(*[F.struct(F.lit(i).alias("n"), F.col(f"at_{i}").alias("percent")) for i in range(1, n + 1)])
    return wide.select(group, F.inline(long))


def cost_summary(costs: DataFrame, group: str) -> DataFrame:
    """Mean over rows of the average, lowest and top-two average cost."""
    usable = F.filter("costs", lambda c: c.isNotNull())
    per_row = costs.select(
        group,
        A.mean(usable).alias("_mean"),
        F.array_min(usable).alias("_min"),
        A.mean(A.first_n(usable, 2)).alias("_two"),
    )
    return per_row.groupBy(group).agg(
        F.avg("_mean").alias("mean_cost"), F.avg("_min").alias("lowest_cost"), F.avg("_two").alias("top_two_cost")
    )


def compare_systems(systems: dict[str, DataFrame], group: str, hit: str) -> DataFrame:
    """Accuracy of several systems per group, from one aggregate over their union."""
    parts = [df.select(group, hit).withColumn("system", F.lit(name)) for name, df in systems.items()]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked.groupBy("system", group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(hit).cast("int")).alias("accuracy")
    )


def null_audit(df: DataFrame) -> DataFrame:
    """Nulls per column and in total, as one row."""
    per_column = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    out = df.agg(*per_column)
    total = F.col(df.columns[0])
    for c in df.columns[1:]:
        total = total + F.col(c)
    return out.withColumn("total", total)


def titles_per_code(taxonomy: DataFrame, title: str, under: str, elsewhere: str) -> DataFrame:
    """Distinct lowercase titles of each code, as rows: code, title.

    A code's own title, those listed under it, and those that other codes list as
    classified here. Rows rather than arrays, since one code may have any number.
    """
    own = taxonomy.select(
        "code", F.explode(F.concat(F.array(F.lower(title)), F.coalesce(T.listed_titles(F.col(under)), F.array().cast("array<string>")))).alias("title")
    )
    moved = taxonomy.select(F.explode(T.elsewhere_entries(F.col(elsewhere))).alias("e")).select("e.code", "e.title")
    return own.unionByName(moved).filter(F.col("title") != "").distinct()


def predicted_rank(predicted: Column, label: Column) -> Column:
    return A.rank_of(predicted, label)
