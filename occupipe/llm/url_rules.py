"""URL rules by hashed expressions (operator 13), in DataFrame functions only.

A rule is a host, a path and a verdict. It fits a url whose host is the rule's or a subdomain
of it and whose path starts with the rule's. So a url is expanded into expressions: its host
and the host's suffixes at dots, each with the prefixes of its path at slashes and at the
lengths of those rule paths that end elsewhere. Suffixes and prefixes longer than any rule's
are left out, so a url has a bounded number of expressions however long it is.

The expressions are joined to the rules' by the first four bytes of their SHA-256, which rules
can be shipped by; an equal full digest then confirms the rule. Of the rules that fit, the
longest by host and path wins; of equally long ones the longer host, and a block comes before
an allow. Each distinct host and path is expanded once, whatever the number of its urls.

Defined results: a null url and one without ``://`` have an empty host and path; a url that no
rule fits has a null rule and the verdict ``otherwise``. Rules with a null or empty host, a
null path or a null verdict fit nothing; a rule stated twice counts once. Repeated rows stay
repeated; an empty table gives no rows and an empty list of rules fits nothing. All columns of
the table are kept but those called host, path, rule and verdict, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occupipe.llm.common import col
from occupipe.operators.groups import lookup
from occupipe.session import through_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHIPPED = 4
RULES_SENT = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://`` with A-Z lower-cased, and the path up to a query or fragment."""
    begun = F.locate("://", url)
    rest = F.when(begun > 0, url.substr(begun + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    # A line feed cannot move between host and path unnoticed, since the host's length is hashed too.
    return F.unhex(F.sha2(F.concat_ws("\n", F.length(host).cast("string"), host, path), 256))


def host_suffixes(host: Column, labels: int) -> Column:
    """The host's last 1, 2, ... labels, up to ``labels`` of them."""
    found = F.size(F.split(host, "[.]"))
    counts = F.sequence(F.lit(1), F.least(found, F.lit(labels)))
    return F.transform(counts, lambda n: F.call_function("substring_index", host, F.lit("."), -n))


def path_prefixes(path: Column, longest: int, lengths: list[int]) -> Column:
    """The path's prefixes that end in a slash or have one of the lengths, up to ``longest`` characters."""
    head = path.substr(1, longest)
    slashes = F.size(F.split(head, "/")) - 1
    at_slashes = F.when(
        slashes > 0, F.transform(F.sequence(F.lit(1), slashes), lambda n: F.concat(F.call_function("substring_index", head, F.lit("/"), n), F.lit("/")))
    ).otherwise(F.array().cast("array<string>"))
    if not lengths:
        return at_slashes
    cut = F.array(*[F.when(F.length(path) >= n, path.substr(1, n)) for n in lengths])
    return F.array_distinct(F.concat(at_slashes, F.filter(cut, F.isnotnull)))


def judge(
    pages: DataFrame, rules: DataFrame, otherwise: str = "allow", url: str = "url", rules_sent: int = RULES_SENT
) -> DataFrame:
    """``pages`` with ``host``, ``path``, the winning ``rule`` and its ``verdict``.

    ``rules`` has the columns host, path and verdict. Up to ``rules_sent`` of them go to every
    task; more are joined by shuffle.
    """
    stated = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    stated = stated.filter("rule_host <> '' and rule_path is not null and verdict is not null")
    stated = through_table(stated.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict")))
    ragged = F.when(~F.col("rule_path").endswith("/"), F.length("rule_path"))
    labels, longest, lengths = stated.agg(
        F.max(F.size(F.split("rule_host", "[.]"))), F.max(F.length("rule_path")), F.collect_set(ragged)
    ).first()
    host, path = host_and_path(col(url))
    parsed = pages.withColumns({"host": host, "path": path})
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    if labels is None:
        return parsed.select(*map(col, kept), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))

    # One row for each distinct host and path: copies meet in the map tasks.
    distinct = parsed.select("host", "path").filter("host <> ''").distinct()
    suffixed = distinct.withColumn("suffix", F.explode(host_suffixes(F.col("host"), labels)))
    spread = suffixed.withColumn("prefix", F.explode(path_prefixes(F.col("path"), longest, sorted(lengths))))
    asked = spread.withColumn("digest", _digest(F.col("suffix"), F.col("prefix"))).drop("suffix", "prefix")
    asked = asked.withColumn("short", F.substring("digest", 1, SHIPPED))
    full = _digest(F.col("rule_host"), F.col("rule_path"))
    sent = stated.withColumn("full", full).withColumn("short", F.substring("full", 1, SHIPPED))
    hits = asked.join(lookup(sent, rules_sent), "short").filter(F.col("digest") == F.col("full"))
    name = F.concat("rule_host", "rule_path")
    order = F.struct(
        F.length(name).alias("length"), F.length("rule_host").alias("host_length"),
        F.col("verdict").alias("verdict"), name.alias("rule"),
    )
    best = hits.groupBy(F.col("host").alias("_h"), F.col("path").alias("_p")).agg(F.max(order).alias("_best"))
    # Written first, so that the join has a shuffle of its own and the many rows of one url can be split.
    best = through_table(best.select("_h", "_p", F.col("_best.rule").alias("_rule"), F.col("_best.verdict").alias("_verdict")))
    taken = {c: f"_page_{i}" for i, c in enumerate(kept)}
    rows = parsed.select(*[col(c).alias(n) for c, n in taken.items()], "host", "path")
    judged = rows.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return judged.select(
        *[F.col(n).alias(c) for c, n in taken.items()], "host", "path",
        F.col("_rule").alias("rule"), F.coalesce("_verdict", F.lit(otherwise)).alias("verdict"),
    )
