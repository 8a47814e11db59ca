"""HTML extraction: lists, paragraph lists, verb paragraphs, sections and links.

A document is one row, so its blocks are found inside that row, lists by one scan with a
stack (``functions/tag_scan.py``) and all else with array functions. No shuffle regroups a
document's pieces, however many documents there are: the whole extraction is one narrow stage.

Known differences from a DOM parser: a ``p`` closes at the next block tag rather than
nesting when left open, and only the entities in ``fixed_values`` are decoded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occupipe.functions import fixed_values as fixed
from occupipe.functions import tag_scan
from occupipe.functions import text as T
from occupipe.functions.binding import let
from occupipe.operators.groups import is_small, lookup_each

# Tags at which an open paragraph ends.
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|details|div|dl|fieldset|figcaption|figure|"
    "footer|form|h1|h2|h3|h4|h5|h6|header|html|li|main|menu|nav|ol|p|pre|section|table|"
    "td|th|tr|ul"
)
TOKEN = "<[^>]*>|[^<]+"
LEXICON_LIMIT = 50_000


def without_scripts(html: Column) -> Column:
    """Drop script and style content and comments, whose tags are not markup."""
    html = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")


def tokens(html: Column) -> Column:
    """Tags and text runs in document order."""
    return F.regexp_extract_all(without_scripts(html), F.lit(TOKEN), F.lit(0))


def token_rows(df: DataFrame, key: str, html: str) -> DataFrame:
    """One row per tag or text run: key, pos, token."""
    return df.select(key, F.posexplode(tokens(F.col(html))).alias("pos", "token"))


def rewritten(html: Column) -> Column:
    """Extracted markup as a parser prints it back: closed breaks, decoded entities."""
    html = F.regexp_replace(html, r"(?i)<br\s*/?>", "<br/>")
    for entity, char in fixed.ENTITIES.items():
        html = F.replace(html, F.lit(entity), F.lit(char))
    return html


def markup(html: Column) -> Column:
    """The prepared text that lists and paragraphs are cut from."""
    return rewritten(without_scripts(html))


def _cut_at(html: Column, tags: str) -> Column:
    """Split before every opening or closing tag of the given names."""
    return F.split(html, rf"(?i)(?=</?(?:{tags})\b)")


def html_lists(markup: Column) -> Column:
    """``ol`` and ``ul`` blocks as an array of item arrays, in document order.

    A nested list is a list of its own, and its items also count in every list around it.
    """
    return tag_scan.html_lists(markup)


def paragraphs(markup: Column) -> Column:
    """``p`` elements in document order, each closed at the next block tag."""
    pieces = _cut_at(markup, BLOCK_TAGS)
    opened = F.filter(pieces, lambda p: p.rlike(r"(?i)^<p\b"))
    return F.transform(opened, lambda p: F.concat(p, F.lit("</p>")))


def paragraph_lists(markup: Column) -> Column:
    """Runs of consecutive bulleted paragraphs, as an array of item arrays."""
    return tag_scan.paragraph_lists(markup, BLOCK_TAGS)


def first_word(cleaned: Column) -> Column:
    """The word that the verb test looks up, after ``you are`` is taken off."""
    rest = let(F.lower(cleaned), lambda low: T.remove_prefix(low, fixed.ADDRESS_PREFIXES))
    return F.regexp_extract(rest, r"(?U)^([^\s\x1c-\x1f]*)", 1)


def verb_test(cleaned: Column, in_lexicon: Column) -> Column:
    """Override lists first, then the lexicon's answer for the first word."""
    opening = F.lower(F.substring_index(cleaned, " ", 1))
    return (
        F.when(F.length(cleaned) == 0, False)
        .when(opening.isin(fixed.NOT_VERBS), False)
        .when(opening.isin(fixed.VERBS), True)
        .otherwise(F.coalesce(in_lexicon, F.lit(False)))
    )


def small_lexicon(lexicon: DataFrame, word: str = "word") -> list[str] | None:
    """The lexicon's words if there are at most ``LEXICON_LIMIT`` of them, else None."""
    words = lexicon.select(F.lower(word).alias("w")).filter(F.col("w").isNotNull()).distinct()
    return sorted(row["w"] for row in words.collect()) if is_small(words, LEXICON_LIMIT) else None


def starts_with_verb(cleaned: Column, verbs: Sequence[str] | Column) -> Column:
    """Verb test against a word list small enough to travel with the plan, or a row's own array."""
    known = (lambda w: F.array_contains(verbs, w)) if isinstance(verbs, Column) else (lambda w: w.isin(list(verbs)))
    return let(cleaned, lambda text: verb_test(text, known(first_word(text))))


def opening_words(markup: Column) -> Column:
    """The distinct words that the verb test can look up in a document."""
    word = lambda opening: lambda part: first_word(opening(part))
    parts = [
        F.transform(F.flatten(html_lists(markup)), word(T.item_opening)),
        F.transform(F.flatten(paragraph_lists(markup)), word(T.item_opening)),
        F.transform(paragraphs(markup), word(T.paragraph_opening)),
    ]
    return F.array_distinct(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))


def with_verbs(
    df: DataFrame, markup: Column, lexicon: DataFrame | Sequence[str], word: str = "word", out: str = "_verbs"
) -> tuple[DataFrame, Sequence[str] | Column]:
    """What ``starts_with_verb`` needs of a lexicon of any size.

    A list, or a table of few words, goes with the plan. From a larger table each document
    gets the array of those of its opening words that the table holds.
    """
    verbs = lexicon if not isinstance(lexicon, DataFrame) else small_lexicon(lexicon, word)
    if verbs is not None:
        return df, list(verbs)
    known = lexicon.select(F.lower(word).alias("_on")).filter(F.col("_on").isNotNull()).distinct()
    known = known.withColumn("_word", F.col("_on"))
    found = lookup_each(df, opening_words(markup), known, "_on", "_word", out)
    return found.withColumn(out, F.filter(out, lambda w: w.isNotNull())), F.col(out)


def scored_lists(lists: Column, verbs: Sequence[str] | Column) -> Column:
    """Item arrays as an array of (items, n, verbs)."""
    def score(items: Column) -> Column:
        hits = F.filter(items, lambda item: starts_with_verb(T.item_opening(item), verbs))
        return F.struct(
            items.alias("items"), F.size(items).alias("n"), F.size(hits).alias("verbs")
        )

    return F.transform(lists, score)


SCORED = "array<struct<items:array<string>,n:int,verbs:int>>"


def merged_lists(lists: Column) -> Column:
    """Merge short verb lists into the list before them until nothing changes.

    Only the counts leave the JVM; a merged list is a range of the lists.
    """
    counts = F.transform(lists, lambda l: F.struct(l["n"].alias("n"), l["verbs"].alias("verbs")))

    def joined(r: Column) -> Column:
        items = F.flatten(F.transform(F.slice(lists, r["first"] + 1, r["lists"]), lambda l: l["items"]))
        return F.struct(items.alias("items"), r["n"].alias("n"), r["verbs"].alias("verbs"))

    return F.transform(tag_scan.merge_ranges(counts), joined)


def chosen_list(lists: Column) -> Column:
    """The items of the list with the highest verb share; null if none is good enough.

    Lists under three items score at most one half, and the first of equals wins.
    """
    def final(entry: Column, i: Column) -> Column:
        share = entry["verbs"] / entry["n"]
        capped = F.when(
            entry["n"] < fixed.SHORT_LIST_ITEMS, F.least(share, F.lit(fixed.SHORT_LIST_CAP))
        ).otherwise(share)
        return F.struct(
            capped.alias("score"), (-i).alias("order"), entry["items"].alias("items")
        )

    def choose(scored: Column) -> Column:
        best = F.array_max(F.transform(scored, lambda s: F.struct(s["score"], s["order"])))
        winner = F.get(scored, -best["order"])
        return F.when(winner["score"] >= fixed.ACCEPT_SCORE, winner["items"])

    return let(F.transform(lists, final), choose)


def best_list(lists: Column, verbs: Sequence[str] | Column) -> Column:
    """Score, merge and choose, in that order; ``chosen_list(merged_lists(scored_lists(lists, verbs)))`` without the copies."""
    def counts(items: Column) -> Column:
        hits = F.filter(items, lambda item: starts_with_verb(T.item_opening(item), verbs))
        return F.struct(F.size(items).alias("n"), F.size(hits).alias("verbs"))

    best = tag_scan.choose_range(F.transform(lists, counts))
    return F.flatten(F.slice(lists, best["first"] + 1, best["lists"]))


def verb_paragraphs(markup: Column, verbs: Sequence[str] | Column) -> Column:
    """All paragraphs led by a verb, joined by a space; empty if there is none."""
    hits = F.filter(
        paragraphs(markup), lambda p: starts_with_verb(T.paragraph_opening(p), verbs)
    )
    return F.array_join(hits, " ").alias("verb_paragraphs")


def extract_tasks(df: DataFrame, text: str, lexicon: Sequence[str] | DataFrame) -> DataFrame:
    """Pick the task text of each document and clean it.

    Adds ``branch`` and ``cleaned``. Documents under 100 words are cleaned whole. Others
    take the first of: tag list, paragraph list, verb paragraphs, everything. An extract
    under 50 words falls back to the whole document. Each stage sees null input unless
    the one before it found nothing, so work stops at the first hit. ``lexicon`` is a list of
    words or a table with a ``word`` column, of any size.
    """
    raw = T.clean_raw(F.col(text))
    staged = df.withColumn("_raw", raw).withColumn("_whole", T.clean_final(F.col("_raw")))
    staged = staged.withColumn(
        "_long", F.when(~T.shorter_than(F.col("_whole"), fixed.MIN_WORDS_DOCUMENT), F.col("_raw"))
    )
    staged = staged.withColumn("_markup", markup(F.col("_long")))
    staged, verbs = with_verbs(staged, F.col("_markup"), lexicon)
    staged = staged.withColumn("_list", best_list(html_lists(F.col("_markup")), verbs))
    left = F.when(F.col("_list").isNull(), F.col("_markup"))
    staged = staged.withColumn("_plist", best_list(paragraph_lists(left), verbs))
    left = F.when(F.col("_list").isNull() & F.col("_plist").isNull(), F.col("_markup"))
    staged = staged.withColumn("_verbs", F.nullif(verb_paragraphs(left, verbs), F.lit("")))
    picked = F.coalesce(
        F.array_join("_list", " "), F.array_join("_plist", " "), F.col("_verbs")
    )
    staged = staged.withColumn("_picked", T.clean_final(picked))
    source = (
        F.when(F.col("_raw").isNull(), None)
        .when(F.col("_long").isNull(), "short")
        .when(F.col("_list").isNotNull(), "list")
        .when(F.col("_plist").isNotNull(), "paragraph list")
        .when(F.col("_verbs").isNotNull(), "verb paragraphs")
        .otherwise("whole")
    )
    thin = T.shorter_than(F.col("_picked"), fixed.MIN_WORDS_EXTRACT)
    untagged = T.clean_final(F.regexp_replace("_raw", T.TAG, " "))
    staged = staged.withColumn("_source", source)
    return staged.select(
        *df.columns,
        F.when(thin, F.concat(F.col("_source"), F.lit(", too short")))
        .otherwise(F.col("_source"))
        .alias("branch"),
        F.when(F.col("_source") == "whole", untagged)
        .when(F.col("_picked").isNull() | thin, F.col("_whole"))
        .otherwise(F.col("_picked"))
        .alias("cleaned"),
    )


def list_item_rows(df: DataFrame, key: str, lists: Column) -> DataFrame:
    """One row per list item: key, list_no, item_no, item (cleaned)."""
    per_list = df.select(key, F.posexplode(lists).alias("list_no", "items"))
    per_item = per_list.select(key, "list_no", F.posexplode("items").alias("item_no", "html"))
    return per_item.select(key, "list_no", "item_no", T.clean_item(F.col("html")).alias("item"))


def flag_verbs(items: DataFrame, lexicon: DataFrame, item: str = "item") -> DataFrame:
    """Verb flag by a join on the first word, for a lexicon of any size.

    The lexicon is distinct, so the join neither multiplies nor drops items.
    """
    known = lexicon.select(F.lower("word").alias("_word")).distinct().withColumn("_known", F.lit(True))
    joined = items.withColumn("_word", first_word(F.col(item))).join(known, "_word", "left")
    return joined.withColumn("is_verb", verb_test(F.col(item), F.col("_known"))).drop(
        "_word", "_known"
    )


def list_scores(flagged: DataFrame, key: str) -> DataFrame:
    """Items, verb-led items and their share per list."""
    return flagged.groupBy(key, "list_no").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_verb").alias("verbs"),
        F.avg(F.col("is_verb").cast("int")).alias("score"),
    )


def header_sections(
    df: DataFrame,
    key: str,
    html: str,
    titles: Sequence[str],
    threshold: float,
    tags: Sequence[str] = ("h3", "h2"),
) -> DataFrame:
    """Text under the first header that resembles a title, and under the one after it.

    For each tag in turn the headers are compared with the titles by word overlap; the
    first tag with a match wins. Gives key, tag, header and the section texts.
    """
    wanted = [F.lit(t) for t in titles]

    def overlap(a: Column, b: Column) -> Column:
        left = F.array_distinct(T.words(F.lower(a)))
        right = F.array_distinct(T.words(F.lower(b)))
        both = F.size(F.array_intersect(left, right))
        return both / F.nullif(F.size(F.array_union(left, right)), F.lit(0))

    def sections(tag: str) -> Column:
        cut = F.split(without_scripts(F.col(html)), rf"(?i)(?=<{tag}\b)")
        own = F.filter(cut, lambda p: p.rlike(rf"(?i)^<{tag}\b"))
        parts = F.transform(
            own,
            lambda p: F.struct(
                T.strip(
                    F.regexp_replace(F.regexp_extract(p, rf"(?is)^<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), "<[^>]*>", "")
                ).alias("header"),
                F.regexp_replace(p, rf"(?is)^<{tag}\b.*?</{tag}\s*>", "").alias("body"),
            ),
        )
        hit = F.filter(
            F.transform(
                parts,
                lambda s, i: F.struct(
                    i.alias("i"),
                    F.exists(F.array(*wanted), lambda t: overlap(s["header"], t) > threshold).alias("ok"),
                ),
            ),
            lambda s: s["ok"],
        )
        at = F.get(hit, F.lit(0))["i"]
        return F.when(
            at.isNotNull(),
            F.struct(F.lit(tag).alias("tag"), F.slice(parts, at + 1, 2).alias("parts")),
        )

    found = df.select(key, F.coalesce(*[sections(t) for t in tags]).alias("found"))
    texts = F.filter(
        F.transform(
            F.flatten(F.transform(F.col("found.parts"), lambda s: _cut_at(s["body"], BLOCK_TAGS))),
            lambda t: T.strip(F.regexp_replace(t, "<[^>]*>", "")),
        ),
        lambda t: t != "",
    )
    return found.filter(F.col("found").isNotNull()).select(
        key,
        F.col("found.tag").alias("tag"),
        F.get("found.parts", F.lit(0))["header"].alias("header"),
        texts.alias("texts"),
    )


def page_links(
    df: DataFrame, key: str, html: str, blocked: Sequence[str] = fixed.BLOCKED_LINK_PREFIXES
) -> DataFrame:
    """Links of a page that lead to none of the blocked prefixes."""
    links = df.select(
        key, F.explode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).alias("link")
    )
    for prefix in blocked:
        links = links.filter(~F.startswith("link", F.lit(prefix)))
    return links
