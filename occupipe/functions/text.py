"""Text cleaning as column expressions.

Every function takes and returns a Column, is null-safe, and stays in the JVM, so a
whole cleaning chain is one projection over the scan. Java regex differs from the
Unicode-aware dialect the rules were written for, hence ``(?U)`` wherever ``\\w``,
``\\s`` or ``\\d`` must see more than ASCII. From the removal of non-ASCII characters on,
text is ASCII and the cheaper classes are exact.

Patterns start with a literal or a narrow class where they can: a leading lookbehind or an
optional run of spaces is tried at every character and costs several times as much.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from occupipe.functions import fixed_values as fixed

# Whitespace as the rules mean it: Unicode spaces plus the four ASCII separators.
SPACE = r"[\s\x1c-\x1f]"
ASCII_SPACE = r"[\t-\r\x1c-\x20]"
TAG = r"<[^>\n]*>"
EDGE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _sub(column: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(column, pattern, replacement)


def _literal(column: Column, search: str, replacement: str) -> Column:
    return F.replace(column, F.lit(search), F.lit(replacement))


def strip(column: Column) -> Column:
    """Trim every kind of whitespace; Spark's ``trim`` removes spaces only."""
    return F.btrim(column, F.lit(EDGE_CHARACTERS))


def as_trimmed_string(column: Column) -> Column:
    """Cast to string and trim, leaving nulls null."""
    return strip(column.cast("string"))


def collapse_space(column: Column) -> Column:
    """Join whitespace-separated words by single spaces."""
    return strip(_sub(column, rf"(?U){SPACE}+", " "))


def words(column: Column) -> Column:
    """Whitespace-separated words as an array; empty for blank text."""
    return F.regexp_extract_all(column, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def clean_raw(column: Column) -> Column:
    """Drop newlines, tabs and non-breaking spaces; spell out ``No.``."""
    tabbed = _sub(column, r"(?U)(?<=>\d)\t", ". ")
    return _literal(_sub(tabbed, r"[\n \t]", ""), "No.", "Number")


def break_to_period(column: Column) -> Column:
    return _literal(column, "<br>", ".")


def decode_entities(column: Column) -> Column:
    """The few entities that the final cleaning knows."""
    column = _literal(_literal(column, "&amp;", "&"), "&nbsp;", " ")
    return _sub(column, "&[rl][sd]quo;", "'")


def straighten_quotes(column: Column) -> Column:
    return _sub(column, "[’‘]", "'")


def bullet_after_tag(column: Column) -> Column:
    return _sub(column, rf"(?U)>{SPACE}*(•|-|·|\d+\.)", ">.")


def non_ascii_to_period(column: Column) -> Column:
    return _sub(column, r"[^\x00-\x7F]+", ".")


def tags_to_text(column: Column) -> Column:
    """Closing tags end a sentence, other tags become a space."""
    return _sub(_sub(column, r"</[^>\n]*>", "."), TAG, " ")


def semicolons_and_space(column: Column) -> Column:
    ascii_runs = rf"{ASCII_SPACE}{{2,}}|[\t-\r\x1c-\x1f]"
    return strip(_sub(_literal(column, ";", "."), ascii_runs, " "))


def leading_punctuation(column: Column) -> Column:
    return _sub(column, rf"^{SPACE}*[?.,!]{SPACE}*", "")


def space_between_periods(column: Column) -> Column:
    return _sub(column, rf"\.{ASCII_SPACE}+(?=\.)", ".")


def space_before_punctuation(column: Column) -> Column:
    return _sub(column, rf"(?<=\w){ASCII_SPACE}+(?=[?.,!])", "")


def collapse_periods(column: Column) -> Column:
    return _sub(column, r"\.+", ".")


def period_after_symbol(column: Column) -> Column:
    return _sub(column, r"\.(?<=[^A-Za-z0-9\s\x1c-\x1f]\.)", "")


def period_before_lowercase(column: Column) -> Column:
    return _sub(column, rf"\.{ASCII_SPACE}*(?=[a-z])", " ")


def drop_short_segments(column: Column) -> Column:
    """Keep period-separated segments of two words or more; end with a period."""
    kept = F.filter(
        F.split(column, r"\."),
        lambda segment: segment.rlike(r"[^\s\x1c-\x1f][\s\x1c-\x1f]+[^\s\x1c-\x1f]"),
    )
    return F.concat(strip(F.array_join(kept, ".")), F.lit("."))


FINAL_STEPS = [
    break_to_period,
    decode_entities,
    straighten_quotes,
    bullet_after_tag,
    non_ascii_to_period,
    tags_to_text,
    semicolons_and_space,
    leading_punctuation,
    space_between_periods,
    space_before_punctuation,
    collapse_periods,
    period_after_symbol,
    period_before_lowercase,
    drop_short_segments,
]


def clean_final(column: Column) -> Column:
    """The full cleaning chain, in its fixed order."""
    return reduce(lambda text, step: step(text), FINAL_STEPS, column)


# Up to three chunks that hold a word character: all that a test of first words can see.
OPENING = r"(?U)^(?:[^\w]*\w[^\s\x1c-\x1f]*){0,3}"


def _untagged_item(column: Column) -> Column:
    return strip(_sub(strip(_sub(column, TAG, "")), r"(?U)^\d+\.{0,1}", ""))


def _without_symbols(column: Column) -> Column:
    return strip(_sub(column, r"(?U)[^\w\s\x1c-\x1f]+", ""))


def clean_item(column: Column) -> Column:
    """Strip tags, a leading number, then symbols, trimming after each."""
    return _without_symbols(_untagged_item(column))


def clean_paragraph(column: Column) -> Column:
    """Strip tags and symbols; numbers stay."""
    return _without_symbols(_sub(column, TAG, ""))


def item_opening(column: Column) -> Column:
    """The first words of ``clean_item``, without cleaning what follows them."""
    return _without_symbols(F.regexp_extract(_untagged_item(column), OPENING, 0))


def paragraph_opening(column: Column) -> Column:
    """The first words of ``clean_paragraph``, without cleaning what follows them."""
    return _without_symbols(F.regexp_extract(_sub(column, TAG, ""), OPENING, 0))


def word_count(column: Column) -> Column:
    """Number of word tokens in cleaned text, which is ASCII."""
    return F.regexp_count(column, F.lit(r"\w+"))


def shorter_than(cleaned: Column, n: int) -> Column:
    return word_count(cleaned) < n


def remove_prefix(column: Column, prefixes: Iterable[str]) -> Column:
    """Remove the first listed prefix that matches, then trim; never a second one."""
    branch = None
    for prefix in prefixes:
        rest = strip(F.substr(column, F.lit(len(prefix) + 1)))
        hit = F.startswith(column, F.lit(prefix))
        branch = F.when(hit, rest) if branch is None else branch.when(hit, rest)
    return column if branch is None else branch.otherwise(column)


def clean_title(column: Column) -> Column:
    """Job-title cleaning: bracketed text, hashtags, numbers, symbols, double spaces."""
    for pattern in fixed.TITLE_PATTERNS:
        column = strip(_sub(column, "(?Ud)" + pattern, " "))
    column = _sub(column, r"[^\x00-\x7F]+", " ")
    column = _sub(column, r"(?U)[^a-zA-Z0-9\s\x1c-\x1f]", " ")
    return _sub(column, rf"(?U){SPACE}{SPACE}+", " ")


def clean_bag(column: Column) -> Column:
    """Lowercase ASCII words only, for bag-of-words features."""
    text = F.lower(_sub(column, TAG, ""))
    return F.array_join(F.regexp_extract_all(text, F.lit("[a-zA-Z]+"), F.lit(0)), " ")


def clean_title_list(column: Column) -> Column:
    """Bullets, newlines, blank marks and parentheses in a taxonomy title list."""
    for pattern, replacement in fixed.TITLE_LIST_REPLACEMENTS:
        column = _sub(column, pattern, replacement)
    return column


def listed_titles(column: Column) -> Column:
    """A cleaned title list as an array of lowercase titles; empty ones dropped."""
    parts = F.transform(
        F.split(clean_title_list(column), r"\."), lambda t: F.lower(strip(t))
    )
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def elsewhere_entries(column: Column) -> Column:
    """``title, see code`` entries as an array of (code, title)."""
    entries = F.filter(
        F.split(clean_title_list(column), r"\."),
        lambda e: F.contains(e, F.lit(", see")),
    )
    return F.transform(
        entries,
        lambda e: F.struct(
            strip(F.get(F.split(e, ", see"), F.lit(1))).alias("code"),
            F.lower(strip(F.get(F.split(e, ", see"), F.lit(0)))).alias("title"),
        ),
    )


def to_ascii(column: Column) -> Column:
    """Every non-ASCII character becomes one space."""
    return _sub(column, r"[^\x00-\x7F]", " ")


def url_id(column: Column) -> Column:
    """The 32-character id at the end of a URL path; null if there is none."""
    found = F.regexp_extract(F.concat(column, F.lit("?")), r"-([a-z0-9]{32})\?", 1)
    return F.nullif(found, F.lit(""))


def record_key(column: Column) -> Column:
    return F.md5(column)


def percent(column: Column) -> Column:
    """``0.1234`` as ``12.34%``."""
    return F.when(column.isNotNull(), F.format_string("%.2f%%", column * 100))


def confidence_band(column: Column) -> Column:
    """low, medium or high, for a percentage."""
    return (
        F.when(column < 33.33, "low").when(column < 66.66, "medium").when(column.isNotNull(), "high")
    )


def centre_trim(column: Column, n: int) -> Column:
    """The middle ``n`` words; text of ``n`` words or fewer is left as it is."""
    parts = words(column)
    start = F.ceil((F.size(parts) - n) / 2).cast("int") + 1
    return F.when(F.size(parts) > n, F.array_join(F.slice(parts, start, n), " ")).otherwise(
        column
    )
