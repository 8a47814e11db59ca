"""One-pass scans of a page's markup with an explicit stack, as Arrow column functions.

Array expressions would copy the arrays at each tag, so their time grows with the square of
the tags of a page. These scans read the markup once, and their time is linear in the markup and
in what they return. A null page gives null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from occupipe.functions import fixed_values as fixed

LIST_TAG = re.compile(r"<(/?)(ol|ul|li)\b", re.I | re.A)
OPENING = re.compile("^<[^>]*>")
BULLET = re.compile(fixed.BULLET_START, re.A)
LISTS = pa.list_(pa.list_(pa.string()))
BLOCKS = ArrayType(ArrayType(StringType()))


def whole_numbers(*names: str) -> StructType:
    return StructType([StructField(n, IntegerType()) for n in names])


def list_blocks(markup: str) -> list[list[str]]:
    """``ol`` and ``ul`` blocks as lists of items, in the order of their opening tags.

    A list ends where the depth falls below its own, an item there too and at the next item
    tag of its depth. What is left open ends with the page. Lists without items are left out.
    """
    depth = 0
    begun: list[int] = []
    ended: list[int] = []
    blocks: list[list[int]] = []
    open_items: list[tuple[int, int]] = []
    open_blocks: list[tuple[int, int]] = []
    for tag in LIST_TAG.finditer(markup):
        at, closing, name = tag.start(), tag.group(1), tag.group(2).lower()
        if name == "li":
            if open_items and open_items[-1][0] == depth:
                ended[open_items.pop()[1]] = at
            if not closing:
                open_items.append((depth, len(begun)))
                begun.append(at)
                ended.append(len(markup))
        elif closing:
            depth -= 1
            while open_items and open_items[-1][0] > depth:
                ended[open_items.pop()[1]] = at
            while open_blocks and open_blocks[-1][0] > depth:
                blocks[open_blocks.pop()[1]][1] = len(begun)
        else:
            depth += 1
            open_blocks.append((depth, len(blocks)))
            blocks.append([len(begun), -1])
    # The items inside a list are those begun between its two ends.
    items = [f"{markup[a:b]}</li>" for a, b in zip(begun, ended)]
    found = [items[a : len(items) if b < 0 else b] for a, b in blocks]
    return [f for f in found if f]


def paragraph_blocks(markup: str, block_tag: re.Pattern) -> list[list[str]]:
    """Runs of ``p`` elements that open with a bullet, hyphen, middle dot or number; each closes at the next block tag."""
    found: list[list[str]] = []
    inside = False
    starts = [(m.start(), m.group().lower() == "<p") for m in block_tag.finditer(markup)]
    for (at, opens), stop in zip(starts, [*(s for s, _ in starts[1:]), len(markup)]):
        if opens:
            paragraph = f"{markup[at:stop]}</p>"
            if BULLET.search(OPENING.sub("", paragraph, count=1)):
                if not inside:
                    found.append([])
                found[-1].append(paragraph)
                inside = True
            else:
                inside = False
    return found


def merged_ranges(counts: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Lists that a merge leaves: first list, number of lists, items and verb-led items.

    In each pass every short verb list joins the one kept before it. Only a list that grew can
    newly qualify, so there are at most as many passes as a short list has items.
    """
    kept = [(i, 1, n, v) for i, (n, v) in enumerate(counts)]
    while True:
        out: list[tuple[int, int, int, int]] = []
        for first, lists, n, v in kept:
            if out and n < fixed.MERGE_BELOW_ITEMS and n and v / n >= fixed.MERGE_FROM_SCORE:
                a, b, c, d = out[-1]
                out[-1] = (a, b + lists, c + n, d + v)
            else:
                out.append((first, lists, n, v))
        if len(out) == len(kept):
            return out
        kept = out


def chosen_range(ranges: list[tuple[int, int, int, int]]) -> tuple[int, int] | None:
    """First list and number of lists of the best: the highest verb share, short ones capped, the first of equals."""
    best = None
    for first, lists, n, v in ranges:
        score = v / n if n else 0.0
        if n < fixed.SHORT_LIST_ITEMS:
            score = min(score, fixed.SHORT_LIST_CAP)
        if score >= fixed.ACCEPT_SCORE and (best is None or score > best[0]):
            best = (score, first, lists)
    return best and best[1:]


def _each(values: pa.Array, function, kind: pa.DataType) -> pa.Array:
    return pa.array([None if v is None else function(v) for v in values.to_pylist()], kind)


@F.arrow_udf(BLOCKS)
def _list_blocks(markup: pa.Array) -> pa.Array:
    return _each(markup, list_blocks, LISTS)


def html_lists(markup: Column) -> Column:
    """``ol`` and ``ul`` blocks as an array of item arrays, in document order.

    A nested list is a list of its own, and its items also count in every list around it.
    """
    return _list_blocks(markup)


def paragraph_lists(markup: Column, block_tags: str) -> Column:
    """Runs of consecutive bulleted paragraphs, as an array of item arrays."""
    pattern = re.compile(rf"</?(?:{block_tags})\b", re.I | re.A)

    @F.arrow_udf(BLOCKS)
    def blocks(markup: pa.Array) -> pa.Array:
        return _each(markup, lambda m: paragraph_blocks(m, pattern), LISTS)

    return blocks(markup)


def _counted(pages: pa.Array) -> Iterator[list[tuple[int, int]] | None]:
    for page in pages.to_pylist():
        yield None if page is None else [(c["n"], c["verbs"]) for c in page]


@F.arrow_udf(ArrayType(whole_numbers("first", "lists", "n", "verbs")))
def merge_ranges(counts: pa.Array) -> pa.Array:
    """From the (n, verbs) of a page's lists, what their merge leaves."""
    names = ("first", "lists", "n", "verbs")
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in names]))
    return pa.array([None if c is None else [dict(zip(names, r)) for r in merged_ranges(c)] for c in _counted(counts)], kind)


@F.arrow_udf(whole_numbers("first", "lists"))
def choose_range(counts: pa.Array) -> pa.Array:
    """From the (n, verbs) of a page's lists, the range of lists that the merge's best one is made of."""
    found = (c and chosen_range(merged_ranges(c)) for c in _counted(counts))
    return pa.array([f and {"first": f[0], "lists": f[1]} or None for f in found], pa.struct([("first", pa.int32()), ("lists", pa.int32())]))
