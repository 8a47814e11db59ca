import re
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from occupipe.functions import tag_scan
from occupipe.operators import blocks as B

VERBS = ["performing", "perform", "acting", "manage", "plan", "lead"]


def lists_of(spark, html, function=B.html_lists):
    df = spark.createDataFrame([(html,)], "h string")
    return df.select(function(B.markup(F.col("h"))).alias("r")).first()["r"]


def best_of(spark, html, function=B.html_lists):
    df = spark.createDataFrame([(html,)], "h string")
    return df.select(B.best_list(function(B.markup(F.col("h"))), VERBS).alias("r")).first()["r"]


def test_lists_and_nesting(spark):
    html = "<UL><li>a</li><li>x<ol><li>in1<li>in2</li></ol></li></UL><ul></ul>"
    assert lists_of(spark, html) == [
        ["<li>a</li>", "<li>x<ol><li>in1<li>in2</li></ol></li>", "<li>in1</li>", "<li>in2</li>"],
        ["<li>in1</li>", "<li>in2</li>"],
    ]
    assert lists_of(spark, "plain") == []
    assert lists_of(spark, None) is None
    assert lists_of(spark, "<script>'<ul><li>no</li></ul>'</script><!-- <ul><li>no</li></ul> -->") == []


def test_paragraph_runs(spark):
    html = "<p>• a</p><p>&bull; b</p><p>no</p><p></p><p>1. c<p>2 d</p><div>x</div><p><b>3</b></p>"
    assert lists_of(spark, html, B.paragraph_lists) == [
        ["<p>• a</p>", "<p>• b</p>"],
        ["<p>1. c</p>", "<p>2 d</p>"],
    ]


def test_list_choice(spark):
    verbs = "<ul><li>Manage the shop &amp; its stock</li><li>Plan rotas</li><li>Lead tours</li></ul>"
    other = "<ol><li>A bus pass</li><li>Free lunch</li><li>Own locker</li></ol>"
    kept = ["<li>Manage the shop &amp; its stock</li>", "<li>Plan rotas</li>", "<li>Lead tours</li>"]
    assert best_of(spark, verbs + other) == kept and best_of(spark, other) is None
    marked = "<p>- Plan rotas<br>- Lead tours</p>"
    assert best_of(spark, marked, B.paragraph_lists) == ["<p>- Plan rotas<br/>- Lead tours</p>"]


def test_verb_overrides(one):
    test = lambda c: B.starts_with_verb(c, VERBS)
    assert one(test, "proven skill with tools") is False
    assert one(test, "review of all plans") is True
    assert one(test, "lead a crew of five") is True
    assert one(test, "Are you performing under pressure") is True
    assert one(test, "") is False
    assert one(test, "nothing here") is False


def by_arrays(html):
    """Lists and items by the positions and depths of all tags, pair by pair."""
    cuts = [m.start() for m in re.finditer(r"</?(?:ol|ul|li)\b", html, re.I | re.A)]
    pieces = [html[a:b] for a, b in zip(cuts, [*cuts[1:], len(html)])]
    depth, deep = 0, []
    for p in pieces:
        depth += 1 if re.match("<(ol|ul)", p, re.I) else -1 if re.match("</(ol|ul)", p, re.I) else 0
        deep.append(depth)
    stop = lambda at, ends: next((j for j in range(at + 1, len(pieces)) if ends(j)), len(pieces))
    items = {}
    for i, p in enumerate(pieces):
        if re.match("<li", p, re.I):
            end = stop(i, lambda j: deep[j] < deep[i] or deep[j] == deep[i] and re.match("</?li", pieces[j], re.I))
            items[i] = "".join(pieces[i:end]) + "</li>"
    found = []
    for i, p in enumerate(pieces):
        if re.match("<(ol|ul)", p, re.I):
            end = stop(i, lambda j: deep[j] < deep[i])
            found.append([items[k] for k in items if i < k < end])
    return [f for f in found if f]


MARKUP = st.lists(st.sampled_from(["<ul>", "</ul>", "<OL class='x'>", "</ol>", "<li>", "<li id=1>", "</LI>", "a", "b c", "<p>", "<lie>", "<ul"]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(MARKUP)
def test_scanned_lists_equal_the_rule(parts):
    html = "".join(parts)
    assert tag_scan.list_blocks(html) == by_arrays(html)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 7), st.integers(0, 7)).map(lambda c: (c[0], min(c))), max_size=12))
def test_merged_ranges_cover_all_lists_in_order(counts):
    ranges = tag_scan.merged_ranges(counts)
    assert [(n, v) for _, _, n, v in ranges] == merged_by_rule(counts)
    assert [i for first, lists, _, _ in ranges for i in range(first, first + lists)] == list(range(len(counts)))


def test_a_page_of_many_tags_is_scanned_in_seconds(spark):
    flat = "<ul>" + "<li>Plan it</li>" * 25_000 + "</ul>" + "<p>• Lead it</p>" * 25_000
    deep = "<ul><li>x" * 2_000 + "</li></ul>" * 2_000
    unclosed = "<li>" * 50_000 + "</ul>" * 50_000
    begun = time.perf_counter()
    assert [len(x) for x in tag_scan.list_blocks(flat)] == [25_000] and len(tag_scan.list_blocks(deep)) == 2_000
    assert tag_scan.list_blocks(unclosed) == [] and time.perf_counter() - begun < 5
    assert len(lists_of(spark, flat, B.paragraph_lists)[0]) == 25_000


def merged_by_rule(lists):
    """The merge rule as a loop: repeat whole passes until none changes anything."""
    while True:
        out = []
        for i, (n, v) in enumerate(lists):
            if i and n < 6 and v / n >= 0.7:
                out[-1] = (out[-1][0] + n, out[-1][1] + v)
            else:
                out.append((n, v))
        if len(out) == len(lists):
            return out
        lists = out


LISTS = st.lists(st.integers(1, 7).flatmap(lambda n: st.tuples(st.just(n), st.integers(0, n))), max_size=9)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LISTS, min_size=20, max_size=40))
def test_merge_reaches_the_stable_state(spark, cases):
    rows = [([([f"i{j}" for j in range(n)], n, v) for n, v in case],) for case in cases]
    df = spark.createDataFrame(rows, f"l {B.SCORED}")
    got = df.select(B.merged_lists(F.col("l")).alias("m")).collect()
    for case, row in zip(cases, got):
        assert [(m["n"], m["verbs"]) for m in row["m"]] == merged_by_rule(list(case))
        assert all(len(m["items"]) == m["n"] for m in row["m"])


def test_extract_branches(spark):
    filler = "Plain words fill the text so that it is long enough to be looked at. " * 12
    tasks = "".join(f"<li>Manage the team and plan the work of week number {i} with care</li>" for i in range(6))
    points = "".join(f"<p>• Manage the team and plan the work of week number {i} with care</p>" for i in range(6))
    lead = "<p>Lead the whole team through the year and plan " + "all of the work with care " * 12 + "</p>"
    docs = {
        "short": "<p>Too short.</p>",
        "list": f"<div>{filler}</div><ul>{tasks}</ul>",
        "paragraph list": f"<div>{filler}</div>{points}",
        "verb paragraphs": f"<div>{filler}</div>{lead}<p>Other words</p>",
        "whole": f"<div>{filler}</div>",
        "list, too short": f"<div>{filler}</div><ul><li>Manage it</li><li>Plan it</li></ul>",
        None: None,
    }
    df = spark.createDataFrame([(k, v) for k, v in docs.items()], "want string, html string")
    for row in B.extract_tasks(df, "html", VERBS).collect():
        assert row["branch"] == row["want"]
        if row["want"] is None:
            assert row["cleaned"] is None
        elif row["want"] in ("list", "paragraph list"):
            assert "Plain words" not in row["cleaned"] and "Manage the team" in row["cleaned"]


def test_lexicon_join_agrees_with_word_list(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    words = ["the", "de", "and", "la"]
    items = B.list_item_rows(pages, "page_id", B.html_lists(B.markup(F.col("html"))))
    joined = B.flag_verbs(items, spark.createDataFrame([(w,) for w in words], "word string"))
    inline = joined.withColumn("inline", B.starts_with_verb(F.col("item"), words))
    assert inline.filter("is_verb <> inline").count() == 0
    assert inline.filter("is_verb").count() > 0


def test_extraction_takes_a_lexicon_of_any_size(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    pages = pages.union(spark.createDataFrame([(-1, None), (-2, ""), (-2, "")], pages.schema))
    paragraphs = "".join(f"<p>• the {w} thing to do here</p>" for w in "abcdefgh") + "<p>" + "and more words " * 60 + "</p>"
    pages = pages.union(spark.createDataFrame([(-3, paragraphs)], pages.schema))
    lexicon = spark.createDataFrame([("The",), ("de",), ("and",), ("la",), (None,), ("the",)], "word string")
    run = lambda: sorted(map(repr, B.extract_tasks(pages, "html", lexicon).collect()))
    small = run()
    monkeypatch.setattr(B, "LEXICON_LIMIT", 3)
    assert B.small_lexicon(lexicon) is None
    assert run() == small and any("list" in row for row in small)


def test_sections_and_links(spark):
    html = (
        "<h2>About us</h2><p>no</p><h2>Job duties</h2><p>first</p><ul><li>a</li><li>b</li></ul>"
        "<h2>Pay</h2><p>money</p><h2>More</h2><p>no</p><a href=\"https://google.com/x\">x</a><a href=\"/in\">y</a>"
    )
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "id int, html string")
    found = B.header_sections(df, "id", "html", ["duties of the job"], 0.3).collect()
    assert [(r["id"], r["tag"], r["header"], r["texts"]) for r in found] == [
        (1, "h2", "Job duties", ["first", "a", "b", "money"])
    ]
    assert [r["link"] for r in B.page_links(df, "id", "html").collect()] == ["/in"]
