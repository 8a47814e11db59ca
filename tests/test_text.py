import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from occupipe.functions import arrays as A
from occupipe.functions import codes as K
from occupipe.functions import text as T


@pytest.mark.parametrize(
    ("text", "prefixes", "expected"),
    [
        ("ref: clerk wanted", ["ref:"], "clerk wanted"),
        ("ref: clerk wanted", ["Ref:", "clerk"], "ref: clerk wanted"),
        ("new new clerk", ["job", "new"], "new clerk"),
        ("clerk", [], "clerk"),
    ],
)
def test_remove_prefix(one, text, prefixes, expected):
    assert one(lambda c: T.remove_prefix(c, prefixes), text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("sort\nmail", "sortmail"),
        ("\u00a0file\tletters\u00a0", "fileletters"),
        ("room No. 12", "room Number 12"),
        ("<p>7\tsteps", "<p>7. steps"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_raw(one, text, expected):
    assert one(T.clean_raw, text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("<li>sort mail</li>", "sort mail"),
        ('<li id="x" class="y">12. answer calls</li>', "answer calls"),
        ("file # letters @ once", "file  letters  once"),
        ("<b\n>naïve!?", "b\nnaïve"),
        ("", ""),
    ],
)
def test_clean_item(one, text, expected):
    assert one(T.clean_item, text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Sort the mail<br>Answer all calls", "Sort the mail.Answer all calls."),
        ("<p>Keep books</p><p>Pay &amp; bill</p>", "Keep books. Pay & bill."),
        ("Lead the team; Plan the work; Rest", "Lead the team. Plan the work."),
        ("Greet guests .... Show rooms", "Greet guests. Show rooms."),
        ("the guests&rsquo; bags", "the guests' bags."),
        ("one", "."),
        ("", "."),
    ],
)
def test_clean_final(one, text, expected):
    assert one(T.clean_final, text) == expected


def well_formed(text):
    """What every cleaned text has in common."""
    assert text.endswith(".") and ".." not in text and text.isascii() and "<br>" not in text
    assert all(len(part.split()) > 1 for part in text.split(".") if part)


def test_clean_final_on_fixture_text(spark):
    folder = "/root/testdata/sf0.001"
    for table, column in (("pages", "html"), ("documents", "text")):
        df = spark.read.parquet(f"{folder}/{table}.parquet")
        for row in df.select(T.clean_final(F.col(column)).alias("r")).collect():
            well_formed(row["r"])


PIECES = st.sampled_from(
    ["a", "Bc", " ", "  ", ".", ";", ",", "!", "<br>", "<p>", "</p>", "• ", "-", "1.", "é", "\t", "\n", "\r", "\x1f", "’", "&amp;", "&nbsp;", "?", ")", "_", "9"]
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=25).map("".join), min_size=20, max_size=60))
def test_clean_final_on_random_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", T.clean_final(F.col("t")).alias("r")).collect():
        well_formed(row["r"])


def test_opening_agrees_with_whole_item(spark):
    texts = ["", "<b>1. You are !! able</b> to", "* - 2) first second third fourth", "é à", "are you & there now", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from occupipe.operators.blocks import starts_with_verb

    verbs = ["able", "first", "there", "à"]
    row = df.select(
        (starts_with_verb(T.clean_item(F.col("t")), verbs) == starts_with_verb(T.item_opening(F.col("t")), verbs)).alias("a"),
        (starts_with_verb(T.clean_paragraph(F.col("t")), verbs) == starts_with_verb(T.paragraph_opening(F.col("t")), verbs)).alias("b"),
    )
    assert all(r["a"] and r["b"] for r in row.collect())


def test_small_functions(one):
    assert one(T.clean_title, "[new] cook (night) #sgunitedjobs 12345 - chef é") == "cook chef "
    assert one(T.url_id, "http://x/ad-" + "a" * 32) == "a" * 32
    assert one(T.url_id, "http://x/ad") is None
    assert one(lambda c: T.percent(c.cast("double")), "0.1234") == "12.34%"
    assert one(lambda c: T.confidence_band(c.cast("double")), "33.33") == "medium"
    assert one(lambda c: T.centre_trim(c, 2), "a b c d e") == "c d"
    assert one(lambda c: T.centre_trim(c, 9), "a  b") == "a  b"
    assert one(lambda c: T.to_ascii(c), "aéb") == "a b"
    assert one(T.listed_titles, "• Cook\n• Chef (night)\n<Blank>") == ["cook", "chef"]
    assert one(lambda c: K.week_bucket(c.cast("date")), "2019-12-30") == "2019-01"
    assert one(lambda c: K.week_bucket(c.cast("date"), iso_year=True), "2019-12-30") == "2020-01"
    assert one(K.normalise, "1234.0") == "1234"
    assert one(K.normalise, "X5000") is None
    assert one(K.others, "25121") == "25129"
    assert one(A.parse_list_literal, "['1', '2']") == ["1", "2"]
    assert one(lambda c: A.rank_of(F.split(c, ","), F.lit("b")), "a,b") == 1
    assert one(lambda c: A.rank_of(F.split(c, ","), F.lit("z")), "a,b") is None
    assert one(T.record_key, "a") == "0cc175b9c0f1b6a831c399e269772661"


def test_rank_ties(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>")
    row = df.select(A.top_n(F.col("p"), 2).alias("t"), A.argmax(F.col("p")).alias("m")).first()
    assert [e["idx"] for e in row["t"]] == [1, 0]
    assert row["m"] == 0


def test_percent_and_band_of_null(spark):
    row = spark.range(1).select(T.percent(F.lit(None).cast("double")).alias("p"), T.confidence_band(F.lit(None).cast("double")).alias("b")).first()
    assert row["p"] is None and row["b"] is None
