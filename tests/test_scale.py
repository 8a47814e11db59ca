"""Steps whose memory or largest task must not grow with the input, and their results."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from occupipe.functions import fixed_values as fixed
from occupipe.operators import augment as G
from occupipe.operators import corpus as C
from occupipe.operators import joins as J
from occupipe.operators.groups import md5_coin, md5_coins
from occupipe.plans import streams as P
from occupipe.plans.registry import Tables
from occupipe.session import unsorted_writes
from occupipe.sources import writers


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_texts_are_substituted_in_pieces():
    lists = pa.array([["a"] * 3, None, [], ["b"] * 9, ["c"] * 2, ["d"] * 2], pa.list_(pa.string()))
    pieces = list(G._pieces(pa.RecordBatch.from_arrays([lists], names=["w"]), "w", 4))
    assert [len(p.column("w").flatten()) for p in pieces] == [3, 9, 4] and sum(p.num_rows for p in pieces) == 6


def test_coins_are_those_of_the_column(spark):
    for name in ("7", None):
        key = F.lit(name).cast("string")
        shown = spark.range(50).select(md5_coin(3, key, F.col("id")).alias("c")).collect()
        assert md5_coins(name, np.arange(50), 3).tolist() == [r["c"] for r in shown]


def test_masked_runs_are_drawn_in_arrow(spark):
    words = [0, 0, None, 0, 1, None, 0, 2]
    rows = [(str(k), list(range(8)), words) for k in range(40)] + [("x", None, None), ("y", [], []), (None, [5], [1])]
    df = spark.createDataFrame(rows, "k string, ids array<int>, w array<int>").coalesce(2)
    masked = C.mask_whole_words(df, "k", "ids", "w", 99, share=0.5)
    assert "MapInArrow" in plan_of(masked) and "aggregate(" not in plan_of(masked)
    runs, got = [0, 0, None, 0, 1, None, 2, 3], {r["k"]: r for r in masked.collect()}
    for k in map(str, range(40)):
        coins = md5_coins(k, np.arange(4), 1) % np.uint64(1_000_000) < 500_000
        hit = [r is not None and bool(coins[r]) for r in runs]
        assert got[k]["ids"] == [99 if h else i for i, h in enumerate(hit)]
        assert got[k]["labels"] == [i if h else fixed.IGNORE_LABEL for i, h in enumerate(hit)]
    assert got["x"]["labels"] is None and got["y"]["labels"] == [] and len(got[None]["labels"]) == 1


def test_a_large_matrix_is_met_by_label_and_not_by_pair(spark, monkeypatch):
    pairs = [("a", "b", 0.9), ("a", "c", 0.5), ("a", "c", 0.7), ("b", "a", None)]
    matrix = spark.createDataFrame(pairs, "code_a string, code_b string, sim double")
    rows = [(1, "a", ["c", "x", "b", None]), (1, "a", ["b"]), (2, None, ["a"]), (3, "b", ["a"]), (4, "z", []), (5, "a", None)]
    df = spark.createDataFrame(rows, "id long, code string, p array<string>")
    monkeypatch.setattr(J, "is_small", lambda df: False)
    costs = J.similarity_of(df, "id", "code", "p", matrix)
    assert "Generate" not in plan_of(costs)
    shown = sorted((r["id"], None if r["costs"] is None else [c if c is None else round(c, 6) for c in r["costs"]]) for r in costs.collect() if r["id"] > 1)
    assert shown == [(2, [None]), (3, [None]), (4, []), (5, None)]
    first = [[c if c is None else round(c, 6) for c in r["costs"]] for r in costs.filter("id = 1").collect()]
    assert sorted(first, key=len) == [[0.1], [0.3, 0.5, None, 0.1, None]]


def test_each_lot_arrives_in_as_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "FILE_ROWS", 100)
    df = spark.range(1000).select("id", F.concat(F.lit("line "), F.col("id")).alias("value"))
    part = F.when(F.col("id") < 950, 0).when(F.col("id") < 953, 1).otherwise(3).cast("int")
    for kind, columns in (("parquet", df), ("text", df.select("value"))):
        numbered = part if kind == "parquet" else F.when(F.substring("value", 6, 9).cast("int") < 950, 0).otherwise(3)
        folder, files = P.arrivals(Tables(spark, str(tmp_path)), columns, numbered, 4, kind)
        assert files == 10
        read = spark.read.format(kind).schema(columns.schema).load(f"{folder}/in-*")
        assert read.count() == 1000 and read.distinct().count() == 1000
        context = spark.sparkContext
        for k in range(4):
            path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/in-{k}")
            listed = path.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(path)
            times = [s.getModificationTime() for s in listed if s.getPath().getName().startswith("part-")]
            assert times == [1_700_000_000_000 + 60_000 * k] * 10


def test_writes_by_few_values_are_not_sorted(spark, tmp_path):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    with unsorted_writes(spark):
        assert int(spark.conf.get(name)) > 1
    assert spark.conf.get(name) == before
    df = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, "bad").alias("reject_reason"))
    writers.write_with_quarantine(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["rejected"]: r["count"] for r in back.groupBy(F.col("rejected").cast("string").alias("rejected")).count().collect()} == {"true": 34, "false": 66}


def test_links_listed_twice_are_joined_once_and_their_rows_repeated(spark, monkeypatch):
    monkeypatch.setattr(J, "COPIES", 2)
    ads = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (4, None), (5, "e")], "ad_id int, code string")
    aliases = [("a", "A")] * 3 + [("a", "B"), ("b", "B"), ("c", "C"), ("c", None), (None, "A"), ("e", "E")]
    versions = [("A", "x")] * 2 + [("A", "y"), ("B", "z"), ("C", "Deleted"), ("C", None), (None, "x")]
    found = J.recode_twice(ads, "code", spark.createDataFrame(aliases, "alias string, actual string"), spark.createDataFrame(versions, "old string, new string"))
    # Above the joins rows are only repeated.
    plan = plan_of(found)
    assert plan.count("Generate explode") == 2 and "Join" not in plan[: plan.rindex("Generate explode")]
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == [(1, "x")] * 12 + [(1, "y")] * 6 + [(1, "z")] * 2 + [(2, "z")] and found.columns == ["ad_id", "code"]


def test_titles_of_repeated_codes_are_spread_after_the_joins(spark, monkeypatch):
    monkeypatch.setattr(J, "COPIES", 2)
    titles = [("a", "x")] * 3 + [("a", "y"), ("a", None), ("b", "z"), ("c", None), (None, "n")]
    ads = [(1, "a", "b"), (1, "a", "b"), (2, "a", "a"), (3, "c", "d"), (4, None, "b"), (5, "d", None)]
    taxonomy = spark.createDataFrame(titles, "code string, title string")
    found = J.with_titles(spark.createDataFrame(ads, "ad_id int, code string, other string"), ["code", "other"], taxonomy)
    plan = plan_of(found)
    assert plan.count("Join") == 2 and "Join" not in plan[: plan.rindex("Generate explode")]
    def of(code):
        return [t for c, t in titles if c is not None and c == code] or [None]

    wanted = [(*ad, x, y) for ad in ads for x in of(ad[1]) for y in of(ad[2])]
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in found.collect())
    assert found.columns == ["ad_id", "code", "other", "code_title", "other_title"]
