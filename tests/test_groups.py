import pytest
from pyspark.sql import functions as F

from occupipe.operators import groups as G
from occupipe.operators import split as S
from occupipe.operators import taxonomy as X


@pytest.fixture
def skewed(spark):
    """A third of the rows share one key; one key is null; many keys have one row."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))
    )
    return spark.range(5000).select("id", key.alias("key"))


@pytest.mark.parametrize("slices", [1, 7, 1 << 16])
def test_first_by_hash_takes_exact_numbers(skewed, slices):
    flagged = G.first_by_hash(skewed, ["key"], ["id"], F.floor(F.col("n") * 0.3), 5, slices=slices)
    per_key = flagged.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("taken").alias("t")).collect()
    assert flagged.count() == 5000
    assert all(r["t"] == int(r["n"] * 0.3 + 1e-9) for r in per_key)


def test_first_by_hash_is_stable_and_in_hash_order(skewed):
    take = F.floor(F.col("n") * 0.3)
    taken = lambda df: {r["id"] for r in G.first_by_hash(df, ["key"], ["id"], take, 5).filter("taken").collect()}
    first = taken(skewed.repartition(1))
    assert first == taken(skewed.repartition(8)) == taken(skewed.repartition(5, "key"))
    rows = skewed.filter("key = 'hot'").select("id", G.coin(5, "id").alias("h")).orderBy("h").collect()
    hot = {r["id"] for r in rows}
    assert first & hot == {r["id"] for r in rows[: int(len(rows) * 0.3)]}


def test_row_index_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    rows = G.with_row_index(df, [F.asc("v")]).collect()
    assert sorted((r["row_index"], r["v"]) for r in rows) == [(i, i) for i in range(1000)]


def test_lookup_falls_back_to_a_plain_join(spark):
    assert "broadcast" not in G.lookup(spark.range(10), limit=5)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in G.lookup(spark.range(10), limit=10)._jdf.queryExecution().logical().toString().lower()


def test_lookup_each_both_ways(spark, monkeypatch):
    rows = [(1, ["a", "z", "b"]), (2, []), (3, ["b"]), (4, None), (5, [None, "c"]), (3, ["c"] * 14), (3, ["c"] * 14)]
    df = spark.createDataFrame(rows, "id int, codes array<string>").repartition(3)
    table = spark.createDataFrame([("a", 1.5, ["x", "y"]), ("b", None, []), ("c", 3.0, None)], "code string, v double, w array<string>")
    narrow = sorted(map(repr, G.lookup_each(df, F.col("codes"), table, "code", "v", "out").collect()))
    wide = sorted(map(repr, G.lookup_each(df, F.col("codes"), table, "code", "v", "out", limit=0).collect()))
    assert narrow == wide and len(narrow) == len(rows)
    found = {(r["id"], tuple(r["codes"]) if r["codes"] is not None else None): r["out"] for r in G.lookup_each(df, F.col("codes"), table, "code", "v", "out").collect()}
    assert found[1, ("a", "z", "b")] == [1.5, None, None] and found[2, ()] == [] and found[4, None] is None
    assert found[5, (None, "c")] == [None, 3.0] and found[3, ("c",) * 14] == [3.0] * 14
    lists = [sorted(map(repr, G.lookup_each(df, F.col("codes"), table, "code", "w", "out", limit=n).collect())) for n in (0, 9)]
    assert lists[0] == lists[1]



def test_lookup_each_with_only_the_codes_in_python(spark):
    rows = [(1, ["a", "x", None, "b"]), (1, ["a"]), (2, []), (3, None), (None, ["b", "b"])]
    df = spark.createDataFrame(rows, "id int, codes array<string>").repartition(3)
    table = spark.createDataFrame([("a", 1, ("p",)), ("b", None, ("q",)), (None, 5, ("r",))], "code string, v int, w struct<s:string>")
    for value in ("v", "w"):
        both = [G.lookup_each(df, F.col("codes"), table, "code", value, "out", apart=apart) for apart in (False, True)]
        assert both[0].schema == both[1].schema
        assert sorted(map(repr, both[0].collect())) == sorted(map(repr, both[1].collect()))


def test_stratified_split_rules(spark):
    rows = [(i, "big", "t") for i in range(10)] + [(20, "one", "t"), (21, "none", None), (22, "pair", "t"), (23, "pair", "t")]
    rows += [(24, "half", "t"), (25, "half", None), (None, "big", "d"), (None, "none", "d")]
    df = spark.createDataFrame(rows, "id int, code string, title string")
    out = S.stratified_split(df, "id", "code", "title")
    n = {(r["code"], r["split"]): r["n"] for r in out.groupBy("code", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {
        ("big", "train"): 9, ("big", "test"): 2, ("one", "train"): 1, ("none", "train"): 1,
        ("pair", "train"): 1, ("pair", "test"): 1, ("half", "train"): 2,
    }
    audit = S.split_audit(out, "code").first()
    assert (audit["test_codes"], audit["missing_from_train"]) == (2, 0)


def test_exact_and_head_splits(spark):
    df = spark.range(300)
    out = S.exact_split(df, ["id"], 100, 0.25)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 100, "test": 25}
    assert out.select("id").distinct().count() == 125
    head = S.head_split(df.repartition(5), "id", 5)
    assert sorted(r["id"] for r in head.filter("split = 'validation'").collect()) == list(range(15))
    tied = S.head_split(df.select(F.lit(1).alias("same"), "id").repartition(5), "same", 5)
    assert tied.filter("split = 'validation'").count() == 15 and tied.count() == 300
    nulls = S.head_split(df.select(F.when(F.col("id") < 290, F.lit(None)).otherwise(F.col("id")).alias("k"), "id"), "k", 5)
    assert nulls.filter("split = 'validation' and k is null").count() == 15


def test_holdout_has_no_first_row(spark):
    df = spark.range(100).select("id", (F.col("id") % 20).alias("code"))
    out = S.holdout_of_repeats(df, "code", "id", 30)
    test = [r["id"] for r in out.filter("split = 'test'").collect()]
    assert len(test) == 30 and min(test) >= 20
    assert out.count() == 100


def test_group_samples_and_draws(spark, skewed):
    keyed = skewed.filter("key is not null")
    drawn = S.sample_share_per_group(keyed, ["key"], ["id"], 0.1)
    hot = keyed.filter("key = 'hot'").count()
    assert drawn.filter("key = 'hot'").count() == round(hot * 0.1)
    again = S.sample_with_replacement(keyed, "id", 200)
    assert again.count() == 200 and again.select("id").distinct().count() < 200
    assert abs(S.sample_share(spark.range(20000), ["id"], 0.1).count() - 2000) < 200


def test_others_and_nested(spark):
    tax = spark.createDataFrame(
        [("11", "a", "d"), ("19", "b", "d"), ("25", "c", "d")], "code string, title string, definition string"
    )
    df = spark.createDataFrame(
        [(1, "job", [("11", 0.1), ("25", 0.05), ("19", 0.01), ("11", 0.9)])],
        "id int, name string, p array<struct<code:string,proba:double>>",
    )
    out = X.apply_others(df, "p", 0.2, tax).first()["converted"]
    assert [r["code"] for r in out] == ["19", "25", "19", "11"]
    assert [r["changed"] for r in out] == [True, False, False, False]
    single = df.withColumn("p", F.array(F.struct(F.lit("1").alias("code"), F.lit(0.1).alias("proba"))))
    assert X.apply_others(single, "p", 0.2, tax).first()["converted"][0]["code"] == "1"
    row = X.nested_result(df, "id", ["name"], "p", tax, n=3).first()
    assert row["top_prediction"].asDict() == {"code": "11", "title": "a", "description": "d", "confidence": "10.00%"}
    assert [o["code"] for o in row["other_predictions"]] == ["25", "19"]
    bad = df.withColumn("p", F.transform("p", lambda e: e.withField("code", F.lit("99"))))
    assert X.nested_result(bad, "id", [], "p", tax).first()["top_prediction"]["title"] is None
    with pytest.raises(Exception, match="no title for code 99"):
        X.nested_result(bad, "id", [], "p", tax, require_titles=True).collect()


def test_prefix_hit_without_label(spark):
    df = spark.createDataFrame([(["12"], "123"), (["13"], "123"), (["12"], None)], "p array<string>, l string")
    hits = df.select(X.prefix_hit(F.col("p"), F.col("l")).alias("h")).collect()
    assert [r["h"] for r in hits] == [True, False, None]


def test_a_side_is_broadcast_by_rows_and_bytes(spark):
    """Few rows of long texts are no small side; nested values count as well, and an empty table is small."""
    df = spark.range(100).select("id", F.repeat(F.lit("é"), 500).alias("text"), F.array(F.lit("x" * 50)).alias("words"))
    is_small = G.is_small
    assert is_small(df) and not is_small(df, limit=99)
    assert is_small(df, limit_bytes=120_000) and not is_small(df, limit_bytes=100_000)
    assert not is_small(df.select("words"), limit_bytes=5_000) and is_small(df.select("id"), limit_bytes=2_000)
    assert is_small(df.limit(0), 0, 0) and is_small(spark.range(1).select(F.lit(None).cast("string").alias("t")), 1, 8)


def test_labels_are_encoded_alike_by_a_small_and_a_large_encoding(spark):
    taxonomy = spark.createDataFrame([("11111",), ("11125",), ("23000",), (None,)], "code string")
    encoding = X.build_encoding(taxonomy, "code")
    labels = ["11111", "11129", "23000", "2", "9", "", None, "11111"]
    df = spark.createDataFrame(list(enumerate(labels)), "id int, own string")
    small = {tuple(r) for r in X.encode_labels(df, "own", encoding).collect()}
    large = {tuple(r) for r in X.encode_labels(df, "own", encoding, limit=0).collect()}
    assert small == large and len(small) == 7
    assert {r[0]: r[2:] for r in small}[1] == (0, 0, 0, 1, None)


def test_an_encoding_in_documents_of_few_codes(spark):
    codes = spark.range(25).select((F.col("id") + 10000).cast("string").alias("code"))
    encoding = X.build_encoding(codes, "code")
    documents = X.encoding_to_json(encoding, codes_each=7)
    assert documents.filter("level = 5").count() == 4 and documents.filter("level = 1").count() == 1
    assert {tuple(r) for r in X.encoding_from_json(documents).collect()} == {tuple(r) for r in encoding.collect()}
