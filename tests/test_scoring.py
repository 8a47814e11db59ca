import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from occupipe.operators import cascade as M
from occupipe.operators import scoring as Z
from occupipe.session import shared_dir

WEIGHTS = {1: np.array([[1.0, 0, 0], [0, 1.0, 0]]), 2: np.array([[1.0, 0, 0], [0, 1.0, 0], [0, 0, 2.0]])}
BIAS = {1: np.array([0.0, 0.3]), 2: np.array([0.1, 0.0, -0.2])}


def test_a_model_fed_in_batches(spark):
    """The same probabilities whatever the batch and partition; null vectors have none; empty tables give no rows."""
    def load():
        return Z.softmax_heads(WEIGHTS, BIAS, np.full(3, 0.5), np.full(3, 2.0))

    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3)) * 3
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(40, None), (41, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    for parts, batch in ((1, 7), (5, 512), (3, 1)):
        got = {r["id"]: r for r in Z.probabilities_in_batches(df.repartition(parts), "v", 3, load, [1, 2], batch).collect()}
        assert len(got) == 42 and got[40]["proba_1"] is None and got[41]["proba_2"] is None
        for i in range(40):
            for k in (1, 2):
                exp = np.exp(WEIGHTS[k] @ ((x[i] - 0.5) / 2) + BIAS[k])
                assert np.allclose(got[i][f"proba_{k}"], exp / exp.sum())
    assert Z.probabilities_in_batches(df.limit(0), "v", 3, load, [1, 2]).count() == 0


def test_ranked_levels(spark):
    rows = [(1, [0.2, 0.8], [0.5, 0.1, 0.4], "ba"), (2, [0.6, 0.4], [0.2, 0.3, 0.5], None), (3, None, None, "ab")]
    df = spark.createDataFrame(rows, "id int, proba_1 array<double>, proba_2 array<double>, own string")
    got = {r["id"]: r for r in M.ranked_levels(df, ["id"], {1: ["a", "b"], 2: ["aa", "ab", "ba"]}, "own", {1: 1, 2: 2}).collect()}
    assert [p["code"] for p in got[1]["level_1"]] == ["b"] and got[1]["hit_1"]
    assert [(p["code"], p["proba"]) for p in got[1]["level_2"]] == [("aa", 0.5), ("ba", 0.4)] and got[1]["hit_2"]
    assert [p["code"] for p in got[2]["level_2"]] == ["ba", "ab"] and got[2]["hit_1"] is None
    assert got[3]["level_1"] is None and got[3]["hit_2"] is None


def test_records_are_scored_by_a_saved_pipeline(spark):
    """HTML in, titled predictions out, with a learnable class; null and empty pages pass, odd column names too."""
    words = {"1": "cook grill bake fry", "2": "audit ledger budget invoice"}
    rng = np.random.default_rng(9)
    rows = [
        (i, f"<p>{' '.join(rng.choice(words[c].split(), 12))}</p>", "kept", c + str(i % 2), int(c) - 1, 2 * (int(c) - 1) + i % 2)
        for i in range(40) for c in [str(1 + i // 20)]
    ]
    df = spark.createDataFrame(rows, "id int, html string, branch string, code string, one int, two int")
    taxonomy = spark.createDataFrame([(c, f"title {c}", f"text {c}") for c in ("10", "11", "20")], "code string, title string, definition string")
    saved = shared_dir(spark)
    Z.fit_scoring(df, "html", {1: "one", 2: "two"}, ["cook"], features=64, max_iter=8).save(saved)
    model = PipelineModel.load(saved)
    more = spark.createDataFrame([(90, None, "kept"), (91, "", "kept")], "id int, html string, branch string")
    asked = df.select("id", "html", "branch").unionByName(more).withColumn("cleaned", F.lit("own"))
    out = Z.score_records(model, asked, "id", ["branch", "cleaned"], {1: ["1", "2"], 2: ["10", "11", "20", "21"]}, taxonomy)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 42 and all(r["branch"] == "kept" and r["cleaned"] == "own" for r in got.values())
    assert got[90]["tasks"] == "" and got[91]["tasks"] == "."  # the cleaning ends every text with a stop
    for i in range(40):
        own, other = str(1 + i // 20), {got[i]["top_prediction"]["code"], *(p["code"] for p in got[i]["other_predictions"])}
        assert got[i]["level_1"][0]["code"] == own and got[i]["top_prediction"]["code"][0] == own
        assert other == {"10", "11", "20", "21"}
        for p in [got[i]["top_prediction"], *got[i]["other_predictions"]]:
            assert p["title"] == (None if p["code"] == "21" else f"title {p['code']}")
