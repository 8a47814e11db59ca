import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from occupipe.functions import fixed_values as fixed
from occupipe.operators import augment as G
from occupipe.operators import cascade as M
from occupipe.operators import corpus as C
from occupipe.operators import evaluate as E
from occupipe.operators import joins as J
from occupipe.operators import search as R
from occupipe.operators import split as S


def test_title_search_matches_a_full_scan(spark):
    words = ["cook", "chef", "it", "ab", "x", "head", "cooking", "manager", "night"]
    rng = np.random.default_rng(3)
    ads = [(i, " ".join(rng.choice(words, rng.integers(1, 5))).title(), "Shift" if i % 5 else "Day") for i in range(200)]
    wanted = [("1", "Cook (head)"), ("1", "head chef"), ("2", "it"), ("3", "x"), ("4", "night manager"), ("5", ""), ("6", "zzz")]
    got = R.title_search(
        spark.createDataFrame(ads, "id int, title string, text string"), "id", "title",
        spark.createDataFrame(wanted, "code string, title string"), ["ab"], "text", ["day"],
    ).collect()
    want = set()
    for i, title, text in ads:
        low = title.lower()
        for code, t in wanted:
            plain = t.lower().replace("(head)", "").strip()
            if plain and all(w in low for w in plain.split(" ")) and "ab" not in low and text != "Day":
                want.add((code, i))
    assert {(r["code"], r["id"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_similar_vectors_broadcast_and_grid(spark, limit):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(23, 6)), rng.normal(size=(150, 6))
    b[7] = 0
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id int, vector array<double>")
    got = R.similar_vectors(frame(a), frame(b).repartition(5), 4, 0.2, broadcast_bytes=limit, block_rows=10).collect()
    sims = (a / np.linalg.norm(a, axis=1)[:, None]) @ np.where(
        np.linalg.norm(b, axis=1)[:, None] > 0, b / np.maximum(np.linalg.norm(b, axis=1)[:, None], 1e-300), 0
    ).T
    want = set()
    for i in range(len(a)):
        best = sorted((-s, j) for j, s in enumerate(sims[i]) if s >= 0.2)[:4]
        want |= {(i, j) for _, j in best}
    assert {(r["source"], r["target"]) for r in got} == want and len(got) == len(want)


def test_many_sources_are_not_collected(spark, monkeypatch):
    """Sources of few bytes but many rows meet the targets in blocks; one task would keep the best of all of them."""
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(df):
        raise AssertionError("collected")

    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    words = spark.range(R.BROADCAST_BYTES // 800).select(F.concat(F.lit("w"), "id").alias("word"), F.array(F.rand(1), F.rand(2)).alias("vector"))
    assert G.neighbour_table(words, 3).columns == ["word", "replacement"]


@pytest.mark.parametrize("size, n, threshold", [(3000, 5, -1.0), (900, 40, 0.2), (2, 5, -1.0)])
def test_best_targets_in_single_precision_first(size, n, threshold):
    """Ties, near ties, zero vectors and vectors of no numbers: the rows of a full sort by the exact products."""
    rng = np.random.default_rng(5)
    targets = R._unit(rng.normal(size=(size, 6)))
    targets[size // 2 :] = targets[: size - size // 2] if size < 2000 else targets[: size - size // 2] + 1e-9 * rng.normal(size=(size - size // 2, 6))
    targets[size // 3] = 0
    if size > 2:
        targets[size // 4] = np.nan
    sources = R._unit(rng.normal(size=(70, 6)))
    sims = np.stack([np.einsum("ij,ij->i", np.broadcast_to(s, targets.shape), targets) for s in sources])
    at, target, sim = R._compare(sources, targets, np.arange(size), n, threshold)
    want = [(i, j, sims[i, j]) for i in range(70) for j in sorted(np.flatnonzero(sims[i] >= threshold), key=lambda j: (-sims[i, j], j))[:n]]
    assert list(zip(at.tolist(), target.tolist(), sim.tolist())) == want


def test_dissimilar_sample_is_greedy(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id int, v array<double>")
    got = [r["id"] for r in R.dissimilar_sample(df, "id", "v", 8).orderBy("round").collect()]
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for at in range(1, 8):
        scores = {j: round(float(unit[j] @ unit[got[:at]].sum(axis=0)), 9) for j in range(40) if j not in got[:at]}
        assert scores[got[at]] == min(scores.values())
    assert len(set(got)) == 8


@pytest.mark.parametrize("fetched", [1, 5, 4096])
def test_dissimilar_sample_settles_rounds_exactly(spark, fetched):
    """However many rows a pass fetches, the rounds are those of one pass each; ties go to the smaller key."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(30, 4)) + [1.5, 0, 0, 0]
    v = np.vstack([v, v[:6], v[3:5], np.zeros((1, 4))])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(90, None), (None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(3)
    got = [r["id"] for r in R.dissimilar_sample(df, "id", "v", 12, fetched=fetched).orderBy("round").collect()]
    norms = np.linalg.norm(v, axis=1)[:, None]
    unit = np.divide(v, norms, out=np.zeros_like(v), where=norms > 0)
    want = got[:1]
    while len(want) < 12:
        sums = np.round(unit @ unit[want].sum(axis=0), 9)
        want.append(min((s, i) for i, s in enumerate(sums) if i not in want)[1])
    assert got == want
    assert R.dissimilar_sample(df, "id", "v", 99, fetched=fetched).count() == len(v)
    assert R.dissimilar_sample(df.limit(0), "id", "v", 3).count() == 0


def test_packing_keeps_order_and_size(spark):
    rows = [(s, d, list(range(s * 1000 + d * 100, s * 1000 + d * 100 + n))) for s, d, n in [(0, 0, 5), (0, 1, 0), (0, 2, 17), (0, 3, 2), (1, 0, 3)]]
    df = spark.createDataFrame(rows, "shard int, doc int, ids array<int>").repartition(3)
    got = {(r["shard"], r["block"]): r["input_ids"] for r in C.pack_blocks(df, "shard", "doc", "ids", 4).collect()}
    flat = [t for s, _, ids in rows if s == 0 for t in ids]
    assert got == {(0, i): flat[i * 4 : i * 4 + 4] for i in range(len(flat) // 4)}


def test_masks(spark):
    df = spark.range(200).select("id", F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: i.cast("int") + 10).alias("ids"))
    out = C.mask_tokens(df, "id", "ids", 0, share=0.2, vocab_size=9, seed=4)
    flat = [(i, t, lab) for r in out.collect() for i, (t, lab) in enumerate(zip(r["ids"], r["labels"]))]
    assert all(t == i + 11 for i, t, lab in flat if lab == fixed.IGNORE_LABEL)
    chosen = [(t, lab) for i, t, lab in flat if lab != fixed.IGNORE_LABEL]
    assert all(lab >= 11 for _, lab in chosen) and 0.17 < len(chosen) / len(flat) < 0.23
    assert 0.75 < sum(t == 0 for t, _ in chosen) / len(chosen) < 0.9
    again = C.mask_tokens(df.repartition(7), "id", "ids", 0, share=0.2, vocab_size=9, seed=4)
    assert {r["id"]: r["ids"] for r in again.collect()} == {r["id"]: r["ids"] for r in out.collect()}


def test_whole_words_are_masked_together(spark):
    words = [0, 0, 1, None, 1, 2, 2, 2, 0, 0]
    df = spark.range(300).select(
        "id", F.array(*[F.lit(i + 100) for i in range(10)]).alias("ids"), F.array(*[F.lit(w).cast("int") for w in words]).alias("w")
    )
    runs = [(0, 1), (2, 4), (5, 6, 7), (8, 9)]
    rows = C.mask_whole_words(df, "id", "ids", "w", 1, share=0.5).collect()
    assert 0 < sum(r["ids"][0] == 1 for r in rows) < 300
    assert any(r["ids"][0] == 1 and r["ids"][8] != 1 for r in rows), "a repeated number is another word"
    for r in rows:
        assert r["ids"][3] == 103
        for run in runs:
            assert len({r["ids"][i] == 1 for i in run}) == 1
        assert all((lab == i + 100) == (r["ids"][i] == 1) for i, lab in enumerate(r["labels"]))


def test_encoding_by_map_and_by_join(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "B a, é!"), (2, "  "), (3, "zz a"), (4, None), (5, "")], "id int, text string")
    vocab = C.vocabulary(docs, "text", first_id=2)
    assert [r["token"] for r in vocab.orderBy("token_id").collect()] == ["!", ",", "a", "b", "zz", "é"]
    small = vocab.filter("token <> 'zz'")
    mapped = {r["id"]: (r["input_ids"], r["word_ids"]) for r in C.encode_tokens(docs, "id", "text", small, 1).collect()}
    monkeypatch.setattr(C, "VOCABULARY_LIMIT", 0)
    joined = {r["id"]: (r["input_ids"], r["word_ids"]) for r in C.encode_tokens(docs, "id", "text", small, 1).collect()}
    assert mapped == joined == {1: ([5, 4, 3, 7, 2], [0, 1, 2, 3, 4]), 3: ([1, 4], [0, 1])}
    row = docs.limit(1).select(C.fixed_length(F.array(F.lit(7), F.lit(8), F.lit(9)), 2).alias("a"), C.fixed_length(F.array(F.lit(7)), 3).alias("b")).first()
    assert (row["a"]["input_ids"], row["a"]["attention_mask"]) == ([7, 8], [1, 1])
    assert (row["b"]["input_ids"], row["b"]["attention_mask"]) == ([7, 0, 0], [1, 0, 0])


@pytest.mark.parametrize("limit", [500_000, 0])
def test_substitution_counts(spark, monkeypatch, limit):
    monkeypatch.setattr(G, "LEXICON_LIMIT", limit)
    text = " ".join(["cat"] * 30 + ["dog"] * 10)
    df = spark.createDataFrame([(1, text), (2, "dog only"), (3, None), (4, ""), (5, "  "), (6, "cat"), (6, "cat")], "id int, text string")
    table = spark.createDataFrame([("cat", "lion"), ("cat", "tiger")], "word string, replacement string")
    rows = {r["id"]: r["out"] for r in G.substitute_words(df, "id", "text", table, "out").collect()}
    new = rows[1].split(" ")
    assert len(new) == 40 and sum(w in ("lion", "tiger") for w in new) == 20 and new.count("dog") == 10
    assert rows[2] == "dog only" and rows[3] is None and rows[4] == "" and rows[6] in ("lion", "tiger")
    monkeypatch.setattr(G, "LEXICON_LIMIT", 500_000 - limit)
    other = sorted(map(repr, G.substitute_words(df, "id", "text", table, "out").collect()))
    assert other == sorted(map(repr, G.substitute_words(df, "id", "text", table, "out").collect())) and len(other) == 7


def test_injection_adds_phrases(spark):
    df = spark.createDataFrame([(i, "One. Two. Three") for i in range(30)], "id int, text string")
    out = df.select(G.inject_phrases(F.col("id"), F.col("text"), 0.5).alias("t")).collect()
    for r in out:
        parts = r["t"].split(".")
        assert len(parts) == 15 and parts[-1] == " Three"
        assert [p for p in parts if p in ("One", " Two", " Three")] == ["One", " Two", " Three"]
        added = [p for p in parts if p not in ("One", " Two", " Three")]
        assert set(added) <= set(fixed.COMMON_PHRASES) and len(set(added)) == 12
    assert len({r["t"] for r in out}) > 20


def test_variant_rows_keep_originals_in_test(spark):
    df = spark.createDataFrame([(1, "train", "a b. c"), (2, "test", "d. e")], "id int, split string, description string")
    wide = G.augment_wide(df, "id", "description", {"up": lambda d, n: G.rewrite(d, "description", n, lambda s: s.str.upper())}, 0.1)
    assert wide.filter("id = 1").first()["description"] == "a b. c"
    rows = G.split_variants(wide, ["id"], "description", ["up"]).collect()
    assert sorted((r["id"], r["variant"]) for r in rows) == [(1, "description"), (1, "up"), (2, "description")]


def test_neighbours_exclude_the_word(spark):
    df = spark.createDataFrame([(w, [float(i), 1.0]) for i, w in enumerate("abcdefgh")], "word string, vector array<double>")
    table = G.neighbour_table(df, 3).collect()
    assert len(table) == 24 and all(r["word"] != r["replacement"] for r in table)


@pytest.fixture(scope="module")
def coded(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        a, b = i % 3, (i // 3) % 2
        v = rng.normal(scale=0.3, size=6)
        v[a] += 2
        v[3 + b] += 2
        rows.append((i, [float(x) for x in v], a, a * 2 + b, f"{a}{b}"))
    df = spark.createDataFrame(rows, "id int, e array<double>, idx_1 int, idx_2 int, code string")
    return S.random_split(M.with_vector(df, "e", "features"), ["id"])


def test_cascade_beats_the_majority(coded):
    labels = {1: "idx_1", 2: "idx_2"}
    train, test = coded.filter("split = 'train'"), coded.filter("split = 'test'")
    model = M.fit_cascade(train, "features", labels, max_iter=20)
    widths = lambda m: [s.numFeatures for s in m.stages if hasattr(s, "numFeatures")]
    assert widths(model) == [6, 9], "level 2 sees the three scores of level 1"
    losses = {r["side"]: r for r in M.train_and_validation(model, train, test, labels).collect()}
    assert losses["validation"]["accuracy"] > 0.9
    names = {1: ["0", "1", "2"], 2: ["00", "01", "10", "11", "20", "21"]}
    scored = M.score_levels(model, test, "id", names, "code", {1: 1, 2: 2})
    assert scored.agg(F.avg(F.col("hit_2").cast("int"))).first()[0] > 0.9
    assert {level for level, _, _ in M.training_history(model)} == {1, 2}
    trees = M.fit_cascade(train, "features", labels, trees=True)
    assert widths(trees) == [6, 9]


def test_expanded_labels_do_not_leak(coded):
    rows = M.class_expanded(coded, "features", 3, "idx_1").select("id", "class", "is_class", M.vector_to_array("expanded").alias("v"))
    for r in rows.filter("id < 6").collect():
        assert r["v"][6:] == [float(c == r["class"]) for c in range(3)]
    assert rows.filter("is_class = 1").count() == 240


def test_pooling_head_and_zero_vector(spark):
    row = spark.range(1).select(
        M.mean_pooling(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(5.0), F.lit(6.0))), F.array(F.lit(1.0), F.lit(0.0)), 2).alias("a"),
        M.mean_pooling(F.array(F.array(F.lit(1.0), F.lit(2.0))), F.array(F.lit(0.0)), 2).alias("b"),
    ).first()
    assert row["a"] == [1.0, 2.0] and row["b"] == [0.0, 0.0]
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    p = M.linear_head(df, "v", [[1.0, 0.0], [0.0, 1.0]], [0.0, 0.5], [1.0, 1.0], [1.0, 2.0]).first()["probabilities"]
    assert p == pytest.approx(list(np.exp([0, 1.0]) / np.exp([0, 1.0]).sum()))
    vectors = spark.createDataFrame([("cook", [1.0, 3.0])], "word string, vector array<double>")
    docs = spark.createDataFrame([(1, ["cook", "zz"]), (2, ["zz"])], "id int, tokens array<string>")
    assert {r["id"]: r["doc_vector"] for r in M.mean_of_words(docs, "id", "tokens", vectors, 2).collect()} == {1: [1.0, 3.0], 2: [0.0, 0.0]}


def test_counts_skip_null_titles(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "x")], "code string, title string")
    assert {r["code"]: r["n"] for r in E.count_of(df, "code", "title").collect()} == {"a": 0, "b": 1}


def test_perplexity_overflows_to_infinity(spark):
    df = spark.createDataFrame([(1e6,)], "nll double")
    assert E.perplexity(df, "nll").first()["perplexity"] == float("inf")


def test_matrix_to_long(spark):
    df = spark.createDataFrame([("1", 1.0, 0.2), ("2", 0.2, 1.0)], "code string, `1` double, `2` double")
    assert {(r["code_a"], r["code_b"]): r["sim"] for r in J.matrix_to_long(df, "code").collect()}[("1", "2")] == 0.2


def test_a_probability_of_zero_counts_in_the_loss(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.0, 1.0), (None, 1.0)], "p1 double, p2 double")
    got = E.weighted_loss(df, {1: "p1", 2: "p2"}, {1: 2.0, 2: 1.0}).first()["loss"]
    import math

    assert got == pytest.approx(2 * (math.log(2) - math.log(1e-15)) / 2)


def test_title_search_in_blocks_of_titles(spark):
    """The same rows however many titles a task is given; overlapping words, one-letter words, nulls and repeated rows."""
    from occupipe.operators.search import title_search

    texts = ["abcab", "a b c", "ABC tab", None, "", "cabin crew lead", "crew", "crew", "é à la carte", "xaxbx"]
    ads = spark.createDataFrame([(i % 8, t) for i, t in enumerate(texts)], "id int, t string").repartition(3)
    titles = [(1, "ab"), (1, "bca"), (2, "a b c"), (3, "crew lead"), (4, "crew"), (5, "la carte é"), (6, ""), (7, None), (4, "cabin"), (None, "tab")]
    wanted = spark.createDataFrame(titles, "code int, title string")
    want = set()
    for i, t in enumerate(texts):
        for code, title in titles:
            words = (title or "").split()
            if t is not None and words and all(w in t.lower() for w in words):
                want.add((code, i % 8))
    for sent in (1, 3, 1000):
        got = [(r["code"], r["id"]) for r in title_search(ads, "id", "t", wanted, titles_sent=sent).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert title_search(ads, "id", "t", wanted.limit(0)).count() == 0


def test_title_search_keeps_ads_without_a_description(spark):
    from occupipe.operators.search import title_search

    ads = spark.createDataFrame([(1, "Data Clerk", None), (2, "Data Clerk", "a scam offer"), (3, "Data Clerk", "fine")], "id int, t string, d string")
    wanted = spark.createDataFrame([("11", "data clerk")], "code string, title string")
    found = title_search(ads, "id", "t", wanted, description="d", exclude_description=["scam"])
    assert {r["id"] for r in found.collect()} == {1, 3}


def test_boosted_cascade_and_its_curve(spark):
    """Train loss falls tree by tree, a later level sees earlier margins, and held rows are hit well above chance."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        x = rng.normal(size=3)
        first = int(x[0] > 0)
        rows.append((i, Vectors.dense(x.tolist()), first, first + int(first and x[1] > 0), i % 4 == 0))
    df = spark.createDataFrame(rows, ["id", "features", "one", "two", "held"])
    cascade, curve = M.fit_boosted_cascade(df, "features", {1: "one", 2: "two"}, "held", trees=3, depth=2)
    assert [len(cascade.models[k]) for k in (1, 2)] == [1, 3]
    assert cascade.models[1][0].numFeatures == 3 and cascade.models[2][0].numFeatures == 5
    losses = {}
    for r in curve.orderBy("level", "class", "iteration").collect():
        losses.setdefault((r["level"], r["class"]), []).append((r["train_loss"], r["validation_loss"]))
    assert set(losses) == {(1, 1), (2, 0), (2, 1), (2, 2)}
    for both in losses.values():
        train = [a for a, _ in both]
        assert 1 <= len(both) <= 3 and train == sorted(train, reverse=True) and all(b > 0 for _, b in both)
    held = cascade.transform(df.filter("held")).select("one", "two", "pred_1", "pred_2", "margins_2").collect()
    assert len(held) == 60 and all(len(r["margins_2"]) == 3 for r in held)
    assert np.mean([r["one"] == r["pred_1"] for r in held]) > 0.85
    assert np.mean([r["two"] == r["pred_2"] for r in held]) > 0.75
