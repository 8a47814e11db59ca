"""The pipeline's stages on rows with planted cases, and the registry."""

import numpy as np
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from occupipe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's rows on planted documents."""
    from tests.llm.test_corpus_operators import prose

    folder = tmp_path_factory.mktemp("planted")
    leak = prose(900, 25)
    passage = prose(901, 60)
    docs = [(i, prose(i, 200 if i == 15 else 80) + (" grobling" if i % 10 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(200)]
    docs += [(300 + i, docs[i][1], "en", "s0", 1) for i in range(1, 6)]  # exact copies
    near = docs[15][1].split()
    near[190] = "changed"
    docs += [(400, " ".join(near), "en", "s0", 1)]
    docs += [(500 + i, f"{prose(600 + i, 30)}. {leak.upper()}. {prose(650 + i, 30)}", "en", "s1", 1) for i in range(2)]
    docs += [(700 + i, f"{prose(750 + i, 40)}.\n{passage}.\n{prose(780 + i, 40)}.", "en", "s2", 1) for i in range(6)]
    docs += [(800, None, "en", None, None), (801, "", None, "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 10 == 0)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, str(folder)).write.parquet(f"{folder}/out-{name}")
        rows = spark.read.parquet(f"{folder}/out-{name}")
        seen[name] = rows.toPandas()
    return seen, str(folder)


def test_stages_catch_what_was_planted(stages):
    seen, _ = stages
    ids = {name: set(rows.doc_id.dropna()) for name, rows in seen.items()}
    clean = {i for i in range(200) if i % 10}
    assert ids["toxicity"] == clean | {300 + i for i in range(1, 6)} | {400} | {500 + i for i in range(2)} | {700 + i for i in range(6)} | {800, 801}
    texts = seen["line_dedup"].set_index("doc_id").text
    kept = [i for i in range(700, 706) if len(texts[i].split()) > 120]
    assert kept == [700] and all(len(texts[i].split()) == 80 for i in range(701, 706))
    assert all(len(texts[i].split()) == (200 if i == 15 else 80) for i in clean)  # a pair of copies is no template
    assert clean <= ids["near_duplicates"] and not ids["near_duplicates"] & {400, *range(301, 306)}
    assert ids["near_duplicates"] - ids["decontamination"] == {500 + i for i in range(2)}
    assert ids["packing"] == ids["decontamination"] and len(ids["packing"]) == len(clean) + 7


def test_near_duplicates_are_those_of_the_simhash_operator(spark):
    """Of each component the row of the smallest id stays; other columns may clash with inner names."""
    from occupipe.llm import simhash
    from tests.llm.test_corpus_operators import prose

    docs = [(i, prose(i % 40, 60 + i % 3), "x", 1) for i in range(90)] + [(200, None, "x", 1), (201, "", "x", 1), (None, prose(1, 60), "x", 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, _later_id string, node int")
    roots = {r.doc_id: r.component_id for r in simhash.near_duplicates(table, words=4, radius=4).collect()}
    got = corpus_pipeline.near_duplicates(spark, table, "")
    assert got.columns == table.columns
    kept = [r.doc_id for r in got.collect()]
    assert sorted(i for i in kept if i is not None) == sorted({r for i, r in roots.items() if i is not None}) and len(kept) < 60


def test_pipeline_of_empty_tables(spark, tmp_path):
    """No documents give no rows; no labels and no benchmark items reject nothing."""
    from tests.llm.test_corpus_operators import prose

    full = [(i, prose(i, 60), "en", "s", 1) for i in range(4)]
    for name, rows in (("none", []), ("some", full)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {r[0] for r in rows}


def test_columns_are_those_of_documents(stages):
    seen, _ = stages
    for name in ("toxicity", "line_dedup", "near_duplicates", "decontamination"):
        assert list(seen[name].columns) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_is_the_chain_of_stages(spark, stages):
    seen, folder = stages
    got = corpus_pipeline.run(spark, folder).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    total = lambda rows: rows.groupby("doc_id", dropna=False).length.sum().to_dict()
    assert total(got) == total(seen["packing"]) and set(got.columns) >= set(key)


def test_registered_queries(spark):
    found = {name.split("_")[0] for name in QUERIES}
    assert found == {f"op{n}" for n in range(1, 14)} and set(QUERIES) <= set(queries()) and "pipeline" in queries()
    assert {n.split("_")[0] for n in QUERIES if n in oracle_sql()} == {"op3", "op11", "op12", "op13"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_whole_table(spark, name):
    got = queries()[name](spark, FOLDER).toPandas()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").toPandas()
    if name in oracle_sql():
        assert_matches_sql(got, oracle_sql()[name])
    elif name.startswith("op7"):
        assert len(got) and set(got.doc_id) <= set(docs.doc_id)
    else:
        assert set(got.doc_id) == set(docs.doc_id)
    if name.startswith(("op1_", "op9_")):
        assert ((got.score >= 0.5).astype(int) == got.predicted).all() and got.held_out.dtype == np.bool_


def assert_matches_sql(got, sql):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "pages"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    want = con.execute(sql).df()
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows[list(want.columns)].values.tolist())
    assert set(got.columns) == set(want.columns) and len(want) and plain(got) == plain(want)
