import datetime
import hashlib
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from occupipe.sources import readers, records, writers
from occupipe.streaming import stream as ST


def record(**changes):
    base = {
        "uuid": hashlib.md5(b"AD-1").hexdigest(),
        "title": "Cook",
        "description": "<p>Cook&nbsp;food\nwell</p>",
        "minimumYearsExperience": None,
        "numberOfVacancies": 2,
        "skills": [{"id": 1, "skill": "Frying", "uuid": "x", "confidence": 0.5}, {"id": 2, "skill": "Baking"}],
        "postedCompany": {"name": "P", "description": None, "ssicCode": "1", "employeeCount": None},
        "hiringCompany": {"name": "H", "description": "d", "ssicCode": "2", "employeeCount": 7},
        "metadata": {
            "jobPostId": "AD-1", "isPostedOnBehalf": False, "originalPostingDate": "2018-12-20",
            "newPostingDate": "2018-12-21", "expiryDate": "2019-01-20", "totalNumberOfView": 3,
            "totalNumberJobApplication": 1,
        },
        "salary": {"maximum": 3000, "minimum": 2000, "type": {"id": 4, "salaryType": "Monthly"}},
        "other": [1],
    }
    base.update(changes)
    return {k: v for k, v in base.items() if v != "absent"}


DOCS = {
    "full": record(),
    "behalf": record(metadata={**record()["metadata"], "isPostedOnBehalf": True, "originalPostingDate": "2019-12-30"}),
    "nocompany": record(postedCompany=None, hiringCompany=None),
    "nosalary": record(salary=None),
    "notype": record(salary={"maximum": 1, "minimum": 0, "type": None}),
    "noskills": record(skills=[]),
    "lacking": record(title="absent"),
    "nometa": record(metadata="absent"),
    "notfound": {"message": "UUID is not found in the database."},
}


@pytest.fixture
def folder(tmp_path):
    for name, doc in DOCS.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    return str(tmp_path)


def test_flatten_record_shapes(spark, folder):
    parsed = records.parse_records(readers.read_json_records(spark, folder))
    rows = {r["ad_id"]: r for r in records.flatten(parsed).collect()}
    assert set(rows) == {"full", "behalf", "nocompany", "nosalary", "notype", "noskills"}
    full = rows["full"].asDict()
    assert len(full) == 21  # the id, 19 fields and the bucket
    assert full["skills"] == "Frying, Baking" and full["company_name"] == "P" and full["salary_type"] == "Monthly"
    assert full["minimumYearsExperience"] is None and full["bucket"] == "2018-51"
    assert rows["behalf"]["company_name"] == "H" and rows["behalf"]["bucket"] == "2019-01"
    assert rows["nocompany"]["company_name"] is None and rows["nocompany"]["company_ssicCode"] is None
    assert rows["nosalary"]["salary_maximum"] is None and rows["nosalary"]["salary_type"] is None
    assert rows["notype"]["salary_maximum"] == 1.0 and rows["notype"]["salary_type_id"] is None
    assert rows["noskills"]["skills"] == ""
    monthly = records.flatten(parsed, monthly=True).filter("ad_id = 'full'").first()
    assert monthly["bucket"] == "2018-12"
    bad = {r["ad_id"]: r["reject_reason"] for r in records.rejected(parsed).collect()}
    assert bad == {"lacking": "missing required key", "nometa": "missing structure", "notfound": "not found"}
    assert records.reconciliation(parsed).first().asDict() == {"total": 9, "bad": 3, "kept": 6}


def test_changed_since_and_name_filter(spark, folder):
    old = time.time() - 30 * 86400
    os.utime(os.path.join(folder, "full.json"), (old, old))
    since = datetime.datetime.now(datetime.timezone.utc) - datetime.timedelta(days=15)
    names = {r["ad_id"] for r in readers.read_json_records(spark, folder, modified_after=since).collect()}
    assert names == set(DOCS) - {"full"}
    named = readers.read_json_records(spark, folder, name_filter="no*").collect()
    assert {r["ad_id"] for r in named} == {n for n in DOCS if n.startswith("no")}


def test_sinks_round_trip(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    parsed = records.parse_records(readers.read_json_records(spark, folder))
    writers.write_with_quarantine(parsed.drop("record"), f"{out}/tagged")
    assert spark.read.parquet(f"{out}/tagged/rejected=false").count() == 6
    assert spark.read.parquet(f"{out}/tagged/rejected=true").filter("reject_reason is not null").count() == 3
    flat = records.flatten(parsed).select("ad_id", "description", "bucket")
    writers.write_buckets(flat, f"{out}/buckets")
    read_back = lambda: readers.read_csv(spark, f"{out}/buckets", "ad_id string, description string, bucket string")
    assert read_back().filter("ad_id = 'full'").first()["description"] == record()["description"]
    writers.write_buckets(flat.filter("bucket = '2019-01'"), f"{out}/buckets")
    assert read_back().count() == flat.count(), "other buckets stay"
    writers.write_lines(flat, f"{out}/lines", "description")
    assert readers.read_lines(spark, f"{out}/lines").count() == 6
    assert writers.stamped(flat).select("processed_at").distinct().count() == 1
    writers.process_bucket(flat, "description", F.upper("description"), f"{out}/done")
    assert spark.read.option("header", True).csv(f"{out}/done").count() > 0


def test_labelled_csv_checks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t,d,c\n1,x,"line\nbreak", 12 \n2,y,z,34\n', encoding="utf-8")
    schema = "id string, t string, d string, c string"
    columns = {"id": "job_id", "t": "title", "d": "description", "c": "code"}
    rows = readers.labelled_csv(spark, str(tmp_path / "a.csv"), schema, columns, "code").collect()
    assert [(r["code"], r["description"]) for r in rows] == [("12", "line\nbreak"), ("34", "z")]
    with pytest.raises(ValueError, match='"gone" not found'):
        readers.labelled_csv(spark, str(tmp_path / "a.csv"), schema, {"gone": "x"}, "code")
    (tmp_path / "b.csv").write_text("id,t,d,c\n1,x,,5\n")
    with pytest.raises(ValueError, match="1 nulls"):
        readers.labelled_csv(spark, str(tmp_path / "b.csv"), schema, columns, "code")


def test_latin1_and_preamble(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("k,v\n1,é\n".encode("latin-1"))
    assert readers.read_csv(spark, str(tmp_path / "l.csv"), "k int, v string", encoding="ISO-8859-1").first()["v"] == "é"
    (tmp_path / "p.csv").write_text("Title\n\nnote\n\nk,v\n1,a\n2,b\n")
    rows = readers.read_csv_after_preamble(spark, str(tmp_path / "p.csv"), 4, "k int, v string").collect()
    assert [(r["k"], r["v"]) for r in rows] == [(1, "a"), (2, "b")]
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.csv").write_text('Title\nk,v\n1,"x\ny, ""z"""\n\n2,b\n')
    (tmp_path / "many" / "b.csv").write_text("Other\r\nk,v\r\n3,c\r\n")
    rows = readers.read_csv_after_preamble(spark, str(tmp_path / "many"), 1, "k int, v string").collect()
    assert sorted((r["k"], r["v"]) for r in rows) == [(1, 'x\ny, "z"'), (2, "b"), (3, "c")]


def test_streamed_records_equal_batch(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("stream"))
    stream = ST.flatten_stream(ST.read_record_stream(spark, folder, files_per_trigger=2))
    ST.run_all(lambda: ST.append_buckets(stream, f"{out}/sink", f"{out}/check"))
    ST.run_all(lambda: ST.append_buckets(stream, f"{out}/sink", f"{out}/check"))
    streamed = {r["ad_id"]: r["description"] for r in spark.read.parquet(f"{out}/sink").collect()}
    batch = ST.flatten_stream(readers.read_json_records(spark, folder))
    assert streamed == {r["ad_id"]: r["description"] for r in batch.collect()}


def test_stream_skips_ids_of_the_sink(spark, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "sink")
    source.mkdir()
    stream = lambda: spark.readStream.schema("id string, bucket string").json(str(source))
    (source / "1.json").write_text('{"id":"a","bucket":"x"}\n{"id":"b","bucket":"x"}\n{"id":"a","bucket":"x"}\n')
    ST.run_all(lambda: ST.append_unseen(stream(), "id", sink, str(tmp_path / "c")))
    (source / "2.json").write_text('{"id":"b","bucket":"x"}\n{"id":"c","bucket":"y"}\n')
    ST.run_all(lambda: ST.append_unseen(stream(), "id", sink, str(tmp_path / "c")))
    assert sorted(r["id"] for r in ST.appended(spark, sink).collect()) == ["a", "b", "c"]


def test_a_retried_batch_writes_its_rows_once(spark, tmp_path, monkeypatch):
    """A batch that fails between its rows and its ids, and one that fails after both, is written over."""
    source, sink, check = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "c")
    source.mkdir()
    (source / "1.json").write_text('{"id":"a","bucket":"x","n":2}\n{"id":"a","bucket":"x","n":1}\n{"id":null,"bucket":"x","n":3}\n')
    stream = lambda: spark.readStream.schema("id string, bucket string, n int").json(str(source))
    ST.run_all(lambda: ST.append_unseen(stream(), "id", sink, check, order=["n"]))
    for commit in (tmp_path / "c" / "commits").iterdir():
        commit.unlink()  # as if the driver had died before the commit
    (source / "2.json").write_text('{"id":"b","bucket":"x","n":1}\n{"id":"a","bucket":"y","n":0}\n')
    ST.run_all(lambda: ST.append_unseen(stream(), "id", sink, check, order=["n"]))
    got = sorted(((r["id"], r["n"]) for r in ST.appended(spark, sink).collect()), key=str)
    assert got == [("a", 1), ("b", 1), (None, 3)]


def test_stream_repeats_within_watermark(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text(
        '{"id":"a","ts":"2024-01-01T00:00:00"}\n{"id":"a","ts":"2024-01-01T01:00:00"}\n{"id":"b","ts":"2024-01-01T00:00:00"}\n'
    )
    stream = spark.readStream.schema("id string, ts timestamp").json(str(source))
    once = ST.skip_repeats(stream, "id", "ts", "1 day").withColumn("bucket", F.lit("x"))
    ST.run_all(lambda: ST.append_buckets(once, str(tmp_path / "sink"), str(tmp_path / "c")))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "sink")).collect()) == ["a", "b"]


def test_files_of_one_folder_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"x\n2,y"\n2,\n')
    (tmp_path / "b.csv").write_text("\ufeffname,extra col\nz,9\n")
    (tmp_path / "c [d] {1}%20.csv").write_text("id,name\n3,w\n")
    (tmp_path / "header only.csv").write_text("id,other\n")
    (tmp_path / "empty.csv").write_text("")
    out = readers.read_csv_by_header(spark, str(tmp_path), {"id": "int"})
    rows = sorted(((r["id"], r["name"], r["extra col"], r["other"]) for r in out.collect()), key=str)
    assert rows == sorted([(1, "x\n2,y", None, None), (2, None, None, None), (None, "z", "9", None), (3, "w", None, None)], key=str)
    (tmp_path / "twice.csv").write_text("id,id\n1,2\n")
    with pytest.raises(ValueError, match="twice"):
        readers.read_csv_by_header(spark, str(tmp_path))
