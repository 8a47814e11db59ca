"""Queries over sources, sinks and record flattening."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from occupipe.functions import fixed_values as fixed
from occupipe.functions import text as T
from occupipe.plans.cleaning import RAW_SQL, chain_sql
from occupipe.plans.registry import ADS_SQL, query
from occupipe.session import shared_dir, through_table
from occupipe.sources import readers, records, writers


def order_records(t):
    """The documents of the orders, written once and parsed."""
    return records.parse_records(through_table(order_documents(t)))


def order_documents(t):
    """Orders as JSON documents: complete ones, null ones, and two kinds of bad ones."""
    k = F.col("o_orderkey")
    company = lambda tag, present: F.when(
        present,
        F.struct(
            F.concat(F.lit(tag), F.col("o_custkey").cast("string")).alias("name"),
            F.lit("text").alias("description"),
            F.lit("62011").alias("ssicCode"),
            (F.col("o_custkey") % 100).alias("employeeCount"),
        ),
    )
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    fields = [
        F.md5(k.cast("string")).alias("uuid"),
        F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("<p>"), "o_orderstatus", F.lit("</p>")).alias("description"),
        F.when(k % 5 != 0, k % 10).alias("minimumYearsExperience"),
        F.array(
            F.struct(F.lit(1).alias("id"), F.col("o_orderpriority").alias("skill")),
            F.struct(F.lit(2).alias("id"), F.col("o_orderstatus").alias("skill")),
        ).alias("skills"),
        company("posted", k % 9 != 0).alias("postedCompany"),
        company("hiring", k % 3 != 0).alias("hiringCompany"),
        F.struct(
            k.cast("string").alias("jobPostId"),
            (k % 2 == 0).alias("isPostedOnBehalf"),
            day.alias("originalPostingDate"),
            day.alias("newPostingDate"),
            day.alias("expiryDate"),
            (k % 50).alias("totalNumberOfView"),
            (k % 20).alias("totalNumberJobApplication"),
        ).alias("metadata"),
        F.when(
            k % 4 != 0,
            F.struct(
                F.col("o_totalprice").alias("maximum"),
                F.lit(1.0).alias("minimum"),
                F.when(k % 8 != 1, F.struct(F.lit(4).alias("id"), F.lit("Monthly").alias("salaryType"))).alias("type"),
            ),
        ).alias("salary"),
    ]
    keep_nulls = {"ignoreNullFields": "false"}
    whole = F.to_json(F.struct(*fields, (k % 7).alias("numberOfVacancies")), keep_nulls)
    lacking = F.to_json(F.struct(*fields), keep_nulls)
    missing = F.to_json(F.struct(F.lit(fixed.NOT_FOUND_MESSAGE).alias("message")))
    doc = F.when(k % 11 == 0, missing).when(k % 13 == 0, lacking).otherwise(whole)
    return t.spread("orders").select(F.concat(F.lit("AD-"), k.cast("string")).alias("ad_id"), doc.alias("doc"))


FLAT_SQL = """
    WITH o AS (SELECT *, o_orderkey % 2 = 0 AS behalf, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 <> 0 ELSE o_orderkey % 9 <> 0 END AS has_company,
        strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0)
    SELECT 'AD-' || o_orderkey AS ad_id, md5(CAST(o_orderkey AS VARCHAR)) AS uuid, o_orderpriority AS title, '<p>' || o_orderstatus || '</p>' AS description,
        coalesce(CAST(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 10 END AS VARCHAR), 'null') AS years, o_orderkey % 7 AS vacancies,
        o_orderpriority || ', ' || o_orderstatus AS skills,
        CASE WHEN has_company THEN CASE WHEN behalf THEN 'hiring' ELSE 'posted' END || o_custkey END AS company_name,
        CASE WHEN has_company THEN '62011' END AS company_code,
        day AS posted, o_orderkey % 50 AS views, o_orderkey % 20 AS applications,
        CASE WHEN o_orderkey % 4 <> 0 THEN round(o_totalprice, 2) ELSE -1 END AS salary_maximum,
        CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 8 <> 1 THEN 'Monthly' END AS salary_type,
        day[1:4] || '-' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS bucket
    FROM o
"""


@query("flattened_records", FLAT_SQL)
def flattened_records(t):
    return flat_result(records.flatten(order_records(t)))


def flat_result(flat):
    return flat.select(
        "ad_id",
        "uuid",
        "title",
        "description",
        F.coalesce(F.col("minimumYearsExperience").cast("string"), F.lit("null")).alias("years"),
        F.col("numberOfVacancies").alias("vacancies"),
        "skills",
        "company_name",
        F.col("company_ssicCode").alias("company_code"),
        F.col("originalPostingDate").alias("posted"),
        F.col("totalNumberOfView").alias("views"),
        F.col("totalNumberJobApplication").alias("applications"),
        F.coalesce(F.round("salary_maximum", 2), F.lit(-1.0)).alias("salary_maximum"),
        "salary_type",
        "bucket",
    )


@query(
    "quarantined_records",
    """
    SELECT 'AD-' || o_orderkey AS ad_id, CASE WHEN o_orderkey % 11 = 0 THEN 'not found' ELSE 'missing required key' END AS reject_reason
    FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0
    """,
)
def quarantined_records(t):
    return records.rejected(order_records(t)).select("ad_id", "reject_reason")


@query(
    "quarantine_sink",
    """
    SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'not found' WHEN o_orderkey % 13 = 0 THEN 'missing required key' ELSE 'kept' END AS fate,
        count(*) AS n, min('AD-' || o_orderkey) AS first_ad FROM orders GROUP BY 1
    """,
)
def quarantine_sink(t):
    path = shared_dir(t.spark)
    writers.write_with_quarantine(order_records(t).select("ad_id", "doc", "reject_reason"), path)
    back = t.spark.read.parquet(path)
    fate = F.when(F.col("rejected") == "true", F.col("reject_reason")).otherwise("kept")
    return back.groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"), F.min("ad_id").alias("first_ad"))


@query(
    "ingest_reconciliation",
    """
    SELECT count(*) AS total, count(*) FILTER (o_orderkey % 11 = 0 OR o_orderkey % 13 = 0) AS bad,
        count(*) FILTER (o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0) AS kept FROM orders
    """,
)
def ingest_reconciliation(t):
    return records.reconciliation(order_records(t))


@query("incremental_ingest", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'")
def incremental_ingest(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    done = orders.filter("o_orderstatus = 'F'").select("o_orderkey")
    return readers.newer_than(orders, "o_orderkey", done).select("o_orderkey", "o_custkey")


@query("csv_scan", "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents")
def csv_scan(t):
    path = shared_dir(t.spark)
    docs = t.documents.select("doc_id", "lang", "text")
    docs.write.option("header", True).option("escape", '"').csv(path)
    back = readers.read_csv(t.spark, path, docs.schema)
    return back.select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("csv_scan_latin1", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def csv_scan_latin1(t):
    path = shared_dir(t.spark)
    docs = t.documents.select("doc_id", "text")
    docs.write.option("header", True).option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    back = readers.read_csv(t.spark, path, docs.schema, encoding="ISO-8859-1")
    return back.select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "csv_folders_stacked",
    """
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, CAST(s_acctbal AS VARCHAR) FROM supplier
    """,
)
def csv_folders_stacked(t):
    a, b = shared_dir(t.spark), shared_dir(t.spark)
    left = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    right = t.supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("string").alias("balance")
    )
    left.write.option("header", True).csv(a)
    right.write.option("header", True).csv(b)
    return readers.read_csv_dirs(t.spark, {a: left.schema, b: right.schema})


@query(
    "csv_drifted_folder",
    """
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name || chr(10) || 'and, partners', NULL, CAST(s_acctbal AS VARCHAR) FROM supplier
    UNION ALL SELECT n_nationkey, NULL, n_name, NULL FROM nation
    """,
)
def csv_drifted_folder(t):
    """One folder whose files have three headers, in differing column order."""
    path = shared_dir(t.spark)
    parts = [
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        t.supplier.select(
            F.col("s_acctbal").cast("string").alias("balance"),
            F.concat("s_name", F.lit("\nand, partners")).alias("name"),
            F.col("s_suppkey").alias("id"),
        ),
        t.nation.select(F.col("n_name").alias("segment"), F.col("n_nationkey").alias("id")),
    ]
    for part in parts:
        part.repartition(2).write.mode("append").option("header", True).option("escape", '"').csv(path)
    return readers.read_csv_by_header(t.spark, path, {"id": "bigint"}).select("id", "name", "segment", "balance")


@query("line_scan", "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT line, count(*) AS n FROM l GROUP BY line")
def line_scan(t):
    path = shared_dir(t.spark)
    t.documents.select(F.col("text").alias("value")).write.text(path)
    return readers.read_lines(t.spark, path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "csv_after_preamble",
    "SELECT s_suppkey AS id, s_name || chr(10) || 'No. ' || s_suppkey AS name FROM supplier",
)
def csv_after_preamble(t):
    path = shared_dir(t.spark)
    lines = [(f, at, line) for f in (0, 1) for at, line in ((-3, "Table 1"), (-2, ""), (-1, "id,name"))]
    head = t.spark.createDataFrame(lines, "file int, at bigint, value string")
    cell = F.concat(F.lit('"'), "s_name", F.lit("\nNo. "), F.col("s_suppkey").cast("string"), F.lit('"'))
    at = F.col("s_suppkey")
    body = t.supplier.select((at % 2).cast("int").alias("file"), at.alias("at"), F.concat_ws(",", at, cell).alias("value"))
    # Two exports, each with its own preamble; the sort keeps it in front.
    files = head.unionByName(body).repartition("file").sortWithinPartitions("file", "at")
    files.drop("at").write.partitionBy("file").text(path)
    return readers.read_csv_after_preamble(t.spark, path, 2, "id bigint, name string")


@query("bucketed_sink", "SELECT strftime(o_orderdate, '%Y-%m') AS bucket, count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM orders GROUP BY 1")
def bucketed_sink(t):
    path = shared_dir(t.spark)
    orders = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("bucket"))
    writers.write_buckets(orders, path)
    back = readers.read_csv(t.spark, path, "o_orderkey bigint, bucket string")
    return back.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("ids"))


@query(
    "processed_buckets",
    f"SELECT bucket, count(*) AS n, min(ad_id) AS first_ad, max(title) AS last_title, CAST(sum(length(cleaned)) AS BIGINT) AS chars, min(md5(cleaned)) AS least_md5, max(md5(cleaned)) AS most_md5 "
    f"FROM (SELECT *, coalesce({chain_sql(RAW_SQL.replace('{t}', 'description'))}, '') AS cleaned "
    f"FROM (SELECT * REPLACE ('<p>The ' || title || ' role: ' || description || ', no. ' || views || '!</p>' AS description) FROM ({FLAT_SQL}))) GROUP BY bucket",
)
def processed_buckets(t):
    path = shared_dir(t.spark)
    told = F.concat(F.lit("<p>The "), "title", F.lit(" role: "), "description", F.lit(", no. "), F.col("totalNumberOfView").cast("string"), F.lit("!</p>"))
    flat = records.flatten(order_records(t)).select("ad_id", "title", told.alias("description"), "bucket")
    writers.process_bucket(flat, "description", T.clean_final(T.clean_raw(F.col("description"))), path)
    back = readers.read_csv(
        t.spark, path, "ad_id string, title string, description string, processed_at timestamp, bucket string"
    )
    cleaned = F.coalesce("description", F.lit(""))
    return back.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ad_id").alias("first_ad"),
        F.max("title").alias("last_title"),
        F.sum(F.length(cleaned)).alias("chars"),
        F.min(F.md5(cleaned)).alias("least_md5"),
        F.max(F.md5(cleaned)).alias("most_md5"),
    )


@query("line_sink", "SELECT md5(replace(text, chr(10), ' ')) AS text_md5, count(*) AS n FROM documents GROUP BY 1")
def line_sink(t):
    path = shared_dir(t.spark)
    writers.write_lines(t.documents, path, "text")
    return readers.read_lines(t.spark, path).groupBy(F.md5("value").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("nested_sink", f"WITH {ADS_SQL} SELECT ad_id, predicted[1] AS top_code, len(predicted) AS n FROM ads")
def nested_sink(t):
    path = shared_dir(t.spark)
    ads = t.ads().select("ad_id", F.struct(F.col("predicted").alias("codes")).alias("prediction"))
    writers.write_nested(ads, path)
    back = t.spark.read.schema(ads.schema).json(path)
    return back.select(
        "ad_id", F.get("prediction.codes", F.lit(0)).alias("top_code"), F.size("prediction.codes").cast("bigint").alias("n")
    )


def nation_files(t) -> str:
    """One JSON document per nation in a file named by its key, a day apart in time."""
    folder, context = shared_dir(t.spark), t.spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())
    docs = t.nation.select("n_nationkey", F.to_json(F.struct("n_name", F.expr("if(n_nationkey % 3 = 0, null, n_regionkey)").alias("region"))).alias("doc"))
    for row in docs.collect():  # the files of a source, a handful of nations
        file = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/N-{row['n_nationkey']}.json")
        out = fs.create(file)
        out.write(bytearray(row["doc"].encode()))
        out.close()
        fs.setTimes(file, 1_700_000_000_000 + 86_400_000 * row["n_nationkey"], -1)
    return folder


@query(
    "records_by_file_name",
    """SELECT 'N-' || n_nationkey AS ad_id, n_name AS name, n_nationkey % 3 <> 0 AS has_region FROM nation""",
)
def records_by_file_name(t):
    """One document per file, with the id from the file's name; a null key is left out of the text."""
    docs = readers.read_json_records(t.spark, nation_files(t))
    return docs.select("ad_id", F.get_json_object("doc", "$.n_name").alias("name"), F.array_contains(F.json_object_keys("doc"), "region").alias("has_region"))


@query(
    "records_changed_since",
    """SELECT 'N-' || n_nationkey AS ad_id FROM nation WHERE n_nationkey > 5""",
)
def records_changed_since(t):
    """Files changed after a time that is given with a zone other than the session's."""
    since = datetime.fromtimestamp(1_700_000_000 + 5 * 86_400, timezone(timedelta(hours=8)))
    return readers.read_json_records(t.spark, nation_files(t), modified_after=since).select("ad_id")


@query(
    "records_of_matching_files",
    """SELECT 'N-' || n_nationkey AS ad_id FROM nation WHERE CAST(n_nationkey AS VARCHAR) LIKE '1%'""",
)
def records_of_matching_files(t):
    return readers.read_json_records(t.spark, nation_files(t), name_filter="N-1*.json").select("ad_id")


@query(
    "json_lines_scan",
    """
    SELECT 'AD-' || o_orderkey AS ad_id, CASE WHEN o_orderkey % 3 = 0 THEN 'missing' WHEN o_orderkey % 3 = 1 THEN 'null' ELSE o_orderpriority END AS priority,
        'part' AS file_kind, strftime(TIMESTAMP '2023-11-14 00:00:00', '%Y-%m-%d') AS modified FROM orders
    """,
)
def json_lines_scan(t):
    """A splittable scan of one document per line, in which a missing key and a null one differ, with each file's name and time."""
    folder, context = shared_dir(t.spark), t.spark.sparkContext
    key = F.concat(F.lit("AD-"), F.col("o_orderkey").cast("string")).alias("id")
    nothing = {"ignoreNullFields": "false"}
    third = F.col("o_orderkey") % 3
    full = F.to_json(F.struct(key, F.when(third == 2, F.col("o_orderpriority")).alias("priority")), nothing)
    lines = t.orders.select(F.when(third == 0, F.to_json(F.struct(key))).otherwise(full).alias("value"))
    lines.write.text(folder)
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())
    for status in fs.listStatus(path):
        fs.setTimes(status.getPath(), 1_699_948_800_000, -1)
    rows = readers.read_json_lines(t.spark, folder, name_filter="part-*")
    keys = F.json_object_keys("doc")
    shown = F.when(~F.array_contains(keys, "priority"), "missing").otherwise(F.coalesce(F.get_json_object("doc", "$.priority"), F.lit("null")))
    return rows.select("ad_id", shown.alias("priority"), F.substring("file_name", 1, 4).alias("file_kind"), F.date_format("modified", "yyyy-MM-dd").alias("modified"))


@query("missing_column", """SELECT 'column "grade" not found' AS error, count(*) AS n FROM orders""")
def missing_column(t):
    """The error that names an absent column, beside the count of a subset that has all of its columns."""
    try:
        readers.select_renamed(t.orders, {"o_orderkey": "key", "grade": "label"})
        error = None
    except ValueError as found:
        error = str(found)
    kept = readers.select_renamed(t.orders, {"o_orderkey": "key"})
    return kept.agg(F.lit(error).alias("error"), F.count("key").alias("n"))
