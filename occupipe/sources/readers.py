"""File sources. Schemas are given rather than inferred: inference reads the data twice."""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping
from datetime import datetime, timezone
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def text_columns(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def read_csv(
    spark: SparkSession, path: str | list[str], schema: StructType | str, encoding: str = "UTF-8", **options
) -> DataFrame:
    """CSV with a header; quoted cells may hold newlines."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True)
    reader = reader.option("escape", '"').option("encoding", encoding).options(**options)
    return reader.csv(path)


def read_csv_dirs(spark: SparkSession, parts: dict[str, StructType | str], **options) -> DataFrame:
    """Folders of CSV files stacked by column name; missing columns become null.

    One folder per schema: within a folder all files share their columns.
    """
    frames = [read_csv(spark, path, schema, **options) for path, schema in parts.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def read_csv_by_header(
    spark: SparkSession, path: str, types: Mapping[str, str] | None = None, encoding: str = "UTF-8", **options
) -> DataFrame:
    """CSV files of one folder whose columns differ from file to file, stacked by column name.

    A first scan takes each file's own header line, in the map tasks; files of one header are
    then read together, and the groups are united by name, so a column that a file lacks is
    null in its rows. Columns are text unless ``types`` names a type. A header stands on one
    line and names each column once; files without a header line give no rows.
    """
    # No text holds this separator, so a line is one cell whatever its encoding.
    lines = spark.read.schema("value string").option("sep", "\x01").option("quote", "").option("encoding", encoding).csv(path)
    placed = lines.select("value", F.monotonically_increasing_id().alias("at"), "_metadata.file_path", "_metadata.file_block_start")
    first = placed.groupBy("file_path").agg(F.min_by("value", F.struct("file_block_start", "at")).alias("header"))
    groups = first.groupBy("header").agg(F.sort_array(F.collect_list("file_path")).alias("files")).collect()
    frames = []
    for group in sorted(groups, key=lambda g: g["files"][0]):
        names = next(csv.reader([group["header"].lstrip("\ufeff")], delimiter=options.get("sep", ",")))
        if len(set(names)) < len(names):
            raise ValueError(f"{group['files'][0]} names a column twice: {names}")
        kinds = ", ".join(f"`{n.replace('`', '``')}` {(types or {}).get(n, 'string')}" for n in names)
        # Paths come as URLs; what a path pattern would read as special is escaped.
        files = [re.sub(r"([][{}*?\\])", r"\\\1", unquote(f)) for f in group["files"]]
        frames.append(read_csv(spark, files, kinds, encoding=encoding, **options))
    if not frames:
        return spark.createDataFrame([], StructType([]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_csv_after_preamble(spark: SparkSession, path: str, skip: int, schema: StructType | str) -> DataFrame:
    """CSV whose header follows ``skip`` lines in every file, as in spreadsheet exports.

    Each file is cut after its own header and parsed as a whole, so quoted cells may hold
    newlines. Such exports are small files: one file is one row here.
    """
    whole = spark.read.text(path, wholetext=True)
    rest = F.regexp_replace("value", rf"^(?:[^\r\n]*(?:\r\n|\n|\r)){{0,{skip + 1}}}", "")
    # A row ends at a line end outside quotes: an even number of quotes stands before it.
    rows = F.regexp_extract_all(rest, F.lit(r'(?:[^"\r\n]++|"(?:[^"]++|"")*+")++'), F.lit(0))
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = whole.select(F.explode(rows).alias("line")).filter(F.trim("line") != "")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    parsed = F.from_csv("line", columns, {"escape": '"'})
    return lines.select(parsed.alias("row")).select("row.*")


def read_json_records(
    spark: SparkSession,
    path: str,
    modified_after: datetime | None = None,
    name_filter: str | None = None,
) -> DataFrame:
    """One JSON document per file as raw text, with the id taken from the file name.

    Raw text keeps the difference between a missing key and a null one. Only files
    changed since ``modified_after`` and matching ``name_filter`` are opened.
    """
    found = _filtered(spark, modified_after, name_filter).option("wholetext", True).format("text").load(path)
    return found.select(file_id().alias("ad_id"), F.col("value").alias("doc"))


def _filtered(spark: SparkSession, modified_after: datetime | None, name_filter: str | None):
    reader = spark.read
    if modified_after is not None:
        # A time without a zone is in the session's.
        if modified_after.tzinfo is not None:
            reader = reader.option("timeZone", "UTC")
            modified_after = modified_after.astimezone(timezone.utc)
        reader = reader.option("modifiedAfter", modified_after.strftime("%Y-%m-%dT%H:%M:%S"))
    return reader if name_filter is None else reader.option("pathGlobFilter", name_filter)


def read_json_lines(
    spark: SparkSession, path: str, id_path: str = "$.id", modified_after: datetime | None = None, name_filter: str | None = None
) -> DataFrame:
    """One JSON document per line as raw text, with the id at ``id_path`` in it, the file's name and its time.

    Files are read in splits, and raw text keeps the difference between a missing key and a null one.
    """
    lines = _filtered(spark, modified_after, name_filter).format("text").load(path)
    doc = F.col("value")
    return lines.filter(F.trim(doc) != "").select(
        F.get_json_object(doc, id_path).alias("ad_id"), doc.alias("doc"),
        F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("modified"),
    )


def file_id():
    """The file's name without its JSON suffix."""
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of text."""
    return spark.read.text(path)


def newer_than(df: DataFrame, key: str, done: DataFrame) -> DataFrame:
    """Rows whose id the sink does not hold yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def select_renamed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Subset and rename; an absent column is an error that names it."""
    for name in columns:
        if name not in df.columns:
            raise ValueError(f'column "{name}" not found')
    return df.select([F.col(old).alias(new) for old, new in columns.items()])


def require_no_nulls(df: DataFrame) -> DataFrame:
    """Return the frame, or fail with the number of nulls found."""
    counts = [F.count_if(F.col(c).isNull()) for c in df.columns]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    found = df.agg(total.alias("n")).first()["n"]
    if found:
        raise ValueError(f"{found} nulls detected in the data")
    return df


def labelled_csv(spark: SparkSession, path: str, schema: StructType | str, columns: dict[str, str], code: str) -> DataFrame:
    """Read, subset, rename and check a labelled set. Nulls are counted before any cast."""
    from occupipe.functions.text import as_trimmed_string

    named = select_renamed(read_csv(spark, path, schema), columns)
    return require_no_nulls(named).withColumn(code, as_trimmed_string(F.col(code)))
