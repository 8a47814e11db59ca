"""Flatten nested ad records and set unusable ones aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occupipe.functions import codes as K
from occupipe.functions import fixed_values as fixed
from occupipe.functions.binding import let

COMPANY = "struct<name:string,description:string,ssicCode:string,employeeCount:bigint>"
RECORD = f"""
    struct<
        message:string,
        uuid:string,
        title:string,
        description:string,
        minimumYearsExperience:bigint,
        numberOfVacancies:bigint,
        skills:array<struct<id:bigint,skill:string,uuid:string,confidence:double>>,
        postedCompany:{COMPANY},
        hiringCompany:{COMPANY},
        metadata:struct<
            jobPostId:string,
            isPostedOnBehalf:boolean,
            originalPostingDate:string,
            newPostingDate:string,
            expiryDate:string,
            totalNumberOfView:bigint,
            totalNumberJobApplication:bigint>,
        salary:struct<maximum:double,minimum:double,type:struct<id:bigint,salaryType:string>>>
"""
STRUCTURE_KEYS = ["skills", "metadata"]


GATE = "struct<message:string,skills:array<string>,metadata:string>"


def reject_reason(doc: Column) -> Column:
    """Why a document cannot be flattened; null if it can.

    A required key that is present with a null value is accepted, one that is missing is
    not. So the keys are read from the text, which tells the two apart. The reason does
    not use the full record: a filter on it would otherwise parse the record once more
    for every field it looks at.
    """
    def reason(seen: Column) -> Column:
        lacks = lambda names: F.size(F.array_intersect(seen["keys"], F.array(*[F.lit(n) for n in names]))) < len(names)
        gate = seen["gate"]
        return (
            F.when(seen["keys"].isNull(), "not a JSON object")
            .when(gate["message"] == fixed.NOT_FOUND_MESSAGE, "not found")
            .when(lacks(fixed.REQUIRED_KEYS), "missing required key")
            .when(
                lacks(STRUCTURE_KEYS) | gate["skills"].isNull() | gate["metadata"].isNull(), "missing structure"
            )
        )

    seen = F.struct(F.json_object_keys(doc).alias("keys"), F.from_json(doc, GATE).alias("gate"))
    return let(seen, reason)


def parse_records(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Add the parsed record and the reason for rejection, if any."""
    parsed = df.withColumn("record", F.from_json(doc, RECORD))
    return parsed.withColumn("reject_reason", reject_reason(F.col(doc)))


def flat_columns(record: Column) -> list[Column]:
    """The 19 flat fields. A null struct gives null fields."""
    company = F.when(record["metadata"]["isPostedOnBehalf"], record["hiringCompany"]).otherwise(
        record["postedCompany"]
    )
    salary = record["salary"]
    meta = record["metadata"]
    return [
        *[record[k].alias(k) for k in fixed.REQUIRED_KEYS],
        F.array_join(F.transform(record["skills"], lambda s: s["skill"]), ", ").alias("skills"),
        company["name"].alias("company_name"),
        company["description"].alias("company_description"),
        company["ssicCode"].alias("company_ssicCode"),
        company["employeeCount"].alias("company_employeeCount"),
        *[
            meta[k].alias(k)
            for k in (
                "originalPostingDate",
                "newPostingDate",
                "expiryDate",
                "totalNumberOfView",
                "totalNumberJobApplication",
            )
        ],
        salary["maximum"].alias("salary_maximum"),
        salary["minimum"].alias("salary_minimum"),
        salary["type"]["id"].alias("salary_type_id"),
        salary["type"]["salaryType"].alias("salary_type"),
    ]


def flatten(df: DataFrame, key: str = "ad_id", monthly: bool = False, iso_year: bool = False) -> DataFrame:
    """Flat rows of the accepted documents, with their bucket."""
    accepted = df.filter(F.col("reject_reason").isNull())
    flat = accepted.select(key, *flat_columns(F.col("record")))
    day = F.col("originalPostingDate").try_cast("date")
    bucket = K.month_bucket(day) if monthly else K.week_bucket(day, iso_year)
    return flat.withColumn("bucket", bucket)


def rejected(df: DataFrame, key: str = "ad_id", doc: str = "doc") -> DataFrame:
    return df.filter(F.col("reject_reason").isNotNull()).select(key, "reject_reason", doc)


def reconciliation(df: DataFrame) -> DataFrame:
    """Documents read, rejected and kept."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("bad"),
        F.count_if(F.col("reject_reason").isNull()).alias("kept"),
    )
