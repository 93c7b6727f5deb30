"""Explicit schemas; nothing in this package infers one."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


POSTING_COLUMNS = (
    "title", "company", "location", "type", "salary", "description",
    "link", "date_posted", "source",
)

# A posting plus where it came from: the searched role (null for the curated list) and
# its arrival order within (role_ord, source_rank).
POSTING = T.StructType(
    _strings(*POSTING_COLUMNS)
    + _strings("role")
    + [
        T.StructField("role_ord", T.IntegerType()),
        T.StructField("source_rank", T.IntegerType()),
        T.StructField("seq", T.LongType()),
    ]
)

RAW_PAYLOAD = T.StructType(
    _strings("source", "slug", "role", "url")
    + [
        T.StructField("status", T.IntegerType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("body", T.StringType()),
    ]
)

# A match belongs to one resume: jobs, status log and tracker know a link within its resume.
JOBS = T.StructType(
    _strings("resume_id", "date_found", "company", "title", "location", "job_type")
    + [T.StructField("match_score", T.IntegerType())]
    + _strings("application_status", "link", "source", "salary", "description")
    + [T.StructField("created_at", T.TimestampType())]
)

STATUS_LOG = T.StructType(
    _strings("resume_id", "link", "status") + [T.StructField("ts", T.TimestampType())]
)

RESUME_TEXT = T.StructType(_strings("resume_id", "raw_text", "source_file"))

PROJECT = "struct<name:string,description:string,technologies:array<string>,year:string>"
EDUCATION = "struct<institution:string,degree:string,field:string,gpa:string,graduation:string>"
EXPERIENCE = "struct<company:string,title:string,duration:string,description:string>"

BOARD_BODY = (
    "struct<jobs:array<struct<title:string,location:string,"
    "absolute_url:string,updated_at:string>>>"
)
POSTINGS_BODY = (
    "array<struct<text:string,categories:struct<location:string>,"
    "descriptionPlain:string,hostedUrl:string>>"
)
THREAD_BODY = "struct<children:array<struct<id:bigint,text:string>>>"
CURATED_BODY = (
    "array<struct<active:boolean,title:string,company_name:string,"
    "locations:array<string>,url:string,date_posted:string>>"
)
CARD = (
    "struct<title:string,company:string,location:string,href:string,"
    "has_link:boolean,has_time:boolean,datetime:string>"
)

# Header of the tabular tracker.
SHEET_COLUMNS = (
    "Date Found", "Company", "Title", "Location", "Type", "Match Score",
    "Job Link", "Source", "Status",
)
