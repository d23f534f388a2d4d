"""A content-addressed WARC archive.

`write_archive` keeps two tables in one folder: `payloads` (digest, payload), each payload's bytes once under their
SHA-256, and `records` (page_id, digest, header), each record's exact WARC header bytes. `read_archive` verifies every
payload against the digest it is stored under and against the SHA-1 that each header states, and joins both tables back.
`record_bytes` rebuilds the records as they stand in a WARC file and `parse_records` reads such bytes again. A record
whose payload has at least REVISIT_BYTES bytes and equals that of a larger page_id is a revisit that refers to the largest
one: its block is empty, its Content-Length 0, and X-Payload-Length keeps the length. The full payload of a revisit is
still reachable through its digest.

Cases: null payloads are empty; null URLs give an empty target; line breaks in a URL are percent-encoded in the header;
rows that repeat page_id and payload stay separate records of the same type with record ids of their own; a null page_id
never becomes the response of others unless all are null (then each is a response); an empty table gives an empty archive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import delete, scratch_dir

REVISIT_BYTES = 1000
NO_PAGE = -(1 << 63)
DATE = "2020-01-01T00:00:00Z"
CRLF = "\r\n"


def _uuid(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), *[x for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (h.substr(a, b), F.lit("-" if a < 21 else ">"))])


def _header() -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    page = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    _record_id = lambda row, id_: _uuid(F.lit("record"), row.cast("string"), page(id_), F.col("sha256"))
    revisit = F.col("refers_to").isNotNull()
    target = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("row"), F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _record_id(F.col("first_row"), F.col("refers_to"))), line("X-Refers-To-Page", page(F.col("refers_to"))))).otherwise(""),
        line("X-Page-ID", page(F.col("page_id"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Length", F.when(revisit, 0).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str) -> str:
    """Write (page_id, url, html) rows as an archive below path; only keys pass through the grouping by digest."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keys = base.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.monotonically_increasing_id().alias("row"))
    keys.write.parquet(f"{path}/keys")
    keys = pages.sparkSession.read.schema(keys.schema).parquet(f"{path}/keys")
    # The rows are numbered once, in this written table, so that repeated rows get record ids of their own.
    first = keys.groupBy("sha256", "page_id").agg(F.max("row").alias("row")).groupBy("sha256").agg(F.max("page_id").alias("first_id"), F.max_by("row", F.coalesce("page_id", F.lit(NO_PAGE))).alias("first_row"))
    refers = F.when((F.col("payload_bytes") >= REVISIT_BYTES) & (F.col("page_id") < F.col("first_id")) | (F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNull(), F.col("first_id"))
    records = keys.join(first, "sha256").withColumn("refers_to", refers)
    records.select("page_id", F.col("sha256").alias("digest"), F.encode(_header(), "UTF-8").alias("header")).write.parquet(f"{path}/records")
    # Payloads move once, by plain (page, digest) keys: a null-safe join would make dropDuplicates shuffle them again.
    page = lambda c: F.coalesce(F.col(c), F.lit(NO_PAGE)).alias("page")
    owner = first.select(page("first_id"), F.col("sha256").alias("digest"))
    own = base.select(page("page_id"), F.sha2("payload", 256).alias("digest"), "payload").join(owner, ["page", "digest"], "left_semi")
    own.dropDuplicates(["page", "digest"]).select("digest", "payload").write.parquet(f"{path}/payloads")
    delete(pages.sparkSession, f"{path}/keys")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The original records: parsed header fields, verified payload, exact header bytes.

    A payload that does not hash to its address raises.
    """
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.concat(F.lit("corrupt payload "), F.col("digest"))).cast("long"))
    stored = stored.select("digest", "payload", checked.alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    records = spark.read.schema("page_id long, digest string, header binary").parquet(f"{path}/records")
    field = _fields(F.decode("header", "UTF-8"))
    parsed = records.select(field("X-Page-ID", "long").alias("page_id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("record_type"), field("X-Refers-To-Page", "long").alias("refers_to"), _stated(field).alias("stated"), "digest", "header")
    whole = parsed.join(stored, "digest")
    right = F.when(F.col("stated") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("stated digest differs from payload "), F.col("digest"))))
    return whole.withColumn("payload_digest", right).drop("stated")


def _fields(text: Column):
    def field(name: str, kind: str | None = None) -> Column:
        value = F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1)
        return F.nullif(value, F.lit("")).cast(kind) if kind else value

    return field


def _stated(field) -> Column:
    return F.substring(field("WARC-Payload-Digest"), 6, 40)


def record_bytes(records: DataFrame) -> DataFrame:
    """(record): each record as it stands in a WARC file. A revisit carries headers only."""
    body = F.when(F.col("record_type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return records.select("page_id", F.concat("header", body, F.encode(F.lit(CRLF * 2), "UTF-8")).alias("record"))


def parse_records(records: DataFrame) -> DataFrame:
    """(record binary) to page_id, url, record_type, refers_to, block, payload_bytes, payload_digest.

    A block of another length than its header states, or a response that does not hash to its stated digest, raises.
    """
    # One byte is one letter in Latin-1, so the place of the blank line is a byte offset.
    cut = records.select("record", F.instr(F.decode("record", "ISO-8859-1"), CRLF * 2).alias("gap"))
    cut = cut.select(F.decode(F.substring("record", 1, F.col("gap") + 1), "UTF-8").alias("text"), F.substring("record", F.col("gap") + 4, F.greatest(F.octet_length("record") - F.col("gap") - 7, F.lit(0))).alias("block"), (F.substring("record", -4, 4) == F.encode(F.lit(CRLF * 2), "UTF-8")).alias("closed"))
    field = _fields(F.col("text"))
    parsed = cut.select(
        field("X-Page-ID", "long").alias("page_id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("record_type"), field("X-Refers-To-Page", "long").alias("refers_to"), "block",
        field("X-Payload-Length", "long").alias("payload_bytes"), _stated(field).alias("payload_digest"), (F.col("closed") & (F.octet_length("block") == field("Content-Length", "long"))).alias("whole"),
    )
    good = F.col("whole") & ((F.col("record_type") == "revisit") | (F.sha1("block") == F.col("payload_digest")) & (F.octet_length("block") == F.col("payload_bytes")))
    checked = F.when(good, F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("broken record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?")))))
    return parsed.withColumn("record_type", checked).drop("whole")


def op2_warc(spark, sf_dir):
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return parse_records(record_bytes(read_archive(spark, path))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op2_warc": op2_warc}
SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM q
"""
}
