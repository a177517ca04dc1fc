"""A content-addressed WARC archive: payloads once by digest, headers apart, joined to read.

An archive is a folder with two tables. ``payloads`` holds every distinct payload once,
under its SHA-256. ``heads`` holds one row per record: the exact header bytes, up to where
the payload begins, and the digest. A record is head, payload (none for a revisit), and
two line ends; reading joins the tables and checks every payload against both digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import stored

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"


def base32(hexadecimal: Column) -> Column:
    """Forty hexadecimal digits as 32 base32 characters: ten digits make eight."""
    def letters(group: int) -> list[Column]:
        value = F.conv(F.substring(hexadecimal, 10 * group + 1, 10), 16, 10).cast("long")
        digits = [F.shiftright(value, 35 - 5 * k).bitwiseAND(31) for k in range(8)]
        return [F.substring(F.lit(BASE32), d.cast("int") + 1, F.lit(1)) for d in digits]

    return F.concat(*[letter for group in range(4) for letter in letters(group)])


def records(pages: DataFrame, payload: str = "html") -> DataFrame:
    """``(page_id, url, sha256, sha1, bytes, payload)``; a null page counts as empty."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", body.alias("payload")).select(
        "page_id", "url",
        F.unhex(F.sha2("payload", 256)).alias("sha256"),
        base32(F.sha1("payload")).alias("sha1"),
        F.length("payload").cast("long").alias("bytes"),
        "payload")


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line ends in the value become blanks."""
    clean = F.regexp_replace(value.cast("string"), "[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def _record_id(page_id: Column, record_no: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
                    F.lit(":"), record_no.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages(page_id, url, html)`` to the archive at ``path``.

    Of equal payloads of at least ``min_bytes`` bytes the record with the smallest
    page_id is the response (null ids last, then the first stored), the others revisit
    it; smaller payloads are all responses. Equal means equal in SHA-256, SHA-1 and
    length, all three. Payload bytes pass one shuffle, after equal ones of a task became
    one; the choice of the response moves digests only.
    """
    content = ["sha256", "sha1", "bytes"]
    rows = records(pages)
    rows.groupBy(*content).agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    narrow = stored(
        rows.drop("payload").withColumn("record_no", F.monotonically_increasing_id()), "warc-records")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_no")
    firsts = stored(
        narrow.filter(F.col("bytes") >= min_bytes).groupBy(*content).agg(F.min(order).alias("first")),
        "warc-firsts")
    linked = narrow.join(firsts, content, "left")
    revisit = F.coalesce(F.col("first.record_no") != F.col("record_no"), F.lit(False))
    block = F.length(F.lit(HTTP_HEAD)) + F.when(revisit, 0).otherwise(F.col("bytes"))
    refers = F.when(revisit, _record_id(F.col("first.page_id"), F.col("first.record_no")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("record_no"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line("WARC-Refers-To", refers),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block),
        F.lit("\r\n" + HTTP_HEAD))
    linked.select(
        "record_no", *content, revisit.alias("revisit"), head.cast("binary").alias("head"),
    ).write.parquet(f"{path}/heads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``(record_no, sha256, sha1, bytes, revisit, record)``: the original records' bytes.

    Responses are joined with their payload; a payload whose digests or length are not
    those it is stored under, or that is missing, stops the job. Revisits have no
    payload of their own.
    """
    heads = spark.read.parquet(f"{path}/heads")
    payloads = spark.read.parquet(f"{path}/payloads").select(
        F.col("sha256").alias("_sha256"), F.col("payload"))
    joined = heads.filter("not revisit").join(payloads, F.col("sha256") == F.col("_sha256"), "left")
    intact = (
        F.col("payload").isNotNull()
        & (F.unhex(F.sha2("payload", 256)) == F.col("sha256"))
        & (base32(F.sha1("payload")) == F.col("sha1"))
        & (F.length("payload") == F.col("bytes"))
    )
    broken = F.raise_error(F.concat(F.lit("payload is not what its digest says: "), F.hex("sha256")))
    sound = F.when(F.coalesce(intact, F.lit(False)), F.col("payload")).otherwise(broken.cast("binary"))
    keys = ["record_no", "sha256", "sha1", "bytes", "revisit"]
    end = F.lit(END).cast("binary")
    whole = joined.select(*keys, F.concat("head", sound, end).alias("record"))
    bare = heads.filter("revisit").select(*keys, F.concat("head", end).alias("record"))
    return whole.union(bare)


def parsed(archive: DataFrame) -> DataFrame:
    """Fields read from the bytes of each record: ids, type, digest, length, payload.

    The bytes are ours up to the first empty line, so the header is decoded as UTF-8;
    the payload is what the block's length leaves after the HTTP header.
    """
    split = archive.withColumn("_head_size", F.instr(F.decode("record", "ISO-8859-1"), "\r\n\r\n") - 1)
    header = F.decode(F.expr("substring(record, 1, _head_size)"), "UTF-8")
    fields = split.withColumn("_header", F.concat(header, F.lit("\r\n")))

    def field(name: str) -> Column:
        value = F.regexp_extract("_header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
        return F.when(value != "", value)

    def page(name: str) -> Column:
        return F.regexp_extract(field(name), r"<urn:page:(-?[0-9]+):[0-9]+>", 1)

    length = field("Content-Length").cast("int")
    block = F.expr(f"substring(record, _head_size + 5 + {len(HTTP_HEAD)}, _length - {len(HTTP_HEAD)})")
    return fields.withColumn("_length", length).select(
        "record_no", "sha256", "sha1", "bytes",
        F.when(page("WARC-Record-ID") != "", page("WARC-Record-ID")).cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        F.substring(field("WARC-Payload-Digest"), 6, 32).alias("payload_digest"),
        F.when(page("WARC-Refers-To") != "", page("WARC-Refers-To")).cast("long").alias("refers_to"),
        F.when(~F.col("revisit"), block).alias("payload"))


def archived(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to an archive at ``path``, read it back, and describe each record.

    Returns ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``: length
    and digest of a response are taken from the payload read back, those of a revisit
    from the response it refers to. A null html is an empty payload, a null url has no
    header line, a null page_id stays null. Repeated rows are records of their own: the
    first stored is the response. No pages give no records; extra columns are ignored.
    """
    write_archive(pages, path, min_bytes)
    read = parsed(read_archive(pages.sparkSession, path))
    own = read.withColumn("own", F.length("payload").cast("long"))
    described = stored(own.drop("payload", "url"), "warc-read")
    stores = stored(
        described.filter("record_type = 'response'").groupBy("sha256").agg(
            F.max("own").alias("of_response"), F.max("payload_digest").alias("digest")),
        "warc-responses")
    full = described.join(stores, "sha256", "left")
    return full.select(
        "page_id",
        F.coalesce("own", "of_response").alias("payload_bytes"),
        F.coalesce(F.when(F.col("record_type") == "response", F.col("payload_digest")), F.col("digest"))
        .alias("payload_digest"),
        "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, html, sha1(html) as hex, octet_length(encode(html)) as n,
             min(page_id) over (partition by html) as first from p)
select page_id, n as payload_bytes,
  (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      cast((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::bigint >> (35 - 5 * (i % 8))) & 31 as bigint) + 1, 1), '' order by i)
   from range(32) as r(i)) as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to
from d"""
