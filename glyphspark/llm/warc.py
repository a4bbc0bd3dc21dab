"""Content-addressed WARC archive: payload bytes once by digest, record headers apart, records by join.

write() makes a WARC/1.1 record of each page. An archive is two tables: `payloads` holds each
distinct payload once under its SHA-1, SHA-256 and length; `headers` holds each record's exact header
bytes with these three of the page they were made from, so that two payloads of one SHA-1 stay two.
Of pages with equal payloads of at least MIN_REVISIT bytes the one with the largest page_id is a
response, the others revisit it; smaller payloads are always responses. records() joins the two
tables again and gives the original bytes of every record: header, blank line, payload, two line
ends. A revisit's block is empty. read() parses those bytes and checks each block's length, SHA-1 and
SHA-256 against what its header says; one that doesn't match raises an error.

All of it is DataFrame functions. The group of one payload is summed before its shuffle, and of it
only the digests and the largest page_id travel back, from a written table, so that Spark can split the join of a payload
that a third of all pages share. Only responses need a payload: a large one has one response. A
small one, of less than MIN_REVISIT bytes, is laid out once for each share of records that it has; a share is
SHARE records, or a SHARE-th of all where these are more, so that there are fewer than SHARE payloads of several shares, and
no task joins more than a share of one.

Edge cases: a null html is the empty payload; a null url is the empty URI; rows that repeat a
page_id are one record each, and of these the largest url is the response (rows alike in page_id, url
and html are all responses); a null page_id takes part, never as the page referred to if another has
an id; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

MIN_REVISIT = 1000
#: Fixed, so that equal inputs give equal archives.
DATE = "1970-01-01T00:00:00Z"
END = "\r\n"
#: What tells payloads apart.
KEY = ["digest", "sha256", "bytes"]
#: Records that are joined to one copy of a small payload, at least; and how many payloads may have several copies.
SHARE = 1_000


def _header(kind: Column) -> Column:
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.lit(f"WARC-Date: {DATE}"),
        # a line end inside a URI would end the header line
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "%0A")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.lit(f"{END}WARC-Refers-To: <urn:page:"), F.coalesce(F.col("refers_to").cast("string"), F.lit("")), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
    ]
    return F.concat(F.concat_ws(END, *lines), F.lit(END)).cast("binary")


def write(pages: DataFrame, scratch: Scratch | None = None, min_revisit: int = MIN_REVISIT, digest: Callable[[str], Column] = F.sha1) -> tuple[DataFrame, DataFrame]:
    """Archive pages(page_id, url, html); returns the written tables headers and payloads."""
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.select("page_id", "url", "payload", digest("payload").alias("digest"), F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("bytes"))

    # one payload a key: the first pass keeps what each task holds once, without a row leaving it twice
    payloads = scratch.keep(rows.groupBy(KEY).agg(F.first("payload").alias("payload"), F.count("*").alias("records")), "payloads")

    seen = rows.drop("payload")
    shared = seen.where(F.col("bytes") >= min_revisit).groupBy(KEY).agg(F.max("page_id").alias("first_page"), F.max(F.struct("page_id", "url")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    firsts = scratch.keep(shared.select(*KEY, "first_page", F.col("kept.url").alias("first_url")), "shared")
    joined = seen.join(firsts, KEY, "left")
    first = F.col("page_id").eqNullSafe(F.col("first_page")) & F.col("url").eqNullSafe(F.col("first_url"))
    revisit = F.col("first_page").isNotNull() & ~first
    kinds = joined.select("page_id", "url", *KEY, F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first_page")).alias("refers_to"))
    headers = scratch.keep(kinds.select("page_id", *KEY, "kind", _header(F.col("kind")).alias("header")), "headers")
    return headers, payloads


def _copies(payloads: DataFrame, min_revisit: int, share: int) -> DataFrame:
    """KEY and copies of the small payloads that have several: fewer than `share` rows."""
    total = payloads.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    each = max(share, -(-total // share))
    return payloads.where((F.col("bytes") < min_revisit) & (F.col("records") > each)).select(*KEY, F.ceil(F.col("records") / each).cast("int").alias("copies"))


def records(headers: DataFrame, payloads: DataFrame, min_revisit: int = MIN_REVISIT, share: int = SHARE) -> DataFrame:
    """The original records: page_id, the bytes as they would stand in a WARC file, and the SHA-256 and length of the page's payload."""
    several = F.broadcast(_copies(payloads, min_revisit, share))
    copies = F.coalesce("copies", F.lit(1))
    held = payloads.join(several, KEY, "left").select(*KEY, "payload", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
    end, none = F.lit(END).cast("binary"), F.lit("").cast("binary")
    record = lambda block: F.concat("header", end, block, end, end).alias("record")
    responses = headers.where("kind = 'response'").join(several, KEY, "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "header"), copies).cast("int"))
    full = responses.join(held, [*KEY, "salt"], "left")
    # a payload that isn't there is found by read()
    whole = full.select("page_id", record(F.coalesce("payload", none)), "sha256", "bytes")
    return whole.unionByName(headers.where("kind = 'revisit'").select("page_id", record(none), "sha256", "bytes"))


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"(?dm)^{name}: ([^\r\n]*)\r$", 1)


def read(found: DataFrame, digest: Callable[[str], Column] = F.sha1) -> DataFrame:
    """Parse records; page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Raises if a block's length, SHA-1 or SHA-256 isn't what its header says, or a header's length not that of its page.
    """
    # the header is the record before its first blank line; latin-1 keeps one character a byte
    text = F.decode("record", "ISO-8859-1")
    cut = found.select("sha256", "bytes", "record", F.substring_index(text, END + END, 1).alias("head_bytes"))
    cut = cut.withColumns({"head_len": F.length("head_bytes"), "head": F.concat(F.decode(F.encode("head_bytes", "ISO-8859-1"), "UTF-8"), F.lit(END))}).drop("head_bytes")
    cut = cut.withColumn("block", F.substring(F.col("record"), F.col("head_len") + 5, F.octet_length("record") - F.col("head_len") - 8)).drop("record")
    parsed = cut.select(
        "block", "sha256", "bytes",
        F.nullif(F.regexp_extract("head", r"(?dm)^WARC-Record-ID: <urn:page:(-?\d*)>\r$", 1), F.lit("")).cast("long").alias("page_id"),
        _field("WARC-Target-URI").alias("url"), _field("WARC-Type").alias("record_type"),
        F.nullif(F.regexp_extract("head", r"(?dm)^WARC-Refers-To: <urn:page:(-?\d*)>\r$", 1), F.lit("")).cast("long").alias("refers_to"),
        F.regexp_extract("head", r"(?dm)^WARC-Payload-Digest: sha1:(\w+)\r$", 1).alias("payload_digest"),
        _field("X-Payload-Length").cast("long").alias("payload_bytes"),
        _field("Content-Length").cast("long").alias("length"),
    )
    whole = (digest("block") == F.col("payload_digest")) & (F.sha2("block", 256) == F.col("sha256")) & (F.col("length") == F.col("payload_bytes"))
    good = (F.octet_length("block") == F.col("length")) & (F.col("payload_bytes") == F.col("bytes")) & F.when(F.col("record_type") == "revisit", F.col("length") == 0).otherwise(whole)
    checked = F.when(good, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("archive record does not match its digest: "), F.col("payload_digest"))))
    return parsed.select("page_id", "url", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages, read the archive back, and return one row a record."""
    return read(records(*write(pages)))


def export(found: DataFrame) -> bytes:
    """The bytes of a small archive as one uncompressed WARC file, by page_id (driver side, for tools and tests)."""
    return b"".join(bytes(r.record) for r in found.orderBy("page_id").select("record").toLocalIterator())


def repeats(spark: SparkSession, payloads: DataFrame, k: int = 20) -> DataFrame:
    """The k payloads that most records share."""
    w = Window.orderBy(F.desc("records"), "digest")
    top = payloads.select("digest", "bytes", "records").orderBy(F.desc("records"), "digest").limit(k)
    return top.withColumn("rank", F.row_number().over(w))
