"""Content-addressed WARC archive.

An archive is two written tables. ``payloads`` holds every distinct payload once under its SHA-256 digest; ``records``
holds the exact header bytes of every record (the WARC header block and the HTTP header block) with the digest of its
payload. A record is reconstructed by joining the two; the digest is computed anew from the stored bytes and must
equal the one in the header.

Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is the response and
the others are revisits that refer to it; smaller payloads are always responses (their bytes are stored once, too).

Defined cases: null html is the empty payload; a null url gives an empty target; rows repeated under the largest
page_id are responses all; a null page_id is never referred to unless no other is there; payloads of any length are
kept whole; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewell.llm.common import Scratch, attach_groups, own

#: Fixed values of the format.
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _lines(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def record_id(page_id: Column) -> Column:
    return _lines("<urn:page:", F.coalesce(page_id.cast("string"), F.lit("none")), ">")


def _http_head() -> Column:
    return _lines("HTTP/1.1 200 OK", CRLF, "Content-Type: text/html; charset=utf-8", CRLF, "Content-Length: ", F.col("payload_bytes").cast("string"), CRLF + CRLF)


def _warc_head() -> Column:
    """The header block: lengths and digests of the record's own block, and where a revisit's payload is found."""
    response = F.col("record_type") == "response"
    length = F.octet_length("http_head") + F.when(response, F.col("payload_bytes")).otherwise(0)
    revisit = _lines("WARC-Refers-To: ", record_id(F.col("refers_to")), CRLF, "WARC-Profile: " + PROFILE + CRLF)
    return _lines(
        "WARC/1.1" + CRLF + "WARC-Type: ", F.col("record_type"), CRLF + "WARC-Record-ID: ", record_id(F.col("page_id")), CRLF + "WARC-Date: " + DATE + CRLF + "WARC-Target-URI: ",
        F.regexp_replace(own(F.col("url")), r"[\r\n]+", " "), CRLF + "WARC-Payload-Digest: sha1:", F.col("payload_sha1"), CRLF, F.when(response, F.lit("")).otherwise(revisit),
        "Content-Type: application/http;msgtype=response" + CRLF + "Content-Length: ", length.cast("string"), CRLF + CRLF)


def write_archive(pages: DataFrame, scratch: Scratch, least_bytes: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(records, payloads) as written tables. Payload bytes are written where they stand and never shuffled."""
    body = F.encode(own(F.col("html")), "UTF-8")
    narrow = pages.select("page_id", "url", F.sha2(body, 256).alias("digest"), F.sha1(body).alias("payload_sha1"), F.octet_length(body).cast("bigint").alias("payload_bytes"))
    narrow = scratch.save(narrow, "narrow")
    total = narrow.count()
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("size")).filter("size > 1")
    groups = scratch.save(groups, "equal")
    repeated = attach_groups(narrow.select("digest", "page_id", "payload_bytes"), groups, ["digest"], "size", total)
    spare = scratch.save(repeated.filter(~F.col("page_id").eqNullSafe(F.col("last"))).select(
        "page_id", "digest", "last", F.col("payload_bytes").alias("bytes")).distinct(), "spare")
    small = spare.count() <= 1_000_000
    hinted = F.broadcast(spare) if small else spare.hint("shuffle_merge")
    revisits = hinted.filter(F.col("bytes") >= least_bytes).withColumnsRenamed({"last": "refers_to", "page_id": "_cw_page", "digest": "_cw_digest"}).drop("bytes")
    # an id that is null or repeated may stand for several payloads, so rows are told apart by the digest, too
    typed = narrow.join(revisits, (narrow["digest"] == F.col("_cw_digest")) & narrow["page_id"].eqNullSafe(F.col("_cw_page")), "left")
    typed = typed.withColumn("record_type", F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit")))
    records = typed.withColumn("http_head", _http_head()).withColumn("warc_head", _warc_head())
    records = scratch.save(records.select("page_id", "digest", F.encode("warc_head", "UTF-8").alias("warc_head"), F.encode("http_head", "UTF-8").alias("http_head")), "records")
    stored = pages.select("page_id", F.sha2(body, 256).alias("digest"), body.alias("payload"))
    gone = hinted.select(F.col("page_id").alias("_cw_page"), F.col("digest").alias("_cw_digest"))
    stored = stored.join(gone, (stored["digest"] == F.col("_cw_digest")) & stored["page_id"].eqNullSafe(F.col("_cw_page")), "left_anti").drop("page_id")
    # rows repeated under a group's largest page_id would store its payload again
    again = repeated.filter(F.col("page_id").eqNullSafe(F.col("last"))).groupBy("digest").count().filter("count > 1").select("digest")
    again = scratch.save(again, "again")
    hinted = F.broadcast(again) if again.count() <= 1_000_000 else again.hint("shuffle_merge")
    once = stored.join(hinted, "digest", "left_semi").dropDuplicates(["digest"])
    payloads = scratch.save(stored.join(hinted, "digest", "left_anti").unionByName(once), "payloads")
    return records, payloads


def read_archive(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every record with its header fields and its full payload; ``verified`` when the bytes match both digests.

    Both sides are written tables, so a digest that many records share is split by adaptive execution.
    """
    head = F.decode("warc_head", "UTF-8")
    whole = records.join(payloads, "digest", "left")
    field = lambda name, pattern: F.regexp_extract(head, f"\r\n{name}: {pattern}\r\n", 1)
    parsed = whole.select(
        "page_id", "digest", "warc_head", "http_head", "payload",
        field("WARC-Type", "(.*?)").alias("record_type"), field("WARC-Target-URI", "(.*?)").alias("url"),
        F.nullif(field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>"), F.lit("")).cast("bigint").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("payload_digest"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("found"))
    both = (F.col("found") == F.col("payload_digest")) & (F.sha2("payload", 256) == F.col("digest"))
    return parsed.withColumn("verified", F.coalesce(both, F.lit(False))).drop("found", "digest")


def proven(back: DataFrame) -> DataFrame:
    """``back`` as it is; a record whose bytes do not match its digests is an error."""
    failed = F.raise_error(F.concat(F.lit("damaged payload of record "), record_id(F.col("page_id"))))
    return back.withColumn("payload_digest", F.when(F.col("verified"), F.col("payload_digest")).otherwise(failed.cast("string")))


def record_bytes() -> Column:
    """A reconstructed record as it stands in a WARC file: revisits carry no payload."""
    end = F.encode(F.lit(CRLF + CRLF), "UTF-8")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat("warc_head", "http_head", body, end)


ORACLE = """
select page_id, payload_bytes, payload_digest, if(last is null or page_id = last, 'response', 'revisit') as record_type,
       if(page_id = last, null, last) as refers_to
from (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
             if(octet_length(encode(coalesce(html, ''))) >= 1000, max(page_id) over (partition by coalesce(html, '')), null) as last from pages)
"""
