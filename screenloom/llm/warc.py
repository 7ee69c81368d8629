"""Content-addressed web archive: payload bytes once by digest, exact record headers apart, records rebuilt by joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


@dataclass(frozen=True)
class Archive:
    """payloads: (digest, payload), one row per distinct payload; headers: (record_id, digest, header), one per record."""

    payloads: DataFrame
    headers: DataFrame


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 digest (160 bits: 32 characters, no padding)."""
    digest = F.sha1(data)
    out = []
    for g in range(8):
        v = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def write_archive(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> Archive:
    """One record per row. Of records with equal payloads of at least min_bytes bytes, the largest id is the response.

    Payload bytes are grouped by digest and by the bytes themselves; two payloads with one digest stop the run. Null
    html is an empty payload, a null url an empty one; line breaks in urls are percent-encoded. Rows repeating an id
    are records of their own. A null id is a response if its payload has no other id. Payloads of any length are
    stored whole. Empty tables give empty tables; further columns are ignored, whatever their names.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("record_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    keys = rows.select("record_id", "url", "digest", F.octet_length("payload").cast("long").alias("n_bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    store = materialise(rows.groupBy("digest", "payload").agg(F.max("record_id").alias("response_id")), "payloads")
    if not store.groupBy("digest").count().where("count > 1").isEmpty():
        raise ValueError("two payloads share a SHA-256 digest")
    whole = keys.join(store.select("digest", "response_id"), "digest")
    revisit = (F.col("n_bytes") >= min_bytes) & ~F.col("record_id").eqNullSafe(F.col("response_id"))
    rid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(F.lit(f"WARC/1.1{EOL}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(f"{EOL}WARC-Record-ID: "), rid("record_id"), F.lit(f"{EOL}WARC-Date: {date}{EOL}WARC-Target-URI: "), url)
    link = F.when(revisit, F.concat(F.lit(f"{EOL}WARC-Profile: {PROFILE}{EOL}WARC-Refers-To: "), rid("response_id"))).otherwise("")
    length = F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")
    tail = F.concat(F.lit(f"{EOL}WARC-Payload-Digest: sha1:"), "sha1", F.lit(f"{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), length, F.lit(EOL + EOL))
    headers = materialise(whole.select("record_id", "digest", F.concat(head, link, tail).alias("header")), "headers")
    return Archive(store.select("digest", "payload"), headers)


def read_index(archive: Archive) -> DataFrame:
    """(record_id, record_type, refers_to, payload_bytes, payload_sha1, sound), parsed headers joined with stored bytes.

    payload_bytes and payload_sha1 come from the stored bytes; sound says whether the header's digest is theirs and
    its Content-Length that of the record's block: the payload of a response, nothing for a revisit.
    """
    field = lambda name, what: F.regexp_extract("header", rf"\r\n{name}: {what}\r\n", 1)
    parsed = archive.headers.select("record_id", "digest", field("WARC-Type", r"([^\r\n]*)").alias("record_type"), field("WARC-Refers-To", "<urn:page:([^>]*)>").alias("refers_to"), field("WARC-Payload-Digest", "sha1:([A-Z2-7]*)").alias("header_sha1"), field("Content-Length", "([0-9]+)").try_cast("long").alias("length"))
    stored = archive.payloads.select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_sha1"))
    block = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    sound = F.coalesce((F.col("header_sha1") == F.col("payload_sha1")) & (F.col("length") == block), F.lit(False))
    return parsed.join(stored, "digest").select("record_id", "record_type", "refers_to", "payload_bytes", "payload_sha1", sound.alias("sound"))


def read_records(archive: Archive) -> DataFrame:
    """(record_id, record): the bytes of each WARC record, header, block and closing line breaks."""
    block = F.when(F.col("header").contains("WARC-Type: revisit\r\n"), F.lit(b"")).otherwise(F.col("payload"))
    rows = archive.headers.join(archive.payloads, "digest")
    return rows.select("record_id", F.concat(F.col("header").cast("binary"), block, F.lit(b"\r\n\r\n")).alias("record"))
