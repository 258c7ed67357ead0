"""WARC archives: writing, reading, and revisit resolution by payload digest.

Records are written by Spark's text writer (one row is one record, and its line separator is the blank line that ends a WARC record)
and read by its binary-file reader, so any store that Spark reads will do, files are committed atomically, and a lost executor only
repeats its own tasks. Files are gzip-compressed as wholes and hold ``FILE_RECORDS`` records at most, which bounds the size of each; they are read as streams, a
record at a time.

Deduplication shuffles headers only (digest, smallest id, count), with partial sums before the shuffle, so a digest with a third of all records is one row for each
task. The digests that occur more than once come back to the records: broadcast, so that no payload moves, where their counted number is within ``MOST_DIGESTS``, else by a
join on the digest, in which adaptive execution splits hot ones. Records that lose become ``revisit`` records with fresh headers that refer to the kept response; a
revisit finds its original by id and digest.

Defined results: a null payload is empty; payloads under ``least`` bytes always stay responses; a null id is its own record with an empty
id and sorts after all others; records that repeat in id and payload all become what the first is; records that repeat in id with other payloads are records of their own, and a
revisit's original is the one of its digest; a revisit whose original is missing keeps its digest and a null original; whole payloads are archived, however long; an empty
table gives an archive without records; other columns are not archived, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.storage import fresh, materialize, new_path

LEAST = 100
#: Digests of 64 characters and an id: some 100 MB at most.
MOST_DIGESTS = 1_000_000
FILE_RECORDS = 5_000
STEP_BYTES = 1 << 20
END = "\r\n\r\n"
FIELDS = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to_id string, payload_bytes long, payload binary"


def deduplicate(records: DataFrame, least: int = LEAST, most_digests: int = MOST_DIGESTS) -> DataFrame:
    """Adds ``record_type`` and ``refers_to`` to records (page_id, url, payload binary); adds ``payload_bytes`` and ``payload_digest``."""
    df = records.withColumn("payload", F.coalesce("payload", F.lit(b"")))
    df = df.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    kept_id, n = fresh(df, "kept", "n")
    heads = df.filter(F.col("payload_bytes") >= least).select("payload_digest", "page_id")
    kept = heads.groupBy("payload_digest").agg(F.min("page_id").alias(kept_id), F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1).drop(n)
    kept = materialize(kept, "warc-kept")
    kept = F.broadcast(kept) if kept.count() <= most_digests else kept.hint("merge")
    df = df.join(kept, "payload_digest", "left")
    revisit = F.col(kept_id).isNotNull() & ~F.col("page_id").eqNullSafe(F.col(kept_id))
    return df.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col(kept_id))}).drop(kept_id)


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line ends inside a value would break the record, so they become spaces."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.translate(value, "\r\n", "  "), F.lit("\r\n"))).otherwise("")


def records_text(df: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: the whole record without its closing blank line. A revisit has no payload, only the HTTP head."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(F.col("payload")).cast("string"), F.lit(END))
    size = F.octet_length(http) + F.octet_length(body)
    identity = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", identity(F.col("page_id"))),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _header("WARC-Refers-To", F.when(revisit, identity(F.col("refers_to")))),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        F.concat(F.lit("Content-Length: "), size.cast("string"), F.lit(END)),
        http,
    )
    return df.select(F.concat(head.cast("binary"), body).cast("string").alias("value"))


def write_archive(df: DataFrame, path: str) -> None:
    """Writes the records of :func:`deduplicate` as .txt.gz files of WARC/1.1."""
    records_text(df).write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _plain(data: bytes) -> Iterator[bytes]:
    """The bytes of a file, gzip-compressed (in one or many members) or plain, some at a time."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof and at < len(view):
            rest = view[at : at + STEP_BYTES]
            at += len(rest)
            yield member.decompress(rest)
        at -= len(member.unused_data)


def parse(data: bytes) -> Iterator[dict]:
    """The records of one file; what is held is one record and a step's worth of bytes."""
    source, have, at = _plain(data), bytearray(), 0

    def more() -> bool:
        part = next(source, None)
        if part is not None:
            have.extend(part)
        return part is not None

    bare = lambda x: None if x is None else x.removeprefix("<urn:page:").removesuffix(">")
    while True:
        del have[:at]
        at = 0
        while (begin := have.find(b"WARC/")) < 0 or (stop := have.find(END.encode(), begin)) < 0:
            if not more():
                if begin >= 0:
                    raise ValueError("a WARC header without an end")
                return
        fields = {}
        for line in bytes(have[begin:stop]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        at = stop + 4 + int(fields["content-length"])
        while at > len(have):
            if not more():
                raise ValueError("a WARC record is cut short")
        block = bytes(have[stop + 4 : at])
        if fields.get("content-type", "").startswith("application/http"):
            block = block[block.index(END.encode()) + 4 :]
        yield {
            "record_id": bare(fields.get("warc-record-id")), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
            "payload_digest": (fields.get("warc-payload-digest") or "").rpartition(":")[2] or None, "refers_to_id": bare(fields.get("warc-refers-to")), "payload_bytes": len(block), "payload": block,
        }


def _reader(with_payload: bool):
    names = ["record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to_id", "payload_bytes"]
    kinds = [pa.string()] * 6 + [pa.int64()]
    schema = pa.schema([*zip(names, kinds, strict=True), *([("payload", pa.binary())] if with_payload else [])])

    def read(batches):
        import hashlib

        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for r in parse(data.as_py()):
                    if r["record_type"] == "response" and r["payload_digest"] != hashlib.sha256(r["payload"]).hexdigest():
                        raise ValueError(f"the digest of record {r['record_id']} does not fit its payload")
                    if not with_payload:
                        del r["payload"]
                    rows.append(r)
                    size += r["payload_bytes"] if with_payload else 100
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return read


def read_archive(spark, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archive's files; payloads are checked against their digests in any case."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_reader(with_payload), FIELDS if with_payload else FIELDS.removesuffix(", payload binary"))


def resolve(records: DataFrame) -> DataFrame:
    """Joins every revisit to its original response by id and digest; adds ``original_bytes`` (own size for responses)."""
    wanted, digest, size = fresh(records, "id", "digest", "bytes")
    originals = records.filter("record_type = 'response'").groupBy(F.col("record_id").alias(wanted), F.col("payload_digest").alias(digest)).agg(F.max("payload_bytes").alias(size))
    on = (F.col("refers_to_id") == F.col(wanted)) & (F.col("payload_digest") == F.col(digest))
    revisits = records.filter("record_type = 'revisit'").join(originals, on, "left").withColumn("original_bytes", F.col(size)).drop(wanted, digest, size)
    return records.filter("record_type <> 'revisit'").withColumn("original_bytes", F.col("payload_bytes")).unionByName(revisits)


def op2_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """Writes the deduplicated archive of all pages and reports what it holds, as read back from it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.encode("html", "UTF-8").alias("payload"))
    path = new_path(spark, "warc")
    write_archive(deduplicate(pages), path)
    found = resolve(read_archive(spark, path, with_payload=False))
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return found.select(number("record_id").alias("page_id"), F.col("original_bytes").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to_id").alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, min(page_id) AS kept FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND payload_bytes >= 100
"""
