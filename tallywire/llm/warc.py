"""Web archives: write WARC records, resolve revisits by payload digest, read the archives back.

The digest and the revisit decision are made on headers only. Archives are written by Spark's text writer, whose line
separator is the end of a record, so the usual commit protocol covers lost executors and any Hadoop store will do; payload
bytes pass unchanged. They are read as whole files of bounded size and cut by Content-Length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
END = CRLF * 2
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records to a file; with `ROWS_PER_FILE` pages of 100 kB a file stays near 100 MB.
ROWS_PER_FILE = 1000
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def digest(data: Column) -> Column:
    """The bare upper-case base32 SHA-1 of binary data: the hash's 160 bits in eight groups of four letters."""
    letters = F.lit(BASE32)
    parts = []
    for group in range(8):
        bits = F.conv(F.substring(F.sha1(data), 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(letters.substr(F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + F.lit(1), F.lit(1)))
    return F.concat(*parts)


def records_of(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest) of each page; a null body is an empty payload."""
    payload = F.coalesce(F.col(body).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": digest(F.col("payload"))})


def resolve_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """`records` with record_type and refers_to: of equal payloads of `min_bytes` or more, the record with the largest page_id
    is the response and the others revisit it; smaller payloads are all responses.

    Only (digest, length, page_id) is aggregated, with partial sums, so a payload that a third of all pages share is one row a
    task; what is joined back is one row for each payload that occurs more than once. A null page_id never wins unless a
    payload has no other; rows with the same largest page_id are all responses.
    """
    heads = records.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    again = heads.where("n > 1").select("payload_digest", "payload_bytes", "original")
    revisits = (F.col("payload_bytes") >= min_bytes) & F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return records.join(again, ["payload_digest", "payload_bytes"], "left").select(
        *records.columns,
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("original")).alias("refers_to"),
    )


def _urn(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"<urn:{kind}:"), value.cast("string"), F.lit(">"))


def write_warc(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write one WARC record per row with fresh headers; a revisit carries no payload, only what it refers to.

    WARC-Payload-Digest and X-Payload-Length describe the full payload in both kinds; X-Page-Id carries the key (absent if
    null). CR and LF in a url are removed, since a header may not hold them; a null url has no WARC-Target-URI.
    """
    header = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    parts = [
        F.lit(f"WARC/1.1{CRLF}"),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", _urn("page", F.coalesce(F.col("page_id").cast("string"), F.lit("none")))),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", F.translate("url", CRLF, "")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Refers-To", _urn("page", F.col("refers_to"))),
        header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        header("X-Page-Id", F.col("page_id").cast("string")),
        header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    ]
    lines = records.select(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).text(path)


def _parse(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        head = data.index(END.encode(), at)
        fields = dict(x.split(": ", 1) for x in data[at:head].decode("utf-8", "replace").split(CRLF)[1:])
        start, size = head + 4, int(fields["Content-Length"])
        urn = fields.get("WARC-Refers-To")
        page = fields.get("X-Page-Id")
        yield (
            None if page is None else int(page),
            fields.get("WARC-Target-URI"),
            fields["WARC-Type"],
            int(urn.rsplit(":", 1)[1].rstrip(">")) if urn else None,
            fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            int(fields["X-Payload-Length"]),
            data[start : start + size],
        )
        at = start + size + 4


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for content in batch.column("content"):
            data, rest = b"", content.as_py()
            parts = []
            while rest:  # a file may have one gzip member or one for each record
                z = zlib.decompressobj(31)
                parts.append(z.decompress(rest) + z.flush())
                rest = z.unused_data
            data = b"".join(parts)
            rows, size = [], 0
            for r in _parse(data):
                rows.append(r)
                size += len(r[-1])
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below `path`. Each file is read whole by one task; `write_warc` bounds its records."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read_files, RECORDS)


def archive(pages: DataFrame, path: str, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Write `pages` as deduplicated archives below `path` and return the records read back from them (RECORDS).
    An empty table writes no record and returns no rows; repeated rows and nulls are defined in the steps above."""
    write_warc(resolve_revisits(records_of(pages, **columns), min_bytes), path)
    return read_warc(pages.sparkSession, path)
