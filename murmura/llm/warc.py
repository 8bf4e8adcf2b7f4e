"""Content-addressed WARC archive.

An archive is two tables in a folder. ``payloads`` holds every distinct payload
once, addressed by its SHA-256. ``records`` holds the exact header bytes of every
record, its HTTP head and the digest of its payload. Original records come back
by joining the two; a payload is read back only if its bytes still give the digest
that addresses it. What is said of a record when the archive is read (its type, what
it refers to, its lengths and digest) is taken from the bytes of the rebuilt record,
and a record whose header doesn't fit its own bytes stops the read.

Of records with equal payloads of at least ``least_bytes``, the one with the
largest id is a response and the others revisit it; smaller ones are all responses.

Payload bytes move once: digests, sizes and ids decide which row of a payload is
stored, and only then is that row picked by its own id, so that a payload that a
third of the rows share lands in no one task.

Defined results: a null payload is empty; a null url gives a record without a
target line; line breaks and other control characters in a url are percent-escaped;
rows that repeat an id and payload are all responses if theirs is the largest id,
and of these the one with the largest url is referred to; record ids name an id, url
and payload, so only rows equal in all three share one; a null id counts as below all others, and is returned as
null; further columns aren't stored.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm.common import ship
from murmura.session import scratch_dir, tidy_shuffles

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Bytes of a header from which on it is taken as endless, and bytes of records that a reading task holds.
MAX_HEADER, HELD = 1 << 20, 8 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(h: Column, digits: int = 40) -> Column:
    """A hex digest of whole 20-bit groups in base 32."""
    parts = []
    for g in range(digits // 5):
        v = F.conv(F.substring(h, 5 * g + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(v, 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in (3, 2, 1, 0)]
    return F.concat(*parts)


def record_id(key: Column, url: Column, digest: Column) -> Column:
    """A name for the record of an id, a url and a payload: the same in every run."""
    told = F.to_json(F.struct(key.cast("string").alias("id"), url.alias("url"), digest.alias("digest")))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.md5(told), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the archive of a table of pages to a folder that all executors share."""
    with tidy_shuffles(df.sparkSession):
        _write_archive(df, path, id_col, url_col, payload_col, least_bytes, date)


def _write_archive(df: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, least_bytes: int, date: str) -> None:
    kind = dict(df.dtypes)[payload_col]
    payload = F.coalesce(df[payload_col] if kind == "binary" else F.encode(df[payload_col], "UTF-8"), F.lit(b""))
    base = df.select(df[id_col].alias("page_id"), df[url_col].alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    small = base.select("page_id", "url", "digest", "payload_bytes", base32_of_hex(F.sha1("payload")).alias("payload_digest"))

    holders = base.groupBy("digest", "page_id").agg(F.count("*").alias("rows"), F.max("url").alias("url"))
    first = holders.groupBy("digest").agg(F.max(F.struct("page_id", "rows", "url")).alias("m")).select("digest", F.col("m.page_id").alias("first"), F.col("m.rows").alias("rows"), F.col("m.url").alias("first_url"))
    chosen = base.join(first.select(F.col("digest").alias("of"), "first", "rows"), base.page_id.eqNullSafe(F.col("first")) & (F.col("digest") == F.col("of")))
    stored = chosen.select("digest", "payload_bytes", "payload", "rows")
    # Only where rows repeat an id and a payload can a payload have been picked twice.
    once = stored.filter("rows = 1").unionByName(stored.filter("rows > 1").dropDuplicates(["digest"])) if first.filter("rows > 1").limit(1).count() else stored
    once.select("digest", "payload_bytes", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")

    heads = small.join(first.select("digest", "first", "first_url"), "digest")
    revisit = (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    heads = heads.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    heads = heads.withColumn("http_head", http)
    length = F.octet_length("http_head") + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col("page_id"), F.col("url"), F.col("digest")), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), record_id(F.col("first"), F.col("first_url"), F.col("digest")), F.lit(">")))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit(CRLF),
    )
    heads.select("page_id", "digest", F.encode(header, "UTF-8").alias("header"), F.encode("http_head", "UTF-8").alias("http_head")).write.option("compression", "zstd").parquet(f"{path}/records")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """The payloads, each checked against its address; a damaged one stops the read."""
    p = spark.read.parquet(f"{path}/payloads")
    sound = (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("payload_bytes"))
    return p.withColumn("payload", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("digest"))).cast("binary")))


def _field(head: Column, name: str) -> Column:
    """The value of a header line, or null where there is none."""
    return F.nullif(F.regexp_extract(head, f"\\r\\n{name}: ([^\\r]*)", 1), F.lit(""))


def parsed(records: DataFrame) -> DataFrame:
    """``records`` with what the bytes of column ``record`` say: warc_type, record_id, refers_to_id, digest_line and block.

    A record is read up to the length that its header states; what doesn't fit, or
    doesn't end as a record does, stops the read.
    """
    head = F.substring_index(F.col("record").cast("string"), CRLF + CRLF, 1)
    out = records.withColumn("head", head).withColumns({
        "warc_type": _field(F.col("head"), "WARC-Type"),
        "record_id": _field(F.col("head"), "WARC-Record-ID"),
        "refers_to_id": _field(F.col("head"), "WARC-Refers-To"),
        "digest_line": _field(F.col("head"), "WARC-Payload-Digest"),
        "length": _field(F.col("head"), "Content-Length").cast("bigint"),
    })
    start = F.octet_length("head") + 4
    sound = F.col("head").startswith("WARC/1.") & F.col("record_id").isNotNull() & (F.octet_length("record") == start + F.col("length") + 4) & F.col("warc_type").isin("response", "revisit") & (F.substring("record", -4, 4) == F.lit(b"\r\n\r\n"))
    block = F.substring(F.col("record"), (start + 1).cast("int"), F.col("length").cast("int"))
    return out.withColumn("block", F.when(F.coalesce(sound, F.lit(False)), block).otherwise(F.raise_error(F.concat(F.lit("not a sound record: "), "head")).cast("binary"))).drop("head", "length")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload, payload_digest, record): the original bytes of every record, its full payload and that one's base 32 SHA-1.

    Each payload is checked and hashed once, before the join.
    """
    p = payloads(spark, path).withColumn("payload_digest", base32_of_hex(F.sha1("payload")))
    r = spark.read.parquet(f"{path}/records").join(p, "digest")
    body = F.when(F.col("header").cast("string").contains(f"{CRLF}WARC-Type: revisit{CRLF}"), F.lit(b"")).otherwise(F.col("payload"))
    return r.select("page_id", "payload", "payload_digest", F.concat("header", "http_head", body, F.lit(b"\r\n\r\n")).alias("record"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read from the rebuilt records.

    A response's block must end in its payload, and the digest that any record
    states must be that of the full payload. References are record ids; they become
    page ids by a join with the responses.
    """
    r = parsed(read_records(spark, path))
    size = F.octet_length("payload")
    ends = (F.col("warc_type") == "revisit") | (F.expr("substring(block, octet_length(block) - octet_length(payload) + 1)") == F.col("payload"))
    fits = ends & (F.col("digest_line") == F.concat(F.lit("sha1:"), "payload_digest")) & (F.col("refers_to_id").isNotNull() == (F.col("warc_type") == "revisit"))
    kind = F.when(F.coalesce(fits, F.lit(False)), F.col("warc_type")).otherwise(F.raise_error(F.concat(F.lit("record does not match its payload: "), "record_id")))
    index = r.select("page_id", size.cast("bigint").alias("payload_bytes"), "payload_digest", kind.alias("record_type"), "record_id", "refers_to_id")
    index.write.parquet(f"{path}/index-{(name := uuid.uuid4().hex)}")
    index = spark.read.parquet(f"{path}/index-{name}")
    named = index.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).dropDuplicates(["refers_to_id"])
    revisits = index.filter("record_type = 'revisit'").join(named, "refers_to_id", "left")
    known = F.when(F.col("refers_to").isNotNull(), F.col("refers_to")).otherwise(F.raise_error(F.concat(F.lit("nothing has the id that is referred to: "), "refers_to_id")).cast(dict(index.dtypes)["page_id"]))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type")
    return revisits.select(*columns, known.alias("refers_to")).unionByName(index.filter("record_type = 'response'").select(*columns).withColumn("refers_to", F.lit(None).cast(dict(index.dtypes)["page_id"])))


def export_files(spark: SparkSession, path: str, target: str) -> None:
    """The archive's records as compressed WARC files, one from each task: every record is written with the two line breaks that end it."""
    whole = F.expr("cast(substring(record, 1, octet_length(record) - 4) as string)")  # the bytes as they are
    read_records(spark, path).select(whole.alias("record")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(target)


FILE_ROWS = "file string, at bigint, header binary, block binary, problem string"


def _parse(file: str, stream) -> Iterator[tuple]:
    """Rows of ``FILE_ROWS`` from one stream; the first record that isn't sound ends it, as nothing tells where the next one starts."""
    at = 0
    try:
        while head := stream.readline():
            while not head.endswith(b"\r\n\r\n"):
                line = stream.readline()
                if not line or len(head) > MAX_HEADER:
                    raise ValueError("a header without an end")
                head += line
            size = next((int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
            if not head.startswith(b"WARC/1.") or size is None:
                raise ValueError("not a record")
            block = stream.read(size)
            if len(block) < size or stream.read(4) != b"\r\n\r\n":
                raise ValueError("a record of another length than its header states")
            yield file, at, head, block, None
            at += len(head) + size + 4
    except (ValueError, EOFError, OSError, zlib.error) as e:
        yield file, at, None, None, str(e)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, header, block, problem) of every record of a folder's ``.warc`` and ``.gz`` files.

    Tasks stream the files, record by record; ``at`` is a record's place in the
    uncompressed file. Where a file is damaged its last row says what is wrong.
    """
    ship(spark)
    names = spark.read.format("binaryFile").load(path).select("path").filter("lower(path) RLIKE '[.](warc|gz)$'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                target, base = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                held, size = [], 0
                with target.open_input_stream(base, compression=None) as raw:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if name.lower().endswith(".gz") else io.BufferedReader(raw)
                    for row in _parse(name, stream):
                        held.append(row)
                        size += len(row[3] or b"")
                        if len(held) >= 256 or size >= HELD:
                            yield _batch(held)
                            held, size = [], 0
                yield _batch(held)

    return names.repartition("path").mapInArrow(run, FILE_ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "at", "header", "block", "problem"])


def archive_path(spark: SparkSession) -> str:
    return scratch_dir(spark, "warc")
