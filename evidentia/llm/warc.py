"""WARC archives as chunked record tables.

Writing: each task streams the payloads it is given into one archive, record by record and chunk
by chunk, under a name of its own attempt; only archives whose names the job returns count, so a
task that is run again leaves nothing that is read.  Reading: an archive becomes rows of (record,
chunk number, bytes so far, digest so far), where only the last chunk of a record carries its final
digest.  Neither side holds more of a payload than one chunk besides the row that Spark hands over.

Records follow WARC/1.1: ``response`` records hold a payload, and a ``revisit`` record (profile
identical-payload-digest) names the record that already holds it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import cut, fresh_dir, scope, session

CHUNK = 1 << 16
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_output(path: str):
    """A binary stream to a path or URI that all nodes share."""
    system, inner = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


def open_input(path: str):
    system, inner = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    return system.open_input_stream(inner, compression=None)


def record_id(key: object) -> str:
    """A record's name, the same in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def header(fields: dict[str, str]) -> bytes:
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    return VERSION + b"\r\n" + b"".join(f"{k}: {clean(v)}\r\n".encode("utf-8", "surrogatepass") for k, v in fields.items()) + b"\r\n"


def write_record(out, key: str | None, url: str, payload: memoryview, digest: str, refers_to: str | None, date: str) -> None:
    """One record as a gzip member of its own; the payload goes through in chunks."""
    fields = {
        "WARC-Type": "revisit" if refers_to is not None else "response",
        "WARC-Record-ID": record_id(key),
        "WARC-Date": date,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Payload-Length": str(len(payload)),
    }
    if key is not None:
        fields["WARC-Page"] = key
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "WARC-Refers-To-Page": refers_to}
        payload = memoryview(b"")
    fields["Content-Length"] = str(len(payload))
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0) as member:
        member.write(header(fields))
        for at in range(0, len(payload), CHUNK):
            member.write(payload[at : at + CHUNK])
        member.write(b"\r\n\r\n")


def read_chunks(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], int, int, str, bool, bytes]]:
    """Of each record its chunks: fields, chunk number, bytes so far, digest so far, whether it is the last, and the bytes.

    A record without payload has one empty chunk.
    """
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if line.strip() != VERSION:
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            fields[name] = value.strip()
        left, number, seen, digest = int(fields["Content-Length"]), 0, 0, hashlib.sha1()
        while True:
            data = stream.read(min(CHUNK, left))
            if left and not data:
                raise ValueError("a record ends early")
            left -= len(data)
            seen += len(data)
            digest.update(data)
            sofar = base64.b32encode(digest.digest()).decode()
            if not left and fields["WARC-Type"] == "response" and fields.get("WARC-Payload-Digest", f"sha1:{sofar}") != f"sha1:{sofar}":
                raise ValueError(f"the bytes of {fields.get('WARC-Record-ID')} are not those of its digest")
            yield fields, number, seen, sofar, not left, data
            number += 1
            if not left:
                break


def base32_of_hex(c: Column) -> Column:
    """Upper-case base32 of the 40 hexadecimal digits of a SHA-1: five of them give four."""
    group = lambda i: F.lpad(F.conv(F.substring(c, 1 + 5 * i, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*map(group, range(8))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, key: str, payload: str, least: int, common: int = 100_000) -> DataFrame:
    """``_rk, _rsha, _refers`` of the rows that revisit another: of equal payloads of ``least`` bytes or more the smallest key is kept.

    Payloads are equal if length and SHA-256 are.  Digests are taken where the rows are; only keys and digests move.  The
    smallest keys are pre-aggregated, and payloads that occur once do not enter the join.  A payload of
    more than ``common`` rows would be one key of a join with all of these: such payloads, of which there are fewer
    than rows by ``common``, are broadcast instead, up to 100,000 of them.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    with scope(pages.sparkSession):
        found = cut(
            pages.select(F.col(key).alias("_rk"), F.octet_length(body).alias("_bytes"), F.sha1(body).alias("_rsha"), F.unhex(F.sha2(body, 256)).alias("_same")).where(F.col("_bytes") >= least),
            "warc-digests",
        )
        groups = found.groupBy("_same", "_bytes").agg(F.min("_rk").alias("_refers"), F.count(F.lit(1)).alias("_n")).where("_n > 1 AND _refers IS NOT NULL")
        groups = cut(groups, "warc-groups")
        hot, most = groups.where(F.col("_n") > common), 100_000
        if hot.count() > most:
            met = found.join(groups, ["_same", "_bytes"])
        else:
            known = found.join(F.broadcast(hot), ["_same", "_bytes"], "left")
            rest = known.where("_n IS NULL").drop("_refers", "_n").join(groups.where(F.col("_n") <= common), ["_same", "_bytes"])
            met = known.where("_n IS NOT NULL").unionByName(rest)
        plan = met.where(~F.col("_rk").eqNullSafe(F.col("_refers"))).select("_rk", "_rsha", "_refers").distinct()
        return cut(plan, "warc-revisits", keep=True)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for every row of ``pages`` and return a table of ``archive, records``.

    The payload is the text in UTF-8 (null: empty).  Of rows with equal payloads of at least
    ``least`` bytes the one with the smallest key is a response and the others revisit it; smaller
    payloads are all responses.  A null key is never the smallest.  Where the smallest key is
    repeated with its payload, each of these rows is a response.  Other columns are not read; an
    empty table gives no archives.  The date is a parameter, so runs agree.
    """
    session(pages.sparkSession)
    refers = plan_records(pages, key, payload, least)
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("_k"), F.coalesce(F.col(url), F.lit("")).alias("_u"), body.alias("_p")).withColumn("_sha", F.sha1("_p"))
    joined = rows.join(refers, F.col("_k").eqNullSafe(F.col("_rk")) & (F.col("_sha") == F.col("_rsha")), "left").select(
        F.col("_k").cast("string"), "_u", "_p", base32_of_hex(F.col("_sha")).alias("_d"), F.col("_refers").cast("string")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, count = "", None, 0
        for batch in batches:
            for k, u, p, d, r in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out = open_output(path)
                write_record(out, k.as_py(), u.as_py(), memoryview(p.as_buffer()), d.as_py(), r.as_py(), date)
                count += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["archive", "records"])

    return cut(joined.mapInArrow(run, "archive string, records long"), "warc-archives")


CHUNK_SCHEMA = (
    "archive string, record long, chunk long, page string, url string, record_type string, refers_to string, "
    "payload_bytes long, payload_digest string, last boolean, declared_bytes long, declared_digest string"
)


def read_archives(spark: SparkSession, archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The record table of the archives: a row for each chunk of each record.

    ``payload_bytes`` and ``payload_digest`` are those of the record's bytes up to and with the
    chunk, so the row marked ``last`` has those of the whole; ``declared_*`` are what the record's
    header says, which for a revisit is about the payload it refers to.  A response whose bytes do not have the declared digest raises.  An archive is read once, as a
    stream; archives are read side by side.  A truncated archive raises an error.
    """
    session(spark)
    many = max(1, min(archives.count(), 1 << 14))
    schema = CHUNK_SCHEMA + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]
            names = [x.split()[0] for x in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[: len(names)], strict=True)], names)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows: list[tuple] = []
                record = -1
                with open_input(archive) as raw, gzip.GzipFile(fileobj=raw) as plain, io.BufferedReader(plain, CHUNK) as stream:
                    for fields, number, seen, digest, last, data in read_chunks(stream):
                        record += number == 0
                        row = (
                            archive, record, number, fields.get("WARC-Page"), fields.get("WARC-Target-URI"), fields["WARC-Type"], fields.get("WARC-Refers-To-Page"),
                            seen, digest, last, int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                        )
                        rows.append((*row, data) if with_payload else row)
                        if len(rows) >= 128:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    return archives.select("archive").repartition(many).mapInArrow(run, schema)


def round_trip(pages: DataFrame, key: str = "page_id", **options) -> DataFrame:
    """Write ``pages`` to archives, read them back and return ``key, payload_bytes, payload_digest, record_type, refers_to`` of each record.

    Of a response these are counted from the bytes that were read, and must be what its header says; of a revisit they are the
    header's.
    """
    kind = pages.schema[key].dataType
    archives = write_archives(pages, fresh_dir(pages.sparkSession, "warc"), key, **options)
    chunks = read_archives(pages.sparkSession, archives, with_payload=False)
    revisit = F.col("record_type") == "revisit"
    return chunks.where("last").select(
        F.col("page").cast(kind).alias(key),
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


#: The round trip's rows in DuckDB SQL.
ORACLE = """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), g AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(d.h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST((3 - i % 4) * 5 AS INTEGER)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d JOIN g ON d.h = g.h
"""
