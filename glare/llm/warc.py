"""Operator 8: deterministic sharded WARC writer and reader."""
from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glare.llm.common import materialize, open_fs, shared_path, table

#: a file is closed once it holds this many compressed bytes
ROLL_BYTES = 32 << 20
#: equal payloads from this many bytes on are written once
REVISIT_BYTES = 1000
#: fixed capture date: the same rows give the same bytes
DATE = "2020-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("7c1a5d4e-0b5f-5c58-9d0e-6b9f0f6f6a10")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def sha1_label(hexdigest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexdigest)).decode()


def sha1_hex(label: str) -> str:
    return base64.b32decode(label.removeprefix("sha1:")).hex()


def record_id(page_id, digest: str, turn: int) -> str:
    """The same for the same page, payload and repetition, and for no other."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}/{turn}')}>"


def _clean(value) -> str:
    """A header value on one line; control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in str(value))


def record(page_id, url, payload: bytes, digest: str, refers_to, turn: int) -> bytes:
    """One response or (``refers_to`` given) revisit record, headers regenerated."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
            + str(len(payload)).encode() + CRLF + CRLF)
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", record_id(page_id, digest, turn)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, 0)),
                   ("WARC-Refers-To-Page", refers_to)]
    fields += [("WARC-Payload-Digest", sha1_label(digest)),
               ("WARC-Block-Digest", sha1_label(hashlib.sha1(block).hexdigest())),
               ("WARC-Payload-Length", len(payload)), ("WARC-Page", "" if page_id is None else page_id),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {_clean(v)}\r\n".encode() for k, v in fields)
    return head + CRLF + block + CRLF + CRLF


def gzip_member(data: bytes) -> bytes:
    """A gzip member without time or name, so that equal records are equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def read_records(data: bytes):
    """(fields, block) of every member; lengths and block digests are checked."""
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        raw = z.decompress(data[at:]) if len(data) - at < (1 << 16) else None
        if raw is None:  # feed piecewise, not the whole rest for each member
            out, pos = io.BytesIO(), at
            while not z.eof and pos < len(data):
                out.write(z.decompress(data[pos:pos + (1 << 16)]))
                pos += 1 << 16
            raw = out.getvalue()
            at = min(pos, len(data)) - len(z.unused_data)
        else:
            at = len(data) - len(z.unused_data)
        if not z.eof:
            raise ValueError("cut archive")
        head, _, rest = raw.partition(CRLF + CRLF)
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[:int(fields["Content-Length"])]
        if lines[0] != "WARC/1.1" or rest[len(block):] != CRLF + CRLF:
            raise ValueError("broken record")
        if sha1_label(hashlib.sha1(block).hexdigest()) != fields["WARC-Block-Digest"]:
            raise ValueError("wrong block digest")
        yield fields, block


def responses(pages: DataFrame) -> DataFrame:
    """(digest, first): the page that carries each payload of REVISIT_BYTES or
    more that several rows share: the largest page_id."""
    return materialize(pages.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest")
                       .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
                       .filter("n > 1").select("digest", "first"), "payloads")


def write_warc(df: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write every row as a record below ``out``; returns the manifest.

    Rows are range-sorted by page id (null ids first), so files are ordered. Where
    a shard ends is Spark's choice from a sample, so file edges may differ between
    runs over large tables; records do not. Each task fills files up to ``roll_bytes`` under
    temporary names of its attempt, renames them when complete, and the manifest
    is written last: readers see whole files of a finished run or nothing.

    Null payloads are empty. Of rows that share page id and payload, the first is
    the response and the others revisit that page. Shared payloads whose rows have
    null ids only are all responses. Extra columns are not read; an empty table
    gives a manifest without files."""
    spark = df.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                      payload.alias("payload"), F.sha1(payload).alias("digest"), F.length(payload).alias("size"))
    carriers = responses(pages.select("page_id", "digest", "size"))
    # narrow rows find their response; html moves once, in the range sort
    marks = (pages.select("page_id", "digest", "size").filter(F.col("size") >= REVISIT_BYTES).join(carriers, "digest")
             .filter(F.col("first").isNotNull()).select("page_id", "digest", "first").distinct())
    none = F.lit(None)
    rows = (pages.select("page_id", "digest", F.lit(1).alias("kind"), "url", "payload", none.cast("long").alias("first"))
            .unionByName(marks.select("page_id", "digest", F.lit(0).alias("kind"), none.cast("string").alias("url"),
                                      none.cast("binary").alias("payload"), "first")))
    rows = (rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id")
            .sortWithinPartitions("page_id", "digest", "kind", "url"))

    def write(batches):
        ctx = TaskContext.get()
        shard, number, held, about = ctx.partitionId(), 0, [], {"n": 0, "bytes": 0, "first": None}
        fs, path = open_fs(out)
        mark, last, turn = None, None, 0

        def close():
            name = f"pages-{shard:05d}-{number:05d}.warc.gz"
            data = b"".join(held)
            fs.create_dir(path, recursive=True)
            part = f"{path}/.{name}.tmp-{ctx.taskAttemptId()}"
            with fs.open_output_stream(part, compression=None) as f:
                f.write(data)
            fs.move(part, f"{path}/{name}")
            return pa.RecordBatch.from_pylist([{"file": name, "records": about["n"], "bytes": len(data),
                                                "sha256": hashlib.sha256(data).hexdigest()}], schema)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                for page_id, digest, kind, url, body, first in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                    if kind == 0:
                        mark = (page_id, digest, first)
                        continue
                    turn = turn + 1 if (page_id, digest) == last else 0
                    last = (page_id, digest)
                    refers = mark[2] if mark and mark[:2] == last and (mark[2] != page_id or turn) else None
                    member = gzip_member(record(page_id, url, body, digest, refers, turn))
                    held.append(member)
                    about["n"] += 1
                    about["bytes"] += len(member)
                    if about["bytes"] >= roll_bytes:
                        yield close()
                        number, held, about = number + 1, [], {"n": 0, "bytes": 0}
        if held:
            yield close()

    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
    files = materialize(rows.mapInArrow(write, "file string, records long, bytes long, sha256 string"), "warc-files")
    listed = [r.asDict() for r in files.orderBy("file").collect()]  # one row per file
    fs, path = open_fs(out)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/manifest.json.tmp", compression=None) as f:
        f.write(json.dumps(listed, indent=0).encode())
    fs.move(f"{path}/manifest.json.tmp", f"{path}/manifest.json")
    return read_manifest(spark, out)


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    fs, path = open_fs(out)
    with fs.open_input_stream(f"{path}/manifest.json", compression=None) as f:
        listed = json.loads(f.read())
    return spark.createDataFrame([(r["file"], r["records"], r["bytes"], r["sha256"]) for r in listed],
                                 "file string, records long, bytes long, sha256 string")


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """One row per record of the manifest's files, in any order: page_id, url,
    record_type, payload_bytes, payload_digest, refers_to, payload (null for
    revisits). File sums, block digests and payload digests are checked."""
    manifest = read_manifest(spark, out)
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        fs, path = open_fs(out)
        for b in batches:
            for name, sha in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{name} is not the file of the manifest")
                rows = []
                for fields, block in read_records(data):
                    rows.append(parsed(fields, block))
                    if len(rows) == 256:
                        yield as_batch(rows)
                        rows = []
                if rows:
                    yield as_batch(rows)

    def parsed(fields, block):
        body, digest = block.partition(CRLF + CRLF)[2], sha1_hex(fields["WARC-Payload-Digest"])
        size, page = int(fields["WARC-Payload-Length"]), fields["WARC-Page"]
        revisit = fields["WARC-Type"] == "revisit"
        if not revisit and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
            raise ValueError("wrong payload")
        return (int(page) if page else None, fields.get("WARC-Target-URI"), fields["WARC-Type"], size, digest,
                int(fields["WARC-Refers-To-Page"]) if revisit else None, None if revisit else body)

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    n = max(1, manifest.count())
    return (manifest.repartitionByRange(n, "file")
            .mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
                             "refers_to long, payload binary"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS first, count(*) AS n FROM p GROUP BY h),
x AS (SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
    strlen(p.h) >= {REVISIT_BYTES} AND first <> page_id AS again, first FROM p JOIN g ON p.h = g.h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to FROM x"""
