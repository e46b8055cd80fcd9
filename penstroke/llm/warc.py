"""Web archives: a deterministic sharded writer and a reader of WARC files."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstroke.llm.storage import filesystem
from penstroke.staging import fresh_path, stage

SHARD_BYTES = 64 << 20
"""Payload bytes of a shard, the work of one task. The first page of every shard is known to the driver."""

FILE_BYTES = 32 << 20
"""Compressed bytes after which a shard starts its next file."""

LEAST_REVISIT = 1000
"""Payload bytes below which equal records are all written in full."""

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_READ = 1 << 20
_ROWS = 2000


def payload_table(pages: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest)`` of the UTF-8 payload; a missing one is empty."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select(F.col("page_id").cast("long"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))


def revisits(payloads: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``(page_id, payload_digest, refers_to)`` of the records to be written without payload.

    Of records with equal payloads the largest page id stays, with every row that has it; only groups of several are
    joined, on the digest, where the other side has one row per digest.
    """
    long_ones = payloads.where(F.col("payload_bytes") >= least)
    first = long_ones.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low"), F.count("page_id").alias("n"), F.count("*").alias("rows"))
    first = first.where("refers_to is not null and (low < refers_to or n < rows)").select("payload_digest", "refers_to")
    return long_ones.join(first, "payload_digest").where("page_id is null or page_id < refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def shard_starts(payloads: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[int]:
    """The first page of every shard but the first: where the running total of bytes, in order of page id, passes a
    multiple of ``shard_bytes``. It depends on the rows alone, not on how Spark partitions them.

    The rows are sorted by range; totals of earlier partitions are added, one row per partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.column(1).to_numpy()
            before = total + np.cumsum(size) - size
            total += int(size.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), part)), batch.column(0), batch.column(1), pa.array(before)], names=["part", "page_id", "n", "before"])

    rows = payloads.where("page_id is not null").select("page_id", "payload_bytes").repartitionByRange("page_id").sortWithinPartitions("page_id", "payload_bytes")
    placed = stage(rows.mapInArrow(run, "part long, page_id long, n long, before long"), "warc-order")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    shard = F.floor((F.col("base") + F.col("before")) / shard_bytes).alias("shard")
    starts = placed.join(F.broadcast(base), "part").groupBy(shard).agg(F.min("page_id").alias("page_id")).where("shard > 0")
    return sorted({r["page_id"] for r in starts.select("page_id").collect()})


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record with headers and digests made anew."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda i: f"<urn:uuid:{uuid.uuid5(_SPACE, f'page {i}')}>"
    digest = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    kind = "revisit" if refers_to is not None else "response"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(url.split())))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    fields += [("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block))]
    if page_id is not None:
        fields.append(("X-Page", str(page_id)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (``page_id``, ``url``, ``html``) as compressed archives and return their manifest, stored:
    ``(shard, file, path, bytes, records, sha256)``.

    The same rows give the same files, byte for byte. Shards are ranges of page ids with equal payload bytes; a task
    writes a whole shard in order of page id and rolls to the next file by compressed size. Payloads are shuffled
    once: which records are revisits comes as small rows of the same shard that sort before the page. Files are
    written under temporary names; a second job renames those that the manifest of the finished tasks lists, and can
    be repeated. Rows without an id lie in the first shard; an empty table gives no file.
    """
    spark = pages.sparkSession
    payloads = stage(payload_table(pages), "payloads")
    firsts = shard_starts(payloads, shard_bytes)
    starts = spark.sparkContext.broadcast(np.array(firsts, np.int64))

    @F.pandas_udf("long")
    def shard_of(page_id: pd.Series) -> pd.Series:
        known = page_id.notna()
        out = np.zeros(len(page_id), np.int64)
        out[known] = np.searchsorted(starts.value, page_id[known].astype(np.int64), "right")
        return pd.Series(out)

    none = lambda kind: F.lit(None).cast(kind)
    rows = pages.select(F.col("page_id").cast("long"), F.lit(1).alias("kind"), "url", F.coalesce("html", F.lit("")).alias("html"), none("string").alias("digest"), none("long").alias("refers_to"))
    notes = revisits(payloads).select("page_id", F.lit(0).alias("kind"), none("string").alias("url"), none("string").alias("html"), F.col("payload_digest").alias("digest"), "refers_to")
    both = rows.unionByName(notes).withColumn("shard", shard_of("page_id"))
    dealt = both.repartitionByRange(len(firsts) + 1, "shard").sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "kind", "url", "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        done, now, page, noted = [], None, object(), {}

        def finish(now):
            now["stream"].close()
            done.append((now["shard"], now["file"], now["path"], now["bytes"], now["records"], now["sha"].hexdigest()))

        for batch in batches:
            for row in batch.to_pylist():
                if row["page_id"] != page:
                    page, noted = row["page_id"], {}
                if row["kind"] == 0:
                    noted[row["digest"]] = row["refers_to"]
                    continue
                if now is not None and (now["shard"] != row["shard"] or now["bytes"] >= file_bytes):
                    finish(now)
                    now = {"file": now["file"] + 1} if now["shard"] == row["shard"] else None
                if now is None or "stream" not in now:
                    file = now["file"] if now else 0
                    path = f"_temporary/{uuid.uuid4().hex}-{row['shard']:06d}-{file:04d}.warc.gz"
                    fs.create_dir(f"{root}/_temporary", recursive=True)
                    now = {"shard": row["shard"], "file": file, "path": path, "bytes": 0, "records": 0, "sha": hashlib.sha256(), "stream": fs.open_output_stream(f"{root}/{path}", compression=None)}
                payload = row["html"].encode()
                refers_to = noted.get(hashlib.sha1(payload).hexdigest()) if noted else None
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(record(page, row["url"], payload, refers_to)) + packer.flush()
                now["stream"].write(data)
                now["sha"].update(data)
                now["bytes"] += len(data)
                now["records"] += 1
        if now is not None:
            finish(now)
        if done:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=["shard", "file", "path", "bytes", "records", "sha256"])

    schema = "shard long, file long, path string, bytes long, records long, sha256 string"
    written = stage(dealt.mapInArrow(write, schema), "warc-written")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                final = f"part-{row['shard']:06d}-{row['file']:04d}.warc.gz"
                if fs.get_file_info(f"{root}/{row['path']}").is_file:
                    fs.move(f"{root}/{row['path']}", f"{root}/{final}")
                elif fs.get_file_info(f"{root}/{final}").size != row["bytes"]:
                    raise RuntimeError(f"{final} was not written")
                row["path"] = final
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return stage(written.mapInArrow(commit, schema), "warc-manifest")


def _unpacked(stream) -> Iterator[bytes]:
    """The decompressed bytes of a file of many gzip members, in portions."""
    packer = zlib.decompressobj(31)
    while data := stream.read(_READ):
        while data:
            yield packer.decompress(data)
            data = packer.unused_data
            if packer.eof:
                packer = zlib.decompressobj(31)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of every record of a compressed archive; one record is held at a time."""
    held, portions = bytearray(), _unpacked(stream)

    def more() -> bool:
        try:
            held.extend(next(portions))
            return True
        except StopIteration:
            return False

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a record")
                return
        fields = dict(line.split(": ", 1) for line in held[:end].decode().split("\r\n")[1:])
        size = end + 4 + int(fields["Content-Length"])
        while len(held) < size + 4:
            if not more():
                raise ValueError("the archive ends within a record")
        yield fields, bytes(held[end + 4 : size])
        del held[: size + 4]


def read_warc(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the files: ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and, if asked
    for, ``url`` and ``payload`` (null for revisits). Digests of responses are computed from what was read and must
    equal those in the headers; a revisit states those of the payload it refers to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"][: 7 if with_payload else 5]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        number = lambda x: None if x is None else int(x)
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            rows, held = [], 0
            with fs.open_input_stream(f"{root}/{path}", compression=None) as f:
                for fields, block in read_records(f):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
                    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                    response = fields["WARC-Type"] == "response"
                    if response and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: the payload of page {fields.get('X-Page')} is damaged")
                    row = (number(fields.get("X-Page")), size, digest, fields["WARC-Type"], number(fields.get("X-Refers-To-Page")))
                    rows.append((*row, fields.get("WARC-Target-URI"), payload if response else None) if with_payload else row)
                    held += len(payload) if with_payload else 0
                    if len(rows) >= _ROWS or held >= 16 * _READ:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", url string, payload binary" if with_payload else "")
    # a file is the work of a task, however small its row
    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(read, schema)


def archive(pages: DataFrame) -> DataFrame:
    """Write under the shared folder and read back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder), folder)
