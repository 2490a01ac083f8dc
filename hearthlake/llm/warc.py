"""Operator 2: WARC archives and their chunked record table."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.llm.common import cut, shared_dir

CHUNK = 1 << 18
#: Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

CHUNK_ROWS = (
    "record_id string, chunk_no int, record_type string, target_uri string, refers_to string, stated_digest string, stated_bytes long, "
    "bytes_so_far long, digest_so_far string, last boolean, payload binary"
)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, sha1, payload_bytes, refers_to): of records of equal payloads of
    ``least`` bytes or more, all but that of the largest page_id refer to it.

    Only digests and ids are shuffled to find groups, combined before the shuffle,
    so a payload that a third of all pages share is a row a task; payloads then
    meet the few rows that refer to another. Rows that share the largest page_id
    (or have none, if all of a group have none) are all responses; a null page_id
    is less than any other.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    digest = rows.select("page_id", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    equal = ["sha1", "payload_bytes"]
    digest = cut(digest)
    kept = digest.where(F.col("payload_bytes") >= least).groupBy(*equal).agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 AND kept IS NOT NULL")
    refer = digest.join(kept, equal).where("NOT page_id <=> kept").select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), F.col("kept").alias("refers_to")).distinct()
    rows = rows.withColumns({"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    return rows.join(refer, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1")), "left").drop("_id", "_sha1")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _head(page_id: int | None, url: str | None, refers_to: int | None, sha1: str, size: int, date: str) -> bytes:
    revisit = refers_to is not None
    block = HTTP % size
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _name(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": f"sha1:{_base32(sha1)}",
        "WARC-Refers-To": _name(refers_to) if revisit else None,
        "WARC-Profile": PROFILE if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block) + (0 if revisit else size)),
    }
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields.items() if v is not None)]
    return b"\r\n".join(lines) + END + block


def _writer(folder: str, date: str, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"  # a task that is run again writes another
        out, member, count = None, None, 0
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                page_id, url, sha1, size, refers_to, chunk_no, last, data = (x.as_py() for x in row)
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                if chunk_no == 0:
                    member, count = zlib.compressobj(level, zlib.DEFLATED, 31), count + 1
                    out.write(member.compress(_head(page_id, url, refers_to, sha1, size, date)))
                out.write(member.compress(data))
                if last:
                    out.write(member.compress(END) + member.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [count]})

    return run


def write_archives(rows: DataFrame, folder: str, chunk: int = CHUNK, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Writes ``rows`` (see ``records``) to gzipped archives in ``folder``, a member a record; returns (file, records).

    A payload reaches the writing task in rows of at most ``chunk`` bytes, and is
    compressed as it comes. Only files of the returned table belong to the
    archive: a task that failed half-way, or ran twice, leaves a file that no row
    names. ``folder`` is one that all executors share.
    """
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    own = F.col("refers_to").isNull()
    number = F.when(own, F.greatest(F.ceil(F.col("payload_bytes") / chunk), F.lit(1))).otherwise(1).cast("int")
    pieces = rows.withColumn("number", number).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("number") - 1)))
    data = F.when(own, F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    pieces = pieces.select("page_id", "url", "sha1", "payload_bytes", "refers_to", "chunk_no", (F.col("chunk_no") == F.col("number") - 1).alias("last"), data.alias("data"))
    return cut(pieces.mapInArrow(_writer(folder, date, level), "file string, records long"))


class _Stream:
    """Bytes of a gzipped file, member after member, with a bounded buffer."""

    def __init__(self, source, step: int = 1 << 16):
        self.source, self.step, self.buffer, self.rest, self.gunzip = source, step, b"", b"", None

    def more(self) -> bool:
        raw = self.rest or self.source.read(self.step)
        self.rest = b""
        if not raw:
            return False
        if self.gunzip is None:
            self.gunzip = zlib.decompressobj(31)
        self.buffer += self.gunzip.decompress(raw, 4 * self.step)
        if self.gunzip.eof:
            self.rest, self.gunzip = self.gunzip.unused_data, None
        else:
            self.rest = self.gunzip.unconsumed_tail
        return True

    def upto(self, mark: bytes) -> bytes | None:
        """What stands before ``mark``, which is passed; None at the end of the file."""
        while (at := self.buffer.find(mark)) < 0:
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("the archive ends within a record")
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return out

    def take(self, most: int) -> bytes:
        while not self.buffer:
            if not self.more():
                raise ValueError("the archive ends within a record")
        out, self.buffer = self.buffer[:most], self.buffer[most:]
        return out

    def take_full(self, size: int) -> bytes:
        parts = []
        while size:
            parts.append(self.take(size))
            size -= len(parts[-1])
        return b"".join(parts)


def _reader(folder: str, chunk: int, payloads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(stream: _Stream) -> Iterator[tuple]:
        while (head := stream.upto(END)) is not None:
            version, *lines = head.split(b"\r\n")
            if not version.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            field = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
            left = int(field["content-length"])
            if field.get("content-type", "").lower().startswith("application/http") and left:
                http = stream.upto(END)
                left -= len(http) + len(END)
                size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
                stated = int(size[1]) if size else left
            else:  # other records have no head of their own, all is payload
                stated = left
            # only SHA-1 is compared
            name, _, digest = field.get("warc-payload-digest", "").partition(":")
            digest = digest if name.lower() == "sha1" else None
            sha, done, number = hashlib.sha1(), 0, 0
            while True:
                data = stream.take_full(min(chunk, left))
                left -= len(data)
                done += len(data)
                sha.update(data)
                yield (
                    field["warc-record-id"].strip("<>"), number, field["warc-type"], field.get("warc-target-uri"),
                    field.get("warc-refers-to", "").strip("<>") or None, digest, stated,
                    done, base64.b32encode(sha.digest()).decode(), not left, data if payloads else None,
                )
                number += 1
                if not left:
                    break
            if stream.take_full(len(END)) != END:
                raise ValueError("a record is longer than it says")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in CHUNK_ROWS.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, CHUNK_ROWS.split(", "), strict=True)])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as source:
                    held, size = [], 0
                    for row in rows(_Stream(source)):
                        held.append(row)
                        size += len(row[-1] or b"") + 300
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return run


def read_archives(files: DataFrame, folder: str, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunked record table: a row for each ``chunk`` bytes of each record's payload.

    record_id and chunk_no name a row; bytes_so_far and digest_so_far (base32
    SHA-1) cover the payload up to and with it, so those of the row marked
    ``last`` are the whole payload's, and no task holds more of a payload than a
    chunk. A record without payload (empty, or a revisit) has one row. Records of any type are read, in any
    order: the payload of one with an HTTP head is what follows it, that of another (warcinfo, metadata, resource) its whole
    block; stated_digest is null where the header has no SHA-1. Without files there are no rows.
    stated_digest and stated_bytes are what the record's header says. Files are
    dealt out one to a task. Without ``payloads`` that column is null.
    """
    number = max(1, files.count())
    return files.select("file").repartition(number, "file").mapInArrow(_reader(folder, chunk, payloads), CHUNK_ROWS)


def _page(name: str):
    return F.expr(f"try_cast(substring({name}, {len('urn:page:') + 1}) AS bigint)")


def whole_records(files: DataFrame, folder: str) -> DataFrame:
    """The last row of each record, without payloads; a response whose digest is not what its header states is an error."""
    rows = read_archives(files, folder, payloads=False).where("last")
    damaged = (F.col("record_type") == "response") & (F.col("stated_digest") != F.col("digest_so_far"))
    said = F.concat(F.lit("damaged record "), "record_id")
    return rows.withColumn("digest_so_far", F.when(damaged, F.raise_error(said)).otherwise(F.col("digest_so_far")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    files = write_archives(records(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=0), folder)
    whole = whole_records(files, folder)
    response = F.col("record_type") == "response"
    out = whole.select(
        _page("record_id").alias("page_id"),
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        _page("refers_to").alias("refers_to"),
    )
    out = cut(out)
    store, root = fs.FileSystem.from_uri(folder)
    store.delete_dir(root)
    return out
