"""WARC archives: writing, normalising monolithic gzip files, and reading by offset index.

* ``write_archives``: each task writes WARC/1.1 records as *one* gzip stream per file (what many
  crawlers leave behind), a new file after ``roll_bytes``.
* ``normalise``: each monolithic file is inflated once, as a stream in bounded memory; every record
  is written again as a gzip member of its own, and its place goes to a sidecar index (a table).
* ``read_records``: rows of the index in, records out; each task seeks to the members it was dealt.

Files live in the shared folder (any store that pyarrow.fs opens by URI).  A task writes files with
names of its own attempt, and only the rows of tasks that succeeded name files, so lost and
speculative attempts leave no trace in the result.

Edge cases: null payloads are empty; payloads under ``dedup_from`` bytes are always responses; of
rows with equal payload and equal page_id the first is the response, others revisit that page_id;
an empty table gives no archive and an empty index; null page_ids come back as null and are the
last choice for the response.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrack.llm.storage import fresh_path, written

#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL, END = b"\r\n", b"\r\n\r\n"

FILES = "file string, records long"
INDEX = "file string, offset long, length long, record_id string, record_type string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str) -> bytes:
    """One WARC record.  A revisit keeps the HTTP header, with the length of the payload it stands for, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[6:6] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode() + END + block + END


def parse(raw: bytes) -> dict:
    """Headers, HTTP headers and payload of one record."""
    top, _, block = raw.partition(END)
    head = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
    http, _, payload = block[: int(head["Content-Length"])].partition(END)
    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    return {"head": head, "http": fields, "payload": payload}


def page_of(urn: str) -> int | None:
    x = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x else None


def with_references(pages: DataFrame, dedup_from: int = 1000) -> DataFrame:
    """Adds ``digest``, ``revisit`` and ``refers_to``.

    Only (page_id, digest) pairs are grouped by digest, with counts and maxima before the shuffle;
    pages meet the outcome by page_id and digest, so that many copies of a page do not meet in a task.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    digests = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("page_id", F.lit(-(1 << 63))).alias("key"), "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    own = digests.where(F.octet_length("html") >= dedup_from).select("key", "digest")
    heads = own.groupBy("digest").agg(F.max("key").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "head")
    found = own.distinct().join(heads, "digest").select("key", "digest", "head")
    joined = digests.join(found, ["key", "digest"], "left")
    copy = F.row_number().over(Window.partitionBy("key", "digest").orderBy("url"))
    revisit = F.col("head").isNotNull() & ((F.col("key") != F.col("head")) | (copy > 1))
    joined = joined.withColumn("revisit", revisit)
    return joined.select("page_id", "url", "html", "digest", "revisit", F.when(F.col("revisit"), F.nullif("head", F.lit(-(1 << 63)))).alias("refers_to"))


class _Out:
    """A file written by one attempt of a task."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        fs, path = _opened(folder)
        fs.create_dir(path, recursive=True)
        self.stream = fs.open_output_stream(f"{path}/{self.uri.rpartition('/')[2]}", compression=None)
        self.at = 0

    def write(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.at += len(raw)


def write_archives(rows: DataFrame, folder: str, roll_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """page_id, url, html, digest, revisit, refers_to -> the monolithic files written (a table of the shared folder)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, squeeze, n, raw = None, None, 0, 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            out.write(squeeze.flush())
            out.stream.close()
            done.append((out.uri, n))

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to", "revisit", "digest")]
            for k in range(batch.num_rows):
                page, url, html, refers, revisit, digest = (c[k].as_py() for c in columns)
                if out is None:
                    out, squeeze, n, raw = _Out(folder), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                data = record(page, url, html.encode(), refers, revisit, digest)
                out.write(squeeze.compress(data))
                n, raw = n + 1, raw + len(data)
                if raw >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["file", "records"])

    return written(rows.mapInArrow(run, FILES), "warc-files")


def records_of(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Records of a gzip file of one or many members, inflated once; holds a chunk and a record at most."""
    held, inflate = bytearray(), zlib.decompressobj(31)
    packed, ended = b"", False
    while True:
        cut = held.find(END)
        need = None
        if cut >= 0:
            size = next(int(x[16:]) for x in bytes(held[:cut]).split(EOL) if x[:16].lower() == b"content-length: ")
            need = cut + 4 + size + 4
        if need is not None and len(held) >= need:
            yield bytes(held[:need])
            del held[:need]
            continue
        if ended:
            if held:
                raise ValueError("the archive ends within a record")
            return
        if not packed:
            packed = stream.read(chunk)
        if not packed:
            ended = True
            continue
        held += inflate.decompress(packed, chunk)
        packed = inflate.unconsumed_tail
        if inflate.eof:
            packed, inflate = inflate.unused_data + packed, zlib.decompressobj(31)


def normalise(files: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Rewrites every record of every file as its own gzip member; returns the sidecar index (a table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                fs, path = _opened(uri)
                rows, out = [], _Out(folder)
                with fs.open_input_stream(path, compression=None) as stream:
                    for raw in records_of(stream):
                        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = squeeze.compress(raw) + squeeze.flush()
                        head = dict(x.split(": ", 1) for x in raw.partition(END)[0].decode().split("\r\n")[1:])
                        rows.append((out.uri, out.at, len(member), head["WARC-Record-ID"], head["WARC-Type"]))
                        out.write(member)
                out.stream.close()
                names = INDEX.replace(",", "").split()[::2]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([(n, pa.int64() if n in ("offset", "length") else pa.string()) for n in names]))

    spread = max(1, files.count())
    return written(files.repartition(spread).mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` names, each read by a seek and checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, source = None, None
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if name != uri:
                    fs, path = _opened(name)
                    uri, source = name, fs.open_input_file(path)
                source.seek(offset)
                got = parse(zlib.decompress(source.read(length), 31))
                head, payload = got["head"], got["payload"]
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"digest of {head['WARC-Record-ID']} differs")
                refers = page_of(head["WARC-Refers-To"]) if kind == "revisit" else None
                rows.append((page_of(head["WARC-Record-ID"]), head.get("WARC-Target-URI", ""), kind, refers, int(got["http"]["Content-Length"]), digest, payload if with_payload and kind == "response" else None))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], RECORDS.replace(",", "").split()[::2])

    return index.mapInArrow(run, RECORDS)


def archive(pages: DataFrame, dedup_from: int = 1000) -> DataFrame:
    """Writes the pages, normalises the archives, and returns the sidecar index."""
    folder = fresh_path(pages.sparkSession, "warc")
    files = write_archives(with_references(pages, dedup_from), f"{folder}/monolithic")
    return normalise(files, f"{folder}/records")


def digest(records: DataFrame) -> DataFrame:
    """The columns of the query's contract."""
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

