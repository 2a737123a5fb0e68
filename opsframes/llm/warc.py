"""WARC archives: write, normalise and read back.

``write_archives`` turns pages into WARC files the plain way: one gzip stream
over a whole file, as many tools leave them. ``normalise`` inflates such a
stream once, front to back, and rewrites every record as a gzip member of its
own, with a sidecar index (offset, length, record id, type, digest) so that a
record can be read alone. ``read_records`` fetches records by that index.

Records with equal payloads of ``LEAST_BYTES`` or more become revisits of one
of them, the one with the greatest page id.

Files go to the shared folder through pyarrow's file systems. A task writes
under a name of its own attempt, and the name reaches the manifest only with
the task's result, so a lost executor or a second attempt leaves at most a
stray file that nothing refers to. Each file holds about ``FILE_BYTES`` of
payload; a record is streamed, an archive is never held in memory whole.

Edge cases: a null html is an empty payload; null urls give no target header.
Rows without a page id are written as responses. Rows that share a page id
are all written, under one record id; those that hold the greatest id of a
payload are all responses.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframes.llm._common import delete_at_exit, keep, only
from opsframes.sources.files import scratch_path

LEAST_BYTES = 1000
FILE_BYTES = 64 << 20
LEVEL = 6
CHUNK = 1 << 20
URN = "urn:page:"
#: WARC-Date of records whose capture time isn't known.
UNDATED = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    """``file:/x`` as ``file:///x``, which pyarrow reads."""
    return "file:///" + path[5:].lstrip("/") if path.startswith("file:") else path


def record(rid: str, kind: str, payload: bytes, digest: str, target: str | None, refers_to: str | None,
           date: datetime = UNDATED) -> bytes:
    """One WARC 1.1 record. A revisit carries no payload but the digest of its response's."""
    block = b"" if kind == "revisit" else payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {date:%Y-%m-%dT%H:%M:%SZ}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if target is not None:
        head.append("WARC-Target-URI: " + quote(target, safe="%/:=&?~#+!$,;'@()*[]"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record: " + lines[0][:40])
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


class _Inflated:
    """The records of one gzip stream, or of several members, read once from front to back."""

    def __init__(self, source):
        self.source, self.buffer, self.box = source, bytearray(), zlib.decompressobj(31)
        self.pending = b""

    def _more(self) -> bool:
        data = self.pending or self.source.read(CHUNK)
        if not data:
            return False
        if self.box.eof:
            self.box = zlib.decompressobj(31)
        self.buffer += self.box.decompress(data, CHUNK)
        self.pending = self.box.unconsumed_tail or self.box.unused_data
        return True

    def _need(self, n: int) -> None:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("archive ends within a record")

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """Headers and the whole record's bytes."""
        while True:
            while (at := self.buffer.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.buffer:
                        raise ValueError("archive ends within a record")
                    return
            head = parse_head(bytes(self.buffer[:at]))
            end = at + 4 + int(head["content-length"]) + 4
            self._need(end)
            yield head, bytes(self.buffer[:end])
            del self.buffer[:end]


def _member(raw: bytes) -> bytes:
    box = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return box.compress(raw) + box.flush()


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write rows (rid, kind, payload, digest, target, refers_to) as monolithic gzip
    WARC files; returns the manifest (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(_uri(folder))
        system.create_dir(root, recursive=True)
        sink = box = path = None
        done, held = 0, 0

        def close():
            sink.write(box.flush())
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([done], pa.int64())], names=["path", "records"])

        for batch in batches:
            for r in batch.to_pylist():
                if sink is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    sink, box, done, held = system.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                raw = record(r["rid"], r["kind"], r["payload"], r["digest"], r["target"], r["refers_to"])
                sink.write(box.compress(raw))
                done, held = done + 1, held + len(raw)
                if held >= file_bytes:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    return records.mapInArrow(run, "path string, records long")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite each monolithic archive with one gzip member per record, and a sidecar
    ``.idx`` of JSON lines beside it; returns the index as rows."""
    shape = [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("rid", pa.string()),
             ("kind", pa.string()), ("digest", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(_uri(folder))
        for batch in batches:
            for source in batch.column("path").to_pylist():
                path = source.removesuffix(".warc.gz") + f"-{uuid.uuid4().hex[:8]}.records.warc.gz"
                at, rows = 0, []
                with (system.open_input_stream(source, compression=None) as raw, system.open_output_stream(path, compression=None) as out,
                      system.open_output_stream(path.removesuffix(".warc.gz") + ".idx", compression=None) as index):
                    for head, whole in _Inflated(raw).records():
                        member = _member(whole)
                        out.write(member)
                        rows.append((path, at, len(member), head["warc-record-id"].strip("<>"), head["warc-type"],
                                     head["warc-payload-digest"].removeprefix("sha1:")))
                        index.write((json.dumps(dict(zip([n for n, _ in shape][1:], rows[-1][1:]))) + "\n").encode())
                        at += len(member)
                        if len(rows) >= 10_000:
                            yield _rows(rows, shape)
                            rows = []
                yield _rows(rows, shape)

    return manifest.mapInArrow(run, "path string, offset long, length long, rid string, kind string, digest string")


def _rows(rows: list[tuple], shape: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(shape)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, shape)], names=[n for n, _ in shape])


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Each indexed record, read alone from its archive and checked: rid, kind,
    payload_bytes, digest, refers_to, payload (null for a revisit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(_uri(folder))
        path = source = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["path"] != path:
                    path, source = r["path"], system.open_input_file(r["path"])
                raw = zlib.decompress(source.read_at(r["length"], r["offset"]), 31)
                cut = raw.index(b"\r\n\r\n")
                head = parse_head(raw[:cut])
                block = raw[cut + 4:cut + 4 + int(head["content-length"])]
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-record-id"] != f"<{r['rid']}>":
                    raise ValueError(f"index and archive disagree at {path}:{r['offset']}")
                if head["warc-type"] == "response" and hashlib.sha1(block).hexdigest() != digest:
                    raise ValueError(f"payload of {r['rid']} isn't what its digest says")
                refers = head.get("warc-refers-to")
                out.append((r["rid"], head["warc-type"], int(head["x-payload-length"]), digest, refers and refers.strip("<>"),
                            None if head["warc-type"] == "revisit" else block))
            yield _rows(out, [("rid", pa.string()), ("kind", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()),
                              ("refers_to", pa.string()), ("payload", pa.binary())])

    return index.mapInArrow(run, "rid string, kind string, payload_bytes long, digest string, refers_to string, payload binary")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 least: int = LEAST_BYTES) -> DataFrame:
    """Rows for ``write_archives``; rid is ``urn:page:<id>``.

    The greatest id per long payload comes from an aggregate that sees ids and
    digests only; payloads move once, for the join with those that repeat.
    """
    rows = only(pages, id=id_col, target=url_col, html=html_col)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = rows.select("id", "target", payload.alias("payload"), F.sha1(payload).alias("digest"),
                       F.sha2(payload, 256).alias("same"))  # two payloads with one SHA-1 are known; the record's digest doesn't tell them apart
    long_enough = (F.octet_length("payload") >= least) & F.col("id").isNotNull()
    best = (rows.where(long_enough).groupBy("same").agg(F.max("id").alias("best"), F.count("*").alias("n"))
            .where("n > 1").select("same", "best"))

    def name(column: str):
        return F.concat(F.lit(URN), F.url_encode(F.coalesce(F.col(column).cast("string"), F.lit(""))))

    again = F.coalesce(long_enough & (F.col("id") != F.col("best")), F.lit(False))
    return rows.join(best, "same", "left").select(
        name("id").alias("rid"), F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("kind"), "payload", "digest", "target",
        F.when(again, name("best")).alias("refers_to"))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               least: int = LEAST_BYTES) -> DataFrame:
    """Write, normalise and read back: page id, payload_bytes, payload_digest, record_type, refers_to, payload."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    delete_at_exit(spark, folder)
    kind = pages.select(id_col).schema[0].dataType.simpleString()
    manifest = keep(write_archives(plan_records(pages, id_col, url_col, html_col, least), folder), "warc-manifest")
    files = manifest.count()
    index = keep(normalise(manifest.repartition(max(1, files)), folder), "warc-index")
    back = read_records(index, folder)

    def page(rid: str):
        return F.nullif(F.url_decode(F.substring(rid, len(URN) + 1, 1 << 30)), F.lit("")).cast(kind)

    return back.select(page("rid").alias(id_col), "payload_bytes", F.col("digest").alias("payload_digest"),
                       F.col("kind").alias("record_type"), page("refers_to").alias("refers_to"), "payload")
