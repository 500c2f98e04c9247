"""WARC archives (operator 10): a writer and a sequential reader.

Every record is one gzip member. The reader feeds fixed-size blocks to an incremental zlib
decompressor, frames each record by its Content-Length and verifies block and payload digests while
the bytes pass by; it never holds more than one record. Each writer task streams its rows into files
of bounded size under unique names and returns their paths; only the paths of committed tasks reach
the manifest, so a re-run task leaves no half-written archive in the result.

Of rows with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the smallest page id (null
last, then file and row order) becomes a response, the others become revisits without a body.

Defined cases: null html is an empty payload; a null url omits the target URI; control characters
and blanks in a url are percent-encoded; a null page id is kept as null; repeated rows give one record
each; an empty table writes no archive and reads back no row.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, scratch_path, small_join, with_row_key

MIN_REVISIT = 100
BLOCK = 1 << 16
FILE_BYTES = 256 << 20  # an archive is closed once it holds this many compressed bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def header_value(s: str) -> str:
    """Percent-encode what would break a header line."""
    return "".join(c if 32 < ord(c) != 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in s)


def record_id(page_id: int | None, key: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{key}>"


def page_of(urn: str) -> int | None:
    p = urn.split(":")[2]
    return int(p) if p else None


def record_bytes(kind: str, rid: str, url: str | None, payload: bytes, digest: str, refers: str | None) -> bytes:
    """One record, not compressed. A revisit keeps the HTTP head (with the full length), no body."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}",
             "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {header_value(url)}")
    if refers is not None:
        lines += [f"WARC-Refers-To: {refers}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class WarcError(ValueError):
    pass


class _Member:
    """Decompressed bytes of one gzip member, pulled block by block from the file."""

    def __init__(self, source, rest: bytes):
        self.z, self.source, self.raw, self.buf = zlib.decompressobj(31), source, rest, b""

    def _more(self) -> bool:
        if self.z.eof:
            return False
        if not self.raw:
            self.raw = self.source.read(BLOCK)
            if not self.raw:
                raise WarcError("the archive ends inside a record")
        self.buf += self.z.decompress(self.raw, BLOCK)
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.buf.find(mark)) < 0:
            if not self._more():
                raise WarcError("a record has no end of its head")
        out, self.buf = self.buf[:at], self.buf[at + len(mark):]
        return out

    def chunks(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buf and not self._more():
                raise WarcError("a record is shorter than its Content-Length")
            out, self.buf = self.buf[:n], self.buf[n:]
            n -= len(out)
            if out:
                yield out

    def close(self) -> bytes:
        """The four bytes after the block, then the end of the member; returns unread raw bytes."""
        if b"".join(self.chunks(4)) != b"\r\n\r\n":
            raise WarcError("a record does not end where its Content-Length says")
        while not self.z.eof:
            self._more()
        if self.buf:
            raise WarcError("a gzip member holds more than one record")
        return self.raw


def _head(text: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = text.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_records(source) -> Iterator[dict]:
    """Records of an open archive: type, id, refers_to, url, payload digest (recomputed for
    responses and checked), full payload length, payload (None for revisits)."""
    rest = source.read(BLOCK)
    while rest or (rest := source.read(BLOCK)):
        m = _Member(source, rest)
        version, h = _head(m.until(b"\r\n\r\n"))
        if not version.startswith("WARC/"):
            raise WarcError(f"not a WARC record: {version[:20]!r}")
        block_sha, body_sha, head, parts = hashlib.sha256(), hashlib.sha256(), b"", []
        in_body = False
        for c in m.chunks(int(h["content-length"])):
            block_sha.update(c)
            if not in_body:
                head += c
                at = head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                head, c, in_body = head[:at], head[at + 4:], True
            body_sha.update(c)
            parts.append(c)
        rest = m.close()
        if h.get("warc-block-digest", "sha256:" + block_sha.hexdigest()) != "sha256:" + block_sha.hexdigest():
            raise WarcError(f"block digest of {h['warc-record-id']} is wrong")
        http = _head(head)[1]
        revisit = h["warc-type"] == "revisit"
        digest = h["warc-payload-digest"].removeprefix("sha256:")
        if not revisit and digest != body_sha.hexdigest():
            raise WarcError(f"payload digest of {h['warc-record-id']} is wrong")
        payload = None if revisit else b"".join(parts)
        if payload is not None and len(payload) != int(http["content-length"]):
            raise WarcError(f"payload length of {h['warc-record-id']} is wrong")
        yield {"type": h["warc-type"], "id": h["warc-record-id"], "refers_to": h.get("warc-refers-to"), "url": h.get("warc-target-uri"),
               "payload_digest": digest, "payload_bytes": int(http["content-length"]), "payload": payload}


def _open(path: str, write: bool = False):
    from pyarrow.fs import FileSystem

    fs, p = FileSystem.from_uri(path)
    if write:
        fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
        return fs.open_output_stream(p, compression=None)
    return fs.open_input_stream(p, compression=None)


def _writer(folder: str, file_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, n = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for b in batches:
            for r in zip(*[b.column(c) for c in ("page_id", "url", "_bin", "_digest", "_key", "_first_id", "_first_key")]):
                page, url, data, digest, key, first_id, first_key = (x.as_py() for x in r)
                rid = record_id(page, key)
                refers = record_id(first_id, first_key) if first_key is not None and first_key != key else None
                m = member(record_bytes("revisit" if refers else "response", rid, url, data, digest, refers))
                if out is None:
                    path, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open(path, write=True)
                out.write(m)
                size, n = size + len(m), n + 1
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row into archives in the shared folder; returns the manifest
    ``(path, records, bytes)``."""
    spark = pages.sparkSession
    data = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = with_row_key(pages).select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), data.alias("_bin"),
        F.concat_ws("-", F.hex("_file_key"), F.col("_row_index").cast("string")).alias("_key"))
    rows = rows.withColumn("_digest", F.sha2("_bin", 256))
    first = F.min(F.struct(F.col("page_id").isNull().alias("z"), F.col("page_id").alias("i"), F.col("_key").alias("k")))
    same = rows.filter(F.octet_length("_bin") >= min_revisit).groupBy("_digest").agg(F.count(F.lit(1)).alias("n"), first.alias("f"))
    same = scratch(same.filter("n > 1").select("_digest", F.col("f.i").alias("_first_id"), F.col("f.k").alias("_first_key")), "warc-same")
    joined = small_join(rows, same, ["_digest"], salt_by=F.col("_key"))
    folder = scratch_path(spark, "warc")
    return scratch(joined.mapInArrow(_writer(folder, file_bytes), "path string, records bigint, bytes bigint"), "warc-manifest")


def _reader(with_payload: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, size = [], 0
                with _open(path) as f:
                    for r in read_records(f):
                        rows.append((page_of(r["id"]), r["url"], r["payload_bytes"], r["payload_digest"], r["type"],
                                     page_of(r["refers_to"]) if r["refers_to"] else None, r["payload"] if with_payload else None))
                        size += 200 + (len(r["payload"] or b"") if with_payload else 0)
                        if size > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def read_warc(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read the archives of a manifest; each file is read by one task from start to end."""
    spark = manifest.sparkSession
    files = manifest.count()
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    return manifest.select("path").repartition(max(1, min(files, 100_000)), "path").mapInArrow(_reader(with_payload), schema)
