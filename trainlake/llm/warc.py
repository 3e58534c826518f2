"""WARC archives: write monolithic gzip streams, normalise them to one member a record with a sidecar offset index, read back.

Archives are files in the shared folder, written and read by tasks through pyarrow's file systems; manifests (one row an
archive) are Parquet tables. A task that is run again writes a file of another name, and only files in a committed manifest
are read, so lost executors leave at most files that nobody reads. Memory per task is one record plus one inflate block."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, new_path

MIN_REVISIT_BYTES = 100
ROLL_BYTES = 64 << 20
BLOCK = 1 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, index_path string, n_records long, n_bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to of every row.

    Rows whose payload has MIN_REVISIT_BYTES or more and equals that of a row with a smaller page_id refer to the smallest
    such page_id; all others, and all rows with that page_id itself, are responses (refers_to null). A null html is an empty
    payload; a row without page_id is nobody's first unless no equal row has one. Digests are counted with partial sums;
    only digests that occur more than once are joined, and the join may split a hot digest."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.unhex(F.sha2(body, 256)).alias("digest"))
    firsts = materialize(
        rows.where(F.octet_length("html") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"),
        "warc-firsts",
    )
    return rows.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _urn(page_id: int | None) -> str:
    return f"<urn:trainlake:page:{'none' if page_id is None else page_id}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One uncompressed WARC/1.1 record. Revisits carry the HTTP headers alone; Content-Length there is that of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest.hex()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflate(read, block: int = BLOCK) -> Iterator[bytes]:
    """Blocks of the inflated stream, of any number of gzip members, never more than `block` bytes at a time. A stream that
    ends within a member raises EOFError."""
    z, data, within = zlib.decompressobj(31), b"", False
    while True:
        data = data or read(block)
        if not data:
            if within:
                raise EOFError("the gzip stream ends within a member")
            break
        within = True
        yield z.decompress(data, block)
        data = z.unconsumed_tail
        while not z.eof and z.unconsumed_tail:
            yield z.decompress(data, block)
            data = z.unconsumed_tail
        if z.eof:
            z, data, within = zlib.decompressobj(31), z.unused_data, False


def split_records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole WARC records (with their trailing blank lines) from a stream of bytes."""
    buf = bytearray()
    blocks = iter(blocks)

    def more(n: int) -> bool:
        while len(buf) < n:
            b = next(blocks, None)
            if b is None:
                return False
            buf.extend(b)
        return True

    while more(1):
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not more(len(buf) + 1):
                raise ValueError("archive ends within a header")
        size = int(re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", buf[:end])[1])
        if not more(end + 4 + size + 4):
            raise ValueError("archive ends within a record")
        yield bytes(buf[: end + 4 + size + 4])
        del buf[: end + 4 + size + 4]


def decode_record(record: bytes) -> dict:
    """Fields of RECORD that the record itself holds; the payload of a response is checked against its digest."""
    head, _, block = record[:-4].partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    page = lambda urn: None if urn is None or urn == _urn(None) else int(urn[1:-1].rsplit(":", 1)[1])
    n = int(re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", http)[1])
    if fields["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": n, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To")), "payload": payload}


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "index_path", "n_records", "n_bytes"])


def write_archives(rows: DataFrame, level: int = LEVEL, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes record_types() rows as WARC records, each archive one gzip stream; a new archive starts after roll_bytes
    (before compression). Returns the manifest (path, index_path null, n_records, n_bytes before compression)."""
    top = new_path(rows.sparkSession, "warc")

    def write(batches):
        system, base = _open(top)
        system.create_dir(base, recursive=True)
        done, out = [], None
        for b in batches:
            for page_id, url, html, digest, refers_to in zip(*(b.column(i) for i in range(5)), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, z, n, size = system.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                record = encode_record(page_id.as_py(), url.as_py(), payload, digest.as_py(), refers_to.as_py())
                out.write(z.compress(record))
                n, size = n + 1, size + len(record)
                if size >= roll_bytes:
                    out.write(z.flush())
                    out.close()
                    done.append((f"{top}/{name}", None, n, size))
                    out = None
        if out is not None:
            out.write(z.flush())
            out.close()
            done.append((f"{top}/{name}", None, n, size))
        yield _manifest(done)

    return materialize(map_batches(rows.select("page_id", "url", "html", "digest", "refers_to"), write, MANIFEST), "warc-manifest")


def _spread(manifest: DataFrame) -> DataFrame:
    """An archive or a few to a task."""
    return manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def normalise(manifest: DataFrame, level: int = LEVEL) -> DataFrame:
    """Inflates each archive's stream once, writes every record as a gzip member of its own to a new archive, and beside it
    a sidecar index: a line "offset<TAB>length<TAB>record id" a record. Archives with any number of members are taken.
    Returns the manifest of the new archives."""
    top = new_path(manifest.sparkSession, "warc-members")

    def rewrite(batches):
        system, base = _open(top)
        system.create_dir(base, recursive=True)
        for b in batches:
            done = []
            for path in b.column("path").to_pylist():
                name, at, n, lines = uuid.uuid4().hex, 0, 0, []
                source, inner = _open(path)
                with source.open_input_stream(inner, compression=None) as src, system.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as out, system.open_output_stream(f"{base}/{name}.idx", compression=None) as idx:
                    for record in split_records(inflate(src.read)):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(record) + z.flush()
                        out.write(member)
                        urn = re.search(rb"\r\nWARC-Record-ID: ([^\r]*)", record)[1]
                        lines.append(b"%d\t%d\t%s\n" % (at, len(member), urn))
                        at, n = at + len(member), n + 1
                        if len(lines) >= 4096:
                            idx.write(b"".join(lines))
                            lines = []
                    idx.write(b"".join(lines))
                done.append((f"{top}/{name}.warc.gz", f"{top}/{name}.idx", n, at))
            yield _manifest(done)

    return materialize(map_batches(_spread(manifest), rewrite, MANIFEST), "warc-members-manifest")


def read_records(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of normalised archives, found through the sidecar index: RECORD, with payload (binary) if asked for."""
    schema = RECORD + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], types[x.split()[1]]) for x in schema.split(", ")])

    def read(batches):
        for b in batches:
            for path, index in zip(b.column("path").to_pylist(), b.column("index_path").to_pylist(), strict=True):
                system, inner = _open(path)
                side, side_inner = _open(index)
                with side.open_input_stream(side_inner, compression=None) as s:
                    entries = [x.split(b"\t") for x in s.read().splitlines()]
                rows, held = [], 0
                with system.open_input_file(inner) as f:
                    for offset, length, urn in entries:
                        f.seek(int(offset))
                        record = decode_record(zlib.decompress(f.read(int(length)), 31))
                        if _urn(record["page_id"]).encode() != urn:
                            raise ValueError(f"{index} and {path} disagree at {int(offset)}")
                        held += len(record["payload"]) if payloads else 0
                        rows.append(record | {"archive": path, "offset": int(offset), "length": int(length)})
                        if len(rows) >= 4096 or held >= 32 << 20:
                            yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], arrow)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], arrow)

    return map_batches(_spread(manifest), read, schema)


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """pages (page_id, url, html) written, normalised and read back: one row a page.

    A null html is an empty payload, a null url gives a record without a target, a null page_id a record of its own. Rows that
    are repeated, page_id too, are records each; equal payloads of at least 100 bytes refer to the smallest page_id. Long
    payloads are read in blocks; other columns, whatever their names, are not looked at; empty tables give no rows."""
    return read_records(normalise(write_archives(record_types(pages))), payloads)
