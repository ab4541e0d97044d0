"""WARC archives: writing, and segment reassembly when they are read back.

Written: a response record per page (an HTTP head and the payload in chunked
transfer framing), or a revisit record for a payload that another page holds.
A block longer than ``segment_bytes`` is cut: the first segment is the record
itself (WARC-Segment-Number 1), the others are continuation records that name
it in WARC-Segment-Origin-ID; the last has WARC-Segment-Total-Length.

Read: records are parsed one at a time from each archive's stream; segments are
grouped by their origin's identifier, ordered by segment number, checked against
the total length, and the chunked framing is decoded.  Only records that are cut
are shuffled; a group holds one record.

Archives go to the folder in spark.checkpoint.dir under a name of the task
attempt; the manifest, itself a written table, lists those of the attempts that
counted, so a retry leaves at most an unread file.

A record's role depends on its page_id and payload alone: rows need no numbers,
and record identifiers are made where a record is written, of its archive's name
and its place there.

Defined cases: a null payload is empty; an empty payload is a record of its own
and can be revisited; each row is a record and gives a row, repeated ones too;
rows of one page_id with equal payloads have the same role; a null page_id ranks
below all others; a null url is empty; other columns, whatever their names, are
ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxstrata.llm.common import new_path, small_batches, written
from voxstrata.llm.components import sized

VERSION = b"WARC/1.1"
CHUNK = 8192
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped.  Raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        eol = body.index(b"\r\n", at)
        n = int(body[at:eol].split(b";")[0], 16)
        at = eol + 2
        if not n:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk ends early")
        out.append(body[at : at + n])
        at += n + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(archive: str, place: int, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}/{place}/{segment}')}>"


def page_records(page: int | None, url: str, payload: bytes, refers_to: int | None, segment_bytes: int, archive: str, place: int) -> list[bytes]:
    """All records of a page, in order; archive and place name them."""
    rid = record_id(archive, place)
    common = [("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), *[("WARC-Page", str(page))] * (page is not None), ("WARC-Payload-Digest", "sha1:" + digest(payload))]
    if refers_to is not None:
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *common, ("WARC-Refers-To-Page", str(refers_to)), ("WARC-Payload-Length", str(len(payload))), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], b"")]
    block = HEAD + chunked(payload)
    if len(block) <= segment_bytes:
        return [record([("WARC-Type", "response"), ("WARC-Record-ID", rid), *common], block)]
    out, parts = [], [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for k, part in enumerate(parts, 1):
        number = ("WARC-Segment-Number", str(k))
        if k == 1:
            out.append(record([("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, number], part))
        else:
            last = [("WARC-Segment-Total-Length", str(len(block)))] * (k == len(parts))
            out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(archive, place, k)), ("WARC-Segment-Origin-ID", rid), number, *last], part))
    return out


def read_records(stream):
    """(fields, block) of each record of an archive's stream."""
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record ends early")
        yield fields, block


def _store(uri: str):
    return pafs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, root: str, segment_bytes: int, archive_bytes: int) -> DataFrame:
    """Writes rows (page, url, payload, refers_to); returns the manifest (path, records), written and reread."""

    def run(batches):
        where, name, out, paths = None, "", None, []
        raw = n = rows = 0
        for b in batches:
            for at in range(0, b.num_rows, 20):
                for r in b.slice(at, 20).to_pylist():
                    if out is None:
                        fs, where = _store(root)
                        fs.create_dir(where, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, raw, n, rows = gzip.GzipFile(fileobj=(sink := fs.open_output_stream(f"{where}/{name}", compression=None)), mode="wb", compresslevel=4, mtime=0), 0, 0, 0
                    for rec in page_records(r["page"], r["url"] or "", r["payload"] or b"", r["refers_to"], segment_bytes, name, rows):
                        out.write(rec)
                        raw, n = raw + len(rec), n + 1
                    rows += 1
                    if raw >= archive_bytes:
                        out.close(), sink.close()
                        paths.append((f"{root}/{name}", n))
                        out = None
        if out is not None:
            out.close(), sink.close()
            paths.append((f"{root}/{name}", n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in paths], pa.string()), pa.array([n for _, n in paths], pa.int64())], ["path", "records"])

    with small_batches(pages.sparkSession):
        return written(pages.mapInArrow(run, "path string, records long"), "warc-manifest")


def assemble(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The payload of a record's segments (number, total length or None, block).  ValueError: one lacks or repeats, the length differs, or the framing is broken."""
    segments = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("segments are missing or repeated")
    block = b"".join(s[2] for s in segments)
    if len(segments) > 1 and segments[-1][1] != len(block):
        raise ValueError("the total length differs")
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_READ_SQL = "origin string, page long, kind string, stated string, refers_to long, payload_bytes long, payload_digest string, valid boolean, segment long, total long, block binary"
_PAGE = ["page", "kind", "stated", "refers_to", "payload_bytes", "payload_digest", "valid"]
_PAGE_SQL = "page long, kind string, stated string, refers_to long, payload_bytes long, payload_digest string, valid boolean"
_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
_arrow = lambda ddl: pa.schema([(k, _TYPES[v]) for k, v in (c.split(" ") for c in ddl.split(", "))])


def _checked(segments: list[tuple[int, int | None, bytes]], stated: str | None) -> dict:
    """Length and digest of the payload, and whether that is the stated one; no payload where the segments or the framing are broken."""
    try:
        p = assemble(segments)
    except ValueError:
        return {"payload_bytes": None, "payload_digest": None, "valid": False}
    d = digest(p)
    return {"payload_bytes": len(p), "payload_digest": d, "valid": d == stated}


def _read(f: dict[str, str], block: bytes) -> dict:
    """A record's row: payload length and digest of a whole one, the block of a segment."""
    whole = lambda k: int(f[k]) if k in f else None
    row = {
        "origin": f.get("warc-segment-origin-id", f["warc-record-id"]), "page": whole("warc-page"), "kind": f["warc-type"],
        "stated": f.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": whole("warc-refers-to-page"),
        "payload_bytes": None, "payload_digest": None, "valid": None, "segment": whole("warc-segment-number"), "total": whole("warc-segment-total-length"), "block": None,
    }
    if row["kind"] == "revisit":
        return row | {"payload_bytes": whole("warc-payload-length"), "payload_digest": row["stated"], "valid": True}
    if row["segment"] is not None:
        return row | {"block": block}
    return row | _checked([(1, None, block)], row["stated"])


def _rows(batches):
    held, size, schema = [], 0, _arrow(_READ_SQL)
    for b in batches:
        for path in b.column(0).to_pylist():
            fs, where = _store(path)
            with fs.open_input_stream(where, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                for f, block in read_records(stream):
                    held.append(_read(f, block))
                    size += len(held[-1]["block"] or b"")
                    if size > 2_000_000 or len(held) >= 2000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _joined(batches):
    """A row for each record from its segments: as much at a time as one record holds."""
    schema = _arrow(_PAGE_SQL)
    for b in batches:
        for at in range(b.num_rows):
            (parts,) = b.column(0).slice(at, 1).to_pylist()
            first = min(parts, key=lambda s: s["segment"])
            row = {k: first[k] for k in ("page", "kind", "stated")} | {"refers_to": None}
            yield pa.RecordBatch.from_pylist([row | _checked([(s["segment"], s["total"], s["block"]) for s in parts], first["stated"])], schema)


def read_archives(manifest: DataFrame) -> DataFrame:
    """page, kind, stated, refers_to, payload_bytes, payload_digest, valid of each record of the archives in manifest.path.

    A revisit has the payload length and digest that it states."""
    paths = manifest.select("path").repartition(max(1, manifest.count()), "path")
    rows = written(paths.mapInArrow(_rows, _READ_SQL), "warc-records")
    parts = rows.where("segment is not null").groupBy("origin").agg(F.collect_list(F.struct("segment", "total", "block", "page", "kind", "stated")).alias("parts"))
    with small_batches(manifest.sparkSession):
        joined = written(parts.select("parts").mapInArrow(_joined, _PAGE_SQL), "warc-joined")
    return rows.where("segment is null").select(_PAGE).unionByName(joined)


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page, url, payload) and refers_to: the largest page of those with an equal payload, null for that page and for payloads under least_bytes."""
    keyed = pages.withColumn("key", F.unhex(F.sha2("payload", 256)))
    # only payloads that several rows have: narrow, and pre-aggregated before it's shuffled
    shared = written(keyed.where(F.length("payload") >= least_bytes).groupBy("key").agg(F.max("page").alias("top"), F.count("*").alias("n")).where("n > 1").select("key", "top"), "shared-payloads")
    marked = keyed.join(sized(shared, shared.count()), "key", "left")
    return marked.select("page", "url", "payload", F.when(F.coalesce(F.col("page") < F.col("top"), F.col("top").isNotNull()), F.col("top")).alias("refers_to"))


def roundtrip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, segment_bytes: int = 16_384, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes a record per row and reads the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, valid."""
    base = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"), F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload"))
    manifest = write_archives(with_roles(base, least_bytes), new_path(pages.sparkSession, "warc"), segment_bytes, archive_bytes)
    return read_archives(manifest).select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to", "valid")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(sha1(h), (5 * i) // 4 + 1, 2))::INTEGER >> (3 - (5 * i) % 4)::INTEGER) & 31)), 1)), '') AS payload_digest,
  CASE WHEN coalesce(page_id < top, top IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN coalesce(page_id < top, top IS NOT NULL) THEN top END AS refers_to
FROM p JOIN m USING (h)
"""
