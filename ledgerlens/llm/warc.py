"""WARC archives with dictionary-compressed records, and their reader.

An archive is a ``.warc.zst`` file: a leading skippable frame with magic number 0x184D2A5D holds a Zstandard
dictionary built from the archive's first records; each record after it is a frame of its own, compressed with that
dictionary. Too few or too small records give no dictionary, and then the archive has no leading frame.

Of records with equal payloads of at least ``revisit_bytes`` bytes, the one with the smallest page id is a response
and the others are revisits that name it; smaller ones are all responses. Payloads are equal when their SHA-256 are.

The rows come to the writers by the join with their digest's group, which adaptive execution splits when a payload is
hot; groups of one are left out of it. Each writer task has an archive of its own in the shared folder, opened through
pyarrow's file systems and named for the attempt; the manifest lists the archives of the attempts that ended well, so
what a lost executor left is never read. The memory of a writer is bounded by ``DICTIONARY_SAMPLE`` and one record.

Defined results: null html is an empty payload; a null url writes no target; rows that repeat the smallest page id
are all responses; a row with null page id is a revisit if its group has an id, else a response; an empty table gives
no archives and no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm.arrow import bound_batches
from ledgerlens.session import materialize, scratch_path, table

REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3
#: Bytes of records, and of one record, that the dictionary is built from; the dictionary's size.
DICTIONARY_SAMPLE, RECORD_SAMPLE, DICTIONARY_BYTES = 1 << 20, 1 << 15, 1 << 15
#: Fixed values of the archive format: the frame's magic number, and the profile of revisits.
MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long, dictionary_bytes long"
RECORDS = "page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def build_record(page_id: str | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: str | None) -> bytes:
    """One WARC record: HTTP header lines and, in a response, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page: {refers_to}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from the first ``RECORD_SAMPLE`` bytes of the records; those bytes themselves where Zstandard finds too little to build one."""
    import zstandard

    samples = [x[:RECORD_SAMPLE] for x in records]
    plain = b"".join(samples)[:DICTIONARY_BYTES]
    if len(samples) < 8:
        return plain
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return plain


def write_archive(records: Iterator[bytes], out: io.RawIOBase) -> tuple[int, int]:
    """Writes the dictionary's frame and a frame for each record; returns the records and the dictionary's bytes."""
    import zstandard

    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record)
        if size >= DICTIONARY_SAMPLE:
            break
    trained = train_dictionary(held)
    if trained:
        out.write(struct.pack("<II", MAGIC, len(trained)) + trained)
    using = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
    press = zstandard.ZstdCompressor(level=LEVEL, **using)
    n = 0
    for part in (held, records):
        for record in part:
            out.write(press.compress(record))
            n += 1
    return n, len(trained)


def _headers(source: io.BufferedReader) -> dict[str, str] | None:
    first = source.readline()
    if not first:
        return None
    if first != b"WARC/1.1\r\n":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    found = {}
    while (line := source.readline()) != b"\r\n":
        if not line:
            raise ValueError("a record ends in its header")
        name, _, value = line.decode().rstrip("\r\n").partition(": ")
        found[name] = value
    return found


def read_archive(raw: io.RawIOBase) -> Iterator[dict]:
    """The records of an archive, one at a time; a response whose payload doesn't have its digest is an error."""
    import zstandard

    head, trained = raw.read(8), b""
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == MAGIC:
        trained, head = raw.read(struct.unpack("<I", head[4:])[0]), b""

    class Rest:
        """The stream with what was read of it put back."""

        def __init__(self) -> None:
            self.first = head

        def read(self, n: int = -1) -> bytes:
            first, self.first = self.first, b""
            return first or raw.read(n)

    using = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
    source = io.BufferedReader(zstandard.ZstdDecompressor(**using).stream_reader(Rest(), read_across_frames=True), 1 << 16)
    while (head_lines := _headers(source)) is not None:
        block = source.read(int(head_lines["Content-Length"]))
        if source.read(4) != b"\r\n\r\n":
            raise ValueError("a record has no end mark")
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(http.rpartition(b"Content-Length: ")[2])
        digest = head_lines["WARC-Payload-Digest"].removeprefix("sha256:")
        kind = head_lines["WARC-Type"]
        if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"the payload of {head_lines['WARC-Record-ID']} has another digest")
        yield {
            "page_id": head_lines.get("X-Page-Id"),
            "url": head_lines.get("WARC-Target-URI"),
            "record_type": kind,
            "payload_digest": digest,
            "payload_bytes": length,
            "refers_to": head_lines.get("X-Refers-To-Page"),
            "payload": payload if kind == "response" else None,
        }


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, revisit_bytes: int) -> DataFrame:
    """page_id, url, payload (of responses), digest, revisit and refers_to for every page."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("payload", 256)), "size": F.octet_length("payload")})
    groups = (
        rows.filter(F.col("size") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first_id is not null")
        .drop("n")
    )
    revisit = F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull())
    # What is too small to be a revisit has no part in the join.
    joined = rows.filter(F.col("size") >= revisit_bytes).join(groups, "digest", "left")
    short = rows.filter(F.col("size") < revisit_bytes).withColumn("first_id", F.lit(None).cast(rows.schema["page_id"].dataType))
    return joined.unionByName(short).select(
        F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.lower(F.hex("digest")).alias("digest"),
        revisit.alias("revisit"), F.when(revisit, F.col("first_id").cast("string")).alias("refers_to"),
    )


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES
) -> DataFrame:
    """Writes the archives below ``folder``; returns the manifest: path, records, bytes, dictionary_bytes."""
    bound_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def records() -> Iterator[bytes]:
            for batch in batches:
                for row in zip(*(batch.column(k) for k in range(6)), strict=True):
                    page_id, url, payload, digest, revisit, refers_to = (x.as_py() for x in row)
                    yield build_record(page_id, url, payload, digest, revisit, refers_to)

        source = records()
        first = next(source, None)
        if first is None:
            return
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"

        def all_records() -> Iterator[bytes]:
            yield first
            yield from source

        with store.open_output_stream(f"{base}/{name}", buffer_size=1 << 18) as out:
            n, trained = write_archive(all_records(), out)
            size = out.tell()
        columns = [pa.array([f"{folder}/{name}"]), *(pa.array([x], pa.int64()) for x in (n, size, trained))]
        yield pa.RecordBatch.from_arrays(columns, ["path", "records", "bytes", "dictionary_bytes"])

    planned = plan_records(pages, id_col, url_col, html_col, revisit_bytes)
    return materialize(planned.mapInArrow(write, MANIFEST), "warc-manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """The records of all archives of a manifest, as RECORDS; each archive is a task's work."""
    bound_batches(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = [x.split(" ")[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64() if x.endswith(" long") else pa.binary() if x.endswith(" binary") else pa.string() for x in RECORDS.split(", ")]

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, buffer_size=1 << 18) as raw:
                    rows, size = [], 0
                    for record in read_archive(raw):
                        rows.append(record)
                        size += len(record["payload"] or b"")
                        if size >= 1 << 22 or len(rows) >= 2000:
                            yield packed(rows)
                            rows, size = [], 0
                    if rows:
                        yield packed(rows)

    files = manifest.select("path")
    return files.repartition(max(1, files.count()), "path").mapInArrow(read, RECORDS)


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all ``pages`` and returns what the archives hold."""
    pages = table(spark, sf_dir, "pages")
    manifest = write_warc(pages, scratch_path(spark, "warc"))
    kind = pages.schema["page_id"].dataType
    return read_warc(manifest).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


QUERIES = {"op3_warc_archive": op3_warc_archive}
ORACLES = {
    "op3_warc_archive": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p),
        r AS (SELECT *, payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS revisit FROM g)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN revisit THEN first_id END AS refers_to
        FROM r""",
}
