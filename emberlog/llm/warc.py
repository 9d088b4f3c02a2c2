"""Operator 8: WARC archives with an index that comes first.

Writing is a map over the pages: each task streams gzip members, one for each record, into files of its own in a
shared folder, and returns an index row with file, offset, length, URL and digest for each record. The index is
written as Parquet and is the commit: files of a task that was lost or repeated are never referred to.
Reading starts from any selection of index rows: they are sorted by file and offset, neighbouring ranges become one
bounded read, and records are cut from it. No payload is shuffled, and duplicates are found from digests alone.

Defined cases: a null html is an empty payload; a null URL leaves its header out; payloads under `least_bytes` are
always responses; a repeated row is written once more with the same type; a row with a null id is a response unless
an equal payload has an id; an empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import materialize, own_columns, shared_dir

#: A task begins another file beyond so many bytes.
FILE_BYTES = 128 << 20
#: Ranges with a smaller gap are read at once, up to so many bytes.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Archive bytes that a reading task gets, where there are enough of them for all cores.
TASK_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record of WARC 1.1, uncompressed."""
    block = b""
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    safe = None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {safe}"] if safe is not None else []),
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, and the payload without its HTTP headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes all pages below folder and returns the index, a row for each record, itself written below folder."""
    html = F.coalesce("html", F.lit(""))
    slim = own_columns(pages, "page_id", "url", "html").select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    copies = slim.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    # Written first: its true size then decides whether the pages need a shuffle at all.
    copies = materialize(copies, f"{folder}/copies")
    typed = slim.join(copies, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id"))), F.col("first_id")).alias("refers_to"))

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, base = _filesystem(folder)
        fs.create_dir(f"{base}/archives", recursive=True)
        out = name = None
        offset = 0
        try:
            for batch in batches:
                files, offsets, lengths = [], [], []
                for page_id, url, text, digest, refers_to in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    if out is None or offset >= file_bytes:
                        if out:
                            out.close()
                        name, offset = f"archives/{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    member = gzip.compress(record(page_id, url, text.encode(), digest, refers_to), 4, mtime=0)
                    out.write(member)
                    files.append(name)
                    offsets.append(offset)
                    lengths.append(len(member))
                    offset += len(member)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(files, "string"), pa.array(offsets, "int64"), pa.array(lengths, "int64")], ["page_id", "url", "digest", "refers_to", "file", "offset", "length"])
        finally:
            if out:
                out.close()

    return materialize(typed.mapInArrow(write, "page_id long, url string, digest string, refers_to long, file string, offset long, length long"), f"{folder}/index")


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """page_id, record_type, refers_to, digest (as the record states), payload: the records of the selected index rows.

    Index rows are few bytes for each record, so tasks are dealt by what they will read: ranges of file and offset, as
    many as the records' lengths ask for.
    """
    total = selected.agg(F.sum("length").alias("n")).first()["n"] or 0
    cores = selected.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-total // TASK_BYTES), min(cores, -(-total // READ_BYTES * 4)), 1)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, base = _filesystem(folder)
        name = source = None
        for batch in batches:
            ranges = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            at = 0
            while at < len(ranges):
                file, begin, n = ranges[at]
                end, stop = begin + n, at + 1
                while stop < len(ranges) and ranges[stop][0] == file and ranges[stop][1] <= end + GAP_BYTES and ranges[stop][1] + ranges[stop][2] - begin <= READ_BYTES:
                    end = max(end, ranges[stop][1] + ranges[stop][2])
                    stop += 1
                if file != name:
                    if source:
                        source.close()
                    name, source = file, fs.open_input_file(f"{base}/{file}")
                chunk = source.read_at(end - begin, begin)
                rows: list[tuple] = []
                for _, offset, length in ranges[at:stop]:
                    fields, payload = parse_record(gzip.decompress(chunk[offset - begin : offset - begin + length]))
                    own, ref = (None if x in (None, "<urn:page:None>") else int(x[10:-1]) for x in (fields["WARC-Record-ID"], fields.get("WARC-Refers-To")))
                    rows.append((own, fields["WARC-Type"], ref, fields["WARC-Payload-Digest"][7:], payload))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), ("int64", "string", "int64", "string", "binary"))], ["page_id", "record_type", "refers_to", "digest", "payload"])
                at = stop
        if source:
            source.close()

    ranges = selected.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(read, "page_id long, record_type string, refers_to long, digest string, payload binary")


def archived_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 100) -> DataFrame:
    """Writes pages, reads all records back, and describes each: what a revisit refers to is looked up in the archive."""
    folder = folder or shared_dir(pages.sparkSession)
    index = write_archives(pages, folder, least_bytes)
    read = read_records(index, folder).select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("actual"))
    read = materialize(read, f"{folder}/read")
    responses = read.where("record_type = 'response'")
    full = responses.join(read.where("refers_to IS NOT NULL").select(F.col("refers_to").alias("page_id"), "digest").distinct(), ["page_id", "digest"], "left_semi").groupBy("page_id", "digest").agg(F.min("bytes").alias("bytes"), F.min("actual").alias("actual"))
    revisits = read.where("record_type = 'revisit'").drop("bytes", "actual").alias("r").join(full.alias("f"), (F.col("r.refers_to") == F.col("f.page_id")) & (F.col("r.digest") == F.col("f.digest")), "left").select("r.page_id", "r.record_type", "r.refers_to", "f.bytes", "f.actual")
    both = responses.select("page_id", "record_type", "refers_to", "bytes", "actual").unionByName(revisits)
    return both.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("actual").alias("payload_digest"), "record_type", "refers_to")
