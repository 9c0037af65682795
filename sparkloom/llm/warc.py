"""WARC records in ZIP packages: written by tasks to the shared folder, read back by ranges.

A package holds a gzip WARC file (each record a gzip member) and its index, both stored
without compression by the ZIP, so a record is one range of the package. Readers parse the
package's directories, take the index and fetch records, some neighbours at a time.

Files get a name of their own for each attempt of a task, and the manifest that Spark
writes names those of the attempts that counted; what a lost executor left is not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import lean, new_folder, ship, written
from sparkloom.llm.zipread import Reader, Writer

#: WARC bytes after which a package is closed; bytes of neighbouring records that are fetched at once.
PACKAGE, FETCH = 32 << 20, 4 << 20
LEVEL = 4
# Where a package has its archives and their indexes.
ARCHIVES, INDEXES = "archive/", "indexes/"
DATA, INDEX = "data.warc.gz", "index.cdxj"
#: Tasks that read packages at most; each has whole packages.
READERS = 10_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def from_urn(text: str) -> int | None:
    number = text.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, response: bool, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit has the HTTP head of its payload, whose length stands there, and no payload."""
    digest = digest32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if response else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if not response:
        head += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload (None for a revisit), payload_bytes, payload_digest. Broken records raise ValueError."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record ends early")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != length or digest32(payload) != digest):
        raise ValueError("a payload differs from its digest")
    return {
        "page_id": from_urn(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind,
        "refers_to": from_urn(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
        "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": digest,
    }


def packages(batches: Iterator[pa.RecordBatch], folder: str, package: int, zip64: bool) -> Iterator[pa.RecordBatch]:
    """Writes rows (page_id, url, html, response, refers_to) to packages; gives (path, records, bytes)."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    parts: list[bytes] = []
    index: list[str] = []
    size = 0

    def close() -> pa.RecordBatch:
        name = f"part-{uuid.uuid4().hex}.zip"
        with store.open_output_stream(f"{root}/{name}") as out:
            z = Writer(out, zip64)
            z.add(ARCHIVES + DATA, b"".join(parts))
            z.add(INDEXES + INDEX, "\n".join(index).encode())
            z.close()
            total = z.at
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64()), pa.array([total], pa.int64())], ["path", "records", "bytes"])

    for batch in batches:
        for page_id, url, html, response, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5))):
            data = zlib.compress(record(page_id, url, (html or "").encode(), response, refers_to), LEVEL, wbits=31)
            index.append(json.dumps({"id": page_id, "filename": DATA, "offset": size, "length": len(data)}))
            parts.append(data)
            size += len(data)
            if size >= package:
                yield close()
                parts, index, size = [], [], 0
    if index:
        yield close()


def records(path: str, fetch: int = FETCH) -> Iterator[dict]:
    """The records of a package, by ranges of up to fetch bytes (or of one record).

    All indexes in the package's directory are read; an entry names its archive, or leaves it
    out where there is one only. Neighbours of one archive are fetched together.
    """
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as file:
        z = Reader(file)
        archives = sorted(m for m in z.members if m.startswith(ARCHIVES) and m.endswith((".warc.gz", ".warc")))
        entries = [json.loads(x[x.index("{") :]) for m in sorted(z.members) if m.startswith(INDEXES) and m.endswith(".cdxj") for x in z.whole(m).decode().split("\n") if "{" in x]
        for e in entries:
            e["filename"] = ARCHIVES + e["filename"] if "filename" in e else archives[0]
        i = 0
        while i < len(entries):
            at, archive, end, j = int(entries[i]["offset"]), entries[i]["filename"], 0, i
            while j < len(entries) and entries[j]["filename"] == archive:
                start, stop = int(entries[j]["offset"]), int(entries[j]["offset"]) + int(entries[j]["length"])
                if j > i and (start < at or max(end, stop) - at > fetch):
                    break
                end, j = max(end, stop), j + 1
            data = z.ranged(archive, at, end - at)
            for e in entries[i:j]:
                start = int(e["offset"]) - at
                part = data[start : start + int(e["length"])]
                yield parsed(zlib.decompress(part, wbits=31) if archive.endswith(".gz") else part)
            i = j


def planned(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """(page_id, url, html, response, refers_to): which page of equal payloads of at least least bytes is the response.

    Only digests are grouped, with partial maxima; the pages meet their group's largest key
    by the digest, where the adaptive join splits a group that is most of the table.
    """
    p = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), p.alias("html"), F.sha1(F.encode(p, "UTF-8")).alias("d"))
    largest = rows.groupBy(F.col("d").alias("g")).agg(F.max("page_id").alias("top"))
    met = rows.join(largest, F.col("d") == F.col("g"))
    same = F.col("page_id").eqNullSafe(F.col("top")) | (F.octet_length("html") < least)
    return met.select("page_id", "url", "html", same.alias("response"), F.when(~same, F.col("top")).alias("refers_to"))


def write(pages: DataFrame, package: int = PACKAGE, zip64: bool = False, **names) -> DataFrame:
    """The manifest (path, records, bytes) of packages with a record for each page.

    A null html counts as empty, a null url is left out, a null key is kept as none. Of rows
    that repeat the largest key of equal payloads each is a response. An empty table gives an
    empty manifest. Very long pages make a package of their own. Extra columns are not kept.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = new_folder(spark, "warc")
    made = planned(pages, **names).mapInArrow(lean(lambda b: packages(b, folder, package, zip64)), "path string, records long, bytes long")
    return written(made, "warc-manifest")


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload]) of the packages in a manifest's column path.

    Packages are dealt evenly to as many tasks as there are, READERS at most. A null path counts
    for nothing, a path that repeats is read again, an empty manifest gives an empty table, and
    further columns are not looked at. A record that is broken fails the query.
    """
    ship(manifest.sparkSession)
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}
    kinds |= {"payload": pa.binary()} if payloads else {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for r in records(path):
                    held.append(r)
                    size += len(r["payload"] or b"") if payloads else 64
                    if size >= FETCH:
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], t) for k, t in kinds.items()], list(kinds))
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], t) for k, t in kinds.items()], list(kinds))

    paths = manifest.filter("path is not null").select("path")
    spread = paths.repartition(max(1, min(paths.count(), READERS)))
    return spread.mapInArrow(lean(work), schema)


def oracle(table: str = "pages") -> str:
    """DuckDB SQL of the op7 columns."""
    nibbles = ", ".join(f"'{i:04b}'" for i in range(16))
    five = " + ".join(f"substr(b, (5 * i + {j})::int, 1)::int * {2 ** (5 - j)}" for j in range(1, 6))
    return f"""
with p as (select page_id, encode(coalesce(html, '')) h from {table}),
d as (select page_id, octet_length(h)::bigint n, sha1(h) s from p),
b as (select *, array_to_string(list_transform(range(1, 41), lambda i: ([{nibbles}])[strpos('0123456789abcdef', substr(s, i::int, 1))]), '') b from d),
e as (select page_id, n, s, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {five}, 1)), '') g from b),
m as (select s, max(page_id) top from e group by 1)
select page_id, n payload_bytes, g payload_digest, case when page_id is not distinct from top then 'response' else 'revisit' end record_type,
  case when page_id is distinct from top then top end refers_to
from e join m using (s)"""
