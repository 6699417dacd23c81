"""WARC archives: written from pages, read back, and assembled to one nested row for each capture.

Writing: each task streams its pages into gzip members (one for each record) of files in a folder that all machines share; a file
is renamed to its final name when whole, and the names come back as rows, so files of lost attempts are never read. A page gives a
request, a response (or a revisit, where a page with a smaller id has the same payload) and a metadata record; request
and metadata name the response in WARC-Concurrent-To.

Payloads are hashed where they are read; repeated digests are found without payloads, and only pages that a bitmap of fixed size lets through are joined with
them, those of frequent payloads by broadcast. A revisit names its original's address in WARC-Refers-To-Target-URI.

Reading: each task streams files, record by record. Transactions: records are grouped by the identifier that they are
concurrent to (a response by its own), in one shuffle that needs no payload unless it is asked for. In archives where a response names others, or a record names
several, transactions are the connected components of what is named.

Defined cases: null html is an empty payload; a null url is written as a URN of the page; a null page_id is no target of revisits
and revisits a page that has an id; rows that share the smallest page_id and a payload are responses, all of them; empty
tables give no files and no rows; other columns are ignored; records without a response among them give a row whose response is null.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.llm.common import bits_of, components, hot_join, is_empty, saved, shared_dir

LEAST = 100  # payloads of fewer bytes are never revisits
ROTATE = 64 << 20  # compressed bytes after which a task starts another file
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _member(kind: str, record: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record}>"), ("WARC-Date", DATE), *headers, ("Content-Length", len(block))])
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def _target(page: int | None, url: str | None) -> str:
    return quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{page}"


def _capture(ids: Iterator[str], page: int | None, url: str | None, payload: bytes, digest: str, original: int | None, original_url: str | None) -> bytes:
    target = _target(page, url)
    host, main = target.split("/")[2] if "://" in target else "", next(ids)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    about = [("WARC-Target-URI", target)]
    sums = [*about, ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    near = [*about, ("WARC-Concurrent-To", f"<urn:uuid:{main}>")]
    fields = "" if page is None else f"page-id: {page}\r\n"
    if original is None:
        answer = _member("response", main, sums, http + payload)
    else:
        answer = _member("revisit", main, [*sums, ("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _target(original, original_url)), ("WARC-Refers-To-Date", DATE)], http)
        fields += f"refers-to-page-id: {original}\r\n"
    request = _member("request", next(ids), [*near, ("Content-Type", "application/http;msgtype=request")], f"GET {target} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    return request + answer + _member("metadata", next(ids), [*near, ("Content-Type", "application/warc-fields")], fields.encode())


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives pages(page_id, url, html, ...) in the folder, a URI that executors reach; returns the files: (path, records)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    seen = saved(rows.where(F.octet_length("html") >= LEAST).select("digest", F.struct("page_id", "url").alias("page")), "digests")
    first = seen.groupBy("digest").agg(F.min(F.when(F.col("page.page_id").isNotNull(), F.col("page"))).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = saved(first.select("digest", F.col("first.page_id").alias("original"), F.col("first.url").alias("original_url"), "n"), "repeated")
    bits = np.frombuffer(bits_of(first, "digest"), np.int64)  # 1 MiB
    held = F.broadcast(rows.sparkSession.createDataFrame(pa.table({"w": pa.array(np.flatnonzero(bits).astype(np.int32)), "bits": pa.array(bits[bits != 0])})))
    place = F.expr(f"cast(pmod(xxhash64(digest), {len(bits) * 64}L) / 64 as int)") == F.col("w")
    maybe = place & F.expr("(bits & shiftleft(1L, cast(pmod(xxhash64(digest), 64) as int))) <> 0")
    none = rows.join(held, maybe, "left_anti").select("*", F.lit(None).cast("long").alias("original"), F.lit(None).cast("string").alias("original_url"))
    some = hot_join(rows.join(held, maybe, "left_semi"), first, "digest", how="left").withColumn("original", F.when(~F.col("page_id").eqNullSafe(F.col("original")) & (F.octet_length("html") >= LEAST), F.col("original")))
    typed = none.unionByName(some.select(*none.columns))

    def archive(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = FileSystem.from_uri(folder)
        attempt, count, files, out = uuid.uuid4().hex, 0, [], None

        def ids():
            k = 0
            while True:
                yield str(uuid.UUID(bytes=hashlib.blake2b(f"{attempt}:{k}".encode(), digest_size=16).digest(), version=4))
                k += 1

        made = ids()

        def close():
            out.close()
            fs.move(files[-1][0] + ".part", files[-1][0])
            files[-1][1] = count

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "digest", "original", "original_url")]
            for page, url, html, digest, original, address in zip(*columns):
                if out is None:
                    name = f"{base}/{task.partitionId():06d}-{attempt}-{len(files):04d}.warc.gz"
                    out, count = fs.open_output_stream(name + ".part", compression=None), 0
                    files.append([name, 0])
                    out.write(_member("warcinfo", next(made), [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                out.write(_capture(made, page.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), original.as_py(), address.as_py()))
                count += 3
                if out.tell() >= ROTATE:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64())], names=["path", "records"])

    fs, base = FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    return saved(typed.mapInArrow(archive, "path string, records long"), "warc-files")


def _records(stream) -> Iterator[tuple[dict[str, str], list[str], bytes]]:
    """Headers (lower-case names), all values of WARC-Concurrent-To, and block of each record of a WARC file, gzipped by record or plain."""
    z, data, plain = zlib.decompressobj(31), b"", None
    text = bytearray()

    def more() -> bool:
        nonlocal z, data, plain
        if not data:
            data = bytes(stream.read(1 << 18))
            if not data:
                return False
        if plain is None:
            plain = data[:2] != b"\x1f\x8b"
        if plain:
            text.extend(data)
            data = b""
            return True
        text.extend(z.decompress(data, 1 << 20))
        data = z.unconsumed_tail or z.unused_data
        if z.eof:
            z = zlib.decompressobj(31)
        return True

    while True:
        while (end := text.find(b"\r\n\r\n")) < 0:
            if not more():
                if text.strip():
                    raise ValueError("a WARC record ends in its headers")
                return
        lines = bytes(text[:end]).decode("utf-8", "replace").strip().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        pairs = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
        headers, concurrent = dict(pairs), [v for k, v in pairs if k == "warc-concurrent-to"]
        size = int(headers["content-length"])
        while len(text) < end + 4 + size + 4:
            if not more():
                break
        if len(text) < end + 4 + size:
            raise ValueError("a WARC record is cut off")
        block = bytes(text[end + 4 : end + 4 + size])
        del text[: end + 4 + size + 4]
        yield headers, concurrent, block


RECORD = "record_id string, type string, concurrent_to array<string>, target_uri string, refers_to string, refers_to_uri string, content_type string, profile string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def read(files: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of files(path, ...) as rows of RECORD; payload is null unless asked for.

    The payload of a response is checked against its digest; payload_bytes of a revisit is what its HTTP header says.
    """

    def scan(batches):
        fs, _ = FileSystem.from_uri(folder)
        schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string()))] + [(c, pa.string()) for c in ("target_uri", "refers_to", "refers_to_uri", "content_type", "profile", "payload_digest")] + [("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as stream:
                    for h, near, block in _records(stream):
                        kind, payload, n, fields = h.get("warc-type"), None, None, None
                        digest = (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None
                        if kind in ("response", "revisit"):
                            head, _, body = block.partition(b"\r\n\r\n")
                            if kind == "response":
                                payload, n = body, len(body)
                                if digest and hashlib.sha256(body).hexdigest() != digest:
                                    raise ValueError(f"{h.get('warc-record-id')}: the payload isn't that of its digest")
                            else:
                                n = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                        elif h.get("content-type") == "application/warc-fields":
                            fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode().split("\r\n") if x)]
                        rows.append((h.get("warc-record-id"), kind, near, h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-refers-to-target-uri"), h.get("content-type"), h.get("warc-profile"), digest, n, fields, payload if payloads else None))
                        size += len(block) * payloads + 500
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.select("path").repartition(max(1, min(files.count(), 4096))).mapInArrow(scan, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row for each capture: (capture, request, response, metadata), joined through concurrent-to identifiers; records is read twice.

    capture is the identifier of the response where records name that, else the smallest of those joined.
    """
    part = lambda kinds, columns: F.first(F.when(F.col("type").isin(*kinds), F.struct(*columns)), ignorenulls=True)
    rows = records.where("type in ('request', 'response', 'revisit', 'metadata')")
    other = rows.where("size(concurrent_to) > 1 or type in ('response', 'revisit') and size(concurrent_to) > 0").select("record_id")
    if is_empty(other):
        rows = rows.withColumn("capture", F.coalesce(F.get("concurrent_to", F.lit(0)), "record_id"))
    else:
        roots = components(rows.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))).select(F.col("node").alias("record_id"), F.col("root").alias("capture"))
        rows = rows.join(roots, "record_id", "left").withColumn("capture", F.coalesce("capture", "record_id"))
    return rows.groupBy("capture").agg(
        part(["request"], ["record_id", "target_uri"]).alias("request"),
        part(["response", "revisit"], ["record_id", "type", "target_uri", "refers_to", "refers_to_uri", "profile", "payload_digest", "payload_bytes", "payload"]).alias("response"),
        part(["metadata"], ["record_id", "fields"]).alias("metadata"),
    )


def page_captures(spark: SparkSession, pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Writes pages to archives in the shared folder, reads them back and gives (page_id, payload_bytes, payload_digest, record_type, refers_to[, payload])."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records = read(write(pages, folder), folder, payloads)
    captures = transactions(records if payloads else saved(records, "warc-records")).where("response is not null")
    number = lambda key: F.col("metadata.fields")[key].cast("long")
    columns = [number("page-id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), number("refers-to-page-id").alias("refers_to")]
    return captures.select(*columns, *([F.col("response.payload").alias("payload")] if payloads else []))
