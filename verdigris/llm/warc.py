"""WARC archives: records with chunked bodies and segments written, and read back whole.

Writing: a response is an HTTP message whose body is framed in chunks. Where its block is longer
than segment bytes, the first part stays in the response record (WARC-Segment-Number: 1) and the
rest goes to continuation records that name their origin, their number and, the last, the total
length. Of equal payloads of at least least_bytes, the one with the largest key is a response and the others
are revisit records that refer to it by its key and the payload's digest.

Reading: records are parsed out of the archives; continuations are grouped by their origin, put in
order of their segment numbers, checked against the total length, and the chunked framing is
decoded. Only segmented records go through a shuffle.

Archives are .warc.gz files, a gzip member per record, of at most archive bytes (one record at
least), in a folder that all executors share. Every attempt of a task writes archives of its own; the
manifest beside them, a table that Spark commits, names those of the attempts that counted, and the
reader follows it. So neither a lost executor nor a second attempt leaves half an archive or a record
twice. A folder without a manifest is read whole.

Repeated rows and null keys: a record is named by the task and its place there, not by its key, so each
row gives a record and a row back. Null keys are smaller than all others. Of equal payloads with the
same largest key (or only null keys) all are responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import common_values, delete, scratch, spread_join, staged, tune

#: Bytes of a block's part in one record; of an archive; of an HTTP chunk.
SEGMENT, ARCHIVE, CHUNK = 16 << 10, 16 << 20, 4096
#: Compressed bytes that are decompressed at a time.
PIECE = 8 << 10
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(name: object, segment: int = 1) -> str:
    """A record's identifier, from what names it in its folder."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{name}:{segment}')}>"


def header(key: object) -> str | None:
    """A key as the value of a header."""
    return None if key is None else quote(str(key), safe=" !#$&'()*+,/:;=?@[]~")


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """body in HTTP/1.1 chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for x in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes:
    """The body of a chunked framing; extensions and trailers are dropped. Raises ValueError if it is cut short."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(framed[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(framed) < at + size + 2 or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(framed[at : at + size])
        at += size + 2


def record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def records(name: object, key: object, uri: str | None, payload: bytes, sha: str, refers_to: object = None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page; name tells it from all others of its folder."""
    uri = re.sub(r"[\r\n]+", " ", uri or "")
    named = [("WARC-Date", _DATE), ("WARC-Target-URI", uri), ("X-Key", header(key))]
    if refers_to is not None:
        yield record("revisit", [("WARC-Record-ID", record_id(name)), *named, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Key", header(refers_to)), ("WARC-Payload-Digest", f"sha1:{sha}")], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = [("WARC-Record-ID", record_id(name)), *named, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha}")]
    yield record("response", first + ([("WARC-Segment-Number", 1)] if len(parts) > 1 else []), parts[0])
    for n, x in enumerate(parts[1:], 2):
        last = n == len(parts)
        yield record("continuation", [("WARC-Record-ID", record_id(name, n)), *named, ("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", record_id(name)), ("WARC-Segment-Total-Length", len(block) if last else None)], x)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record. Raises ValueError if a record is cut short."""
    at = 0
    while at < len(archive):
        if archive.startswith(b"\r\n", at):
            at += 2
            continue
        end = archive.find(b"\r\n\r\n", at)
        if end < 0 or not archive.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        at = end + 4
        if len(archive) < at + size:
            raise ValueError("record is cut short")
        yield headers, archive[at : at + size]
        at += size + 4


def gzipped(record: bytes) -> bytes:
    """A gzip member."""
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def members(archive: bytes) -> Iterator[bytes]:
    """The contents of the gzip members of an archive; of one that isn't compressed, all of it."""
    if not archive.startswith(b"\x1f\x8b"):
        yield archive
        return
    view, at, out, d = memoryview(archive), 0, [], zlib.decompressobj(31)
    while at < len(view):
        piece = view[at : at + PIECE]
        out.append(d.decompress(piece))
        at += len(piece) - len(d.unused_data)
        if d.eof:
            yield b"".join(out)
            out, d = [], zlib.decompressobj(31)
    if out:
        raise ValueError("gzip member is cut short")


def file_system(folder: str):
    """The Arrow file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", folder)
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def plan(pages: DataFrame, key: str, uri: str, payload: str, least_bytes: int) -> DataFrame:
    """key, uri, payload, sha and refers_to (null: a response) of each page.

    The largest key of equal payloads is found on digests alone, added up before the shuffle; payloads that are
    common are joined without a shuffle.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    keys = pages.select(F.col(key).alias("of"), F.unhex(F.sha1(body)).alias("sha"), F.length(body).alias("bytes"))
    digests = keys.filter(F.col("bytes") >= least_bytes).groupBy("sha").agg(F.max("of").alias("first"), F.count("*").alias("n"))
    digests = staged(digests, "digests", pages.count())
    firsts = digests.filter("n > 1 and first is not null").select("sha", "first")
    rows = pages.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), body.alias("payload"), F.unhex(F.sha1(body)).alias("sha"))
    return spread_join(rows, firsts, "sha", common_values(digests, "sha")).withColumn("refers_to", F.expr("if(key <=> first, null, first)")).drop("first")


def write(pages: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html", least_bytes: int = 0, segment: int = SEGMENT, archive: int = ARCHIVE) -> int:
    """Write a record per page below folder, and the manifest of its archives; the number of pages. Null payloads are
    empty, text is UTF-8. Extra columns are not read."""
    spark = pages.sparkSession
    tune(spark)
    files, path = file_system(folder)
    files.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = file_system(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        open_file, size, place, names, counts = None, 0, 0, [], []
        try:
            for b in batches:
                for k, u, p, s, r in zip(*(b.column(c) for c in ("key", "uri", "payload", "sha", "refers_to"))):
                    for x in records(f"{folder}:{part}:{place}", k.as_py(), u.as_py(), p.as_py(), base64.b32encode(s.as_py()).decode(), r.as_py(), segment):
                        x = gzipped(x)
                        if open_file is None or size + len(x) > archive and size:
                            if open_file is not None:
                                open_file.close()
                            names.append(f"part-{part:05}-{len(names):04}-{attempt}.warc.gz")
                            counts.append(0)
                            open_file, size = files.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                        open_file.write(x)
                        size += len(x)
                    counts[-1] += 1
                    place += 1
        finally:
            if open_file is not None:
                open_file.close()
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "pages": pa.array(counts, pa.int64())})

    plan(pages, key, uri, payload, least_bytes).select("key", "uri", "payload", "sha", "refers_to").mapInArrow(run, "name string, pages bigint").write.parquet(f"{folder}/manifest")
    return manifest(spark, folder).agg(F.sum("pages")).first()[0] or 0


def manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """name and pages of the archives that count, or None if the folder has no manifest."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema("name string, pages bigint").parquet(f"{folder}/manifest")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """content of the archives of a folder: those of its manifest, opened by the tasks, or all of them."""
    named = manifest(spark, folder)
    if named is None:
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = file_system(folder)
        for b in batches:
            for name in b.column("name"):
                with files.open_input_stream(f"{path}/{name.as_py()}", compression=None) as f:
                    yield pa.RecordBatch.from_pydict({"content": pa.array([f.read()], pa.binary())})

    return named.select("name").repartition(max(1, min(100_000, named.count()))).mapInArrow(run, "content binary")


def assemble(number: list[int], total: list[int | None], block: list[bytes]) -> bytes:
    """A record's block from its segments. Raises ValueError if one is missing or the total length is wrong."""
    order = sorted(range(len(number)), key=number.__getitem__)
    number, total = [number[i] for i in order], [total[i] for i in order if total[i] is not None]
    if number != list(range(1, len(number) + 1)):
        raise ValueError(f"segments {number}")
    out = b"".join(block[i] for i in order)
    if total != [len(out)]:
        raise ValueError(f"{len(out)} bytes of {total}")
    return out


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """key (string), uri, record_type, refers_to (string key), payload, payload_bytes, payload_digest, error of each record.

    Revisits have no payload of their own: payload is null, length and digest are those of the response of the digest
    that they name. Segments missing, double or of another total length, and broken framing, give null payload columns
    and what is wrong in error; so does a revisit whose response is missing. payloads=False leaves the payloads out.
    A continuation whose first segment is missing gives a row of its own.
    """
    tune(spark)
    done = "kind string, key string, uri string, refers_key string, sha string, payload binary, payload_bytes bigint, payload_digest string, error string"
    schema = "origin string, number int, total bigint, " + done
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 5, pa.binary(), pa.int64(), pa.string(), pa.string()]

    def finish(block: bytes | None, claimed: str | None, error: str | None) -> tuple:
        """payload, payload_bytes, payload_digest, error of a whole block."""
        payload = sha = None
        if error is None:
            try:
                payload = payload_of(block)
                sha = digest(payload)
                if claimed and claimed != sha:
                    error = f"digest {sha}, not {claimed}"
            except ValueError as e:
                error = str(e)
        return (payload if payloads else None, None if payload is None else len(payload), sha, error)

    def parsed(h: dict[str, str], block: bytes) -> tuple:
        claimed = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        about = (h.get("warc-type"), unquote(h["x-key"]) if "x-key" in h else None, h.get("warc-target-uri"), unquote(h["x-refers-to-key"]) if "x-refers-to-key" in h else None, claimed)
        if "warc-segment-number" in h:
            total = int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None
            return (h.get("warc-segment-origin-id", h.get("warc-record-id")), int(h["warc-segment-number"]), total, *about, block, None, None, None)
        if about[0] == "revisit":
            return (None, None, None, *about, None, None, None, None)
        return (None, None, None, *about, *finish(block, claimed, None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("content"):
                rows, size = [], 0
                for h, block in (r for m in members(x.as_py()) for r in parse(m)):
                    rows.append(parsed(h, block))
                    size += len(block)
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows))})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        first = next((r for r in pdf.itertuples() if r.number == 1), next(pdf.itertuples()))
        try:
            block, error = assemble(pdf["number"].astype(int).tolist(), [None if pd.isna(x) else int(x) for x in pdf["total"]], pdf["payload"].tolist()), None
        except ValueError as e:
            block, error = None, str(e)
        return pd.DataFrame([(first.kind, first.key, first.uri, first.refers_key, first.sha, *finish(block, first.sha, error))], columns=names[3:])

    records = staged(archives(spark, folder).mapInArrow(run, schema), "records")
    whole = records.filter("number is null").drop("origin", "number", "total")
    segments = staged(records.filter("number is not null").groupBy("origin").applyInPandas(joined, done), "segments", records.count())
    responses = whole.filter("kind <> 'revisit'").unionByName(segments)
    target = responses.groupBy(F.col("payload_digest").alias("sha")).agg(F.first("payload_bytes").alias("n")).filter("sha is not null")
    revisits = whole.filter("kind = 'revisit'").select("kind", "key", "uri", "refers_key", "sha")
    revisits = spread_join(revisits, target, "sha", common_values(revisits.groupBy("sha").agg(F.count("*").alias("n")), "sha"))
    missing = F.col("n").isNull()
    revisits = revisits.select("kind", "key", "uri", "refers_key", "sha", F.lit(None).cast("binary").alias("payload"), F.col("n").alias("payload_bytes"), F.when(~missing, F.col("sha")).alias("payload_digest"), F.when(missing, F.lit("no such response")).alias("error"))
    return responses.unionByName(revisits).select("key", "uri", F.col("kind").alias("record_type"), F.col("refers_key").alias("refers_to"), "payload", "payload_bytes", "payload_digest", "error")


def round_trip(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", least_bytes: int = 0, payloads: bool = True, **limits: int) -> DataFrame:
    """What reading gives of the pages just written to a scratch folder, which is deleted again."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    write(pages, folder, key, uri, payload, least_bytes, **limits)
    got = read(spark, folder, payloads)
    delete(spark, folder)
    return got


def oracle(pages: str = "pages", key: str = "page_id", payload: str = "html") -> str:
    """SQL (DuckDB) for the columns of op2: lengths, digests in base32, and which page of equal payloads is the response."""
    base32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + (i // 4)::BIGINT * 5, 5))::INT >> (15 - 5 * (i % 4)::INT)) & 31), 1)), '')"
    return f"WITH p AS (SELECT {key}, octet_length(encode(coalesce({payload}, ''))) n, sha1(coalesce({payload}, '')) h FROM {pages}), f AS (SELECT *, max({key}) OVER (PARTITION BY h) top FROM p) SELECT {key}, n::BIGINT payload_bytes, {base32} payload_digest, CASE WHEN {key} IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END record_type, CASE WHEN {key} IS DISTINCT FROM top THEN top END refers_to, NULL::VARCHAR error FROM f"
