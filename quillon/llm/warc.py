"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

A reader that looks for record starts in parallel cannot trust the magic bytes: payloads may hold them, even whole
records. Tasks therefore only propose candidates, each with the offset its own header says its successor has; pointer
jumping from the start of each file then marks the candidates that the chain reaches, and those alone are records.
"""

from __future__ import annotations

import hashlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.storage import filesystem, put, scratch, written
from quillon.llm.textkit import narrow_batches

MAGIC = b"WARC/1.1\r\n"
HEAD_LIMIT = 1 << 24  # a longer header is not written, and not looked for
NEAR = 1 << 16  # bytes read beyond a block for the header at its end; a longer header is read by itself
#: Fixed value of the format: why a record revisits another.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: str, page: int | None, url: str | None, digest: str, size: int, refers: int | None, payload: bytes, date: str) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size))]
    if refers is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Profile", REVISIT)]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    head = MAGIC + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    if len(head) > HEAD_LIMIT:
        raise ValueError(f"the header of page {page} has more than {HEAD_LIMIT} bytes")
    return head + payload + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100, roll: int = 1 << 26, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of pages under folder and return (file, size), the archives that were completed.

    Of rows with equal payloads of at least `least` bytes the smallest key has a response record with the payload, the
    others are revisits that refer to it; rows that share the smallest key are all responses, and a null key never is
    the smallest. A null payload is empty. Payloads never enter a shuffle unless the table of repeated digests is too
    large to broadcast. Archives end at about `roll` bytes; their names are those of one task attempt, and only what the
    returned manifest names counts, so repeated tasks do no harm.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    sized = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    repeated = sized.where(F.col("size") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = written(repeated, "warc-repeated")
    named = sized.join(repeated, "digest", "left")
    refers = F.when((F.col("size") >= least) & F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    named = named.select("key", "url", "html", "digest", "size", refers.alias("refers"))

    def run(batches):
        task = TaskContext.get()
        mark, number, held, size = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0, [], 0
        done = []

        def close():
            nonlocal number, held, size
            name = f"{folder}/{mark}-{number:04d}.warc"
            done.append((name, put(name, held)))
            number, held, size = number + 1, [], 0

        for batch in batches:
            for k, u, text, digest, n, r in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(_record("response" if r is None else "revisit", k, u, digest, n, r, text.encode() if r is None else b"", date))
                size += len(held[-1])
                if size >= roll:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], names=["file", "size"])

    return written(narrow_batches(named).mapInArrow(run, "file string, size bigint"), "warc-manifest")


def parse_head(head: bytes) -> tuple[dict[str, str], int] | None:
    """(fields in lower case, length with the blank line) of the header that head starts with, or None if it has none."""
    end = head.find(b"\r\n\r\n")
    if not head.startswith(MAGIC) or end < 0 or end + 4 > HEAD_LIMIT:
        return None
    try:
        lines = head[len(MAGIC) : end].decode("utf-8").split("\r\n")
    except UnicodeDecodeError:
        return None
    fields = dict((k.strip().lower(), v.strip()) for k, found, v in (x.partition(":") for x in lines) if found)
    return (fields, end + 4) if fields.get("content-length", "").isdecimal() and "warc-type" in fields else None


def _read(opened: dict, uri: str, at: int, n: int) -> bytes:
    if opened.get("uri") != uri:
        if "file" in opened:
            opened["file"].close()
        files, path = filesystem(uri)
        opened |= {"uri": uri, "file": files.open_input_file(path)}
    return opened["file"].read_at(n, at)


def _tasks(manifest: DataFrame, bytes_each: int = 1 << 24) -> int:
    """A task for each 16 MB of archives: rows that only point at bytes look too small to Spark to be spread."""
    return max(1, -(-(manifest.agg(F.sum("size")).first()[0] or 0) // bytes_each))


def candidates(manifest: DataFrame, block: int = 1 << 22) -> DataFrame:
    """(file, start, next) of every place that looks like a record's start; next is where its header says it ends.

    A task reads one block of a file (and a header's length beyond), so files of any size are split.
    """
    blocks = manifest.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("at"))

    def run(batches):
        opened: dict = {}
        for batch in batches:
            for uri, size, at in zip(*(c.to_pylist() for c in batch.columns)):
                data = _read(opened, uri, at, min(block + NEAR, size - at))
                starts, nexts, k = [], [], data.find(MAGIC)
                while 0 <= k < block:
                    end = data.find(b"\r\n\r\n", k)
                    if end < 0 and at + len(data) < size:
                        head = parse_head(_read(opened, uri, at + k, min(HEAD_LIMIT, size - at - k)))
                    else:
                        head = parse_head(data[k : end + 4])
                    if head:
                        starts.append(at + k)
                        nexts.append(at + k + head[1] + int(head[0]["content-length"]) + 4)
                    k = data.find(MAGIC, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(nexts, pa.int64())], names=["file", "start", "next"])

    return blocks.repartition(_tasks(manifest), "file", "at").mapInArrow(run, "file string, start bigint, next bigint")


def reachable(start: np.ndarray, following: np.ndarray, size: int) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches, by pointer jumping; an error unless it ends at the file's end."""
    if not len(start):
        raise ValueError("a file has no record")
    order = np.argsort(start, kind="stable")
    n, start, following = len(start), start[order], following[order]
    jump = np.searchsorted(start, following)
    jump[(jump == n) | (start[np.minimum(jump, n - 1)] != following)] = n
    jump, reach = np.append(jump, n), np.zeros(n + 1, bool)
    reach[0] = n > 0 and start[0] == 0
    own = jump.copy()
    for _ in range(max(1, n.bit_length())):
        reach[jump[np.flatnonzero(reach)]] = True
        jump = jump[jump]
    reach = reach[:n]
    ends = following[reach & (own[:n] == n)]
    if not reach.any() or ends.tolist() != [size]:
        raise ValueError(f"the chain of records ends at {ends.tolist()} and not at {size}")
    out = np.zeros(n, bool)
    out[order] = reach
    return out


def record_bounds(manifest: DataFrame) -> DataFrame:
    """(file, start, next) of the true records. A file's candidates, 16 bytes each, meet in one task."""

    def chain(table: pa.Table) -> pa.Table:
        start, size = np.asarray(table["start"]), int(np.asarray(table["size"]).max())
        own = table.filter(pa.array(start >= 0))
        keep = reachable(np.asarray(own["start"]), np.asarray(own["next"]), size)
        return own.filter(pa.array(keep)).select(["file", "start", "next"])

    none = F.lit(-1).cast("long")
    rows = candidates(manifest).withColumn("size", none).unionByName(manifest.where("size > 0").select("file", none.alias("start"), none.alias("next"), "size"))
    return rows.groupBy("file").applyInArrow(chain, "file string, start bigint, next bigint")


RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def read_archives(manifest: DataFrame, payload: bool = True, block: int = 1 << 22) -> DataFrame:
    """The records of the archives (file, size): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Lengths and digests are of the full payload: computed from a response's bytes (and compared with its header, a
    difference is an error), taken from a revisit's header. payload is null for revisits, or if not asked for. A broken
    chain is an error. No archive, no rows.
    """
    bounds = written(record_bounds(manifest), "warc-bounds")
    tasks = bounds.withColumn("block", F.floor(F.col("start") / block)).repartition(_tasks(manifest), "file", "block").sortWithinPartitions("file", "start").select("file", "start", "next")
    number = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None

    def run(batches):
        opened: dict = {}
        for batch in batches:
            out = []
            for uri, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                data = _read(opened, uri, start, stop - start)
                fields, size = parse_head(data[: data.find(b"\r\n\r\n") + 4])
                body = data[size : size + int(fields["content-length"])]
                digest, length = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
                if fields["warc-type"] == "response":
                    if hashlib.sha256(body).hexdigest() != digest or len(body) != length:
                        raise ValueError(f"payload and header differ at {start} of {uri}")
                    digest, length = hashlib.sha256(body).hexdigest(), len(body)
                out.append((number(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], number(fields.get("warc-refers-to")), length, digest, body if payload and fields["warc-type"] == "response" else None))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in RECORD.split(", ")])

    return narrow_batches(tasks).mapInArrow(run, RECORD)


def digests(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from written archives."""
    manifest = write_archives(pages, scratch(pages.sparkSession, "warc"))
    return read_archives(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
