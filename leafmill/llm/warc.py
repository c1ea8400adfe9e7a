"""WARC archives with a two-level capture index.

Each input partition writes one archive of gzip members to the shared folder: a
response record per page, or a revisit record where another page holds the same
payload.  Record ids and dates follow from content, files are renamed into place, so a
retried task writes the same bytes again.  The captures are sorted by reversed-host
url key into blocks of BLOCK lines, each compressed by itself; beside every index file
lies a sparse directory with the first key and the byte range of each block.
A lookup bisects the directory, reads one range of the index, bisects the block's lines, and reads one range of the
archive.  The query looks up every capture this way.

Archives and index are reached through Arrow's file systems, so the folder may
be any store that Arrow opens by URI.  Null html is an empty payload; null or
odd urls get an escaped key and are archived like others.  Of equal payloads of
at least REVISIT bytes the row with the largest page_id (null lowest, then the
last row) is the response.
"""

from __future__ import annotations

import base64
import bisect
import functools
import gzip
import hashlib
import json
import uuid
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import cut, lookup_join, shared_dir, small_batches, table, with_row_id

#: Payloads from so many bytes on may be revisits; captures of an index block.
REVISIT, BLOCK = 1000, 256
#: Rows of an input partition whose captures of one key are looked up together; archived bytes that a task reads back.
SPAN, TASK = 4096, 32 << 20
DATE = "2020-01-01T00:00:00Z"


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def surt(url: str | None) -> str:
    """Reversed-host key of a url: labels reversed, then the rest as it is (escaped to one word)."""
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        scheme, rest = "", url or ""
    cut_at = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut_at].lower(), rest[cut_at:]
    return quote(",".join(reversed(host.split("."))) + ")" + path, safe="/?#&=,)(:;@!$*+~'%-._")


def record(row: dict) -> bytes:
    """One WARC record: ``row`` has html, url, page_id, type, refers_to, digest, key."""
    body = row["payload"]
    sha = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + (body if row["type"] == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['type']}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, row['name'])}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(row['url'], safe=_URI)}"] if row["url"] is not None else []),
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Page-ID: {json.dumps(row['page_id'])}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {json.dumps(row['refers_to'])}"] if row["type"] == "revisit" else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URI = "/?#&=,)(:;@!$*+~'%-._[]"


def parse(raw: bytes) -> dict:
    """Headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["length"] = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    return fields | {"payload": payload}


def _put(store, path: str, data) -> None:
    """Write under a name of this attempt, then move into place."""
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        data(f)
    store.move(own, path)


def write(pages: DataFrame, root: str) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) under ``root``; returns the captures (key, file, at, size), cut."""
    small_batches(pages.sparkSession)
    rows = with_row_id(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")), "_row")
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).withColumn("size", F.octet_length("html"))
    copies = rows.where(F.col("size") >= REVISIT).groupBy("digest", "size").agg(F.max(F.struct(F.col("page_id").isNotNull().alias("a"), "page_id", "_row")).alias("first"), F.count("*").alias("n"))
    copies = cut(copies.where("n > 1").select("digest", "size", F.col("first.page_id").alias("refers_to"), F.col("first._row").alias("_first")))
    rows = lookup_join(rows, copies, ["digest", "size"])
    rows = rows.withColumn("type", F.when(F.col("_first") != F.col("_row"), "revisit").otherwise("response"))

    def archive(frames):
        store, folder = _open(root)
        name = f"captures-{TaskContext.get().partitionId():06d}.warc.gz"
        made = []

        def fill(f):
            at = 0
            for frame in frames:
                for r in frame.to_dict("records"):
                    page, first = (None if pd.isna(r[c]) else int(r[c]) for c in ("page_id", "refers_to"))
                    raw = record({"payload": r["html"].encode(), "url": r["url"], "page_id": page, "refers_to": first, "digest": r["digest"], "type": r["type"], "name": f"{r['_row']}:{r['digest']}"})
                    data = gzip.compress(raw, 6, mtime=0)
                    f.write(data)
                    made.append((surt(r["url"]), int(r["_row"]), name, at, len(data)))
                    at += len(data)

        _put(store, f"{folder}/{name}", fill)
        for i in range(0, len(made), 10_000):
            yield pd.DataFrame(made[i : i + 10_000], columns=["key", "_row", "file", "at", "size"])

    return cut(rows.select("_row", "page_id", "url", "html", "digest", "type", "refers_to").mapInPandas(archive, "key string, _row long, file string, at long, size long"))


def index(captures: DataFrame, root: str) -> list[tuple[str, str]]:
    """Write the captures' sorted index; returns (first key, file) of each index file, in key order."""

    def blocks(frames):
        store, folder = _open(root)
        name = f"index-{TaskContext.get().partitionId():06d}.gz"
        directory, held = [], []

        def fill(f):
            at = 0

            def flush():
                nonlocal at
                data = gzip.compress("".join(held).encode(), 6, mtime=0)
                directory.append([" ".join(held[0].split(" ", 2)[:2]), at, len(data)])
                f.write(data)
                at += len(data)
                held.clear()

            for frame in frames:
                for r in frame.itertuples(index=False):
                    held.append(f"{r.key} {r.row:020d} {r.file} {r.at} {r.size}\n")
                    if len(held) == BLOCK:
                        flush()
            if held:
                flush()

        _put(store, f"{folder}/{name}", fill)
        if directory:
            _put(store, f"{folder}/{name}.directory", lambda f: f.write(json.dumps(directory).encode()))
            yield pd.DataFrame({"first": [directory[0][0].split(" ")[0]], "file": [name]})

    ordered = captures.repartitionByRange("key", "_row").sortWithinPartitions("key", "_row").withColumnRenamed("_row", "row")
    # a row for each index file, of which there are as many as partitions
    return sorted((r["first"], r["file"]) for r in cut(ordered.select("key", "row", "file", "at", "size").mapInPandas(blocks, "first string, file string")).collect())


class Reader:
    """Lookups in an archive folder; keeps one directory, one block and the open archives of a task."""

    def __init__(self, root: str, files: list[tuple[str, str]]):
        self.store, self.folder = _open(root)
        self.files, self.starts = files, [k for k, _ in files]
        self.directory = functools.lru_cache(4)(self._directory)
        self.block = functools.lru_cache(4)(self._block)
        self.archive = functools.lru_cache(16)(lambda f: self.store.open_input_file(f"{self.folder}/{f}"))

    def _directory(self, file: str):
        with self.store.open_input_stream(f"{self.folder}/{file}.directory") as f:
            return json.loads(f.read())

    def _block(self, file: str, at: int, size: int) -> list[str]:
        with self.store.open_input_file(f"{self.folder}/{file}") as f:
            f.seek(at)
            return gzip.decompress(f.read(size)).decode().splitlines()

    def captures(self, key: str, low: int, high: int):
        """(row, archive file, at, size) of each capture of a key with a row from ``low`` up to ``high``."""
        mark = key + " "
        begin = f"{mark}{low:020d}"
        i = max(bisect.bisect_left(self.starts, key) - 1, 0)  # its first captures may end the file before
        while i < len(self.files) and self.starts[i] <= key:
            directory = self.directory(self.files[i][1])
            b = max(bisect.bisect_right(directory, begin, key=lambda x: x[0]) - 1, 0)
            while b < len(directory) and directory[b][0] < f"{mark}{high:020d}":
                lines = self.block(self.files[i][1], directory[b][1], directory[b][2])
                for line in lines[bisect.bisect_left(lines, begin) :]:
                    _, row, file, at, size = line.split(" ")
                    if not line.startswith(mark) or int(row) >= high:
                        break
                    yield int(row), file, int(at), int(size)
                b += 1
            i += 1

    def record(self, file: str, at: int, size: int) -> dict:
        f = self.archive(file)
        f.seek(at)
        return parse(gzip.decompress(f.read(size)))


def lookups(captures: DataFrame) -> DataFrame:
    """(key, low, high): what to look up to read all captures; a key with many captures is several ranges of rows."""
    part = F.floor(F.col("_row") / SPAN)
    return captures.select("key", (part * SPAN).alias("low"), ((part + 1) * SPAN).alias("high")).distinct()


def lookup(keys: DataFrame, root: str, files: list[tuple[str, str]], tasks: int | None = None) -> DataFrame:
    """Records of every capture of ``keys`` (key; low and high, if only captures of rows in this range): page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    Keys are looked up once each and in order, so that a task reads each block about
    once; they are dealt to ``tasks`` ranges, for the work lies in the records, not in the keys.
    """
    if "low" not in keys.columns:
        keys = keys.withColumns({"low": F.lit(0).cast("long"), "high": F.lit((1 << 63) - 1)})

    def read(frames):
        reader = Reader(root, files)
        for frame in frames:
            out, held = [], 0
            for key, low, high in zip(frame["key"], frame["low"], frame["high"], strict=True):
                for _, file, at, size in reader.captures(key, low, high):
                    r = reader.record(file, at, size)
                    revisit = r["WARC-Type"] == "revisit"
                    digest = base64.b32decode(r["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if not revisit and hashlib.sha1(r["payload"]).hexdigest() != digest:
                        raise ValueError(f"{file} at {at}: the payload does not match its digest")
                    out.append((json.loads(r["WARC-Page-ID"]), r["length"], digest, r["WARC-Type"], json.loads(r.get("WARC-Refers-To-Page-ID", "null")), r["payload"]))
                    held += size
                    if held > 1 << 22:
                        yield _frame(out)
                        out, held = [], 0
            if out:
                yield _frame(out)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    order = ("key", "low")
    ranged = keys.repartitionByRange(tasks, *order) if tasks else keys.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order).select("key", "low", "high").mapInPandas(read, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    store, folder = _open(root) if "://" in root else _open("file://" + root)
    store.create_dir(folder, recursive=True)
    root = root if "://" in root else "file://" + root
    captures = write(table(spark, sf_dir, "pages"), root)
    files = index(captures, root)
    size = captures.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, size // TASK)
    out = lookup(lookups(captures), root, files, tasks).drop("payload")
    return cut(out)


QUERIES = {"op5_warc": op5_warc}
ORACLES = {
    "op5_warc": f"""
    with p as (select row_number() over () as i, page_id, coalesce(html, '') as html from pages),
    d as (select *, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as payload_digest from p),
    r as (select *, first_value(i) over w as first, first_value(page_id) over w as first_page, count(*) over (partition by payload_digest, payload_bytes) as n
      from d window w as (partition by payload_digest, payload_bytes order by page_id desc nulls last, i desc))
    select page_id, payload_bytes, payload_digest,
      case when payload_bytes >= {REVISIT} and first <> i then 'revisit' else 'response' end as record_type,
      case when payload_bytes >= {REVISIT} and first <> i then first_page end as refers_to
    from r
    """
}
