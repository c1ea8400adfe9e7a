"""Archive members as a Spark data source, and archives as a sink.

``spark.read.format("archive_members").option("path", folder)`` gives one partition per
container: members in archive order with their payloads where they are wanted.
The safety budget runs inside the reader, so a refused container stops
where it is refused and never expands further; its row carries the reason.
zip and tar (plain, gz, bz2, xz) are read; 7z and RAR are recognised and named
as unavailable here.
"""

from __future__ import annotations

import contextlib
import io
import os
import tarfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leafmill.operators.safety import MAX_FILE, MAX_MEMBERS, MAX_RATIO, MAX_TOTAL, RATIO_FLOOR

# First bytes of each family, as hex.
SIGNATURES = {"504B0304": "zip", "504B0506": "zip", "377ABCAF271C": "7z", "526172211A07": "rar", "1F8B": "tar", "425A68": "tar", "FD377A585A00": "tar"}
COMPRESSION = {"1F8B": "gz", "425A68": "bz2", "FD377A585A00": "xz"}


def archive_family(content: Column) -> Column:
    """Family of a container by its first bytes; tar has its mark at offset 257. Null for anything else."""
    head = F.hex(F.substring(content, 1, 512))
    out = F.when(F.substring(head, 515, 10) == "7573746172", "tar")
    for mark, name in reversed(SIGNATURES.items()):
        out = F.when(head.startswith(mark), name).otherwise(out)
    return out


def tar_compression(content: Column) -> Column:
    head, out = F.hex(F.substring(content, 1, 8)), F.lit("")
    for mark, name in COMPRESSION.items():
        out = F.when(head.startswith(mark), name).otherwise(out)
    return out


def rar_generation(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == "526172211A070100", 5).when(head.startswith("526172211A0700"), 4)


def is_pdf(content: Column) -> Column:
    return F.contains(F.hex(F.substring(content, 1, 1024)), F.lit("255044462D"))


def container_family(content: Column) -> Column:
    """An archive's signature goes before a PDF's: a zip that holds one is a zip."""
    return F.coalesce(archive_family(content), F.when(is_pdf(content), "pdf"))


class Refused(Exception):
    pass


class Budget:
    """What one container may still expand to; raises Refused with the rule's name."""

    def __init__(self, members=MAX_MEMBERS, file=MAX_FILE, total=MAX_TOTAL, ratio=MAX_RATIO):
        self.limits, self.members, self.total = (members, file, total, ratio), 0, 0

    def admit(self, name: str, link: bool) -> None:
        self.members += 1
        path = name.replace("\\", "/")
        checks = (("member-count", self.members > self.limits[0]), ("link-entry", link), ("absolute-path", path.startswith("/")), ("drive-letter", path[1:2] == ":"), ("parent-traversal", ".." in path.split("/")))
        for reason, bad in checks:
            if bad:
                raise Refused(reason)

    def read(self, stream, compressed: int) -> bytes:
        """The whole payload by chunks, counted as they come."""
        parts, size = [], 0
        while chunk := stream.read(1 << 16):
            size, self.total = size + len(chunk), self.total + len(chunk)
            if size > self.limits[1]:
                raise Refused("file-size-cap")
            if self.total > self.limits[2]:
                raise Refused("total-size-cap")
            if compressed > 0 and size >= RATIO_FLOOR and size / compressed > self.limits[3]:
                raise Refused("ratio-cap")
            parts.append(chunk)
        return b"".join(parts)


def _zip_members(path: str, budget: Budget, payloads: bool):
    with zipfile.ZipFile(path) as z:
        infos = z.infolist()
        for i in infos:
            budget.admit(i.filename, (i.external_attr >> 16) & 0o170000 == 0o120000)
        for n, i in enumerate(infos):
            content = None
            if payloads and not i.is_dir():
                with z.open(i) as f:
                    content = budget.read(f, i.compress_size)
            yield n, i.filename, i.is_dir(), False, i.compress_size, content


def _tar_members(path: str, budget: Budget, payloads: bool, whole: bool):
    """A compressed tar is one forward pass in which members are admitted and read; a plain one is listed first."""
    with tarfile.open(path, "r|*" if whole else "r:") as t:
        if not whole:
            for m in t:
                budget.admit(m.name, not (m.isfile() or m.isdir()))
        for n, m in enumerate(t):
            if whole:
                budget.admit(m.name, not (m.isfile() or m.isdir()))
            content = budget.read(t.extractfile(m), 0) if payloads and m.isfile() else None
            yield n, m.name, m.isdir(), not (m.isfile() or m.isdir()), 0, content


def _family(path: str) -> str:
    with open(path, "rb") as f:
        head = f.read(512)
    for mark, name in SIGNATURES.items():
        if head.startswith(bytes.fromhex(mark)):
            return name if mark not in COMPRESSION else "tar+"
    return "tar" if head[257:262] == b"ustar" else ""


class _Path(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.payloads = options.get("payloads", "true") == "true"
        self.caps = {k: float("inf") if options[k] == "none" else int(options[k]) for k in ("members", "file", "total", "ratio") if k in options}

    def partitions(self):
        return [_Path(os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder)) if not f.startswith(".") and not f.endswith(".tmp")]

    def read(self, partition):
        item, budget, family = os.path.basename(partition.path), Budget(**self.caps), _family(partition.path)
        if family not in ("zip", "tar", "tar+"):
            reason = f"{family} reader unavailable" if family else "unrecognised archive signature"
            yield item, None, None, None, None, None, None, reason
            return
        rows = _zip_members(partition.path, budget, self.payloads) if family == "zip" else _tar_members(partition.path, budget, self.payloads, family == "tar+")
        try:
            for row in rows:
                yield item, *row, None
        except Refused as e:
            yield item, None, None, None, None, None, None, str(e)


class ArchiveMembers(DataSource):
    @classmethod
    def name(cls):
        return "archive_members"

    def schema(self):
        return "item string, position int, member string, is_dir boolean, is_link boolean, compressed long, content binary, refused string"

    def reader(self, schema):
        return _Reader(self.options)


def read_members(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Members of a folder's containers; a cap (members, file, total, ratio) that is "none" isn't held, for archives of our own."""
    spark.dataSource.register(ArchiveMembers)
    reader = spark.read.format("archive_members").option("path", folder)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load()


class _Zip:
    def __init__(self, path: str):
        self.file = zipfile.ZipFile(path, "w")

    def add(self, name: str, content: bytes) -> None:
        self.file.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)


class _Tar:
    def __init__(self, path: str, mode: str):
        self.file = tarfile.open(path, mode)  # noqa: SIM115

    def add(self, name: str, content: bytes) -> None:
        info = tarfile.TarInfo(name)
        info.size = len(content)
        self.file.addfile(info, io.BytesIO(content))


#: Writers by kind; stamps are fixed, so that equal entries give equal archives.
WRITERS = {"zip": _Zip, "tar": lambda path: _Tar(path, "w"), "tar.gz": lambda path: _Tar(path, "w:gz"), "tar.bz2": lambda path: _Tar(path, "w:bz2"), "tar.xz": lambda path: _Tar(path, "w:xz")}


def write_archives(entries: DataFrame, folder: str, kind: str = "zip") -> DataFrame:
    """Write ``entries`` (item, place, name, content) as one archive per item, entries by place; returns (item, path, entries).

    An entry named ComicInfo.xml comes first, whatever its place.  Files are renamed
    into place, and an item's rows pass through its task one after the other.
    """
    new = WRITERS[kind]

    def write(frames):
        import pandas as pd

        made, now, archive, own = {}, None, None, None

        def close():
            if archive:
                archive.file.close()
                os.replace(own, os.path.join(folder, now))

        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.item != now:
                    close()
                    now, own = r.item, os.path.join(folder, f".{r.item}.{uuid.uuid4().hex}.tmp")
                    archive = new(own)
                    made[now] = 0
                archive.add(r.name, bytes(r.content))
                made[now] += 1
        close()
        yield pd.DataFrame({"item": list(made), "path": [os.path.join(folder, i) for i in made], "entries": list(made.values())})

    with contextlib.suppress(FileExistsError):
        os.makedirs(folder)
    first = F.col("name") != "ComicInfo.xml"
    ordered = entries.withColumn("place", F.struct(first.alias("late"), F.col("place").alias("at"))).repartition("item").sortWithinPartitions("item", "place")
    return ordered.select("item", "name", "content").mapInPandas(write, "item string, path string, entries long")


def write_json_records(records: DataFrame, path: str) -> None:
    """One JSON object per record with sorted keys, by Spark's file commit: readers see all of it or nothing."""
    fields = sorted(records.columns)
    records.select(F.to_json(F.struct(*fields)).alias("value")).write.mode("overwrite").text(path)
