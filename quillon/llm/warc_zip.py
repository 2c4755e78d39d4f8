"""WARC records in ZIP packages: written as stored members, found by the directories, read by byte ranges.

A package holds `archive/data.warc.gz` (one gzip member a record) and `indexes/index.cdxj` (a line a record, with
its offset and length), both stored, not deflated. The reader parses the end record, the ZIP64 end record and the
central directory from the package's tail, locates the members' bytes, cuts the index into runs of neighbouring
records and reads each run with one range read; nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import urllib.parse
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import released, scratch_path, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Up to so many revisits their ids and targets (about 50 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def member_range(file, size: int, name: str) -> tuple[int, int]:
    """(offset, length) of the stored member `name`; `file` is random-access with read_at(n, offset)."""
    tail_at = max(0, size - 65_557)
    tail = file.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("not a ZIP package")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":  # the ZIP64 end record's locator
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        end = file.read_at(56, where)
        if end[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end record where its locator points")
        entries, length, offset = struct.unpack_from("<QQQ", end, 32)
    directory, at = file.read_at(length, offset), 0
    for _ in range(entries):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("damaged central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, plain, n, extra, comment = struct.unpack_from("<IIHHH", directory, at + 20)
        begin, = struct.unpack_from("<I", directory, at + 42)
        own = directory[at + 46 : at + 46 + n].decode()
        if own == name:
            more, stop = at + 46 + n, at + 46 + n + extra
            while more + 4 <= stop:
                kind, k = struct.unpack_from("<HH", directory, more)
                if kind == 1:  # ZIP64: the values that don't fit, in this order
                    wide = list(struct.unpack_from(f"<{k // 8}Q", directory, more + 4))
                    plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    begin = wide.pop(0) if begin == 0xFFFFFFFF else begin
                more += 4 + k
            if method != zipfile.ZIP_STORED:
                raise ValueError(f"{name} isn't stored")
            local = file.read_at(30, begin)
            n, extra = struct.unpack_from("<HH", local, 26)
            return begin + 30 + n + extra, packed
        at += 46 + n + extra + comment
    raise KeyError(name)


def _record(kind: str, page: str, url: str, payload: bytes, refers_to: str | None) -> tuple[bytes, str]:
    """The record's bytes before compression, and its payload's digest."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    more = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if kind == "revisit" else []
    block += payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: {digest}", *more, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def _name(page) -> str:
    return "null" if page is None else urllib.parse.quote(f"={page}", safe="=")


def _page(urn: str | None) -> str | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return urllib.parse.unquote(name[1:]) if name.startswith("=") else None


def parse_record(data: bytes) -> dict:
    """Type, ids, url, digest and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else None
    if payload is not None and fields["warc-payload-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError("a payload doesn't match its digest")
    return {"type": fields["warc-type"], "page": _page(fields["warc-record-id"]), "refers_to": _page(fields.get("warc-refers-to")), "url": fields["warc-target-uri"], "digest": base64.b32decode(fields["warc-payload-digest"][5:]).hex(), "payload": payload}


def write_packages(pages: DataFrame, directory: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 1000) -> int:
    """Writes one record per row into a package per task under `directory`; returns the number of records.

    Of the rows with equal payloads of at least `revisit_bytes`, those with the largest id are responses and the
    others revisit it; rows with a null id are responses.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    large = rows.where(F.octet_length("payload") >= revisit_bytes).select("id", "digest")
    first = large.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = stored(first, "firsts")  # so that the join has a shuffle of its own, whose large partitions can be split
    revisits = stored(large.join(first, "digest").where("id <> refers_to").distinct(), "revisits")
    few = revisits.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(revisits) if few else revisits, ["id", "digest"], "left").select("id", "url", "payload", "refers_to")

    def run(batches):
        store, root = pafs.FileSystem.from_uri(directory)
        store.create_dir(root, recursive=True)
        task = TaskContext.get().partitionId()
        temp, index, at = f"{root}/.{uuid.uuid4().hex}", [], 0
        with store.open_output_stream(temp) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            with package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as f:
                for batch in batches:
                    for page, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to"))):
                        url = urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]")
                        kind = "response" if refers_to is None else "revisit"
                        data, digest = _record(kind, _name(page), url, payload, None if refers_to is None else _name(refers_to))
                        packed = gzip.compress(data, 6, mtime=0)
                        f.write(packed)
                        index.append(json.dumps({"url": url, "digest": digest, "offset": at, "length": len(packed)}))
                        at += len(packed)
            package.writestr(zipfile.ZipInfo(INDEX), "".join(f"{DATE} {x}\n" for x in index))
        final = f"{root}/part-{task:06d}.zip"
        if store.get_file_info(final).type != pafs.FileType.NotFound:
            store.delete_file(final)
        store.move(temp, final)
        yield pa.RecordBatch.from_arrays([pa.array([len(index)], pa.int64())], ["n"])

    return joined.mapInArrow(released(run), "n long").agg(F.sum("n")).first()[0] or 0


def read_packages(spark: SparkSession, directory: str, run_bytes: int = 2 << 20, payloads: bool = True) -> DataFrame:
    """All records: page, record_type, refers_to, url, payload_bytes and payload (null for revisits), payload_digest."""
    store, root = pafs.FileSystem.from_uri(directory)
    paths = [f.path for f in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".zip")]
    packages = spark.createDataFrame([(p,) for p in sorted(paths)], "path string").repartition(max(1, min(len(paths), 10_000)))

    def plan(batches):
        store, _ = pafs.FileSystem.from_uri(directory)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                runs: list[list[int]] = []
                with store.open_input_file(path) as file:
                    size = file.size()
                    begin, _ = member_range(file, size, DATA)
                    at, length = member_range(file, size, INDEX)
                    for line in file.read_at(length, at).splitlines():
                        entry = json.loads(line[line.index(b"{") :])
                        where, n = begin + entry["offset"], entry["length"]
                        if runs and runs[-1][0] + runs[-1][1] == where and runs[-1][1] + n <= run_bytes:
                            runs[-1][1] += n
                        else:
                            runs.append([where, n])
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(runs), pa.string()), *(pa.array(c, pa.int64()) for c in zip(*runs))] if runs else [pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64())], ["path", "at", "length"])

    def read(batches):
        store, _ = pafs.FileSystem.from_uri(directory)
        for batch in batches:
            for path, at, length in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "length"))):
                with store.open_input_file(path) as file:
                    data = file.read_at(length, at)
                rows = []
                while data:
                    unzip = zlib.decompressobj(31)
                    record = parse_record(unzip.decompress(data) + unzip.flush())
                    data = unzip.unused_data
                    body = record["payload"]
                    rows.append((record["page"], record["type"], record["refers_to"], record["url"], None if body is None else len(body), record["digest"], body if payloads else None))
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page", "record_type", "refers_to", "url", "payload_bytes", "payload_digest", "payload"])

    found = packages.mapInArrow(released(plan), "path string, at long, length long")
    found = found.repartition(max(spark.sparkContext.defaultParallelism, len(paths)))
    return found.mapInArrow(released(read), "page string, record_type string, refers_to string, url string, payload_bytes long, payload_digest string, payload binary")


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", directory: str | None = None) -> DataFrame:
    """Writes all pages into packages and reads them back: id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's size and digest are those of the response that it refers to. A null html is an empty payload; a null
    id is always a response; repeated rows give repeated records; an empty table gives none; other columns are ignored.
    A very long html is one record, which one task holds.
    """
    spark = pages.sparkSession
    directory = directory or scratch_path(spark, "warc")
    kind = pages.schema[id_col].dataType.simpleString()
    write_packages(pages, directory, id_col, url_col, html_col)
    records = stored(read_packages(spark, directory, payloads=False).drop("payload", "url"), "records")
    full = records.where("record_type = 'response' and page is not null").select(F.col("page").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").join(full, ["refers_to", "payload_digest"], "left")
    columns = [F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")]
    return records.where("record_type = 'response'").select(*columns).unionByName(revisits.select(*columns))
