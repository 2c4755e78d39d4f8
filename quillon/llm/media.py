"""Media columns: payloads as gray PNG members of TAR archives, read back by a Spark data source.

The source lists an archive directory on the driver, plans byte-range partitions over the archives by their sizes
alone, and finds in each range the members that begin there by the archive's index beside it (or, without one, by
hopping from header to header). Payloads go to Spark as Arrow batches of bounded size. A member that can't be read is
tried again on its own, from its offset and with a newly opened file; a member that stays bad fails the task.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import time
import urllib.parse
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ._shared import released, scratch_path, texts

BLOCK, UNIT, LEVEL = 512, 576, 6
_PNG = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """`data` with bytes 255 up to a positive multiple of `unit`."""
    return data + b"\xff" * (-len(data) % unit or unit * (not data))


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(payload: bytes, width: int = UNIT) -> bytes:
    """An 8-bit gray image of `width` samples a line that holds `payload` losslessly."""
    lines = np.zeros((len(payload) // width, width + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, width)
    return _PNG + _part(b"IHDR", struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)) + _part(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _part(b"IEND", b"")


def samples(image: bytes) -> np.ndarray:
    """The samples of an image that png() wrote, line by line."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, width = 8, [], 0
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError(f"PNG part {kind!r} is damaged")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    return lines[:, 1:].reshape(-1)


def features(payload: np.ndarray) -> str:
    """Mean, deviation, entropy in bits and a 16-bin histogram (hex, per 255) of 8-bit samples."""
    counts = np.bincount(payload, minlength=256)
    p = counts / len(payload)
    mean = float(p @ np.arange(256))
    deviation = float(p @ (np.arange(256) - mean) ** 2) ** 0.5
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    bins = (p.reshape(16, 16).sum(axis=1) * 255).astype(np.uint8).tobytes().hex()
    return f"mean={mean:.4f};dev={deviation:.4f};bits={entropy:.4f};hist={bins}"


def write_archives(docs: DataFrame, directory: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """One TAR archive and index per task under `directory`; the member's name is the id. Returns the members written.

    A task writes under a name of its own and renames at the end, so a repeated task leaves one whole archive.
    """
    rows = texts(docs, id_col, text_col)

    def run(batches):
        store, root = pafs.FileSystem.from_uri(directory)
        store.create_dir(root, recursive=True)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        temp, at, index = f"{root}/.{attempt}", 0, []
        with store.open_output_stream(temp) as out:
            for batch in batches:
                for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    image = png(padded(text.encode()))
                    info = tarfile.TarInfo("null" if doc is None else urllib.parse.quote(f"={doc}", safe="=") + ".png")
                    info.size = len(image)
                    head = info.tobuf(tarfile.GNU_FORMAT)
                    out.write(head + image + b"\0" * (-len(image) % BLOCK))
                    index.append((at, at + len(head), len(image)))
                    at += len(head) + len(image) + -len(image) % BLOCK
            out.write(b"\0" * 2 * BLOCK)
        if index:
            with store.open_output_stream(f"{temp}.i") as out:
                out.write(np.array(index, "<i8").tobytes())
            for a, b in ((f"{temp}.i", f"{root}/part-{task:06d}.idx"), (temp, f"{root}/part-{task:06d}.tar")):
                if store.get_file_info(b).type != pafs.FileType.NotFound:
                    store.delete_file(b)
                store.move(a, b)
        else:
            store.delete_file(temp)
        yield pa.RecordBatch.from_arrays([pa.array([len(index)], pa.int64())], ["n"])

    return rows.mapInArrow(released(run), "n long").agg(F.sum("n")).first()[0] or 0


class ByteRange(InputPartition):
    """The members of an archive that begin at a byte from `lo` to before `hi`."""

    def __init__(self, path: str, lo: int, hi: int):
        super().__init__((path, lo, hi))
        self.path, self.lo, self.hi = path, lo, hi


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.directory = options["path"]
        self.split = int(options.get("splitbytes", 16 << 20))
        self.batch = int(options.get("batchbytes", 4 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self):
        store, root = pafs.FileSystem.from_uri(self.directory)
        found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
        archives = sorted((f.path, f.size) for f in found if f.path.endswith(".tar"))
        return [ByteRange(p, lo, min(lo + self.split, n)) for p, n in archives for lo in range(0, n, self.split)] or [ByteRange("", 0, 0)]

    def members(self, store, part: ByteRange):
        """(header's offset, data's offset, size) of the members that begin in the range."""
        index = part.path.removesuffix(".tar") + ".idx"
        if store.get_file_info(index).type == pafs.FileType.File:
            with store.open_input_stream(index) as f:
                rows = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
            lo, hi = np.searchsorted(rows[:, 0], (part.lo, part.hi))
            yield from rows[lo:hi].tolist()
            return
        with store.open_input_file(part.path) as f:
            at = begun = 0
            while at < part.hi:
                head = f.read_at(BLOCK, at)
                if len(head) < BLOCK or not head.strip(b"\0"):
                    return
                info = tarfile.TarInfo.frombuf(head, "utf-8", "strict")
                if info.type not in (tarfile.GNUTYPE_LONGNAME, tarfile.GNUTYPE_LONGLINK):
                    if begun >= part.lo:
                        yield begun, at + BLOCK, info.size
                at += BLOCK + info.size + -info.size % BLOCK
                if info.type not in (tarfile.GNUTYPE_LONGNAME, tarfile.GNUTYPE_LONGLINK):
                    begun = at

    def member(self, store, file, path: str, begun: int, at: int, size: int):
        """Name and payload of one member; a failed read is repeated from the offset with the file opened anew."""
        for attempt in range(self.retries + 1):
            try:
                if attempt:
                    time.sleep(0.1 * 2**attempt)
                    file = store.open_input_file(path)
                data = file.read_at(at + size - begun, begun)
                if len(data) != at + size - begun:
                    raise OSError("cut short")
                head = data[: at - begun]
                info = tarfile.TarInfo.frombuf(head[-BLOCK:], "utf-8", "strict")
                name = head[BLOCK:-BLOCK].rstrip(b"\0").decode() if len(head) > BLOCK else info.name
                return name, data[at - begun :]
            except (OSError, tarfile.TarError) as e:
                if attempt == self.retries:
                    raise OSError(f"{path}: member at byte {begun}: {e}") from e
        raise AssertionError

    def read(self, part: ByteRange):
        if not part.path:
            return
        store, _ = pafs.FileSystem.from_uri(self.directory)
        names = ["archive", "member", "offset", "payload"]
        rows: list[tuple] = []
        held = 0
        with store.open_input_file(part.path) as file:
            for begun, at, size in self.members(store, part):
                name, data = self.member(store, file, part.path, begun, at, size)
                rows.append((part.path, name, begun, data))
                held += size
                if held >= self.batch:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names)


_KINDS = (pa.string(), pa.string(), pa.int64(), pa.binary())


class MediaArchives(DataSource):
    """spark.read.format("quillon_media").load(directory), after register(spark). Options: splitBytes, batchBytes, retries."""

    @classmethod
    def name(cls):
        return "quillon_media"

    def schema(self):
        return "archive string, member string, offset long, payload binary"

    def reader(self, schema):
        return MediaReader(self.options)


def read_archives(spark: SparkSession, directory: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("quillon_media").options(**options).load(directory)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str | None = None) -> DataFrame:
    """Stores each whole text as an image, reads it back and describes it.

    Returns id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. A null or
    empty text is stored as padding alone; null ids and repeated rows are kept; an empty table gives none; other
    columns are ignored. Equal texts give equal values. A very long text is one image, which one task holds.
    """
    spark = docs.sparkSession
    directory = directory or scratch_path(spark, "media")
    kind = docs.schema[id_col].dataType.simpleString()
    write_archives(docs, directory, id_col, text_col)

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for name, image in zip(batch.column("member").to_pylist(), batch.column("payload").to_pylist()):
                payload = samples(image)
                raw = payload.tobytes()
                own = (None if name == "null" else urllib.parse.unquote(name[1:].removesuffix(".png")), len(raw.rstrip(b"\xff")), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(image), hashlib.sha256(image).hexdigest(), features(payload))
                for column, value in zip(out, own):
                    column.append(value)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["id", *_COLUMNS])

    found = read_archives(spark, directory).select("member", "payload").mapInArrow(released(run), "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.select(F.col("id").cast(kind).alias(id_col), *_COLUMNS)


_COLUMNS = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
