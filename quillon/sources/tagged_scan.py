"""Large files of tagged text, read by as many tasks as Spark cuts them into.

Spark's own text source cuts a file at ends of lines. A task parses the records that are whole in its part; what stands
before the first sure boundary (the rest of a record that began before) and after the last one goes on as a fragment.
A record over several parts is the open fragment of one and the heads of those that follow, up to the next open one; there
are at most two fragments a part. A record's number is its place in its part and the records of the parts before.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import formats

PARSED = "source_file string, source_index int, source_kind string, source_format string, raw_block string, fields map<string, array<string>>, header string, warning string, error string"
_PIECES = "path string, start long, part string, nth int, lines string, raw_block string, fields map<string, array<string>>"
KINDS = frozenset({"wos_tagged", *formats.DIALECTS})
UTF16_MARKS = (b"\xff\xfe", b"\xfe\xff")


def _plain(path: str) -> str:
    """A path without its scheme, by which Spark's two ways of naming a file agree."""
    return unquote(path.partition(":")[2] if ":" in path.partition("/")[0] else path).lstrip("/")


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, start (of the part) and value (bytes of a line), in order within a part."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _parts(batches, key=("path", "start")) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """The parts of a task one after the other, each with an iterator over its lines."""
    rows = ((p, s, v) for b in batches for p, s, v in zip(b["path"], b["start"], b["value"]))
    ahead = next(rows, None)
    while ahead is not None:
        path, start = ahead[:2]

        def own(path=path, start=start):
            nonlocal ahead
            while ahead is not None and ahead[:2] == (path, start):
                value = ahead[2]
                ahead = next(rows, None)
                yield value

        lines = own()
        yield path, start, lines
        for _ in lines:  # what the caller has left
            pass


def tagged_files(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, str, str]]:
    """Of `paths` those that can be read in parts: path to (database, format, encoding), by the heads and by validity as UTF-8."""
    if not paths:
        return {}
    names = {_plain(p): p for p in paths}

    def heads(batches):
        for path, start, lines in _parts(batches):
            if start == 0:
                head, size = [], 0
                for line in lines:
                    head.append(bytes(line))
                    size += len(head[-1]) + 1
                    if size > 4 * formats.SAMPLE_CHARS:
                        break
                yield pd.DataFrame({"path": [path], "head": [b"\n".join(head)]})

    found = {}
    for r in _lines(spark, paths).mapInPandas(heads, "path string, head binary").collect():
        head = bytes(r.head)
        if head.startswith((*UTF16_MARKS, formats.OLE)):
            continue
        text = min((head.decode(e, "replace") for e in ("utf-8-sig", "gb18030", "cp1252")), key=lambda t: t.count("\ufffd"))
        try:
            source, kind = formats.detect(text)
        except formats.FormatError:
            continue
        if kind in KINDS:
            found[names[_plain(r.path)]] = (source, kind)
    if not found:
        return {}
    valid = {names[_plain(r.path)]: r.utf8 for r in _lines(spark, list(found)).groupBy("path").agg(F.min(F.expr("is_valid_utf8(cast(value as string))")).alias("utf8")).collect()}
    other = [p for p in found if not valid[p]]

    def chinese(batches):
        for path, _, lines in _parts(batches):
            yield pd.DataFrame({"path": [path], "fits": [all(_decodes(line, "gb18030") for line in lines)]})

    fits = {names[_plain(r.path)]: r.fits for r in _lines(spark, other).mapInPandas(chinese, "path string, fits boolean").groupBy("path").agg(F.min("fits").alias("fits")).collect()} if other else {}
    return {p: (*what, "utf-8" if valid[p] else "gb18030" if fits[p] else "cp1252") for p, what in found.items()}


def _decodes(line: bytes, encoding: str) -> bool:
    try:
        line.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _record(lines: list[str], source: str, kind: str, over: bool = True) -> tuple[formats.Raw, str] | None:
    """Fields and raw block of the record in a run of lines, if there is one; `over`: its end has been read."""
    if kind == "wos_tagged":
        _, block = formats.wos_run(lines)
        if block and not over:
            block = ["\n".join(block).rstrip(), "ER"]
        return (formats.wos_block("\n".join(block).split("\n")), "\n".join(block)) if block else None
    raw = formats.tagged_item(lines, formats.DIALECTS[kind])
    if not raw:
        return None
    fields = formats.from_tags(raw, source, kind)
    return fields, formats.raw_block(fields)


def scan(spark: SparkSession, files: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Records, headers, warnings and errors of files (as `tagged_files` gives them), in the form of whole files' rows."""
    kinds = {_plain(p): (p, *what) for p, what in files.items()}

    def cut(batches):
        for path, start, lines in _parts(batches):
            path, source, kind, encoding = kinds[_plain(path)]
            texts = (line.decode(encoding, "replace") for line in map(bytes, lines))
            if kind != "wos_tagged":
                texts = (x for t in texts for x in t.splitlines() or [""])
            out, nth, header = [], 0, []
            for state, own in formats.cut_lines(texts, kind, synced=start == 0):
                if kind == "wos_tagged" and start == 0 and not nth and state != "head":
                    header += [x for x in formats.wos_run(own)[0] if not x.startswith("EF")]
                if state != "whole":
                    out.append((path, start, state, None, "\n".join(own), None, None))
                elif (found := _record(own, source, kind)) is not None:
                    nth += 1
                    out.append((path, start, "record", nth, None, found[1], found[0]))
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            out.append((path, start, "header", None, "\n".join(header).strip(), None, None))
            yield pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in _PIECES.replace("map<string, array<string>>", "m").split(", ")]
    pieces = _lines(spark, list(files)).mapInPandas(cut, _PIECES).checkpoint()
    by_path = Window.partitionBy("path").orderBy("start", F.col("part") == "open")
    fragments = pieces.where("part in ('head', 'open')").withColumn("owner", F.count_if(F.col("part") == "open").over(by_path))
    joined = fragments.groupBy("path", "owner").agg(F.min(F.when(F.col("part") == "open", F.col("start"))).alias("start"), F.array_sort(F.collect_list(F.struct("start", "lines"))).alias("own"), F.max("owner").over(Window.partitionBy("path")).alias("last"))

    def stitched(batches):
        for b in batches:
            out = []
            for path, owner, start, own, last in zip(b["path"], b["owner"], b["start"], b["own"], b["last"]):
                _, source, kind, _ = kinds[_plain(path)]
                text = "\n".join(x["lines"] for x in own)
                over = owner < last or kind == "wos_tagged" and any(x == "ER" or x.startswith("ER ") for x in text.split("\n"))
                if (found := _record(text.split("\n"), source, kind, over)) is not None:
                    out.append((path, start, "record" if over else "unended", None, None, found[1], found[0]))
            yield pd.DataFrame(out, columns=names)

    found = pieces.where("part = 'record'").unionByName(joined.mapInPandas(stitched, _PIECES)).withColumn("titled", F.expr("exists(coalesce(fields['TI'], array()), x -> trim(x) <> '')"))
    starts = pieces.where("part = 'header'").select("path", "start", F.lit(0).alias("n")).unionByName(found.select("path", "start", F.lit(1).alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = starts.groupBy("path", "start").agg(F.sum("n").alias("n"), F.sum("n").alias("own")).select("path", "start", before.alias("before"), "own")
    numbered = found.join(offsets, ["path", "start"]).withColumn("index", (F.col("before") + F.coalesce("nth", "own")).cast("int"))
    meta = spark.createDataFrame([(p, *what[:2]) for p, what in files.items()], "path string, source string, kind string")
    account = numbered.groupBy("path").agg(F.min(F.when(~F.col("titled"), F.col("index"))).alias("first_untitled"), F.count_if(~F.col("titled")).alias("untitled"), F.max(F.expr("exists(coalesce(fields['CR'], array()), x -> trim(x) <> '')")).alias("cited"), F.max(F.col("part") == "unended").alias("unended"), F.count("*").alias("n"))
    header = pieces.where("part = 'header' and start = 0").select("path", F.col("lines").alias("header"))
    account = meta.join(account, "path", "left").join(header, "path", "left")
    wos, none = F.col("kind") == "wos_tagged", F.col("n").isNull()
    error = F.when(none & wos, "no record begins with PT").when(none, F.concat(F.lit("recognised as "), "kind", F.lit(", but without records"))).when(~wos & (F.col("untitled") > 0), F.concat(F.lit("record "), "first_untitled", F.lit(" has no title")))
    warnings = F.array_compact(F.array(F.when(wos & F.col("unended"), formats.NO_END), F.when(wos & ~F.col("cited"), formats.NO_CITED), F.when(wos & (F.col("untitled") > 0), F.concat("untitled", F.lit(" records without TI")))))
    account = account.withColumn("error", error)
    blank = lambda kind: F.lit(None).cast(kind)
    good = account.where("error is null")
    files_rows = account.select(
        F.col("path").alias("source_file"), F.lit(0).alias("source_index"), F.when(F.col("error").isNull(), F.col("source")).alias("source_kind"), F.when(F.col("error").isNull(), F.col("kind")).alias("source_format"), blank("string").alias("raw_block"),
        blank("map<string, array<string>>").alias("fields"), F.when(wos & F.col("error").isNull(), F.col("header")).otherwise(F.when(F.col("error").isNull(), "")).alias("header"), F.explode_outer(F.when(F.col("error").isNull(), warnings)).alias("warning"), "error",
    )
    rows = numbered.join(good.select("path", "source", "kind"), "path").select(
        F.col("path").alias("source_file"), F.col("index").alias("source_index"), F.col("source").alias("source_kind"), F.col("kind").alias("source_format"), "raw_block", "fields", *[blank("string").alias(c) for c in ("header", "warning", "error")]
    )
    return files_rows.unionByName(rows)
