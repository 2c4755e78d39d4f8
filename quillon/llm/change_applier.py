"""Numbered changes applied in order per client: a stateful stream with a timing wheel over buckets of clients.

Rows arrive in batches, out of order and with gaps. A client's rows are held until all numbers before theirs are applied;
where a number doesn't come, the client jumps over it once its earliest held row is `wait` days behind the latest day that
any client has shown in earlier batches.

The stream needs only client, number and day. In each input task the rows of a client and a stretch of numbers become one
summary, so that a client with a third of all rows sends a row for each 4096 of its own. A bucket's state has, per client,
the next number and the held numbers with their days, and a wheel: earliest held day to the clients that wait for it. A tick
(a row for each bucket in every batch, with the latest day) visits only the slots that are due, lets their clients jump and
files them anew. It emits ranges of applied numbers, not rows. What a row came to follows from a join with those ranges by
short stretches; values after each change from a scan within stretches and one over their last values. So no stage needs a
client's rows together; only the held numbers of a client (12 bytes each) are in one bucket.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbering import numbered
from ._shared import delete_path, scratch_path, stored

#: Numbers of a client in one summary and in one block of the scan; in one stretch of the join with ranges.
STRETCH, STEP = 4096, 64
#: Clients in a bucket, and the least number of buckets.
CLIENTS, LEAST_BUCKETS = 2000, 16
#: Days that a held row waits for the numbers before it.
WAIT = 8
#: The latest day of the tick after the last batch: everything held is due.
END = 1 << 40

_SUMMARY = "bucket long, client string, batch int, latest long, numbers binary, days binary"
_RANGES = "client string, batch int, lo long, hi long, missed long"


def ranked(changes: DataFrame, client: str, seq: str, name: str) -> DataFrame:
    """Adds `name`: the dense rank of `seq` among those of its client, by a distributed sort. Nulls are a client, and come first."""
    pairs = changes.select(F.col(client).alias("_client"), F.col(seq).alias("_seq")).distinct()
    placed = numbered(pairs, [F.col("_client").asc_nulls_first(), F.col("_seq").asc_nulls_first()], "_at")
    begin = placed.groupBy(F.col("_client").alias("_own")).agg(F.min("_at").alias("_begin"))
    ranks = placed.join(begin, F.col("_client").eqNullSafe(F.col("_own"))).select("_client", "_seq", (F.col("_at") - F.col("_begin") + 1).alias(name))
    return changes.join(ranks, F.col(client).eqNullSafe(F.col("_client")) & F.col(seq).eqNullSafe(F.col("_seq"))).drop("_client", "_seq")


# --- the stream ----------------------------------------------------------------------------------------------------


def _summaries(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ticks as they are; of a client's rows in a stretch one row with the numbers and the least day of each."""
    names = ["bucket", "client", "batch", "latest", "numbers", "days"]
    for pdf in pdfs:
        ticks = pdf[pdf["client"].isna()]
        if len(ticks):
            yield pd.DataFrame({"bucket": ticks["bucket"], "client": None, "batch": ticks["batch"], "latest": ticks["latest"], "numbers": None, "days": None})
        rows = pdf[pdf["client"].notna()].sort_values(["client", "n", "day"], kind="stable").drop_duplicates(["client", "n"])
        if not len(rows):
            continue
        client, n, day = rows["client"].to_numpy(), rows["n"].to_numpy(np.int64), rows["day"].to_numpy(np.int32)
        stretch = n // STRETCH
        first = np.flatnonzero(np.concatenate(([True], (client[1:] != client[:-1]) | (stretch[1:] != stretch[:-1]))))
        ends = np.append(first[1:], len(rows))
        yield pd.DataFrame({"bucket": rows["bucket"].to_numpy()[first], "client": client[first], "batch": rows["batch"].to_numpy()[first], "latest": None, "numbers": [n[a:b].tobytes() for a, b in zip(first, ends)], "days": [day[a:b].tobytes() for a, b in zip(first, ends)]})[names]


class Wheel:
    """The state of a bucket: clients' next numbers and held rows, and which clients wait for which day."""

    def __init__(self):
        self.next: dict[str, int] = {}
        self.held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.filed: dict[str, int] = {}
        self.slots: dict[int, set[str]] = {}

    def due(self, latest: int, wait: int) -> list[str]:
        """Takes the clients out of the slots whose time has come."""
        found = [day for day in self.slots if day + wait <= latest]
        clients = sorted(c for day in found for c in self.slots.pop(day))
        for c in clients:
            del self.filed[c]
        return clients

    def file(self, client: str) -> None:
        """Puts a client into the slot of its earliest held day, or into none."""
        day = int(self.held[client][1].min()) if client in self.held else None
        old = self.filed.get(client)
        if old == day:
            return
        if old is not None:
            self.slots[old].discard(client)
            if not self.slots[old]:
                del self.slots[old]
            del self.filed[client]
        if day is not None:
            self.slots.setdefault(day, set()).add(client)
            self.filed[client] = day

    def _keep(self, client: str, numbers: np.ndarray, days: np.ndarray) -> None:
        if len(numbers):
            self.held[client] = numbers.copy(), days.copy()
        else:
            self.held.pop(client, None)

    def jump(self, client: str, latest: int, wait: int) -> list[tuple[int, int, int]]:
        """(first, last, numbers missed before) of all runs that a due client applies: to the end of the last due row's run."""
        numbers, days = self.held[client]
        breaks = np.flatnonzero(np.diff(numbers) != 1) + 1
        last_due = int(np.flatnonzero(days + wait <= latest)[-1])
        begins = np.concatenate(([0], breaks))
        ends = np.append(breaks, len(numbers))
        n = int(np.searchsorted(begins, last_due, "right"))
        found, after = [], self.next.get(client, 1)
        for a, b in zip(begins[:n].tolist(), ends[:n].tolist()):
            found.append((int(numbers[a]), int(numbers[b - 1]), int(numbers[a]) - after))
            after = int(numbers[b - 1]) + 1
        self.next[client] = after
        self._keep(client, numbers[ends[n - 1] :], days[ends[n - 1] :])
        return found

    def arrive(self, client: str, numbers: np.ndarray, days: np.ndarray) -> list[tuple[int, int, int]]:
        """Holds new numbers (of equal ones the least day; none below next, none that is held) and applies the run at next."""
        after = self.next.get(client, 1)
        order = np.lexsort((days, numbers))
        numbers, days = numbers[order], days[order]
        fresh = (numbers >= after) & np.concatenate(([True], numbers[1:] != numbers[:-1]))
        if client in self.held:
            own, own_days = self.held[client]
            fresh &= ~np.isin(numbers, own)
            numbers, days = np.concatenate((own, numbers[fresh])), np.concatenate((own_days, days[fresh]))
            order = np.argsort(numbers, kind="stable")
            numbers, days = numbers[order], days[order]
        else:
            numbers, days = numbers[fresh], days[fresh]
        run = int((numbers - np.arange(len(numbers)) == after).sum())
        self._keep(client, numbers[run:], days[run:])
        self.next[client] = after + run
        return [(after, after + run - 1, 0)] if run else []


def _tick(wait: int):
    def run(key, pdfs, state) -> Iterator[pd.DataFrame]:
        wheel = pickle.loads(state.get[0]) if state.exists else Wheel()
        found = []
        for batch, rows in pd.concat(list(pdfs)).groupby("batch"):  # one, and the flush with the last
            touched = set()
            ticks = rows["client"].isna()
            latest = rows.loc[ticks, "latest"].max()
            if pd.notna(latest):
                for client in wheel.due(int(latest), wait):
                    touched.add(client)
                    found += [(client, int(batch), *r) for r in wheel.jump(client, int(latest), wait)]
            new: dict[str, list[tuple[bytes, bytes]]] = {}
            for client, numbers, days in rows.loc[~ticks, ["client", "numbers", "days"]].itertuples(index=False):
                new.setdefault(client, []).append((numbers, days))
            for client, parts in new.items():
                touched.add(client)
                numbers = np.frombuffer(b"".join(x for x, _ in parts), np.int64)
                found += [(client, int(batch), *r) for r in wheel.arrive(client, numbers, np.frombuffer(b"".join(x for _, x in parts), np.int32))]
            for client in touched:
                wheel.file(client)
        state.update((pickle.dumps(wheel, protocol=5),))
        yield pd.DataFrame(found, columns=["client", "batch", "lo", "hi", "missed"])

    return run


def applied_ranges(rows: DataFrame, batches: int, wait: int = WAIT, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranges: client, batch, lo, hi, missed; the rows as they were fed) for rows of client (text), n, day and batch (1 to `batches`).

    Each batch's files are put in the stream's folder and the query is started anew on the same checkpoint, until it has
    taken them. With the last batch comes a tick for which all is due, as batch `batches` + 1. Unless given, `buckets` follows from
    the (estimated) number of clients, CLIENTS to a bucket; it holds for the life of a checkpoint, which is new for each call.
    """
    spark = rows.sparkSession
    folder = scratch_path(spark, "stream")
    dealt = rows.withColumn("bucket", F.lit(None).cast("long")).withColumn("latest", F.lit(None).cast("long"))
    # a batch has its share of the shuffle's partitions as files; a hot client is dealt over them by short stretches
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("client", F.floor(F.col("n") / STEP)), F.lit(max(1, n // batches)))
    dealt.withColumn("part", F.col("batch")).repartition(n, "batch", share).write.partitionBy("part").parquet(f"{folder}/parts")
    schema = dealt.schema
    read = lambda reader, p: reader.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/{p}")
    parts = read(spark.read, "parts")
    # a row for each batch
    days = {r.batch: r.day for r in parts.groupBy("batch").agg(F.max("day").alias("day")).collect()}
    if buckets is None:
        buckets = max(LEAST_BUCKETS, parts.agg(F.approx_count_distinct("client").alias("n")).first().n // CLIENTS)
    jvm = spark._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{folder}/{p}")
    fs = path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(path("feed"))
    stream = read(spark.readStream, "feed")
    bucket = F.coalesce("bucket", F.pmod(F.xxhash64("client"), F.lit(buckets))).alias("bucket")
    summed = stream.select(bucket, "client", "batch", "latest", "n", "day").mapInPandas(_summaries, _SUMMARY)
    ranges = summed.groupBy("bucket").applyInPandasWithState(_tick(wait), _RANGES, "wheel binary", "append", "NoTimeout")
    checksums = "spark.sql.streaming.checkpoint.fileChecksum.enabled"
    before = spark.conf.get(checksums, None)
    spark.conf.set(checksums, False)  # the checkpoint ends with this call
    try:
        for batch in range(1, batches + 1):
            latest = max((d for b, d in days.items() if b < batch), default=None)
            ticks = [(batch, latest)] + [(batches + 1, END)] * (batch == batches)
            told = F.explode(F.array(*[F.struct(F.lit(b).alias("batch"), F.lit(d).cast("long").alias("latest")) for b, d in ticks]))
            own = spark.range(0, buckets, 1, 1).select(F.col("id").alias("bucket"), told.alias("t")).select("bucket", "t.*")
            own.select(*[(F.col(f.name) if f.name in own.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(f"{folder}/parts/part={batch}")
            if not fs.rename(path(f"parts/part={batch}"), path(f"feed/part={batch}")):
                raise OSError(f"can't move batch {batch} to the stream's folder")
            query = ranges.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/ranges").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(checksums)
        else:
            spark.conf.set(checksums, before)
    fed = read(spark.read, "feed").where("client is not null").drop("bucket", "latest")
    found = stored(spark.read.schema(_RANGES).parquet(f"{folder}/ranges"), "ranges")
    delete_path(spark, f"{folder}/checkpoint")
    return found, fed


# --- what rows come to ---------------------------------------------------------------------------------------------


def _carried(rows: DataFrame, values: list[str]) -> DataFrame:
    """Each of `values` (null: no change, else a struct of one value) as the last one up to the row by client and n."""
    rows = rows.withColumn("_block", F.floor(F.col("n") / STRETCH))
    own = Window.partitionBy("client", "_block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("client").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("client", "_block").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("n"))).alias(f"_end_{v}") for v in values])
    ends = ends.select("client", "_block", *[F.last(f"_end_{v}", ignorenulls=True).over(before).alias(f"_before_{v}") for v in values])
    joined = rows.join(ends, ["client", "_block"])
    return joined.select("client", "n", "first", "applied_batch", "missed", "final", *[F.coalesce(F.last(v, ignorenulls=True).over(own), F.col(f"_before_{v}"))["v"].alias(v) for v in values])


def apply_changes(changes: DataFrame, day: Column, batch: Column, keep: Column, batches: int, client: str = "client_id", seq: str = "seq", order: str = "change_id", op: str = "op", values: tuple[str, ...] = ("city", "balance"), wait: int = WAIT, buckets: int | None = None) -> DataFrame:
    """Every distinct row with what became of it: status (applied, rejected), batch, missed, values afterwards, current.

    A row's number is the dense rank of `seq` per client over all distinct rows; then only rows of which `keep` holds and
    `day` isn't null take part, in batches 1 to `batches`. In a batch, rows come by day, `order` and the other columns. A row
    is rejected if its number was held or passed before. Operation I sets all values, U those that aren't null, D nulls
    all; others change nothing. `batch` is that of application or rejection (`batches` + 1: the flush at the end), `missed`
    the numbers jumped right before the row, `current` true on a client's last applied row unless that is a D. Values of
    rejected rows are null.

    Null clients are one client, a null `seq` is its first; rows with a null `order` have a place before others. Equal rows
    are one; an empty table gives none. Texts are carried whole. Columns of any other name only tell rows apart.
    """
    place = {c: f"c{k}" for k, c in enumerate(changes.columns)}
    base = changes.distinct()
    base = base.select(*[F.col(f"`{c}`").alias(k) for c, k in place.items()], day.cast("int").alias("_day"), batch.cast("int").alias("_batch"), keep.alias("_keep"))
    rows = ranked(base, place[client], place[seq], "_n").where("_keep and _day is not null")
    key = F.coalesce(F.concat(F.lit("c"), F.col(place[client]).cast("string")), F.lit(""))
    row = F.struct("_day", place[order], *[k for k in place.values() if k != place[order]])
    narrow = rows.select(key.alias("client"), F.col("_n").alias("n"), F.col("_day").alias("day"), row.alias("row"), F.greatest(F.lit(1), F.least(F.lit(batches), F.col("_batch"))).alias("batch"))
    ranges, fed = applied_ranges(narrow, batches, wait, buckets)
    firsts = fed.groupBy("client", "n").agg(F.min(F.struct("batch", "row")).alias("first")).withColumn("_step", F.floor(F.col("n") / STEP))
    ends = ranges.groupBy("client").agg(F.max("hi").alias("_end"))
    steps = ranges.join(ends, "client").select(F.col("client").alias("_client"), "_end", F.explode(F.sequence(F.floor(F.col("lo") / STEP), F.floor(F.col("hi") / STEP))).alias("_own_step"), "lo", "hi", F.col("batch").alias("applied_batch"), F.col("missed").alias("_missed"))
    on = (F.col("client") == F.col("_client")) & (F.col("_step") == F.col("_own_step")) & F.col("n").between(F.col("lo"), F.col("hi"))
    hit = firsts.join(steps, on)
    what = lambda c: F.col(f"first.row.{place[c]}")
    deleted, own = F.coalesce(what(op) == "D", F.lit(False)), [f"v{k}" for k in range(len(values))]
    changed = [F.when(what(op).isin("I", "D") | ((what(op) == "U") & what(v).isNotNull()), F.struct(F.when(~deleted, what(v)).alias("v"))).alias(k) for v, k in zip(values, own)]
    hit = hit.select("client", "n", "first", "applied_batch", F.when(F.col("n") == F.col("lo"), F.col("_missed")).otherwise(0).alias("missed"), ((F.col("n") == F.col("_end")) & ~deleted).alias("final"), *changed)
    done = _carried(hit, own).withColumnRenamed("client", "_client").withColumnRenamed("n", "_own")
    joined = fed.join(done, (F.col("client") == F.col("_client")) & (F.col("n") == F.col("_own")), "left")
    won = F.coalesce(F.struct("batch", "row") == F.col("first"), F.lit(False))
    result = {c: F.col(f"row.{place[c]}") for c in (order, client)} | {
        "status": F.when(won, "applied").otherwise("rejected"),
        "batch": F.when(won, F.col("applied_batch")).otherwise(F.col("batch")),
        "missed": F.when(won, F.col("missed")).otherwise(0).cast("long"),
        **{v: F.when(won, F.col(k)) for v, k in zip(values, own)},
        "current": won & F.coalesce("final", F.lit(False)),
    }
    return joined.select(*[c.alias(n) for n, c in result.items()])


def digits_crc32(number: Column) -> Column:
    """CRC-32 of a number's decimal digits."""
    return F.crc32(number.cast("string").cast("binary"))


def cents(balance: Column) -> Column:
    return F.floor(100 * balance + 0.5).cast("long")
