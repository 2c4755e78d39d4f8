"""Best-fit packing of token sequences by bin completion with branch and bound.

Items are the pieces' lengths with their counts: at most `capacity` different ones, whatever the size of the corpus,
so the search runs on the driver over a bounded histogram. Incumbents are the best-fit packing and one by the least
wasteful filling around each largest length. While an incumbent has more sequences than the lower bound (the tokens,
and the waste beside large items), a depth-first search goes on: it takes the largest length left, enumerates the
undominated fillings of the space beside it, and leaves a branch when its waste, or the bound of what is left, can't
beat the incumbent. Rounds of it fill `SINGLE` sequences of the incumbent anew, the most wasteful first and all of them if
the steps last, beginning again whenever one is saved. All three bounds are parameters; without them (None) the search is
whole and its packing the least. Pieces then find their place by their rank among the pieces of their length, which needs no
sort: a task numbers its own, and tasks' offsets are summed.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from math import inf

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _chunks
from ._shared import released, stored, texts
from .token_counts import tokenizer

#: Steps in the search for one filling, of the incumbent by least waste; of the search beyond the incumbents, and of a round of it.
NODES, SEARCH, ROUND = 4000, 200_000, 50_000
#: Sequences that a round fills anew.
SINGLE = 48


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that every packing needs: for each size, what lies beside larger items than fit with it counts as waste."""
    if not histogram:
        return 0
    n, tokens = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    for x, c in histogram.items():
        n[x] += c
        tokens[x] += c * x
    n, tokens = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(tokens))  # [x]: items shorter than x
    half, best = capacity // 2, -(-int(tokens[-1]) // capacity)
    for least in [0, *(x for x in histogram if x <= half)]:
        alone = int(n[capacity + 1] - n[capacity - least + 1])
        beside, held = int(n[capacity - least + 1] - n[half + 1]), int(tokens[capacity - least + 1] - tokens[half + 1])
        small = int(tokens[half + 1] - tokens[least])
        best = max(best, alone + beside + max(0, -(-(small - (beside * capacity - held)) // capacity)))
    return best


def completions(space: int, lengths: list[int], counts: dict[int, int], allowed: list[int], steps: list[int]):
    """Fillings of `space` from the ascending list `lengths`, each used at most counts[length] times, larger items first.

    Yields those to which no shorter item can be added and that waste at most allowed[0], which the caller may lower on
    the way. steps[0] is counted down; at 0 the enumeration ends.
    """
    held = [0]  # tokens in the shortest k lengths
    for x in lengths:
        held.append(held[-1] + x * counts[x])
    used, chosen, left = dict.fromkeys(lengths, 0), [], space
    frames, fresh = [bisect_right(lengths, space)], True
    while frames and steps[0] > 0:
        steps[0] -= 1
        k = frames[-1]
        while k and used[lengths[k - 1]] >= counts[lengths[k - 1]]:
            k -= 1
        if fresh and (not chosen or left <= chosen[-1]) and used.get(left, 1) < counts.get(left, 0):
            yield [*chosen, left]  # an exact fit before all others
        elif fresh and not k and left <= allowed[0]:
            yield list(chosen)
        if k and left - held[k] <= allowed[0]:
            x = lengths[k - 1]
            frames[-1] = k - 1
            chosen.append(x)
            used[x] += 1
            left -= x
            frames.append(bisect_right(lengths, left, 0, k))
            fresh = True
        else:
            frames.pop()
            fresh = False
            if chosen:
                x = chosen.pop()
                used[x] -= 1
                left += x


def dominated(filling: list[int], waste: int, lengths: list[int], counts: dict[int, int]) -> bool:
    """Whether a longer item left over could take the place of one or two of the filling's, or of none."""
    free = [x for x in lengths if counts[x] > filling.count(x)]
    parts = {(0, 1)} | {(x, 1) for x in filling} | {(x + y, 0) for k, x in enumerate(filling[:40]) for y in filling[k + 1 : 40]}
    # a part of one item must be replaced by a longer one, a part of two also by one that is as long
    return any((j := bisect_right(free, total + waste)) and free[j - 1] >= total + more for total, more in parts)


def best_filling(space: int, lengths: list[int], counts: dict[int, int], nodes: int | None = NODES) -> list[int]:
    """Lengths from the ascending list `lengths` that waste the least of `space`, each used at most counts[length] times."""
    best, allowed, steps = [], [space], [inf if nodes is None else nodes]
    for found in completions(space, lengths, counts, allowed, steps):
        waste = space - sum(found)
        if waste <= allowed[0]:
            best, allowed[0] = found, waste - 1
        if not waste:
            break
    return best


def _used_up(items: list[int], counts: dict[int, int], most: int | None = None) -> int:
    """Takes the items from the counts as often as they allow, `most` times at most; returns how often."""
    need = Counter(items)
    times = min(counts[x] // n for x, n in need.items())
    times = times if most is None else min(times, most)
    for x, n in need.items():
        counts[x] -= n * times
    return times


def least_waste(histogram: dict[int, int], capacity: int, nodes: int | None = NODES) -> list[tuple[list[int], int]]:
    """The packing that fills the space beside the largest length left with the least waste, again and again."""
    counts = {x: n for x, n in histogram.items() if n}
    lengths, found = sorted(counts), []
    while lengths:
        top = lengths[-1]
        counts[top] -= 1
        items = [top, *best_filling(capacity - top, lengths, counts, nodes)]
        counts[top] += 1
        found.append((sorted(items, reverse=True), _used_up(items, counts)))
        lengths = [x for x in lengths if counts[x]]
    return found


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing: each item, the longest first, goes where it leaves the least space."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {capacity: []}  # by space left
    for x in sorted((x for x, n in histogram.items() if n), reverse=True):
        n = histogram[x]
        while n:
            space = min((r for r, own in open_.items() if r >= x and own), default=capacity)
            items, times = open_[space].pop() if open_[space] else ((), -(-n // (capacity // x)))
            each = min(space // x, n)
            full = min(times, n // each)
            if times > full:
                open_[space].append((items, times - full)) if space < capacity else None
            open_.setdefault(space - each * x, []).append((items + (x,) * each, full))
            n -= each * full
    return [(list(items), times) for own in open_.values() for items, times in own]


def fillings(histogram: dict[int, int], capacity: int, search: int | None = SEARCH, nodes: int | None = NODES, single: int | None = SINGLE) -> list[tuple[list[int], int]]:
    """(lengths in one sequence, number of such sequences), as few sequences as found; all items are used up.

    The better of two incumbents; where it doesn't meet `lower_bound`, rounds fill `single` of its sequences anew, those that
    waste most and haven't been looked at since the last one was saved, until none is left or `search` steps are taken.
    With None for all three the number is the least. Memory is bounded by a round's sequences.
    """
    size = lambda packing: sum(times for _, times in packing)
    best = min((best_fit(histogram, capacity), least_waste(histogram, capacity, nodes)), key=size)
    bound, left = lower_bound(histogram, capacity), [inf if search is None else search]
    seen: Counter = Counter()  # how many sequences of a filling have been looked at
    while size(best) > bound and left[0] > 0:
        kept, tail, room = [], [], inf if single is None else single
        for items, times in sorted(best, key=lambda f: sum(f[0])):
            n = min(times - seen[tuple(items)], room) if sum(items) < capacity else 0
            room -= n
            tail += [(items, n)] * (n > 0)
            kept += [(items, times - n)] * (times > n)
        if not tail:
            break
        rest: Counter = Counter()
        for items, n in tail:
            for x in items:
                rest[x] += n
        steps = [left[0] if single is None else min(left[0], ROUND)]
        before = steps[0]
        found = _search(dict(rest), capacity, tail, steps)
        left[0] -= before - steps[0] if before < inf else 0
        if size(found) < size(tail):
            seen.clear()
        merged: Counter = Counter()
        for items, n in kept + found:
            merged[tuple(items)] += n
        if size(found) == size(tail):
            for items, n in found:
                seen[tuple(items)] += n
        best = [(list(items), n) for items, n in merged.items()]
    return best


def report(histogram: dict[int, int], capacity: int, **bounds) -> dict[str, int]:
    """How many sequences `fillings` needs, and how many every packing does."""
    return {"sequences": sum(n for _, n in fillings(histogram, capacity, **bounds)), "lower_bound": lower_bound(histogram, capacity)}


def _search(histogram: dict[int, int], capacity: int, best: list[tuple[list[int], int]], steps: list) -> list[tuple[list[int], int]]:
    """Depth-first bin completion from the incumbent `best`; steps[0] is counted down."""
    size = lambda packing: sum(times for _, times in packing)
    bound, total = lower_bound(histogram, capacity), sum(x * n for x, n in histogram.items())
    counts = {x: n for x, n in histogram.items() if n}
    path: list[tuple[list[int], int]] = []  # what the branch has filled
    waste = 0

    def options():
        lengths = [x for x in sorted(counts) if counts[x]]
        top = lengths[-1]
        counts[top] -= 1
        own = dict(counts)
        counts[top] += 1
        allowed = [(size(best) - 1) * capacity - total - waste]
        seen = set()
        for found in completions(capacity - top, lengths, own, allowed, steps):
            spare = capacity - top - sum(found)
            if tuple(found) not in seen and not dominated(found, spare, lengths, own):
                seen.add(tuple(found))
                yield [top, *found], spare
            allowed[0] = (size(best) - 1) * capacity - total - waste

    frames = [options()] if counts else []
    while frames and size(best) > bound and steps[0] > 0:
        step = next(frames[-1], None)
        if step is None:
            frames.pop()
            if path:
                items, times = path.pop()
                for x in items:
                    counts[x] += times
                waste -= times * (capacity - sum(items))
            continue
        items, spare = step
        times = _used_up(items, counts, 1)
        path.append((sorted(items, reverse=True), times))
        waste += times * spare
        rest = lower_bound({x: n for x, n in counts.items() if n}, capacity)
        if not rest and size(path) < size(best):
            best = list(path)
        frames.append(options() if rest and size(path) + rest < size(best) else iter(()))
    return best


def _places(found: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, items of that length in a sequence, offset), by length and rank."""
    rows, ranks, sequence = [], {}, 0
    for items, times in found:
        offset = 0
        for x in dict.fromkeys(items):
            n = items.count(x)
            rows.append((x, ranks.get(x, 0), sequence, n, offset))
            ranks[x] = ranks.get(x, 0) + n * times
            offset += n * x
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = _byte_letters()
#: A piece that is one word for every byte-level tokenizer, so that the merges alone decide its ids.
_WORD = re.compile(f" ?[{_chunks.LATIN}]+").fullmatch


def _ids(tok, pieces: list[str]) -> list[bytes]:
    """The ids of each piece, little-endian; single words go to the merges directly, others through the whole tokenizer."""
    found: dict[str, bytes] = {}
    others = []
    for p in pieces:
        if _WORD(p):
            found[p] = array("I", [t.id for t in tok.model.tokenize(p.encode().decode("latin-1").translate(_LETTERS))]).tobytes()
        else:
            others.append(p)
    found.update((p, array("I", e.ids).tobytes()) for p, e in zip(others, tok.encode_batch_fast(others, add_special_tokens=False)))
    return [found[p] for p in pieces]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str, end_id: int, keep_ids: bool) -> DataFrame:
    """The pieces of every document: id, piece, start, length, ids_crc32, ids; task and seq number pieces of a length."""
    rows = texts(docs, id_col, text_col)

    def run(batches):
        tok = tokenizer(tokenizer_path)
        cache = _chunks.Cache(lambda pieces: _ids(tok, pieces))
        seen, end, task = [0] * (capacity + 1), int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId()
        for batch in batches:
            for part in _chunks.byte_batches(batch):
                out: list[list] = [[] for _ in range(8)]
                for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    ids = memoryview(b"".join(cache.of(_chunks.split(text, _chunks.SPACED_FINE, _chunks.SPACED_COARSE))) + end)
                    total, start, piece = len(ids) // 4, 0, 0
                    while start < total:
                        n = (total - start) % capacity or capacity
                        own = ids[4 * start : 4 * (start + n)]
                        for column, value in zip(out, (doc, piece, start, n, zlib.crc32(own), np.frombuffer(own, "<u4").tolist() if keep_ids else None, task, seen[n])):
                            column.append(value)
                        seen[n] += 1
                        start, piece = start + n, piece + 1
                kinds = (batch.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["id", "piece", "start", "length", "ids_crc32", "ids", "task", "seq"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(released(run), f"id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>, task int, seq long")
    return found if keep_ids else found.drop("ids")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, keep_ids: bool = False, search: int | None = SEARCH, nodes: int | None = NODES, single: int | None = SINGLE) -> DataFrame:
    """Packs all documents' tokens, each document closed by `end_id`, into as few sequences of `capacity` as found.

    Returns per piece: id, piece, start, length, ids_crc32, [ids,] sequence_id, offset. Only documents of more than
    `capacity` tokens are cut; their first piece may be shorter. A null or empty text is the end token alone;
    null ids and repeated rows are packed like others; an empty table gives none; other columns are ignored. A very long
    text is cut into pieces by one task. `search`, `nodes` and `single` are the bounds of `fillings`.
    """
    pieces = stored(token_pieces(docs, tokenizer_path, capacity, id_col, text_col, end_id, keep_ids), "pieces")
    spark = docs.sparkSession
    counts = pieces.groupBy("task", "length").agg((F.max("seq") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("task", "length", before.alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(_places(fillings(histogram, capacity, search, nodes, single)))
    placed = pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("seq") + F.col("before")).drop("task", "seq", "before")

    def place(batches):
        table = places.value
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            _, first, sequence, n, offset = table[np.searchsorted(keys, length << 48 | rank, side="right") - 1].T
            more = [sequence + (rank - first) // n, offset + (rank - first) % n * length]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x, pa.int64()) for x in more)], [*kept, "sequence_id", "offset"])

    columns = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    placed = placed.select(*columns, "rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.drop("rank").schema)
    return placed.mapInArrow(released(place), f"{schema}, sequence_id long, offset long").withColumnRenamed("id", id_col)
