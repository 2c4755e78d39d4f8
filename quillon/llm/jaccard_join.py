"""N-gram Jaccard join in the metric space of shingle sets, exact, with pivots, regions and triangle-inequality windows.

Documents of equal sets are one class, so copies never meet as pairs. The join of the classes works down in regions:

1. Regions. Far apart in this space is the rule: two texts that have no shingle in common have distance 1 from each
   other and from every pivot, where no triangle inequality parts them. So the first regions come from shared shingles:
   under one order of all shingles (frequent ones last, of the others the longest first) two sets with similarity t share a shingle among the first
   n - ceil(t n) + 1 of each, and the classes that have a shingle there make a region, named after its pivot, the
   least of them. Both ends of every link lie in a common region.
2. Windows. Each class has the sizes of its set's parts in fixed parts of the space (64, and more for sets of more than
   768); the L1 distance of two such vectors is at most the sets' symmetric difference. Within a region only classes
   that have a partner inside the window stay, and the classes that windows connect become a region of their own.
3. Recursion (`_split`). A region of more than `CELL` classes gets pivots, and its blocks find their distances to them:
   links with pivots are found, a class goes to the Voronoi cell of its nearest pivot and is replicated into those whose
   border lies within twice the link distance; classes that hardly share a shingle with any pivot make a cell
   of their own. Cells are regions again. Where borders hold nearly all (a group of near copies) cells are of no use and
   the region is joined in pairs of blocks; for components, classes that link with one pivot needn't meet each other.
4. Regions that fit a task are joined exactly on the sets, by the same recursion in memory. Those that fit at once get the
   texts, which take up less than half of what the sets do; sets are stored only for larger ones.

No task holds more than a cell or two blocks. `jaccard_links` gives all links, which grow with the square of a group of
near copies. For components a region is left as soon as it is connected, and its links then give components by a
label propagation over written tables. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._chunks import byte_batches
from ._shared import freed, release_memory, released, sorted_groups, stored, texts

WORDS, PARTS, MOST_PARTS = 5, 64, 4096
#: Frequent: so many times in a batch of about 8 MB of text, wherever it is.
OFTEN, MOST_OFTEN = 4, 500_000
#: Classes that a task joins by windows, and the most of a region that is joined so, in pairs of blocks.
BLOCK, WINDOWED = 256, 8192
#: Classes that a task joins by sets; pivots of a larger region; below so many a cell is joined pivot by pivot.
CELL, PIVOTS, LEAF = 512, 32, 24
#: Shingles in a bucket, about.
BUCKET = 250_000
#: Ids to look up are broadcast up to this number (8 bytes each), joined by a shuffle beyond.
BROADCAST_ROWS = 500_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _hashed(text: str) -> tuple[np.ndarray, list[bytes]]:
    """The 5-word shingles of a text as 64-bit hashes, one for each place; of 1 to 4 words, all of them as one shingle. And the words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space only
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    if len(h) >= WORDS:
        s = sum(h[k : len(h) - WORDS + 1 + k] * _MULTIPLIERS[k] for k in range(WORDS))
    elif len(h):
        s = (h * _MULTIPLIERS[: len(h)]).sum(keepdims=True) + np.uint64(len(h))
    else:
        return h, words
    s = (s ^ s >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return s ^ s >> np.uint64(32), words


def shingles(text: str) -> np.ndarray:
    """The distinct shingles of a text, sorted by their hashes."""
    return np.unique(_hashed(text)[0])


def measured_shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The same, and how many bytes the words of each have together (65,535 at most)."""
    s, words = _hashed(text)
    found, first = np.unique(s, return_index=True)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    ends = np.append(0, ends)
    span = min(WORDS, len(words))
    return found, np.minimum(ends[first + span] - ends[first], 0xFFFF).astype(np.uint16)


class Keys:
    """Keys of sets: a hash of 64 bits (or `bits`), with the next salt while it is one of `taken`.

    `taken` are the few keys under which different sets have met; those sets get other ones.
    """

    def __init__(self, taken: frozenset[int] = frozenset(), bits: int = 64):
        self.taken, self.bits = taken, bits

    def __call__(self, s: np.ndarray) -> int:
        salt, data = 0, s.tobytes()
        while True:
            key = int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little", signed=True) >> (64 - self.bits)
            if key not in self.taken:
                return key
            salt += 1


def prefix_length(n: int, t: int) -> int:
    """How many of a set's n shingles come first in the order."""
    return n - (t * n + 99) // 100 + 1


def parts(s: np.ndarray) -> bytes:
    """How many of the set lie in each of the fixed parts of the space: a power of two of parts, at most about 12 in each.

    Numbers above 255 count as 255, which never makes two vectors' distance larger.
    """
    k = PARTS
    while k < MOST_PARTS and 12 * k < len(s):
        k *= 2
    return np.minimum(np.bincount(s % np.uint64(k), minlength=k), 0xFF).astype(np.uint8).tobytes()


def near_pairs(vectors: list[bytes], sizes: np.ndarray, t: int):
    """(k, js): for each member the later members inside the window, vectors of more parts folded to the other's."""
    own = [np.frombuffer(v, np.uint8).astype(np.int32) for v in vectors]
    width = np.array([len(v) for v in own])
    levels = sorted(set(width.tolist()))
    rows = {w: np.flatnonzero(width >= w) for w in levels}
    folded = {w: np.stack([own[k].reshape(-1, w).sum(axis=0) for k in rows[w]]) for w in levels}
    for k in range(len(own) - 1):
        found = []
        for w in levels:
            if w > width[k]:
                break
            at = np.flatnonzero((rows[w] > k) & ((width[rows[w]] == w) | (width[k] == w)))
            if len(at):
                mine = folded[w][np.searchsorted(rows[w], k)]
                j = rows[w][at]
                # |A - B| + |B - A| <= (100 - t) / (100 + t) * (|A| + |B|)
                found.append(j[(100 + t) * np.abs(folded[w][at] - mine).sum(axis=1) <= (100 - t) * (sizes[j] + sizes[k])])
        yield k, np.concatenate(found) if found else np.zeros(0, int)


def _profiles(rows: DataFrame, keys: Keys) -> DataFrame:
    """Per row id, n and the class with its vector, and the hash of its text; and rows of frequent shingles (s, c, a class that has it) with a null n."""
    kind, id_type = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)
    names, none = ["id", "h", "n", "cls", "vec", "s", "c"], pa.int64()

    def run(batches):
        for batch in batches:
            for part in byte_batches(batch):
                n, cls, vec, all_, owner, seen = [], [], [], [], [], set()
                for text in part.column("text").to_pylist():
                    s = shingles(text)
                    key = keys(s)
                    n.append(len(s))
                    cls.append(key)
                    vec.append(parts(s))
                    if key not in seen:
                        seen.add(key)
                        all_.append(s)
                        owner.append(key)
                empty = [None] * len(n)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array(n, none), pa.array(cls, none), pa.array(vec, pa.binary()), pa.array(empty, none), pa.array(empty, none)], names)
                values, first, c = np.unique(np.concatenate(all_), return_index=True, return_counts=True)
                often = np.flatnonzero(c >= OFTEN)
                if len(often):
                    holder = np.repeat(np.array(owner, np.int64), [len(s) for s in all_])[first[often]]
                    empty = [None] * len(often)
                    yield pa.RecordBatch.from_arrays([pa.array(empty, id_type), pa.array(empty, none), pa.array(empty, none), pa.array(holder), pa.array(empty, pa.binary()), pa.array(values[often].view(np.int64)), pa.array(c[often].astype(np.int64))], names)

    return rows.withColumn("h", F.xxhash64("text")).mapInArrow(released(run), f"id {kind}, h long, n long, cls long, vec binary, s long, c long")


def _packed(numbers: np.ndarray, cut: np.ndarray, width: int) -> pa.Array:
    """Binary values: the runs of 64-bit numbers that end at `cut`, `width` bytes each."""
    data = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :width])
    return pa.Array.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(np.append(0, cut * width).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def leading(s: np.ndarray, m: int, known: np.ndarray, ranks: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first m shingles of a set in the order of all: those that aren't frequent, and places in `known` of the frequent ones.

    Of those that aren't frequent the longest come first where `lengths` are given: unrelated texts share short words in
    a row by chance, in numbers that grow with the square of the table, but hardly ever long ones.
    """
    at = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
    often = known[at] == s if len(known) else np.zeros(len(s), bool)
    first, held = s[~often], at[often]
    if lengths is not None and len(first) > m:
        first = first[np.argsort(0xFFFF - lengths[~often], kind="stable")]  # of equal ones by hash, so that the order is total
    first = first[:m]
    return first, held[np.argsort(ranks[held], kind="stable")][: m - len(first)]


def _postings(rows: DataFrame, shared, t: int, buckets: int, keys: Keys) -> DataFrame:
    """(bucket, s, cls): shingles that come first in the order of each class, packed by bucket, 5 and 8 bytes each.

    For a frequent shingle its region is known already, and `s` holds nothing: `cls` has pairs of region and class.
    """

    def run(batches):
        known, ranks, homes = (np.ascontiguousarray(shared.value[x]) for x in ("s", "rank", "p"))
        for batch in batches:
            for part in byte_batches(batch):
                rare, rare_owner, pairs, seen = [], [], [], set()
                for text in part.column("text").to_pylist():
                    s, lengths = measured_shingles(text)
                    if not len(s) or (key := keys(s)) in seen:
                        continue
                    seen.add(key)
                    m = prefix_length(len(s), t)
                    first, held = leading(s, m, known, ranks, lengths)
                    rare.append(first)
                    rare_owner.append((key, len(first)))
                    if len(held):
                        regions = np.unique(homes[held])
                        pairs.append(np.stack([regions, np.full(len(regions), key, np.int64)], axis=1))
                if rare and sum(n for _, n in rare_owner):
                    s, owner = np.concatenate(rare), np.repeat(np.array([k for k, _ in rare_owner], np.int64), [n for _, n in rare_owner])
                    b = (s >> np.uint64(40)) % np.uint64(buckets)
                    order = np.argsort(b, kind="stable")
                    found, counts = np.unique(b, return_counts=True)
                    cut = np.cumsum(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), _packed(s[order], cut, 5), _packed(owner[order], cut, 8)], ["bucket", "s", "cls"])
                if pairs:
                    both = np.concatenate(pairs)
                    b = ((both[:, 0] ^ both[:, 1]).view(np.uint64) >> np.uint64(40)) % np.uint64(buckets)
                    order = np.argsort(b, kind="stable")
                    found, counts = np.unique(b, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array([None] * len(found), pa.binary()), _packed(both[order].reshape(-1), 2 * np.cumsum(counts), 8)], ["bucket", "s", "cls"])

    return rows.mapInArrow(released(run), "bucket int, s binary, cls binary")


def _regions(postings: DataFrame) -> DataFrame:
    """(p, cls): the classes of every shingle that two classes have among their first, with the least of them."""

    def run(batches):
        for _, rows in sorted_groups(batches, ["bucket"]):
            pairs = [np.frombuffer(c, np.int64).reshape(-1, 2) for s, c in zip(rows["s"], rows["cls"]) if s is None]
            own = [(s, c) for s, c in zip(rows["s"], rows["cls"]) if s is not None]
            if own:
                short = np.frombuffer(b"".join(s for s, _ in own), np.uint8).reshape(-1, 5)
                s = np.zeros((len(short), 8), np.uint8)
                s[:, :5] = short
                s, cls = s.view(np.uint64).ravel(), np.frombuffer(b"".join(c for _, c in own), np.int64)
                order = np.argsort(s, kind="stable")
                s, cls = s[order], cls[order]
                starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                sizes = np.diff(np.append(starts, len(s)))
                least, most = np.minimum.reduceat(cls, starts), np.maximum.reduceat(cls, starts)
                some = np.repeat(least != most, sizes)
                pairs.append(np.stack([np.repeat(least, sizes)[some], cls[some]], axis=1))
            both = np.unique(np.concatenate(pairs), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["p", "cls"])

    dealt = postings.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(released(run), "p long, cls long").distinct()


class Links:
    """Union-find over members 0 to n - 1 that keeps the links that joined two groups, or every link."""

    def __init__(self, n: int, every: bool = False):
        self.up, self.made, self.every = list(range(n)), [], every

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        if x != y or (self.every and a != b):
            self.made.append((a, b))


class Region:
    """Exact recursive join of a list of sets: links that connect what all links connect, or every link (some twice)."""

    def __init__(self, sets: list[np.ndarray], t: int, every: bool = False):
        self.t, self.n = t, np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        values, self.flat = np.unique(flat, return_inverse=True)
        self.starts = np.concatenate(([0], np.cumsum(self.n)))
        self.mark = np.zeros(len(values) + 1, np.int32)
        self.links = Links(len(sets), every)

    def overlaps(self, pivot: int, members: np.ndarray) -> np.ndarray:
        own = self.flat[self.starts[pivot] : self.starts[pivot + 1]]
        self.mark[own] = 1
        if 3 * len(members) > len(self.n):
            found = np.add.reduceat(self.mark[self.flat], self.starts[:-1])[members]
        else:
            found = np.array([self.mark[self.flat[self.starts[m] : self.starts[m + 1]]].sum() for m in members], np.int64)
        self.mark[own] = 0
        return found

    def measured(self, pivot: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Jaccard distances of the members from the pivot, and which of them link with it."""
        both = self.overlaps(pivot, members)
        either = self.n[pivot] + self.n[members] - both
        return 1 - both / either, 100 * both >= self.t * either

    def distances(self, pivot: int, members: np.ndarray) -> np.ndarray:
        """Jaccard distances; members that link with the pivot are linked."""
        found, linked = self.measured(pivot, members)
        for m in members[linked]:
            self.links.link(pivot, int(m))
        return found

    def unite(self, labels: list) -> None:
        """Members of equal labels are connected already, by links known elsewhere."""
        first: dict = {}
        for k, x in enumerate(labels):
            if x is not None:
                a, b = self.links.root(k), self.links.root(first.setdefault(x, k))
                self.links.up[max(a, b)] = min(a, b)

    def connected(self, members: np.ndarray) -> bool:
        """Whether no further link of these members is wanted."""
        return not self.links.every and len({self.links.root(int(m)) for m in members}) == 1

    def join(self, members: np.ndarray) -> None:
        if len(members) < 2 or self.connected(members):
            return
        eps = 1 - self.t / 100
        if len(members) <= LEAF:
            while len(members) > 1 and not self.connected(members):
                self.distances(int(members[0]), members[1:])
                members = members[1:]
            return
        pivots = members[:: max(1, len(members) // max(2, int(len(members) ** 0.5) // 2))]
        d = np.stack([self.distances(int(p), members) for p in pivots], axis=1)
        rest = ~np.isin(members, pivots)  # pivots have met all others
        members, d = members[rest], d[rest]
        if len(members) < 2 or self.connected(members):
            return
        near = d.min(axis=1)
        for k in range(len(pivots)):
            cell = members[d[:, k] <= near + 2 * eps + 1e-9]
            if len(cell) > 0.8 * len(members):  # the border windows hold nearly all: no use in cells
                order = np.argsort(self.n[members], kind="stable")
                self._sweep(members[order])
                return
        for k in range(len(pivots)):
            self.join(members[d[:, k] <= near + 2 * eps + 1e-9])

    def _sweep(self, members: np.ndarray) -> None:
        """One after the other as the pivot of those not much larger, in the order of sizes."""
        while len(members) > 1 and not self.connected(members):
            last = np.searchsorted(self.n[members], self.n[members[0]] * 100 / self.t, side="right")
            if last > 1:
                self.distances(int(members[0]), members[1:last])
            members = members[1:]


def _paired(rows: DataFrame, blocks: str, own: str, others: str, tag: str) -> DataFrame:
    """Rows with `tag`, the pairs of blocks that they meet in: block `own` with each of the first `others`, itself included.

    `blocks` is how many there are. A pair of blocks i <= j has a number of its own.
    """
    met = rows.withColumn("_with", F.explode(F.expr(f"sequence(0, {others} - 1)"))).withColumn("_own", F.expr(own))
    return met.withColumn(tag, F.expr(f"1 + least(_own, _with) * cast({blocks} as long) + greatest(_own, _with)").cast("long")).drop("_with", "_own")


def _plausible(members: DataFrame, vectors: DataFrame, t: int) -> DataFrame:
    """(region, cls): members with a partner within the window, in the region of those that windows connect.

    A region of up to BLOCK members is looked at by one task, a larger one in pairs of blocks. Regions of more than
    WINDOWED members stay whole; their members meet pivots.
    """
    sizes = members.groupBy("p").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    sizes = stored(sizes, "large_regions")  # at most one of BLOCK members: the rest is dealt by region, these are not
    large = members.join(sizes, "p")
    blocks = f"cast(ceil(size / {BLOCK}) as int)"
    paired = _paired(large.where(F.col("size") <= WINDOWED), blocks, f"pmod(xxhash64(cls), {blocks})", blocks, "part")
    rows = members.join(sizes, "p", "left_anti").select("p", F.lit(0).cast("long").alias("part"), "cls").unionByName(paired.select("p", "part", "cls")).join(vectors, "cls")

    def run(batches):
        for (p, part), rows in sorted_groups(batches, ["p", "part"]):
            cls = rows["cls"]
            groups, some = Links(len(cls)), np.zeros(len(cls), bool)
            for k, js in near_pairs(rows["vec"], np.array(rows["n"]), t):
                for j in js.tolist():
                    groups.link(k, j)
                    some[k] = some[j] = True
            least: dict[int, int] = {}
            found = np.flatnonzero(some).tolist()
            for k in found:
                r = groups.root(k)
                least[r] = min(least.get(r, cls[k]), cls[k])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p if part else least[groups.root(k)] for k in found], pa.int64()), pa.array([cls[k] for k in found], pa.int64())], ["region", "cls"])

    near = rows.select("p", "part", "cls", "n", "vec").repartition("p", "part").sortWithinPartitions("p", "part").mapInArrow(released(run), "region long, cls long")
    return near.union(large.where(F.col("size") > WINDOWED).select("p", "cls")).distinct()


def _matched(docs: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of the documents of which the id and the hash of the text (`h`) are in `wanted`.

    By both, so that null or repeated ids meet only their own text.
    """
    few = wanted.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(wanted) if few else wanted, (docs["h"] == wanted["h"]) & docs["id"].eqNullSafe(wanted["id"])).select(*columns)


def _sets(docs: DataFrame, wanted: DataFrame, keys: Keys) -> DataFrame:
    """(cls, set) of the classes of which a document's id and hash of its text are in `wanted` (id, h, cls): read again."""
    rows = _matched(docs.withColumn("h", F.xxhash64("text")), wanted, ["cls", "text"])

    def run(batches):
        seen: set[int] = set()  # rows that repeat an id and a text repeat a set
        for batch in batches:
            for part in byte_batches(batch):
                found = []
                for c, text in zip(part.column("cls").to_pylist(), part.column("text").to_pylist()):
                    if c not in seen and keys(own := shingles(text)) == c:
                        seen.add(c)
                        found.append((c, own.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["cls", "set"])

    return rows.mapInArrow(released(run), "cls long, set binary")


def _zipped(rows: DataFrame) -> DataFrame:
    """The rows with `zip` (compressed) and `size` in place of `text`; of equal rows that a task has, one."""
    rest = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches):
        codec, seen = pa.Codec("zstd", 1), set()
        for batch in batches:
            for part in byte_batches(batch):
                own = part.column("text").cast(pa.binary()).to_pylist()
                marks = list(zip(*(part.column(c).to_pylist() for c in rest), map(hash, own)))
                new = [k for k, mark in enumerate(marks) if mark not in seen and not seen.add(mark)]
                kept = part.take(pa.array(new, pa.int64()))
                packed = pa.array([codec.compress(own[k], asbytes=True) for k in new], pa.binary())
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in rest), packed, pa.array([len(own[k]) for k in new], pa.int32())], [*rest, "zip", "size"])

    return rows.mapInArrow(released(run), f"{schema}, zip binary, size int")


def _text_links(docs: DataFrame, wanted: DataFrame, keys: Keys, t: int, every: bool) -> DataFrame:
    """(a, b), a < b: the links of the cells of `wanted` (cell, cls, id, h), which tasks can hold, from the texts read again.

    A set's hashes take up more than twice its compressed text, so the texts go to the cells, by one shuffle and no table.
    """
    docs, columns = docs.withColumn("h", F.xxhash64("text")), ["cell", "cls"]
    if wanted.count() <= BROADCAST_ROWS:
        rows = _zipped(_matched(docs, wanted, [*columns, "text"]))
    else:  # the documents are shuffled by the join, compressed already
        rows = _matched(_zipped(docs.select("id", "h", "text")), wanted, [*columns, "zip", "size"])

    def run(batches):
        codec = pa.Codec("zstd")
        for _, rows in sorted_groups(batches, ["cell"]):
            own: dict[int, np.ndarray] = {}
            for c, packed, size in zip(rows["cls"], rows["zip"], rows["size"]):
                if c not in own and keys(s := shingles(codec.decompress(packed, size, asbytes=True).decode())) == c:
                    own[c] = s
            if len(own) > 1:
                yield from _made(list(own), Region(list(own.values()), t, every))

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(released(run), "a long, b long")


def _made(cls: list[int], region: Region):
    """The links of a region of these classes, as a batch if there are any."""
    region.join(np.arange(len(cls)))
    made = sorted({(min(cls[x], cls[y]), max(cls[x], cls[y])) for x, y in region.links.made if cls[x] != cls[y]})
    if made:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.int64()), pa.array([y for _, y in made], pa.int64())], ["a", "b"])


def _numbers(rows: dict[str, list]) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in rows["set"]]


def _split(cells: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """One level of the recursion for `cells` (cell, cls, size) of more than CELL classes.

    Rows (cell, cls, pivot, linked, into): each class with the cells that it goes to (`into`, by pivot; 0 for the cell
    of those far from all pivots) and whether it links with the pivot. A cell's pivots are those of its classes whose
    hash is lowest in a sense that needs no sort; its blocks get a copy of them each and are dealt out by cell and block.
    """
    blocks = F.ceil(F.col("size") / CELL).cast("int")
    drawn = F.pmod(F.xxhash64("cls", "cell"), F.col("size")) < PIVOTS
    rows = cells.withColumn("is_pivot", drawn.cast("int")).withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("blocks", blocks)
    both = rows.select("cell", "cls", F.lit(0).alias("is_pivot"), "block").union(rows.where("is_pivot = 1").select("cell", "cls", "is_pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    dealt = both.join(sets, "cls").repartition("cell", "block").sortWithinPartitions("cell", "block")
    eps = 1 - t / 100

    def run(batches):
        for (cell, _), rows in sorted_groups(batches, ["cell", "block"]):
            region = Region(_numbers(rows), t)
            pivots = dict.fromkeys(c for c, p in zip(rows["cls"], rows["is_pivot"]) if p)
            cls, first = np.unique(np.array(rows["cls"], np.int64), return_index=True)
            members = first[np.isin(cls, np.array([c for c, p in zip(rows["cls"], rows["is_pivot"]) if not p], np.int64))]
            names = np.array(rows["cls"], np.int64)[members]
            heads = sorted(pivots)
            at = {c: int(first[np.searchsorted(cls, c)]) for c in heads}
            if heads:
                d, linked = zip(*(region.measured(at[c], members) for c in heads))
                d, linked = np.stack(d, axis=1), np.stack(linked, axis=1)
                near = d.min(axis=1, keepdims=True)
                window = (d <= near + 2 * eps + 1e-9) & (d < 1)
                far = near[:, 0] >= 1 - eps - 1e-9
            else:  # drawn by chance: all are far from no pivot
                window = linked = np.zeros((len(names), 0), bool)
                far = np.ones(len(names), bool)
            i, k = np.nonzero(window | linked)
            pivot = np.append(np.array(heads, np.int64)[k] if heads else np.zeros(0, np.int64), np.zeros(far.sum(), np.int64))
            who = np.append(names[i], names[far])
            into = np.append(window[i, k], np.ones(far.sum(), bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), cell, np.int64)), pa.array(who), pa.array(pivot), pa.array(np.append(linked[i, k], np.zeros(far.sum(), bool))), pa.array(into)], ["cell", "cls", "pivot", "linked", "into"])

    return dealt.mapInArrow(released(run), "cell long, cls long, pivot long, linked boolean, into boolean")


def _by_second(cells: DataFrame, sets: DataFrame, shared, t: int) -> DataFrame:
    """(cell, cls): the classes of each cell in cells by a second shingle that they have in common.

    Sets of similarity t have two shingles in common among the first n - ceil(t n) + 2 of each. So a class goes to a cell
    for each of those, and as every linked pair meets in two of them, the largest cell is left out: that of a shingle
    which texts without anything else in common share.
    """

    def run(batches):
        known, ranks = (np.ascontiguousarray(shared.value[x]) for x in ("s", "rank"))
        for batch in batches:
            for cell, cls, own in zip(*(batch.column(c).to_pylist() for c in ("cell", "cls", "set"))):
                own = np.frombuffer(own, np.uint64)
                first, held = leading(own, prefix_length(len(own), t) + 1, known, ranks)
                second = np.append(first, known[held]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(second), cell)), pa.array(second), pa.array(np.full(len(second), cls))], ["cell", "s", "cls"])

    rows = stored(cells.select("cell", "cls").join(sets, "cls").mapInArrow(released(run), "cell long, s long, cls long").distinct(), "by_second")
    sizes = rows.groupBy("cell", "s").agg(F.count("*").alias("n")).where("n > 1")
    largest = sizes.groupBy("cell").agg(F.max_by("s", F.struct("n", "s")).alias("s"))
    kept = sizes.join(largest, ["cell", "s"], "left_anti").select("cell", "s")
    return rows.join(kept, ["cell", "s"]).select(F.xxhash64("cell", "s").alias("cell"), "cls")


def _cells(cells: DataFrame, sets: DataFrame, shared, t: int, every: bool) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(cell, part, cls, label): what each task joins, part by part; links (a, b) with pivots; tables that both are read from.

    Regions (cell, cls) are split by pivots until a task can hold them. Where a region's cells would hold more than three times its
    classes, or a cell nearly all of them, they meet in pairs of blocks (`part`); where nearly all are far from all
    pivots, they go by a second shingle first (once, or it might not end). A label is a pivot that the class
    links with: for components, classes of the region's commonest label don't meet among themselves.
    """
    cells = cells.select("cell", "cls", F.lit(False).alias("second"))
    done: list[DataFrame] = []
    links: list[DataFrame] = []
    tables: list[DataFrame] = []
    none = F.lit(None).cast("long").alias("label")
    while True:
        sizes = cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
        sized = cells.join(sizes, "cell")
        done.append(sized.where(F.col("size") <= CELL).select("cell", F.lit(0).cast("long").alias("part"), "cls", none))
        large = sized.where(F.col("size") > CELL)
        if large.isEmpty():
            return _union(done), links, tables
        large = stored(large, "large_cells")
        found = stored(_split(large, sets, t), "split_cells")
        size = large.groupBy("cell").agg(F.count("*").alias("size"), F.max("second").alias("second"))
        pivots = found.groupBy("cell", "pivot").agg(F.sum(F.col("into").cast("int")).alias("held"), F.sum(F.col("linked").cast("int")).alias("linked"))
        verdict = pivots.groupBy("cell").agg(F.sum("held").alias("sum"), F.max("held").alias("most"), F.max_by("pivot", F.struct("linked", "pivot")).alias("star"), F.max(F.when(F.col("pivot") == 0, F.col("held"))).alias("far")).join(size, "cell")
        lonely = F.expr("not second and coalesce(5 * far > 4 * size, false)")
        verdict = stored(verdict.select("cell", "size", "star", lonely.alias("lonely"), (~lonely & F.expr("sum > 3 * size or 5 * most > 4 * size")).alias("whole"), "second"), "verdicts")
        tables += [large, found, verdict]
        # cells of use: regions of the next level
        cells = found.where("into").join(verdict.where("not whole and not lonely").select("cell", "second"), "cell").select(F.xxhash64("cell", "pivot").alias("cell"), "cls", "second")
        if not verdict.where("lonely").isEmpty():
            alone = large.join(verdict.where("lonely").select("cell"), "cell")
            cells = cells.unionByName(_by_second(alone, sets, shared, t).withColumn("second", F.lit(True)))
        cells = stored(cells, "cells")
        tables.append(cells)
        labels = found.where("linked").groupBy("cell", "cls").agg(F.min("pivot").alias("least"), F.collect_set("pivot").alias("all"))  # PIVOTS or so
        if every:
            made = found.where("linked").select(F.col("cls").alias("x"), F.col("pivot").alias("y"))
        else:  # what connects the same: a class with one of its pivots, and that with the class's others
            made = labels.select(F.col("cls").alias("x"), F.col("least").alias("y")).union(labels.select(F.col("least").alias("x"), F.explode("all").alias("y")).distinct())
        links.append(made.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        # no use: pairs of blocks; a block of the commonest label meets only blocks of the others
        rest = large.select("cell", "cls").join(verdict.where("whole"), "cell").join(labels, ["cell", "cls"], "left")
        rest = rest.withColumn("main", F.lit(False) if every else F.coalesce(F.array_contains("all", F.col("star")), F.lit(False)))
        rest = rest.select("cell", "cls", "main", none if every else F.when(F.col("main"), F.col("star")).otherwise(F.col("least")).alias("label"))
        count = rest.groupBy("cell").agg(F.sum(F.col("main").cast("int")).alias("n_main"), F.sum((~F.col("main")).cast("int")).alias("n_other"))
        count = count.select("cell", F.ceil(2 * F.col("n_main") / CELL).cast("int").alias("b_main"), F.ceil(2 * F.col("n_other") / CELL).cast("int").alias("b_other"))
        rest = rest.join(count, "cell").where("b_other > 0")
        # blocks are numbered from 0, those of the others first
        own = "if(main, b_other + pmod(xxhash64(cls), greatest(b_main, 1)), pmod(xxhash64(cls), greatest(b_other, 1)))"
        done.append(_paired(rest, "b_other + b_main", own, "if(main, b_other, b_other + b_main)", "part").select("cell", "part", "cls", "label"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df)
    return out


def _links(cells: DataFrame, sets: DataFrame, t: int, every: bool) -> DataFrame:
    """(a, b): links that connect just what the links of each cell connect, or every link, a < b."""
    rows = cells.join(sets, "cls").repartition("cell", "part").sortWithinPartitions("cell", "part")

    def run(batches):
        for _, rows in sorted_groups(batches, ["cell", "part"]):
            cls = rows["cls"]
            if len(set(cls)) > 1:
                region = Region(_numbers(rows), t, every)
                region.unite(rows["label"])
                yield from _made(cls, region)

    return rows.mapInArrow(released(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(cls, label): the least class of each component of links (a, b).

    Stars are pointed at their least neighbours and labels at their labels' labels, so the rounds grow with the
    logarithm of a chain's length. Each step is a written table, whose size is known when the next one is planned, so that
    a hub's links or a large component's members don't meet in one task where the other side is small; where it is
    not, such a join can be split. Rows are pre-aggregated by vertex before a shuffle.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        # hook: a vertex takes its neighbours' least label, and so does the vertex that its label names
        seen = both.join(labels.withColumnRenamed("a", "v"), both["b"] == F.col("v")).groupBy(both["a"]).agg(F.min("label").alias("near"))
        low = stored(labels.join(seen, "a").select("a", "label", F.least("label", "near").alias("low")), "low")
        hooks = low.groupBy(F.col("label").alias("a")).agg(F.min("low").alias("hook"))
        hooked = stored(low.join(hooks, "a", "left").select("a", "label", F.least("low", F.coalesce("hook", "low")).alias("low")), "hooked")
        # jump: take the label's label, of labels that aren't their own
        tops = stored(hooked.where("a <> low").select(F.col("a").alias("top"), F.col("low").alias("top_low")), "tops")
        new = stored(hooked.join(tops, hooked["low"] == tops["top"], "left").select("a", F.least("low", F.coalesce("top_low", "low")).alias("new"), "label"), "labels")
        freed(labels, low, hooked, tops)
        labels = new.select("a", F.col("new").alias("label"))
        labels.stored_at = new.stored_at
        if new.where("new <> label").isEmpty():
            freed(both)
            return labels.withColumnRenamed("a", "cls")


#: Rounds in which sets that a key confuses get others; keys that may be taken so.
ROUNDS, TAKEN = 16, 1_000_000


def _classes(rows: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame, Keys]:
    """Profiles, classes (cls, id, n, vec, and id and h of a row) and the keys, under which no two different sets meet.

    Sets that a key would confuse differ in size or vector, which is looked at for every class. Only they get other keys:
    of n sets some n * n / 2^65 pairs, whose keys all tasks know then, so that a second round is nearly always the last.
    """
    taken: set[int] = set()
    for _ in range(ROUNDS):
        keys = Keys(frozenset(taken), bits)
        found = stored(_profiles(rows, keys), "profiles")
        mark, of = F.xxhash64("vec"), F.min(F.struct("h", "id"))
        own = found.where("n > 0").groupBy("cls").agg(F.min("id").alias("id"), of.alias("of"), F.first("n").alias("n"), F.first("vec").alias("vec"), F.min(F.struct("n", mark)).alias("x"), F.max(F.struct("n", mark)).alias("y"))
        classes = stored(own.withColumn("clash", F.col("x") != F.col("y")).drop("x", "y"), "classes")
        clashes = classes.where("clash").select("cls").limit(TAKEN + 1).toArrow().column("cls").to_pylist()
        if not clashes:
            own = classes.drop("clash")
            own.stored_at = classes.stored_at
            return found, own, keys
        taken.update(clashes)
        if len(taken) > TAKEN:
            break
        freed(found, classes)
    raise RuntimeError("no keys keep all sets apart")


def _join(rows: DataFrame, similarity: int, every: bool, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles (id, n, cls), classes (cls, id) and links (a, b) between classes."""
    spark = rows.sparkSession
    found, classes, keys = _classes(rows, bits)
    often = found.where("s is not null").groupBy("s").agg(F.sum("c").alias("c"), F.min("cls").alias("p")).orderBy(F.desc("c"), "s").limit(MOST_OFTEN).select("s", "p").toArrow()
    profiles = stored(found.where("n is not null").select("id", "n", "cls"), "ids")
    freed(found)
    frequent = np.empty(often.num_rows, dtype=[("s", np.uint64), ("rank", np.int64), ("p", np.int64)])
    frequent["s"], frequent["rank"], frequent["p"] = often.column("s").to_numpy().view(np.uint64), np.arange(often.num_rows, 0, -1), often.column("p").to_numpy()
    shared = spark.sparkContext.broadcast(np.sort(frequent, order="s"))
    del often, frequent
    total = classes.agg(F.sum(F.expr(f"n - (({similarity} * n + 99) div 100) + 1"))).first()[0] or 0
    buckets = min(1 << 24, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET))
    members = stored(_regions(_postings(rows, shared, similarity, buckets, keys)), "members")
    plausible = stored(_plausible(members, classes.select("cls", "n", "vec"), similarity), "plausible")
    freed(members)
    of = stored(classes.select("cls", "id", "of"), "classes")
    freed(classes)
    sized = plausible.groupBy("region").agg(F.count("*").alias("size")).where("size > 1")
    cells = stored(plausible.join(sized, "region").select(F.col("region").alias("cell"), "cls", "size"), "cells")
    freed(plausible)
    # what a task can hold is joined on the texts, the rest goes down in regions of sets
    wanted = stored(cells.where(F.col("size") <= CELL).join(of, "cls").select("cell", "cls", "of.id", "of.h"), "wanted")
    near = stored(_text_links(rows, wanted, keys, similarity, every), "near")
    tables, parts = [cells, wanted, near], [near]
    large = cells.where(F.col("size") > CELL)
    if not large.isEmpty():
        wanted = stored(large.select("cls").distinct().join(of, "cls").select("cls", "of.id", "of.h"), "wanted")
        sets = stored(_sets(rows, wanted, keys), "sets")
        split, more, own = _cells(large, sets, shared, similarity, every)
        parts += [_links(split, sets, similarity, every), *more]
        tables += [wanted, sets, *own]
    links = stored(_union(parts).distinct(), "links")
    freed(*tables)
    shared.destroy()
    release_memory()
    return profiles, of.select("cls", "id"), links


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = 80) -> tuple[DataFrame, DataFrame]:
    """The whole join: (id, n_shingles, cls) for every row, and every link between classes as (a, b), a < b, once.

    Rows of equal sets are one class and link with each other; two rows of different classes link as their classes do.
    Rows without words have a null class. Links, ids, null and repeated rows are those of `jaccard_components`.
    """
    profiles, _, links = _join(texts(docs, id_col, text_col), similarity, True)
    return profiles.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("cls")), links


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = 80) -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id that links reach, itself included).

    Two rows link if 100 * |A & B| >= similarity * |A | B| for their sets of distinct 5-word shingles (A-Z in lower
    case; of fewer words the whole sequence). Rows without words, null texts included, have no set and link with
    nothing. A row with a null id gets its component's least id that isn't null, or null. Repeated rows link with each
    other; an empty table gives none; other columns are ignored. A very long text is one set, which one task holds.
    """
    profiles, classes, links = _join(texts(docs, id_col, text_col), similarity, False)
    labels = components(links)
    lowest = labels.join(classes.select("cls", "id"), "cls").groupBy("label").agg(F.min("id").alias("lowest"))
    placed = labels.join(lowest, "label").select("cls", "lowest")
    own = stored(classes.select("cls", "id").join(placed, "cls", "left").select("cls", F.coalesce("lowest", "id").alias("component_id")), "placed")
    joined = profiles.select("id", "n", "cls").join(own, "cls", "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
