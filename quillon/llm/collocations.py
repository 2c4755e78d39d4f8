"""Collocations of a corpus: exact counts of phrases by compressed position bitmaps, scored by their weakest cut.

Texts of a language are laid end to end in shards; every token has a position, and between pieces one stays empty, so
that no phrase crosses them. A word's bitmap is kept as the bytes of it that aren't zero (block and mask). A phrase is
extended by shifting its bitmap one place, cutting it (AND) with the words' bitmaps of the same blocks, and counting bits.
Counts of shards are summed by Spark. Roots are taken in lots, each to its full depth before the next.

Every word of a phrase, and every pair of neighbours in it, is at least as frequent as the phrase. So the first pass counts
pairs of frequent words, the second only follows frequent pairs; both are exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbering import numbered
from ._shared import freed, released, sorted_groups, stored

LONGEST = 5
#: Bytes of text in a shard, unless one text is longer.
SHARD = 12 << 20
#: Of all languages' open shards in a task.
OPEN = 48 << 20
#: Frequent words and pairs (8 bytes each) that are sent to all tasks at most; of more, shards get their own by joins.
WORDS_SENT, PAIRS_SENT = 1 << 20, 1 << 20
#: Cuts of bitmaps that are held at once.
LOT = 1 << 21
#: Occurrences of frequent words to a bucket in which counts of phrases are summed.
BUCKET = 1 << 20
_BITS = 31
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

_SHARD_SCHEMA = "shard long, lang string, words array<string>, lengths array<int>, blocks binary, masks binary"


# --- shards: texts to words' bitmaps -------------------------------------------------------------------------------


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: 0 in words, 1 between words, 2 between pieces; and the byte with A-Z in lower case."""
    kind, low = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    kind[[0x20, 0x09]] = 1
    kind[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
    low[0x41:0x5B] += 32
    return kind, low


def shard_bitmaps(texts: list[bytes]):
    """(words, counts, lengths, blocks, masks) of UTF-8 texts: a word's bitmap is its next `lengths` blocks and masks."""
    import pyarrow as pa

    kinds, lower = _classes()
    raw = np.frombuffer(b".".join(texts), np.uint8)
    kind = kinds[raw]
    edges = np.diff(np.concatenate(([0], (kind == 0).view(np.int8), [0])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    position = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(piece[1:] != piece[:-1])))
    data, offsets = lower[raw[kind == 0]], np.concatenate(([0], np.cumsum(ends - starts)))
    tokens = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
    coded = tokens.dictionary_encode()
    words = coded.indices.to_numpy()
    order = np.argsort(words, kind="stable")
    word, block, bit = words[order], position[order] >> 3, np.left_shift(1, position[order] & 7).astype(np.uint8)
    first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (block[1:] != block[:-1]))))
    n = len(coded.dictionary)
    return coded.dictionary, np.bincount(words, minlength=n), np.bincount(word[first], minlength=n).astype(np.int32), block[first].astype(np.uint32), np.bitwise_or.reduceat(bit, first)


def _by_shard(batches, run):
    """What `run(language, number of the shard, texts)` yields for the shards that a task's texts make."""
    from pyspark import TaskContext

    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    number = TaskContext.get().partitionId() << 32

    def closed(lang: str):
        nonlocal number
        del sizes[lang]
        number += 1
        return run(lang, number, held.pop(lang))

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = text.encode()
            held.setdefault(lang, []).append(raw)
            sizes[lang] = sizes.get(lang, 0) + len(raw) + 1
            if sizes[lang] >= SHARD:
                yield from closed(lang)
            elif sum(sizes.values()) >= OPEN:
                yield from closed(max(sizes, key=sizes.get))
    for lang in list(held):
        yield from closed(lang)


def _word_batches(batches):
    """lang, word, n of each shard."""
    import pyarrow as pa

    def run(lang, number, texts):
        words, counts, *_ = shard_bitmaps(texts)
        yield pa.RecordBatch.from_pydict({"lang": pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(words), np.int32)), [lang]).cast(pa.string()), "word": words.cast(pa.string()), "n": counts.astype(np.int64)})

    yield from _by_shard(batches, run)


def _shard_batches(batches):
    import pyarrow as pa

    def run(lang, number, texts):
        words, counts, lengths, blocks, masks = shard_bitmaps(texts)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(x) if isinstance(x, np.ndarray) else x.cast(pa.string())) for x in (words, lengths)]
        arrays = [pa.array([number]), pa.array([lang]), *lists, pa.array([blocks.tobytes()], pa.binary()), pa.array([masks.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["shard", "lang", "words", "lengths", "blocks", "masks"])

    yield from _by_shard(batches, run)


# --- extension: shift, AND, popcount -------------------------------------------------------------------------------


class Bitmaps:
    """A shard's frequent words: their bitmaps by word for roots, by block for extension."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, blocks: np.ndarray, masks: np.ndarray):
        self.ids, self.word, self.block, self.mask = ids, np.repeat(np.arange(len(ids)), lengths), blocks.astype(np.int64), masks
        order = np.argsort(self.block, kind="stable")
        self.at_word, self.at_mask = self.word[order], masks[order]
        top = int(self.block.max(initial=0)) + 2
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(self.block, minlength=top + 1))))

    def lots(self):
        """Runs of roots whose cuts fit in a lot, as (word, block, mask)."""
        cuts = np.cumsum(self.starts[self.block + 2] - self.starts[self.block])
        begin = 0
        while begin < len(self.word):
            end = int(np.searchsorted(cuts, (cuts[begin - 1] if begin else 0) + LOT, "right"))
            if end < len(self.word):  # a root stays whole
                end = int(np.searchsorted(self.word, self.word[end]))
                end = end if end > begin else int(np.searchsorted(self.word, self.word[begin], "right"))
            yield self.word[begin:end], self.block[begin:end], self.mask[begin:end]
            begin = end

    def extended(self, phrase: np.ndarray, block: np.ndarray, mask: np.ndarray, last: np.ndarray, allowed: np.ndarray | None):
        """Every phrase (a number of `last`, its last word) with every word that follows it: parent, word, count; and bitmaps.

        With `allowed`, only by pairs of ids (first << 31 | second) in this sorted array.
        """
        over = mask >> 7 != 0
        phrase, block, mask = np.concatenate((phrase, phrase[over])), np.concatenate((block, block[over] + 1)), np.concatenate((mask << 1, np.ones(int(over.sum()), np.uint8)))
        n = self.starts[block + 1] - self.starts[block]
        row = np.repeat(np.arange(len(block)), n)
        place = np.arange(len(row)) + np.repeat(self.starts[block] - (np.cumsum(n) - n), n)
        cut = mask[row] & self.at_mask[place]
        hit = np.flatnonzero(cut)
        row, word, cut = row[hit], self.at_word[place[hit]], cut[hit]
        if allowed is not None:
            pair = self.ids[last[phrase[row]]] << _BITS | self.ids[word]
            fit = np.flatnonzero(allowed[np.minimum(np.searchsorted(allowed, pair), len(allowed) - 1)] == pair) if len(allowed) else []
            row, word, cut = row[fit], word[fit], cut[fit]
        key = phrase[row] * len(self.ids) + word
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        counts = np.add.reduceat(np.bitwise_count(cut[order]).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        number = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(key)]))))
        return key[first] // max(1, len(self.ids)), key[first] % max(1, len(self.ids)), counts, (number, block[row][order], cut[order])

    def pairs(self):
        """(first id << 31 | second id, count) of all pairs."""
        words = np.arange(len(self.ids))
        for lot in self.lots():
            parent, word, counts, _ = self.extended(*lot, words, None)
            yield self.ids[parent] << _BITS | self.ids[word], counts

    def phrases(self, allowed: np.ndarray):
        """(ids of a row each, count) of all phrases of three words and more by allowed pairs."""
        words = np.arange(len(self.ids))
        for lot in self.lots():
            last, own, table = words, words[:, None], lot
            for size in range(2, LONGEST + 1):
                parent, word, counts, table = self.extended(*table, last, allowed)
                if not len(word):
                    break
                last, own = word, np.column_stack((own[parent], word))
                if size > 2:
                    yield self.ids[own], counts


def _chosen(lengths: np.ndarray, places: np.ndarray, ids: np.ndarray, blocks: np.ndarray, masks: np.ndarray) -> Bitmaps:
    """The bitmaps of the words at `places` (ascending) of all of a shard's."""
    ends, own = np.cumsum(lengths, dtype=np.int64), lengths[places]
    at = np.arange(own.sum()) + np.repeat(ends[places] - own - (np.cumsum(own) - own), own)
    return Bitmaps(ids.astype(np.int64), own, blocks[at], masks[at])


def _of_row(batch, k: int) -> Bitmaps:
    """The bitmaps of a stored shard's frequent words, of row `k` of a batch with `places` and `ids`."""
    lists = {c: batch.column(c)[k].values.to_numpy() for c in ("lengths", "places", "ids")}
    order = np.argsort(lists["places"])
    blocks, masks = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in (("blocks", np.uint32), ("masks", np.uint8)))
    return _chosen(lists["lengths"], lists["places"][order], lists["ids"][order], blocks, masks)


def _of_texts(sent, lang: str, texts: list[bytes]) -> Bitmaps:
    """The bitmaps of a shard's frequent words by what was sent: language to (first id, words in the order of ids)."""
    import pyarrow.compute as pc

    words, _, lengths, blocks, masks = shard_bitmaps(texts)
    first, known = sent.value.get(lang, (0, words[:0]))
    found = pc.index_in(words.cast(known.type), value_set=known)
    places = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    return _chosen(lengths, places, found.drop_null().to_numpy() + first, blocks, masks)


def _pair_rows(own: Bitmaps, shard: int):
    """shard, pair of each pair of a shard."""
    import pyarrow as pa

    for pair, _ in own.pairs():
        yield pa.RecordBatch.from_pydict({"shard": np.full(len(pair), shard), "pair": pair})


def _packed(found, buckets: int):
    """Phrases (ids of a row each) and counts, packed by buckets of a hash of the ids: bucket, width, ids and n."""
    import pyarrow as pa

    for ids, counts in found:
        ids = ids.reshape(len(counts), -1)
        mixed = (ids.astype(np.uint64) * _MIX[: ids.shape[1]]).sum(axis=1)
        bucket = ((mixed ^ mixed >> np.uint64(29)) * _MIX[0] >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        own, n = np.unique(bucket, return_counts=True)
        cut = np.append(0, np.cumsum(n))

        def binary(x: np.ndarray, width: int, cut=cut) -> pa.Array:
            return pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer((cut * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())

        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), ids.shape[1], np.int32)), binary(ids[order], 8 * ids.shape[1]), binary(counts[order].astype(np.int64), 8)], ["bucket", "width", "ids", "n"])


_PACKED = "bucket int, width int, ids binary, n binary"


def _summed(packed: DataFrame, least: int) -> DataFrame:
    """ids, a: the sums of packed counts that are at least `least`; a bucket and width is summed by one task."""

    def run(batches):
        import pyarrow as pa

        for (_, width), rows in sorted_groups(batches, ["bucket", "width"]):
            ids = np.frombuffer(b"".join(rows["ids"]), np.int64).reshape(-1, width)
            n = np.frombuffer(b"".join(rows["n"]), np.int64)
            order = np.lexsort(ids.T)
            ids = ids[order]
            first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(axis=1)))
            sums = np.add.reduceat(n[order], first)
            ids, sums = ids[first[sums >= least]], sums[sums >= least]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * width, pa.int32()), pa.array(ids.ravel()))
            yield pa.RecordBatch.from_arrays([lists, pa.array(sums)], ["ids", "a"])

    return packed.repartition("bucket", "width").sortWithinPartitions("bucket", "width").mapInArrow(released(run), "ids array<long>, a long")


def _rows_run(out):
    """`out(bitmaps, batch, row)` for the rows of stored shards."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield from out(_of_row(batch, k), batch, k)

    return released(run)


def _texts_run(sent, out):
    """`out(bitmaps)` for the shards of texts."""

    def run(batches):
        yield from _by_shard(batches, lambda lang, number, texts: out(_of_texts(sent, lang, texts)))

    return released(run)


# --- counts --------------------------------------------------------------------------------------------------------


def _sent_words(words: DataFrame):
    """Language to (first id, words in the order of ids), as a broadcast."""
    table = words.select("lang", "word", "id").toArrow().sort_by("id")
    langs = table.column("lang").dictionary_encode().combine_chunks()
    own, column = {}, table.column("word").combine_chunks()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        at = np.flatnonzero(langs.indices.to_numpy() == k)  # ids are in the order of languages
        own[lang] = int(at[0]), column.slice(int(at[0]), len(at))
    return words.sparkSession.sparkContext.broadcast(own)


def _with_lists(texts: DataFrame, words: DataFrame) -> DataFrame:
    """The shards of the texts, stored, with the places and ids of their frequent words: the way for any number of those."""
    shards = stored(texts.mapInArrow(released(_shard_batches), _SHARD_SCHEMA), "shards")
    own = shards.select("shard", "lang", F.posexplode("words").alias("place", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    lists = own.groupBy("shard").agg(F.collect_list(F.struct("place", "id")).alias("_known")).select("shard", F.col("_known.place").alias("places"), F.col("_known.id").alias("ids"))
    bitmaps = stored(shards.select("shard", "lengths", "blocks", "masks").join(lists, "shard"), "bitmaps")
    freed(shards)
    return bitmaps


def count_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, words_sent: int = WORDS_SENT, pairs_sent: int = PAIRS_SENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: lang, word, a, id; phrases: ids, a; totals: lang, n), all of at least `least` occurrences but the totals.

    Up to `words_sent` frequent words go to all tasks, which make the shards anew for each pass; of more, the stored shards
    are joined with them. Up to `pairs_sent` frequent pairs likewise. Both only choose how they get to the shards. The
    tables are written to the shared folder.
    """
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    counts = stored(texts.mapInArrow(released(_word_batches), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("a")), "counts")
    totals = stored(counts.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    words = stored(numbered(counts.where(F.col("a") >= least), [F.col("lang"), F.col("word")], "id"), "words")
    freed(counts)
    n = words.count()
    if n >= 1 << _BITS:
        raise ValueError(f"more than 2^{_BITS} frequent words")
    sent = _sent_words(words) if n <= words_sent else None
    bitmaps = _with_lists(texts, words) if sent is None else None
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (words.agg(F.sum("a")).first()[0] or 0) // BUCKET)
    pairs = texts.mapInArrow(_texts_run(sent, lambda own: _packed(own.pairs(), buckets)), _PACKED) if sent else bitmaps.mapInArrow(_rows_run(lambda own, batch, k: _packed(own.pairs(), buckets)), _PACKED)
    pairs = stored(_summed(pairs, least).select(F.col("ids")[0].alias("pair"), "a"), "pairs")
    allowed = None
    if pairs.count() <= pairs_sent:
        allowed = docs.sparkSession.sparkContext.broadcast(np.sort(pairs.select("pair").toPandas()["pair"].to_numpy(np.int64)))
    if allowed and sent:
        longer = texts.mapInArrow(_texts_run(sent, lambda own: _packed(own.phrases(allowed.value), buckets)), _PACKED)
    elif allowed:
        longer = bitmaps.mapInArrow(_rows_run(lambda own, batch, k: _packed(own.phrases(allowed.value), buckets)), _PACKED)
    else:
        bitmaps = bitmaps or _with_lists(texts, words)
        local = bitmaps.mapInArrow(_rows_run(lambda own, batch, k: _pair_rows(own, batch.column("shard")[k].as_py())), "shard long, pair long").join(pairs.select("pair"), "pair", "left_semi")
        known = bitmaps.join(local.groupBy("shard").agg(F.collect_list("pair").alias("allowed")), "shard")
        longer = known.mapInArrow(_rows_run(lambda own, batch, k: _packed(own.phrases(np.sort(batch.column("allowed")[k].values.to_numpy())), buckets)), _PACKED)
    longer = _summed(longer, least)
    both = pairs.select(F.array(F.shiftright("pair", _BITS), F.col("pair").bitwiseAND(F.lit((1 << _BITS) - 1))).alias("ids"), "a")
    phrases = stored(both.unionByName(longer), "phrases")
    for x in (sent, allowed):
        if x is not None:
            x.destroy()
    freed(pairs, *[x for x in [bitmaps] if x is not None])
    return words, phrases, totals


def _score(a: Column, n: Column, first: Column, rest: Column) -> Column:
    """floor(1000 * a * n / (first * rest)), by decimals of 38 digits."""
    up = (a * 1000).cast("decimal(18,0)") * n.cast("decimal(18,0)")
    down = first.cast("decimal(18,0)") * rest.cast("decimal(18,0)")
    return F.call_function("div", up, down).cast("long")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, share: int = 100, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of 2 to 5 words of each language that its words explain least.

    Texts have A-Z in lower case and are cut at `[.,;:!?\\x0A-\\x0D]` into pieces, those at spaces and tabs into words.
    A phrase has a >= `least` occurrences within pieces, overlapping ones too. Its score is the least, over all cuts into a
    first part and the rest with l and r occurrences, of floor(1000 * a * n / (l * r)); of equal cuts the earliest. A phrase
    inside a longer one with at least `share` hundredths of its occurrences goes. `top` of each language are returned.

    A null language is `und`; null and empty texts have no words; repeated rows count again; an empty table gives no row.
    A text that is longer than a shard is a shard of its own. Columns of any other name are ignored.
    """
    words, phrases, totals = count_phrases(docs, lang_col, text_col, least)
    named = phrases.select("ids", F.posexplode("ids").alias("place", "id")).join(words.select("id", "lang", "word"), "id")
    named = named.groupBy("ids").agg(F.first("lang").alias("lang"), F.array_join(F.array_sort(F.collect_list(F.struct("place", "word")))["word"], " ").alias("phrase"))
    known = phrases.unionByName(words.select(F.array("id").alias("ids"), "a"))
    cuts = phrases.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumn("_first", F.slice("ids", 1, F.col("k"))).withColumn("_rest", F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")))
    cuts = cuts.join(known.select(F.col("ids").alias("_first"), F.col("a").alias("l")), "_first").join(known.select(F.col("ids").alias("_rest"), F.col("a").alias("r")), "_rest")
    cuts = cuts.join(named, "ids").join(totals, "lang").withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = cuts.groupBy("ids").agg(F.min_by(F.struct("lang", "phrase", "a", "l", "r", "n", "score"), F.struct("score", "k")).alias("b"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("ids") - m + 1), lambda i: F.slice("ids", i, m))))
    inside = phrases.where(F.size("ids") > 2).select(F.explode(spans).alias("ids"), F.col("a").alias("f")).groupBy("ids").agg(F.max("f").alias("f"))
    left = best.join(inside, "ids", "left").where(F.col("f").isNull() | (100 * F.col("f") < share * F.col("b.a"))).select("b.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = left.withColumn("rank", rank)
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
