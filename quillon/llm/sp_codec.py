"""SentencePiece encoding and decoding by a merge-type prefix table.

For each prefix of a piece of text the table keeps the one token that ends the prefix's encoding. The candidates are
the vocabulary's matches that end there (an Aho-Corasick automaton); a candidate fits if it and the last token of
the prefix before it are compatible, that is, if the merges of their joined text give just those two tokens again.
The ids are then recovered backwards from the table's end. Unknown characters become their UTF-8 bytes' tokens.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _chunks
from ._shared import released, texts

SPACE = "▁"
_workers: dict = {}


class PrefixTable:
    """Vocabulary, automaton and pair tests of one .model file of merge type with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.id, self.score, self.bytes, self.byte_id = {}, {}, [], {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            elif lib.is_control(i) or lib.is_unknown(i):
                self.bytes.append(b"" if lib.is_control(i) else b" \xe2\x81\x87 ")
            else:
                self.id[piece], self.score[piece] = i, lib.get_score(i)
                self.bytes.append(piece.replace(SPACE, " ").encode())
        self.spaced = frozenset(i for p, i in self.id.items() if p.startswith(SPACE))
        # the order in which merges happen; equal scores have equal ranks
        order = {x: k for k, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: order[x] if len(p) > 1 else -1 for p, x in self.score.items()}
        self.tied = frozenset(p for p in self.id if len(p) > 1 and p.strip(SPACE) == "")
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.start: dict = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.id:
            self.automaton.add_word(piece, (piece, len(piece), {}))  # the dict: which pieces may follow
        self.automaton.make_automaton()
        self.chars = frozenset(p for p in self.id if len(p) == 1)
        fine = re.compile(f"{SPACE}*[{_chunks.LATIN}]+|{SPACE}*[^{SPACE}{_chunks.LATIN}]+|{SPACE}+")
        coarse = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        # a pattern may be used only if it cuts no piece of the vocabulary
        self.split = next((p.findall for p in (fine, coarse) if all(len(p.findall(x)) == 1 for x in self.id)), lambda s: [s] if s else [])

    def merged(self, text: str) -> list[str]:
        """The merges' result for a short text: the pair of the best score first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((s, -k) for k in range(len(parts) - 1) if (s := self.score.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return parts
            k = -best[1]
            if len(parts) == 2:
                self.halves[text] = (parts[0], parts[1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def alone(self, piece: str) -> bool:
        """Whether the merges make this one piece of its own text; notes the two parts merged last."""
        if piece not in self.halves:
            whole = len(piece) == 1 or self.merged(piece) == [piece]
            self.halves[piece] = (self.halves[piece] if len(piece) > 1 else ("", "")) if whole else None
        return self.halves[piece] is not None

    def fits(self, left: str, right: str) -> bool:
        """Whether the merges leave the two pieces side by side; left "" stands for the start.

        Undoes the merges of both, the latest first: no pair across the border may merge before the undone one.
        """
        if not self.alone(right) or left and not self.alone(left):
            return False
        if not left:
            return True
        if left in self.tied or right in self.tied or left[-1] == right[0] == SPACE:
            return self.merged(left + right) == [left, right]
        limit = len(self.rank)
        while True:
            if self.rank.get(left + right, limit) < limit:
                return False
            a, b = self.rank[left], self.rank[right]
            if a == b == -1:
                return True
            if a > b:
                limit = a
                self.alone(left)
                left = self.halves[left][1]
            else:
                limit = b + 1
                self.alone(right)
                right = self.halves[right][0]

    def chunk(self, text: str) -> tuple[int, ...]:
        """The ids of a piece of text in which spaces are written as SPACE."""
        if not self.chars.issuperset(text):
            # characters without a piece merge with nothing: they part the text
            ids: list[int] = []
            for known, part in itertools.groupby(text, self.chars.__contains__):
                part = "".join(part)
                ids.extend(self.chunk(part) if known else [self.byte_id[b] for b in part.encode()])
            return tuple(ids)
        n = len(text)
        last: list = [("", 0, self.start)] + [None] * n
        for end, match in self.automaton.iter(text):
            if last[end + 1] is None:
                piece, size, _ = match
                left, _, follow = last[end + 1 - size]
                ok = follow.get(piece)
                if ok is None:
                    ok = follow[piece] = self.fits(left, piece)
                if ok:
                    last[end + 1] = match
        ids = []
        while n:
            piece, size, _ = last[n]
            ids.append(self.id[piece])
            n -= size
        return tuple(reversed(ids))

    def prepared(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(self.prepared(text)) for i in self.chunk(piece)]

    def decode(self, ids) -> bytes:
        """The text of `ids` in UTF-8; the leading space goes; bytes that are no UTF-8 become U+FFFD one by one."""
        out = b"".join(map(self.bytes.__getitem__, ids))
        first = next((i for i in ids if self.bytes[i]), None)
        if first in self.spaced:
            out = out[1:]
        try:
            out.decode()
            return out
        except UnicodeDecodeError:
            return out.decode(errors="surrogateescape").encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()


def prefix_table(path: str) -> PrefixTable:
    if path not in _workers:
        _workers[path] = PrefixTable(path)
    return _workers[path]


def _encoded(table: PrefixTable, text: str, cache: _chunks.Cache):
    found = cache.of(table.split(table.prepared(text)))
    return [i for ids, _ in found for i in ids], "".join([s for _, s in found])[:-1]


def sp_encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """Ids of whole texts, then their decoding: id, n_tokens, ids (array), ids_sha256, decoded, decoded_sha256.

    With `digests_only` the arrays and decoded texts, as large as the input, stay in the worker. A null or empty text
    has no ids and decodes to the empty text; null ids and repeated rows are kept; an empty table gives none;
    other columns are ignored, whatever their names. A very long text is encoded whole, by one task.
    """
    rows = texts(docs, id_col, text_col)

    def run(batches):
        table = prefix_table(model_path)
        cache = _chunks.Cache(lambda pieces: [(ids, "".join([f"{i}," for i in ids])) for ids in map(table.chunk, pieces)])
        for batch in batches:
            for part in _chunks.byte_batches(batch):
                out: list[list] = [[], [], [], [], []]
                for text in part.column("text").to_pylist():
                    ids, joined = _encoded(table, text, cache)
                    decoded = table.decode(ids)
                    for column, value in zip(out, (len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest(), None if digests_only else ids, None if digests_only else decoded.decode())):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(released(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")
    found = found.withColumnRenamed("id", id_col)
    return found.drop("ids", "decoded") if digests_only else found


def sp_decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The decoded text of each row's array of ids (null: empty), as the library's decode(ids) gives it."""
    rows = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        table = prefix_table(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([table.decode(x).decode() for x in batch.column("ids").to_pylist()], pa.string())], ["id", "decoded"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"id {kind}, decoded string").withColumnRenamed("id", id_col)
