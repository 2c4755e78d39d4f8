"""Splits texts where no tokenizer's token can reach across, so that each piece's encoding can be cached.

The patterns below are coarser than the tokenizers' own: every boundary they set is one of theirs as well.
A text with characters outside `_PLAIN` gets the coarser of two patterns, one with unusual spaces none at all.
"""

from __future__ import annotations

import re

#: Latin letters only; every character of it is a letter for all tokenizers here.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_PUNCT = "¡£§©«»¿–—‘’“”…€"
#: Not plain: other characters, the apostrophe (contractions) and control characters that count as spaces for some.
ODD = re.compile(f"[^\t\n\r\x20-\x26\x28-\x7e{LATIN}{_PUNCT}]")
#: Spaces on which Python's and the tokenizers' ideas differ.
STRANGE = re.compile("[\x0b\x0c\x1c-\x1f\x85  ᠎ -​    ⁠　﻿]")

#: White space is dropped by the tokenizer.
WORDS_FINE = re.compile(f"[{LATIN}]+|[^\\s{LATIN}]+").findall
WORDS_COARSE = str.split
#: White space is kept; one space may belong to the word after it.
SPACED_FINE = re.compile(f" ?[{LATIN}]+| ?[^ \t\n\r{LATIN}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+").findall
SPACED_COARSE = re.compile(" ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+").findall


def split(text: str, fine, coarse) -> list[str]:
    if "<|" not in text and ODD.search(text) is None:  # "<|": special tokens of the vocabularies begin so
        return fine(text)
    return coarse(text) if STRANGE.search(text) is None else [text]


class Cache(dict):
    """Encodings by piece, in two generations; `encode` gets the missing pieces as one list. Long pieces are not kept.

    When half of `most` is reached, the pieces of the generation before go, but for those used since.
    """

    def __init__(self, encode, most: int = 800_000, longest: int = 48):
        super().__init__()
        self.encode, self.half, self.longest, self.old = encode, most // 2, longest, {}

    def of(self, pieces: list[str]) -> list:
        found = list(map(self.get, pieces))
        if None in found:
            old = self.old
            new = {p: old.get(p) for p, f in zip(pieces, found) if f is None}
            missing = [p for p, f in new.items() if f is None]
            new.update(zip(missing, self.encode(missing)))
            self.update((p, f) for p, f in new.items() if len(p) <= self.longest)
            if len(self) > self.half:
                self.old = dict(self)
                self.clear()
            found = [new[p] if f is None else f for p, f in zip(pieces, found)]
        return found


def byte_batches(batch, most: int = 8 << 20):
    """Slices of an Arrow batch with a `text` column, of about `most` bytes of text each."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column("text")).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
