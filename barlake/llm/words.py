"""Ids of whole texts by the tokenizers library, with words looked up before they are encoded.

The library encodes each word of its pre-tokenizer by itself, so the ids of a text are the ids
of its words in turn. Words repeat, and a dictionary lookup costs a small part of an
encoding. New words of a batch go to the library together, those that begin with their only space
as parts of longer texts: there a token that begins with a space begins a word.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
from tokenizers import Tokenizer

from barlake.llm.bpe import PLAIN, Pieces

CACHE_WORDS = 900_000  # words kept per worker before the dictionary starts anew
SPACE = "\u0120"  # the space in byte-level vocabularies
JOINED = 1000  # new words that are encoded as one text
# Characters of texts that are split by the pre-tokenizer's own rule.
ODD = re.compile(PLAIN.pattern.replace("\x00-\x1b\x20", "\x01-\x08\n\x0e-\x1b\x20"))


class LibraryCodec:
    """For tokenizer files without a normalizer, with byte-level words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        if self.library.normalizer is not None:
            raise ValueError("words of a normalized text cannot be looked up by themselves")
        self.pieces = Pieces(space_joins=True)
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(
            special, key=len, reverse=True))) + ")") if special else None
        self.width = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.fixed = {t: np.array([i], dtype="<u4").tobytes() for t, i in special.items()}
        self.known = dict(self.fixed)
        self.joins = not any(" " in t for t in special)
        self.begins = np.zeros(self.library.get_vocab_size(), dtype=bool)
        self.begins[[i for t, i in self.library.get_vocab().items() if t.startswith(SPACE)]] = True

    def words(self, text: str) -> list[str]:
        """Parts of the text that the library encodes by themselves: runs between spaces, each
        with the space before it, where no two white-space characters meet at a space; else
        the words of its pre-tokenizer."""
        if self.special is not None and self.special.search(text):
            return [w for part in self.special.split(text) if part
                    for w in ([part] if part in self.fixed else self._parts(part))]
        return self._parts(text)

    def _parts(self, text: str) -> list[str]:
        if (ODD.search(text) or "  " in text or " \n" in text or "\n " in text):
            return self.pieces(text)
        return text.replace(" ", "\0 ").split("\0")

    def encode_all(self, texts: Iterable[str | None], at_once: int = 256) -> Iterable[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null: none."""
        texts = [t or "" for t in texts]
        for k in range(0, len(texts), at_once):
            if len(self.known) > CACHE_WORDS:
                self.known = dict(self.fixed)
            known = self.known
            split = [self.words(t) for t in texts[k:k + at_once]]
            self._learn(set(filterfalse(known.__contains__, chain.from_iterable(split))))
            for words in split:
                yield b"".join(map(known.__getitem__, words))

    def _learn(self, new: Iterable[str]) -> None:
        joined, single = [], []
        for w in new:
            plain = self.joins and len(w) > 1 and w[0] == " " and w.count(" ") == 1
            (joined if plain and not w[1].isspace() and not w[-1].isspace() else single).append(w)
        groups = [joined[k:k + JOINED] for k in range(0, len(joined), JOINED)]
        for group, e in zip(groups, self._library(map("".join, groups)), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            borders = [*(4 * np.flatnonzero(self.begins[ids])).tolist(), 4 * len(ids)]
            if len(borders) != len(group) + 1 or borders[0]:
                single += group
                continue
            packed = ids.tobytes()
            self.known.update((w, packed[a:b]) for w, a, b in zip(group, borders, borders[1:]))
        for w, e in zip(single, self._library(single), strict=True):
            self.known[w] = self.packed(e.ids)

    def _library(self, texts: Iterable[str]) -> list:
        return self.library.encode_batch_fast(list(texts), add_special_tokens=False)

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def library_codec(path: str) -> LibraryCodec:
    """One codec for each file and Python worker."""
    return LibraryCodec(path)
