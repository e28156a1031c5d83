"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

Greedy longest matching is not BPE, but a sequence of tokens is the BPE result exactly if
every adjacent pair is *compatible*: BPE applied to the two tokens' joined text gives the
two tokens back. So the encoder takes the longest token that an Aho-Corasick automaton
found at the current position, checks it against the token before it, falls back to the
next shorter token, and steps back where none fits. A bit per position marks ends that were
given up, so each position is given up once and the work is linear in the text.

Vocabularies with an end-of-word mark are handled by giving the last byte of a word its own
symbol. Words repeat, so their ids are kept in a bounded dictionary of each Python worker.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from tokenizers import Tokenizer

END = 0x1000  # added to the symbol of a word's last byte where the vocabulary marks ends
CACHE_WORDS = 400_000  # words kept per worker before the dictionary starts anew

# The contractions of the published pre-tokenizers, and Unicode's white space.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
# Texts of these characters only can be split by the faster module of the two.
PLAIN = re.compile("[^\x00-\x1b\x20-\x7f\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ſ‐-‧‰-›€]")
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"


def byte_symbols() -> list[str]:
    """The printable character of each byte: printable bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    symbols = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [symbols[b] for b in range(256)]


class Pieces:
    """Splits a text into the words that are encoded by themselves."""

    def __init__(self, space_joins: bool):
        lead = " ?" if space_joins else ""
        digits = "+" if space_joins else ""
        tail = rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+" if space_joins else ""
        self.fast = re.compile(rf"{CONTRACTIONS}|{lead}[{LETTERS}]+|{lead}[0-9]{digits}"
                               rf"|{lead}[^{SPACE}{LETTERS}0-9]+{tail}")
        self.full = regex.compile(rf"{CONTRACTIONS}|{lead}\p{{L}}+|{lead}\p{{N}}{digits}"
                                  rf"|{lead}[^{SPACE}\p{{L}}\p{{N}}]+{tail}")

    def __call__(self, text: str) -> list[str]:
        return (self.full if PLAIN.search(text) else self.fast).findall(text)


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = [(self.symbols(a), self.symbols(b), self.symbols(self._joined(a, b)))
                       for a, b in merges]
        self.ids = {self.symbols(t): i for t, i in self.words.items()}
        self.texts = {i: t for t, i in self.words.items()} | {
            i: t for t, i in self.special.items()}

    def _joined(self, a: str, b: str) -> str:
        return a + b

    def symbols(self, token: str) -> str:
        """The token with its end mark folded into its last character."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[:-len(self.end)]
            return body[:-1] + chr(ord(body[-1]) + END)
        return token


class Backtracker:
    """BPE of one word, by compatible longest matches."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.alphabet = byte_symbols()
        rank = {merged: r for r, (_, _, merged) in reversed(list(enumerate(vocab.merges)))}
        base = sorted({t for t in vocab.ids if len(t) == 1})
        order = base + sorted(rank, key=rank.__getitem__)
        # Tokens are numbered by age: single symbols first, then as the merges make them.
        self.age = {t: n for n, t in enumerate(order)}
        self.token_id = [vocab.ids[t] for t in order]
        self.length = [len(t) for t in order]
        self.split = [(n, n) for n in range(len(base))]
        self.made: dict[tuple[int, int], int] = {}
        first = {}
        for a, b, merged in vocab.merges:
            pair = (self.age[a], self.age[b])
            self.made.setdefault(pair, self.age[merged])
            first.setdefault(merged, pair)
        self.split += [first[t] for t in order[len(base):]]
        # A token that BPE never makes of its own text is not a match.
        self.live = [n < len(base) or self.compatible(*self.split[n], below=n)
                     for n in range(len(order))]
        self.automaton = ahocorasick.Automaton()
        for n, t in enumerate(order):
            if self.live[n]:
                self.automaton.add_word(t, n)
        self.automaton.make_automaton()
        self.shorter = [self._next_shorter(t) for t in order]

    def _next_shorter(self, token: str) -> int:
        for k in range(len(token) - 1, 0, -1):
            n = self.age.get(token[:k])
            if n is not None and self.live[n]:
                return n
        return -1

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether BPE of the two tokens' text keeps them apart (or, with ``below``, joins
        them only by the merge that makes token ``below``).

        Walks down the inner edge of the two tokens: a merge across the border that is older
        than the merges which have built both sides would have come first.
        """
        limit = len(self.age) if below is None else below
        while True:
            joined = self.made.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit, left = left, self.split[left][1]
                if left == limit:
                    limit, right = right + 1, self.split[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.split[right][0]
                if right + 1 == limit:
                    limit, left = left, self.split[left][1]
                    if left == limit:
                        return True

    def encode(self, symbols: str) -> list[int]:
        n = len(symbols)
        longest = [-1] * n
        for end, token in self.automaton.iter(symbols):
            longest[end - self.length[token] + 1] = token  # later ends are longer
        stack: list[int] = []
        open_end = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n:
            last = stack[-1] if stack else -1
            while token >= 0:
                end = at + self.length[token]
                if open_end[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                stack.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif stack:
                open_end[at] = 0
                token = stack.pop()
                at -= self.length[token]
                token = self.shorter[token]
            else:
                raise ValueError("no tokens cover this text")
        return [self.token_id[t] for t in stack]

    def word(self, word: str) -> bytes:
        """Ids of a word's UTF-8 bytes, as little-endian unsigned 32-bit integers."""
        symbols = "".join(map(self.alphabet.__getitem__, word.encode("utf-8")))
        if self.vocab.end and symbols:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + END)
        return np.array(self.encode(symbols), dtype="<u4").tobytes()


class WordCache(dict):
    """Ids of words met before; starts anew once it is full, so its memory is bounded."""

    def __init__(self, make: Callable[[str], bytes], limit: int = CACHE_WORDS):
        self.make, self.limit = make, limit

    def __missing__(self, word: str) -> bytes:
        ids = self.make(word)
        if len(self) >= self.limit:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


class Decoder:
    """Offset table: the text of token i is ``blob[starts[i]:starts[i + 1]]``.

    As the tokenizer files here name no usable decoder for words with end marks, the
    tokens are joined as the library does: by spaces where the file has no decoder, by
    nothing and through the byte alphabet where it is byte-level.
    """

    def __init__(self, vocab: Vocabulary, byte_level: bool):
        back = {s: b for b, s in enumerate(byte_symbols())}
        size = max(vocab.texts) + 1
        parts = []
        for i in range(size):
            t = vocab.texts.get(i, "")
            if not byte_level:
                parts.append((t + " ").encode("utf-8"))
            elif t in vocab.special or any(c not in back for c in t):
                parts.append(t.encode("utf-8"))
            else:
                parts.append(bytes(back[c] for c in t))
        self.blob = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.starts = np.cumsum([0, *map(len, parts)])
        self.byte_level = byte_level

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        ids = ids.astype(np.int64)
        lengths = self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(lengths)
        where = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + lengths, lengths)
        out = self.blob[where].tobytes()
        if not self.byte_level:
            return out[:-1]
        return out.decode("utf-8", errors="replace").encode("utf-8")


class Codec:
    """Encodes and decodes whole texts as the tokenizer file says."""

    def __init__(self, path: str):
        library = Tokenizer.from_file(path)
        self.vocab = Vocabulary(path)
        self.normalizer = library.normalizer
        self.byte_level = library.decoder is not None
        self.pieces = Pieces(space_joins=not self.vocab.end)
        names = sorted(self.vocab.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.special_ids = {t: np.array([i], dtype="<u4").tobytes()
                            for t, i in self.vocab.special.items()}
        self.words = WordCache(Backtracker(self.vocab).word)
        self.decoder = Decoder(self.vocab, self.byte_level)

    def _plain(self, text: str) -> bytes:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return b"".join(map(self.words.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return b"".join(self.special_ids[part] if part in self.special_ids else self._plain(part)
                        for part in self.special.split(text) if part)

    def decode(self, ids: bytes) -> bytes:
        return self.decoder.decode(np.frombuffer(ids, dtype="<u4"))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each file and Python worker."""
    return Codec(path)


def encode_all(path: str, texts: Iterable[str | None]) -> Iterator[bytes]:
    c = codec(path)
    return (c.encode(t or "") for t in texts)
